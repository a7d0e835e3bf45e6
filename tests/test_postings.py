"""Kept inverted lists: searches read them instead of the articles and find the same."""

import random
import re

import pytest
from pyspark.sql import functions as F

from faultlens.operators import postings, textsearch as ts

KB = "id long, title string, content string, category string, keywords string, symptoms string"
VOCABULARY = [f"w{i}" for i in range(14)]
PARTS = ["CPU", "disk full", "100%", "a_b", "连接池", "c\\d", "", "ab", "abc", "x"]


def article(rng, i):
    content = "w0 " * rng.randint(0, 3) + " ".join(rng.choices(VOCABULARY, k=rng.randint(0, 9)))
    return (i, "", content, "", rng.choice(["w1,W2", None, ""]), rng.choice([None, ",".join(rng.choices(PARTS, k=rng.randint(0, 4)))]))


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    """Three segments: some articles come, change, come back and go; and the articles as they are in the end."""
    rng = random.Random(11)
    first = {i: article(rng, i) for i in range(90)}
    second = {i: article(rng, i) for i in [*range(0, 90, 7), *range(90, 120)]}
    third = {i: article(rng, i) for i in (5, 95, 14)}
    gone = [[*range(3, 60, 9)], [7, 91, 5]]
    index = postings.search_index(spark, str(tmp_path_factory.mktemp("kept")), buckets=5)
    now = {}
    for segment, (rows, out) in enumerate(((first, []), (second, gone[0]), (third, gone[1]))):
        ids = [(i,) for i in out if i not in rows]
        now = {k: v for k, v in {**now, **rows}.items() if (k,) not in ids}
        articles = spark.createDataFrame(list(rows.values()), KB)
        index.add(articles, segment, spark.createDataFrame(ids, "id long") if out else None)
    return index, spark.createDataFrame(list(now.values()), KB), now


def test_full_text_from_kept_lists(spark, built):
    index, kb, now = built
    rng = random.Random(3)
    queries = [(i, " ".join(rng.choices(VOCABULARY + ["unknown"], weights=[3] * 14 + [1], k=rng.randint(0, 4)))) for i in range(50)]
    queries += [(100, "w0"), (101, "W0 w0!"), (102, ""), (103, None)]
    asked = spark.createDataFrame(queries, "query_id long, query_text string")
    words = lambda t: [w for w in re.split(r"[^a-z0-9]+", t.lower()) if w]
    want = set()
    for query_id, text in queries:
        wanted = set(words(text or ""))
        for row in now.values():
            have = words((row[2] or "") + " " + (row[4] or ""))
            if wanted and wanted <= set(have):
                want.add((query_id, row[0], sum(w in wanted for w in have) / len(have)))
    assert {tuple(r) for r in ts.fts_match(asked, kb, index).collect()} == want and len(want) > 50
    assert {tuple(r) for r in ts.fts_topk(asked, kb, 3, index).collect()} == {tuple(r) for r in ts.fts_topk(asked, kb, 3).collect()}


def test_open_keywords_from_kept_and_new_grams(spark, built):
    index, kb, _ = built
    words = ["CPU", "cpu", "isk f", "0%", "a_b", "a\\_b", "连接", "接", "c\\\\d", "%", "__", "___%_", "zz", "b,a", "x", "ab", "abc,ab", "_CPU%ab", "\\%"]
    keywords = spark.createDataFrame([(w,) for w in words], "keyword string")
    plain = kb.crossJoin(keywords).filter(F.expr("symptoms LIKE concat('%', keyword, '%')")).groupBy("keyword").agg(
        F.slice(F.array_sort(F.collect_list("id")), 1, 4).alias("ids"))
    want = {(r.keyword, i) for r in plain.collect() for i in r.ids}
    for kept in (index, None):
        found = ts.open_hits(kb, keywords, 4, kept)
        assert {tuple(r) for r in found.collect()} == want
    assert len({w for w, _ in want}) > 12
    some = ts.open_hits(kb, spark.createDataFrame([("CPU",), ("disk",)], "keyword string"), 4)
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert not re.search("NestedLoop|Cartesian|Python", plan)
    assert ts.open_hits(kb, keywords.limit(0), 4, index).count() == 0


def test_a_search_reads_the_buckets_of_its_words(spark, built):
    index, _, _ = built
    asked = spark.createDataFrame([("w3",)], "term string")
    bucket = asked.select(index.words._bucket().alias("b")).first().b
    found = index.words.postings(asked)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(rf"PartitionFilters: \[[^\]]*bucket#\d+ (= {bucket}\b|IN \({bucket}\))", plan), plan


def test_a_segment_written_again_replaces_itself(spark, built, tmp_path):
    _, kb, now = built
    index = postings.search_index(spark, str(tmp_path), buckets=3)
    for _ in range(2):
        index.add(kb, 0)
    rows = [tuple(r) for r in index.words.postings().collect()]
    assert len(rows) == len(set(rows)) and sorted(rows) == sorted(map(tuple, postings.postings_of(postings.article_words(kb)).collect()))
    index.add(kb.filter("id < 20"), 1, spark.createDataFrame([(30,)], "id long"))
    one = index.words.compacted(str(tmp_path / "one"))
    assert sorted(map(tuple, one.postings().collect())) == sorted(r for r in rows if r[1] != 30) and one.segments() == [0]


def test_a_word_in_most_articles_is_cut(spark, tmp_path):
    kb = spark.range(400).selectExpr("id", "'' AS title", "concat('common w', id) AS content", "'' AS category", "'' AS keywords", "'' AS symptoms")
    index = postings.TermIndex(spark, str(tmp_path), postings.article_words, 2)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as with rows enough to fill the tasks
    index.add(kb, 0, slice_articles=50)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    asked = spark.createDataFrame([("common",)], "term string")
    assert index.postings(asked).count() == 400
    files = spark.read.parquet(f"{tmp_path}/postings").filter("term = 'common'").groupBy(F.input_file_name()).count().collect()
    assert len(files) >= 4 and max(r["count"] for r in files) <= 200


def test_empty_tables(spark, tmp_path):
    kb = spark.createDataFrame([], KB)
    index = postings.search_index(spark, str(tmp_path))
    index.add(kb, 0)
    assert index.words.postings().count() == 0
    assert ts.fts_topk(spark.createDataFrame([(1, "a b")], "query_id long, query_text string"), kb, 3, index).count() == 0
    assert ts.open_hits(kb, spark.createDataFrame([("ab",), ("%",)], "keyword string"), 3, index).count() == 0
