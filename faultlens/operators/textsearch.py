"""Text search in the knowledge table: all-words matching and substring matching.

Both searches run once per distinct query, not once per log: logs share few distinct keyword lists.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from faultlens.functions import fixed_values as fv
from faultlens.functions.tagging import search_vocabulary
from faultlens.functions.text import tokens
from faultlens.operators.postings import SearchIndex, article_words, found_now, pattern_grams, symptom_grams
from faultlens.sources.stage import stage

_WORD_PARTS = 16  # articles of a word meet the queries that ask for it in so many parts


def fts_match(queries: DataFrame, kb: DataFrame, index: SearchIndex | None = None) -> DataFrame:
    """Articles whose content and keywords hold every word of the query.

    queries(query_id, query_text), kb(id, content, keywords) -> (query_id, id, score), where the score is
    the share of the article's words that are query words. Per query only the postings of its rarest word
    are joined; the other words are checked inside the candidate's own word list, so frequent words never
    multiply rows. With an index the articles are not read at all, only the lists of the words asked for.
    """
    found = _match_sets(queries, kb, index)
    return _query_sets(queries).select("query_id", "q_key").join(found, "q_key").select("query_id", "id", "score")


def fts_topk(queries: DataFrame, kb: DataFrame, k: int = fv.TOP_K, index: SearchIndex | None = None) -> DataFrame:
    """Best k articles per query: (query_id, id, rank, score); ties by id."""
    order = Window.partitionBy("q_key").orderBy(F.desc("score"), "id")
    best = _match_sets(queries, kb, index).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return _query_sets(queries).select("query_id", "q_key").join(best, "q_key").select(
        "query_id", "id", "rank", "score"
    )


def _query_sets(queries: DataFrame) -> DataFrame:
    """Queries with their word set and a key that equal word sets share.

    Queries without words stay here and find nothing later: a filter on the words would be pushed through the
    projections that make the text, and multiply them.
    """
    words = F.array_sort(F.array_distinct(tokens(F.col("query_text"))))
    return queries.select("query_id", words.alias("q_tokens")).withColumn("q_key", F.array_join("q_tokens", " "))


def _match_sets(queries: DataFrame, kb: DataFrame, index: SearchIndex | None = None) -> DataFrame:
    """(q_key, id, score) for every distinct word set."""
    # the key is the whole set, so only the key is made distinct (a plain hash aggregation)
    sets = _query_sets(queries).select("q_key").distinct().withColumn("q_tokens", F.split("q_key", " "))
    if index is not None:
        return _match_kept(stage(sets, "word-sets"), index)
    set_words = sets.select("q_key", F.size("q_tokens").alias("n_words"), F.explode_outer("q_tokens").alias("word"))
    vocabulary = set_words.select("word").distinct()

    # explode_outer: explode would add a filter that splits every text a second time
    postings = article_words(kb).select("id", F.size("terms").alias("n_all"), F.explode_outer("terms").alias("word"))
    # one row per article: those of its words that any query asks for (bounded by its own text); written
    # once, so that the articles are read and split only once
    articles = stage(
        postings.join(vocabulary, "word")
        .groupBy("id")
        .agg(F.first("n_all").alias("n_all"), F.collect_list("word").alias("hits")),
        "postings",
    )
    posted = articles.select("id", F.explode(F.array_distinct("hits")).alias("term"))
    drivers = rarest_terms(set_words.withColumnsRenamed({"q_key": "asker", "word": "term", "n_words": "n_terms"}), posted)
    drivers = stage(drivers.withColumnRenamed("asker", "q_key").join(sets, "q_key"), "rarest-words")
    # an article brings its own words to the one join, those that are asked for together with the rarest, so no candidate is shuffled; candidates
    # are many times the rows that go in, so a word is cut into parts by article, and tasks are not put together by the size of those rows
    together = drivers.select("term", F.explode("q_tokens").alias("word")).distinct().groupBy("term").agg(F.collect_list("word").alias("together"))
    homes = articles.filter("id IS NOT NULL").withColumn("term", F.explode(F.array_distinct("hits"))).join(together, "term")
    homes = homes.select(
        "id", "n_all", "term", F.pmod(F.xxhash64("id"), F.lit(_WORD_PARTS)).cast("int").alias("part"),
        F.filter("hits", lambda w: F.array_contains("together", w)).alias("hits"),
    )
    n = int(kb.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = drivers.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(_WORD_PARTS - 1))))
    checked = homes.repartition(n, "term", "part").join(asked.repartition(n, "term", "part"), ["term", "part"]).filter(
        F.size(F.array_intersect("q_tokens", "hits")) == F.size("q_tokens")
    )
    matched = F.size(F.filter("hits", lambda w: F.array_contains(F.col("q_tokens"), w)))
    return checked.select("q_key", "id", (matched / F.col("n_all")).alias("score"))


def rarest_terms(asked: DataFrame, posted: DataFrame) -> DataFrame:
    """(asker, term): of asked(asker, term, n_terms) the term in the fewest articles of posted(term, id).

    Askers with a term that no article has are left out: the inner join loses that row, the count tells.
    """
    spread = posted.groupBy("term").agg(F.count(F.lit(1)).alias("n_articles"))
    per = asked.join(spread, "term").groupBy("asker").agg(
        F.min(F.struct("n_articles", "term")).alias("rarest"), F.count(F.lit(1)).alias("n_known"), F.first("n_terms").alias("n_terms")
    )
    return per.filter(F.col("n_known") == F.col("n_terms")).select("asker", F.col("rarest.term").alias("term"))


def _match_kept(sets: DataFrame, index: SearchIndex) -> DataFrame:
    """``_match_sets`` from the kept lists: candidates come from the rarest word, the others are looked up by word and article."""
    asked = sets.select(F.col("q_key").alias("asker"), F.size("q_tokens").alias("n_terms"), F.explode("q_tokens").alias("term"))
    vocabulary = stage(asked.select("term").distinct(), "asked-words")
    posted = stage(index.words.postings(vocabulary), "asked-postings")
    drivers = rarest_terms(asked, posted).join(sets.withColumnRenamed("q_key", "asker"), "asker")
    candidates = posted.join(drivers, "term").select(
        "asker", "id", "total", F.col("n").alias("n_rarest"), F.array_remove("q_tokens", F.col("term")).alias("others")
    )
    alone = candidates.filter(F.size("others") == 0).select("asker", "id", "total", F.col("n_rarest").alias("matched"))
    looked_up = candidates.select("asker", "id", "total", "n_rarest", F.size("others").alias("n_others"), F.explode("others").alias("term"))
    both = looked_up.join(posted.select("term", "id", "n"), ["term", "id"]).groupBy("asker", "id").agg(
        F.first("total").alias("total"), (F.first("n_rarest") + F.sum("n")).alias("matched"),
        F.count(F.lit(1)).alias("n_found"), F.first("n_others").alias("n_others"),
    )
    full = both.filter(F.col("n_found") == F.col("n_others")).select("asker", "id", "total", "matched")
    return alone.unionByName(full).select(F.col("asker").alias("q_key"), "id", (F.col("matched") / F.col("total")).alias("score"))


def like_hits(kb: DataFrame, k: int = fv.TOP_K, words: list[str] | None = None) -> DataFrame:
    """(keyword, id): per keyword the first k articles whose symptoms are LIKE %keyword%.

    Keywords come from a closed list, so each article tests them in one projection; at most
    k rows per keyword survive, whatever the size of the table.
    """
    words = [w for w in (words or search_vocabulary()) if len(w.encode()) >= fv.MIN_KEYWORD_BYTES]
    tests = [F.when(F.col("symptoms").like(f"%{w}%"), w).otherwise("") for w in words]
    found = kb.select("id", F.array_remove(F.array(*tests), "").alias("words")).select(
        F.explode_outer("words").alias("keyword"), "id"
    ).filter("keyword IS NOT NULL")
    return _first_ids(found, "keyword", k)


def open_hits(kb: DataFrame, keywords: DataFrame, k: int = fv.TOP_K, index: SearchIndex | None = None) -> DataFrame:
    """(keyword, id) for distinct, written keywords(keyword) of any kind: the first k articles per keyword.

    A substring has no key to join on, but runs of its characters have: an article can only match a keyword if it holds all
    runs of three characters of its literal parts (shorter parts: the whole part). The articles of the rarest run are
    candidates, LIKE decides. Keywords of nothing but wildcards have no run; they differ in the number of underscores only
    and are tested as one pattern per number.
    """
    asked = keywords.select(F.col("keyword").alias("asker"), pattern_grams(F.col("keyword")).alias("grams"))
    asked = stage(asked.withColumn("n_terms", F.size("grams")), "keyword-grams")
    runs = asked.select("asker", "n_terms", F.explode("grams").alias("term"))
    wanted = stage(runs.select("term").distinct(), "asked-grams")
    posted = index.grams.postings(wanted) if index is not None else found_now(symptom_grams(kb), wanted)
    posted = stage(posted.select("term", "id"), "gram-postings")
    candidates = posted.join(rarest_terms(runs, posted), "term").select("asker", "id")
    tested = candidates.join(kb.select("id", "symptoms"), "id")
    hits = tested.filter(F.expr("symptoms LIKE concat('%', asker, '%')")).select(F.col("asker").alias("keyword"), "id")
    bare = asked.filter("n_terms = 0").select("asker", F.translate("asker", "%", "").alias("pattern"))
    if not bare.isEmpty():
        patterns = bare.select("pattern", F.lit("").alias("one")).distinct()  # a row per number of underscores
        matched = kb.select("id", "symptoms", F.lit("").alias("one")).join(F.broadcast(patterns), "one")
        first = _first_ids(matched.filter(F.expr("symptoms LIKE concat('%', pattern, '%')")).select("pattern", "id"), "pattern", k)
        hits = hits.unionByName(bare.join(first, "pattern").select(F.col("asker").alias("keyword"), "id"))
    return _first_ids(hits, "keyword", k)


def _first_ids(hits: DataFrame, key: str, k: int) -> DataFrame:
    order = Window.partitionBy(key).orderBy("id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).drop("rank")


def like_match(queries: DataFrame, kb: DataFrame, k: int = fv.TOP_K, index: SearchIndex | None = None) -> DataFrame:
    """queries(query_id, keywords) -> (query_id, keyword, id), for keywords of any kind.

    Words of the closed list are tested in one projection of the articles; the other distinct keywords of the
    queries are looked up by ``open_hits``. Keywords under the least length find nothing.
    """
    asked = stage(queries.select("query_id", F.explode(F.array_distinct("keywords")).alias("keyword")), "asked")
    known = F.col("keyword").isin(search_vocabulary())
    other = asked.filter(~known & (F.octet_length("keyword") >= fv.MIN_KEYWORD_BYTES)).select("keyword").distinct()
    other = stage(other, "open-keywords")
    hits = like_hits(kb, k)
    if not other.isEmpty():
        hits = hits.unionByName(open_hits(kb, other, k, index))
    return asked.join(hits, "keyword").select("query_id", "keyword", "id")


def like_distinct(queries: DataFrame, kb: DataFrame, k: int = fv.TOP_K, index: SearchIndex | None = None) -> DataFrame:
    """Each article once per query, ranked by id: (query_id, id, rank).

    A query has at most k hits per keyword of the closed list, so its ids fit one small array.
    """
    ids = like_match(queries, kb, k, index).groupBy("query_id").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    return ids.select("query_id", F.posexplode("ids").alias("pos", "id")).select(
        "query_id", "id", (F.col("pos") + 1).alias("rank")
    )


def text_hits(logs: DataFrame, kb: DataFrame, k: int = fv.TOP_K, index: SearchIndex | None = None) -> DataFrame:
    """Both text searches for logs(query_id, keywords): (query_id, id, source, rank, n_source).

    The searches see each distinct keyword list once. Their bounded hit list (at most k + k per keyword)
    travels as one array per list, so joining it back to the logs is a plain one-to-many lookup.
    """
    keyed = logs.select("query_id", F.array_join("keywords", "\x01").alias("list_key"))
    # written: what follows must not be optimised together with the making of the keywords
    lists = stage(keyed.select("list_key").distinct(), "keyword-lists").withColumn("keywords", F.split("list_key", "\x01"))
    asked = lists.select(
        F.col("list_key").alias("query_id"), "keywords", F.array_join("keywords", " ").alias("query_text")
    )
    fts = fts_topk(asked, kb, k, index).select("query_id", "id", F.lit("fts").alias("source"), "rank")
    like = like_distinct(asked, kb, k, index).select("query_id", "id", F.lit("like").alias("source"), "rank")
    packed = (
        fts.unionByName(like)
        .groupBy(F.col("query_id").alias("list_key"))
        .agg(
            F.collect_list(F.struct("id", "source", "rank")).alias("hits"),
            F.count_if(F.col("source") == "fts").alias("n_fts"),
        )
    )
    return (
        keyed.select("query_id", "list_key")
        .join(packed, "list_key")
        .select("query_id", "n_fts", F.explode("hits").alias("hit"))
        .select("query_id", "hit.id", "hit.source", "hit.rank", F.col("n_fts").cast("int").alias("n_fts"))
    )
