"""The knowledge table: lookups, paging, and changes that return the new table state."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from faultlens.functions import articles as art
from faultlens.functions import fixed_values as fv
from faultlens.functions.text import clip_chars, embed_text, whole_div
from faultlens.operators.embedding import hashed_vectors
from faultlens.sources.stage import stage

TEXT_FIELDS = ["title", "content", "category", "keywords", "symptoms"]
FIELDS = ["id", *TEXT_FIELDS, "embedding", "created_at", "updated_at"]
COPY_CHUNK = 10_000
SEARCHED = ["title", "content", "keywords", "symptoms", "category"]


def kb_scan(kb: DataFrame) -> DataFrame:
    return kb.orderBy(F.desc("id"))


def kb_by_id(kb: DataFrame, article_id: int) -> DataFrame:
    return kb.filter(F.col("id") == article_id)


def kb_by_category(kb: DataFrame, category: str) -> DataFrame:
    return kb.filter(F.col("category") == category).orderBy(F.desc("id"))


def kb_search(kb: DataFrame, keyword: str = "", escape: bool = False) -> DataFrame:
    """Articles with %keyword% in any text field; ``%`` and ``_`` act as wildcards unless escaped."""
    if not keyword:
        return kb
    if escape:
        hits = [F.contains(F.col(c), F.lit(keyword)) for c in SEARCHED]
    else:
        hits = [F.col(c).like(f"%{keyword}%") for c in SEARCHED]
    return kb.filter(reduce(Column.__or__, hits))


def clamp_page(page: int, size: int) -> tuple[int, int]:
    return max(page, 1), size if 1 <= size <= 100 else 20


def page_of(df: DataFrame, order: list[Column], page: int, size: int) -> DataFrame:
    page, size = clamp_page(page, size)
    return df.orderBy(*order).offset((page - 1) * size).limit(size)


def kb_page(kb: DataFrame, keyword: str = "", page: int = 1, size: int = 20) -> tuple[DataFrame, DataFrame]:
    """(page newest id first, one-row total of all matches)."""
    found = kb_search(kb, keyword)
    return page_of(found, [F.desc("id")], page, size), found.agg(F.count(F.lit(1)).alias("total"))


def page_after(df: DataFrame, order: list[str], after: tuple | None = None, size: int = 20) -> DataFrame:
    """The next rows in descending ``order`` (columns that tell rows apart, without nulls) after the last row of a page.

    ``after`` are that row's values, None for the first page. No row before the cursor is sorted: the filter on the
    first column reaches the scan, where sorted files (``write_pages``) are skipped by their least and greatest values, and every task
    sends ``size`` rows at most.
    """
    _, size = clamp_page(1, size)
    if after is not None:
        first, cursor = F.lit(after[0]), F.struct(*[F.lit(v).cast(df.schema[c].dataType).alias(c) for c, v in zip(order, after)])
        df = df.filter((F.col(order[0]) <= first.cast(df.schema[order[0]].dataType)) & (F.struct(*order) < cursor))
    return df.orderBy(*[F.desc(c) for c in order]).limit(size)


def write_pages(df: DataFrame, order: list[str], path: str, rows_per_file: int = 1_000_000) -> None:
    """Writes the table in ranges of ``order``, newest first, as ``page_after`` reads it."""
    descending = [F.desc(c) for c in order]
    df.repartitionByRange(*descending).sortWithinPartitions(*descending).write.option("maxRecordsPerFile", rows_per_file).mode("errorifexists").parquet(path)


def kb_missing_embedding(kb: DataFrame) -> DataFrame:
    return kb.filter(F.col("embedding").isNull())


def kb_embedding_count(kb: DataFrame) -> DataFrame:
    return kb.agg(F.count("embedding").alias("n_embedded"))


def kb_count(kb: DataFrame) -> DataFrame:
    return kb.agg(F.count(F.lit(1)).alias("n_articles"))


def _is_valid() -> Column:
    return (F.coalesce("title", F.lit("")) != "") & (F.coalesce("content", F.lit("")) != "")


def kb_valid_rows(rows: DataFrame) -> DataFrame:
    return rows.filter(_is_valid())


def kb_rejected_rows(rows: DataFrame) -> DataFrame:
    return rows.filter(~_is_valid())


def number_rows(rows: DataFrame, start: DataFrame, out: str = "id", order: Column | None = None) -> DataFrame:
    """Gapless ids after ``start`` (one row, column ``last_id``), ordered by the md5 of the whole row, or by another one given as ``order``.

    The hash prefix cuts the rows into 4096 even buckets that are numbered side by side; only the bucket
    sizes are added up in one place. Equal rows are counted first and written out again in chunks, so a row
    that makes up a third of the input does not end up in one task.
    """
    fields = rows.columns
    counted = (
        rows.groupBy(*fields).agg(F.count(F.lit(1)).alias("_times"))
        .withColumn("_hash", F.md5(F.concat_ws("\x01", *fields)) if order is None else order)
        .withColumn("_bucket", F.substring("_hash", 1, 3))
    )
    sizes = counted.groupBy("_bucket").agg(F.sum("_times").alias("_size"))
    before = F.sum("_size").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("_bucket", F.coalesce(before, F.lit(0)).alias("_before"))
    in_bucket = F.sum("_times").over(
        Window.partitionBy("_bucket").orderBy("_hash", *fields).rowsBetween(Window.unboundedPreceding, -1)
    )
    last = start.select("last_id", F.lit(True).alias("_one"))
    first = (
        counted.withColumn("_inner", F.coalesce(in_bucket, F.lit(0)))
        .join(F.broadcast(offsets), "_bucket")  # at most 4096 rows
        .withColumn("_one", F.lit(True))
        .join(F.broadcast(last), "_one")  # one row
        .select(*fields, "_times", (F.col("last_id") + F.col("_before") + F.col("_inner") + 1).alias("_first"))
    )
    chunk = F.explode(F.sequence(F.lit(0).cast("long"), whole_div(F.col("_times") - 1, COPY_CHUNK)))
    chunks = first.withColumn("_chunk", chunk)
    rest = F.least(F.col("_times") - F.col("_chunk") * COPY_CHUNK, F.lit(COPY_CHUNK).cast("long"))
    spread = chunks.select(
        *fields, (F.col("_first") + F.col("_chunk") * COPY_CHUNK).alias("_first"), rest.alias("_copies")
    ).repartition("_first")
    return spread.select(
        *fields, F.explode(F.sequence(F.col("_first"), F.col("_first") + F.col("_copies") - 1)).alias(out)
    )


def _last_id(kb: DataFrame) -> DataFrame:
    return kb.agg(F.coalesce(F.max("id"), F.lit(0)).cast("long").alias("last_id"))


def _with_vectors(rows: DataFrame, embed, key: str = "id") -> DataFrame:
    """Adds ``new_embedding`` (null where embedding failed or is switched off)."""
    if embed is None:
        return rows.withColumn("new_embedding", F.lit(None).cast("array<float>"))
    texts = rows.select(key, embed_text(F.col("title"), F.col("content")).alias("text"))
    vectors = embed(texts, key, "text").withColumnRenamed("embedding", "new_embedding")
    return rows.join(vectors, key, "left")


def kb_insert(kb: DataFrame, rows: DataFrame, embed=hashed_vectors, now: Column | None = None) -> DataFrame:
    """New table state with the valid rows appended under new ids; rows(title, content, ...)."""
    return kb.select(*FIELDS).unionByName(new_rows(kb, rows, embed, now))


def new_rows(kb: DataFrame, rows: DataFrame, embed=hashed_vectors, now: Column | None = None) -> DataFrame:
    """The valid rows as rows of the table, under ids after those of kb(id)."""
    now = F.current_timestamp() if now is None else now
    numbered = number_rows(kb_valid_rows(rows).select(*TEXT_FIELDS), _last_id(kb))
    return _with_vectors(numbered, embed).select(
        "id", *TEXT_FIELDS, F.col("new_embedding").alias("embedding"),
        now.alias("created_at"), now.alias("updated_at"),
    )


def kb_update(kb: DataFrame, changes: DataFrame, embed=hashed_vectors, now: Column | None = None) -> DataFrame:
    """New table state: the five text fields of known ids are replaced in full and embedded again; where
    that fails the old vector stays. changes(id, title, ...) hold at most one row per id."""
    now = F.current_timestamp() if now is None else now
    known = changes.select("id", *TEXT_FIELDS).join(kb.select("id"), "id", "left_semi")
    new = _with_vectors(known, embed)
    new = new.select("id", *[F.col(c).alias(f"new_{c}") for c in TEXT_FIELDS], "new_embedding", F.lit(True).alias("hit"))
    joined = kb.join(new, "id", "left")
    return joined.select(
        "id",
        *[F.when(F.col("hit"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in TEXT_FIELDS],
        F.coalesce("new_embedding", "embedding").alias("embedding"),
        "created_at",
        F.when(F.col("hit"), now).otherwise(F.col("updated_at")).alias("updated_at"),
    )


def kb_update_rejects(kb: DataFrame, changes: DataFrame) -> DataFrame:
    """Changes for ids that do not exist."""
    return changes.join(kb.select("id"), "id", "left_anti")


def kb_delete(kb: DataFrame, ids: DataFrame) -> DataFrame:
    """New table state without the given ids; unknown ids are no error."""
    return kb.join(ids.select("id"), "id", "left_anti")


def kb_backfill(kb: DataFrame, embed=hashed_vectors) -> DataFrame:
    """New table state with vectors for the rows that have none; failed rows stay without.

    Where ``embed`` has the function of its ``column``, rows whose id is theirs alone are filled in place, so no text is shuffled.
    """
    if not hasattr(embed, "column"):
        return _filled(kb, embed)
    missing = F.col("embedding").isNull()
    ids = kb.filter("id IS NOT NULL").groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.count_if(missing).alias("n_missing"))
    repeated = stage(ids.filter("n > 1 AND n_missing > 0").select("id"), "repeated-ids")
    some = not repeated.isEmpty()
    alone = kb.join(repeated, "id", "left_anti") if some else kb
    todo = F.when(missing & F.col("id").isNotNull(), embed_text(F.col("title"), F.col("content")))  # other rows have no text to embed
    names = ["id", *(c for c in kb.columns if c != "id")]
    filled = alone.withColumn("embedding", F.coalesce("embedding", embed.column(todo))).select(*names)
    return filled.unionByName(_filled(kb.join(repeated, "id", "left_semi"), embed)) if some else filled


def _filled(kb: DataFrame, embed) -> DataFrame:
    todo = kb_missing_embedding(kb).select("id", "title", "content")
    vectors = _with_vectors(todo, embed).select("id", "new_embedding")
    return kb.join(vectors, "id", "left").withColumn(
        "embedding", F.coalesce("embedding", "new_embedding")
    ).drop("new_embedding")


def articles_from_cases(cases: DataFrame) -> DataFrame:
    """One article per case: title, content, category, keywords, symptoms."""
    words = F.array_join("expected_keywords", ",")
    return cases.select(
        art.seed_title(F.col("category"), F.col("expected_root_cause")).alias("title"),
        art.seed_content(
            F.col("category"), F.col("expected_root_cause"), F.col("expected_keywords"), F.col("log")
        ).alias("content"),
        "category",
        words.alias("keywords"),
        words.alias("symptoms"),
    )


def _text_key() -> Column:
    return F.sha2(F.concat_ws("\x01", "title", "content"), 256)


def not_in_table(articles: DataFrame, kb: DataFrame) -> DataFrame:
    """Articles whose title and content no row of the table has."""
    return articles.withColumn("_key", _text_key()).join(kb.select(_text_key().alias("_key")), "_key", "left_anti").drop("_key")


def kb_seed(kb: DataFrame, cases: DataFrame, embed=hashed_vectors, now: Column | None = None) -> DataFrame:
    """Fills the table from cases. Articles already there (same title and content) are not added twice, and
    their missing vectors are filled in.

    Where ``embed`` has the function of its ``column``, new articles are found and numbered by their hashes, and their texts shuffled once.
    """
    articles = articles_from_cases(cases).withColumn("_key", _text_key())
    if not hasattr(embed, "column"):
        return kb_insert(kb_backfill(kb, embed), not_in_table(articles.dropDuplicates(["_key"]).drop("_key"), kb), embed, now)
    filled = kb_backfill(kb, embed).select(*FIELDS)
    articles = kb_valid_rows(articles).withColumn("_row", F.md5(F.concat_ws("\x01", *TEXT_FIELDS)))
    keys = articles.groupBy("_key").agg(F.min("_row").alias("_row"))
    known = kb.select(_text_key().alias("_key")).distinct()  # distinct: outer joins that kb is made of are not needed for it
    fresh = stage(keys.join(known, "_key", "left_anti"), "fresh-keys")
    if fresh.isEmpty():
        return filled
    numbered = number_rows(fresh, _last_id(kb), order=F.col("_row"))
    new = articles.dropDuplicates(["_key", "_row"]).join(numbered, ["_key", "_row"])
    now = F.current_timestamp() if now is None else now
    vector = embed.column(embed_text(F.col("title"), F.col("content")))
    return filled.unionByName(new.select("id", *TEXT_FIELDS, vector.alias("embedding"), now.alias("created_at"), now.alias("updated_at")))


def articles_from_diagnoses(diagnoses: DataFrame) -> DataFrame:
    """Articles learned from diagnoses whose search had no hits. Fallback answers are not learned; equal
    logs teach one article. Needs rag_missed, parse_kind, original_hash, key_errors and the answer fields."""
    usable = F.col("rag_missed") & (F.col("root_cause") != "") & (F.col("parse_kind") != "failed")
    words = F.array_join("key_errors", ",")
    learned = diagnoses.filter(usable).select(
        "original_hash",
        clip_chars(F.col("root_cause"), fv.TITLE_CHARS).alias("title"),
        art.learned_content(F.col("root_cause"), F.col("analysis_process"), F.col("solution_steps")).alias("content"),
        art.infer_category(F.col("key_errors")).alias("category"),
        words.alias("keywords"),
        words.alias("symptoms"),
    )
    one = learned.groupBy("original_hash").agg(F.min(F.struct(*TEXT_FIELDS)).alias("a"))
    return one.select("a.*")


def auto_learn(
    kb: DataFrame, diagnoses: DataFrame, embed=hashed_vectors, now: Column | None = None, learned: DataFrame | None = None
) -> DataFrame:
    """New table state with what the diagnoses teach. What the table holds already is not learned again, nor are logs with a
    fingerprint in learned(log_hash), so a run over the same misses adds nothing."""
    if learned is not None:
        known = learned.select(F.col("log_hash").alias("original_hash"))
        diagnoses = diagnoses.join(known, "original_hash", "left_anti")
    return kb_insert(kb, not_in_table(articles_from_diagnoses(diagnoses), kb), embed, now)
