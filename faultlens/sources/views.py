"""Logs, articles, cases, answers and results derived from the driver tables.

``raw_logs`` groups events by host and by blocks of 1000 consecutive events, so a log can never have more
than 1000 entries, however uneven the hosts are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from faultlens.functions import fixed_values as fv
from faultlens.functions.text import clip_chars, whole_div

HOSTS = 50
BLOCK = 1000
FAULTS = fv.KEY_ERRORS + fv.RETRIEVAL_WORDS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """For heavy work per row: spreads the rows over the cores if the files have fewer splits than that.

    Larger inputs stay as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def pick(words: list[str], index: Column) -> Column:
    """One of the words by index, round and round."""
    listed = F.split(F.lit("\x01".join(words)), "\x01")
    return F.element_at(listed, (index % len(words) + 1).cast("int"))


def fault(index: Column) -> Column:
    return pick(FAULTS, index)


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def event_lines(events: DataFrame, parts: int | None = None) -> DataFrame:
    """One log line (or stack trace) per event: log_id, ts, event_id, user_id, line; dealt by log to ``parts`` before the lines are made, if given."""
    host, block = F.col("user_id") % HOSTS, whole_div(F.col("event_id"), BLOCK)
    base = events.select(
        (block * HOSTS + host).alias("log_id"),
        "ts", "event_id", "user_id", "event_type",
        host.alias("host"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )
    if parts is not None:
        base = base.repartition(parts, "log_id")
    event_id, user_id, k = F.col("event_id"), F.col("user_id"), F.col("k")
    name = fault(F.col("log_id") + event_id % 2)
    body = (
        F.when((F.col("event_type") == "error") & (k < 50) & (event_id % 3 == 0), _text(
            name, " in worker\n    at com.shop.Worker.run(Worker.java:", k, ") WARN frame\n",
            "Caused by: java.io.IOException: ", name))
        .when((F.col("event_type") == "error") & (k < 50), _text(name, " for user", user_id))
        .when(F.col("event_type") == "error", _text("request failed, retry ", k))
        .when((F.col("event_type") == "purchase") & (k % 2 == 0), _text(
            "payment retry user", user_id, "@mail.example.com password=p", event_id))
        .when(F.col("event_type") == "purchase", _text("slow checkout from 10.", k, ".", F.col("host"), ".", event_id % 256))
        .when(F.col("event_type") == "signup", _text("issued token: ", F.md5(event_id.cast("string")), " to user", user_id))
        .when(F.col("event_type") == "view", _text("cache lookup took ", k, " ms"))
        .otherwise(_text("span closed after ", k, " us"))
    )
    level = (
        F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "purchase", "WARN")
        .when(F.col("event_type") == "signup", "INFO").when(F.col("event_type") == "view", "DEBUG")
        .otherwise("TRACE")
    )
    line = _text(F.substring(F.col("ts").cast("string"), 1, 19), " ", level, " [svc", F.col("host"), "] ", body)
    return base.select("log_id", "ts", "event_id", "user_id", line.alias("line"))


def raw_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log_id, content, source_type, ts, strategy, use_rag"""
    # what the lines are made of is several times smaller than the lines; parts enough for the work on the texts that follows
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return logs_of_lines(event_lines(table(spark, sf_dir, "events"), parts))


def logs_of_lines(lines: DataFrame) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("ts", "event_id", "line")))
    logs = lines.groupBy("log_id").agg(
        F.array_join(F.transform(ordered, lambda x: x.line), "\n").alias("content"),
        F.min("ts").alias("ts"),
    )
    return logs.select(
        "log_id", "content", F.lit("PASTE").alias("source_type"), "ts",
        pick(["zero_shot", "cot", "FEW_SHOT", "unknown"], F.col("log_id")).alias("strategy"),
        (F.col("log_id") % 3 != 0).alias("use_rag"),
    )


def kb_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as articles: id, title, content, category, keywords, symptoms"""
    doc_id = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        doc_id.alias("id"),
        clip_chars(F.col("text"), fv.SEED_TITLE_CHARS).alias("title"),
        F.col("text").alias("content"),
        F.col("source").alias("category"),
        F.concat_ws(",", fault(doc_id), fault(doc_id + 1), fault(doc_id + 2)).alias("keywords"),
        F.concat_ws(",", fault(doc_id), fault(doc_id + 7)).alias("symptoms"),
    )


def kb_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The knowledge table before any change: labelled articles carry a vector, the others have none."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    stamp = F.to_timestamp(F.lit("2024-01-01 00:00:00"))
    return (
        kb_text(spark, sf_dir).join(vectors, "id", "left")
        .withColumn("created_at", stamp).withColumn("updated_at", stamp)
    )


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One case per log: id, category, log, expected_root_cause, expected_keywords"""
    log_id = F.col("log_id")
    words = F.array(*[fault(log_id * 3 + i * 5) for i in range(6)])
    return raw_logs(spark, sf_dir).select(
        F.concat(F.lit("case_"), F.lpad(log_id.cast("string"), 6, "0")).alias("id"),
        pick(fv.CASE_CATEGORIES, log_id).alias("category"),
        F.col("content").alias("log"),
        F.concat(F.lit("服务异常 "), fault(log_id), F.lit(" 与 "), fault(log_id + 1)).alias("expected_root_cause"),
        F.slice(words, F.lit(1), (log_id % 3 + 4).cast("int")).alias("expected_keywords"),
    )


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns as model answers in every shape the parser must handle: conv_id, turn, raw_content"""
    turns = table(spark, sf_dir, "conversations").filter(F.col("role") == "assistant")
    conv_id, turn = F.col("conv_id"), F.col("turn")
    cause = F.concat(F.lit("Suspected "), fault(conv_id * 4 + turn))
    good = F.to_json(F.struct(
        cause.alias("root_cause"), F.col("text").alias("analysis_process"),
        F.array(F.lit("check logs"), F.concat(F.lit("restart svc"), conv_id.cast("string"))).alias("solution_steps"),
        ((conv_id % 50) / F.lit(100.0) + F.lit(0.5)).alias("confidence"),
    ))
    shape = (conv_id + turn) % 7
    raw = (
        F.when(shape == 0, good)
        .when(shape == 1, F.concat(F.lit("Here is the result:\n"), good, F.lit("\nHope it helps.")))
        .when(shape == 2, F.concat(F.lit("{broken "), F.translate("text", '{}"', "")))
        .when(shape == 3, F.concat(F.lit('{"root_cause": 5, "confidence": "0.9", "solution_steps": ["a", 7, null], "n": '), conv_id.cast("string"), F.lit("}")))
        .when(shape == 4, F.lit("null"))
        .when(shape == 5, F.concat(F.lit("["), good, F.lit("]")))
        .otherwise(F.concat(F.lit('{"root_cause": "'), cause, F.lit('", "confidence": 1, "solution_steps": "none"}')))
    )
    return turns.select("conv_id", "turn", raw.alias("raw_content"))


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Experiment result rows from events."""
    event_id, k = F.col("event_id"), F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("case_"), F.col("user_id").cast("string")).alias("case_id"),
        F.col("event_type").alias("category"),
        pick(fv.MODES, whole_div(event_id, 4)).alias("mode"),
        pick(fv.STRATEGIES + ["OTHER"], event_id).alias("strategy"),
        F.concat(F.lit('cause "'), fault(event_id), F.lit('", seen '), k.cast("string"), F.lit(" times")).alias("predicted_cause"),
        F.concat(F.lit("expected "), fault(event_id + k)).alias("expected_cause"),
        (k + event_id % 4 * 10 < 70).alias("is_correct"),
        (k / F.lit(128.0)).alias("confidence"),
        (F.lit(1500) + k * 37 + event_id % 11).cast("long").alias("latency_ms"),
        (k % 5).cast("int").alias("knowledge_used"),
        (F.lit(400) + k * 7).cast("int").alias("tokens_used"),
        F.concat(F.lit("log of event "), event_id.cast("string")).alias("log_snippet"),
        F.when(k == 13, "no answer after 3 attempts").otherwise("").alias("error"),
    )


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feedback from labels: session_id, feedback, user_comment"""
    return table(spark, sf_dir, "labels").select(
        F.concat(F.lit("session-"), F.col("doc_id").cast("string")).alias("session_id"),
        F.col("quality").alias("feedback"),
        F.when(F.col("toxic") == 1, "rude answer").alias("user_comment"),
    )


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Earlier diagnoses, one per document: the whole history schema."""
    doc_id = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        doc_id.alias("id"),
        F.concat(F.lit("session-"), doc_id.cast("string")).alias("session_id"),
        F.sha2("text", 256).alias("log_hash"),
        clip_chars(F.col("text"), fv.SNIPPET_CHARS).alias("log_snippet"),
        F.concat_ws(",", (doc_id % 7).cast("string"), (doc_id % 11).cast("string")).alias("retrieved_doc_ids"),
        F.struct(
            fault(doc_id).alias("root_cause"), F.col("lang").alias("analysis_process"),
            F.array(F.col("source"), F.lit("restart")).alias("solution_steps"),
            ((doc_id % 64) / F.lit(64.0)).alias("confidence"),
        ).alias("diagnosis_result"),
        F.lit(fv.MODEL_NAME).alias("model_used"),
        pick(fv.STRATEGIES, doc_id).alias("prompt_strategy"),
        F.col("n_chars").alias("total_tokens"),
        (doc_id * 13 % 5000).alias("latency_ms"),
        F.timestamp_seconds(F.lit(1704067200) + doc_id * 977 % 86400).alias("created_at"),
    )
