"""Diagnosis history and user feedback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from faultlens.functions import fixed_values as fv
from faultlens.functions.text import clip_chars
from faultlens.operators.knowledge import page_of
from faultlens.sources.stage import stage


def history_rows(
    diagnoses: DataFrame, session_id: Column | None = None, now: Column | None = None, *more: str
) -> DataFrame:
    """Diagnoses in the shape of the history table (without id), and the named further columns.

    Session ids are random by default.
    """
    return diagnoses.select(
        *more,
        (F.uuid() if session_id is None else session_id).alias("session_id"),
        F.col("original_hash").alias("log_hash"),
        clip_chars(F.col("processed_text"), fv.SNIPPET_CHARS).alias("log_snippet"),
        F.coalesce("retrieved_doc_ids", F.lit("")).alias("retrieved_doc_ids"),
        F.struct("root_cause", "analysis_process", "solution_steps", "confidence").alias("diagnosis_result"),
        F.col("model_used"),
        F.col("strategy").alias("prompt_strategy"),
        F.col("total_tokens").cast("long").alias("total_tokens"),
        F.col("latency_ms").cast("long").alias("latency_ms"),
        (F.current_timestamp() if now is None else now).alias("created_at"),
    )


def stable_session_id(log_hash: Column, strategy: Column, batch: Column | None = None) -> Column:
    """A session id that a repeated run gives again."""
    parts = [log_hash, strategy] + ([batch.cast("string")] if batch is not None else [])
    return F.left(F.sha2(F.concat_ws("|", *parts), 256), F.lit(36))


def history_by_session(history: DataFrame, session_id: str) -> DataFrame:
    return history.filter(F.col("session_id") == session_id).orderBy("id").limit(1)


def hash_lookup(logs: DataFrame, history: DataFrame) -> DataFrame:
    """Logs with the id and result of the first earlier diagnosis of the same text (null if new).

    logs(original_hash, ...), history(id, log_hash, diagnosis_result). The history is reduced to one row per
    hash with map-side aggregation and written, so that both join sides are plain exchanges and a hash that very
    many logs share is split.
    """
    first = history.groupBy(F.col("log_hash").alias("original_hash")).agg(
        F.min("id").alias("history_id"), F.min_by("diagnosis_result", "id").alias("cached_result")
    )
    return logs.join(stage(first, "first-diagnoses"), "original_hash", "left")


def lookup_within(logs: DataFrame, history: DataFrame, hours: int = 24) -> DataFrame:
    """Logs with the id and result of the last diagnosis of the same text up to ``hours`` before them (null if none).

    logs(original_hash, ts, ...), history(id, log_hash, created_at, diagnosis_result). Times are cut into hours: a log
    meets, per earlier hour of its hash, the last diagnosis alone, and within its own hour and the one at the far end all of them up to
    it. Hash and hour together are the key, so a hash in a third of all logs is spread over its hours. Logs without
    a time find nothing.
    """
    gap, hour = F.expr(f"INTERVAL {hours} HOURS"), lambda c: F.floor(F.unix_seconds(c) / 3600)
    times = history.filter("created_at IS NOT NULL").select(
        F.col("log_hash").alias("original_hash"), F.col("created_at").cast("timestamp").alias("at"), "id", "diagnosis_result"
    ).withColumn("h", hour(F.col("at")))
    asked = logs.withColumn("_row", F.monotonically_increasing_id()).withColumn("_ts", F.col("ts").cast("timestamp"))
    asked = stage(asked.withColumn("_hour", hour(F.col("_ts"))), "timed-logs")
    keys = asked.filter("_ts IS NOT NULL").select("original_hash", "_hour", "_ts").distinct()
    # whole hours in between: the last diagnosis of each, offered to the later hours it can serve; the latest offer counts
    offered = times.groupBy("original_hash", "h").agg(F.max(F.struct("at", "id", "diagnosis_result")).alias("d"))
    offered = offered.withColumn("_hour", F.explode(F.sequence(F.col("h") + 1, F.col("h") + hours - 1))) if hours > 1 else offered.limit(0).withColumn("_hour", F.col("h"))
    between = offered.groupBy("original_hash", "_hour").agg(F.max("d").alias("d"))
    # the hours at both ends: every diagnosis, compared by time
    ends = times.withColumn("_hour", F.explode(F.array(F.col("h"), F.col("h") + hours)))
    edge = keys.join(ends, ["original_hash", "_hour"]).filter((F.col("at") <= F.col("_ts")) & (F.col("at") >= F.col("_ts") - gap))
    edge = edge.groupBy("original_hash", "_ts").agg(F.max(F.struct("at", "id", "diagnosis_result")).alias("d"))
    wide = keys.join(between, ["original_hash", "_hour"]).select("original_hash", "_ts", "d")
    best = wide.unionByName(edge).groupBy("original_hash", "_ts").agg(F.max("d").alias("d"))
    found = stage(best.select("original_hash", "_ts", F.col("d.id").alias("history_id"), F.col("d.diagnosis_result").alias("cached_result")), "last-diagnoses")
    return asked.join(found, ["original_hash", "_ts"], "left").drop("_row", "_ts", "_hour")


def new_logs(logs: DataFrame, history: DataFrame) -> DataFrame:
    return logs.join(history.select(F.col("log_hash").alias("original_hash")), "original_hash", "left_anti")


def history_page(history: DataFrame, page: int = 1, size: int = 20) -> tuple[DataFrame, DataFrame]:
    """(page newest first, one-row total)."""
    order = [F.desc("created_at"), F.desc("id")]
    return page_of(history, order, page, size), history.agg(F.count(F.lit(1)).alias("total"))


def valid_feedback(rows: DataFrame, now: Column | None = None) -> DataFrame:
    """Feedback rows with a session and a value of 0 or 1, stamped with their arrival time."""
    good = rows.filter((F.coalesce("session_id", F.lit("")) != "") & F.col("feedback").isin(0, 1))
    return good.select(
        "session_id",
        F.col("feedback").cast("short").alias("feedback"),
        F.coalesce("user_comment", F.lit("")).alias("user_comment"),
        (F.current_timestamp() if now is None else now).alias("created_at"),
    )


def feedback_stats(feedback: DataFrame) -> DataFrame:
    return feedback.agg(
        F.count_if(F.col("feedback") == 1).alias("feedback_correct"),
        F.count_if(F.col("feedback") == 0).alias("feedback_incorrect"),
    )


def first_per_day(logs: DataFrame, hours: int = 24) -> DataFrame:
    """Logs not seen within the given hours before: logs(log_hash, ts, log_id) -> (log_hash, ts, log_id).

    A log repeats if the latest earlier log of the same hash is at most ``hours`` old. Within one hour only
    the first log of a hash can be new, so the rows shrink to one record per hash and hour (map-side) before
    any of them is compared; a hash that makes up a third of all logs costs no more than its hours.
    """
    return new_in_hours(hourly_records(logs), hours)


def hourly_records(logs: DataFrame) -> DataFrame:
    """(log_hash, hour, first(ts, log_id), last_ts): a record per hash and hour."""
    return logs.groupBy("log_hash", F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("hour")).agg(
        F.min(F.struct(F.col("ts").cast("timestamp").alias("ts"), "log_id")).alias("first"), F.max(F.col("ts").cast("timestamp")).alias("last_ts")
    )


def new_in_hours(hourly: DataFrame, hours: int) -> DataFrame:
    """First logs of hours before which the hash was not seen for more than ``hours``."""
    earlier = Window.partitionBy("log_hash").orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)
    seen, gap = F.max("last_ts").over(earlier), F.expr(f"INTERVAL {hours} HOURS")
    first = F.col("first.ts")
    return (
        hourly.withColumn("seen", seen)
        .filter(F.col("hour").isNotNull() & (F.col("seen").isNull() | (first > F.col("seen") + gap)))
        .select("log_hash", "first.ts", "first.log_id")
    )
