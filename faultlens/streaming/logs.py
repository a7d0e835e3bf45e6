"""Arriving logs: the batch operators on Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from faultlens.functions import fixed_values as fv
from faultlens.operators.embedding import hashed_vectors
from faultlens.operators.history import history_rows, stable_session_id
from faultlens.operators.hybrid import hybrid_search, retrieved_ids
from faultlens.operators.postings import SearchIndex
from faultlens.operators.preprocess import preprocess, with_keywords
from faultlens.sources.stage import stage

EVERYTHING = {"availableNow": True}  # all that is there now, then stop
_EMPTY_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"
_HOUR = 3_600_000_000


def arriving(spark: SparkSession, path: str, schema, **options: str) -> DataFrame:
    """A stream over the parquet files of a folder; options such as maxFilesPerTrigger or pathGlobFilter."""
    return spark.readStream.schema(schema).options(**options).parquet(path)


def stream_preprocess(logs: DataFrame, text: str = "content", max_tokens: int = fv.MAX_TOKENS) -> DataFrame:
    """Stateless: the same columns as in batch."""
    return preprocess(logs, text, max_tokens)


def _records(logs: DataFrame) -> DataFrame:
    """Logs(log_hash, ts, log_id) of each Arrow batch as a record per hash and hour, with what late ones are needed for.

    Stateless, so it runs before the shuffle: a hash in a third of all logs sends a record per batch and hour.
    """
    ids = logs.schema["log_id"].dataType.simpleString()

    def reduce(frames):
        for frame in frames:
            frame["hour"] = frame["ts"] // _HOUR  # missing where ts is
            frame = frame.sort_values(["ts", "log_id"])
            groups = frame.groupby(["log_hash", "hour"], dropna=False, sort=False)
            out = groups.agg(first=("ts", "first"), last=("ts", "last"), times=("ts", list), ids=("log_id", list)).reset_index()
            yield out.astype({"hour": "Int64", "first": "Int64", "last": "Int64"})

    rows = logs.select("log_hash", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), "log_id")
    reduced = rows.mapInPandas(reduce, f"log_hash string, hour long, first long, last long, times array<long>, ids array<{ids}>")
    return reduced.withColumn("clock", F.timestamp_micros("last"))


def _in_hours(hours: int, sweep_ms: int):
    """State of a hash: first and last time of each hour seen, as long as a log that is not late can repeat one of them."""
    gap = hours * _HOUR

    def step(key, frames, state):
        clock = state.getCurrentWatermarkMs() * 1000
        known = dict(zip(state.get[0], zip(state.get[1], state.get[2]))) if state.exists else {}
        fresh, out = {}, []
        for frame in frames:
            for hour, first, last, times, ids in zip(*(frame[c] for c in ("hour", "first", "last", "times", "ids"))):
                if pd.isna(hour) or (hour + 1) * _HOUR <= clock:
                    kind = "undated" if pd.isna(hour) else "late"
                    out += [(key[0], None if pd.isna(t) else int(t), i, kind) for t, i in zip(times, ids)]
                    continue
                hour, seen = int(hour), fresh.get(int(hour))
                mine = (int(first), ids[0], int(last))
                fresh[hour] = mine if seen is None else (*min(seen[:2], mine[:2]), max(seen[2], mine[2]))
        for hour in sorted(fresh):
            first, log_id, last = fresh[hour]
            if not any(f <= first + gap and t >= first - gap for f, t in known.values()):
                out.append((key[0], first, log_id, "new"))
            before = known.get(hour, (first, last))
            known[hour] = (min(before[0], first), max(before[1], last))
        known = {h: v for h, v in known.items() if v[1] >= clock - gap - _HOUR}
        if known:
            hours_kept = sorted(known)
            state.update((hours_kept, [known[h][0] for h in hours_kept], [known[h][1] for h in hours_kept]))
            state.setTimeoutDuration(sweep_ms)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["log_hash", "ts", "log_id", "kind"]).astype({"ts": "Int64"})

    return step


def stream_dedup(
    logs: DataFrame, path: str, checkpoint: str, late: str, hours: int = 24, lateness: str = "24 hours", sweep: str = "10 minutes",
    trigger: dict | None = None,
) -> StreamingQuery:
    """Writes arriving logs(log_hash, ts, log_id) whose hash did not come within ``hours``: (log_hash, ts, log_id).

    Logs are compared with those of earlier micro-batches up to ``hours`` before or after them, and with those before them in
    their own. Spark's state store holds, per hash, the hours it was seen in, until no log that is at most ``lateness`` older
    than the newest one can repeat them; hashes that come no more are looked at every ``sweep`` and leave the
    store. Logs of hours before the watermark were not compared: they go to ``late`` with ``kind`` late, those without a time as undated,
    so each log is new, a repeat, or in that table. Both tables are written per batch id; a batch repeated after a
    failure overwrites its own. Large state belongs in RocksDB (spark.sql.streaming.stateStore.providerClass).
    """
    records = _records(logs).withWatermark("clock", lateness)
    ids = logs.schema["log_id"].dataType.simpleString()
    sweep_ms = int(pd.Timedelta(sweep).total_seconds() * 1000)
    # timers follow the wall clock, so that Spark keeps late records; what they do follows the watermark
    judged = records.groupBy("log_hash").applyInPandasWithState(
        _in_hours(hours, sweep_ms), f"log_hash string, ts long, log_id {ids}, kind string",
        "hours array<long>, firsts array<long>, lasts array<long>", "append", "ProcessingTimeTimeout",
    )

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = stage(batch.withColumn("ts", F.timestamp_micros("ts")), "stream-judged")
        batch.filter("kind = 'new'").drop("kind").write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
        batch.filter("kind <> 'new'").write.mode("overwrite").parquet(f"{late}/batch_id={batch_id}")

    writer = judged.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or EVERYTHING))
    conf = logs.sparkSession.conf
    before = conf.get(_EMPTY_BATCHES, "true")
    conf.set(_EMPTY_BATCHES, "false")  # timers by the wall clock would ask for batches without end
    try:
        return writer.start()
    finally:
        conf.set(_EMPTY_BATCHES, before)


def write_stream(stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Appends a stream to a parquet folder."""
    return (
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(**(trigger or EVERYTHING)).start()
    )


def stream_retrieve(
    logs: DataFrame,
    kb: DataFrame | Callable[[], DataFrame],
    path: str,
    checkpoint: str,
    text: str = "content",
    method: str = "fused",
    embed=hashed_vectors,
    history: str | None = None,
    index: SearchIndex | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Hybrid search for arriving logs(query_id, content), and a history row for each of them below ``history``.

    Ranking needs the whole hit list of a log, so each micro-batch runs the batch search. Hits and history are written per batch
    id, and a session id follows from batch and log: a batch repeated after a failure overwrites both with the same rows, so every
    log counts once. ``kb`` as a function is asked again for every batch: articles learned since, and segments added to the
    index, are found by later batches. The history's time is the log's own ``ts`` where it has one.
    """

    def search(batch: DataFrame, batch_id: int) -> None:
        times = [c for c in ("ts",) if c in batch.columns]
        prepared = stage(with_keywords(preprocess(batch, text)).select("query_id", "keywords", "processed_text", "original_hash", *times), "arrived")
        articles = kb() if callable(kb) else kb
        hits = hybrid_search(prepared, articles, method=method, embed=embed, index=index)
        folder = f"{path}/batch_id={batch_id}"
        hits.write.mode("overwrite").parquet(folder)
        if history is not None:
            found = batch.sparkSession.read.schema(hits.schema).parquet(folder)
            rows = _undiagnosed(prepared.join(retrieved_ids(found), "query_id", "left"), batch_id, times)
            rows.write.mode("overwrite").parquet(f"{history}/batch_id={batch_id}")

    return logs.writeStream.foreachBatch(search).option("checkpointLocation", checkpoint).trigger(**(trigger or EVERYTHING)).start()


def _undiagnosed(logs: DataFrame, batch_id: int, times: list[str]) -> DataFrame:
    """History rows of logs that were searched for and not diagnosed yet."""
    empty = {
        "root_cause": "string", "analysis_process": "string", "solution_steps": "array<string>", "confidence": "double",
        "model_used": "string", "strategy": "string", "total_tokens": "long", "latency_ms": "long",
    }
    for name, kind in empty.items():
        logs = logs.withColumn(name, F.lit(None).cast(kind))
    session = stable_session_id(F.col("original_hash"), F.col("query_id").cast("string"), F.lit(batch_id))
    now = F.col("ts").cast("timestamp") if times else F.lit(None).cast("timestamp")
    return history_rows(logs, session, now, "query_id")
