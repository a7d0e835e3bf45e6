"""Batch inference over a prompt table: a hook for a model client, and recorded answers."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from faultlens.functions import fixed_values as fv
from faultlens.sources.stage import stage

# request -> (content, total_tokens)
Client = Callable[[dict], tuple[str, int]]
_ANSWER = "raw_content string, error string, model_used string, total_tokens int, latency_ms long"
_STORED = f"prompt_hash string, {_ANSWER}"


def model_answers(
    prompts: DataFrame,
    key: Sequence[str],
    client_factory: Callable[[], Client],
    model: str = fv.MODEL_NAME,
    temperature: float = fv.TEMPERATURE,
    max_tokens: int = fv.MAX_ANSWER_TOKENS,
    waits: Sequence[float] = tuple(fv.RETRY_WAITS),
) -> DataFrame:
    """(key columns, raw_content, error, model_used, total_tokens, latency_ms).

    One client per task; each prompt is sent as a system and a user message and tried once per entry of
    ``waits``. A prompt that keeps failing gives a row with ``error`` and no content. Repartition ``prompts``
    first to set how many clients run side by side.
    """
    keys = ", ".join(f"`{c}` {prompts.schema[c].dataType.simpleString()}" for c in key)
    attempts = len(waits)

    def run(batches):
        client = client_factory()
        for batch in batches:
            rows = []
            for system, user in zip(batch["system_prompt"], batch["user_prompt"]):
                started = time.monotonic()
                content, tokens, error = None, 0, f"no answer after {attempts} attempts"
                request = _request(system, user, model, temperature, max_tokens)
                for wait in waits:
                    time.sleep(wait)
                    try:
                        content, tokens = client(request)
                        error = None
                        break
                    except Exception:  # noqa: BLE001  a failing row must not end the job
                        continue
                rows.append((content, error, model, tokens, int((time.monotonic() - started) * 1000)))
            answers = pd.DataFrame(
                rows, columns=["raw_content", "error", "model_used", "total_tokens", "latency_ms"]
            )
            yield pd.concat([batch[list(key)].reset_index(drop=True), answers], axis=1)

    return prompts.select(*key, "system_prompt", "user_prompt").mapInPandas(run, f"{keys}, {_ANSWER}")


def _request(system: str, user: str, model: str, temperature: float, max_tokens: int) -> dict:
    return {
        "model": model, "messages": [{"role": "system", "content": system}, {"role": "user", "content": user}],
        "temperature": temperature, "max_tokens": max_tokens,
    }


class _Pace:
    """Lets calls of several threads through at a rate; None for no limit."""

    def __init__(self, per_second: float | None):
        self._gap, self._next, self._lock = 1 / per_second if per_second else 0.0, 0.0, threading.Lock()

    def wait(self) -> None:
        if not self._gap:
            return
        with self._lock:
            now = time.monotonic()
            at = max(now, self._next)
            self._next = at + self._gap
        time.sleep(at - now)


def stored_answers(spark: SparkSession, store: str) -> DataFrame:
    """(prompt_hash, raw_content, error, model_used, total_tokens, latency_ms): one row per prompt asked, an answer before an error."""
    rows = spark.read.schema(_STORED).parquet(store)
    best = F.min(F.struct(F.col("error").isNotNull().alias("failed"), *[F.col(c.split()[0]) for c in _ANSWER.split(", ")]))
    return rows.groupBy("prompt_hash").agg(best.alias("a")).select("prompt_hash", "a.*").drop("failed")


def answers_kept(
    prompts: DataFrame,
    key: Sequence[str],
    client_factory: Callable[[], Client],
    store: str,
    model: str = fv.MODEL_NAME,
    temperature: float = fv.TEMPERATURE,
    max_tokens: int = fv.MAX_ANSWER_TOKENS,
    waits: Sequence[float] = tuple(fv.RETRY_WAITS),
    per_task: int = 200,
    in_flight: int = 4,
    per_second: float | None = None,
) -> DataFrame:
    """``model_answers`` that asks each distinct prompt once, over all runs on the same ``store``.

    A prompt is known by a hash of model, settings and both messages. Those without an answer in the store are dealt to tasks
    of some ``per_task`` prompts; a task keeps ``in_flight`` requests open, ``per_second`` at most, and its file enters the store
    when it ends, whatever becomes of the job. So a run that is killed or repeated asks no prompt again that a finished
    task answered, at most those of the tasks it broke off. Prompts that kept failing are rows with ``error``, asked
    again by the next run. Each prompt row gets the answer of its hash.
    """
    spark, attempts = prompts.sparkSession, len(waits)
    settings = F.lit(f"{model}|{temperature}|{max_tokens}|")
    digest = F.sha2(F.concat(settings, F.coalesce("system_prompt", F.lit("")), F.lit("\x01"), F.coalesce("user_prompt", F.lit(""))), 256)
    keyed = stage(prompts.select(*key, "system_prompt", "user_prompt", digest.alias("prompt_hash")), "keyed-prompts")
    spark.createDataFrame([], _STORED).write.mode("append").parquet(store)  # a store that can be read
    answered = stored_answers(spark, store).filter("error IS NULL").select("prompt_hash")
    texts = keyed.groupBy("prompt_hash").agg(F.first("system_prompt").alias("system_prompt"), F.first("user_prompt").alias("user_prompt"))
    missing = stage(texts.join(answered, "prompt_hash", "left_anti"), "missing-prompts")

    def run(batches):
        client, pace = client_factory(), _Pace(per_second)

        def ask(system, user):
            started = time.monotonic()
            request = _request(system, user, model, temperature, max_tokens)
            for wait in waits:
                time.sleep(wait)
                pace.wait()
                try:
                    content, tokens = client(request)
                    return content, None, model, tokens, int((time.monotonic() - started) * 1000)
                except Exception:  # noqa: BLE001  a failing row must not end the job
                    continue
            return None, f"no answer after {attempts} attempts", model, 0, int((time.monotonic() - started) * 1000)

        with ThreadPoolExecutor(in_flight) as pool:
            for batch in batches:
                rows = list(pool.map(ask, batch["system_prompt"], batch["user_prompt"]))
                answers = pd.DataFrame(rows, columns=["raw_content", "error", "model_used", "total_tokens", "latency_ms"])
                yield pd.concat([batch[["prompt_hash"]].reset_index(drop=True), answers], axis=1)

    n_tasks = -(-missing.count() // per_task)
    if n_tasks:
        dealt = missing.repartition(n_tasks, "prompt_hash").mapInPandas(run, _STORED)
        # files of finished tasks go to their place at once, not when the whole job ends
        dealt.write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(store)
    found = stage(stored_answers(spark, store), "kept-answers")
    return keyed.select(*key, "prompt_hash").join(found, "prompt_hash").drop("prompt_hash")


def recorded_answers(prompts: DataFrame, answers: DataFrame, key: Sequence[str]) -> DataFrame:
    """Answers looked up by the hash of the user prompt: answers(prompt_hash, raw_content, total_tokens,
    latency_ms). Prompts without a record give a row with ``error``."""
    asked = prompts.select(*key, F.sha2("user_prompt", 256).alias("prompt_hash"))
    found = asked.join(answers, "prompt_hash", "left")
    return found.select(
        *key,
        "raw_content",
        F.when(F.col("raw_content").isNull(), "no recorded answer").alias("error"),
        F.lit(fv.MODEL_NAME).alias("model_used"),
        F.coalesce("total_tokens", F.lit(0)).cast("int").alias("total_tokens"),
        F.coalesce("latency_ms", F.lit(0)).cast("long").alias("latency_ms"),
    )
