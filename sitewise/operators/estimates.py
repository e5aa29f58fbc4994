"""Estimates by an outside model: prompts, the cache, calls of what it lacks, strict reading, and the way back to the cells."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait

import pyarrow as pa

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sitewise import schemas
from sitewise.durable import delete_folder, forget, new_folder, qualified, written
from sitewise.functions.text import cache_key, prompt, reply
from sitewise.sources.replies import CALLS, Journal, append_replies, delete_journals, journalled, read_cache, state

#: A model: from a prompt to a reply.
Model = Callable[[str], str]


def with_keys(contexts: DataFrame, model_name: str) -> DataFrame:
    """Adds ``prompt`` and ``key`` to (cell_id, context); another model or wording has other keys."""
    asked = contexts.withColumn("prompt", prompt(F.col("context")))
    return asked.withColumn("key", cache_key(model_name, F.col("prompt")))


def cache_misses(keyed: DataFrame, cache: DataFrame) -> DataFrame:
    """(key, prompt) that the cache lacks, each once: cells of one context share a call."""
    return keyed.select("key", "prompt").dropDuplicates(["key"]).join(cache.select("key"), "key", "left_anti")


def parsed(replies: DataFrame, *, raw: str = "raw") -> DataFrame:
    """The replies with wealth_score, area_character, confidence and ``error``, null where the reply is valid."""
    return replies.withColumn("_r", reply(F.col(raw))).select("*", "_r.*").drop("_r")


class Pace:
    """Lets one call through each so many seconds, whatever the number of threads."""

    def __init__(self, seconds: float) -> None:
        self.seconds, self.lock, self.next = seconds, threading.Lock(), 0.0

    def wait(self) -> None:
        if self.seconds <= 0:
            return
        with self.lock:
            at = max(self.next, time.monotonic())
            self.next = at + self.seconds
        time.sleep(max(0.0, at - time.monotonic()))


def replies_to(asked: Iterable[tuple[str, str]], model: Model, *, concurrency: int, pace: Pace, call_retries: int, retry_pause_s: float) -> Iterator[tuple[str, str]]:
    """(key, reply) of (key, prompt) as they come, at most ``concurrency`` calls at once.

    A call that fails is made again, that one only. If it goes on failing, the calls under way
    end and their replies come before the error.
    """

    def call(text: str) -> str:
        for attempt in range(call_retries + 1):
            pace.wait()
            try:
                return model(text)
            except Exception:
                if attempt == call_retries:
                    raise
                time.sleep(retry_pause_s)

    with ThreadPoolExecutor(concurrency) as pool:
        waiting: dict[Future, str] = {}
        failed: BaseException | None = None

        def done(most: int) -> Iterator[tuple[str, str]]:
            nonlocal failed
            while len(waiting) > most:
                for f in wait(waiting, return_when=FIRST_COMPLETED).done:
                    key = waiting.pop(f)
                    if (error := f.exception()) is None:
                        yield key, f.result()
                    else:
                        failed = failed or error

        for key, text in asked:
            waiting[pool.submit(call, text)] = key
            yield from done(concurrency - 1)
            if failed:
                break
        yield from done(0)
        if failed:
            raise failed


def call_model(
    misses: DataFrame, make_model: Callable[[], Model], *, max_retries: int = 2, pause_s: float = 0.0, tasks: int = 8, concurrency: int = 1,
    per_second: float | None = None, call_retries: int = 2, folder: str | None = None, journal: str | None = None,
) -> DataFrame:
    """(key, wealth_score, area_character, confidence, error, attempts): the model's replies to the missing prompts.

    The model is made in the task and called by ``concurrency`` threads; tasks x concurrency calls run at
    once. A task's calls are ``pause_s`` apart, and those of all tasks at most ``per_second``. All prompts are asked once; those
    with an invalid reply are asked again, at most ``max_retries`` times. ``journal``: a folder that gets each
    reply as it comes; a task that is repeated asks only what it lacks. ``folder``: gets the rounds' tables.
    """
    spark = misses.sparkSession
    folder = folder or new_folder(spark, "calls")

    def asking(attempt: int):
        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = make_model()
            pace = Pace(max(pause_s, tasks / per_second if per_second else 0.0))
            kept = Journal(journal, f"{attempt:02d}-{TaskContext.get().partitionId():06d}") if journal else None
            known = kept.earlier() if kept else {}
            for batch in batches:
                pairs = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
                answers = {k: known[k] for k, _ in pairs if k in known}
                try:
                    for key, raw in replies_to(
                        (p for p in pairs if p[0] not in known), model, concurrency=concurrency, pace=pace, call_retries=call_retries, retry_pause_s=pause_s or 1.0
                    ):
                        answers[key] = raw
                        if kept:
                            kept.add(key, raw)
                except BaseException:
                    if kept:
                        kept.close()
                    raise
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([answers[k] for k, _ in pairs], pa.string())], names=["key", "prompt", "raw"])
            if kept:
                kept.close()

        return ask

    left, whole = misses.select("key", "prompt"), None
    for attempt in range(1, max_retries + 2):
        # Written: a call isn't made again for what reads its reply.
        made = parsed(left.repartition(tasks, "key").mapInArrow(asking(attempt), "key string, prompt string, raw string"))
        at = f"{folder}/{attempt}"
        made.write.parquet(at)
        asked = spark.read.schema(made.schema).parquet(at)
        last = attempt == max_retries + 1
        done = asked.where(F.lit(last) | F.col("error").isNull()).withColumn("attempts", F.lit(attempt))
        whole = done if whole is None else whole.unionByName(done)
        left = asked.where(F.col("error").isNotNull()).select("key", "prompt")
        if last or left.isEmpty():
            break
    return whole.select("key", "wealth_score", "area_character", "confidence", "error", "attempts")


def recover(spark: SparkSession, path: str) -> int:
    """Puts the valid replies of broken-off runs into the cache; the number of its last commit."""
    known = state(path)
    calls, folders = journalled(spark, path)
    if calls is None:
        return known.version
    valid = parsed(calls).where("error is null").join(read_cache(spark, path).select("key"), "key", "left_anti")
    version = append_replies(valid, path, known.version)
    delete_journals(spark, folders)
    return version


def estimate_cells(
    contexts: DataFrame, make_model: Callable[[], Model], *, model_name: str, cache_path: str,
    max_retries: int = 2, pause_s: float = 0.0, tasks: int = 8, batch: int = 10_000, strict: bool = True,
    concurrency: int = 1, per_second: float | None = None, call_retries: int = 2,
) -> DataFrame:
    """cell_id, wealth_score, area_character, confidence of (cell_id, context).

    Missing prompts are asked in batches of about ``batch``, each committed to the cache when
    it is answered. Each reply is in a journal as soon as it comes: a run that breaks off loses none, the next one
    puts them into the cache and asks the rest. Replies that stay invalid aren't cached; strict: they end the run with an
    error after the others are kept, else their cells have nulls.
    """
    spark = contexts.sparkSession
    path = qualified(spark, cache_path)
    version = recover(spark, path)
    keyed = with_keys(contexts, model_name)
    misses = written(cache_misses(keyed, read_cache(spark, path)), "misses")
    parts = max(1, -(-misses.count() // batch))
    # A folder a batch: each reads its own rows only.
    folder = new_folder(spark, "misses")
    misses.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts))).repartition("part").write.partitionBy("part").parquet(folder)
    forget(misses)
    waiting = spark.read.schema("key string, prompt string, part bigint").parquet(folder)
    failed = 0
    for part in range(parts):
        rounds, journal = new_folder(spark, "calls"), f"{path}/{CALLS}/{uuid.uuid4().hex}"
        answered = call_model(
            waiting.where(F.col("part") == part), make_model, max_retries=max_retries, pause_s=pause_s, tasks=tasks, concurrency=concurrency, per_second=per_second,
            call_retries=call_retries, folder=rounds, journal=journal,
        )
        version = append_replies(answered.where("error is null"), path, version)
        failed += answered.where("error is not null").count()
        delete_folder(spark, journal)
        delete_folder(spark, rounds)
    delete_folder(spark, folder)
    if failed and strict:
        raise RuntimeError(f"{failed} prompts have no valid reply after {max_retries + 1} attempts")
    cached = read_cache(spark, path)
    return keyed.select("cell_id", "key").join(cached, "key", "left").select("cell_id", "wealth_score", "area_character", "confidence")


def estimate_arriving(contexts: DataFrame, make_model: Callable[[], Model], *, output_path: str, checkpoint: str, **settings) -> StreamingQuery:
    """Estimates of a stream of (cell_id, context), batch by batch over one cache, until what has arrived is done.

    A batch's folder is written anew if the batch is repeated, and its prompts are then in the cache or a journal: after a
    restart from the checkpoint no answered prompt is asked again. ``settings`` are those of ``estimate_cells``.
    """
    spark = contexts.sparkSession

    def each(batch: DataFrame, number: int) -> None:
        found = estimate_cells(batch, make_model, **settings)
        found.write.mode("overwrite").parquet(f"{output_path}/batch={number}")

    return contexts.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_estimates(spark: SparkSession, output_path: str) -> DataFrame:
    """The estimates of a stream: of a cell that has arrived again those of its last batch."""
    rows = spark.read.schema(f"{schemas.ESTIMATES}, batch bigint").parquet(output_path)
    names = ("wealth_score", "area_character", "confidence")
    return rows.groupBy("cell_id").agg(F.max_by(F.struct(*names), "batch").alias("_e")).select("cell_id", *[f"_e.{c}" for c in names])


def with_estimates(cells: DataFrame, estimates: DataFrame) -> DataFrame:
    """The cells with their estimates; nulls where there are none."""
    return cells.join(estimates, "cell_id", "left")


def chat_model(base_url: str, model: str, *, api_key_env: str, temperature: float = 0, timeout_s: float = 60) -> Callable[[], Model]:
    """A maker of clients for an endpoint of the common chat-completions form; the key is read in the task."""

    def make() -> Model:
        import json
        import os
        import urllib.request

        if not (key := os.environ.get(api_key_env)):
            raise RuntimeError(f"the environment has no {api_key_env}")

        def ask(text: str) -> str:
            body = {"model": model, "temperature": temperature, "messages": [{"role": "user", "content": text}]}
            request = urllib.request.Request(
                f"{base_url.rstrip('/')}/chat/completions", json.dumps(body).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {key}"}
            )
            with urllib.request.urlopen(request, timeout=timeout_s) as got:
                return json.load(got)["choices"][0]["message"]["content"]

        return ask

    return make
