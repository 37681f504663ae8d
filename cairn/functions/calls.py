"""Model calls from tasks: some at a time, in input order, and paid for once.

A task keeps up to IN_FLIGHT calls running. A call that fails goes back into the
line after a pause, while others take its place; results leave in the order of
their prompts, so that a slow call holds back at most WAITING prompts. An error
that stays is a value beside its row.

With a log, answers are appended to a table in shared storage, task by task: what
a lost executor or a stopped job had finished is not asked for again, in the same
run or in a later one. Equal prompts to one model are asked once.
"""

from __future__ import annotations

import heapq
import time
from collections import deque
from collections.abc import Callable, Iterator
from queue import Empty, SimpleQueue
from threading import Thread

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.session import materialize

TRIES, IN_FLIGHT, WAITING = 3, 16, 256
#: Prompts of one task, and of one job that appends to a log.
TASK_PROMPTS, WAVE_PROMPTS = 64, 50_000

Client = Callable[[str], str]


def backoff(failures: int) -> float:
    """Seconds before the next try: 1, 2, 4 …"""
    return 2.0 ** (failures - 1)


def pooled(prompts: Iterator[str | None], call: Client, in_flight: int = IN_FLIGHT, tries: int = TRIES, waiting: int = WAITING, pause: Callable[[int], float] = backoff) -> Iterator[tuple[str | None, str | None]]:
    """(value, error) of each prompt, in order. At most `waiting` prompts are read beyond the last result that left."""
    done: dict[int, tuple[str | None, str | None]] = {}
    later: list[tuple[float, int, str, int]] = []
    asked: SimpleQueue = SimpleQueue()
    answered: SimpleQueue = SimpleQueue()
    callers: list[Thread] = []
    read = left = flying = 0
    more = True

    def calling() -> None:
        while (one := asked.get()) is not None:
            try:
                answered.put((*one, call(one[1]), None))
            except BaseException as e:
                answered.put((*one, None, e))

    def ask(*one) -> None:
        asked.put(one)
        if len(callers) < in_flight:
            callers.append(Thread(target=calling, daemon=True))
            callers[-1].start()

    try:
        while more or left < read:
            while more and read - left < waiting:
                try:
                    prompt = next(prompts)
                except StopIteration:
                    more = False
                    break
                if prompt is None:
                    done[read] = (None, "no prompt")
                else:
                    ask(read, prompt, 0)
                    flying += 1
                read += 1
            while later and later[0][0] <= time.monotonic():
                ask(*heapq.heappop(later)[1:])
                flying += 1
            rest = max(0.0, later[0][0] - time.monotonic()) if later else None
            got = []
            if flying and left not in done:
                try:
                    got.append(answered.get(timeout=rest))
                except Empty:
                    continue
            elif left not in done:
                time.sleep(rest or 0.0)
            # all that has been answered meanwhile, in one go: short calls need no wait each
            while not answered.empty():
                got.append(answered.get())
            flying -= len(got)
            for n, prompt, failed, value, error in got:
                if error is None and not isinstance(value, str):
                    error = TypeError(f"the client gave {type(value).__name__}, not text")
                if error is None:
                    done[n] = (value, None)
                elif failed + 1 < tries:
                    heapq.heappush(later, (time.monotonic() + pause(failed + 1), n, prompt, failed + 1))
                else:
                    done[n] = (None, f"{type(error).__name__}: {error}")
            while left in done:
                yield done.pop(left)
                left += 1
    finally:
        # prompts that nobody waits for any more are not asked
        while not asked.empty():
            try:
                asked.get_nowait()
            except Empty:
                break
        for _ in callers:
            asked.put(None)
        for c in callers:
            c.join()


def complete(prompts: DataFrame, call: Client, in_flight: int = IN_FLIGHT, tries: int = TRIES, waiting: int = WAITING, pause: Callable[[int], float] = backoff) -> DataFrame:
    """(id, value, error) for prompts (id, prompt): a row a row, in the order of each partition. A null prompt is not asked."""
    kind = prompts.schema["id"].dataType.simpleString()

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: deque[pa.Array] = deque()

        def feed() -> Iterator[str | None]:
            for b in batches:
                if b.num_rows:
                    ids.append(b.column(0))
                    yield from b.column(1).to_pylist()

        got: list[tuple[str | None, str | None]] = []
        for answer in pooled(feed(), call, in_flight, tries, waiting, pause):
            got.append(answer)
            if len(got) == len(ids[0]):
                yield pa.record_batch([ids.popleft(), pa.array([v for v, _ in got], pa.string()), pa.array([e for _, e in got], pa.string())], ["id", "value", "error"])
                got = []

    return prompts.select("id", "prompt").mapInArrow(go, f"id {kind}, value string, error string")


def read_log(spark, path: str) -> DataFrame:
    """(key, value, error): one row a prompt that was asked, an answer before an error."""
    from cairn.sources.files import exists

    schema = "key string, value string, error string"
    raw = spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)
    best = F.max_by(F.struct("value", "error"), F.struct(F.col("value").isNotNull(), F.coalesce("value", "error")))
    return raw.groupBy("key").agg(best.alias("a")).select("key", "a.value", "a.error")


def logged(prompts: DataFrame, call: Client, path: str, model: str = "", task_prompts: int = TASK_PROMPTS, wave_prompts: int = WAVE_PROMPTS, **how) -> DataFrame:
    """complete() over a log: what it holds for this model is not asked again, what failed before is.

    Prompts are asked in jobs of about wave_prompts, each of tasks of about
    task_prompts that append what they get. Tasks' files are moved into the log as
    each task ends, so that they outlive a job that does not.
    """
    spark = prompts.sparkSession
    key = F.sha2(F.concat(F.lit(f"{model}\0"), F.col("prompt")), 256)
    asked = materialize(prompts.select("id", "prompt", key.alias("key")), "prompts")
    known = read_log(spark, path).where("value is not null").select("key")
    todo = materialize(asked.where("prompt is not null").groupBy("key").agg(F.min("prompt").alias("prompt")).join(known, "key", "left_anti"), "unasked")
    n = todo.count()
    waves = -(-n // wave_prompts)
    for w in range(waves):
        part = todo.where(F.pmod(F.xxhash64("key"), F.lit(waves)) == w).repartition(max(1, -(-n // waves // task_prompts)), "key")
        said = complete(part.select(F.col("key").alias("id"), "prompt"), call, **how)
        said.select(F.col("id").alias("key"), "value", "error").write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").mode("append").parquet(path)
    return asked.join(read_log(spark, path), "key", "left").select("id", "value", F.when(F.col("prompt").isNull(), "no prompt").otherwise(F.col("error")).alias("error"))


class Asker:
    """A client as a step from (id, prompt) to (id, value, error), with a log or without; `how` goes to complete()."""

    def __init__(self, call: Client, log: str | None = None, model: str = "", **how):
        self.call, self.log, self.model, self.how = call, log, model, how

    def __call__(self, prompts: DataFrame) -> DataFrame:
        if self.log is None:
            return complete(prompts, self.call, **self.how)
        return logged(prompts, self.call, self.log, self.model, **self.how)


def asking(call: Client | Asker) -> Asker:
    """What operators take: a client as it is, or one with its log and limits."""
    return call if isinstance(call, Asker) else Asker(call)


def parsed(said: DataFrame, schema: str) -> DataFrame:
    """(id, parsed, value, error): answers as a struct; plain JSON or a fenced block. What does not parse is null."""
    from cairn.functions.scalar import fenced_json

    return said.withColumn("parsed", F.from_json(F.to_json(fenced_json(F.col("value"))), schema))
