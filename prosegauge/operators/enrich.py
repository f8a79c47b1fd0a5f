"""Attach scores and generated texts through plug-ins called in batches.

A plug-in is a picklable factory, called once per task, and by generators once per call in flight. A scorer
takes a list of texts and gives a :class:`Reply` for each; a generator takes a list of prompts and gives for
each a text, a list of texts, None for a failure, or an :class:`Answer` with a service's status.
"""

from __future__ import annotations

import math
import threading
import time
from collections import deque
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import NamedTuple

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prosegauge.config import ATTRS, Pace, Retry
from prosegauge.functions.ranks import text_key
from prosegauge.operators.join import HOT_ROWS, MAX_HOT, join_skewed, pending
from prosegauge.session import stored

# Service statuses.
OK, UNSUPPORTED, BUSY = 200, 400, 429


class Reply(NamedTuple):
    status: int
    scores: Mapping[str, float] | None = None


class Answer(NamedTuple):
    """What a generator's service said: its status, and a text or several if that is OK."""

    status: int
    text: str | list[str] | None = None


class ScoringError(RuntimeError):
    """A scorer reply that is neither a score, unsupported nor busy."""


def status_route(status: Column) -> Column:
    """Where a scorer reply goes: ok, null_score or dead_letter."""
    return F.when(status == OK, "ok").when(status.isin(UNSUPPORTED, BUSY), "null_score").otherwise("dead_letter")


def failure_route(status: Column, reason: Column) -> Column:
    """What went wrong with a reply that has no text: error, unsupported, busy, failed or empty."""
    known = F.when(status == UNSUPPORTED, "unsupported").when(status == BUSY, "busy").when(status != OK, "failed")
    return F.when(reason.isNotNull(), "error").otherwise(known.otherwise("empty"))


def _asked(call: Callable, items: list, retry: Retry, sleep: Callable) -> list:
    """A reply for each item; those the service was too busy for are asked for again."""
    replies: dict = {}
    waiting = list(range(len(items)))
    for attempt in range(retry.attempts):
        for place, reply in zip(waiting, call([items[i] for i in waiting])):
            replies[place] = reply
        waiting = [i for i in waiting if replies[i].status == BUSY]
        if not waiting:
            break
        if attempt + 1 < retry.attempts:
            sleep(retry.base * 2**attempt)
    return [replies[i] for i in range(len(items))]


def ask(scorer: Callable, texts: list[str], retry: Retry, sleep: Callable = time.sleep) -> list[Reply]:
    """Score texts, asking again for those the service was too busy for."""
    return _asked(scorer, texts, retry, sleep)


class Slots:
    """When the calls of a lane may begin: ``start`` + (``lane`` + n ``lanes``) ``interval`` for n = 0, 1, ...

    Every lane has slots of its own, so all lanes together keep the interval. A task that is run again takes the
    slots after the present time, which nobody has used, and none of those before.
    """

    def __init__(self, pace: Pace, lane: int, clock: Callable = time.time, sleep: Callable = time.sleep) -> None:
        self.pace, self.lane, self.clock, self.sleep = pace, lane % pace.lanes, clock, sleep
        # the first is one after the present time
        self.next = max(0, math.floor(self._place(clock())) + 1)

    def _place(self, now: float) -> float:
        """Slots of the lane up to a time."""
        return ((now - self.pace.start) / self.pace.interval - self.lane) / self.pace.lanes

    def wait(self) -> float:
        """Wait for the next free slot, which is used then."""
        now = self.clock()
        self.next = max(self.next, math.ceil(self._place(now)))
        slot = self.pace.start + (self.lane + self.next * self.pace.lanes) * self.pace.interval
        self.next += 1
        if slot > now:
            self.sleep(slot - now)
        return slot


def _scoring(factory, attrs, retry, pace, batch_size, dead_letters, sleep, clock=time.time):
    step = 1 if pace else batch_size

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = factory()
        slots = None
        if pace and pace.start is not None:
            task = TaskContext.get()
            slots = Slots(pace, task.partitionId() if task else 0, clock, sleep)

        def call(texts: list[str]) -> list[Reply]:
            if slots:
                slots.wait()
            return scorer(texts)

        for batch in batches:
            replies: list[Reply] = []
            texts = batch["_text"].tolist()
            for start in range(0, len(texts), step):
                part = texts[start : start + step]
                replies += ask(call, part, retry, sleep)
                if pace and not slots:
                    sleep(pace.interval * pace.lanes)
            for reply in replies:
                if reply.status not in (OK, UNSUPPORTED, BUSY) and not dead_letters:
                    raise ScoringError(f"scorer replied {reply.status}")
            out = {"_key": batch["_key"], "status": [r.status for r in replies]}
            for name in attrs:
                out[name] = pd.Series(
                    [r.scores[name] if r.status == OK else None for r in replies], index=batch.index, dtype="float64"
                )
            yield pd.DataFrame({**out, "_rows": batch["_rows"]})

    return run


def score_attributes(
    df: DataFrame,
    text: str,
    scorer: Callable,
    attrs: Sequence[str] = ATTRS,
    retry: Retry = Retry(),
    pace: Pace | None = None,
    batch_size: int = 64,
    partitions: int | None = None,
    dead_letters: bool = False,
    hot_rows: int = HOT_ROWS,
    path: str | None = None,
    sleep: Callable = time.sleep,
) -> DataFrame:
    """``df`` with one nullable score per attribute and the scorer's status.

    Equal texts are scored once. The scores are written to a table (at ``path``, or in
    the shared folder) before they are joined back, so no later action calls the scorer
    again. A null text is not scored. Old score columns are replaced. A reply that is
    neither a score, unsupported nor busy fails the job, unless ``dead_letters`` keeps it
    with its status.

    A ``pace`` with a start gives every call a slot of its own (see :class:`Slots`); one without waits after each
    call. Two copies of a task would each use its lane, so a paced job must not run with speculation.
    """
    if pace and df.sparkSession.sparkContext.getConf().get("spark.speculation", "false") == "true":
        raise ValueError("spark.speculation runs tasks twice at a time and breaks the pace; turn it off")
    # rows without a text match nothing; a key per task keeps them spread
    no_text = F.concat(F.lit("null "), F.spark_partition_id().cast("string"))
    rows = df.drop(*attrs, "status")
    rows = rows.withColumn("_key", F.when(F.col(text).isNull(), no_text).otherwise(text_key(F.col(text))))
    texts = df.where(F.col(text).isNotNull()).groupBy(F.col(text).alias("_text")).agg(F.count("*").alias("_rows"))
    distinct = texts.select(text_key(F.col("_text")).alias("_key"), "_text", "_rows")
    if pace or partitions:
        distinct = distinct.repartition(pace.lanes if pace else partitions)
    schema = T.StructType([T.StructField("_key", T.StringType()), T.StructField("status", T.IntegerType())])
    for name in attrs:
        schema.add(name, T.DoubleType())
    schema.add("_rows", T.LongType())
    scored = _scoring(scorer, list(attrs), retry, pace, batch_size, dead_letters, sleep)
    scores = stored(distinct.mapInPandas(scored, schema), "scores", path)
    hot = scores.where(F.col("_rows") > hot_rows).orderBy(F.desc("_rows"), "_key").limit(MAX_HOT)
    hot = [row[0] for row in hot.select(F.xxhash64("_key")).collect()]
    return join_skewed(rows, scores.drop("_rows"), "_key", "left", hot).drop("_key")


def score_models(
    responses: DataFrame,
    scorer: Callable,
    done: DataFrame | None = None,
    on: Sequence[str] = ("model", "label", "prompt", "continuation"),
    **options,
) -> DataFrame:
    """Score the responses of all models and ranges in one job, leaving out those ``done``."""
    rows = responses if done is None else pending(responses, done, on)
    return score_attributes(rows, "continuation", scorer, **options)


def in_order(call: Callable, parts: Iterable, in_flight: int, pool: ThreadPoolExecutor | None) -> Iterator:
    """``call`` of each part, results in the order of the parts; ``in_flight`` run at a time.

    Four times as many are dealt out, so that one slow call does not hold the others up.
    """
    if pool is None:
        yield from map(call, parts)
        return
    window: deque = deque()
    for part in parts:
        window.append(pool.submit(call, part))
        if len(window) >= 4 * in_flight:
            yield window.popleft().result()
    while window:
        yield window.popleft().result()


def _answer(reply) -> Answer:
    return reply if hasattr(reply, "status") else Answer(OK, reply)


def enrich_text(
    prompts: DataFrame,
    generator: Callable,
    prompt: str = "prompt",
    name: str = "continuation",
    batch_size: int = 16,
    concurrency: int | None = None,
    reason: str | None = None,
    status: str | None = None,
    in_flight: int = 1,
    retry: Retry = Retry(),
    sleep: Callable = time.sleep,
) -> DataFrame:
    """``prompts`` with a generated text in ``name``; several rows where a prompt gets several.

    With ``reason`` a call that raises gives no text for its prompts, and this column says why; without it
    the job fails. ``status`` names a column for the status of each reply (null where the call raised). Prompts that
    the service was too busy for are asked for again after a while, as ``retry`` says.

    ``concurrency`` bounds the calls running at a time, over all tasks; ``in_flight`` of them run in one task, each
    with a generator of its own, and results keep the order of the prompts. Write the result to a table before using it
    twice: each action calls the generator.
    """
    schema = T.StructType([*prompts.schema.fields, T.StructField(name, T.StringType())])
    if reason:
        schema.add(reason, T.StringType())
    if status:
        schema.add(status, T.IntegerType())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = threading.local()

        def call(part: list[str]) -> tuple[list[Answer], str | None]:
            if not hasattr(own, "generate"):
                own.generate = generator()
            try:
                return _asked(lambda some: map(_answer, own.generate(some)), part, retry, sleep), None
            except Exception as error:
                if not reason:
                    raise
                return [Answer(None)] * len(part), f"{type(error).__name__}: {error}"

        pool = ThreadPoolExecutor(in_flight) if in_flight > 1 else None
        try:
            for batch in batches:
                asked = batch[prompt].tolist()
                parts = (asked[start : start + batch_size] for start in range(0, len(asked), batch_size))
                sizes: list[int] = []
                rows: list[tuple] = []
                for answers, why in in_order(call, parts, in_flight, pool):
                    for answer in answers:
                        text = answer.text if answer.status == OK else None
                        texts = text if isinstance(text, list) else [text]
                        sizes.append(len(texts))
                        rows += [(each, why, answer.status) for each in texts]
                out = batch.loc[batch.index.repeat(sizes)]
                out = out.assign(**{name: pd.Series([r[0] for r in rows], out.index, dtype=object)})
                if reason:
                    out = out.assign(**{reason: pd.Series([r[1] for r in rows], out.index, dtype=object)})
                if status:
                    out = out.assign(**{status: pd.Series([r[2] for r in rows], out.index, dtype="Int32")})
                yield out
        finally:
            if pool:
                pool.shutdown(cancel_futures=True)

    tasks = -(-concurrency // in_flight) if concurrency else None
    return (prompts.repartition(tasks) if tasks else prompts).mapInPandas(run, schema)
