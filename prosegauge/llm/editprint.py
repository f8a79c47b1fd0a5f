"""Fingerprints that keep edit distance: shared random walks over characters, sampled.

A walk reads a text at random speed: at each step it gives out the character it stands on, and
one shared random bit, chosen by step and character, says whether it moves on. Texts with few
edits fall into step again soon after each edit, so their outputs differ in few places: edit
distance becomes Hamming distance. Walks start anew every ``SEGMENT`` characters, which makes them
independent, so that many are walked at once.

A fingerprint has ``SLOTS`` hex digits. Slot s looks at the step, of the 2 n steps of a text of n
characters, that comes first in a random order of its own; the digit is a digest of the character there.
So texts of nearly the same length look at nearly the same steps, whatever the length. The
likeness of two fingerprints is the share of equal digits, less what chance gives.

Defined results: a null text is empty; the fingerprint of an empty text is all zeros; equal texts
have equal fingerprints. Rows with a null id come last in the order of ids, rows of one id in the
order of a digest of their texts. One row alone is its own next. An empty table gives no rows.
Other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLOTS = 128
SEGMENT, STEPS = 2048, 4096
PERIOD, CLASSES = 4096, 64
SEED = 20_231
#: Texts, and walks, that are worked on at a time.
TEXTS, WALKS = 256, 1024
NEIGHBOURS = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


@functools.lru_cache(maxsize=1)
def _strides() -> np.ndarray:
    """Steps that a walk stays on a character, by step of the period and class of the character."""
    bits = np.random.default_rng(SEED).random((PERIOD, CLASSES)) < 0.5
    bits[0] = True  # so that every stay ends
    strides = np.ones((PERIOD, CLASSES), np.int32)
    for step in range(PERIOD - 1, -1, -1):
        strides[step] = np.where(bits[step], 1, 1 + strides[(step + 1) % PERIOD])
    return strides.ravel()


@functools.lru_cache(maxsize=1)
def _firsts() -> list[np.ndarray]:
    """For each slot the steps that come before all steps below them in the slot's order."""
    rng, found = np.random.default_rng(SEED + 1), []
    for _ in range(SLOTS):
        steps, place, rank = [0], 0, rng.random()
        while place < 1 << 40:
            place += int(min(rng.geometric(max(rank, 1e-12)), 1 << 41))
            rank *= rng.random()
            steps.append(place)
        found.append(np.array(steps, np.int64))
    return found


@functools.lru_cache(maxsize=4096)
def sampled_steps(steps: int) -> np.ndarray:
    """The step each slot looks at in an output of so many steps."""
    return np.array([x[np.searchsorted(x, steps) - 1] for x in _firsts()])


def _walk(classes: list[np.ndarray]) -> list[np.ndarray]:
    """The step at which the walk comes to each character, for texts of ``SEGMENT`` characters at most."""
    order = np.argsort([-len(x) for x in classes], kind="stable")
    sizes = np.array([len(classes[i]) for i in order])
    longest = int(sizes[0]) if len(sizes) else 0
    grid = np.zeros((longest, len(order)), np.int32)
    for column, i in enumerate(order):
        grid[: len(classes[i]), column] = classes[i]
    at, now, strides = np.empty((longest, len(order)), np.int32), np.zeros(len(order), np.int32), _strides()
    walking = np.searchsorted(-sizes, -np.arange(longest), side="left")
    for place in range(longest):
        n = walking[place]
        here = now[:n]
        at[place, :n] = here
        here += strides[(here & PERIOD - 1) * CLASSES + grid[place, :n]]
    found: list = [None] * len(order)
    rows = np.ascontiguousarray(at.T)
    for column, i in enumerate(order):
        found[i] = rows[column, : sizes[column]]
    return found


def _codes(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Class and digit of each character."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    mixed = points * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(58)).astype(np.uint8), (mixed >> np.uint64(32) & np.uint64(15)).astype(np.uint8)


def embed(texts: list[str]) -> np.ndarray:
    """The digits of each text, a row of ``SLOTS`` numbers."""
    found = np.zeros((len(texts), SLOTS), np.uint8)
    waiting: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []

    def settle() -> None:
        walks = _walk([x[1] for x in waiting])
        for (row, _, digits, looks), steps in zip(waiting, walks, strict=True):
            slots, local = looks
            found[row, slots] = digits[np.searchsorted(steps, local, side="right") - 1]
        waiting.clear()

    for row, text in enumerate(texts):
        classes, digits = _codes(text)
        steps = sampled_steps(2 * len(text)) if text else np.empty(0, np.int64)
        segments = steps // STEPS
        for segment in np.unique(segments):
            slots = np.flatnonzero(segments == segment)
            part = slice(segment * SEGMENT, (segment + 1) * SEGMENT)
            waiting.append((row, classes[part], digits[part], (slots, steps[slots] % STEPS)))
            if len(waiting) >= WALKS:
                settle()
    settle()
    return found


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of rows of digits: 1 if they are equal, about 0 if only chance makes digits equal."""
    return np.maximum(0, ((a == b).mean(axis=-1) - 1 / 16) * 16 / 15)


def as_hex(digits: np.ndarray) -> list[str]:
    packed = (digits[:, ::2] << 4 | digits[:, 1::2]).astype(np.uint8)
    return [x.tobytes().hex() for x in packed]


def edited(text: str, following: str) -> str:
    """The last third of ``text`` (rounded down) replaced by as much of the beginning of ``following``."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def _compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come in order, each bucket followed by the row that comes after its last."""
    held: list[tuple] = []

    def settle() -> pd.DataFrame:
        """All held rows but the last, which still waits for the row after it."""
        texts = [x[2] for x in held]
        changed = [edited(a, b) for a, b in zip(texts, texts[1:], strict=False)]
        digits = embed(texts + changed)
        own, other = digits[: len(texts)], digits[len(texts) :]
        frame = pd.DataFrame(
            {
                "doc_id": pd.array([x[1] for x in held[:-1]], "Int64"),
                "n_chars": [len(t) for t in texts[:-1]],
                "edited_sha256": [hashlib.sha256(t.encode("utf-8", "replace")).hexdigest() for t in changed],
                "fingerprint": as_hex(own[:-1]),
                "edited_fingerprint": as_hex(other),
                "near_edited": likeness(own[:-1], other),
                "near_next": likeness(own[:-1], own[1:]),
            }
        )
        return frame[[not x[3] for x in held[:-1]]]

    for batch in batches:
        ids = batch["doc_id"].astype("Int64")
        for bucket, doc_id, text, after in zip(batch["bucket"], ids, batch["text"], batch["after"], strict=True):
            if after and held and held[-1][3]:
                continue  # another row of the id that follows the bucket
            held.append((bucket, doc_id, text, after))
            if len(held) > TEXTS:
                yield settle()
                del held[:-1]
    if len(held) > 1:
        yield settle()


def with_next(docs: DataFrame, partitions: int) -> DataFrame:
    """Rows in descending order of doc_id, each in one of ``partitions`` buckets: bucket, doc_id, text, after.

    Each bucket also has, marked ``after``, the row that follows its last row - the first of all
    in the last bucket. Only ids at bucket limits, ``partitions`` at most, come to the driver.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    shares = [i / partitions for i in range(1, partitions)]
    limits = docs.approxQuantile("doc_id", shares, 1 / (4 * partitions)) if shares else []
    splits = [float("-inf"), *sorted(set(limits) or {0.0}), float("inf")]
    name = "bucket of id"
    number = Bucketizer(splits=splits, inputCol="doc_id", outputCol=name, handleInvalid="keep")
    top = len(splits) - 2
    # the largest ids first, null last
    bucket = F.when(F.col("doc_id").isNull(), top + 1).otherwise(F.lit(top) - F.col(f"`{name}`")).cast("int")
    placed = number.transform(docs).select("doc_id", "text", bucket.alias("bucket"))
    heads = placed.groupBy("bucket").agg(F.max("doc_id").alias("head_id")).orderBy("bucket").collect()
    before = [heads[i - 1].bucket for i in range(len(heads))]
    targets = docs.sparkSession.createDataFrame(
        [(x.head_id, b) for x, b in zip(heads, before, strict=True)], "head_id long, target int"
    )
    joined = placed.join(F.broadcast(targets), F.col("doc_id").eqNullSafe(F.col("head_id")), "left")
    own = F.struct(F.col("bucket"), F.lit(False).alias("after"))
    copy = F.when(F.col("target").isNotNull(), F.struct(F.col("target").alias("bucket"), F.lit(True).alias("after")))
    rows = joined.select("doc_id", "text", F.explode(F.array_compact(F.array(own, copy))).alias("to"))
    dealt = rows.select("to.bucket", "doc_id", "text", "to.after").repartitionByRange(partitions, "bucket")
    return dealt.sortWithinPartitions("bucket", "after", F.desc_nulls_last("doc_id"), F.xxhash64("text"))


def next_and_edited(docs: DataFrame) -> DataFrame:
    """Every text against its edited form and the next text: rows of ``NEIGHBOURS``."""
    spark: SparkSession = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return with_next(docs, partitions).mapInPandas(_compare, NEIGHBOURS)


def _prints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for at in range(0, len(batch), TEXTS):
            part = batch.iloc[at : at + TEXTS]
            digits = embed(part["text"].fillna("").tolist())
            yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64"), "fingerprint": as_hex(digits)})


def fingerprints(docs: DataFrame) -> DataFrame:
    """The fingerprint of each whole text: doc_id, fingerprint."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(_prints, "doc_id long, fingerprint string")
