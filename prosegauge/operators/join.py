"""Joins on row identity and on texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosegauge.functions.ranks import text_key

HOT_ROWS = 1_000_000
MAX_HOT = 1_000


def hot_keys(df: DataFrame, key: str, hot_rows: int = HOT_ROWS) -> list[int]:
    """Hashes of the keys with more than ``hot_rows`` rows, the heaviest ``MAX_HOT`` of them.

    Counting moves hashes only and combines before the shuffle. A key left out has less
    than 1/MAX_HOT of the rows.
    """
    counts = df.where(F.col(key).isNotNull()).groupBy(F.xxhash64(key).alias("hash")).agg(F.count("*").alias("n"))
    heaviest = counts.where(F.col("n") > hot_rows).orderBy(F.desc("n"), "hash").limit(MAX_HOT)
    return [row["hash"] for row in heaviest.collect()]


def join_skewed(left: DataFrame, right: DataFrame, key: str, how: str, hot: Sequence[int]) -> DataFrame:
    """Equi-join of any ``left`` with a ``right`` that is unique on ``key``.

    Left rows with a hot key stay where they are and meet a broadcast of the right rows
    for those keys, one for each. The rest is shuffled. ``hot`` are the hashes of hot keys.
    """
    if not hot:
        return left.join(right, key, how)
    if len(hot) > MAX_HOT:
        raise ValueError("too many hot keys")
    is_hot = F.col(key).isNotNull() & F.xxhash64(key).isin(list(hot))
    narrow = left.where(is_hot).join(F.broadcast(right.where(is_hot)), key, how)
    return narrow.unionByName(left.where(~is_hot).join(right.where(~is_hot), key, how))


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def attach_prompt(continuations: DataFrame, prompts: DataFrame, key: str = "row_id", check: bool = True) -> DataFrame:
    """Add the prompt of the same row; null where there is none. Repeated prompt keys are an error."""
    if check and duplicate_keys(prompts, key).limit(1).count():
        raise ValueError(f"prompts repeat a {key}")
    return continuations.join(prompts.select(key, "prompt"), key, "left")


def key_alignment(left: DataFrame, right: DataFrame, key: str = "row_id") -> DataFrame:
    """One row: keys on both sides, on the left only, on the right only, and whether the two agree.

    Sides are stacked and counted per key, which combines before the shuffle; no join.
    """
    sides = left.select(key, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(
        right.select(key, F.lit(0).alias("l"), F.lit(1).alias("r"))
    )
    per_key = sides.groupBy(key).agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    return per_key.agg(
        F.count_if(F.expr("l > 0 and r > 0")).alias("both"),
        F.count_if(F.expr("r = 0")).alias("left_only"),
        F.count_if(F.expr("l = 0")).alias("right_only"),
        (F.count_if(F.expr("l <> r")) == 0).alias("aligned"),
    )


def pending(
    prompts: DataFrame, done: DataFrame, on: Sequence[str] = ("prompt",), hot_rows: int | None = HOT_ROWS
) -> DataFrame:
    """The rows whose ``on`` columns are not among those done; repeats are kept, null equals null.

    ``hot_rows`` None skips the search for hot keys, for rows known to be distinct.
    """
    identity = text_key(*[F.col(c) for c in on])
    rows = prompts.withColumn("_key", identity)
    known = done.select(identity.alias("_key")).distinct()
    hot = [] if hot_rows is None else hot_keys(rows, "_key", hot_rows)
    return join_skewed(rows, known, "_key", "left_anti", hot).drop("_key")


def accepted(responses: DataFrame, column: str = "continuation") -> DataFrame:
    """Responses that count: neither null nor empty."""
    return responses.where(F.col(column).isNotNull() & (F.col(column) != ""))


def rejected(responses: DataFrame, column: str = "continuation") -> DataFrame:
    return responses.where(F.col(column).isNull() | (F.col(column) == ""))
