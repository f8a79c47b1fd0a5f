"""Counts the jobs report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def null_report(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row with the number of nulls per column."""
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])


def counted(df: DataFrame, columns: Sequence[str] = (), **flags: Column) -> tuple[DataFrame, Observation]:
    """``df`` and the counts that the first job over it makes on its way, without a scan of its own.

    Counted are all rows as ``n_rows``, the nulls of each of ``columns`` as ``null_`` and its name, and the rows for
    which each flag is true. ``get`` of the observation has them when that job has ended; what was cached or
    stored before is not counted again.
    """
    nulls = [F.count_if(F.col(f"`{c}`").isNull()).alias(f"null_{c}") for c in columns]
    marked = [F.count_if(F.coalesce(flag, F.lit(False))).alias(name) for name, flag in flags.items()]
    counts = Observation()
    return df.observe(counts, F.count(F.lit(1)).alias("n_rows"), *nulls, *marked), counts


def row_report(**frames: DataFrame) -> DataFrame:
    """Rows and columns per named frame."""
    parts = [
        df.agg(F.count("*").alias("n_rows")).select(
            F.lit(name).alias("frame"), "n_rows", F.lit(len(df.columns)).alias("n_columns")
        )
        for name, df in frames.items()
    ]
    report = parts[0]
    for part in parts[1:]:
        report = report.unionByName(part)
    return report


def progress(
    done: DataFrame, quota: int, keys: Sequence[str] = ("model", "label"), prompt: str = "prompt"
) -> DataFrame:
    """Distinct prompts done per group against the quota."""
    counts = done.groupBy(*keys).agg(F.countDistinct(prompt).alias("n_done"))
    return counts.withColumns({"quota": F.lit(quota).cast("bigint"), "complete": F.col("n_done") >= quota})
