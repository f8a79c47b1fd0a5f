"""Sinks."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosegauge.sources.readers import COLUMNS
from prosegauge.sources.versions import placed


def packed(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows of one output partition together: few files for a small one, and a large one
    still spread over many tasks."""
    return df.hint("rebalance", *by) if by else df


def widened(df: DataFrame, by: Sequence[str], widen: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``packed`` rows in the order a partitioned table is written in, then what ``widen`` makes of
    each; so narrow rows are shuffled and sorted, and wide ones only written."""
    rows = packed(df, by)
    return widen(rows.sortWithinPartitions(*by) if by else rows)


def write_table(
    df: DataFrame, path: str, by: Sequence[str] = (), widen: Callable[[DataFrame], DataFrame] | None = None
) -> None:
    rows = widened(df, by, widen) if widen else packed(df, by)
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "static")
    writer.partitionBy(*by).parquet(path)


def write_csv(df: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    """CSV for exchange: usual column names, every field quoted, quotes doubled."""
    named = df.withColumnsRenamed({ours: theirs for theirs, ours in COLUMNS.items() if ours not in by})
    packed(named, by).write.mode("overwrite").partitionBy(*by).options(header=True, quoteAll=True, escape='"').csv(path)


def write_corpus(df: DataFrame, path: str, text: str = "text", name: str = "class") -> None:
    """Class corpora as text, one row after the other; null texts are left out."""
    rows = df.where(F.col(text).isNotNull()).select(F.col(text).alias("value"), name)
    packed(rows, [name]).write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(name).text(path)


def write_ranges(df: DataFrame, path: str, name: str = "toxicity_bin") -> None:
    write_table(df, path, [name])


def write_responses(df: DataFrame, path: str, by: Sequence[str] = ("model", "label"), pack: bool = True) -> None:
    """Replace the results of the models and ranges in ``df``, and of no others.

    Without ``pack`` every task writes what it has. Results that were costly to make then
    go straight to the table, and a lost executor takes none of them with it.
    """
    for rows, folder in placed(df, path):
        writer = (packed(rows, by) if pack else rows).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy(*by).parquet(folder)


def append_responses(df: DataFrame, path: str, by: Sequence[str] = ("model", "label")) -> None:
    """Add results with the time they were collected."""
    timed = df.withColumn("collected_at", F.current_timestamp())
    for rows, folder in placed(timed, path):
        packed(rows, by).write.mode("append").partitionBy(*by).parquet(folder)
