"""Score thresholds and ranges, and the sizes the balancing steps need."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosegauge.config import EDGES, LABELS


def known(score: Column) -> Column:
    """NaN as null: Spark orders NaN above every number, which would pass a threshold."""
    return F.when(F.isnan(score), F.lit(None)).otherwise(score)


def class_of(score: Column, threshold: float = 0.5) -> Column:
    """1 from the threshold upwards, 0 below it, null without a score."""
    value = known(score)
    return F.when(value >= threshold, 1).when(value < threshold, 0)


def split_by_threshold(df: DataFrame, score: str, threshold: float = 0.5, name: str = "class") -> DataFrame:
    """Add the class; rows without a score belong to neither and go."""
    return df.withColumn(name, class_of(F.col(score), threshold)).where(F.col(name).isNotNull())


def check_edges(edges: Sequence[float], labels: Sequence[str]) -> None:
    if len(labels) != len(edges) - 1:
        raise ValueError("there must be one label fewer than edges")
    if any(not low < high for low, high in zip(edges, edges[1:])):
        raise ValueError("edges must rise strictly")
    if len(set(labels)) != len(labels):
        raise ValueError("labels must differ")


def bucketize(score: Column, edges: Sequence[float] = EDGES, labels: Sequence[str] = LABELS) -> Column:
    """Label of the right-closed range holding the score; the first range holds its lower edge too."""
    check_edges(edges, labels)
    chain = F.when(F.isnan(score) | (score < edges[0]), F.lit(None))
    for upper, label in zip(edges[1:], labels):
        chain = chain.when(score <= upper, label)
    return chain


def range_index(label: Column, labels: Sequence[str] = LABELS) -> Column:
    """Position of a label, for ordering."""
    chain = F.when(label == labels[0], 0)
    for position, name in enumerate(labels[1:], 1):
        chain = chain.when(label == name, position)
    return chain


def range_counts(df: DataFrame, label: str, labels: Sequence[str] = LABELS) -> DataFrame:
    """Rows per range, ranges without rows included: (label, bin_idx, n_rows)."""
    spark = df.sparkSession
    frame = spark.createDataFrame(list(zip(labels, range(len(labels)))), f"`{label}` string, bin_idx int")
    counts = df.where(F.col(label).isin(list(labels))).groupBy(label).agg(F.count("*").alias("n_rows"))
    # counts has a row per label at most
    return frame.join(F.broadcast(counts), label, "left").fillna(0, ["n_rows"])


def common_size(counts: DataFrame, size: int = 0) -> DataFrame:
    """The size all ranges can be cut to, as one row: smallest range, ``size`` at most.

    Of ``counts`` as :func:`range_counts` gives them. ``size`` 0 sets no limit. An
    empty range gives 0.
    """
    value = F.min("n_rows")
    if size:
        value = F.least(value, F.lit(size).cast("bigint"))
    return counts.agg(value.alias("common_size"))


def class_counts(df: DataFrame, name: str = "class") -> DataFrame:
    return df.groupBy(name).agg(F.count("*").alias("n_rows"))
