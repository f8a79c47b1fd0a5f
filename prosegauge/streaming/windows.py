"""Counts of arriving rows per window of event time, and the rows that come too late for them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from prosegauge.session import exists, names

BATCH = "batch_id"


def window_counts(
    stream: DataFrame, key: str, time: str, width: str, delay: str, by: Sequence[str] = ()
) -> DataFrame:
    """Rows per window of ``width`` and per ``by``, each ``key`` once: window_start, window_end, ``by``, n_rows.

    Windows and the memory of keys are state that the watermark, ``delay`` behind the latest event, lets go of: a window comes out
    once, when it is closed. Rows behind the watermark are in no count; ``late_rows`` keeps them.
    """
    once = stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])
    counted = once.groupBy(F.window(time, width), *by).agg(F.count("*").alias("n_rows"))
    return counted.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *by, "n_rows")


def start_counts(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    key: str,
    time: str,
    width: str = "1 hour",
    delay: str = "1 hour",
    by: Sequence[str] = (),
) -> list[StreamingQuery]:
    """Start the two queries over all that has arrived: counts of closed windows, and the side table of late rows.

    Both read the stream in the same batches if its source deals it so (``maxFilesPerTrigger``). Restarted
    with the same ``checkpoint`` they go on where they stopped.
    """
    counts = window_counts(stream, key, time, width, delay, by)
    closed = (
        counts.writeStream.format("parquet")
        .option("path", f"{path}/counts")
        .option("checkpointLocation", f"{checkpoint}/counts")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    return [closed, late_rows(stream, f"{path}/late", f"{checkpoint}/late", time, delay)]


def late_rows(stream: DataFrame, path: str, checkpoint: str, time: str, delay: str) -> StreamingQuery:
    """Start a query that writes the rows behind the watermark of their batch to ``path``, by batch.

    The watermark of a batch is ``delay`` before the latest event of all batches before it, as it is for the counts. It is
    kept as one row per batch (``path`` with "-marks"); a batch run again replaces its rows and its mark.
    """
    marks = f"{path}-marks"

    def split(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        high = _latest(spark, marks, number)
        if high is not None:
            border = F.lit(high) - F.expr(f"interval {delay}")
            late = batch.where(F.col(time) < border).withColumn("watermark", border)
            late.write.mode("overwrite").parquet(f"{path}/{BATCH}={number}")
        latest = batch.agg(F.max(time).alias("latest"))
        latest.select(F.greatest("latest", F.lit(high).cast("timestamp")).alias("latest")).write.mode("overwrite").parquet(
            f"{marks}/{BATCH}={number}"
        )

    return (
        stream.writeStream.foreachBatch(split)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _latest(spark: SparkSession, marks: str, number: int):
    """The latest event of the batches before ``number``; None without one."""
    before = [int(name.split("=")[1]) for name in names(spark, marks) if name.startswith(f"{BATCH}=")]
    before = [n for n in before if n < number]
    # each mark holds the latest so far
    return spark.read.parquet(f"{marks}/{BATCH}={max(before)}").first()["latest"] if before else None


def read_counts(spark: SparkSession, path: str, by: T.StructType | None = None) -> DataFrame:
    """Counts of the windows closed so far."""
    schema = T.StructType([T.StructField("window_start", T.TimestampType()), T.StructField("window_end", T.TimestampType())])
    for field in by or ():
        schema.add(field)
    schema.add("n_rows", T.LongType())
    return _read(spark, f"{path}/counts", schema)


def read_late(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Late rows, as they came, with the watermark that they missed and the batch that brought them."""
    full = T.StructType([*schema.fields, T.StructField("watermark", T.TimestampType()), T.StructField(BATCH, T.LongType())])
    return _read(spark, f"{path}/late", full)


def _read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)
