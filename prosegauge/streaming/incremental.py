"""Collect responses for prompts as they arrive."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from prosegauge.operators.join import accepted, pending
from prosegauge.session import exists, stored

BATCH, TRIES, REJECTS = "batch_id", "tries", "-rejects"
TICK = "tick of the clock"


def read_rejects(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Prompts that failed, as they came, with their tries so far and the batch of the last."""
    return read_collected(spark, path + REJECTS, T.StructType([*schema.fields, T.StructField(TRIES, T.IntegerType())]))


def read_collected(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """What was collected so far; empty before the first batch."""
    full = T.StructType([*schema.fields, T.StructField(BATCH, T.LongType())])
    return spark.read.schema(full).parquet(path) if exists(spark, path) else spark.createDataFrame([], full)


def _collect(
    fresh: DataFrame, enrich: Callable, schema: T.StructType, kept: T.StructType, path: str, number: int, key: str
) -> None:
    """Enrich the prompts of a batch and write its folders."""
    spark = fresh.sparkSession
    done = accepted(enrich(fresh.drop(TRIES))).select(*schema.fieldNames())
    done.write.mode("overwrite").parquet(f"{path}/{BATCH}={number}")
    told = spark.read.schema(schema).parquet(f"{path}/{BATCH}={number}")
    failed = fresh.join(told.select(key), key, "left_anti").withColumn(TRIES, (F.col(TRIES) + 1).cast("int"))
    failed.select(*kept.fieldNames(), TRIES).write.mode("overwrite").parquet(f"{path}{REJECTS}/{BATCH}={number}")


def _failed(spark: SparkSession, path: str, kept: T.StructType, number: int, tries: int) -> DataFrame:
    """Prompts whose last try was in batch ``number`` and that may be tried again."""
    rejects = read_rejects(spark, path, kept)
    return rejects.where((F.col(BATCH) == number) & (F.col(TRIES) < tries)).drop(BATCH)


def incremental_enrich(
    prompts: DataFrame,
    enrich: Callable[[DataFrame], DataFrame],
    schema: T.StructType,
    path: str,
    checkpoint: str,
    key: str = "prompt",
    tries: int = 3,
    every: str | None = None,
) -> StreamingQuery:
    """Start a query that enriches every distinct prompt of a stream once.

    Prompts seen before are keyed state of the query (``dropDuplicates``): a batch looks up its own keys and reads
    nothing of what was collected. With the RocksDB store, which ``session`` sets, the state need not fit in
    memory. Only the first batch of a checkpoint is compared with what is at ``path``, for tables that were there before it.
    Each batch writes accepted results to a folder of its own number, and a batch run again replaces that folder, so a restart
    leaves neither gaps nor repeats. ``enrich`` must give columns of ``schema``, among them ``key`` and ``continuation``.

    Prompts without an accepted result go to the table of ``read_rejects`` and into the next batch,
    until they have had ``tries`` tries; those with that many are dead letters. Without ``every`` the query takes
    what is there and ends, and ``retry_failed`` tries again what is left. With ``every`` (such as "1 minute") it
    runs on, with a batch that often though no prompt arrives, so failed ones are tried again all the same.
    """
    kept = prompts.schema

    def collect(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.where(F.col(TICK).isNull()).drop(TICK).withColumn(TRIES, F.lit(0))
        if number == 0 and exists(spark, path):
            earlier = read_collected(spark, path, schema).where(F.col(BATCH) != number)
            new = pending(new, earlier, [key], hot_rows=None)
        again = _failed(spark, path, kept, number - 1, tries)
        _collect(stored(new.unionByName(again), "fresh"), enrich, schema, kept, path, number, key)

    once = prompts.dropDuplicates([key]).withColumn(TICK, F.lit(None).cast("long"))
    if every:
        # rows of a clock, which wake the query where no prompt does; they go no further than the batch
        clock = prompts.sparkSession.readStream.format("rate").option("rowsPerSecond", 1).load()
        empty = [F.lit(None).cast(field.dataType).alias(field.name) for field in kept.fields]
        once = once.unionByName(clock.select(*empty, F.col("value").alias(TICK)))
    writer = once.writeStream.foreachBatch(collect).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def retry_failed(
    spark: SparkSession,
    prompts: T.StructType,
    enrich: Callable[[DataFrame], DataFrame],
    schema: T.StructType,
    path: str,
    key: str = "prompt",
    tries: int = 3,
    pause: float = 5.0,
    sleep: Callable = time.sleep,
) -> DataFrame:
    """Try failed prompts again, without waiting for new ones, until none is left with tries: the dead letters.

    For a query that has ended. Results are added to the last batch, and its rejects are written anew with one try more. The query
    may be started again afterwards; its next batch finds the failed prompts there.
    """
    last = _last_batch(spark, path + REJECTS)
    while last is not None:
        again = stored(_failed(spark, path, prompts, last, tries), "again")
        if again.isEmpty():
            break
        sleep(pause)
        done = stored(accepted(enrich(again.drop(TRIES))).select(*schema.fieldNames()), "retried")
        failed = stored(again.join(done.select(key), key, "left_anti").withColumn(TRIES, (F.col(TRIES) + 1).cast("int")), "failed")
        # results first: a retry that is cut off here asks again, and loses nothing
        done.write.mode("append").parquet(f"{path}/{BATCH}={last}")
        spent = read_rejects(spark, path, prompts).where((F.col(BATCH) == last) & (F.col(TRIES) >= tries)).drop(BATCH)
        left = stored(failed.unionByName(spent), "left")
        left.write.mode("overwrite").parquet(f"{path}{REJECTS}/{BATCH}={last}")
    return read_rejects(spark, path, prompts).where(F.col(TRIES) >= tries)


def _last_batch(spark: SparkSession, path: str) -> int | None:
    if not exists(spark, path):
        return None
    return spark.read.schema(f"{BATCH} long").parquet(path).agg(F.max(BATCH)).first()[0]


def dedupe_within_watermark(stream: DataFrame, key: str, time: str, delay: str = "1 hour") -> DataFrame:
    """First response per ``key``; keys are forgotten ``delay`` after their last event time."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])
