"""Session settings and the shared folder for tables a job writes on the way."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # keyed state of streams on disk, not in memory
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def session(app: str = "prosegauge", **extra: str) -> SparkSession:
    """A session with the engine's settings; master and sizes come from spark-submit."""
    builder = SparkSession.builder.appName(app)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir``, or one of our own in local mode."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="prosegauge-"))
    return context.getCheckpointDir()


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    """Whether anything is at ``path``, in whatever file system it is."""
    system, place = _file_system(spark, path)
    return system.exists(place)


def mark(spark: SparkSession, path: str) -> None:
    """An empty file at ``path``, whose name says something."""
    system, place = _file_system(spark, path)
    system.create(place, True).close()


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of the files in the folder at ``path``; none if it is not there."""
    system, place = _file_system(spark, path)
    return [found.getPath().getName() for found in system.listStatus(place)] if system.exists(place) else []


def sizes(spark: SparkSession, path: str) -> dict[str, int]:
    """Names and bytes of the files in the folder at ``path``; none if it is not there."""
    system, place = _file_system(spark, path)
    return {f.getPath().getName(): f.getLen() for f in system.listStatus(place)} if system.exists(place) else {}


def removed(spark: SparkSession, path: str, below: bool = False) -> None:
    """Delete one file, or with ``below`` a folder and all that is in it."""
    system, place = _file_system(spark, path)
    system.delete(place, below)


def renamed(spark: SparkSession, path: str, other: str) -> None:
    """Give a file another name."""
    system, place = _file_system(spark, path)
    if not system.rename(place, spark._jvm.org.apache.hadoop.fs.Path(other)):
        raise OSError(f"{path} cannot be renamed")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` as a table once and read it back, so that later uses do not recompute it."""
    spark = df.sparkSession
    path = path or fresh_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder; keeps partition order and contents."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
