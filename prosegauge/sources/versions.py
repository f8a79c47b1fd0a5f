"""Results of a model replaced as a whole.

A model's new results are written to a folder of their own beside the response table (``path`` with
"-versions"), and only when all of them are there does an empty file in ``_current``, named by number, model and
version, make them the model's results. Whoever reads follows the file of the highest number. A run that fails
leaves the results of before; one that leaves out a range leaves none of that range's old rows.

Models without a version have their rows in the table itself, as before. Rows that are added to a model with a
version, or that replace one of its ranges, go to its version. Only names of models and versions come to the driver.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from hashlib import md5

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosegauge.session import exists, mark, names, removed

POINTER = re.compile(r"(\d{10})-([0-9a-f]{32})-(v[0-9a-f]{32})")


def _beside(path: str) -> str:
    return f"{path.rstrip('/')}-versions"


def _pointers(spark: SparkSession, path: str) -> list[tuple[str, str, str]]:
    """Number, model's digest and version of every replacement, in order."""
    found = map(POINTER.fullmatch, names(spark, f"{_beside(path)}/_current"))
    return sorted(match.groups() for match in found if match)


def current(spark: SparkSession, path: str) -> dict[str, str]:
    """The folder of each model that has a version, by the md5 of the model's name."""
    return {model: f"{_beside(path)}/version={version}" for _, model, version in _pointers(spark, path)}


def replace_model(df: DataFrame, path: str, model: str, by: str = "label") -> None:
    """Make ``df`` all results of ``model``. Every task writes what it has, since results are costly to make."""
    spark = df.sparkSession
    version = f"v{uuid.uuid4().hex}"
    folder = f"{_beside(path)}/version={version}"
    df.withColumn("model", F.lit(model)).write.mode("error").partitionBy("model", by).parquet(folder)
    pointers = _pointers(spark, path)
    number = int(pointers[-1][0]) + 1 if pointers else 0
    mark(spark, f"{_beside(path)}/_current/{number:010d}-{md5(model.encode()).hexdigest()}-{version}")


def placed(df: DataFrame, path: str) -> Iterator[tuple[DataFrame, str]]:
    """Rows to write beside the folder they belong to: each version's, then those of all other models.

    ``df`` is read once per model that has a version.
    """
    folders, model = current(df.sparkSession, path), F.md5(F.col("model"))
    for digest, folder in folders.items():
        yield df.where(model == digest), folder
    others = F.coalesce(~model.isin(list(folders)), F.lit(True)) if folders else F.lit(True)
    yield df.where(others), path


def read_current(spark: SparkSession, path: str, schema) -> DataFrame | None:
    """The results of all models, each of its current version; None if there are none."""
    folders = current(spark, path)
    frames = []
    if exists(spark, path):
        rows = spark.read.schema(schema).parquet(path)
        replaced = F.md5(F.col("model")).isin(list(folders))
        frames.append(rows.where(F.coalesce(~replaced, F.lit(True))) if folders else rows)
    if folders:
        rows = spark.read.schema(schema).option("basePath", _beside(path)).parquet(*folders.values())
        frames.append(rows.select(*schema.fieldNames()))
    if not frames:
        return None
    return frames[0].unionByName(frames[1]) if len(frames) == 2 else frames[0]


def drop_superseded(spark: SparkSession, path: str) -> int:
    """Delete the versions that were replaced, and how many these are. No job may be reading them or replacing a model."""
    kept = {folder.rsplit("=", 1)[1] for folder in current(spark, path).values()}
    old = [pointer for pointer in _pointers(spark, path) if pointer[2] not in kept]
    for number, model, version in old:
        removed(spark, f"{_beside(path)}/version={version}", below=True)
        removed(spark, f"{_beside(path)}/_current/{number}-{model}-{version}")
    return len(old)
