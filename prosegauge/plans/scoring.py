"""Scores for the responses of all models."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosegauge.config import Config
from prosegauge.operators.enrich import score_models
from prosegauge.operators.join import pending
from prosegauge.operators.shape import ensure_columns
from prosegauge.plans.worklog import WorkLog
from prosegauge.session import exists, stored
from prosegauge.sources.readers import scan_model_dirs
from prosegauge.sources.writers import packed

KEYS = ("model", "label", "prompt", "continuation")


def score_responses(
    spark: SparkSession,
    responses: DataFrame | Mapping[str, str],
    out: str,
    scorer: Callable,
    config: Config = Config(),
    resume: bool = False,
    **options,
) -> DataFrame:
    """Score a response table, or the CSV files of several model folders, into ``out``.

    By default the models and ranges at hand are scored anew. With ``resume`` only rows
    not yet in ``out`` are scored and added, a commit at a time (see :class:`WorkLog`): a run that fails
    or is stopped has lost no more than its last commit, and run again it goes on from there. Every row is
    looked up in ``out`` once and read once more to be scored, however many commits there are.
    """
    if config.pace and config.pace.start is None:
        config = replace(config, pace=replace(config.pace, start=time.time()))
    if isinstance(responses, Mapping):
        responses = scan_model_dirs(spark, responses)
    responses = ensure_columns(responses, config.attributes)
    options = dict(attrs=config.attributes, retry=config.retry, pace=config.pace) | options
    if not resume:
        rows = score_models(responses, scorer, **options)
        writer = packed(rows, ["model", "label"]).write.partitionBy("model", "label")
        writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(out)
        return spark.read.schema(rows.schema).parquet(out)
    done = _scored(spark, out)
    rest = stored(responses if done is None else pending(responses, done, KEYS), "pending")
    log = WorkLog(spark, f"{out.rstrip('/')}-work", config.slice_rows, config.commit_seconds)
    # equal texts are in one slice and are scored once
    log.deal(rest, ["continuation"])
    schema = None
    for part in log.commits():
        rows = score_models(part, scorer, **options)
        schema = rows.schema
        packed(rows, ["model", "label"]).write.partitionBy("model", "label").mode("append").parquet(out)
    if schema is None:
        schema = score_models(rest, scorer, **options).schema
    return spark.read.schema(schema).parquet(out)


def _scored(spark: SparkSession, path: str) -> DataFrame | None:
    columns = "model string, label string, prompt string, continuation string"
    if not exists(spark, path):
        return None
    return spark.read.schema(columns).parquet(path).where(F.col("model").isNotNull())
