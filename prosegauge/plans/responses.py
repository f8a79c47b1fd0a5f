"""Responses to the prompts of all ranges, from local models or a chat service."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping
from functools import partial
from hashlib import md5

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from prosegauge.config import Config
from prosegauge.functions.records import model_variant
from prosegauge.functions.text import (
    clean_continuation,
    clean_response,
    remove_boilerplate,
    remove_overlap,
    strip_prompt_prefix,
)
from prosegauge.operators.enrich import enrich_text, failure_route
from prosegauge.operators.join import accepted, pending, rejected
from prosegauge.operators.take import take_quota
from prosegauge.operators.tokens import banned_token_ids, subword_truncator
from prosegauge.plans.worklog import WorkLog
from prosegauge.session import fresh_path, stored
from prosegauge.sources.readers import RESPONSES
from prosegauge.sources.versions import read_current, replace_model
from prosegauge.sources.writers import append_responses

MAX_BANNED = 100_000


def banned_sequences(lexicon: DataFrame, vocab: DataFrame | None = None, tokenizer: Callable | None = None) -> list:
    """Banned id sequences as a plain list for generator plug-ins; a word list, so its size is checked."""
    ids = banned_token_ids(lexicon, vocab, tokenizer).where("ids is not null").select("ids")
    rows = ids.limit(MAX_BANNED + 1).collect()
    if len(rows) > MAX_BANNED:
        raise ValueError("the lexicon is too long to hand to every generator")
    return [list(row.ids) for row in rows]


def generate_responses(
    ranges: DataFrame,
    path: str,
    models: Mapping[str, Callable],
    config: Config = Config(),
    variant: str | None = None,
    banned: list | None = None,
    label: str = "toxicity_bin",
    partitions: int | None = None,
) -> None:
    """Continue every prompt with every local model and replace all of that model's results, once they are complete.

    Plug-ins give the full text, prompt included. With ``banned`` sequences they are built
    as ``factory(banned)``, and results go under the model's ``variant``. ``partitions``
    is the number of tasks a model runs in, those of ``ranges`` by default.
    """
    prompts = ranges.select("prompt", F.col(label).alias("label")).where("prompt is not null")
    for name, factory in models.items():
        plugin = factory if banned is None else partial(factory, banned)
        full = enrich_text(prompts, plugin, "prompt", "_full", config.batch_size, partitions)
        text = clean_continuation(strip_prompt_prefix(F.col("_full"), F.col("prompt")))
        results = full.select(
            "prompt",
            text.alias("continuation"),
            F.lit(None).cast("timestamp").alias("collected_at"),
            "label",
        )
        tag = ranges.sparkSession.range(1).select(model_variant(F.lit(name), F.lit(variant))).first()[0]
        replace_model(results, path, tag)


def collected(spark: SparkSession, path: str, model: str) -> DataFrame:
    rows = read_current(spark, path, RESPONSES)
    return spark.createDataFrame([], RESPONSES) if rows is None else rows.where(F.col("model") == model)


def collect_responses(
    ranges: DataFrame,
    path: str,
    model: str,
    generator: Callable,
    config: Config = Config(),
    quota: int | None = None,
    tokenizer: Callable | None = None,
    label: str = "toxicity_bin",
    rejects: str | None = None,
    pause: float = 5.0,
    sleep: Callable = time.sleep,
) -> DataFrame:
    """Collect chat replies until each range has its quota of distinct prompts.

    Prompts already collected are left out. The prompts to ask are dealt once into slices beside the
    table (``path`` with "-work", a folder per model) and committed a few slices at a time, see :class:`WorkLog`. A job that
    ended early first goes on with the slices that its manifest does not have, as far as they are still wanted. A range whose
    prompts fail goes on with prompts not yet tried. Only when none are left are failed ones
    tried again, ``config.rounds`` times in all, until a round in which every one of
    them that the quota still asks for was tried has no success. A call that raises fails its prompts only. Failures
    go to the table ``rejects`` with the service's status, what it means and the reason; ``shortfall`` tells what is missing.
    """
    spark = ranges.sparkSession
    quota = config.range_size if quota is None else quota
    prompts = ranges.select("row_id", "prompt", F.lit(model).alias("model"), F.col(label).alias("label"))
    prompts = prompts.where("prompt is not null").groupBy("model", "label", "prompt").agg(F.min("row_id").alias("row_id"))
    keys, failures = ["label", "prompt"], fresh_path(spark, "failures")
    work = f"{path.rstrip('/')}-work/{md5(model.encode()).hexdigest()}"
    log = WorkLog(spark, work, config.slice_rows, config.commit_seconds)
    left = log.unfinished()
    n_failed = 0
    for tries in range(config.rounds):
        if tries and not n_failed:
            break
        paused, successes = not tries, 0
        while True:
            done = collected(spark, path, model)
            asked = prompts if left is None else left.join(prompts.select(*keys), keys, "left_semi")
            rest = pending(asked.select("row_id", "prompt", "model", "label"), done, keys)
            if n_failed:
                tried = spark.read.schema("label string, prompt string").parquet(failures)
                tried = tried.groupBy(*keys).agg(F.count("*").alias("_tries"))
                rest = rest.join(tried, keys, "left").where(F.coalesce("_tries", F.lit(0)) == tries).drop("_tries")
            if quota:
                rest = stored(rest, "pending")  # read several times to find the quota
            wanted = stored(take_quota(rest.select("row_id", "prompt", "model", "label"), "row_id", quota, done), "wanted")
            resumed, left = left is not None, None
            if not log.deal(wanted, keys):
                if resumed:
                    continue
                break
            if not paused:
                sleep(pause)
                paused = True
            for part in log.commits():
                good, bad = _commit(part, path, generator, config, tokenizer, rejects, failures)
                successes, n_failed = successes + good, n_failed + bad
            if not quota and not resumed:
                break  # all that were there have had this try
        if tries and not successes:
            break
    return collected(spark, path, model)


def _commit(
    part: DataFrame,
    path: str,
    generator: Callable,
    config: Config,
    tokenizer: Callable | None,
    rejects: str | None,
    failures: str,
) -> tuple[int, int]:
    """Ask for the replies to some prompts and commit them: how many are good, and how many are not."""
    replies = enrich_text(
        part, generator, name="_raw", batch_size=1, concurrency=config.concurrency, in_flight=config.in_flight,
        reason="reason", status="service_status", retry=config.retry,
    )
    # one task may have all the calls; cleaning is spread again
    replies = replies.repartition(part.sparkSession.sparkContext.defaultParallelism)
    counts, has_text = Observation(), F.coalesce(F.col("continuation") != "", F.lit(False))
    cleaned = _cleaned(replies, config, tokenizer)
    cleaned = cleaned.observe(counts, F.count_if(has_text).alias("good"), F.count_if(~has_text).alias("bad"))
    replies = stored(cleaned, "replies")
    good, bad = counts.get["good"], counts.get["bad"]
    if good:
        append_responses(accepted(replies).select("prompt", "continuation", "model", "label"), path)
    if bad:
        failed = rejected(replies)
        failed.select("label", "prompt").write.mode("append").parquet(failures)
        if rejects:
            status = failure_route(F.col("service_status"), F.col("reason")).alias("status")
            failed.select("*", status).write.mode("append").partitionBy("model", "label").parquet(rejects)
    return good, bad


def shortfall(ranges: DataFrame, done: DataFrame, quota: int, label: str = "toxicity_bin") -> DataFrame:
    """Ranges with fewer distinct prompts collected than wanted: label, n_wanted, n_done.

    Wanted are ``quota`` prompts, or all that the range has if it has fewer or ``quota`` is 0.
    """
    there = ranges.where("prompt is not null").groupBy(F.col(label).alias("label"))
    there = there.agg(F.countDistinct("prompt").alias("n_wanted"))
    if quota:
        there = there.withColumn("n_wanted", F.least("n_wanted", F.lit(quota).cast("bigint")))
    got = done.groupBy("label").agg(F.countDistinct("prompt").alias("n_done"))
    both = there.join(got, "label", "left").select("label", "n_wanted", F.coalesce("n_done", F.lit(0)).alias("n_done"))
    return both.where("n_done < n_wanted")


def _cleaned(replies: DataFrame, config: Config, tokenizer: Callable | None) -> DataFrame:
    prompt, raw = F.col("prompt"), F.col("_raw")
    if tokenizer is None:
        text = clean_response(prompt, raw, config.new_tokens)
    else:
        text = subword_truncator(tokenizer, config.new_tokens)(prompt, remove_boilerplate(remove_overlap(prompt, raw)))
    return replies.withColumn("continuation", text).drop("_raw")
