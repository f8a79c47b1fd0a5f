"""From a pair corpus to prompts, continuations, class corpora and score ranges."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosegauge.config import Config
from prosegauge.operators.report import counted
from prosegauge.operators.shape import flatten_struct
from prosegauge.operators.split import split_by_threshold
from prosegauge.operators.take import balance_classes, equalize_ranges
from prosegauge.session import stored
from prosegauge.sources.readers import PAIR, parsed_pairs, read_pair_lines, with_file_row_id
from prosegauge.sources.writers import write_ranges, write_table


class PromptTables(NamedTuple):
    prompts: DataFrame
    continuations: DataFrame
    corpus: DataFrame
    ranges: DataFrame
    #: What the job that writes the pairs counts.
    counts: dict[str, int]


def generate_prompts(
    spark: SparkSession, source: str, out: str, config: Config = Config(), nested: bool = True
) -> PromptTables:
    """Parse the corpus once, number its rows, and derive all tables from the stored result.

    Classes follow the score of the continuation, ranges that of the prompt. All later
    passes read the stored columns they need and none of the JSON. What is not parsed or null is counted by
    the job that writes the pairs: ``n_rows``, ``unparsed_lines``, ``unparsed_prompt`` and ``unparsed_continuation`` (values
    there that give no field), and ``null_`` with the name of each column.
    """
    raw = with_file_row_id(read_pair_lines(spark, source))
    given = {f"_has_{name}": F.col(name).isNotNull() for name in PAIR}
    raw = raw.withColumns(given | {"unparsed": F.col("unparsed").isNotNull()})
    if nested:
        raw = parsed_pairs(raw, config.attributes)
    told = ["unparsed", *given]
    prompt = flatten_struct(raw, "prompt", "prompt", ["row_id", "continuation", *told])
    both = flatten_struct(
        prompt.withColumnsRenamed({a: f"prompt_{a}" for a in config.attributes}),
        "continuation",
        "continuation",
        ["row_id", "prompt", *[f"prompt_{a}" for a in config.attributes], *told],
    )
    values = [c for c in both.columns if c not in ("row_id", *told)]
    empty = {}
    for name, prefix in zip(PAIR, ("prompt_", ""), strict=True):
        scores = [F.col(f"{prefix}{a}").cast("string") for a in config.attributes]
        empty[f"unparsed_{name}"] = F.col(f"_has_{name}") & F.coalesce(F.col(name), *scores).isNull()
    both, counts = counted(both, values, unparsed_lines=F.col("unparsed"), **empty)
    pairs = stored(both.drop(*told), "pairs", f"{out}/pairs")

    prompts = pairs.select("row_id", "prompt", *[pairs[f"prompt_{a}"].alias(a) for a in config.attributes])
    prompts = stored(prompts, "prompts", f"{out}/prompts")
    continuations = pairs.select("row_id", "continuation", *config.attributes, "prompt")
    continuations = stored(continuations, "continuations", f"{out}/continuations")

    classes = split_by_threshold(continuations, "toxicity", config.class_threshold)
    corpus = balance_classes(classes, "class", "row_id").selectExpr("row_id", "continuation as text", "class")
    write_table(corpus, f"{out}/corpus", ["class"])

    ranges = equalize_ranges(
        prompts, "toxicity", "row_id", config.edges, config.labels, config.range_size, config.seed
    )
    write_ranges(ranges, f"{out}/ranges")
    return PromptTables(
        prompts,
        continuations,
        spark.read.schema("row_id bigint, text string, class int").parquet(f"{out}/corpus"),
        spark.read.schema(ranges.schema).parquet(f"{out}/ranges"),
        counts.get,
    )
