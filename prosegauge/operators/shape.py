"""Flattening, renaming and pairing of records."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from prosegauge.functions.records import lenient_struct, scored_text

TURN_BLOCK = 1024


def rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(names))


def flatten_struct(
    df: DataFrame, column: str, text_name: str, keep: Iterable[str] = ("row_id",), schema: T.StructType | None = None
) -> DataFrame:
    """One column per field of ``column`` beside the kept ones; ``text`` is renamed.

    A string column is parsed leniently first. A row without a record stays, all null.
    Fields nested deeper come out under their dotted path.
    """
    dtype = df.schema[column].dataType
    record = F.col(column)
    if isinstance(dtype, T.StringType):
        dtype = schema or scored_text()
        df = df.select(*keep, lenient_struct(record, dtype).alias(column))
        record = F.col(column)
    return df.select(*keep, *_leaves(record, dtype, "", text_name))


def _leaves(record, dtype: T.StructType, prefix: str, text_name: str) -> list:
    columns = []
    for field in dtype.fields:
        path = prefix + field.name
        if isinstance(field.dataType, T.StructType):
            columns += _leaves(record[field.name], field.dataType, path + ".", text_name)
        else:
            columns.append(record[field.name].alias(text_name if path == "text" else path))
    return columns


def ensure_columns(df: DataFrame, names: Iterable[str], dtype: str = "double") -> DataFrame:
    """Add the columns that are absent, as nulls."""
    absent = {name: F.lit(None).cast(dtype) for name in names if name not in df.columns}
    return df.withColumns(absent) if absent else df


def pair_turns(
    turns: DataFrame, key: str = "conv_id", turn: str = "turn", block: int = TURN_BLOCK
) -> DataFrame:
    """Each user turn with the assistant turn right after it: (key, turn, prompt, continuation).

    The window runs per block of ``block`` turn numbers, so a conversation of any
    length spreads over many tasks. The turn after a block's last one is the head of
    the next block that has any; heads are read from the later blocks alone, and which
    block comes next from the turn numbers alone. Turn numbers must be unique within a
    conversation.
    """
    rows = turns.select(
        key,
        turn,
        F.greatest(F.expr(f"{turn} div {block}"), F.lit(0)).cast("bigint").alias("_block"),
        F.struct("role", "text").alias("_said"),
    )
    inside = Window.partitionBy(key, "_block").orderBy(turn)
    across = Window.partitionBy(key).orderBy("_block")
    steps = (
        rows.select(key, "_block")
        .distinct()
        .withColumn("_from", F.lag("_block").over(across))
        .where("_from is not null")
    )
    later = rows.where(F.col(turn) >= block).groupBy(key, "_block").agg(F.min_by("_said", turn).alias("_after"))
    heads = steps.join(later, [key, "_block"]).select(key, F.col("_from").alias("_block"), "_after")
    following = rows.withColumn("_next", F.lead("_said").over(inside)).join(heads, [key, "_block"], "left")
    reply = F.coalesce("_next", "_after")
    return following.where((F.col("_said.role") == "user") & (reply["role"] == "assistant")).select(
        key, turn, F.col("_said.text").alias("prompt"), reply["text"].alias("continuation")
    )
