"""Fixed-size character chunks of single texts and of a whole ordered corpus."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from prosegauge.session import stored

BLOCK_ROWS, BLOCK_CHARS = 50_000, 1 << 25
MAX_BLOCKS = 65_536
#: Offsets, one for each corpus and block, that are broadcast; more are joined by shuffle.
BROADCAST_OFFSETS = 100_000


def pieces(text: Column, size: int) -> Column:
    """Consecutive pieces of ``size`` characters, the last one shorter; linear in the text."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))


def chunk_each(df: DataFrame, text: str = "text", size: int = 512, keep: Sequence[str] = ("row_id",)) -> DataFrame:
    """Chunks of every text by itself: (kept columns, chunk_no, chunk). No shuffle."""
    return df.select(*keep, F.posexplode(pieces(F.col(text), size)).alias("chunk_no", "chunk"))


def chunk_corpus(
    df: DataFrame,
    order: str = "row_id",
    text: str = "text",
    size: int = 512,
    by: Sequence[str] = (),
    block_rows: int = BLOCK_ROWS,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """Chunks of the corpus as one string, one text per line in ``order``: (by, chunk_id, chunk).

    ``by`` tells any number of corpora apart, such as classes. Rows are cut into blocks of
    consecutive order values, of about ``block_rows`` rows or ``block_chars`` characters, and
    shuffled once, by block. A block's offset is the sum of the blocks before it, so the running
    offset needs a window per block only, and all chunks inside a block are put together where
    they are. Offsets meet the rows where these are: by broadcast if there are few, else shuffled
    as the rows were. The chunk across a block's edge, two per block, is the only text shuffled
    again. ``order`` must be unique within a corpus; a value that repeats is an error.
    """
    # a struct, so that nulls in ``by`` are equal and both sides of the join are placed alike
    corpus = [F.struct(*by).alias("_corpus")] if by else []
    keys = ["_corpus", "_block"] if by else ["_block"]
    place, line = F.col(order).alias("_order"), F.concat(F.col(text), F.lit("\n")).alias("_line")
    length = F.length(line).cast("bigint").alias("_length")
    full = df.where(F.col(text).isNotNull())
    sizes = stored(full.select(*corpus, place, length), "lengths")
    bounds, n_offsets = _block_bounds(sizes, block_rows, block_chars)
    rows = _with_blocks(full.select(*corpus, place, line, length), bounds)
    before = Window.partitionBy(*keys[:-1]).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy(*keys)
        .agg(F.sum("_length").alias("_total"))
        .withColumn("_base", F.coalesce(F.sum("_total").over(before), F.lit(0)))
    )
    in_order = Window.partitionBy(*keys).orderBy("_order")
    repeated = F.lag("_order").over(in_order) == F.col("_order")
    unclear = F.raise_error(F.lit("the order does not tell all rows apart")).cast("bigint")
    so_far = F.coalesce(F.sum("_length").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.withColumn("_before", F.when(repeated, unclear).otherwise(so_far))
    placed = placed.join(F.broadcast(offsets) if n_offsets <= BROADCAST_OFFSETS else offsets.hint("merge"), keys)
    start = F.col("_base") + F.col("_before")
    placed = placed.select(
        *keys,
        "_line",
        start.alias("_start"),
        (start + F.col("_length")).alias("_end"),
        # chunks from _first up to, not including, _last lie wholly in the block
        F.expr(f"(_base + {size - 1}) div {size}").alias("_first"),
        F.expr(f"(_base + _total) div {size}").alias("_last"),
    )
    whole = F.expr("chunk_id >= _first and chunk_id < _last")
    touches_edge = (F.col("_start") < F.col("_first") * size) | (F.col("_end") > F.col("_last") * size)
    inner = _joined(_exploded(placed, keys, size).where(whole), [*keys, "chunk_id"])
    edges = _joined(_exploded(placed.where(touches_edge), keys, size).where(~whole), [*keys[:-1], "chunk_id"])
    chunks = inner.drop("_block").unionByName(edges)
    return chunks.select(*[F.col("_corpus")[name].alias(name) for name in by], "chunk_id", "chunk")


def _block_bounds(sizes: DataFrame, block_rows: int, block_chars: int) -> tuple[list[float], int]:
    """Order values that cut the rows (_order, _length, perhaps _corpus) into blocks, and how many
    pairs of corpus and block there are at most, within some per cent.

    They come from a sample of the rows, as for a range partitioning, and settle the sizes of the
    blocks and nothing else.
    """
    corpora = F.approx_count_distinct("_corpus") if "_corpus" in sizes.columns else F.lit(1)
    total, chars, n_corpora = sizes.agg(F.count("*"), F.coalesce(F.sum("_length"), F.lit(0)), corpora).first()
    blocks = min(MAX_BLOCKS, math.ceil(max(total / block_rows, chars / block_chars)))
    most = min(total, n_corpora * max(1, blocks))
    if blocks <= 1:
        return [], most
    sample = sizes.select(F.col("_order").cast("double").alias("_at"), "_length").dropna()
    drawn = sample.sample(min(1.0, 32 * blocks / total), seed=1).toArrow()
    values, lengths = (drawn.column(i).to_numpy() for i in range(2))
    if not len(values):
        return [], most
    ranked = np.argsort(values, kind="stable")
    load = np.cumsum(lengths[ranked] / block_chars + 1 / block_rows)
    cuts = np.searchsorted(load, load[-1] * np.arange(1, blocks) / blocks)
    return np.unique(values[ranked][np.minimum(cuts, len(values) - 1)]).tolist(), most


def _with_blocks(rows: DataFrame, bounds: list[float]) -> DataFrame:
    if not bounds:
        return rows.withColumn("_block", F.lit(0))
    cut = Bucketizer(splits=[-math.inf, *bounds, math.inf], inputCol="_at", outputCol="_block")
    placed = cut.transform(rows.withColumn("_at", F.col("_order").cast("double")))
    return placed.withColumn("_block", F.col("_block").cast("int")).drop("_at")


def _exploded(placed: DataFrame, keys: Sequence[str], size: int) -> DataFrame:
    inside = F.col("_start") % size
    room = (size - inside).cast("int")
    parts = F.concat(
        F.array(F.substring("_line", 1, room)), pieces(F.substring(F.col("_line"), room + 1, F.length("_line")), size)
    )
    exploded = placed.select(
        *keys, "_first", "_last", "_start", inside.alias("_inside"), F.posexplode(parts).alias("_no", "_piece")
    )
    return exploded.select(
        *keys,
        "_first",
        "_last",
        F.expr(f"_start div {size} + _no").alias("chunk_id"),
        F.when(F.col("_no") == 0, F.col("_inside")).otherwise(0).alias("_at"),
        "_piece",
    )


def _joined(parts: DataFrame, keys: list[str]) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("_at", "_piece")))
    return parts.groupBy(*keys).agg(F.array_join(ordered["_piece"], "").alias("chunk"))
