"""Links between sets that share a bucket, without forming all pairs of a bucket.

First the ``PIVOTS`` items of a bucket that share most with others are compared with all its items. A
bucket whose items are then in one component has nothing left to find: so a bucket of n copies of one
item with few differences costs ``PIVOTS`` n comparisons. Of the other buckets, the items that are not in
the main component are compared with all items, in blocks of ``BLOCK`` by ``BLOCK``. Every pair of a
bucket is so either compared or known to be connected, and the components are those of all pairs.
Blocks give links that connect what is connected in them, not all pairs.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosegauge.llm.components import components
from prosegauge.llm.reducer import reduced
from prosegauge.session import stored

PIVOTS, BLOCK = 16, 128
#: Elements of sets that are counted at a time.
COLUMNS = 1 << 14


def shared_buckets(rows: DataFrame) -> DataFrame:
    """Of distinct rows (bucket, item) those of buckets with two items or more, with the number ``n`` of items."""
    sizes = stored(rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    # rows may be exploded from others; Spark takes them for as small as those, and would broadcast them
    return reduced(rows, "bucket", sizes).join(sizes.hint("merge"), "bucket")


def common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many elements each set of ``left`` has in common with each of ``right``."""
    rows = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in (*left, *right)])
    codes = np.unique(np.concatenate([*left, *right]), return_inverse=True)[1]
    order = np.argsort(codes, kind="stable")
    rows, codes = rows[order], codes[order]
    counts = np.zeros((len(left), len(right)))
    for first in range(0, int(codes[-1]) + 1 if len(codes) else 0, COLUMNS):
        part = slice(*np.searchsorted(codes, [first, first + COLUMNS]))
        grid = np.zeros((len(left) + len(right), COLUMNS), np.float32)
        grid[rows[part], codes[part] - first] = 1
        counts += grid[: len(left)] @ grid[len(left) :].T
    return counts


def _spanning(links: Iterator[tuple[int, int]]) -> list[tuple[int, int]]:
    """Those of the links that connect what was not connected before."""
    parents: dict[int, int] = {}

    def root(x: int) -> int:
        while (above := parents.setdefault(x, x)) != x:
            parents[x] = x = parents[above]
        return x

    kept = []
    for a, b in links:
        one, other = root(a), root(b)
        if one != other:
            parents[one] = other
            kept.append((a, b))
    return kept


def _compare_blocks(group: pd.DataFrame, similarity: float) -> pd.DataFrame:
    asks = group["asks"].to_numpy(bool)
    sets, items = group["elements"].tolist(), group["item"].to_numpy()
    left, right = ([x for x, a in zip(sets, asks, strict=True) if a == k] for k in (True, False))
    both = common_counts(left, right)
    either = np.array([len(x) for x in left])[:, None] + np.array([len(x) for x in right]) - both
    one, other = np.nonzero(both >= similarity * either)
    links = _spanning(zip(items[asks][one].tolist(), items[~asks][other].tolist(), strict=True))
    return pd.DataFrame(links, columns=["a", "b"], dtype="int64")


def jaccard(a: Column, b: Column, similarity: float) -> Column:
    both = F.size(F.array_intersect(a, b))
    return both >= similarity * (F.size(a) + F.size(b) - both)


def _blocks(unsettled: DataFrame, sets: DataFrame) -> DataFrame:
    """The sets of the blocks that are compared: each item in a row and each that asks in a column of the blocks of its bucket."""
    block = F.pmod(F.xxhash64("item", F.lit(1)), F.col("blocks")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    members = unsettled.select("bucket", "item", F.lit(False).alias("asks"), block.alias("theirs"), every.alias("ours"))
    asking = unsettled.where("label <> main").select(
        "bucket", "item", F.lit(True).alias("asks"), every.alias("theirs"), block.alias("ours")
    )
    # Spark takes the exploded rows for as small as the table, and would broadcast them
    return members.unionByName(asking).join(sets.hint("merge"), "item")


def linked_components(
    shared: DataFrame,
    sets: DataFrame,
    similarity: float = 0.8,
    near: Callable[[Column, Column], Column] | None = None,
    compare: Callable[[pd.DataFrame], pd.DataFrame] | None = None,
) -> DataFrame:
    """Components of the items of ``shared_buckets`` under Jaccard similarity: node, component.

    ``sets`` has the distinct ``elements`` of each ``item``; items and elements are longs. ``shared`` is a stored table.
    For another measure give ``near``, whether two elements are linked, and ``compare``, the links (a, b) of a block: rows
    (item, elements, asks), each that asks against each that does not.
    """
    near = near or functools.partial(jaccard, similarity=similarity)
    compare = compare or functools.partial(_compare_blocks, similarity=similarity)
    # items that share most come first: originals before their variants
    ranks = shared.groupBy("item").agg(F.sum("n").alias("rank"))
    ranked = stored(shared.join(ranks, "item"), "ranked")
    salt = F.pmod(F.xxhash64("item"), F.lit(PIVOTS)).alias("salt")
    chosen = ranked.groupBy("bucket", salt).agg(F.max_by("item", F.struct("rank", "item")).alias("pivot"))
    pivots = stored(chosen.select("bucket", "pivot"), "pivots")
    pairs = (
        ranked.join(pivots, "bucket")
        .where("item <> pivot")
        .select(F.least("item", "pivot").alias("a"), F.greatest("item", "pivot").alias("b"))
        .distinct()
    )
    a, b = (sets.select(F.col("item").alias(x), F.col("elements").alias(f"{x}_set")) for x in "ab")
    linked = near(F.col("a_set"), F.col("b_set"))
    links = stored(pairs.join(a, "a").join(b, "b").where(linked).select("a", "b"), "links")
    known = stored(components(links), "known")

    rest = ranked.join(pivots.withColumnRenamed("pivot", "item"), ["bucket", "item"], "left_anti")
    labelled = rest.join(known.withColumnRenamed("node", "item"), "item", "left").withColumn(
        "label", F.coalesce("component", "item")
    )
    main = (
        labelled.groupBy("bucket")
        .agg(F.max_by("label", F.struct("rank", "item")).alias("main"), F.count("*").alias("n"),
             F.min("label").alias("least"), F.max("label").alias("most"))
        .where("least <> most")
        .select("bucket", "main", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    )
    unsettled = stored(labelled.select("bucket", "item", "label").join(main, "bucket"), "unsettled")
    blocks = _blocks(unsettled, sets)
    more = blocks.groupBy("bucket", "ours", "theirs").applyInPandas(
        lambda group: compare(group), "a long, b long"
    )
    found = stored(more.where("a <> b").distinct(), "links")
    # what is known stands for the links of before
    stars = known.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
    return components(stars.unionByName(found))
