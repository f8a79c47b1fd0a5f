"""Approximate nearest neighbours by cosine: few stable projections, kd-tree, chi-square stopping test.

1. Equal vectors are one item with the ``NEAREST`` + 1 smallest of their ids. Every item's unit vector is projected
   on ``DIMS`` seeded Gaussian directions: the squared projected distance of two items is their squared distance
   times a chi-square variable of ``DIMS`` degrees of freedom.
2. The upper levels of a kd-tree over the projections are fitted on at most ``SAMPLE`` items. They deal all
   items to cells; a cell is cut into blocks of about ``BLOCK`` items by hash, and each block has a kd-tree of its own, down to
   leaves of ``LEAF`` items. Every item is indexed.
3. A query visits its own cell, then the others whose box passes the stopping test. In a block leaves are
   opened in the order of their distance, and items verified by exact cosine in the order of their projected distance,
   until the next one's squared projected distance is above the ``CONFIDENCE`` quantile times the squared distance
   of the worst of the nearest found. A true neighbour fails this test with probability 1 - ``CONFIDENCE``
   at most, whatever the data, so the expected recall is no less than ``CONFIDENCE``.

Equal queries are searched once. No task holds more than one block and ``QUERIES`` queries.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and rows without id, take no
part. Rows that repeat an id count once, with the smallest of their vectors. Vectors of unlike lengths are not
compared. Of equal scores the smaller id comes first. With fewer candidates than asked for all are
returned; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from prosegauge.operators.join import hot_keys, join_skewed
from prosegauge.session import stored

NEAREST = 5
DIMS, CONFIDENCE, SEED = 16, 0.98, 23
#: Items that fit the upper tree, cells it has at most, and items of a cell: of few items that of many cells.
SAMPLE, CELLS, SPREAD, LEAST_CELL = 1 << 16, 1 << 12, 64, 1 << 11
BLOCK, LEAF, QUERIES = 1 << 14, 32, 1 << 14
#: Items verified at a time.
STEP = 64
#: Rounding of squared distances.
SLACK = 1e-9
ITEM = "item string, ids array<long>, embedding array<double>"
INDEX = "place long, n int, vectors binary, projected binary, leaves binary, items array<string>, ids array<array<long>>"
HITS = "item string, vec_id long, score double"


def chi_square_quantile(share: float, freedom: int) -> float:
    """Where the distribution function of an even number of degrees of ``freedom`` is ``share``."""

    def below(x: float) -> float:
        term, total = 1.0, 1.0
        for k in range(1, freedom // 2):
            term *= x / 2 / k
            total += term
        return 1 - math.exp(-x / 2) * total

    low, high = 0.0, 20.0 * freedom
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if below(middle) < share else (low, middle)
    return high


def unit_rows(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1, whatever their magnitude."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def scaled(rows: np.ndarray) -> np.ndarray:
    """Rows as they are; of length 1 if their squares could leave the range of doubles."""
    largest = np.abs(rows).max(axis=1)
    return unit_rows(rows) if largest.max() > 1e150 or largest.min() < 1e-150 else rows


def lengths(rows: np.ndarray) -> np.ndarray:
    return np.sqrt((rows * rows).sum(axis=1))


def _directions(dim: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((dim, DIMS))


def _usable() -> Column:
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & good & F.exists("embedding", lambda x: x != 0)


def usable(vectors: DataFrame) -> DataFrame:
    """Rows that take part, one of each id, with the key of their vector: vec_id, embedding, item."""
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).where(_usable())
    repeated = stored(rows.groupBy("vec_id").count().where("count > 1").select("vec_id"), "repeated-ids")
    if not repeated.isEmpty():
        again = rows.join(repeated, "vec_id", "left_semi").groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
        rows = rows.join(repeated, "vec_id", "left_anti").unionByName(again)
    halves = (F.hex(F.xxhash64(F.lit(seed), "embedding")) for seed in (1, 2))
    return rows.withColumn("item", F.concat_ws("-", *halves))


def distinct_items(rows: DataFrame, k: int) -> DataFrame:
    """A row per vector with the ``k`` smallest of its ids, in order; hot vectors are cut to these before the shuffle."""
    order = Window.partitionBy("item").orderBy("vec_id")
    few = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return few.groupBy("item").agg(
        F.sort_array(F.collect_list("vec_id")).alias("ids"), F.first("embedding").alias("embedding")
    )


def _project(batches: Iterator[pd.DataFrame], dim: int, tree: list | None) -> Iterator[pd.DataFrame]:
    directions = _directions(dim)
    for batch in batches:
        found = unit_rows(np.stack(batch["embedding"])) @ directions
        yield batch.assign(projected=list(found), cell=_cells(tree, found))


def fit_cells(points: np.ndarray, cells: int) -> list:
    """Splits (dimension, value) of a kd-tree of at least ``cells`` cells, as a heap; each at a median of the widest dimension."""
    depth = max(0, math.ceil(math.log2(max(1, cells))))
    tree: list = [None] * (2**depth - 1)
    parts = {0: points}
    for node in range(len(tree)):
        part = parts.pop(node)
        if len(part) < 2:
            tree[node], low = (0, 0.0), np.zeros(len(part), bool)
        else:
            widest = int(np.argmax(part.max(axis=0) - part.min(axis=0)))
            middle = float(np.median(part[:, widest]))
            tree[node], low = (widest, middle), part[:, widest] < middle
        if 2 * node + 2 < len(tree):
            parts[2 * node + 1], parts[2 * node + 2] = part[low], part[~low]
    return tree


def _cells(tree: list | None, points: np.ndarray) -> np.ndarray:
    """The cell of each point."""
    node = np.zeros(len(points), np.int64)
    if tree:
        dims, values = np.array([d for d, _ in tree]), np.array([v for _, v in tree])
        for _ in range(int(math.log2(len(tree) + 1))):
            high = points[np.arange(len(points)), dims[node]] >= values[node]
            node = 2 * node + 1 + high
    return node


def _leaf_order(points: np.ndarray) -> list[np.ndarray]:
    """Members of each leaf of a kd-tree over the points."""
    leaves, waiting = [], [np.arange(len(points))]
    while waiting:
        part = waiting.pop()
        if len(part) <= LEAF:
            leaves.append(part)
            continue
        some = points[part]
        widest = int(np.argmax(some.max(axis=0) - some.min(axis=0)))
        half = len(part) // 2
        order = part[np.argpartition(some[:, widest], half)]
        waiting += [order[half:], order[:half]]
    return leaves


def _build(group: pd.DataFrame) -> pd.DataFrame:
    """The kd-tree of a block as one row: items in the order of its leaves."""
    points = np.stack(group["projected"])
    leaves = _leaf_order(points)
    order = np.concatenate(leaves)
    starts = np.cumsum([0, *map(len, leaves)], dtype=np.int64)
    row = {
        "place": group["place"].iloc[0],
        "n": len(order),
        "vectors": np.stack(group["embedding"])[order].tobytes(),
        "projected": points[order].tobytes(),
        "leaves": starts.tobytes(),
        "items": group["item"].to_numpy()[order].tolist(),
        "ids": [list(x) for x in group["ids"].to_numpy()[order]],
    }
    return pd.DataFrame([row])


class _Block:
    """A block of the index, as a task searches it."""

    def __init__(self, row) -> None:
        self.projected = np.frombuffer(row["projected"]).reshape(row["n"], DIMS)
        self.vectors = scaled(np.frombuffer(row["vectors"]).reshape(row["n"], -1))
        self.lengths = lengths(self.vectors)
        self.ids = row["ids"]
        self.first = np.array([x[0] for x in row["ids"]])
        starts = np.frombuffer(row["leaves"], np.int64)
        self.sizes = np.diff(starts)
        self.low = np.minimum.reduceat(self.projected, starts[:-1])
        self.high = np.maximum.reduceat(self.projected, starts[:-1])

    def search(self, query: np.ndarray, point: np.ndarray, worst: float, ratio: float, k: int) -> list[tuple[float, int]]:
        """The ``k`` best (score, place) found; ``worst`` is the score that the last of the nearest has already."""
        query = scaled(query[None])[0]
        length = lengths(query[None])[0]
        limit = ratio * (2 - 2 * worst) + SLACK
        outside = np.maximum(self.low - point, 0) + np.maximum(point - self.high, 0)
        opened = np.flatnonzero(np.repeat((outside * outside).sum(axis=1) <= limit, self.sizes))
        gap = self.projected[opened] - point
        distances = (gap * gap).sum(axis=1)
        order = np.argsort(distances, kind="stable")
        waiting, distances = opened[order], distances[order]
        scores, places = np.empty(0), np.empty(0, np.int64)
        at, step = 0, STEP
        while at < len(waiting) and distances[at] <= limit:
            end = min(at + step, int(np.searchsorted(distances, limit, "right")))
            checked = waiting[at:end]
            # each row is summed in the same order, so equal rows have equal scores
            fresh = (self.vectors[checked] * query).sum(axis=1) / (self.lengths[checked] * length)
            scores, places = np.concatenate([scores, fresh]), np.concatenate([places, checked])
            best = np.lexsort((self.first[places], -scores))[:k]
            scores, places = scores[best], places[best]
            if len(scores) == k:
                limit = min(limit, ratio * (2 - 2 * float(scores[-1])) + SLACK)
            at, step = end, 2 * step
        return list(zip(scores.tolist(), places.tolist(), strict=True))


def _search_block(blocks: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    ratio, found = chi_square_quantile(CONFIDENCE, DIMS), []
    for _, row in blocks.iterrows():
        block = _Block(row)
        worst = np.nan_to_num(queries["worst"].to_numpy(np.float64), nan=-math.inf)
        for item, query, point, score in zip(queries["item"], queries["embedding"], queries["projected"], worst, strict=True):
            # below the worst possible cosine nothing is left out
            for cosine, place in block.search(np.asarray(query), np.asarray(point), score, ratio, k):
                found += [(item, vec_id, cosine) for vec_id in block.ids[place]]
    return pd.DataFrame(found, columns=["item", "vec_id", "score"]).astype({"vec_id": "int64", "score": "float64"})


def _best(hits: DataFrame, k: int) -> DataFrame:
    """The ``k`` best hits of each item; every task cuts its own before the shuffle."""
    order = Window.partitionBy("item").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _visits(batches: Iterator[pd.DataFrame], boxes: pd.DataFrame, chunks: int, home: bool) -> Iterator[pd.DataFrame]:
    """A row per query and block that it visits: its own cell, or the others whose box passes the stopping test."""
    ratio = chi_square_quantile(CONFIDENCE, DIMS)
    cells, blocks = boxes["cell"].to_numpy(), boxes["blocks"].to_numpy()
    low, high = np.stack(boxes["low"]), np.stack(boxes["high"])
    for batch in batches:
        for at in range(0, len(batch), 256):
            part = batch.iloc[at : at + 256]
            own = part["cell"].to_numpy()[:, None] == cells[None, :]
            if home:
                wanted = own
            else:
                points = np.stack(part["projected"])
                reach = np.zeros(own.shape)
                for d in range(DIMS):
                    outside = np.maximum(low[None, :, d] - points[:, None, d], 0) + np.maximum(points[:, None, d] - high[None, :, d], 0)
                    reach += outside * outside
                worst = np.nan_to_num(part["worst"].to_numpy(np.float64), nan=-math.inf)
                wanted = ~own & (reach <= (ratio * (2 - 2 * worst) + SLACK)[:, None])
            query, cell = np.nonzero(wanted)
            visits = part.iloc[np.repeat(query, blocks[cell])].drop(columns="cell")
            places = [cells[c] * BLOCK + b for c in cell for b in range(blocks[c])]
            chunk = [int(item[:8], 16) % chunks for item in visits["item"].str.rjust(8, "0")]
            yield visits.assign(place=np.array(places, np.int64), chunk=np.array(chunk, np.int64))


def _round(index: DataFrame, queries: DataFrame, boxes: pd.DataFrame, chunks: int, home: bool, k: int) -> DataFrame:
    """Hits of queries (item, embedding, projected, cell, worst) in the blocks that they visit."""
    schema = "item string, embedding array<double>, projected array<double>, worst double, place long, chunk long"
    visits = queries.mapInPandas(lambda batches: _visits(batches, boxes, chunks, home), schema)
    every = index.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))))
    return every.groupBy("place", "chunk").cogroup(visits.groupBy("place", "chunk")).applyInPandas(
        lambda blocks, part: _search_block(blocks, part, k), HITS
    )


def _index(items: DataFrame, dim: int) -> tuple[DataFrame, DataFrame, pd.DataFrame]:
    """Items with projection and cell, the blocks of the index, and the box and number of blocks of each cell."""
    spark, n = items.sparkSession, items.count()
    size = min(BLOCK, max(LEAST_CELL, n // SPREAD))
    cells = min(CELLS, -(-n // size))
    tree: list | None = None
    if cells > 1:
        # hash order is a sample that does not depend on the layout
        share = F.pmod(F.xxhash64("item", F.lit(5)), F.lit(n)) < F.lit(SAMPLE)
        some = items.where(share).limit(SAMPLE).select("embedding").toPandas()
        tree = fit_cells(unit_rows(np.stack(some["embedding"])) @ _directions(dim), cells) if len(some) else None
    schema = f"{ITEM}, projected array<double>, cell long"
    placed = stored(items.mapInPandas(lambda batches: _project(batches, dim, tree), schema), "projected")
    # at most twice CELLS rows
    boxes = placed.groupBy("cell").agg(
        F.count("*").alias("n"),
        F.array(*(F.min(F.get("projected", F.lit(d))) for d in range(DIMS))).alias("low"),
        F.array(*(F.max(F.get("projected", F.lit(d))) for d in range(DIMS))).alias("high"),
    ).toPandas()
    boxes["blocks"] = -(-boxes["n"] // BLOCK)
    counts = F.broadcast(spark.createDataFrame(boxes[["cell", "blocks"]], "cell long, blocks long"))
    block = F.pmod(F.xxhash64("item", F.lit(3)), F.col("blocks"))
    blocks = placed.join(counts, "cell").withColumn("place", F.col("cell") * BLOCK + block)
    return placed, stored(blocks.groupBy("place").applyInPandas(_build, INDEX), "index"), boxes


def _search(items: DataFrame, asked: DataFrame, dim: int, k: int) -> DataFrame:
    """The ``k`` best ids for each of the items ``asked``, itself included: item, vec_id, score."""
    placed, index, boxes = _index(items, dim)
    queries = placed.join(asked, "item", "left_semi").select("item", "embedding", "projected", "cell")
    queries = stored(queries.withColumn("worst", F.lit(None).cast("double")), "queries")
    chunks = max(1, -(-queries.count() // QUERIES))
    first = stored(_best(_round(index, queries, boxes, chunks, True, k), k), "hits")
    worst = first.where(F.col("rank") == k).select("item", F.col("score").alias("worst"))
    rest = queries.drop("worst").join(worst, "item", "left").select(*queries.columns)
    others = _round(index, rest, boxes, chunks, False, k)
    return _best(first.drop("rank").unionByName(others), k)


def nearest(vectors: DataFrame, is_query: Column, k: int = NEAREST) -> DataFrame:
    """The ``k`` nearest other rows of each row for which ``is_query`` holds: query_id, rank, vec_id, score."""
    rows = stored(usable(vectors), "vectors")
    items = stored(distinct_items(rows, k + 1), "items")
    queries = rows.where(is_query).select(F.col("vec_id").alias("query_id"), "item")
    asked = queries.select("item").distinct()
    found = None
    # a length has a search of its own
    for (dim,) in items.select(F.size("embedding")).distinct().orderBy(F.size("embedding")).collect():
        part = _search(items.where(F.size("embedding") == dim), asked, dim, k + 1)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    hits = found.groupBy("item").agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("hits"))
    answered = join_skewed(queries, stored(hits, "answers"), "item", "inner", hot_keys(queries, "item"))
    others = F.slice(F.filter("hits", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    listed = answered.select("query_id", F.posexplode(others).alias("place", "hit"))
    return listed.select("query_id", (F.col("place") + 1).alias("rank"), "hit.vec_id", "hit.score")
