"""Near duplicates among embeddings of one label: NN-descent, then all links at or above a cosine.

1. Equal vectors of a label are one node. A forest of random planes puts nodes into cells, cells are
   cut into blocks of about ``BLOCK`` nodes, and every block is compared within itself. A node
   keeps its ``K`` nearest, whatever their cosine.
2. Rounds of NN-descent: neighbours of a common node, in either direction, are compared with each
   other, until a round changes next to nothing in the lists.
3. A node whose list holds nothing but links is saturated, it may have more. A link that is in neither
   list is then one between saturated nodes, so these are compared with each other, across components
   too, in blocks of ``BLOCK`` by ``BLOCK`` of one component each. Only blocks whose centres are further
   apart than their radii and the angle of a link allow are left out. Blocks give counts, and one link
   between their components, not pairs.
4. The audit compares the ids divisible by ``EVERY`` with all vectors. While they have less than ``RECALL`` of
   their links, another forest is planted and the lists descend again.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and
vectors without label, link with nothing: no links, a component of their own. Vectors of unlike
lengths are not compared. Every row of a repeated vector or id counts as a vector of its own. A null
id is no smaller than any other. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosegauge.llm.components import components
from prosegauge.session import stored

COSINE = 0.93
K = 10
TREES, BITS, BLOCK = 10, 30, 128
SEED = 11
#: A round of NN-descent that changes less than this share of the lists is the last.
SETTLED = 0.01
EVERY, RECALL = 100, 0.99
#: Numbers of all audited vectors, and centres of blocks, that are held at a time; vectors compared with the former.
HELD, CENTRES, ROWS = 1 << 21, 512, 256
PAIRS = "node long, other long, cosine double"


def _usable() -> Column:
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col("label").isNotNull() & (F.size("embedding") > 0) & good & F.exists("embedding", lambda x: x != 0)


def keyed(vectors: DataFrame) -> DataFrame:
    """vec_id, label, embedding, and the key of equal vectors of a label; null key: links with nothing."""
    rows = vectors.select("vec_id", "label", "embedding")
    return rows.withColumn("node", F.when(_usable(), F.xxhash64("label", "embedding")))


def distinct_nodes(rows: DataFrame) -> DataFrame:
    """A row per key: node, label, dim, embedding, copies, first_id."""
    return (
        rows.where("node is not null")
        .groupBy("node")
        .agg(
            F.first("label").alias("label"),
            F.first("embedding").alias("embedding"),
            F.count("*").alias("copies"),
            F.min("vec_id").alias("first_id"),
        )
        .withColumn("dim", F.size("embedding"))
    )


def unit_rows(embeddings: pd.Series) -> np.ndarray:
    """Vectors of equal length as rows of length 1, in double precision."""
    rows = np.stack([np.asarray(x, np.float64) for x in embeddings])
    rows /= np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows**2).sum(axis=1, keepdims=True))


def _codes(batches: Iterator[pd.DataFrame], forest: int) -> Iterator[pd.DataFrame]:
    """On which side of each plane of each tree a vector is."""
    for batch in batches:
        for dim, part in batch.groupby("dim"):
            planes = np.random.default_rng([SEED, int(dim), forest]).standard_normal((int(dim), TREES * BITS))
            sides = (unit_rows(part["embedding"]) @ planes > 0).reshape(len(part), TREES, BITS)
            codes = sides @ (1 << np.arange(BITS, dtype=np.int64)[::-1])
            yield pd.DataFrame({"node": part["node"], "codes": list(codes)})


def _compare_block(block: pd.DataFrame) -> pd.DataFrame:
    """Each node's nearest within the block."""
    nodes, unit = block["node"].to_numpy(), unit_rows(block["embedding"])
    cosines = unit @ unit.T
    np.fill_diagonal(cosines, -2)
    n = min(K, len(nodes) - 1)
    if n < 1:
        return pd.DataFrame({"node": [], "other": [], "cosine": []})
    nearest = np.argpartition(-cosines, n - 1, axis=1)[:, :n]
    found = np.take_along_axis(cosines, nearest, axis=1)
    return pd.DataFrame({"node": np.repeat(nodes, n), "other": nodes[nearest].ravel(), "cosine": found.ravel()})


def best_lists(pairs: DataFrame, k: int = K) -> DataFrame:
    """The ``k`` nearest of each node among pairs in both directions, the rank of each as ``place``."""
    flipped = pairs.select(F.col("other").alias("node"), F.col("node").alias("other"), "cosine")
    every = pairs.unionByName(flipped).groupBy("node", "other").agg(F.max("cosine").alias("cosine"))
    return every.selectExpr(
        "*", "row_number() over (partition by node order by cosine desc, other) as place"
    ).where(F.col("place") <= k)


def forest_lists(nodes: DataFrame, forest: int = 0) -> DataFrame:
    """First neighbour lists, from blocks of nearby nodes; every number of a ``forest`` has its own planes."""
    coded = nodes.select("node", "dim", "embedding").mapInPandas(
        lambda batches: _codes(batches, forest), "node long, codes array<long>"
    )
    sizes = nodes.groupBy("label", "dim").agg(F.count("*").alias("n"))
    bits = F.least(F.lit(BITS), F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / BLOCK)))).cast("int")
    depth = sizes.select("label", "dim", bits.alias("bits"))
    placed = (
        nodes.select("node", "label", "dim")
        .join(depth, ["label", "dim"])
        .join(coded, "node")
        .select("node", "label", "dim", "bits", F.posexplode("codes").alias("tree", "code"))
        .withColumn("cell", F.expr(f"shiftright(code, {BITS} - bits)"))
    )
    cell = ["label", "dim", "tree", "cell"]
    crowded = placed.groupBy(cell).agg(F.ceil(F.count("*") / BLOCK).alias("blocks")).where("blocks > 1")
    blocks = placed.join(crowded, cell, "left").withColumn(
        "block", F.pmod(F.xxhash64("node", "tree", F.lit(forest)), F.coalesce("blocks", F.lit(1)))
    )
    grouped = blocks.select(*cell, "block", "node").join(nodes.select("node", "embedding"), "node")
    return best_lists(grouped.groupBy(*cell, "block").applyInPandas(_compare_block, PAIRS))


def _join_locally(group: pd.DataFrame) -> pd.DataFrame:
    """Pairs of a common node's neighbours that are nearer than the furthest in a list of theirs."""
    nodes, unit = group["other"].to_numpy(), unit_rows(group["embedding"])
    cosines = unit @ unit.T
    np.fill_diagonal(cosines, -2)
    one, other = np.nonzero((cosines > group["furthest"].to_numpy()[:, None]) & (cosines > -2))
    return pd.DataFrame({"node": nodes[one], "other": nodes[other], "cosine": cosines[one, other]})


def descend(nodes: DataFrame, lists: DataFrame) -> DataFrame:
    """Neighbour lists after rounds of NN-descent."""
    lists = stored(lists, "lists")
    while True:
        around = best_lists(lists.drop("place"), 2 * K).select("node", "other")
        furthest = lists.groupBy("node").agg(F.when(F.count("*") >= K, F.min("cosine")).otherwise(-2.0).alias("furthest"))
        known = nodes.select("node", "embedding").join(furthest, "node").withColumnRenamed("node", "other")
        nearer = around.join(known, "other").groupBy("node").applyInPandas(_join_locally, PAIRS)
        better = stored(best_lists(lists.drop("place").unionByName(nearer)), "lists")
        changed = better.join(lists, ["node", "other"], "left_anti").count()
        lists = better
        if changed <= SETTLED * lists.count():
            return lists


def _summary(group: pd.DataFrame) -> pd.DataFrame:
    """The centre of a block, and the angle to its furthest vector."""
    unit = unit_rows(group["embedding"])
    centre = unit.mean(axis=0)
    length = np.sqrt((centre**2).sum())
    centre = centre / length if length > 1e-9 else unit[0]
    radius = float(np.arccos(np.clip(unit @ centre, -1, 1)).max())
    first = group.iloc[0]
    return pd.DataFrame(
        {"label": [str(first["label"])], "dim": [first["dim"]], "block": [first["block"]], "centre": [centre], "radius": [radius]}
    )


def _near_blocks(group: pd.DataFrame, angle: float) -> pd.DataFrame:
    """Pairs of blocks, each once, that may have vectors within ``angle`` of each other."""
    left, right = (group[group["asks"] == k] for k in (True, False))
    if left.empty or right.empty:
        return pd.DataFrame({"one": [], "two": []}, dtype="int64")
    centres, others = np.stack(left["centre"].tolist()), np.stack(right["centre"].tolist())
    reach = left["radius"].to_numpy()[:, None] + right["radius"].to_numpy()[None, :] + angle + 1e-6
    one, two = left["block"].to_numpy(), right["block"].to_numpy()
    a, b = np.nonzero((np.arccos(np.clip(centres @ others.T, -1, 1)) <= reach) & (one[:, None] <= two[None, :]))
    return pd.DataFrame({"one": one[a], "two": two[b]})


def _count_blocks(group: pd.DataFrame, cosine: float) -> pd.DataFrame:
    """How many vectors of one block each node of another links with, and a link between their components."""
    first = (group["block"] == group["one"]).to_numpy()
    unit, nodes, copies = unit_rows(group["embedding"]), group["node"].to_numpy(), group["copies"].to_numpy()
    if first.all():
        linked = unit @ unit.T >= cosine
        np.fill_diagonal(linked, False)
        return pd.DataFrame({"node": nodes, "n": linked @ copies, "other": pd.array([None] * len(nodes), "Int64")})
    linked = unit[first] @ unit[~first].T >= cosine
    found = np.concatenate([linked @ copies[~first], linked.T @ copies[first]])
    others = pd.array([None] * len(nodes), "Int64")
    component = group["component"].to_numpy()
    if linked.any() and component[first][0] != component[~first][0]:
        row, column = (x[0] for x in np.nonzero(linked))
        others[int(row)] = int(nodes[~first][column])
    rows = pd.DataFrame({"node": np.concatenate([nodes[first], nodes[~first]]), "n": found, "other": others})
    return rows[rows["n"] > 0]


def saturated_links(nodes: DataFrame, members: DataFrame, saturated: DataFrame, cosine: float) -> DataFrame:
    """Links among saturated nodes: node, n (vectors in one pair of blocks), other (a link that joins components)."""
    asking = nodes.join(saturated, "node", "left_semi").join(members.select("node", "component"), "node")
    cell = ["label", "dim", "component"]
    sizes = asking.groupBy(cell).agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    slot = F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks"))
    placed = stored(
        asking.join(sizes, cell)
        .withColumn("block", F.xxhash64(*cell, slot))
        .select("label", "dim", "component", "block", "node", "copies", "embedding"),
        "blocks",
    )
    summaries = stored(
        placed.groupBy("block").applyInPandas(
            _summary, "label string, dim int, block long, centre array<double>, radius double"
        ),
        "summaries",
    )
    grid = summaries.groupBy("label", "dim").agg(F.ceil(F.count("*") / CENTRES).cast("int").alias("parts"))
    rows = summaries.join(grid, ["label", "dim"])
    part = F.pmod(F.xxhash64("block", F.lit(4)), F.col("parts")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    asked = rows.select("label", "dim", "block", "centre", "radius", F.lit(False).alias("asks"), part.alias("theirs"), every.alias("ours"))
    asks = rows.select("label", "dim", "block", "centre", "radius", F.lit(True).alias("asks"), every.alias("theirs"), part.alias("ours"))
    angle = float(np.arccos(cosine))
    pairs = asked.unionByName(asks).groupBy("label", "dim", "ours", "theirs").applyInPandas(
        lambda group: _near_blocks(group, angle), "one long, two long"
    )
    sides = pairs.select("one", "two", F.explode(F.array_distinct(F.array("one", "two"))).alias("block"))
    return sides.join(placed.drop("label", "dim"), "block").groupBy("one", "two").applyInPandas(
        lambda group: _count_blocks(group, cosine), "node long, n long, other long"
    )


def counted_links(nodes: DataFrame, lists: DataFrame, cosine: float) -> tuple[DataFrame, DataFrame]:
    """Vectors of other nodes that each node links with (node, n), and components (node, component)."""
    links = stored(lists.where(F.col("cosine") >= cosine), "links")
    saturated = stored(links.groupBy("node").count().where(F.col("count") >= K).select("node"), "saturated")
    members = stored(components(links.select(F.col("node").alias("a"), F.col("other").alias("b"))), "members")
    among = stored(saturated_links(nodes, members, saturated, cosine), "among-saturated")
    across = among.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b"))
    if not across.isEmpty():
        stars = members.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
        members = stored(components(stars.unionByName(across)), "members")
    # lists are cut at K, but a link stands in the list of either end unless both are saturated
    flipped = links.select(F.col("other").alias("node"), F.col("node").alias("other"))
    pairs = links.select("node", "other").unionByName(flipped).distinct()
    full = saturated.withColumn("full", F.lit(True))
    listed = (
        pairs.join(full, "node", "left")
        .join(full.withColumnsRenamed({"node": "other", "full": "other_full"}), "other", "left")
        .where("full is null or other_full is null")
        .join(nodes.select(F.col("node").alias("other"), "copies"), "other")
        .select("node", F.col("copies").alias("n"))
    )
    counts = listed.unionByName(among.select("node", "n")).groupBy("node").agg(F.sum("n").alias("n"))
    return stored(counts, "counts"), members


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """A row per row of ``vectors``: vec_id, n_links, component_id, kept."""
    rows = stored(keyed(vectors), "vectors")
    nodes = stored(distinct_nodes(rows), "nodes")
    asked = rows.where(F.col("node").isNotNull() & (F.col("vec_id") % EVERY == 0)).select("node").distinct()
    true = stored(exact_counts(nodes, asked, cosine), "audit")
    forest, lists = 0, forest_lists(nodes)
    while True:
        lists = descend(nodes, lists)
        counts, members = counted_links(nodes, lists, cosine)
        if _recall(true, counts) >= RECALL:
            break
        forest += 1
        lists = best_lists(lists.drop("place").unionByName(forest_lists(nodes, forest).drop("place")))
    placed = nodes.select("node", "copies", "first_id").join(members, "node", "left").join(counts, "node", "left")
    placed = placed.withColumn("component", F.coalesce("component", "node"))
    smallest = placed.groupBy("component").agg(F.min("first_id").alias("component_id"))
    found = placed.join(smallest, "component").select(
        "node", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id"
    )
    lone = rows.where("node is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    joined = rows.where("node is not null").select("vec_id", "node").join(found, "node").drop("node")
    return joined.unionByName(lone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _exact(batches: Iterator[pd.DataFrame], queries: pd.DataFrame, cosine: float) -> Iterator[pd.DataFrame]:
    """With how many vectors of a batch each query links, a few rows at a time."""
    by_label = {k: (part["node"].to_numpy(), unit_rows(part["embedding"])) for k, part in queries.groupby(["label", "dim"])}
    for batch in batches:
        for key, part in batch.groupby(["label", "dim"]):
            if key not in by_label:
                continue
            nodes, unit = by_label[key]
            found = np.zeros(len(nodes), np.int64)
            for at in range(0, len(part), ROWS):
                some = part.iloc[at : at + ROWS]
                linked = unit @ unit_rows(some["embedding"]).T >= cosine
                linked &= nodes[:, None] != some["node"].to_numpy()[None, :]
                found += linked @ some["copies"].to_numpy()
            yield pd.DataFrame({"node": nodes[found > 0], "n": found[found > 0]})


def exact_counts(nodes: DataFrame, asked: DataFrame, cosine: float) -> DataFrame:
    """Vectors of all other nodes that each of the nodes ``asked`` links with: node, n; none without links.

    Every task gets the nodes asked, as many as are held at a time.
    """
    queries = nodes.join(asked, "node", "left_semi").select("node", "label", "dim", "embedding")
    passes = max(1, -(-(queries.agg(F.sum("dim")).first()[0] or 0) // HELD))
    found = None
    for number in range(passes):
        held = queries.where(F.pmod(F.xxhash64("node", F.lit(5)), F.lit(passes)) == number).toPandas()
        part = nodes.select("node", "label", "dim", "embedding", "copies").mapInPandas(
            lambda batches, held=held: _exact(batches, held, cosine), "node long, n long"
        )
        part = stored(part.groupBy("node").agg(F.sum("n").alias("n")), "audit")
        found = part if found is None else found.unionByName(part)
    return found


def _recall(true: DataFrame, counts: DataFrame) -> float:
    both = true.join(counts.withColumnRenamed("n", "found"), "node", "left")
    total, hit = both.agg(F.sum("n"), F.sum(F.least("n", F.coalesce("found", F.lit(0))))).first()
    return 1.0 if not total else hit / total


def audit(vectors: DataFrame, result: DataFrame, cosine: float = COSINE, every: int = EVERY) -> float:
    """The share of true links of the ids divisible by ``every`` that ``result`` counts."""
    rows = stored(keyed(vectors).where("node is not null"), "vectors")
    nodes = stored(distinct_nodes(rows), "nodes")
    asked = rows.where(F.col("vec_id") % every == 0).select("vec_id", "node")
    exact = exact_counts(nodes, asked.select("node").distinct(), cosine)
    true = asked.join(nodes.select("node", "copies"), "node").join(exact, "node", "left").select(
        F.col("vec_id").alias("node"), (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n")
    )
    return _recall(true, result.select(F.col("vec_id").alias("node"), F.col("n_links").alias("n")))
