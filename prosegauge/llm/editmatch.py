"""Near copies by edit distance: bands of sampled fingerprint digits, then the exact distance.

``editprint`` maps edit distance to Hamming distance between fingerprints of ``SLOTS`` digits. Here ``BANDS`` bands
of ``WIDTH`` digits each, drawn once at random, and a window of lengths are the buckets of a text; texts that share a bucket
are compared by exact edit distance. Texts whose fingerprints have a share p of equal digits meet with probability
about 1 - (1 - p^WIDTH)^BANDS: 0.99 at p = 0.6, 0.87 at 0.5, 0.48 at 0.4. A walk that stays out of step after an early edit
leaves a pair apart; the README has measured shares. Two texts that meet are linked if at most ``edits`` insertions, deletions and
replacements of code points turn one into the other, and these are at most the part ``share`` of the longer one.
A window has ``WINDOW`` times ``edits`` lengths; texts less than ``edits`` below its end are in the next one too.

Equal texts (by SHA-256) are one item, and only items are banded and compared. A bucket of many
items is settled by pivots and blocks (see ``buckets``), so components are those of all its pairs without forming these. Edit
distance is found from the furthest places on each diagonal, in time of the length and the square of the edits;
a block holds two times ``buckets.BLOCK`` whole texts.

Defined results: a null text is empty; empty texts link with each other only. Rows with a null id belong to a
component as others do; its id is the smallest that is not null, and null if all are. Of rows that repeat the
smallest id one is kept. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosegauge.llm import editprint
from prosegauge.llm.buckets import linked_components, shared_buckets
from prosegauge.llm.workers import trimmed
from prosegauge.operators.join import hot_keys, join_skewed
from prosegauge.session import stored

BANDS, WIDTH, WINDOW = 64, 5, 16
EDITS, SHARE = 64, 0.1


@functools.lru_cache(maxsize=1)
def band_slots() -> np.ndarray:
    """The slots of each band, a row of ``WIDTH`` different numbers."""
    rng = np.random.default_rng(editprint.SEED + 2)
    return np.array([rng.permutation(editprint.SLOTS)[:WIDTH] for _ in range(BANDS)])


def buckets_of(texts: list[str], edits: int = EDITS) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``texts`` and buckets, numbers that hold the window, the band and its digits."""
    digits = editprint.embed(texts)
    values = digits[:, band_slots()].astype(np.int64) @ (16 ** np.arange(WIDTH, dtype=np.int64))
    values += np.arange(BANDS, dtype=np.int64) << 4 * WIDTH
    lengths, span = np.array([len(x) for x in texts], np.int64), WINDOW * max(edits, 1)
    windows = lengths // span
    beyond = np.flatnonzero((lengths + edits) // span > windows)
    places = np.concatenate([np.arange(len(texts)), beyond])
    found = values[places] + (np.concatenate([windows, windows[beyond] + 1])[:, None] << 32)
    return np.repeat(places, BANDS), found.ravel()


@trimmed
def _bands(batches: Iterator[pd.DataFrame], edits: int) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for at in range(0, len(batch), editprint.TEXTS):
            part = batch.iloc[at : at + editprint.TEXTS]
            places, buckets = buckets_of(part["elements"].tolist(), edits)
            yield pd.DataFrame({"bucket": buckets, "item": part["item"].to_numpy()[places]})


def _common(a: str, b: str, i: int, j: int) -> int:
    """How far ``a`` from ``i`` on equals ``b`` from ``j`` on: the place in ``a`` where it ends."""
    most, step, growing = min(len(a) - i, len(b) - j), 16, True
    end = i + most
    while i < end:
        step = min(step, end - i)
        if a[i : i + step] == b[j : j + step]:
            i, j = i + step, j + step
            step = step * 2 if growing else step
        elif step == 1:
            break
        else:
            growing, step = False, step // 2
    return i


def distance(a: str, b: str, most: int) -> int | None:
    """Edit distance if it is ``most`` or less, else None."""
    goal = len(a) - len(b)
    if abs(goal) > most:
        return None
    reach = {0: _common(a, b, 0, 0)}
    for edits in range(most + 1):
        if reach.get(goal, -1) == len(a):
            return edits
        further = {}
        for k in range(-edits - 1, edits + 2):
            # from the diagonals beside it by one deletion or insertion, on itself by a replacement
            best = max(reach.get(k - 1, -2) + 1, reach.get(k, -2) + 1, reach.get(k + 1, -2))
            best = min(best, len(a), len(b) + k)
            if best >= max(0, k):
                further[k] = _common(a, b, best, best - k)
        reach = further
    return None


def linked(a: str, b: str, edits: int = EDITS, share: float = SHARE) -> bool:
    return distance(a, b, min(edits, int(share * max(len(a), len(b))))) is not None


def _compare(group: pd.DataFrame, edits: int, share: float) -> pd.DataFrame:
    """Links of a block that connect what no link before connects."""
    parents: dict[int, int] = {}

    def root(x: int) -> int:
        while (above := parents.setdefault(x, x)) != x:
            parents[x] = x = parents[above]
        return x

    asks = group["asks"].to_numpy(bool)
    others, links = group[~asks], []
    for item, text in zip(group["item"][asks].tolist(), group["elements"][asks], strict=True):
        for other, its_text in zip(others["item"].tolist(), others["elements"], strict=True):
            if root(item) != root(other) and linked(text, its_text, edits, share):
                parents[root(item)] = root(other)
                links.append((item, other))
    return pd.DataFrame(links, columns=["a", "b"], dtype="int64")


def near_copies(docs: DataFrame, edits: int = EDITS, share: float = SHARE) -> DataFrame:
    """The component of each row of ``docs``: doc_id, component_id, kept (true for one row of each component)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("elements"))
    numbered = rows.withColumn("digest", F.sha2("elements", 256)).withColumn("row", F.monotonically_increasing_id())
    # numbers hold only for what is written with them
    numbered = stored(numbered, "edit-rows")
    keys = numbered.select("doc_id", "digest", "row")
    firsts = stored(keys.groupBy("digest").agg(F.min("row").alias("item")), "edit-items")
    texts = numbered.select(F.col("row").alias("item"), "elements").join(firsts.select("item"), "item", "left_semi")
    texts = stored(texts, "edit-texts")
    banded = stored(texts.mapInPandas(functools.partial(_bands, edits=edits), "bucket long, item long"), "edit-bands")
    shared = stored(shared_buckets(banded), "edit-shared")

    @F.pandas_udf("boolean")
    def near(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([linked(x, y, edits, share) for x, y in zip(a, b, strict=True)], dtype=bool)

    found = linked_components(shared, texts, near=near, compare=functools.partial(_compare, edits=edits, share=share))
    classes = firsts.join(found.withColumnRenamed("node", "item"), "item", "left")
    classes = classes.select("digest", F.coalesce("component", "item").alias("class"))
    placed = stored(join_skewed(keys, classes, "digest", "inner", hot_keys(keys, "digest")), "edit-classes")
    least = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    heads = placed.groupBy("class").agg(F.min(least).alias("head"))
    both = join_skewed(placed, heads, "class", "inner", hot_keys(placed, "class"))
    return both.select("doc_id", F.col("head.doc_id").alias("component_id"), (F.col("row") == F.col("head.row")).alias("kept"))
