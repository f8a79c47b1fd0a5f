"""Ranked lexical search without an index: one Aho-Corasick automaton of all item terms scans the texts.

1. The terms of all items go into one automaton, each between two boundary marks. Texts have every run of
   other characters as boundary marks, so a match is a whole term; matches overlap in their marks. A term's
   output is its number, which maps to its items.
2. One scan of each text gives its number of terms and the frequency of every item term in it. Corpus
   figures are sums over the rows of this scan: documents, terms, and documents holding each term.
3. The rows of the scan are scored for all items of their terms, and each task keeps the ``RANKS`` best documents of every
   item before the shuffle.

The automaton and the item lists are broadcast. Their size is checked: items are dealt into as many lots as it takes for
one to have about ``LOT`` bytes of terms, and texts are scanned once per lot (once for all items at usual sizes).
One item's terms are never split, so the longest item bounds a lot too.

Defined results: null texts and texts without terms count as no documents; items without terms, or with none that scores, get
no rows. Rows of one item id, null included, are one item with the terms of all. A repeated or null doc_id is a
document of its own; among equal scores ids ascend, null last, and every rank is given once. Empty tables give no rows.
Long texts are scanned in pieces of ``PIECE`` bytes cut at boundaries. Other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from prosegauge.session import stored

RANKS = 10
LOT, PIECE = 1 << 24, 1 << 20
#: Cells of a table of documents by terms that are held at a time.
CELLS = 1 << 21
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes of UTF-8: letters fold, all other ASCII but digits is a boundary, and what is above ASCII stays.
FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)
SCAN = "doc_id long, n long, terms array<int>, counts array<long>"
SCORES = "item int, doc_id long, score long"


def item_terms(items: DataFrame) -> DataFrame:
    """The distinct terms of each item: item_id, term."""
    found = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(TERM), F.lit(0))
    return items.select("item_id", F.explode(found).alias("term")).distinct()


def automaton(terms: list[str]) -> ahocorasick.Automaton:
    """Terms between boundaries, with their place in the list; over the bytes of UTF-8, as characters."""
    found = ahocorasick.Automaton()
    for place, term in enumerate(terms):
        found.add_word(f" {term} ".encode().decode("latin-1"), place)
    if terms:
        found.make_automaton()
    return found


def pieces(text: str) -> Iterator[bytes]:
    """The folded bytes of a text between boundaries, cut at boundaries after ``PIECE`` bytes."""
    folded = text.encode("utf-8", "replace").translate(FOLD)
    at = 0
    while at < len(folded):
        end = folded.find(b" ", at + PIECE)
        end = len(folded) if end < 0 else end
        yield b" %b " % folded[at:end]
        at = end + 1


def _n_terms(piece: bytes) -> int:
    """Starts of terms: a boundary before something else."""
    marks = np.frombuffer(piece, np.uint8) == 32
    return int(np.count_nonzero(marks[:-1] & ~marks[1:]))


def _scan(batches: Iterator[pd.DataFrame], terms: list[str]) -> Iterator[pd.DataFrame]:
    found = automaton(terms)
    place = itemgetter(1)
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch["doc_id"].astype("Int64"), batch["text"], strict=True):
            n, counts = 0, Counter()
            for piece in pieces(text if isinstance(text, str) else ""):
                n += _n_terms(piece)
                if terms:
                    counts.update(map(place, found.iter(piece.decode("latin-1"))))
            if n:
                rows.append((doc_id, n, list(counts.keys()), list(counts.values())))
        yield pd.DataFrame(rows, columns=["doc_id", "n", "terms", "counts"]).astype({"doc_id": "Int64", "n": "int64"})


def scan(docs: DataFrame, terms: list[str]) -> DataFrame:
    """A row per document with a term: doc_id, n, and the places and counts of those of ``terms`` in it."""
    rows = docs.select(F.col("doc_id").cast("long"), "text").where("text is not null")
    return rows.mapInPandas(lambda batches: _scan(batches, terms), SCAN)


def weights(n_docs: int, holding: np.ndarray) -> np.ndarray:
    """The weight of terms that so many of all documents hold."""
    return np.floor(1000 * np.log((2.0 * n_docs + 2) / (2.0 * holding + 1))).astype(np.int64)


class _Items:
    """Which items have a term: lists of items one after the other, by term."""

    def __init__(self, pairs: pd.DataFrame, n_terms: int, n_items: int) -> None:
        ordered = pairs.sort_values(["term", "item"])
        self.items = ordered["item"].to_numpy(np.int64)
        self.starts = np.searchsorted(ordered["term"].to_numpy(), np.arange(n_terms + 1))
        self.n_items = n_items

    def scores(self, doc: np.ndarray, term: np.ndarray, gain: np.ndarray, n_docs: int) -> np.ndarray:
        """Sums of gains per document and item, as 64-bit integers."""
        sizes = self.starts[term + 1] - self.starts[term]
        offsets = np.repeat(self.starts[term] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        cells = np.repeat(doc * self.n_items, sizes) + self.items[offsets]
        gains, total = np.repeat(gain, sizes), np.zeros(n_docs * self.n_items, np.int64)
        # doubles are exact below 2**53, so high and low halves are summed apart
        for shift, part in ((0, gains & 0xFFFFFF), (24, gains >> 24)):
            total += np.bincount(cells, part, len(total)).astype(np.int64) << shift
        return total.reshape(n_docs, self.n_items)


def _best(frame: pd.DataFrame, ranks: int) -> pd.DataFrame:
    ordered = frame.sort_values(["item", "score", "doc_id"], ascending=[True, False, True], na_position="last")
    return ordered.groupby("item", sort=False).head(ranks)


def _score(batches: Iterator[pd.DataFrame], items: _Items, weight: np.ndarray, n_docs: int, n_terms: int, ranks: int):
    best, step = None, max(1, CELLS // max(1, items.n_items))
    for batch in batches:
        for at in range(0, len(batch), step):
            part = batch.iloc[at : at + step]
            sizes = part["terms"].map(len).to_numpy()
            if not sizes.sum():
                continue
            term = np.concatenate(part["terms"].to_numpy()).astype(np.int64)
            tf = np.concatenate(part["counts"].to_numpy()).astype(np.int64)
            m = np.array([10 + 90 * int(n) * n_docs // n_terms for n in part["n"]], np.int64)
            gain = weight[term] * (1_000_000_000 * tf // (1000 * tf + 8 * np.repeat(m, sizes)))
            total = items.scores(np.repeat(np.arange(len(part)), sizes), term, gain, len(part))
            doc, item = np.nonzero(total)
            found = pd.DataFrame({"item": item, "doc_id": part["doc_id"].astype("Int64").to_numpy()[doc], "score": total[doc, item]})
            found["doc_id"] = found["doc_id"].astype("Int64")
            best = _best(found if best is None else pd.concat([best, found]), ranks)
    if best is not None:
        yield best.astype({"item": "int32", "score": "int64"})


def _search_lot(docs: DataFrame, pairs: DataFrame, ranks: int) -> DataFrame:
    """The best documents of the items of a lot, whose terms fit in memory."""
    spark: SparkSession = docs.sparkSession
    held = pairs.toPandas()
    names = held["item_id"].astype("Int64").drop_duplicates().sort_values(na_position="last").reset_index(drop=True)
    terms = sorted(held["term"].unique())
    numbered = pd.DataFrame(
        {
            "item": pd.Categorical(held["item_id"].astype("Int64").fillna(-1 << 63), names.fillna(-1 << 63)).codes,
            "term": np.searchsorted(terms, held["term"].to_numpy()) if terms else [],
        }
    )
    scanned = stored(scan(docs, terms), "scan")
    n_docs, n_terms = scanned.agg(F.count("*"), F.sum("n")).first()
    counts = scanned.select(F.explode("terms").alias("term")).groupBy("term").count().toPandas()
    holding = np.zeros(len(terms), np.int64)
    holding[counts["term"].to_numpy(np.int64)] = counts["count"].to_numpy()
    items, weight = _Items(numbered, len(terms), len(names)), weights(n_docs, holding)
    found = scanned.where(F.size("terms") > 0).mapInPandas(
        lambda batches: _score(batches, items, weight, n_docs, n_terms, ranks), SCORES
    )
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= ranks)
    named = spark.createDataFrame(
        [(i, None if pd.isna(x) else int(x)) for i, x in enumerate(names)], "item int, item_id long"
    )
    return ranked.join(F.broadcast(named), "item").select("item_id", "rank", "doc_id", "score")


def ranked_search(docs: DataFrame, items: DataFrame, ranks: int = RANKS, lot: int = LOT) -> DataFrame:
    """The ``ranks`` documents (doc_id, text) with the highest score for each item (item_id, text): item_id, rank, doc_id, score."""
    pairs = stored(item_terms(items.select(F.col("item_id").cast("long"), "text")), "item-terms")
    size = pairs.agg(F.sum(F.octet_length("term") + 16)).first()[0]
    if not size:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    lots, found = -(-size // lot), None
    for number in range(lots):
        chosen = pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(lots)) == number)
        if lots > 1 and chosen.isEmpty():
            continue
        part = _search_lot(docs, chosen, ranks)
        found = part if found is None else found.unionByName(part)
    return found
