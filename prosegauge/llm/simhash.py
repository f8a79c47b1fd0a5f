"""SimHash fingerprints of word shingles, and near duplicates by Hamming distance.

Fingerprints are mapped to the number of set bits in each of 32 two-bit segments, packed in one
long. The Manhattan distance of two such vectors is never more than the Hamming distance, and
vectors at most 2 apart have a grid cell in common among those at most 1 from each. So every
distinct fingerprint is put into its own and the adjacent cells (65 at most), fingerprints that
share a cell are joined, and the Hamming distance decides. Equal fingerprints are one node of the
graph, and a fingerprint has no more than 2,080 others within 2 bits, however many documents
share it.

Defined results: null and empty texts have fingerprint zero and link like any other; a row with a
null id belongs to a component, whose id is the smallest that is not null; repeated rows are rows
of one component. An empty table gives no rows. Other columns are not read, and kept by
``keep_one``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosegauge.llm.components import components
from prosegauge.llm.workers import trimmed
from prosegauge.session import stored

SEED = 42
SEGMENTS = 32
MAX_BITS = 2
#: Bytes of a text, and shingles of several, that are worked on at a time.
BLOCK, ROWS = 1 << 20, 1 << 15
SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _word_blocks(text: bytes) -> Iterator[list[bytes]]:
    at = 0
    while at < len(text):
        space = SPACE.search(text, at + BLOCK)
        end = space.start() if space else len(text)
        yield text[at:end].split()
        at = end


def shingle_hashes(text: str | None, words: int = 3) -> Iterator[list[int]]:
    """Blocks of XXH64 hashes of the shingles of ``words`` words; of all words if there are fewer."""
    digest, carry, whole = xxhash.xxh64_intdigest, [], True
    for block in _word_blocks((text or "").encode().lower()):
        carry += block
        if len(carry) < words:
            continue
        whole = False
        yield [digest(b" ".join(x), SEED) for x in zip(*(carry[i:] for i in range(words)), strict=False)]
        carry = carry[len(carry) - words + 1 :]
    if whole and carry:
        yield [digest(b" ".join(carry), SEED)]


def _set_bits(hashes: list[int], owners: list[int], n: int) -> np.ndarray:
    """How often each bit is set in the hashes of each owner; owners come in order."""
    counts = np.zeros((n, 64), np.int64)
    if hashes:
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        starts = np.flatnonzero(np.diff(owners, prepend=-1))
        counts[np.asarray(owners)[starts]] = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
    return counts


def _fingerprints(texts: list, words: int = 3) -> np.ndarray:
    counts, sizes = np.zeros((len(texts), 64), np.int64), np.zeros(len(texts), np.int64)
    hashes: list[int] = []
    owners: list[int] = []
    for i, text in enumerate(texts):
        for block in shingle_hashes(text, words):
            hashes += block
            owners += [i] * len(block)
            sizes[i] += len(block)
            if len(hashes) >= ROWS:
                counts += _set_bits(hashes, owners, len(texts))
                hashes, owners = [], []
    counts += _set_bits(hashes, owners, len(texts))
    majority = (2 * counts > sizes[:, None]).astype(np.uint8)
    return np.packbits(majority, axis=1, bitorder="little").view("<i8")[:, 0]


@trimmed
def _fingerprint_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for at in range(0, len(batch), 512):
            part = batch.iloc[at : at + 512]
            found = _fingerprints(part["text"].where(part["text"].notna(), None).tolist())
            yield part.drop(columns="text").astype({"doc_id": "Int64"}).assign(fingerprint=found)


def fingerprints(docs: DataFrame) -> DataFrame:
    """The 64-bit fingerprint of each whole text, as a long: doc_id, fingerprint, and row if it is there."""
    keys = [c for c in ("doc_id", "row") if c in docs.columns]
    schema = ", ".join(f"{c} long" for c in (*keys, "fingerprint"))
    return docs.select(*(F.col(c).cast("long") for c in keys), "text").mapInPandas(_fingerprint_batches, schema)


def segment_counts(fingerprint: Column) -> Column:
    """Set bits of each two-bit segment, in two bits each."""
    high, odd = F.shiftrightunsigned(fingerprint, 1), F.lit(0x5555555555555555)
    one = fingerprint.bitwiseXOR(high).bitwiseAND(odd)
    two = fingerprint.bitwiseAND(high).bitwiseAND(odd)
    return one.bitwiseOR(F.shiftleft(two, 1))


def _cells(cell: Column) -> Column:
    """The cell itself and those at distance 1; null where a count would leave 0 to 2."""
    around = [cell]
    for k in range(SEGMENTS):
        count = F.shiftrightunsigned(cell, 2 * k).bitwiseAND(F.lit(3))
        # 0 and 1 differ in the lower bit, 1 and 2 in both
        lower, both = (F.lit(int(np.uint64(x << 2 * k).astype(np.int64))) for x in (1, 3))
        around += [F.when(count < 2, cell.bitwiseXOR(lower)), F.when(count > 0, cell.bitwiseXOR(both))]
    return F.array(*around)


def close_fingerprints(distinct: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """Pairs (a, b) of the distinct longs in column ``fingerprint`` that differ in 1 to ``bits`` bits.

    The grid gives all pairs up to ``MAX_BITS``; more is an error.
    """
    if bits > MAX_BITS:
        raise ValueError(f"the grid finds fingerprints at most {MAX_BITS} bits apart")
    placed = (
        distinct.select("fingerprint", F.explode(_cells(segment_counts(F.col("fingerprint")))).alias("cell"))
        .where("cell is not null")
    )
    left = placed.select("cell", F.col("fingerprint").alias("a"))
    right = placed.select("cell", F.col("fingerprint").alias("b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits
    # Spark takes the exploded cells for as small as the fingerprints, and would broadcast them
    return left.join(right.hint("merge"), "cell").where((F.col("a") < F.col("b")) & near).select("a", "b").distinct()


def classes(prints: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """The component of each distinct fingerprint: fingerprint, root (a fingerprint), component_id (a doc_id)."""
    distinct = stored(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id")), "fingerprints")
    linked = components(close_fingerprints(distinct, bits))
    rooted = distinct.join(linked, distinct.fingerprint == linked.node, "left").select(
        "fingerprint", "first_id", F.coalesce("component", "fingerprint").alias("root")
    )
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return rooted.join(smallest, "root").select("fingerprint", "root", "component_id")


def near_duplicates(docs: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """A row per row of ``docs``: doc_id, fingerprint (hex digits), component_id."""
    prints = stored(fingerprints(docs.select("doc_id", "text")), "prints")
    joined = prints.join(classes(prints, bits).drop("root"), "fingerprint")
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """One row of each component of ``docs``, that of the smallest id; ``docs`` must be a stored table.

    Rows are told apart by their place in the table, so of repeated rows one stays too.
    """
    place = F.monotonically_increasing_id()
    prints = stored(fingerprints(docs.select("doc_id", "text", place.alias("row"))), "prints")
    rooted = prints.join(classes(prints, bits), "fingerprint")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    first = rooted.groupBy("root").agg(F.min_by("row", order).alias("first_row")).select("first_row")
    kept = docs.withColumn("first row of its class", place).join(
        first.withColumnRenamed("first_row", "first row of its class"), "first row of its class", "left_semi"
    )
    return kept.select(*(f"`{c}`" for c in docs.columns))
