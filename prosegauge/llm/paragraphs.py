"""Removal of passages that repeat across documents: paragraph MinHash and repeated sentences.

Paragraphs are the lines of a text. Those of ``MIN_WORDS`` words or more get MinHash signatures of
their five-word shingles, in ``BANDS`` bands of ``ROWS``: two paragraphs of Jaccard similarity 0.8
collide in some band with probability 0.99, two of 0.3 with 0.17. Colliding paragraphs are compared by exact Jaccard
similarity, and each component of linked paragraphs is kept once, where it comes first by doc_id and place.

A passage put into the middle of other paragraphs makes none of them alike. So sentences are
compared too: below some fifty words one changed word takes Jaccard similarity under 0.8, so they
are compared by equality, as pairs of neighbours and, from ``MIN_WORDS`` words, alone. A run of sentences is removed
if each pair in it has come before at the same distance in one and the same document, and if it has
``MIN_WORDS`` words or more. Every sentence counts, however short, so nothing else stands within a run.

Equal paragraphs are one node, however many documents have them. Texts are read three times and
shuffled only to fetch the paragraphs that collide with another, and to cut out what is removed. Before each such
shuffle a bit map of bounded size (``reducer``) drops most rows that have no partner.

Defined results: a null or empty text has no paragraphs, and stays as it is; a row with a null id
comes after all others; rows that repeat another's id or text are documents of their own and lose what
the first has. An empty table gives no rows. Letter case and white space are not compared. Very long texts are
worked on whole, one at a time; a task holds ``BLOCK`` shingles or ``HELD`` units, and those of one text. Other
columns are not read, and kept by ``remove_repeats``.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from prosegauge.llm.buckets import linked_components, shared_buckets
from prosegauge.llm.reducer import divided, reduced
from prosegauge.llm.workers import trimmed
from prosegauge.operators.join import MAX_HOT, join_skewed
from prosegauge.session import stored

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 7, 3
MIN_WORDS, PAIR_WORDS = 20, 5
SEED = 7
#: Occurrences from which on a paragraph or pair of sentences is looked up by broadcast.
HOT = 1_000
SENTENCES = re.compile(r"\S(?:[^.!?]|[.!?](?!\s))*[.!?]*")
#: Shingles that are hashed, and units that are held, at a time.
BLOCK, HELD = 1 << 16, 1 << 14
UNITS = (
    "doc_id long, row long, kind string, place int, start int, length int, words int, digest long, bands array<long>,"
    " next_start int, next_length int, next_words int"
)
_signed = np.int64


@functools.lru_cache(maxsize=2)
def _multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.integers(1, 1 << 63, n, dtype=np.uint64) | np.uint64(1), rng.integers(0, 1 << 63, n, dtype=np.uint64)


def shingles(words: list[str]) -> list[int]:
    """Hashes of the shingles; of all words if there are fewer."""
    digest, coded = xxhash.xxh64_intdigest, [w.encode("utf-8", "replace") for w in words]
    if len(coded) <= SHINGLE:
        return [digest(b" ".join(coded))]
    return [digest(b" ".join(x)) for x in zip(*(coded[i:] for i in range(SHINGLE)), strict=False)]


def band_keys(hashes: list[int], sizes: list[int], bands: int = BANDS, per_band: int = ROWS) -> np.ndarray:
    """A key per band of each run of ``sizes`` hashes: equal if the signatures agree in that band."""
    values, starts = np.array(hashes, np.uint64), np.cumsum([0, *sizes[:-1]])
    factors, offsets = _multipliers(bands * per_band)
    lowest = np.stack(
        [np.minimum.reduceat(values * m + o ^ (values >> np.uint64(31)), starts) for m, o in zip(factors, offsets, strict=True)],
        axis=1,
    )
    keys = np.zeros((len(sizes), bands), np.uint64)
    for band in range(bands):
        keys[:, band] = band + 1
        for row in range(band * per_band, band * per_band + per_band):
            keys[:, band] = (keys[:, band] ^ lowest[:, row]) * np.uint64(0x9E3779B97F4A7C15)
            keys[:, band] ^= keys[:, band] >> np.uint64(29)
    return keys.view(_signed)


def word_digest(words: list[str]) -> int:
    return xxhash.xxh64_intdigest(" ".join(words).encode("utf-8", "replace")) - (1 << 63)


def _text_units(text: str) -> Iterator[tuple]:
    """Paragraphs that are long enough and all sentences of a text: kind, start, length, word list."""
    at = 0
    for line in text.split("\n"):
        words = line.lower().split()
        if len(words) >= MIN_WORDS:
            yield "paragraph", at, len(line), words
        for found in SENTENCES.finditer(line):
            yield "sentence", at + found.start(), found.end() - found.start(), found.group().lower().split()
        at += len(line) + 1


def _sentence_units(sentences: list[tuple]) -> Iterator[list]:
    """Long sentences and pairs of neighbours: kind, place, start, length, words, digest, bands, the second one's span and words."""
    for place, (start, length, words) in enumerate(sentences):
        if len(words) >= MIN_WORDS:
            yield ["sentence", place, start, length, len(words), word_digest(words), None, None, None, None]
        if place + 1 < len(sentences):
            second, span, more = sentences[place + 1]
            if len(words) + len(more) >= PAIR_WORDS:
                both = word_digest([*words, "\n", *more])
                yield ["pair", place, start, length, len(words), both, None, second, span, len(more)]


@trimmed
def _units(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in UNITS.replace(", ", ",").split(",")]
    rows: list[list] = []
    hashes: list[int] = []
    sizes: list[int] = []
    paragraphs: list[int] = []

    def settle() -> pd.DataFrame:
        if sizes:
            for i, keys in zip(paragraphs, band_keys(hashes, sizes), strict=True):
                rows[i][8] = keys
        whole = dict.fromkeys(["doc_id", "next_start", "next_length", "next_words"], "Int64")
        frame = pd.DataFrame(rows, columns=names).astype(whole)
        for held in (rows, hashes, sizes, paragraphs):
            held.clear()
        return frame

    for batch in batches:
        ids = batch["doc_id"].astype("Int64")
        for doc_id, row, text in zip(ids, batch["row"], batch["text"], strict=True):
            sentences = []
            for kind, start, length, words in _text_units(text if isinstance(text, str) else ""):
                if kind == "sentence":
                    sentences.append((start, length, words))
                    continue
                found = shingles(words)
                hashes += found
                sizes.append(len(found))
                paragraphs.append(len(rows))
                rows.append([doc_id, row, kind, 0, start, length, len(words), word_digest(words), None, None, None, None])
            rows += [[doc_id, row, *unit] for unit in _sentence_units(sentences)]
            if len(hashes) >= BLOCK or len(rows) >= HELD:
                yield settle()
    if rows:
        yield settle()


def units(docs: DataFrame) -> DataFrame:
    """Rows of ``UNITS`` of documents (doc_id, row, text); offsets are code points."""
    return docs.select(F.col("doc_id").cast("long"), "row", "text").mapInPandas(_units, UNITS)


@trimmed
def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = [np.unique(np.array(shingles(t.lower().split()), np.uint64)).view(_signed) for t in batch["paragraph"]]
        yield pd.DataFrame({"item": batch["digest"], "elements": found})


def _first() -> Column:
    """Where a unit stands, in the order in which the first is kept."""
    return F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row", "start", "length")


def repeated_paragraphs(paragraphs: DataFrame, docs: DataFrame) -> DataFrame:
    """Paragraphs that repeat an earlier one: row, start, length, words, doc_id, kept_doc_id, class_id."""
    firsts = stored(
        paragraphs.groupBy("digest").agg(
            F.min(_first()).alias("first"), F.count("*").alias("n"), F.first("bands").alias("bands")
        ),
        "firsts",
    )
    banded = firsts.select(F.explode("bands").alias("bucket"), F.col("digest").alias("item"))
    shared = stored(shared_buckets(banded), "shared")
    colliding = firsts.drop("bands").join(shared.select(F.col("item").alias("digest")).distinct(), "digest")
    where = stored(colliding.select("digest", "first.row", "first.start", "first.length"), "colliding")
    texts = where.join(reduced(docs.select("row", "text"), "row", where), "row").select(
        "digest", F.substring("text", F.col("start") + 1, F.col("length")).alias("paragraph")
    )
    sets = stored(texts.mapInPandas(_sets, "item long, elements array<long>"), "shingles")

    linked = linked_components(shared, sets, SIMILARITY)
    classes = linked.select(F.col("node").alias("digest"), F.col("component").alias("class_id"))
    # only paragraphs that have a copy or a link can be repeats
    alike = (
        firsts.drop("bands")
        .join(classes, "digest", "left")
        .where("n > 1 or class_id is not null")
        .withColumn("class_id", F.coalesce("class_id", "digest"))
    )
    kept = alike.groupBy("class_id").agg(F.min("first").alias("kept"))
    decided = stored(alike.join(kept, "class_id").select("digest", "class_id", "kept", "n"), "decided")
    some = reduced(paragraphs.select("doc_id", "row", "start", "length", "words", "digest"), "digest", decided)
    return (
        join_skewed(some, decided.drop("n"), "digest", "inner", _hottest(decided))
        .where("row <> kept.row or start <> kept.start")
        .select("doc_id", "row", "start", "length", "words", F.col("kept.doc_id").alias("kept_doc_id"), "class_id")
    )


def _hottest(counted: DataFrame) -> list[int]:
    """Hashes of the digests that occur most, of a table with their number ``n``."""
    hottest = counted.where(F.col("n") > HOT).orderBy(F.desc("n"), "digest").limit(MAX_HOT)
    return [row[0] for row in hottest.select(F.xxhash64("digest")).collect()]


def repeated_sentences(sentences: DataFrame) -> DataFrame:
    """Runs of sentences that come before in one document: row, start, length, words, doc_id, kept_doc_id, class_id."""
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row", "place")
    often = stored(sentences.groupBy("digest").count().where("count > 1").select("digest"), "often")
    some = stored(reduced(sentences.drop("bands"), "digest", often), "sentences")
    counts = some.groupBy("digest").agg(F.count("*").alias("n"), F.min(order).alias("kept"))
    firsts = stored(counts.where("n > 1"), "first-sentences")
    again = join_skewed(some, firsts.drop("n"), "digest", "inner", _hottest(firsts))
    again = again.where("row <> kept.row or place <> kept.place").select(
        "*", F.col("kept.row").alias("kept_row"), (F.col("place") - F.col("kept.place")).alias("distance")
    )
    # the sentences of each pair, once
    one = F.struct("place", "start", "length", "words")
    two = F.struct(
        (F.col("place") + 1).alias("place"), F.col("next_start").alias("start"), F.col("next_length").alias("length"),
        F.col("next_words").alias("words"),
    )
    both = F.when(F.col("kind") == "pair", F.array(one, two)).otherwise(F.array(one))
    same = ["doc_id", "row", "kept_row", "distance"]
    each = again.select(*same, F.col("kept.doc_id").alias("kept_doc_id"), "digest", F.explode(both).alias("it"))
    each = each.groupBy(*same, "it.place").agg(
        F.min("it.start").alias("start"), F.min("it.length").alias("length"), F.min("it.words").alias("words"),
        F.min("kept_doc_id").alias("kept_doc_id"), F.min("digest").alias("digest"),
    )
    numbered = each.selectExpr(
        "*", "place - row_number() over (partition by row, kept_row, distance order by place) as run"
    )
    runs = numbered.groupBy("row", "kept_row", "distance", "run").agg(
        F.first("doc_id").alias("doc_id"),
        F.min("start").alias("start"),
        F.max(F.col("start") + F.col("length")).alias("end"),
        F.sum("words").cast("int").alias("words"),
        F.min("kept_doc_id").alias("kept_doc_id"),
        F.min_by("digest", "start").alias("class_id"),
    )
    return runs.where(F.col("words") >= MIN_WORDS).select(
        "doc_id", "row", "start", (F.col("end") - F.col("start")).alias("length"), "words", "kept_doc_id", "class_id"
    )


def repeats(docs: DataFrame) -> DataFrame:
    """All spans to remove from documents (doc_id, row, text): the columns of both, and kind."""
    found = stored(units(docs), "units")
    lines = repeated_paragraphs(found.where("kind = 'paragraph'"), docs)
    runs = repeated_sentences(found.where("kind <> 'paragraph'"))
    return lines.withColumn("kind", F.lit("paragraph")).unionByName(runs.withColumn("kind", F.lit("sentences")))


def numbered(docs: DataFrame) -> DataFrame:
    """Documents with their place in the stored table, which tells rows apart: doc_id, row, text."""
    return docs.select("doc_id", F.monotonically_increasing_id().alias("row"), "text")


@F.pandas_udf(StringType())
@trimmed
def _without(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Texts without the code points of the spans, which may overlap."""
    for texts, spans in batches:
        found = []
        for text, cut in zip(texts, spans, strict=True):
            parts, at = [], 0
            for start, end in sorted((s["start"], s["start"] + s["length"]) for s in cut):
                parts.append(text[at:start] if start > at else "")
                at = max(at, end)
            found.append("".join([*parts, text[at:]]))
        yield pd.Series(found, dtype=object)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs``, a stored table, without the passages that repeat earlier ones; columns as they are.

    ``n_chars``, where it is there, is that of the text left; a text of which nothing but white
    space is left is empty.
    """
    found = stored(repeats(numbered(docs)), "spans")
    spans = found.groupBy("row").agg(F.collect_list(F.struct("start", "length")).alias("cut"))
    place, cut, text = "place in the table", "spans to cut", "text left"
    marked = docs.withColumn(place, F.monotonically_increasing_id())
    # texts that lose nothing are not shuffled, but for those that the bit map does not tell apart
    some, rest = divided(marked, place, found.select(F.col("row").alias(place)))
    # Spark takes the lists of spans for smaller than their table; they are not to be broadcast
    joined = some.join(spans.withColumnsRenamed({"row": place, "cut": cut}).hint("merge"), place, "left")
    columns = [f"`{c}`" for c in docs.columns]
    whole = joined.where(f"`{cut}` is null").select(*columns).unionByName(rest.select(*columns))
    less = joined.where(f"`{cut}` is not null").withColumn(text, _without(F.col("text"), F.col(f"`{cut}`")))
    left = F.when(F.trim(F.replace(F.col(f"`{text}`"), F.lit("\n"), F.lit(" "))) == "", "").otherwise(F.col(f"`{text}`"))
    changed = {"text": left, "n_chars": F.length(left).cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return whole.unionByName(
        less.select(*(changed[c].alias(c) if c in changed else F.col(f"`{c}`") for c in docs.columns))
    )
