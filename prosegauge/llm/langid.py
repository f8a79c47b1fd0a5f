"""Language identification by n-gram filters that answer for all languages at once.

An n-gram is three code points of lower-cased text in which everything but letters is one space.
A language keeps the n-grams that make up at least ``MIN_SHARE`` of its text - so no more than
1 / ``MIN_SHARE`` - and are at least ``RATIO`` as frequent in it as in any other. The kept n-grams
go into a bit-sliced Bloom filter: each slot has one bit per language, and the slots of an n-gram,
and-ed, are the set of languages that contain it. A text's count for a language is the number of
its n-grams with that bit, less what false positives would give; the largest count decides.

Counts are made over all learning rows, combined per task before the one shuffle. The filter is
the only thing broadcast; its size follows from ``MIN_SHARE`` and the number of languages, not
from the corpus.

Defined results: a text that is null or has no letter is ``und`` with score 0; so is every text if
nothing was learned; if no n-gram is known the most frequent language is given, with score 0.
Rows with null lang or text teach nothing; a row repeated teaches twice. Other columns are not
read, and kept by ``keep_known``.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosegauge.llm.workers import trimmed
from prosegauge.session import stored

MIN_SHARE, RATIO = 1e-5, 0.5
HASHES, SLOTS_PER_NGRAM = 3, 16
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)
#: Characters that are worked on at a time; n-grams a task counts before it hands them on.
BLOCK, HELD = 1 << 20, 1 << 21
UNKNOWN = "und"


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def ngrams(text: str) -> Iterator[np.ndarray]:
    """Blocks of a text's n-grams, three code points in one number."""
    carry = np.array([32], np.int64)
    for at in range(0, len(text), BLOCK):
        block = text[at : at + BLOCK].lower().encode("utf-32-le", "surrogatepass")
        points = np.frombuffer(block, "<u4").astype(np.int64)
        points = np.concatenate([carry, np.where(_letters()[points], points, 32)])
        if at + BLOCK >= len(text):
            points = np.append(points, 32)
        points = points[np.concatenate([[True], (points[1:] != 32) | (points[:-1] != 32)])]
        found = points[:-2] << 42 | points[1:-1] << 21 | points[2:]
        yield found[points[1:-1] != 32]
        carry = points[-2:]


@trimmed
def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: dict[str, list] = {}
    waiting: dict[str, list] = {}

    def settle(lang: str) -> None:
        codes, n = np.unique(np.concatenate(waiting.pop(lang)), return_counts=True)
        if lang in held:
            codes, places = np.unique(np.concatenate([held[lang][0], codes]), return_inverse=True)
            n = np.bincount(places, np.concatenate([held[lang][1], n])).astype(np.int64)
        held[lang] = [codes, n]

    def handed_on() -> Iterator[pd.DataFrame]:
        for lang, (codes, n) in held.items():
            yield pd.DataFrame({"lang": lang, "ngram": codes, "n": n})
        held.clear()

    for batch in batches:
        for lang, text in zip(batch["lang"], batch["text"], strict=True):
            for found in ngrams(text):
                waiting.setdefault(lang, []).append(found)
                if sum(map(len, waiting[lang])) >= BLOCK:
                    settle(lang)
        for lang in list(waiting):
            settle(lang)
        if sum(len(x[0]) for x in held.values()) >= HELD:
            yield from handed_on()
    yield from handed_on()


def count_ngrams(docs: DataFrame) -> DataFrame:
    """How often each language has each n-gram: lang, ngram, n."""
    rows = docs.where("lang is not null and text is not null").select("lang", "text")
    return rows.mapInPandas(_count, "lang string, ngram long, n long").groupBy("lang", "ngram").agg(F.sum("n").alias("n"))


class LanguageFilter:
    """A Bloom filter with one bit per language in each slot."""

    def __init__(self, langs: list[str], masks: np.ndarray, codes: np.ndarray):
        """``codes[i]`` is an n-gram of the languages with a bit in ``masks[i]`` (as many words as needed)."""
        self.langs = langs
        self.bits = max(10, int(np.ceil(np.log2(max(1, len(codes)) * SLOTS_PER_NGRAM))))
        self.slots = np.zeros((1 << self.bits, masks.shape[1]), masks.dtype)
        for places in self._places(codes):
            np.bitwise_or.at(self.slots, places, masks)
        self.false_rate = np.array([self._bit(self.slots, i).mean() for i in range(len(langs))]) ** HASHES

    def _places(self, codes: np.ndarray) -> list[np.ndarray]:
        shift = np.uint64(64 - self.bits)
        keys = codes.astype(np.uint64)
        keys ^= keys >> np.uint64(29)
        return [(keys * np.uint64(m)) >> shift for m in MULTIPLIERS]

    def _bit(self, masks: np.ndarray, lang: int) -> np.ndarray:
        word, bit = divmod(lang, masks.dtype.itemsize * 8)
        return (masks[:, word] >> masks.dtype.type(bit)) & masks.dtype.type(1)

    def languages_of(self, codes: np.ndarray) -> np.ndarray:
        """The mask of the languages that contain each n-gram."""
        first, *others = self._places(codes)
        found = self.slots[first]
        for places in others:
            found &= self.slots[places]
        return found

    def _totals(self, masks: np.ndarray) -> np.ndarray:
        """N-grams of each language."""
        if masks.dtype == np.uint8:
            n = np.bincount(masks[:, 0], minlength=256)
            bits = np.arange(256)[:, None] >> np.arange(len(self.langs)) & 1
            return n @ bits
        return np.array([self._bit(masks, i).sum(dtype=np.int64) for i in range(len(self.langs))])

    def decide(self, text: str | None) -> tuple[str, float]:
        """The language of a text and its share of the corrected counts."""
        n, hits = 0, np.zeros(len(self.langs), np.int64)
        for codes in ngrams(text or ""):
            n += len(codes)
            if self.langs:
                hits += self._totals(self.languages_of(codes))
        if not n or not self.langs:
            return UNKNOWN, 0.0
        real = np.maximum(0, (hits - n * self.false_rate) / (1 - self.false_rate))
        best = int(real.argmax())
        return self.langs[best], float(real[best] / real.sum()) if real.sum() else 0.0


def learn(docs: DataFrame) -> LanguageFilter:
    """The filter of the languages in ``docs`` (lang, text). Languages come most frequent first."""
    counts = stored(count_ngrams(docs), "ngrams")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    langs = [r.lang for r in totals.orderBy(F.desc("total"), "lang").collect()]
    shares = (
        counts.join(F.broadcast(totals), "lang")  # a row per language
        .withColumn("share", F.col("n") / F.col("total"))
        .where(F.col("share") >= MIN_SHARE)
        .groupBy("ngram")
        .agg(F.max("share").alias("most"), F.collect_list(F.struct("lang", "share")).alias("each"))
    )
    kept = shares.select(
        "ngram",
        F.transform(F.filter("each", lambda x: x.share >= F.col("most") * RATIO), lambda x: x.lang).alias("langs"),
    ).toPandas()
    width = next((w for w in (8, 16, 32) if len(langs) <= w), 64)
    kind = np.dtype(f"uint{width}")
    masks = np.zeros((len(kept), -(-max(1, len(langs)) // width)), kind)
    place = {lang: i for i, lang in enumerate(langs)}
    for row, found in enumerate(kept["langs"]):
        for lang in found:
            word, bit = divmod(place[lang], width)
            masks[row, word] |= kind.type(1 << bit)
    return LanguageFilter(langs, masks, kept["ngram"].to_numpy(np.int64))


def prediction(model: LanguageFilter, docs: DataFrame) -> Column:
    """A struct of lang and score for column ``text``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    @trimmed
    def decided(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        decide = shared.value.decide
        for texts in batches:
            yield pd.DataFrame([decide(t if isinstance(t, str) else None) for t in texts], columns=["lang", "score"])

    return decided("text")


def held_out(doc_id: Column, of: int = 4, remainder: int = 2) -> Column:
    """Rows that nothing is learned from; a null id is not among them."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(of)) == remainder, F.lit(False))


def learning_rows(docs: DataFrame) -> DataFrame:
    return docs.where("doc_id is not null").where(~held_out(F.col("doc_id"))).select("lang", "text")


def predict(docs: DataFrame) -> DataFrame:
    """Learn from the rows that are not held out, predict all: doc_id, held_out, lang_pred, score."""
    found = prediction(learn(learning_rows(docs)), docs)
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), found.alias("found"))
    return rows.select("doc_id", "held_out", F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"))


def keep_known(docs: DataFrame, least: float = 0.0) -> DataFrame:
    """Rows whose text has a language, with a score of ``least`` or more; columns as they are."""
    name = "language found"
    kept = docs.withColumn(name, prediction(learn(learning_rows(docs)), docs))
    known = (F.col(f"`{name}`.lang") != UNKNOWN) & (F.col(f"`{name}`.score") >= least)
    return kept.where(known).select(*(f"`{c}`" for c in docs.columns))
