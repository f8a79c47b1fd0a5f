"""Toxicity by compression distance: how much shorter text gets with a dictionary of toxic text.

Two zstandard dictionaries are trained on labelled text. The ordinary one is trained on windows of
texts labelled 0. The toxic one is trained on what texts labelled 1 have of their own - words in at
least ``SHARE`` of them and ``LIFT`` times rarer, by document, in texts labelled 0 - and is followed by the ordinary
one, so that the two differ in toxic content alone. A text is cut into windows of ``WINDOW``
bytes; the difference of a window's compressed lengths is its distance. Mean, spread and peaks of the
distances, weighed by a logistic regression fitted on labelled texts that trained neither
dictionary, give the score.

The model is fitted on the driver on a bounded sample: ``SAMPLE`` labelled texts per class, taken
by a digest of their ids, of at most ``SAMPLE_CHARS`` characters each. The ordinary dictionary is trained
on ``TRAINING_BYTES`` of them, in the order of another digest. Scores are of whole texts,
with no shuffle.

Defined results: a null text is empty and has a score as any other; labels are 1 if any row of a
doc_id says so, and rows with null label or id teach nothing; with no text of one class every
score is the share of the other (0 with none at all). Other columns are not read, and kept by
``keep_clean``.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosegauge.llm.workers import trimmed

SAMPLE, SAMPLE_CHARS = 4_000, 200_000
SHARE, LIFT = 0.014, 10
TOXIC_BYTES, ORDINARY_BYTES, TRAINING_BYTES = 3_000, 400_000, 8 << 20
WINDOW, LEVEL = 192, 12
THRESHOLD = 0.7


def _windows(text: bytes, size: int) -> Iterator[bytes]:
    for at in range(0, max(1, len(text)), size):
        yield text[at : at + size]


def _dictionary(samples: list[bytes], size: int, segment: int, unit: int) -> bytes:
    """A trained dictionary; the samples themselves, as far as they fit, if they are too few."""
    try:
        return zstandard.train_dictionary(size, samples, k=segment, d=unit).as_bytes()
    except zstandard.ZstdError:
        return b" ".join(samples)[-size:]


class CompressionModel:
    """Compressors with both dictionaries, and the weights of a text's distances."""

    def __init__(self, toxic: bytes, ordinary: bytes, weights: np.ndarray):
        self.toxic, self.ordinary, self.weights = toxic, ordinary, weights
        self._compressors = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_compressors": None}

    def _lengths_differ(self):
        if self._compressors is None:
            parameters = zstandard.ZstdCompressionParameters.from_level(
                LEVEL, write_content_size=0, write_checksum=0, write_dict_id=0
            )
            self._compressors = []
            for content in (self.ordinary, self.toxic + self.ordinary):
                words = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                words.precompute_compress(compression_params=parameters)
                made = zstandard.ZstdCompressor(dict_data=words, compression_params=parameters)
                self._compressors.append(made.compress)
        return self._compressors

    def features(self, text: str | None) -> list[float]:
        """What the score is made of, from the distances of a text's windows."""
        ordinary, toxic = self._lengths_differ()
        lowered = (text or "").lower().encode("utf-8", "replace")
        distances = np.fromiter(
            (len(ordinary(w)) - len(toxic(w)) for w in _windows(lowered, WINDOW)), np.int32
        )
        above = np.maximum(distances, 0)
        return [
            1.0,
            distances.mean(),
            np.sqrt((above**2).mean()),
            min(distances.max(), 20),
            np.log1p((distances >= 4).sum()),
            (distances >= 3).mean(),
            (distances >= 2).mean(),
        ]

    def scores(self, texts: Iterable) -> np.ndarray:
        if not self.ordinary:
            return np.array([float(self.weights[0]) for _ in texts])
        values = np.array([self.features(t if isinstance(t, str) else None) for t in texts]).reshape(-1, 7)
        return 1 / (1 + np.exp(-np.clip(values @ self.weights, -500, 500)))


def _logistic(values: np.ndarray, targets: np.ndarray, importance: np.ndarray) -> np.ndarray:
    weights, ridge = np.zeros(values.shape[1]), 1e-3 * np.eye(values.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(values @ weights, -30, 30)))
        slope = values.T @ (importance * (p - targets)) + ridge @ weights
        curve = (values * (importance * p * (1 - p))[:, None]).T @ values + ridge
        step = np.linalg.solve(curve, slope)
        weights -= step * min(1, 5 / max(1e-9, np.abs(step).max()))
    return weights


def own_words(toxic: list[bytes], ordinary: list[bytes]) -> set[bytes]:
    """Words of many toxic texts and few ordinary ones."""
    inside = Counter(w for text in toxic for w in set(text.split()))
    least = max(2, SHARE * len(toxic))
    often = {w for w, n in inside.items() if n >= least}
    outside = Counter(w for text in ordinary for w in often.intersection(text.split()))
    return {w for w in often if inside[w] / len(toxic) >= LIFT * outside[w] / max(1, len(ordinary))}


def fit(rows: pd.DataFrame, counts: dict[int, int]) -> CompressionModel:
    """The model of sampled texts (doc_id, text, toxic); ``counts``: labelled documents of each class."""
    total = sum(counts.values())
    # in the order of a digest, so that what trains the ordinary dictionary does not depend on the ids' order
    rows = rows.iloc[sorted(range(len(rows)), key=lambda i: zlib.crc32(f"order|{rows['doc_id'].iloc[i]}".encode()))]
    texts = [t.lower().encode("utf-8", "replace") for t in rows["text"]]
    for_words = [zlib.crc32(f"words|{d}".encode()) % 2 == 0 for d in rows["doc_id"]]
    classes = rows["toxic"].tolist()
    toxic, ordinary = ([t for t, c, w in zip(texts, classes, for_words, strict=True) if w and c == k] for k in (1, 0))
    checks = rows[~np.array(for_words, bool)] if len(rows) else rows
    if not toxic or not ordinary or checks["toxic"].nunique() < 2:
        return CompressionModel(b"", b"", np.array([counts.get(1, 0) / total if total else 0.0]))
    kept = own_words(toxic, ordinary)
    own = (b" " + b" ".join(w for w in t.split() if w in kept) + b" " for t in toxic)
    toxic_samples = [w for t in own if t.strip() for w in _windows(t, 256)]
    ordinary_samples, size = [], 0
    for text in ordinary:
        ordinary_samples += _windows(text, 512)
        size += len(text)
        if size > TRAINING_BYTES:
            break
    model = CompressionModel(
        _dictionary(toxic_samples, TOXIC_BYTES, 32, 6), _dictionary(ordinary_samples, ORDINARY_BYTES, 256, 8), None
    )
    values = np.array([model.features(t) for t in checks["text"]])
    targets = checks["toxic"].to_numpy(float)
    each = {k: counts[k] / max(1, (targets == k).sum()) for k in (0, 1)}
    importance = np.where(targets == 1, each[1], each[0])
    model.weights = _logistic(values, targets, importance / importance.mean())
    return model


def held_out(doc_id: Column, of: int = 3, remainder: int = 1) -> Column:
    """Rows whose labels teach nothing; a null id is not among them."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(of)) == remainder, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame) -> CompressionModel:
    """Fit on the sample of ``docs`` (doc_id, text) whose ``labels`` (doc_id, toxic) may teach."""
    usable = labels.where("doc_id is not null and toxic in (0, 1)").where(~held_out(F.col("doc_id")))
    classes = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r.toxic: r.n for r in classes.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    digest = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    taken = F.lit(False)
    for label, n in counts.items():
        taken |= (F.col("toxic") == label) & (digest < SAMPLE / n)
    ids = classes.where(taken)
    texts = docs.select("doc_id", "text").where(F.length("text") <= SAMPLE_CHARS)
    # the ids are a sample of a set size
    rows = texts.join(F.broadcast(ids), "doc_id").toPandas()
    rows = rows.drop_duplicates(["doc_id"]).sort_values("doc_id", ignore_index=True)
    return fit(rows, counts)


def score(model: CompressionModel, docs: DataFrame) -> Column:
    """The score of column ``text``, 0 to 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    @trimmed
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(shared.value.scores(texts))

    return scored("text")


def predict(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Learn from labels that are not held out, score all: doc_id, held_out, score, predicted."""
    found = score(learn(docs, labels), docs)
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), found.alias("score"))
    return rows.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows whose text scores below ``threshold``; columns as they are."""
    name = "toxicity score"
    scored = docs.withColumn(name, score(learn(docs, labels), docs))
    return scored.where(F.col(f"`{name}`") < threshold).select(*(f"`{c}`" for c in docs.columns))
