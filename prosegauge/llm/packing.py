"""Documents as token pieces, packed into sequences by the sum-of-squares rule.

``token_pieces`` tokenizes whole texts and cuts only documents longer than a sequence.
``pack`` puts each piece where the sum, over the gaps of open sequences, of the squared number of
sequences with that gap becomes smallest, in the better of two orders. Pieces are dealt evenly to tasks
of ``per_task`` pieces; the pieces of sequences that a task leaves open are packed again, together
with those of other tasks, in rounds of fewer tasks until one round closes all.

Defined results: a null text is empty and gives the one piece of its closing id; each row is a
document, rows that repeat another's id or text too; a null id stays null. An empty table gives
no pieces. Other columns are not read.
"""

from __future__ import annotations

import functools
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosegauge.llm.workers import trimmed
from prosegauge.session import stored

LENGTH = 2048
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = f"{PIECES}, sequence_id long, offset long"
#: Characters that are tokenized at a time, and distinct words.
CHUNK, WORDS = 8 << 20, 20_000


#: Words of which normalizing is lower-casing, and splitting off the marks at the end.
PLAIN_WORD = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]*)([!,.:;?]*)")
#: Parts of words whose ids a worker keeps.
KEPT = 1 << 18


class _Words:
    """Ids of single words. Plain words skip the tokenizer's normalizing and splitting steps."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        letters = [chr(i) for i in range(256) if PLAIN_WORD.fullmatch(chr(i))]
        before = self.tokenizer.pre_tokenizer
        self.written = {ord(x): before.pre_tokenize_str(x)[0][0] for x in letters}
        self.kept: dict[str, bytes] = {}

    def part(self, part: str) -> bytes:
        """Ids, as 32-bit numbers, of letters alone or marks alone, in lower case."""
        ids = self.kept.get(part)
        if ids is None:
            if len(self.kept) >= KEPT:
                self.kept.clear()
            ids = array("I", [x.id for x in self.tokenizer.model.tokenize(part.translate(self.written))]).tobytes()
            self.kept[part] = ids
        return ids

    def ids(self, words: list[str]) -> list[bytes]:
        found, others, match, part = [], [], PLAIN_WORD.fullmatch, self.part
        for word in words:
            plain = match(word)
            if plain is None:
                others.append(len(found))
                found.append(None)
            else:
                letters, marks = plain.groups()
                ids = part(letters.lower()) if letters else b""
                found.append(ids + part(marks) if marks else ids)
        for at in range(0, len(others), WORDS):
            some = others[at : at + WORDS]
            encoded = self.tokenizer.encode_batch_fast([words[i] for i in some], add_special_tokens=False)
            for i, x in zip(some, encoded, strict=True):
                found[i] = array("I", x.ids).tobytes()
        return found


@functools.lru_cache(maxsize=2)
def _words(path: str) -> _Words:
    return _Words(path)


def token_ids(texts: list[str], path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after another, and how many each has.

    The tokenizer splits at every space and line end before anything else, so each distinct word
    of the texts is tokenized once.
    """
    spaced = pc.replace_substring(pa.array(texts, pa.large_string()), "\n", " ")
    split = pc.split_pattern(spaced, " ")
    words = split.flatten().dictionary_encode()
    lists = _words(path).ids(words.dictionary.to_pylist())
    sizes = np.fromiter(map(len, lists), np.int64, len(lists)) // 4
    flat = np.frombuffer(b"".join(lists), np.uint32)
    codes = words.indices.to_numpy(zero_copy_only=False)
    counts, starts = sizes[codes], (np.cumsum(sizes) - sizes)[codes]
    ends = np.cumsum(counts)
    places = np.arange(counts.sum()) + np.repeat(starts - (ends - counts), counts)
    before = np.concatenate([[0], ends])[split.offsets.to_numpy()]
    return flat[places], np.diff(before)


def _groups(texts: list[str]) -> Iterator[slice]:
    """Runs of texts of about ``CHUNK`` characters."""
    first, chars = 0, 0
    for i, text in enumerate(texts):
        chars += len(text)
        if chars >= CHUNK:
            yield slice(first, i + 1)
            first, chars = i + 1, 0
    if first < len(texts):
        yield slice(first, len(texts))


@trimmed
def _pieces(batches: Iterator[pd.DataFrame], path: str, length: int, closing: int) -> Iterator[pd.DataFrame]:
    """Pieces of the texts; the tokenizer goes when the task ends, since the next one may be another worker's."""
    try:
        yield from _text_pieces(batches, path, length, closing)
    finally:
        _words.cache_clear()


def _text_pieces(batches: Iterator[pd.DataFrame], path: str, length: int, closing: int) -> Iterator[pd.DataFrame]:
    for batch in batches:
        texts, keys = batch["text"].fillna("").tolist(), batch["doc_id"]
        for group in _groups(texts):
            ids, counts = token_ids(texts[group], path)
            rows, at = [], 0
            for key, n in zip(keys[group], counts, strict=True):
                document = np.append(ids[at : at + n], np.uint32(closing)).astype("<u4")
                at += n
                for piece, start in enumerate(range(0, len(document), length)):
                    part = document[start : start + length]
                    rows.append((key, piece, start, len(part), zlib.crc32(part.tobytes())))
            frame = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            yield frame.astype({"doc_id": "Int64", "piece": "int32"})


def token_pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH, closing: int = 0) -> DataFrame:
    """Rows of ``PIECES``: each text's ids and a closing id, cut only beyond ``length``.

    ``tokenizer`` is the path of a tokenizer file that every executor has. It must leave out white
    space, lower-case and split letters, digits and marks from each other, as ``word_bpe_49k`` does.
    """
    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(
        functools.partial(_pieces, path=tokenizer, length=length, closing=closing), PIECES
    )


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bin of each length in turn, its offset there, and the gap each bin ends with."""
    counts = np.zeros(capacity + 1, np.int64)
    unseen = np.iinfo(np.int64).max
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, gaps = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), []
    for i, size in enumerate(lengths.tolist()):
        best, gap = 2 * counts[capacity - size] + 1, capacity
        if size < capacity:
            # moving a bin from gap g to g - size changes the sum by 2 (count[g - size] - count[g]) + 2
            there = counts[size:capacity]
            change = 2 * (counts[: capacity - size] - there) + 2
            change[0] -= 1  # a full bin is not counted any more
            change[there == 0] = unseen
            tightest = int(change.argmin())
            if change[tightest] <= best:
                gap = size + tightest
        if gap == capacity:
            chosen = len(gaps)
            gaps.append(capacity)
        else:
            chosen = open_bins[gap].pop()
            counts[gap] -= 1
        bins[i], offsets[i] = chosen, capacity - gap
        gaps[chosen] = left = gap - size
        if left:
            open_bins[left].append(chosen)
            counts[left] += 1
    return bins, offsets, np.array(gaps, np.int64)


@trimmed
def _pack(batches: Iterator[pd.DataFrame], capacity: int, slack: int, number: int) -> Iterator[pd.DataFrame]:
    parts = [x for x in batches if len(x)]
    if not parts:
        return
    pieces = pd.concat(parts, ignore_index=True)
    # neither order is better for all lengths: longest first, or mixed by digest
    tried = []
    for order, up in ((["length", "doc_id", "piece"], [False, True, True]), (["ids_crc32", "doc_id", "piece"], True)):
        ordered = pieces.sort_values(order, ascending=up, ignore_index=True)
        bins, offsets, gaps = sum_of_squares(ordered["length"].to_numpy(), capacity)
        tried.append((len(gaps), int((gaps[bins] > slack).sum()), len(tried), ordered, bins, offsets, gaps))
    *_, pieces, bins, offsets, gaps = min(tried, key=lambda x: x[:3])
    base = number << 54 | TaskContext.get().partitionId() << 24
    yield pieces.assign(sequence_id=base + bins, offset=offsets, closed=gaps[bins] <= slack)


def pack(pieces: DataFrame, capacity: int = LENGTH, per_task: int = 1 << 16, slack: int | None = None) -> DataFrame:
    """Rows of ``PACKED``. A sequence with a gap of ``slack`` (1/256) or less counts as full."""
    slack = capacity // 256 if slack is None else slack
    rest, n, number, closed = pieces, pieces.count(), 0, []
    while True:
        tasks = max(1, -(-n // per_task))
        # the last round is that of one task, or one after which half would be left once more
        last = tasks == 1 or (number > 0 and n > before / 2)  # noqa: F821
        step = functools.partial(_pack, capacity=capacity, slack=capacity if last else slack, number=number)
        done = stored(rest.repartition(tasks).mapInPandas(step, f"{PACKED}, closed boolean"), "packed")
        closed.append(done.where("closed").drop("closed"))
        if last:
            return functools.reduce(DataFrame.unionByName, closed)
        before, rest, number = n, done.where("not closed").drop("closed", "sequence_id", "offset"), number + 1
        n = rest.count()


def pack_documents(docs: DataFrame, tokenizer: str, length: int = LENGTH) -> DataFrame:
    """Token pieces of ``docs`` in packed sequences: rows of ``PACKED``."""
    return pack(stored(token_pieces(docs, tokenizer, length), "pieces"), length)
