"""SentencePiece pieces: unigram encoding by Viterbi over a double-array trie, and decoding.

A text is encoded as the sequence of pieces with the largest sum of log scores. A space is put
before it and spaces are part of pieces, as ``▁`` in the model's spelling. A character that no
piece covers alone counts as unknown, ``UNKNOWN_PENALTY`` below the lowest score, and is written as
its bytes. Decoding joins the pieces and takes the space off again, so every text comes back
as it was.

The trie and scores, in size given by the model file, are built once per Python worker. Where no piece
goes over the beginning of a run of spaces, runs and the word after them are encoded by themselves: each
distinct word of a batch once, all of them side by side.

Defined results: null and empty texts have no pieces and decode to the empty text; a literal ``▁``
is a character like any other, and goes through bytes; of sequences with equal scores that with the longer
last piece is taken. Each row is encoded, repeated or not; an empty table gives no rows. Other
columns are not read.
"""

from __future__ import annotations

import functools
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
#: Words beyond so many bytes are encoded one by one; characters and words that are worked on at a time.
LONG, CHUNK, WORDS = 96, 2 << 20, 1 << 15
ENCODED = "doc_id long, ids array<int>, score double, n_bytes int, ids_crc32 long"
RUNS = re.compile(rb" +[^ ]*|[^ ]+")


class DoubleArray:
    """A trie in two arrays: from state s, byte c leads to base[s] + c if check there is s."""

    def __init__(self, keys: list[bytes]):
        children: list[dict[int, int]] = [{}]
        ends: dict[int, int] = {}
        for number, key in enumerate(keys):
            node = 0
            for byte in key:
                following = children[node].get(byte)
                if following is None:
                    following = children[node][byte] = len(children)
                    children.append({})
                node = following
            ends[node] = number
        size = 4 * len(children) + 1024
        self.base, self.check = np.zeros(size, np.int32), np.full(size, -1, np.int32)
        self.value = np.full(size, -1, np.int32)
        taken = bytearray(size)
        taken[0] = 1
        # where to look for room for so many children: what was too full once is not tried again
        waiting, lowest = [(0, 0)], [1] * 257
        while waiting:
            node, state = waiting.pop()
            self.value[state] = ends.get(node, -1)
            if not children[node]:
                continue
            wanted = sorted(children[node])
            slot = lowest[len(wanted)]
            while taken[slot] or slot <= wanted[0] or any(taken[slot - wanted[0] + c] for c in wanted):
                slot += 1
            lowest[len(wanted)], base = slot, slot - wanted[0]
            if base + 1024 > size:
                self.base = np.concatenate([self.base, np.zeros(size, np.int32)])
                self.check, self.value = (np.concatenate([x, np.full(size, -1, np.int32)]) for x in (self.check, self.value))
                taken += bytes(size)
                size *= 2
            self.base[state] = base
            for c in wanted:
                taken[base + c] = 1
                self.check[base + c] = state
                waiting.append((children[node][c], base + c))


class UnigramModel:
    """Pieces with log scores, in the order of their ids."""

    def __init__(self, pieces: list[str], scores: list[float], kinds: list[str]):
        """``kinds``: normal, byte (pieces named <0xXX>) or other, which no text matches."""
        self.bytes_of = [b""] * len(pieces)
        self.byte_ids = np.full(256, -1, np.int64)
        keys, self.ids = [], []
        for i, (piece, kind) in enumerate(zip(pieces, kinds, strict=True)):
            if kind == "byte":
                self.byte_ids[int(piece[3:5], 16)] = i
                self.bytes_of[i] = bytes([int(piece[3:5], 16)])
            elif kind == "normal" and piece:
                self.bytes_of[i] = piece.replace(SPACE, " ").encode()
                keys.append(self.bytes_of[i])
                self.ids.append(i)
        if (self.byte_ids < 0).any():
            raise ValueError("the model has no piece for some bytes")
        self.ids = np.array(self.ids, np.int64)
        self.scores = np.array(scores, np.float64)[self.ids]
        self.trie = DoubleArray(keys)
        self.unknown = (float(self.scores.min()) if len(keys) else 0.0) - UNKNOWN_PENALTY
        self.splits = not any(b" " in k.lstrip(b" ") for k in keys)
        self.deepest = max(map(len, keys), default=0)

    @classmethod
    def load(cls, path: str) -> UnigramModel:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        every = range(model.get_piece_size())

        def kind(i: int) -> str:
            if model.is_byte(i):
                return "byte"
            return "other" if model.is_control(i) or model.is_unknown(i) or model.is_unused(i) else "normal"

        return cls([model.id_to_piece(i) for i in every], [model.get_score(i) for i in every], [kind(i) for i in every])

    def _spelled(self, word: bytes, cuts: list[tuple[int, int, int]]) -> bytes:
        """Ids, as 32-bit numbers, of (start, end, key) in order; bytes for an unknown character."""
        ids: list[int] = []
        for start, end, key in cuts:
            if key >= 0:
                ids.append(int(self.ids[key]))
            else:
                ids.extend(int(self.byte_ids[b]) for b in word[start:end])
        return array("i", ids).tobytes()

    def encode_long(self, word: bytes) -> tuple[bytes, float]:
        """Ids and score of one word, of any length."""
        base, check, value = self._lists()
        n, unseen = len(word), float("-inf")
        best, back = [unseen] * (n + 1), [(0, -1)] * (n + 1)
        best[0] = 0.0
        for at in range(n):
            score = best[at]
            if score == unseen:
                continue
            first = word[at]
            size = 1 if first < 0xC0 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
            state, place, alone = 0, at, False
            while place < n:
                following = base[state] + word[place]
                if check[following] != state:
                    break
                state, place = following, place + 1
                key = value[state]
                if key >= 0:
                    alone |= place - at == size
                    total = score + self._score_list[key]
                    if total > best[place]:
                        best[place], back[place] = total, (at, key)
            if not alone and score + self.unknown > best[at + size]:
                best[at + size], back[at + size] = score + self.unknown, (at, -1)
        cuts, end = [], n
        while end:
            start, key = back[end]
            cuts.append((start, end, key))
            end = start
        return self._spelled(word, cuts[::-1]), best[n]

    def _lists(self):
        if not hasattr(self, "_as_lists"):
            self._as_lists = tuple(x.tolist() for x in (self.trie.base, self.trie.check, self.trie.value))
            self._score_list = self.scores.tolist()
        return self._as_lists

    def encode_words(self, words: list[bytes]) -> tuple[list[bytes], np.ndarray]:
        """Ids and scores of words of ``LONG`` bytes at most, side by side."""
        n, sizes = len(words), np.fromiter(map(len, words), np.int64, len(words))
        longest = int(sizes.max(initial=0))
        grid = np.frombuffer(b"".join(w.ljust(longest, b"\0") for w in words), np.uint8).reshape(n, longest).T.astype(np.int32)
        best = np.full((longest + 5, n), -np.inf)
        key_at = np.full((longest + 5, n), -1, np.int32)
        from_at = np.zeros((longest + 5, n), np.int16)
        best[0] = 0
        trie, scores = self.trie, self.scores
        for at in range(longest):
            words_here = np.flatnonzero((sizes > at) & (best[at] > -np.inf))
            if not len(words_here):
                continue
            start, first = best[at, words_here], grid[at, words_here]
            char = 1 + (first >= 0xC0) + (first >= 0xE0) + (first >= 0xF0)
            alone = np.zeros(len(words_here), bool)
            here, state = np.arange(len(words_here)), np.zeros(len(words_here), np.int32)
            for place in range(at, min(longest, at + self.deepest)):
                rows = words_here[here]
                following = trie.base[state] + grid[place, rows]
                # past its end a word has zero bytes, which could be a key's only by their state
                ok = (trie.check[following] == state) & (place < sizes[rows])
                here, state = here[ok], following[ok]
                if not len(here):
                    break
                keys = trie.value[state]
                done = keys >= 0
                ended, keys = here[done], keys[done]
                alone[ended[char[ended] == place + 1 - at]] = True
                total, rows = start[ended] + scores[keys], words_here[ended]
                better = total > best[place + 1, rows]
                rows = rows[better]
                best[place + 1, rows] = total[better]
                key_at[place + 1, rows], from_at[place + 1, rows] = keys[better], at
            lost = ~alone
            rows, ends, total = words_here[lost], at + char[lost], start[lost] + self.unknown
            better = total > best[ends, rows]
            rows, ends = rows[better], ends[better]
            best[ends, rows] = total[better]
            key_at[ends, rows], from_at[ends, rows] = -1, at
        return self._traced(words, sizes, key_at, from_at), best[sizes, np.arange(n)]

    def _traced(self, words: list[bytes], sizes: np.ndarray, key_at: np.ndarray, from_at: np.ndarray) -> list[bytes]:
        """Ids of the best cuts, followed from the ends of all words at once."""
        ends, rows, steps = sizes.copy(), np.flatnonzero(sizes > 0), []
        while len(rows):
            keys, starts = key_at[ends[rows], rows], from_at[ends[rows], rows].astype(np.int64)
            steps.append((rows, keys, starts, ends[rows]))
            ends[rows] = starts
            rows = rows[starts > 0]
        if not steps:
            return [b""] * len(words)
        rows, keys, starts, stops = (np.concatenate(x) for x in zip(*steps, strict=True))
        order = np.lexsort((starts, rows))
        rows, keys, starts, stops = rows[order], keys[order], starts[order], stops[order]
        known = keys >= 0
        counts = np.where(known, 1, stops - starts)
        flat = np.empty(counts.sum(), np.int32)
        places = np.cumsum(counts) - counts
        flat[places[known]] = self.ids[keys[known]]
        for row, start, stop, place in zip(rows[~known], starts[~known], stops[~known], places[~known], strict=True):
            flat[place : place + stop - start] = self.byte_ids[list(words[row][start:stop])]
        limits = np.concatenate([[0], np.cumsum(np.bincount(rows, counts, len(words)).astype(np.int64))]) * 4
        content = flat.tobytes()
        return [content[a:b] for a, b in zip(limits[:-1].tolist(), limits[1:].tolist(), strict=True)]

    def encode_all(self, words: list[bytes]) -> tuple[list[bytes], np.ndarray]:
        """Ids and scores of distinct words."""
        ids: list = [b""] * len(words)
        scores = np.zeros(len(words))
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        short = [i for i in order if len(words[i]) <= LONG]
        for at in range(0, len(short), WORDS):
            some = short[at : at + WORDS]
            found, scores[some] = self.encode_words([words[i] for i in some])
            for i, x in zip(some, found, strict=True):
                ids[i] = x
        for i in order[len(short) :]:
            ids[i], scores[i] = self.encode_long(words[i])
        return ids, scores

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
        """Ids and scores of whole texts."""
        coded = [b" " + t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
        if self.splits:
            parts = [RUNS.findall(x) if b"  " in x else [b" " + w for w in x[1:].split(b" ")] if x else [] for x in coded]
        else:
            parts = [[x] if x else [] for x in coded]
        sizes = [len(x) for x in parts]
        words = pa.array([w for x in parts for w in x], pa.large_binary()).dictionary_encode()
        spelled, scored = self.encode_all(words.dictionary.to_pylist())
        codes = words.indices.to_numpy(zero_copy_only=False)
        ids, scores, at = [], np.zeros(len(texts)), 0
        for i, n in enumerate(sizes):
            mine = codes[at : at + n]
            at += n
            ids.append(np.frombuffer(b"".join([spelled[c] for c in mine.tolist()]), np.int32))
            scores[i] = scored[mine].sum()
        return ids, scores

    def decode(self, ids: list[int]) -> str:
        """The text of a sequence of ids; ids of no text are left out."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).removeprefix(b" ").decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def _model(path: str) -> UnigramModel:
    return UnigramModel.load(path)


def _encode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    model = _model(path)
    is_byte = np.zeros(len(model.bytes_of), bool)
    is_byte[model.byte_ids] = True
    for batch in batches:
        lengths = np.cumsum(pc.fill_null(pc.utf8_length(batch["text"]), 0).to_numpy(zero_copy_only=False))
        first = 0
        while first < len(batch):
            before = lengths[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(lengths, before + CHUNK)))
            part = batch.slice(first, last - first)
            ids, scores = model.encode([t or "" for t in part["text"].to_pylist()])
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    part["doc_id"],
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32())),
                    pa.array(scores),
                    pa.array([int(is_byte[x].sum()) for x in ids], pa.int32()),
                    pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()),
                ],
                names=["doc_id", "ids", "score", "n_bytes", "ids_crc32"],
            )
            first = last


def encode(docs: DataFrame, model: str) -> DataFrame:
    """Rows of ``ENCODED`` of documents (doc_id, text); ``model`` is the path of a file every executor has."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(functools.partial(_encode, path=model), ENCODED)


def _decode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    model = _model(path)
    for batch in batches:
        lists = pc.fill_null(batch["ids"], [])
        flat, limits = lists.values.to_numpy(), lists.offsets.to_numpy()
        # a row at a time: as Python numbers, ids are many times as large
        texts = [model.decode(flat[a:b].tolist()) for a, b in zip(limits[:-1], limits[1:], strict=True)]
        kept = [c for c in batch.schema.names if c != "ids"]
        yield pa.RecordBatch.from_arrays([*(batch[c] for c in kept), pa.array(texts, pa.string())], names=[*kept, "text"])


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """The columns of ``encoded`` with the text in place of its ``ids``."""
    fields = [f"`{x.name}` {x.dataType.simpleString()}" for x in encoded.schema if x.name != "ids"]
    return encoded.mapInArrow(functools.partial(_decode, path=model), ", ".join([*fields, "text string"]))
