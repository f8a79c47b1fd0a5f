import zlib

import numpy as np
import pytest

from prosegauge.llm import packing
from prosegauge.llm.queries import tokenizer_path

DOCS = "doc_id long, text string"


@pytest.fixture(scope="module")
def path():
    return tokenizer_path("word_bpe_49k.json")


def expected_ids(path, text):
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids, 0]


def test_word_by_word_equals_whole_texts(path):
    texts = ["", " ", "It's 1,234 TESTS... don't!", "É́ é ﬁ İ ΑΣ", "a b c\u001cd\r\n\te", "<|endoftext|> x<|startoftext|>", "日本語 🙂🙂", "naïve'll 's"]
    ids, counts = packing.token_ids(texts, path)
    ends = np.cumsum(counts)
    for text, end, n in zip(texts, ends, counts, strict=True):
        assert [*ids[end - n : end].tolist(), 0] == expected_ids(path, text)


def test_pieces_and_places(spark, path):
    rows = [(i, "some words here " * (i % 40)) for i in range(120)] + [(500, "many words " * 3000), (None, None), (7, ""), (7, "")]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as piece", "2 as closed")
    found = packing.pack_documents(docs, path, 256).toPandas()
    assert len(found[found.doc_id == 7]) == 3
    texts = dict(rows[:121])
    for doc_id, text in texts.items():
        ids, mine = expected_ids(path, text), found[found.doc_id == doc_id].sort_values("piece")
        if doc_id == 7:
            continue
        assert mine["length"].sum() == len(ids) and (len(mine) == -(-len(ids) // 256))
        for r in mine.itertuples():
            part = np.array(ids[r.start : r.start + r.length], "<u4")
            assert zlib.crc32(part.tobytes()) == r.ids_crc32
    for _, one in found.groupby("sequence_id"):
        one = one.sort_values("offset")
        assert (one.offset == one["length"].cumsum() - one["length"]).all() and one["length"].sum() <= 256
    assert found.sequence_id.nunique() <= 1.1 * found["length"].sum() / 256 + 2
    assert packing.pack_documents(spark.createDataFrame([], DOCS), path).count() == 0


def test_rounds_keep_every_piece(spark):
    pieces = spark.range(5000).selectExpr("id as doc_id", "0 as piece", "0L as start", "1 + id * 7919 % 255 as length", "id * 31 as ids_crc32")
    found = packing.pack(pieces, 256, per_task=2000).toPandas()
    assert len(found) == 5000 and found.groupby("sequence_id")["length"].sum().max() <= 256
    assert found.sequence_id.nunique() <= 1.05 * found["length"].sum() / 256


def plain_sum_of_squares(lengths, capacity):
    gaps = []
    for size in lengths:
        def cost(after):
            return sum(after.count(g) ** 2 for g in set(after) if g)

        options = [(cost([*gaps, capacity - size]), 1, 0, None)]
        for g in sorted({g for g in gaps if g >= size}):
            i = gaps.index(g)
            options.append((cost([*gaps[:i], g - size, *gaps[i + 1 :]]), 0, g, i))
        *_, chosen = min(options, key=lambda x: x[:3])
        if chosen is None:
            gaps.append(capacity - size)
        else:
            gaps[chosen] -= size
    return sorted(gaps)


def test_sum_of_squares_rule_against_plain_version():
    rng = np.random.default_rng(3)
    for _ in range(20):
        lengths = rng.integers(1, 31, 60)
        bins, offsets, gaps = packing.sum_of_squares(lengths, 30)
        assert sorted(gaps) == plain_sum_of_squares(lengths.tolist(), 30)
        for b in range(len(gaps)):
            assert sorted(offsets[bins == b]) == sorted(np.cumsum(lengths[bins == b]) - lengths[bins == b])
