import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from prosegauge.llm import unigram
from prosegauge.llm.queries import tokenizer_path

DOCS = "doc_id long, text string"


def small_model():
    rng = np.random.default_rng(1)
    pieces = sorted({"▁" * int(rng.integers(0, 3)) + "".join(rng.choice(list("abé"), rng.integers(1, 5))) for _ in range(40)} | {"▁", "a", "▁▁"})
    scores = [-float(x) for x in rng.uniform(1, 8, len(pieces))]
    return unigram.UnigramModel(
        ["<unk>", *(f"<0x{i:02X}>" for i in range(256)), *pieces], [0.0] * 257 + scores, ["other"] + ["byte"] * 256 + ["normal"] * len(pieces)
    )


SMALL = small_model()


def best_score(model, text):
    """By all cuts of the whole text, one character after another."""
    keys = {model.bytes_of[i].decode(): s for i, s in zip(model.ids, model.scores, strict=True)}
    spaced = " " + text
    best = [0.0] + [-np.inf] * len(spaced)
    for end in range(1, len(spaced) + 1):
        options = [best[start] + keys[spaced[start:end]] for start in range(end) if spaced[start:end] in keys]
        if spaced[end - 1] not in keys:
            options.append(best[end - 1] + model.unknown)
        best[end] = max(options, default=-np.inf)
    return best[-1]


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("abé \n▁x🙂\0"), max_size=30))
def test_best_cut_and_round_trip(text):
    (ids,), (score,) = SMALL.encode([text])
    assert SMALL.decode(ids.tolist()) == text
    if text:
        assert score == pytest.approx(best_score(SMALL, text))
        alone, other = SMALL.encode_long((" " + text).encode())
        assert other == pytest.approx(score)
    else:
        assert len(ids) == 0 and score == 0


def test_double_array_holds_exactly_its_keys():
    rng = np.random.default_rng(2)
    keys = sorted({bytes(rng.integers(0, 256, rng.integers(1, 6), dtype=np.uint8)) for _ in range(3000)})
    trie = unigram.DoubleArray(keys)

    def find(key):
        state = 0
        for byte in key:
            following = trie.base[state] + byte
            if trie.check[following] != state:
                return -1
            state = following
        return trie.value[state]

    assert [find(k) for k in keys] == list(range(len(keys)))
    known = set(keys)
    others = [bytes(rng.integers(0, 256, rng.integers(1, 6), dtype=np.uint8)) for _ in range(3000)]
    assert all(find(k) == -1 for k in others if k not in known)


def test_encode_and_decode_tables(spark):
    path = tokenizer_path("piece_bpe_32k.model")
    rows = [(1, "Some text, with  two spaces"), (2, None), (3, ""), (None, " é▁🙂\n"), (1, "Some text, with  two spaces"), (4, "long" * 5000 + " word")]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as ids", "2 as score")
    encoded = unigram.encode(docs, path)
    assert encoded.where("size(ids) = 0").count() == 2
    decoded = unigram.decode(encoded, path).collect()
    assert sorted((str(r.doc_id), r.text) for r in decoded) == sorted((str(d), t or "") for d, t in rows)
    assert unigram.decode(unigram.encode(spark.createDataFrame([], DOCS), path), path).count() == 0
