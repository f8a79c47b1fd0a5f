from collections import Counter

import pytest
from conftest import plan_of
from pyspark.sql import functions as F

from prosegauge.operators import tokens
from prosegauge.plans.responses import banned_sequences
from prosegauge.sources.readers import load_lexicon

TEXTS = ["the cat the dog", "the  a\na b", "", " \t", "z", None]


class Letters:
    """A tokenizer of single letters."""

    def encode(self, text):
        return [ord(c) for c in text]

    def decode(self, ids):
        return "".join(map(chr, ids))


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "row_id int, text string")


@pytest.fixture(scope="module")
def vocab(texts):
    return tokens.build_vocab(texts)


def expected_ids():
    counts = Counter(w for t in TEXTS if t for w in t.split())
    ordered = sorted(counts, key=lambda w: (-counts[w], w))
    return {w: i for i, w in enumerate(ordered, 1)}


def test_vocab(vocab):
    assert {r.token: r.id for r in vocab.collect()} == expected_ids()


def test_padding_is_added_once(vocab):
    once = tokens.with_padding(vocab)
    assert once.count() == vocab.count() + 1
    assert tokens.with_padding(once).count() == once.count()
    assert once.where("id = 0").first().token == "[PAD]"


@pytest.mark.parametrize("broadcast", [500_000, 2, 0])
def test_rows(texts, vocab, monkeypatch, broadcast):
    monkeypatch.setattr(tokens, "BROADCAST_TERMS", broadcast)
    ids = expected_ids()
    rows = tokens.tokenize_pad(texts, ["row_id"], "text", vocab, 3)
    rows = rows.withColumn("labels", tokens.lm_labels(F.col("input_ids"), F.col("attention_mask")))
    for r in rows.collect():
        words = (TEXTS[r.row_id] or "").split()[:3]
        blank = 3 - len(words)
        assert r.input_ids == [ids[w] for w in words] + [0] * blank
        assert r.attention_mask == [1] * len(words) + [0] * blank
        assert r.labels == [ids[w] for w in words] + [-100] * blank
    assert rows.count() == len(TEXTS)


def test_missing_token(texts, vocab):
    poor = vocab.where("token <> 'cat'")
    with pytest.raises(Exception, match="missing from the vocabulary"):
        tokens.tokenize_pad(texts, ["row_id"], "text", poor, 3).collect()
    got = tokens.tokenize_pad(texts, ["row_id"], "text", poor, 3, unknown="drop").where("row_id = 0").first()
    assert sum(got.attention_mask) == 2


def test_plug_in_tokenizer(texts, column):
    rows = tokens.tokenize_pad(texts.where("text is not null"), ["row_id"], "text", length=4, tokenizer=Letters)
    first = rows.where("row_id = 0").first()
    assert first.input_ids == [ord(c) for c in "the "] and first.attention_mask == [1] * 4
    cut = column(tokens.subword_truncator(Letters, 3), [("ab", "cdefg"), ("ab", "cde"), ("ab", None)], ["p", "x"])
    assert cut == ["cde", "cde", None]


def test_banned(spark, vocab, tmp_path):
    path = tmp_path / "words.txt"
    path.write_text("The Cat\nthe cat\n\n  dog \ncat unknown\n🖕", encoding="utf-8")
    lexicon = load_lexicon(spark, str(path))
    assert sorted(r.term for r in lexicon.collect()) == ["cat unknown", "dog", "the cat", "🖕"]
    ids = expected_ids()
    banned = {r.term: r.ids for r in tokens.banned_token_ids(lexicon, vocab).collect()}
    assert banned == {"the cat": [ids["the"], ids["cat"]], "dog": [ids["dog"]], "cat unknown": None, "🖕": None}
    assert sorted(banned_sequences(lexicon, vocab)) == sorted([banned["the cat"], banned["dog"]])
    letters = {r.term: r.ids for r in tokens.banned_token_ids(lexicon, tokenizer=Letters).collect()}
    assert letters["dog"] == [100, 111, 103]


def test_only_rare_tokens_are_shuffled_again(spark, vocab, monkeypatch):
    monkeypatch.setattr(tokens, "BROADCAST_TERMS", 2)
    rows = spark.createDataFrame([(None, "z z b the b"), (1, "z nowhere nowhere"), (2, "the a"), (3, None)], "k int, text string")
    found = tokens.token_ids(rows, ["k"], tokens.words(F.col("text")), vocab)
    ids = expected_ids()
    assert {r.k: (r.ids, r.n_unknown) for r in found.collect()} == {
        None: ([ids[w] for w in "z z b the b".split()], 0),
        1: ([ids["z"]], 2),
        2: ([ids["the"], ids["a"]], 0),
        3: ([], 0),
    }
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = plan_of(found.select("*"))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    by_key = [x for x in plan.splitlines() if "Exchange hashpartitioning(_key" in x and "Reused" not in x]
    # the rows, and the ids of rare terms on their way back
    assert len(by_key) == 2 and sum("REPARTITION" in x for x in by_key) == 1


@pytest.mark.parametrize("broadcast", [500_000, 2, 0])
def test_tokens_set_the_number_of_tasks(spark, monkeypatch, broadcast):
    monkeypatch.setattr(tokens, "BROADCAST_TERMS", broadcast)
    monkeypatch.setattr(tokens, "TASK_TOKENS", 50, raising=False)
    lines = [" ".join(f"t{i * j % 7}" for j in range(10)) for i in range(100)]
    rows = spark.createDataFrame(list(enumerate(lines)), "k int, text string")
    vocab = tokens.build_vocab(rows)
    ids = {r.token: r.id for r in vocab.collect()}
    found = tokens.token_ids(rows, ["k"], tokens.words(F.col("text")), vocab)
    got = {r.k: (r.ids, r.n_unknown) for r in found.collect()}
    assert got == {i: ([ids[t] for t in line.split()], 0) for i, line in enumerate(lines)}
    assert found.rdd.getNumPartitions() == 1000 // 50


def test_any_int_is_an_id(spark):
    vocab = spark.createDataFrame([("a", -5), ("a", 7), ("b", 2**31 - 1), ("c", -(2**31))], "token string, id long")
    rows = spark.createDataFrame([(0, "b a c b")], "k int, text string")
    found = tokens.token_ids(rows, ["k"], tokens.words(F.col("text")), vocab).first()
    assert found.ids == [2**31 - 1, -5, 7, -(2**31), 2**31 - 1]
