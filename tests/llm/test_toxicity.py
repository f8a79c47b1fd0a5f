import numpy as np
import pandas as pd

from prosegauge.llm import toxicity

DOCS, LABELS = "doc_id long, text string", "doc_id long, toxic int"
RNG = np.random.default_rng(2)
PLAIN = ["".join(RNG.choice(list("aeiounrst"), RNG.integers(2, 8))) for _ in range(300)]
TOXIC = ["grobian", "schuftig", "nasty-wretch"]


def text(toxic, n=120):
    words = RNG.choice(PLAIN, n).tolist()
    for at in RNG.integers(0, n, 8 if toxic else 0):
        words[at] = str(RNG.choice(TOXIC))
    return " ".join(words)


def tables(spark, n=500):
    rows = [(i, text(i % 4 == 0)) for i in range(n)]
    extra = [(1000, None), (1001, ""), (None, text(True)), (1002, text(True, 20_000)), (0, rows[0][1])]
    labels = [(i, int(i % 4 == 0)) for i in range(n) if i % 5] + [(None, 1), (7, None), (3, 0), (3, 0)]
    return spark.createDataFrame(rows + extra, DOCS), spark.createDataFrame(labels, LABELS)


def test_held_out_accuracy_and_edges(spark):
    docs, labels = tables(spark)
    found = toxicity.predict(docs.selectExpr("*", "9 as toxic", "1 as score"), labels).toPandas()
    assert len(found) == 505 and found.score.between(0, 1).all()
    assert (found.predicted == (found.score >= 0.7)).all()
    told = found[found.held_out & (found.doc_id < 500)]
    right = told.predicted == (told.doc_id % 4 == 0)
    assert len(told) > 100 and right.mean() > 0.97
    assert (found[found.doc_id.isin([1000, 1001])].predicted == 0).all()
    assert found[found.doc_id == 1002].predicted.item() == 1
    assert not found[found.doc_id.isna()].held_out.any()


def test_keep_clean_keeps_columns(spark):
    docs, labels = tables(spark)
    docs = docs.selectExpr("*", "'x' as `toxicity score x`", "1 as toxic")
    kept = toxicity.keep_clean(docs, labels)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert {i for i in range(500) if i % 4} <= ids and len(ids & {i for i in range(500) if i % 4 == 0}) < 10


def test_no_labels_one_class_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], DOCS)
    none = spark.createDataFrame([], LABELS)
    assert {r.score for r in toxicity.predict(docs, none).collect()} == {0.0}
    one = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 1)], LABELS)
    assert {r.score for r in toxicity.predict(docs, one).collect()} == {1.0}
    assert toxicity.predict(spark.createDataFrame([], DOCS), none).count() == 0


def test_words_of_their_own():
    toxic, ordinary = [b"bad the a"] * 3 + [b"odd the"], [b"the a bad"] + [b"the a"] * 99
    assert toxicity.own_words(toxic, ordinary) == {b"bad"}
    model = toxicity.fit(pd.DataFrame(columns=["doc_id", "text", "toxic"]), {})
    assert model.scores(["x", None]).tolist() == [0.0, 0.0]
