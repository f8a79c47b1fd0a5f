import random

import pytest
from conftest import plan_of
from pyspark.sql import functions as F

from prosegauge.operators import chunk

SIZE = 16


def corpus(seed, count):
    random.seed(seed)
    lengths = [0, 1, 15, 16, 17, 31, 32, 33, 150]
    return [(i * 3 - 50, "".join(random.choices("ab \n😀é", k=random.choice(lengths)))) for i in range(count)]


def sliced(texts):
    whole = "".join(text + "\n" for text in texts)
    return [whole[i : i + SIZE] for i in range(0, len(whole), SIZE)]


@pytest.mark.parametrize("block_rows", [1, 2, 7, 1000])
def test_corpus(spark, block_rows):
    rows = corpus(3, 60)
    frame = spark.createDataFrame(rows + [(10_000, None)], "row_id long, text string").repartition(5)
    got = chunk.chunk_corpus(frame, size=SIZE, block_rows=block_rows).orderBy("chunk_id").collect()
    assert [r.chunk_id for r in got] == list(range(len(got)))
    assert [r.chunk for r in got] == sliced([text for _, text in rows])


def test_corpora_and_outlying_order(spark):
    rows = [("x", i, text) for i, text in corpus(4, 40)] + [("y", i + 7, text) for i, text in corpus(5, 20)]
    rows += [("y", 1 << 62, "far away")] + [(None, i, text) for i, text in corpus(9, 15)]
    frame = spark.createDataFrame(rows, "name string, row_id long, text string")
    got = chunk.chunk_corpus(frame, size=SIZE, by=["name"], block_rows=6)
    for name in ("x", "y", None):
        chunks = [r.chunk for r in got.where(F.col("name").eqNullSafe(name)).orderBy("chunk_id").collect()]
        assert chunks == sliced([text for n, _, text in sorted(rows, key=lambda r: r[1]) if n == name])


def test_each(spark):
    rows = corpus(6, 30) + [(10_000, None)]
    got = chunk.chunk_each(spark.createDataFrame(rows, "row_id long, text string"), size=SIZE)
    want = [(i, n, t[n * SIZE : (n + 1) * SIZE]) for i, t in rows if t for n in range((len(t) + SIZE - 1) // SIZE)]
    assert sorted(map(tuple, got.collect())) == want
    assert "Exchange" not in plan_of(got)


def test_texts_are_shuffled_once(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        frame = spark.createDataFrame(corpus(8, 60), "row_id long, text string")
        plan = plan_of(chunk.chunk_corpus(frame, size=SIZE, block_rows=7))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    shuffles = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "Reused" not in line]
    # the texts by block, block totals, and the chunks across block edges
    assert len(shuffles) == 3 and sum("chunk_id" in line for line in shuffles) == 1
    assert "ReusedExchange" in plan


def test_repeated_order_values_are_an_error(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b")], "row_id long, text string")
    with pytest.raises(Exception, match="does not tell all rows apart"):
        chunk.chunk_corpus(rows).collect()


def test_many_corpora_are_joined_by_shuffle(spark, monkeypatch):
    rows = [(None if i % 50 == 0 else i % 200, i, "ab" * (i % 23)) for i in range(3_000)]
    frame = spark.createDataFrame(rows, "name int, row_id long, text string")
    few = chunk.chunk_corpus(frame, size=SIZE, by=["name"], block_rows=40)
    monkeypatch.setattr(chunk, "BROADCAST_OFFSETS", 100)
    many = chunk.chunk_corpus(frame, size=SIZE, by=["name"], block_rows=40)
    assert sorted(map(str, few.collect())) == sorted(map(str, many.collect()))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = plan_of(chunk.chunk_corpus(frame, size=SIZE, by=["name"], block_rows=40))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "Broadcast" not in plan and "SortMergeJoin" in plan
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "Reused" not in line]
    # rows by block, block totals, those by corpus and back by block, chunks across edges: no other holds rows
    assert len(set(line.split("plan_id")[0].lstrip(" :+-") for line in exchanges)) <= 5
    assert sum("chunk_id" in line for line in exchanges) == 1


def test_blocks_by_characters(spark):
    rows = [(i, "x" * (10_000 if i < 20 else 1)) for i in range(400)]
    sizes = spark.createDataFrame([(i, len(t) + 1) for i, t in rows], "_order long, _length long")
    bounds, most = chunk._block_bounds(sizes, 1_000, 50_000)
    assert most == 5 and len(bounds) == 4 and max(bounds) < 20
    got = chunk.chunk_corpus(spark.createDataFrame(rows, "row_id long, text string"), size=SIZE, block_chars=50_000)
    assert [r.chunk for r in got.orderBy("chunk_id").collect()] == sliced([t for _, t in rows])
