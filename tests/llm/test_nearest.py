import numpy as np
import pytest
from pyspark.sql import functions as F

from prosegauge.llm import nearest
from prosegauge.llm.queries import QUERIES, table

SF_DIR = "/root/testdata/sf0.001"


def brute_force(rows, every, k=5):
    """The nearest of each query by double precision cosine, from (vec_id, vector) pairs."""
    unit = {i: np.asarray(v, float) / np.linalg.norm(v) for i, v in rows}
    found = {}
    for q in (i for i in unit if i % every == 0):
        scores = [(-round(float(unit[q] @ unit[i]), 12), i) for i in unit if i != q and len(unit[i]) == len(unit[q])]
        found[q] = [(i, -s) for s, i in sorted(scores)[:k]]
    return found


def searched(df, every, k=5):
    found = {}
    for row in sorted(nearest.nearest(df, F.col("vec_id") % every == 0, k).collect()):
        found.setdefault(row.query_id, []).append((row.vec_id, row.score))
        assert row["rank"] == len(found[row.query_id])
    return found


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def recall(found, true):
    pairs = {(q, i) for q, hits in true.items() for i, _ in hits}
    return len(pairs & {(q, i) for q, hits in found.items() for i, _ in hits}) / len(pairs)


def test_quantiles():
    assert nearest.chi_square_quantile(0.95, 2) == pytest.approx(5.991, abs=1e-3)
    assert nearest.chi_square_quantile(0.99, 16) == pytest.approx(32.000, abs=1e-3)


def test_query_against_all_rows(spark):
    rows = [(r.vec_id, r.embedding) for r in table(spark, SF_DIR, "embeddings").collect()]
    true, found = brute_force(rows, 50), {}
    for row in sorted(QUERIES["op11_nearest_vectors"](spark, SF_DIR).collect()):
        found.setdefault(row.query_id, []).append((row.vec_id, row.score))
    assert recall(found, true) >= 0.9 and all(len(found[q]) == len(true[q]) for q in true)
    unit = {i: np.asarray(v, float) for i, v in rows}
    for q, hits in found.items():
        for i, score in hits:
            assert score == pytest.approx(unit[q] @ unit[i] / np.linalg.norm(unit[q]) / np.linalg.norm(unit[i]), abs=1e-14)


def test_cells_and_blocks_lose_nothing(spark, monkeypatch):
    """Many cells, several blocks a cell, several lots of queries: as good as one block."""
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((40, 24))
    rows = [(i, (centres[i % 40] + 0.3 * rng.standard_normal(24)).tolist()) for i in range(1200)]
    monkeypatch.setattr(nearest, "LEAST_CELL", 150)
    monkeypatch.setattr(nearest, "BLOCK", 64)
    monkeypatch.setattr(nearest, "QUERIES", 16)
    found = searched(frame(spark, rows), 10)
    single = [(i, np.float32(v).tolist()) for i, v in rows]
    assert recall(found, brute_force(single, 10)) >= 0.97


def test_hot_vector_and_ties(spark):
    """A third of the rows is one vector: the smallest other ids come first."""
    rng = np.random.default_rng(5)
    rows = [(i, [1.0, 2.0, 3.0] if i % 3 == 0 else rng.standard_normal(3).tolist()) for i in range(300)]
    found = searched(frame(spark, rows), 30)
    assert [i for i, _ in found[0]] == [3, 6, 9, 12, 15] and [i for i, _ in found[90]] == [0, 3, 6, 9, 12]
    assert found[3 * 30][0][1] == pytest.approx(1.0, abs=1e-15)


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(0, None), (10, []), (20, [0.0, 0.0]), (30, [nan, 1.0]), (40, [None, 1.0]), (50, [inf, 1.0]), (None, [1.0, 1.0])]
    kept = [(60, [1.0, 0.0]), (61, [1.0, 0.1]), (70, [1.0, 0.0]), (70, [0.0, 5.0]), (80, [1.0, 0.0, 0.0])]
    df = frame(spark, odd + kept).withColumn("item", F.lit("x")).withColumn("rank", F.lit(1))
    found = searched(df, 10)
    # of the two vectors of 70 the smaller counts; 80 has no other of its length
    assert {q: [i for i, _ in hits] for q, hits in found.items()} == {60: [61, 70], 70: [61, 60]}
    assert found[60][1][1] == 0.0
    assert searched(frame(spark, []), 10) == {} and searched(frame(spark, odd), 10) == {}
