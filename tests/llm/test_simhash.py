import pytest
import numpy as np
import xxhash
from conftest import plan_of
from pyspark.sql import functions as F

from prosegauge.llm import simhash
from prosegauge.llm.components import components
from prosegauge.session import stored

DOCS = "doc_id long, text string"
WORDS = [f"w{i}" for i in range(400)]


def fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for space in "\t\n\v\f\r":
        lowered = lowered.replace(space, " ")
    words = [w for w in lowered.split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def corpus():
    rng = np.random.default_rng(5)
    rows = []
    for i in range(40):
        words = rng.choice(WORDS, 150).tolist()
        rows.append((3 * i, " ".join(words)))
        if i % 3 == 0:
            words[rng.integers(150)] = "Changed"
            rows.append((3 * i + 1, "\t".join(words)))
    return [*rows, (900, None), (901, ""), (None, rows[0][1]), (902, "One Two"), (903, "one two"), (0, rows[0][1]), (904, "É a b c")]


def test_classes_against_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "'x' as component_id", "'y' as fingerprint")
    found = simhash.near_duplicates(docs).toPandas()
    prints = [fingerprint(t) for _, t in rows]
    roots = list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(prints):
            roots[i] = min(roots[j] for j, b in enumerate(prints) if (a ^ b).bit_count() <= 2)
    ids = {}
    for (doc_id, _), root in zip(rows, roots, strict=True):
        ids[root] = min((x for x in (doc_id, ids.get(root)) if x is not None), default=None)
    expected = sorted((str(d), f"{p:016x}", ids[r]) for (d, _), p, r in zip(rows, prints, roots, strict=True))
    got = sorted((str(None if np.isnan(r.doc_id) else int(r.doc_id)), r.fingerprint, r.component_id) for r in found.itertuples())
    assert got == expected


def test_keep_one_row_of_each_class(spark, tmp_path):
    path = f"file://{tmp_path}/docs"
    spark.createDataFrame(corpus(), DOCS).selectExpr("*", "1 as row", "2 as node").write.parquet(path)
    docs = spark.read.parquet(path)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    classes = simhash.near_duplicates(docs).select("component_id").distinct()
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.component_id for r in classes.collect())
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_all_pairs_within_two_bits_are_found(spark):
    rng = np.random.default_rng(8)
    base = [int(x) for x in rng.integers(-(1 << 63), 1 << 63, 30)] + [0, -1, 1 << 62, -(1 << 63)]
    values = set(base)
    for x in base:
        for _ in range(4):
            y = x
            for k in rng.integers(0, 64, rng.integers(1, 4)):
                y ^= 1 << int(k)
            values.add((y + (1 << 63)) % (1 << 64) - (1 << 63))
    frame = spark.createDataFrame([(v,) for v in values], "fingerprint long")
    found = {(r.a, r.b) for r in simhash.close_fingerprints(frame).collect()}
    mask = (1 << 64) - 1
    assert found == {(a, b) for a in values for b in values if a < b and ((a ^ b) & mask).bit_count() <= 2}


def test_cells_are_not_broadcast(spark):
    """65 cells of each fingerprint: a stored table of a few megabytes would be broadcast as some hundred."""
    frame = stored(spark.range(500).selectExpr("xxhash64(id) as fingerprint"), "fingerprints")
    near = simhash.close_fingerprints(frame)
    assert "Broadcast" not in plan_of(near) and "SortMergeJoin" in plan_of(near)
    near.collect()
    assert "Broadcast" not in plan_of(near)  # nor when the sizes are known


def test_blocks_of_a_long_text_give_the_same_hashes(monkeypatch):
    text = "some Words\nand others\t in é text " * 300
    whole = [h for block in simhash.shingle_hashes(text) for h in block]
    monkeypatch.setattr(simhash, "BLOCK", 11)
    assert [h for block in simhash.shingle_hashes(text) for h in block] == whole


def test_components_of_a_path_a_star_and_loops(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(5, 5), (None, 3), (200, 201), (201, 200)]
    found = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).where(F.col("node") > 0).count() == 0


def test_a_distance_beyond_the_grid_is_an_error(spark):
    with pytest.raises(ValueError, match="at most 2 bits"):
        simhash.near_duplicates(spark.createDataFrame([(1, "a")], "doc_id long, text string"), bits=3).collect()
