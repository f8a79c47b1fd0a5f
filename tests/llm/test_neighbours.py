import numpy as np

from prosegauge.llm import neighbours

VECTORS = "vec_id long, embedding array<float>, label int"


def vectors():
    rng = np.random.default_rng(9)
    rows, number = [], 0
    for label in (1, 2):
        for _ in range(250):
            rows.append((number, rng.standard_normal(16).astype(np.float32).tolist(), label))
            number += 1
        for size, noise in ((60, 0.05), (12, 0.12), (4, 0.2)):
            centre = rng.standard_normal(16)
            for _ in range(size):
                rows.append((number, (centre * rng.uniform(0.5, 2) + noise * rng.standard_normal(16)).astype(np.float32).tolist(), label))
                number += 1
    for like in (0, 0, 255, 255, 255):
        rows.append((number, rows[like][1], 1))
        number += 1
    rows.append((number, rows[0][1], 2))
    rows.append((number + 1, rows[0][1], None))
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0, 2.0], [1.0, 2.0], [-1.0, -2.0]]
    rows += [(number + 2 + i, x, 1) for i, x in enumerate(odd)]
    return rows


def expected(rows):
    def usable(e, label):
        return label is not None and e and all(x is not None and np.isfinite(x) for x in e) and any(e)

    units = [np.array(e, np.float64) / np.linalg.norm(np.array(e, np.float64)) if usable(e, label) else None for _, e, label in rows]
    links = [[] for _ in rows]
    for i, a in enumerate(units):
        for j in range(i):
            b = units[j]
            if a is not None and b is not None and rows[i][2] == rows[j][2] and len(a) == len(b) and a @ b >= 0.93:
                links[i].append(j)
                links[j].append(i)
    roots = [r[0] for r in rows]
    for _ in rows:
        roots = [min([roots[i], *(roots[j] for j in near)]) for i, near in enumerate(links)]
    return {r[0]: (len(links[i]), roots[i]) for i, r in enumerate(rows)}


def test_links_and_components_against_brute_force(spark):
    rows = vectors()
    frame = spark.createDataFrame(rows, VECTORS).selectExpr("*", "1 as node", "2 as copies")
    result = neighbours.near_duplicates(frame)
    found, true = result.toPandas(), expected(rows)
    assert len(found) == len(rows) and (found.kept == (found.vec_id == found.component_id)).all()
    links = {r.vec_id: r.n_links for r in found.itertuples()}
    assert all(links[i] <= n for i, (n, _) in true.items())
    assert sum(links.values()) >= 0.99 * sum(n for n, _ in true.values())
    wrong = sum(r.component_id != true[r.vec_id][1] for r in found.itertuples())
    assert wrong <= 0.01 * len(rows)
    assert neighbours.audit(frame, result, every=7) >= 0.95


def test_tight_groups_that_link_across(spark):
    """Two groups whose members are nearer to each other than to the other group, which all link with too."""
    rng = np.random.default_rng(3)
    one, other = np.linalg.qr(rng.standard_normal((32, 2)))[0].T
    rows = []
    for i in range(80):
        centre = one if i % 2 else 0.95 * one + np.sqrt(1 - 0.95**2) * other
        rows.append((i, (centre + 0.004 * rng.standard_normal(32)).astype(np.float32).tolist(), 1))
    rows += [(100 + i, rng.standard_normal(32).astype(np.float32).tolist(), 1) for i in range(200)]
    true = expected(rows)
    assert true[0] == (79, 0) and true[1] == (79, 0)
    found = neighbours.near_duplicates(spark.createDataFrame(rows, VECTORS)).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in found} == true


def test_lists_hold_the_nearest_whatever_their_cosine(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal(64).astype(np.float32).tolist(), 1) for i in range(60)]
    nodes = neighbours.distinct_nodes(neighbours.keyed(spark.createDataFrame(rows, VECTORS)))
    lists = neighbours.forest_lists(nodes).toPandas()
    assert (lists.groupby("node").size() == neighbours.K).all() and lists.node.nunique() == 60
    assert lists.cosine.max() < 0.93


def test_another_forest_when_the_audit_misses_links(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(40):
        vector = rng.standard_normal(32)
        rows += [(50 * (2 * i + k), (vector + 0.05 * k * rng.standard_normal(32)).astype(np.float32).tolist(), 1) for k in (0, 1)]
    plant, planted = neighbours.forest_lists, []

    def first_finds_nothing(nodes, forest=0):
        planted.append(forest)
        return plant(nodes, forest) if forest else plant(nodes).limit(0)

    monkeypatch.setattr(neighbours, "forest_lists", first_finds_nothing)
    found = neighbours.near_duplicates(spark.createDataFrame(rows, VECTORS)).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in found} == expected(rows)
    assert planted == [0, 1]


def test_empty_table(spark):
    assert neighbours.near_duplicates(spark.createDataFrame([], VECTORS)).count() == 0
