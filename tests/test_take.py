import hashlib
import random

import pytest
from pyspark.sql import functions as F

from prosegauge.operators import split, take

TUNINGS = [{}, {"settle_rows": 1, "slices": 64}]
SCORES = [0.0, -1e-9, 0.25, 0.2500001, 0.5, 0.75, 1.0, 1.0000001, float("nan"), None]


def test_edges(spark):
    rows = spark.createDataFrame(list(enumerate(SCORES)), "i int, s double")
    got = rows.select("i", split.range_index(split.bucketize(F.col("s"))).alias("b"), split.class_of(F.col("s")).alias("c"))
    got = sorted(got.collect())
    assert [r.b for r in got] == [0, None, 0, 1, 1, 2, 3, None, None, None]
    assert [r.c for r in got] == [0, 0, 0, 0, 1, 1, 1, 1, None, None]
    assert split.split_by_threshold(rows, "s").count() == 8


@pytest.mark.parametrize("edges, labels", [([0, 1, 1], ["a", "b"]), ([0, 2, 1], ["a", "b"]), ([0, 1, 2], ["a"])])
def test_bad_edges(edges, labels):
    with pytest.raises(ValueError):
        split.check_edges(edges, labels)


def test_empty_range_counts_zero(spark):
    binned = spark.createDataFrame([("0-0.25",)] * 3, "toxicity_bin string")
    counts = split.range_counts(binned, "toxicity_bin")
    assert [r.n_rows for r in counts.orderBy("bin_idx").collect()] == [3, 0, 0, 0]
    assert split.common_size(counts, 2).first()[0] == 0
    assert split.common_size(counts.where("n_rows > 0"), 2).first()[0] == 2


def test_a_range_without_rows_makes_the_common_size_zero(spark):
    binned = spark.createDataFrame([("0-0.25",), ("0.75-1.0",), ("0.75-1.0",)], "toxicity_bin string")
    counts = split.range_counts(binned, "toxicity_bin")
    assert counts.where("n_rows is null").count() == 0
    assert split.common_size(counts).first()[0] == 0


@pytest.fixture(scope="module")
def skewed(spark):
    """One group holds most rows; ids have wide gaps, negative ones and an outlier."""
    random.seed(7)
    ids = random.sample(range(-500, 500), 600) + [i << 33 for i in range(1, 200)] + [(1 << 62) + 5]
    rows = [(random.choice("aaaaaab"), i) for i in ids] + [(None, 1 << 40 | i) for i in range(5)]
    return spark.createDataFrame(rows, "g string, row_id long"), rows


def heads(rows, n):
    groups = {}
    for g, i in sorted(rows, key=lambda r: r[1]):
        groups.setdefault(g, []).append(i)
    return {(g, i) for g, members in groups.items() for i in members[: n if isinstance(n, int) else n.get((g,), 0)]}


@pytest.mark.parametrize("tuning", TUNINGS)
@pytest.mark.parametrize("n", [0, 77, 5000, {("a",): 250, ("b",): 2}])
def test_heads(skewed, n, tuning):
    frame, rows = skewed
    got = take.head_per_group(frame, ["g"], "row_id", n, **tuning)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(heads(rows, n), key=repr)


@pytest.mark.parametrize("tuning", TUNINGS)
@pytest.mark.parametrize("n", [3, 250, {("a",): 250, ("b",): 2}])
def test_heads_of_many_groups(skewed, monkeypatch, n, tuning):
    frame, rows = skewed
    want = sorted(heads(rows, n), key=repr)
    monkeypatch.setattr(take, "FILTER_GROUPS", 0)  # facts of groups are joined
    assert sorted(map(tuple, take.head_per_group(frame, ["g"], "row_id", n, **tuning).collect()), key=repr) == want
    monkeypatch.setattr(take, "MAX_GROUPS", 1)  # searches become tables
    spans, complete = take.group_spans(frame, ["g"], take.SourceOrder("row_id"))
    assert list(spans) == [("a",)] and not complete
    assert sorted(map(tuple, take.head_per_group(frame, ["g"], "row_id", n, **tuning).collect()), key=repr) == want


def test_taking_is_a_filter(skewed):
    plan = take.head_per_group(skewed[0], ["g"], "row_id", 3)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan


def test_order_must_be_unique(spark):
    same = spark.createDataFrame([("a", 1)] * 50, "g string, row_id long")
    for tuning in TUNINGS:
        with pytest.raises(ValueError):
            take.head_per_group(same, ["g"], "row_id", 10, **tuning).count()


@pytest.mark.parametrize("tuning", TUNINGS)
def test_order_must_not_be_null(spark, tuning):
    rows = spark.createDataFrame([(i if i < 5 else None,) for i in range(50)], "row_id long")
    with pytest.raises(ValueError):
        take.head_per_group(rows, [], "row_id", 20, **tuning)


@pytest.mark.parametrize("tuning", TUNINGS)
def test_sample(spark, tuning):
    frame = spark.range(1000).withColumnRenamed("id", "row_id")
    want = sorted(range(1000), key=lambda i: hashlib.md5(f"42|{i}".encode()).hexdigest())[:137]
    for parts in (1, 7):
        got = take.sample_exact(frame.repartition(parts), 137, 42, **tuning)
        assert sorted(r.row_id for r in got.collect()) == sorted(want)
    other = take.sample_exact(frame, 137, 43, **tuning)
    assert other.count() == 137 and sorted(r.row_id for r in other.collect()) != sorted(want)


def test_balance(spark):
    rows = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(100)], "row_id long, class int")
    kept = take.balance_classes(rows, "class", "row_id").collect()
    assert sorted(r.row_id for r in kept if r["class"]) == list(range(0, 100, 4))
    assert sorted(r.row_id for r in kept if not r["class"]) == [i for i in range(100) if i % 4][:25]
    assert take.balance_classes(rows.where("class = 0"), "class", "row_id").count() == 0


@pytest.mark.parametrize("tuning", TUNINGS)
@pytest.mark.parametrize("size", [0, 5, 30])
def test_equalize(spark, size, tuning):
    scores = [0.1] * 200 + [0.3] * 80 + [0.6] * 20 + [0.9] * 50 + [1.5, float("nan")]
    rows = spark.createDataFrame(list(enumerate(scores)), "row_id long, score double")
    got = take.equalize_ranges(rows, "score", "row_id", size=size, **tuning).collect()
    common = min(20, size) if size else 20
    per_bin = {}
    for r in got:
        per_bin.setdefault(r.toxicity_bin, []).append(r.row_id)
    assert {len(ids) for ids in per_bin.values()} == {common} and len(per_bin) == 4
    if size:  # drawn from the first rows of each range
        assert max(per_bin["0-0.25"]) < size


def test_equalize_with_an_empty_range(spark):
    rows = spark.createDataFrame([(1, 0.1), (2, 0.9)], "row_id long, score double")
    assert take.equalize_ranges(rows, "score", "row_id").count() == 0


def test_quota(spark):
    prompts = spark.createDataFrame(
        [("m", lab, i, f"p{i}") for i, lab in enumerate("x" * 10 + "y" * 10)],
        "model string, label string, row_id long, prompt string",
    )
    done = spark.createDataFrame([("m", "x", "q1"), ("m", "x", "q1"), ("m", "x", "q2")], "model string, label string, prompt string")
    got = take.take_quota(prompts, "row_id", 5, done)
    assert sorted(r.row_id for r in got.collect()) == [0, 1, 2, 10, 11, 12, 13, 14]
    assert take.take_quota(prompts, "row_id", 0, done).count() == 20
    assert take.take_quota(prompts, "row_id", 1, done).where("label = 'x'").count() == 0


def test_more_groups_than_are_collected(spark, monkeypatch):
    monkeypatch.setattr(take, "MAX_GROUPS", 10)
    classes = spark.range(60).selectExpr("id as row_id", "int(id % 12) as class")
    assert take.balance_classes(classes, "class", "row_id", range(12)).count() == 60
    scores = spark.range(60).selectExpr("id as row_id", "(id % 20 + 0.5) / 20 as score")
    edges, labels = [i / 20 for i in range(21)], [str(i) for i in range(20)]
    assert take.equalize_ranges(scores, "score", "row_id", edges, labels).count() == 60
    done = classes.selectExpr("class", "row_id as prompt").where("row_id < 12")
    got = take.take_quota(classes, "row_id", 3, done, ["class"])
    assert sorted(r.row_id for r in got.collect()) == list(range(24))
    nulls = classes.selectExpr("if(row_id = 30, null, row_id) as row_id", "class")
    with pytest.raises(ValueError):
        take.head_per_group(nulls, ["class"], "row_id", 2)
    repeated = classes.selectExpr("row_id div 24 as row_id", "class")
    with pytest.raises(ValueError):
        take.head_per_group(repeated, ["class"], "row_id", 1)


@pytest.mark.parametrize("most", [1_000, 0])
def test_nulls_in_a_cut_group_are_an_error_on_both_paths(spark, monkeypatch, most):
    monkeypatch.setattr(take, "MAX_GROUPS", most)
    rows = [(g, None if i > 2 else i) for g in range(3) for i in range(5)]
    frame = spark.createDataFrame(rows, "name int, row_id long")
    with pytest.raises(ValueError, match="nulls"):
        take.head_per_group(frame, ["name"], "row_id", 3)
    assert take.head_per_group(frame, ["name"], "row_id", 5).count() == 15
