import zlib
from hashlib import md5, sha256

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from prosegauge.llm import prefixes

COLUMNS = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()


def ordered(rows):
    """Turns (role, text) of each conversation in the defined order."""

    def key(row):
        _, turn, role, text = row
        return turn is not None, turn or 0, role or "", md5(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest()

    found = {}
    for row in sorted((r for r in rows if r[0] is not None), key=key):
        found.setdefault(row[0], []).append((row[2] or "", row[3] or ""))
    return found


def rebuilt(rows):
    convs = ordered(rows)
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        out[c] = tuple(convs.get(base, [])[:h] + own[h:])
    return out


def brute_force(rows):
    convs = rebuilt(rows)
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    children = {p: [q for q in members if len(q) == len(p) + 1 and q[: len(p)] == p] for p in members}
    found = []
    for node, who in members.items():
        below = [q for q in members if q[: len(node)] == node]
        ends = sorted(c for c in who if convs[c] == node)
        found.append(
            (
                min(who),
                len(node),
                min(members[node[:-1]]) if node else None,
                len(who),
                len(children[node]),
                sum(not children[q] for q in below),
                sum((len(members[q]) - 1) * len(q[-1][1]) for q in below if q),
                sha256(",".join(map(str, ends)).encode()).hexdigest(),
            )
        )
    return sorted(found, key=repr)


def trie(spark, rows, partitions=3):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(partitions)
    df = df.withColumn("key", F.lit("x")).withColumn("part", F.lit(1)).withColumn("depth", F.lit(2))
    return sorted((tuple(r) for r in prefixes.prefix_trie(df).select(*COLUMNS).collect()), key=repr)


CASES = {
    "shared": [(c, t, "user", f"{c % 2}-{t}") for c in range(40) for t in range(c % 4 + 1)],
    "families": [(c, t, "user", f"{c % 3}-{t}") for c in (100, 101, 102, 150, 199, 200, 250, 399) for t in range(7)],
    "nulls and ties": [
        (None, 0, "user", "x"), (1, None, None, None), (1, None, None, ""), (1, 0, "user", "a"), (1, 0, "user", "a"),
        (1, 0, "bot", "b"), (2, 1, "user", ""), (3, 1, "user", None), (-7, 0, "user", "é日"), (-107, 0, "user", "é日"),
    ],
    "no base": [(c, t, "r", "same") for c in (507, 508, 512) for t in range(2)],
    "one long": [(700, t, "r", f"t{t}") for t in range(300)] + [(c, t, "r", f"t{t}") for c in range(701, 720) for t in range(8)],
    "long texts": [(c, t, "r", "long " * 20_000 + str(t)) for c in (800, 801) for t in range(3)],
    "empty": [],
}


@pytest.mark.parametrize("name", CASES)
def test_nodes_equal_those_of_brute_force(spark, name):
    assert trie(spark, CASES[name]) == brute_force(CASES[name])


def test_a_conversation_over_several_partitions(spark, monkeypatch):
    """Ranges of eight partitions cut one conversation, which has most of the rows, in several parts."""
    rows = [(900, t, "r", f"t{t % 50}") for t in range(400)] + [(901, t, "r", f"t{t}") for t in range(9)]
    monkeypatch.setattr(prefixes, "HOT", 100)
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesce, "false")
    scanned = prefixes.hashed_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    parts = scanned.where("conv_id = 900").select("part").distinct().count()
    places = [r.pos for r in scanned.where("conv_id = 900").select("pos").collect()]
    assert parts > 1 and sorted(places) == list(range(1, 401))
    found = trie(spark, rows)
    spark.conf.set(coalesce, "true")
    assert found == brute_force(rows)


def test_hot_keys_are_joined_apart(spark, monkeypatch):
    monkeypatch.setattr(prefixes, "HOT", 3)
    monkeypatch.setattr(prefixes, "RANGE_BITS", 2)
    for name in ("shared", "one long"):
        assert trie(spark, CASES[name]) == brute_force(CASES[name])


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(98, 104), st.integers(0, 5), st.sampled_from(["u", None]), st.sampled_from(["", "a", "bc"])), max_size=40))
def test_random_conversations(spark, rows):
    assert trie(spark, rows) == brute_force(rows)
