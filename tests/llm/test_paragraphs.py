from itertools import combinations

import numpy as np
from conftest import plan_of

from prosegauge.llm import buckets, paragraphs, reducer
from prosegauge.session import stored

DOCS = "doc_id long, text string, n_chars long, row string, kind string, `cut` int"
RNG = np.random.default_rng(4)
WORDS = [f"word{i}" for i in range(3000)]


def line(n):
    return " ".join(RNG.choice(WORDS, n)) + "."


def table(spark, tmp_path, texts):
    path = f"file://{tmp_path}/docs"
    rows = [(i, t, None if t is None else len(t), "r", "k", 1) for i, t in texts]
    spark.createDataFrame(rows, DOCS).write.parquet(path)
    return spark.read.parquet(path)


def test_passages_stay_once_and_the_rest_is_left_alone(spark, tmp_path):
    passage = " ".join(line(12) for _ in range(5))
    shared, near = line(60), None
    words = shared.split()
    words[-2] = "other"
    near = " ".join(words)
    own = [line(30) for _ in range(6)]
    texts = [
        (3, own[0] + "\n" + shared),
        (1, own[1] + "\n" + near.upper() + "\n" + own[2]),
        (7, " ".join(RNG.choice(WORDS, 9)) + " " + passage + " " + own[3]),
        (9, own[4] + " tail " + passage),
        (None, shared),
        (11, None),
        (12, ""),
        (13, "short line\nshort line"),
        (14, own[5] + "\n" + own[5]),
        (14, own[5] + "\n" + own[5]),
    ]
    docs = table(spark, tmp_path, texts)
    kept = paragraphs.remove_repeats(docs)
    assert kept.columns == docs.columns and kept.count() == len(texts)
    found = {}
    for r in kept.collect():
        found.setdefault(r.doc_id, []).append(r)
        assert r.n_chars == (None if r.text is None else len(r.text))
    left = {k: [r.text for r in v] for k, v in found.items()}
    assert left[1] == [texts[1][1]]  # the first by doc_id keeps it
    assert shared not in left[3][0] and own[0] in left[3][0]
    assert left[None] == [""] and left[11] == [None] and left[12] == [""] and left[13] == ["short line\nshort line"]
    assert left[7] == [texts[2][1]]
    inner = passage.split(". ")[2]
    assert inner in left[7][0] and inner not in left[9][0] and own[4] in left[9][0]
    assert "".join(t or "" for t in left[14]).count(own[5]) == 1
    empty = spark.createDataFrame([], DOCS)
    assert paragraphs.repeats(paragraphs.numbered(empty)).count() == 0


def test_what_stands_between_repeated_sentences_stays(spark, tmp_path):
    """Two repeated sentences around many short ones of its own: neither is a passage of twenty words."""
    first, second = line(14), line(14)
    own = " ".join(f"own {i} text here." for i in range(200))
    docs = table(spark, tmp_path, [(1, first + " " + line(9)), (2, second), (3, f"{first} {own} {second}")])
    assert {r.doc_id: r.text for r in paragraphs.remove_repeats(docs).collect()} == {r.doc_id: r.text for r in docs.collect()}
    # with sentences of twenty words each goes by itself
    first, second = line(24), line(24)
    texts = [(1, first + " " + line(9)), (2, "x. " + second), (3, f"{first} {own} {second}")]
    docs = table(spark, tmp_path / "long", texts)
    left = {r.doc_id: r.text for r in paragraphs.remove_repeats(docs).collect()}
    assert left[3].strip() == own and left[1] == texts[0][1] and left[2] == texts[1][1]


def test_sentences_of_different_documents_are_no_passage(spark, tmp_path):
    parts = [line(7) for _ in range(3)]
    docs = table(spark, tmp_path, [*((i, f"{line(8)} {p} {line(8)}") for i, p in enumerate(parts)), (9, " ".join(parts))])
    assert {r.doc_id: r.text for r in paragraphs.remove_repeats(docs).collect()}[9] == " ".join(parts)


def sentence_runs(texts):
    """Brute force: spans of maximal runs whose every pair of neighbours comes first at one distance in one document."""
    sentences = []
    for _, text in texts:
        units = [u for u in paragraphs._text_units(text or "") if u[0] == "sentence"]
        sentences.append([(start, length, words) for _, start, length, words in units])
    first, found = {}, set()
    keys = lambda s, i: [(1, tuple(s[i][2]))] * (len(s[i][2]) >= 20) + (
        [(2, tuple(s[i][2]), tuple(s[i + 1][2]))] if i + 1 < len(s) and len(s[i][2]) + len(s[i + 1][2]) >= 5 else []
    )
    for d, s in enumerate(sentences):
        for i in range(len(s)):
            for key in keys(s, i):
                first.setdefault(key, (d, i))
    for d, s in enumerate(sentences):
        hits = {}
        for i in range(len(s)):
            for key in keys(s, i):
                where, at = first[key]
                if (where, at) != (d, i):
                    hits.setdefault((where, i - at), set()).update(range(i, i + key[0]))
        for places in hits.values():
            for start in (p for p in places if p - 1 not in places):
                end = start
                while end + 1 in places:
                    end += 1
                if sum(len(s[p][2]) for p in range(start, end + 1)) >= 20:
                    found.add((texts[d][0], s[start][0], s[end][0] + s[end][1] - s[start][0]))
    return found


def test_runs_equal_those_of_brute_force(spark, tmp_path):
    pool = [line(int(n)) for n in RNG.integers(1, 26, 30)]
    texts = [(i, " ".join(pool[k] for k in RNG.integers(0, 30, RNG.integers(0, 25)))) for i in range(40)]
    block = pool[3:9]
    texts += [(40 + i, "\n".join([line(4), " ".join(block[i % 3 :]), line(6)])) for i in range(8)] + [(50, None), (51, "")]
    texts += [(60, texts[0][1]), (61, "One. " * 3000 + " ".join(block))]
    docs = table(spark, tmp_path, texts)
    # only sentence runs: lines are cut so that none of twenty words is alike
    found = paragraphs.repeated_sentences(paragraphs.units(paragraphs.numbered(docs)).where("kind <> 'paragraph'"))
    rows = found.collect()
    assert {(r.doc_id, r.start, r.length) for r in rows} == sentence_runs(texts) and len(rows) > 20


def test_a_very_common_passage(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(paragraphs, "HOT", 10)
    passage = " ".join(line(12) for _ in range(3))
    texts = [(i, f"{line(9)} {passage} {line(9)}") for i in range(60)]
    left = paragraphs.remove_repeats(table(spark, tmp_path, texts)).collect()
    inner = passage.split(". ")[1]
    assert [inner in r.text for r in sorted(left)] == [True] + [False] * 59


def test_reducer_keeps_every_partner(spark):
    rows = spark.range(-50, 5000).selectExpr("case when id % 10 = 9 then null else id end as k", "id")
    keys = spark.range(-50, 5000, 7).withColumnRenamed("id", "k")
    left = reducer.reduced(rows, "k", keys)
    assert left.join(keys, "k").count() == rows.join(keys, "k").count() and left.count() < 800
    assert reducer.reduced(rows, "k", keys.limit(0)).count() == 0
    some, rest = reducer.divided(rows, "k", keys)
    assert sorted(r.id for r in some.unionByName(rest).collect()) == list(range(-50, 5000))


def test_links_equal_those_of_all_pairs(spark, tmp_path):
    base = [RNG.choice(WORDS, 70).tolist() for _ in range(12)]
    lines = []
    for words in base:
        lines.append(" ".join(words))
        for _ in range(6):
            changed = list(words)
            for at in RNG.integers(0, 70, RNG.integers(1, 3)):
                changed[at] = "x"
            lines.append(" ".join(changed))
    docs = table(spark, tmp_path, list(enumerate(lines)))
    found = paragraphs.repeats(paragraphs.numbered(docs)).where("kind = 'paragraph'").collect()
    sets = [set(paragraphs.shingles(t.split())) for t in lines]
    roots = list(range(len(lines)))
    for _ in range(len(lines)):
        for i, j in combinations(range(len(lines)), 2):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                roots[i] = roots[j] = min(roots[i], roots[j])
    assert {(r.doc_id, r.kept_doc_id) for r in found} == {(i, r) for i, r in enumerate(roots) if i != r}


def test_common_counts_and_spanning_links(monkeypatch):
    sets = [np.unique(RNG.integers(0, 200, RNG.integers(0, 60))) for _ in range(30)]
    monkeypatch.setattr(buckets, "COLUMNS", 16)
    counts = buckets.common_counts(sets[:11], sets[11:])
    assert (counts == [[len(np.intersect1d(a, b)) for b in sets[11:]] for a in sets[:11]]).all()
    assert buckets._spanning([(1, 2), (2, 1), (2, 3), (1, 3), (5, 5), (4, 5)]) == [(1, 2), (2, 3), (4, 5)]


def test_buckets_beyond_pivots_and_blocks(spark, monkeypatch):
    """Two chains of sets, of which no few items are like all others, in one bucket."""
    monkeypatch.setattr(buckets, "BLOCK", 16)
    n = 150
    elements = [(i, [k + 10_000 * (i % 2) for k in range(i // 2, i // 2 + 40)]) for i in range(n)]
    sets = spark.createDataFrame(elements, "item long, elements array<long>")
    rows = sets.selectExpr("7L as bucket", "item")
    found = buckets.linked_components(buckets.shared_buckets(rows), sets, 0.8)
    assert {r.node: r.component for r in found.collect()} == {i: i % 2 for i in range(n)}


def test_exploded_rows_and_lists_are_not_broadcast(spark, tmp_path, monkeypatch):
    """Spark takes them for a fraction of their size: rows of buckets, of blocks, and lists of spans."""
    plans = {}

    def noted(df, name):
        plans.setdefault(name, []).append(plan_of(df))
        return stored(df, name)

    monkeypatch.setattr(buckets, "stored", noted)
    monkeypatch.setattr(buckets, "BLOCK", 16)
    sets = stored(spark.range(60).selectExpr("id as item", "sequence(id div 2, id div 2 + 40) as elements"), "sets")
    shared = buckets.shared_buckets(sets.selectExpr("explode(array(7L, 8L)) as bucket", "item"))
    assert "Broadcast" not in plan_of(shared)
    shared = stored(shared, "shared")
    assert {r.component for r in buckets.linked_components(shared, sets, 0.8).collect()} == {0}
    [compared] = [x for x in plans["links"] if "FlatMapGroupsInPandas" in x]
    assert "Broadcast" not in compared
    left = paragraphs.remove_repeats(table(spark, tmp_path, [(i, line(9) + " " + "word " * 30) for i in range(3)]))
    assert "Broadcast" not in plan_of(left) and left.count() == 3


def test_offsets_are_code_points():
    text = "é🙂 " + " ".join(f"w{i}" for i in range(25)) + ". Next one is a sentence here!\n\nlast"
    for kind, start, length, words in paragraphs._text_units(text):
        part = text[start : start + length]
        assert part.lower().split() == words and kind in ("paragraph", "sentence")
