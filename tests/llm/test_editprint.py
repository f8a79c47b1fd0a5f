import hashlib

import numpy as np

from prosegauge.llm import editprint

DOCS = "doc_id long, text string"
RNG = np.random.default_rng(6)


def text(n):
    return "".join(RNG.choice(list("abcdefghij é\n"), n))


def test_every_row_against_the_next(spark):
    rows = [(int(i), text(int(RNG.integers(0, 400)))) for i in RNG.permutation(300)] + [(1000, text(9000)), (1001, None), (None, "null id")]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as bucket", "2 as after").repartition(7)
    found = {r.doc_id: r for r in editprint.next_and_edited(docs).collect()}
    assert len(found) == len(rows)
    ordered = sorted(rows, key=lambda r: -1 if r[0] is None else r[0], reverse=True)
    for (doc_id, own), (_, following) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        own, following = own or "", following or ""
        changed = own[: len(own) - len(own) // 3] + following[: len(own) // 3]
        row = found[doc_id]
        digits = editprint.embed([own, changed, following])
        assert row.n_chars == len(own)
        assert row.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert [row.fingerprint, row.edited_fingerprint] == editprint.as_hex(digits[:2])
        assert row.near_next == editprint.likeness(digits[0], digits[2])


def test_one_row_repeated_ids_and_empty_tables(spark):
    one = editprint.next_and_edited(spark.createDataFrame([(5, "abc")], DOCS)).first()
    assert one.near_next == 1 and one.n_chars == 3
    assert editprint.next_and_edited(spark.createDataFrame([(5, "abc"), (5, "abd"), (5, "abc"), (4, None)], DOCS)).count() == 4
    assert editprint.next_and_edited(spark.createDataFrame([], DOCS)).count() == 0


def plain_walk(text):
    """Steps at which each character is reached, one text at a time."""
    strides, found, at = editprint._strides().reshape(editprint.PERIOD, editprint.CLASSES), [], 0
    for c in editprint._codes(text)[0]:
        found.append(at)
        at += int(strides[at % editprint.PERIOD, c])
    return found


def test_walks_side_by_side_equal_single_ones():
    texts = [text(n) for n in (1, 2048, 17, 500, 1)]
    walked = editprint._walk([editprint._codes(t)[0] for t in texts])
    assert [w.tolist() for w in walked] == [plain_walk(t) for t in texts]


def test_likeness_falls_with_edits():
    base = text(3000)
    levels = []
    for edits in (0, 10, 100, 1000, 3000):
        changed = list(base)
        for at in RNG.permutation(3000)[:edits]:
            changed[at] = str(RNG.choice(list("abcdefghij")))
        a, b = editprint.embed([base, "".join(changed)])
        levels.append(float(editprint.likeness(a, b)))
    assert levels[0] == 1 and levels[1] > 0.9 and levels[1] > levels[2] > max(levels[3:]) and max(levels[3:]) < 0.4
    shifted = editprint.embed([base, "x" + base])
    assert editprint.likeness(*shifted) > 0.7  # an insertion does not put the rest out of step
    assert editprint.embed([""])[0].any() == np.False_
