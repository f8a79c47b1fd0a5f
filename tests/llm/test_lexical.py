import math
import re

import pytest
from pyspark.sql import functions as F

from prosegauge.llm import lexical

TERM = re.compile(lexical.TERM)


def terms(text):
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return TERM.findall(folded)


def brute_force(docs, items, ranks=10):
    """(item_id, rank, doc_id, score) by the definition, document by document."""
    lists = [(doc_id, terms(text)) for doc_id, text in docs]
    lists = [(doc_id, found) for doc_id, found in lists if found]
    n_docs, n_terms = len(lists), sum(len(found) for _, found in lists)
    wanted = {}
    for item_id, text in items:
        wanted.setdefault(item_id, set()).update(terms(text))
    rows = []
    for item_id, own in wanted.items():
        held = {t: sum(t in found for _, found in lists) for t in own}
        scores = []
        for doc_id, found in lists:
            m, score = 100 - 90 + 90 * len(found) * n_docs // n_terms, 0
            for t in own & set(found):
                tf, w = found.count(t), math.floor(1000 * math.log((2 * n_docs + 2) / (2 * held[t] + 1)))
                score += w * (1_000_000_000 * tf // (1000 * tf + 8 * m))
            if score > 0:
                scores.append((-score, doc_id is None, doc_id or 0, doc_id))
        rows += [(item_id, i + 1, s[3], -s[0]) for i, s in enumerate(sorted(scores)[:ranks])]
    return sorted(rows, key=repr)


def searched(spark, docs, items, **options):
    docs = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item", F.lit(1)).withColumn("n", F.lit(2))
    items = spark.createDataFrame(items, "item_id long, text string").withColumn("term", F.lit("x"))
    found = lexical.ranked_search(docs, items, **options)
    return sorted((tuple(r) for r in found.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


DOCS = [
    (1, "the cat sat on the mat"),
    (2, "The CAT, the-cat; cat's"),
    (3, None),
    (4, ""),
    (5, "... --- !!!"),
    (None, "the cat sat on the mat"),
    (6, "naïve ÄPFEL äpfel 12x 7"),
    (7, "the cat sat on the mat"),
    (7, "the cat sat on the mat"),
    (8, "catalogue concat " * 5),
    (9, "x" * 3000 + " cat"),
    (10, "日本 cat 日本\x7f日本"),
    (11, "no words of theirs"),
]
ITEMS = [(1, "Cat mat?"), (1, "sat"), (2, "ÄPFEL 12X naïve"), (3, None), (4, "!!"), (None, "the"), (5, "日本"), (6, "unknown")]


@pytest.mark.parametrize("options", [{}, {"lot": 40}, {"ranks": 2}])
def test_ranks_equal_those_of_the_definition(spark, options):
    want = brute_force(DOCS, ITEMS, options.get("ranks", 10))
    assert searched(spark, DOCS, ITEMS, **options) == want
    assert {r[0] for r in want} == {1, 2, 5, None}


def test_long_texts_are_counted_whole(spark, monkeypatch):
    monkeypatch.setattr(lexical, "PIECE", 64)
    docs = [(i, " ".join(["cat", "dog", "bird", "über"][: i % 4 + 1] * (20 * i))) for i in range(1, 9)]
    assert searched(spark, docs, [(1, "bird über"), (2, "cat cat")]) == brute_force(docs, [(1, "bird über"), (2, "cat cat")])
    assert [len(x) for x in lexical.pieces("ab cd" + "e" * 200)] == [207]


def test_empty_tables(spark):
    assert searched(spark, [], ITEMS) == [] and searched(spark, DOCS, []) == [] and searched(spark, [], []) == []


def test_sums_of_large_gains_are_exact():
    import numpy as np
    import pandas as pd

    items = lexical._Items(pd.DataFrame({"item": [0] * 5 + [1], "term": [0, 1, 2, 3, 4, 4]}), 5, 2)
    gain = np.array([2**60 + 1, 2**59 + 3, 2**58 + 7, 1, 2**61 + 9], np.int64)
    found = items.scores(np.zeros(5, np.int64), np.arange(5), gain, 1)
    assert found.tolist() == [[int(gain.sum()), int(gain[4])]]
