from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

import pytest

from prosegauge.functions import text as t

SPACES = "\t\n\x0b\f\r\x1c\x1f \x85\xa0     　"
OVERLAPS = [
    ("The cat", "The cat sat on the mat", "sat on the mat"),
    ("a b", "zz A, b a—b? c d e f g h i j k l m n", "zz A, b a—b? c d e f g h i j k l m n"),
    ("He said “hi”", 'He said "hi" and left', 'He said "hi" and left'),
    ("", "x  y", "x y"),
    ("q", "q", ""),
    ("x y", "x, y 1 2 3 4 5 6 7 8", "6 7 8"),
    ("?!", "one two", "one two"),
    ("a", "banana", "bnn"),
]
OPENINGS = {
    "Of course! Here's a continuation of that text: Foo": "Foo",
    "OF COURSE, here is the continuation, written in the style of X: Bar": "Bar",
    "Of course. Here is the continuation of your text: Baz": "your text: Baz",
    "Sure. Of course here is the continuation": "Sure. Of course here is the continuation",
    "Of course Here’s continuation of the textbook: q": "the textbook: q",
    "\n Of course,\xa0here is continuation.\n\nText": "Text",
    "Of  course here is the continuation: x": "Of  course here is the continuation: x",
}


def test_overlap(column):
    got = column(t.remove_overlap, [(p, x) for p, x, _ in OVERLAPS], ["p", "x"])
    assert got == [want for *_, want in OVERLAPS]


def test_boilerplate(column):
    assert column(t.remove_boilerplate, list(OPENINGS), ["x"]) == list(OPENINGS.values())


def test_fold_and_normalize(column):
    texts = ["“a” ‘b’ — c...d", "x.\x1cy　 Z!", None, ""]
    assert column(t.fold_typography, texts, ["x"]) == ["\"a\" 'b' - c d", "x.\x1cy　 Z!", None, ""]
    assert column(t.normalize_for_match, texts, ["x"]) == ["a b c d", "x y Z", None, ""]


def test_prefix(column):
    rows = [("abc", "ab"), ("ab", "abc"), ("😀😀x", "ab"), ("", ""), (None, "a")]
    assert column(t.strip_prompt_prefix, rows, ["x", "p"]) == ["c", "", "x", "", None]


def test_truncation(column):
    rows = [("a b", "c d e"), ("a ", "b c d"), ("", "  one   two "), ("a", None), ("a b", "")]
    got = column(lambda p, x: t.truncate_new_tokens(p, x, 2), rows, ["p", "x"])
    # the seam joins "b" and "c", so two tokens are new
    assert got == ["c d e", "b c", "  one   two ", None, ""]


def test_response_order(column):
    numbers = " ".join(map(str, range(40)))
    rows = [
        ("Once upon", "Once upon a time"),
        ("Hi!", f"Of course, here's the continuation: {numbers}"),
        ("Hi ", f"Of course, here's the continuation: {numbers}"),
    ]
    # "Hi!" and "0" make one token, so the cut starts after it
    want = ["a time", " ".join(map(str, range(1, 21))), " ".join(map(str, range(20)))]
    assert column(t.clean_response, rows, ["p", "x"]) == want


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab\"'.😀" + SPACES), min_size=1, max_size=60))
def test_white_space_as_in_python(column, texts):
    assert column(t.clean_continuation, texts, ["x"]) == [" ".join(x.split()).replace('"', "'") for x in texts]
    assert column(t.words, texts, ["x"]) == [x.split() for x in texts]
    for limit in (1, 2, 5):
        assert column(lambda x: t.words(x, limit), texts, ["x"]) == [x.split()[:limit] for x in texts]
    assert column(t.strip, texts, ["x"]) == [x.strip() for x in texts]


@pytest.mark.parametrize("text", ["a\n\nb  c", "x"])
def test_cleaning_twice_changes_nothing(column, text):
    once = column(t.clean_continuation, [text], ["x"])
    assert column(t.clean_continuation, once, ["x"]) == once
