import json
import math

import pytest
from pyspark.sql import functions as F

from prosegauge.functions import records
from prosegauge.operators import join, report, shape

SCHEMA = records.scored_text(("toxicity", "insult"))
CASES = {
    '{"text": "hi", "toxicity": 0.5}': ("hi", 0.5, None),
    "{'text': 'hi', 'toxicity': None}": ("hi", None, None),
    "{\"text\": \"it's\", \"toxicity\": null}": ("it's", None, None),
    "{'text': \"it's\", 'insult': 1}": ("it's", None, 1.0),
    r"{'text': 'it\'s \xe9', 'toxicity': None}": ("it's é", None, None),
    "{'text': 'a, None, b', 'toxicity': 0.1}": ("a, None, b", 0.1, None),
    "{'text': 'a, None, b', 'toxicity': None}": ("a, None, b", None, None),
    "{'text': \"it's, None, nan, b\", 'toxicity':None , 'insult':  None}": ("it's, None, nan, b", None, None),
    r"{'text': 'x \', None, \\', 'toxicity': None}": ("x ', None, \\", None, None),
    "{'text': '" + r"\'n, None," * 20_000 + "', 'toxicity': None}": ("'n, None," * 20_000, None, None),
    "{'text': 'a', 'other': [True, False, None], 'insult': 0.2}": ("a", None, 0.2),
    "junk": (None, None, None),
    "[1, 2]": (None, None, None),
    "3": (None, None, None),
    None: (None, None, None),
}


def test_lenient_parse(spark):
    rows = spark.createDataFrame(list(enumerate(CASES)), "row_id int, prompt string")
    flat = shape.flatten_struct(rows, "prompt", "prompt", schema=SCHEMA)
    assert flat.columns == ["row_id", "prompt", "toxicity", "insult"]
    assert [tuple(r)[1:] for r in sorted(flat.collect())] == list(CASES.values())


def test_nan_score(column):
    value = column(lambda v: records.lenient_struct(v, SCHEMA)["toxicity"], ["{'text': 'a', 'toxicity': nan}"], ["v"])
    assert math.isnan(value[0])


def test_flatten_nested(spark):
    rows = spark.createDataFrame([(1, (("deep",), "t"))], "row_id int, prompt struct<more: struct<x: string>, text: string>")
    flat = shape.flatten_struct(rows, "prompt", "prompt")
    assert flat.columns == ["row_id", "more.x", "prompt"]
    assert tuple(flat.first()) == (1, "deep", "t")


def test_replies(column):
    reply = json.dumps({"choices": [{"message": {"content": 'a "b"\n'}}]})
    assert column(records.chat_content, [reply, "{}", "junk"], ["x"]) == ['a "b"\n', None, None]
    reply = json.dumps({"attributeScores": {"TOXICITY": {"summaryScore": {"value": 0.25}}}})
    scores = column(lambda x: records.summary_scores(x, ("toxicity", "threat")), [reply, "junk"], ["x"])
    assert [tuple(s) for s in scores] == [(0.25, None), (None, None)]
    message = column(records.prompt_message, ['say "x"', None], ["x"])
    assert json.loads(message[0]) == [{"role": "user", "content": 'Continue this text: say "x"'}]


def test_variants(column):
    rows = [("M", None), ("M", "BW"), ("Chat-API", None)]
    assert column(records.model_variant, rows, ["b", "v"]) == ["M", "M_BW", "Chat_API"]


def test_service_fields_may_be_missing(column):
    replies = ['{"choices": []}', '{"choices": [{"message": {}}]}', None]
    assert column(records.chat_content, replies, ["x"]) == [None, None, None]
    scores = column(lambda x: records.summary_scores(x, ("toxicity",)), ['{"attributeScores": {}}', None], ["x"])
    assert [tuple(s) for s in scores] == [(None,), (None,)]


def test_ensure_columns(spark):
    frame = shape.ensure_columns(spark.createDataFrame([(1, 0.5)], "i int, threat double"), ["threat", "insult"])
    assert frame.columns == ["i", "threat", "insult"] and frame.first().insult is None


@pytest.mark.parametrize("block", [1, 2, 3, 1024])
def test_pairs_across_blocks(spark, block):
    said = [(0, 0, "user"), (0, 1, "assistant"), (0, 4, "user"), (0, 9, "assistant"), (0, 10, "user"), (0, 11, "user")]
    said += [(1, 0, "system"), (1, 1, "user"), (2, 5, "user"), (2, 3, "assistant"), (2, 100, "assistant")]
    turns = spark.createDataFrame([(c, t, r, f"{c}.{t}") for c, t, r in said], "conv_id long, turn long, role string, text string")
    pairs = shape.pair_turns(turns, block=block)
    got = sorted((r.prompt, r.continuation) for r in pairs.collect())
    assert got == [("0.0", "0.1"), ("0.4", "0.9"), ("2.5", "2.100")]


def test_attach_prompt(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b")], "row_id int, continuation string")
    right = spark.createDataFrame([(1, "p"), (3, "q")], "row_id int, prompt string")
    joined = join.attach_prompt(left, right)
    assert sorted(map(tuple, joined.collect())) == [(1, "a", "p"), (2, "b", None)]
    assert tuple(report.null_report(joined, ["prompt"]).first()) == (1,)
    with pytest.raises(ValueError, match="repeat"):
        join.attach_prompt(left, right.union(right))
    assert tuple(join.key_alignment(left, right).first()) == (1, 1, 1, False)
    assert join.key_alignment(left, left).first().aligned


def test_pending_keeps_repeats_and_matches_null(spark):
    prompts = spark.createDataFrame([(i, p) for i, p in enumerate(["a", "a", "b", None, "", "c"])], "i int, prompt string")
    done = spark.createDataFrame([("b",), (None,), ("b",)], "prompt string")
    for hot_rows in (0, 1, 1_000_000):
        left = join.pending(prompts, done, hot_rows=hot_rows)
        assert sorted(r.i for r in left.collect()) == [0, 1, 4, 5]
        assert left.join(done, "prompt", "left_semi").count() == 0
    two = join.pending(prompts.withColumn("label", F.lit("x")), done.withColumn("label", F.lit("y")), ["label", "prompt"])
    assert two.count() == 6


def test_accepted_and_rejected(spark):
    rows = spark.createDataFrame([("x",), ("",), (None,), (" ",)], "continuation string")
    assert join.accepted(rows).count() == 2 and join.rejected(rows).count() == 2
