import hashlib

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from prosegauge.llm import chat

LOG = "conv_id long, place long, message_id long, seq long, kind string, role string, text string"


def rendered(events):
    rows = chat.render(chat.fold(events)).collect()
    found = {}
    for r in sorted(rows, key=lambda r: r.segment):
        found[r.conv_id] = found.get(r.conv_id, "") + r.formatted
    return found


def test_deltas_edits_regenerations_and_deletions(spark):
    log = [
        (1, 0, 10, 0, "open", "user", "old"),
        (1, 0, 10, 9, "edit", None, "new"),
        (1, 1, 11, 1, "open", "assistant", None),
        (1, 1, 11, 3, "delta", None, "b"),
        (1, 1, 11, 2, "delta", None, "a"),
        (1, 1, 11, 2, "delta", None, "a"),  # delivered twice
        (1, 1, 11, 4, "regenerate", None, None),
        (1, 1, 11, 6, "delta", None, "d"),
        (1, 1, 11, 5, "delta", None, "c"),
        (1, 2, 12, 7, "open", "user", "gone"),
        (1, 2, 12, 8, "delete", None, None),
        (1, 3, 13, 10, "nonsense", "user", "ignored"),
        (1, 3, 14, 10, None, "user", "ignored"),
    ]
    text = rendered(spark.createDataFrame(log, LOG))[1]
    assert text == "<|im_start|>user\nnew<|im_end|>\n<|im_start|>assistant\ncd<|im_end|>\n"


def test_nulls_ties_empty_and_other_columns(spark):
    log = [
        (None, None, None, None, "open", None, None),
        (None, None, None, None, "open", None, None),
        (2, 0, 1, 0, "open", "user", "b"),
        (2, 0, 2, 0, "open", "user", "a"),
        (2, None, 3, 0, "open", "x\ny", ""),
    ]
    events = spark.createDataFrame(log, LOG).withColumn("segment", F.lit("clash")).withColumn("log", F.lit(1))
    found = rendered(events)
    assert found[None] == "<|im_start|>\n<|im_end|>\n"
    assert found[2].startswith("<|im_start|>x<|nl|>y\n<|im_end|>\n<|im_start|>user\na")
    assert rendered(spark.createDataFrame([], LOG)) == {}


def test_long_conversations_are_rendered_in_segments(spark):
    n = 3 * chat.SEGMENT + 5
    turns = spark.range(n).selectExpr("7L as conv_id", "id as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "string(id) as text")
    segments = chat.render(chat.fold(chat.turn_events(turns)))
    assert segments.count() == 4
    row = chat.conversation_digests(segments).first()
    whole = "".join(f"{'user' if i % 2 == 0 else 'assistant'}\n{i}\n" for i in range(n))
    assert row.n_turns == n and row.turns_sha256 == hashlib.sha256(whole.encode()).hexdigest()
    assert row.loss_chars == sum(len(str(i)) for i in range(1, n, 2))


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(texts=st.lists(st.text(st.sampled_from("<|\\>im_endstar\nx é"), max_size=12), min_size=1, max_size=6))
def test_rendering_is_reversible(spark, texts):
    turns = spark.createDataFrame(
        [(0, i, ("assistant", "user", t)[i % 3], t) for i, t in enumerate(texts)], "conv_id long, turn long, role string, text string"
    )
    segment = chat.render(chat.fold(chat.turn_events(turns))).select(
        chat.read_turns(F.col("formatted")).alias("turns"),
        chat.masked_texts(F.col("formatted"), F.col("loss_spans")).alias("masked"),
    ).first()
    roles = [("assistant", "user", t)[i % 3] for i, t in enumerate(texts)]
    assert [(t.role, t.text) for t in segment.turns] == list(zip(roles, texts, strict=True))
    assert segment.masked == [t for r, t in zip(roles, texts, strict=True) if r == "assistant"]


def test_no_python_on_the_way(spark):
    turns = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    plan = chat.conversation_digests(chat.render(chat.fold(chat.turn_events(turns))))
    assert "Python" not in plan._jdf.queryExecution().executedPlan().toString()
