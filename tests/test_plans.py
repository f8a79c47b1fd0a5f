import json

import pytest
from conftest import plan_of
from pyspark.sql import functions as F

from prosegauge.config import Config
from prosegauge.operators import enrich
from prosegauge.plans import training
from prosegauge.plans.prompts import generate_prompts
from prosegauge.plans.responses import collect_responses, generate_responses, shortfall
from prosegauge.plans.scoring import score_responses
from prosegauge.plans.training import prepare_training
from prosegauge.sources.readers import read_responses
from prosegauge.sources.writers import widened
from prosegauge.streaming import incremental


@pytest.mark.parametrize("nested", [True, False])
def test_prompt_job(spark, tmp_path, nested):
    """40 records; continuation scores fall where prompt scores rise."""
    lines = []
    for i in range(40):
        prompt = {"text": f"it's {i}", "toxicity": i / 40, "threat": 0.5}
        reply = {"text": f"c{i}", "toxicity": None if i == 7 else 1 - i / 40}
        if nested:
            lines.append(json.dumps({"prompt": prompt, "continuation": reply}))
        else:
            lines.append(json.dumps({"prompt": repr(prompt), "continuation": repr(reply)}))
    source = tmp_path / "pairs.jsonl"
    source.write_text("\n".join(lines))
    tables = generate_prompts(spark, str(source), str(tmp_path / "out"), Config(range_size=8), nested)
    assert [r.prompt for r in tables.prompts.orderBy("row_id").collect()] == [f"it's {i}" for i in range(40)]
    row = tables.continuations.orderBy("row_id").first()
    assert (row.continuation, row.prompt, row.toxicity, row.threat) == ("c0", "it's 0", 1.0, None)
    corpus = {(r["class"], r.text) for r in tables.corpus.collect()}
    # 20 in class 1 (not c7), 19 in class 0: scores 1 - i/40 >= 0.5 for i <= 20
    assert corpus == {(0, f"c{i}") for i in range(21, 40)} | {(1, f"c{i}") for i in range(20) if i != 7}
    counts = {r.toxicity_bin: r["count"] for r in tables.ranges.groupBy("toxicity_bin").count().collect()}
    assert set(counts.values()) == {8} and len(counts) == 4


class Flaky:
    """Replies to a prompt from its second try on, never to ``never``."""

    def __init__(self, folder):
        self.folder = folder

    def __call__(self):
        def reply(prompts):
            out = []
            for p in prompts:
                mark = f"{self.folder}/{p}"
                try:
                    tried = open(mark).read()
                except FileNotFoundError:
                    tried = ""
                open(mark, "w").write(tried + "x")
                out.append(None if p == "never" or (p.startswith("late") and not tried) else f"{p} then more of {p}")
            return out

        return reply


def ranges_of(spark, prompts):
    rows = [(i, p, label) for i, (p, label) in enumerate(prompts)]
    return spark.createDataFrame(rows, "row_id long, prompt string, toxicity_bin string")


def test_collector_retries_resumes_and_stops(spark, tmp_path):
    marks = tmp_path / "marks"
    marks.mkdir()
    path, rejects = str(tmp_path / "out"), str(tmp_path / "rejects")
    ranges = ranges_of(spark, [("a", "x"), ("late1", "x"), ("never", "x"), ("b", "y"), (None, "y")])
    pauses = []
    options = dict(config=Config(rounds=4), quota=0, rejects=rejects, sleep=pauses.append)
    got = collect_responses(ranges, path, "chat", Flaky(str(marks)), **options)
    assert sorted((r.label, r.prompt, r.continuation) for r in got.collect()) == [
        ("x", "a", "then more of"),
        ("x", "late1", "then more of"),
        ("y", "b", "then more of"),
    ]
    assert got.where("collected_at is null").count() == 0
    # round 1 has successes, round 2 late1, round 3 none
    assert (marks / "never").read_text() == "xxx" and (marks / "a").read_text() == "x" and pauses == [5.0, 5.0]
    assert spark.read.parquet(rejects).where("prompt = 'never'").count() == 3
    more = ranges.unionByName(ranges_of(spark, [("c", "y")]).withColumn("row_id", F.lit(9)))
    got = collect_responses(more, path, "chat", Flaky(str(marks)), **options)
    assert got.count() == 4 and (marks / "a").read_text() == "x"


def test_collector_quota(spark, tmp_path):
    marks = tmp_path / "marks"
    marks.mkdir()
    ranges = ranges_of(spark, [(f"p{i}", "xy"[i % 2]) for i in range(10)])
    got = collect_responses(ranges, str(tmp_path / "out"), "chat", Flaky(str(marks)), Config(), quota=2)
    assert sorted(r.prompt for r in got.collect()) == ["p0", "p1", "p2", "p3"]
    got = collect_responses(ranges, str(tmp_path / "out"), "chat", Flaky(str(marks)), Config(), quota=3)
    assert sorted(r.prompt for r in got.collect()) == ["p0", "p1", "p2", "p3", "p4", "p5"]


def stubborn():
    def reply(prompts):
        if prompts[0].startswith("raise"):
            raise RuntimeError("no service")
        return [None if prompts[0].startswith("bad") else "then more of it"]

    return reply


@pytest.mark.parametrize(
    "prompts, quota, want",
    [
        (["bad1", "bad2", "bad3", "ok1", "ok2", "ok3"], 3, ["ok1", "ok2", "ok3"]),
        (["bad1", "raise", "ok0", "ok1", "ok2", "ok3"], 3, ["ok0", "ok1", "ok2"]),
        (["a", "a", "b", "c"], 2, ["a", "b"]),
    ],
)
def test_collector_fills_its_quota(spark, tmp_path, prompts, quota, want):
    ranges, rejects = ranges_of(spark, [(p, "x") for p in prompts]), str(tmp_path / "rejects")
    config = Config(rounds=2, slice_rows=2)
    got = collect_responses(
        ranges, str(tmp_path / "out"), "chat", stubborn, config, quota=quota, rejects=rejects, sleep=lambda seconds: None
    )
    assert sorted(r.prompt for r in got.collect()) == want
    assert shortfall(ranges, got, quota).count() == 0
    short = shortfall(ranges, got, 6).first()
    assert (short.n_wanted, short.n_done) == (len(set(prompts)), quota)
    if "raise" in prompts:
        told = {(r.prompt, r.status, r.reason) for r in spark.read.parquet(rejects).collect()}
        assert told == {("bad1", "empty", None), ("raise", "error", "RuntimeError: no service")}


class Recovering:
    """No reply for prompts in b; the others fail on the first try, which is noted in a folder."""

    def __init__(self, folder):
        self.folder = folder

    def __call__(self):
        from pathlib import Path

        def reply(prompts):
            known = [(Path(self.folder) / p).exists() for p in prompts]
            for p in prompts:
                (Path(self.folder) / p).touch()
            return [f"{p} and more." if k and not p.startswith("b") else None for p, k in zip(prompts, known, strict=True)]

        return reply


def test_every_failed_prompt_has_its_tries_before_a_range_ends(spark, tmp_path):
    marks = tmp_path / "marks"
    marks.mkdir()
    ranges = ranges_of(spark, [(p, "x") for p in ("b1", "b2", "c1", "c2", "c3", "c4", "c5")])
    got = collect_responses(
        ranges, str(tmp_path / "out"), "chat", Recovering(str(marks)), Config(rounds=2), quota=2, sleep=lambda seconds: None
    )
    assert sorted(r.prompt for r in got.collect()) == ["c1", "c2"]


def echo(banned=None):
    return lambda prompts: [f'{p}\n said "{banned}"' for p in prompts]


def test_local_models(spark, tmp_path):
    path = str(tmp_path / "out")
    ranges = ranges_of(spark, [("a", "x"), ("b", "y")])
    generate_responses(ranges, path, {"M": echo})
    generate_responses(ranges, path, {"M": echo}, variant="BW", banned=[[1, 2]])
    generate_responses(ranges, path, {"M": echo})
    rows = sorted((r.model, r.label, r.prompt, r.continuation) for r in read_responses(spark, path).collect())
    assert rows == [
        ("M", "x", "a", "said 'None'"),
        ("M", "y", "b", "said 'None'"),
        ("M_BW", "x", "a", "said '[[1, 2]]'"),
        ("M_BW", "y", "b", "said '[[1, 2]]'"),
    ]


def lengths():
    return lambda texts: [enrich.Reply(200, dict.fromkeys(Config().attributes, len(t) / 10)) for t in texts]


def test_scoring_job(spark, tmp_path):
    for model in "AB":
        (tmp_path / model).mkdir()
        (tmp_path / model / "responses_x.csv").write_text("Prompts,Continuation\np,abc\nq,\n")
    dirs = {m: str(tmp_path / m) for m in "AB"}
    out = str(tmp_path / "scored")
    config = Config(pace=None)
    rows = score_responses(spark, dirs, out, lengths, config)
    got = sorted((r.model, r.label, r.prompt, r.toxicity) for r in rows.collect())
    assert got == [("A", "x", "p", 0.3), ("A", "x", "q", None), ("B", "x", "p", 0.3), ("B", "x", "q", None)]
    (tmp_path / "A" / "responses_x.csv").write_text("Prompts,Continuation\np,abc\nr,abcd\n")
    assert score_responses(spark, dirs, out, lengths, config, resume=True).count() == 5
    assert score_responses(spark, {"A": dirs["A"]}, out, lengths, config).count() == 4


def test_training_rows(spark, tmp_path):
    texts = [(i, f"{'bad' if i % 2 else 'good'} words {i}", i % 2) for i in range(50)]
    corpus = spark.createDataFrame(texts, "row_id long, text string, class int")
    config = Config(chunk_chars=32, sequence_length=8)
    rows = prepare_training(corpus, str(tmp_path / "t"), config)
    for name in (0, 1):
        whole = sum(len(t) + 1 for _, t, c in texts if c == name)
        assert rows.where(F.col("class") == name).count() == -(-whole // 32)
    first = rows.first()
    assert len(first.input_ids) == len(first.attention_mask) == len(first.labels) == 8


@pytest.mark.parametrize("kind", ["int", "string"])
def test_training_rows_are_padded_after_their_sort(spark, tmp_path, monkeypatch, kind):
    texts = [(i, f"word{i}", i % 2) for i in range(40)]
    corpus = spark.createDataFrame(texts, "row_id long, text string, class int").withColumn("class", F.col("class").cast(kind))
    written, write = [], training.write_table

    def noted(*args):
        written.append(args)
        write(*args)

    monkeypatch.setattr(training, "write_table", noted)
    rows = prepare_training(corpus, str(tmp_path / "t"), Config(chunk_chars=32, sequence_length=64)).collect()
    assert len(rows) == 2 * -(-(5 * 6 + 15 * 7) // 32)
    assert all(len(r.input_ids) == len(r.attention_mask) == len(r.labels) == 64 for r in rows)
    assert all((i > 0) == (m == 1) and (n == i if m else n == -100) for r in rows for i, m, n in zip(r.input_ids, r.attention_mask, r.labels))
    (narrow, _, by, *widen), = written
    assert narrow.columns == ["class", "chunk_id", "ids"]
    wide = widened(narrow, by, *widen)
    # the writer needs no sort of its own
    assert wide._jdf.queryExecution().optimizedPlan().outputOrdering().nonEmpty()
    plan = plan_of(wide).splitlines()
    padding, sort, shuffle = (min(i for i, x in enumerate(plan) if name in x) for name in ("array_repeat", "Sort [", "REBALANCE"))
    assert padding < sort < shuffle and not any("array_repeat" in x for x in plan[sort:])


def test_stream_equals_batch(spark, tmp_path):
    source, out, marks = (str(tmp_path / n) for n in ("in", "out", "marks"))
    schema = "prompt string, continuation string"
    kind = spark.createDataFrame([], schema).schema

    def reply(fresh):
        return fresh.select("prompt", F.when(fresh.prompt != "none", F.upper("prompt")).alias("continuation"))

    seen = []
    for batch in (["a", "b", "a", "none"], ["b", "c"], []):
        spark.createDataFrame([(p,) for p in batch], "prompt string").write.mode("append").parquet(source)
        stream = spark.readStream.schema("prompt string").parquet(source)
        incremental.incremental_enrich(stream, reply, kind, out, marks).awaitTermination()
        seen += batch
        got = incremental.read_collected(spark, out, kind)
        assert sorted((r.prompt, r.continuation) for r in got.collect()) == sorted({(p, p.upper()) for p in seen if p != "none"})


class Failing:
    """Scores texts and notes them, until it is told to fail."""

    def __init__(self, folder, fails):
        self.folder, self.fails = folder, fails

    def __call__(self):
        def score(texts):
            from pathlib import Path

            if self.fails and len(list(Path(self.folder).iterdir())) >= 20:
                raise RuntimeError("stopped")
            for text in texts:
                with (Path(self.folder) / text).open("a") as f:
                    f.write("x")
            return [enrich.Reply(200, dict.fromkeys(Config().attributes, 0.5)) for _ in texts]

        return score


def test_scoring_goes_on_where_it_stopped(spark, tmp_path):
    marks, out = tmp_path / "marks", str(tmp_path / "scored")
    marks.mkdir()
    rows = spark.range(40).selectExpr("'m' as model", "'x' as label", "concat('p', id) as prompt", "concat('t', id) as continuation")
    config = Config(pace=None, slice_rows=5)
    with pytest.raises(Exception, match="stopped"):
        score_responses(spark, rows, out, Failing(str(marks), True), config, resume=True, batch_size=1, partitions=1)
    first = {r.continuation for r in spark.read.parquet(out).collect()}
    assert 5 <= len(first) < 40
    got = score_responses(spark, rows, out, Failing(str(marks), False), config, resume=True, batch_size=1)
    assert got.count() == 40
    assert all((marks / t).read_text() == "x" for t in first)


def test_stream_tries_failed_prompts_again(spark, tmp_path):
    source, out, marks, seen = (str(tmp_path / n) for n in ("in", "out", "marks", "seen"))
    kind = spark.createDataFrame([], "prompt string, continuation string").schema
    known = []

    def reply(fresh):
        return fresh.select("prompt", F.when(fresh.prompt.isin(known) | (fresh.prompt < "l"), "ok").alias("continuation"))

    for batch in (["a", "late", "never"], ["b", "late"], ["c"], ["d"]):
        spark.createDataFrame([(p,) for p in batch], "prompt string").write.mode("append").parquet(source)
        stream = spark.readStream.schema("prompt string").parquet(source)
        incremental.incremental_enrich(stream, reply, kind, out, marks).awaitTermination()
        known.append("late")
    got = incremental.read_collected(spark, out, kind)
    assert sorted(r.prompt for r in got.collect()) == ["a", "b", "c", "d", "late"]
    lost = incremental.read_rejects(spark, out, stream.schema).where("tries = 3").collect()
    assert [r.prompt for r in lost] == ["never"]
