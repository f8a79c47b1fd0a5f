import re

import pytest
from conftest import plan_of
from pyspark.sql import functions as F

from prosegauge.sources import readers, writers

MESSY = (
    "Prompts,Continuation\n"
    "plain,text\n"
    '"x ""y, z"" w",k\n'
    '"doubled ""quotes""","a, b"\n'
    '"escaped \\"quotes\\"",x\n'
    "short\n"
    "one,two,three\n"
    '"line\nbreak",y\n'
    "null,None\n"
)


def test_lenient_csv(spark, tmp_path):
    path = tmp_path / "responses_0-0.25.csv"
    path.write_text(MESSY)
    rows = readers.read_responses_lenient(spark, str(path))
    assert sorted(map(tuple, rows.collect()), key=repr) == sorted(
        [
            ("plain", "text"),
            ('x "y, z" w', "k"),
            ('doubled "quotes"', "a, b"),
            ('escaped "quotes"', "x"),
            ("short", None),
            ("line\nbreak", "y"),
            ("null", "None"),
        ],
        key=repr,
    )
    assert rows.count() == 7 and rows.select("continuation").where("continuation is null").count() == 1


def test_model_folders(spark, tmp_path):
    for model, header, line in (("A", "Prompts,Continuation", "p,c"), ("B", "Prompts,Continuation,Timestamp", "p,c,2025-01-02 03:04:05")):
        for label in ("0-0.25", "0.75-1.0"):
            folder = tmp_path / model
            folder.mkdir(exist_ok=True)
            (folder / f"responses_{label}.csv").write_text(f"{header}\n{line}\n")
            (folder / "notes.txt").write_text("not a table")
    dirs = {m: str(tmp_path / m) for m in "AB"}
    rows = readers.scan_model_dirs(spark, dirs)
    got = sorted((r.model, r.label, r.prompt, r.collected_at is not None) for r in rows.collect())
    assert got == [("A", "0-0.25", "p", False), ("A", "0.75-1.0", "p", False), ("B", "0-0.25", "p", True), ("B", "0.75-1.0", "p", True)]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        readers.scan_model_dirs(spark, {"C": str(tmp_path / "C")})


def test_prompts_csv_roundtrip(spark, tmp_path):
    texts = ['say "hi", twice', "line\nbreak", "null", "None", "back\\slash"]
    rows = spark.createDataFrame([(t, 0.5) for t in texts], "prompt string, toxicity double")
    writers.write_csv(rows, str(tmp_path / "p"))
    assert spark.read.option("header", True).csv(str(tmp_path / "p")).columns == ["Prompts", "toxicity"]
    back = readers.read_prompts(spark, str(tmp_path / "p"))
    assert sorted(map(tuple, back.collect())) == sorted((t, 0.5) for t in texts)


def test_corpus_text(spark, tmp_path):
    path = tmp_path / "toxic.txt"
    path.write_bytes("one\r\ntwo\rthree\n\nfive é".encode())
    lines = readers.read_corpus_text(spark, str(path)).orderBy("row_id")
    assert [r.text for r in lines.collect()] == ["one", "two", "three", "", "five é"]
    rows = spark.createDataFrame([("a", 0), ("b\nc", 1), (None, 1)], "text string, class int")
    writers.write_corpus(rows, str(tmp_path / "corpora"))
    back = readers.read_corpus_lines(spark, str(tmp_path / "corpora"))
    assert sorted((r["class"], r.value) for r in back.collect()) == [(0, "a"), (1, "b"), (1, "c")]
    (tmp_path / "more").mkdir()
    for name in "ab":
        (tmp_path / "more" / f"{name}.txt").write_text("x")
    with pytest.raises(ValueError, match="one file"):
        readers.read_corpus_text(spark, str(tmp_path / "more"))


def test_ranges_prune_partitions(spark, tmp_path):
    rows = spark.createDataFrame([(1, "0-0.25"), (2, "0.75-1.0")], "row_id long, toxicity_bin string")
    writers.write_ranges(rows, str(tmp_path / "r"))
    back = spark.read.schema(rows.schema).parquet(str(tmp_path / "r"))
    one = readers.select_range(back, "0-0.25")
    assert [r.row_id for r in one.collect()] == [1]
    assert readers.load_ranges(back, ["0.25-0.5"]).count() == 0
    writers.write_ranges(rows.where("row_id = 1"), str(tmp_path / "r"))  # leaves nothing of an earlier run
    assert spark.read.schema(rows.schema).parquet(str(tmp_path / "r")).count() == 1
    assert re.search(r"PartitionFilters: \[[^\]]*toxicity_bin#\d+ = 0-0.25", plan_of(one))


def test_responses_replace_their_own_partitions_only(spark, tmp_path):
    path = str(tmp_path / "responses")

    def write(model, label, text, writer=writers.write_responses):
        row = spark.createDataFrame([("p", text, model, label)], "prompt string, continuation string, model string, label string")
        writer(row.withColumn("collected_at", F.lit(None).cast("timestamp")), path)

    for label in ("x", "y"):
        write("m", label, "old")
    write("m", "x", "new")
    rows = {(r.label, r.continuation) for r in readers.read_responses(spark, path).collect()}
    assert rows == {("x", "new"), ("y", "old")}
    write("m", "x", "more", writers.append_responses)
    added = readers.read_responses(spark, path).where("continuation = 'more'").first()
    assert added.collected_at is not None and readers.read_responses(spark, path).count() == 3


def test_pairs_as_structs_or_strings(spark, tmp_path):
    path = tmp_path / "pairs.jsonl"
    path.write_text('{"prompt": {"text": "a", "toxicity": 0.1}, "continuation": {"text": "b"}}\n')
    assert readers.read_pairs_jsonl(spark, str(path)).first().prompt.toxicity == 0.1
    assert "toxicity" in readers.read_pairs_jsonl(spark, str(path), nested=False).first().prompt


def test_files_with_unlike_headers(spark, tmp_path):
    folder = tmp_path / "m"
    folder.mkdir()
    (folder / "responses_0-0.25.csv").write_text("Prompts,Continuation\n" + "p,c\n" * 1000)
    (folder / "responses_0.25-0.5.csv").write_text("Continuation,Prompts\nc,p\n")
    (folder / "responses_0.5-0.75.csv").write_text("")
    (folder / "responses_0.75-1.0.csv").write_text("Prompts,Continuation,Timestamp\n" + "p,c,2025-01-02 03:04:05\n" * 30)
    for lenient in (True, False):
        rows = readers.scan_model_dirs(spark, {"m": str(folder)}, lenient)
        counts = {r.label: r.n for r in rows.where("prompt = 'p' and continuation = 'c'").groupBy("label").agg(F.count("*").alias("n")).collect()}
        assert counts == {"0-0.25": 1000, "0.25-0.5": 1, "0.75-1.0": 30} and rows.count() == 1031
        assert rows.where("collected_at is not null").count() == 30


def test_records_of_both_kinds_in_one_file(spark, tmp_path):
    path = tmp_path / "pairs.jsonl"
    path.write_text('{"prompt": {"text": "a", "toxicity": 0.1}}\n{"prompt": "{\'text\': \'b\', \'toxicity\': None}"}\n{"prompt": 3}\n')
    rows = readers.read_pairs_jsonl(spark, str(path)).select("prompt.text", "prompt.toxicity").collect()
    assert [tuple(r) for r in rows] == [("a", 0.1), ("b", None), (None, None)]


def test_row_ids_follow_files_and_lines(spark, tmp_path):
    want = []
    for name, n in (("a", 5), ("b", 50_000), ("c", 500)):
        lines = [f"{name}{i}" for i in range(n)]
        (tmp_path / f"{name}.txt").write_text("\n".join(lines) + "\n")
        want += lines
    for size in ("128m", "20k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            got = readers.with_file_row_id(spark.read.text(str(tmp_path))).orderBy("row_id").collect()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert [r.value for r in got] == want and [r.row_id for r in got] == list(range(len(want)))


def test_counts_of_rows_left_out(spark, tmp_path):
    """Two files with headers of their own: over-long rows and rows without a continuation are counted while they are read."""
    (tmp_path / "a.csv").write_text("Prompts,Continuation\np1,c1\np2,c2,surplus\np3,\n")
    (tmp_path / "b.csv").write_text("Continuation,Prompts\nc4,p4,\nc5,p5,more,still\nc6\n")
    rows, counts = readers.read_responses_counted(spark, str(tmp_path))
    assert sorted(r.prompt or "" for r in rows.collect()) == ["", "p1", "p3", "p4"]
    assert counts.get == {"n_rows": 6, "n_over_long": 2, "n_no_prompt": 1, "n_no_continuation": 1}


def test_lines_that_are_no_json(spark, tmp_path):
    path = tmp_path / "pairs.jsonl"
    path.write_text('{"prompt":{"text":"a"},"continuation":"none"}\n{"prompt": \n{}\n')
    found = [(r.prompt, r.continuation, r.unparsed) for r in readers.read_pair_lines(spark, str(path)).collect()]
    assert found == [('{"text":"a"}', "none", None), (None, None, '{"prompt": '), (None, None, None)]
