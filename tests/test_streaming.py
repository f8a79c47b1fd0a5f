import time
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from prosegauge.streaming import incremental, windows


def arrive(spark, path, prompts):
    spark.createDataFrame([(p,) for p in prompts], "prompt string").coalesce(1).write.mode("append").parquet(path)


def stream_of(spark, path):
    return spark.readStream.schema("prompt string").parquet(path)


def test_a_batch_reads_nothing_of_what_was_collected(spark, tmp_path):
    """Collected rows may even be gone: what was seen is state of the query."""
    source, out, marks = (str(tmp_path / n) for n in ("in", "out", "marks"))
    schema = spark.createDataFrame([], "prompt string, continuation string").schema
    asked = []

    def reply(fresh):
        asked.append(sorted(r.prompt for r in fresh.collect()))
        return fresh.select("prompt", F.upper("prompt").alias("continuation"))

    for batch in (["a", "b", "a"], ["b", "c"], ["a", "d"]):
        arrive(spark, source, batch)
        incremental.incremental_enrich(stream_of(spark, source), reply, schema, out, marks).awaitTermination()
        (tmp_path / "out" / f"batch_id={len(asked) - 1}").rename(tmp_path / f"moved-{len(asked)}")
        (tmp_path / "out" / "batch_id=0").mkdir(exist_ok=True)
    assert asked == [["a", "b"], ["c"], ["d"]]


def test_a_new_query_leaves_out_what_a_table_has(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = spark.createDataFrame([], "prompt string, continuation string").schema
    spark.createDataFrame([("a", "A")], schema).write.parquet(f"{out}/batch_id=7")
    arrive(spark, source, ["a", "b"])

    def reply(fresh):
        return fresh.select("prompt", F.lit("new").alias("continuation"))

    incremental.incremental_enrich(stream_of(spark, source), reply, schema, out, str(tmp_path / "marks")).awaitTermination()
    got = incremental.read_collected(spark, out, schema).collect()
    assert sorted((r.prompt, r.continuation) for r in got) == [("a", "A"), ("b", "new")]


def test_failed_prompts_are_tried_again_without_new_ones(spark, tmp_path):
    source, out, marks = (str(tmp_path / n) for n in ("in", "out", "marks"))
    schema = spark.createDataFrame([], "prompt string, continuation string").schema
    known, pauses = ["a"], []

    def reply(fresh):
        return fresh.select("prompt", F.when(fresh.prompt.isin(known), "ok").alias("continuation"))

    arrive(spark, source, ["a", "late", "never"])
    stream = stream_of(spark, source)
    incremental.incremental_enrich(stream, reply, schema, out, marks).awaitTermination()
    known.append("late")
    dead = incremental.retry_failed(spark, stream.schema, reply, schema, out, sleep=pauses.append)
    assert [(r.prompt, r.tries) for r in dead.collect()] == [("never", 3)] and pauses == [5.0, 5.0]
    assert sorted(r.prompt for r in incremental.read_collected(spark, out, schema).collect()) == ["a", "late"]
    # a query started again goes on from there, and the dead stay dead
    arrive(spark, source, ["b", "late", "never"])
    known.extend(["b", "never"])
    incremental.incremental_enrich(stream_of(spark, source), reply, schema, out, marks).awaitTermination()
    assert sorted(r.prompt for r in incremental.read_collected(spark, out, schema).collect()) == ["a", "b", "late"]


def test_a_running_query_tries_again_by_the_clock(spark, tmp_path):
    source, out, marks = (str(tmp_path / n) for n in ("in", "out", "marks"))
    schema = spark.createDataFrame([], "prompt string, continuation string").schema
    seen = []

    def reply(fresh):
        seen.append(sorted(r.prompt for r in fresh.collect()))
        done = ["a", "late"] if sum("late" in some for some in seen) > 1 else ["a"]
        return fresh.select("prompt", F.when(fresh.prompt.isin(done), "ok").alias("continuation"))

    arrive(spark, source, ["a", "late"])
    query = incremental.incremental_enrich(stream_of(spark, source), reply, schema, out, marks, every="2 seconds")
    try:
        end = time.monotonic() + 90
        while time.monotonic() < end and query.isActive:
            if sorted(r.prompt for r in incremental.read_collected(spark, out, schema).collect()) == ["a", "late"]:
                break
            time.sleep(1)
    finally:
        query.stop()
    assert sorted(r.prompt for r in incremental.read_collected(spark, out, schema).collect()) == ["a", "late"]
    assert sum("a" in some for some in seen) == 1


def test_windows_and_late_rows(spark, tmp_path):
    source, out, marks = (str(tmp_path / n) for n in ("in", "out", "marks"))
    start = datetime(2025, 1, 1)
    schema = "event_id long, kind string, at timestamp"
    batches = [
        [(1, "x", 5), (2, "x", 50), (3, "y", 70)],
        [(2, "x", 50), (4, "y", 130), (5, "x", 65)],  # one again; one before the latest, within the delay
        [(6, "x", 10), (7, "x", 200)],  # the first is behind 130 - 60 minutes
        [(8, "x", 600)],
    ]
    for batch in batches:
        rows = [(i, kind, start + timedelta(minutes=m)) for i, kind, m in batch]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        for query in windows.start_counts(stream, out, marks, "event_id", "at", by=["kind"]):
            query.awaitTermination()
    by = spark.createDataFrame([], "kind string").schema
    counts = windows.read_counts(spark, out, by).collect()
    found = sorted(((r.window_start - start).total_seconds() / 3600, r.kind, r.n_rows) for r in counts)
    assert found == [(0, "x", 2), (1, "x", 1), (1, "y", 1), (2, "y", 1), (3, "x", 1)]
    late = windows.read_late(spark, out, stream.schema).collect()
    assert [(r.event_id, r.batch_id, r.watermark) for r in late] == [(6, 2, start + timedelta(minutes=70))]


def test_no_rows_have_no_counts(spark, tmp_path):
    path = str(tmp_path)
    assert windows.read_counts(spark, path).count() == 0
    assert windows.read_late(spark, path, spark.createDataFrame([], "a int").schema).count() == 0
