import pytest
from pyspark.sql import functions as F

from prosegauge.sources import readers, versions, writers


def rows(spark, *texts, model=None):
    frame = spark.createDataFrame([("p", text, label) for label, text in texts], "prompt string, continuation string, label string")
    frame = frame.withColumn("collected_at", F.lit(None).cast("timestamp"))
    return frame.withColumn("model", F.lit(model)) if model else frame


def contents(spark, path):
    return sorted((r.model, r.label, r.continuation) for r in readers.read_responses(spark, path).collect())


def test_a_model_is_replaced_as_a_whole(spark, tmp_path):
    path = str(tmp_path / "responses")
    versions.replace_model(rows(spark, ("x", "old"), ("y", "old")), path, "m 1/2=é")
    versions.replace_model(rows(spark, ("x", "n")), path, "n")
    versions.replace_model(rows(spark, ("x", "new")), path, "m 1/2=é")
    assert contents(spark, path) == [("m 1/2=é", "x", "new"), ("n", "x", "n")]
    assert versions.drop_superseded(spark, path) == 1 and versions.drop_superseded(spark, path) == 0
    assert contents(spark, path) == [("m 1/2=é", "x", "new"), ("n", "x", "n")]


def test_a_failed_run_leaves_what_was_there(spark, tmp_path):
    path = str(tmp_path / "responses")
    versions.replace_model(rows(spark, ("x", "old")), path, "m")
    broken = rows(spark, ("x", "a"), ("y", "b")).withColumn(
        "continuation", F.when(F.col("label") == "y", F.raise_error(F.lit("lost"))).otherwise(F.col("continuation"))
    )
    with pytest.raises(Exception, match="lost"):
        versions.replace_model(broken, path, "m")
    assert contents(spark, path) == [("m", "x", "old")]


def test_versions_beside_plain_rows(spark, tmp_path):
    """Rows of the table give way to a version; later rows are added to it, also where a range is replaced."""
    path = str(tmp_path / "responses")
    writers.write_responses(rows(spark, ("x", "old"), ("y", "old"), model="m"), path)
    writers.write_responses(rows(spark, ("x", "other"), model="o"), path)
    versions.replace_model(rows(spark, ("x", "new")), path, "m")
    assert contents(spark, path) == [("m", "x", "new"), ("o", "x", "other")]
    both = rows(spark, ("x", "more"), model="m").unionByName(rows(spark, ("x", "more"), model="o"))
    writers.append_responses(both.drop("collected_at"), path)
    assert contents(spark, path) == [("m", "x", "more"), ("m", "x", "new"), ("o", "x", "more"), ("o", "x", "other")]
    writers.write_responses(rows(spark, ("x", "last"), model="m"), path)
    assert contents(spark, path) == [("m", "x", "last"), ("o", "x", "more"), ("o", "x", "other")]


def test_a_model_without_any_results(spark, tmp_path):
    path = str(tmp_path / "responses")
    with pytest.raises(FileNotFoundError):
        readers.read_responses(spark, path)
    versions.replace_model(rows(spark, ("x", "old")), path, "m")
    versions.replace_model(rows(spark, ("x", "n")), path, "n")
    versions.replace_model(rows(spark, ("x", "old")).where("false"), path, "m")
    assert contents(spark, path) == [("n", "x", "n")]
    versions.replace_model(rows(spark, ("x", "old")).where("false"), path, "n")
    assert contents(spark, path) == []
