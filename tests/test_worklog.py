import pytest
from pyspark.sql import functions as F

from prosegauge.config import Config
from prosegauge.plans import worklog
from prosegauge.plans.responses import collect_responses
from prosegauge.plans.worklog import WorkLog


class Clock:
    def __init__(self):
        self.now = 0.0

    def __call__(self):
        return self.now


def work(spark, n):
    return spark.range(n).select(F.col("id").alias("row_id"), F.concat(F.lit("p"), "id").alias("prompt"))


def rows_read(df):
    """The rows of a frame, and how many its scan gave."""
    rows = df.collect()
    leaf = df._jdf.queryExecution().executedPlan().collectLeaves().head()
    return rows, leaf.metrics().apply("numOutputRows").value()


def test_every_row_is_read_once(spark, tmp_path):
    log, clock = None, Clock()
    log = WorkLog(spark, str(tmp_path / "work"), 10, seconds=8.0, clock=clock)
    assert log.unfinished() is None and log.deal(work(spark, 400), ["prompt"]) == 400
    seen, sizes, read = [], [], 0
    for part in log.commits():
        rows, scanned = rows_read(part)
        seen += [r.prompt for r in rows]
        read += scanned
        sizes.append(len(rows))
        clock.now += len(rows) / 10.0  # a slice a second
    assert sorted(seen) == sorted(f"p{i}" for i in range(400)) and read == 400
    # the first commit is one slice; the pace found then makes the others some eight
    assert sizes[0] < 30 and 4 <= len(sizes) <= 12
    assert log.unfinished() is None


def test_a_run_goes_on_with_the_slices_not_done(spark, tmp_path):
    path, clock = str(tmp_path / "work"), Clock()
    log, done = WorkLog(spark, path, 10, seconds=1.0, clock=clock), []
    log.deal(work(spark, 100), ["prompt"])
    for number, part in enumerate(log.commits()):
        if number == 3:
            break  # killed within the fourth commit
        done += [r.prompt for r in part.collect()]
        clock.now += 5.0
    left = [r.prompt for r in WorkLog(spark, path, 10).unfinished().collect()]
    assert sorted(done + left) == sorted(f"p{i}" for i in range(100)) and done and left
    # what is dealt anew replaces it
    log = WorkLog(spark, path, 10)
    assert log.deal(work(spark, 7), ["row_id"]) == 7 and log.unfinished().count() == 7
    assert [p.count() for p in log.commits()] == [7] and log.unfinished() is None


def test_slices_are_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(worklog, "MAX_SLICES", 4)
    log = WorkLog(spark, str(tmp_path / "work"), 1, seconds=0.0)
    log.deal(work(spark, 50), ["prompt"])
    sizes = [p.count() for p in log.commits()]
    assert len(sizes) == 4 and sum(sizes) == 50


@pytest.mark.parametrize("numbers, want", [([], []), ([3], [(3, 3)]), ([0, 1, 2, 5, 7, 8], [(0, 2), (5, 5), (7, 8)])])
def test_stretches(numbers, want):
    assert worklog._stretches(numbers) == want


class Counting:
    """Notes every call; fails the whole job once ``limit`` prompts were answered, if there is one."""

    def __init__(self, folder, limit=None):
        self.folder, self.limit = folder, limit

    def __call__(self):
        from pathlib import Path

        def reply(prompts):
            if self.limit and len(list(Path(self.folder).iterdir())) >= self.limit:
                raise SystemExit("killed")
            for p in prompts:
                with (Path(self.folder) / p).open("a") as out:
                    out.write("x")
            return [f"{p} and more." for p in prompts]

        return reply


def test_a_killed_collector_repeats_one_commit(spark, tmp_path):
    calls, path = tmp_path / "calls", str(tmp_path / "out")
    calls.mkdir()
    ranges = work(spark, 60).withColumn("toxicity_bin", F.lit("x"))
    config = Config(rounds=1, slice_rows=10, commit_seconds=0.0, concurrency=1, in_flight=1)
    with pytest.raises(BaseException, match="killed|exited|crashed|SystemExit|Job aborted|WORKER|failed"):
        collect_responses(ranges, path, "chat", Counting(str(calls), 35), config, quota=0, sleep=lambda s: None)
    first = {r.prompt for r in spark.read.parquet(path).collect()}
    assert 20 <= len(first) <= 35
    got = collect_responses(ranges, path, "chat", Counting(str(calls)), config, quota=0, sleep=lambda s: None)
    assert sorted(r.prompt for r in got.collect()) == sorted(f"p{i}" for i in range(60))
    asked = {p.name: len(p.read_text()) for p in calls.iterdir()}
    twice = [p for p, n in asked.items() if n > 1]
    assert len(asked) == 60 and len(twice) <= 20 and not first & set(twice)
