import threading
import time
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
import pytest
from pyspark import SparkContext
from pyspark.sql import functions as F

from prosegauge.config import Pace, Retry
from prosegauge.operators import enrich

ATTRS = ("toxicity", "threat")
NO_WAIT = Retry(base=0.0)


def ok(value):
    return enrich.Reply(200, {"toxicity": value, "threat": value / 2})


class Busy:
    """Busy for each text the first ``times`` times."""

    def __init__(self, times):
        self.times, self.calls = times, []

    def __call__(self, texts):
        self.calls.append(list(texts))
        return [enrich.Reply(429) if "busy" in t and len(self.calls) <= self.times else ok(1.0) for t in texts]


@pytest.mark.parametrize("times, waits, status", [(0, [], 200), (1, [1], 200), (4, [1, 2, 4, 8], 200), (9, [1, 2, 4, 8], 429)])
def test_back_off(times, waits, status):
    slept, scorer = [], Busy(times)
    replies = enrich.ask(scorer, ["a", "busy", "b"], Retry(), slept.append)
    assert [r.status for r in replies] == [200, status, 200]
    assert slept == waits
    assert scorer.calls[1:] == [["busy"]] * min(times, 4)  # only the busy one is asked again


def by_word():
    def score(texts):
        words = {"bad": enrich.Reply(400), "busy": enrich.Reply(429), "broken": enrich.Reply(500)}
        assert len(set(texts)) == len(texts)
        return [words.get(t, None) or ok(float(len(t))) for t in texts]

    return score


@pytest.fixture
def texts(spark):
    rows = ["a", "bb", "a", None, "bad", "busy", "a", "ccc"]
    return spark.createDataFrame(list(enumerate(rows)), "row_id int, text string")


@pytest.mark.parametrize("hot_rows", [1, 1_000_000])
def test_scores(texts, hot_rows):
    old = texts.withColumn("toxicity", F.lit(9.0))
    got = enrich.score_attributes(old, "text", by_word, ATTRS, NO_WAIT, hot_rows=hot_rows)
    assert got.columns == ["row_id", "text", "status", *ATTRS]
    rows = {r.row_id: (r.status, r.toxicity, r.threat) for r in got.collect()}
    assert rows == {
        0: (200, 1.0, 0.5), 1: (200, 2.0, 1.0), 2: (200, 1.0, 0.5), 3: (None, None, None),
        4: (400, None, None), 5: (429, None, None), 6: (200, 1.0, 0.5), 7: (200, 3.0, 1.5),
    }


def test_other_status(spark):
    texts = spark.createDataFrame([("a",), ("broken",)], "text string")
    with pytest.raises(Exception, match="scorer replied 500"):
        enrich.score_attributes(texts, "text", by_word, ATTRS, NO_WAIT)
    kept = enrich.score_attributes(texts, "text", by_word, ATTRS, NO_WAIT, dead_letters=True)
    routes = {r.text: r.route for r in kept.select("text", enrich.status_route(F.col("status")).alias("route")).collect()}
    assert routes == {"a": "ok", "broken": "dead_letter"}


def test_pace(spark, tmp_path):
    log = str(tmp_path / "waits")

    def sleep(seconds):
        with open(log, "a") as out:
            out.write(f"{seconds}\n")

    texts = spark.createDataFrame([(str(i),) for i in range(6)], "text string")
    scored = enrich.score_attributes(texts, "text", by_word, ATTRS, NO_WAIT, Pace(0.5, 2), sleep=sleep)
    assert scored.count() == scored.count() == 6
    assert open(log).read().split() == ["1.0"] * 6  # one call per text, none for later actions


def test_done_rows_are_not_scored(spark):
    rows = [("m", "x", "p", "a"), ("m", "x", "p", "b"), ("m", "y", "p", "a"), ("m", "y", "p", None)]
    responses = spark.createDataFrame(rows, "model string, label string, prompt string, continuation string")
    done = responses.where("label = 'x' and continuation = 'a' or continuation is null")
    got = enrich.score_models(responses, by_word, done, attrs=ATTRS)
    assert sorted((r.label, r.continuation) for r in got.collect()) == [("x", "b"), ("y", "a")]


def several():
    return lambda prompts: [None if p == "none" else [p + "1", p + "2"] if p == "two" else p + "!" for p in prompts]


@pytest.mark.parametrize("batch_size, concurrency", [(1, None), (2, 3), (100, None)])
def test_enrich(spark, batch_size, concurrency):
    prompts = spark.createDataFrame([(i, p) for i, p in enumerate(["a", "two", "none", "b", "c"])], "row_id int, prompt string")
    got = enrich.enrich_text(prompts, several, batch_size=batch_size, concurrency=concurrency)
    want = [(0, "a", "a!"), (1, "two", "two1"), (1, "two", "two2"), (2, "none", None), (3, "b", "b!"), (4, "c", "c!")]
    assert sorted(map(tuple, got.collect()), key=repr) == want


class Clock:
    """Time that passes by sleeping."""

    def __init__(self, now=1000.0):
        self.now, self.calls = now, []

    def __call__(self):
        return self.now

    def sleep(self, seconds):
        self.now += seconds


def test_calls_own_slots():
    """Three lanes whose calls take any time: all calls together keep the interval, and no slot is used twice."""
    pace, used = Pace(0.5, 3, start=1000.0), []
    for lane, effort in enumerate((0.0, 0.7, 4.0)):
        clock = Clock()
        slots = enrich.Slots(pace, lane, clock, clock.sleep)
        for _ in range(6):
            used.append(slots.wait())
            assert clock.now >= used[-1]
            clock.now += effort
    assert len(set(used)) == len(used) and all(((t - 1000.0) / 0.5).is_integer() for t in used)
    used.sort()
    assert min(b - a for a, b in zip(used, used[1:])) >= 0.5


def test_a_task_run_again_keeps_the_rate():
    """The first run fails after three calls; the second takes later slots, and never one of before."""
    clock, calls = Clock(), []
    texts = [str(i) for i in range(6)]

    def broken():
        def score(some):
            calls.append(clock.now)
            if len(calls) == 4:
                raise RuntimeError("lost")
            return [ok(1.0) for _ in some]

        return score

    run = enrich._scoring(broken, ATTRS, Retry(), Pace(0.5, 2, start=1000.0), 64, False, clock.sleep, clock)
    batch = pd.DataFrame({"_key": texts, "_text": texts, "_rows": [1] * 6})
    with pytest.raises(RuntimeError):
        list(run(iter([batch])))
    assert len(list(run(iter([batch])))) == 1 and len(calls) == 10
    assert all(b - a >= 1.0 for a, b in zip(calls, calls[1:]))


def test_no_pace_with_speculation(texts, monkeypatch):
    monkeypatch.setattr(SparkContext, "getConf", lambda self: {"spark.speculation": "true"})
    with pytest.raises(ValueError, match="speculation"):
        enrich.score_attributes(texts, "text", by_word, ATTRS, NO_WAIT, Pace(0.5, 2))


@pytest.mark.parametrize("in_flight", [1, 4])
def test_results_in_order_and_calls_in_flight(in_flight):
    """Each call waits a while; some first ones are slowest, and as many run at a time as may."""
    lock, running, most = threading.Lock(), [0], [0]

    def call(part):
        with lock:
            running[0] += 1
            most[0] = max(most[0], running[0])
        time.sleep(0.08 if part % 4 == 0 else 0.02)
        with lock:
            running[0] -= 1
        return part

    with ThreadPoolExecutor(in_flight) as pool:
        got = list(enrich.in_order(call, iter(range(24)), in_flight, pool if in_flight > 1 else None))
    assert got == list(range(24)) and most[0] == in_flight


class Service:
    """Statuses by prompt; ``busy`` ones are OK when asked a third time, ``never`` ones never."""

    def __call__(self):
        asked = {}

        def reply(prompts):
            time.sleep(0.01)
            out = []
            for p in prompts:
                asked[p] = asked.get(p, 0) + 1
                if p == "raise":
                    raise OSError("no line")
                known = {"bad": enrich.Answer(400), "broken": enrich.Answer(503, "not a text"), "never": enrich.Answer(429)}
                if p in known:
                    out.append(known[p])
                elif p == "busy" and asked[p] < 3:
                    out.append(enrich.Answer(429))
                else:
                    out.append(enrich.Answer(200, [p + "1", p + "2"]) if p == "two" else None if p == "none" else p + "!")
            return out

        return reply


@pytest.mark.parametrize("in_flight, concurrency", [(1, 2), (3, 3), (4, 9)])
def test_status_of_every_reply(spark, in_flight, concurrency):
    names = ["a", "bad", "two", "busy", "raise", "never", "broken", "none", "b"]
    prompts = spark.createDataFrame(list(enumerate(names)), "row_id int, prompt string")
    got = enrich.enrich_text(
        prompts, Service(), batch_size=1, concurrency=concurrency, in_flight=in_flight, reason="reason", status="status",
        retry=Retry(attempts=3, base=0.01),
    )
    rows = got.withColumn("route", enrich.failure_route(F.col("status"), F.col("reason"))).collect()
    found = sorted((r.prompt, r.continuation, r.status, None if r.continuation else r.route) for r in rows)
    assert found == sorted(
        [("a", "a!", 200, None), ("b", "b!", 200, None), ("two", "two1", 200, None), ("two", "two2", 200, None)]
        + [("busy", "busy!", 200, None), ("bad", None, 400, "unsupported"), ("never", None, 429, "busy")]
        + [("broken", None, 503, "failed"), ("none", None, 200, "empty"), ("raise", None, None, "error")],
        key=lambda r: (r[0], r[1] or ""),
    )
    assert [r.reason for r in rows if r.prompt == "raise"] == ["OSError: no line"]
