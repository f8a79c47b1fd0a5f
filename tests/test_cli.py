import json

import pytest

from prosegauge.__main__ import main

PLUGINS = """
from prosegauge.config import ATTRS
from prosegauge.operators.enrich import Reply

class Letters:
    def encode(self, text):
        return [ord(c) for c in text]
    def decode(self, ids):
        return "".join(map(chr, ids))

def model(banned=None):
    return lambda prompts: [f"{p} and {banned}" for p in prompts]

def chat():
    return lambda prompts: [f"{p} well" for p in prompts]

def scorer():
    return lambda texts: [Reply(200, dict.fromkeys(ATTRS, 0.5)) for _ in texts]
"""


def test_commands_in_a_row(spark, tmp_path, monkeypatch):
    (tmp_path / "plugins_of_test.py").write_text(PLUGINS)
    monkeypatch.syspath_prepend(str(tmp_path))
    spark.sparkContext.addPyFile(str(tmp_path / "plugins_of_test.py"))
    lines = [
        {"prompt": {"text": f"p{i}", "toxicity": i / 20}, "continuation": {"text": f"c{i}", "toxicity": i / 20}}
        for i in range(20)
    ]
    (tmp_path / "pairs.jsonl").write_text("\n".join(map(json.dumps, lines)))
    (tmp_path / "words.txt").write_text("no\n")
    at = {n: str(tmp_path / n) for n in ("made", "responses", "rows", "scored")}
    main(["prompts", str(tmp_path / "pairs.jsonl"), at["made"], "--size", "3"])
    ranges = at["made"] + "/ranges"
    assert spark.read.parquet(ranges).count() == 12
    main(["generate", ranges, at["responses"], "--model", "M=plugins_of_test:model"])
    main(
        ["generate", ranges, at["responses"], "--model", "M=plugins_of_test:model", "--variant", "BW"]
        + ["--banned", str(tmp_path / "words.txt"), "--tokenizer", "plugins_of_test:Letters"]
    )
    main(["collect", ranges, at["responses"], "--model", "C=plugins_of_test:chat", "--quota", "2"])
    main(["training-rows", at["made"] + "/corpus", at["rows"], "--tokenizer", "plugins_of_test:Letters"])
    main(["score", at["scored"], "--responses", at["responses"], "--scorer", "plugins_of_test:scorer", "--interval", "0"])
    scored = spark.read.parquet(at["scored"])
    counts = {r.model: r["count"] for r in scored.groupBy("model").count().collect()}
    assert counts == {"M": 12, "M_BW": 12, "C": 8}
    assert scored.where("model = 'M_BW'").first().continuation == "and [[110, 111]]"
    assert spark.read.parquet(at["rows"] + "/rows").count() == 2
    with pytest.raises(SystemExit):
        main(["score", at["scored"], "--scorer", "plugins_of_test:scorer"])
