"""Time the headline queries: one JSON line with seconds per query."""

import json
import os
import statistics
import tempfile
import time

from prosegauge.queries import QUERIES
from prosegauge.session import session

HEADLINES = (
    "balanced_corpus",
    "equalize_ranges",
    "sample_exact",
    "clean_text",
    "clean_response",
    "chunk_each",
    "chunk_corpus",
    "build_vocab",
    "tokenize_pad",
    "training_rows",
    "flatten_struct",
    "pending_prompts",
    "score_attributes",
    "collect_responses",
    "generate_responses",
    "prompt_tables",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINES)).split(",")
    spark = session(
        "bench",
        **{
            "spark.master": f"local[{cores}]",
            "spark.sql.shuffle.partitions": cores,
            "spark.driver.memory": "12g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="run-", dir="/tmp"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        taken = []
        for run in range(runs + 1):  # the first one warms up
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            if run:
                taken.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(taken), 3)
    total = round(sum(seconds.values()), 3)
    print(
        json.dumps(
            {
                "metric": "sum of median seconds of the headline queries",
                "value": total,
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
