import os
import sys
from pathlib import Path

import pytest

HERE = Path(__file__).resolve().parent
sys.path.insert(0, str(HERE.parent))
# plug-ins of the tests are looked up by Python workers
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [str(HERE), os.environ.get("PYTHONPATH")]))

from prosegauge.session import session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    spark = session(
        "tests",
        **{
            "spark.master": "local[*]",
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "8g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    spark.stop()


@pytest.fixture
def column(spark):
    """Evaluate a column expression over rows of strings."""

    def run(build, rows, names):
        from pyspark.sql import functions as F

        frame = spark.createDataFrame(
            [(i, *(row if isinstance(row, tuple) else (row,))) for i, row in enumerate(rows)],
            "i int, " + ", ".join(f"{n} string" for n in names),
        )
        result = frame.select("i", build(*[F.col(n) for n in names]).alias("x"))
        return [row.x for row in sorted(result.collect())]

    return run


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()
