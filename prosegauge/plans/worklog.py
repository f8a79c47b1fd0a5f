"""Costly work dealt once into slices, and a manifest of the slices that are done.

A job that calls a paid service must neither read all its rows again for every commit nor lose much when it is
killed. So its rows are written once, in a folder per slice, and each commit reads the folders of its
slices and no others. What a commit takes follows from how long the last one took, so that fast work has few commits and
slow work has one per slice.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prosegauge.session import mark, names

#: Slices that work is dealt into at most: folders, and commits of a run.
MAX_SLICES = 1000
#: How many times as much as the last one a commit may take.
GROWTH = 100
SLICE, GENERATION = "slice", "generation"


def _stretches(numbers: Sequence[int]) -> list[tuple[int, int]]:
    """First and last of each run of consecutive numbers."""
    starts = [n for i, n in enumerate(numbers) if not i or numbers[i - 1] != n - 1]
    ends = [n for i, n in enumerate(numbers) if i + 1 == len(numbers) or numbers[i + 1] != n + 1]
    return list(zip(starts, ends, strict=True))


class WorkLog:
    """Work at ``path``: rows by generation and slice; as names of empty files the generations dealt and the slices done.

    A slice has about ``slice_rows`` rows, more only where the work would have over ``MAX_SLICES`` of them.
    A commit takes as many slices as were worked off in ``seconds`` at the pace of the commit before, one at least. Rows of
    equal ``keys`` are in one slice.
    """

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        slice_rows: int,
        seconds: float = 60.0,
        clock: Callable[[], float] = time.monotonic,
    ) -> None:
        self.spark, self.path, self.slice_rows, self.seconds, self.clock = spark, path.rstrip("/"), slice_rows, seconds, clock
        self._size = 1

    def _last(self) -> tuple[int, int] | None:
        """The last generation and its number of slices."""
        dealt = (name.split("-") for name in names(self.spark, f"{self.path}/dealt"))
        return max(((int(generation), int(slices)) for generation, slices in dealt), default=None)

    def _rows(self, generation: int, schema: T.StructType | None = None) -> DataFrame:
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        return reader.parquet(f"{self.path}/rows/{GENERATION}={generation}")

    def _waiting(self) -> tuple[int, list[int]]:
        """The last generation, and those of its slices that are not done."""
        last = self._last()
        if last is None:
            return 0, []
        generation, slices = last
        done = (name.split("-") for name in names(self.spark, f"{self.path}/done/{generation}"))
        known = {n for first, end in done for n in range(int(first), int(end) + 1)}
        return generation, [n for n in range(slices) if n not in known]

    def unfinished(self) -> DataFrame | None:
        """Rows that a run before dealt and did not finish; None if there are none."""
        generation, waiting = self._waiting()
        return self._rows(generation).where(F.col(SLICE).isin(waiting)).drop(SLICE) if waiting else None

    def deal(self, rows: DataFrame, keys: Sequence[str]) -> int:
        """Write ``rows``, a stored table, as a new generation: how many rows they are."""
        n, last = rows.count(), self._last()
        if not n:
            return 0
        generation = last[0] + 1 if last else 0
        slices = min(MAX_SLICES, max(1, -(-n // self.slice_rows)))
        number = F.pmod(F.xxhash64(*keys), F.lit(slices)).cast("int")
        tasks = min(slices, 2 * self.spark.sparkContext.defaultParallelism)
        dealt = rows.withColumn(SLICE, number).repartition(tasks, SLICE)
        dealt.write.mode("overwrite").partitionBy(SLICE).parquet(f"{self.path}/rows/{GENERATION}={generation}")
        self._schema = dealt.schema
        mark(self.spark, f"{self.path}/dealt/{generation}-{slices}")
        return n

    def commits(self) -> Iterator[DataFrame]:
        """The rows of what was dealt last, a commit at a time; a commit counts as done when the next is asked for."""
        generation, waiting = self._waiting()
        # folders are listed once
        rows = self._rows(generation, self._schema) if waiting else None
        while waiting:
            some, waiting = waiting[: self._size], waiting[self._size :]
            begun = self.clock()
            yield rows.where(F.col(SLICE).isin(some)).drop(SLICE)
            for first, end in _stretches(some):
                mark(self.spark, f"{self.path}/done/{generation}/{first}-{end}")
            took = max(self.clock() - begun, 0.001)
            self._size = max(1, int(len(some) * min(self.seconds / took, GROWTH)))
