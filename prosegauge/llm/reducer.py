"""Leave out, before a shuffle, most rows that a join would drop: a bit map of the other side's keys.

The map has ``BITS`` bits, whatever the data, so it may be sent to every task. A key that is there is never left
out; of others a share passes that grows with the number of keys. So the join's result is the same, and with
very many keys only the saving is less.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from prosegauge.llm.workers import trimmed

BITS, CHUNK_BITS = 1 << 26, 16
CHUNK_BYTES = (1 << CHUNK_BITS) // 8


def _bit(key: str) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(17)), F.lit(BITS))


@trimmed
def _chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The bit map's chunks that a task has all keys of."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        bits = np.unique(batch["bit"].to_numpy(np.int64))
        chunk, rest = bits >> CHUNK_BITS, bits & ((1 << CHUNK_BITS) - 1)
        for number in np.unique(chunk):
            some = rest[chunk == number]
            np.bitwise_or.at(held.setdefault(int(number), np.zeros(CHUNK_BYTES, np.uint8)), some >> 3, np.uint8(1) << (some & 7).astype(np.uint8))
    yield pd.DataFrame({"chunk": list(held), "bits": [x.tobytes() for x in held.values()]}).astype({"chunk": "int64"})


def reduced(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """``rows`` without most of those whose ``key``, a long, is not in ``keys``; rows with a null key go too."""
    return divided(rows, key, keys)[0]


def divided(rows: DataFrame, key: str, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows that may have their ``key``, a long, among ``keys``, and those that have not.

    ``keys`` is a stored table. The driver gets the map in chunks, ``BITS`` bits at most.
    """
    key = f"`{key}`"
    bits = keys.where(f"{key} is not null").select(_bit(key).alias("bit")).repartition(F.shiftright("bit", CHUNK_BITS))
    held = np.zeros(BITS // 8, np.uint8)
    for number, chunk in bits.mapInPandas(_chunks, "chunk long, bits binary").collect():
        held[number * CHUNK_BYTES : (number + 1) * CHUNK_BYTES] |= np.frombuffer(chunk, np.uint8)
    shared = rows.sparkSession.sparkContext.broadcast(held)

    @F.pandas_udf(BooleanType())
    @trimmed
    def known(bits: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in bits:
            at = batch.to_numpy(np.int64)
            yield pd.Series((shared.value[at >> 3] >> (at & 7).astype(np.uint8)) & np.uint8(1) == 1)

    there = rows.where(f"{key} is not null")
    return there.where(known(_bit(key))), rows.where(f"{key} is null").unionByName(there.where(~known(_bit(key))))
