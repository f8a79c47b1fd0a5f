"""Seeded orders and scores from md5, equal on any engine and any partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seeded_digest(seed: int, key: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))


def digest_rank(digest: Column) -> Column:
    """The first 60 bits of a hex digest as a non-negative long."""
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def digest_share(digest: Column) -> Column:
    """The first 32 bits of a hex digest as a number from 0 to 1."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967295.0)


def text_key(*texts: Column) -> Column:
    """Short identity of one text, or of several together, for joins; null has one of its own."""
    digests = [F.coalesce(F.sha2(text.cast("string"), 256), F.lit("null")) for text in texts]
    return digests[0] if len(digests) == 1 else F.sha2(F.concat_ws("|", *digests), 256)
