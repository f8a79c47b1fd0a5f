"""Exact first-n, seeded samples and equal-sized groups without sorting the groups.

A group may hold a third of all rows, so it is never sorted in one task. The cut-off
of a group - the order value of its n-th row - is found by counting: each pass counts
the rows per slice of the value range still in question and keeps the one slice that
holds the n-th row, until few rows are left. Counting passes read the order and group
columns alone, combine before the shuffle and return one row per group. The taking
itself is then a filter, with neither shuffle nor sort, and reaches the scan.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_, or_
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from prosegauge.config import EDGES, LABELS
from prosegauge.functions.ranks import digest_rank, seeded_digest
from prosegauge.operators.split import bucketize
from prosegauge.session import stored

SLICES = 1024
SETTLE_ROWS = 100_000
MAX_GROUPS = 1_000
FILTER_GROUPS = 32

Quota = int | Mapping[tuple, int]


class Span(NamedTuple):
    """Rows of a group, bounds of their ranks, and rows without a rank."""

    n: int
    low: int
    high: int
    nulls: int = 0


class SourceOrder:
    """Order of a unique long column."""

    def __init__(self, name: str) -> None:
        self.rank = self.place = F.col(name).cast("bigint")
        self.span = [F.min(self.rank).alias("low"), F.max(self.rank).alias("high")]

    def first(self, rank: int) -> int:
        return rank

    last = first


class SeededOrder:
    """Order of the md5 of a seed and a unique key; its first 60 bits rank it."""

    def __init__(self, seed: int, key: str) -> None:
        self.place = seeded_digest(seed, F.col(key))
        self.rank = digest_rank(self.place)
        self.span = [F.lit(0).alias("low"), F.lit((1 << 60) - 1).alias("high")]

    def first(self, rank: int) -> str:
        return f"{rank:015x}"

    def last(self, rank: int) -> str:
        return f"{rank:015x}g"  # g comes after all hex digits


Order = SourceOrder | SeededOrder


def group_spans(
    df: DataFrame, keys: Sequence[str], order: Order, most: int | None = None
) -> tuple[dict[tuple, Span], bool]:
    """The spans of the groups in one pass, and whether these are all: no more than ``most`` are collected."""
    most = MAX_GROUPS if most is None else most
    groups, names = _group_columns(keys)
    spans = df.groupBy(*[g.alias(n) for g, n in zip(groups, names)]).agg(
        F.count("*").alias("n"), *order.span, F.count_if(order.rank.isNull()).alias("nulls")
    )
    rows = spans.orderBy(F.desc("n")).limit(most + 1).collect()
    largest = {tuple(row[n] for n in names): Span(row.n, row.low, row.high, row.nulls) for row in rows[:most]}
    return largest, len(rows) <= most


def _group_columns(keys: Sequence[str]) -> tuple[list[Column], list[str]]:
    return [F.col(key) for key in keys] or [F.lit(0)], [f"_k{i}" for i in range(max(1, len(keys)))]


def take_first(
    df: DataFrame,
    keys: Sequence[str],
    order: Order,
    quota: Quota,
    spans: Mapping[tuple, Span] | None = None,
    slices: int = SLICES,
    settle_rows: int = SETTLE_ROWS,
) -> DataFrame:
    """The rows of each group that come first in ``order``, ``quota`` of them.

    ``quota`` is one number or one per group; groups it does not name give no row.
    ``spans`` saves the first pass where sizes and bounds are known. ``df`` must give the
    same rows each time it is read. With more than ``MAX_GROUPS`` groups the searches are a
    table of their own instead of filters; the rows taken are the same. A null
    order value anywhere in a group that is cut is an error, and so is one repeated at the cut.
    """
    if spans is None:
        spans, complete = group_spans(df, keys, order)
        if not complete:
            return _take_from_many(df, keys, order, quota, slices, settle_rows)
    groups, names = _group_columns(keys)
    slim = df.select(*[g.alias(n) for g, n in zip(groups, names)], order.rank.alias("_rank"), order.place.alias("_place"))
    whole, cuts, searches = [], {}, {}
    for group, span in spans.items():
        wanted = quota if isinstance(quota, int) else quota.get(group, 0)
        if wanted >= span.n:
            whole.append(group)
        elif wanted > 0:
            if span.nulls:
                raise ValueError("the order holds nulls")
            searches[group] = _Search(span.low, span.high, span.n, wanted, True)

    while wide := {g: s for g, s in searches.items() if s.rows > settle_rows}:
        stuck = [g for g, s in wide.items() if s.low == s.high]
        if stuck:
            raise ValueError(f"the order does not tell the rows of {stuck[0]} apart")
        searches.update(_all_found(_narrow(slim, names, order, wide, slices), wide))
    if searches:
        cuts = _all_found(_settle(slim, names, order, searches), searches)
    return _filtered(df, groups, names, slim, order, whole, cuts)


def _all_found(found: dict, sought: dict) -> dict:
    if len(found) < len(sought):
        raise ValueError("the order holds nulls, or the rows changed between two readings")
    return found


class _Search(NamedTuple):
    """Ranks still in question in a group: their rows, which of them is the last one
    wanted, and whether they are all the group has."""

    low: int
    high: int
    rows: int
    nth: int
    all: bool


def _same(groups: list[Column], names: list[str]) -> Column:
    return reduce(and_, [g.eqNullSafe(F.col(n)) for g, n in zip(groups, names)])


def _is_group(names: Sequence, group: tuple) -> Column:
    return reduce(and_, [(F.col(n) if isinstance(n, str) else n).eqNullSafe(F.lit(v)) for n, v in zip(names, group)])


def _group_frame(slim: DataFrame, names: list[str], rows: list, more: str) -> DataFrame:
    """Driver-side facts as a frame, one row for each of ``MAX_GROUPS`` groups at most."""
    shape = ", ".join(f"{n} {slim.schema[n].dataType.simpleString()}" for n in names)
    return slim.sparkSession.createDataFrame(rows, shape + more)


def _within(slim: DataFrame, names: list[str], order: Order, searches: Mapping[tuple, _Search], slices: int) -> DataFrame:
    """The rows in question, with what is sought in their group."""
    place = F.col("_place")
    width = {g: max(1, -(-(s.high - s.low + 1) // slices)) for g, s in searches.items()}
    if len(searches) > FILTER_GROUPS:
        rows = [(*g, order.first(s.low), order.last(s.high), s.nth, width[g]) for g, s in searches.items()]
        kind = slim.schema["_place"].dataType.simpleString()
        frame = _group_frame(slim, names, rows, f", low {kind}, high {kind}, nth bigint, width bigint")
        frame = frame.withColumnsRenamed({n: f"s{n}" for n in names})
        same = _same([F.col(n) for n in names], [f"s{n}" for n in names])
        return slim.join(F.broadcast(frame), same & place.between(F.col("low"), F.col("high")))
    # few groups: plain tests, which reach the scan
    tests = []
    for group, s in searches.items():
        near = place.isNotNull() if s.all else place.between(order.first(s.low), order.last(s.high))
        tests.append(_is_group(names, group) & near)
    chosen = lambda facts: F.coalesce(*[F.when(_is_group(names, g), F.lit(v).cast("bigint")) for g, v in facts.items()])
    sought = {"nth": chosen({g: s.nth for g, s in searches.items()}), "width": chosen(width)}
    return slim.where(reduce(or_, tests)).withColumns(sought)


def _narrow(
    slim: DataFrame, names: list[str], order: Order, searches: dict[tuple, _Search], slices: int
) -> dict[tuple, _Search]:
    """Count the rows per slice of the ranks in question and keep the slice with the n-th row."""
    slice_no = F.expr("(_rank - pmod(_rank, width)) div width")
    counts = (
        _within(slim, names, order, searches, slices)
        .groupBy(*names, slice_no.alias("slice"), "nth", "width")
        .agg(F.count("*").alias("n"))
    )
    upto = Window.partitionBy(*names).orderBy("slice")
    found = (
        counts.withColumn("upto", F.sum("n").over(upto))
        .where((F.col("upto") >= F.col("nth")) & (F.col("upto") - F.col("n") < F.col("nth")))
        .collect()
    )
    result = {}
    for row in found:
        group, start = tuple(row[n] for n in names), row.slice * row.width
        low, high = max(searches[group].low, start), min(searches[group].high, start + row.width - 1)
        result[group] = _Search(low, high, row.n, row.nth - (row.upto - row.n), False)
    return result


def _settle(slim: DataFrame, names: list[str], order: Order, searches: dict[tuple, _Search]) -> dict[tuple, Any]:
    """The place of the last row wanted, out of the few rows left in question."""
    sorted_rows = Window.partitionBy(*names).orderBy("_place")
    numbered = _within(slim, names, order, searches, 1).withColumns(
        {"number": F.row_number().over(sorted_rows), "after": F.lead("_place").over(sorted_rows)}
    )
    cuts = {}
    for row in numbered.where("number = nth").collect():
        if row.after == row["_place"]:
            raise ValueError("the order does not tell all rows apart")
        cuts[tuple(row[n] for n in names)] = row["_place"]
    return cuts


def _filtered(
    df: DataFrame, groups: list[Column], names: list[str], slim: DataFrame, order: Order, whole: list, cuts: dict
) -> DataFrame:
    """The rows of whole groups, and of cut ones those up to the cut."""
    if not whole and not cuts:
        return df.where(F.lit(False))
    if len(whole) + len(cuts) <= FILTER_GROUPS:
        tests = [_is_group(groups, group) for group in whole]
        tests += [_is_group(groups, group) & (order.place <= F.lit(cut)) for group, cut in cuts.items()]
        return df.where(reduce(or_, tests))
    rows = [(*g, None) for g in whole] + [(*g, cut) for g, cut in cuts.items()]
    frame = _group_frame(slim, names, rows, f", _cut {slim.schema['_place'].dataType.simpleString()}")
    test = F.col("_cut").isNull() | (order.place <= F.col("_cut"))
    return df.join(F.broadcast(frame), _same(groups, names) & test).select(*df.columns)


def _with_quota(groups: DataFrame, names: list[str], quota: Quota | DataFrame) -> DataFrame:
    """``groups`` with the rows wanted of each, as ``_wanted``."""
    if isinstance(quota, int):
        return groups.withColumn("_wanted", F.lit(quota).cast("bigint"))
    if not isinstance(quota, DataFrame):
        quota = _group_frame(groups, names, [(*g, n) for g, n in quota.items()], ", _wanted bigint")
    quota = quota.withColumnsRenamed({n: f"q{n}" for n in names})
    return groups.join(quota, _same([F.col(n) for n in names], [f"q{n}" for n in names])).drop(*[f"q{n}" for n in names])


def _take_from_many(
    df: DataFrame, keys: Sequence[str], order: Order, quota: Quota | DataFrame, slices: int, settle_rows: int
) -> DataFrame:
    """As ``take_first``, for any number of groups: sizes, searches and cuts are tables joined on the group.

    ``quota`` may be a frame of the group columns and ``_wanted``. A counting pass holds at
    most ``slices`` + 1 rows of a group, and only the last ``settle_rows`` of a group are sorted.
    """
    groups, names = _group_columns(keys)
    slim = df.select(*[g.alias(n) for g, n in zip(groups, names)], order.rank.alias("_rank"), order.place.alias("_place"))
    sizes = df.groupBy(*[g.alias(n) for g, n in zip(groups, names)]).agg(F.count("*").alias("n"), *order.span)
    wanted = stored(_with_quota(sizes, names, quota).where("_wanted > 0"), "wanted")
    sought = wanted.where("_wanted < n").selectExpr(
        *names, "cast(low as bigint) as low", "cast(high as bigint) as high", "n as rows", "_wanted as nth"
    )
    searches, pass_no = stored(sought, "searches"), 0
    total = searches.count()

    def near(some: DataFrame) -> DataFrame:
        """Rows in question beside what is sought in their group; nulls are looked for in the first pass."""
        other = some.withColumnsRenamed({n: f"s{n}" for n in names})
        same = _same([F.col(n) for n in names], [f"s{n}" for n in names])
        within = F.col("_rank").between(F.col("low"), F.col("high"))
        return slim.join(other, same & within)

    def all_found(found: DataFrame, expected: int) -> DataFrame:
        if found.count() < expected:
            raise ValueError("the order holds nulls, or the rows changed between two readings")
        return found

    if total and slim.where("_rank is null").join(
        searches.withColumnsRenamed({n: f"s{n}" for n in names}),
        _same([F.col(n) for n in names], [f"s{n}" for n in names]),
        "left_semi",
    ).limit(1).count():
        raise ValueError("the order holds nulls")
    while not (wide := searches.where(F.col("rows") > settle_rows)).isEmpty():
        if not wide.where("low = high").isEmpty():
            raise ValueError("the order does not tell all rows apart")
        # in halves, so that no difference of two longs overflows
        wide = wide.withColumn("width", F.expr(f"high div {slices} - low div {slices} + 1"))
        slice_no = F.expr("_rank div width - cast(_rank < 0 and _rank % width <> 0 as int)")
        counts = near(wide).groupBy(*names, slice_no.alias("slice"), "nth", "width", "low", "high").agg(F.count("*").alias("rows"))
        upto = F.sum("rows").over(Window.partitionBy(*names).orderBy("slice"))
        found = counts.withColumn("upto", upto).where("upto >= nth and upto - rows < nth")
        start = F.expr("coalesce(try_multiply(slice, width), low)")
        end = F.expr("coalesce(try_add(try_multiply(slice, width), width - 1), high)")
        narrowed = found.select(
            *names,
            F.greatest("low", start).alias("low"),
            F.least("high", end).alias("high"),
            "rows",
            F.expr("nth - (upto - rows)").alias("nth"),
        )
        narrow = searches.where(F.col("rows") <= settle_rows)
        searches = all_found(stored(narrow.unionByName(narrowed), "searches"), total)
    sorted_rows = Window.partitionBy(*names).orderBy("_place")
    numbered = near(searches).withColumns(
        {"number": F.row_number().over(sorted_rows), "after": F.lead("_place").over(sorted_rows)}
    )
    cuts = all_found(stored(numbered.where("number = nth").select(*names, "_place", "after"), "cuts"), total)
    if not cuts.where("after = _place").isEmpty():
        raise ValueError("the order does not tell all rows apart")
    kind = slim.schema["_place"].dataType
    whole = wanted.where("_wanted >= n").select(*names, F.lit(None).cast(kind).alias("_cut"))
    limits = cuts.select(*names, F.col("_place").alias("_cut")).unionByName(whole)
    limits = limits.withColumnsRenamed({n: f"c{n}" for n in names})
    test = F.col("_cut").isNull() | (order.place <= F.col("_cut"))
    return df.join(limits, _same(groups, [f"c{n}" for n in names]) & test).select(*df.columns)


def head_per_group(df: DataFrame, keys: Sequence[str], order: str, n: Quota, **tuning: int) -> DataFrame:
    """The first ``n`` rows of each group in source order; ``order`` is a unique long."""
    return take_first(df, keys, SourceOrder(order), n, **tuning)


def sample_exact(
    df: DataFrame, n: Quota, seed: int = 42, key: str = "row_id", groups: Sequence[str] = (), **tuning: int
) -> DataFrame:
    """Exactly ``n`` rows (per group), without replacement, the same for any partitioning.

    Rows are taken in the order of the md5 of seed and ``key``, which must be unique.
    """
    return take_first(df, groups, SeededOrder(seed, key), n, **tuning)


def balance_classes(df: DataFrame, name: str, order: str, classes: Sequence = (0, 1), **tuning: int) -> DataFrame:
    """Cut every class to the size of the smallest, in source order."""
    rows, source = df.where(F.col(name).isin(list(classes))), SourceOrder(order)
    spans, _ = group_spans(rows, [name], source, len(classes))
    smallest = min(spans[(c,)].n if (c,) in spans else 0 for c in classes)
    return take_first(rows, [name], source, smallest, spans, **tuning)


def equalize_ranges(
    df: DataFrame,
    score: str,
    order: str,
    edges: Sequence[float] = EDGES,
    labels: Sequence[str] = LABELS,
    size: int = 0,
    seed: int = 42,
    label: str = "toxicity_bin",
    **tuning: int,
) -> DataFrame:
    """Rows by score range, all ranges of one size.

    Each range keeps its first ``size`` rows in source order (all for 0). Where some
    range is smaller, the larger ones are cut to its size by a seeded sample of the
    rows they kept. An empty range therefore empties all.
    """
    binned = df.withColumn(label, bucketize(F.col(score), edges, labels))
    binned = binned.where(F.col(label).isNotNull())
    source, drawn = SourceOrder(order), SeededOrder(seed, order)
    spans, _ = group_spans(binned, [label], source, len(labels))
    sizes = {(name,): spans[(name,)].n if (name,) in spans else 0 for name in labels}
    headed = binned
    if size and max(sizes.values()) > size:
        headed = take_first(binned, [label], source, size, spans, **tuning)
        sizes = {group: min(n, size) for group, n in sizes.items()}
    common = min(sizes.values())
    if common == max(sizes.values()):
        return headed
    if common == 0:
        return headed.where(F.lit(False))
    nulls = {group: spans[group].nulls for group in sizes}  # none is empty here
    known = {group: Span(n, 0, (1 << 60) - 1, nulls[group]) for group, n in sizes.items()}
    return take_first(headed, [label], drawn, common, known, **tuning)


def take_quota(
    pending: DataFrame,
    order: str,
    quota: int,
    done: DataFrame,
    keys: Sequence[str] = ("model", "label"),
    prompt: str = "prompt",
    **tuning: int,
) -> DataFrame:
    """Of each group's pending rows the first that its quota still allows.

    ``quota`` counts distinct prompts already done; 0 means no limit.
    """
    if quota == 0:
        return pending
    groups, names = _group_columns(keys)
    named = [g.alias(n) for g, n in zip(groups, names)]
    used = done.groupBy(*named).agg(F.countDistinct(prompt).alias("used"))
    left = F.greatest(F.lit(0), F.lit(quota) - F.coalesce("used", F.lit(0))).cast("bigint")
    present = pending.select(*named).distinct()
    same = _same([F.col(n) for n in names], [f"u{n}" for n in names])
    quotas = present.join(used.withColumnsRenamed({n: f"u{n}" for n in names}), same, "left").select(
        *names, left.alias("_wanted")
    )
    few = quotas.limit(MAX_GROUPS + 1).collect()
    if len(few) > MAX_GROUPS:
        tuned = {"slices": SLICES, "settle_rows": SETTLE_ROWS} | tuning
        return _take_from_many(pending, keys, SourceOrder(order), quotas, **tuned)
    known = {tuple(row[n] for n in names): row["_wanted"] for row in few}
    return head_per_group(pending, keys, order, known, **tuning)
