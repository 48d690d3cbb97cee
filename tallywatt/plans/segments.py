"""Ordered work without one-task groups.

A window partitioned by a hot key puts that key's rows in one task. Here an
order column is cut into value ranges that hold about equal shares of *all*
rows, so (key, segment) groups stay below one share however skewed the keys
are. What a row needs from earlier segments (last reading, running range,
count) comes from a table with one row per key and segment.

The cut points only decide how work is spread; results do not depend on them.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, functions as F, types as T, Window as W

from tallywatt.session import shuffle_partitions

SEGMENT = "__seg"


def order_number(df: DataFrame, col: str) -> Column:
    """A double that sorts like the column (timestamps by microsecond)."""
    if isinstance(df.schema[col].dataType, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(F.col(col).cast("timestamp")).cast("double")
    return F.col(col).cast("double")


#: Groups of tasks whose sketches are merged before the last merge, and the
#: sketch's size parameter (a rank error of about 0.5 %).
SKETCH_GROUPS, SKETCH_K = 64, 400


def _quantile_points(df: DataFrame, cols: Sequence[str], parts: int) -> list[list[float]]:
    """Quantiles that cut each column into ``parts`` shares, from sketches of a
    fixed size: those of a group of tasks meet in one task, and so do the
    groups'. What the last task reads does not grow with the table."""
    if parts < 2:
        return [[] for _ in cols]
    numbers = [F.nanvl(order_number(df, c), F.lit(None)) for c in cols]
    sketches = df.groupBy(F.pmod(F.spark_partition_id(), F.lit(SKETCH_GROUPS)).alias("g")).agg(
        *[F.kll_sketch_agg_double(x, F.lit(SKETCH_K)).alias(f"s{i}") for i, x in enumerate(numbers)],
        *[F.count(x).alias(f"n{i}") for i, x in enumerate(numbers)])
    merged = sketches.agg(*[F.kll_merge_agg_double(F.when(F.col(f"n{i}") > 0, F.col(f"s{i}"))).alias(f"s{i}") for i in range(len(cols))],
                          *[F.sum(f"n{i}").alias(f"n{i}") for i in range(len(cols))])
    probs = F.array(*[F.lit(i / parts) for i in range(1, parts)])
    found = merged.select(*[F.when(F.col(f"n{i}") > 0, F.kll_sketch_get_quantile_double(f"s{i}", probs)) for i in range(len(cols))]).first()
    return [sorted(points or []) for points in found]


def segment_count(df: DataFrame, parts: int | None) -> int:
    return parts or 4 * shuffle_partitions(df.sparkSession)


def cut_points(df: DataFrame, cols: Sequence[str], parts: int | None = None) -> dict[str, list[float]]:
    """Approximate quantiles of each column: one pruned scan, small sketches."""
    found = _quantile_points(df, cols, segment_count(df, parts))
    return {c: sorted(set(points)) for c, points in zip(cols, found)}


def tied_cut_points(df: DataFrame, col: str, parts: int | None = None) -> tuple[list[float], list[int]]:
    """Cut points that give every value repeated among the quantiles a range
    of its own, and per range the number of tasks its rows deserve (1, or more
    for such a single-value range).
    """
    points = _quantile_points(df, [col], segment_count(df, parts))[0]
    repeats = Counter(points)
    heavy = {v for v, m in repeats.items() if m > 1}
    cuts = sorted(set(points) | {math.nextafter(v, math.inf) for v in heavy})
    # range i + 1 starts at cut i
    return cuts, [1, *[repeats[c] + 1 if c in heavy else 1 for c in cuts], 1]


class Ranges(NamedTuple):
    """Range i + 1 starts at ``cuts[i]``; ``single``: the ranges of one value."""

    cuts: list[float]
    single: list[float]


def value_ranges(df: DataFrame, cols: Sequence[str], parts: int | None = None) -> dict[str, Ranges]:
    """Ranges of each column from one scan; a value repeated among the
    quantiles has a range of its own, so that no other range holds many rows."""
    out = {}
    for c, points in zip(cols, _quantile_points(df, cols, segment_count(df, parts))):
        finite = Counter(p for p in points if math.isfinite(p))
        heavy = {v for v, m in finite.items() if m > 1}
        cuts = sorted(set(finite) | {math.nextafter(v, math.inf) for v in heavy})
        out[c] = Ranges(cuts, [float(i + 1) for i, v in enumerate(cuts) if v in heavy])
    return out


def add_segments(df: DataFrame, cuts: Mapping[str, Sequence[float]], names: Mapping[str, str]) -> DataFrame:
    """Add ``names[c]``, the index of the value range that holds ``c``."""
    for c, points in cuts.items():
        if not points:
            df = df.withColumn(names[c], F.lit(0.0))
            continue
        helper = f"__num_{names[c]}"
        splits = [float("-inf"), *points, float("inf")]
        buckets = Bucketizer(splits=splits, inputCol=helper, outputCol=names[c], handleInvalid="keep")
        df = buckets.transform(df.withColumn(helper, order_number(df, c))).drop(helper)
    return df


def segmented(df: DataFrame, order: str, parts: int | None = None) -> DataFrame:
    return add_segments(df, cut_points(df, [order], parts), {order: SEGMENT})


def with_history(df: DataFrame, keys: Sequence[str], order: str, last: Mapping[str, str] = {},
                 low: Mapping[str, str] = {}, high: Mapping[str, str] = {}, index: str | None = None,
                 parts: int | None = None, segment: Column | None = None, ties: Sequence[str] = (),
                 initial: DataFrame | None = None) -> DataFrame:
    """Add per-key history columns of the rows ordered by ``order``, then by
    the columns in ``ties``.

    ``last`` maps a column to the name of its previous value (null for the
    first row), ``low``/``high`` map a column to the name of its running
    minimum/maximum including the current row, ``index`` names a row number
    that counts from 0.

    ``segment`` replaces the measured cut points where the caller knows an
    even cut of the order column (a uniform hash).

    ``initial`` is the state of earlier rows (see ``history_state``).

    Every segment starts from a seed row that carries the state of the earlier
    segments; the seeds are unioned in, so the rows shuffle once and null keys
    need no join.
    """
    rows = segmented(df, order, parts) if segment is None else df.withColumn(SEGMENT, segment)
    newest = F.struct(order, *ties) if ties else F.col(order)
    state = rows.groupBy(*keys, SEGMENT).agg(
        *[F.max_by(c, newest).alias(f"__last_{c}") for c in last],
        *[F.min(c).alias(f"__low_{c}") for c in low],
        *[F.max(c).alias(f"__high_{c}") for c in high],
        F.count(F.lit(1)).alias("__n"),
    )
    if initial is not None:
        before_all = initial.select(*[c for c in state.columns if c != SEGMENT]).withColumn(SEGMENT, F.lit(-1.0))
        state = state.unionByName(before_all)
    # one row per key and segment: at most `parts` + 2 rows per key
    earlier = W.partitionBy(*keys).orderBy(SEGMENT)
    before = earlier.rowsBetween(W.unboundedPreceding, -1)
    seeds = state.select(
        *keys, SEGMENT,
        *[F.lag(f"__last_{c}").over(earlier).alias(f"__last_{c}") for c in last],
        *[F.min(f"__low_{c}").over(before).alias(f"__low_{c}") for c in low],
        *[F.max(f"__high_{c}").over(before).alias(f"__high_{c}") for c in high],
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__n"),
        F.lit(True).alias("__seed"),
    )
    rows = rows.withColumns({
        **{f"__last_{c}": F.col(c) for c in last},
        **{f"__low_{c}": F.col(c) for c in low},
        **{f"__high_{c}": F.col(c) for c in high},
        "__n": F.lit(1).cast("bigint"),
        "__seed": F.lit(False),
    })
    both = rows.unionByName(seeds, allowMissingColumns=True)
    ordered = W.partitionBy(*keys, SEGMENT).orderBy(F.col("__seed").desc(), order, *ties)
    upto = ordered.rowsBetween(W.unboundedPreceding, W.currentRow)
    added = {
        **{name: F.lag(f"__last_{c}").over(ordered) for c, name in last.items()},
        **{name: F.min(f"__low_{c}").over(upto) for c, name in low.items()},
        **{name: F.max(f"__high_{c}").over(upto) for c, name in high.items()},
    }
    if index:
        added[index] = F.sum("__n").over(upto) - 1
    out = both.withColumns(added).filter(~F.col("__seed"))
    return out.select(*df.columns, *added)


def history_state(df: DataFrame, keys: Sequence[str], order: str, last: Sequence[str] = (), low: Sequence[str] = (),
                  high: Sequence[str] = (), initial: DataFrame | None = None, late: bool = False) -> DataFrame:
    """One row per key: what rows after these need from them and from the
    earlier ``initial`` state. ``late`` rows count for ranges and numbers but
    leave the last readings alone.
    """
    at = F.lit(None).cast("double") if late else order_number(df, order)
    now = df.withColumn("__at", at).groupBy(*keys).agg(
        *[F.max_by(c, "__at").alias(f"__last_{c}") for c in last],
        *[F.min(c).alias(f"__low_{c}") for c in low],
        *[F.max(c).alias(f"__high_{c}") for c in high],
        F.count(F.lit(1)).alias("__n"), F.max("__at").alias("__at"))
    if initial is None:
        return now
    return now.unionByName(initial).groupBy(*keys).agg(
        *[F.max_by(f"__last_{c}", "__at").alias(f"__last_{c}") for c in last],
        *[F.min(f"__low_{c}").alias(f"__low_{c}") for c in low],
        *[F.max(f"__high_{c}").alias(f"__high_{c}") for c in high],
        F.sum("__n").alias("__n"), F.max("__at").alias("__at"))
