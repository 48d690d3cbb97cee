"""Global ranks without an unpartitioned window.

Equal values are first counted (map-side combined), so a value that fills a
third of the table is one row afterwards; the distinct values are then ranked
inside value ranges that each hold a bounded share of the rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from tallywatt.plans.segments import SEGMENT, add_segments, cut_points, tied_cut_points


def _ranked_counts(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """From (keys, segment, value, n), one row per value: add ``__before``
    (rows with a smaller value) and ``__total`` (all rows of the key).
    """
    sizes = counts.groupBy(*keys, SEGMENT).agg(F.sum("n").alias("__size"))
    order = W.partitionBy(*keys).orderBy(SEGMENT)
    # one row per key and segment
    offsets = sizes.select(
        *keys, SEGMENT,
        F.coalesce(F.sum("__size").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("n"),
        F.sum("__size").over(W.partitionBy(*keys)).alias("__total"),
        F.lit(True).alias("__seed"),
    )
    rows = counts.withColumn("__seed", F.lit(False))
    both = rows.unionByName(offsets, allowMissingColumns=True)
    upto = W.partitionBy(*keys, SEGMENT).orderBy(F.col("__seed").desc(), F.col("value")).rowsBetween(
        W.unboundedPreceding, W.currentRow)
    return (
        both.withColumns({"__before": F.sum("n").over(upto) - F.col("n"), "__total": F.max("__total").over(upto)})
        .filter(~F.col("__seed"))
        .drop("__seed")
    )


def _numbers(df: DataFrame) -> DataFrame:
    return df.filter("value is not null and not isnan(value)")


def _ranks(counts: DataFrame, keys: Sequence[str], cuts: Mapping[str, Sequence[float]]) -> DataFrame:
    ranked = _ranked_counts(add_segments(counts, cuts, {"value": SEGMENT}), keys)
    return ranked.select(
        *keys, "value", "n",
        (F.col("__before") + 1).alias("min_rank"),
        (F.col("__before") + (F.col("n") + 1) / 2).alias("avg_rank"),
        F.col("__total").alias("total"),
    )


def ranked_counts(rows: DataFrame, parts: int | None = None) -> DataFrame:
    """(value, n, min_rank, avg_rank, total) of (value, n) rows; a row with n = 0
    asks for the rank its value would have."""
    counts = rows.groupBy("value").agg(F.sum("n").alias("n"))
    return _ranks(counts, [], cut_points(counts, ["value"], parts))


def value_ranks(df: DataFrame, col: str, keys: Sequence[str] = (), parts: int | None = None) -> DataFrame:
    """(keys, value, n, min_rank, avg_rank, total) of every distinct value.

    ``avg_rank`` is the mean of the positions the tied rows share. Null and
    NaN values have no rank. The cut points come from all keys together, so a
    (key, segment) group holds at most one share of all rows.
    """
    clean = _numbers(df.select(*keys, F.col(col).cast("double").alias("value")))
    counts = clean.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("n"))
    return _ranks(counts, keys, cut_points(clean, ["value"], parts))


def average_ranks(df: DataFrame, keys: Sequence[str], payload: Sequence[str], parts: int | None = None,
                  weight: str | None = None) -> DataFrame:
    """(keys, value, payload, n, avg_rank, total) from rows with ``value``, each
    standing for ``weight`` rows.

    Equal rows are counted first. A value that fills a whole share of the rows
    has a range of its own, where order does not matter: its payloads are
    spread over several window groups, each with its own copy of the seed row.
    """
    clean = _numbers(df)
    cuts, tasks = tied_cut_points(clean, "value", parts)
    counts = add_segments(
        clean.groupBy(*keys, "value", *payload).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("n")), {"value": cuts}, {"value": SEGMENT})
    sizes = counts.groupBy(*keys, SEGMENT).agg(F.sum("n").alias("__size"))
    order = W.partitionBy(*keys).orderBy(SEGMENT)
    width = F.get(F.array(*[F.lit(t) for t in tasks]), F.col(SEGMENT).cast("int"))
    # one row per key and segment
    placed = sizes.withColumns({
        "__from": F.coalesce(F.sum("__size").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
        "total": F.sum("__size").over(W.partitionBy(*keys)),
        "__kind": F.lit(0), "n": F.lit(0).cast("bigint")})
    # only now repeated: the sums above must see each segment once
    seeds = placed.withColumn("__group", F.explode(F.sequence(F.lit(0), width - 1)))
    rows = counts.withColumns({
        "__kind": F.lit(1), "__group": F.pmod(F.xxhash64(*payload), width).cast("int")})
    both = rows.unionByName(seeds, allowMissingColumns=True)
    group = [*keys, SEGMENT, "__group"]
    upto = W.partitionBy(*group).orderBy("__kind", "value").rangeBetween(W.unboundedPreceding, W.currentRow)
    tied = F.sum("n").over(W.partitionBy(*group, "__kind", "value"))
    ranked = both.withColumn("__tied", tied).withColumns({
        c: F.max(c).over(upto) for c in ("__from", "__size", "total")} | {"__upto": F.sum("n").over(upto)}).filter("__kind = 1")
    spread = F.col("__from") + (F.col("__size") + 1) / 2
    inside = F.col("__from") + F.col("__upto") - F.col("__tied") + (F.col("__tied") + 1) / 2
    return ranked.select(*keys, "value", *payload, "n", F.when(width > 1, spread).otherwise(inside).alias("avg_rank"), "total")


def stacked(df: DataFrame, keys: Sequence[str], cols: Sequence[str], extra: Mapping[str, Sequence[str]] = {}) -> DataFrame:
    """Unpivot ``cols`` into (keys, column, value), with more columns that
    run parallel to them (``extra[name][i]`` belongs to ``cols[i]``)."""
    entries = [
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value"),
                 *[F.col(source[i]).alias(name) for name, source in extra.items()])
        for i, c in enumerate(cols)
    ]
    return df.select(*keys, F.inline(F.array(*entries)))


def null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join on keys where null equals null; keeps the left key columns."""
    renamed = right.select(*[F.col(k).alias(f"__r_{k}") if k in keys else F.col(k) for k in right.columns])
    condition: Column = F.lit(True)
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"__r_{k}"))
    return left.join(renamed, condition, how).drop(*[f"__r_{k}" for k in keys])
