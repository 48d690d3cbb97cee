"""Per-group count, mean, standard deviation, minimum and maximum."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tallywatt.operators.clean import constant_columns, dedup_stored
from tallywatt.operators.features import derive
from tallywatt.plans.small import checked_small
from tallywatt.schema import DERIVED_COLUMNS, NUMERIC_COLUMNS, PROFILE_KEYS, PROTECTED_COLUMNS


def profiled_columns(df: DataFrame) -> list[str]:
    """Declared numeric columns that are present; extras are not profiled."""
    return [c for c in [*NUMERIC_COLUMNS, *DERIVED_COLUMNS] if c in df.columns]


def _stats(c: str) -> list[Column]:
    # count and sum are shared by count and mean, so the aggregation buffer
    # holds them once per column
    return [
        F.count(c).alias(f"{c}_count"),
        F.try_divide(F.sum(c), F.count(c)).alias(f"{c}_mean"),
        F.stddev_samp(c).alias(f"{c}_std"),
        F.min(c).alias(f"{c}_min"),
        F.max(c).alias(f"{c}_max"),
    ]


def profile(df: DataFrame, keys: Sequence[str] = PROFILE_KEYS, cols: Sequence[str] | None = None) -> DataFrame:
    """One wide hash aggregate; null keys form their own group.

    Few groups and map-side partial aggregation: each task ships one row per
    group, whatever the skew of the keys.
    """
    cols = list(cols) if cols is not None else profiled_columns(df)
    return df.groupBy(*keys).agg(*[s for c in cols for s in _stats(c)])


def telemetry_profile(telemetry: DataFrame, dtype: str = "double", keys: Sequence[str] = PROFILE_KEYS,
                      distinct: Callable[[DataFrame], DataFrame] | None = dedup_stored) -> DataFrame:
    """The whole workload: distinct rows, drop constants, derive, profile.

    ``distinct`` removes repeated rows: ``dedup_stored`` for tables with few
    repeats, ``dedup`` otherwise, None where rows are known to be unique.
    """
    gone = constant_columns(telemetry, PROTECTED_COLUMNS)
    rows = distinct(telemetry) if distinct else telemetry
    return profile(derive(rows.drop(*gone), dtype), keys)


def partial_profile(df: DataFrame, keys: Sequence[str], cols: Sequence[str] | None = None) -> DataFrame:
    """Mergeable state, long form: one row per key and column with the count,
    mean, sum of squared deviations, minimum and maximum (as DOUBLE).

    Mean and squared deviations are kept instead of sum and sum of squares,
    which lose digits when the mean is large against the spread.
    """
    cols = list(cols) if cols is not None else profiled_columns(df)
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        aggs += [F.count(x).alias(f"{c}__n"), F.avg(x).alias(f"{c}__mean"), F.var_pop(x).alias(f"{c}__var"),
                 F.min(x).alias(f"{c}__min"), F.max(x).alias(f"{c}__max")]
    wide = df.groupBy(*keys).agg(*aggs)
    entries = [
        F.struct(F.lit(c).alias("column"), F.col(f"{c}__n").alias("n"), F.col(f"{c}__mean").alias("mean"),
                 (F.col(f"{c}__var") * F.col(f"{c}__n")).alias("m2"),
                 F.col(f"{c}__min").alias("min"), F.col(f"{c}__max").alias("max"))
        for c in cols
    ]
    return wide.select(*keys, F.inline(F.array(*entries)))


def merge_profiles(partials: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Roll stored partial states up to ``keys`` and finish them (long form).

    Means are taken relative to the column's overall mean before squaring, so
    no large squares are subtracted; one aggregate then merges all parts,
    map-side first. The overall means are one row per column.
    """
    centre = checked_small(
        partials.groupBy("column").agg(
            F.try_divide(F.sum(F.col("mean") * F.col("n")), F.sum("n")).alias("__centre")))
    shift = F.col("mean") - F.col("__centre")
    merged = partials.join(centre, "column", "left").groupBy(*keys, "column").agg(
        F.sum("n").cast("bigint").alias("count"),
        F.first("__centre", ignorenulls=True).alias("__centre"),
        F.sum(F.col("n") * shift).alias("__s1"),
        F.sum(F.col("m2") + F.col("n") * shift * shift).alias("__s2"),
        F.min("min").alias("min"),
        F.max("max").alias("max"),
    )
    offset = F.try_divide(F.col("__s1"), F.col("count"))
    spread = F.greatest(F.col("__s2") - F.col("__s1") * offset, F.lit(0.0))
    std = F.when(F.col("count") > 1, F.sqrt(spread / (F.col("count") - 1)))
    return merged.select(*keys, "column", "count", (F.col("__centre") + offset).alias("mean"),
                         std.alias("std"), "min", "max")
