"""Canonical values, row hashes and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

# Effect-size thresholds and the published grid factor.
ETA_LABELS = [(0.14, "large"), (0.06, "medium"), (0.01, "small")]
GRID_KG_PER_KWH = 0.62
JOULES_PER_KWH = 3_600_000.0
FLOAT_DIGITS = 7


def finite(value: Column) -> Column:
    """NaN and infinities become null."""
    bad = F.isnan(value) | value.isin(float("inf"), float("-inf"))
    return F.when(~bad, value)


def canonical(field: T.StructField) -> Column:
    """One cell for hashing: floats rounded to the seventh decimal, NaN and
    infinities null (x - x is NaN for both), other types as text."""
    value = F.col(field.name)
    if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
        x = value.cast("double")
        unit = F.lit(10.0 ** FLOAT_DIGITS)
        return F.nanvl(F.rint(x * unit) / unit + (x - x), F.lit(None))
    return value.cast("string")


def row_json(df: DataFrame) -> Column:
    """Compact JSON of a row, columns in name order, nulls kept."""
    fields = sorted(df.schema.fields, key=lambda f: f.name)
    return F.to_json(F.struct(*[canonical(f).alias(f.name) for f in fields]), {"ignoreNullFields": "false"})


def row_sha256(df: DataFrame) -> Column:
    return F.sha2(row_json(df), 256)


def eta_label(eta2: Column) -> Column:
    chain = F.when(eta2.isNull() | F.isnan(eta2), F.lit(""))
    for low, label in ETA_LABELS:
        chain = chain.when(eta2 >= low, F.lit(label))
    return chain.otherwise(F.lit("very small"))


def carbon_grams(joules: Column, kg_per_kwh: float = GRID_KG_PER_KWH) -> Column:
    return joules / F.lit(JOULES_PER_KWH) * F.lit(kg_per_kwh) * F.lit(1000.0)
