"""Rounding of result tables, so that summation order does not show."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T


# Means of short decimals often end exactly on a rounding boundary, where the
# order of summation would decide the last digit; every value is moved off it.
NUDGE = 0.0037


def nudge(digits: int) -> float:
    return NUDGE * 10.0 ** -digits


def rounded(df: DataFrame, digits: int | dict[str, int] = 6) -> DataFrame:
    """Floating columns as DOUBLE rounded to ``digits``, or to those of their name (6 without)."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            d = digits if isinstance(digits, int) else digits.get(f.name, 6)
            out.append(F.round(F.col(f.name).cast("double") + F.lit(nudge(d)), d).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def rounded_sql(expression: str, digits: int = 6) -> str:
    return f"round({expression} + {nudge(digits)!r}::DOUBLE, {digits})"
