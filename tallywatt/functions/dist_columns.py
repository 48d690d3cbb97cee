"""Distribution functions as columns, for small result tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from tallywatt.functions import dist


@F.pandas_udf(T.DoubleType())
def f_tail(f: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
    return pd.Series([dist.f_tail(*v) for v in zip(f, df1, df2)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def t_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([dist.t_two_sided(*v) for v in zip(t, df)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def _t_quantile(p: pd.Series, df: pd.Series) -> pd.Series:
    known = {pair: dist.t_quantile(*pair) for pair in set(zip(p, df))}
    return pd.Series([known[pair] for pair in zip(p, df)], dtype="float64")


def t_quantile(p: float, df: Column) -> Column:
    return _t_quantile(F.lit(p), df.cast("double"))
