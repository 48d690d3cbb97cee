"""Variance and normality checks."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T, Window as W

from tallywatt.functions import dist
from tallywatt.functions.dist_columns import f_tail
from tallywatt.operators.anova import observed_levels, residuals
from tallywatt.plans.ranks import null_safe, value_ranks
from tallywatt.plans.selection import medians
from tallywatt.plans.small import checked_small
from tallywatt.schema import OUTCOMES
from tallywatt.session import stored

POSITIONS_PER_CHUNK = 100_000
ROYSTON_LIMIT = 5000


# The names of the tests in result tables.
CENTERS = {"mean": "Levene (mean-centered)", "median": "Brown-Forsythe (median-centered)"}


def spread_tests(runs: DataFrame, outcomes: Sequence[str], by: str = "config_id", centers: Sequence[str] = tuple(CENTERS)) -> DataFrame:
    """(outcome, test, statistic, df1, df2, p_value): equality of spread over the
    groups, by distance from the group's mean or median; one job for all."""
    unknown = set(centers) - set(CENTERS)
    if unknown:
        raise ValueError(f"center must be 'mean' or 'median', not {unknown.pop()!r}")
    y = runs.select(by, *[F.col(c).cast("double").alias(c) for c in outcomes])
    middle = None
    if "mean" in centers:
        middle = y.groupBy(by).agg(*[F.avg(c).alias(f"{c}__mean") for c in outcomes])
    if "median" in centers:
        found = medians(y, outcomes, [by], "__median")
        middle = found if middle is None else null_safe(middle, found, [by])
    wide = null_safe(y, checked_small(middle), [by])
    entries = [F.struct(F.lit(c).alias("outcome"), F.lit(k).alias("center"), F.abs(F.col(c) - F.col(f"{c}__{k}")).alias("z"))
               for c in outcomes for k in centers]
    z = wide.select(by, F.inline(F.array(*entries))).where("z is not null")
    groups = z.groupBy("outcome", "center", by).agg(
        F.count("z").alias("n"), F.avg("z").alias("m"), (F.var_pop("z") * F.count("z")).alias("ss"))
    groups = stored(groups)
    # one row per outcome and centre
    grand = groups.groupBy("outcome", "center").agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("grand"))
    parts = groups.join(F.broadcast(grand), ["outcome", "center"]).groupBy("outcome", "center").agg(
        F.sum("n").alias("N"), F.count(F.lit(1)).alias("k"), F.sum("ss").alias("inside"),
        F.sum(F.col("n") * F.pow(F.col("m") - F.col("grand"), 2)).alias("between"))
    df1, df2 = (F.col("k") - 1).cast("double"), (F.col("N") - F.col("k")).cast("double")
    name = F.create_map(*[F.lit(v) for kv in CENTERS.items() for v in kv])[F.col("center")]
    out = parts.select("outcome", name.alias("test"), F.try_divide(F.col("between") * df2, F.col("inside") * df1).alias("statistic"),
                       df1.alias("df1"), df2.alias("df2"))
    return out.withColumn("p_value", f_tail("statistic", "df1", "df2"))


def levene(runs: DataFrame, outcome: str = "energy_j", by: str = "config_id", center: str = "mean") -> DataFrame:
    """One row (test, statistic, df1, df2, p_value) of ``spread_tests``."""
    return spread_tests(runs, [outcome], by, [center]).drop("outcome")


def _position_chunks(df: DataFrame, col: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, value, first, last, total): the sorted positions of every distinct
    value, long runs of ties cut into chunks that spread over the tasks."""
    ranks = value_ranks(df, col, keys)
    start = F.explode(F.sequence(F.col("min_rank"), F.col("min_rank") + F.col("n") - 1, F.lit(POSITIONS_PER_CHUNK)))
    chunks = ranks.select(*keys, "value", "total", (F.col("min_rank") + F.col("n") - 1).alias("end"), start.alias("first"))
    return chunks.select(*keys, "value", "total", "first",
                         F.least(F.col("end"), F.col("first") + POSITIONS_PER_CHUNK - 1).alias("last"))


def _score(position: np.ndarray, total: float) -> np.ndarray:
    return dist.normal_quantile((position - 0.375) / (total + 0.25))


@F.pandas_udf(T.StructType([T.StructField("s1", T.DoubleType()), T.StructField("s2", T.DoubleType())]))
def _score_sums(first: pd.Series, last: pd.Series, total: pd.Series) -> pd.DataFrame:
    """Sum and sum of squares of the expected normal scores of positions."""
    start, width, n = first.to_numpy(), (last - first + 1).to_numpy(), total.to_numpy(dtype=float)
    s1, s2 = np.zeros(len(start)), np.zeros(len(start))
    # a slice covers at most a few chunks' positions at a time
    slices = np.flatnonzero(np.diff(np.cumsum(width) // POSITIONS_PER_CHUNK)) + 1
    for rows in np.split(np.arange(len(start)), slices):
        owner = np.repeat(rows, width[rows])
        offset = np.arange(len(owner)) - np.repeat(np.cumsum(width[rows]) - width[rows], width[rows])
        m = _score(start[owner] + offset, n[owner])
        np.add.at(s1, owner, m)
        np.add.at(s2, owner, m * m)
    return pd.DataFrame({"s1": s1, "s2": s2})


def _royston(n: int, sxm: float, mm: float, ss: float, ends: dict[str, float]) -> tuple[float, float]:
    """W and p by Royston's 1995 approximation from the sums.

    Fixed values: the published polynomial coefficients.
    """
    poly = np.polynomial.polynomial.polyval
    u = 1.0 / math.sqrt(n)
    m_n = float(_score(np.array([float(n)]), n)[0])
    m_n1 = float(_score(np.array([float(n - 1)]), n)[0])
    if n == 3:
        w_sum = math.sqrt(0.5) * (ends["x_n"] - ends["x_1"])
    else:
        a_n = m_n / math.sqrt(mm) + poly(u, [0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056])
        if n > 5:
            a_n1 = m_n1 / math.sqrt(mm) + poly(u, [0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633])
            phi = (mm - 2 * m_n ** 2 - 2 * m_n1 ** 2) / (1 - 2 * a_n ** 2 - 2 * a_n1 ** 2)
            outer = a_n * (ends["x_n"] - ends["x_1"]) + a_n1 * (ends["x_n1"] - ends["x_2"])
            inner = sxm - m_n * (ends["x_n"] - ends["x_1"]) - m_n1 * (ends["x_n1"] - ends["x_2"])
        else:
            phi = (mm - 2 * m_n ** 2) / (1 - 2 * a_n ** 2)
            outer = a_n * (ends["x_n"] - ends["x_1"])
            inner = sxm - m_n * (ends["x_n"] - ends["x_1"])
        w_sum = outer + inner / math.sqrt(phi)
    w = min(w_sum * w_sum / ss, 1.0)
    if n == 3:
        p = 6.0 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75)))
        return w, max(p, 0.0)
    if w >= 1.0:
        return w, 1.0
    y, log_n = math.log(1 - w), math.log(n)
    if n <= 11:
        gamma = poly(n, [-2.273, 0.459])
        if y >= gamma:
            return w, 1e-99
        y = -math.log(gamma - y)
        mean = poly(n, [0.544, -0.39978, 0.025054, -6.714e-4])
        sd = math.exp(poly(n, [1.3822, -0.77857, 0.062767, -0.0020322]))
    else:
        mean = poly(log_n, [-1.5861, -0.31082, -0.083751, 0.0038915])
        sd = math.exp(poly(log_n, [-0.4803, -0.082676, 0.0030302]))
    return w, dist.normal_tail((y - mean) / sd)


SHAPIRO = "statistic double, p_value double, n bigint, beyond_range boolean"


def shapiro_wilk(df: DataFrame, col: str = "residual", by: Sequence[str] = ()) -> DataFrame:
    """One row (by, statistic, p_value, n, beyond_range) per group.

    Positions come from the segmented ranking and the normal scores are
    summed per chunk; only a handful of sums reach the last step. The p value
    is an approximation for n <= 5000; ``beyond_range`` flags larger tables.
    """
    by = list(by)
    values = df.select(*by, F.col(col).cast("double").alias("v")).filter("v is not null and not isnan(v)")
    # sums about the mean keep their digits; one row per group
    centre = values.groupBy(*by).agg(F.avg("v").alias("shift"))
    shift = {tuple(r)[:-1]: r["shift"] or 0.0 for r in centre.collect()}
    middle = F.lit(shift.get((), 0.0))
    for group, value in shift.items():
        if by:
            middle = F.when(F.array(*[F.col(k).cast("string") for k in by]) == F.array(*[F.lit(str(g)) for g in group]), value).otherwise(middle)
    chunks = _position_chunks(values.select(*by, (F.col("v") - middle).alias("v")), "v", by)
    x, n = F.col("value"), F.col("total")
    holds = lambda at: (F.col("first") <= at) & (F.col("last") >= at)
    pick = lambda at: F.max(F.when(holds(at), x))
    scored = chunks.withColumn("s", _score_sums("first", "last", "total"))
    rows = F.col("last") - F.col("first") + 1
    sums = scored.groupBy(*by).agg(
        F.sum(x * F.col("s.s1")).alias("sxm"), F.sum("s.s2").alias("mm"), F.sum(rows * x * x).alias("sxx"),
        F.sum(rows * x).alias("sx"), F.max("total").alias("n"),
        pick(F.lit(1)).alias("x_1"), pick(F.lit(2)).alias("x_2"), pick(n - 1).alias("x_n1"), pick(n).alias("x_n"))

    def finish(batches):
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                head = tuple(r[k] for k in by)
                if pd.isna(r["n"]) or r["n"] < 3 or r["x_n"] == r["x_1"]:
                    out.append((*head, None, None, 0 if pd.isna(r["n"]) else int(r["n"]), False))
                    continue
                n = int(r["n"])
                ss = r["sxx"] - r["sx"] ** 2 / n
                w, p = _royston(n, r["sxm"], r["mm"], ss, r)
                out.append((*head, w, p, n, n > ROYSTON_LIMIT))
            yield pd.DataFrame(out, columns=[*by, "statistic", "p_value", "n", "beyond_range"])

    kinds = {f.name: f.dataType.simpleString() for f in values.schema}
    return sums.mapInPandas(finish, ", ".join([*[f"{k} {kinds[k]}" for k in by], SHAPIRO]))


@F.pandas_udf(T.DoubleType())
def _normal_quantile(p: pd.Series) -> pd.Series:
    return pd.Series(dist.normal_quantile(p.to_numpy()))


def qq_points(df: DataFrame, col: str = "residual") -> DataFrame:
    """(position, theoretical, sample) of every value: normal quantiles at
    i / (n + 1) against the values standardised by their mean and (population)
    sd.
    """
    values = df.select(F.col(col).cast("double").alias("v")).filter("v is not null and not isnan(v)")
    fit = values.agg(F.avg("v"), F.stddev_pop("v")).first()
    mean, sd = fit[0] or 0.0, fit[1] or 1.0
    points = _position_chunks(values, "v").select(
        "value", "total", F.explode(F.sequence("first", "last")).alias("position"))
    return points.select(
        "position", _normal_quantile(F.col("position") / (F.col("total") + 1)).alias("theoretical"),
        ((F.col("value") - mean) / sd).alias("sample"))


def assumption_summary(runs: DataFrame, outcomes: Sequence[str] = OUTCOMES, levels: Mapping[str, Sequence[str]] | None = None,
                       block: str | None = "block", alpha: float = 0.05) -> DataFrame:
    """(outcome, diagnostic, statistic, p_value, rejected, method): normality
    of residuals and equality of spread, and the method the rule picks: aligned
    ranks if Shapiro-Wilk or Brown-Forsythe rejects.
    """
    levels = levels or observed_levels(runs)
    # read by several jobs: computed once
    runs = stored(runs.select("config_id", *levels, *([block] if block else []), *outcomes))
    left = [residuals(runs, c, levels, block).select(F.lit(c).alias("outcome"), "residual") for c in outcomes]
    normal = shapiro_wilk(stored(reduce(DataFrame.unionByName, left)), "residual", ["outcome"])
    spread = spread_tests(runs, outcomes)
    label = F.when(F.col("test") == CENTERS["mean"], "Levene homogeneity").otherwise("Brown-Forsythe homogeneity")
    out = normal.select("outcome", F.lit("Shapiro-Wilk residual normality").alias("diagnostic"), "statistic", "p_value").unionByName(
        spread.select("outcome", label.alias("diagnostic"), "statistic", "p_value"))
    out = out.withColumn("rejected", F.col("p_value") < alpha)
    decides = F.col("rejected") & ~F.col("diagnostic").startswith("Levene")
    anywhere = F.coalesce(F.bool_or(decides).over(W.partitionBy("outcome")), F.lit(False))
    return out.withColumn("method", F.when(anywhere, "aligned rank transform").otherwise("original-scale factorial"))
