"""Correlations, Pareto frontiers and block robustness."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, Window as W

from tallywatt.functions.dist_columns import t_two_sided
from tallywatt.operators.summary import config_means, numbered
from tallywatt.plans.ranks import average_ranks, null_safe, ranked_counts
from tallywatt.plans.segments import Ranges, add_segments, value_ranges
from tallywatt.plans.small import checked_small, small_copy
from tallywatt.session import checkpointed, shuffle_partitions, stored


def _paired(df: DataFrame, x: str, y: str) -> DataFrame:
    pair = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    return pair.filter("x is not null and y is not null and not isnan(x) and not isnan(y)")


def _with_p(stat: DataFrame) -> DataFrame:
    """p from t = r sqrt((n - 2) / (1 - r^2)) on n - 2 degrees of freedom."""
    r, n = F.col("statistic"), F.col("n")
    t = F.when(F.abs(r) >= 1, F.lit(float("inf"))).otherwise(r * F.sqrt((n - 2) / (1 - r * r)))
    return stat.withColumn("p_value", t_two_sided(t, (n - 2).cast("double")))


def pearson(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row (n, statistic)."""
    return _paired(df, x, y).agg(F.count(F.lit(1)).alias("n"), F.corr("x", "y").alias("statistic"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row (n, statistic): the correlation of average ranks.

    Equal pairs are counted first; the ranking of one side carries the other
    along, so nothing is looked up by a join. Weighted sums about the known mean
    rank replace the expanded rows.
    """
    pairs = _paired(df, x, y).groupBy("x", "y").agg(F.count(F.lit(1)).alias("w"))
    centred = F.col("avg_rank") - (F.col("total") + 1) / 2
    first = average_ranks(pairs.select(F.col("x").alias("value"), F.col("y").alias("other"), "w"), [], ["other"], weight="w")
    second = average_ranks(first.select(F.col("other").alias("value"), centred.alias("rx"), F.col("n").alias("w")), [], ["rx"], weight="w")
    ry = second.select("rx", "n", centred.alias("ry"))
    sums = ry.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("rx") * F.col("ry")).alias("xy"),
                  F.sum(F.col("n") * F.col("rx") * F.col("rx")).alias("xx"), F.sum(F.col("n") * F.col("ry") * F.col("ry")).alias("yy"))
    return sums.select(F.coalesce("n", F.lit(0)).alias("n"),
                       F.try_divide("xy", F.sqrt("xx") * F.sqrt("yy")).alias("statistic"))


def correlations(runs: DataFrame, x: str = "energy_j", y: str = "runtime_s") -> DataFrame:
    """Pearson and Spearman at run level and over configuration means."""
    means = config_means(runs)
    short = {"energy_j": "energy_mean", "runtime_s": "runtime_mean", "peak_rss_mb": "memory_mean"}
    parts = [("run-level", runs, x, y), ("configuration-mean", means, short[x], short[y])]
    out = None
    for level, df, a, b in parts:
        for method, fn in (("Pearson", pearson), ("Spearman", spearman)):
            row = fn(df, a, b).select(F.lit(level).alias("level"), F.lit(method).alias("method"), "n", "statistic")
            out = row if out is None else out.unionByName(row)
    return _with_p(out)


PAIRWISE = 1 << 12  # comparisons that are made at once rather than divided further


def _skyline(points: np.ndarray) -> np.ndarray:
    """Mask of the rows that no other row dominates (all <=, one <).

    Equal rows do not dominate each other. The distinct rows in lexicographic
    order are halved until few are left; nothing in the right half dominates
    the left one, so a merge only asks which rows of the right front the left
    front covers.
    """
    order = np.lexsort(points.T[::-1])
    rows = points[order]
    new = np.concatenate([np.ones(min(1, len(rows)), bool), (rows[1:] != rows[:-1]).any(axis=1)])
    mask = np.zeros(len(points), dtype=bool)
    mask[order] = _front(rows[new])[np.cumsum(new) - 1]
    return mask


def _front(rows: np.ndarray) -> np.ndarray:
    """Mask of the undominated among distinct rows in lexicographic order."""
    if len(rows) ** 2 <= PAIRWISE:
        return (rows[None] <= rows[:, None]).all(axis=2).sum(axis=1) == 1  # only itself
    half = len(rows) // 2
    left, right = _front(rows[:half]), _front(rows[half:])
    right[right] = ~_covered(rows[:half][left][:, 1:], rows[half:][right][:, 1:])
    return np.concatenate([left, right])


def _covered(by: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Whether some row of ``by`` is at most the row in every column. Divided
    at the median of the first column; what lies on both sides of it is
    compared in the other columns only."""
    if not len(by) or not len(rows):
        return np.zeros(len(rows), dtype=bool)
    if by.shape[1] == 1:
        return rows[:, 0] >= by[:, 0].min()
    if by.shape[1] == 2:
        by = by[np.argsort(by[:, 0], kind="stable")]
        lowest = np.concatenate([[np.inf], np.minimum.accumulate(by[:, 1])])
        reached = np.searchsorted(by[:, 0], rows[:, 0], "right")
        return (reached > 0) & (lowest[reached] <= rows[:, 1])
    if len(by) * len(rows) <= PAIRWISE:
        return (by[None] <= rows[:, None]).all(axis=2).any(axis=1)
    cut = np.sort(np.concatenate([by[:, 0], rows[:, 0]]))[(len(by) + len(rows)) // 2]
    below, above = rows[:, 0] < cut, rows[:, 0] > cut
    out = np.zeros(len(rows), dtype=bool)
    out[below] = _covered(by[by[:, 0] < cut], rows[below])
    out[~below] = _covered(by[by[:, 0] <= cut][:, 1:], rows[~below][:, 1:])
    open_ = above & ~out
    out[open_] = _covered(by[by[:, 0] > cut], rows[open_])
    return out


def _skyline_batches(cols: list[str]):
    """The front of a task's own distinct points, taken again whenever as many
    new points have come as it holds."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pool, waiting, front = [], 0, 0
        for batch in batches:
            pool.append(batch)
            waiting += len(batch)
            if waiting < front:
                continue
            points = pd.concat(pool, ignore_index=True).drop_duplicates()
            pool, waiting = [points[_skyline(points[cols].to_numpy())]], 0
            front = len(pool[0])
            if front > LOCAL_FRONT:  # too long to pay off: pass it on
                yield pool[0]
                pool, front = [], 0
        if pool:
            points = pd.concat(pool, ignore_index=True).drop_duplicates()
            yield points[_skyline(points[cols].to_numpy())]
    return run


def _beaten_by_pivot(points: DataFrame, cols: Sequence[str]) -> Column | None:
    """Condition of the rows dominated by one well-placed point of the table:
    the one with the smallest sum of range-scaled objectives."""
    ends = points.agg(*[f(c) for c in cols for f in (F.min, F.max)]).first()
    if ends[0] is None:
        return None
    scaled = F.lit(0.0)
    for i, c in enumerate(cols):
        lo, hi = ends[2 * i], ends[2 * i + 1]
        if hi > lo:
            scaled = scaled + (F.col(c) - lo) / (hi - lo)
    pivot = points.agg(F.min_by(F.struct(*cols), scaled)).first()[0]
    worse, strictly = F.lit(True), F.lit(False)
    for c in cols:
        worse = worse & (F.col(c) >= pivot[c])
        strictly = strictly | (F.col(c) > pivot[c])
    return worse & strictly


LOCAL_FRONT = 200_000
MAX_GRID = 256  # ranges per objective: the grid table has MAX_GRID^(d-1) rows


def pareto_front(df: DataFrame, cols: Sequence[str], parts: int | None = None) -> DataFrame:
    """The distinct points no other point dominates, all objectives minimised.

    With d objectives the first d - 1 are cut into value ranges; a value that
    many points share has a range of its own. A dominator of a point lies in
    the point's range in one of them (a strip), or in a strictly lower range
    in all of them. Strips are checked inside one strip at a time, and the
    strictly lower ranges through one number per grid cell: the running
    minimum of the last objective. A strip of one value, however many points
    it holds, is the same question with one objective less and is divided
    again. No pairs of points are formed and the front is never gathered.
    """
    cols = list(cols)
    if len(cols) < 2:
        raise ValueError("pareto needs at least two objectives")
    clean = [F.col(c).isNotNull() & ~F.isnan(F.col(c)) for c in cols]
    keep: Column = clean[0]
    for extra in clean[1:]:
        keep = keep & extra
    points = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).filter(keep)
    beaten = _beaten_by_pivot(points, cols)
    if beaten is not None:
        points = points.filter(~beaten)
    lead = cols[:-1]
    schema = ", ".join(f"{c} double" for c in cols)
    points = points.mapInPandas(_skyline_batches(cols), schema).distinct()
    # read several times below: kept as a checked local copy or a checkpoint
    points, size = small_copy(points)
    if size is None:
        points = checkpointed(points)

    grid = parts or max(4, min(MAX_GRID, shuffle_partitions(df.sparkSession)))
    names = {c: f"__g{i}" for i, c in enumerate(lead)}
    ranges = value_ranges(points, lead, grid)
    points = add_segments(points, {c: ranges[c].cuts for c in lead}, names)
    return _divided(points, cols, {names[c]: ranges[c] for c in lead}, []).select(*cols)


def _divided(points: DataFrame, cols: list[str], axes: dict[str, Ranges], fixed: list[str]) -> DataFrame:
    """The undominated points of every group of ``fixed`` ranges, each of one
    value. ``axes`` maps a range column to its ranges."""
    last = cols[-1]
    free = [a for a in axes if a not in fixed]
    if not free:  # all but the last objective are equal
        rest = [c for c in points.columns if c not in (*axes, last)]
        return points.groupBy(*axes, *rest).agg(F.min(last).alias(last)).select(*points.columns)

    # per grid cell: the lowest last objective over strictly lower cells
    reach = points.groupBy(*fixed, *free).agg(F.min(last).alias("__low"))
    for axis in free:
        rest = [a for a in (*fixed, *free) if a != axis]
        above = F.transform(F.sequence((F.col(axis) + 1).cast("int"), F.lit(len(axes[axis].cuts) + 1)), lambda i: i.cast("double"))
        reach = reach.select(*rest, F.explode(above).alias(axis), "__low").groupBy(*fixed, *free).agg(
            F.min("__low").alias("__low"))
    out = points.join(reach, [*fixed, *free], "left").filter(
        F.col("__low").isNull() | (F.col("__low") > F.col(last))).select(*points.columns)

    for axis in free:
        # a strip's own front decides: what a removed point dominates is also
        # dominated by a kept point
        one = F.col(axis).isin(axes[axis].single)
        strips = out.filter(~one) if axes[axis].single else out
        strips = strips.groupBy(*fixed, axis).applyInPandas(
            lambda pdf: pdf[_skyline(pdf[cols].to_numpy())], points.schema)
        out = strips.unionByName(_divided(out.filter(one), cols, axes, [*fixed, axis])) if axes[axis].single else strips
    return out


def pareto(df: DataFrame, cols: Sequence[str], name: str = "pareto", parts: int | None = None) -> DataFrame:
    """All rows with a flag. A row with a missing objective is compared to
    nothing, so nothing dominates it."""
    front = pareto_front(df, cols, parts).withColumn("__front", F.lit(True))
    marked = null_safe(df, checked_small(front), list(cols))
    missing = F.lit(False)
    for c in cols:
        missing = missing | F.col(c).isNull() | F.isnan(F.col(c))
    return marked.withColumn(name, missing | F.coalesce("__front", F.lit(False))).drop("__front")


def pareto_table(runs: DataFrame, keys: Sequence[str] = ("config_id",)) -> DataFrame:
    """Configuration means with the two published frontier flags."""
    means = config_means(runs, keys)
    two = pareto(means, ["energy_mean", "runtime_mean"], "pareto_energy_runtime")
    return pareto(two, ["energy_mean", "runtime_mean", "memory_mean"], "pareto_energy_runtime_memory")


def leave_one_block_out(runs: DataFrame, outcome: str = "energy_j") -> DataFrame:
    """Per excluded block: the best configuration of the rest, its mean, and
    the (minimum) rank of the full-sample best.

    Excluding a block changes only the means of the configurations that ran in
    it. All means are ranked once; each block then compares its changed means
    with the first place that it leaves as it is, and counts who is lower from
    the full ranking and the changes. Blocks x configurations is never formed.
    """
    cells = runs.groupBy("config_id", "block").agg(F.coalesce(F.sum(outcome), F.lit(0.0)).alias("s"), F.count(outcome).alias("n"))
    totals = cells.groupBy("config_id").agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"))
    totals = totals.withColumn("full_mean", F.try_divide("ts", "tn"))
    full = stored(numbered(totals, [F.col("full_mean").asc_nulls_last(), F.col("config_id")], "place"))
    mean = F.try_divide(F.col("ts") - F.col("s"), F.col("tn") - F.col("n"))
    changed = stored(cells.join(full, "config_id").select("block", "config_id", "place", "full_mean", mean.alias("mean")))

    # places are 1, 2, ... without a gap: the first one missing among the
    # changed is the best that stays as it is
    step = W.partitionBy("block").orderBy("place")
    top = full.where("place = 1").first()
    low = F.lit(None if top is None else top["full_mean"]).cast("double")
    whole = W.partitionBy("block")
    height = lambda c: F.coalesce(F.col(c), F.lit(float("inf")))
    own = changed.withColumns({
        "i": F.row_number().over(step),
        "at": F.coalesce(F.max(F.when(F.col("place") == 1, height("mean"))).over(whole), low, F.lit(float("inf")))})
    blocks = own.groupBy("block", "at").agg(
        F.coalesce(F.min(F.when(F.col("place") > F.col("i"), F.col("i"))), F.count("*") + 1).alias("free"),
        F.min(F.struct(height("mean").alias("h"), "config_id", "mean")).alias("best"),
        (F.count_if(height("mean") < F.col("at")) - F.count_if(height("full_mean") < F.col("at"))).alias("gained"))
    stays = full.select(F.col("place").alias("free"), F.struct(height("full_mean").alias("h"), "config_id", F.col("full_mean").alias("mean")).alias("stay"))
    blocks = stored(blocks.join(stays, "free", "left").withColumn("best", F.least("best", "stay")))

    # how many full means lie below each block's mark
    marks = blocks.select(F.col("at").alias("value"), F.lit(0).cast("bigint").alias("n"))
    below = ranked_counts(full.select(height("full_mean").alias("value"), F.lit(1).cast("bigint").alias("n")).unionByName(marks))
    lower = below.select(F.col("value").alias("at"), (F.col("min_rank") - 1).alias("lower"))
    return blocks.join(lower, "at").select(
        F.col("block").alias("excluded_block"), F.col("best.config_id").alias("best_config_after_exclusion"),
        F.col("best.mean").alias("best_mean_energy_after_exclusion"), F.lit(None if top is None else top["config_id"]).cast("string").alias("full_sample_best_config"),
        (1 + F.col("lower") + F.col("gained")).cast("int").alias("rank_of_full_sample_best"))


def best_stability(loo: DataFrame) -> DataFrame:
    """In how many exclusions the full-sample best keeps rank 1."""
    return loo.agg(F.count_if(F.col("rank_of_full_sample_best") == 1).alias("kept_rank_1"),
                   F.count(F.lit(1)).alias("exclusions"))


def position_drift(runs: DataFrame, residual: str = "residual", position: str = "position_in_block") -> DataFrame:
    """Spearman of run position against residual, with p."""
    return _with_p(spearman(runs, position, residual)).select(
        "n", F.col("statistic").alias("spearman_rho"), "p_value")
