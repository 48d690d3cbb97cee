"""Aligned-rank analysis and its contrasts, with or without balanced blocks.

``block_model`` tells how blocks enter the test on the ranks: "fixed" (an
additive block), "pooled" (none) or "mixed" (a random block whose variance is
estimated, for as many runs of each configuration in each block)."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, Window as W

from tallywatt.functions import dist
from tallywatt.operators.anova import TABLE, Design, Fit, _row, _solved, moments, observed_levels, term_name
from tallywatt.plans.segments import tied_cut_points
from tallywatt.plans.small import checked_small
from tallywatt.session import shuffle_partitions, stored


SIGNIFICANT = 9  # aligned values are rounded to this many digits of the range
ROWS_PER_RANGE = 250_000  # runs of a value range, which one task ranks at once


def holm(df: DataFrame, p: str = "p_value", family: Sequence[str] = (), name: str = "p_holm") -> DataFrame:
    """Step-down adjustment inside each family of comparisons.

    A family is a list of contrasts between declared levels, so its window
    group is bounded by the design.
    """
    w = W.partitionBy(*family)
    order = w.orderBy(F.col(p).asc_nulls_last())
    size = F.count(p).over(w)
    step = F.least(F.lit(1.0), (size - F.col("__i") + 1) * F.col(p))
    adjusted = F.max(step).over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    return df.withColumn("__i", F.row_number().over(order)).withColumn(
        name, F.when(F.col(p).isNotNull(), adjusted)).drop("__i")


def _cell_effects(runs: DataFrame, design: Design) -> tuple[np.ndarray, float]:
    """(effect of every cell, constant) of the factorial and block model.

    With as many runs of each cell in each block these are the cell means about
    their mean; otherwise block effects are removed by least squares, so that a
    cell that happens to fill the high blocks is not taken for a high one.
    """
    within = runs.groupBy("cell", "block").agg(F.sum("y").alias("s"), F.count("y").alias("n"))
    cells = within.groupBy("cell").agg((F.sum("s") / F.sum("n")).alias("mean"), F.min("n").alias("low"), F.max("n").alias("high"),
                                       F.count("*").alias("blocks"))
    table = {r["cell"]: r for r in cells.collect()}  # one row per cell
    empty = [design.label(i) for i in range(design.cells) if i not in table or not table[i]["high"]]
    if empty:
        raise ValueError(f"empty cells: {empty}")
    if len({(n, r["blocks"]) for r in table.values() for n in (r["low"], r["high"])}) == 1:
        mean = np.array([table[i]["mean"] for i in range(design.cells)])
        return mean - mean.mean(), float(mean.mean())

    def rows_of(fit: Fit, keys: dict) -> list[dict]:
        return [{"cell": i, "effect": float(v), "constant": fit.constant} for i, v in enumerate(fit.effects)]

    base = moments(design, runs, ["y"], "block")
    found = _solved(design, base, ["outcome"], "fixed", rows_of, "cell int, effect double, constant double").collect()  # one row per cell
    effects = np.zeros(design.cells)
    effects[[r["cell"] for r in found]] = [r["effect"] for r in found]
    return effects, found[0]["constant"]


class Aligned(NamedTuple):
    """Stored runs (cell, block, y) and what aligns them: for every target, by how
    much the values of each cell move before they are rounded to ``1 / unit``."""

    runs: DataFrame
    names: list[str]
    shifts: np.ndarray
    unit: float

    def values(self, y: np.ndarray, cell: np.ndarray, target) -> np.ndarray:
        return np.rint((y + self.shifts[target, cell]) * self.unit) / self.unit

    def moved(self) -> DataFrame:
        """(cell, block, y, shifts) of the rows with an outcome."""
        local = [(i, self.shifts[:, i].tolist()) for i in range(self.shifts.shape[1])]
        cells = F.broadcast(self.runs.sparkSession.createDataFrame(local, "cell int, shifts array<double>"))
        return self.runs.where("y is not null").join(cells, "cell")

    def value(self, shift: Column) -> Column:
        unit = F.lit(self.unit)
        return (F.rint((F.col("y") + shift) * unit) / unit).alias("value")

    def rows(self) -> DataFrame:
        """(term, cell, block, value), every row once per target."""
        names = F.array(*[F.lit(t) for t in self.names])
        rows = self.moved().select("cell", "block", "y", F.posexplode("shifts").alias("i", "shift"))
        return rows.select(F.get(names, F.col("i")).alias("term"), "cell", "block", self.value(F.col("shift")))


def _aligned(runs: DataFrame, design: Design, outcome: str, block: str, targets: Mapping[str, np.ndarray]) -> Aligned:
    """For every target, what the cell's effect leaves of the outcome plus the
    target's estimate for the cell.

    ``targets`` maps a name to the matrix that turns cell effects into the
    estimate. The cell table is solved on its own.
    """
    # read by several jobs: computed once
    runs = stored(runs.select(design.declared_cell().alias("cell"), F.col(block).alias("block"), F.col(outcome).cast("double").alias("y")))
    effects, constant = _cell_effects(runs, design)
    span = max(float(effects.max() - effects.min()), float(np.abs(effects + constant).max()) * 1e-6, 1e-300)
    digits = SIGNIFICANT - math.ceil(math.log10(span))
    shifts = np.array([matrix @ (effects + constant) - effects - constant for matrix in targets.values()])
    return Aligned(runs, list(targets), shifts, 10.0 ** digits)


def _ranges_met(aligned: Aligned, cuts: np.ndarray, y: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, range): the distinct ranges that hold a row's values of all targets."""
    low, high = (np.searchsorted(cuts, aligned.values(y, cell, at[cell]), "right")
                 for at in (aligned.shifts.argmin(0), aligned.shifts.argmax(0)))
    one, more = np.flatnonzero(low == high), np.flatnonzero(low != high)
    met = np.stack([np.searchsorted(cuts, aligned.values(y[more], cell[more], i), "right") for i in range(len(aligned.names))], 1)
    met.sort(1)
    first = np.ones(met.shape, bool)
    first[:, 1:] = met[:, 1:] != met[:, :-1]
    return np.concatenate([one, np.repeat(more, first.sum(1))]), np.concatenate([low[one], met[first]])


def _ranked_in(aligned: Aligned, cuts: np.ndarray, at: int, table: pa.Table) -> list[tuple]:
    """For each target, (target, key, n, s, q) of the rows of range ``at``: n, sum and
    squares of the ranks about the range's middle, by the keys that ``table`` holds."""
    y, cell, key, n = (table[c].to_numpy() for c in ("y", "cell", "key", "n"))
    keys, out = int(key.max()) + 1, []
    for i in range(len(aligned.names)):
        value = aligned.values(y, cell, i)
        here = value >= cuts[at - 1] if at else np.ones(len(value), bool)
        if at < len(cuts):
            here &= value < cuts[at]
        here = np.flatnonzero(here)
        if not len(here):
            continue
        here = here[np.argsort(value[here])]
        value, w, k = value[here], n[here], key[here]
        starts = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
        tied = np.add.reduceat(w, starts)
        upto = np.cumsum(tied)
        rank = np.repeat(upto - (tied - 1) / 2 - (upto[-1] + 1) / 2, np.diff(np.append(starts, len(value))))
        sums = [np.bincount(k, x, keys) for x in (w, w * rank, w * rank * rank)]
        held = np.flatnonzero(sums[0])
        out.append((np.full(len(held), i), held, *[x[held] for x in sums]))
    return out


def _rank_moments(aligned: Aligned) -> DataFrame:
    """(term, cell, block, n, mean, m2) of the average ranks of every target.

    Rows are not shuffled once per target: equal rows are counted, and a row goes
    once to each value range that holds one of its aligned values, where the
    targets are ranked one after another. A value that fills a whole share of the
    rows has a range of its own, whose rows are spread. Ranks are taken about their
    known middle, so their squares stay small against each other.
    """
    runs, spark = aligned.runs, aligned.runs.sparkSession
    numbers = F.col("y").isNotNull() & ~F.isnan("y")
    turn = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(len(aligned.names))).cast("int")
    # cuts only spread the work: each row tells one of its values
    told = aligned.moved().where(numbers).select(aligned.value(F.get("shifts", turn)))
    parts = max(shuffle_partitions(spark), -(-runs.count() // ROWS_PER_RANGE))
    points, widths = tied_cut_points(told, "value", parts)
    cuts, widths = np.array(points), np.array(widths)
    plain = aligned._replace(runs=None)  # travels to the tasks
    block = runs.schema["block"].dataType
    counts = runs.where(numbers).groupBy("cell", "block", "y").agg(F.count(F.lit(1)).alias("n"))
    columns = ["cell", "block", "y", "n"]

    def route(batches):
        for batch in batches:
            y, cell, mixed = (batch.column(c).to_numpy() for c in ("y", "cell", "mixed"))
            row, at = _ranges_met(plain, cuts, y, cell)
            sent = batch.select(columns).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([*sent.columns, pa.array(at.astype(np.int32)), pa.array((mixed[row] % widths[at]).astype(np.int32))],
                                             [*columns, "range", "group"])

    def rank(key, table):
        table = table.combine_chunks()
        codes = table["block"].combine_chunks().dictionary_encode("encode")
        cell = table["cell"].to_numpy()
        place = codes.indices.to_numpy().astype(np.int64) * plain.shifts.shape[1] + cell
        place, own = np.unique(place, return_inverse=True)
        found = _ranked_in(plain, cuts, key[0].as_py(), table.append_column("key", pa.array(own)))
        target, held, n, s, q = (np.concatenate(x) for x in zip(*found))
        number, of = np.divmod(place[held], plain.shifts.shape[1])
        return pa.table({"range": np.full(len(held), key[0].as_py(), np.int32), "target": target.astype(np.int32), "cell": of.astype(np.int32),
                         "block": codes.dictionary.take(pa.array(number)), "n": n.astype(np.int64), "s": s, "q": q})

    kinds = f"cell int, block {block.simpleString()}"
    met = counts.withColumn("mixed", F.xxhash64("cell", "block")).select(*columns, "mixed").mapInArrow(
        route, f"{kinds}, y double, n long, range int, group int")
    local = stored(met.groupBy("range", "group").applyInArrow(rank, f"range int, target int, {kinds}, n long, s double, q double"))
    sizes = local.groupBy("target", "range").agg(F.sum("n").alias("size"))
    w = W.partitionBy("target")
    before = F.coalesce(F.sum("size").over(w.orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    # one row per target and range
    middles = checked_small(sizes.select("target", "range", (before + (F.col("size") - F.sum("size").over(w)) / 2).alias("d")))
    d, n = F.col("d"), F.col("n")
    sums = local.join(middles, ["target", "range"]).groupBy("target", "cell", "block").agg(
        F.sum("n").alias("n"), F.sum(F.col("s") + n * d).alias("s"), F.sum(F.col("q") + 2 * d * F.col("s") + n * d * d).alias("q"))
    names = F.array(*[F.lit(t) for t in aligned.names])
    return sums.select(F.get(names, F.col("target")).alias("term"), "cell", "block", "n", (F.col("s") / F.col("n")).alias("mean"),
                       F.greatest(F.col("q") - F.col("s") * F.col("s") / F.col("n"), F.lit(0.0)).alias("m2"))


def _model(block_model: str) -> str:
    if block_model not in ("fixed", "pooled", "mixed"):
        raise ValueError(f"block_model must be 'fixed', 'pooled' or 'mixed', not {block_model!r}")
    return block_model


def art_anova(runs: DataFrame, outcome: str = "energy_j", levels: Mapping[str, Sequence[str]] | None = None,
              block: str = "block", block_model: str = "fixed") -> DataFrame:
    """(term, sum_sq, df, F, p_value, partial_eta2): every term tested on the
    ranks of its own aligned values, one job for all terms. The log may be
    unbalanced, but for ``block_model="mixed"``.
    """
    design = Design.of(levels or observed_levels(runs))
    terms = {term_name(t): t for t in design.terms()}
    aligned = _aligned(runs, design, outcome, block, {name: design.effect(t) for name, t in terms.items()})

    def rows_of(fit: Fit, keys: dict) -> list[dict]:
        t = terms[keys["target"]]
        return [_row(keys["target"], fit.sum_sq(t), fit.span[t].stop - fit.span[t].start, fit)]

    base = _rank_moments(aligned).withColumnRenamed("term", "target")
    return _solved(design, base, ["target"], _model(block_model), rows_of, TABLE).drop("target")


def art_alignment_check(runs: DataFrame, outcome: str = "energy_j", levels: Mapping[str, Sequence[str]] | None = None,
                        block: str = "block") -> DataFrame:
    """(target, aligned_sum, target_sum_sq, largest_other_sum_sq, ok): the
    aligned values of a term must sum to zero and carry no other effect. In an
    unbalanced log the sum is that of their constant over all rows.
    """
    design = Design.of(levels or observed_levels(runs))
    terms = {term_name(t): t for t in design.terms()}
    aligned = _aligned(runs, design, outcome, block, {name: design.effect(t) for name, t in terms.items()})
    base = moments(design, aligned.rows().withColumnRenamed("term", "target"), ["value"], "block", ["target"]).drop("outcome")

    def rows_of(fit: Fit, keys: dict) -> list[dict]:
        own = fit.sum_sq(terms[keys["target"]])
        other = max((fit.sum_sq(t) for n, t in terms.items() if n != keys["target"]), default=0.0)
        total = fit.constant * fit.n
        scale = max(fit.resid, own, 1e-300)
        return [{"aligned_sum": total, "target_sum_sq": own, "largest_other_sum_sq": other,
                 "ok": bool(other <= 1e-9 * scale and abs(total) <= 1e-6 * math.sqrt(scale * fit.n))}]

    return _solved(design, base, ["target"], "fixed", rows_of,
                   "aligned_sum double, target_sum_sq double, largest_other_sum_sq double, ok boolean")


CONTRAST = ("contrast string, left_level array<string>, right_level array<string>, estimate double, se double, "
            "df double, t_ratio double, p_value double")


def artc_pairwise(runs: DataFrame, factors: Sequence[str] = ("engine",), outcome: str = "energy_j",
                  levels: Mapping[str, Sequence[str]] | None = None, block: str = "block",
                  block_model: str = "fixed", adjust: bool = True) -> DataFrame:
    """All pairwise contrasts between the level combinations of ``factors``
    on values aligned for exactly that combination; Holm over all pairs.
    """
    design = Design.of(levels or observed_levels(runs))
    factors = [f for f in design.factors if f in factors]
    matrix = design.averaging(factors)
    aligned = _aligned(runs, design, outcome, block, {"contrast": matrix})
    labels = [tuple(v for f, v in zip(design.factors, design.label(i)) if f in factors) for i in range(design.cells)]
    combos = list(dict.fromkeys(labels))
    member = {c: np.array([x == c for x in labels]) for c in combos}

    def rows_of(fit: Fit, keys: dict) -> list[dict]:
        mse = fit.resid / fit.df
        # estimated marginal means: plain averages of the cells' estimates
        share = {c: m / m.sum() for c, m in member.items()}
        out = []
        for i, a in enumerate(combos):
            for b in combos[i + 1:]:
                est, spread = fit.contrast(share[a] - share[b])
                se = math.sqrt(mse * spread)
                t = est / se if se > 0 else None
                out.append({"contrast": f"{','.join(a)} - {','.join(b)}", "left_level": list(a), "right_level": list(b), "estimate": est, "se": se,
                            "df": fit.df, "t_ratio": t, "p_value": dist.t_two_sided(t, fit.df)})
        return out

    base = _rank_moments(aligned).withColumnRenamed("term", "target")
    table = _solved(design, base, ["target"], _model(block_model), rows_of, CONTRAST).drop("target")
    return holm(table) if adjust else table


def artc_within(runs: DataFrame, factor: str, by: str = "engine", outcome: str = "energy_j",
                levels: Mapping[str, Sequence[str]] | None = None, block: str = "block",
                block_model: str = "fixed", alpha: float = 0.05) -> DataFrame:
    """Contrasts of a factor's levels inside the same engine, Holm over them."""
    levels = levels or observed_levels(runs)
    table = artc_pairwise(runs, [by, factor], outcome, levels, block, block_model, adjust=False)
    first = list(levels).index(by) < list(levels).index(factor)
    side = lambda c: F.get(F.col(c), F.lit(0 if first else 1))
    kept = table.withColumn(by, side("left_level")).filter(F.col(by) == side("right_level"))
    out = holm(kept.drop("left_level", "right_level"))
    return out.withColumn("significant_holm", F.col("p_holm") < alpha)
