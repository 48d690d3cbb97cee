"""Factorial Type III analysis with an additive block.

Spark reduces the log to one row per (block, cell) with count, mean and
squared deviations; a cell is a combination of the declared factor levels.
Only those cell tables are solved, one task per outcome.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tallywatt.functions import dist
from tallywatt.functions.values import eta_label
from tallywatt.plans.small import checked_small, small_copy
from tallywatt.schema import FACTORS

MAX_CELLS = 4096
ROWS_PER_TASK = 500_000
MERGE_WIDTH = 64


@dataclass(frozen=True)
class Design:
    """Factor levels in declared order; cells are numbered row-major."""

    levels: tuple[tuple[str, tuple[str, ...]], ...]

    @staticmethod
    def of(levels: Mapping[str, Sequence[str]]) -> "Design":
        design = Design(tuple((f, tuple(map(str, v))) for f, v in levels.items()))
        if design.cells > MAX_CELLS:
            raise ValueError(f"{design.cells} cells exceed {MAX_CELLS}")
        return design

    @property
    def factors(self) -> list[str]:
        return [f for f, _ in self.levels]

    @property
    def sizes(self) -> list[int]:
        return [len(v) for _, v in self.levels]

    @property
    def cells(self) -> int:
        return reduce(lambda a, b: a * b, self.sizes, 1)

    def cell(self) -> Column:
        """The cell number of a row; null for an undeclared level."""
        number: Column = F.lit(0)
        for f, values in self.levels:
            chain = None
            for i, v in enumerate(values):
                test = F.col(f).cast("string") == v
                chain = F.when(test, i) if chain is None else chain.when(test, i)
            number = number * len(values) + chain
        return number.cast("int")

    def declared_cell(self) -> Column:
        """The cell number; a row with an undeclared level is an error."""
        told = F.concat_ws(", ", *[F.coalesce(F.col(f).cast("string"), F.lit("null")) for f in self.factors])
        return F.coalesce(self.cell(), F.raise_error(F.concat(F.lit("undeclared level in: "), told)).cast("int"))

    def terms(self) -> list[tuple[str, ...]]:
        """Main effects first, then interactions by order."""
        return [t for k in range(1, len(self.factors) + 1) for t in combinations(self.factors, k)]

    def contrasts(self, term: Sequence[str]) -> np.ndarray:
        """Sum-to-zero columns of a term, one row per cell."""
        out = np.ones((1, 1))
        for f, values in self.levels:
            n = len(values)
            block = np.vstack([np.eye(n - 1), -np.ones(n - 1)]) if f in term else np.ones((n, 1))
            out = np.kron(out, block)
        return out

    def averaging(self, term: Sequence[str]) -> np.ndarray:
        """Matrix from cell means to the marginal means of a term, per cell."""
        out = np.ones((1, 1))
        for f, values in self.levels:
            n = len(values)
            out = np.kron(out, np.eye(n) if f in term else np.full((n, n), 1.0 / n))
        return out

    def effect(self, term: Sequence[str]) -> np.ndarray:
        """Matrix from cell means to the estimated effect of a term."""
        out = np.ones((1, 1))
        for f, values in self.levels:
            n = len(values)
            mean = np.full((n, n), 1.0 / n)
            out = np.kron(out, np.eye(n) - mean if f in term else mean)
        return out

    def label(self, cell: int) -> tuple[str, ...]:
        out = []
        for _, values in reversed(self.levels):
            cell, i = divmod(cell, len(values))
            out.append(values[i])
        return tuple(reversed(out))


def term_name(term: Sequence[str]) -> str:
    return ":".join(term)


def observed_levels(runs: DataFrame, factors: Sequence[str] = FACTORS) -> dict[str, list[str]]:
    """Sorted levels found in the log. A factor with more than MAX_CELLS levels
    is no factor of a design that can be solved, and an error."""
    pairs = F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).cast("string").alias("v")) for f in factors])
    limit = MAX_CELLS * len(factors)
    found = runs.select(F.inline(pairs)).where("v is not null").distinct().limit(limit + 1).collect()
    levels = {f: sorted(r["v"] for r in found if r["f"] == f) for f in factors}
    if len(found) > limit or any(len(v) > MAX_CELLS for v in levels.values()):
        raise ValueError(f"more than {MAX_CELLS} levels of a factor")
    return levels


def moments(design: Design, rows: DataFrame, outcomes: Sequence[str], block: str | None,
            by: Sequence[str] = ()) -> DataFrame:
    """(by, outcome, cell, block, n, mean, m2) of the rows; ``m2`` is the sum
    of squared deviations within the block and cell.
    """
    place = rows if "cell" in rows.columns else rows.withColumn("cell", design.declared_cell())
    key = F.col(block) if block else F.lit(0)
    aggs = []
    for c in outcomes:
        x = F.col(c).cast("double")
        aggs += [F.count(x).alias(f"{c}__n"), F.avg(x).alias(f"{c}__mean"),
                 (F.var_pop(x) * F.count(x)).alias(f"{c}__m2")]
    wide = place.groupBy(*by, "cell", key.alias("block")).agg(*aggs)
    entries = [
        F.struct(F.lit(c).alias("outcome"), F.col(f"{c}__n").alias("n"), F.col(f"{c}__mean").alias("mean"),
                 F.col(f"{c}__m2").alias("m2")) for c in outcomes]
    return wide.select(*by, "cell", "block", F.inline(F.array(*entries))).filter("n > 0")


STATE = ("n_rows double, n_blocks double, gram array<double>, rhs array<double>, within double, "
         "cell_n array<double>, cell_s array<double>, cell_q array<double>, lo_n double, hi_n double, n_cells double, "
         "block_share array<double>, block_mean double, block_inverse double")


def _absorb(cells: int):
    """Sufficient statistics of a set of whole blocks, block effects removed.

    gram = sum over blocks of diag(n) - n n'/N, rhs likewise, within = squared
    deviations inside blocks; cell_* are plain cell sums about ``shift``. A
    block's own level is its mean less the effects of its cells, each weighted
    with n/N: block_share, block_mean and block_inverse add up n/N, the mean and
    1/N over the blocks, so that the constant can be told from their levels.
    """
    def run(pdf: pd.DataFrame, head: dict) -> pd.DataFrame:
        gram, rhs = np.zeros((cells, cells)), np.zeros(cells)
        cn, cs, cq = np.zeros(cells), np.zeros(cells), np.zeros(cells)
        within = float(pdf["m2"].sum())
        share, means, inverse = np.zeros(cells), 0.0, 0.0
        codes, _ = pd.factorize(pdf["block"])
        order = np.argsort(codes, kind="stable")
        bounds = np.flatnonzero(np.diff(codes[order])) + 1
        cell, n, mean = (pdf[c].to_numpy() for c in ("cell", "n", "mean"))
        y = mean - pdf["shift"].to_numpy()
        blocks = np.split(order, bounds)
        for rows in blocks:
            c, w, v = cell[rows], n[rows].astype(float), y[rows]
            total = w.sum()
            level = (w @ v) / total
            d = v - level
            share[c] += w / total
            means += level
            inverse += 1 / total
            gram[c, c] += w
            gram[np.ix_(c, c)] -= np.outer(w, w) / total
            rhs[c] += w * d
            within += float(w @ (d * d))
            cn[c] += w
            cs[c] += w * v
            cq[c] += w * v * v
        return pd.DataFrame([{
            **head, "n_rows": float(n.sum()), "n_blocks": float(len(blocks)), "gram": gram.ravel(), "rhs": rhs,
            "within": within, "cell_n": cn, "cell_s": cs, "cell_q": cq + np.bincount(cell, pdf["m2"], cells),
            "lo_n": float(n.min()), "hi_n": float(n.max()), "n_cells": float(len(pdf)),
            "block_share": share, "block_mean": float(means), "block_inverse": inverse}])
    return run


def _added(pdf: pd.DataFrame) -> dict:
    """Sum of states; blocks must not be split between them."""
    out = {c: float(pdf[c].sum()) for c in ("n_rows", "n_blocks", "within", "n_cells", "block_mean", "block_inverse")}
    out |= {c: np.sum([np.asarray(v) for v in pdf[c]], axis=0) for c in ("gram", "rhs", "cell_n", "cell_s", "cell_q", "block_share")}
    return out | {"lo_n": float(pdf["lo_n"].min()), "hi_n": float(pdf["hi_n"].max())}


def absorbed(design: Design, base: DataFrame, by: Sequence[str]) -> DataFrame:
    """One state per (by): the cell table with the block effects removed.

    Blocks are hashed over as many tasks as the table needs, so their number
    is free; a state's size depends on the number of cells only.
    """
    by = list(by)
    base, size = small_copy(base)
    kinds = {f.name: f.dataType.simpleString() for f in base.schema.fields}
    head = ", ".join(f"{c} {kinds[c]}" for c in by)
    absorb = _absorb(design.cells)
    if size is None:
        size = base.count()
    tasks = max(1, -(-size // ROWS_PER_TASK))

    def keys(pdf: pd.DataFrame) -> dict:
        return {c: pdf[c].iloc[0] for c in [*by, "task", "shift"]}

    if tasks == 1:
        def whole(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.assign(task=0, shift=np.average(pdf["mean"], weights=pdf["n"]))
            return absorb(pdf, keys(pdf))

        return base.groupBy(*by).applyInPandas(whole, f"{head}, task bigint, shift double, {STATE}")

    centre = checked_small(base.groupBy(*by).agg(F.avg("mean").alias("shift")))
    rows = base.join(centre, by).withColumn("task", F.pmod(F.xxhash64("block"), F.lit(tasks)).cast("bigint"))
    state = rows.groupBy(*by, "task").applyInPandas(
        lambda pdf: absorb(pdf, keys(pdf)), f"{head}, task bigint, shift double, {STATE}")
    while tasks > 1:
        tasks = -(-tasks // MERGE_WIDTH)
        state = state.withColumn("task", F.pmod(F.col("task"), F.lit(tasks))).groupBy(*by, "task").applyInPandas(
            lambda pdf: pd.DataFrame([{**keys(pdf), **_added(pdf)}]), f"{head}, task bigint, shift double, {STATE}")
    return state


class Fit:
    """Least squares solution of one state.

    ``block`` is None (no block), "fixed" (an additive block), "pooled" (the
    blocks in the state, but not in the model) or "mixed" (a random block).
    """

    def __init__(self, design: Design, state: pd.Series, block: str | None):
        self.design, self.block = design, block
        k = design.cells
        self.cell_n = np.asarray(state["cell_n"])
        empty = [design.label(i) for i in np.flatnonzero(self.cell_n == 0)]
        if empty:
            raise ValueError(f"empty cells: {empty}")
        self.n, self.blocks = state["n_rows"], state["n_blocks"] if block else 1.0
        self.balanced = state["lo_n"] == state["hi_n"] and state["n_cells"] == k * state["n_blocks"]
        self.terms = design.terms()
        parts = [design.contrasts(t) for t in self.terms]
        edges = np.cumsum([0] + [p.shape[1] for p in parts])
        self.span = {t: slice(edges[i], edges[i + 1]) for i, t in enumerate(self.terms)}
        self.x = np.hstack(parts)
        self.shift = state["shift"]
        s, q = np.asarray(state["cell_s"]), np.asarray(state["cell_q"])
        gram, rhs, within = np.asarray(state["gram"]).reshape(k, k), np.asarray(state["rhs"]), float(state["within"])
        if block == "pooled":  # one block of all rows
            gram = np.diag(self.cell_n) - np.outer(self.cell_n, self.cell_n) / self.n
            rhs = s - self.cell_n * s.sum() / self.n
        inner = self.x.T @ gram @ self.x
        if np.linalg.matrix_rank(inner, hermitian=True) < len(inner):
            raise ValueError("blocks hold too few cells together: effects and blocks cannot be told apart")
        self.inverse = np.linalg.inv(inner)
        self.beta = self.inverse @ (self.x.T @ rhs)
        self.effects = self.x @ self.beta
        self.cell_mean = s / self.cell_n + self.shift
        self.pure = max(float(np.sum(q - s * s / self.cell_n)), 0.0)  # within cells, block ignored
        self.total = float(np.sum(q) - np.sum(s) ** 2 / self.n)
        self.df = self.n - (k - 1) - self.blocks
        within_blocks = max(within - float(self.beta @ (self.x.T @ rhs)), 0.0)
        self.resid = within_blocks if block in ("fixed", "mixed") else self.pure
        if block == "pooled":
            self.df = self.n - k
        if block == "mixed":
            self._mix()
        if block in ("fixed", "mixed"):
            share = self.x.T @ np.asarray(state["block_share"])
            self.constant = (state["block_mean"] - share @ self.beta) / self.blocks + self.shift
            # levels of the blocks and effects of the cells are independent estimates' sums
            self.constant_variance = (state["block_inverse"] + share @ self.inverse @ share) / self.blocks ** 2
        else:
            self.constant = float(self.cell_mean.mean())
            self.constant_variance = float(np.sum(1.0 / self.cell_n)) / k ** 2

    def _mix(self) -> None:
        """Restricted likelihood with a random block, for complete balanced blocks.

        A block's variance is (block mean square - residual mean square) / rows
        of a block, or zero where that is negative. Above zero the terms are
        tested as with fixed blocks. At zero the residual variance is estimated
        from both strata; the denominator df stay those of the residual stratum,
        as both variances stay parameters (Kenward and Roger's approximation).
        """
        if not self.balanced:
            raise ValueError("a random block needs as many runs of each configuration in each block")
        between = max(self.pure - self.resid, 0.0)
        residual = self.resid / self.df if self.df > 0 else 0.0
        self.block_variance = max((between / (self.blocks - 1) - residual) * self.blocks / self.n, 0.0) if self.blocks > 1 else 0.0
        if self.block_variance == 0.0 and self.df > 0:
            self.resid = self.pure * self.df / (self.df + self.blocks - 1)  # pooled variance, residual df

    def sum_sq(self, term) -> float:
        part = self.span[term]
        b = self.beta[part]
        return float(b @ np.linalg.solve(self.inverse[part, part], b))

    def intercept(self) -> float:
        """The constant's sum of squares; blocks, too, add up to zero."""
        return float(self.constant ** 2 / self.constant_variance)

    def contrast(self, weights: np.ndarray) -> tuple[float, float]:
        """(estimate, variance in units of the residual variance) of a weighted
        sum of the cells' effects."""
        of_beta = weights @ self.x
        return float(of_beta @ self.beta), float(of_beta @ self.inverse @ of_beta)


def _row(term: str, ss: float | None, df: float, fit: Fit, tested: bool = True) -> dict:
    mse = fit.resid / fit.df if fit.df > 0 else None
    f = ss / df / mse if tested and ss is not None and mse and df > 0 else None
    p = dist.f_tail(f, df, fit.df) if f is not None else None
    eta = ss / (ss + fit.resid) if tested and ss is not None and term != "Intercept" and ss + fit.resid > 0 else None
    return {"term": term, "sum_sq": ss, "df": float(df), "F": f, "p_value": p, "partial_eta2": eta}


TABLE = "term string, sum_sq double, df double, F double, p_value double, partial_eta2 double"


def anova_rows(fit: Fit) -> list[dict]:
    out = [_row("Intercept", fit.intercept(), 1, fit)]
    for t in fit.terms:
        out.append(_row(term_name(t), fit.sum_sq(t), fit.span[t].stop - fit.span[t].start, fit))
    if fit.block == "fixed":
        out.append(_row("block", max(fit.pure - fit.resid, 0.0), fit.blocks - 1, fit))
    out.append(_row("Residual", fit.resid, fit.df, fit, tested=False))
    return out


def _solved(design: Design, base: DataFrame, by: Sequence[str], block: str | None, rows_of, fields: str) -> DataFrame:
    """Solve every state of ``by`` in its own task."""
    state = absorbed(design, base, by)
    kinds = {f.name: f.dataType.simpleString() for f in state.schema.fields}
    head = ", ".join(f"{c} {kinds[c]}" for c in by)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        fit = Fit(design, pdf.iloc[0], block)
        keys = {c: pdf[c].iloc[0] for c in by}
        return pd.DataFrame([{**keys, **row} for row in rows_of(fit, keys)])

    return state.groupBy(*by).applyInPandas(solve, f"{head}, {fields}")


def type3_anova(runs: DataFrame, outcomes: Sequence[str] = ("energy_j",), levels: Mapping[str, Sequence[str]] | None = None,
                block: str | None = "block") -> DataFrame:
    """(outcome, term, sum_sq, df, F, p_value, partial_eta2): the full
    factorial with sum-to-zero contrasts, balanced or not, plus Intercept,
    block and Residual rows. Empty cells raise.
    """
    design = Design.of(levels or observed_levels(runs))
    base = moments(design, runs, outcomes, block)
    return _solved(design, base, ["outcome"], "fixed" if block else None, lambda fit, keys: anova_rows(fit), TABLE)


def model_fit(runs: DataFrame, outcomes: Sequence[str] = ("energy_j",), levels: Mapping[str, Sequence[str]] | None = None,
              block: str | None = "block") -> DataFrame:
    """(outcome, n, df_resid, r_squared, rmse)."""
    design = Design.of(levels or observed_levels(runs))

    def rows_of(fit: Fit, keys: dict) -> list[dict]:
        return [{"n": fit.n, "df_resid": fit.df, "r_squared": 1 - fit.resid / fit.total if fit.total else None,
                 "rmse": (fit.resid / fit.df) ** 0.5 if fit.df > 0 else None}]

    base = moments(design, runs, outcomes, block)
    return _solved(design, base, ["outcome"], "fixed" if block else None, rows_of,
                   "n double, df_resid double, r_squared double, rmse double")


def effect_rows(anova: DataFrame) -> DataFrame:
    """The tested terms: no Intercept, no Residual."""
    return anova.filter(~F.col("term").isin("Intercept", "Residual"))


def ranked_effects(anova: DataFrame) -> DataFrame:
    """Effects by falling partial eta squared, with its verbal label."""
    labelled = effect_rows(anova).withColumn("eta2_interpretation", eta_label(F.col("partial_eta2")))
    return labelled.orderBy(F.col("partial_eta2").desc_nulls_last(), "term")


def residuals(runs: DataFrame, outcome: str = "energy_j", levels: Mapping[str, Sequence[str]] | None = None,
              block: str | None = "block") -> DataFrame:
    """The rows with fitted value and residual of the factorial + block model.

    Cell effects come from the solved cell table (one row per cell, broadcast
    after a size check); a block's effect is the mean of what they leave.
    """
    design = Design.of(levels or observed_levels(runs))
    base = checked_small(moments(design, runs, [outcome], block))

    def rows_of(fit: Fit, keys: dict) -> list[dict]:
        values = fit.effects if fit.block else fit.cell_mean
        return [{"cell": i, "__cell_effect": float(v)} for i, v in enumerate(values)]

    cells = checked_small(_solved(design, base, ["outcome"], "fixed" if block else None, rows_of,
                                  "cell int, __cell_effect double").drop("outcome"))
    rows = runs.withColumn("cell", design.cell()).join(cells, "cell", "left")
    if block is None:
        fitted = rows.withColumn("fitted", F.col("__cell_effect"))
    else:
        left = base.join(cells, "cell").groupBy(F.col("block").alias("__b")).agg(
            (F.sum(F.col("n") * (F.col("mean") - F.col("__cell_effect"))) / F.sum("n")).alias("__block_effect"))
        left = checked_small(left)
        fitted = rows.join(left, F.col(block) == F.col("__b"), "left").withColumn(
            "fitted", F.col("__cell_effect") + F.col("__block_effect"))
    return fitted.withColumn("residual", F.col(outcome) - F.col("fitted")).select(
        *runs.columns, "fitted", "residual")


def interpretation(runs: DataFrame, anova: DataFrame, k: int = 10) -> DataFrame:
    """(kind, name, value, label): the best configuration with its interval,
    then the strongest effects."""
    from tallywatt.operators.summary import config_summary

    best = config_summary(runs).filter("energy_rank = 1")
    facts = [("mean energy (J)", "energy_mean"), ("95% low", "energy_ci95_low"), ("95% high", "energy_ci95_high"),
             ("mean runtime (s)", "runtime_mean"), ("mean peak memory (MB)", "memory_mean")]
    entries = F.array(*[
        F.struct(F.lit("best configuration").alias("kind"), F.lit(name).alias("name"), F.col(c).alias("value"),
                 F.col("config_id").alias("label")) for name, c in facts])
    strongest = ranked_effects(anova).limit(k).select(
        F.lit("effect").alias("kind"), F.col("term").alias("name"), F.col("partial_eta2").alias("value"),
        F.col("eta2_interpretation").alias("label"))
    return best.select(F.inline(entries)).unionByName(strongest)
