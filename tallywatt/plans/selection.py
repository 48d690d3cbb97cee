"""Exact quantiles of many groups at once, by narrowing brackets.

A mergeable sketch per group brackets each wanted position between two values.
One scan then counts the rows below and on each bracket, and lists the few inside;
where they are expected to be many, they are sketched instead and the next bracket
is some fifty times smaller. Rows are never moved: what is shuffled are sketches
and lists of a bounded size. A bracket that missed its position is widened, so
sketches decide only how often the table is read: twice for groups of up to some
million rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tallywatt.plans.ranks import null_safe
from tallywatt.plans.small import MAX_BROADCAST_BYTES, MAX_BROADCAST_ROWS, local_frame
from tallywatt.session import stored

#: Size parameter of the sketches, steps of their ranks, and rows expected inside
#: a bracket that are listed.
SIZE, STEPS, LISTED = 4000, 400, 20_000
LOCAL_ROWS = MAX_BROADCAST_ROWS

#: Per group and mark: the two values of the position (null: not known yet), the
#: bracket around them and whether its inside is to be listed.
STATE = {"__v0": "array<double>", "__v1": "array<double>", "__low": "array<double>", "__high": "array<double>", "__few": "array<boolean>"}


class Mark(NamedTuple):
    """A wanted quantile of a column."""

    source: int
    prob: float

    def places(self, n: int) -> tuple[int, int]:
        at = (n - 1) * self.prob
        return math.floor(at), math.ceil(at)


class Bracket(NamedTuple):
    v0: float | None
    v1: float | None
    low: float | None
    high: float | None
    few: bool


def _margin(size: int) -> float:
    """Twice the rank error that a sketch of that size keeps with 99 %, as a share."""
    return 2 * 2.296 / size ** 0.9723


def _around(ranks: Sequence[float], n: int, first: int, last: int, margin: float) -> tuple[float, float, bool]:
    """Values around the places ``first`` to ``last`` of n rows with these values
    at even ranks, and whether few are expected between."""
    a = min(max(math.floor((first / n - margin) * STEPS), 0), STEPS)
    b = max(min(math.ceil(((last + 1) / n + margin) * STEPS), STEPS), 0)
    return ranks[a], ranks[b], (b - a) * n / STEPS <= LISTED


def _start(mark: Mark, n: int, ranks: Sequence[float] | None, margin: float) -> Bracket:
    if n == 0:
        return Bracket(None, None, None, None, True)
    return Bracket(None, None, *_around(ranks, n, *mark.places(n), margin))


class Counted(NamedTuple):
    """Rows below a bracket, on its lower end, inside and on its upper end; what is inside."""

    below: int
    on: int
    inside: int
    top: int
    listed: Sequence[float]
    ranks: Sequence[float] | None


def _next(mark: Mark, n: int, least: float, most: float, old: Bracket, seen: Counted, margin: float) -> Bracket:
    """The two values, if the counts tell them, else a smaller bracket (a wider one after a miss)."""
    if n == 0 or old.v1 is not None:
        return old
    listed = np.sort(np.asarray(seen.listed, np.float64)) if old.few else ()
    p0, p1 = (p - seen.below for p in mark.places(n))
    upper = seen.on + seen.inside

    def value(p: int) -> float | None:
        if 0 <= p < seen.on:
            return old.low
        if seen.on <= p < upper:
            return float(listed[p - seen.on]) if old.few else None
        return old.high if upper <= p < upper + seen.top else None

    v0, v1 = value(p0), value(p1)
    if v0 is not None and v1 is not None:
        return Bracket(v0, v1, old.low, old.high, True)
    if p0 < 0 or p1 >= upper + seen.top:
        return Bracket(None, None, least if p0 < 0 else old.low, most if p1 >= upper + seen.top else old.high, n <= LISTED)
    low, high, few = _around(seen.ranks, seen.inside, max(p0 - seen.on, 0), min(p1 - seen.on, seen.inside - 1), margin)
    return Bracket(None, None, old.low if p0 < seen.on else low, old.high if p1 >= upper else high, few)


def _number(c: str) -> Column:
    return F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None))


def _ranks(sketch: Column, n: Column) -> Column:
    """The values of a sketch over n rows at every rank of 0 to STEPS."""
    steps = F.array(*[F.lit(k / STEPS) for k in range(STEPS + 1)])
    return F.when(n > 0, F.kll_sketch_get_quantile_double(sketch, steps))


def _with_state(batch: pa.RecordBatch, rows: list[list[Bracket]], drop: Sequence[str]) -> pa.Table:
    """The batch with the brackets of its rows in place of the columns ``drop``."""
    kept = [c for c in batch.schema.names if c not in drop and c not in STATE]
    types = (pa.float64(),) * 4 + (pa.bool_(),)
    state = [pa.array([[getattr(b, name[2:]) for b in row] for row in rows], pa.list_(t)) for name, t in zip(STATE, types)]
    return pa.table([*[batch.column(c) for c in kept], *state], names=[*kept, *STATE])


class Kept(NamedTuple):
    frame: DataFrame
    local: pa.Table | None


def _computed(df: DataFrame, change: Callable[[pa.RecordBatch | pa.Table], pa.Table], drop: Sequence[str]) -> Kept:
    """``df`` with ``change`` applied, once: on the driver if it is small, else in tasks."""
    fields = [f for f in df.schema.fields if f.name not in drop and f.name not in STATE]
    schema = T.StructType(fields + [T.StructField(c, T.ArrayType(T.BooleanType() if "bool" in t else T.DoubleType())) for c, t in STATE.items()])
    found = df.limit(LOCAL_ROWS + 1).toArrow()
    if found.num_rows <= LOCAL_ROWS and found.nbytes <= MAX_BROADCAST_BYTES:
        told = change(found.combine_chunks())
        return Kept(local_frame(df.sparkSession, told, schema), told)

    def rows(batches):
        for batch in batches:
            yield from change(batch).to_batches()

    return Kept(stored(df.mapInArrow(rows, schema)), None)


def _first(df: DataFrame, cols: Sequence[str], keys: Sequence[str], marks: Sequence[Mark], extra: Sequence[Column], size: int) -> Kept:
    numbers = [_number(c) for c in cols]
    own = [f(x).alias(f"__{name}_{i}") for i, x in enumerate(numbers)
           for name, f in (("n", F.count), ("min", F.min), ("max", F.max), ("s", lambda x: F.kll_sketch_agg_double(x, F.lit(size))))]
    table = df.groupBy(*keys).agg(*extra, *own)
    table = table.withColumns({f"__r_{i}": _ranks(F.col(f"__s_{i}"), F.col(f"__n_{i}")) for i in range(len(cols))}).drop(
        *[f"__s_{i}" for i in range(len(cols))])
    margin, drop = _margin(size), [f"__r_{i}" for i in range(len(cols))]

    def change(batch) -> pa.Table:
        n, ranks = ([batch.column(f"__{x}_{i}").to_pylist() for i in range(len(cols))] for x in "nr")
        rows = [[_start(m, n[m.source][k], ranks[m.source][k], margin) for m in marks] for k in range(batch.num_rows)]
        return _with_state(batch, rows, drop)

    return _computed(table, change, drop)


def _narrowed(df: DataFrame, cols: Sequence[str], keys: Sequence[str], marks: Sequence[Mark], groups: DataFrame, all_few: bool, size: int) -> Kept:
    """``groups`` (with __g, their number) after one more scan of the rows."""
    bounds = F.broadcast(groups) if not keys else groups
    bounds = bounds.select(*keys, "__g", *[F.get(f"__{b}", F.lit(j)).alias(f"__{b}_{j}") for j in range(len(marks)) for b in ("low", "high", "few")])
    values = df.select(*keys, *[_number(c).alias(f"__x_{i}") for i, c in enumerate(cols)])
    rows = null_safe(values, bounds, keys, "inner") if keys else values.crossJoin(F.broadcast(bounds))  # one row of bounds
    aggs = []
    for j, m in enumerate(marks):
        x, low, high, few = (F.col(f"__{c}") for c in (f"x_{m.source}", f"low_{j}", f"high_{j}", f"few_{j}"))
        inside = (x > low) & (x < high)
        aggs += [F.count(F.when(test, 1)).alias(f"__{name}_{j}") for name, test in (
            ("below", x < low), ("on", x == low), ("inside", inside), ("top", (x == high) & (high > low)))]
        aggs.append(F.collect_list(F.when(inside & few, x)).alias(f"__list_{j}"))
        if not all_few:
            aggs += [F.count(F.when(inside & ~few, 1)).alias(f"__m_{j}"),
                     F.kll_sketch_agg_double(F.when(inside & ~few, x), F.lit(size)).alias(f"__s_{j}")]
    none = F.lit(None).cast("array<double>")
    # as many rows as groups
    told = rows.groupBy("__g").agg(*aggs)
    told = told.select("__g", *[f"__{x}_{j}" for j in range(len(marks)) for x in ("below", "on", "inside", "top", "list")], *[
        (none if all_few else _ranks(F.col(f"__s_{j}"), F.col(f"__m_{j}"))).alias(f"__r_{j}") for j in range(len(marks))])
    table = told.join(groups, "__g")
    names = ("below", "on", "inside", "top", "list", "r")
    margin, drop = _margin(size), ["__g", *[f"__{x}_{j}" for x in names for j in range(len(marks))]]

    def change(batch) -> pa.Table:
        seen = [[batch.column(f"__{x}_{j}").to_pylist() for x in names] for j in range(len(marks))]
        whole = [[batch.column(f"__{x}_{i}").to_pylist() for x in ("n", "min", "max")] for i in range(len(cols))]
        old = [batch.column(c).to_pylist() for c in STATE]
        rows = [[_next(m, *[c[k] for c in whole[m.source]], Bracket(*[c[k][j] for c in old]),
                       Counted(*[c[k] for c in seen[j][:4]], seen[j][4][k] or (), seen[j][5][k]), margin)
                 for j, m in enumerate(marks)] for k in range(batch.num_rows)]
        return _with_state(batch, rows, drop)

    return _computed(table, change, drop)


def _open(marks: Sequence[Mark]) -> Column:
    out = F.lit(False)
    for j, m in enumerate(marks):
        out = out | ((F.col(f"__n_{m.source}") > 0) & F.get("__v1", F.lit(j)).isNull())
    return out


def quantile_table(df: DataFrame, cols: Sequence[str], probs: Sequence[float], keys: Sequence[str] = (),
                   extra: Iterable[Column] = (), size: int = SIZE) -> DataFrame:
    """One row per group of ``keys`` (null is a group): the aggregates ``extra``
    and, for column i and probability j, ``q_i_j`` with linear interpolation
    between the two rows around (rows - 1) * prob, and the number of values
    ``n_i``. Null and NaN are skipped; a column without values has null.
    """
    marks = [Mark(i, p) for i in range(len(cols)) for p in probs]
    state, parts = _first(df, cols, keys, marks, list(extra), size), []
    while True:
        is_open = _open(marks)
        parts.append(state.frame.where(~is_open))
        left = state.frame.where(is_open)
        if state.local is None:
            left = stored(left.withColumn("__g", F.monotonically_increasing_id()))
            few, done = False, not left.take(1)
        else:
            told = _open_rows(state.local, marks)
            few, done = all(all(row) for row in told.column("__few").to_pylist()), told.num_rows == 0
            left = local_frame(df.sparkSession, told.append_column("__g", pa.array(np.arange(told.num_rows))),
                               T.StructType([*state.frame.schema.fields, T.StructField("__g", T.LongType())]))
        if done:
            break
        state = _narrowed(df, cols, keys, marks, left, few, size)
    table = parts[0]
    for part in parts[1:]:
        table = table.unionByName(part)
    out = []
    for j, m in enumerate(marks):
        at = (F.col(f"__n_{m.source}") - 1) * F.lit(float(m.prob))
        low, high = F.get("__v0", F.lit(j)), F.get("__v1", F.lit(j))
        out.append((low + (high - low) * (at - F.floor(at))).alias(f"q_{m.source}_{j % len(probs)}"))
    kept = [c for c in table.columns if not c.startswith("__")]
    return table.select(*[F.col(f"`{c}`") for c in kept], *[F.col(f"__n_{i}").alias(f"n_{i}") for i in range(len(cols))], *out)


def _open_rows(table: pa.Table, marks: Sequence[Mark]) -> pa.Table:
    n = [table.column(f"__n_{m.source}").to_pylist() for m in marks]
    known = table.column("__v1").to_pylist()
    return table.filter(pa.array([any(n[j][k] > 0 and known[k][j] is None for j in range(len(marks))) for k in range(table.num_rows)], pa.bool_()))


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], keys: Sequence[str] = (), size: int = SIZE) -> DataFrame:
    """(keys, column, prob, quantile) of ``quantile_table``, columns without values left out."""
    table = quantile_table(df, cols, probs, keys, size=size)
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(float(p)).alias("prob"), F.col(f"q_{i}_{j}").alias("quantile"))
                     for i, c in enumerate(cols) for j, p in enumerate(probs)])
    return table.select(*keys, F.inline(rows)).where("quantile is not null")


def medians(df: DataFrame, cols: Sequence[str], keys: Sequence[str], suffix: str = "_median", extra: Iterable[Column] = (),
            size: int = SIZE) -> DataFrame:
    """Wide (keys, extra, <col><suffix>) exact medians, aggregates of ``extra`` beside them."""
    table = quantile_table(df, cols, [0.5], keys, extra, size)
    own = {f"{x}_{i}{tail}" for i in range(len(cols)) for x, tail in (("n", ""), ("q", "_0"))}
    return table.select(*[F.col(f"`{c}`") for c in table.columns if c not in own],
                        *[F.col(f"q_{i}_0").alias(f"{c}{suffix}") for i, c in enumerate(cols)])
