"""Experiment design tables: grid, randomized schedule, resume, samples."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tallywatt.operators.clean import select_configs
from tallywatt.plans.segments import with_history
from tallywatt.schema import FACTORS, PUBLISHED_LEVELS
from tallywatt.session import shuffle_partitions, stored

HASH_HEX = 13  # 52 bits: exact in a double


def config_id(factors: Sequence[str] = FACTORS) -> Column:
    return F.concat_ws("__", *factors)


def design_grid(spark: SparkSession, levels: Mapping[str, Sequence[str]] = PUBLISHED_LEVELS,
                wanted: Mapping[str, str | Sequence[str] | None] = {}) -> DataFrame:
    """Every combination of the declared factor levels, with its id.

    The product is built by exploding literal lists, one per factor.
    """
    grid = spark.range(1).select()
    for name, values in levels.items():
        grid = grid.select("*", F.explode(F.array(*[F.lit(v) for v in values])).alias(name))
    return select_configs(grid, wanted).withColumn("config_id", config_id(list(levels)))


def hash_key(*parts: Column) -> Column:
    """A uniform 52-bit number from the md5 of the dash-joined parts."""
    digest = F.md5(F.concat_ws("-", *[p.cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, HASH_HEX), 16, 10).cast("bigint")


def _hash_segment(key: Column, parts: int) -> Column:
    return F.floor(key / F.lit(2.0 ** (4 * HASH_HEX)) * parts)


def block_positions(units: DataFrame, block: str = "block", unit: str = "config_id", seed: int = 0,
                    name: str = "position_in_block", parts: int | None = None) -> DataFrame:
    """1-based position of every row in its block's shuffled order.

    The order is that of a hash of seed + block and the unit, so it is the
    same on every run. A hash is uniform, so equal hash ranges hold equal
    shares and a block of any size spreads over all tasks.
    """
    parts = parts or 4 * shuffle_partitions(units.sparkSession)
    keyed = units.withColumn("__h", hash_key(F.col(block) + F.lit(seed), F.col(unit)))
    placed = with_history(keyed, [block], "__h", index=name, segment=_hash_segment(F.col("__h"), parts), ties=[unit])
    return placed.withColumn(name, F.col(name) + 1).drop("__h")


def block_schedule(units: DataFrame, blocks: int, seed: int = 0, unit: str = "config_id",
                   parts: int | None = None) -> DataFrame:
    """Every unit once per block, in an order shuffled per block."""
    if blocks < 1:
        raise ValueError("blocks must be at least 1")
    spread = units.select("*", F.explode(F.sequence(F.lit(1), F.lit(blocks))).alias("block"))
    return block_positions(spread, unit=unit, seed=seed, parts=parts)


def pending_runs(schedule: DataFrame, log: DataFrame, keys: Sequence[str] = ("block", "config_id")) -> DataFrame:
    """Scheduled runs without an ok row; failed ones stay pending."""
    done = log.filter("status = 'ok'").select(*keys).distinct()
    return schedule.join(done, list(keys), "left_anti")


def latest_state(log: DataFrame, keys: Sequence[str] = ("block", "config_id"), order: str = "timestamp") -> DataFrame:
    """One row per key: an ok row beats a failed one, then the latest wins,
    then the greater row; the choice does not depend on row order.
    """
    rest = [c for c in log.columns if c not in keys]
    row = F.struct((F.col("status") == "ok").alias("__ok"), F.col(order).alias("__at"), *rest)
    best = log.groupBy(*keys).agg(F.max(row).alias("__row"))
    return best.select(*keys, *[F.col(f"__row.{c}").alias(c) for c in rest])


def _smallest(df: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """The n first rows by ``keys``, nulls first; ties fall by the other columns
    that can be ordered, in their order. Fewer rows if there are no more.

    The keys are dealt into ranges and counted; only the range that holds the
    n-th row is ordered, to find its key. The rows before that key are then a
    plain filter, so no task holds n rows, whatever n is.
    """
    rest = [f.name for f in df.schema if f.name not in keys and not isinstance(f.dataType, (T.MapType, T.VariantType))]
    order = F.struct(*keys, *rest)
    ranged = df.select(order.alias("k")).repartitionByRange(F.col("k"))
    placed = stored(ranged.select("k", F.spark_partition_id().alias("range")))
    before = 0
    for range_, rows in sorted(map(tuple, placed.groupBy("range").count().collect())):  # one row per task
        if before + rows >= n:
            break
        before += rows
    else:
        return df
    edge = (placed.where(F.col("range") == range_).orderBy("k").limit(n - before)
            .agg(F.max("k").alias("k"), F.count_if(F.lit(True)).alias("n")))
    inside = placed.where(F.col("range") == range_).join(F.broadcast(edge.select(F.col("k").alias("edge"))), F.col("k") < F.col("edge"))
    left = n - before - inside.count()
    last = F.broadcast(edge.select(F.col("k").alias("__edge")))  # one row
    first = df.join(last, order < F.col("__edge")).drop("__edge")
    return first.unionByName(df.join(last, order.eqNullSafe(F.col("__edge"))).drop("__edge").limit(left))


def _check_rows(n: int) -> None:
    if n < 0:
        raise ValueError("rows must be 0 or a positive number")


def first_n(df: DataFrame, n: int, order: str = "sample_index") -> DataFrame:
    """The first n rows in sample order, a null order first; 0 means all."""
    _check_rows(n)
    return df if n == 0 else _smallest(df, [order], n)


def random_n(df: DataFrame, n: int, seed: int = 0, unit: str = "sample_index") -> DataFrame:
    """Exactly min(n, rows) rows without replacement; 0 means all. The seed
    decides which; a written result keeps ``unit`` to restore row order.
    """
    _check_rows(n)
    if n == 0:
        return df
    keyed = df.withColumn("__h", hash_key(F.lit(seed), F.col(unit)))
    return _smallest(keyed, ["__h", unit], n).drop("__h")


def expected_cells(spark: SparkSession, levels: Mapping[str, Sequence[str]], blocks: Sequence[int]) -> DataFrame:
    grid = design_grid(spark, levels)
    return grid.select("config_id", F.explode(F.array(*[F.lit(int(b)) for b in blocks])).alias("block"))


def check_design(runs: DataFrame, levels: Mapping[str, Sequence[str]], blocks: Sequence[int]) -> DataFrame:
    """Every expected or observed (block, config_id) with its run count and
    state: ok, missing, duplicated or unexpected.
    """
    expected = expected_cells(runs.sparkSession, levels, blocks).withColumns({"__want": F.lit(1), "__n": F.lit(0)})
    seen = runs.select("config_id", F.col("block").cast("int").alias("block")).withColumns(
        {"__want": F.lit(0), "__n": F.lit(1)})
    cells = expected.unionByName(seen).groupBy("block", "config_id").agg(
        F.max("__want").alias("__want"), F.sum("__n").alias("n"))
    state = (
        F.when(F.col("__want") == 0, "unexpected").when(F.col("n") == 0, "missing")
        .when(F.col("n") > 1, "duplicated").otherwise("ok")
    )
    return cells.select("block", "config_id", "n", state.alias("state"))


def design_summary(runs: DataFrame, levels: Mapping[str, Sequence[str]], blocks: Sequence[int]) -> DataFrame:
    """One row: observed and expected counts and whether the design passed."""
    cells = check_design(runs, levels, blocks)
    configs = reduce(lambda a, v: a * len(v), levels.values(), 1)
    seen = F.col("n") > 0
    return cells.agg(
        F.count_distinct(F.when(seen, F.col("config_id"))).alias("configs"),
        F.count_distinct(F.when(seen, F.col("block"))).alias("blocks"),
        F.sum("n").alias("rows"),
        F.bool_and(F.col("state") == "ok").alias("passed"),
    ).withColumns({"expected_configs": F.lit(configs), "expected_blocks": F.lit(len(blocks)),
                   "expected_rows": F.lit(configs * len(blocks))})


def check_levels(runs: DataFrame, levels: Mapping[str, Sequence[str]]) -> DataFrame:
    """(factor, level, state) with state ok, missing or extra."""
    declared = [F.struct(F.lit(f).alias("factor"), F.lit(v).alias("level")) for f, vs in levels.items() for v in vs]
    want = runs.sparkSession.range(1).select(F.inline(F.array(*declared)))
    have = runs.select(F.inline(F.array(*[
        F.struct(F.lit(f).alias("factor"), F.col(f).cast("string").alias("level")) for f in levels]))).distinct()
    both = want.withColumn("__want", F.lit(True)).withColumn("__have", F.lit(False)).unionByName(
        have.withColumn("__want", F.lit(False)).withColumn("__have", F.lit(True)))
    found = both.groupBy("factor", "level").agg(F.bool_or("__want").alias("__want"), F.bool_or("__have").alias("__have"))
    state = F.when(~F.col("__have"), "missing").when(~F.col("__want"), "extra").otherwise("ok")
    return found.select("factor", "level", state.alias("state"))


def check_workers(runs: DataFrame, single: str = "single") -> DataFrame:
    """Per mode: rows, and whether single has one worker and others more."""
    good = F.when(F.col("execution_mode") == single, F.col("workers") == 1).otherwise(F.col("workers") > 1)
    return runs.groupBy("execution_mode").agg(
        F.count(F.lit(1)).alias("rows"), F.bool_and(good).alias("passed"), F.bool_or(~good).alias("any_bad"))


def level_order(spark: SparkSession, levels: Mapping[str, Sequence[str]] = PUBLISHED_LEVELS) -> DataFrame:
    """(factor, level, position): the declared level order as a table."""
    entries = [
        F.struct(F.lit(f).alias("factor"), F.lit(v).alias("level"), F.lit(i).alias("position"))
        for f, vs in levels.items() for i, v in enumerate(vs)
    ]
    return spark.range(1).select(F.inline(F.array(*entries)))
