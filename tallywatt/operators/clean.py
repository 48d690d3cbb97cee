"""Column checks, casts, deduplication, constant columns, filters, samples."""

from __future__ import annotations

import logging
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T, Window as W

from tallywatt.plans.small import MAX_BROADCAST_ROWS, checked_small, small_copy
from tallywatt.schema import CATEGORY_COLUMNS, NUMERIC_COLUMNS, PROTECTED_COLUMNS, TELEMETRY_COLUMNS

log = logging.getLogger(__name__)


def check_columns(df: DataFrame, expected: Sequence[str] = TELEMETRY_COLUMNS) -> list[str]:
    """Raise on missing columns, warn about extra ones and return those."""
    missing = [c for c in expected if c not in df.columns]
    extra = [c for c in df.columns if c not in expected]
    if missing:
        raise ValueError(f"missing columns {missing}; unexpected columns {extra}")
    if extra:
        log.warning("extra columns kept: %s", extra)
    return extra


def numeric_columns(df: DataFrame, skip: Iterable[str] = ("sample_index",)) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in set(skip)]


def to_number(df: DataFrame, name: str, dtype: str) -> Column:
    """A number of the wanted type; unreadable text and NaN become null."""
    value = F.col(name)
    if isinstance(df.schema[name].dataType, T.StringType):
        value = value.try_cast(dtype)
    else:
        value = value.cast(dtype)
    return F.nanvl(value, F.lit(None).cast(dtype))


def cast_numeric(df: DataFrame, dtype: str = "double", cols: Sequence[str] = NUMERIC_COLUMNS) -> DataFrame:
    present = [c for c in cols if c in df.columns]
    return df.withColumns({c: to_number(df, c, dtype) for c in present})


def parse_timestamp(df: DataFrame, col: str = "timestamp") -> DataFrame:
    """Text to timestamp, unreadable text to null; other types pass through."""
    if isinstance(df.schema[col].dataType, T.StringType):
        return df.withColumn(col, F.try_to_timestamp(F.col(col)))
    return df


def dedup(df: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """Distinct rows. Copies collapse map-side, so a row repeated billions of
    times adds one row per task to the shuffle. ``keys`` is for callers who
    know a unique key: it shuffles the same rows but compares fewer columns.
    """
    return df.dropDuplicates(list(keys)) if keys else df.dropDuplicates()


def _repeated_hashes(df: DataFrame, max_repeated: int) -> tuple[Column, DataFrame | None, int | None]:
    """The row hash, the hashes that occur more than once and their number
    (None if above the limit)."""
    if any(isinstance(f.dataType, T.MapType) for f in df.schema.fields):
        raise TypeError("rows with map columns cannot be compared")
    key = F.xxhash64(*df.columns)
    counts = df.select(key.alias("__hash")).groupBy("__hash").agg(F.count(F.lit(1)).alias("__n"))
    repeated, size = small_copy(counts.filter("__n > 1").select("__hash"), max_repeated)
    return key, F.broadcast(repeated), size


def dedup_stored(df: DataFrame, max_repeated: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Distinct rows of a stored table with few repeats, without shuffling
    the rows.

    One pass counts row hashes: eight bytes per row are shuffled instead of
    all columns. A row whose hash occurs once has no copy and stays where it
    is; only the rows behind a repeated hash are compared in full, so hash
    collisions do no harm. With more than ``max_repeated`` repeated hashes
    this is the plain distinct. The table is scanned up to three times, which
    pays off when scanning is cheaper than shuffling it.
    """
    key, repeated, size = _repeated_hashes(df, max_repeated)
    if size is None:
        return df.dropDuplicates()
    if size == 0:
        return df
    hashed = df.withColumn("__hash", key)
    alone = hashed.join(repeated, "__hash", "left_anti").select(*df.columns)
    copies = hashed.join(repeated, "__hash", "left_semi").select(*df.columns)
    return alone.unionByName(copies.dropDuplicates())


def constant_report(df: DataFrame, protected: Iterable[str] = PROTECTED_COLUMNS) -> DataFrame:
    """(column, is_constant) of every unprotected column in one pass.

    Null counts as a value: a column is constant when it is all null, or has
    no null and its minimum equals its maximum.
    """
    cols = [c for c in df.columns if c not in set(protected)]
    aggs = [F.count(F.lit(1)).alias("__rows")]
    for i, c in enumerate(cols):
        aggs += [F.min(c).alias(f"__lo{i}"), F.max(c).alias(f"__hi{i}"), F.count(c).alias(f"__n{i}")]
    entries = [
        F.struct(
            F.lit(c).alias("column"),
            (F.col(f"__lo{i}").eqNullSafe(F.col(f"__hi{i}"))
             & ((F.col(f"__n{i}") == 0) | (F.col(f"__n{i}") == F.col("__rows")))).alias("is_constant"),
        )
        for i, c in enumerate(cols)
    ]
    return df.agg(*aggs).select(F.inline(F.array(*entries)))


def constant_columns(df: DataFrame, protected: Iterable[str] = PROTECTED_COLUMNS, probe: int = 1000) -> list[str]:
    """Names of the unprotected constant columns.

    Copies of a row do not change the answer, so this runs on the source, not
    on the deduplicated frame. A probe of a few rows rules out most columns;
    only what is left is read in full, column-pruned.
    """
    cols = [c for c in df.columns if c not in set(protected)]
    if not cols:
        return []
    seen = df.select(*cols).limit(probe).collect()
    left = [c for i, c in enumerate(cols) if all(_same(r[i], seen[0][i]) for r in seen)]
    if not left or len(seen) < probe:
        return left
    found = constant_report(df.select(*left), protected=()).filter("is_constant").collect()
    return [r["column"] for r in found]


def _same(a, b) -> bool:
    return a == b or (a != a and b != b)


def drop_constant(df: DataFrame, protected: Iterable[str] = PROTECTED_COLUMNS) -> DataFrame:
    return df.drop(*constant_columns(df, protected))


def long_categories(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    entries = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols]
    return df.select(F.inline(F.array(*entries)))


def category_codes(df: DataFrame, cols: Sequence[str] = CATEGORY_COLUMNS, missing: str = "missing") -> DataFrame:
    """Dictionary (column, value, code): codes follow value order from 0. Null is
    a value of its own, placed right behind the text ``missing``."""
    values = long_categories(df, cols).distinct()
    order = W.partitionBy("column").orderBy(F.coalesce("value", F.lit(missing)), F.col("value").isNull())
    return values.withColumn("code", F.row_number().over(order) - 1)


#: Entries of a dictionary that is looked up in a literal map, without a join.
LITERAL_ENTRIES = 2000


def _looked_up(df: DataFrame, codes: DataFrame, cols: Sequence[str], found: str, wanted: str) -> DataFrame:
    """Each column's cell replaced by what the dictionary says, null-safe: from a
    literal map if the dictionary is small, else by one join per column."""
    codes, size = small_copy(codes)
    if size is not None and size <= LITERAL_ENTRIES:
        rows, out = codes.collect(), {}
        for c in cols:
            known = {r[found]: r[wanted] for r in rows if r["column"] == c}
            kind = codes.schema[wanted].dataType
            of_null = F.lit(known.pop(None, None)).cast(kind)
            cell = F.col(c).cast(codes.schema[found].dataType)
            entries = F.create_map(*[F.lit(v) for kv in known.items() for v in kv]) if known else None
            out[c] = F.when(cell.isNull(), of_null).otherwise(F.lit(None).cast(kind) if entries is None else F.try_element_at(entries, cell))
        return df.withColumns(out)
    out = df
    for c in cols:
        part = codes.filter(F.col("column") == c).select(F.col(found).alias("__f"), F.col(wanted).alias("__w"))
        cell = F.col(c).cast("string") if found == "value" else F.col(c)
        out = out.join(part, cell.eqNullSafe(F.col("__f")), "left").withColumn(c, F.col("__w")).drop("__f", "__w")
    return out.select(*df.columns)


def encode_categories(df: DataFrame, cols: Sequence[str] = CATEGORY_COLUMNS, missing: str = "missing",
                      codes: DataFrame | None = None) -> DataFrame:
    """Replace category text by its code."""
    return _looked_up(df, category_codes(df, cols, missing) if codes is None else codes, cols, "value", "code")


def decode_categories(df: DataFrame, codes: DataFrame, cols: Sequence[str] = CATEGORY_COLUMNS) -> DataFrame:
    """Codes back to text and null."""
    return _looked_up(df, codes, cols, "code", "value")


def ok_runs(runs: DataFrame) -> DataFrame:
    return runs.filter(F.col("status") == "ok")


def failed_runs(runs: DataFrame) -> DataFrame:
    return runs.filter(~F.col("status").eqNullSafe("ok"))


def normalise_runs(runs: DataFrame) -> DataFrame:
    """Rename the mode column of the raw log, check names, keep ok rows."""
    if "execution_mode" not in runs.columns and "threading_mode" in runs.columns:
        runs = runs.withColumnRenamed("threading_mode", "execution_mode")
    from tallywatt.schema import REQUIRED_RUN_COLUMNS

    check_columns(runs, REQUIRED_RUN_COLUMNS)
    return ok_runs(runs)


def invalid_outcomes(runs: DataFrame, outcomes: Sequence[str]) -> DataFrame:
    """Rows with a null or non-positive outcome."""
    bad = [F.col(c).isNull() | (F.col(c) <= 0) for c in outcomes]
    test = bad[0]
    for extra in bad[1:]:
        test = test | extra
    return runs.filter(test)


def select_configs(df: DataFrame, wanted: Mapping[str, str | Sequence[str] | None]) -> DataFrame:
    """Keep rows whose factors are in every given list; empty means all.

    A list may be given as comma-separated text.
    """
    for name, values in wanted.items():
        if isinstance(values, str):
            values = [v.strip() for v in values.split(",") if v.strip()]
        if values:
            df = df.filter(F.col(name).isin(list(values)))
    return df


def null_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(column, nulls) of the columns that have any."""
    cols = list(cols or df.columns)
    wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    entries = [F.struct(F.lit(c).alias("column"), F.col(c).alias("nulls")) for c in cols]
    return wide.select(F.inline(F.array(*entries))).filter("nulls > 0")


def duplicate_rows(df: DataFrame, max_repeated: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """One row: how many rows repeat an earlier identical row. Only rows
    behind a repeated hash are compared in full, as in ``dedup_stored``."""
    key, repeated, size = _repeated_hashes(df, max_repeated)
    if size is not None:
        df = df.withColumn("__hash", key).join(repeated, "__hash", "left_semi").select(*df.columns)
    counts = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("__n"))
    return counts.agg(F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).cast("bigint").alias("duplicate_rows"))


def distinct_counts(df: DataFrame, cols: Sequence[str] | None = None, error: float | None = None) -> DataFrame:
    """(column, distinct) with null counted as a value.

    Exact counts group the (column, value) pairs of all columns at once;
    ``error`` asks for sketches of that relative error in a single pass.
    """
    cols = list(cols or df.columns)
    has_null = lambda c: F.bool_or(F.col(c).isNull()).cast("bigint")
    if error is not None:
        wide = df.agg(*[(F.approx_count_distinct(c, error) + F.coalesce(has_null(c), F.lit(0))).alias(c) for c in cols])
        entries = [F.struct(F.lit(c).alias("column"), F.col(c).cast("bigint").alias("distinct")) for c in cols]
        return wide.select(F.inline(F.array(*entries)))
    names = spark_literals(df, cols)
    pairs = long_categories(df, cols).distinct().groupBy("column").agg(F.count(F.lit(1)).alias("distinct"))
    return names.join(pairs, "column", "left").select("column", F.coalesce("distinct", F.lit(0)).alias("distinct"))


def spark_literals(df: DataFrame, values: Sequence[str], name: str = "column") -> DataFrame:
    return df.sparkSession.createDataFrame([(v,) for v in values], f"`{name}` string")
