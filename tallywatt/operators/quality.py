"""Validation reports, fingerprints and tolerant comparison."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tallywatt.functions.values import row_sha256
from tallywatt.operators.clean import duplicate_rows, numeric_columns
from tallywatt.schema import PROTECTED_COLUMNS, TELEMETRY_COLUMNS

HASH_WORDS = 4


def row_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: how many rows (with repeats) are only in a, only in b.

    Both tables are counted into one grouping with opposite signs: one
    shuffle, and copies collapse map-side.
    """
    cols = a.columns
    both = a.withColumn("__side", F.lit(1)).unionByName(b.select(*cols).withColumn("__side", F.lit(-1)))
    extra = both.groupBy(*cols).agg(F.sum("__side").alias("__d"))
    return extra.agg(
        F.coalesce(F.sum(F.greatest(F.col("__d"), F.lit(0))), F.lit(0)).cast("bigint").alias("only_in_first"),
        F.coalesce(F.sum(F.greatest(-F.col("__d"), F.lit(0))), F.lit(0)).cast("bigint").alias("only_in_second"))


def compare_copies(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: row counts, column order and row equality of two copies."""
    rows = lambda df, name: df.agg(F.count(F.lit(1)).alias(name), F.lit(1).alias("__one"))
    counts = rows(a, "first_rows").join(rows(b, "second_rows"), "__one")
    same_names = sorted(a.columns) == sorted(b.columns)
    if same_names:
        difference = row_difference(a, b).withColumn("__one", F.lit(1))
    else:
        difference = a.sparkSession.range(1).select(
            F.lit(None).cast("bigint").alias("only_in_first"), F.lit(None).cast("bigint").alias("only_in_second"),
            F.lit(1).alias("__one"))
    return counts.join(difference, "__one").drop("__one").withColumns({
        "first_columns": F.lit(len(a.columns)), "second_columns": F.lit(len(b.columns)),
        "same_column_order": F.lit(a.columns == b.columns),
        "same_row_count": F.col("first_rows") == F.col("second_rows")})


def column_facts(df: DataFrame, protected: Iterable[str] = PROTECTED_COLUMNS) -> DataFrame:
    """(check, column, value) of everything one scan can tell: the row count,
    constant columns and null counts."""
    rows = F.col("__rows")
    aggs, facts = [F.count(F.lit(1)).alias("__rows")], [_fact("rows", None, rows)]
    for i, c in enumerate(df.columns):
        n = F.col(f"__n{i}")
        aggs.append(F.count(c).alias(f"__n{i}"))
        facts.append(_fact("nulls", c, F.when(n < rows, rows - n)))
        if c not in set(protected):
            aggs += [F.min(c).alias(f"__lo{i}"), F.max(c).alias(f"__hi{i}")]
            same = F.col(f"__lo{i}").eqNullSafe(F.col(f"__hi{i}")) & ((n == 0) | (n == rows))
            facts.append(_fact("constant", c, F.when(same, F.lit(1))))
    return df.agg(*aggs).select(F.inline(F.array(*facts))).filter("value is not null")


def _fact(check: str, column: str | None, value: Column) -> Column:
    return F.struct(F.lit(check).alias("check"), F.lit(column).cast("string").alias("column"),
                    value.cast("bigint").alias("value"))


def validate_telemetry(df: DataFrame, copy: DataFrame | None = None,
                       expected: Sequence[str] = TELEMETRY_COLUMNS) -> DataFrame:
    """(check, column, value): counts, missing and extra names, duplicate
    rows, constant columns, null counts and the comparison with a copy.
    """
    names = [_fact("columns", None, F.lit(len(df.columns)))]
    names += [_fact("missing", c, F.lit(1)) for c in sorted(set(expected) - set(df.columns))]
    names += [_fact("extra", c, F.lit(1)) for c in sorted(set(df.columns) - set(expected))]
    out = column_facts(df).unionByName(df.sparkSession.range(1).select(F.inline(F.array(*names))))
    out = out.unionByName(duplicate_rows(df).select(F.inline(F.array(_fact("duplicate_rows", None, F.col("duplicate_rows"))))))
    if copy is not None:
        compared = [_fact(f"copy_{n}", None, F.col(n)) for n in (
            "second_rows", "second_columns", "same_column_order", "same_row_count", "only_in_first", "only_in_second")]
        out = out.unionByName(compare_copies(df, copy).select(F.inline(F.array(*compared))))
    return out


def fingerprint(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, rows, fingerprint): a hash of the rows that ignores their order.

    Every row's SHA-256 is cut into 60-bit words that are summed exactly, so
    the aggregate merges map-side and never lists the row hashes; repeated
    rows count. The sums and the row count are hashed once more.
    """
    words = [
        F.conv(F.substring(F.col("__sha"), 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)") for i in range(HASH_WORDS)
    ]
    hashed = df.select(*by, row_sha256(df).alias("__sha")).select(
        *by, *[w.alias(f"__w{i}") for i, w in enumerate(words)])
    sums = hashed.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.sum(f"__w{i}").alias(f"__s{i}") for i in range(HASH_WORDS)])
    text = F.concat_ws("-", F.col("rows").cast("string"),
                       *[F.coalesce(F.col(f"__s{i}"), F.lit(0)).cast("decimal(38,0)").cast("string") for i in range(HASH_WORDS)])
    return sums.select(*by, "rows", F.sha2(text, 256).alias("fingerprint"))


def equal_within(a: DataFrame, b: DataFrame, keys: Sequence[str], rtol: float = 1e-5, atol: float = 1e-8,
                 cols: Sequence[str] | None = None) -> DataFrame:
    """(keys, column, first, second, equal) of every numeric cell.

    Both tables meet in one grouping on the keys, so null keys match and no
    join is needed. A key found on one side only is unequal; two nulls are
    equal. Keys must be unique in each table (``first_rows`` and
    ``second_rows`` say so).
    """
    cols = list(cols or [c for c in numeric_columns(a, keys) if c in b.columns])

    def long(df: DataFrame, side: int) -> DataFrame:
        entries = [F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in cols]
        return df.select(*keys, F.inline(F.array(*entries))).withColumn("__side", F.lit(side))

    side = lambda i, c: F.when(F.col("__side") == i, F.col(c))
    both = long(a, 1).unionByName(long(b, 2)).groupBy(*keys, "column").agg(
        F.max(side(1, "value")).alias("first"), F.max(side(2, "value")).alias("second"),
        F.count_if(F.col("__side") == 1).alias("first_rows"), F.count_if(F.col("__side") == 2).alias("second_rows"))
    near: Column = F.abs(F.col("first") - F.col("second")) <= atol + rtol * F.abs(F.col("second"))
    equal = (
        F.when((F.col("first_rows") != 1) | (F.col("second_rows") != 1), F.lit(False))
        .when(F.col("first").isNull() & F.col("second").isNull(), F.lit(True))
        .otherwise(F.coalesce(near, F.lit(False)))
    )
    return both.withColumn("equal", equal)


def small_groups(df: DataFrame, keys: Sequence[str], minimum: int = 2) -> DataFrame:
    """Groups with too few rows for a standard deviation."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") < minimum)
