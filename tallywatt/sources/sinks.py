"""Writers of telemetry, run logs and result tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallywatt.operators import design as D
from tallywatt.schema import RUN_COLUMNS
from tallywatt.sources.tables import read_if_exists, read_telemetry


def _write(df: DataFrame, path: str, fmt: str, mode: str) -> None:
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    if fmt == "parquet":
        writer = writer.option("compression", "snappy")
    writer.save(path)


def csv_to_parquet(spark: SparkSession, source: str, target: str, mode: str = "errorifexists") -> None:
    """Convert telemetry CSV to Snappy Parquet."""
    _write(read_telemetry(spark, source, "csv"), target, "parquet", mode)


def append_rows(df: DataFrame, path: str, fmt: str = "parquet", overwrite: bool = False) -> None:
    """Append to a table folder, or start it afresh."""
    _write(df, path, fmt, "overwrite" if overwrite else "append")


def as_run_columns(runs: DataFrame) -> DataFrame:
    """The fixed run-log columns: missing ones null, extra ones left out."""
    if "threading_mode" not in runs.columns and "execution_mode" in runs.columns:
        runs = runs.withColumnRenamed("execution_mode", "threading_mode")
    return runs.select(*[
        (F.col(name).cast(kind) if name in runs.columns else F.lit(None).cast(kind)).alias(name)
        for name, kind in RUN_COLUMNS
    ])


def append_runs(runs: DataFrame, path: str, fmt: str = "csv") -> None:
    _write(as_run_columns(runs), path, fmt, "append")


def write_json_row(spark: SparkSession, facts: Mapping[str, object], path: str) -> None:
    """A metadata sidecar: one JSON object, values as text or numbers."""
    cells = [F.lit(v if isinstance(v, (int, float, bool)) or v is None else str(v)).alias(k) for k, v in facts.items()]
    spark.range(1).select(*cells).coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_pair(df: DataFrame, folder: str, facts: Mapping[str, object] = {}) -> dict[str, object]:
    """The same rows as CSV and Parquet plus a metadata sidecar.

    The Parquet copy is written first and read back for the CSV and the count,
    so the input is computed once and both copies hold the same rows.
    """
    spark = df.sparkSession
    paths = {"csv_path": f"{folder}/subset.csv", "parquet_path": f"{folder}/subset.parquet"}
    _write(df, paths["parquet_path"], "parquet", "overwrite")
    stored = spark.read.parquet(paths["parquet_path"])
    _write(stored, paths["csv_path"], "csv", "overwrite")
    meta = {"rows_used": stored.count(), **paths, **facts}
    write_json_row(spark, meta, f"{folder}/metadata.json")
    return meta


def files_digest(spark: SparkSession, path: str) -> str:
    """Names the state of a table's files: it changes with any file's path,
    length or time of modification. No file is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(
        "path", "length", F.unix_micros("modificationTime").alias("at"))
    told = files.agg(F.count("*").alias("n"), F.sum("length").alias("bytes"), F.bit_xor(F.xxhash64("path", "length", "at")).alias("mix"))
    return told.select(F.format_string("%d-%x-%016x", "n", "bytes", "mix")).first()[0]


def stored_subset(df: DataFrame, folder: str, source: str, rows: int, selection: str = "first", seed: int = 42) -> dict:
    """Rows of ``df``, which was read from the files at ``source``, kept under a
    name made of the wanted rows and the state of those files: asking again
    returns what is there, and a changed source gives another name."""
    choose = {"first": lambda: D.first_n(df, rows), "random": lambda: D.random_n(df, rows, seed)}
    if selection not in choose:
        raise ValueError(f"selection is 'first' or 'random', not {selection!r}")
    spark = df.sparkSession
    wanted = f"{selection}-{rows}" + (f"-{seed}" if selection == "random" else "")
    place = f"{folder}/{wanted}@{files_digest(spark, source)}"
    kept = read_if_exists(spark, f"{place}/metadata.json", "json")
    if kept is not None:
        return kept.first().asDict()
    subset = choose[selection]()
    if subset.isEmpty():
        raise ValueError(f"{source} gives no rows")
    return write_pair(subset, place, {"source": source, "selection": selection, "rows_wanted": rows, "seed": seed})


def run_metadata(runs: DataFrame, path: str, facts: Mapping[str, object] = {}) -> dict[str, object]:
    """Sidecar of a run set: configuration, block and run counts, settings."""
    counts = runs.agg(F.count_distinct("config_id").alias("configuration_count"),
                      F.count_distinct("block").alias("runs_per_configuration"),
                      F.count(F.lit(1)).alias("measured_run_count")).first().asDict()
    meta = {**counts, **facts}
    write_json_row(runs.sparkSession, meta, path)
    return meta


def write_result(df: DataFrame, folder: str, name: str, fmt: str = "csv", order: Sequence[str] = ()) -> str:
    """An analysis table under its name."""
    path = f"{folder}/{name}.{fmt}"
    _write(df.orderBy(*order) if order else df, path, fmt, "overwrite")
    return path
