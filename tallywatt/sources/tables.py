"""Readers of telemetry and run-log tables."""

from __future__ import annotations

import logging

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from tallywatt.schema import RUN_COLUMNS, telemetry_schema

log = logging.getLogger(__name__)


def read_telemetry(spark: SparkSession, path: str, fmt: str = "parquet", dirty: bool = False) -> DataFrame:
    """Telemetry files. CSV gets a declared schema, so no inference pass;
    ``dirty`` reads text that the casts then turn into numbers or null.
    """
    if fmt == "csv":
        return spark.read.schema(telemetry_schema(dirty=dirty)).option("header", True).csv(path)
    if fmt in ("parquet", "orc", "json"):
        return spark.read.format(fmt).load(path)
    raise ValueError(f"unsupported format {fmt!r}")


def read_runs(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """A run log: the known columns typed, whatever else it holds as it is. The
    mode column goes by ``execution_mode`` under either of its names."""
    raw = spark.read.format(fmt).option("header", True).load(path)
    if "execution_mode" not in raw.columns:
        raw = raw.withColumnRenamed("threading_mode", "execution_mode")
    kinds = dict(RUN_COLUMNS)
    # the file may hold the columns in any order: matched by name
    return raw.select(*[F.col(f"`{c}`").try_cast(kinds[c]).alias(c) if c in kinds else F.col(f"`{c}`") for c in raw.columns])


def read_if_exists(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame | None:
    """The table, or None with a message when the path is absent."""
    try:
        return spark.read.format(fmt).options(**options).load(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            log.warning("optional table %s is absent", path)
            return None
        raise


def count_rows(df: DataFrame) -> int:
    """Row count; the scan reads no column."""
    return df.count()


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet")
