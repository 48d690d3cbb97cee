"""Small-side joins whose size is checked before anything is broadcast."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

MAX_BROADCAST_ROWS = 100_000
MAX_BROADCAST_BYTES = 32 << 20


def small_copy(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> tuple[DataFrame, int | None]:
    """A local copy of ``df`` and its row count when it has at most
    ``max_rows`` rows and MAX_BROADCAST_BYTES, else ``df`` itself and None.

    The limit bounds what reaches the driver; an aggregate feeding a small
    table is computed once here rather than once per use.
    """
    table = df.limit(max_rows + 1).toArrow()
    if table.num_rows > max_rows or table.nbytes > MAX_BROADCAST_BYTES:
        return df, None
    return local_frame(df.sparkSession, table, df.schema), table.num_rows


def local_frame(spark: SparkSession, table: pa.Table, schema: StructType) -> DataFrame:
    """A DataFrame of a table on the driver; no rows are a list, as Arrow's empty columns carry no type."""
    return spark.createDataFrame(table if table.num_rows else [], schema)


def checked_small(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """``df`` as a broadcast join side if its checked size allows it, else
    unchanged (and the join shuffles)."""
    copy, size = small_copy(df, max_rows)
    return df if size is None else F.broadcast(copy)
