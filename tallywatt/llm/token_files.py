"""Token ids as Parquet list columns.

One row per document, in ascending id order over the files. Ids are dictionary
encoded (a 16-bit place in the row group's dictionary each), counters are delta
encoded; row groups and pages are small and carry page indexes, so that a reader
of a range of documents skips the other pages and a reader of the metadata never
touches the ids.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallywatt.llm.common import batch_of, bounded, slices
from tallywatt.llm.tokens import encode

END_ID = 1
ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 256 << 10
FILE_SCHEMA = "doc_id long, part int, start_in_part long, n_tokens long, ids array<int>"


def write_token_files(docs: DataFrame, folder: str, path: str, id_col: str = "doc_id", text_col: str = "text",
                      end_id: int = END_ID) -> None:
    """Encode every whole text and write the files to ``folder``.

    Null and empty texts become the end id alone. A null id sorts first; rows
    that share an id stand in the order of their texts' hashes. Other columns are
    ignored. An empty table gives files without rows.
    """
    ordered = bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ordered = ordered.withColumn("tie", F.xxhash64("text"))
    ordered = ordered.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    schema = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("start_in_part", pa.int64()),
                        ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def rows(batches):
        part, at = TaskContext.get().partitionId(), 0
        for batch in slices(batches, "text"):
            ids, offsets = encode(batch.column("text"), path)
            n = batch.num_rows
            ids = np.insert(ids, offsets[1:], end_id).astype(np.int32)
            ends = offsets + np.arange(n + 1)
            yield batch_of(schema, batch.column("doc_id"), np.full(n, part, np.int32), at + ends[:-1], np.diff(ends),
                           pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids)))
            at += int(ends[-1])

    (ordered.mapInArrow(rows, FILE_SCHEMA).write
        .option("compression", "zstd")
        .option("parquet.writer.version", "PARQUET_2_0")
        .option("parquet.block.size", ROW_GROUP_BYTES)
        .option("parquet.page.size", PAGE_BYTES)
        .option("parquet.enable.dictionary", "true")
        .option("parquet.enable.dictionary#doc_id", "false")
        .option("parquet.enable.dictionary#start_in_part", "false")
        .option("parquet.enable.dictionary#n_tokens", "false")
        .parquet(folder))


def read_token_files(spark: SparkSession, folder: str, where: Column | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids): ``start`` counts the ids of all documents
    before. ``where`` is pushed to the pages' indexes; unused columns are not read."""
    rows = spark.read.schema(FILE_SCHEMA).parquet(folder)
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    # one row per file: an unpartitioned window is fine
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    if where is not None:
        rows = rows.where(where)
    return (rows.join(F.broadcast(starts), "part")
            .select("doc_id", (F.col("part_start") + F.col("start_in_part")).alias("start"), "n_tokens", "ids"))


def checksums(tokens: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of what ``read_token_files`` gives."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()),
                        ("ids_crc32", pa.int64())])

    def rows(batches):
        for batch in batches:
            lists = batch.column("ids")
            ends = lists.offsets.to_numpy()
            ids = lists.values.to_numpy(zero_copy_only=False).astype("<u4")
            sums = [zlib.crc32(ids[a:b]) for a, b in zip(ends[:-1], ends[1:])]
            yield batch_of(schema, batch.column("doc_id"), batch.column("start"), np.diff(ends).astype(np.int64), sums)

    return tokens.select("doc_id", "start", "n_tokens", "ids").mapInArrow(
        rows, "doc_id long, start long, n_tokens long, ids_crc32 long")
