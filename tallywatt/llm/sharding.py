"""Shards of near equal bytes by sampled splitters.

Records are ordered by a hash of their text, so equal texts lie together. Keys
drawn with probability in proportion to size give splitters at the quantiles of
the bytes; the records between two splitters form a range. Every range is then
measured exactly, overfull ones (a text repeated very often) are subdivided by a
hash of the id, and what is overfull still (one row repeated very often) by the
rows' places; runs of ranges become shards.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallywatt.llm.common import batch_of, stored

#: Keys drawn per range; the driver holds ranges x draws of them.
DRAWS = 16
#: Ranges per shard at least: a shard is off by half a range at most.
RANGES_PER_SHARD = 128
#: Rows that a range holds on average at most.
ROWS_PER_RANGE = 1_000_000


def sized_records(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, key, tie, place): UTF-8 bytes plus 1, the text's
    checksum (null: of the empty text), the hashes that order the records, and a
    number that tells rows apart (to be stored before it is used twice)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("key"),
        F.xxhash64(F.lit(1), F.col(id_col)).alias("tie"), F.monotonically_increasing_id().alias("place"))


def sampled_splitters(records: DataFrame, ranges: int, total: int, draws: int = DRAWS) -> np.ndarray:
    """Keys that cut the records into about ``ranges`` ranges of equal size.

    A record is drawn size * ranges * draws / total times on average, by a hash
    of its key and tie, so a retried task draws the same.
    """
    expected = F.col("size") * F.lit(ranges * draws / max(total, 1))
    u = (F.pmod(F.xxhash64("key", "tie", "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30)))
    times = (F.floor(expected) + (u < expected - F.floor(expected)).cast("long")).alias("times")
    drawn = records.select("key", times).where("times > 0")
    drawn = drawn.groupBy("key").agg(F.sum("times").alias("times")).toPandas()  # ranges x draws rows expected
    if drawn.empty:
        return np.zeros(0, np.int64)
    drawn = drawn.sort_values("key")
    at = np.cumsum(drawn["times"].to_numpy())
    marks = np.arange(1, ranges) * at[-1] / ranges
    return np.unique(drawn["key"].to_numpy()[np.searchsorted(at, marks)])


def shard_by_bytes(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per record: doc_id, size, text_crc32, law ('bytes'), shard (0 to
    shards - 1), slot (gapless from 0 in its shard) and grown_shard (null).

    Null and empty texts have size 1. Equal texts share a shard unless a range
    boundary had to be put between them. Rows equal in id and text get different
    slots. An empty table gives no rows; other columns are ignored.
    """
    records = stored(sized_records(docs, id_col, text_col), "records")
    told = records.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("total")).first()
    ranges = max(RANGES_PER_SHARD * shards, -(-told["n"] // ROWS_PER_RANGE))
    splitters = sampled_splitters(records, ranges, told["total"])
    limit = max(1, 2 * told["total"] // ranges)
    ranged = _ranged(records, splitters)

    cut = _subdivided(ranged.withColumn("part", F.lit(0)), ["range"], "part", "tie", limit)
    cut = _subdivided(cut.withColumn("copy", F.lit(0)), ["range", "part"], "copy", "place", limit)

    unit = ["range", "part", "copy"]
    units = stored(cut.groupBy(*unit).agg(F.sum("size").alias("held"), F.count("*").alias("rows")), "units")
    # one row per range: an unpartitioned window is fine
    before = Window.orderBy(*unit).rowsBetween(Window.unboundedPreceding, -1)
    units = units.withColumn("bytes_before", F.coalesce(F.sum("held").over(before), F.lit(0)))
    middle = (F.col("bytes_before") + F.col("held") / 2) * F.lit(shards / max(told["total"], 1))
    units = units.withColumn("shard", F.least(F.floor(middle), F.lit(shards - 1)).cast("int"))
    within = Window.partitionBy("shard").orderBy(*unit).rowsBetween(Window.unboundedPreceding, -1)
    units = units.select(*unit, "shard", F.coalesce(F.sum("rows").over(within), F.lit(0)).alias("rows_before"))

    place = Window.partitionBy(*unit).orderBy("key", "tie", "doc_id")
    return (cut.withColumn("place", F.row_number().over(place) - 1)
            .join(F.broadcast(units), unit)
            .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                    (F.col("rows_before") + F.col("place")).cast("long").alias("slot"),
                    F.lit(None).cast("int").alias("grown_shard")))


def _subdivided(rows: DataFrame, unit: list[str], name: str, by: str, limit: int) -> DataFrame:
    """``name`` numbers the pieces into which units above the limit are cut by
    the column ``by``; 0 in all others. Overfull units are fewer than the ranges."""
    sizes = rows.groupBy(*unit).agg(F.sum("size").alias("held")).where(F.col("held") > limit)
    overfull = sizes.select(*unit, F.ceil(F.col("held") / F.lit(limit / 2)).cast("long").alias("pieces"))
    pieces = F.coalesce(F.pmod(F.xxhash64(by), F.col("pieces")), F.lit(0)).cast("long")
    return rows.join(F.broadcast(overfull), unit, "left").withColumn(name, pieces).drop("pieces")


def _ranged(records: DataFrame, splitters: np.ndarray) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("size", pa.int64()), ("text_crc32", pa.int64()),
                        ("key", pa.int64()), ("tie", pa.int64()), ("place", pa.int64()), ("range", pa.int64())])

    def rows(batches):
        for batch in batches:
            keys = batch.column("key").to_numpy()
            yield batch_of(schema, *[batch.column(c) for c in schema.names[:6]], np.searchsorted(splitters, keys))

    return records.select(*schema.names[:6]).mapInArrow(
        rows, "doc_id long, size long, text_crc32 long, key long, tie long, place long, range long")
