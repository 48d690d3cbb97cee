"""What the operators share: folders, batches bounded in bytes, words as codes."""

from __future__ import annotations

import ctypes
import sys
import types
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywatt.session import checkpoint_dir

#: Bytes of text that a task works on at once; a longer text is worked on alone.
SLICE_BYTES = 4 << 20
#: Bytes of a batch that goes to a Python worker, however long its texts are.
BATCH_BYTES = 8 << 20


def run_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, rows_per_file: int | None = None) -> DataFrame:
    """``df`` as a table in the shared folder: the lineage ends here, every
    executor can read it, and a lost executor costs a re-read."""
    folder = run_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def bounded(df: DataFrame) -> DataFrame:
    """``df``, whose rows go to Python workers in batches of BATCH_BYTES, or of
    one row, from now on."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def carried(columns):
    """The named columns as one struct, so that no name can clash with others."""
    return F.struct(F.lit(0).alias("none"), *[F.col("`" + c.replace("`", "``") + "`").alias(c) for c in columns]).alias("carried")


def row_key(id_col: str, text_col: str):
    """Names a row by its id and its content, so that rows which repeat an id
    stay apart and rows that are equal in both get the same answer."""
    return F.xxhash64(F.col(id_col), F.col(text_col))


class Remembered:
    """A cache of at most ``limit`` entries in two generations: what was not asked
    for while the younger one filled up goes."""

    def __init__(self, limit: int) -> None:
        self.young, self.old, self.limit = {}, {}, limit // 2

    def get(self, key):
        found = self.young.get(key)
        if found is None:
            found = self.old.get(key)
            if found is not None:
                self.put(key, found)
        return found

    def put(self, key, value) -> None:
        if len(self.young) >= self.limit:
            self.old, self.young = self.young, {}
        self.young[key] = value


def _give_back() -> None:
    """A worker that waits for its next task returns what it does not use."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def of_process(name: str) -> dict:
    """A dictionary that lives as long as the Python worker. Code travels by
    value, so a module's own globals would not outlive a task."""
    home = sys.modules.setdefault("_tallywatt_worker", types.ModuleType("_tallywatt_worker"))
    return home.__dict__.setdefault(name, {})


def powers(base: int, n: int) -> np.ndarray:
    """base^0 ... base^(n-1) modulo 2^64; a worker keeps those of usual lengths."""
    kept = of_process("powers")
    known = kept.get(base)
    if known is None or len(known) < n:
        known = np.full(max(n, 1 << 18), np.uint64(base))
        known[0] = 1
        np.multiply.accumulate(known, out=known)
        if n <= 1 << 20:
            kept[base] = known
    return known[:n]


def inverse_powers(base: int, n: int) -> np.ndarray:
    return powers(pow(base, -1, 1 << 64), n)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that ``column`` holds about ``limit`` bytes at most
    or is one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(at, to - at)
            at = to
    _give_back()


class Words(NamedTuple):
    """``codes[offsets[i]:offsets[i + 1]]`` are the words of text i, as places
    in ``vocabulary``."""

    codes: np.ndarray
    offsets: np.ndarray
    vocabulary: pa.Array


def words_of(texts: pa.Array) -> Words:
    """Words between ASCII white space ([^\\x20\\x09-\\x0D]+); null has none."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    offsets = lists.offsets.to_numpy().astype(np.int64)
    coded = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
    offsets = offsets - offsets[0]
    codes = coded.indices.to_numpy(zero_copy_only=False)
    empty = pc.index(coded.dictionary, pa.scalar("", coded.dictionary.type)).as_py()
    if empty >= 0:  # the piece before a leading or behind a trailing space
        kept = codes != empty
        offsets = np.concatenate([[0], np.cumsum(kept, dtype=np.int64)])[offsets]
        codes = codes[kept]
    return Words(codes, offsets, coded.dictionary)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of all texts in UTF-8; null is empty."""
    texts = pc.fill_null(texts, "")
    offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4).astype(np.int64)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def joined(pool: pa.Array, codes: np.ndarray) -> tuple[memoryview, np.ndarray]:
    """(bytes, offsets) of ``pool[codes]`` behind one another; pool: large binary."""
    taken = pool.take(pa.array(codes))
    offsets = np.frombuffer(taken.buffers()[1], np.int64, len(codes) + 1, taken.offset * 8)
    data = taken.buffers()[2]
    return memoryview(data) if data is not None else memoryview(b""), offsets


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)
