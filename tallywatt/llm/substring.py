"""Windows of words that occur anywhere else, by a count-min prefilter.

Every window gets a 128-bit hash (two rolling sums over word hashes). Two rounds
of merged partition sketches estimate which windows repeat; a sketch only
overestimates, so none is lost. A last pass groups exactly the windows that are
estimated repeated, and only the few that turn out to occur once travel back.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tallywatt.llm.common import batch_of, bounded, carried, inverse_powers, joined, powers, row_key, slices, stored, words_of
from tallywatt.llm.sketch import LEAST_BITS, Sketch, cell_bits, repeated_cells

WINDOW = 35
#: Windows per byte of text, for the size of the sketches.
WINDOWS_PER_BYTE = 0.15
#: Estimated but single windows are joined by broadcast up to so many bytes.
BROADCAST_BYTES = 32 << 20
#: Candidates that a task combines before it sends them on.
COMBINED = 500_000

_BASES = (0x9E3779B97F4A7C15 | 1, 0xD1342543DE82EF95 | 1)


class Windows(NamedTuple):
    h1: np.ndarray
    h2: np.ndarray
    start: np.ndarray  # place of the first word in the batch
    text: np.ndarray  # row of the batch


def window_hashes(codes: np.ndarray, offsets: np.ndarray, vocabulary: list[str], window: int) -> Windows:
    """Hash pairs of every window of ``window`` words that lies in one text."""
    size = np.diff(offsets)
    text = np.repeat(np.arange(len(size)), size)
    start = np.flatnonzero(offsets[1:][text] - np.arange(len(codes)) >= window)
    words = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, vocabulary)), np.uint64).reshape(-1, 2)
    out = []
    for k, base in enumerate(_BASES):
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(words[codes, k] * powers(base, len(codes)), out=sums[1:])
        out.append((sums[start + window] - sums[start]) * inverse_powers(base, len(codes) + 1)[start])
    return Windows(out[0], out[1], start, text[start])


def remove_repeated_windows(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text",
                            carry: tuple[str, ...] = ()) -> DataFrame:
    """Remove each word that a window covers whose word sequence starts anywhere
    else too, in the same document included; windows are judged on the input.

    Words are [^\\x20\\x09-\\x0D]+, unchanged. Returns doc_id, n_words, n_removed,
    kept (the words left, joined by one space) and, as struct ``carried``, the
    input's columns named in ``carry``. Null, empty and short texts lose nothing.
    A row that is repeated repeats its windows, so both lose them. An empty table
    gives no rows; columns that are not named are ignored, whatever their names.
    """
    spark = docs.sparkSession
    narrow = bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
                         row_key(id_col, text_col).alias("row"), carried(carry))
    scan = narrow.select("text", "row")
    size = narrow.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = cell_bits(int(size * WINDOWS_PER_BYTE))

    def windows(batch) -> tuple:
        words = words_of(batch.column("text"))
        return words, window_hashes(words.codes, words.offsets, words.vocabulary.to_pylist(), window)

    def all_keys(batches):
        for batch in slices(batches, "text"):
            _, w = windows(batch)
            yield w.h1, w.h2

    first = spark.sparkContext.broadcast(tuple(repeated_cells(scan, all_keys, bits)))

    def left_keys(batches):
        for batch in slices(batches, "text"):
            _, w = windows(batch)
            left = Sketch(*first.value).repeated(w.h1, w.h2)
            yield w.h1[left], w.h2[left]

    second = spark.sparkContext.broadcast(tuple(repeated_cells(scan, left_keys, max(LEAST_BITS, bits - 1), rows=4, salt=1)))

    def estimated(w: Windows) -> np.ndarray:
        left = Sketch(*first.value).repeated(w.h1, w.h2)
        return left[Sketch(*second.value).repeated(w.h1[left], w.h2[left])]

    candidate = pa.schema([(c, pa.int64()) for c in ("h1", "h2", "n", "row")])

    def candidates(batches):
        held, count = [], 0
        for batch in slices(batches, "text"):
            _, w = windows(batch)
            left = estimated(w)
            held.append((w.h1[left], w.h2[left], batch.column("row").to_numpy()[w.text[left]]))
            count += len(left)
            if count >= COMBINED:
                yield _combined(held, candidate)
                held, count = [], 0
        if count:
            yield _combined(held, candidate)

    # combined in the tasks already: a second partial aggregation would find nothing
    single = (scan.mapInArrow(candidates, "h1 long, h2 long, n long, row long").repartition("h1", "h2")
              .groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.min("row").alias("row")).where("n = 1"))
    spared = stored(single.groupBy(F.col("row").alias("of_row")).agg(F.collect_list("h1").alias("spared")), "single-windows")
    told = spared.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.size("spared")), F.lit(0)).alias("n")).first()
    if 64 * told["rows"] + 8 * told["n"] <= BROADCAST_BYTES:
        spared = F.broadcast(spared)
    matched = narrow.join(spared, F.col("row") == F.col("of_row"), "left")

    result = narrow.select("doc_id", F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"),
                           F.lit("").cast("string").alias("kept"), "carried").schema
    schema = to_arrow_schema(result)

    def reduced(batches):
        for batch in slices(batches, "text"):
            words, w = windows(batch)
            hit = np.zeros(len(words.codes) + 1, np.int64)
            left = estimated(w)
            found = np.zeros(len(words.codes) + 1, bool)
            found[w.start[left]] = True
            lists = batch.column("spared")
            of = w.text[left]
            for i in np.flatnonzero(lists.is_valid().to_numpy(zero_copy_only=False)).tolist():
                own = left[np.searchsorted(of, i):np.searchsorted(of, i, "right")]
                single = lists[i].values.to_numpy(zero_copy_only=False).view(np.uint64)
                found[w.start[own[np.isin(w.h1[own], single)]]] = False
            start = np.flatnonzero(found)
            np.add.at(hit, start, 1)
            np.add.at(hit, start + window, -1)
            kept = np.cumsum(hit[:-1]) == 0
            ends = np.concatenate([[0], np.cumsum(kept)])[words.offsets]
            n_words = np.diff(words.offsets)
            yield batch_of(schema, batch.column("doc_id"), n_words, n_words - np.diff(ends),
                           _texts(words.vocabulary, words.codes[kept], ends), batch.column("carried"))

    return matched.select("doc_id", "text", "carried", "spared").mapInArrow(reduced, result)


def _combined(held: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    """One row per distinct window of a task's share: how often, and one of its rows."""
    h1, h2, rows = (np.concatenate(c) for c in zip(*held))
    order = np.lexsort((h2, h1))
    h1, h2 = h1[order], h2[order]
    new = np.flatnonzero(np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])) if len(h1) else order
    return batch_of(schema, h1[new].view(np.int64), h2[new].view(np.int64), np.diff(np.append(new, len(h1))), rows[order[new]])


def _texts(vocabulary: pa.Array, codes: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Texts whose words are ``codes[ends[i]:ends[i + 1]]``, joined by one space."""
    pool = pa.array([w + b" " for w in vocabulary.cast(pa.binary()).to_pylist()], pa.large_binary())
    data, bounds = joined(pool, codes)
    told = [str(data[bounds[a]:max(bounds[a], bounds[b] - 1)], "utf-8") for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
    return pa.array(told, pa.string())
