"""Count-min sketch for one question: which cells were hit at least twice.

Counters saturate at two, so a merged sketch is one bit per cell: "hit twice or
more". A key whose cells all carry the bit is estimated repeated; the estimate
never misses a repeated key. Partition sketches travel as gaps between the cells
they hit (about a byte a cell), block by block, and are merged block by block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywatt.llm.common import batch_of

#: Cells of a block, the unit of merging.
BLOCK_BITS = 20
#: A task sends its sketch on when it holds so many hits.
FLUSH_HITS = 8_000_000
#: The merged sketch is broadcast; 2^30 cells are 128 MB. Beyond that it stays
#: as large, estimates more keys repeated, and the exact pass does the rest.
LEAST_BITS, MOST_BITS = 26, 30

_MIXERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)


class Sketch(NamedTuple):
    bits: np.ndarray  # packed, one per cell
    cell_bits: int
    rows: int
    salt: int

    def repeated(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Places of the keys (128-bit hashes) that are estimated repeated."""
        left = np.arange(len(h1))
        for row in range(self.rows):
            cell = cells(h1[left], h2[left], row, self.cell_bits, self.rows, self.salt)
            left = left[(self.bits[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 == 1]
        return left


def cell_bits(keys: int) -> int:
    """A power of two of cells for about ``keys`` keys: four to eight each."""
    return min(MOST_BITS, max(LEAST_BITS, (4 * max(keys, 1) - 1).bit_length()))


def cells(h1: np.ndarray, h2: np.ndarray, row: int, bits: int, rows: int, salt: int = 0) -> np.ndarray:
    """The cell of each key in one row of the sketch; each row has an own
    stretch of the cells (rows: a power of two)."""
    mixed = (h1 + np.uint64(2 * row + 1 + 16 * salt) * h2) * np.uint64(_MIXERS[row % 4])
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(_MIXERS[(row + 1 + salt) % 4])
    width = bits - (rows.bit_length() - 1)
    return (mixed >> np.uint64(64 - width)).astype(np.int64) + (row << width)


def repeated_cells(source: DataFrame, keys: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[np.ndarray, np.ndarray]]],
                   bits: int, rows: int = 2, salt: int = 0) -> Sketch:
    """The merged sketch over the keys that ``keys`` draws from the batches of
    ``source``, on the driver: 2^bits bits."""
    hit = pa.schema([("block", pa.int32()), ("gaps", pa.binary()), ("twice", pa.binary())])

    def partial(batches):
        held, count = [], 0
        for h1, h2 in keys(batches):
            for at in range(0, len(h1), FLUSH_HITS // rows):
                part = slice(at, at + FLUSH_HITS // rows)
                for row in range(rows):
                    held.append(cells(h1[part], h2[part], row, bits, rows, salt).astype(np.uint32))
                    count += len(held[-1])
                if count >= FLUSH_HITS:
                    yield _blocks(np.concatenate(held), hit)
                    held, count = [], 0
        if count:
            yield _blocks(np.concatenate(held), hit)

    def merged(batches):
        block, once, twice = None, None, None
        for batch in batches:
            for at, gaps, many in zip(*(batch.column(c).to_pylist() for c in hit.names)):
                if at != block:
                    if block is not None:
                        yield batch_of(out, [block], [np.packbits(twice).tobytes()])
                    block, once, twice = at, np.zeros(1 << BLOCK_BITS, bool), np.zeros(1 << BLOCK_BITS, bool)
                own = _cells_of(gaps)
                again = once[own] | np.unpackbits(np.frombuffer(many, np.uint8), count=len(own)).astype(bool)
                twice[own[again]] = True
                once[own] = True
        if block is not None:
            yield batch_of(out, [block], [np.packbits(twice).tobytes()])

    out = pa.schema([("block", pa.int32()), ("bits", pa.binary())])
    parts = source.mapInArrow(partial, "block int, gaps binary, twice binary")
    rows_of = (parts.repartition(F.col("block")).sortWithinPartitions("block")
               .mapInArrow(merged, "block int, bits binary").toLocalIterator())
    packed = np.zeros(1 << (bits - 3), np.uint8)
    size = 1 << (BLOCK_BITS - 3)
    for block, told in rows_of:  # 2^bits bits in all
        packed[block * size:(block + 1) * size] = np.frombuffer(told, np.uint8)
    return Sketch(packed, bits, rows, salt)


def _blocks(hits: np.ndarray, schema: pa.Schema) -> pa.RecordBatch:
    hits = np.sort(hits)
    first = np.concatenate([[True], hits[1:] != hits[:-1]])
    at = np.flatnonzero(first)
    own = hits[at]
    many = np.diff(np.append(at, len(hits))) > 1
    block = own >> np.uint32(BLOCK_BITS)
    starts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
    ends = np.append(starts[1:], len(own))
    names, gaps, twice = [], [], []
    for a, b in zip(starts.tolist(), ends.tolist()):
        names.append(int(block[a]))
        gaps.append(_gaps(own[a:b] & np.uint32((1 << BLOCK_BITS) - 1)))
        twice.append(np.packbits(many[a:b]).tobytes())
    return batch_of(schema, names, gaps, twice)


def _gaps(own: np.ndarray) -> bytes:
    """Distances between ascending cells in bytes; 255 goes on with the next."""
    gap = np.diff(own.astype(np.int64), prepend=0)
    ends = np.cumsum(gap // 255 + 1)
    out = np.full(int(ends[-1]), 255, np.uint8)
    out[ends - 1] = gap % 255
    return out.tobytes()


def _cells_of(gaps: bytes) -> np.ndarray:
    told = np.frombuffer(gaps, np.uint8)
    return np.cumsum(told, dtype=np.int64)[told != 255]
