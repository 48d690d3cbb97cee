"""Tokens of two tokenizers aligned by byte offsets, and how often ids meet.

A text is cut into units (a space and what follows up to the next) at places where
both tokenizers must end a token, so every distinct unit is aligned once. There,
end-to-index dictionaries of both sides are intersected; the sorted common ends
slice both id lists into groups, and each group's links are listed from its slices.
"""

from __future__ import annotations

import hashlib
import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywatt.llm.common import Remembered, batch_of, bounded, joined, of_process, slices, stored, text_bytes
from tallywatt.llm.shared import heavy, with_joined

#: Bytes of units whose alignment a worker remembers.
REMEMBERED_BYTES = 128 << 20
#: A unit with so long a run of white space goes to the file's own tokenizer.
LONG_SPACE = 64
#: A pair of ids as one number: the A id times PAIR plus the B id.
PAIR = 1 << 32


class Aligned(NamedTuple):
    """One unit: numbers of A and B ids, groups, as text, and its links as pairs.
    ``n_a`` is -1 where a side's bytes are not the unit's."""

    n_a: int
    n_b: int
    n_groups: int
    told: bytes
    pairs: bytes


NONE = Aligned(-1, 0, 0, b"", b"")


class Names(NamedTuple):
    """Ids as text and what follows: place 2 * id inside a group's side, 2 * id + 1
    at the side's end; B ids from place ``of_a`` on."""

    both: pa.Array
    of_a: int


def names_of(n_a: int, n_b: int) -> Names:
    sides = [[f"{k}{sep}".encode() for k in range(n) for sep in (",", last)] for n, last in ((n_a, "|"), (n_b, ";"))]
    return Names(pa.array(sides[0] + sides[1], pa.large_binary()), 2 * n_a)


def aligned(ids_a: np.ndarray, sizes_a: np.ndarray, ids_b: np.ndarray, sizes_b: np.ndarray, units: np.ndarray, names: Names) -> list[Aligned] | None:
    """Groups and links of units behind one another, which end at ``units``;
    None where a unit's end is not an end of both sides."""
    cut_a, cut_b = np.cumsum(sizes_a), np.cumsum(sizes_b)
    ends_a = dict(zip(cut_a.tolist(), range(1, len(cut_a) + 1)))
    ends_b = dict(zip(cut_b.tolist(), range(1, len(cut_b) + 1)))
    shared = ends_a.keys() & ends_b.keys()
    if not shared.issuperset(units.tolist()):
        return None
    common = sorted(shared)
    to_a = np.fromiter(map(ends_a.get, common), np.int64, len(common))
    to_b = np.fromiter(map(ends_b.get, common), np.int64, len(common))
    # within a group, tokens overlap where neither has ended: one link for every end of either side
    ends = np.union1d(cut_a, cut_b)
    pairs = ids_a[np.searchsorted(cut_a, ends)] * PAIR + ids_b[np.searchsorted(cut_b, ends)]
    # all ids in the order of the text: a group's A ids, then its B ids
    places = np.concatenate([np.arange(len(ids_a)) + np.append(0, to_b)[np.searchsorted(to_a, np.arange(len(ids_a)), "right")],
                             np.arange(len(ids_b)) + to_a[np.searchsorted(to_b, np.arange(len(ids_b)), "right")]])
    last_a, last_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
    last_a[to_a - 1] = last_b[to_b - 1] = 1
    codes = np.empty(len(places), np.int64)
    codes[places] = np.concatenate([2 * ids_a + last_a, 2 * ids_b + last_b + names.of_a])
    data, bounds = joined(names.both, codes)
    groups = np.searchsorted(np.array(common), units) + 1
    n_a, n_b = to_a[groups - 1], to_b[groups - 1]
    told = bounds[n_a + n_b].tolist()
    links = (8 * (np.searchsorted(ends, units) + 1)).tolist()
    raw = pairs.astype(np.int64).tobytes()
    figures = np.diff(np.vstack([n_a, n_b, groups]), prepend=0).T.tolist()
    return [Aligned(*f, bytes(data[t0:t1 - 1]), raw[p0:p1])
            for f, t0, t1, p0, p1 in zip(figures, [int(bounds[0]), *told[:-1]], told, [0, *links[:-1]], links)]


class Tokenizers:
    """Both tokenizers over units that begin with a space."""

    def __init__(self, path_a: str, path_b: str) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        by_char = _byte_of_char()
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = {k: bytes(map(by_char.get, p)) if all(c in by_char for c in p) else p.encode() for p, k in vocabulary.items()}
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode()
                        for k, p in enumerate(map(self.b.id_to_piece, range(self.b.get_piece_size())))]
        size_a = max(self.bytes_a) + 1
        self.sizes_a = np.array([len(self.bytes_a.get(k, b"")) for k in range(size_a)])
        self.sizes_b = np.array(list(map(len, self.bytes_b)))
        self.names = names_of(size_a, len(self.bytes_b))
        self.fast = self._by_ranks(path_a)

    def _by_ranks(self, path: str):
        """The same ids by ``tiktoken``, where the file's merges stand in the order of the ids."""
        import json

        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        vocabulary, special = model["vocab"], {t.content for t in self.a.get_added_tokens_decoder().values()}
        made = [vocabulary["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in model["merges"]]
        if made != sorted(made) or len(made) + 256 + len(special) != len(vocabulary | dict.fromkeys(special)):
            return None
        ranks = {self.bytes_a[k]: k for p, k in vocabulary.items() if p not in special}
        return tiktoken.Encoding("by-ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def sides(self, ids_a: list[int], ids_b: list[int], told: bytes, ends: np.ndarray) -> list[Aligned] | None:
        if not ids_a or not ids_b or any(b"".join([known[k] for k in ids]) != told
                                         for ids, known in ((ids_a, self.bytes_a), (ids_b, self.bytes_b))):
            return None
        a, b = np.array(ids_a, np.int64), np.array(ids_b, np.int64)
        return aligned(a, self.sizes_a[a], b, self.sizes_b[b], ends, self.names)

    def one(self, unit: bytes) -> Aligned:
        """A unit of any form."""
        told = unit.decode()
        found = self.sides(self.a.encode(told, add_special_tokens=False).ids, self.b.encode(told[1:], num_threads=1), unit, np.array([len(unit)]))
        return NONE if found is None else found[0]

    def many(self, units: list[bytes]) -> list[Aligned]:
        """Plain units, which can stand behind one another, go to the tokenizers together."""
        out: list[Aligned | None] = [None] * len(units)
        plain = [k for k, u in enumerate(units) if not ODD.search(u)] if self.fast is not None else []
        for at in range(0, len(plain), 1 << 12):
            part = plain[at:at + (1 << 12)]
            told = b"".join([units[k] for k in part])
            text = told.decode()
            found = self.sides(self.fast.encode_ordinary(text), self.b.encode(text[1:], num_threads=1), told,
                               np.cumsum([len(units[k]) for k in part]))
            if found is not None:  # else one unit has another form after all: one by one below
                for k, x in zip(part, found):
                    out[k] = x
        return [self.one(units[k]) if x is None else x for k, x in enumerate(out)]


#: White space at either end or in a long run, or a space mark: such units stand alone.
ODD = re.compile(rb"^\x20(?:$|[\x09-\x0D\x1C-\x20]|\xC2[\x85\xA0]|\xE1\x9A\x80|\xE2\x80[\x80-\xAF]|\xE2\x81\x9F|\xE3\x80\x80)"
                 rb"|(?:[\x09-\x0D\x1C-\x20]|\xC2[\x85\xA0]|\xE1\x9A\x80|\xE2\x80[\x80-\xAF]|\xE2\x81\x9F|\xE3\x80\x80)$"
                 rb"|\xE2\x96\x81|(?:[\x09-\x0D\x1C-\x20]|\xC2[\x85\xA0]|\xE1\x9A\x80|\xE2[\x80\x81].|\xE3\x80\x80){%d}" % LONG_SPACE, re.S)


def _byte_of_char() -> dict[str, int]:
    """Byte-level files show a byte as itself where it is printable, and all
    others, in ascending order, as the characters from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


def units_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(codes, offsets, vocabulary): the units of each text with a space put
    before it; empty texts have none. A cut lies before a space that stands
    between two bytes which belong to no white space."""
    data, offsets = text_bytes(texts)
    size = np.diff(offsets)
    data = np.insert(data, offsets[:-1][size > 0], 32)
    offsets = np.concatenate([[0], np.cumsum(size + (size > 0))])
    inner = np.zeros(len(data) + 4, bool)  # bytes of white space and of the space mark
    inner[:len(data)] = (data <= 32) & ((data == 32) | ((data >= 9) & (data <= 13)) | (data >= 28))
    padded = np.concatenate([data, np.zeros(4, np.uint8)])
    for lead, second, third in ((0xC2, (0x85, 0x85), None), (0xC2, (0xA0, 0xA0), None), (0xE1, (0x9A, 0x9A), (0x80, 0x80)),
                                (0xE2, (0x80, 0x80), (0x80, 0xAF)), (0xE2, (0x81, 0x81), (0x9F, 0x9F)),
                                (0xE2, (0x96, 0x96), (0x81, 0x81)), (0xE3, (0x80, 0x80), (0x80, 0x80))):
        at = np.flatnonzero(data == lead)
        at = at[(padded[at + 1] >= second[0]) & (padded[at + 1] <= second[1])]
        if third is not None:
            at = at[(padded[at + 2] >= third[0]) & (padded[at + 2] <= third[1])]
            inner[at + 2] = True
        inner[at] = inner[at + 1] = True
    at = np.flatnonzero(data == 32)
    first = np.zeros(len(data) + 1, bool)
    first[offsets[:-1]] = True
    last = np.zeros(len(data) + 1, bool)
    last[offsets[1:] - 1] = True
    starts = first[:len(data)].copy()
    free = at[~first[at] & ~last[at]]
    starts[free[~inner[free - 1] & ~inner[free + 1]]] = True
    begins = np.flatnonzero(starts)
    bounds = np.append(begins, len(data)).astype(np.int64)
    cut = pa.Array.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])
    coded = cut.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), np.searchsorted(begins, offsets), coded.dictionary


class UnitCache:
    """Alignments by unit, as many as fit the given bytes."""

    def __init__(self, limit: int) -> None:
        self.known, self.limit, self.held = Remembered(1 << 30), limit // 2, 0

    def get(self, unit: bytes):
        return self.known.get(unit)

    def put(self, unit: bytes, value: Aligned) -> None:
        self.known.put(unit, value)
        self.held += len(unit) + len(value.told) + len(value.pairs) + 400
        if self.held > self.limit:
            self.known.old, self.known.young, self.held = self.known.young, {}, 0


def _of_worker(path_a: str, path_b: str) -> tuple[Tokenizers, UnitCache]:
    kept = of_process("alignment")
    if (path_a, path_b) not in kept:
        kept[path_a, path_b] = Tokenizers(path_a, path_b), UnitCache(REMEMBERED_BYTES)
    return kept[path_a, path_b]


class Slice(NamedTuple):
    """Figures of each text and the pairs of its links, text by text."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    digests: list[str]
    pairs: np.ndarray
    ends: np.ndarray


def align(texts: pa.Array, path_a: str, path_b: str) -> Slice:
    tokenizers, cache = _of_worker(path_a, path_b)
    codes, offsets, vocabulary = units_of(texts)
    units = vocabulary.to_pylist()
    found = [cache.get(u) for u in units]
    new = [k for k, x in enumerate(found) if x is None]
    for k, x in zip(new, tokenizers.many([units[k] for k in new])):
        found[k] = x
        cache.put(units[k], x)
    figures = np.array([x[:3] for x in found], np.int64).reshape(-1, 3)[codes]
    bad = np.concatenate([[0], np.cumsum(figures[:, 0] < 0)])[offsets]
    sound = (np.diff(bad) == 0) & (np.diff(offsets) > 0)
    # texts that cannot be aligned have no tokens: their units go
    held = np.repeat(sound, np.diff(offsets))
    codes, figures = codes[held], figures[held]
    offsets = np.concatenate([[0], np.cumsum(np.where(sound, np.diff(offsets), 0))])
    sums = np.vstack([np.zeros(3, np.int64), np.cumsum(figures, axis=0)])[offsets]
    n_a, n_b, n_groups = np.diff(sums, axis=0).T
    told, told_ends = joined(pa.array([x.told + b";" for x in found], pa.large_binary()), codes)
    told_ends = told_ends[offsets]
    digests = [hashlib.sha256(told[a:b - 1]).hexdigest() if b > a else "" for a, b in zip(told_ends[:-1].tolist(), told_ends[1:].tolist())]
    data, ends = joined(pa.array([x.pairs for x in found], pa.large_binary()), codes)
    pairs = np.frombuffer(data, np.int64, (int(ends[-1]) - int(ends[0])) // 8, int(ends[0]))
    return Slice(n_a, n_b, n_groups, digests, pairs, (ends[offsets] - ends[0]) // 8)


def aligned_documents(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: row, doc_id, n_a, n_b, n_groups, n_links,
    groups_sha256, and its distinct linked ``pairs`` (A id * 2^32 + B id) with
    the number of links ``times``."""
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
                        ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int32()))])

    def rows(batches):
        row = TaskContext.get().partitionId() << 40
        for batch in slices(batches, "text"):
            told, n = align(batch.column("text"), path_a, path_b), batch.num_rows
            text = np.repeat(np.arange(n), np.diff(told.ends))
            order = np.lexsort((told.pairs, text))
            pairs, text = told.pairs[order], text[order]
            new = np.flatnonzero(np.concatenate([[True], (pairs[1:] != pairs[:-1]) | (text[1:] != text[:-1])])) if len(pairs) else order
            ends = pa.array(np.searchsorted(text[new], np.arange(n + 1)), pa.int32())
            times = np.diff(np.append(new, len(pairs))).astype(np.int32)
            yield batch_of(schema, row + np.arange(n), batch.column("doc_id"), told.n_a, told.n_b, told.n_groups, np.diff(told.ends),
                           told.digests, pa.ListArray.from_arrays(ends, pa.array(pairs[new])), pa.ListArray.from_arrays(ends, pa.array(times)))
            row += n

    narrow = bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(rows, "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
                                   "pairs array<long>, times array<int>")


def pair_counts(aligned_rows: DataFrame) -> DataFrame:
    """(key, n, best): links of each id pair in all documents, and whether no
    other A id has more links with the same B id."""
    each = aligned_rows.select(F.explode(F.arrays_zip("pairs", "times")).alias("p"))
    counts = each.groupBy(F.col("p.pairs").alias("key")).agg(F.sum("p.times").alias("n"))
    counts = stored(counts.withColumn("b", F.pmod("key", F.lit(PAIR)).cast("int")), "pairs")
    most = counts.groupBy("b").agg(F.max("n").alias("most"))  # at most one row per B id: bounded by its vocabulary
    return counts.join(F.broadcast(most), "b").select("key", "n", (F.col("n") == F.col("most")).alias("best"))


def alignment_figures(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best,
    count_sum, groups_sha256.

    A (a byte-level ``tokenizers`` file) reads a space and the text, B (a
    ``sentencepiece`` file) the text; special tokens' strings are plain text.
    Null and empty texts, and those whose tokens' bytes on either side are not the
    space and the text, have no tokens: zeros and ''. Repeated rows count and get
    a row each. An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    rows = stored(aligned_documents(docs, path_a, path_b, id_col, text_col), "aligned")
    counts = stored(pair_counts(rows), "pair-counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    is_heavy = heavy(F.col("n"), total)
    near = counts.where(is_heavy).sort("key").select("key", "n", "best").toArrow()  # fewer than SHARES rows
    lookup = spark.sparkContext.broadcast(tuple(near.column(c).to_numpy() for c in ("key", "n", "best")))
    schema = pa.schema([("row", pa.int64()), ("n_best", pa.int64()), ("count_sum", pa.int64()),
                        ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int32()))])
    fixed = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    fields = [(c, rows.schema[c].dataType.simpleString()) for c in fixed]
    whole = pa.schema([*schema, *[(c, pa.string() if c == "groups_sha256" else pa.int64()) for c in fixed]])

    def partly(batches):
        keys, counted, best = lookup.value
        for batch in batches:
            if not batch.num_rows:
                continue
            lists, n = batch.column("pairs"), batch.num_rows
            ends = lists.offsets.to_numpy().astype(np.int64)
            pairs = lists.values.to_numpy(zero_copy_only=False)[ends[0]:ends[-1]]
            times = batch.column("times").values.to_numpy(zero_copy_only=False)[ends[0]:ends[-1]]
            text = np.repeat(np.arange(n), np.diff(ends))
            at = np.minimum(np.searchsorted(keys, pairs), max(len(keys) - 1, 0))
            hit = keys[at] == pairs if len(keys) else np.zeros(len(pairs), bool)
            sums, bests = np.zeros(n, np.int64), np.zeros(n, np.int64)
            np.add.at(sums, text[hit], counted[at[hit]] * times[hit])
            np.add.at(bests, text[hit], best[at[hit]] * times[hit])
            left = pa.array(np.searchsorted(text[~hit], np.arange(n + 1)), pa.int32())
            yield batch_of(whole, batch.column("row"), bests, sums, pa.ListArray.from_arrays(left, pa.array(pairs[~hit])),
                           pa.ListArray.from_arrays(left, pa.array(times[~hit])), *[batch.column(c) for c in fixed])

    told = rows.mapInArrow(partly, "row long, n_best long, count_sum long, pairs array<long>, times array<int>, "
                           + ", ".join(f"{c} {t}" for c, t in fields))
    far = counts.where(~is_heavy)
    if not far.take(1):
        return told.select(*fixed[:5], "n_best", "count_sum", "groups_sha256")
    times = F.col("times").cast("long")
    sums = with_joined(stored(told, "partly"), "pairs", "times", far, {
        "n_best": F.when(F.col("best"), times).otherwise(0), "count_sum": F.col("n") * times})
    return sums.select(*fixed[:5], "n_best", "count_sum", "groups_sha256")
