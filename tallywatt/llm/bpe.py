"""Byte-level BPE by a segment tree over the ranks of adjacent pairs.

The leaves hold ``rank * n + place`` of the pair that starts at a symbol, the
root the smallest, so it names the leftmost pair of lowest rank. A merge updates
three leaves, each in log n steps, until the root holds no pair. A piece of n
bytes thus takes O(n log n), however long it is.

Texts are cut where no token can cross: in front of a single space that is
followed by something else than white space. Distinct cuts are split into pieces
once per batch; pieces that a worker has not seen yet are merged side by side, one
row of a matrix of trees each.
"""

from __future__ import annotations

import hashlib
import json
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywatt.llm.common import Remembered, batch_of, bounded, joined, of_process, slices

#: Pieces that a worker remembers.
REMEMBERED = 200_000
# Fixed value: the split of the byte-level vocabulary.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def merge(symbols: list[int], pairs: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Merge the leftmost pair of lowest rank until none is left.

    pairs: (left, right) -> (rank, merged symbol).
    """
    n = len(symbols)
    if n < 2:
        return list(symbols)
    ids = list(symbols)
    size = 1
    while size < n:
        size *= 2
    none = 1 << 62  # above every rank * n + place
    tree = [none] * (2 * size)
    get = pairs.get
    for i in range(n - 1):
        found = get((ids[i], ids[i + 1]))
        if found:
            tree[size + i] = found[0] * n + i
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))

    def put(i: int, value: int) -> None:
        k = size + i
        if tree[k] == value:
            return
        tree[k] = value
        while k > 1:
            other = tree[k ^ 1]
            low = value if value < other else other
            k >>= 1
            if tree[k] == low:
                return
            tree[k] = value = low

    while tree[1] < none:
        i = tree[1] % n
        j = after[i]
        ids[i] = get((ids[i], ids[j]))[1]
        ids[j] = -1
        after[i] = k = after[j]
        put(j, none)
        if k < n:
            before[k] = i
            found = get((ids[i], ids[k]))
            put(i, found[0] * n + i if found else none)
        else:
            put(i, none)
        h = before[i]
        if h >= 0:
            found = get((ids[h], ids[i]))
            put(h, found[0] * n + h if found else none)
    return [x for x in ids if x >= 0]


class Pairs:
    """Mergeable pairs as arrays."""

    def __init__(self, pairs: dict[tuple[int, int], tuple[int, int]]) -> None:
        keys = np.array([a << 32 | b for a, b in pairs], np.int64)
        ranks = np.array([rank for rank, _ in pairs.values()], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = np.append(keys[order], -1), np.append(ranks[order], 0)
        self.merged = np.zeros(int(ranks.max(initial=0)) + 1, np.int64)
        self.merged[ranks] = [symbol for _, symbol in pairs.values()]

    def leaf(self, left: np.ndarray, right: np.ndarray, place: np.ndarray) -> np.ndarray:
        """rank * LONGEST + place of the pairs, NO_PAIR where there is none."""
        key = left << 32 | right
        at = np.searchsorted(self.keys[:-1], key)
        return np.where(self.keys[at] == key, self.ranks[at] * LONGEST + place, NO_PAIR)


#: Pieces of up to so many symbols are merged side by side.
LONGEST = 64
NO_PAIR = np.int64(1 << 62)


def merge_many(pieces: list[list[int]], pairs: Pairs) -> list[list[int]]:
    """``merge`` of many pieces of at most LONGEST symbols: their trees are rows
    of one matrix, and every step merges one pair in each row that still has one."""
    out: list = [None] * len(pieces)
    sizes = np.array([max(2, 1 << (len(p) - 1).bit_length()) for p in pieces])
    for size in np.unique(sizes).tolist():
        own = np.flatnonzero(sizes == size)
        for at in range(0, len(own), 1 << 14):
            part = own[at:at + (1 << 14)]
            ids, bounds = _merge_rows([pieces[k] for k in part.tolist()], size, pairs)
            for k, a, b in zip(part.tolist(), bounds[:-1], bounds[1:]):
                out[k] = ids[a:b]
    return out


def _merge_rows(pieces: list[list[int]], size: int, pairs: Pairs) -> tuple[list[int], list[int]]:
    n = len(pieces)
    length = np.array([len(p) for p in pieces])
    place = np.arange(size)
    ids = np.full((n, size), -1, np.int64)
    ids[place < length[:, None]] = [x for p in pieces for x in p]
    after = np.broadcast_to(place + 1, (n, size)).copy()
    before = np.broadcast_to(place - 1, (n, size)).copy()
    tree = np.full((n, 2 * size), NO_PAIR)
    paired = place[:-1] + 1 < length[:, None]
    found = pairs.leaf(ids[:, :-1], ids[:, 1:], place[:-1])
    tree[:, size:2 * size - 1] = np.where(paired, found, NO_PAIR)
    for k in range(size - 1, 0, -1):
        tree[:, k] = np.minimum(tree[:, 2 * k], tree[:, 2 * k + 1])
    row = np.arange(n)

    def put(row: np.ndarray, leaf: np.ndarray, value: np.ndarray) -> None:
        at = size + leaf
        tree[row, at] = value
        while at[0] > 1:
            at >>= 1
            tree[row, at] = np.minimum(tree[row, 2 * at], tree[row, 2 * at + 1])

    while True:
        row = row[tree[row, 1] < NO_PAIR]
        if not len(row):
            break
        rank, i = np.divmod(tree[row, 1], LONGEST)
        j = after[row, i]
        ids[row, i] = pairs.merged[rank]
        ids[row, j] = -1
        k = after[row, j]
        after[row, i] = k
        put(row, j, np.full(len(row), NO_PAIR))
        inside = k < length[row]
        before[row[inside], k[inside]] = i[inside]
        value = np.full(len(row), NO_PAIR)
        value[inside] = pairs.leaf(ids[row, i][inside], ids[row[inside], k[inside]], i[inside])
        put(row, i, value)
        h = before[row, i]
        inside = h >= 0
        if inside.any():
            at, h = row[inside], h[inside]
            put(at, h, pairs.leaf(ids[at, h], ids[at, i[inside]], h))
    left = ids >= 0
    return ids[left].tolist(), np.concatenate([[0], np.cumsum(left.sum(axis=1))]).tolist()


class ByteBpe:
    """Encoder and decoder of a byte-level ``tokenizers`` file."""

    def __init__(self, path: str) -> None:
        import regex

        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        ids = told["model"]["vocab"]
        byte_of = _bytes_of_characters()
        character_of = {b: c for c, b in byte_of.items()}
        self.of_byte = [ids[character_of[b]] for b in range(256)]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in told["model"]["merges"]]
        self.pairs = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(merges)}
        self.pair_arrays = Pairs(self.pairs)
        self.special = {t["content"]: t["id"] for t in told.get("added_tokens", [])}
        bytes_of = {i: bytes(byte_of[c] for c in token) for token, i in ids.items() if token not in self.special}
        bytes_of |= {i: token.encode() for token, i in self.special.items()}
        every = range(max(bytes_of) + 1)
        #: By id: the token's bytes, and the id in decimal with a comma behind it.
        self.tokens = pa.array([bytes_of.get(i, b"") for i in every], pa.large_binary())
        self.decimals = pa.array([b"%d," % i for i in every], pa.large_binary())
        self.pieces = regex.compile(PIECES).findall
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.known = Remembered(REMEMBERED)

    def of_pieces(self, pieces: list[str]) -> list:
        """Ids of each piece."""
        out = [self.known.get(p) for p in pieces]
        new = [k for k, ids in enumerate(out) if ids is None]
        symbols = [[self.of_byte[b] for b in pieces[k].encode()] for k in new]
        short = [k for k, own in enumerate(symbols) if len(own) <= LONGEST]
        for k, ids in zip(short, merge_many([symbols[k] for k in short], self.pair_arrays)):
            out[new[k]] = ids
            self.known.put(pieces[new[k]], ids)
        for k, own in enumerate(symbols):
            if len(own) > LONGEST:
                out[new[k]] = merge(own, self.pairs)
        return out

    def split(self, cuts: list[str], spaced: int) -> tuple[list[str], np.ndarray]:
        """Pieces of all cuts in a row, and where each cut's begin. The first
        ``spaced`` cuts begin with a space and something else than white space, so
        no piece crosses from one into the next."""
        pieces = self.pieces("".join(cuts[:spaced]))
        ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        bounds = np.searchsorted(ends, np.cumsum([0, *map(len, cuts[:spaced])]), "right").tolist()
        for cut in cuts[spaced:]:
            parts = self.specials.split(cut) if self.specials and any(x in cut for x in self.special) else [cut]
            for part in parts:
                pieces += [part] if part in self.special else self.pieces(part)
            bounds.append(len(pieces))
        return pieces, np.array(bounds)


def _bytes_of_characters() -> dict[str, int]:
    """Byte-level vocabularies write a byte as a printable character: itself if
    it is printable in Latin-1, else the next free one from U+0100."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def _bpe(path: str) -> ByteBpe:
    kept = of_process("byte_bpe")
    if path not in kept:
        kept[path] = ByteBpe(path)
    return kept[path]


class Cuts(NamedTuple):
    """Cut j of text i: ``cuts[codes[offsets[i] + j]]``; the first ``spaced`` cuts
    begin with a space."""

    codes: np.ndarray
    offsets: np.ndarray
    cuts: list[str]
    spaced: int


def _cut(texts: pa.Array, specials: list[str]) -> Cuts:
    lists = pc.split_pattern(texts, " ")
    offsets = lists.offsets.to_numpy().astype(np.int64)
    coded = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
    offsets = offsets - offsets[0]
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    raw = coded.dictionary.to_pylist()
    # what follows a space must not begin with white space, else the text stays whole
    loose = np.fromiter((not c or c[0].isspace() for c in raw), bool, len(raw))[codes]
    loose[offsets[:-1][np.diff(offsets) > 0]] = False
    whole = np.diff(np.concatenate([[0], np.cumsum(loose)])[offsets]) > 0
    for special in specials:
        whole |= pc.match_substring(texts, special).to_numpy(zero_copy_only=False)
    # cuts that stand behind a space nowhere are not wanted in that form
    cuts = [" " + c if c and not c[0].isspace() else "" for c in raw]
    first: dict[str, int] = {}

    def own(text: str) -> int:
        if text not in first:
            first[text] = len(cuts)
            cuts.append(text)
        return first[text]

    for i in np.flatnonzero(np.diff(offsets) > 0).tolist():
        if not whole[i]:
            codes[offsets[i]] = own(raw[codes[offsets[i]]])
    if whole.any():
        kept = np.ones(len(codes), bool)
        for i in np.flatnonzero(whole).tolist():
            kept[offsets[i] + 1:offsets[i + 1]] = False
            codes[offsets[i]] = own(texts[i].as_py())
        offsets = np.concatenate([[0], np.cumsum(kept)])[offsets]
        codes = codes[kept]
    return Cuts(codes, offsets, cuts, len(raw))


def _spread(bounds: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the items of ``codes`` in a row, and where each code's begin."""
    size = np.diff(bounds)[codes]
    ends = np.concatenate([[0], np.cumsum(size)])
    return np.repeat(bounds[codes] - ends[:-1], size) + np.arange(ends[-1]), ends


def _encode(texts: pa.Array, bpe: ByteBpe) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts in a row, where each text's begin)."""
    cut = _cut(texts, list(bpe.special))
    pieces, piece_bounds = bpe.split(cut.cuts, cut.spaced)
    codes: dict[str, int] = {}
    piece_codes = np.fromiter((codes.setdefault(p, len(codes)) for p in pieces), np.int64, len(pieces))
    for special, one in bpe.special.items():
        if special in codes:
            bpe.known.put(special, [one])
    ids = bpe.of_pieces(list(codes))
    bounds = np.concatenate([[0], np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))])
    flat = np.fromiter(chain.from_iterable(ids), np.int64, int(bounds[-1]))
    place, in_cut = _spread(piece_bounds, cut.codes)
    place, in_piece = _spread(bounds, piece_codes[place])
    return flat[place], in_piece[in_cut[cut.offsets]]


def bpe_round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text and decode its ids again.

    One row per document: doc_id, n_tokens, ids (little-endian 32-bit), decoded
    (UTF-8). Null and empty texts have no ids and decode to the empty text. Equal
    rows give equal rows; other columns are ignored; an empty table gives none.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()),
                        ("decoded", pa.binary())])

    def rows(batches):
        bpe = _bpe(path)
        for batch in slices(batches, "text"):
            ids, at = _encode(pc.fill_null(batch.column("text"), ""), bpe)
            text, ends = joined(bpe.tokens, ids)
            data = ids.astype("<u4").tobytes()
            yield batch_of(schema, batch.column("doc_id"), np.diff(at),
                           [data[4 * a:4 * b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())],
                           [bytes(text[ends[a]:ends[b]]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())])

    return _narrow(docs, id_col, text_col).mapInArrow(rows, "doc_id long, n_tokens long, ids binary, decoded binary")


def bpe_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``bpe_round_trip`` with ids and decoded text as SHA-256: of the decimal
    ids joined by commas, and of the decoded text."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()),
                        ("decoded_sha256", pa.string())])

    def sha(data: memoryview, a: int, b: int) -> str:
        return hashlib.sha256(data[a:b]).hexdigest()

    def rows(batches):
        bpe = _bpe(path)
        for batch in slices(batches, "text"):
            ids, at = _encode(pc.fill_null(batch.column("text"), ""), bpe)
            told, told_ends = joined(bpe.decimals, ids)
            text, text_ends = joined(bpe.tokens, ids)
            yield batch_of(
                schema, batch.column("doc_id"), np.diff(at),
                [sha(told, a, max(a, b - 1)) for a, b in zip(told_ends[at[:-1]].tolist(), told_ends[at[1:]].tolist())],
                [sha(text, a, b) for a, b in zip(text_ends[at[:-1]].tolist(), text_ends[at[1:]].tolist())])

    return _narrow(docs, id_col, text_col).mapInArrow(
        rows, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _narrow(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
