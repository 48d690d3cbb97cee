"""Token ids by a ``tokenizers`` file, worked out once per distinct piece.

For tokenizers that drop white space (as ``word_bpe_49k.json`` does): no token
crosses ASCII white space there, so a text's ids are its words' ids in a row.
Words of printable ASCII and of the Latin letters up to U+017F are lowered here and
cut as the file's expression cuts them; their pieces go to the library's model. All
other words go through the whole library. A worker remembers pieces and such words.
"""

from __future__ import annotations

import itertools
import json
import os
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from tallywatt.llm.common import joined, of_process, words_of

#: Pieces that a worker remembers, with ids of BYTES_PER_PIECE on average; at a limit it starts anew.
REMEMBERED, BYTES_PER_PIECE = 1_500_000, 32
#: Bytes of a piece that is remembered; longer ones are encoded each time.
LONGEST = 256
_MARK = "\x01"
#: Bytes of a piece that is its own key; longer ones are hashed.
_KEY_BYTES = 15
# The expression that ``_units`` follows, the byte-level alphabet
# and which bytes no plain word has.
_EXPRESSION = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE_LEVEL = {b: 0x100 + k for k, b in enumerate(b for b in range(0x100) if b not in _SHOWN)}
_OTHER_BYTES = np.array([not (0x21 <= b <= 0x7E or 0x80 <= b <= 0xBF or 0xC3 <= b <= 0xC5) for b in range(0x100)])
_LETTER, _DIGIT, _SIGN = 0, 1, 2
_CLASSES = np.array([_LETTER if b >= 0x80 or chr(b).isalpha() else _DIGIT if chr(b).isdigit() else _SIGN for b in range(0x100)], np.uint8)
_SUFFIXES = {n: [int.from_bytes(x.encode()) for x in "s t re ve m ll d".split() if len(x) == n] for n in (1, 2)}
_LOW_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


class Encoded(NamedTuple):
    """Little-endian 32-bit ids of all texts and where each text's begin (in ids)."""

    ids: np.ndarray
    offsets: np.ndarray


class Known:
    """Ids of pieces by their 128-bit keys: sorted arrays, some 40 bytes a piece."""

    def __init__(self) -> None:
        self.h1, self.h2, self.place = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.ids = pa.array([], pa.large_binary())

    def places(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Place of the ids of each piece, -1 where it is not known; in the order of h1 it is found faster."""
        if not len(self.h1):
            return np.full(len(h1), -1)
        at = np.minimum(np.searchsorted(self.h1, h1), len(self.h1) - 1)
        return np.where((self.h1[at] == h1) & (self.h2[at] == h2), self.place[at], -1)

    def add(self, h1: np.ndarray, h2: np.ndarray, pool: pa.Array, limit: int) -> None:
        """New pieces, each once and in the order of h1; ``pool`` has the known ids, then theirs."""
        first = len(self.ids)
        if first + len(h1) > limit or pool.nbytes > limit * BYTES_PER_PIECE:
            self.__init__()
            pool, first = pool.slice(first), 0
        at = np.searchsorted(self.h1, h1)
        self.h1, self.h2 = np.insert(self.h1, at, h1), np.insert(self.h2, at, h2)
        self.place = np.insert(self.place, at, first + np.arange(len(h1)))
        self.ids = pool


class Units(NamedTuple):
    """What is encoded: ``codes[starts[i]:starts[i + 1]]`` are the pieces of word i,
    or the word itself, as places in ``names``; ``plain`` tells the pieces."""

    codes: np.ndarray
    starts: np.ndarray
    names: pa.Array
    plain: np.ndarray


def _tokenizer(path: str):
    kept = of_process("tokenizers")
    if path not in kept:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        kept[path] = tokenizer, Known(), _cut_of(tokenizer)
    return kept[path]


def _cut_of(tokenizer) -> str | None:
    """The expression that cuts lowered words into the model's pieces; None if the
    file has other steps than those that are followed here."""
    if tokenizer.normalizer is None or tokenizer.pre_tokenizer is None:
        return None
    normal, cut = (json.loads(step.__getstate__()) for step in (tokenizer.normalizer, tokenizer.pre_tokenizer))
    # of these, only the last changes plain words
    lowers = [n["type"] for n in normal.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
    if not lowers or normal["normalizers"][1]["pattern"] != {"Regex": r"\s+"} or tokenizer.post_processor is not None:
        return None
    steps = cut.get("pretokenizers", [])
    if [x["type"] for x in steps] != ["Split", "ByteLevel"]:
        return None
    split, to_bytes = steps
    if split["pattern"].get("Regex") != _EXPRESSION or not (split["behavior"] == "Removed" and split["invert"]):
        return None
    if to_bytes["add_prefix_space"] or to_bytes["use_regex"]:
        return None
    return _EXPRESSION


def largest_id(path: str) -> int:
    return max(_tokenizer(path)[0].get_vocab().values())


def _bytes_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of large strings."""
    offsets = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1, words.offset * 8)
    data = words.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def _plain(words: pa.Array) -> np.ndarray:
    """Which words have no other characters than printable ASCII and the letters of
    U+00C0 to U+017F, which NFC leaves as they are and lowering maps one to one
    (not so U+0130), and no mark of a special token."""
    data, offsets = _bytes_of(words)
    after = np.append(data[1:], np.uint8(0))
    bad = _OTHER_BYTES[data] | ((data == ord("<")) & (after == ord("|")))
    lead = np.flatnonzero(data >= 0xC3)
    pair = data[lead].astype(np.int64) << 8 | after[lead]
    bad[lead] |= (pair == 0xC397) | (pair == 0xC3B7) | (pair == 0xC4B0)
    out = np.ones(len(words), bool)
    out[np.searchsorted(offsets, np.flatnonzero(bad), "right") - 1] = False
    return out


def _units(words: pa.Array, cut: str | None) -> Units:
    words = words.cast(pa.large_string())
    plain = _plain(words) if cut else np.zeros(len(words), bool)
    if plain.all():
        words = pc.utf8_lower(words)
    elif plain.any():
        words = pc.if_else(pa.array(plain), pc.utf8_lower(words), words)
    data, offsets = _bytes_of(words)
    kind = _CLASSES[data]
    begins = np.zeros(len(data) + 1, bool)
    begins[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
    inside = np.ones(len(data) + 1, bool)
    inside[offsets] = False
    begins[offsets] = True
    _join_suffixes(begins, data, inside)
    if not plain.all():
        begins[:-1] &= np.repeat(plain, np.diff(offsets))
        begins[offsets] = True
    bounds = np.flatnonzero(begins)
    pieces = pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds), pa.py_buffer(data))
    coded = pieces.dictionary_encode()
    codes, starts = coded.indices.to_numpy(), np.searchsorted(bounds, offsets)
    of_plain = np.zeros(len(coded.dictionary), bool)
    of_plain[codes if plain.all() else codes[np.repeat(plain, np.diff(starts))]] = True
    return Units(codes, starts, coded.dictionary, of_plain)


def _join_suffixes(begins: np.ndarray, data: np.ndarray, inside: np.ndarray) -> None:
    """'s, 't, 're, 've, 'm, 'll and 'd are pieces where a piece begins with the
    sign; ``inside``: places that lie in the word of the place before."""
    at = np.flatnonzero((data == ord("'")) & begins[:-1])
    if not len(at):
        return
    room = np.append(data, np.zeros(2, np.uint8)).astype(np.int64)
    here = np.append(inside, [False, False])
    one = np.where(here[at + 1], room[at + 1], 0)
    two = np.where(here[at + 1] & here[at + 2], one << 8 | room[at + 2], 0)
    size = np.where(np.isin(one, _SUFFIXES[1]), 1, np.where(np.isin(two, _SUFFIXES[2]), 2, 0))
    at, size = at[size > 0], size[size > 0]
    begins[at + 1] = False
    begins[at + 1 + size] = True


def _keys(names: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each name: its bytes and their number, of longer names a hash;
    the first half is mixed."""
    data, offsets = _bytes_of(names)
    start, size = offsets[:-1], np.diff(offsets)
    padded = np.append(data, np.zeros(16, np.uint8))
    eight = np.ndarray((len(data) + 9,), "<u8", padded, strides=(1,))
    low = eight[start] & _LOW_BYTES[np.minimum(size, 8)]
    high = eight[start + 8] & _LOW_BYTES[np.clip(size - 8, 0, 7)] | size.astype(np.uint64) << np.uint64(56)
    long = np.flatnonzero(size > _KEY_BYTES)
    if len(long):
        held = padded.data
        told = b"".join([xxhash.xxh3_128_digest(held[a:b]) for a, b in zip(start[long].tolist(), offsets[long + 1].tolist())])
        low[long], high[long] = np.frombuffer(told, np.uint64).reshape(-1, 2).T
        high[long] |= np.uint64(1 << 63)  # apart from all sizes
    return _mixed(high) ^ _mixed(~low), low


def _mixed(keys: np.ndarray) -> np.ndarray:
    """One to one."""
    keys = keys * np.uint64(0x9E3779B97F4A7C15)
    keys ^= keys >> np.uint64(32)
    return keys * np.uint64(0xD6E8FEB86659FD93)


def _encode_new(tokenizer, names: pa.Array, plain: np.ndarray) -> pa.Array:
    """Ids of each name, as large binary."""
    places = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
    found = _encode_pieces(tokenizer, names.filter(pa.array(plain)).to_pylist())
    if plain.all():
        return found
    other = _encode_other(tokenizer, names.filter(pa.array(~plain)).to_pylist())
    return pa.concat_arrays([found, other]).take(pa.array(np.argsort(places)))


def _encode_pieces(tokenizer, pieces: list[str]) -> pa.Array:
    model = tokenizer.model
    rows = [[t.id for t in model.tokenize(p if p.isascii() else p.encode().decode("latin-1").translate(_BYTE_LEVEL))] for p in pieces]
    ends = np.cumsum([0, *map(len, rows)]) * 4
    ids = np.fromiter(itertools.chain.from_iterable(rows), "<u4", ends[-1] // 4)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(ids)])


def _encode_other(tokenizer, words: list[str]) -> pa.Array:
    """Ids of any words; they go to the library in rows, between marks whose id
    tells them apart again."""
    mark = tokenizer.encode(_MARK, add_special_tokens=False).ids
    plain = [w for w in words if _MARK not in w] if len(mark) == 1 else []
    found = {}
    for at in range(0, len(plain), 1024):
        part = plain[at:at + 1024]
        row = tokenizer.encode_batch_fast([f" {_MARK} ".join(part)], add_special_tokens=False)[0].ids
        ids = np.array(row, "<u4")
        ends = np.append(np.flatnonzero(ids == mark[0]), len(ids))
        if len(ends) != len(part):
            continue
        start = 0
        for word, end in zip(part, ends.tolist()):
            found[word] = ids[start:end].tobytes()
            start = end + 1
    left = [w for w in words if w not in found]
    for word, one in zip(left, tokenizer.encode_batch_fast(left, add_special_tokens=False)):
        found[word] = np.array(one.ids, "<u4").tobytes()
    return pa.array([found[w] for w in words], pa.large_binary())


def encode(texts: pa.Array, path: str, remembered: int | None = None) -> Encoded:
    """Ids of each text without special tokens added; null is empty. Special
    tokens' strings in a text are found as the library finds them. A text's ids
    do not depend on the texts beside it."""
    tokenizer, known, cut = _tokenizer(path)
    words = words_of(texts)
    units = _units(words.vocabulary, cut)
    h1, h2 = _keys(units.names)
    order = np.argsort(h1)
    h1, h2 = h1[order], h2[order]
    found = known.places(h1, h2)
    new = np.flatnonzero(found < 0)
    pool = known.ids
    if len(new):
        short = pc.binary_length(units.names.take(pa.array(order[new]))).to_numpy() <= LONGEST
        new, kept = np.concatenate([new[short], new[~short]]), int(short.sum())
        ids = _encode_new(tokenizer, units.names.take(pa.array(order[new])), units.plain[order[new]])
        found[new] = len(pool) + np.arange(len(new))
        pool = pa.concat_arrays([pool, ids])
        known.add(h1[new[:kept]], h2[new[:kept]], pool.slice(0, len(pool) - len(new) + kept), remembered or REMEMBERED)
    place = np.empty(len(order), np.int64)
    place[order] = found
    data, ends = joined(pool, place[units.codes])
    bounds = pa.py_buffer(ends[units.starts])
    by_word = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(words.vocabulary), [None, bounds, pa.py_buffer(data)])
    data, ends = joined(by_word, words.codes)
    ids = np.frombuffer(data, "<u4", (int(ends[-1]) - int(ends[0])) // 4, int(ends[0]))
    return Encoded(ids, (ends[words.offsets] - ends[0]) // 4)
