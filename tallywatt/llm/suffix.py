"""Byte strings that already start in an earlier document, by suffix arrays.

A 50-byte string is routed by the smallest hash among its 20-byte grams, so equal
strings meet whatever document they come from, and the strings of a run with the
same smallest gram travel as one segment. A sketch of the grams seen in two
documents keeps the others at home. What meets is cut into shards of up to two
million bytes; each gets its own suffix array by Larsson and Sadakane's refinement
(only unsorted groups are sorted again, by the ranks h bytes on, h doubling) and
its common prefixes by Kasai's inequality; strings with a common prefix of 50
bytes form a group, whose smallest document keeps them. A route that fills more
than one shard is merged by binary search in the shards' sorted strings.

Of equal segments only the smallest document needs an answer: everywhere else
the whole segment goes. So equal segments are combined before they travel, and
answers go to one document each. A segment that is left alone on its route shares
no string and needs no suffix array.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywatt.llm.common import _give_back as give_back
from tallywatt.llm.common import batch_of, bounded, inverse_powers, powers, slices, text_bytes
from tallywatt.llm.sketch import Sketch, cell_bits, repeated_cells

LENGTH, GRAM = 50, 20
#: Bytes of one suffix array; a place fits 21 bits, so three numbers fit a key.
PLACE_BITS = 21
CAPACITY = (1 << PLACE_BITS) - 2
#: Text that a task works on at once (its arrays fit the processor's cache), text
#: after which it sends segments on, and over which it counts those of a gram.
PIECE_BYTES, FLUSH_BYTES, COUNTED_BYTES = 1 << 17, 8 << 20, 16 << 20
#: Text per shard and per bucket of documents, on average; least number of each.
#: A flush sends a packet to every shard and a shard to every bucket, so that the
#: number of packets grows with the square of the text: shards are not small.
SHARD_TEXT, BUCKET_TEXT, LEAST_PARTS = 8 << 20, 8 << 20, 64
#: Answers that a task holds before it sends them on to the buckets.
ANSWERED = 1 << 18
#: A gram is hot if it leads more distinct segments than this, or than a 2^-16 of
#: the text's bytes / 64; its strings are routed one by one, by their own hash.
HOT_SEGMENTS, HOT_SHARE, HOT_IN_FLUSH = 4096, 1 << 22, 64

#: Strings of one segment; longer runs (one gram again and again) are cut.
LONGEST = 1 << 16

_NO_DOC = np.iinfo(np.int64).max
_BASE, _BASE2 = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
_MIX, _MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h *= _MIX
    h ^= h >> np.uint64(33)
    h *= _MIX2
    return h ^ (h >> np.uint64(33))


class Rolling(NamedTuple):
    sums: np.ndarray
    inverse: np.ndarray

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the byte ranges, their lengths included."""
        raw = (self.sums[end] - self.sums[start]) * self.inverse[start]
        return _mix(raw + (end - start).astype(np.uint64) * _MIX)


def rolling(data: np.ndarray, base: int = _BASE) -> Rolling:
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(data * powers(base, len(data)), out=sums[1:])
    return Rolling(sums, inverse_powers(base, len(data) + 1))


def hashes_of(parts: pa.Array, base: int = _BASE) -> np.ndarray:
    """Hash of each byte string, PIECE_BYTES of them at a time."""
    data, ends = _flat(parts)
    out, at = np.zeros(len(parts), np.uint64), 0
    while at < len(parts):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + PIECE_BYTES, "right")) - 1)
        own = ends[at:to + 1] - ends[at]
        out[at:to] = rolling(data[ends[at]:ends[to]], base).of(own[:-1], own[1:])
        at = to
    return out


class Segments(NamedTuple):
    """Runs of strings: the starts ``first`` to ``last`` of one text, their
    bytes ``first`` to ``last + LENGTH``, their route and their hash."""

    first: np.ndarray
    last: np.ndarray
    text: np.ndarray
    route: np.ndarray
    hash: np.ndarray


def segments(data: np.ndarray, bounds: np.ndarray) -> Segments:
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return Segments(none, none, none, none.astype(np.uint64), none.astype(np.uint64))
    hashes = rolling(data)
    n = len(data) - GRAM + 1
    gram = _mix((hashes.sums[GRAM:] - hashes.sums[:n]) * hashes.inverse[:n])
    least, width = gram, 1
    while 2 * width <= LENGTH - GRAM + 1:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = LENGTH - GRAM + 1 - width
    if rest:
        least = np.minimum(least[:-rest], least[rest:])
    # a string starts at i if it ends in the same text
    size = np.diff(bounds)
    starts = np.maximum(size - LENGTH + 1, 0)
    at = np.repeat(bounds[:-1] - np.concatenate([[0], np.cumsum(starts)[:-1]]), starts) + np.arange(starts.sum())
    if not len(at):
        return Segments(none, none, none, none.astype(np.uint64), none.astype(np.uint64))
    least = least[at]
    cut = np.concatenate([[True], (least[1:] != least[:-1]) | (at[1:] != at[:-1] + 1)])
    new = np.flatnonzero(cut)
    if np.diff(np.append(new, len(at))).max() > LONGEST:
        since = np.arange(len(at)) - np.maximum.accumulate(np.where(cut, np.arange(len(at)), 0))
        new = np.flatnonzero(since % LONGEST == 0)
    first, last, route = at[new], at[np.append(new[1:], len(at)) - 1], least[new]
    return Segments(first, last, np.searchsorted(bounds, first, "right") - 1, route, hashes.of(first, last + LENGTH))


def _among(route: np.ndarray, hot: np.ndarray) -> np.ndarray:
    place = np.searchsorted(hot, route)
    return hot[np.minimum(place, len(hot) - 1)] == route if len(hot) else np.zeros(len(route), bool)


def singled(found: Segments, data: np.ndarray, hot: np.ndarray) -> Segments:
    """The segments of hot grams as strings, each routed by its own hash."""
    many = _among(found.route, hot)
    if not many.any():
        return found
    size = (found.last - found.first + 1)[many]
    start = np.repeat(found.first[many] - (np.cumsum(size) - size), size) + np.arange(size.sum())
    own = rolling(data).of(start, start + LENGTH)
    single = Segments(start, start, np.repeat(found.text[many], size), own, own)
    return Segments(*(np.concatenate([a[~many], b]) for a, b in zip(found, single)))


def _bytes_of(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The byte ranges, each longer than 12 bytes, as a large binary array."""
    views = np.zeros((len(start), 4), np.int32)  # size, first four bytes, buffer, place
    views[:, 0], views[:, 3] = end - start, start
    views[:, 1] = np.ascontiguousarray(data[start[:, None] + np.arange(4)]).view(np.int32).ravel()
    return pa.Array.from_buffers(pa.binary_view(), len(start), [None, pa.py_buffer(views), pa.py_buffer(data)]).cast(pa.large_binary())


def _flat(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    ends = np.frombuffer(array.buffers()[1], np.int64, len(array) + 1, array.offset * 8)
    data = array.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[ends[0]:ends[-1]], ends - ends[0]


class Held(NamedTuple):
    """Distinct segments by (shard, route, hashes), each with its smallest document."""

    route: np.ndarray
    doc: np.ndarray
    hash: np.ndarray
    bytes: pa.Array


def distinct(route: np.ndarray, doc: np.ndarray, h1: np.ndarray, h2: np.ndarray, parts: pa.Array, n_shards: int = 1) -> Held:
    order = np.lexsort((h2, h1, route, route % np.uint64(n_shards)))
    if not len(order):
        return Held(route, doc, h1, parts)
    r, a, b = route[order], h1[order], h2[order]
    new = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    return Held(r[new], np.minimum.reduceat(doc[order], new), a[new], parts.take(pa.array(order[new])))


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Places of the suffixes in order."""
    n = len(data)
    mask = np.int64((1 << PLACE_BITS) - 1)
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.int64)
    key = padded[:n].copy()
    for k in range(1, 5):
        key = key << 8 | padded[k:n + k]
    key = np.sort(key << PLACE_BITS | np.arange(n))
    order = key & mask
    key >>= PLACE_BITS
    head = np.concatenate([[True], key[1:] != key[:-1]])
    group = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    rank = np.zeros(n + 1, np.int64)  # 0: behind the end
    rank[order] = group + 1
    h = 5
    while True:
        single = head & np.append(head[1:], True)
        left = np.flatnonzero(~single)
        if not len(left):
            break
        place = order[left]
        key = np.sort(group[left] << 2 * PLACE_BITS | rank[np.minimum(place + h, n)] << PLACE_BITS | place)
        place = key & mask
        key >>= PLACE_BITS
        new = np.concatenate([[True], key[1:] != key[:-1]])
        order[left] = place
        head[left] = new
        group[left] = left[np.maximum.accumulate(np.where(new, np.arange(len(left)), 0))]
        rank[place] = group[left] + 1
        h *= 2
    return order


def common_prefixes(data: np.ndarray, order: np.ndarray, cap: int, stride: int = 16) -> np.ndarray:
    """Common prefix of each suffix with the one before it in ``order``, exact
    below ``cap``.

    Kasai: going one byte on in the text loses one byte of the common prefix at
    most. Every ``stride``-th place is compared from its first byte on, the places
    behind it from what it promises.
    """
    n = len(data)
    words = np.concatenate([data, np.zeros(cap + 2 * stride + 16, np.uint8)]).astype(np.uint64)
    word = words[:len(words) - 8].copy()
    for k in range(1, 8):
        word = word << np.uint64(8) | words[k:len(words) - 8 + k]
    before = np.empty(n, np.int64)
    before[order[1:]] = order[:-1]
    before[order[0]] = order[0]
    out = np.zeros(n, np.int64)

    def extend(place: np.ndarray, limit: int) -> None:
        place = place[out[place] < limit]
        while len(place):
            differ = word[place + out[place]] ^ word[before[place] + out[place]]
            same = np.zeros(len(place), np.int64)
            for shift in range(8, 65, 8):
                same += differ < np.uint64(1 << (64 - shift)) if shift < 64 else differ == 0
            out[place] += same
            place = place[(same == 8) & (out[place] < limit)]
        out[order[0]] = 0  # nothing is before it

    extend(np.arange(0, n, stride), cap + stride)
    for k in range(1, stride):
        place = np.arange(k, n, stride)
        out[place] = np.maximum(out[place - 1] - 1, 0)
        extend(place, cap + stride - k)
    found = out[order]
    # behind the end there is nothing to share
    return np.minimum(found, np.minimum(n - order, n - np.append(order[:1], order[:-1])))


def _shard(data: np.ndarray, ends: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, ...]:
    """(order of the strings' starts, group of each, smallest document of each
    group, place of each group's first string) of one suffix array."""
    size = np.diff(ends)
    order = suffix_array(data)
    group = np.cumsum(common_prefixes(data, order, LENGTH) < LENGTH)
    owner = np.repeat(np.arange(len(size)), size)
    sound = ends[1:][owner[order]] - order >= LENGTH
    order, group = order[sound], group[sound]
    new = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    least = np.minimum.reduceat(doc[owner[order]], new)
    group = np.cumsum(np.concatenate([[0], group[1:] != group[:-1]]))
    return order, group, least, order[new]


def _starts(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... size[0] of them, then those of the next."""
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())


def removed_strings(held: Held) -> tuple[np.ndarray, np.ndarray]:
    """(flags of the segments' strings behind one another, number of each segment's):
    which strings start in a smaller document too."""
    size = np.diff(_flat(held.bytes)[1]) - LENGTH + 1
    gone = np.zeros(int(size.sum()), bool)
    if not len(size):
        return gone, size
    # equal strings have one route: a segment that is alone on its own shares none
    new = np.concatenate([[True], held.route[1:] != held.route[:-1]])
    met = np.flatnonzero(~(new & np.append(new[1:], True)))
    if len(met):
        gone[_starts((np.cumsum(size) - size)[met], size[met])] = _removed(Held(*(c[met] for c in held[:3]), held.bytes.take(pa.array(met))))
    return gone, size


def _removed(held: Held) -> np.ndarray:
    _, ends = _flat(held.bytes)
    out: list = []
    at, n = 0, len(held.doc)
    while at < n:
        # whole routes as long as they fit; a larger route takes several shards
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + CAPACITY, "right")) - 1)
        if to < n and held.route[to] == held.route[to - 1]:
            begin = int(np.searchsorted(held.route, held.route[to]))
            if begin > at:
                to = begin
            else:
                to = int(np.searchsorted(held.route, held.route[to], "right"))
        out += _filled(held, at, to)
        at = to
    return np.concatenate(out)


def _filled(held: Held, at: int, to: int) -> list[np.ndarray]:
    shards = []
    while at < to:
        _, ends = _flat(held.bytes.slice(at, to - at))
        stop = at + max(1, int(np.searchsorted(ends, CAPACITY, "right")) - 1)
        shards.append((at, min(stop, to)))
        at = shards[-1][1]
    found, out = [], []
    for a, b in shards:
        data, ends = _flat(held.bytes.slice(a, b - a))
        found.append((data, ends, *_shard(data, ends, held.doc[a:b])))
    if len(found) > 1:
        found = _merge(found)
    for (a, b), (_, ends, order, group, least, _) in zip(shards, found):
        size = np.diff(ends)
        gone = np.zeros(int(ends[-1]), bool)
        gone[order] = least[group] < np.repeat(held.doc[a:b], size)[order]
        out.append(gone[_starts(ends[:-1], size - LENGTH + 1)])
    return out


def _merge(found: list[tuple]) -> list[tuple]:
    """Smallest documents over all shards: each shard's sorted strings are looked
    up in the sorted strings of those before it by binary search."""
    known, docs = np.zeros(0, f"S{LENGTH}"), np.zeros(0, np.int64)
    own = []
    for data, _, _, _, least, first in found:
        strings = np.ascontiguousarray(data[first[:, None] + np.arange(LENGTH)]).view(f"S{LENGTH}").ravel()
        own.append(strings)
        place = np.searchsorted(known, strings)
        hit = np.zeros(len(strings), bool)
        if len(known):
            hit = known[np.minimum(place, len(known) - 1)] == strings
            np.minimum.at(docs, place[hit], least[hit])
        known, docs = np.insert(known, place[~hit], strings[~hit]), np.insert(docs, place[~hit], least[~hit])
    return [(data, ends, order, group, docs[np.searchsorted(known, strings)], first)
            for (data, ends, order, group, _, first), strings in zip(found, own)]


def _pack(*arrays: np.ndarray) -> bytes:
    sizes = np.array([a.nbytes for a in arrays], "<i8")
    raw = b"".join([sizes.tobytes(), *[a.tobytes() for a in arrays]])
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(raw, asbytes=True)


def _unpack(blob: bytes, *kinds: str) -> list[np.ndarray]:
    raw = pa.Codec("zstd").decompress(memoryview(blob)[8:], int.from_bytes(blob[:8], "little"), asbytes=True)
    sizes = np.frombuffer(raw, "<i8", len(kinds))
    ends = np.cumsum(sizes) + 8 * len(kinds)
    return [np.frombuffer(raw[e - s:e], kind) for s, e, kind in zip(sizes.tolist(), ends.tolist(), kinds)]


def _answer_key(doc: np.ndarray, own: np.ndarray) -> np.ndarray:
    return _mix(own + _mix(doc.astype(np.int64).view(np.uint64) + _MIX2))


def remove_earlier_strings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove each byte that a 50-byte string covers which also starts in a
    document with a smaller id; strings are judged on the input.

    One row per document: doc_id, n_bytes, n_removed, n_spans (maximal removed
    runs) and kept (the other bytes). Null and short texts lose nothing. Rows that
    share an id do not take from each other; a null id is larger than all others.
    An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    narrow = bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    size = narrow.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_shards = max(LEAST_PARTS, -(-size // SHARD_TEXT))
    n_buckets = max(LEAST_PARTS, -(-size // BUCKET_TEXT))

    def pieces(batches):
        for batch in slices(batches, "text", PIECE_BYTES):
            yield batch, batch.column("doc_id").fill_null(_NO_DOC).to_numpy(), *text_bytes(batch.column("text"))

    def grams(batches):
        for _, ids, data, bounds in pieces(batches):
            found = segments(data, bounds)
            order = np.lexsort((ids[found.text], found.route))
            route, doc = found.route[order], ids[found.text][order]
            route = route[np.concatenate([np.ones(min(1, len(route)), bool), (route[1:] != route[:-1]) | (doc[1:] != doc[:-1])])]
            yield route, route

    # a gram leads about every 16th byte; eight cells each
    grams_seen = spark.sparkContext.broadcast(tuple(repeated_cells(narrow, grams, cell_bits(size // 8))))

    def meeting(data, bounds):
        """Segments whose gram is estimated to be in two documents."""
        found = segments(data, bounds)
        left = Sketch(*grams_seen.value).repeated(found.route, found.route)
        return Segments(*(c[left] for c in found))

    heavy = pa.schema([("route", pa.int64()), ("n", pa.int64())])

    def heavy_grams(batches):
        held, count = [], 0
        for _, _, data, bounds in pieces(batches):
            found = meeting(data, bounds)
            held.append((found.route, found.hash))
            count += len(data)
            if count >= COUNTED_BYTES:
                yield batch_of(heavy, *_heavy(held))
                held, count = [], 0
        if held:
            yield batch_of(heavy, *_heavy(held))

    limit = max(HOT_SEGMENTS, size // HOT_SHARE)
    hot = (narrow.mapInArrow(heavy_grams, "route long, n long").groupBy("route").agg(F.sum("n").alias("n"))
           .where(F.col("n") > limit).select("route").toPandas())  # at most 2^18 of them: bytes / 16 / limit
    hot = spark.sparkContext.broadcast(np.sort(hot["route"].to_numpy(np.int64).view(np.uint64)))

    packed = pa.schema([("shard", pa.int64()), ("blob", pa.binary())])

    def flushes(batches):
        """Segments of a share of the text at a time, combined."""
        held, count = [], 0
        for _, ids, data, bounds in pieces(batches):
            found = singled(meeting(data, bounds), data, hot.value)
            end = found.last + LENGTH
            held.append((found.route, ids[found.text], found.hash, rolling(data, _BASE2).of(found.first, end), _bytes_of(data, found.first, end)))
            count += len(data)
            if count >= FLUSH_BYTES:
                yield _together(held, n_shards)
                count = 0
                give_back()
        if held:
            yield _together(held, n_shards)

    def sent(batches):
        for found in flushes(batches):
            shard = (found.route % np.uint64(n_shards)).astype(np.int64)
            data, ends = _flat(found.bytes)
            cut = np.flatnonzero(np.diff(shard, prepend=-1))
            blobs = [_pack(found.route[a:b], found.doc[a:b], np.diff(ends[a:b + 1]).astype("<u4"), data[ends[a]:ends[b]])
                     for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(shard)])]
            yield batch_of(packed, shard[cut], blobs)

    answer = pa.schema([("bucket", pa.int64()), ("kind", pa.int32()), ("doc_id", pa.int64()), ("text", pa.string()),
                        ("blob", pa.binary())])

    def answered(batches):
        shard, held, told, count = None, [], [], 0
        for batch in batches:
            for own, blob in zip(batch.column("shard").to_pylist(), batch.column("blob").to_pylist()):
                if own != shard:
                    if held:
                        told.append(_answers(_together(held)))
                        count += len(told[-1].doc)
                        if count >= ANSWERED:
                            yield _by_bucket(told, n_buckets, answer)
                            told, count = [], 0
                    shard = own
                route, doc, sizes, data = _unpack(blob, "<u8", "<i8", "<u4", "u1")
                ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
                parts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(data)])
                held.append((route, doc, hashes_of(parts), hashes_of(parts, _BASE2), parts))
        if held:
            told.append(_answers(_together(held)))
        if told:
            yield _by_bucket(told, n_buckets, answer)
        give_back()

    answers = (narrow.mapInArrow(sent, "shard long, blob binary").repartition(F.col("shard")).sortWithinPartitions("shard")
               .mapInArrow(answered, "bucket long, kind int, doc_id long, text string, blob binary"))
    bucket = F.pmod(F.coalesce("doc_id", F.lit(int(_NO_DOC))), F.lit(n_buckets)).alias("bucket")
    texts = narrow.select(bucket, F.lit(1).alias("kind"), "doc_id", "text", F.lit(None).cast("binary").alias("blob"))
    met = answers.union(texts).repartition(F.col("bucket")).sortWithinPartitions("bucket", "kind")

    result = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()),
                        ("n_spans", pa.int64()), ("kept", pa.binary())])

    def reduced(batches):
        at, keys, masks = None, [], []
        table = None
        for batch in batches:
            buckets = batch.column("bucket").to_numpy()
            kinds = batch.column("kind").to_numpy()
            cut = np.flatnonzero(np.concatenate([[True], (buckets[1:] != buckets[:-1]) | (kinds[1:] != kinds[:-1])]))
            for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(buckets)]):
                if buckets[a] != at:
                    give_back()
                    at, keys, masks, table = buckets[a], [], [], None
                part = batch.slice(a, b - a)
                if kinds[a] == 0:
                    for blob in part.column("blob").to_pylist():
                        own, whole, counts, bits = _unpack(blob, "<u8", "?", "<u4", "u1")
                        keys.append((own, whole, counts))
                        masks.append(np.unpackbits(bits, count=int(counts.sum())).astype(bool))
                    continue
                table = table or _table(keys, masks)
                for piece, ids, data, bounds in pieces([part]):
                    yield _reduced(piece, ids, data, bounds, singled(meeting(data, bounds), data, hot.value), table, result)

    return met.mapInArrow(reduced, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def _together(held: list[tuple], n_shards: int = 1) -> Held:
    """What is held as one; the list is empty then."""
    *numbers, parts = (np.concatenate(c) if isinstance(c[0], np.ndarray) else pa.concat_arrays(c) for c in zip(*held))
    held.clear()
    return distinct(*numbers, parts, n_shards)


def _heavy(held: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """Grams that lead many distinct segments, how many."""
    route, own = (np.concatenate(c) for c in zip(*held))
    order = np.lexsort((own, route))
    route, own = route[order], own[order]
    if len(route):
        route = route[np.concatenate([[True], (route[1:] != route[:-1]) | (own[1:] != own[:-1])])]
    route, n = np.unique(route, return_counts=True)
    return route[n >= HOT_IN_FLUSH].view(np.int64), n[n >= HOT_IN_FLUSH]


class Answers(NamedTuple):
    """Of segments that lose less than everything in their smallest document: key,
    number of their strings or 0 if they lose nothing, and the bits of the strings."""

    doc: np.ndarray
    key: np.ndarray
    size: np.ndarray
    bits: np.ndarray


def _answers(held: Held) -> Answers:
    gone, size = removed_strings(held)
    end = np.cumsum(size)
    before = np.concatenate([[0], np.cumsum(gone)])
    lost = before[end] - before[end - size]
    told = np.flatnonzero(lost < size)
    partly = np.where(lost > 0, size, 0)[told]
    return Answers(held.doc[told], _answer_key(held.doc, held.hash)[told], partly, gone[_starts((end - size)[told], partly)])


def _by_bucket(told: list[Answers], n_buckets: int, schema: pa.Schema) -> pa.RecordBatch:
    """The answers in one packet for each bucket of documents."""
    doc, key, size, bits = (np.concatenate(c) for c in zip(*told))
    bucket = doc % n_buckets
    order = np.lexsort((key, bucket))
    bits = bits[_starts((np.cumsum(size) - size)[order], size[order])]
    bucket, key, size = bucket[order], key[order], size[order]
    ends = np.concatenate([[0], np.cumsum(size)])
    cut = np.flatnonzero(np.diff(bucket, prepend=-1))
    blobs = [_pack(key[a:b], size[a:b] == 0, size[a:b][size[a:b] > 0].astype("<u4"), np.packbits(bits[ends[a]:ends[b]]))
             for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(bucket)])]
    n = len(blobs)
    return batch_of(schema, bucket[cut], [0] * n, [None] * n, [None] * n, blobs)


def _table(keys: list[tuple], masks: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """(sorted keys, begin of each key's bits or -1, bits)."""
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool)
    key = np.concatenate([k for k, _, _ in keys])
    whole = np.concatenate([w for _, w, _ in keys])
    counts = np.concatenate([c for _, _, c in keys]).astype(np.int64)
    begin = np.full(len(key), -1, np.int64)
    begin[~whole] = np.concatenate([[0], np.cumsum(counts)[:-1]]) if len(counts) else counts
    order = np.argsort(key)
    return key[order], begin[order], np.concatenate(masks)


def _reduced(batch: pa.RecordBatch, ids: np.ndarray, data: np.ndarray, bounds: np.ndarray, found: Segments, table: tuple,
             schema: pa.Schema) -> pa.RecordBatch:
    keys, begin, bits = table
    key = _answer_key(ids[found.text], found.hash)
    place = np.minimum(np.searchsorted(keys, key), max(len(keys) - 1, 0))
    known = keys[place] == key if len(keys) else np.zeros(len(key), bool)
    # no answer: the segment is in a smaller document as a whole
    first, end = [found.first[~known]], [found.last[~known] + LENGTH]
    partly = known.copy()
    partly[known] = begin[place[known]] >= 0
    size = (found.last - found.first + 1)[partly]
    if len(size):
        inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        gone = bits[np.repeat(begin[place[partly]], size) + inner]
        start = (np.repeat(found.first[partly], size) + inner)[gone]
        first.append(start)
        end.append(start + LENGTH)
    change = (np.bincount(np.concatenate(first), minlength=len(data) + 1)
              - np.bincount(np.concatenate(end), minlength=len(data) + 1))
    gone = np.cumsum(change[:-1]) > 0
    begins = gone.copy()
    begins[1:] &= ~gone[:-1]
    inside = bounds[:-1][np.diff(bounds) > 0]
    begins[inside] = gone[inside]

    def per_text(flags: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(flags)])[bounds])

    lost = per_text(gone)
    kept = data[~gone]
    ends = np.concatenate([[0], np.cumsum(np.diff(bounds) - lost)]).tolist()
    return batch_of(schema, batch.column("doc_id"), np.diff(bounds), lost, per_text(begins),
                    [kept[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])])
