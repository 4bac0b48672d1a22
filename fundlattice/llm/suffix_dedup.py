"""Suffix-array dedup: bytes covered by long strings that a document with a smaller id has too."""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table, text_portions
from .packed import bucket_bits, cuts, pack, pack_keys, planned_bytes, unpack, unpack_keys
from .shingle_join import mix, series

LENGTH = 50
#: Bytes of the texts of a portion, of a piece of them that is hashed at once, and of input for each bucket; the fewest buckets.
PORTION, PIECE, BUCKET_BYTES, LEAST_BUCKETS = 8_000_000, 1_000_000, 1_000_000, 16
#: Anchors whose surroundings are compared at once.
SLICE = 20_000
#: Suffixes that are sorted at once; a key with more is sorted alone.
SORTED = 200_000
#: An anchor with more surroundings than this (summed over portions) is dealt out by each of its strings.
SPLIT = 2_000
_U = np.uint64
_MOST = _U(2**64 - 1)
_BASE = _U(0x9E3779B97F4A7C15)
CELLS = ["portion", "bucket", "kind", "packed"]
CELL = "portion long, bucket long, kind int, packed binary"
OWN, ASKED = 0, 1


@functools.cache
def _values() -> np.ndarray:
    return series(256, 7)


@functools.cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base, and of its inverse, modulo 2^64."""
    base, inverse = int(_BASE), pow(int(_BASE), -1, 2**64)
    out = []
    for b in (base, inverse):
        p, done = np.ones(n, np.uint64), 1
        while done < n:
            more = min(done, n - done)
            p[done : done + more] = p[:more] * _U(pow(b, done, 2**64))
            done += more
        out.append(p)
    return out[0], out[1]


class PrefixHashes:
    """Polynomial hashes of all prefixes of some bytes: any substring's hash in constant time."""

    def __init__(self, flat: np.ndarray):
        powers, self.inverse = _powers(1 << max(12, len(flat).bit_length()))
        self.sums = np.zeros(len(flat) + 1, np.uint64)
        np.cumsum(_values()[flat] * powers[: len(flat)], out=self.sums[1:])

    def of(self, start: np.ndarray, size) -> np.ndarray:
        """Hash of the `size` bytes from each start."""
        return (self.sums[start + size] - self.sums[start]) * self.inverse[start]

    def each(self, size: int) -> np.ndarray:
        """Hash of the `size` bytes from every place that has so many."""
        out = self.sums[size:] - self.sums[: len(self.sums) - size]
        out *= self.inverse[: len(out)]
        return out


def _sliding(x: np.ndarray, w: int, pick, ahead: bool) -> np.ndarray:
    """The least or largest (pick) of each element and the w - 1 after it (ahead) or before it."""
    now, span = x.copy(), 1
    while span < w:
        step = min(span, w - span)
        a, b = (now[: len(now) - step], now[step:]) if ahead else (now[step:], now[: len(now) - step])
        pick(a, b, out=a)  # numpy sees that they overlap
        span += step
    return now


def seed_length(length: int) -> int:
    """Bytes of an anchor: a string of `length` bytes holds at most 62 of them."""
    return max(1, length // 2 - 1, length - 61)


def anchors(flat: np.ndarray, sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, key) of the anchors of texts that lie one after the other: every string of `length` bytes in a text has one.

    A string's anchor is the part of seed_length bytes whose hash is least, so that equal strings have equal anchors at equal
    places; in the mean there is one in a quarter of `length` bytes.
    """
    m = seed_length(length)
    w = length - m + 1
    if len(flat) < length:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    h = np.full(len(flat), _MOST, np.uint64)
    h[: len(flat) - m + 1] = mix(PrefixHashes(flat).each(m)) | _U(1)
    ends = np.cumsum(sizes)

    def last(n: int) -> np.ndarray:
        """The places of the last n bytes of each text, or of all it has."""
        at = ends[:, None] - 1 - np.arange(n)
        return at[at >= (ends - sizes)[:, None]]

    h[last(m - 1)] = _MOST  # no anchor reaches into the next text
    least = _sliding(h, w, np.minimum, True)
    least[last(length - 1)] = 0  # nor does a string
    found = _sliding(least, w, np.maximum, False) == h
    found[last(m - 1)] = False
    place = np.flatnonzero(found)
    return place, h[place]


def portion_anchors(texts: list[bytes], length: int):
    """(place in the portion's bytes, key) of the anchors of all texts; long texts in overlapping pieces."""
    found, at = [], 0
    held, sizes, begin = [], [], 0

    def flush():
        if held:
            place, key = anchors(np.frombuffer(b"".join(held), np.uint8), np.array(sizes, np.int64), length)
            found.append((place + begin, key))

    for t in texts:
        for lo in range(0, max(1, len(t)), PIECE):
            part = t[lo : lo + PIECE + length - 1]
            if len(t) > PIECE or sum(sizes) + len(part) > PIECE:
                flush()
                held, sizes, begin = [], [], at + lo
            held.append(part)
            sizes.append(len(part))
        if len(t) > PIECE:
            flush()
            held, sizes, begin = [], [], at + len(t)
        at += len(t)
    flush()
    place, key = (np.concatenate([f[k] for f in found]) if found else np.empty(0, (np.int64, np.uint64)[k]) for k in (0, 1))
    place, first = np.unique(place, return_index=True)
    return place, key[first]


def shut(*arrays) -> bytes:
    """Arrays, packed and compressed together."""
    raw = [np.ascontiguousarray(a).tobytes() for a in arrays]
    return zstandard.ZstdCompressor(3).compress(np.array([len(raw), *map(len, raw)], "<i8").tobytes() + b"".join(raw))


def opened(packed: bytes, *kinds) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(packed)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    ends = np.cumsum(np.r_[8 * (n + 1), np.frombuffer(raw, "<i8", n, 8)]).tolist()
    return [np.frombuffer(raw[i:j], k) for i, j, k in zip(ends, ends[1:], kinds)]


def unique_rows(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first of each distinct row, number of the distinct row for each row)."""
    if not len(rows):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    whole = np.ascontiguousarray(rows).view(np.dtype((np.void, rows.shape[1]))).ravel()
    _, first, which = np.unique(whole, return_index=True, return_inverse=True)
    return first, which


def surroundings(flat: np.ndarray, bounds: np.ndarray, owner: np.ndarray, place: np.ndarray, length: int) -> np.ndarray:
    """For each anchor a row of bytes: how many bytes lie before and after it, at most length - seed_length, then the bytes; 0 beyond its text."""
    m = seed_length(length)
    side = length - m
    before = np.minimum(place - bounds[owner], side)
    after = np.minimum(bounds[owner + 1] - place - m, side)
    steps = np.arange(-side, m + side)
    at = place[:, None] + steps
    inside = (steps >= -before[:, None]) & (steps < m + after[:, None])
    rows = np.where(inside, flat[np.clip(at, 0, len(flat) - 1)], 0).astype(np.uint8)
    return np.concatenate([before[:, None].astype(np.uint8), after[:, None].astype(np.uint8), rows], axis=1)


def strings_of(before: np.ndarray, after: np.ndarray, length: int) -> np.ndarray:
    """Bits of the strings around an anchor: bit i stands for the one that begins i bytes before it."""
    side = length - seed_length(length)
    i = np.arange(side + 1)
    fits = (i <= before[:, None]) & (side - i <= after[:, None])
    return (fits.astype(np.uint64) << i.astype(np.uint64)).sum(axis=1, dtype=np.uint64)


class Suffixes:
    """Suffixes of rows of bytes, told apart in their first `length` bytes."""

    def __init__(self, flat: np.ndarray, starts: np.ndarray, length: int):
        self.flat, self.starts, self.length, self.hashes = flat, starts, length, PrefixHashes(flat)

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the common prefix of suffixes x and y, at most `length`, by binary search over the prefixes' hashes."""
        a, b = self.starts[x], self.starts[y]
        known, step = np.zeros(len(a), np.int64), 1 << self.length.bit_length()
        while step:
            more = known + step
            fits = more <= self.length
            more = np.where(fits, more, 0)
            same = fits & (self.hashes.of(a, more) == self.hashes.of(b, more))
            known = np.where(same, more, known)
            step >>= 1
        return known

    def less(self, x: np.ndarray, y: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        """Whether x comes before y, or, where or_equal says so, is equal to it."""
        n = self.common(x, y)
        at = np.minimum(n, self.length - 1)
        return np.where(n == self.length, or_equal, self.flat[self.starts[x] + at] < self.flat[self.starts[y] + at])

    def sort(self, group: np.ndarray) -> np.ndarray:
        """The suffixes' order within groups (ascending numbers, equal ones together): a mergesort, all runs of a width at once.

        A suffix's place in two merged runs is its place in its own and its rank in the other, by binary search.
        """
        order = np.arange(len(group))
        begins = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.empty(0, np.int64)
        sizes = np.diff(np.r_[begins, len(group)])
        begin, size = np.repeat(begins, sizes), np.repeat(sizes, sizes)
        width = 1
        while width < sizes.max(initial=0):
            moved = np.flatnonzero(size > width)
            rank = moved - begin[moved]
            run = rank // width
            end = begin[moved] + size[moved]
            low = np.minimum(begin[moved] + (run ^ 1) * width, end)
            other, high = low.copy(), np.minimum(low + width, end)
            x, right = order[moved], (run & 1).astype(bool)
            open_ = np.flatnonzero(low < high)
            while len(open_):
                mid = (low[open_] + high[open_]) // 2
                goes = self.less(order[mid], x[open_], right[open_])  # equal ones of the left run come first
                low[open_], high[open_] = np.where(goes, mid + 1, low[open_]), np.where(goes, high[open_], mid)
                open_ = open_[low[open_] < high[open_]]
            target = begin[moved] + (run & ~1) * width + (rank - run * width) + (low - other)
            after = order.copy()
            after[target] = x
            order, width = after, 2 * width
        return order

    def classes(self, group: np.ndarray) -> np.ndarray:
        """A number for each suffix, equal for those of a group that agree in `length` bytes.

        Neighbours in sorted order whose hashes agree are compared byte by byte; were any two different, all would be sorted by bytes.
        """
        order = self.sort(group)
        x, y = order[:-1], order[1:]
        same = (group[x] == group[y]) & (self.common(x, y) == self.length)
        for lo in range(0, len(x), SLICE):
            k = np.flatnonzero(same[lo : lo + SLICE]) + lo
            steps = np.arange(self.length)
            if (self.flat[self.starts[x[k]][:, None] + steps] != self.flat[self.starts[y[k]][:, None] + steps]).any():
                rows = self.flat[self.starts[:, None] + steps]
                return unique_rows(np.concatenate([group.astype(np.int64)[:, None].view(np.uint8).reshape(-1, 8), rows], axis=1))[1]
        out = np.empty(len(order), np.int64)
        out[order] = np.cumsum(np.r_[0, ~same])[: len(order)]
        return out


def least_holders(keys: np.ndarray, rows: np.ndarray, ids: np.ndarray, length: int) -> np.ndarray:
    """For each row of surroundings the bits of its strings that some row of the same key with a smaller id holds too."""
    m = seed_length(length)
    side = length - m
    first, which = unique_rows(np.concatenate([keys[:, None].view(np.uint8).reshape(-1, 8), rows], axis=1))
    least = np.full(len(first), np.iinfo(np.int64).max)
    np.minimum.at(least, which, ids)
    kinds, kind_keys = rows[first], keys[first]
    every = strings_of(kinds[:, 0].astype(np.int64), kinds[:, 1].astype(np.int64), length)
    out = np.where(least[which] < ids, every[which], _U(0))
    _, of_key, n = np.unique(kind_keys, return_inverse=True, return_counts=True)
    several = np.flatnonzero(n[of_key] > 1)
    if not len(several):
        return out
    bit = np.arange(side + 1)
    other = np.full((len(several), side + 1), np.iinfo(np.int64).max)  # the least holder of each string
    several = several[np.argsort(of_key[several], kind="stable")]
    edges = np.r_[0, np.flatnonzero(np.diff(of_key[several])) + 1, len(several)]  # of keys
    lo = 0
    while lo < len(edges) - 1:  # some keys at a time
        hi = max(lo + 1, int(np.searchsorted(edges, edges[lo] + SORTED // (side + 1), side="right")) - 1)
        at = slice(edges[lo], edges[hi])
        own = several[at]
        kind, i = np.nonzero((every[own][:, None] >> bit.astype(np.uint64)) & _U(1))
        group = of_key[own][kind] * (side + 1) + i
        order = np.argsort(group, kind="stable")
        kind, i, group = kind[order], i[order], group[order]
        found = Suffixes(np.ascontiguousarray(kinds[own][:, 2:]).ravel(), kind * (m + 2 * side) + side - i, length).classes(group)
        holder = np.full(int(found.max(initial=-1)) + 1, np.iinfo(np.int64).max)
        np.minimum.at(holder, found, least[own[kind]])
        other[at][kind, i] = holder[found]
        lo = hi
    place = np.zeros(len(first), np.int64)
    place[several] = np.arange(len(several))
    many = np.flatnonzero(np.isin(which, several))
    for lo in range(0, len(many), SLICE):
        k = many[lo : lo + SLICE]
        bits = (other[place[which[k]]] < ids[k][:, None]).astype(np.uint64) << bit.astype(np.uint64)
        out[k] |= bits.sum(axis=1, dtype=np.uint64)
    return out


def cell_batch(portion, cells: list[tuple]) -> dict:
    bucket, kind, packed = zip(*cells) if cells else ((), (), ())
    return {"portion": pa.array([portion] * len(cells), pa.int64()), "bucket": pa.array(bucket, pa.int64()), "kind": pa.array(kind, pa.int32()), "packed": pa.array(packed, pa.binary())}


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, with_kept: bool = True) -> DataFrame:
    """id_col, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 and, with with_kept, kept (bytes) of every row.

    A byte goes if it lies in a string of `length` bytes that also starts in a row with a smaller id. Strings are judged on
    the texts as they come, in UTF-8, and never cross texts.

    1. Texts are stored in compressed portions. Every string has an anchor (see anchors); a portion sends the distinct keys of its
    anchors to buckets of the hash space, which answer which ones other documents have. 2. For those only, a portion sends each
    distinct surrounding (the anchor and all strings that hold it) with the smallest id that has it. A bucket collapses equal
    surroundings, sorts the suffixes of the others of each key by prefix hashes, and answers which strings a
    smaller id holds. 3. The portion's texts lose what these cover. A key with more than SPLIT surroundings, such as the edge of a
    passage that goes on differently in many documents, is dealt out by each of its strings, whose hash is then the key.

    A text without `length` bytes (null, empty) loses nothing. Rows with one id don't take from each other; a null id counts as
    larger than all. A very long text is a portion by itself, in one task's memory. An empty table gives none. id_col is an integer;
    only it and text_col are read, so other columns' names don't matter.
    """
    m, scratch = seed_length(length), Scratch()
    side = length - m
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    size = planned_bytes(rows, "text")
    bits = bucket_bits(size, BUCKET_BYTES, LEAST_BUCKETS)
    shift = _U(64 - min(64, max(1, size).bit_length() + 16))
    split = SPLIT

    def deal(batches):
        context, ids, texts, total, portion = TaskContext.get(), [], [], 0, 0
        first = (context.partitionId() if context else 0) << 32

        def flush():
            sizes = np.array([len(t) for t in texts], np.int64)
            packed = zstandard.ZstdCompressor(3).compress(sizes.tobytes() + b"".join(texts))
            return pa.RecordBatch.from_pydict({"portion": pa.array([first + portion], pa.int64()), "ids": pa.array([ids], pa.list_(pa.int64())), "packed": [packed]})

        for part, some in text_portions(batches, 1, PIECE, raw=True):
            for i, t in zip(part.column(0).to_pylist(), some):
                if texts and total + len(t) > PORTION:
                    yield flush()
                    ids, texts, total, portion = [], [], 0, portion + 1
                ids.append(i)
                texts.append(t)
                total += len(t)
        if texts:
            yield flush()

    def texts_of(ids, packed):
        """(ids as numbers, texts) of a portion's row."""
        raw = zstandard.ZstdDecompressor().decompress(packed)
        ends = np.cumsum(np.r_[8 * len(ids), np.frombuffer(raw, np.int64, len(ids))]).tolist()
        return np.array([np.iinfo(np.int64).max if i is None else i for i in ids], np.int64), [raw[i:j] for i, j in zip(ends, ends[1:])]

    def keyed(texts):
        """(the portion's bytes, bounds of its texts, anchors' places, keys)."""
        place, key = portion_anchors(texts, length)
        return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0] + [len(t) for t in texts]), place, key >> shift << shift

    def ask(batches):
        for batch in batches:
            for portion, ids, packed in zip(*(c.to_pylist() for c in batch.columns)):
                ids, texts = texts_of(ids, packed)
                flat, bounds, place, key = keyed(texts)
                owner = np.searchsorted(bounds, place, side="right") - 1
                begin, end = np.maximum(place - side, bounds[owner]), np.minimum(place + m + side, bounds[owner + 1])
                seen = np.empty(len(place), np.uint64)
                for lo in range(0, len(place), SLICE):  # names of surroundings; they only count
                    k = slice(lo, lo + SLICE)
                    at = begin[k].min()
                    seen[k] = PrefixHashes(flat[at : end[k].max()]).of(begin[k] - at, end[k] - begin[k])
                order = np.lexsort((seen, key))
                key, seen, who = key[order], seen[order], ids[owner[order]]
                edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
                keys, fresh = key[edge], np.r_[True, (key[1:] != key[:-1]) | (seen[1:] != seen[:-1])][: len(key)]
                kinds = np.add.reduceat(fresh.astype(np.int64), edge) if len(edge) else edge
                both = np.minimum.reduceat(who, edge) < np.maximum.reduceat(who, edge) if len(edge) else edge.astype(bool)
                cells = [(n, ASKED, shut(np.frombuffer(pack_keys(keys[i:j] >> shift), np.uint8), np.frombuffer(pack(kinds[i:j] << 1 | both[i:j]), np.uint8))) for n, i, j in cuts(keys, bits)]
                yield pa.RecordBatch.from_pydict(cell_batch(portion, cells))

    def answer(key, group):
        asked = [(unpack_keys(k.tobytes()), unpack(c.tobytes())) for k, c in (opened(x, np.uint8, np.uint8) for x in group["packed"].to_pylist())]
        keys, at = np.unique(np.concatenate([k for k, _ in asked]), return_inverse=True)
        kinds, both = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        edges = np.cumsum([0] + [len(k) for k, _ in asked]).tolist()
        for (_, c), i, j in zip(asked, edges, edges[1:]):
            kinds[at[i:j]] += c >> 1
            both[at[i:j]] += 1 + (c & 1)
        state = ((both > 1).astype(np.uint8) * np.where(kinds > split, 2, 1)).astype(np.uint8)
        return pa.table([group["portion"], group["bucket"], group["kind"], pa.array([shut(state[at[i:j]]) for i, j in zip(edges, edges[1:])], pa.binary())], CELLS)

    def emit(portion, answers):
        number, ids, packed = (portion[c][0].as_py() for c in ("dealt", "ids", "packed"))
        ids, texts = texts_of(ids, packed)
        flat, bounds, place, key = keyed(texts)
        order = np.argsort(answers["bucket"].to_numpy())
        states = np.concatenate([np.empty(0, np.uint8), *(opened(answers["packed"][int(k)].as_py(), np.uint8)[0] for k in order)])
        keys = np.unique(key)
        assert len(keys) == len(states)
        state = states[np.searchsorted(keys, key)] if len(keys) else np.empty(0, np.uint8)
        key, place, state = key[state > 0], place[state > 0], state[state > 0]
        owner = np.searchsorted(bounds, place, side="right") - 1
        own, kinds = [], []  # (owner, place, number of its surrounding); (key, surrounding)
        total = 0
        for lo in range(0, len(place), SLICE):
            k = slice(lo, lo + SLICE)
            around = surroundings(flat, bounds, owner[k], place[k], length)
            first, which = unique_rows(around)
            hot = state[k][first] == 2
            plain = ~hot[which]
            kinds.append((key[k][first], around[first]))
            own.append((owner[k][plain], place[k][plain], which[plain] + total))
            total += len(first)
            if hot.any():  # each string of such an anchor stands for itself
                at = np.flatnonzero(~plain)
                fits = strings_of(around[at, 0].astype(np.int64), around[at, 1].astype(np.int64), length)
                for lo2 in range(0, len(at), SLICE // 32):
                    a, i = np.nonzero((fits[lo2 : lo2 + SLICE // 32, None] >> np.arange(side + 1, dtype=np.uint64)) & _U(1))
                    begin, of = place[k][at[lo2 : lo2 + SLICE // 32][a]] - i, owner[k][at[lo2 : lo2 + SLICE // 32][a]]
                    alone = np.zeros((len(begin), 2 + m + 2 * side), np.uint8)
                    alone[:, 1] = side
                    alone[:, 2 + side :] = flat[begin[:, None] + np.arange(length)]
                    first, which = unique_rows(alone)
                    name = mix(PrefixHashes(alone[first, 2 + side :].ravel()).of(np.arange(len(first)) * length, length)) >> shift << shift
                    kinds.append((name, alone[first]))
                    own.append((of, begin, which + total))
                    total += len(first)
        names = np.concatenate([np.empty(0, np.uint64), *(n for n, _ in kinds)])
        around = np.concatenate([np.empty((0, 2 + m + 2 * side), np.uint8), *(r for _, r in kinds)])
        of, place, kind = (np.concatenate([np.empty(0, np.int64), *(o[k] for o in own)]) for k in (0, 1, 2))
        used = np.unique(kind)  # surroundings of anchors that were dealt out by their strings aren't
        first, which = unique_rows(np.concatenate([names[used][:, None].view(np.uint8).reshape(-1, 8), around[used]], axis=1))
        names, around, kind = names[used][first], around[used][first], which[np.searchsorted(used, kind)]
        order = np.argsort(names, kind="stable")
        names, around = names[order], around[order]
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        kind = back[kind]
        least = np.full(len(names), np.iinfo(np.int64).max)
        np.minimum.at(least, kind, ids[of])
        every = strings_of(around[:, 0].astype(np.int64), around[:, 1].astype(np.int64), length)
        by_place = np.argsort(place, kind="stable")
        cells = [(-1 - number, OWN, shut(of[by_place], place[by_place], kind[by_place], least, every))]
        cells += [(n, ASKED, shut(names[i:j], around[i:j], least[i:j])) for n, i, j in cuts(names, bits)]
        return pa.table(cell_batch(number, cells))

    def resolve(key, group):
        if key[0].as_py() < 0:
            return group
        asked = [opened(x, np.uint64, np.uint8, np.int64) for x in group["packed"].to_pylist()]
        found = least_holders(np.concatenate([a[0] for a in asked]), np.concatenate([a[1].reshape(-1, 2 + m + 2 * side) for a in asked]), np.concatenate([a[2] for a in asked]), length)
        edges = np.cumsum([0] + [len(a[0]) for a in asked]).tolist()
        return pa.table([group["portion"], group["bucket"], group["kind"], pa.array([shut(found[i:j]) for i, j in zip(edges, edges[1:])], pa.binary())], CELLS)

    def finish(portion, answers):
        raw_ids, packed = portion["ids"][0].as_py(), portion["packed"][0].as_py()
        ids, texts = texts_of(raw_ids, packed)
        bucket, raw = answers["bucket"].to_numpy(), answers["packed"]
        order = [int(k) for k in np.argsort(bucket)]
        of, place, kind, least, every = opened(raw[order[0]].as_py(), np.int64, np.int64, np.int64, np.int64, np.uint64)
        held = np.concatenate([np.empty(0, np.uint64), *(opened(raw[k].as_py(), np.uint64)[0] for k in order[1:])])
        assert bucket[order[0]] < 0 and len(held) == len(least)
        gone = np.where(least[kind] < ids[of], every[kind], held[kind])
        begins = np.cumsum([0] + [len(t) for t in texts])
        edges = np.searchsorted(of, np.arange(len(texts) + 1))
        out = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": [], "kept": []}
        for t, text in enumerate(texts):
            own = slice(edges[t], edges[t + 1])
            kept = text
            n_spans = 0
            if gone[own].any():
                starts = np.zeros(len(text), bool)
                for i in range(side + 1):
                    starts[place[own][(gone[own] >> _U(i) & _U(1)) > 0] - i - begins[t]] = True
                removed = _sliding(starts, length, np.logical_or, False)
                n_spans = int(removed[0]) + int(np.count_nonzero(removed[1:] & ~removed[:-1]))
                kept = np.frombuffer(text, np.uint8)[~removed].tobytes()
            for c, v in zip(out, (len(text), len(text) - len(kept), n_spans, hashlib.sha256(kept).hexdigest(), kept)):
                out[c].append(v)
        numbers = {c: pa.array(out[c], pa.int64()) for c in ("n_bytes", "n_removed", "n_spans")}
        return pa.table({"id": pa.array(raw_ids, pa.int64()), **numbers, "kept_sha256": pa.array(out["kept_sha256"]), **({"kept": pa.array(out["kept"], pa.binary())} if with_kept else {})})

    portions = scratch.keep(rows.mapInArrow(deal, "portion long, ids array<long>, packed binary"), "portions")
    asked = portions.mapInArrow(ask, CELL)
    answers = asked.groupBy("bucket").applyInArrow(answer, CELL)
    texts = portions.select(F.col("portion").alias("dealt"), "ids", "packed")
    emitted = texts.groupBy("dealt").cogroup(answers.groupBy("portion")).applyInArrow(emit, CELL)
    resolved = emitted.groupBy("bucket").applyInArrow(resolve, CELL)
    schema = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_kept else "")
    out = texts.groupBy("dealt").cogroup(resolved.groupBy("portion")).applyInArrow(finish, schema)
    return scratch.end(out, "repeats").withColumn("id", F.col("id").cast(docs.schema[id_col].dataType)).withColumnRenamed("id", id_col)


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), with_kept=False)
