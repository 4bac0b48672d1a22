"""N-gram Jaccard join: size-banded tiles, bitmap bounds, exact intersections."""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, join_frequent, table, text_portions
from .graph import components
from .packed import bucket_bits, cuts, pack, pack_keys, planned_bytes, unpack, unpack_keys

#: Bits of a set's bitmap.
BITS = 2_048
#: Members of a tile that one task compares with as many others.
BLOCK = 1_024
#: Bytes of input for each bucket of members, and the fewest buckets.
BUCKET_BYTES, LEAST_BUCKETS = 1_000_000, 64
#: Further hubs of a tile before its members are compared with each other, and the growth of pairs tried by then.
MORE_HUBS, MORE_PAIRS = 1, 8
#: Bytes of texts that are hashed at once, and members that a task holds before it passes them on.
PORTION, HELD_MEMBERS = 300_000, 300_000
#: Pairs of a tile that a task adds before it keeps the closest.
HELD_PAIRS = 100_000
#: A member that more sets of a portion have is sent once, with their number (at least 1, as what is counted is shared).
SENT_APART = 8
#: Kinds of packed rows: a portion's sets and its frequent members; members with the sets that have them, or with their number.
SETS, HOT, MEMBERS, COUNTED = range(4)
PACKED_NAMES = ["portion", "bucket", "kind", "keys", "owners", "counts"]
PACKED = "portion long, bucket long, kind int, keys binary, owners binary, counts binary"
#: Rows that may be broadcast (of two numbers each).
BROADCAST_IDS = 500_000

_SPACES = np.zeros(256, bool)
_SPACES[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of x reaches every bit of the result."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def series(n: int, salt: int) -> np.ndarray:
    """n numbers that look random, the same each time."""
    return mix((np.arange(1, n + 1, dtype=np.uint64) + _U(salt) * _U(0x9E3779B9)) * _U(0x9E3779B97F4A7C15))


@functools.cache
def _byte_numbers() -> np.ndarray:
    return series(256, 1)


@functools.cache
def _place_numbers(n: int) -> np.ndarray:
    return series(n, 2) | _U(1)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(index of its text, 64-bit hash) of each word; A-Z are lowered, words are split at ASCII white space."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    flat = _LOWER[np.frombuffer(b"\n" + b"\n".join(raw) + b"\n", np.uint8)]
    inside = ~_SPACES[flat]
    edge = np.diff(inside.astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
    if not len(starts):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    sizes = ends - starts
    at = np.flatnonzero(inside)
    firsts = np.cumsum(sizes) - sizes
    place = np.arange(len(at)) - np.repeat(firsts, sizes)
    longest = int(sizes.max())
    values = _byte_numbers()[flat[at]] * _place_numbers(1 << max(6, longest.bit_length()))[place]
    words = mix(np.add.reduceat(values, firsts) + sizes.astype(np.uint64))
    begins = np.cumsum([0] + [len(r) + 1 for r in raw])[:-1] + 1
    return np.searchsorted(begins, starts, side="right") - 1, words


def shingle_sets(texts: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of its text, hash) of each distinct shingle of k words, sorted by both.

    A text of fewer words has them all as its one shingle; a text without words has none.
    """
    text, word = word_hashes(texts)
    counts = np.bincount(text, minlength=len(texts)) if len(texts) else np.empty(0, np.int64)
    full = np.flatnonzero(text[: len(text) - k + 1] == text[k - 1 :]) if len(text) >= k else np.empty(0, np.int64)
    value = np.full(len(full), k, np.uint64)
    for j in range(k):
        value = mix(value * _U(0x9E3779B97F4A7C15) + word[full + j])
    short = np.flatnonzero((counts > 0) & (counts < k))
    firsts = np.cumsum(counts) - counts
    few = []
    for i in short.tolist():
        x = np.array([counts[i]], np.uint64)
        for w in word[firsts[i] : firsts[i] + counts[i]]:
            x = mix(x * _U(0x9E3779B97F4A7C15) + w)
        few.append(x[0])
    owner, value = np.r_[text[full], short], np.r_[value, np.array(few, np.uint64)]
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    first = np.ones(len(owner), bool)
    first[1:] = (np.diff(owner) != 0) | (value[1:] != value[:-1])
    return owner[first], value[first]


def set_names(owner: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums for each of n sets: equal for equal sets, and otherwise different but for chance."""
    out = []
    for salt in (3, 4):
        total = np.zeros(n, np.uint64)
        if len(owner):
            firsts = np.flatnonzero(np.r_[True, np.diff(owner) != 0])
            total[owner[firsts]] = np.add.reduceat(mix(value ^ series(1, salt)[0]), firsts)
        out.append(total.view(np.int64))
    return out[0], out[1]


def bitmaps(owner: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """A bitmap for each of n sets: each member flips the bit of its hash.

    Two sets' bitmaps differ in at most as many bits as the sets have members that the other lacks.
    """
    bit = (mix(value ^ series(1, 5)[0]) >> _U(64 - (BITS - 1).bit_length())).astype(np.int64)
    flips = np.bincount(owner * BITS + bit, minlength=n * BITS).reshape(n, BITS)
    return np.packbits((flips & 1).astype(np.uint8), axis=1)


def band_bounds(percent: int, largest: int) -> np.ndarray:
    """Sizes at which size bands begin: a set's partners lie in its band or the next ones beside it."""
    bounds = [1]
    while bounds[-1] <= largest:
        bounds.append(max(bounds[-1] + 1, -(-bounds[-1] * 100 // percent)))
    return np.array(bounds, np.int64)


def prefix_length(sizes: np.ndarray, percent: int) -> np.ndarray:
    """How many of a set's first members, in an order that all sets share, surely hold one of a linked set's first.

    Linked sets have at least ceil(percent * size / 100) members in common, whichever of the two sizes is taken.
    """
    return sizes - -(-sizes * percent // 100) + 1


def tile_keys(owner: np.ndarray, value: np.ndarray, count: np.ndarray, sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the set, tile key) for the rarest members of each set that other sets have too.

    owner, value, count: the set, the hash and the number of sets of each member that more than one set has. Members
    are ordered by that number, then by hash. Those that no other set has come first and give no key; of the
    others a set gives as many as its prefix has left (see prefix_length), so linked sets share a key. A key stands for a
    member and a size band; each set gives keys in its own band and the next.
    """
    order = np.lexsort((value, count, owner))
    owner, value = owner[order], value[order]
    shared = np.bincount(owner, minlength=len(sizes))
    left = prefix_length(sizes, percent) - (sizes - shared)
    rank = np.arange(len(owner)) - (np.cumsum(shared) - shared)[owner]
    chosen = rank < left[owner]
    owner, value = owner[chosen], value[chosen]
    home = np.searchsorted(band_bounds(percent, int(sizes.max(initial=1))), sizes[owner], side="right").astype(np.uint64)
    return np.r_[owner, owner], np.r_[mix(value + mix(home)), mix(value + mix(home + _U(1)))]


def bounded(n_a, n_b, differing, percent: int):
    """Whether the bitmaps leave it open that two sets link: differing bits bound the intersection from above."""
    most = (n_a + n_b - differing) // 2
    return 100 * most >= percent * (n_a + n_b - most)


def features(rows: DataFrame, k: int) -> DataFrame:
    """id, n (shingles), h1 and h2 (the set's names), bits (its bitmap) of each row, and its third column as it is."""

    names = ["id", "n", "h1", "h2", "bits"] + rows.columns[2:]

    def run(batches):
        for part, texts in text_portions(batches, 1, PORTION):
            owner, value = shingle_sets(texts, k)
            h1, h2 = set_names(owner, value, len(texts))
            maps = bitmaps(owner, value, len(texts))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.bincount(owner, minlength=len(texts))), pa.array(h1), pa.array(h2), pa.array([m.tobytes() for m in maps], pa.binary()), *part.columns[2:]], names)

    return rows.mapInArrow(run, "id long, n long, h1 long, h2 long, bits binary" + "".join(f", {c} long" for c in names[5:]))


def shared_keys(rows: DataFrame, k: int, percent: int, bits: int, key_bits: int = 64) -> DataFrame:
    """(key, member: a set's h1) of each set's tile keys; repeated where copies of a set lie in several portions.

    1. A task packs the members of some sets, a portion, by bucket of the hash space: key_bits leading bits of each, since
    two members that look equal by these only meet without need. A member that many sets of the portion have is
    sent once, with their number; which sets these are goes into the portion's own rows. 2. A bucket counts the sets of each member and answers with those that more than one set has. 3. The
    answers meet the portion's own rows and give the keys. Members that only one set has never come back.
    """

    shift = _U(64 - key_bits)
    keys_of = lambda keys: pack_keys(keys >> shift)
    opened = lambda raw: unpack_keys(raw) << shift

    def batch(portion: int, cells: list[tuple]) -> pa.RecordBatch:
        """Rows (bucket, kind, keys, owners, counts) of a portion."""
        bucket, kind, *packed = zip(*cells)
        return pa.RecordBatch.from_arrays([pa.array([portion] * len(cells), pa.int64()), pa.array(bucket, pa.int64()), pa.array(kind, pa.int32()), *(pa.array(x, pa.binary()) for x in packed)], PACKED_NAMES)

    def ask(batches):
        context = TaskContext.get()
        first = (context.partitionId() if context else 0) << 32
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        total = done = 0

        def flush():
            names = np.concatenate([h for h, _, _ in held])
            begin = np.cumsum([0] + [len(h) for h, _, _ in held])
            owner, value = np.concatenate([o + at for (_, o, _), at in zip(held, begin)]), np.concatenate([v for _, _, v in held])
            sizes = np.bincount(owner, minlength=len(names))
            one = np.zeros(len(names), bool)
            one[np.unique(names, return_index=True)[1]] = True  # of equal sets one
            owner, value = owner[one[owner]], value[one[owner]] >> shift << shift
            order = np.argsort(value, kind="stable")
            owner, value = owner[order], value[order]
            begins = np.flatnonzero(np.r_[True, value[1:] != value[:-1]])
            times = np.diff(np.r_[begins, len(value)])
            hot, hot_times, often = value[begins[times > SENT_APART]], times[times > SENT_APART], np.repeat(times > SENT_APART, times)
            few, few_owners = value[~often], owner[~often]
            own = -1 - first - done
            cells = [(own, SETS, pack(names), b"", pack(sizes)), (own, HOT, keys_of(hot), pack(owner[often]), pack(hot_times))]
            cells += [(n, MEMBERS, keys_of(few[i:j]), pack(few_owners[i:j]), b"") for n, i, j in cuts(few, bits)]
            cells += [(n, COUNTED, keys_of(hot[i:j]), b"", pack(hot_times[i:j])) for n, i, j in cuts(hot, bits)]
            return batch(first + done, cells)

        for _, texts in text_portions(batches, 1, PORTION):
            owner, value = shingle_sets(texts, k)
            held.append((set_names(owner, value, len(texts))[0], owner, value))
            total += len(value)
            if total > HELD_MEMBERS:
                yield flush()
                held, total, done = [], 0, done + 1
        if total:
            yield flush()

    def answer(key, group):
        if key[0].as_py() < 0:  # a portion's own rows
            return group
        asked = [(opened(x), unpack(c) if c else None) for x, c in zip(group["keys"].to_pylist(), group["counts"].to_pylist())]
        found, at = np.unique(np.concatenate([x for x, _ in asked]), return_inverse=True)
        sets = np.bincount(at, weights=np.concatenate([np.ones(len(x)) if c is None else c for x, c in asked])).astype(np.int64)
        edges = np.cumsum([0] + [len(x) for x, _ in asked]).tolist()
        cells = []
        for (keys, c), owners, i, j in zip(asked, group["owners"].to_pylist(), edges, edges[1:]):
            n = sets[at[i:j]]
            many = n > 1
            cells.append((keys_of(keys[many]), pack(unpack(owners)[many]) if c is None else b"", pack(n[many])))
        return pa.table([group["portion"], group["bucket"], group["kind"], *(pa.array(x, pa.binary()) for x in zip(*cells))], PACKED_NAMES)

    def choose(key, group):
        parts: dict[int, list[tuple]] = {kind: [] for kind in (SETS, HOT, MEMBERS, COUNTED)}
        for _, kind, *packed in sorted(zip(*(group[c].to_pylist() for c in PACKED_NAMES[1:])), key=lambda r: r[:2]):
            parts[kind].append(packed)
        (names, _, sizes), (hot, hot_owners, hot_times) = parts[SETS][0], parts[HOT][0]
        none = [np.empty(0, np.int64)]
        times = unpack(hot_times)
        owner = np.concatenate(none + [unpack(o) for _, o, _ in parts[MEMBERS]] + [unpack(hot_owners)])
        value = np.concatenate([np.empty(0, np.uint64)] + [opened(x) for x, _, _ in parts[MEMBERS]] + [np.repeat(opened(hot), times)])
        # counted members are answered in full, bucket by bucket, so in the order of hot
        count = np.concatenate(none + [unpack(c) for _, _, c in parts[MEMBERS]] + [np.repeat(np.concatenate(none + [unpack(c) for _, _, c in parts[COUNTED]]), times)])
        who, keys = tile_keys(owner, value, count, unpack(sizes), percent)
        return pa.table({"key": keys.view(np.int64), "member": unpack(names)[who]})

    asked = rows.mapInArrow(ask, PACKED)
    return asked.groupBy("bucket").applyInArrow(answer, PACKED).groupBy("portion").applyInArrow(choose, "key long, member long")


def tiles(keys: DataFrame) -> DataFrame:
    """Members of each tile with more than one: key, member, hub (the smallest member)."""
    hubs = keys.groupBy("key").agg(F.min("member").alias("hub"), F.max("member").alias("top")).where("hub <> top").select("key", "hub")
    return keys.join(hubs, "key").distinct()


def verify(pairs: DataFrame, rows: DataFrame, classes: DataFrame, k: int, percent: int, scratch: Scratch, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(those of pairs (a, b: sets' h1) that link, the sets' arrays): bitmaps first, then exact intersections of sorted arrays.

    known has the arrays of earlier calls, which are not made again.
    """
    side = lambda x: classes.select(F.col("h1").alias(x), F.col("id").alias(f"id_{x}"), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}"))

    def bound(batches):
        for batch in batches:
            if batch.num_rows:
                one, two = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for c in ("bits_a", "bits_b"))
                n_a, n_b = (batch.column(c).to_numpy() for c in ("n_a", "n_b"))
                keep = bounded(n_a, n_b, np.bitwise_count(one ^ two).sum(axis=1, dtype=np.int64), percent)
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("a", "b", "id_a", "id_b")], ["a", "b", "id_a", "id_b"]).filter(pa.array(keep))

    joined = pairs.join(side("a"), "a").join(side("b"), "b").where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
    left = scratch.keep(joined.mapInArrow(bound, "a long, b long, id_a long, id_b long"), "bounded")
    wanted = left.select(F.explode(F.array(F.struct(F.col("id_a").alias("id"), F.col("a").alias("h1")), F.struct(F.col("id_b").alias("id"), F.col("b").alias("h1")))).alias("x")).select("x.*").distinct()
    wanted = scratch.keep(wanted if known is None else wanted.join(known.select("h1"), "h1", "left_anti").select("id", "h1"), "wanted")
    missing = wanted.count()

    def sets(batches):
        for batch in batches:
            names = batch.column(2).to_numpy()
            at = 0
            for ids, texts in text_portions([batch], 1, PORTION):
                owner, value = shingle_sets(texts, k)
                h1, _ = set_names(owner, value, len(texts))
                right = np.flatnonzero(h1 == names[at : at + len(texts)])  # rows may share an id
                ends = np.searchsorted(owner, right, side="right")
                begins = np.searchsorted(owner, right)
                yield pa.RecordBatch.from_arrays([pa.array(h1[right]), pa.array([value[i:j].tobytes() for i, j in zip(begins, ends)], pa.binary())], ["h1", "members"])
                at += len(texts)

    texts = rows.where("id is not null").join(F.broadcast(wanted) if missing <= BROADCAST_IDS else wanted, "id").select("id", "text", "h1")
    arrays = known
    if known is None or missing:
        made = scratch.keep(texts.mapInArrow(sets, "h1 long, members binary").groupBy("h1").agg(F.first("members").alias("members")), "arrays")
        arrays = made if known is None else known.unionAll(made)

    def exact(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = int((y[at] == x).sum())
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = left.select("a", "b").join(arrays.toDF("a", "x"), "a").join(arrays.toDF("b", "y"), "b")
    links = scratch.keep(both.select("a", "b", "x", "y").mapInArrow(exact, "a long, b long"), "links")
    scratch.drop(left, wanted)
    return links, arrays


def _unsettled(met: DataFrame, reached: DataFrame) -> DataFrame:
    """key, member, component of the members of each tile but its hub."""
    return met.where("member <> hub").join(reached.select(F.col("id").alias("member"), "component"), "member", "left").select("key", "member", F.coalesce("component", "member").alias("component"))


def _next_hubs(met: DataFrame, reached: DataFrame, turn: int) -> DataFrame:
    """Pairs of another hub of each tile whose members lie in different components with the members outside its own."""
    named = _unsettled(met, reached)
    rank = F.xxhash64("member", F.lit(turn))
    hubs = named.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min_by(F.struct("member", "component"), rank).alias("hub")).where("low <> high").select("key", "hub")
    pairs = named.join(hubs, "key").where(F.col("component") != F.col("hub.component"))
    return pairs.select(F.least("member", "hub.member").alias("a"), F.greatest("member", "hub.member").alias("b")).distinct()


def _others(met: DataFrame, reached: DataFrame, classes: DataFrame, percent: int, most: int) -> DataFrame:
    """a, b, cut: pairs that share a tile and lie in different components, where bitmaps leave them open.

    Of a tile's pairs (of two of its blocks, if it has several) each component gives the `most` closest ones by their
    bitmaps; how many others there were comes in rows without a pair. Tiles are streamed in order of their
    keys; a task holds two blocks of one tile at a time.
    """
    named = _unsettled(met, reached)
    open_keys = named.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n")).where("low <> high").select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    part = F.pmod(F.xxhash64("member"), F.col("blocks")).cast("int")
    rows = named.join(open_keys, "key").join(classes.select(F.col("h1").alias("member"), "n", "bits"), "member").withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("low", F.least("part", "other")).withColumn("high", F.greatest("part", "other"))

    def compare(low: int, high: int, group: list[tuple]) -> tuple[np.ndarray, np.ndarray, int]:
        sides = [[g for g in group if g[0] == part] for part in (low, high)]
        maps = [np.frombuffer(b"".join(g[4] for g in side), np.uint64).reshape(len(side), BITS // 64) for side in sides]
        one, two = ([np.array([g[c] for g in side], np.int64) for c in (1, 2, 3)] for side in sides)
        return open_pairs((*one, maps[0]), (*two, maps[1]), low == high, percent, most)

    def run(batches):
        def each():
            for batch in batches:
                yield from zip(*(batch.column(c).to_pylist() for c in range(8)))

        def rows_of(pairs, cut):
            a, b = (np.array(x, np.int64) for x in zip(*pairs)) if pairs else (np.empty(0, np.int64), np.empty(0, np.int64))
            return pa.RecordBatch.from_arrays([pa.array([*a, None], pa.int64()), pa.array([*b, None], pa.int64()), pa.array([0] * len(a) + [cut], pa.int64())], ["a", "b", "cut"])

        pairs: set[tuple[int, int]] = set()  # a pair shares many tiles
        cut = 0
        for (_, low, high), group in itertools.groupby(each(), key=lambda r: r[:3]):
            a, b, more = compare(low, high, [r[3:] for r in group])
            pairs.update(zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist()))
            cut += more
            if len(pairs) > 100_000:
                yield rows_of(pairs, cut)
                pairs, cut = set(), 0
        if pairs or cut:
            yield rows_of(pairs, cut)

    dealt = rows.select("key", "low", "high", "part", "member", "component", "n", "bits").repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
    return dealt.mapInArrow(run, "a long, b long, cut long")


def open_pairs(one: tuple, two: tuple, same: bool, percent: int, most: int, held: int = HELD_PAIRS) -> tuple[np.ndarray, np.ndarray, int]:
    """Members of the pairs of two blocks that bitmaps leave open, the `most` closest of each component, and how many pairs are left out.

    A block is its members, their components, sizes and bitmaps; same: the two are one. After so many pairs as `held` says
    only the closest so far stay: what isn't among these isn't among the closest of all either.
    """
    (a, comp_a, n_a, maps_a), (b, comp_b, n_b, maps_b) = one, two
    left, right, far = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
    settled = fresh = cut = 0
    for i in range(len(a) + 1):
        if i == len(a) or fresh > held + settled:
            x, y, distance = np.concatenate(left), np.concatenate(right), np.concatenate(far)
            kept = closest(comp_a[x], comp_b[y], distance, most)
            left, right, far = [x[kept]], [y[kept]], [distance[kept]]
            settled, fresh, cut = int(kept.sum()), 0, cut + int((~kept).sum())
        if i < len(a):
            j = np.flatnonzero((comp_b != comp_a[i]) & ((b > a[i]) if same else True))
            differing = np.bitwise_count(maps_b[j] ^ maps_a[i]).sum(axis=1, dtype=np.int64)
            may = bounded(n_a[i], n_b[j], differing, percent)
            left.append(np.full(may.sum(), i))
            right.append(j[may])
            far.append(differing[may] / (n_a[i] + n_b[j[may]]))
            fresh += len(right[-1])
    return a[left[0]], b[right[0]], cut


def closest(one: np.ndarray, two: np.ndarray, far: np.ndarray, most: int) -> np.ndarray:
    """Which pairs are among the `most` closest of either of their components."""
    kept = np.zeros(len(far), bool)
    for side in (one, two):
        order = np.lexsort((far, side))
        first = np.flatnonzero(np.r_[True, np.diff(side[order]) != 0]) if len(order) else np.empty(0, np.int64)
        rank = np.arange(len(order)) - np.repeat(first, np.diff(np.r_[first, len(order)]))
        kept[order[rank < most]] = True
    return kept


def join_groups(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """Groups of rows whose sets of k-word shingles link: 100 * intersection >= percent * union.

    1. Rows with equal sets are one class. 2. Classes fall into tiles by size band and by their rarest members (see
    shared_keys and tile_keys): two sets that link share a tile, and sets that only share common passages hardly
    ever do. 3. In each tile every class is compared with one hub: bitmaps bound the intersection from above, what
    they leave open is intersected exactly. 4. Tiles with members in different components take up to MORE_HUBS other
    hubs in turn. 5. Then each component is compared by the pairs that are closest by their bitmaps, MORE_PAIRS times
    as many each time, until no pair between different components is left that bitmaps leave open. So no link
    between components is lost, while large groups of near copies take a few comparisons for each member.

    Returns id_col, n_shingles, component_id (the smallest id reachable by links, itself included); one row for each
    row of docs. If row_col names a number of each row, it comes too, with component_set, which tells components apart
    where rows share ids (null for rows that link with nothing). Rows without words link with nothing and are their
    own component, as are rows with a null id (their component_id is null). Repeated rows, and rows with one id, are
    judged each by its own text. Texts are read whole. Sets are held as 64-bit hashes. What is stored on the way is deleted at the end.
    """
    scratch = Scratch()
    more = [F.col(row_col).cast("long").alias("row")] if row_col else []
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *more)
    size = planned_bytes(docs, text_col)
    bits, key_bits = bucket_bits(size, BUCKET_BYTES, LEAST_BUCKETS), min(64, max(40, size.bit_length() + 16))
    made = scratch.keep(features(rows, k), "features")
    full = made.where("n > 0 and id is not null")
    classes = scratch.keep(full.groupBy("h1", "h2", "n").agg(F.min("id").alias("id"), F.first("bits").alias("bits")), "classes")
    copies = scratch.keep(full.select("id").distinct().join(classes.select("id"), "id", "left_anti"), "copies")
    texts = rows.where("id is not null").select("id", "text")
    some = texts.join(F.broadcast(copies), "id", "left_anti") if copies.count() <= BROADCAST_IDS else texts  # copies only cost time
    keys = scratch.keep(shared_keys(some, k, percent, bits, key_bits), "keys")
    met = scratch.keep(tiles(keys), "tiles")
    scratch.drop(keys)
    first = met.where("member <> hub").select(F.col("member").alias("a"), F.col("hub").alias("b")).distinct()
    links, arrays = verify(first, texts, classes, k, percent, scratch)
    reached = scratch.hold(components(links))
    for turn in range(MORE_HUBS):
        pairs = scratch.keep(_next_hubs(met, reached, turn), "pairs")
        if not pairs.limit(1).count():
            break
        found, arrays = verify(pairs, texts, classes, k, percent, scratch, arrays)
        links = links.unionAll(found)
        scratch.drop(pairs, reached)
        reached = scratch.hold(components(links))
    most, left_out = 1, 1
    while left_out:  # ends, as at last every component gives all its pairs
        others = scratch.keep(_others(met, reached, classes, percent, most), "others")
        left_out, given = others.agg(F.sum("cut"), F.count("a")).first()
        if given:
            found, arrays = verify(others.where("a is not null").select("a", "b").distinct(), texts, classes, k, percent, scratch, arrays)
            links = links.unionAll(found)
            scratch.drop(others, reached)
            reached = scratch.hold(components(links))
        most *= MORE_PAIRS
    least = classes.join(reached.withColumnRenamed("id", "h1"), "h1").select("h1", "h2", "n", "id", "component")
    least = join_frequent(least, least.groupBy("component").agg(F.min("id").alias("component_id")), ["component"], scratch)
    root, least_id = F.coalesce("component", "h1").alias("component_set"), F.coalesce("component_id", "id").alias("component_id")
    named = scratch.keep(classes.join(least.drop("id"), ["h1", "h2", "n"], "left").select("h1", "h2", "n", root, least_id), "named")
    out = join_frequent(full.drop("bits"), named, ["h1", "h2", "n"], scratch)
    own = [F.col("row").alias(row_col), "component_set"] if row_col else []
    rest = made.where("n = 0 or id is null").withColumns({"component_id": F.col("id"), "component_set": F.lit(None).cast("long")})
    columns = [F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", *own]
    return scratch.end(out.select(*columns).unionAll(rest.select(*columns)), "groups")


def op10_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_groups(table(spark, sf_dir, "documents"), k=3, percent=90)


OP10_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w),
g AS (SELECT min(doc_id) AS g, list_sort(s) AS s, len(s) AS n FROM s WHERE len(s) > 0 GROUP BY list_sort(s), len(s)),
x AS (SELECT g, n, unnest(s) AS t FROM g),
p AS (SELECT a.g AS a, b.g AS b, a.n AS na, b.n AS nb, count(*) AS i FROM x a JOIN x b ON a.t = b.t AND a.g <> b.g AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE 100 * i >= 90 * (na + nb - i)),
r AS (SELECT g AS a, g AS b FROM g UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS g, min(b) AS c FROM r GROUP BY a)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(c.c, s.doc_id) AS component_id
FROM s LEFT JOIN g ON g.s = list_sort(s.s) LEFT JOIN c ON c.g = g.g
"""
