"""Packing token sequences: first-fit decreasing with a tournament tree, in randomised groups."""

from __future__ import annotations

import functools
import json
import sys
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import WordCoder, byte_letters, spans
from .common import slices, stash, table, text_portions

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
LENGTH = 2048
#: Bytes of texts that are encoded at once.
PORTION = 500_000
#: Pieces of a group on average; a group is what one call packs.
GROUP_PIECES = 8_192


class WordEncoder(WordCoder):
    """A vocabulary file of BPE with word ends that lowers the case and drops white space.

    Texts are told apart in one array of code points: kinds of characters say where words begin, and a word is looked up by
    a 64-bit hash that running sums give. What is found is compared letter by letter; should two words share
    a hash, the portion is encoded word by word.
    """

    #: fixed value: how this vocabulary splits a normalised text
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    SPACE, LETTER, NUMBER, OTHER = range(4)
    #: Code points that are told apart together; longer texts are cut at white space.
    PORTION = 500_000
    #: Words remembered from portion to portion.
    WORDS = 150_000

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        super().__init__(spec)
        end = spec["model"]["end_of_word_suffix"]
        self.word = regex.compile(self.PATTERN)
        self.inner, self.last = np.zeros(256, np.int64), np.zeros(256, np.int64)
        for c, b in byte_letters().items():
            self.inner[b], self.last[b] = self.vocab[c], self.vocab[c + end]
        every = "".join(map(chr, range(sys.maxunicode + 1)))
        self.kinds = np.full(len(every), self.OTHER, np.uint8)
        for kind, pattern in ((self.SPACE, r"\s+"), (self.LETTER, r"\p{L}+"), (self.NUMBER, r"\p{N}+")):
            for found in regex.finditer(pattern, every):
                self.kinds[slice(*found.span())] = kind
        self.marks = np.random.default_rng(7).integers(0, 2**64, len(every), np.uint64)
        self.powers = self.inverses = np.ones(1, np.uint64)

    def _forget(self) -> None:
        super()._forget()
        self.keys, self.rows = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.ids, self.letters = Runs(np.int32), Runs(np.uint32)

    def _normal(self, text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if "\u03a3" in text:  # here the case of a letter is lowered without regard to its neighbours
                text = "".join(c.lower() for c in text)
        return text.lower()

    def symbols(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        flat, sizes = np.frombuffer(b"".join(raw), np.uint8), np.array([len(r) for r in raw], np.int64)
        symbols, ends = self.inner[flat], np.cumsum(sizes) - 1
        symbols[ends] = self.last[flat[ends]]
        return symbols, sizes

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text; strings of special tokens count as those tokens."""
        parts = [list(self._parts(t)) for t in texts]
        flat = [p for ps in parts for p in ps]
        plain = [p for p in flat if isinstance(p, str)]
        coded = iter([ids for lo, hi in slices(plain, self.PORTION) for ids in self._encode_portion(plain[lo:hi])])
        pieces = [next(coded) if isinstance(p, str) else np.array([p], np.int32) for p in flat]
        if len(pieces) == len(texts):
            return pieces
        ends = np.cumsum([len(ps) for ps in parts])
        return [np.concatenate(pieces[e - len(ps) : e]) for e, ps in zip(ends.tolist(), parts)]

    def _parts(self, text: str) -> Iterator[str | int]:
        """At least one normalised part of a text, and ids of special tokens, in order."""
        whole = self.special_pattern.split(text) if any(s in text for s in self.special) else [text]
        for i, part in enumerate(whole):
            if i % 2:
                yield self.special[part]
                continue
            part, at = self._normal(part), 0
            while len(part) - at > self.PORTION:
                cut = max(part.rfind(c, at + 1, at + self.PORTION) for c in " \n\t\u3000")
                cut = cut if cut > 0 else part.find(" ", at + self.PORTION)
                if cut < 0:
                    break
                yield part[at:cut]
                at = cut
            yield part[at:]

    def _starts(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where words begin, their sizes, and which code points are in words; the last code point is white space."""
        kind = self.kinds[points]
        inside, letter = kind != self.SPACE, kind == self.LETTER
        first = np.r_[True, kind[1:] != kind[:-1]] | (kind == self.NUMBER)
        first &= inside
        quote = np.flatnonzero((points[:-1] == ord("'")) & first[:-1] & letter[1:])
        one, two = points[quote + 1], points[quote + 2]
        is_ = lambda x, c: x == ord(c)
        short = is_(one, "s") | is_(one, "t") | is_(one, "m") | is_(one, "d")
        long = ((is_(one, "r") | is_(one, "v")) & is_(two, "e")) | (is_(one, "l") & is_(two, "l"))
        for found, n in ((quote[short], 1), (quote[long], 2)):
            first[found + 1] = False
            first[found + 1 + n] |= letter[found + 1 + n]
        edges = np.flatnonzero(first | ~inside)
        begins = first[edges]
        return edges[begins], np.diff(edges, append=len(points))[begins], inside

    def _hashes(self, points: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Polynomial hashes of words: differences of running sums, divided by the power that their place has."""
        if len(self.powers) < len(points):
            odd = 0x9E3779B97F4A7C15
            self.powers, self.inverses = (np.cumprod(np.full(len(points), x, np.uint64)) for x in (odd, pow(odd, -1, 2**64)))
        sums = np.r_[np.uint64(0), np.cumsum(self.marks[points] * self.powers[: len(points)])]
        return (sums[starts + sizes] - sums[starts]) * self.inverses[starts]

    def _encode_portion(self, texts: list[str]) -> list[np.ndarray]:
        joined = "\n".join([*texts, ""])
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        starts, sizes, inside = self._starts(points)
        keys, at, index = np.unique(self._hashes(points, starts, sizes), return_index=True, return_inverse=True)
        if len(self.keys) + len(keys) > self.WORDS:
            self._forget()
        place = np.searchsorted(self.keys, keys)
        fresh = np.r_[self.keys, np.uint64(0)][place] != keys
        fresh |= place == len(self.keys)
        if fresh.any():
            a, n = starts[at[fresh]], sizes[at[fresh]]
            ids, counts = self.merges.apply(*self.symbols([joined[i:j] for i, j in zip(a.tolist(), (a + n).tolist())]))
            more = np.arange(len(self.keys), len(self.keys) + len(a))
            self.ids.add(ids, counts)
            self.letters.add(points[spans(a, n)], n)
            self.keys, self.rows = np.insert(self.keys, place[fresh], keys[fresh]), np.insert(self.rows, place[fresh], more)
            place = np.searchsorted(self.keys, keys)
        row = self.rows[place][index]
        if not (np.array_equal(self.letters.sizes[row], sizes) and np.array_equal(self.letters.take(row), points[inside])):
            return self._one_by_one(texts)
        ends = np.r_[0, np.cumsum(self.ids.sizes[row])][np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts]))]
        return np.split(self.ids.take(row), ends[:-1])

    def _one_by_one(self, texts: list[str]) -> list[np.ndarray]:
        split, ids = [self.word.findall(t) for t in texts], Runs(np.int32)
        numbers = {w: k for k, w in enumerate(dict.fromkeys(chain.from_iterable(split)))}
        ids.add(*self.merges.apply(*self.symbols(list(numbers))))
        return [ids.take(np.fromiter(map(numbers.__getitem__, s), np.int64, len(s))) for s in split]


class Runs:
    """Runs of numbers in one array."""

    def __init__(self, kind: type):
        self.flat, self.sizes, self.starts = np.empty(0, kind), np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        self.starts = np.concatenate([self.starts, np.cumsum(sizes) - sizes + len(self.flat)])
        self.flat, self.sizes = np.concatenate([self.flat, flat.astype(self.flat.dtype)]), np.concatenate([self.sizes, sizes])

    def take(self, rows: np.ndarray) -> np.ndarray:
        """The numbers of some runs, one run after the other."""
        return self.flat[spans(self.starts[rows], self.sizes[rows])]


@functools.cache
def encoder(name: str) -> WordEncoder:
    import public_tokenizers

    return WordEncoder(public_tokenizers.path(name))


class Tournament:
    """Bins with room `size` each; finds the leftmost bin with enough room in logarithmic time.

    A node holds the larger room of its two children, so the way down from the root, left where the
    left child has enough, ends in the first bin that fits.
    """

    def __init__(self, bins: int, size: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.room = [size] * (2 * self.leaves)

    def place(self, need: int) -> int:
        room, node = self.room, 1
        while node < self.leaves:
            node *= 2
            if room[node] < need:
                node += 1
        room[node] -= need
        found = node - self.leaves
        while node > 1:
            node //= 2
            room[node] = max(room[2 * node], room[2 * node + 1])
        return found


def first_fit_decreasing(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length; of equal lengths the first comes first."""
    order = np.argsort(-lengths, kind="stable")
    tree = Tournament(max(1, len(lengths)), size)
    bins, offsets, used = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), [0] * tree.leaves
    for i in order.tolist():
        need = int(lengths[i])
        at = tree.place(need)
        bins[i], offsets[i] = at, used[at]
        used[at] += need
    return bins, offsets


def cut(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """Every document's ids, cut every `length`: id_col, start, length, ids_crc32, doc_tokens, salt[, ids].

    A null text is empty and leaves the end id alone. salt is a number without regard to the contents,
    so that repeated rows and ids spread evenly.
    """

    def run(batches):
        from pyspark import TaskContext

        enc = encoder(vocabulary)
        context = TaskContext.get()
        seed = np.random.default_rng([context.partitionId() if context else 0, 7])
        for part, texts in text_portions(batches, 1, PORTION):
            rows, start, size, crc, total, ids_of = [], [], [], [], [], []
            for i, ids in enumerate(enc.encode(texts)):
                ids = np.append(ids, np.int32(END_ID))
                for at in range(0, len(ids), length):
                    piece = ids[at : at + length]
                    rows.append(i)
                    start.append(at)
                    size.append(len(piece))
                    crc.append(zlib.crc32(piece.astype("<u4").tobytes()))
                    total.append(len(ids))
                    if with_ids:
                        ids_of.append(piece)
            cols = [part.column(0).take(pa.array(rows, pa.int64()))] + [pa.array(x, pa.int64()) for x in (start, size, crc, total, seed.integers(0, 2**62, len(rows)))]
            names = ["id", "start", "length", "ids_crc32", "doc_tokens", "salt"]
            if with_ids:
                cols.append(pa.array(ids_of, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, salt long"
    return rows.mapInArrow(run, schema + (", ids array<int>" if with_ids else "")).withColumnRenamed("id", id_col)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, length: int = LENGTH, group_pieces: int = GROUP_PIECES, with_ids: bool = False) -> DataFrame:
    """Documents packed into sequences of at most `length` tokens: one row for each piece.

    Returns id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]. Documents are cut
    only where they fill a whole sequence; the remainders are packed by first-fit decreasing within random
    groups of about `group_pieces` pieces, so no task grows with the input. Empty tables give no rows;
    repeated rows are packed as often as they come; rows with a null id are packed too. A very long text is encoded
    whole, in one task's memory, and gives as many full sequences as it fills.
    """
    pieces = stash(cut(docs, id_col, text_col, vocabulary, length, with_ids), "pieces")
    groups = max(1, -(-pieces.count() // group_pieces))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["salt", "ids_crc32"], kind="stable").reset_index(drop=True)
        bins, offsets = first_fit_decreasing(pdf["length"].to_numpy(), length)
        return pdf.assign(sequence_id=(pdf["group"].to_numpy().astype(np.int64) << 32) | bins, offset=offsets)[out]

    kind = pieces.schema[id_col].dataType.simpleString()
    out = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
    schema = f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + (", ids array<int>" if with_ids else "")
    return pieces.withColumn("group", (F.col("salt") % groups).cast("int")).groupBy("group").applyInPandas(run, schema)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
