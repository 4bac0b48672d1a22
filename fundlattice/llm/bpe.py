"""Byte-level BPE encoding and decoding with batched numpy merge rounds."""

from __future__ import annotations

import functools
import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table

VOCABULARY = "byte_bpe_50k.json"
#: fixed value: how byte-level BPE vocabularies split a text into words
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words remembered from batch to batch by a worker; beyond it the memory starts anew.
REMEMBERED = 200_000


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte: itself where printable, else the next free one from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """Merge rules, applied to many words at a time.

    All words' symbols lie in one flat array. A round looks up each pair of neighbours in the sorted pair
    keys, finds each word's lowest rank and merges that pair wherever it stands in the word, from the
    left. Words without a known pair leave the array.
    """

    def __init__(self, pairs: list[tuple[int, int, int]]):
        rules = np.array(pairs, np.int64).reshape(-1, 3)
        keys = rules[:, 0] << 20 | rules[:, 1]
        self.ranks = np.argsort(keys, kind="stable")
        self.keys, self.into = keys[self.ranks], rules[:, 2]

    def apply(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The merged symbols of all words, in the words' order, and the new size of each word."""
        none, which, done = len(self.keys), np.arange(len(sizes)), []
        while len(which):
            ends = np.cumsum(sizes)
            starts = ends - sizes
            pair = np.empty(len(symbols), np.int64)
            pair[:-1] = symbols[:-1] << 20 | symbols[1:]
            pair[ends - 1] = -1  # no pair across words
            at = np.minimum(np.searchsorted(self.keys, pair), none - 1)
            rank = np.where(self.keys[at] == pair, self.ranks[at], none)
            least = np.minimum.reduceat(rank, starts)
            rest = least < none
            if not rest.all():
                inside = np.repeat(rest, sizes)
                done.append((which[~rest], sizes[~rest], symbols[~inside]))
                symbols, rank, sizes, which, least = symbols[inside], rank[inside], sizes[rest], which[rest], least[rest]
                if not len(which):
                    break
                starts = np.cumsum(sizes) - sizes
            hit = np.flatnonzero(rank == np.repeat(least, sizes))
            fresh = np.r_[True, np.diff(hit) != 1]
            if not fresh.all():  # of overlapping pairs (a a a) every second one, from the left
                run = np.cumsum(fresh) - 1
                hit = hit[(np.arange(len(hit)) - np.flatnonzero(fresh)[run]) % 2 == 0]
            symbols[hit] = self.into[rank[hit]]
            left = np.ones(len(symbols), bool)
            left[hit + 1] = False
            symbols, sizes = symbols[left], np.add.reduceat(left.astype(np.int64), starts)
        if not done:
            return symbols, sizes
        which, sizes, symbols = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(which)
        return symbols[spans(np.cumsum(sizes)[order] - sizes[order], sizes[order])], sizes[order]


def spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The indices of all spans, one span after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


class WordCoder:
    """Encodes texts word by word; each distinct word is merged once and remembered.

    A subclass says how a text falls into words and a word into first symbols.
    """

    def __init__(self, spec: dict):
        import regex

        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_pattern = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")")
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        self.merges = Merges([(self.vocab[a], self.vocab[b], self.vocab[a + b]) for a, b in pairs])
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.sizes = self.starts = self.pool = np.empty(0, np.int64)

    def words(self, text: str) -> list[str]:
        raise NotImplementedError

    def symbols(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raise NotImplementedError

    def _split(self, text: str) -> list[str]:
        if any(s in text for s in self.special):
            parts = self.special_pattern.split(text)
            return [w for i, p in enumerate(parts) for w in ([p] if i % 2 else self.words(p))]
        return self.words(text)

    def _learn(self, fresh: list[str]) -> None:
        plain = [w for w in fresh if w not in self.special]
        ids, sizes = self.merges.apply(*self.symbols(plain)) if plain else (np.empty(0, np.int64), np.empty(0, np.int64))
        more = [w for w in fresh if w in self.special]
        ids = np.concatenate([ids, np.array([self.special[w] for w in more], np.int64)])
        sizes = np.concatenate([sizes, np.ones(len(more), np.int64)])
        self.known.update(zip(plain + more, range(len(self.known), len(self.known) + len(fresh))))
        self.pool, self.sizes = np.concatenate([self.pool, ids]), np.concatenate([self.sizes, sizes])
        self.starts = np.cumsum(self.sizes) - self.sizes

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text; strings of special tokens count as those tokens."""
        split = [self._split(t) for t in texts]
        fresh = set().union(*split).difference(self.known)
        if len(self.known) + len(fresh) > REMEMBERED:
            self._forget()
            fresh = set().union(*split)
        if fresh:
            self._learn(list(fresh))
        counts = np.array([len(s) for s in split], np.int64)
        index = np.fromiter((self.known[w] for s in split for w in s), np.int64, int(counts.sum()))
        sizes = self.sizes[index]
        ids = self.pool[spans(self.starts[index], sizes)].astype(np.int32)
        ends = np.r_[0, np.cumsum(sizes)][np.cumsum(counts)]
        return np.split(ids, ends[:-1]) if len(texts) else []


class ByteBPE(WordCoder):
    """A vocabulary file of byte-level BPE: texts to ids and back, whole batches at a time."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            super().__init__(json.load(f))
        letters = byte_letters()
        self.word = regex.compile(PATTERN)
        self.of_byte = np.zeros(256, np.int64)
        for c, b in letters.items():
            self.of_byte[b] = self.vocab[c]
        strings = {i: bytes(letters[c] for c in s) for s, i in self.vocab.items() if s not in self.special} | {i: s.encode() for s, i in self.special.items()}
        size = max(strings) + 1
        self.token_sizes = np.array([len(strings.get(i, b"")) for i in range(size)], np.int64)
        self.token_starts = np.cumsum(self.token_sizes) - self.token_sizes
        self.token_bytes = np.frombuffer(b"".join(strings.get(i, b"") for i in range(size)), np.uint8)

    def words(self, text: str) -> list[str]:
        return self.word.findall(text)

    def symbols(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        return self.of_byte[np.frombuffer(b"".join(raw), np.uint8)], np.array([len(r) for r in raw], np.int64)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids' tokens, one after the other."""
        return self.token_bytes[spans(self.token_starts[ids], self.token_sizes[ids])].tobytes()


@functools.cache
def codec(name: str) -> ByteBPE:
    import public_tokenizers

    return ByteBPE(public_tokenizers.path(name))


def encode_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, with_ids: bool = True) -> DataFrame:
    """Every whole text encoded, and decoded again from its ids.

    Returns id_col, n_tokens, ids_sha256 (of the ids as little-endian unsigned 32-bit integers),
    decoded_sha256 (of the decoded text in UTF-8) and, with with_ids, ids and decoded. A null text is
    empty: no tokens. One row for each row of docs, repeated rows and rows with a null id included; nothing is
    shuffled. Texts are read in portions of a million characters; a longer one is read whole, in one task's memory.
    """

    def run(batches):
        bpe = codec(vocabulary)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for lo, hi in slices(texts, 1_000_000):
                ids = bpe.encode(texts[lo:hi])
                decoded = [bpe.decode(x).decode("utf-8", "replace") for x in ids]
                cols = [
                    batch.column(0).slice(lo, hi - lo),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids]),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded]),
                ]
                names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    cols += [pa.array(ids, pa.list_(pa.int32())), pa.array(decoded)]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(cols, names)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return rows.mapInArrow(run, schema + (", ids array<int>, decoded string" if with_ids else "")).withColumnRenamed("id", id_col)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(table(spark, sf_dir, "documents"), with_ids=False)
