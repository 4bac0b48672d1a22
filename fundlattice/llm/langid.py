"""Language identification with hyperdimensional profiles: a random vector for each letter of any script."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, small_batches, table, text_portions
from .shingle_join import mix, series

DIM = 1024
#: Bytes of texts that are read at once.
PORTION = 300_000
#: Trigrams whose vectors are held at once.
TRIGRAMS = 512
SEED = 20_240_101
#: A score that unrelated vectors of DIM components reach by chance hardly ever: three standard deviations.
SIGNIFICANT = 3 / DIM**0.5
#: The bar of a language, see bars(): the rate that all but so large a share of its labelled rows reach, less a margin for texts still to come.
BELOW, MARGIN = 0.002, 0.8


@functools.cache
def folded() -> np.ndarray:
    """For each code point the first code point of its lower case, and 0 for what is no letter."""
    out = np.zeros(0x110000, np.int64)
    for cp in range(0x110000):
        if (c := chr(cp)).isalpha():
            out[cp] = ord(c.lower()[0])
    return out


def letter_vectors(letters: np.ndarray, dim: int = DIM) -> np.ndarray:
    """The random vector of +1 and -1 of each letter (a folded code point; 0 is the boundary), from a seeded hash."""
    words = letters.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + series(dim // 64, SEED)[None]
    bits = np.unpackbits(mix(words).view(np.uint8).reshape(len(letters), -1), axis=1)
    return (bits.astype(np.int8) << 1) - 1


def trigram_vectors(codes: np.ndarray, dim: int = DIM) -> np.ndarray:
    """The hypervector of each trigram: its letters' random vectors, permuted by place, then bound.

    Permutation is a rotation by the letter's place and binding the product of +1/-1 components.
    """
    parts = np.stack([codes >> 42, codes >> 21 & 0x1FFFFF, codes & 0x1FFFFF])
    letters, at = np.unique(parts, return_inverse=True)
    first, second, third = at.reshape(parts.shape)
    vectors = letter_vectors(letters, dim)
    return np.roll(vectors, 2, axis=1)[first] * np.roll(vectors, 1, axis=1)[second] * vectors[third]


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For each letter the index of its text and the trigram of which it is the middle (three letters of 21 bits).

    A run of other characters, and each end of a text, is one boundary symbol.
    """
    points = np.frombuffer(("\n" + "\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    own = np.zeros(len(points), bool)
    ends = np.cumsum([len(t) + 1 for t in texts])
    own[ends] = True
    letters = folded()[points]
    keep = (letters > 0) | np.r_[True, letters[:-1] > 0]
    text = np.cumsum(own)[keep]
    s = letters[keep]
    middle = np.flatnonzero(s[1:-1]) + 1 if len(s) > 2 else np.empty(0, np.int64)
    return text[middle], (s[middle - 1] << 42) | (s[middle] << 21) | s[middle + 1]


def weighted_sum(codes: np.ndarray, counts: np.ndarray, dim: int) -> np.ndarray:
    """The bundle of trigrams that occur so often."""
    out = np.zeros(dim)
    for at in range(0, len(codes), 1_024):
        out += counts[at : at + 1_024].astype(np.float64) @ trigram_vectors(codes[at : at + 1_024], dim).astype(np.float64)
    return out


def bundles(texts: list[str], dim: int = DIM) -> tuple[np.ndarray, np.ndarray]:
    """The bundled vector of each text, a row each, and the number of its letters."""
    out, letters = np.zeros((len(texts), dim)), np.zeros(len(texts), np.int64)
    for at in range(0, len(texts), 128):
        part = texts[at : at + 128]
        text, code = trigrams(part)
        cols, code = np.unique(code, return_inverse=True)
        for first in range(0, len(cols), 4_096):  # a few thousand trigrams make up most languages
            some = (code >= first) & (code < first + 4_096)
            width = min(4_096, len(cols) - first)
            counts = np.bincount(text[some] * width + code[some] - first, minlength=len(part) * width).reshape(len(part), width)
            for lo in range(0, width, TRIGRAMS):  # exact, as the sums are whole numbers
                hi = min(lo + TRIGRAMS, width)
                out[at : at + len(part)] += counts[:, lo:hi].astype(np.float32) @ trigram_vectors(cols[first + lo : first + hi], dim).astype(np.float32)
            letters[at : at + len(part)] += counts.sum(axis=1)
    return out, letters


def learn(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", dim: int = DIM) -> dict[str, np.ndarray]:
    """The prototype of each language: the bundle of all its texts.

    Rows with a null text or language teach nothing; repeated rows teach as often as they come. Each task adds up its
    rows, so that one vector for each task and language is shuffled; dim sums for each language reach the driver, as
    packed arrays.
    """

    def add(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            seen: dict[str, list] = {}
            for part, texts in text_portions([batch], 0, PORTION):
                langs = part.column(1).to_pylist()
                for lang in set(langs):
                    seen.setdefault(lang, []).append(np.unique(trigrams([t for t, x in zip(texts, langs) if x == lang])[1], return_counts=True))
            for lang, found in seen.items():
                codes, at = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
                counts = np.bincount(at, weights=np.concatenate([n for _, n in found]), minlength=len(codes))
                sums[lang] = sums.get(lang, 0) + weighted_sum(codes, counts, dim)
        for lang, vector in sums.items():
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang]), "vector": pa.array([vector.astype(np.int64).tolist()], pa.list_(pa.int64()))})

    rows = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text is not null and lang is not null")
    parts = rows.mapInArrow(add, "lang string, vector array<long>").select("lang", F.posexplode("vector").alias("at", "v")).groupBy("lang", "at").agg(F.sum("v").alias("v"))
    whole = parts.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda x: x["v"]).alias("v"))
    with small_batches(labelled.sparkSession):
        whole = whole.toArrow()
    found = {lang.as_py(): v.values.to_numpy().astype(float) for lang, v in zip(whole["lang"], whole["v"])}
    return {k: found[k] for k in sorted(found) if found[k].any()}


def bars(labelled: DataFrame, prototypes: dict[str, np.ndarray], text_col: str = "text", lang_col: str = "lang", below: float = BELOW) -> dict[str, float]:
    """For each language how like its prototype a text of it is at least, for the root of its effective letters.

    A cosine with the own language grows with that root (see identify), at a rate that is the language's own: it depends on how unlike its
    trigrams are. The bar is MARGIN times the rate, with SIGNIFICANT for chance, that all but a share `below` of the language's labelled rows
    reach, each against the prototype without itself. So a language with a single text has no bar to speak of. One value for each language reaches the driver.
    """
    names = {lang: v for lang, v in prototypes.items()}

    def rates(batches):
        for part, texts in text_portions(batches, 0, PORTION):
            langs = part.column(1).to_pylist()
            vectors, letters = bundles(texts)
            size = np.linalg.norm(vectors, axis=1)
            some = [k for k, lang in enumerate(langs) if lang in names and letters[k]]
            others = np.array([names[langs[k]] for k in some]).reshape(len(some), DIM) - vectors[some]
            cosine = (vectors[some] * others).sum(axis=1) / np.maximum(size[some] * np.linalg.norm(others, axis=1), 1e-9)
            rate = (np.clip(cosine, 0, 1) + SIGNIFICANT) * size[some] / (DIM**0.5 * letters[some])
            yield pa.RecordBatch.from_arrays([pa.array([langs[k] for k in some], pa.string()), pa.array(rate, pa.float64())], ["lang", "rate"])

    rows = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text is not null and lang is not null")
    found = rows.mapInArrow(rates, "lang string, rate double").groupBy("lang").agg(F.percentile_approx("rate", below, 10_000).alias("bar"))
    with small_batches(labelled.sparkSession):
        return {r["lang"]: MARGIN * r["bar"] for r in found.collect()}


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), dim: int = DIM, out: tuple[str, str, str] = ("lang_pred", "score", "effective"), least: dict[str, float] | None = None, foreign: str | None = None) -> DataFrame:
    """The language of every text: id_col, the columns named in keep, lang_pred, score, effective (or as `out` says) and, if it is named, foreign.

    lang_pred is the prototype with the largest cosine (ties: the first in alphabetical order), score
    that cosine, from 0 to 1. A null text, one without a letter, or no prototype at all gives ``und`` with
    score 0. effective is the number of letters, repeated trigrams counted less: the square of the number, times dim,
    over the square of the bundle's length (0 without a letter). The column named by foreign says whether the text is less like lang_pred
    than `least` asks for so many effective letters (see bars; without it none is). Whole texts are read, in portions. Nothing is
    shuffled; one row comes out for each row of docs, repeated rows and rows with a null id included.
    """
    names, names_out = list(prototypes), [*out, foreign] if foreign else out
    asked = np.array([(least or {}).get(k, 0.0) for k in names])
    unit = np.array([prototypes[k] / np.linalg.norm(prototypes[k]) for k in names]).reshape(len(names), dim)

    def predict(batches):
        for batch, texts in text_portions(batches, text_at, PORTION):
            vectors, letters = bundles(texts, dim)
            size = np.linalg.norm(vectors, axis=1)
            effective = np.where(letters > 0, dim * letters.astype(float) ** 2 / np.maximum(size, 1e-9) ** 2, 0)
            lang, score, bar = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
            if names and len(texts):
                cosines = vectors @ unit.T / np.maximum(size, 1e-9)[:, None]
                best = cosines.argmax(axis=1)
                lang = [names[b] if n else "und" for b, n in zip(best, letters)]
                score = np.where(letters > 0, np.clip(cosines.max(axis=1), 0, 1), 0)
                bar = asked[best] * np.sqrt(effective)
            made = [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(effective, pa.float64()), *([pa.array(score + SIGNIFICANT < bar)] if foreign else [])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], *made], schema=pa.schema([*list(batch.schema)[:width], *((n, a.type) for n, a in zip(names_out, made))]))

    kept = [id_col, *[c for c in keep if c != id_col]]
    width = len(kept)
    rows = docs.select(*kept) if text_col in kept else docs.select(*kept, F.col(text_col).alias(free_name(kept, "text")))  # a text goes to Python once
    text_at = kept.index(text_col) if text_col in kept else width
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:width])
    return rows.mapInArrow(predict, f"{head}, `{out[0]}` string, `{out[1]}` double, `{out[2]}` double" + (f", `{foreign}` boolean" if foreign else ""))


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, learn(docs.where(~held_out()))).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
