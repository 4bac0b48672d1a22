"""Language-model scores: cross-entropy difference of matched target and background bigram models."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, stash, table
from .packed import bucket_bits, cuts, pack, pack_keys, planned_bytes, unpack, unpack_keys
from .shingle_join import BROADCAST_IDS, mix, word_hashes

#: Weight of the pair against the word alone, and of the word's count against an even share for each of the vocabulary.
PAIR_WEIGHT, WORD_WEIGHT = 0.7, 0.9
#: Characters whose distinct words and pairs are counted, and looked up, together, and those that are compressed together.
PORTION, CHUNK = 8_000_000, 300_000
DEALT = ["portion", "chunk", "place", "id", "text", "hit", "taught", "judged"]
#: Bytes of input for each bucket of words and pairs, and the fewest buckets.
BUCKET_BYTES, LEAST_BUCKETS = 4_000_000, 16
_U = np.uint64


@dataclass
class Model:
    """What both models learn from: docs, with the rows of the target marked, and their totals."""

    docs: DataFrame
    rows: DataFrame  # id, text, hit
    size: int
    words: tuple[int, int]  # of all documents, of the target
    vocabulary: int


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each word: its text, its key, the key of the pair with the word before (0 at a text's begin), that word's key.

    Keys are 64-bit hashes whose last bit tells words (0) from pairs (1).
    """
    text, word = word_hashes(texts)
    pair, before = np.zeros(len(word), np.uint64), np.zeros(len(word), np.uint64)
    inner = np.flatnonzero(text[1:] == text[:-1]) + 1 if len(text) > 1 else np.empty(0, np.int64)
    pair[inner] = mix(word[inner - 1] * _U(0x9E3779B97F4A7C15) + word[inner]) | _U(1)
    word = word & ~_U(1)
    before[inner] = word[inner - 1]
    return text, word, pair, before


def _keys(texts: list[str], hits: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all words and pairs of texts, or of those texts that hits names as well."""
    every, some = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
    for lo, hi in slices(texts, 300_000):
        text, word, pair, _ = grams(texts[lo:hi])
        every += [word, pair[pair > 0]]
        if hits is not None:
            hit = hits[lo:hi][text]
            some += [word[hit], pair[hit & (pair > 0)]]
    return np.concatenate(every), np.concatenate(some)


def _counts(keys: np.ndarray, some: np.ndarray) -> np.ndarray:
    """How often each of the sorted keys is in some, which holds no others."""
    of, n = np.unique(some, return_counts=True)
    out = np.zeros(len(keys), np.int64)
    out[np.searchsorted(keys, of)] = n
    return out


def _own(text: np.ndarray, key: np.ndarray) -> np.ndarray:
    """How often the key of each place occurs in its text."""
    order = np.lexsort((key, text))
    t, k = text[order], key[order]
    first = np.flatnonzero(np.r_[True, (t[1:] != t[:-1]) | (k[1:] != k[:-1])]) if len(t) else np.empty(0, np.int64)
    times = np.diff(np.r_[first, len(t)])
    out = np.empty(len(t), np.int64)
    out[order] = np.repeat(times, times)
    return out


def _shut(texts: list[str]) -> bytes:
    """Texts compressed together, with their sizes."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    return zlib.compress(np.array([len(raw), *map(len, raw)], "<u4").tobytes() + b"".join(raw), 1)


def _open(packed: bytes) -> list[str]:
    raw = zlib.decompress(packed)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    ends = np.cumsum(np.r_[4 * (n + 1), np.frombuffer(raw, "<u4", n, 4)]).tolist()
    return [raw[i:j].decode("utf-8", "surrogatepass") for i, j in zip(ends, ends[1:])]


def _portions(rows):
    """(texts, hits) of at most PORTION characters together, or one text, from batches of text and hit."""
    texts, hits, total = [], [], 0
    for batch in rows:
        for t, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if total and total + len(t or "") > PORTION:
                yield texts, np.array(hits, bool)
                texts, hits, total = [], [], 0
            texts.append(t or "")
            hits.append(h)
            total += len(t or "")
    yield texts, np.array(hits, bool)


def train(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model of all of docs, and one of the rows whose id is in target.

    The words of both and the size of their vocabulary are counted here: distinct words meet by bucket, three totals
    reach the driver. The counts of words and pairs are as many as the corpus holds; score() sums them
    where they are asked for.
    """
    ids = target.select(F.col(id_col).alias("__id")).where("__id is not null").distinct()
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    size = planned_bytes(docs, text_col)
    bits = bucket_bits(size, BUCKET_BYTES, LEAST_BUCKETS)
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text")).join(ids.withColumn("hit", F.lit(True)), "__id", "left").select(F.col("__id").alias("id"), "text", F.coalesce("hit", F.lit(False)).alias("hit"))

    def words(batches):
        for texts, hits in _portions(batches):
            found, n, m = [np.empty(0, np.uint64)], 0, 0
            for lo, hi in slices(texts, 300_000):
                text, word, _, _ = grams(texts[lo:hi])
                found.append(np.unique(word))
                n, m = n + len(word), m + int(hits[lo:hi][text].sum())
            keys = np.unique(np.concatenate(found))
            parts = cuts(keys, bits)
            for k, (bucket, a, b) in enumerate(parts):
                yield pa.RecordBatch.from_pydict({"bucket": [bucket], "keys": pa.array([pack_keys(keys[a:b])], pa.binary()), "n": [0 if k else n], "hits": [0 if k else m]})

    def distinct(key, group):
        keys = np.unique(np.concatenate([unpack_keys(raw) for raw in group["keys"].to_pylist()]))
        return pa.table({"n": [sum(group["n"].to_pylist())], "hits": [sum(group["hits"].to_pylist())], "distinct": [len(keys)]})

    found = rows.select("text", "hit").mapInArrow(words, "bucket long, keys binary, n long, hits long").groupBy("bucket").applyInArrow(distinct, "n long, hits long, distinct long")
    sums = found.agg(F.sum("n"), F.sum("hits"), F.sum("distinct")).first()
    return Model(docs, rows, size, (sums[0] or 0, sums[1] or 0), sums[2] or 0)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", learned: bool = False) -> DataFrame:
    """id_col, n_tokens, target_loss, background_loss, score: mean losses of a word in nats, and target less background.

    A lower score means more like the target. Both models have one vocabulary, that of all learned documents with a
    place for other words, and one smoothing that does not depend on how much they have seen: after a word that the
    model knows, a word's probability is PAIR_WEIGHT of the pair's share plus the rest of the word's; a word's is
    WORD_WEIGHT of its share of all words plus the rest of an even share of the vocabulary. Probabilities of all words
    and a text's end sum to one. With learned, docs are the rows that the model has learned from (read again or not), and each is scored
    without its own counts, so that the target's documents have no advantage; of repeated rows each leaves out only itself. Without it
    they are other texts. A text without
    words, null included, has zeros. One row for each row; whole texts, long ones in one task's memory.

    The model's texts and those of docs (once, where they are the same) are stored in portions, compressed. A portion sends the
    distinct keys of its words and pairs, with their counts, to the buckets of the hash space. A bucket sums
    them in one task and answers each portion in the order of its keys; a frequent word comes once from each
    portion, so a bucket grows with the portions, not with the rows. The answers meet the portion's texts again. Every distinct word and pair has its own count.
    """
    bits, words = bucket_bits(model.size, BUCKET_BYTES, LEAST_BUCKETS), model.words
    vocabulary = model.vocabulary + 1  # with a place for words that were never seen
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = own.schema["id"].dataType.simpleString()
    if learned:
        rows = model.rows.select("id", "text", "hit", F.lit(True).alias("taught"), F.lit(True).alias("judged"))
    else:
        taught = model.rows.select(F.lit(None).cast(kind).alias("id"), "text", "hit", F.lit(True).alias("taught"), F.lit(False).alias("judged"))
        rows = taught.unionAll(own.select("id", "text", F.lit(False).alias("hit"), F.lit(False).alias("taught"), F.lit(True).alias("judged")))

    def deal(batches):
        portion, total, number = TaskContext.get().partitionId() << 32, 0, 0
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for lo, hi in slices(texts, CHUNK):
                if total and total + sum(map(len, texts[lo:hi])) > PORTION:
                    portion, total = portion + 1, 0
                total, number = total + sum(map(len, texts[lo:hi])), number + 1
                packed = [_shut(texts[lo:hi])] + [None] * (hi - lo - 1)
                columns = [np.full(hi - lo, portion), np.full(hi - lo, number), np.arange(hi - lo)]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), batch.column(0).slice(lo, hi - lo), pa.array(packed, pa.binary()), *(c.slice(lo, hi - lo) for c in batch.columns[2:])], DEALT)

    def opened(group):
        """The texts of a portion's rows; a chunk's first row has them all."""
        chunks = {c: _open(raw) for c, raw in zip(group["chunk"].to_pylist(), group["text"].to_pylist()) if raw is not None}
        return [chunks[c][k] for c, k in zip(group["chunk"].to_pylist(), group["place"].to_pylist())]

    def ask(key, group):
        texts, hits, taught = opened(group), np.array(group["hit"].to_pylist(), bool), np.array(group["taught"].to_pylist(), bool)
        every, of_target = _keys(texts, hits)
        keys, n = np.unique(every, return_counts=True)
        if not taught.all():
            n = _counts(keys, _keys(texts, taught)[1])
        hits = _counts(keys, of_target)
        parts = cuts(keys, bits)
        packed = {"keys": [pack_keys(keys[a:b]) for _, a, b in parts], "n": [pack(n[a:b]) for _, a, b in parts], "hits": [pack(hits[a:b]) for _, a, b in parts]}
        return pa.table({"portion": pa.array([key[0].as_py()] * len(parts), pa.int64()), "bucket": pa.array([b for b, _, _ in parts], pa.int64())} | {k: pa.array(v, pa.binary()) for k, v in packed.items()})

    def answer(key, group):
        asked = [unpack_keys(raw.as_py()) for raw in group["keys"]]
        keys, at = np.unique(np.concatenate(asked), return_inverse=True)
        edges = np.cumsum([0] + [len(x) for x in asked]).tolist()
        out = {"portion": group["portion"], "bucket": group["bucket"]}
        for name in ("n", "hits"):
            sums = np.zeros(len(keys), np.int64)
            for a, b, raw in zip(edges, edges[1:], group[name]):
                sums[at[a:b]] += unpack(raw.as_py())  # keys of one portion are distinct
            out[name] = pa.array([pack(sums[at[a:b]]) for a, b in zip(edges, edges[1:])], pa.binary())
        return pa.table(out)

    def judge(portion, answers):
        texts, judged, taught, hit = opened(portion), *(np.array(portion[c].to_pylist(), bool) for c in ("judged", "taught", "hit"))
        learned_from = taught, taught & hit
        keys = np.unique(_keys(texts)[0])
        order = np.argsort(answers["bucket"].to_numpy())
        counts = [np.concatenate([np.empty(0, np.int64), *(unpack(raw[int(k)].as_py()) for k in order)]) for raw in (answers["n"], answers["hits"])]
        assert len(counts[0]) == len(keys)
        tokens, loss = [np.empty(0, np.int64)], ([np.empty(0)], [np.empty(0)])
        for lo, hi in slices(texts, 300_000):
            text, word, pair, before = grams(texts[lo:hi])
            n = np.bincount(text, minlength=hi - lo)
            tokens.append(n)
            inner = pair > 0
            at_word, at_pair, at_before = np.searchsorted(keys, word), np.searchsorted(keys, pair[inner]), np.searchsorted(keys, before[inner])
            own_word, own_pair = _own(text, word), _own(text, pair)[inner]
            own_before = own_word[np.flatnonzero(inner) - 1]
            for k in (0, 1):
                learned = learned_from[k][lo:hi]
                mine = learned[text]
                size = words[k] - (n * learned)[text]
                alone = WORD_WEIGHT * (counts[k][at_word] - own_word * mine) / np.maximum(size, 1) + np.where(size > 0, 1 - WORD_WEIGHT, 1) / vocabulary
                seen, both = np.zeros(len(word), np.int64), np.zeros(len(word), np.int64)
                seen[inner], both[inner] = counts[k][at_before] - own_before * mine[inner], counts[k][at_pair] - own_pair * mine[inner]
                p = np.where(seen > 0, PAIR_WEIGHT * both / np.maximum(seen, 1) + (1 - PAIR_WEIGHT) * alone, alone)
                loss[k].append(np.bincount(text, weights=-np.log(p), minlength=hi - lo) / np.maximum(n, 1))
        n, (background, target) = np.concatenate(tokens), (np.concatenate(x) for x in loss)
        out = pa.table({"id": portion["id"], "n_tokens": pa.array(n), "target_loss": pa.array(target), "background_loss": pa.array(background), "score": pa.array(target - background)})
        return out.filter(pa.array(judged))

    dealt = stash(rows.mapInArrow(deal, f"portion long, chunk long, place long, id {kind}, text binary, hit boolean, taught boolean, judged boolean"), "portions")
    asked = dealt.groupBy("portion").applyInArrow(ask, "portion long, bucket long, keys binary, n binary, hits binary")
    answers = asked.groupBy("bucket").applyInArrow(answer, "portion long, bucket long, n binary, hits binary")
    out = dealt.groupBy("portion").cogroup(answers.groupBy("portion")).applyInArrow(judge, f"id {kind}, n_tokens long, target_loss double, background_loss double, score double")
    return out.withColumnRenamed("id", id_col)


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: documents labelled as of good quality; background: all documents."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels").where("quality = 1")), learned=True)
