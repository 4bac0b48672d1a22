"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes of a text."""

from __future__ import annotations

import contextlib
import functools
import hashlib
import json
import os
import re
from itertools import chain, count

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import PATTERN, byte_letters
from .common import Scratch, join_frequent, small_batches, stash_by, table, text_portions
from .packed import planned_bytes
from .shingle_join import BROADCAST_IDS

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of texts whose distinct words are told apart together, and those that are read together.
PORTION, PART = 16_000_000, 1_000_000
#: Units that are encoded together, and bytes of a unit that is encoded by itself.
ENCODED, LONG_UNIT = 2_048, 400
#: Bytes of input for each bucket of the stored portions, and the most buckets that Spark allows.
BUCKET_BYTES, MOST_BUCKETS = 8_000_000, 100_000
#: A token travels as id << SIZE_BITS | bytes.
SIZE_BITS = 10
#: Set in the jobs of align() alone: rows that lie by portion need no exchange to be joined by portion and more.
CO_PARTITIONED = "spark.sql.requireAllClusterKeysForCoPartition"
#: Where both vocabularies surely cut: before a space between two characters that aren't white space.
BOUND, ODD_SPACE = re.compile(r"(?<=\S) (?=\S)"), re.compile(r"\s |^ | \s| $")
#: And between a letter and a stop, where no piece of the second vocabulary joins these.
STOP = re.compile(r"(?<=[A-Za-zÀ-ÖØ-öø-ÿ])(?=[.,;:!?])")
#: Units that fall apart again when they are put one after the other.
PLAIN = re.compile(r" \S(?:.*\S)?", re.DOTALL)


class Pair:
    """Both vocabularies: units of text to tokens, each with the number of its bytes."""

    def __init__(self, a_file: str, b_file: str):
        import public_tokenizers
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.a = Tokenizer.from_file(public_tokenizers.path(a_file))
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(b_file))
        letters = byte_letters()
        spec = json.loads(self.a.to_str())
        ranks = {bytes(letters[c] for c in s): i for s, i in spec["model"]["vocab"].items() if all(c in letters for c in s) and self.a.token_to_id(s) not in self.a.get_added_tokens_decoder()}
        self.ranked = tiktoken.Encoding(a_file, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.a_sizes = np.array([len(s) if (s := self.a.id_to_token(i)) and all(c in letters for c in s) else len((s or "").encode()) for i in range(self.a.get_vocab_size())], np.int64)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_sizes = np.array([1 if self.b.is_byte(i) else len(p.replace("▁", " ").encode()) for i, p in enumerate(pieces)], np.int64)
        #: no piece goes on with a space, so texts fall apart before spaces
        self.separable = not any(re.search("[^▁]▁", p) for p in pieces)
        self.stops = self.separable and not any(len(STOP.split(p)) > 1 for p in pieces) and self.b.encode("a", out_type=str) == ["▁a"]

    def exact(self, text: str) -> bool:
        """Whether the tokens of both spell space and text. U+2581 is read as a space by b; normalising may change a text."""
        return "▁" not in text and (text.isascii() or self.b.normalize(text).replace("▁", " ").lstrip(" ") == text.lstrip(" "))

    def words(self, text: str) -> list[str]:
        """Parts of space and text that are encoded apart with the same result; each has lost its leading space."""
        if not self.separable:
            return [text]
        return BOUND.split(text) if ODD_SPACE.search(text) else text.split(" ")

    def units(self, word: str) -> list[str]:
        """Parts of space and word that are encoded apart with the same result."""
        return STOP.split(" " + word) if self.stops else [" " + word]

    def encode(self, units: list[str]) -> tuple[pa.ListArray, pa.ListArray]:
        """The packed tokens of each unit by a and by b, which puts a space before a text: one without it is read after a letter."""
        led = np.array([u[0] != " " for u in units])
        b = self.b.encode(["a" + u if n else u[1:] for u, n in zip(units, led.tolist())], num_threads=1)
        return _packed(*self._encode_a(units, led), self.a_sizes), _packed(*_without_first(*_flat(b), led), self.b_sizes)

    def _encode_a(self, units: list[str], led: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Short plain units one after the other, told apart by their tokens' bytes; the others each by itself."""
        spelled = [" a" + u if n else u for u, n in zip(units, led.tolist())]
        plain = np.array([len(u) <= LONG_UNIT and PLAIN.fullmatch(u) is not None for u in spelled])
        if plain.all():
            return _without_first(*self._encode_plain(spelled), led)
        rest = np.flatnonzero(~plain).tolist()
        ids, counts = _without_first(*self._encode_plain([spelled[k] for k in np.flatnonzero(plain).tolist()]), led[plain])
        more, sizes = _flat([e.ids for e in self.a.encode_batch([units[k] for k in rest], add_special_tokens=False)])
        whole = np.empty(len(units), np.int64)
        whole[plain], whole[~plain] = counts, sizes
        of_plain, out = np.repeat(plain, whole), np.empty(len(ids) + len(more), np.int64)
        out[of_plain], out[~of_plain] = ids, more
        return out, whole

    def _encode_plain(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = np.array(self.ranked.encode_ordinary("".join(units)), np.int64)
        ends = np.searchsorted(np.cumsum(self.a_sizes[ids]), np.cumsum([len(u.encode()) for u in units])) + 1 if units else np.zeros(0, np.int64)
        return ids, np.diff(ends, prepend=0)


def _flat(tokens: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Lists of ids as one array, and how many each has."""
    counts = np.fromiter(map(len, tokens), np.int64, len(tokens))
    return np.fromiter(chain.from_iterable(tokens), np.int64, int(counts.sum())), counts


def _without_first(ids: np.ndarray, counts: np.ndarray, led: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same without the first id of those that are led by another letter."""
    if not led.any():
        return ids, counts
    return np.delete(ids, (np.cumsum(counts) - counts)[led]), counts - led


def _packed(ids: np.ndarray, counts: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    """Lists of packed tokens, of one array of ids."""
    values = (ids << SIZE_BITS | sizes[ids]).astype(np.int32)
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), values)


@functools.cache
def vocabularies(a_file: str, b_file: str) -> Pair:
    return Pair(a_file, b_file)


@contextlib.contextmanager
def _co_partitioned(spark: SparkSession):
    before = spark.conf.get(CO_PARTITIONED)
    spark.conf.set(CO_PARTITIONED, "false")
    try:
        yield
    finally:
        spark.conf.set(CO_PARTITIONED, before)


def _ids(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.shiftrightunsigned(t, SIZE_BITS))


def alignments(types: DataFrame, keys: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """keys, keep, n_a, n_b, groups, links of each row of types (unique in keys; a, b: packed tokens of the same bytes).

    groups: the tokens between common ends, as a1,a2|b1;a3|b2,b3. links: (a, b) of the tokens that end together.
    The last tokens of a row always end together; so a row with one token on a side is one group, and only cuts within the others are looked for.
    Their tokens but the last are exploded with their places, their ends are running sums of their bytes, and ends meet in an equi-join by key and
    end. Running sums of the digits of ids tell where a group lies in a row's ids as
    text, so a group is a part of that text's bytes. Rows that lie by a key from the start aren't exchanged.
    """
    so_far = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    sizes = [F.size(s).alias(f"n_{s}") for s in "ab"]
    cut = (F.size("a") > 1) & (F.size("b") > 1)
    text = {s: F.array_join(_ids(F.col(s)).cast("array<string>"), ",") for s in "ab"}
    last = {s: F.shiftrightunsigned(F.element_at(s, -1), SIZE_BITS).alias(s) for s in "ab"}

    def ends(side: str) -> DataFrame:
        size, token = F.col("token").bitwiseAND((1 << SIZE_BITS) - 1), F.shiftrightunsigned("token", SIZE_BITS)
        tokens = types.where(cut).select(*keys, F.size(side).alias("n"), F.posexplode(side).alias("pos", "token")).where("pos < n - 1").select(*keys, "pos", size.alias("size"), token.alias(side))
        return tokens.select(*keys, side, F.sum("size").over(so_far).alias("end"), F.sum(F.length(F.col(side).cast("string")) + 1).over(so_far).cast("int").alias(f"{side}_to"))

    listed = ends("a").join(ends("b"), [*keys, "end"]).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("a_to", "b_to", "a", "b"))).alias("cuts"))
    told = [t.cast("binary").alias(f"{s}_text") for s, t in text.items()]
    joined = types.where(cut).select(*keys, *keep, *sizes, *told, F.struct(*last.values()).alias("last")).join(listed, keys, "left")
    end = [(F.octet_length(f"{s}_text") + 1).alias(f"{s}_to") for s in "ab"]
    final = F.array(F.struct(*end, F.col("last.a").alias("a"), F.col("last.b").alias("b")))
    joined = joined.withColumn("cuts", F.when(F.col("cuts").isNull(), final).otherwise(F.concat("cuts", final)))

    def side(c: Column, i: Column, name: str) -> Column:
        before = F.when(i == 0, F.lit(0)).otherwise(F.col("cuts")[i - 1][f"{name}_to"])
        return F.substring(F.col(f"{name}_text"), before + 1, c[f"{name}_to"] - before - 1)

    groups = F.array_join(F.transform("cuts", lambda c, i: F.concat(side(c, i, "a"), F.lit(b"|"), side(c, i, "b")).cast("string")), ";")
    several = joined.select(*keys, *keep, "n_a", "n_b", groups.alias("groups"), F.arrays_zip(F.col("cuts.a"), F.col("cuts.b")).alias("links"))
    one = types.where(~cut & (F.size("a") > 0) & (F.size("b") > 0)).select(*keys, *keep, *sizes, F.concat_ws("|", *text.values()).alias("groups"), F.array(F.struct(*last.values())).alias("links"))
    return several.unionAll(one).withColumns({f"n_{s}": F.col(f"n_{s}").cast("long") for s in "ab"})


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_file: str = A_FILE, b_file: str = B_FILE, with_groups: bool = True) -> DataFrame:
    """id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 and, with with_groups, groups of every row.

    Texts that are null, empty or not spelled by both vocabularies have no tokens: zeros and '' in place of a digest.
    A link is a pair of tokens that end together; its count is the number of links of all documents that have its
    two ids; n_best counts links whose count is the highest of their b id, ties included.

    Both vocabularies cut before a space between words and between a letter and a stop, so what lies between is a unit that is encoded and
    aligned apart. A task takes a portion of texts apart, numbers its distinct words, encodes their distinct units and stores these as rows;
    texts become sequences of words' numbers. The units' tokens are aligned as rows (see alignments), pairs of ids are counted over all portions, and
    the results meet the sequences of their portion. Portions are bounded and stored by their number, so neither units, tokens nor
    sequences are ever exchanged; only counts of pairs of ids are. A text without spaces is one unit, and with its tokens one
    row; a very long text is read whole in one task's memory.
    Repeated rows count like others; rows with a null id are kept; an empty table gives none. Only id_col and text_col are read.
    """
    spark, scratch = docs.sparkSession, Scratch()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    names = ["portion", "no", "times", "a", "b", "id", "seq"]
    buckets = min(MOST_BUCKETS, max(2 * spark.sparkContext.defaultParallelism, planned_bytes(rows, "text") // BUCKET_BYTES))

    def deal(batches):
        pair, context = vocabularies(a_file, b_file), TaskContext.get()
        portion, index, times, size, fresh = (context.partitionId() if context else 0) << 32, {}, np.zeros(0, np.int64), 0, count()
        zipped, lists = zstandard.ZstdCompressor(1), pa.list_(pa.int32())

        def flush():
            units, sizes, numbers = {}, np.empty(len(index), np.int32), []
            for k, word in enumerate(index):
                parts = pair.units(word)
                sizes[k] = len(parts)
                numbers += [units.setdefault(u, len(units)) for u in parts]
            index.clear()
            numbers = np.array(numbers, np.int32)
            of_units = np.bincount(numbers, weights=np.repeat(times, sizes)).astype(np.int64)
            nulls = [pa.nulls(1, t) for t in (pa.int32(), lists, lists, ids)]
            packed = zipped.compress(np.concatenate([sizes, numbers]).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([portion]), nulls[0], pa.array([len(sizes)]), *nulls[1:], pa.array([packed], pa.binary())], names)
            units, n = list(units), len(units)
            for lo in range(0, n, ENCODED):
                hi = min(n, lo + ENCODED)
                columns = [pa.array(np.full(hi - lo, portion)), pa.array(np.arange(lo, hi, dtype=np.int32)), pa.array(of_units[lo:hi])]
                yield pa.RecordBatch.from_arrays([*columns, *pair.encode(units[lo:hi]), pa.nulls(hi - lo, ids), pa.nulls(hi - lo, pa.binary())], names)

        for part, texts in text_portions(batches, 1, PART):
            ids = part.column(0).type
            split = [pair.words(t) if t and pair.exact(t) else [] for t in texts]
            new = set().union(*split).difference(index)
            index.update(zip(new, fresh))
            seqs = [np.fromiter(map(index.__getitem__, s), np.int32, len(s)) for s in split]
            more = np.bincount(np.concatenate(seqs), minlength=len(index))
            more[: len(times)] += times
            times = more
            packed = [zipped.compress(s.view(np.uint8).reshape(-1, 4).T.tobytes()) if len(s) else b"" for s in seqs]
            nulls = [pa.nulls(len(texts), t) for t in (pa.int32(), pa.int64(), lists, lists)]
            yield pa.RecordBatch.from_arrays([pa.array([portion] * len(texts), pa.int64()), *nulls, part.column(0), pa.array(packed, pa.binary())], names)
            size += sum(map(len, texts))
            if size > PORTION:
                yield from flush()
                portion, index, times, size, fresh = portion + 1, {}, np.zeros(0, np.int64), 0, count()
        if index:
            yield from flush()

    def gather(portion, answers):
        order, opened, out = np.argsort(answers["no"].to_numpy()), zstandard.ZstdDecompressor(), {c: [] for c in [*totals, "sha", "groups"]}
        of_units = answers["groups"].take(pa.array(order)).to_pylist()
        strings, numbers = [], np.empty((0, len(totals)), np.int64)
        for k in np.flatnonzero(portion["words"].is_valid().to_numpy()).tolist():  # the units of each word
            n = portion["words"][k].as_py()
            sizes, units = np.split(np.frombuffer(opened.decompress(portion["seq"][k].as_py()), np.int32), [n])
            ends = np.cumsum(sizes)
            numbers = np.stack([np.add.reduceat(answers[c].to_numpy()[order][units], ends - sizes) for c in totals], axis=1)
            parts, ends = list(map(of_units.__getitem__, units.tolist())), ends.tolist()
            strings = [parts[i] if j == i + 1 else ";".join(parts[i:j]) for i, j in zip([0, *ends], ends)]
        texts = portion.filter(portion["words"].is_null())
        for raw in texts["seq"].to_pylist():
            seq = np.frombuffer(opened.decompress(raw), np.uint8).reshape(4, -1).T.copy().view(np.int32).ravel() if raw else np.empty(0, np.int32)
            for c, n in zip(totals, numbers[seq].sum(axis=0).tolist()):
                out[c].append(n)
            digest, whole = hashlib.sha256(), []
            for lo in range(0, len(seq), 100_000):
                text = (";" if lo else "") + ";".join(map(strings.__getitem__, seq[lo : lo + 100_000].tolist()))
                digest.update(text.encode())
                if with_groups:
                    whole.append(text)
            out["sha"].append(digest.hexdigest() if len(seq) else "")
            out["groups"].append("".join(whole))
        kinds = [*(pa.array(out[c], pa.int64()) for c in totals), pa.array(out["sha"])]
        return pa.table([texts["id"], *kinds, *([pa.array(out["groups"])] if with_groups else [])], ["id", *totals, "groups_sha256", *(["groups"] if with_groups else [])])

    # by number first, as that tells a portion's rows apart when they are sorted
    totals, keys = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"], ["no", "portion"]
    with small_batches(spark):
        dealt = scratch.hold(stash_by(rows.mapInArrow(deal, f"portion long, no int, times long, a array<int>, b array<int>, id {kind}, seq binary"), "portion", buckets, "portions"))
    types = dealt.where("no is not null")
    with _co_partitioned(spark):
        aligned = scratch.hold(stash_by(alignments(types, keys, keep=("times",)), "portion", buckets, "aligned"))
    links = aligned.select(*keys, "times", F.explode("links").alias("link")).select(*keys, "times", "link.a", "link.b")
    counts = links.groupBy("a", "b").agg(F.sum("times").alias("n"))
    pairs = scratch.keep(counts.join(counts.groupBy("b").agg(F.max("n").alias("most")), "b").select("a", "b", "n", (F.col("n") == F.col("most")).cast("long").alias("best")), "pairs")
    told = links.join(F.broadcast(pairs), ["a", "b"]) if pairs.count() <= BROADCAST_IDS else join_frequent(links, pairs, ["a", "b"], scratch)
    sums = told.groupBy(*keys).agg(F.count("*").alias("n_links"), F.sum("best").alias("n_best"), F.sum("n").alias("count_sum"))
    schema = f"id {kind}, " + ", ".join(f"{c} long" for c in totals) + ", groups_sha256 string" + (", groups string" if with_groups else "")
    with _co_partitioned(spark):
        answers = aligned.select(*keys, "groups", "n_a", "n_b").join(sums, keys).withColumn("n_groups", F.col("n_links"))
        seqs = dealt.where("no is null").select(F.col("portion").alias("dealt"), F.col("times").alias("words"), "id", "seq")
        out = seqs.groupBy("dealt").cogroup(answers.groupBy("portion")).applyInArrow(gather, schema)
        return scratch.end(out, "alignment").withColumnRenamed("id", id_col)


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"), with_groups=False)
