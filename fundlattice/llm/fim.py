"""Fill-in-middle: texts cut at two random token bounds and reordered; overlapping chunks find the bounds."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_portions

#: Bytes of a chunk, of texts that are counted together, and of a text whose chunks are counted by several tasks.
CHUNK, PORTION, LONG = 65_536, 2_000_000, 8_000_000
PREFIX, SUFFIX, MIDDLE = MARKS = ("<P>", "<S>", "<M>")
#: Percent of texts that are left plain, and of the others those that get the suffix first.
PLAIN_PERCENT, SPM_PERCENT = 10, 20

_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(65, 91), *range(97, 123)]] = True


def token_ends(raw: np.ndarray) -> np.ndarray:
    """Whether a token ends with each byte but the last, as it and its neighbour tell.

    A token is a run of letters A-Z and a-z or one other character: none ends between two letters or within a character.
    """
    letter = _LETTERS[raw]
    return ((raw[1:] & 0xC0) != 0x80) & ~(letter[:-1] & letter[1:])


def chunk_counts(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of chunks of each text, token ends of each chunk). A chunk sees the first byte of the next one."""
    sizes = np.array([len(t) for t in texts], np.int64)
    chunks = -(-sizes // size)
    if not chunks.sum():
        return chunks, np.empty(0, np.int64)
    ends = token_ends(np.frombuffer(b"".join(texts) + b" ", np.uint8))
    last = np.cumsum(sizes)[sizes > 0] - 1
    ends[last] = True
    first = np.repeat(np.cumsum(sizes) - sizes, chunks) + (np.arange(chunks.sum()) - np.repeat(np.cumsum(chunks) - chunks, chunks)) * size
    return chunks, np.add.reduceat(ends.astype(np.int64), first)


def cut_place(text: bytes, sums: np.ndarray, rank: int, size: int) -> int:
    """Bytes before the end of the token of that rank (from 1; 0 for none): sums routes it to a chunk, which alone is scanned.

    sums: the running sums of the token ends of the text's chunks.
    """
    if not rank:
        return 0
    chunk = int(np.searchsorted(sums, rank))
    seen = int(sums[chunk - 1]) if chunk else 0
    own = text[chunk * size : (chunk + 1) * size + 1]
    ends = np.flatnonzero(token_ends(np.frombuffer(own if len(own) > size else own + b" ", np.uint8)))
    return chunk * size + (int(ends[rank - seen - 1]) + 1 if rank - seen <= len(ends) else len(own))


def draws(seed: int, name: str) -> tuple[int, ...]:
    """Four numbers of 32 bits."""
    h = hashlib.sha256(f"{seed}:{name}".encode()).hexdigest()
    return tuple(int(h[k : k + 8], 16) for k in range(0, 32, 8))


def rearrange(name: str, text: bytes, ends: np.ndarray, seed: int, size: int) -> tuple:
    """(n, form, characters of the prefix, of the middle, output) of a text with the token ends of its chunks."""
    sums = np.cumsum(ends)
    n = int(sums[-1]) if len(sums) else 0
    one, two, plain, spm = draws(seed, name)
    if not text or plain % 100 >= 100 - PLAIN_PERCENT or any(m.encode() in text for m in MARKS):
        return n, "plain", None, None, text
    p, q = (cut_place(text, sums, r, size) for r in sorted((one % (n + 1), two % (n + 1))))
    prefix, middle, suffix = text[:p], text[p:q], text[q:]
    form = "spm" if spm % 100 < SPM_PERCENT else "psm"
    output = b"<S>%b<P>%b<M>%b" % (suffix, prefix, middle) if form == "spm" else b"<P>%b<S>%b<M>%b" % (prefix, suffix, middle)
    return n, form, len(prefix.decode("utf-8", "replace")), len(middle.decode("utf-8", "replace")), output


def restore(output: Column, form: Column) -> Column:
    """The text that an output was made from."""
    part = F.split(output, "|".join(MARKS), -1)
    return F.when(form == "plain", output).when(form == "psm", F.concat(part[1], part[3], part[2])).otherwise(F.concat(part[2], part[3], part[1]))


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, size: int = CHUNK, long: int = LONG) -> DataFrame:
    """id_col, n (tokens), form (plain, psm, spm), prefix_chars, middle_chars (null if plain), output.

    Random numbers come from SHA-256 of the seed and the id, so they don't depend on where a row lies. A text falls into
    overlapping chunks; a chunk's token ends follow from its adjacent characters alone, all chunks at once. Running sums over the
    chunks give the number of tokens and the chunk of each of both cuts, and only these chunks are scanned again.

    The chunks of a text of over `long` bytes are dealt to all tasks and counted there; the counts come back by the text's
    digest (equal texts share them). All other texts are counted where they lie, and nothing is shuffled; results are the
    same either way. A text's output is made in one task's memory.
    A null text is empty, and empty texts are plain with no tokens. A null id draws as the word null. One row for each
    row, repeated rows and ids included; an empty table gives none. Only id_col and text_col are read, so other columns' names don't matter.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("name"), F.coalesce(text_col, F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output string"
    large = F.octet_length("text") > long

    def table_of(part, found):
        n, form, p, m, output = zip(*found)
        kinds = pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()
        columns = [pa.array(x, k) for x, k in zip((n, form, p, m, [o.decode("utf-8", "replace") for o in output]), kinds)]
        return pa.RecordBatch.from_arrays([part.column(0), *columns], ["id", "n", "form", "prefix_chars", "middle_chars", "output"])

    def in_place(batches):
        for part, texts in text_portions(batches, 2, PORTION, raw=True):
            chunks, counts = chunk_counts(texts, size)
            ends = np.split(counts, np.cumsum(chunks)[:-1])
            yield table_of(part, [rearrange(name, t, e, seed, size) for name, t, e in zip(part.column(1).to_pylist(), texts, ends)])

    def spread(batches):
        for part, texts in text_portions(batches, 1, PORTION, raw=True):
            for digest, text in zip(part.column(0).to_pylist(), texts):
                for no, at in enumerate(range(0, len(text), size)):
                    yield pa.RecordBatch.from_pydict({"digest": [digest], "no": pa.array([no], pa.int64()), "chunk": [text[at : at + size + 1]]})

    def count(batches):
        for batch in batches:
            own = [np.frombuffer(c if len(c) > size else c + b" ", np.uint8) for c in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([int(token_ends(c).sum()) for c in own], pa.int64())], ["digest", "no", "n"])

    def with_counts(batches):
        for part, texts in text_portions(batches, 2, PORTION, raw=True):
            yield table_of(part, [rearrange(name, t, np.array(e, np.int64), seed, size) for name, t, e in zip(part.column(1).to_pylist(), texts, part.column(3).to_pylist())])

    dealt = rows.where(large).select(F.sha2("text", 256).alias("digest"), "text").mapInArrow(spread, "digest string, no long, chunk binary").repartition("digest", "no")
    counted = dealt.mapInArrow(count, "digest string, no long, n long").groupBy("digest").agg(F.transform(F.sort_array(F.collect_set(F.struct("no", "n"))), lambda c: c["n"]).alias("ends"))
    many = rows.where(large).withColumn("digest", F.sha2("text", 256)).join(counted, "digest").select("id", "name", "text", "ends").mapInArrow(with_counts, schema)
    return rows.where(~large).mapInArrow(in_place, schema).unionAll(many).withColumnRenamed("id", id_col)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = fill_in_middle(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


OP12_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS ts, sha256('1:' || doc_id) AS h FROM documents),
d AS (SELECT *, len(ts) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM t),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
        CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
             WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
c AS (SELECT doc_id, n, form, text, CASE WHEN a = 0 THEN '' ELSE array_to_string(ts[1:a], '') END AS p,
        CASE WHEN b = a THEN '' ELSE array_to_string(ts[a + 1:b], '') END AS m, CASE WHEN b = n THEN '' ELSE array_to_string(ts[b + 1:n], '') END AS s FROM f),
o AS (SELECT *, CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END AS output FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(output) AS output_sha256, sha256(text) AS restored_sha256
FROM o"""
