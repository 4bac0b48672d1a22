"""A corpus pipeline of four stages over the documents table.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept. Stages that filter or
rewrite return the columns of docs; the last returns packed pieces. Empty tables give empty results, and
rows are never dropped but by the decisions that the stages state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fundlattice.llm.common import free_name, stash, unstash
from fundlattice.llm.langid import SIGNIFICANT, bars, held_out, identify, learn
from fundlattice.llm.packing import pack
from fundlattice.llm.secrets import redact_secrets
from fundlattice.llm.shingle_join import BROADCAST_IDS, join_groups


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach; a missing lang is filled in.

    Rejected are texts that are null or without a letter, and foreign ones: those less like every learned language than
    so many letters of it are, by a bar that the labelled rows of each language set (langid.bars). A missing
    lang is filled in where the score tells it from chance, and stays null elsewhere. Without labelled documents only
    texts without letters go. A very long text is read whole, in one task's memory.
    What is kept is stored, as only here it can be said that Python gets few of the long texts at a time.
    """
    labelled = docs.where(~held_out())
    prototypes = learn(labelled)
    lang, score, effective, foreign = (free_name(docs.columns, n) for n in ("_lang", "_score", "_effective", "_foreign"))
    found = identify(docs, prototypes, keep=tuple(docs.columns), out=(lang, score, effective), least=bars(labelled, prototypes) if prototypes else None, foreign=foreign)
    kept = found.where((F.col(effective) > 0) & ~F.col(foreign))
    if prototypes:
        told = F.when(F.col(score) >= SIGNIFICANT, F.col(lang))
        kept = kept.withColumn("lang", F.coalesce("lang", told))
    return stash(kept.select(*docs.columns), "identified")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that share 80 % of their five-word shingles, the one with the smallest doc_id.

    Rows with a null doc_id, and texts without words, stay. Where a group's smallest doc_id occurs in several of
    its rows, one of them stays. Rows that share a doc_id but not a group are judged apart.
    """
    known = docs.where("doc_id is not null")
    if not known.groupBy("doc_id").count().where("count > 1").limit(1).count():
        groups = join_groups(known, k=5, percent=80)
        rows, key = docs, "doc_id"
        dropped = groups.where("doc_id <> component_id").select("doc_id")
    else:  # rows get numbers, which tell apart those with one doc_id
        key = free_name(docs.columns, "_row")
        rows = stash(docs.withColumn(key, F.monotonically_increasing_id()), "rows")
        groups = join_groups(rows.where("doc_id is not null"), k=5, percent=80, row_col=key)
        linked = groups.where("component_set is not null")
        first = linked.where("doc_id = component_id").groupBy("component_set").agg(F.min(key).alias(key))
        dropped = linked.join(first, key, "left_anti").select(key)
    dropped = F.broadcast(dropped) if dropped.count() <= BROADCAST_IDS else dropped
    return rows.join(dropped, key, "left_anti").select(*docs.columns)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts replaced."""
    return redact_secrets(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as tokens, packed into sequences: one row for each piece."""
    return pack(docs)


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("secret scans", redact),
    ("packing", pack_sequences),
]
#: The language model and the packing aren't expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, stage(spark, docs, sf_dir)
        if not hasattr(docs, "_stash_path"):
            docs = stash(docs, name.replace(" ", "-"))
        unstash(before)  # nothing but for what a stage before has stored
    return STAGES[-1][1](spark, docs, sf_dir)
