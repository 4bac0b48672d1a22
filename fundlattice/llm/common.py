"""What several operators share: reading tables, stored intermediate results, text batches."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a Python worker gets at once in small_batches().
BATCH_SETTING, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1_000
#: Files that a task of stash_by() writes side by side; rows are sorted by bucket only if it has more.
WRITERS = "spark.sql.maxConcurrentOutputFileWriters"
#: See join_frequent.
FREQUENT_SHARE = 10_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only in local mode, where all share one machine, may it be unset: then a temporary folder is made, and removed at
    exit. A cluster without the setting is an error, as each machine would write to a folder of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    own = tempfile.mkdtemp(prefix="fundlattice-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{own}")
    return f"file://{own}"


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 0):
    """Jobs that begin meanwhile give Python workers so many rows (BATCH_ROWS) at a time, as texts and arrays of members are long."""
    before = spark.conf.get(BATCH_SETTING)
    spark.conf.set(BATCH_SETTING, min(int(before), rows or BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(BATCH_SETTING, before)


def stash(df: DataFrame, tag: str, rows: int = 0) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back.

    That cuts the lineage and fixes the rows: a lost executor costs a re-read, not a recomputation.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    with small_batches(spark, rows):
        df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._stash_path = path
    return back


def stash_by(df: DataFrame, key: str, buckets: int, tag: str) -> DataFrame:
    """As stash(), with rows that lie by key when they are read, so that windows, joins and groups by it need no exchange.

    Nothing is exchanged to write it either; where a task holds few keys it writes few files.
    """
    spark, name = df.sparkSession, f"{tag}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    before = spark.conf.get(WRITERS)
    spark.conf.set(WRITERS, 8)
    try:
        df.write.format("parquet").bucketBy(buckets, key).option("path", path).saveAsTable(name)
    finally:
        spark.conf.set(WRITERS, before)
    back = spark.table(name)
    back._stash_path, back._stash_table = path, name
    return back


def unstash(df: DataFrame) -> None:
    """Deletes what stash() or stash_by() wrote for df; later reads of df fail."""
    path = getattr(df, "_stash_path", None)
    if getattr(df, "_stash_table", None):
        df.sparkSession.sql(f"DROP TABLE IF EXISTS {df._stash_table}")
    if path:
        jvm = df.sparkSession._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """The stored tables of one operator: each can be dropped once it is used up, and the end drops all."""

    def __init__(self):
        self.held: list[DataFrame] = []

    def hold(self, df: DataFrame) -> DataFrame:
        self.held.append(df)
        return df

    def keep(self, df: DataFrame, tag: str) -> DataFrame:
        return self.hold(stash(df, tag))

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            unstash(df)
        self.held = [h for h in self.held if all(h is not df for df in frames)]

    def end(self, df: DataFrame, tag: str) -> DataFrame:
        """df, stored; whatever else was stored is deleted."""
        out = stash(df, tag)
        self.drop(*self.held)
        return out


def join_frequent(rows: DataFrame, by: DataFrame, keys: list[str], scratch: Scratch) -> DataFrame:
    """Inner join of rows with `by`, which is unique in keys, where a key may hold a large share of the rows.

    Keys of more than one row in FREQUENT_SHARE, of which there are fewer than that, are broadcast with what `by` has for
    them; so the shuffled join of the other rows has no hot key.
    """
    counts = scratch.keep(rows.groupBy(*keys).count(), "counts")
    total = counts.agg(F.sum("count")).first()[0] or 0
    often = F.broadcast(counts.where(F.col("count") * FREQUENT_SHARE > total).drop("count"))
    return rows.join(F.broadcast(by.join(often, keys)), keys).unionAll(rows.join(often, keys, "left_anti").join(by, keys).select(*rows.join(by, keys).columns))


def free_name(columns: list[str], name: str) -> str:
    """name, with underscores put before it until no column is called so."""
    while name.lower() in (c.lower() for c in columns):
        name = "_" + name
    return name


def text_portions(batches, column: int, most_bytes: int, most_texts: int = 1_024, raw: bool = False):
    """(part of a batch, its texts) for batches with texts in a column; a part holds one text, or so many bytes and texts.

    Only one part's texts are Python strings (UTF-8 bytes with raw) at a time; null texts are empty.
    """
    none = b"" if raw else ""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy()
        begin = 0
        while begin < len(size):
            fits = int(np.searchsorted(np.cumsum(size[begin : begin + most_texts]), most_bytes, side="right"))
            part = batch.slice(begin, max(1, fits))
            texts = part.column(column).cast(pa.binary()) if raw else part.column(column)
            yield part, [t or none for t in texts.to_pylist()]
            begin += part.num_rows


def slices(texts: list[str], most: int = 2_000_000):
    """(first, end) ranges of texts with at most that many characters together, or one text."""
    begin = total = 0
    for i, text in enumerate(texts):
        if total and total + len(text) > most:
            yield begin, i
            begin, total = i, 0
        total += len(text)
    if begin < len(texts):
        yield begin, len(texts)
