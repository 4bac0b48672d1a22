"""A keyed table in files: rows lie in buckets of their key, and a change writes the buckets that it hits anew."""

from __future__ import annotations

import atexit
import json
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fundlattice.operators.portfolio import dedup_last_wins, valid_codes


def shared_path(spark: SparkSession, name: str) -> str:
    """A place of that name in the folder that driver and executors share; in local mode without such a setting a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="fundlattice-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        found = f"file://{own}"
    return f"{found}/{name}"


class Conflict(Exception):
    """Another writer has changed the table since this one read it."""


class KeyedStore:
    """SNK-1 to SNK-3, SRC-24 at the scale of a table: at most one row for each key.

    <path>/data/<change>/bucket=<n> holds Parquet files, and <path>/manifest/<number> names the folder of each bucket. The manifest
    with the largest number is the table. A change reads and writes only the buckets of its keys, into a new
    folder, and then puts the next manifest in place by a rename that fails if there is one. So readers see the table
    before or after a change, a writer that dies leaves files that no manifest names (see vacuum), and of two writers that meet one gets
    a Conflict and can try again. Rows stay on the executors; the driver handles bucket numbers. Null keys are refused.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str = "code", buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path, key, buckets
        self.schema = spark.createDataFrame([], schema).schema
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _place(self, *parts: str):
        return self.jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def _numbers(self) -> list[int]:
        where = self._place("manifest")
        fs = where.getFileSystem(self.conf)
        return sorted(int(f.getPath().getName()) for f in fs.listStatus(where) if f.getPath().getName().isdigit()) if fs.exists(where) else []

    def manifest(self, number: int | None = None) -> tuple[int, dict[str, str]]:
        """(its number, the folder of each bucket that has rows); number 0 is the empty table. An older number gives the table as it was."""
        number = number if number is not None else max(self._numbers(), default=0)
        if not number:
            return 0, {}
        return number, json.loads("".join(r[0] for r in self.spark.read.text(f"{self.path}/manifest/{number:09d}").collect()))

    def _commit(self, number: int, folders: dict[str, str]) -> None:
        target, temporary = self._place("manifest", f"{number:09d}"), self._place("manifest", f".{uuid.uuid4().hex}")
        fs = target.getFileSystem(self.conf)
        out = fs.create(temporary, True)
        out.write(bytearray(json.dumps(folders).encode()))
        out.close()
        rename = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.NONE
        try:
            self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.conf).rename(temporary, target, options)
        except Exception as e:
            fs.delete(temporary, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"manifest {number} is there already") from None
            raise

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _rows(self, folders: dict[str, str]) -> DataFrame:
        paths = [f"{self.path}/data/{folder}/bucket={b}" for b, folder in sorted(folders.items())]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self, number: int | None = None) -> DataFrame:
        return self._rows(self.manifest(number)[1])

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The rows of some keys; other buckets aren't read."""
        hit = {str(r[0]) for r in keys.select(self.bucket()).distinct().collect()}
        rows = self._rows({b: f for b, f in self.manifest()[1].items() if b in hit})
        return rows.join(keys.select(self.key).distinct(), self.key, "left_semi")

    def _change(self, keys: DataFrame, build) -> tuple[int, dict[str, str]]:
        """Puts build(rows of the buckets of keys) in the place of these rows."""
        number, folders = self.manifest()
        hit = {str(r[0]) for r in keys.select(self.bucket()).distinct().collect()}
        if not hit:
            return number, folders
        change = uuid.uuid4().hex
        rows = build(self._rows({b: f for b, f in folders.items() if b in hit}))
        rows.select(*self.schema.names).withColumn("bucket", self.bucket()).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/data/{change}")
        fs = self._place("data", change).getFileSystem(self.conf)
        written = {f.getPath().getName().removeprefix("bucket=") for f in fs.listStatus(self._place("data", change)) if f.getPath().getName().startswith("bucket=")}
        folders = {b: f for b, f in folders.items() if b not in hit} | dict.fromkeys(written, change)
        self._commit(number + 1, folders)
        return number + 1, folders

    def upsert(self, new: DataFrame, order: str | None = None) -> None:
        """SNK-2: rows of new replace those with their key. Of several rows of new with one key the last by `order` counts."""
        if new.where(F.col(self.key).isNull()).limit(1).count():
            raise ValueError(f"{self.key} is null")
        new = dedup_last_wins(new, self.key, order).drop("place") if order else new.dropDuplicates([self.key])
        new = new.select(*[F.col(f.name).cast(f.dataType) if f.name in new.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema])
        self._change(new, lambda old: old.join(new, self.key, "left_anti").unionByName(new))

    def delete(self, keys: DataFrame) -> DataFrame:
        """SNK-3: deletes the rows of some keys; returns the keys that had none. Buckets that none of the keys lie in stay."""
        keys = keys.select(self.key).where(F.col(self.key).isNotNull()).distinct()
        absent = keys.join(self.lookup(keys), self.key, "left_anti")
        path = f"{self.path}/absent/{uuid.uuid4().hex}"
        absent.write.parquet(path)  # as it was before the change
        self._change(keys, lambda old: old.join(keys, self.key, "left_anti"))
        return self.spark.read.schema(absent.schema).parquet(path)

    def load_json(self, source: str) -> DataFrame:
        """SRC-24: upserts the items of {"funds": [...]} files; returns what was unfit, and keeps it under <path>/quarantine: source, record.

        Files that aren't JSON or have no such list, and items without a valid code, are unfit. Of items with one code the last of a file, and
        the last file by name, counts. A source that isn't there holds nothing.
        """
        where = self.jvm.org.apache.hadoop.fs.Path(source)
        fs = where.getFileSystem(self.conf)
        unfit = self.spark.createDataFrame([], "source string, record string")
        if fs.exists(where):
            kind = f"struct<{', '.join(f'{f.name}: {f.dataType.simpleString()}' for f in self.schema)}>"
            files = self.spark.read.schema("funds array<string>, _corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").option("multiLine", True).json(source)
            files = files.select("funds", "_corrupt", F.input_file_name().alias("source")).persist()
            try:
                items = files.select("source", F.posexplode("funds").alias("place", "record"))
                items = items.withColumn("x", F.from_json("record", kind)).select("source", "place", "record", "x.*").withColumn(self.key, F.trim(self.key))
                good = valid_codes(items, self.key)
                bad = items.where(~F.coalesce(F.trim(self.key).rlike("^[0-9]{5,6}$"), F.lit(False))).select("source", "record")
                unfit = files.where("funds is null").select("source", F.coalesce("_corrupt", F.lit("")).alias("record")).unionAll(bad)
                path = f"{self.path}/quarantine/{uuid.uuid4().hex}"
                unfit.write.parquet(path)
                unfit = self.spark.read.schema(unfit.schema).parquet(path)
                self.upsert(good.withColumn("ord", F.struct("source", "place")).drop("source", "place", "record"), order="ord")
            finally:
                files.unpersist()
        return unfit

    def vacuum(self, keep: int = 1) -> int:
        """Deletes files of buckets that none of the last `keep` manifests names, and older manifests; how many buckets went. Not beside a writer."""
        numbers = self._numbers()
        named = {(folder, b) for n in numbers[-keep:] for b, folder in self.manifest(n)[1].items()}
        where = self._place("data")
        fs, gone = where.getFileSystem(self.conf), 0
        for f in fs.listStatus(where) if fs.exists(where) else []:
            folder = f.getPath().getName()
            buckets = [b.getPath() for b in fs.listStatus(f.getPath()) if b.getPath().getName().startswith("bucket=")]
            old = [b for b in buckets if (folder, b.getName().removeprefix("bucket=")) not in named]
            for b in [f.getPath()] if len(old) == len(buckets) else old:
                fs.delete(b, True)
            gone += len(old)
        for n in numbers[:-keep]:
            fs.delete(self._place("manifest", f"{n:09d}"), False)
        return gone
