"""Holdings of several years: one folder for each year, whose columns and types may differ from those of other years."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: names that a column goes by in one year or another, and how far back holdings are looked for
NAMES = {"fund": ("fund", "基金代码"), "stock": ("stock", "股票代码"), "name": ("name", "股票名称"), "quarter": ("quarter", "季度"), "weight_pct": ("weight_pct", "占净值比例")}
NEEDED = ("fund", "stock", "quarter")
YEARS_BACK = 4


def write_years(h: DataFrame, path: str) -> None:
    """Holdings (quarter: a text that names its year) as year=<y> folders under path. Rows without a year are left out.

    A year that holds most rows is split among tasks.
    """
    years = h.withColumn("year", F.regexp_extract("quarter", r"(\d{4})年", 1).try_cast("int")).where("year is not null")
    years.hint("rebalance", "year").write.partitionBy("year").parquet(path)


def _folder(spark: SparkSession, path: str, year: int) -> str | None:
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/year={year}")
    return f"{path}/year={year}" if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place) else None


def _column(df: DataFrame, name: str) -> Column:
    """The column under the first of its names that a year has, as text or number; null where it has none."""
    found = next((c for c in NAMES[name] if c in df.columns), None)
    kind = "double" if name == "weight_pct" else "string"
    x = F.lit(None).cast(kind) if found is None else F.col(f"`{found}`").cast("string").try_cast(kind)
    return (F.coalesce(x, F.lit(0.0)) if name == "weight_pct" else x).alias(name)


def holdings_of_years(spark: SparkSession, path: str, newest: int, back: int = YEARS_BACK) -> DataFrame:
    """SRC-20: fund, stock, name, quarter, weight_pct of the year newest and those before it, back years in all, united by name.

    Only the folders of these years are listed and read. A year without a folder is passed over, as is one that lacks a column
    of NEEDED; weights that are missing or no numbers are 0. Without any year there are no rows.
    """
    parts = []
    for year in range(newest, newest - back, -1):
        folder = _folder(spark, path, year)
        df = spark.read.option("basePath", path).parquet(folder) if folder else None
        if df is not None and all(any(c in df.columns for c in NAMES[n]) for n in NEEDED):
            parts.append(df.select(*[_column(df, n) for n in NAMES]))
    schema = ", ".join(f"{n} {'double' if n == 'weight_pct' else 'string'}" for n in NAMES)
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)
