"""Instrument panels and related tables derived from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def by_code() -> Window:
    return Window.partitionBy("code").orderBy("d")


def index_panel(panel: DataFrame) -> DataFrame:
    """code, d, nav plus i (0-based row of the code) and r (daily return; null in the first row).

    Rows without a date or a value above 0 are left out (FLT-3). Daily returns that the panel gives in percent are
    preferred to those of its values (IND-0).
    """
    w = by_code()
    given = "daily_ret_pct" in panel.columns
    r = F.col("daily_ret_pct") / 100 if given else F.col("nav") / F.lag("nav").over(w) - 1
    return panel.where("d is not null and nav > 0").select("code", "d", "nav", (F.row_number().over(w) - 1).alias("i"), r.alias("r"))


def nav_panel(spark: SparkSession, sf_dir: str, warm_up: int = 60) -> DataFrame:
    """A net-asset-value series for each order priority: the 60-row mean of daily order values.

    Sums are of whole cents, so they do not depend on the order of addition. Orders are summed by day before
    the series is ordered; only those sums are shuffled by code.
    """
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    daily = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("code"), F.to_date("o_orderdate").alias("d")).agg(F.sum(cents).alias("cents"), F.count("*").alias("n"))
    w = by_code()
    w60 = w.rowsBetween(-(warm_up - 1), 0)
    nav = F.sum("cents").over(w60).cast("double") / (F.sum("n").over(w60).cast("double") * 25_000_000.0)
    rows = daily.select("code", "d", F.row_number().over(w).alias("rn"), nav.alias("nav")).where(F.col("rn") >= warm_up)
    return index_panel(rows)


def price_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily mean unit price of each brand: stock, d, close."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("stock")), "l_partkey")
    cents = F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).cast("double")
    return lines.groupBy("stock", F.to_date("l_shipdate").alias("d")).agg((cents / F.sum(F.col("l_quantity").cast("long")).cast("double") / 100).alias("close"))


def holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of brands in each supplier nation by quarter: fund, stock, quarter (text), weight_pct."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    brands = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("stock"))
    nations = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("fund"))
    quarter = F.concat(F.year("l_shipdate").cast("string"), F.lit("年"), F.quarter("l_shipdate").cast("string"), F.lit("季度股票投资明细"))
    sums = lines.join(brands, "l_partkey").join(nations, "l_suppkey").groupBy("fund", "stock", quarter.alias("quarter")).agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("cents"))
    total = F.sum("cents").over(Window.partitionBy("fund", "quarter"))
    return sums.select("fund", "stock", "quarter", (F.col("cents").cast("double") / total * 100).alias("weight_pct"))


#: The same tables for the comparison engine.
NAV_SQL = """
daily AS (SELECT o_orderpriority AS code, CAST(o_orderdate AS DATE) AS d, sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS cents, count(*) AS n FROM orders GROUP BY 1, 2),
nav0 AS (SELECT code, d, row_number() OVER (PARTITION BY code ORDER BY d) AS rn,
  CAST(sum(cents) OVER w AS DOUBLE) / (CAST(sum(n) OVER w AS DOUBLE) * 25000000.0) AS nav
  FROM daily WINDOW w AS (PARTITION BY code ORDER BY d ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)),
nav AS (SELECT code, d, nav, row_number() OVER (PARTITION BY code ORDER BY d) - 1 AS i, nav / lag(nav) OVER (PARTITION BY code ORDER BY d) - 1 AS r FROM nav0 WHERE rn >= 60)"""
PRICE_SQL = """
prices AS (SELECT p_brand AS stock, CAST(l_shipdate AS DATE) AS d,
  CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) / 100 AS close
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""
HOLDINGS_SQL = """
h0 AS (SELECT s_nationkey AS fund, p_brand AS stock, year(l_shipdate) || '年' || quarter(l_shipdate) || '季度股票投资明细' AS quarter,
  sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS cents FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2, 3),
holdings AS (SELECT fund, stock, quarter, CAST(cents AS DOUBLE) / sum(cents) OVER (PARTITION BY fund, quarter) * 100 AS weight_pct FROM h0)"""
