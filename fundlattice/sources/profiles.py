"""Fund dimensions, profiles and market snapshots put together from several sources."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fundlattice.sources.readers import find_column

# fixed values: words in a fund's kind and the sectors to look at; the first that fits
SECTORS = (("消费|白酒", ("consumer",)), ("医药|医疗", ("healthcare",)), ("科技|TMT", ("technology",)), ("金融|银行", ("finance",)))
DEFAULT_SECTORS = ("consumer", "technology")


def first_known(frames: Sequence[DataFrame], fields: Sequence[str], key: str = "code") -> DataFrame:
    """SRC-2, SRC-4, SRC-9, SRC-12: for each key of any source and each field, the first source's value that is known.

    Empty texts and the word "unavailable" count as unknown. Sources are united with their place and summed up
    once, so that any number of them costs one exchange.
    """
    known = lambda c: F.when((F.trim(F.col(c)) != "") & (F.col(c) != "unavailable"), F.col(c))
    tagged = [df.select(key, *[(known(f) if f in df.columns else F.lit(None).cast("string")).alias(f) for f in fields], F.lit(n).alias("__n")) for n, df in enumerate(frames)]
    united = reduce(DataFrame.unionByName, tagged)
    return united.groupBy(key).agg(*[F.min_by(f, F.when(F.col(f).isNotNull(), F.col("__n"))).alias(f) for f in fields])


def short_profile(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """SRC-16, SRC-5: the code and these fields, "unavailable" where a field is missing or not known."""
    return df.select("code", *[(F.coalesce(F.col(f).cast("string"), F.lit("unavailable")) if f in df.columns else F.lit("unavailable")).alias(f) for f in fields])


def company_of(items: DataFrame) -> DataFrame:
    """SRC-3: the first value, in order, of an item whose name holds 公司."""
    return items.where(F.contains("item", F.lit("公司")) & (F.col("value") != "")).groupBy("code").agg(F.min_by("value", "ord").alias("company"))


def one_year_return(panel: DataFrame, ranks: DataFrame | None = None) -> DataFrame:
    """SRC-15: the ranked return where there is one, else the last value against that 249 rows before."""
    w = Window.partitionBy("code").orderBy("d")
    own = panel.withColumn("x", (F.col("nav") / F.lag("nav", 249).over(w) - 1) * 100).groupBy("code").agg(F.max_by(F.struct("x"), "d").alias("x")).select("code", F.col("x.x").alias("own"))
    if ranks is None:
        return own.select("code", F.col("own").alias("return_1y"))
    return own.join(ranks.select("code", F.col("return_1y").alias("ranked")), "code", "full").select("code", F.coalesce("ranked", "own").alias("return_1y"))


def normalise_prices(df: DataFrame, stock: Column) -> DataFrame:
    """SRC-22: stock, d, close, above 0, one row for each date (the largest of several)."""
    d, close = find_column(df.columns, ["日期", "date", "交易日期", "净值日期"]), find_column(df.columns, ["收盘", "close", "收盘价"])
    out = df.select(stock.alias("stock"), F.col(f"`{d}`").cast("string").try_cast("timestamp").cast("date").alias("d"), F.col(f"`{close}`").try_cast("double").alias("close"))
    return out.where("d is not null and close > 0").groupBy("stock", "d").agg(F.max("close").alias("close"))


def date_range(panel: DataFrame) -> DataFrame:
    """SRC-26: ten days before the first date and one after the last, as yyyyMMdd."""
    text = lambda c: F.date_format(c, "yyyyMMdd")
    return panel.groupBy("code").agg(text(F.date_sub(F.min("d"), 10)).alias("start"), text(F.date_add(F.max("d"), 1)).alias("end"))


def padded(expected: DataFrame, rows: DataFrame, keys: Sequence[str] = ("category", "name")) -> DataFrame:
    """SRC-17, SRC-18: the newest row of every expected name; names without one are "unavailable"."""
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct("latest", "change_pct", "as_of"), "as_of").alias("x")).select(*keys, "x.*", F.lit("ok").alias("status"))
    return expected.join(newest, list(keys), "left").withColumn("status", F.coalesce("status", F.lit("unavailable")))


def sectors(kinds: DataFrame) -> DataFrame:
    """SRC-19: the sectors to look at for each fund_type; their figures are always unavailable."""
    names = F.array(*map(F.lit, DEFAULT_SECTORS))
    for words, found in reversed(SECTORS):
        names = F.when(F.col("fund_type").rlike(words), F.array(*map(F.lit, found))).otherwise(names)
    return kinds.select("code", F.explode(names).alias("sector"), F.lit(0.0).alias("change_pct"), F.lit("unavailable").alias("status"))
