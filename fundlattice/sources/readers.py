"""Scans and normalisers: columns under many names, quotes and estimates as text, portfolios as JSON, fallbacks."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# fixed values: names under which sources give each column
CANDIDATES = {
    "nav_date": ["净值日期", "date", "日期", "time", "净值日", "交易日期", "Date", "nav_date"],
    "unit_nav": ["单位净值", "nav", "netvalue", "单位", "净值", "dwjz", "NAV", "unit_nav"],
    "acc_nav": ["累计净值", "accumulatednav", "累计", "ljjz", "acc_nav", "累计单位净值"],
    "daily_ret_pct": ["日增长率", "dailyreturn", "增长率", "日涨幅", "涨跌幅", "rzzl", "change_pct", "日增长"],
}
USER_FUND = "code string, cost_nav double, holding_amount double, holding_units double, is_dca boolean, monthly_dca_amount double, max_loss_percent double, holding_horizon string, risk_preference string, planned_buy_amount double, note string"


def _plain(name: str) -> str:
    return name.lower().translate(str.maketrans("", "", "_()."))


def find_column(columns: Sequence[str], names: Sequence[str]) -> str | None:
    """The first column that has one of the names; else the first that holds one, case and marks aside."""
    exact = (c for c in columns if c.strip() in names)
    close = (c for c in columns for n in names if _plain(n) == _plain(c) or (len(n) >= 3 and _plain(n) in _plain(c)))
    return next(exact, next(close, None))


def normalise_nav(df: DataFrame, code: Column | None = None) -> DataFrame:
    """SRC-8, FLT-2: code, nav_date, unit_nav, acc_nav, daily_ret_pct; rows without a date or value are dropped.

    A missing daily return is derived from the order of dates. Of several rows for one date the largest value stays.
    """
    left, found = list(df.columns), {}
    for target, names in CANDIDATES.items():
        if (c := find_column(left, names)) is not None:
            found[target] = c
            left.remove(c)
    key = code if code is not None else F.col("code")
    number = lambda t: F.col(f"`{found[t]}`").try_cast("double") if t in found else F.lit(None).cast("double")
    out = df.select(key.alias("code"), F.col(f"`{found['nav_date']}`").cast("string").try_cast("timestamp").cast("date").alias("nav_date"), number("unit_nav").alias("unit_nav"), number("acc_nav").alias("acc_nav"), number("daily_ret_pct").alias("daily_ret_pct"))
    out = out.where("nav_date is not null and unit_nav is not null")
    out = out.groupBy("code", "nav_date").agg(F.max_by(F.struct("unit_nav", "acc_nav", "daily_ret_pct"), "unit_nav").alias("x")).select("code", "nav_date", "x.*")
    if "daily_ret_pct" not in found:
        out = out.withColumn("daily_ret_pct", (F.try_divide(F.col("unit_nav"), F.lag("unit_nav").over(Window.partitionBy("code").orderBy("nav_date"))) - 1) * 100)
    return out


def with_fallback(sources: Sequence[DataFrame], enough: int = 5, least: int = 2) -> DataFrame:
    """SRC-1: for each code the first source with `enough` rows, else the longest with at least `least`.

    Sources are united with their place; counts by code and source are small and are joined back.
    """
    united = None
    for n, df in enumerate(sources):
        tagged = df.withColumn("__source", F.lit(n))
        united = tagged if united is None else united.unionByName(tagged)
    counts = united.groupBy("code", "__source").agg(F.count("*").alias("__n")).where(F.col("__n") >= least)
    order = Window.partitionBy("code").orderBy(F.desc(F.col("__n") >= enough), F.when(F.col("__n") >= enough, F.col("__source")), F.desc("__n"), "__source")
    chosen = counts.withColumn("__rank", F.row_number().over(order)).where("__rank = 1").select("code", "__source")
    return united.join(chosen, ["code", "__source"]).drop("__source")


def parse_quotes(lines: DataFrame, col: str = "value") -> DataFrame:
    """SRC-6: quote lines like v_sh510300="1~name~code~price~previous~..."; lines with fewer than 10 fields are dropped."""
    body = F.trim(F.regexp_extract(col, "=(.*)$", 1))
    fields = F.split(F.regexp_replace(body, "^[\"']+|[\"';]+$", ""), "~")
    x = lines.select(fields.alias("f")).where(F.size("f") >= 10)
    price, before = F.col("f")[3].try_cast("double"), F.col("f")[4].try_cast("double")
    return x.select(F.col("f")[2].alias("code"), F.col("f")[1].alias("name"), price.alias("price"), before.alias("prev_close"), F.when(before > 0, (price - before) / before * 100).alias("change_pct"))


def parse_estimates(lines: DataFrame, col: str = "value") -> DataFrame:
    """SRC-7: estimates like jsonpgz({...}); lines without one, or without a name, are dropped."""
    schema = "fundcode string, name string, jzrq string, dwjz string, gsz string, gszzl string, gztime string"
    x = lines.select(F.from_json(F.regexp_extract(col, r"jsonpgz\((.+)\)", 1), schema).alias("x")).select("x.*").where("name <> ''")
    return x.select(F.col("fundcode").alias("code"), "name", F.try_to_date("jzrq").alias("nav_date"), *[F.col(a).try_cast("double").alias(b) for a, b in (("dwjz", "unit_nav"), ("gsz", "estimated_nav"), ("gszzl", "estimated_change_pct"))], F.col("gztime").alias("estimate_time"))


def exchange(code: Column) -> Column:
    """SRC-11."""
    return F.when(code.rlike("^[569]"), "sh").otherwise("sz")


def exchange_symbol(code: Column) -> Column:
    """SRC-23: six digits with the exchange's prefix."""
    c = F.lpad(F.trim(code), 6, "0")
    return F.concat(F.when(c.rlike("^[569]"), "sh").when(c.rlike("^[48]"), "bj").otherwise("sz"), c)


def load_user_funds(spark: SparkSession, path: str) -> tuple[DataFrame, bool]:
    """SRC-24: (the cleaned rows of a {"funds": [...]} file, whether the file was readable).

    A missing, broken or wrongly shaped file gives no rows; the latter two are copied to <path>.bad. Items that are no objects, or have no valid code, are
    dropped; of rows with one code the last stays, at the place of the first. Missing files are told apart by Hadoop.
    """
    from fundlattice.operators.portfolio import dedup_last_wins, valid_codes

    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    empty = spark.createDataFrame([], USER_FUND + ", place long")
    conf = spark._jsc.hadoopConfiguration()
    fs = where.getFileSystem(conf)
    if not fs.exists(where):
        return empty, True
    text = "".join(r[0] for r in spark.read.text(path, wholetext=True).collect())  # one settings file of a user
    try:
        funds = json.loads(text)["funds"]
        items = [json.dumps(f) for f in funds if isinstance(f, dict)]
    except (ValueError, TypeError, KeyError):
        jvm.org.apache.hadoop.fs.FileUtil.copy(fs, where, fs, jvm.org.apache.hadoop.fs.Path(path + ".bad"), False, True, conf)
        return empty, False
    rows = spark.createDataFrame(list(enumerate(items)), "ord long, item string").select("ord", F.from_json("item", USER_FUND).alias("x")).select("ord", "x.*")
    return dedup_last_wins(valid_codes(rows)).select(*empty.columns), True


def save_user_funds(df: DataFrame, path: str) -> None:
    """SNK-1: the file is written beside its place and then renamed over it, so readers see the old one or the new."""
    rows = df.toJSON().collect()  # one settings file of a user
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    target, temporary = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(path + ".tmp")
    fs = target.getFileSystem(conf)
    out = fs.create(temporary, True)
    out.write(bytearray(('{"funds": [' + ", ".join(rows) + "]}").encode()))
    out.close()
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = df.sparkSession.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf).rename(temporary, target, options)


def pivot_profile(kv: DataFrame, aliases: DataFrame, fields: Sequence[str]) -> DataFrame:
    """SRC-13, JOIN-11: (code, item, value, ord) to one row for each code; a name matches a key that holds it or that it holds.

    aliases (field, alias) is a short fixed list, so its side is broadcast.
    """
    met = kv.join(F.broadcast(aliases), F.col("item").contains(F.col("alias")) | F.col("alias").contains(F.col("item"))).where("value <> ''")
    return met.groupBy("code").pivot("field", list(fields)).agg(F.min_by("value", "ord"))


def profile_quality(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """SRC-12: good from 70 % filled, partial from 30 %, else limited."""
    filled = sum((F.col(c).isNotNull().cast("int") for c in fields), F.lit(0)) / len(fields)
    return df.withColumn("data_quality", F.when(filled >= 0.7, "good").when(filled >= 0.3, "partial").otherwise("limited"))


def source_status(df: DataFrame) -> DataFrame:
    """SRC-25: by code and source, whether it gave rows, and how many."""
    return df.groupBy("code", "source").agg(F.count("nav").alias("n")).select("code", "source", (F.col("n") > 0).alias("available"), F.left(F.concat(F.col("n").cast("string"), F.lit(" rows")), F.lit(100)).alias("detail"))


def search(df: DataFrame, keyword: str, most: int = 20) -> DataFrame:
    """SRC-10: the first `most` names that hold the keyword, by code."""
    return df.where(F.contains("name", F.lit(keyword))).orderBy("code").limit(most)


def strip_fence(text: Column) -> Column:
    """DEC-5: what stands between code fences, or the text."""
    inner = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    return F.regexp_replace(F.when(inner != "", inner).otherwise(text), r"^\s+|\s+$", "")
