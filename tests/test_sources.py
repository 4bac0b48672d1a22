import pytest
from pyspark.sql import functions as F

from fundlattice.operators import joins
from fundlattice.sources import readers
from fundlattice.streaming import daily


def test_normaliser_finds_columns_and_derives_returns(spark):
    df = spark.createDataFrame([("2024-01-02", "1.1"), ("2024-01-01", "1.0"), ("bad", "1.2"), ("2024-01-03", "x"), ("2024-01-04", "1.21")], "`净值日期` string, `Unit_Nav(1)` string")
    out = readers.normalise_nav(df, F.lit("161725")).orderBy("nav_date").collect()
    assert [(str(r["nav_date"]), r["unit_nav"]) for r in out] == [("2024-01-01", 1.0), ("2024-01-02", 1.1), ("2024-01-04", 1.21)]
    assert [r["daily_ret_pct"] for r in out] == [None, pytest.approx(10), pytest.approx(10)]


def test_find_column_prefers_exact_names():
    assert readers.find_column(["my_date", "date"], ["date"]) == "date"
    assert readers.find_column(["x", "my_Date."], ["date"]) == "my_Date."
    assert readers.find_column(["x"], ["date"]) is None


def test_quotes_and_estimates(spark):
    lines = spark.createDataFrame([('v_sh510300="1~沪深300ETF~510300~3.850~3.800~5~6~7~8~9";',), ("junk",), ('v_x="1~2~3"',)], "value string")
    r = readers.parse_quotes(lines).collect()
    assert len(r) == 1 and r[0]["code"] == "510300" and r[0]["change_pct"] == pytest.approx(1.3157894)
    text = spark.createDataFrame([('jsonpgz({"fundcode":"161725","name":"n","jzrq":"2024-01-02","dwjz":"1.5","gsz":"1.6","gszzl":"x","gztime":"2024-01-03 10:00"});',), ("jsonpgz();",), ("",)], "value string")
    r = readers.parse_estimates(text).collect()
    assert len(r) == 1 and r[0]["estimated_nav"] == 1.6 and r[0]["estimated_change_pct"] is None


def test_exchange(spark):
    df = spark.createDataFrame([("510300",), ("161725",), ("600000",), ("830001",)], "c string")
    rows = df.select(readers.exchange(F.col("c")), readers.exchange_symbol(F.col("c"))).collect()
    assert [tuple(r) for r in rows] == [("sh", "sh510300"), ("sz", "sz161725"), ("sh", "sh600000"), ("sz", "bj830001")]


@pytest.mark.parametrize("text, codes, good", [("this is not json {{{", [], False), ('[{"code":"161725"}]', [], False), ('{"funds": [{"code":"161725","note":"a"}, "x", 3, null, {"code":"110022"}, {"code":"161725","note":"b"}, {"code":"12"}, {}]}', [("161725", "b"), ("110022", None)], True)])
def test_user_funds(spark, tmp_path, text, codes, good):
    path = tmp_path / "funds.json"
    path.write_text(text)
    df, readable = readers.load_user_funds(spark, f"file://{path}")
    assert readable is good and [(r["code"], r["note"]) for r in df.orderBy("place").collect()] == codes


def test_user_funds_survive_a_round_trip(spark, tmp_path):
    path = f"file://{tmp_path}/f.json"
    assert readers.load_user_funds(spark, path)[0].count() == 0
    df = spark.createDataFrame([("161725", 1.5)], "code string, cost_nav double")
    readers.save_user_funds(df, path)
    readers.save_user_funds(df.withColumn("cost_nav", F.lit(2.0)), path)
    rows = readers.load_user_funds(spark, path)[0].collect()
    assert [(r["code"], r["cost_nav"]) for r in rows] == [("161725", 2.0)]


def test_broken_portfolio_is_copied_aside(spark, tmp_path):
    (tmp_path / "f.json").write_text("{broken")
    df, readable = readers.load_user_funds(spark, f"file://{tmp_path}/f.json")
    assert not readable and df.count() == 0 and (tmp_path / "f.json.bad").read_text() == "{broken" and (tmp_path / "f.json").exists()


def test_rows_without_a_date_or_value_are_left_out(spark):
    from fundlattice.sources.panel import index_panel

    rows = [("a", "2024-01-01", 1.0, 9.0), ("a", "2024-01-02", 0.0, 8.0), ("a", None, 2.0, 7.0), ("a", "2024-01-03", -1.0, 6.0), ("a", "2024-01-04", 1.5, None), ("a", "2024-01-05", None, 5.0), ("a", "2024-01-06", 3.0, 4.0)]
    df = spark.createDataFrame(rows, "code string, d string, nav double, daily_ret_pct double").withColumn("d", F.to_date("d"))
    assert [(r["i"], r["nav"], r["r"]) for r in index_panel(df.drop("daily_ret_pct")).orderBy("i").collect()] == [(0, 1.0, None), (1, 1.5, 0.5), (2, 3.0, 1.0)]
    assert [(r["i"], r["r"]) for r in index_panel(df).orderBy("i").collect()] == [(0, 0.09), (1, None), (2, 0.04)]  # given returns are preferred


def test_first_distinct(spark):
    from fundlattice.functions.numeric import first_distinct

    df = spark.createDataFrame([(["b", "a", "b", "c", "d"],), ([],), (None,)], "x array<string>")
    assert [r[0] for r in df.select(first_distinct(F.col("x"), 3)).collect()] == [["b", "a", "c"], [], None]


def test_as_of_join_over_gaps(spark):
    from fundlattice.operators import joins

    left = spark.createDataFrame([("a", 1), ("a", 3), ("a", 6), ("b", 2)], "code string, d int")
    right = spark.createDataFrame([("a", 2, 5.0), ("a", 5, None), ("b", 2, 7.0), ("c", 1, 9.0)], "code string, d int, x double")
    got = {(r["code"], r["d"]): r["x"] for r in joins.as_of_join(left, right, values=("x",)).collect()}
    assert got == {("a", 1): None, ("a", 3): 5.0, ("a", 6): 5.0, ("b", 2): 7.0}
    assert {(r["code"], r["d"]): r["x"] for r in joins.as_of_join(left, right, values=("x",), fill=False).collect()}[("a", 6)] is None


def test_failures_are_rows(spark):
    from fundlattice.operators import documents

    known = spark.createDataFrame([("a", 300), ("b", 12)], "code string, data_days int")
    docs = spark.createDataFrame([("a", "{}")], "code string, document string")
    assert {r["code"]: (r["document"], r["error"]) for r in documents.with_failures(docs, known, 60).collect()} == {"a": ("{}", None), "b": (None, "历史净值样本不足（12 条，至少 60 条）")}
    quality = spark.createDataFrame([("a", "medium")], "code string, quality string")
    assert documents.batch_report(quality, known).first().asDict() == {"codes": 2, "n_high": 0, "n_medium": 1, "n_low": 0, "n_failed": 1}


def test_fallback_takes_the_first_source_with_enough(spark):
    make = lambda n, k: spark.createDataFrame([("a", i, k) for i in range(n)], "code string, i int, src string")
    pick = lambda *dfs: {r["src"] for r in readers.with_fallback(dfs).collect()}
    assert pick(make(3, "x"), make(6, "y")) == {"y"} and pick(make(3, "x"), make(4, "y")) == {"y"} and pick(make(5, "x"), make(9, "y")) == {"x"}


def test_profile(spark):
    kv = spark.createDataFrame([("1", "基金公司名称", "A", 0), ("1", "公司", "B", 1), ("1", "类型", "", 2)], "code string, item string, value string, ord int")
    aliases = spark.createDataFrame([("company", "基金公司"), ("type", "基金类型")], "field string, alias string")
    r = readers.profile_quality(readers.pivot_profile(kv, aliases, ["company", "type"]), ["company", "type"]).first()
    assert (r["company"], r["type"], r["data_quality"]) == ("A", None, "partial")


def test_strip_fence(spark):
    df = spark.createDataFrame([('```json\n{"a": 1}\n```',), ('{"a": 2}',)], "t string")
    assert [r[0] for r in df.select(readers.strip_fence(F.col("t"))).collect()] == ['{"a": 1}', '{"a": 2}']


def test_as_of_carries_whole_rows_then_fills(spark):
    left = spark.createDataFrame([("a", i, i) for i in range(1, 6)], "code string, d int, i int")
    right = spark.createDataFrame([("a", 1, 1.0, 10.0), ("a", 3, None, 30.0), ("b", 1, 9.0, 9.0)], "code string, d int, x double, y double")
    out = joins.as_of_join(left, right, values=("x", "y")).orderBy("d").collect()
    assert [(r["x"], r["y"]) for r in out] == [(1.0, 10.0), (1.0, 10.0), (1.0, 30.0), (1.0, 30.0), (1.0, 30.0)]
    bare = joins.as_of_join(left, right, values=("x", "y"), fill=False).orderBy("d").collect()
    assert bare[2]["x"] is None


def test_positional_and_outer(spark):
    prices = spark.createDataFrame([("s", 1, 1.0), ("t", 2, 2.0), ("s", 3, 3.0)], "stock string, d int, close double")
    assert [tuple(r) for r in joins.outer_prices(prices, ["s", "t"]).orderBy("d").collect()] == [(1, 1.0, None), (2, 1.0, 2.0), (3, 3.0, 2.0)]


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    stream = spark.readStream.schema(events.schema).format("parquet").load("/root/testdata/sf0.001/events*.parquet")
    q = daily.daily_series(stream).writeStream.outputMode("complete").format("memory").queryName("daily").start()
    try:
        q.processAllAvailable()
        got = sorted(map(tuple, spark.sql("select * from daily").collect()))
    finally:
        q.stop()
    assert got == sorted(map(tuple, daily.daily_series(events).collect()))


def test_estimate_override(spark):
    e = spark.createDataFrame([("a", "2024-01-03 10:00", 1.5), ("b", "2024-01-01 10:00", 1.5), ("c", None, 1.5)], "code string, estimate_time string, estimated_nav double")
    n = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 1.0)], "code string, unit_nav double").withColumn("data_end", F.lit("2024-01-02").cast("date"))
    out = {r["code"]: r["nav"] for r in daily.estimate_override(e, n).collect()}
    assert out == {"a": 1.5, "b": 1.0, "c": 1.0}
    assert daily.delay_days(n, "2024-01-05").first()["days_behind"] == 3
