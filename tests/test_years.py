"""Holdings by year: which folders are read, and years that differ in names, types and columns."""

from fundlattice.operators import joins
from fundlattice.sources import years


def test_years_are_united_by_name(spark, tmp_path):
    path = str(tmp_path / "h")
    spark.createDataFrame([("a", "600001", "2024年1季度", 5.0)], "fund string, stock string, quarter string, weight_pct double").write.parquet(f"{path}/year=2024")
    spark.createDataFrame([("2023年4季度", "a", "x", "600002", "7.5", 1), ("2023年3季度", "a", "y", "600003", "-", 2)], "`季度` string, `基金代码` string, `股票名称` string, `股票代码` string, `占净值比例` string, extra int").write.parquet(f"{path}/year=2023")
    spark.createDataFrame([("no stock",)], "fund string").write.parquet(f"{path}/year=2022")
    spark.createDataFrame([("a", "1", "2020年1季度", 1.0)], "fund string, stock string, quarter string, weight_pct double").write.parquet(f"{path}/year=2020")
    got = {(r["stock"], r["name"], r["weight_pct"]) for r in years.holdings_of_years(spark, path, 2024).collect()}
    assert got == {("600001", None, 5.0), ("600002", "x", 7.5), ("600003", "y", 0.0)}
    assert years.holdings_of_years(spark, path, 1999).count() == 0
    assert [r["stock"] for r in joins.latest_holdings(years.holdings_of_years(spark, path, 2024)).collect()] == ["600001"]


def test_only_the_years_asked_are_read(spark, tmp_path):
    path = str(tmp_path / "h")
    rows = [(f, "s", f"{y}年{q}季度", 1.0) for f in ("a", "b") for y in range(2015, 2025) for q in (1, 2)] + [("a", "s", "unknown", 1.0)]
    years.write_years(spark.createDataFrame(rows, "fund string, stock string, quarter string, weight_pct double"), path)
    found = years.holdings_of_years(spark, path, 2024)
    assert {f.split("year=")[1][:4] for f in found.inputFiles()} == {"2021", "2022", "2023", "2024"}
    assert found.count() == 2 * 4 * 2
