"""What walk-forward samples add up to, by code and horizon."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LABELS = ("up", "sideways", "down")
KEYS = ("code", "horizon")
BUCKETS = (-200, -60, -40, -20, 0, 20, 40, 60, 200)


def is_hit() -> Column:
    return F.col("prediction") == F.col("actual")


def share(condition: Column) -> Column:
    return F.avg(condition.cast("double")) * 100


def confidence(score: str = "raw_score") -> Column:
    """AGG-4: the probability that a score gives its prediction; the rest is dealt evenly."""
    return F.lit(0.35) + F.lit(0.30) * F.least(F.abs(score), F.lit(80.0)) / 80


def bucket(x: Column, edges: tuple[int, ...]) -> Column:
    """BKT-1: the number of the half-open bucket, null outside."""
    out = F.lit(None).cast("int")
    for k, (low, high) in reversed(list(enumerate(zip(edges, edges[1:])))):
        out = F.when((x >= low) & (x < high), k).otherwise(out)
    return out


def confusion_matrix(s: DataFrame) -> DataFrame:
    """AGG-2: counts of each prediction and outcome, with zeros."""
    counts = [F.count_if((F.col("prediction") == p) & (F.col("actual") == a)).alias(f"{p}_{a}") for p in LABELS for a in LABELS]
    return s.groupBy(*KEYS).agg(*counts)


def actual_distribution(s: DataFrame) -> DataFrame:
    """AGG-3, AGG-11."""
    return s.groupBy(*KEYS).agg(*[share(F.col("actual") == a).alias(f"{a}_pct") for a in LABELS], F.avg("threshold").alias("threshold_mean"), F.median("threshold").alias("threshold_median"))


def brier_multiclass(s: DataFrame) -> DataFrame:
    """AGG-4: mean squared distance of the three probabilities from the outcome, halved."""
    c = confidence()
    rest = (1 - c) / 2
    hit = F.pow(c - 1, F.lit(2.0)) + 2 * F.pow(rest, F.lit(2.0))
    miss = F.pow(c, F.lit(2.0)) + F.pow(rest - 1, F.lit(2.0)) + F.pow(rest, F.lit(2.0))
    return s.groupBy(*KEYS).agg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.avg(F.when(is_hit(), hit).otherwise(miss)) / 2)).alias("brier"), F.count("*").alias("n"))


def calibration_bins(s: DataFrame) -> DataFrame:
    """AGG-6."""
    out = s.withColumn("bin", bucket(F.abs("raw_score"), (0, 20, 40, 60, 80, 200))).where("bin is not null")
    return out.groupBy(*KEYS, "bin").agg(F.avg(confidence()).alias("expected"), F.avg(is_hit().cast("double")).alias("observed"), F.count("*").alias("n")).withColumn("gap", F.abs(F.col("expected") - F.col("observed")))


def hit_by_move(s: DataFrame) -> DataFrame:
    """AGG-7: hit rates of large, middling and small moves, by quartiles of the absolute return."""
    move = F.abs("ret")
    marks = s.groupBy(*KEYS).agg(F.percentile(move, F.lit(0.75)).alias("high"), F.percentile(move, F.lit(0.25)).alias("low"), F.count("*").alias("n"))
    out = s.join(marks, list(KEYS))
    size = F.when(move >= F.col("high"), "high").when(move <= F.col("low"), "low").otherwise("medium")
    return out.where("n >= 10").groupBy(*KEYS).agg(*[(F.avg(F.when(size == k, is_hit().cast("double"))) * 100).alias(f"hit_{k}") for k in ("high", "medium", "low")])


def return_stats(s: DataFrame) -> DataFrame:
    """AGG-8."""
    return s.groupBy(*KEYS).agg(F.avg("ret").alias("mean"), F.median("ret").alias("median"), F.percentile("ret", F.lit(0.1)).alias("p10"), F.percentile("ret", F.lit(0.9)).alias("p90"))


def score_buckets(s: DataFrame) -> DataFrame:
    """AGG-9: counts, shares and accuracy of the scores' buckets."""
    out = s.withColumn("bucket", bucket(F.col("raw_score"), BUCKETS)).groupBy(*KEYS, "bucket").agg(F.count("*").alias("n"), share(is_hit()).alias("accuracy"))
    return out.withColumn("pct", F.col("n") / F.sum("n").over(Window.partitionBy(*KEYS)) * 100)


def score_stats(s: DataFrame) -> DataFrame:
    return s.groupBy(*KEYS).agg(F.avg("raw_score").alias("mean"), F.stddev_pop("raw_score").alias("std"), *[F.percentile("raw_score", F.lit(q)).alias(f"p{int(q * 100)}") for q in (0.1, 0.5, 0.9)])


def baseline_edge(s: DataFrame) -> DataFrame:
    """AGG-1, AGG-10: the rules against always "sideways" and against momentum."""
    out = s.groupBy(*KEYS).agg(F.count("*").alias("n"), share(is_hit()).alias("rule_acc"), share(F.col("actual") == "sideways").alias("sideways_acc"), share(F.col("momentum") == F.col("actual")).alias("momentum_acc"))
    return out.withColumn("edge", F.col("rule_acc") - F.greatest("sideways_acc", "momentum_acc"))


def down_metrics(s: DataFrame) -> DataFrame:
    """AGG-12: precision, recall and F1 of "down" by code and horizon, then their means over codes by horizon."""
    down_p, down_a = F.col("prediction") == "down", F.col("actual") == "down"
    out = s.groupBy(*KEYS).agg(F.count_if(down_p & down_a).alias("tp"), F.count_if(down_p).alias("predicted"), F.count_if(down_a).alias("actual"))
    out = out.withColumns({"precision": F.try_divide(F.col("tp"), F.col("predicted")) * 100, "recall": F.try_divide(F.col("tp"), F.col("actual")) * 100})
    out = out.withColumn("f1", F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    return out.groupBy("horizon").agg(F.avg("precision").alias("precision"), F.avg(F.coalesce("recall", F.lit(0.0))).alias("recall"), F.avg("f1").alias("f1"), F.count("*").alias("codes"))


def quality(s: DataFrame) -> DataFrame:
    """AGG-19: how far the probabilities of a code can be trusted, over its horizons with at least 10 samples."""
    periods = baseline_edge(s).join(brier_multiclass(s).drop("n"), list(KEYS)).where("n >= 10")
    a = periods.groupBy("code").agg(F.count("*").alias("periods"), F.sum("n").alias("total"), F.count_if(F.col("edge") >= 0).alias("good"), F.count_if(F.col("edge") > 3).alias("strong"), F.max("brier").alias("worst"), F.max("sideways_acc").alias("sideways"))
    low = (F.col("periods") < 2) | (F.col("total") < 30) | (F.col("worst") > 0.4) | (F.col("good") == 0)
    strong_half = F.col("strong") >= F.col("periods") / 2
    q = (
        F.when(low, "low")
        .when(F.col("sideways") > 80, F.when(strong_half & (F.col("total") >= 60), "medium").otherwise("low"))
        .when((F.col("strong") > F.col("periods") / 2) & (F.col("total") >= 120), "high")
        .when((F.col("good") >= 2) & (F.col("total") >= 60), "medium")
        .otherwise("low")
    )
    calibrated = ~low & ((F.col("sideways") > 80) | (q != "low"))
    return a.select("code", "periods", "total", "good", "strong", q.alias("quality"), calibrated.alias("calibrated"))


def uncertainties(s: DataFrame) -> DataFrame:
    """SCR-9: what speaks against each code's backtest, as a list: code, uncertainties.

    Thresholds are told with two decimals. Of horizons that share a reason the shortest is named.
    """
    each = s.groupBy(*KEYS).agg(F.count("*").alias("n"), share(F.col("prediction") == F.col("actual")).alias("hit"), share(F.col("actual") == "sideways").alias("sideways"), F.avg("threshold").alias("t"))
    name = F.concat(F.col("horizon").cast("string"), F.lit("d"))
    first = lambda text, when: F.min_by(text, F.when(when, F.col("horizon")))
    # fixed values: bounds and texts
    high = first(F.concat(name, F.lit("周期阈值较高（"), F.format_string("%.2f", "t"), F.lit("%），反映波动较大，方向预测误差可能放大")), F.col("t") > 5)
    flat = first(F.concat(name, F.lit("周期实际走势极端偏向震荡，方向预测区分度可能不足")), F.col("sideways") > 80)
    found = F.array(
        high, F.when(F.min("n") < 30, "部分周期回测样本较少，历史准确率参考价值有限"), F.when(F.count_if(F.col("hit") < 50) >= 2, "多个周期方向准确率低于随机猜测，需谨慎参考"), flat,
    )
    out = each.groupBy("code").agg(F.array_compact(found).alias("uncertainties"))
    return out.withColumn("uncertainties", F.when(F.size("uncertainties") > 0, F.col("uncertainties")).otherwise(F.array(F.lit("回测样本量尚可，但历史表现不代表未来"))))
