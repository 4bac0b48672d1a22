"""Up-probability models: calibration, threshold sweeps and the validated rule search."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KEYS = ("code", "horizon")
# fixed values: gates of the rule search by horizon, and thresholds used when nothing passes
DEFAULT_THRESHOLDS = {1: 0.60, 3: 0.59, 7: 0.62, 30: 0.64}
MIN_SIGNALS = {1: 24, 3: 20, 7: 16, 30: 10}
MIN_VALIDATION = {1: 6, 3: 5, 7: 4, 30: 3}
TARGET_HIT, MIN_EDGE, MIN_BOUND, MIN_FACTOR, FOLDS = 80.0, 5.0, 55.0, 1.05, 4
TRAINED_CODES = ("015916", "015790", "161226", "014331", "015566", "012868", "161128", "020872", "017811", "017516")


def binary_metrics(s: DataFrame) -> DataFrame:
    """AGG-1, AGG-5, AGG-10 for up or not: hit rates of the model, the majority and momentum, edge and Brier score."""
    up = F.col("up").cast("double")
    out = s.groupBy(*KEYS).agg(
        F.count("*").alias("n"), (F.avg(((F.col("probability") >= 0.5) == F.col("up")).cast("double")) * 100).alias("hit"),
        (F.avg(up) * 100).alias("up_rate"), (F.avg((F.col("momentum_up") == F.col("up")).cast("double")) * 100).alias("momentum_hit"), F.avg(F.pow(F.col("probability") - up, F.lit(2.0))).alias("brier"),
    )
    out = out.withColumn("majority_hit", F.greatest(F.col("up_rate"), 100 - F.col("up_rate")))
    return out.withColumn("edge", F.col("hit") - F.greatest("majority_hit", "momentum_hit"))


def kernel_calibration(s: DataFrame, present: DataFrame, near: float = 0.08, enough: int = 12) -> DataFrame:
    """AGG-18: the probability of the present row against what followed similar ones, all from one pass of sums."""
    d = F.abs(F.col("probability") - F.col("now"))
    up, w = F.col("up").cast("double"), 1 / (d + 0.05)
    now = present.select(*KEYS, F.col("probability").alias("now"))
    out = s.join(now, list(KEYS)).groupBy(*KEYS).agg(F.first("now").alias("now"), F.avg(up).alias("base"), F.count_if(d <= near).alias("n_near"), F.avg(F.when(d <= near, up)).alias("seen"), (F.sum(w * up) / F.sum(w)).alias("weighted"))
    shrunk = (F.col("seen") * F.col("n_near") + F.col("base") * 8) / (F.col("n_near") + 8)
    value = F.when(F.col("n_near") >= enough, 0.65 * shrunk + 0.35 * F.col("now")).otherwise(0.5 * F.col("weighted") + 0.3 * F.col("now") + 0.2 * F.col("base"))
    return out.select(*KEYS, "now", "base", "n_near", value.alias("calibrated"))


def sweep(s: DataFrame, low: float, high: float, step: float) -> DataFrame:
    """Cumulative sums over samples by falling probability: every threshold of a grid from one window pass.

    For each grid point: signals, hits, sum, gains, losses and minimum of returns among samples at or above it.
    """
    count = round((high - low) / step)
    grid = F.floor((F.col("probability") - low) / step + 1e-9)
    binned = s.withColumn("k", F.least(F.lit(count), grid)).where("k >= 0").groupBy(*KEYS, "k").agg(F.count("*").alias("c"), F.count_if("up").alias("h"))
    points = s.select(*KEYS).distinct().withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count).cast("long"))))
    w = Window.partitionBy(*KEYS).orderBy(F.desc("k"))
    filled = points.join(binned, [*KEYS, "k"], "left")
    return filled.select(*KEYS, "k", F.sum(F.coalesce("c", F.lit(0))).over(w).alias("signals"), F.sum(F.coalesce("h", F.lit(0))).over(w).alias("hits"))


def threshold_sweep(s: DataFrame) -> DataFrame:
    """AGG-15: the best of 21 thresholds with at least 20 signals, 60 % hits and an edge of 3; else the default."""
    base = binary_metrics(s).select(*KEYS, "n", F.greatest("up_rate", "momentum_hit").alias("baseline"))
    tried = sweep(s, 0.55, 0.75, 0.01).join(base, list(KEYS)).withColumn("hit", F.try_divide(F.col("hits") * 100.0, F.col("signals")))
    passing = tried.where((F.col("signals") >= 20) & (F.col("hit") >= 60) & (F.col("hit") - F.col("baseline") >= 3))
    best = passing.withColumn("rank", F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.desc("hit"), F.desc("signals"), "k"))).where("rank = 1").select(*KEYS, "k", "signals", "hit")
    default = F.lit(None).cast("double")
    for h, t in DEFAULT_THRESHOLDS.items():
        default = F.when(F.col("horizon") == h, t).otherwise(default)
    fall = s.withColumn("t", default).groupBy(*KEYS, "t").agg(F.count_if(F.col("probability") >= F.col("t")).alias("signals_d"), (F.avg(F.when(F.col("probability") >= F.col("t"), F.col("up").cast("double"))) * 100).alias("hit_d"))
    out = base.join(best, list(KEYS), "left").join(fall, list(KEYS))
    hit = F.coalesce("hit", "hit_d")
    return out.select(*KEYS, F.coalesce(0.55 + F.col("k") * 0.01, "t").alias("threshold"), F.coalesce("signals", "signals_d").alias("signals"), hit.alias("hit"), (hit - F.col("baseline")).alias("edge"), F.col("k").isNotNull().alias("valid"))


def _products(groups: list[list[dict]], parts: int, cap: int) -> list[dict]:
    """One item from each of `parts` groups, in the order of the first item, then of the second; the first `cap`."""

    def grow(rule: dict, begin: int, left: int):
        if not left:
            yield rule
            return
        for at in range(begin, len(groups) - left + 1):
            for item in groups[at]:
                yield from grow(rule | item, at + 1, left - 1)

    return list(itertools.islice(grow({}, 0, parts), cap))


def rule_templates(horizon: int, external: bool = False) -> list[dict[str, float]]:
    """PRD-4: conjunctions of bounds on features, in their order of preference, without repeats."""
    bounds = lambda key, *values: [{key: float(v)} for v in values]
    # fixed values: keys and bounds, down to the removal of repeats
    singles = [{}]
    for key, values in (
        ("position_30d_max", (95, 90, 85, 80, 75, 70)), ("position_60d_max", (95, 85, 75)), ("rsi_14_max", (80, 75, 70, 65)), ("bb_position_max", (98, 95, 90, 85)),
        ("return_5d_min", (-5, -3, -1, 0, 1)), ("prev_return_min", (-5, -2, 0)), ("score_min", (-15, -5, 0, 5)),
    ):
        singles += bounds(key, *values)
    combined = [
        {"position_30d_max": 80.0, "rsi_14_max": 75.0}, {"position_30d_max": 80.0, "bb_position_max": 90.0}, {"rsi_14_max": 70.0, "bb_position_max": 90.0},
        {"position_30d_max": 80.0, "rsi_14_max": 75.0, "return_5d_min": -1.0}, {"position_30d_max": 70.0, "rsi_14_max": 70.0, "prev_return_min": 0.0}, {"return_5d_min": 0.0, "prev_return_min": 0.0},
    ]
    groups = [
        bounds("position_30d_max", 90, 80, 70), bounds("rsi_14_max", 80, 75, 70), bounds("bb_position_max", 95, 90, 85),
        bounds("return_5d_min", -3, -1, 0, 1), bounds("return_20d_min", -8, -5, 0), bounds("score_min", -5, 0, 5),
    ]
    combined += _products(groups, 2, 200) + _products(groups[:4], 3, 80)
    if horizon >= 7:
        combined += [{"return_20d_min": -5.0, "position_30d_max": 85.0}, {"return_20d_min": 0.0, "rsi_14_max": 75.0}]
    if external:
        for key, values in (("factor_return_1d_min", (-3,)), ("factor_return_5d_min", (-5, -2, 0)), ("factor_position_30d_max", (95, 85, 75)), ("factor_above_ma20_min", (1,)), ("factor_volatility_20d_max", (45,))):
            singles += bounds(key, *values)
        mixed = [groups[0], groups[1], bounds("factor_return_5d_min", -5, -2, 0, 1), bounds("factor_position_30d_max", 95, 85, 75)]
        combined += [{"factor_return_5d_min": -2.0, "position_30d_max": 85.0}, {"factor_return_5d_min": 0.0, "rsi_14_max": 75.0}, {"factor_position_30d_max": 85.0, "bb_position_max": 90.0}, {"factor_above_ma20_min": 1.0, "return_5d_min": -1.0}]
        combined += _products(mixed, 2, 120) + _products(mixed, 3, 120)
        if horizon >= 7:
            combined += [{"factor_return_20d_min": -8.0, "position_30d_max": 85.0}, {"factor_return_20d_min": 0.0, "rsi_14_max": 75.0}, {"factor_return_5d_min": 0.0, "factor_position_30d_max": 90.0}]
    out: dict[tuple, dict] = {}
    for rule in singles + combined:
        out.setdefault(tuple(sorted(rule.items())), rule)
    return list(out.values())


#: Feature of each rule key in the samples' columns.
FEATURES = {"position_30d": "pos_30", "position_60d": "pos_60", "rsi_14": "rsi_14", "bb_position": "bb_pos", "return_5d": "ret_5", "return_20d": "ret_20", "prev_return": "prev_return", "score": "adjusted"}
#: Those of baskets of a fund's holdings, which some templates ask for.
EXTERNAL = {c: c for c in ("factor_return_1d", "factor_return_5d", "factor_return_20d", "factor_position_30d", "factor_above_ma20", "factor_volatility_20d")}


def rule_table(spark: SparkSession, horizons=(1, 3, 7, 30), external: bool = False) -> DataFrame:
    """D5: horizon, ord and a nullable bound for each key; a few hundred rows, whatever the data."""
    keys = [f"{f}_{side}" for f in (FEATURES | EXTERNAL if external else FEATURES) for side in ("min", "max")]
    rows = [(h, n, *(rule.get(k) for k in keys)) for h in horizons for n, rule in enumerate(rule_templates(h, external))]
    return spark.createDataFrame(rows, "horizon int, ord int, " + ", ".join(f"{k} double" for k in keys))


def wilson(hits: Column, n: Column, z: float = 1.96) -> Column:
    """AGG-14: lower bound of a share, in percent."""
    p = hits / n
    margin = z * F.sqrt((p * (1 - p) + z * z / (4.0 * n)) / n)
    return F.greatest(F.lit(0.0), (p + z * z / (2.0 * n) - margin) / (1 + z * z / n) * 100)


def _by_horizon(values: dict[int, float]) -> Column:
    out = F.lit(None)
    for h, v in values.items():
        out = F.when(F.col("horizon") == h, F.lit(v)).otherwise(out)
    return out


def meets(features: dict[str, str] = FEATURES) -> Column:
    """Whether a row meets the bounds of the template beside it; a null bound is none, a missing feature meets no bound."""
    met = F.lit(True)
    for key, column in features.items():
        x = F.col(column)
        met = met & (F.col(f"{key}_min").isNull() | (x >= F.col(f"{key}_min"))) & (F.col(f"{key}_max").isNull() | (x <= F.col(f"{key}_max")))
    return F.coalesce(met, F.lit(False))


def rule_metrics(s: DataFrame, rules: DataFrame, features: dict[str, str] = FEATURES, count: int = 70, low: float = 0.55, step: float = 0.005) -> DataFrame:
    """AGG-13 for every template and every probability threshold, by part of the samples.

    Samples meet the broadcast templates once (a few hundred rows of fixed number); each pair falls into a bin of its
    probability, and bins are summed by part: all samples (no suffix), training (_t), validation (_v) and the folds
    (_1 to _4). c, h, s, g, l are signals, hits and the sums of returns, gains and losses; m the least return of all.
    """
    parts = s.join(s.groupBy(*KEYS).agg(F.count("*").alias("n")), list(KEYS))
    order = Window.partitionBy(*KEYS).orderBy("i")
    parts = parts.withColumns({"rn": F.row_number().over(order), "fold": F.ntile(FOLDS).over(order)}).withColumn("train", F.col("rn") <= F.greatest(F.lit(1), F.col("n") - F.greatest(F.lit(1), F.least(F.ceil(F.col("n") * 0.3), F.greatest(F.col("n") - 1, F.lit(1))))))
    slim = parts.select(*KEYS, "n", "fold", "train", "up", "ret", F.least(F.lit(count), F.floor((F.col("probability") - low) / step + 1e-9)).alias("k"), *dict.fromkeys(features.values())).where("k >= 0")
    pairs = slim.join(F.broadcast(rules), "horizon").where(meets(features))
    values = {"c": F.lit(1), "h": F.col("up").cast("int"), "s": F.col("ret"), "g": F.greatest("ret", F.lit(0.0)), "l": F.least("ret", F.lit(0.0))}
    masks = {"": F.lit(True), "_t": F.col("train"), "_v": ~F.col("train")} | {f"_{f}": F.col("fold") == f for f in range(1, FOLDS + 1)}
    return pairs.groupBy(*KEYS, "ord", "k", "n").agg(*[F.sum(F.when(m, v).otherwise(v * 0)).alias(x + tag) for tag, m in masks.items() for x, v in values.items()], F.min("ret").alias("m"))


def rule_search(s: DataFrame, rules: DataFrame, present: DataFrame, features: dict[str, str] = FEATURES) -> DataFrame:
    """PRD-5: the best rule of each code and horizon among those whose full-sample figures pass all gates.

    Valid rules (training, validation and folds pass as well) come before others; among either, rules that the present
    row meets; then the higher hit rate, more signals, the lower threshold and the earlier template. Median and worst
    return are those of the rule's signals.
    """
    cells = rule_metrics(s, rules, features)
    base = binary_metrics(s).select(*KEYS, F.greatest("up_rate", "momentum_hit").alias("baseline"))
    # sums over falling thresholds; a row stands for the thresholds above the next lower bin, of which the lowest is named
    down = Window.partitionBy(*KEYS, "ord").orderBy(F.desc("k"))
    tags = ["", "_t", "_v", *[f"_{f}" for f in range(1, FOLDS + 1)]]
    total = [F.sum(x + tag).over(down).alias(x + tag) for tag in tags for x in "chsgl"] + [F.min("m").over(down).alias("worst_return")]
    out = cells.select(*KEYS, "ord", "n", F.coalesce(F.lead("k").over(down) + 1, F.lit(0)).alias("t"), *total).join(base, list(KEYS))
    hit = lambda p: F.try_divide(F.col(f"h{p}") * 100.0, F.col(f"c{p}"))
    mean = lambda p: F.try_divide(F.col(f"s{p}"), F.col(f"c{p}"))
    factor = lambda p: F.when(F.col(f"l{p}") < -1e-9, F.col(f"g{p}") / -F.col(f"l{p}")).when(F.col(f"g{p}") > 0, 99.0).otherwise(0.0)
    passes = lambda p, least, goal, edge, pf: (F.col(f"c{p}") >= least) & (hit(p) >= goal) & (hit(p) - F.col("baseline") >= edge) & (mean(p) > 0) & (factor(p) >= pf)
    bound = lambda p: wilson(F.col(f"h{p}"), F.col(f"c{p}")) >= MIN_BOUND
    least, val = _by_horizon(MIN_SIGNALS), _by_horizon(MIN_VALIDATION)
    least_train = _by_horizon({h: max(MIN_VALIDATION[h], math.ceil(MIN_SIGNALS[h] * 0.65)) for h in MIN_SIGNALS})
    fold_min = _by_horizon({h: max(2, math.ceil(v * 0.6)) for h, v in MIN_VALIDATION.items()})
    full = out.where((F.col("c") > 0) & passes("", least, TARGET_HIT, MIN_EDGE, MIN_FACTOR) & bound(""))
    seen = [F.col(f"c_{f}") >= fold_min for f in range(1, FOLDS + 1)]
    good = [seen[f - 1] & passes(f"_{f}", fold_min, max(60.0, TARGET_HIT - 15), max(0.0, MIN_EDGE - 3), 1.0) for f in range(1, FOLDS + 1)]
    evaluable, passed = sum((x.cast("int") for x in seen), F.lit(0)), sum((F.coalesce(x, F.lit(False)).cast("int") for x in good), F.lit(0))
    fold_mean = F.try_divide(sum((F.when(x, mean(f"_{f}")).otherwise(0.0) for f, x in enumerate(seen, 1)), F.lit(0.0)), evaluable)
    full = full.withColumns({
        "train_ok": F.coalesce((F.col("c_t") > 0) & passes("_t", least_train, TARGET_HIT, MIN_EDGE, MIN_FACTOR) & bound("_t"), F.lit(False)),
        "validation_ok": F.coalesce(passes("_v", val, TARGET_HIT, MIN_EDGE, 1.0), F.lit(False)),
        "cv_ok": (evaluable >= 2) & (passed * 100.0 >= evaluable * 50.0) & (fold_mean > 0),
    })
    full = full.withColumn("valid", F.col("train_ok") & F.col("validation_ok") & F.col("cv_ok"))
    now = present.select(*KEYS, F.col("probability").alias("now"), *dict.fromkeys(features.values()))
    met = meets(features) & (F.col("now") >= low_threshold() + F.col("t") * 0.005)
    full = full.join(F.broadcast(rules), ["horizon", "ord"]).join(now, list(KEYS), "left").withColumn("matches_now", F.coalesce(met, F.lit(False)))
    rank = F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.desc("valid"), F.desc("matches_now"), F.desc(F.round(hit(""), 9)), F.desc("c"), "t", "ord"))
    best = full.withColumn("rank", rank).where("rank = 1")
    figures = [(low_threshold() + F.col("t") * 0.005).alias("threshold"), F.col("c").alias("signals"), hit("").alias("hit"), (F.col("c") * 100.0 / F.col("n")).alias("coverage"), mean("").alias("avg_return"), "worst_return", factor("").alias("profit_factor"), wilson(F.col("h"), F.col("c")).alias("bound")]
    chosen = best.select(*KEYS, "ord", *figures, "train_ok", "validation_ok", "cv_ok", "valid", "matches_now", "t")
    bounds = chosen.select(*KEYS, "ord", "t").join(F.broadcast(rules), ["horizon", "ord"])
    bin_of = F.floor((F.col("probability") - low_threshold()) / 0.005 + 1e-9)
    medians = s.join(bounds, list(KEYS)).where(meets(features) & (bin_of >= F.col("t"))).groupBy(*KEYS).agg(F.median("ret").alias("median_return"))
    return chosen.drop("t").join(medians, list(KEYS))


def low_threshold() -> Column:
    return F.lit(0.55)


def ts_cv_folds(s: DataFrame) -> DataFrame:
    """AGG-16, AGG-17: folds and the chronological split, with their hit rates."""
    order = Window.partitionBy(*KEYS).orderBy("i")
    n = F.count("*").over(Window.partitionBy(*KEYS))
    out = s.withColumns({"fold": F.ntile(FOLDS).over(order), "train": F.row_number().over(order) <= n - F.ceil(n * 0.3)})
    return out.groupBy(*KEYS, "fold").agg(F.count("*").alias("n"), F.min("i").alias("first_i"), F.max("i").alias("last_i"), F.count_if("train").alias("n_train"), (F.avg(((F.col("probability") >= 0.5) == F.col("up")).cast("double")) * 100).alias("hit"))
