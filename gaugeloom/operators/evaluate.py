"""Errors, bins, tests and station summaries of predictions (method, station_id, pos, tgt, out)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .supersteps import globally_ranked, stored


def errors(pred: DataFrame) -> DataFrame:
    return pred.withColumns({"se": F.pow(F.col("out") - F.col("tgt"), 2), "gain": F.col("tgt") - F.col("out")})


def pearson(pred: DataFrame, by: list[str], eps: float = 1e-8) -> DataFrame:
    """Population covariance over the product of population deviations, plus eps."""
    return pred.groupBy(*by).agg((F.covar_pop("tgt", "out") / (F.stddev_pop("tgt") * F.stddev_pop("out") + eps)).alias("corr"), F.avg(F.pow(F.col("out") - F.col("tgt"), 2)).alias("mse"), F.count(F.lit(1)).alias("n"))


def overall(pred: DataFrame) -> DataFrame:
    """Mean error over samples, mean correlation over stations."""
    return pearson(pred, ["method", "station_id"]).groupBy("method").agg((F.sum(F.col("mse") * F.col("n")) / F.sum("n")).alias("mse"), F.avg("corr").alias("corr"))


def std_gap(pred: DataFrame, by: list[str]) -> DataFrame:
    return pred.groupBy(*by).agg(F.abs(F.stddev_samp("tgt") - F.stddev_samp("out")).alias("std_gap"))


def combined_loss(pred: DataFrame, by: list[str]) -> DataFrame:
    return pearson(pred, by).join(std_gap(pred, by), by).withColumn("loss", F.col("mse") - F.col("corr") + F.col("std_gap"))


def location_mean_loss(pred: DataFrame) -> DataFrame:
    return errors(pred).groupBy("method", "station_id").agg(F.avg("se").alias("l")).groupBy("method").agg(F.avg("l").alias("loss"))


def deviation_weighted_rmse(pred: DataFrame, by: list[str]) -> DataFrame:
    mean = pred.groupBy(*by).agg(F.avg("tgt").alias("mean"))
    return pred.join(mean, by).groupBy(*by).agg(F.sqrt(F.avg(F.pow(F.col("out") - F.col("tgt"), 2) * F.abs(F.col("tgt") - F.col("mean")))).alias("rmse"))


def peak_hit(pred: DataFrame, by: list[str], tolerance: float = 0.2) -> DataFrame:
    return pred.groupBy(*by).agg((F.max("out") >= F.max("tgt") - tolerance).alias("hit"))


def _top(pred: DataFrame, score, share: float, by: list[str], up: bool) -> DataFrame:
    """Mean squared error over the share of largest scores in each group: ranks by group, ties by station and pos."""
    w = Window.partitionBy(*by)
    ranked = pred.withColumn("rank", F.row_number().over(w.orderBy(score.desc(), "station_id", "pos"))).withColumn("n", F.count(F.lit(1)).over(w))
    k = F.ceil(F.col("n") * share) if up else F.greatest(F.lit(1), F.floor(F.col("n") * share))
    return ranked.where(F.col("rank") <= k).groupBy(*by).agg(F.avg(F.pow(F.col("out") - F.col("tgt"), 2)).alias("mse"))


def topk_mse(pred: DataFrame, share: float, by: list[str]) -> DataFrame:
    return _top(pred, F.pow(F.col("out") - F.col("tgt"), 2), share, by, up=False)


def top_target_mse(pred: DataFrame, share: float, by: list[str]) -> DataFrame:
    return _top(pred, F.abs("tgt"), share, by, up=True)


def best_row(df: DataFrame, score: str, key: str) -> DataFrame:
    return df.agg(F.min(F.struct(score, key)).alias("b")).select(f"b.{key}", f"b.{score}")


def error_bin(tgt):
    a = F.abs(tgt)
    return F.when(a <= 0.3, "low").when((a > 0.3) & (a < 0.6), "mid").when((a >= 0.6) & (a < 1.2), "high")


def bin_errors(pred: DataFrame) -> DataFrame:
    """Mean and population deviation of absolute errors by method and bin of the target; targets from 4 on go."""
    p = pred.where(F.abs("tgt") < 4).withColumn("bin", error_bin(F.col("tgt"))).where("bin is not null")
    e = F.abs(F.col("out") - F.col("tgt"))
    return p.groupBy("method", "bin").agg(F.avg(e).alias("mean"), F.stddev_pop(e).alias("std"), F.count(F.lit(1)).alias("n"))


def bin_errors_given_hit(pred: DataFrame, best: str, tolerance: float) -> DataFrame:
    """bin_errors over the samples where the best method's error is within the tolerance."""
    hits = pred.where((F.col("method") == best) & (F.abs(F.col("out") - F.col("tgt")) <= tolerance)).select("station_id", "pos")
    return bin_errors(pred.join(hits, ["station_id", "pos"], "left_semi"))


def _pairs(pred: DataFrame, a: str, b: str) -> DataFrame:
    x = pred.where(F.col("method") == a).select("station_id", "pos", "tgt", F.abs(F.col("out") - F.col("tgt")).alias("ea"))
    y = pred.where(F.col("method") == b).select("station_id", "pos", F.abs(F.col("out") - F.col("tgt")).alias("eb"))
    return x.join(y, ["station_id", "pos"]).withColumn("bin", error_bin(F.col("tgt"))).where("bin is not null")


def gain_vs_baseline(pred: DataFrame, a: str, b: str) -> DataFrame:
    return _pairs(pred, a, b).groupBy("bin").agg(F.avg(F.col("eb") - F.col("ea")).alias("gain"))


def paired_ttest(pred: DataFrame, a: str, b: str) -> DataFrame:
    """t of the paired differences by bin."""
    d = F.col("ea") - F.col("eb")
    g = _pairs(pred, a, b).groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg(d).alias("mean"), F.stddev_samp(d).alias("sd"))
    return g.withColumn("t", F.try_divide(F.col("mean") * F.sqrt("n"), F.col("sd")))


def t_p_value(t: float, dof: int) -> float:
    """Two-sided p of Student's t, by the continued fraction of the incomplete beta function."""
    x, a, b = dof / (dof + t * t), dof / 2, 0.5
    if x >= 1:
        return 1.0
    swap = x > (a + 1) / (a + b + 2)
    if swap:
        x, a, b = 1 - x, b, a
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / d
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d)
            c = 1 + num / c
            h *= d * c
    front = math.exp(a * math.log(x) + b * math.log(1 - x) - (math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b))) / a
    return 1 - front * h if swap else front * h


def adjust_p(tests: DataFrame, how: str = "holm") -> DataFrame:
    """Adjusted p over all tests (a row a test): holm, bonferroni or fdr_bh. Running extremes go part by part, and over the parts' own."""
    tests = stored(tests, "tests")
    m = tests.count()
    if how == "bonferroni":
        return tests.withColumn("p_adj", F.least(F.lit(1.0), F.col("p") * m))
    if how not in ("holm", "fdr_bh"):
        raise ValueError(f"unknown correction {how}")
    ranked = globally_ranked(tests, [F.col("p"), F.col("test")], "tests-ranked")
    down = how == "fdr_bh"
    best = F.min if down else F.max
    ranked = stored(ranked.withColumn("v", F.col("p") * m / F.col("rank") if down else F.col("p") * (m - F.col("rank") + 1)), "tests-ranked")
    side = (1, Window.unboundedFollowing) if down else (Window.unboundedPreceding, -1)
    parts = ranked.groupBy("part").agg(best("v").alias("v")).select("part", best("v").over(Window.orderBy("part").rowsBetween(*side)).alias("beyond"))
    order = Window.partitionBy("part").orderBy("rank")
    run = best("v").over(order.rowsBetween(0, Window.unboundedFollowing) if down else order.rowsBetween(Window.unboundedPreceding, 0))
    both = F.least("run", "beyond") if down else F.greatest("run", "beyond")  # nulls don't count
    return ranked.withColumn("run", run).join(F.broadcast(parts), "part").withColumn("p_adj", F.least(F.lit(1.0), both)).select("test", "p", "p_adj")  # parts: one row a part


def station_bin_rmse(pred: DataFrame, low: float, high: float) -> DataFrame:
    p = pred.where(F.abs("tgt").between(low, high))
    rmse, mean = F.sqrt(F.avg(F.pow(F.col("out") - F.col("tgt"), 2))), F.avg(F.abs("tgt"))
    return p.groupBy("method", "station_id").agg(F.count(F.lit(1)).alias("n"), rmse.alias("rmse"), mean.alias("mean_abs"), F.try_divide(rmse, mean).alias("relative"))


def station_relative_rmse_per_sample(pred: DataFrame, eps: float = 1e-6) -> DataFrame:
    return pred.groupBy("method", "station_id").agg(F.sqrt(F.avg(F.pow((F.col("out") - F.col("tgt")) / (F.abs("tgt") + eps), 2))).alias("relative"))


def metric_summary(df: DataFrame, col: str, by: list[str]) -> DataFrame:
    return df.where(F.col(col).isNotNull() & ~F.isnan(col)).groupBy(*by).agg(F.count(col).alias("n"), F.avg(col).alias("mean"), F.stddev_pop(col).alias("std"), F.min(col).alias("min"), F.median(col).alias("median"), F.max(col).alias("max"))


def bucket_counts(df: DataFrame, col: str, bounds: list[float]) -> DataFrame:
    """Rows per interval: bucket i holds values from bounds[i - 1] up to below bounds[i]; the ends are open."""
    bucket = F.lit(0)
    for b in bounds:
        bucket = bucket + F.when(F.col(col) >= b, 1).otherwise(0)
    return df.where(F.col(col).isNotNull()).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def percent_under(df: DataFrame, col: str, thresholds: list[float]) -> DataFrame:
    """Percentage of rows up to each threshold, in one pass."""
    one = df.agg(*[(100 * F.avg(F.when(F.col(col) <= t, 1.0).otherwise(0.0))).alias(str(i)) for i, t in enumerate(thresholds)])
    pairs = F.explode(F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(str(i)).alias("percent")) for i, t in enumerate(thresholds)]))
    return one.select(pairs.alias("p")).select("p.threshold", "p.percent")


def outlier_stations(pred: DataFrame, low: float, high: float, least: float) -> DataFrame:
    return pred.where(F.abs("tgt").between(low, high)).groupBy("method", "station_id").agg(F.median(F.abs(F.col("out") - F.col("tgt"))).alias("median")).where(F.col("median") > least)


def degradation_penalty(pred: DataFrame, model: str, neighbor: str) -> DataFrame:
    """Mean of what the model's squared error has over the neighbour's, plus the model's mean squared error."""
    p = errors(pred)
    m = p.where(F.col("method") == model).select("station_id", "pos", F.col("se").alias("sm"))
    n = p.where(F.col("method") == neighbor).select("station_id", "pos", F.col("se").alias("sn"))
    return m.join(n, ["station_id", "pos"]).groupBy("station_id").agg((F.avg(F.greatest(F.lit(0.0), F.col("sm") - F.col("sn"))) + F.avg("sm")).alias("penalty"))


def local_maxima(series: DataFrame, height: float) -> DataFrame:
    """Points above both neighbours and at least so high."""
    w = Window.partitionBy("station_id").orderBy("pos")
    return series.withColumns({"a": F.lag("value").over(w), "b": F.lead("value").over(w)}).where((F.col("value") > F.col("a")) & (F.col("value") > F.col("b")) & (F.col("value") >= height)).select("station_id", "pos", "value")


def match_peaks(peaks: DataFrame, series: DataFrame, reach: int = 6, tolerance: float = 0.2) -> DataFrame:
    """The largest prediction within reach of each peak: its signed error, offset, and whether it is a hit (an equi-join on positions)."""
    wide = peaks.withColumn("at", F.explode(F.sequence(F.col("pos") - reach, F.col("pos") + reach)))
    s = series.select("station_id", F.col("pos").alias("at"), F.col("value").alias("out"))
    best = wide.join(s, ["station_id", "at"]).groupBy("station_id", "pos", "value").agg(F.max(F.struct("out", (-F.col("at")).alias("neg"))).alias("m"))
    return best.select("station_id", "pos", "value", F.col("m.out").alias("out"), (F.col("m.out") - F.col("value")).alias("error"), (-F.col("m.neg") - F.col("pos")).alias("offset"), (F.col("m.out") >= F.col("value") - tolerance).alias("hit"))


def zstats(df: DataFrame, col: str, by: str) -> DataFrame:
    """Mean and population deviation of a group, then the largest, mean, least and deviation of its absolute z."""
    g = df.groupBy(by).agg(F.avg(col).alias("mean"), F.stddev_pop(col).alias("std"))
    z = F.abs(F.coalesce(F.try_divide(F.col(col) - F.col("mean"), F.col("std")), F.lit(0.0)))
    return df.join(g, by).groupBy(by).agg(F.first("mean").alias("mean"), F.first("std").alias("std"), F.max(z).alias("z_max"), F.avg(z).alias("z_mean"), F.min(z).alias("z_min"), F.stddev_pop(z).alias("z_std"))


def path_stats(df: DataFrame, col: str, by: str) -> DataFrame:
    return df.groupBy(by).agg(F.avg(col).alias("mean"), F.stddev_pop(col).alias("std"), F.min(col).alias("min"), F.max(col).alias("max"), F.median(col).alias("median"))


PERCENTS = (0.0, 0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99, 1.0)


def percentile_summary(df: DataFrame, col: str) -> DataFrame:
    """Counts and percentiles (linear between neighbours) of a column. Values are ranked by range; only the rows beside the percentiles are picked."""
    total, valid = df.agg(F.count(F.lit(1)), F.count(col)).first()
    ranked = globally_ranked(df.where(F.col(col).isNotNull()).select(F.col(col).cast("double").alias("v")), [F.col("v")], "percentiles")
    at = [q * (valid - 1) for q in PERCENTS]
    wanted = {int(x) + k for x in at for k in (1, 2)}
    picked = {f"v{r}": F.max(F.when(F.col("rank") == r, F.col("v"))) for r in sorted(wanted)}
    out = ranked.where(F.col("rank").isin(sorted(wanted))).agg(*[v.alias(k) for k, v in picked.items()])
    between = [F.col(f"v{int(x) + 1}") + (F.coalesce(f"v{int(x) + 2}", f"v{int(x) + 1}") - F.col(f"v{int(x) + 1}")) * (x - int(x)) for x in at]
    ratio = F.lit(valid / total if total else None).cast("double")
    return out.select(F.lit(total).cast("long").alias("total"), F.lit(valid).cast("long").alias("valid"), ratio.alias("ratio"), *[v.alias(f"p{round(100 * q)}") for v, q in zip(between, PERCENTS)])


def masked_mse(pred: DataFrame) -> DataFrame:
    """Mean over stations of the mean squared error where mask is 0, by method."""
    own = pred.where("mask = 0").groupBy("method", "station_id").agg(F.avg(F.pow(F.col("out") - F.col("tgt"), F.lit(2))).alias("mse"))
    return own.groupBy("method").agg(F.avg("mse").alias("mse"))


def paired_ttest_p(pred: DataFrame, a: str, b: str) -> DataFrame:
    """paired_ttest with the two-sided p of each bin: as many rows as bins."""

    @F.pandas_udf("double")
    def p(t: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([None if np.isnan(x) or m < 2 else t_p_value(x, m - 1) for x, m in zip(t, n)], dtype=float)

    return paired_ttest(pred, a, b).withColumn("p", p("t", "n"))


def bin_errors_best_ref(pred: DataFrame, best: str, threshold: float, least: int) -> DataFrame:
    """bin_errors_given_hit, of bins with at least `least` samples of a method."""
    return bin_errors_given_hit(pred, best, threshold).where(F.col("n") >= least)


def _peak_places(x: np.ndarray, height: float, prominence: float, distance: int) -> list[int]:
    rise = np.flatnonzero(np.diff(x))
    starts, ends = np.concatenate([[0], rise + 1]), np.concatenate([rise, [len(x) - 1]])
    tops = [(a + b) // 2 for a, b in zip(starts, ends) if 0 < a and b < len(x) - 1 and x[a - 1] < x[a] and x[b + 1] < x[b] and x[a] >= height]
    kept: list[int] = []
    for i in sorted(tops, key=lambda i: (-x[i], -i)):  # the higher peak wins
        if all(abs(i - j) >= distance for j in kept):
            kept.append(i)
    out = []
    for i in sorted(kept):
        higher = np.flatnonzero(x > x[i])
        left, right = higher[higher < i], higher[higher > i]
        base = max(x[(left[-1] if len(left) else 0) : i + 1].min(), x[i : (right[0] if len(right) else len(x) - 1) + 1].min())
        if x[i] - base >= prominence:
            out.append(i)
    return out


def find_peaks(series: DataFrame, height: float = 0.6, prominence: float = 0.1, distance: int = 6) -> DataFrame:
    """station_id, pos, value of local maxima (the middle of a flat top) of a height and a prominence, `distance` samples apart.

    Of peaks nearer to each other the higher stays (equal: the later); one station's series meets in a task.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        return pdf.iloc[_peak_places(pdf["value"].to_numpy(float), height, prominence, distance)]

    s = series.where("value is not null").select("station_id", F.col("pos").cast("long").alias("pos"), "value")
    return s.groupBy("station_id").applyInPandas(run, "station_id long, pos long, value double")


def peak_metrics(truth: DataFrame, pred: DataFrame, reach: int = 6, **how) -> DataFrame:
    """One row: peaks of the truth, the share with a predicted peak at most `reach` steps off, the mean absolute error to
    the nearest such peak, and the share of stations without a true peak that have a predicted one (null without such stations).
    """
    stations = truth.select("station_id").distinct()
    t, p = find_peaks(truth, **how), find_peaks(pred, **how).withColumnsRenamed({"pos": "p_pos", "value": "p_value"})
    off = F.abs(F.col("pos") - F.col("p_pos"))
    near = t.join(p, "station_id").where(off <= reach).groupBy("station_id", "pos", "value").agg(F.min_by("p_value", F.struct(off, "p_pos")).alias("p_value"))
    hits = t.join(near, ["station_id", "pos", "value"], "left").agg(F.count(F.lit(1)).alias("peaks"), F.avg(F.col("p_value").isNotNull().cast("int")).alias("recall"), F.avg(F.abs(F.col("p_value") - F.col("value"))).alias("mae"))
    calm = stations.join(t, "station_id", "left_anti").join(p.select("station_id", F.lit(1).alias("f")).distinct(), "station_id", "left")
    return hits.join(F.broadcast(calm.agg(F.avg(F.coalesce("f", F.lit(0))).alias("false_rate"))))  # one row each
