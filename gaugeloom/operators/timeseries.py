"""Gaps, runs, weeks and windows of time series. Every shuffle is by station, so stations scale out."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def by_time():
    return Window.partitionBy("station_id").orderBy("ts")


def by_pos():
    return Window.partitionBy("station_id").orderBy("pos")


def gap_report(readings: DataFrame, step_s: int, tolerance_s: float = 0) -> DataFrame:
    """Consecutive readings whose distance isn't the step."""
    gap = F.unix_timestamp("ts") - F.unix_timestamp(F.lag("ts").over(by_time()))
    return readings.select("station_id", F.lag("ts").over(by_time()).alias("gap_from"), F.col("ts").alias("gap_to"), gap.alias("gap_s")).where(F.abs(F.col("gap_s") - step_s) > tolerance_s)


def resample_daily(readings: DataFrame) -> DataFrame:
    """Daily mean, with a row for each day between a station's first and last; empty days are null."""
    daily = readings.groupBy("station_id", F.to_date("ts").alias("day")).agg(F.avg("value").alias("value"))
    calendar = daily.groupBy("station_id").agg(F.explode(F.sequence(F.min("day"), F.max("day"))).alias("day"))
    return calendar.join(daily, ["station_id", "day"], "left")


def full_months(readings: DataFrame, mode: str = "ref") -> DataFrame:
    """Readings of complete months. ref: from the first of a month to the last day that is present, once gaps are filled; calendar: all days."""
    days = readings.groupBy("station_id", F.trunc("ts", "month").alias("month")).agg(F.min(F.dayofmonth("ts")).alias("first"), F.max(F.dayofmonth("ts")).alias("last"), F.countDistinct(F.to_date("ts")).alias("n"))
    earlier = readings.groupBy("station_id").agg(F.min(F.to_date("ts")).alias("start"))
    if mode == "calendar":
        good = days.where(F.col("n") == F.dayofmonth(F.last_day("month")))
    elif mode == "ref":  # gaps are filled between a station's first and last day, so only the very first month can start late
        good = days.join(earlier, "station_id").where((F.col("start") <= F.col("month")))
    else:
        raise ValueError(f"unknown mode {mode}")
    keyed = readings.withColumn("month", F.trunc("ts", "month"))
    return keyed.join(good.select("station_id", "month"), ["station_id", "month"], "left_semi").select(*readings.columns)


def contiguous_runs(readings: DataFrame, step_s: int, mode: str = "exact") -> DataFrame:
    """Readings with the number of their gap-free run. exact: another step breaks; gap_only: only a longer one does."""
    delta = F.unix_timestamp("ts") - F.unix_timestamp(F.lag("ts").over(by_time()))
    broken = delta != step_s if mode == "exact" else delta > step_s + 1
    breaks = F.sum(F.when(broken, 1).otherwise(0)).over(by_time().rowsBetween(Window.unboundedPreceding, 0))
    return readings.withColumn("run", F.coalesce(breaks, F.lit(0)).cast("int"))


def run_lengths(readings: DataFrame, step_s: int, mode: str = "exact") -> DataFrame:
    return contiguous_runs(readings, step_s, mode).groupBy("station_id", "run").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count(F.lit(1)).alias("n"))


def weekly_segments(readings: DataFrame, step_s: int, mode: str = "exact", require_successor: bool = True) -> DataFrame:
    """Complete weeks on the global origin: station_id, week_idx, values. A run must reach a week's end (require_successor)."""
    per_week, week = 7 * 86400 // step_s, 7 * 86400
    origin = readings.agg(F.min(F.unix_timestamp("ts")).alias("origin"))  # one row, over all stations
    runs = contiguous_runs(readings, step_s, mode).join(F.broadcast(origin))
    runs = runs.withColumn("week_idx", F.floor((F.unix_timestamp("ts") - F.col("origin")) / week).cast("int"))
    last = F.max(F.unix_timestamp("ts")).over(Window.partitionBy("station_id", "run"))
    runs = runs.withColumn("last", last)
    pairs = F.array_sort(F.collect_list(F.struct(F.col("ts"), F.col("value"))))
    weeks = runs.groupBy("station_id", "run", "week_idx").agg(F.count(F.lit(1)).alias("n"), F.first("last").alias("last"), F.first("origin").alias("origin"), pairs.alias("pairs")).where(F.col("n") == per_week)
    if require_successor:
        weeks = weeks.where(F.col("origin") + (F.col("week_idx") + 1) * week <= F.col("last"))
    return weeks.select("station_id", "week_idx", F.transform("pairs", lambda p: p["value"]).alias("values"))


def trailing_mean(series: DataFrame, width: int) -> DataFrame:
    return series.withColumn("value", F.avg("value").over(by_pos().rowsBetween(-(width - 1), 0)))


def lag_edgefill(series: DataFrame, k: int) -> DataFrame:
    first = F.first("value").over(by_pos().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return series.withColumn("value", F.coalesce(F.lag("value", k).over(by_pos()), first))


def window_mean_asym(series: DataFrame, half: int) -> DataFrame:
    """Mean over positions [i - half, i + half)."""
    return series.withColumn("value", F.avg("value").over(by_pos().rowsBetween(-half, half - 1)))


def zscore(series: DataFrame, eps: float = 1e-8) -> DataFrame:
    whole = Window.partitionBy("station_id")
    return series.withColumn("value", (F.col("value") - F.avg("value").over(whole)) / (F.stddev_samp("value").over(whole) + eps))


def fixed_chunks(series: DataFrame, length: int) -> DataFrame:
    """Full chunks of a series: station_id, chunk, pos within the chunk, value; the tail goes."""
    n = F.count(F.lit(1)).over(Window.partitionBy("station_id"))
    return series.withColumn("n", n).withColumn("chunk", F.floor(F.col("pos") / length).cast("int")).where((F.col("chunk") + 1) * length <= F.col("n")).select("station_id", "chunk", (F.col("pos") % length).alias("pos"), "value")


def day_chunks(series: DataFrame, length: int = 24) -> DataFrame:
    chunks = fixed_chunks(series, length)
    return chunks.groupBy("station_id", "chunk").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda p: p["value"]).alias("values"))


def time_varying_fir(series: DataFrame, weights: list[float]) -> DataFrame:
    """y[t] = sum over k of weights[k] * x[t - K + 1 + k], zeros on the left."""
    k = len(weights)
    y = F.lit(0.0)
    for i, w in enumerate(weights):
        y = y + w * F.coalesce(F.lag("value", k - 1 - i).over(by_pos()), F.lit(0.0))
    return series.withColumn("value", y)


def _pairs(at: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of all equal positions of two ascending arrays."""
    low, high = np.searchsorted(other, at, "left"), np.searchsorted(other, at, "right")
    i = np.repeat(np.arange(len(at)), high - low)
    return i, np.arange(len(i)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + low[i]


def _correlations(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Correlation of each row of x with its row of y; 0 where one of them doesn't vary, or fewer than two places are known. nan: unknown."""
    known = ~(np.isnan(x) | np.isnan(y))
    n = np.maximum(known.sum(axis=1), 1)[:, None]
    flat = lambda a: np.where(known, a, np.inf).min(axis=1) >= np.where(known, a, -np.inf).max(axis=1)
    still = flat(x) | flat(y)
    x, y = (np.where(known, a, 0.0) for a in (x, y))
    x, y = (np.where(known, a - a.sum(axis=1, keepdims=True) / n, 0.0) for a in (x, y))
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(still, 0.0, (x * y).sum(axis=1) / np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1)))


def _best_lags(max_lag: int, overlap: int):
    """Best absolute correlation of each row's two series; rows whose positions are alike are one matrix."""

    def run(batches):
        for b in batches:
            station, *sides = b.columns
            told = []
            for side in sides:
                pos, value = side.flatten().flatten()
                told.append((np.diff(side.offsets.to_numpy()), np.append(0, np.cumsum(np.diff(side.offsets.to_numpy()))), pos.to_numpy(zero_copy_only=False).astype(np.int64), value.to_numpy(zero_copy_only=False).astype(float), value.is_null().to_numpy(zero_copy_only=False)))
            alike: dict[tuple[bytes, bytes], list[int]] = {}
            for i in range(b.num_rows):
                alike.setdefault(tuple(pos[start[i] : start[i + 1]].tobytes() for _, start, pos, _, _ in told), []).append(i)
            best = np.full(b.num_rows, -1.0)
            for rows in alike.values():
                at = [pos[start[rows[0]] : start[rows[0] + 1]] for _, start, pos, _, _ in told]
                lags = [(i, j) for i, j in (_pairs(at[0] + lag, at[1]) for lag in range(-max_lag, max_lag + 1)) if len(i) >= overlap]
                few = max(1, (1 << 18) // max(map(len, at)))
                for k in range(0, len(rows), few):
                    some = np.array(rows[k : k + few])
                    x, y = (value[start[some][:, None] + np.arange(len(p))] for p, (_, start, _, value, _) in zip(at, told))
                    odd = [np.isnan(value[start[some][:, None] + np.arange(len(p))]) & ~null[start[some][:, None] + np.arange(len(p))] for p, (_, start, _, value, null) in zip(at, told)]
                    top = best[some]
                    for i, j in lags:
                        c = np.abs(_correlations(x[:, i], y[:, j]))
                        c[(odd[0][:, i] | odd[1][:, j]).any(axis=1)] = np.nan  # values that aren't numbers have no correlation
                        top = np.maximum(top, c)
                    best[some] = top
            keep = np.flatnonzero(~(best < 0))
            yield pa.RecordBatch.from_arrays([station.take(pa.array(keep)), pa.array(best[keep])], ["station_id", "best"])

    return run


def lagged_corr_gate(water: DataFrame, rain: DataFrame, max_lag: int = 24, least: float = 0.05, power: float = 2, overlap: int = 8) -> DataFrame:
    """Best absolute correlation over lags and the gate least + (1 - least) * best ** power, by station.

    A station's two series meet as one row, and lags are looked up in it; they aren't rows.
    """
    whole = lambda df, name: df.where("pos is not null").groupBy("station_id").agg(F.sort_array(F.collect_list(F.struct(F.col("pos").cast("long").alias("pos"), F.col("value").cast("double").alias("value")))).alias(name))
    # Sizes of what comes out of exploded arrays aren't known, so neither side is broadcast.
    both = whole(water, "water").join(whole(rain, "rain").hint("merge"), "station_id").select("station_id", "water", "rain")
    best = both.mapInArrow(_best_lags(max_lag, overlap), f"station_id {water.schema['station_id'].dataType.simpleString()}, best double")
    return best.withColumn("gate", least + (1 - least) * F.pow("best", F.lit(power)))


def fir_table(series: DataFrame, weights: DataFrame) -> DataFrame:
    """y[t] = sum over k of w[t, k] * x[t - K + 1 + k], zeros on the left. weights: station_id, pos, w (an array of K)."""
    x = weights.select("station_id", F.col("pos").alias("at"), F.posexplode("w").alias("k", "w"), F.size("w").alias("n"))
    x = x.select("station_id", "at", "w", (F.col("at") - F.col("n") + 1 + F.col("k")).alias("pos"))
    y = x.join(series, ["station_id", "pos"]).groupBy("station_id", F.col("at").alias("pos")).agg(F.sum(F.col("w") * F.col("value")).alias("y"))
    return series.join(y, ["station_id", "pos"], "left").select("station_id", "pos", F.coalesce("y", F.lit(0.0)).alias("value"))


def sliding_windows(series: DataFrame, length: int, step: int) -> DataFrame:
    """Whole windows over each station's positions, from 0 in steps: station_id, win, pos, value."""
    own = Window.partitionBy("station_id")
    n = series.withColumn("n", F.max("pos").over(own) + 1)
    first, last = F.greatest(F.lit(0), F.ceil((F.col("pos") - length + 1) / step)), F.floor(F.col("pos") / step)
    wide = n.where(first <= last).withColumn("win", F.explode(F.sequence(first.cast("int"), last.cast("int"))))
    return wide.where(F.col("win") * step + length <= F.col("n")).select("station_id", "win", "pos", "value")


def savgol_trend(series: DataFrame, share: float = 0.15) -> DataFrame:
    """Local quadratic trend over a window of that share of the series, made odd; the first and last half take the fit of the outermost window.

    A series is one row of a bounded length here, and each place a sum over its window.
    """
    rows = series.groupBy("station_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda p: p["value"]).alias("y"))
    half = F.greatest(F.lit(1), F.floor(F.floor(F.size("y") * share) / 2)).cast("int")
    rows = rows.withColumn("h", half).where(F.size("y") >= 2 * F.col("h") + 1)
    h = F.col("h").cast("double")
    s0, s2 = 2 * h + 1, h * (h + 1) * (2 * h + 1) / 3
    s4 = s2 * (3 * h * h + 3 * h - 1) / 5

    def fitted(y: Column, t: Column) -> Column:
        start = F.least(F.greatest(t - F.col("h"), F.lit(0)), F.size("y") - 2 * F.col("h") - 1)
        u = F.transform(F.slice(F.col("y"), start + 1, 2 * F.col("h") + 1), lambda v, i: F.struct(v.alias("v"), (i - F.col("h")).cast("double").alias("u")))
        total = lambda f: F.aggregate(u, F.lit(0.0), lambda acc, p: acc + f(p))
        y0, y1, y2 = total(lambda p: p["v"]), total(lambda p: p["u"] * p["v"]), total(lambda p: p["u"] * p["u"] * p["v"])
        at = (t - start - F.col("h")).cast("double")
        a2 = (s0 * y2 - s2 * y0) / (s0 * s4 - s2 * s2)
        return (y0 - a2 * s2) / s0 + y1 / s2 * at + a2 * at * at

    trend = F.transform(F.sequence(F.lit(0), F.size("y") - 1), lambda t: fitted(F.col("y"), t))
    return rows.select("station_id", F.posexplode(trend).alias("pos", "trend"))


def fluctuation_score(series: DataFrame, share: float = 0.15, length: int = 16, crossings: float = 0.1, scatter: float = 0.5) -> DataFrame:
    """Half the share of energy that the trend leaves, and half the share of half-overlapping windows of the rest that cross zero often and vary much."""
    r = series.join(savgol_trend(series, share), ["station_id", "pos"]).withColumn("rest", F.col("value") - F.col("trend"))
    whole = r.groupBy("station_id").agg(F.coalesce(F.try_divide(F.sum(F.pow("rest", F.lit(2))), F.sum(F.pow("value", F.lit(2)))), F.lit(0.0)).alias("energy"), F.stddev_pop("rest").alias("std"))
    w = sliding_windows(r.select("station_id", "pos", F.col("rest").alias("value")), length, length // 2)
    before = F.lag("value").over(Window.partitionBy("station_id", "win").orderBy("pos"))
    w = w.withColumn("cross", F.coalesce((F.signum("value") != F.signum(before)).cast("int"), F.lit(0)))
    w = w.groupBy("station_id", "win").agg((F.sum("cross") / (length - 1)).alias("rate"), F.stddev_pop("value").alias("own"))
    lively = w.join(whole, "station_id").groupBy("station_id").agg(F.avg(((F.col("rate") > crossings) & (F.col("own") > scatter * F.col("std"))).cast("double")).alias("lively"))
    return whole.join(lively, "station_id", "left").select("station_id", (0.5 * F.col("energy") + 0.5 * F.coalesce("lively", F.lit(0.0))).alias("score"))


def gated_loss(pred: DataFrame, gate: DataFrame) -> DataFrame:
    """Sum of gate times squared error over the sum of gates, by method. gate: station_id, gate."""
    p = pred.join(gate, "station_id")
    return p.groupBy("method").agg((F.sum(F.col("gate") * F.pow(F.col("out") - F.col("tgt"), F.lit(2))) / F.sum("gate")).alias("loss"))
