"""Ordered operators over series: gap filling, interpolation, trends, rank tests, anomalies, correlation.

A series is the rows of one key. Positions count all dates of the calendar, missing ones included.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from geocadence.functions import special
from geocadence.operators.ordered import numbered


def fill_linear(df: DataFrame, max_gap: int | None = None, *, key: str = "pixel_id", ts: str = "ts", value: str = "value", out: str = "filled") -> DataFrame:
    """Linear gap filling between the valid neighbours in time; no extrapolation; gaps over ``max_gap`` days stay."""
    w = W.partitionBy(key).orderBy(ts)
    pair = F.when(F.col(value).isNotNull(), F.struct(F.col(ts).alias("t"), F.col(value).alias("v")))
    before = F.last(pair, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    after = F.first(pair, ignorenulls=True).over(w.rowsBetween(0, W.unboundedFollowing))
    got = df.withColumn("_b", before).withColumn("_a", after)
    gap, share = F.datediff("_a.t", "_b.t"), F.datediff(F.col(ts), "_b.t")
    line = F.col("_b.v") + (F.col("_a.v") - F.col("_b.v")) * share / gap
    allowed = F.lit(True) if max_gap is None else gap <= max_gap
    return got.withColumn(out, F.when(F.col(value).isNotNull(), F.col(value)).when(allowed & (gap > 0), line)).drop("_a", "_b")


def regular_dates(df: DataFrame, step: int, *, ts: str = "ts") -> DataFrame:
    """One row per date of a regular grid over the table's span: floor((end - start + 1) / step) dates."""
    span = df.agg(F.min(ts).alias("a"), F.max(ts).alias("b"))
    n = F.floor((F.datediff("b", "a") + 1) / step).cast("int")
    return span.where("a IS NOT NULL").select(F.explode(F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.date_add(F.col("a"), k * step))).alias("grid_ts"))


def daily(df: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    return df.where(F.col(value).isNotNull()).groupBy(F.col(key), F.col(ts).alias("ts")).agg(F.avg(value).alias("value"))


def interpolate(df: DataFrame, method: str = "linear", *, step: int = 16, window: int = 16, sigma: Sequence[float] = (8, 16, 32), cutoff: float = 0.95, key: str = "pixel_id", ts: str = "ts", value: str = "value") -> DataFrame:
    """Series at the dates of a regular grid: linear (constant beyond the ends), moving mean of
    |t - x| <= window, or a mix of Gaussian kernels. Observations of a day are averaged first."""
    obs = daily(df, key, ts, value)
    grid = regular_dates(df, step, ts=ts)
    if method == "linear":
        both = obs.select(key, "ts", "value", F.lit(False).alias("is_grid")).unionByName(
            obs.select(key).distinct().crossJoin(F.broadcast(grid)).select(key, F.col("grid_ts").alias("ts"), F.lit(None).cast("double").alias("value"), F.lit(True).alias("is_grid"))
        )
        w = W.partitionBy(key).orderBy("ts").rangeBetween(W.unboundedPreceding, 0)
        v = W.partitionBy(key).orderBy("ts").rangeBetween(0, W.unboundedFollowing)
        dated = both.withColumn("ts", F.unix_date("ts"))
        pair = F.when(F.col("value").isNotNull(), F.struct(F.col("ts").alias("t"), "value"))
        got = dated.withColumn("b", F.last(pair, ignorenulls=True).over(w)).withColumn("a", F.first(pair, ignorenulls=True).over(v)).where("is_grid")
        line = F.when(F.col("b").isNull(), F.col("a.value")).when(F.col("a").isNull() | (F.col("a.t") == F.col("b.t")), F.col("b.value"))
        line = line.otherwise(F.col("b.value") + (F.col("a.value") - F.col("b.value")) * (F.col("ts") - F.col("b.t")) / (F.col("a.t") - F.col("b.t")))
        return got.select(key, F.date_from_unix_date("ts").alias("ts"), line.alias("value"))
    if method == "moving":
        reach, weights = window, [(d, 1.0) for d in range(window + 1)]
    else:
        weights = special.rbf_weights(sigma, cutoff)
        reach = max(d for d, _ in weights)
    table = F.broadcast(df.sparkSession.createDataFrame([(int(d), float(w)) for d, w in weights], "_d int, _w double"))
    # each observation meets the grid dates in reach: a bounded number, found by arithmetic, not by comparison
    first = df.agg(F.min(ts).alias("origin"), F.max(ts).alias("last"))
    n = F.floor((F.datediff("last", "origin") + 1) / step).cast("int")
    day = F.datediff("ts", "origin")
    lo, hi = F.greatest(F.lit(0), F.ceil((day - reach) / step).cast("int")), F.least(n - 1, F.floor((day + reach) / step).cast("int"))
    met = obs.crossJoin(F.broadcast(first)).where(lo <= hi).withColumn("k", F.explode(F.sequence(lo, hi)))
    met = met.withColumn("_d", F.abs(day - F.col("k") * step)).join(table, "_d")
    got = met.groupBy(key, "k").agg((F.sum(F.col("value") * F.col("_w")) / F.sum("_w")).alias("value"))
    frame = obs.select(key).distinct().crossJoin(F.broadcast(grid.crossJoin(first).select((F.datediff("grid_ts", "origin") / step).cast("int").alias("k"), "grid_ts")))
    return frame.join(got, [key, "k"], "left").select(key, F.col("grid_ts").alias("ts"), "value")


def positions(df: DataFrame, step: str) -> DataFrame:
    """Add ``pos``: 0-based position of each step in the calendar of all series (a small distinct table)."""
    calendar = df.select(step).distinct().withColumn("pos", F.row_number().over(W.orderBy(step)) - 1)
    return df.join(F.broadcast(calendar), step)


def linear_trend(df: DataFrame, *, step: str = "year", key: str = "pixel_id", value: str = "value", conf: float = 0.95) -> DataFrame:
    """Least squares on the position: mean, offset (fit at the first step), slope, pct_gain, abs_gain, rsq, sig,
    rmse, mae, maxe, num, len. Fewer than three valid values give nulls. ``sig`` is 1 / -1 / 0 by an exact t-test."""
    p = positions(df, step)
    length = df.select(step).distinct().count()
    x, y = F.when(F.col(value).isNotNull(), F.col("pos").cast("double")), F.col(value)
    fit = p.groupBy(key).agg(
        F.avg(y).alias("mean"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("offset"), F.regr_r2(y, x).alias("rsq"),
        F.count(y).alias("num"), F.regr_sxx(y, x).alias("sxx"),
    ).where("num >= 3")
    error = F.col(value) - (F.col("offset") + F.col("slope") * F.col("pos"))
    back = p.join(fit, key).where(F.col(value).isNotNull()).withColumn("e", error)
    sums = back.groupBy(key).agg(F.sum(F.col("e") * F.col("e")).alias("sse"), F.avg(F.abs("e")).alias("mae"), F.max(F.abs("e")).alias("maxe"))
    rows = [(n, special.t_quantile(1 - (1 - conf) / 2, n - 2)) for n in range(3, length + 1)]
    crit = F.broadcast(df.sparkSession.createDataFrame(rows or [], "num long, crit double"))
    out = fit.join(sums, key).join(crit, "num", "left")
    t = F.try_divide(F.col("slope"), F.sqrt(F.col("sse") / (F.col("num") - 2)) / F.sqrt("sxx"))
    sig = F.when(F.abs(t) > F.col("crit"), F.signum("slope")).otherwise(0.0).cast("int")
    gain = F.col("slope") * length
    pct = F.when(F.col("offset") > 0, gain / F.col("offset") * 100).otherwise(0.0)
    return df.select(key).distinct().join(out.select(key, "mean", "offset", "slope", pct.alias("pct_gain"), gain.alias("abs_gain"), "rsq", sig.alias("sig"), F.sqrt(F.col("sse") / F.col("num")).alias("rmse"), "mae", "maxe", "num"), key, "left").withColumn("len", F.lit(length))


def greatest_step_loss(df: DataFrame, *, step: str = "year", key: str = "pixel_id", value: str = "value") -> DataFrame:
    """Change, aftereffect, trend: the greatest drop from a valid value to the next, and the slopes before and after.

    before = steps [0, f - 1), after = steps [f, n), f the position of the drop; the first of equal drops wins.
    """
    p = positions(df, step).where(F.col(value).isNotNull())
    w = W.partitionBy(key).orderBy("pos")
    drops = p.withColumn("drop", F.lag(value).over(w) - F.col(value)).where("drop IS NOT NULL")
    top = drops.groupBy(key).agg(F.max(F.struct("drop", (-F.col("pos")).alias("n"), F.col(step).alias("s"))).alias("m"))
    top = top.select(key, F.col("m.drop").alias("change"), (-F.col("m.n")).alias("f"), F.col("m.s").alias("change_time"))
    j = p.join(top, key)
    part = lambda c: (F.when(c, F.col(value)), F.when(c, F.col("pos").cast("double")))
    before, after = part(F.col("pos") < F.col("f") - 1), part(F.col("pos") >= F.col("f"))
    return j.groupBy(key, "change", "change_time").agg(
        F.regr_slope(F.col(value), F.col("pos").cast("double")).alias("total_slope"), F.regr_slope(*before).alias("before_slope"), F.regr_slope(*after).alias("after_slope"),
        F.avg(before[0]).alias("before_mean"), F.avg(after[0]).alias("after_mean"),
    )


def _z(s: Column, var: Column) -> Column:
    return F.when(s > 0, (s - 1) / F.sqrt(var)).when(s < 0, (s + 1) / F.sqrt(var)).otherwise(0.0)


def mann_kendall(df: DataFrame, *, step: str = "year", key: str = "pixel_id", value: str = "value", period: int = 1, alpha: float = 0.05, min_valid: int = 4) -> DataFrame:
    """Original (period 1) or seasonal Mann-Kendall test with Theil-Sen slope, all with array functions.

    Each series becomes one sorted array, so pairs never leave the row. Slopes divide by position gaps
    (seasonal: by gaps in whole periods). trend 1 / -1 / 0, h, p, z, tau, s, var_s, slope, intercept.
    """
    p = positions(df, step).where(F.col(value).isNotNull())
    pair = F.struct(F.col("pos").alias("i"), F.col(value).alias("v"))
    series = p.groupBy(key).agg(F.array_sort(F.collect_list(pair)).alias("a")).where(F.size("a") >= min_valid)
    seasons = series.select(key, "a", F.explode(F.sequence(F.lit(0), F.lit(period - 1))).alias("k")).withColumn("a", F.filter("a", lambda x: x["i"] % period == F.col("k")))
    n = F.size("a")
    pairs = F.flatten(F.transform("a", lambda x: F.transform(F.filter("a", lambda y: y["i"] > x["i"]), lambda y: F.struct(F.signum(y["v"] - x["v"]).alias("g"), ((y["v"] - x["v"]) / ((y["i"] - x["i"]) / period)).alias("b")))))
    values = F.transform("a", lambda x: x["v"])
    ties = F.aggregate(
        F.transform(F.array_distinct(values), lambda v: F.size(F.filter("a", lambda x: x["v"] == v)).cast("double")), F.lit(0.0), lambda acc, t: acc + t * (t - 1) * (2 * t + 5)
    )
    each = seasons.withColumn("q", pairs).select(
        key, F.aggregate("q", F.lit(0.0), lambda acc, x: acc + x["g"]).alias("s"), ((n * (n - 1) * (2 * n + 5) - ties) / 18).alias("var"), F.transform("q", lambda x: x["b"]).alias("b"), (n * (n - 1) / 2).alias("pairs")
    )
    pooled = each.groupBy(key).agg(F.sum("s").alias("s"), F.sum("var").alias("var_s"), F.sum("pairs").alias("pairs"))
    slopes = each.select(key, F.explode("b").alias("b")).groupBy(key).agg(F.median("b").alias("slope"))
    middle = p.groupBy(key).agg(F.median(value).alias("mv"), F.median("pos").alias("mi"))
    out = pooled.join(slopes, key, "left").join(middle, key)
    z = F.when(F.col("var_s") > 0, _z(F.col("s"), F.col("var_s")))
    out = out.withColumn("z", z).withColumn("p", special.normal_two_sided(F.abs("z")))
    h = F.coalesce(F.abs("z") > special.normal_quantile(1 - alpha / 2), F.lit(False))
    scored = out.withColumn("h", h).withColumn("trend", F.when(h, F.signum("z")).otherwise(0.0).cast("int"))
    return scored.select(key, "trend", "h", "p", "z", F.try_divide("s", "pairs").alias("tau"), "s", "var_s", "slope", (F.col("mv") - F.col("mi") / period * F.col("slope")).alias("intercept"))


def desawtooth_classes(df: DataFrame, max_length: int = 1, *, key: str = "pixel_id", order: Sequence[str] = ("ts", "seq"), value: str = "class") -> DataFrame:
    """Runs of at most ``max_length`` valid dates between two runs of one other class take that class."""
    w = W.partitionBy(key).orderBy(*order)
    valid = df.where(F.col(value).isNotNull())
    started = valid.withColumn("_new", F.when(F.lag(value).over(w) == F.col(value), 0).otherwise(1))
    run = started.withColumn("_run", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    runs = run.groupBy(key, "_run", value).agg(F.count("*").alias("n"))
    r = W.partitionBy(key).orderBy("_run")
    runs = runs.withColumn("_p", F.lag(value).over(r)).withColumn("_q", F.lead(value).over(r))
    fixed = runs.select(key, "_run", F.when((F.col("n") <= max_length) & (F.col("_p") == F.col("_q")), F.col("_p")).otherwise(F.col(value)).alias("smoothed"))
    return run.join(fixed, [key, "_run"]).drop("_new", "_run")


def anomaly(df: DataFrame, kind: str = "month", *, key: str = "pixel_id", month: str = "month", value: str = "value") -> DataFrame:
    """Value less the mean of the series ("mean") or of the series and calendar month ("month")."""
    w = W.partitionBy(key, F.month(month)) if kind == "month" else W.partitionBy(key)
    return df.withColumn("anomaly", F.col(value) - F.avg(value).over(w))


def lagged_correlation(x: DataFrame, y: DataFrame, lags: Sequence[int] = (0, 1, 2, 3), *, key: str = "pixel_id", month: str = "month", value: str = "value", min_pairs: int = 10, rank: bool = False) -> DataFrame:
    """Correlation of each series with a driver ``lag`` months earlier, with effective sample size and p-value.

    n_eff = n (1 - r) / (1 + r) with r the product of both lag-1 autocorrelations, held in [0, 0.99].
    """
    number = lambda c: F.year(c) * 12 + F.month(c)
    left = x.where(F.col(value).isNotNull()).select(key, number(month).alias("m"), F.col(value).alias("a"))
    right = y.where(F.col(value).isNotNull()).select(number(month).alias("m"), F.col(value).alias("b"))
    shifted = F.broadcast(right.withColumn("lag", F.explode(F.array(*map(F.lit, lags)))).select((F.col("m") + F.col("lag")).alias("m"), "lag", "b"))
    pairs = left.join(shifted, "m")
    if rank:
        average = lambda c: F.rank().over(W.partitionBy(key, "lag").orderBy(c)) + (F.count("*").over(W.partitionBy(key, "lag", c)) - 1) / 2
        pairs = pairs.withColumn("ra", average("a")).withColumn("rb", average("b")).select(key, "m", "lag", F.col("ra").alias("a"), F.col("rb").alias("b"))
    w = W.partitionBy(key, "lag").orderBy("m")
    before = pairs.withColumn("pm", F.lag("m").over(w)).withColumn("pa", F.when(F.col("pm") == F.col("m") - 1, F.lag("a").over(w))).withColumn("pb", F.when(F.col("pm") == F.col("m") - 1, F.lag("b").over(w)))
    got = before.groupBy(key, "lag").agg(F.corr("a", "b").alias("r"), F.count("*").alias("n"), F.corr("a", "pa").alias("ra"), F.corr("b", "pb").alias("rb")).where(F.col("n") >= min_pairs)
    rho = F.least(F.lit(0.99), F.greatest(F.lit(0.0), F.coalesce(F.col("ra") * F.col("rb"), F.lit(0.0))))
    return got.withColumn("n_eff", F.col("n") * (1 - rho) / (1 + rho)).select(key, "lag", "r", "n", "n_eff")


def best_lag(correlations: DataFrame, *, key: str = "pixel_id") -> DataFrame:
    """The lag of greatest absolute correlation; the smallest lag on ties."""
    m = F.max(F.struct(F.abs(F.round("r", 9)).alias("s"), (-F.col("lag")).alias("l"), "r", "n")).alias("m")
    return correlations.groupBy(key).agg(m).select(key, F.col("m.r").alias("best_r"), (-F.col("m.l")).alias("best_lag"), F.col("m.n").alias("n"))


def fdr(df: DataFrame, p: str = "p", order: str = "pixel_id", alpha: float = 0.1) -> DataFrame:
    """Benjamini-Hochberg q-values and significance: ranks by ranges of (p, order), and the least of p m / k over a
    row's own range and the later ranges' minima."""
    ranked = numbered(df.where(F.col(p).isNotNull()), [p, order], "_k").withColumn("_r", F.col(p) * F.col("_m") / (F.col("_k") + 1))
    least = ranked.groupBy("_b").agg(F.min("_r").alias("_l"))
    later = least.select("_b", F.min("_l").over(W.orderBy(F.col("_b").desc()).rowsBetween(W.unboundedPreceding, -1)).alias("_later"))
    down = W.partitionBy("_b").orderBy(F.col(p).desc(), F.col(order).desc()).rowsBetween(W.unboundedPreceding, 0)
    q = F.least(F.lit(1.0), F.min("_r").over(down), F.coalesce("_later", F.lit(1.0)))
    out = ranked.join(F.broadcast(later), "_b").withColumn("q", q).withColumn("significant", F.col("q") <= alpha)
    return out.drop("_k", "_m", "_r", "_b", "_later")


def recovery(df: DataFrame, events: DataFrame, *, horizon: int = 5, pre_years: int = 2, target: float = 0.8, key: str = "pixel_id", year: str = "year", value: str = "value") -> DataFrame:
    """Recovery after an event (key, yod): pre_val (mean of the years before), dist_val, magnitude, post_val
    (mean of the horizon's last two years), ari, rri, r80p, yryr, y2r (years until the target share of pre_val)."""
    j = df.where(F.col(value).isNotNull()).join(events.select(key, "yod"), key).withColumn("dt", F.col(year) - F.col("yod"))
    v, dt = F.col(value), F.col("dt")
    a = j.groupBy(key, "yod").agg(
        F.avg(F.when(dt.between(-pre_years, -1), v)).alias("pre_val"), F.avg(F.when(dt == 0, v)).alias("dist_val"),
        F.max(F.when(dt.between(horizon - 1, horizon), v)).alias("peak"), F.avg(F.when(dt.between(horizon - 1, horizon), v)).alias("post_val"),
        F.array_sort(F.collect_list(F.when(dt > 0, F.struct(dt.alias("dt"), v.alias("v"))))).alias("after"),
    )
    level = F.col("pre_val") * target
    years = F.try_element_at(F.transform(F.filter("after", lambda s: s["v"] >= level), lambda s: s["dt"]), F.lit(1))
    loss = F.col("pre_val") - F.col("dist_val")
    ari = F.col("peak") - F.col("dist_val")
    return a.select(key, "yod", "pre_val", "dist_val", loss.alias("magnitude"), "post_val", ari.alias("ari"), F.try_divide(ari, loss).alias("rri"), F.try_divide(F.col("peak"), level).alias("r80p"), (ari / horizon).alias("yryr"), years.alias("y2r"))
