"""Queries of ordered operators over series."""

from __future__ import annotations

from pyspark.sql import functions as F

from geocadence.functions import special
from geocadence.operators import series
from geocadence.sources.tables import ANNUAL_SQL, MONTHLY_SQL, OBS_SQL, annual, monthly, observations, read, sql

QUERIES, ORACLE_SQL = {}, {}


def _daily(spark, d):
    """One value per pixel and day; a third of the days is missing."""
    o = observations(spark, d).groupBy("pixel_id", "ts").agg(F.sqrt(F.round(F.sum("value"), 2) / F.count("value")).alias("v"))
    return o.select("pixel_id", "ts", F.when((F.col("pixel_id") + F.unix_date("ts")) % 3 != 0, F.col("v")).alias("value"))


DAILY_SQL = "daily AS (SELECT pixel_id, ts, CASE WHEN (pixel_id + (ts - DATE '1970-01-01')) % 3 <> 0 THEN v END AS value FROM (SELECT pixel_id, ts, sqrt(round(sum(value), 2) / count(value)) AS v FROM obs GROUP BY ALL))"


def _fill(name, gap):
    QUERIES[name] = lambda spark, d: series.fill_linear(_daily(spark, d), gap).select("pixel_id", "ts", F.round("filled", 6).alias("filled"))
    rule = "" if gap is None else f"AND aft - bt <= {gap}"
    ORACLE_SQL[name] = sql(OBS_SQL, DAILY_SQL, """n AS (SELECT *, last_value(CASE WHEN value IS NOT NULL THEN ts END IGNORE NULLS) OVER b AS bt, last_value(value IGNORE NULLS) OVER b AS bv,
  first_value(CASE WHEN value IS NOT NULL THEN ts END IGNORE NULLS) OVER a AS aft, first_value(value IGNORE NULLS) OVER a AS av FROM daily
  WINDOW b AS (PARTITION BY pixel_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY pixel_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))""",
        select=f"SELECT pixel_id, ts, round(CASE WHEN value IS NOT NULL THEN value WHEN aft > bt {rule} THEN bv + (av - bv) * (ts - bt) / (aft - bt) END, 6) AS filled FROM n")


_fill("gapfill_linear", None)
_fill("gapfill_linear_maxgap", 3)

_SPAN = "s AS (SELECT min(ts) AS a, max(ts) AS b FROM obs), g AS (SELECT CAST(a + CAST(k * 2 AS INTEGER) AS DATE) AS gts FROM (SELECT a, unnest(range(0, CAST(floor((b - a + 1) / 2.0) AS BIGINT))) AS k FROM s))"
_DAYS = "dd AS (SELECT pixel_id, ts, avg(value) AS value FROM obs WHERE value IS NOT NULL GROUP BY ALL), f AS (SELECT p.pixel_id, g.gts FROM (SELECT DISTINCT pixel_id FROM dd) p CROSS JOIN g)"
QUERIES["interp_linear"] = lambda spark, d: series.interpolate(observations(spark, d), "linear", step=2).select("pixel_id", "ts", F.round("value", 6).alias("value"))
ORACLE_SQL["interp_linear"] = sql(OBS_SQL, _SPAN, _DAYS, "x AS (SELECT f.pixel_id, f.gts, max(CASE WHEN dd.ts <= f.gts THEN dd.ts END) AS bt, min(CASE WHEN dd.ts >= f.gts THEN dd.ts END) AS aft FROM f JOIN dd ON dd.pixel_id = f.pixel_id GROUP BY ALL)",
    select="""SELECT x.pixel_id, x.gts AS ts, round(CASE WHEN bt IS NULL THEN a.value WHEN aft IS NULL OR aft = bt THEN b.value ELSE b.value + (a.value - b.value) * (x.gts - bt) / (aft - bt) END, 6) AS value
FROM x LEFT JOIN dd a ON a.pixel_id = x.pixel_id AND a.ts = x.aft LEFT JOIN dd b ON b.pixel_id = x.pixel_id AND b.ts = x.bt""")  # fmt: skip
QUERIES["interp_moving"] = lambda spark, d: series.interpolate(observations(spark, d), "moving", step=2, window=3).select("pixel_id", "ts", F.round("value", 6).alias("value"))
ORACLE_SQL["interp_moving"] = sql(OBS_SQL, _SPAN, _DAYS, select="SELECT f.pixel_id, f.gts AS ts, round(avg(dd.value), 6) AS value FROM f LEFT JOIN dd ON dd.pixel_id = f.pixel_id AND abs(dd.ts - f.gts) <= 3 GROUP BY ALL")
QUERIES["interp_rbf"] = lambda spark, d: series.interpolate(observations(spark, d), "rbf", step=2, sigma=(2, 4)).select("pixel_id", "ts", F.round("value", 6).alias("value"))
_W = ", ".join(f"({a}, {b!r})" for a, b in special.rbf_weights((2, 4), 0.95))
ORACLE_SQL["interp_rbf"] = sql(OBS_SQL, _SPAN, _DAYS, f"w(d, w) AS (VALUES {_W})", select="SELECT f.pixel_id, f.gts AS ts, round(sum(dd.value * CAST(w AS DOUBLE)) / sum(CASE WHEN dd.value IS NOT NULL THEN CAST(w AS DOUBLE) END), 6) AS value FROM f LEFT JOIN (dd JOIN w ON TRUE) ON dd.pixel_id = f.pixel_id AND abs(dd.ts - f.gts) = w.d GROUP BY ALL")

_POS = "cal AS (SELECT year, row_number() OVER (ORDER BY year) - 1 AS pos FROM (SELECT DISTINCT year FROM annual)), p AS (SELECT a.*, pos FROM annual a JOIN cal USING (year))"
_TREND = ("mean", "offset", "slope", "pct_gain", "abs_gain", "rsq", "rmse", "mae", "maxe")
QUERIES["linear_trend_yearly"] = lambda spark, d: series.linear_trend(annual(spark, d)).select("pixel_id", *[F.round(c, 4).alias(c) for c in _TREND], "sig", "num", "len")
_CRIT = ", ".join(f"({n}, {special.t_quantile(0.975, n - 2)!r})" for n in range(3, 12))
ORACLE_SQL["linear_trend_yearly"] = sql(ANNUAL_SQL, _POS, f"crit(n, c) AS (VALUES {_CRIT})", "l AS (SELECT count(*) AS len FROM cal)",
    "f AS (SELECT pixel_id, avg(value) AS mean, regr_slope(value, pos) AS slope, regr_intercept(value, pos) AS off, regr_r2(value, pos) AS rsq, count(value) AS num, regr_sxx(value, pos) AS sxx FROM p GROUP BY pixel_id HAVING count(value) >= 3)",
    "e AS (SELECT p.pixel_id, sum(pow(value - off - slope * pos, 2)) AS sse, avg(abs(value - off - slope * pos)) AS mae, max(abs(value - off - slope * pos)) AS maxe FROM p JOIN f USING (pixel_id) WHERE value IS NOT NULL GROUP BY 1)",
    select="""SELECT k.pixel_id, round(mean, 4) AS mean, round(off, 4) AS "offset", round(slope, 4) AS slope, round(CASE WHEN off > 0 THEN slope * len / off * 100 ELSE 0 END, 4) AS pct_gain, round(slope * len, 4) AS abs_gain, round(rsq, 4) AS rsq,
  round(sqrt(sse / num), 4) AS rmse, round(mae, 4) AS mae, round(maxe, 4) AS maxe, CAST(CASE WHEN abs(slope / (sqrt(sse / (num - 2)) / sqrt(sxx))) > c THEN sign(slope) ELSE 0 END AS INTEGER) AS sig, num, CAST(len AS INTEGER) AS len
FROM (SELECT DISTINCT pixel_id FROM annual) k CROSS JOIN l LEFT JOIN f USING (pixel_id) LEFT JOIN e USING (pixel_id) LEFT JOIN crit ON crit.n = f.num""")  # fmt: skip

QUERIES["cat_yearly"] = lambda spark, d: series.greatest_step_loss(annual(spark, d)).select("pixel_id", "change_time", *[F.round(c, 4).alias(c) for c in ("change", "total_slope", "before_slope", "after_slope", "before_mean", "after_mean")])
ORACLE_SQL["cat_yearly"] = sql(ANNUAL_SQL, _POS, "v AS (SELECT *, lag(value) OVER (PARTITION BY pixel_id ORDER BY pos) - value AS dr FROM p WHERE value IS NOT NULL)",
    "m AS (SELECT pixel_id, year AS change_time, pos AS f, dr AS change FROM (SELECT *, row_number() OVER (PARTITION BY pixel_id ORDER BY dr DESC, pos) AS r FROM v WHERE dr IS NOT NULL) WHERE r = 1)",
    select="""SELECT m.pixel_id, change_time, round(change, 4) AS change, round(regr_slope(value, pos), 4) AS total_slope, round(regr_slope(value, pos) FILTER (pos < f - 1), 4) AS before_slope, round(regr_slope(value, pos) FILTER (pos >= f), 4) AS after_slope,
  round(avg(value) FILTER (pos < f - 1), 4) AS before_mean, round(avg(value) FILTER (pos >= f), 4) AS after_mean FROM v JOIN m USING (pixel_id) GROUP BY m.pixel_id, change_time, change""")  # fmt: skip

_MK = ("s", "var_s", "z", "tau", "slope", "intercept")
QUERIES["mk_original"] = lambda spark, d: series.mann_kendall(annual(spark, d)).select("pixel_id", "trend", *[F.round(c, 5).alias(c) for c in _MK])


def _mk_sql(cte, table, cal_step, period):
    return sql(cte, f"cal AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS pos FROM (SELECT DISTINCT {cal_step} AS t FROM {table}))",
        f"p AS (SELECT pixel_id, value, pos, pos % {period} AS k FROM {table} JOIN cal ON cal.t = {cal_step} WHERE value IS NOT NULL AND pixel_id IN (SELECT pixel_id FROM {table} WHERE value IS NOT NULL GROUP BY 1 HAVING count(*) >= 4))",
        f"q AS (SELECT x.pixel_id, sign(y.value - x.value) AS g, (y.value - x.value) / ((y.pos - x.pos) / {float(period)}) AS b FROM p x JOIN p y ON x.pixel_id = y.pixel_id AND x.k = y.k AND x.pos < y.pos)",
        "t AS (SELECT pixel_id, k, sum(t * (t - 1) * (2 * t + 5)) AS ties, sum(t) AS n FROM (SELECT pixel_id, k, value, count(*) AS t FROM p GROUP BY ALL) GROUP BY ALL)",
        "v AS (SELECT pixel_id, sum((n * (n - 1) * (2 * n + 5) - ties) / 18.0) AS var_s, sum(n * (n - 1) / 2.0) AS pairs FROM t GROUP BY 1)",
        "s AS (SELECT pixel_id, sum(g) AS s, median(b) AS slope FROM q GROUP BY 1)", "m AS (SELECT pixel_id, median(value) AS mv, median(pos) AS mi FROM p GROUP BY 1)",
        "z AS (SELECT *, CASE WHEN var_s > 0 THEN CASE WHEN s > 0 THEN (s - 1) / sqrt(var_s) WHEN s < 0 THEN (s + 1) / sqrt(var_s) ELSE 0 END END AS z FROM v JOIN s USING (pixel_id) JOIN m USING (pixel_id))",
        select=f"SELECT pixel_id, CAST(CASE WHEN abs(z) > {special.normal_quantile(0.975)!r} THEN sign(z) ELSE 0 END AS INTEGER) AS trend, round(s, 5) AS s, round(var_s, 5) AS var_s, round(z, 5) AS z, round(s / nullif(pairs, 0), 5) AS tau, round(slope, 5) AS slope, round(mv - mi / {float(period)} * slope, 5) AS intercept FROM z")


ORACLE_SQL["mk_original"] = _mk_sql(ANNUAL_SQL, "annual", "year", 1)
QUERIES["mk_seasonal"] = lambda spark, d: series.mann_kendall(monthly(spark, d), step="month", period=12).select("pixel_id", "trend", *[F.round(c, 5).alias(c) for c in _MK])
ORACLE_SQL["mk_seasonal"] = _mk_sql(MONTHLY_SQL, "monthly", "month", 12)
QUERIES["theil_sen"] = lambda spark, d: series.mann_kendall(annual(spark, d)).select("pixel_id", F.round("slope", 5).alias("slope"), F.round("intercept", 5).alias("intercept"))
ORACLE_SQL["theil_sen"] = sql(ANNUAL_SQL, _POS, "s AS (SELECT x.pixel_id, median((y.value - x.value) / (y.pos - x.pos)) AS slope FROM p x JOIN p y ON x.pixel_id = y.pixel_id AND x.pos < y.pos WHERE x.value IS NOT NULL AND y.value IS NOT NULL GROUP BY 1)",
    select="SELECT pixel_id, round(slope, 5) AS slope, round(median(value) - median(pos) * slope, 5) AS intercept FROM (SELECT * FROM p WHERE value IS NOT NULL) JOIN s USING (pixel_id) GROUP BY pixel_id, slope HAVING count(*) >= 4")

QUERIES["desawtooth_classes"] = lambda spark, d: series.desawtooth_classes(observations(spark, d).withColumn("class", F.col("band")).withColumn("pixel_id", F.col("pixel_id") % 20), 1).select("seq", "smoothed")
ORACLE_SQL["desawtooth_classes"] = sql(OBS_SQL, "o AS (SELECT pixel_id % 20 AS pixel_id, ts, seq, band FROM obs)", "a AS (SELECT *, CASE WHEN lag(band) OVER w = band THEN 0 ELSE 1 END AS nw FROM o WINDOW w AS (PARTITION BY pixel_id ORDER BY ts, seq))",
    "b AS (SELECT *, sum(nw) OVER (PARTITION BY pixel_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS run FROM a)", "r AS (SELECT pixel_id, run, band, count(*) AS n FROM b GROUP BY ALL)",
    "f AS (SELECT pixel_id, run, CASE WHEN n <= 1 AND lag(band) OVER w = lead(band) OVER w THEN lag(band) OVER w ELSE band END AS smoothed FROM r WINDOW w AS (PARTITION BY pixel_id ORDER BY run))",
    select="SELECT seq, smoothed FROM b JOIN f USING (pixel_id, run)")

for _kind, _part in (("month", "pixel_id, month(month)"), ("mean", "pixel_id")):
    _key = "monthly_anomaly" if _kind == "month" else "mean_anomaly"
    QUERIES[_key] = lambda spark, d, k=_kind: series.anomaly(monthly(spark, d), k).select("pixel_id", "month", F.round("anomaly", 7).alias("anomaly"))
    ORACLE_SQL[_key] = sql(MONTHLY_SQL, select=f"SELECT pixel_id, month, round(value - avg(value) OVER (PARTITION BY {_part}), 7) AS anomaly FROM monthly")


def _driver(spark, d):
    return read(spark, d, "orders").groupBy(F.trunc("o_orderdate", "MM").alias("month")).agg(F.sqrt(F.round(F.sum("o_totalprice"), 2) / F.count("o_totalprice")).alias("value"))


DRIVER_SQL = "driver AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, sqrt(round(sum(o_totalprice), 2) / count(o_totalprice)) AS value FROM orders GROUP BY ALL)"
_PAIRS = """pairs AS (SELECT x.pixel_id, l.lag, year(x.month) * 12 + month(x.month) AS m, x.value AS a, y.value AS b FROM monthly x CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS lag) l
  JOIN driver y ON year(y.month) * 12 + month(y.month) + l.lag = year(x.month) * 12 + month(x.month))"""
_CORR = """c AS (SELECT pixel_id, lag, corr(a, b) AS r, count(*) AS n, corr(a, pa) AS ra, corr(b, pb) AS rb FROM (
  SELECT *, CASE WHEN lag(m) OVER w = m - 1 THEN lag(a) OVER w END AS pa, CASE WHEN lag(m) OVER w = m - 1 THEN lag(b) OVER w END AS pb FROM pairs WINDOW w AS (PARTITION BY pixel_id, lag ORDER BY m)) GROUP BY ALL HAVING count(*) >= 10)"""
QUERIES["lagged_corr"] = lambda spark, d: series.lagged_correlation(monthly(spark, d), _driver(spark, d)).select("pixel_id", "lag", F.round("r", 6).alias("r"), "n", F.round("n_eff", 4).alias("n_eff"))
ORACLE_SQL["lagged_corr"] = sql(MONTHLY_SQL, DRIVER_SQL, _PAIRS, _CORR, select="SELECT pixel_id, lag, round(r, 6) AS r, n, round(n * (1 - q) / (1 + q), 4) AS n_eff FROM (SELECT *, least(0.99, greatest(0, coalesce(ra * rb, 0))) AS q FROM c)")
QUERIES["lagged_corr_best"] = lambda spark, d: series.best_lag(series.lagged_correlation(monthly(spark, d), _driver(spark, d))).select("pixel_id", F.round("best_r", 6).alias("best_r"), "best_lag", "n")
ORACLE_SQL["lagged_corr_best"] = sql(MONTHLY_SQL, DRIVER_SQL, _PAIRS, _CORR, select="SELECT pixel_id, round(r, 6) AS best_r, lag AS best_lag, n FROM (SELECT *, row_number() OVER (PARTITION BY pixel_id ORDER BY abs(round(r, 9)) DESC, lag) AS k FROM c) WHERE k = 1")
QUERIES["spearman_lag0"] = lambda spark, d: series.lagged_correlation(monthly(spark, d), _driver(spark, d), (0,), rank=True).select("pixel_id", F.round("r", 6).alias("r"), "n")
ORACLE_SQL["spearman_lag0"] = sql(MONTHLY_SQL, DRIVER_SQL, _PAIRS, "k AS (SELECT pixel_id, rank() OVER (PARTITION BY pixel_id ORDER BY a) + (count(*) OVER (PARTITION BY pixel_id, a) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY pixel_id ORDER BY b) + (count(*) OVER (PARTITION BY pixel_id, b) - 1) / 2.0 AS rb FROM pairs WHERE lag = 0)",
    select="SELECT pixel_id, round(corr(ra, rb), 6) AS r, count(*) AS n FROM k GROUP BY 1 HAVING count(*) >= 10")


def _pvalues(spark, d):
    return read(spark, d, "part").select(F.col("p_partkey").alias("pixel_id"), (F.pow((F.col("p_partkey") * 37 % 997 + 1) / 1000, 3)).alias("p"))


QUERIES["fdr_bh"] = lambda spark, d: series.fdr(_pvalues(spark, d)).select("pixel_id", F.round("q", 11).alias("q"), "significant")
ORACLE_SQL["fdr_bh"] = """WITH t AS (SELECT p_partkey AS pixel_id, pow((p_partkey * 37 % 997 + 1) / 1000.0, 3) AS p FROM part), r AS (SELECT *, row_number() OVER (ORDER BY p, pixel_id) AS k, count(*) OVER () AS m FROM t),
q AS (SELECT pixel_id, least(1, min(p * m / k) OVER (ORDER BY k DESC ROWS UNBOUNDED PRECEDING)) AS q FROM r) SELECT pixel_id, round(q, 11) AS q, q <= 0.1 AS significant FROM q"""

_REC = ("pre_val", "dist_val", "magnitude", "post_val", "ari", "rri", "r80p", "yryr")


def recovery_metrics(spark, d):
    a = annual(spark, d)
    events = series.greatest_step_loss(a).where("change > 0").select("pixel_id", F.col("change_time").alias("yod"))
    return series.recovery(a, events, horizon=3).select("pixel_id", "yod", *[F.round(c, 4).alias(c) for c in _REC], F.col("y2r").cast("double").alias("y2r"))


QUERIES["recovery_metrics"] = recovery_metrics
ORACLE_SQL["recovery_metrics"] = sql(ANNUAL_SQL, _POS, "v AS (SELECT *, lag(value) OVER (PARTITION BY pixel_id ORDER BY pos) - value AS dr FROM p WHERE value IS NOT NULL)",
    "e AS (SELECT pixel_id, year AS yod FROM (SELECT *, row_number() OVER (PARTITION BY pixel_id ORDER BY dr DESC, pos) AS r FROM v WHERE dr IS NOT NULL) WHERE r = 1 AND dr > 0)",
    "j AS (SELECT v.pixel_id, yod, value, year - yod AS dt FROM v JOIN e USING (pixel_id))",
    "g AS (SELECT pixel_id, yod, avg(value) FILTER (dt BETWEEN -2 AND -1) AS pre, avg(value) FILTER (dt = 0) AS dist, max(value) FILTER (dt BETWEEN 2 AND 3) AS peak, avg(value) FILTER (dt BETWEEN 2 AND 3) AS post FROM j GROUP BY ALL)",
    "y AS (SELECT j.pixel_id, min(dt) AS y2r FROM j JOIN g USING (pixel_id) WHERE dt > 0 AND value >= pre * 0.8 GROUP BY 1)",
    select="""SELECT g.pixel_id, yod, round(pre, 4) AS pre_val, round(dist, 4) AS dist_val, round(pre - dist, 4) AS magnitude, round(post, 4) AS post_val, round(peak - dist, 4) AS ari, round((peak - dist) / nullif(pre - dist, 0), 4) AS rri,
  round(peak / nullif(pre * 0.8, 0), 4) AS r80p, round((peak - dist) / 3, 4) AS yryr, CAST(y2r AS DOUBLE) AS y2r FROM g LEFT JOIN y ON g.pixel_id = y.pixel_id""")  # fmt: skip
