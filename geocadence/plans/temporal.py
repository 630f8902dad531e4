"""Queries of temporal aggregation and composites."""

from __future__ import annotations

from pyspark.sql import functions as F

from geocadence.functions import spectral
from geocadence.operators import temporal
from geocadence.sources.tables import OBS_SQL, WIDE_SQL, observations, read, sql, wide

QUERIES, ORACLE_SQL = {}, {}
_INT = {"count"}
_STATS = ("count", "min", "p25", "median", "p75", "max", "mean", "std", "range", "iqr", "skew", "kurtosis")


def rounded(df, keys, metrics, digits=5):
    return df.select(*keys, *[F.col(m).cast("long").alias(m) if m in _INT else F.round(m, digits).alias(m) for m in metrics])


def stats_sql(v: str, metrics, ddof: int = 1, digits: int = 5) -> str:
    """Moments from power sums about the mean are left to DuckDB's own functions; skew from its definition."""
    q = lambda p: f"quantile_cont({v}, {p})"
    named = {
        "count": f"count({v})", "min": f"min({v})", "max": f"max({v})", "mean": f"avg({v})", "median": q(0.5), "std": f"{'stddev_samp' if ddof else 'stddev_pop'}({v})",
        "range": f"max({v}) - min({v})", "iqr": f"{q(0.75)} - {q(0.25)}",
        "skew": f"CASE WHEN min({v}) < max({v}) THEN (avg({v} * {v} * {v}) - 3 * avg({v}) * avg({v} * {v}) + 2 * pow(avg({v}), 3)) / pow(stddev_pop({v}), 3) END",
        "kurtosis": f"CASE WHEN min({v}) < max({v}) THEN (avg(pow({v}, 4)) - 4 * avg({v}) * avg(pow({v}, 3)) + 6 * pow(avg({v}), 2) * avg({v} * {v}) - 3 * pow(avg({v}), 4)) / pow(var_pop({v}), 2) - 3 END",
    }
    out = []
    for m in metrics:
        x = named[m] if m in named else q(int(m[1:]) / 100)
        out.append(f"{x} AS {m}" if m in _INT else f"round({x}, {digits}) AS {m}")
    return ", ".join(out)


QUERIES["stm_series"] = lambda spark, d: rounded(temporal.temporal_metrics(observations(spark, d), _STATS), ["pixel_id"], _STATS, 4)
ORACLE_SQL["stm_series"] = sql(OBS_SQL, select=f"SELECT pixel_id, {stats_sql('value', _STATS, digits=4)} FROM obs GROUP BY pixel_id")
QUERIES["stm_series_population"] = lambda spark, d: rounded(temporal.temporal_metrics(observations(spark, d), ("count", "mean", "std", "p5", "p95"), ddof=0), ["pixel_id"], ("count", "mean", "std", "p5", "p95"), 5)
ORACLE_SQL["stm_series_population"] = sql(OBS_SQL, select=f"SELECT pixel_id, {stats_sql('value', ('count', 'mean', 'std', 'p5', 'p95'), 0)} FROM obs GROUP BY pixel_id")

_DOY = "(list_extract([0, 31, 59, 90, 120, 151, 181, 212, 243, 273, 304, 334], month(ts)) + day(ts))"
_PERIOD_SQL = {"year": "year(ts)", "quarter": "quarter(ts)", "month": "month(ts)", "week": f"least(ceil({_DOY} / 7.0), 52)", "doy": _DOY}
_PSTATS = ("count", "mean", "std", "p25", "median", "p75", "iqr", "min", "max")


def _by(by: str, table: str) -> None:
    key = f"stm_by_{by}"
    if table == "wide":
        source, cte, value = (lambda s, d: wide(s, d).withColumn("value", F.sqrt("nir"))), WIDE_SQL, "sqrt(nir)"
    else:
        source, cte, value = observations, OBS_SQL, "value"
    QUERIES[key] = lambda spark, d: rounded(temporal.temporal_metrics(source(spark, d), _PSTATS, by=by), ["pixel_id", "period"], _PSTATS, 8)
    top = {"quarter": 4, "month": 12, "week": 52, "doy": 365}.get(by)
    periods = f"SELECT CAST(unnest(range(1, {top} + 1)) AS INTEGER) AS period" if top else f"SELECT CAST(unnest(range(a, b + 1)) AS INTEGER) AS period FROM (SELECT min(year(ts)) AS a, max(year(ts)) AS b FROM {table})"
    ORACLE_SQL[key] = sql(cte, f"p AS ({periods})", f"k AS (SELECT DISTINCT pixel_id FROM {table})",
        f"g AS (SELECT pixel_id, CAST({_PERIOD_SQL[by]} AS INTEGER) AS period, {value} AS v FROM {table})",
        select=f"SELECT k.pixel_id, p.period, {stats_sql("v", _PSTATS, digits=8)} FROM k CROSS JOIN p LEFT JOIN g ON g.pixel_id = k.pixel_id AND g.period = p.period GROUP BY ALL")


for _b, _t in (("year", "wide"), ("quarter", "wide"), ("month", "wide"), ("week", "obs"), ("doy", "obs")):
    _by(_b, _t)


def stm_indices(spark, d):
    """Annual metrics of several indices in one pass."""
    x = spectral.compute_indices(wide(spark, d), ["NDVI", "NBR"]).withColumns({n: F.round(n, 9) for n in ("NDVI", "NBR")})
    cols = [F.round(c, 5).alias(f"{n}_{m}") for n in ("NDVI", "NBR") for m, c in (("mean", F.avg(n)), ("median", F.median(n)), ("std", F.stddev_samp(n)))]
    return x.groupBy("pixel_id", F.year("ts").alias("year")).agg(*cols)


QUERIES["stm_indices_by_year"] = stm_indices
ORACLE_SQL["stm_indices_by_year"] = sql(WIDE_SQL, "i AS (SELECT pixel_id, CAST(year(ts) AS INTEGER) AS year, round((nir - red) / nullif(nir + red, 0), 9) AS a, round((nir - swir2) / nullif(nir + swir2, 0), 9) AS b FROM wide)",
    select="SELECT pixel_id, year, " + ", ".join(f"round({f}({c}), 5) AS {n}_{m}" for n, c in (("NDVI", "a"), ("NBR", "b")) for m, f in (("mean", "avg"), ("median", "median"), ("std", "stddev_samp"))) + " FROM i GROUP BY ALL")

QUERIES["standardize_z"] = lambda spark, d: temporal.standardize(observations(spark, d)).select("seq", F.round("standardized", 6).alias("z"))
ORACLE_SQL["standardize_z"] = sql(OBS_SQL, select="""SELECT seq, round(CASE WHEN count(value) OVER w < 2 THEN value ELSE (value - avg(value) OVER w) / nullif(stddev_samp(value) OVER w, 0) END, 6) AS z FROM obs WINDOW w AS (PARTITION BY pixel_id)""")
QUERIES["standardize_center"] = lambda spark, d: temporal.standardize(observations(spark, d), "center").select("seq", F.round("standardized", 6).alias("centred"))
ORACLE_SQL["standardize_center"] = sql(OBS_SQL, select="SELECT seq, round(CASE WHEN count(value) OVER w < 2 THEN value ELSE value - avg(value) OVER w END, 6) AS centred FROM obs WINDOW w AS (PARTITION BY pixel_id)")


def _orders(spark, d):
    o = read(spark, d, "orders")
    return o.select((F.col("o_custkey") % 200).alias("pixel_id"), F.to_date("o_orderdate").alias("ts"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice")).alias("value"))


ORDERS_SQL = "ord AS (SELECT o_custkey % 200 AS pixel_id, CAST(o_orderdate AS DATE) AS ts, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS value FROM orders)"


def _clear(months: int) -> None:
    key = "clear_obs_monthly" if months == 1 else f"clear_obs_{months}_months"
    QUERIES[key] = lambda spark, d: temporal.clear_observations(_orders(spark, d), months).select("pixel_id", "window", "window_end", "count", F.round("gap_mean", 6).alias("gap_mean"), "gap_max", F.round("gap_std", 6).alias("gap_std"), "n_gaps")
    ORACLE_SQL[key] = sql(
        ORDERS_SQL, f"n AS (SELECT pixel_id, ts, value, (year(ts) * 12 + month(ts) - 1) // {months} AS w FROM ord)",
        f"ws AS (SELECT w, make_date(CAST(w * {months} // 12 AS INTEGER), CAST(w * {months} % 12 + 1 AS INTEGER), 1) AS s FROM (SELECT unnest(range(min(w), max(w) + 1)) AS w FROM n))",
        f"f AS (SELECT pixel_id, w, s, CAST(s + INTERVAL {months} MONTH AS DATE) AS e FROM (SELECT DISTINCT pixel_id FROM n) CROSS JOIN ws)",
        "p AS (SELECT DISTINCT pixel_id, w, ts AS t FROM n WHERE value IS NOT NULL UNION ALL SELECT pixel_id, w, s FROM f UNION ALL SELECT pixel_id, w, e FROM f)",
        "g AS (SELECT pixel_id, w, t - lag(t) OVER (PARTITION BY pixel_id, w ORDER BY t) AS gap FROM p)",
        "c AS (SELECT pixel_id, w, count(*) AS n FROM n WHERE value IS NOT NULL GROUP BY ALL)",
        "q AS (SELECT pixel_id, w, avg(gap) AS a, max(gap) AS m, stddev_samp(gap) AS s, count(*) AS k FROM g WHERE gap > 0 GROUP BY ALL)",
        select="""SELECT f.pixel_id, f.s AS "window", CAST(f.e - 1 AS DATE) AS window_end, coalesce(c.n, 0) AS count, round(q.a, 6) AS gap_mean, CAST(q.m AS INTEGER) AS gap_max, round(q.s, 6) AS gap_std, coalesce(q.k, 0) AS n_gaps
FROM f LEFT JOIN c ON c.pixel_id = f.pixel_id AND c.w = f.w LEFT JOIN q ON q.pixel_id = f.pixel_id AND q.w = f.w""",
    )


_clear(1)
_clear(3)

_BANDS = ("red", "nir", "swir1")
_STEP = "CAST(floor((ts - DATE '1995-01-01') / 16.0) AS INTEGER)"
QUERIES["composite_median_16d"] = lambda spark, d: temporal.composite_median(wide(spark, d), 16, origin="1995-01-01", bands=_BANDS).select("pixel_id", "step", *[F.round(b, 9).alias(b) for b in _BANDS])
ORACLE_SQL["composite_median_16d"] = sql(WIDE_SQL, select=f"SELECT pixel_id, {_STEP} AS step, " + ", ".join(f"round(median({b}), 9) AS {b}" for b in _BANDS) + " FROM wide GROUP BY ALL")
QUERIES["composite_medoid"] = lambda spark, d: temporal.composite_medoid(wide(spark, d), 16, origin="1995-01-01", bands=_BANDS)
ORACLE_SQL["composite_medoid"] = sql(WIDE_SQL, f"c AS (SELECT *, {_STEP} AS step FROM wide)", "m AS (SELECT pixel_id, step, " + ", ".join(f"median({b}) AS m_{b}" for b in _BANDS) + " FROM c GROUP BY ALL)",
    select="SELECT pixel_id, step, seq, ts FROM (SELECT c.*, row_number() OVER (PARTITION BY c.pixel_id, c.step ORDER BY round(" + " + ".join(f"pow({b} - m_{b}, 2)" for b in _BANDS) + ", 9), ts, seq) AS r FROM c JOIN m ON c.pixel_id = m.pixel_id AND c.step = m.step) WHERE r = 1")
QUERIES["composite_clearest"] = lambda spark, d: temporal.composite_clearest(observations(spark, d), 8, origin="2024-01-01")
ORACLE_SQL["composite_clearest"] = sql(OBS_SQL, "c AS (SELECT *, CAST(floor((ts - DATE '2024-01-01') / 8.0) AS INTEGER) AS step FROM obs)", "s AS (SELECT step, ts, count(value) / count(*) AS share FROM c GROUP BY ALL)",
    select="SELECT pixel_id, step, ts, value FROM (SELECT c.*, row_number() OVER (PARTITION BY pixel_id, c.step ORDER BY share DESC, c.ts, seq) AS r FROM c JOIN s ON c.step = s.step AND c.ts = s.ts WHERE value IS NOT NULL) WHERE r = 1")


def _annual(name, season):
    QUERIES[name] = lambda spark, d: temporal.annual_composite(wide(spark, d).withColumn("value", F.col("nir")), season).select("pixel_id", "year", F.round("value", 9).alias("value"), "clear")
    a, b = season
    inside = f"(d >= '{a}' OR d <= '{b}')" if a > b else f"(d >= '{a}' AND d <= '{b}')"
    year = f"year(ts) - CASE WHEN d <= '{b}' THEN 1 ELSE 0 END" if a > b else "year(ts)"
    ORACLE_SQL[name] = sql(WIDE_SQL, "x AS (SELECT pixel_id, ts, nir, strftime(ts, '%m-%d') AS d FROM wide)", f"g AS (SELECT pixel_id, {year} AS year, median(nir) AS v, count(nir) AS n FROM x WHERE {inside} GROUP BY ALL)",
        "y AS (SELECT unnest(range(min(year(ts)), max(year(ts)) + 1)) AS year FROM wide)", "f AS (SELECT DISTINCT pixel_id, y.year FROM wide CROSS JOIN y)",
        select="SELECT f.pixel_id, CAST(f.year AS INTEGER) AS year, round(v, 9) AS value, coalesce(n, 0) AS clear FROM f LEFT JOIN g ON f.pixel_id = g.pixel_id AND f.year = g.year")


_annual("composite_annual_season", ("06-01", "09-30"))
_annual("composite_annual_winter", ("11-15", "02-15"))


def composite_bap(spark, d):
    w = wide(spark, d).withColumn("cloud_distance", (F.col("seq") % 60).cast("double")).withColumn("sensor_score", F.when(F.col("seq") % 2 == 0, 1.0).otherwise(0.5)).withColumn("cover", (F.col("seq") % 10) / 10)
    return temporal.best_available_pixel(w, target_doy=210).select("pixel_id", "year", "seq", F.round("score", 6).alias("score"))


QUERIES["composite_bap"] = composite_bap
ORACLE_SQL["composite_bap"] = sql(WIDE_SQL, f"""s AS (SELECT pixel_id, CAST(year(ts) AS INTEGER) AS year, ts, seq, round(0.3 * exp(-0.5 * pow(({_DOY} - 210) / 40.0, 2)) + 0.5 / (1 + exp(-0.2 * (least(seq % 60, 50) - 25)))
  + 0.1 * CASE WHEN seq % 2 = 0 THEN 1.0 ELSE 0.5 END + 0.1 * (1 - (seq % 10) / 10.0), 9) AS score FROM wide)""",
    select="SELECT pixel_id, year, seq, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY pixel_id, year ORDER BY score DESC, ts, seq) AS r FROM s) WHERE r = 1")
