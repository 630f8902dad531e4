"""Queries of events, zonal statistics, accuracy and neighbourhoods."""

from __future__ import annotations

from pyspark.sql import functions as F

from geocadence.functions import embeddings as emb
from geocadence.functions.special import normal_quantile
from geocadence.operators import events, multivariate, spatial, zonal
from geocadence.sources.tables import ANNUAL_SQL, GRID_SQL, annual, grid, read, sql, wide

QUERIES, ORACLE_SQL = {}, {}

_SEG = """seg AS (SELECT pixel_id, row_number() OVER w - 1 AS seq, lag(year) OVER w AS y0, year AS y1, lag(value) OVER w AS v0, value AS v1 FROM annual WHERE value IS NOT NULL WINDOW w AS (PARTITION BY pixel_id ORDER BY year)),
s AS (SELECT *, v1 - v0 AS change, y1 - y0 AS duration FROM seg WHERE y0 IS NOT NULL)"""


def _segments(spark, d):
    return events.segments_from_vertices(annual(spark, d))


_EV = ("magnitude", "pre_val", "post_val", "rate")


def _event(name, kind, sort, least=0.0, pre=None):
    QUERIES[name] = lambda spark, d: events.extract_events(_segments(spark, d), kind, sort, min_magnitude=least, pre_val_threshold=pre).select("pixel_id", "yod", "duration", *[F.round(c, 5).alias(c) for c in _EV])
    mag = {"loss": "-change", "gain": "change", "any": "abs(change)"}[kind]
    score = {"greatest": "mag", "newest": "y1", "fastest": "mag / duration", "longest": "duration"}[sort]
    keep = f"mag > 0 AND mag >= {least}" + (f" AND v0 >= {pre}" if pre is not None else "")
    ORACLE_SQL[name] = sql(ANNUAL_SQL, _SEG, f"m AS (SELECT *, {mag} AS mag FROM s)", f"r AS (SELECT *, row_number() OVER (PARTITION BY pixel_id ORDER BY {score} DESC, seq) AS k FROM m WHERE {keep})",
        select="SELECT pixel_id, y0 + 1 AS yod, duration, round(mag, 5) AS magnitude, round(v0, 5) AS pre_val, round(v1, 5) AS post_val, round(mag / duration, 5) AS rate FROM r WHERE k = 1")


_event("events_greatest_loss", "loss", "greatest")
_event("events_newest_gain", "gain", "newest", 1.0)
_event("events_fastest_any", "any", "fastest")
_event("events_longest_loss", "loss", "longest", 0.5, 225.0)


def agreement_k_maps(spark, d):
    maps = [events.extract_events(_segments(spark, d), "loss", s).select("pixel_id", "yod") for s in ("greatest", "newest", "fastest")]
    return events.agreement(maps).select("pixel_id", "yod", "n_detected", "n_agree", "spread")


def _map_sql(i, score):
    return f"m{i} AS (SELECT pixel_id, y0 + 1 AS yod FROM (SELECT *, row_number() OVER (PARTITION BY pixel_id ORDER BY {score} DESC, seq) AS k FROM s WHERE change < 0) WHERE k = 1)"


QUERIES["agreement_k_maps"] = agreement_k_maps
ORACLE_SQL["agreement_k_maps"] = sql(ANNUAL_SQL, _SEG, _map_sql(1, "-change"), _map_sql(2, "y1"), _map_sql(3, "-change / duration"), "u AS (SELECT * FROM m1 UNION ALL SELECT * FROM m2 UNION ALL SELECT * FROM m3)",
    "c AS (SELECT a.pixel_id, a.yod, count(*) FILTER (abs(a.yod - b.yod) <= 1) AS support, count(*) FILTER (a.yod = b.yod) AS exact, count(*) AS n, max(b.yod) FILTER (abs(a.yod - b.yod) <= 1) - min(b.yod) FILTER (abs(a.yod - b.yod) <= 1) AS spread FROM (SELECT DISTINCT pixel_id, yod FROM u) a JOIN u b USING (pixel_id) GROUP BY ALL)",
    select="SELECT pixel_id, yod, CAST(n AS INTEGER) AS n_detected, CAST(support AS INTEGER) AS n_agree, CAST(spread AS INTEGER) AS spread FROM (SELECT *, row_number() OVER (PARTITION BY pixel_id ORDER BY support DESC, exact DESC, yod) AS k FROM c) WHERE k = 1")


def _decades(spark, d):
    return events.segments_from_vertices(annual(spark, d).where("year % 2 = 1"))


_SEG2 = _SEG.replace("WHERE value IS NOT NULL WINDOW", "WHERE value IS NOT NULL AND year % 2 = 1 WINDOW")
QUERIES["fitted_series"] = lambda spark, d: events.fitted_series(_decades(spark, d), annual(spark, d).select("year")).select("pixel_id", "year", F.round("fitted", 6).alias("fitted"))
ORACLE_SQL["fitted_series"] = sql(ANNUAL_SQL, _SEG2, "f AS (SELECT *, seq = min(seq) OVER (PARTITION BY pixel_id) AS first FROM s)", select="SELECT pixel_id, y.year, round(v0 + (v1 - v0) * (y.year - y0) / (y1 - y0), 6) AS fitted FROM f JOIN (SELECT DISTINCT year FROM annual) y ON (y.year > y0 OR (first AND y.year = y0)) AND y.year <= y1")
QUERIES["segment_at"] = lambda spark, d: events.segment_at(_segments(spark, d), F.lit(1998)).select("pixel_id", "at", "seq", "y0", "y1")
ORACLE_SQL["segment_at"] = sql(ANNUAL_SQL, _SEG, select='SELECT pixel_id, 1998 AS "at", seq, y0, y1 FROM (SELECT *, row_number() OVER (PARTITION BY pixel_id ORDER BY CASE WHEN y0 <= 1998 THEN 0 ELSE 1 END, CASE WHEN y0 <= 1998 THEN -y0 ELSE y0 END) AS k FROM s) WHERE k = 1')


def predict_harmonic(spark, d):
    w = wide(spark, d)
    t = F.datediff("ts", F.lit("1970-01-01").cast("date")) + 719163 + 366
    coefs = [F.col("nir"), F.col("blue") / 1e6, *[F.col(c) for c in ("green", "red", "swir1", "swir2")]]
    return w.select("seq", F.round(events.predict_harmonic(coefs, t), 5).alias("predicted"))


QUERIES["predict_harmonic"] = predict_harmonic
_TT = "((ts - DATE '1970-01-01') + 719163 + 366)"
_OM = "(2 * 3.141592653589793 / 365.25)"
from geocadence.sources.tables import WIDE_SQL  # noqa: E402

ORACLE_SQL["predict_harmonic"] = sql(WIDE_SQL, f"x AS (SELECT *, {_TT} AS t FROM wide)", select=f"SELECT seq, round(nir + blue / 1e6 * t + green * cos({_OM} * t) + red * sin({_OM} * t) + swir1 * cos(2 * {_OM} * t) + swir2 * sin(2 * {_OM} * t), 5) AS predicted FROM x")


def asof(spark, d):
    """Every lineitem row with its nearest order; rows that repeat order and line number are told apart by ``copy``."""
    from pyspark.sql import Window as W

    left = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_suppkey") % 50).alias("k"), F.to_date("l_shipdate").alias("ship"))
    left = left.withColumn("copy", F.row_number().over(W.partitionBy("l_orderkey", "l_linenumber").orderBy("ship", "k")))
    left = left.select(F.struct("l_orderkey", "l_linenumber", "copy").alias("id"), "k", "ship")
    right = read(spark, d, "orders").select((F.col("o_custkey") % 50).alias("k"), F.to_date("o_orderdate").alias("od"), F.col("o_orderkey"))
    right = right.groupBy("k", "od").agg(F.min("o_orderkey").cast("long").alias("o"))
    out = events.asof_nearest(left, right, 8, key="k", left_ts="ship", right_ts="od", left_id="id", value="o")
    return out.select("id.*", "k", "matched_ts", *[F.col(c).cast("double").alias(c) for c in ("matched_value", "gap_days")])


QUERIES["asof_nearest"] = asof
ORACLE_SQL["asof_nearest"] = """WITH l AS (SELECT l_orderkey, l_linenumber, l_suppkey % 50 AS k, CAST(l_shipdate AS DATE) AS ship, CAST(row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY CAST(l_shipdate AS DATE), l_suppkey % 50) AS INTEGER) AS copy FROM lineitem),
r AS (SELECT o_custkey % 50 AS k, CAST(o_orderdate AS DATE) AS od, min(o_orderkey) AS o FROM orders GROUP BY ALL),
j AS (SELECT l.*, od, o, abs(ship - od) AS g, row_number() OVER (PARTITION BY l_orderkey, l_linenumber, copy ORDER BY abs(ship - od), od) AS n FROM l JOIN r ON l.k = r.k AND od BETWEEN ship - 8 AND ship + 8)
SELECT l.l_orderkey, l.l_linenumber, l.copy, l.k, j.od AS matched_ts, CAST(j.o AS DOUBLE) AS matched_value, CAST(j.g AS DOUBLE) AS gap_days FROM l LEFT JOIN j ON j.l_orderkey = l.l_orderkey AND j.l_linenumber = l.l_linenumber AND j.copy = l.copy AND j.n = 1"""


def same_month(spark, d):
    a = read(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 50).alias("k"), F.trunc("l_shipdate", "MM").alias("month")).agg(F.count("*").alias("n_left"))
    b = read(spark, d, "orders").groupBy((F.col("o_custkey") % 50).alias("k"), F.trunc("o_orderdate", "MM").alias("month")).agg(F.count("*").alias("n_right"))
    return a.join(b, ["k", "month"])


QUERIES["same_month_join"] = same_month
ORACLE_SQL["same_month_join"] = """SELECT * FROM (SELECT l_suppkey % 50 AS k, CAST(date_trunc('month', l_shipdate) AS DATE) AS month, count(*) AS n_left FROM lineitem GROUP BY ALL)
JOIN (SELECT o_custkey % 50 AS k, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(*) AS n_right FROM orders GROUP BY ALL) USING (k, month)"""


def cva(spark, d):
    p = read(spark, d, "part").select("p_partkey", (F.col("p_size") / 50).alias("a1"), (F.col("p_retailprice") / 2000).alias("a2"), ((F.col("p_partkey") * 13 % 50) / 50).alias("b1"), ((F.col("p_partkey") * 7 % 2000) / 2000).alias("b2"))
    return events.change_vector(p, ["a1", "a2"], ["b1", "b2"], threshold=0.5)


QUERIES["cva_magnitude"] = lambda spark, d: cva(spark, d).select("p_partkey", F.round("magnitude", 6).alias("magnitude"), F.round("direction", 5).alias("direction"), "sector", "change")
_CVA = "v AS (SELECT p_partkey, (p_partkey * 13 % 50) / 50.0 - p_size / 50.0 AS d1, (p_partkey * 7 % 2000) / 2000.0 - p_retailprice / 2000 AS d2 FROM part), m AS (SELECT *, sqrt(d1 * d1 + d2 * d2) AS rho FROM v)"
_CVA_SECTOR = "1 + CASE WHEN d1 > 0 THEN 1 ELSE 0 END + CASE WHEN d2 > 0 THEN 2 ELSE 0 END"
ORACLE_SQL["cva_magnitude"] = sql(_CVA, select=f"SELECT p_partkey, round(rho, 6) AS magnitude, round(acos(greatest(-1, least(1, (d1 + d2) / nullif(rho * sqrt(2), 0)))), 5) AS direction, {_CVA_SECTOR} AS sector, rho > 0.5 AS change FROM m")
QUERIES["cva_table"] = lambda spark, d: cva(spark, d).groupBy("sector").agg(F.count("*").alias("pixels"), F.round(F.avg("magnitude"), 6).alias("mean_magnitude"))
ORACLE_SQL["cva_table"] = sql(_CVA, select=f"SELECT {_CVA_SECTOR} AS sector, count(*) AS pixels, round(avg(rho), 6) AS mean_magnitude FROM m GROUP BY 1")

# ---------------------------------------------------------------- zones


def _cells(spark, d):
    return read(spark, d, "customer").select(F.col("c_nationkey").alias("zone"), F.col("c_mktsegment").alias("label"), F.when(F.col("c_custkey") % 11 != 0, F.sqrt(F.abs("c_acctbal"))).alias("value"))


CELLS_SQL = "cells AS (SELECT c_nationkey AS zone, c_mktsegment AS label, CASE WHEN c_custkey % 11 <> 0 THEN sqrt(abs(c_acctbal)) END AS value FROM customer)"
_ZS = ("mean", "std", "min", "p10", "p25", "median", "p75", "p90", "max")


def _zones(spark, d):
    return read(spark, d, "nation").select(F.col("n_nationkey").alias("zone"))


QUERIES["zonal_stats"] = lambda spark, d: zonal.zonal_stats(_cells(spark, d), _zones(spark, d)).select("zone", "label", "n", *[F.round(c, 6).alias(c) for c in _ZS])
_ZSQL = ", ".join(["count(value) AS n", "round(avg(value), 6) AS mean", "round(stddev_pop(value), 6) AS std", "round(min(value), 6) AS min", "round(max(value), 6) AS max", *[f"round(quantile_cont(value, {p}), 6) AS {n}" for n, p in (("p10", 0.1), ("p25", 0.25), ("median", 0.5), ("p75", 0.75), ("p90", 0.9))]])
ORACLE_SQL["zonal_stats"] = sql(CELLS_SQL, select=f"SELECT n_nationkey AS zone, l.label, {_ZSQL} FROM nation CROSS JOIN (SELECT DISTINCT label FROM cells) l LEFT JOIN cells ON cells.zone = n_nationkey AND cells.label = l.label GROUP BY ALL")
_SEGS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
QUERIES["zonal_stats_wide"] = lambda spark, d: zonal.zonal_wide(zonal.zonal_stats(_cells(spark, d), _zones(spark, d)).withColumn("mean", F.round("mean", 6)), _SEGS)
ORACLE_SQL["zonal_stats_wide"] = sql(CELLS_SQL, select="SELECT n_nationkey AS zone, " + ", ".join(f'round(avg(value) FILTER (label = \'{s}\'), 6) AS "{s}"' for s in _SEGS) + " FROM nation LEFT JOIN cells ON zone = n_nationkey GROUP BY 1")
QUERIES["zonal_areas"] = lambda spark, d: zonal.zonal_areas(_cells(spark, d).withColumn("value", F.col("value") / 20)).select("zone", "label", "class", "pixels", "area_m2", "area_ha", F.round("percent", 4).alias("percent"))
ORACLE_SQL["zonal_areas"] = sql(CELLS_SQL, "g AS (SELECT zone, label, CAST(round(value / 20) AS INTEGER) AS class, count(*) AS pixels FROM cells WHERE value IS NOT NULL GROUP BY ALL)", select='SELECT zone, label, class, pixels, round(pixels * 100.0, 3) AS area_m2, round(pixels * 100.0 / 10000, 6) AS area_ha, round(pixels * 100.0 / sum(pixels) OVER (PARTITION BY zone, label), 4) AS percent FROM g')
QUERIES["zonal_transitions"] = lambda spark, d: zonal.zonal_transitions(grid(spark, d).withColumn("later", (F.col("class") + F.col("size") % 3) % 5), "class", "later")
ORACLE_SQL["zonal_transitions"] = sql(GRID_SQL, select="SELECT zone, class AS from_class, (class + size % 3) % 5 AS to_class, count(*) AS pixels FROM grid GROUP BY ALL")

# ---------------------------------------------------------------- accuracy


def _samples(spark, d):
    docs = read(spark, d, "documents").select("doc_id", F.col("lang").alias("stratum"))
    return docs.join(read(spark, d, "labels").select("doc_id", F.col("quality").alias("ref"), F.when(F.col("doc_id") % 9 == 0, 1 - F.col("quality")).otherwise(F.col("quality")).alias("map")), "doc_id")


def _weights(spark, d):
    return zonal.strata(read(spark, d, "documents").select(F.col("lang").alias("stratum")))


SAMPLES_SQL = "smp AS (SELECT doc_id, lang AS stratum, quality AS ref, CASE WHEN doc_id % 9 = 0 THEN 1 - quality ELSE quality END AS map FROM documents JOIN labels USING (doc_id)), wt AS (SELECT lang AS stratum, count(*) AS pixels, count(*) / sum(count(*)) OVER () AS weight FROM documents GROUP BY 1)"
_Z = normal_quantile(0.975)
QUERIES["accuracy_direct"] = lambda spark, d: zonal.accuracy(_samples(spark, d), _weights(spark, d)).select("measure", "class", *[F.round(c, 6).alias(c) for c in ("estimate", "se", "ci_low", "ci_high")])
ORACLE_SQL["accuracy_direct"] = sql(SAMPLES_SQL, "cl AS (SELECT DISTINCT ref AS class FROM smp)",
    """f AS (SELECT stratum, class, 'overall' AS measure, CASE WHEN map = ref THEN 1.0 ELSE 0 END AS y, 1.0 AS x FROM smp, cl UNION ALL SELECT stratum, class, 'users', CASE WHEN map = class AND ref = class THEN 1.0 ELSE 0 END, CASE WHEN map = class THEN 1.0 ELSE 0 END FROM smp, cl
  UNION ALL SELECT stratum, class, 'producers', CASE WHEN map = class AND ref = class THEN 1.0 ELSE 0 END, CASE WHEN ref = class THEN 1.0 ELSE 0 END FROM smp, cl UNION ALL SELECT stratum, class, 'area', CASE WHEN ref = class THEN 1.0 ELSE 0 END, 1.0 FROM smp, cl)""",
    "h AS (SELECT stratum, measure, class, count(*) AS n, avg(y) AS my, avg(x) AS mx FROM f GROUP BY ALL)", "t AS (SELECT measure, class, sum(weight * my) AS ty, sum(weight * mx) AS tx FROM h JOIN wt USING (stratum) GROUP BY ALL)",
    "r AS (SELECT f.stratum, f.measure, f.class, CASE WHEN count(*) > 1 THEN var_samp(y - ty / tx * x) / count(*) ELSE 0 END AS v FROM f JOIN t USING (measure, class) GROUP BY f.stratum, f.measure, f.class)",
    "v AS (SELECT measure, class, sum(weight * weight * v) AS v FROM r JOIN wt USING (stratum) GROUP BY ALL)",
    select=f"SELECT measure, class, round(ty / tx, 6) AS estimate, round(sqrt(v) / tx, 6) AS se, round(ty / tx - {_Z!r} * sqrt(v) / tx, 6) AS ci_low, round(ty / tx + {_Z!r} * sqrt(v) / tx, 6) AS ci_high FROM t JOIN v USING (measure, class)")
QUERIES["confusion_matrix"] = lambda spark, d: zonal.confusion(_samples(spark, d))
ORACLE_SQL["confusion_matrix"] = sql(SAMPLES_SQL, select="SELECT map AS map_class, ref AS ref_class, count(*) AS n FROM smp GROUP BY ALL")
QUERIES["strata_areas"] = lambda spark, d: _weights(spark, d).select("stratum", "pixels", "area", F.round("weight", 8).alias("weight"))
ORACLE_SQL["strata_areas"] = sql(SAMPLES_SQL, select="SELECT stratum, pixels, CAST(pixels AS DOUBLE) AS area, round(weight, 8) AS weight FROM wt")


def stratified_sample(spark, d):
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("stratum"))
    counts = {r["stratum"]: r["count"] for r in c.groupBy("stratum").count().collect()}
    sizes = zonal.sampling_design(counts, n=60, min_per_stratum=5)
    return zonal.stratified_sample(c, sizes).groupBy("stratum").agg(F.count("*").alias("n"), F.countDistinct("id").alias("distinct_ids"))


QUERIES["stratified_sample"] = stratified_sample
ORACLE_SQL["stratified_sample"] = """WITH s AS (SELECT c_mktsegment AS stratum, count(*) * 60.0 / sum(count(*)) OVER () AS e FROM customer GROUP BY 1), f AS (SELECT *, floor(e) AS b, row_number() OVER (ORDER BY e - floor(e) DESC, stratum) AS k, 60 - sum(floor(e)) OVER () AS rest FROM s)
SELECT stratum, CAST(b + CASE WHEN k <= rest THEN 1 ELSE 0 END AS BIGINT) AS n, CAST(b + CASE WHEN k <= rest THEN 1 ELSE 0 END AS BIGINT) AS distinct_ids FROM f"""

# ---------------------------------------------------------------- neighbourhoods

QUERIES["gi_star"] = lambda spark, d: spatial.gi_star(grid(spark, d).withColumn("value", F.col("size").cast("double"))).select("y", "x", F.round("gi", 6).alias("gi"))
_GI = """st AS (SELECT count(size) AS n, avg(size) AS mu, stddev_pop(size) AS sd FROM grid), nb AS (SELECT a.y, a.x, sum(b.size) AS s, count(*) AS m FROM grid a JOIN grid b ON abs(a.y - b.y) <= {r} AND abs(a.x - b.x) <= {r} {more} GROUP BY ALL)"""
_GISEL = "SELECT y, x, round((s - m * mu) / (sd * sqrt((n * m - m * m) / (n - 1.0))), 6) AS gi FROM nb, st"
ORACLE_SQL["gi_star"] = sql(GRID_SQL, _GI.format(r=1, more=""), select=_GISEL)
QUERIES["gi_star_circle"] = lambda spark, d: spatial.gi_star(grid(spark, d).withColumn("value", F.col("size").cast("double")), 3, "circle").select("y", "x", F.round("gi", 6).alias("gi"))
ORACLE_SQL["gi_star_circle"] = sql(GRID_SQL, _GI.format(r=3, more="AND pow(a.y - b.y, 2) + pow(a.x - b.x, 2) <= 9"), select=_GISEL)
QUERIES["majority_filter"] = lambda spark, d: spatial.majority_filter(grid(spark, d))
ORACLE_SQL["majority_filter"] = sql(GRID_SQL, "c AS (SELECT a.y, a.x, b.class, count(*) AS n, bool_or(a.y = b.y AND a.x = b.x) AS own FROM grid a JOIN grid b ON abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY ALL)",
    select="SELECT y, x, class FROM (SELECT *, row_number() OVER (PARTITION BY y, x ORDER BY n DESC, own DESC, class) AS k FROM c) WHERE k = 1")
QUERIES["buffer_mask"] = lambda spark, d: spatial.buffer_mask(grid(spark, d).withColumn("mask", F.col("size") > 47), 2)
ORACLE_SQL["buffer_mask"] = sql(GRID_SQL, select="SELECT a.y, a.x, coalesce(bool_or(b.size > 47), false) AS mask FROM grid a LEFT JOIN grid b ON b.size > 47 AND pow(a.y - b.y, 2) + pow(a.x - b.x, 2) <= 4 GROUP BY ALL")


def _probs(spark, d):
    g = grid(spark, d).withColumn("class", F.explode(F.array(*map(F.lit, range(3)))))
    return g.select("y", "x", "class", ((F.col("size") * (F.col("class") + 3) % 17 + 1) / 20).alias("p"))


QUERIES["bayes_filter"] = lambda spark, d: spatial.bayesian_filter(_probs(spark, d)).select("y", "x", "class", F.round("score", 7).alias("score"))
ORACLE_SQL["bayes_filter"] = sql(GRID_SQL, "pr AS (SELECT y, x, c.class, (size * (c.class + 3) % 17 + 1) / 20.0 AS p FROM grid CROSS JOIN (SELECT unnest([0, 1, 2]) AS class) c)", "m AS (SELECT a.y, a.x, a.class, round(a.p * avg(b.p), 9) AS score FROM pr a JOIN pr b ON a.class = b.class AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY a.y, a.x, a.class, a.p)",
    select="SELECT y, x, class, round(score, 7) AS score FROM (SELECT *, row_number() OVER (PARTITION BY y, x ORDER BY score DESC, class) AS k FROM m) WHERE k = 1")
QUERIES["focal_statistics"] = lambda spark, d: spatial.focal(grid(spark, d), 1).select("y", "x", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))
ORACLE_SQL["focal_statistics"] = sql(GRID_SQL, select="SELECT a.y, a.x, round(avg(b.value), 6) AS mean, round(stddev_pop(b.value), 6) AS std FROM grid a JOIN grid b ON abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY ALL")
QUERIES["slope_aspect"] = lambda spark, d: spatial.slope_aspect(grid(spark, d).withColumn("value", F.sqrt("size"))).select("y", "x", F.round("slope", 6).alias("slope"), F.round("aspect", 5).alias("aspect"))
_HORN = "SELECT a.y, a.x, count(*) AS n, sum(CASE WHEN b.y = a.y THEN 2 ELSE 1 END * (b.x - a.x) * sqrt(b.size)) / 8 AS gx, sum(CASE WHEN b.x = a.x THEN 2 ELSE 1 END * (b.y - a.y) * sqrt(b.size)) / 8 AS gy FROM grid a JOIN grid b ON abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY ALL HAVING count(*) = 9"
ORACLE_SQL["slope_aspect"] = sql(GRID_SQL, f"h AS ({_HORN})", select="SELECT y, x, round(degrees(atan(sqrt(gx * gx + gy * gy))), 6) AS slope, round((degrees(atan2(-gx, gy)) + 360) % 360, 5) AS aspect FROM h")
for _how, _agg in {"average": "avg(value)", "max": "max(value)", "med": "median(value)", "rms": "sqrt(avg(value * value))"}.items():
    QUERIES[f"resample_{_how}"] = lambda spark, d, h=_how: spatial.resample(grid(spark, d), 4, h).select("y", "x", F.round("value", 6).alias("value"))
    ORACLE_SQL[f"resample_{_how}"] = sql(GRID_SQL, select=f"SELECT y // 4 AS y, x // 4 AS x, round({_agg}, 6) AS value FROM grid GROUP BY y // 4, x // 4")
QUERIES["spatial_blocks"] = lambda spark, d: spatial.spatial_blocks(grid(spark, d), 8, 5).select("y", "x", "block_row", "block_col", "fold")
ORACLE_SQL["spatial_blocks"] = sql(GRID_SQL, "b AS (SELECT *, CAST(y // 8 AS BIGINT) AS block_row, CAST(x // 8 AS BIGINT) AS block_col FROM grid)", "f AS (SELECT block_row, block_col, CAST((row_number() OVER (ORDER BY block_row, block_col) - 1) % 5 AS INTEGER) AS fold FROM (SELECT DISTINCT block_row, block_col FROM b))",
    select="SELECT y, x, block_row, block_col, fold FROM b JOIN f USING (block_row, block_col)")
QUERIES["spatial_checkerboard"] = lambda spark, d: spatial.spatial_blocks(grid(spark, d), 8, 2, selection="checkerboard").select("y", "x", "fold")
ORACLE_SQL["spatial_checkerboard"] = sql(GRID_SQL, select="SELECT y, x, CAST((y // 8 + x // 8) % 2 AS INTEGER) AS fold FROM grid")
QUERIES["variogram_bins"] = lambda spark, d: spatial.variogram(grid(spark, d).select((F.col("y") * 50 + F.col("x")).alias("id"), "x", "y", F.sqrt("size").alias("value")), 6.5, 5).select("bin", "n", F.round("distance", 6).alias("distance"), F.round("gamma", 6).alias("gamma"))
ORACLE_SQL["variogram_bins"] = sql(GRID_SQL, "p AS (SELECT y * 50 + x AS id, x, y, sqrt(size) AS v FROM grid)", "q AS (SELECT sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS d, pow(a.v - b.v, 2) AS g FROM p a JOIN p b ON a.id < b.id AND abs(a.x - b.x) <= 6.5 AND abs(a.y - b.y) <= 6.5)",
    select="SELECT CAST(least(4, ceil(d / 1.3) - 1) AS INTEGER) AS bin, count(*) AS n, round(avg(d), 6) AS distance, round(avg(g) / 2, 6) AS gamma FROM q WHERE d > 0 AND d <= 6.5 GROUP BY 1")

# ---------------------------------------------------------------- embeddings


def similarity(spark, d):
    """Cosine similarity of each vector to the mean vector of label 1: the mean is one row of fixed width."""
    e = read(spark, d, "embeddings")
    parts = e.where("label = 1").select(F.posexplode("embedding").alias("i", "v")).groupBy("i").agg(F.avg(F.col("v").cast("double")).alias("v"))
    ref = parts.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("ref"))
    return e.crossJoin(F.broadcast(ref)).select("vec_id", F.round(emb.cosine(F.col("embedding"), F.col("ref")), 6).alias("cosine"), F.round(emb.euclid(F.col("embedding"), F.col("ref")), 6).alias("euclid"))


QUERIES["similarity_cosine"] = similarity
ORACLE_SQL["similarity_cosine"] = """WITH u AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings), r AS (SELECT i, avg(v) AS r FROM u WHERE label = 1 GROUP BY i)
SELECT vec_id, round(sum(v * r) / (sqrt(sum(v * v)) * sqrt(sum(r * r))), 6) AS cosine, round(sqrt(sum(pow(v - r, 2))), 6) AS euclid FROM u JOIN r USING (i) GROUP BY vec_id"""


def embedding_change(spark, d):
    """Cosine distance of each year's vector to the year before; vectors of a pixel are vec_id div 5, years vec_id mod 5."""
    from pyspark.sql import Window as W

    e = read(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 5).alias("pixel_id"), (F.col("vec_id") % 5).alias("year"), "embedding")
    before = F.lag("embedding").over(W.partitionBy("pixel_id").orderBy("year"))
    return e.withColumn("p", before).select("pixel_id", "year", F.round(1 - emb.cosine(F.col("embedding"), F.col("p")), 6).alias("distance"))


QUERIES["embedding_change"] = embedding_change
ORACLE_SQL["embedding_change"] = """WITH e AS (SELECT vec_id // 5 AS pixel_id, vec_id % 5 AS year, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
SELECT pixel_id, year, round(1 - list_cosine_similarity(e, lag(e) OVER (PARTITION BY pixel_id ORDER BY year)), 6) AS distance FROM e"""


def aoa_di(spark, d):
    """Dissimilarity index: distance to the nearest training vector over the mean distance between training vectors.

    Every vector with an even id trains, every one with an odd id gets an index.
    """
    e = read(spark, d, "embeddings").select("vec_id", "embedding")
    di = multivariate.dissimilarity(e.where("vec_id % 2 = 1"), e.where("vec_id % 2 = 0"), key="vec_id", vector="embedding")
    return di.select("vec_id", F.round("di", 6).alias("di"))


QUERIES["aoa_di"] = aoa_di
ORACLE_SQL["aoa_di"] = """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), t AS (SELECT * FROM e WHERE vec_id % 2 = 0),
m AS (SELECT avg(list_distance(a.e, b.e)) AS m FROM t a JOIN t b ON a.vec_id < b.vec_id) SELECT n.vec_id, round(min(list_distance(n.e, t.e)) / m, 6) AS di FROM e n CROSS JOIN t CROSS JOIN m WHERE n.vec_id % 2 = 1 GROUP BY n.vec_id, m"""
