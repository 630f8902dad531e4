"""Queries of hot spots, area estimates, synthetic images, smoothing, plans of scenes, and of sources and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from geocadence.functions.special import normal_quantile
from geocadence.operators import events, spatial, zonal
from geocadence.plans.maps import CELLS_SQL, _cells, _zones
from geocadence.sources import io, scratch
from geocadence.sources.tables import GRID_SQL, OBS_SQL, WIDE_SQL, grid, observations, read, sql, wide

QUERIES, ORACLE_SQL = {}, {}
_Z = repr(normal_quantile(0.975))

# ---------------------------------------------------------------- hot spots

_STEPS = 6


def _cube(spark, d):
    """Six maps of the parts' sizes; a block of the map rises from step to step, another is low."""
    g = grid(spark, d).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(_STEPS))))
    base = F.sqrt(F.col("size") * (F.col("step") + 2) % 23 + 1)
    up = F.when((F.col("x") >= 10) & (F.col("x") < 16), F.col("step") * 1.5).when((F.col("x") >= 30) & (F.col("x") < 36), -2.0).otherwise(0.0)
    return g.select("step", "y", "x", F.when(F.col("size") % 13 != F.col("step"), base + up).alias("value"))


_CUBE = f"""cube AS (SELECT step, y, x, CASE WHEN size % 13 <> step THEN sqrt(size * (step + 2) % 23 + 1) + CASE WHEN x >= 10 AND x < 16 THEN step * 1.5 WHEN x >= 30 AND x < 36 THEN -2.0 ELSE 0.0 END END AS value
  FROM grid CROSS JOIN (SELECT unnest(range(1, {_STEPS + 1})) AS step))"""


def _gi_sql(reference):
    stats = "st AS (SELECT step, count(value) AS n, avg(value) AS mu, stddev_pop(value) AS sd FROM cube GROUP BY step)"
    if reference == "cube":
        stats = "st AS (SELECT * FROM (SELECT DISTINCT step FROM cube) CROSS JOIN (SELECT count(value) AS n, avg(value) AS mu, stddev_pop(value) AS sd FROM cube))"
    return (
        stats,
        "v AS (SELECT step, y, x, value FROM cube WHERE value IS NOT NULL)",
        """around AS (SELECT a.step, a.y, a.x, sum(b.value) AS s, count(*) AS m FROM v a JOIN (SELECT step + k AS at, y + dy AS y, x + dx AS x, value FROM v CROSS JOIN (SELECT unnest([0, 1]) AS k) CROSS JOIN (SELECT unnest([-1, 0, 1]) AS dy) CROSS JOIN (SELECT unnest([-1, 0, 1]) AS dx)) b
  ON b.at = a.step AND b.y = a.y AND b.x = a.x GROUP BY ALL)""",
        "gi AS (SELECT step, y, x, (s - m * mu) / (sd * sqrt((n * m - m * m) / (n - 1.0))) AS gi FROM around JOIN st USING (step) WHERE n >= 2 AND sd > 0 AND n * m - m * m > 0)",
    )


_KIND = """CASE WHEN NOT {h}[n] THEN CASE WHEN {c} * 10 >= n * 9 THEN 8 END WHEN {c} = 1 THEN 1 WHEN {c} * 10 >= n * 9 THEN CASE WHEN sig AND trend = {s} THEN 3 WHEN sig AND trend = -({s}) THEN 5 ELSE 4 END
  WHEN n - {off} = {c} THEN 2 WHEN {o} > 0 THEN 7 ELSE 6 END"""


def _hotspots(reference):
    name = "emerging_hotspots" if reference == "date" else f"emerging_hotspots_{reference}"
    QUERIES[name] = lambda spark, d: spatial.emerging_hotspots(_cube(spark, d), reference=reference).select("y", "x", "category", F.round("trend_z", 6).alias("trend_z"), "n_hot", "n_cold")
    hot = _KIND.format(h="hot", c="n_hot", s="1", off="hot_off", o="len(list_filter(cold[1:n - 1], lambda q: q))")
    cold = _KIND.format(h="cold", c="n_cold", s="-1", off="cold_off", o="len(list_filter(hot[1:n - 1], lambda q: q))")
    ORACLE_SQL[name] = sql(GRID_SQL, _CUBE, *_gi_sql(reference),
        f"lists AS (SELECT y, x, count(*) AS n, list(gi > {_Z} ORDER BY step) AS hot, list(gi < -{_Z} ORDER BY step) AS cold FROM gi GROUP BY ALL)",
        "mk AS (SELECT a.y, a.x, sum(sign(b.gi - a.gi)) AS s FROM gi a JOIN gi b ON a.y = b.y AND a.x = b.x AND a.step < b.step GROUP BY ALL)",
        "ties AS (SELECT y, x, sum(t * (t - 1) * (2 * t + 5)) AS ties FROM (SELECT y, x, gi, count(*) AS t FROM gi GROUP BY ALL) GROUP BY ALL)",
        "test AS (SELECT y, x, CASE WHEN var > 0 THEN CASE WHEN s > 0 THEN (s - 1) / sqrt(var) WHEN s < 0 THEN (s + 1) / sqrt(var) ELSE 0.0 END END AS z FROM (SELECT l.y, l.x, s, (n * (n - 1) * (2 * n + 5) - ties) / 18.0 AS var FROM lists l JOIN mk USING (y, x) JOIN ties USING (y, x) WHERE n >= 3))",
        f"""f AS (SELECT l.*, z, coalesce(abs(z) > {_Z}, false) AS sig, CASE WHEN abs(z) > {_Z} THEN sign(z) ELSE 0 END AS trend, len(list_filter(hot, lambda q: q)) AS n_hot, len(list_filter(cold, lambda q: q)) AS n_cold,
  coalesce(list_max(list_transform(range(1, n + 1), lambda i: CASE WHEN hot[i] THEN 0 ELSE i END)), 0) AS hot_off, coalesce(list_max(list_transform(range(1, n + 1), lambda i: CASE WHEN cold[i] THEN 0 ELSE i END)), 0) AS cold_off FROM lists l LEFT JOIN test USING (y, x))""",
        select=f"SELECT y, x, CASE WHEN n >= 3 THEN coalesce({hot}, -({cold}), 0) END AS category, round(z, 6) AS trend_z, n_hot, n_cold FROM f")


_hotspots("date")
_hotspots("cube")

# ---------------------------------------------------------------- areas with the map's help


def _assessed(spark, d):
    docs = read(spark, d, "documents").select("doc_id", F.col("lang").alias("stratum"), F.when(F.col("doc_id") * 7 % 10 < 8, 1).otherwise(0).alias("map"))
    return docs, docs.join(read(spark, d, "labels").select("doc_id", F.col("quality").alias("ref")), "doc_id")


_ASSESSED = """docs AS (SELECT doc_id, lang AS stratum, CASE WHEN doc_id * 7 % 10 < 8 THEN 1 ELSE 0 END AS map FROM documents),
smp AS (SELECT docs.*, quality AS ref FROM docs JOIN labels USING (doc_id)), wt AS (SELECT stratum, count(*) / sum(count(*)) OVER () AS weight FROM docs GROUP BY 1)"""


def _shares(estimator):
    def query(spark, d):
        docs, samples = _assessed(spark, d)
        mapped = docs.groupBy(F.col("map").alias("class")).agg(F.count("*").alias("k"))
        total = docs.count()
        got = zonal.area_shares(samples, zonal.strata(docs), mapped.select("class", (F.col("k") / total).alias("share")), estimator=estimator)
        return got.select("class", *[F.round(c, 7).alias(c) for c in ("mapped", "estimate", "se", "ci_low", "ci_high")])

    r, value, se = ("1.0", "p + ty - tx", "sqrt(v)") if estimator == "difference" else ("ty / nullif(tx, 0)", "p * ty / nullif(tx, 0)", "p * sqrt(v) / nullif(tx, 0)")
    QUERIES[f"accuracy_{estimator}"] = query
    ORACLE_SQL[f"accuracy_{estimator}"] = sql(_ASSESSED, "cl AS (SELECT map AS class FROM smp UNION SELECT ref FROM smp)", "mp AS (SELECT class, (SELECT count(*) FROM docs WHERE map = class) / (SELECT count(*) FROM docs) AS p FROM cl)",
        "e AS (SELECT stratum, class, CASE WHEN ref = class THEN 1.0::DOUBLE ELSE 0 END AS y, CASE WHEN map = class THEN 1.0::DOUBLE ELSE 0 END AS x FROM smp CROSS JOIN cl)",
        "t AS (SELECT class, sum(weight * my) AS ty, sum(weight * mx) AS tx FROM (SELECT stratum, class, avg(y) AS my, avg(x) AS mx FROM e GROUP BY ALL) JOIN wt USING (stratum) GROUP BY 1)",
        f"q AS (SELECT class, sum(weight * weight * v) AS v FROM (SELECT e.stratum, class, CASE WHEN count(*) > 1 THEN var_samp(y - {r} * x) / count(*) ELSE 0 END AS v FROM e JOIN t USING (class) GROUP BY ALL) JOIN wt USING (stratum) GROUP BY 1)",
        select=f"SELECT class, round(p, 7) AS mapped, round({value}, 7) AS estimate, round({se}, 7) AS se, round({value} - {_Z} * {se}, 7) AS ci_low, round({value} + {_Z} * {se}, 7) AS ci_high FROM t JOIN q USING (class) JOIN mp USING (class)")


_shares("difference")
_shares("ratio")


def transitions(spark, d):
    """Accuracy of each pair of classes at two dates."""
    docs, samples = _assessed(spark, d)
    two = samples.withColumnRenamed("map", "map_from").withColumnRenamed("ref", "ref_from").withColumn("map_to", (F.col("doc_id") % 2).cast("int"))
    two = zonal.transition_samples(two.withColumn("ref_to", F.when(F.col("doc_id") % 5 == 0, 1 - F.col("map_to")).otherwise(F.col("map_to"))))
    got = zonal.accuracy(two.select("stratum", "map", "ref"), zonal.strata(docs))
    return got.where("measure <> 'overall'").select("measure", "class", *[F.round(c, 6).alias(c) for c in ("estimate", "se")])


QUERIES["accuracy_transitions"] = transitions
ORACLE_SQL["accuracy_transitions"] = sql(_ASSESSED, "tr AS (SELECT stratum, map || ' -> ' || (doc_id % 2) AS map, ref || ' -> ' || CASE WHEN doc_id % 5 = 0 THEN 1 - doc_id % 2 ELSE doc_id % 2 END AS ref FROM smp)", "cl AS (SELECT map AS class FROM tr UNION SELECT ref FROM tr)",
    """f AS (SELECT stratum, class, 'users' AS measure, CASE WHEN map = class AND ref = class THEN 1.0::DOUBLE ELSE 0 END AS y, CASE WHEN map = class THEN 1.0::DOUBLE ELSE 0 END AS x FROM tr, cl
  UNION ALL SELECT stratum, class, 'producers', CASE WHEN map = class AND ref = class THEN 1.0 ELSE 0 END, CASE WHEN ref = class THEN 1.0 ELSE 0 END FROM tr, cl UNION ALL SELECT stratum, class, 'area', CASE WHEN ref = class THEN 1.0 ELSE 0 END, 1.0 FROM tr, cl)""",
    "t AS (SELECT measure, class, sum(weight * my) AS ty, sum(weight * mx) AS tx FROM (SELECT stratum, measure, class, avg(y) AS my, avg(x) AS mx FROM f GROUP BY ALL) JOIN wt USING (stratum) GROUP BY ALL)",
    "v AS (SELECT measure, class, sum(weight * weight * v) AS v FROM (SELECT f.stratum, f.measure, f.class, CASE WHEN count(*) > 1 THEN var_samp(y - ty / nullif(tx, 0) * x) / count(*) ELSE 0 END AS v FROM f JOIN t USING (measure, class) GROUP BY ALL) JOIN wt USING (stratum) GROUP BY ALL)",
    select="SELECT measure, class, round(ty / nullif(tx, 0), 6) AS estimate, round(sqrt(v) / nullif(tx, 0), 6) AS se FROM t JOIN v USING (measure, class)")

# ---------------------------------------------------------------- models of segments


def _models(spark, d):
    """A segment a year and pixel with coefficients made of the bands' means."""
    w = wide(spark, d).groupBy("pixel_id", F.year("ts").alias("year")).agg(F.min("ts").alias("t_start"), F.max("ts").alias("t_end"), *[F.avg(b).alias(b) for b in ("green", "red", "nir", "swir1")])
    array = lambda b: F.array(F.col(b) * 1000, F.col("red") / 1e6, F.col("nir"), F.col("red"))
    return w.select("pixel_id", "t_start", "t_end", array("green").alias("green"), array("swir1").alias("swir1"))


_MODELS = "md AS (SELECT pixel_id, min(ts) AS t_start, max(ts) AS t_end, avg(green) AS green, avg(red) AS red, avg(nir) AS nir, avg(swir1) AS swir1 FROM wide GROUP BY pixel_id, year(ts))"
_T = "((DATE '1998-06-15' - DATE '1970-01-01') + 719163 + 366)"
_OM = "(2 * 3.141592653589793 / 365.25)"
QUERIES["synthetic_image"] = lambda spark, d: events.synthetic_image(_models(spark, d), F.lit("1998-06-15").cast("date"), ["green", "swir1"]).select("pixel_id", F.round("green", 6).alias("green"), F.round("swir1", 6).alias("swir1"))
ORACLE_SQL["synthetic_image"] = sql(WIDE_SQL, _MODELS, "s AS (SELECT *, row_number() OVER (PARTITION BY pixel_id ORDER BY CASE WHEN t_start <= DATE '1998-06-15' THEN 0 ELSE 1 END, CASE WHEN t_start <= DATE '1998-06-15' THEN DATE '1970-01-01' - t_start ELSE t_start - DATE '1970-01-01' END) AS k FROM md)",
    select="SELECT pixel_id, " + ", ".join(f"round({b} * 1000 + red / 1e6 * {_T} + nir * cos({_OM} * {_T}) + red * sin({_OM} * {_T}), 6) AS {b}" for b in ("green", "swir1")) + " FROM s WHERE k = 1")
QUERIES["water_mask"] = lambda spark, d: events.water_mask(_models(spark, d), threshold=260.0, green="swir1", swir="green").select("pixel_id", "water")
ORACLE_SQL["water_mask"] = sql(WIDE_SQL, _MODELS, "s AS (SELECT *, (t_start - DATE '1970-01-01') + (t_end - t_start) / 2.0 + 719163 + 366 AS t, row_number() OVER (PARTITION BY pixel_id ORDER BY t_start) AS k FROM md)",
    select="SELECT pixel_id, swir1 * 1000 + red / 1e6 * t > green * 1000 + red / 1e6 * t AND green * 1000 + red / 1e6 * t < 260 AS water FROM s WHERE k = 1")

# ---------------------------------------------------------------- smoothing of probabilities


def _probs(spark, d):
    g = grid(spark, d).withColumn("class", F.explode(F.array(*map(F.lit, range(3)))))
    return g.select("y", "x", "class", ((F.col("size") * (F.col("class") + 3) % 17 + 1) / 20).alias("p"))


QUERIES["smooth_probs"] = lambda spark, d: spatial.smooth_probs(_probs(spark, d)).select("y", "x", "class", F.round("smoothed", 7).alias("smoothed"))
_MIRROR = "CASE WHEN (({c} + d{c}) % (2 * {n}) + 2 * {n}) % (2 * {n}) >= {n} THEN 2 * {n} - 1 - (({c} + d{c}) % (2 * {n}) + 2 * {n}) % (2 * {n}) ELSE (({c} + d{c}) % (2 * {n}) + 2 * {n}) % (2 * {n}) END"
ORACLE_SQL["smooth_probs"] = sql(GRID_SQL, "pr AS (SELECT y, x, c.class, (size * (c.class + 3) % 17 + 1) / 20.0::DOUBLE AS p FROM grid CROSS JOIN (SELECT unnest([0, 1, 2]) AS class) c)", "l AS (SELECT *, ln(greatest(least(p, 0.9999), 0.0001) / (1 - greatest(least(p, 0.9999), 0.0001))) AS z FROM pr)",
    f"o AS (SELECT y, x, {_MIRROR.format(c='y', n='h')} AS yy, {_MIRROR.format(c='x', n='w')} AS xx FROM grid CROSS JOIN (SELECT max(y) + 1 AS h, max(x) + 1 AS w FROM grid) CROSS JOIN (SELECT unnest(range(-4, 5)) AS dy) CROSS JOIN (SELECT unnest(range(-4, 5)) AS dx))",
    "r AS (SELECT o.y, o.x, l.class, l.z, row_number() OVER w AS k, count(*) OVER (PARTITION BY o.y, o.x, l.class) AS n FROM o JOIN l ON l.y = o.yy AND l.x = o.xx WINDOW w AS (PARTITION BY o.y, o.x, l.class ORDER BY l.z DESC))",
    "m AS (SELECT y, x, class, max(n) AS n, avg(z) AS m, var_samp(z) AS s2 FROM r WHERE k <= greatest(2, ceil(n * 0.5)) GROUP BY ALL)",
    select="SELECT y, x, class, round(CASE WHEN n <= 1 THEN p ELSE 1 / (1 + exp(-(s2 * z + 20 * m) / (s2 + 20))) END, 7) AS smoothed FROM (SELECT l.*, n, m, CASE WHEN s2 < 1e-12 THEN 0 ELSE s2 END AS s2 FROM l JOIN m USING (y, x, class))")

# ---------------------------------------------------------------- scenes


def fusion(spark, d):
    fine = read(spark, d, "lineitem").select((F.col("l_suppkey") % 25).alias("tile"), F.to_date("l_shipdate").alias("ts")).where("day(ts) % 9 = 1")
    coarse = read(spark, d, "orders").select((F.col("o_custkey") % 25).alias("tile"), F.to_date("o_orderdate").alias("ts"))
    return events.fusion_plan(fine, coarse, pair_tolerance=3, max_gap=20)


QUERIES["fusion_plan"] = fusion
ORACLE_SQL["fusion_plan"] = """WITH f AS (SELECT DISTINCT l_suppkey % 25 AS tile, CAST(l_shipdate AS DATE) AS ts FROM lineitem WHERE day(l_shipdate) % 9 = 1), c AS (SELECT DISTINCT o_custkey % 25 AS tile, CAST(o_orderdate AS DATE) AS ts FROM orders),
p AS (SELECT tile, fine, coarse FROM (SELECT f.tile, f.ts AS fine, c.ts AS coarse, row_number() OVER (PARTITION BY f.tile, f.ts ORDER BY abs(f.ts - c.ts), c.ts) AS k FROM f JOIN c ON f.tile = c.tile AND c.ts BETWEEN f.ts - 3 AND f.ts + 3) WHERE k = 1),
b AS (SELECT c.tile, c.ts, max(fine) AS fine FROM c JOIN p ON c.tile = p.tile AND fine <= c.ts GROUP BY ALL), a AS (SELECT c.tile, c.ts, min(fine) AS fine FROM c JOIN p ON c.tile = p.tile AND fine >= c.ts GROUP BY ALL)
SELECT c.tile, c.ts AS target, pb.fine AS fine_before, pb.coarse AS coarse_before, pa.fine AS fine_after, pa.coarse AS coarse_after FROM c LEFT JOIN b ON b.tile = c.tile AND b.ts = c.ts AND c.ts - b.fine <= 20 LEFT JOIN p pb ON pb.tile = b.tile AND pb.fine = b.fine
LEFT JOIN a ON a.tile = c.tile AND a.ts = c.ts AND a.fine - c.ts <= 20 LEFT JOIN p pa ON pa.tile = a.tile AND pa.fine = a.fine WHERE pb.fine IS NOT NULL OR pa.fine IS NOT NULL"""

# ---------------------------------------------------------------- sources and sinks


def _place(spark, name):
    return f"{scratch.folder(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def observations_round_trip(spark, d):
    """Observations written by tile and year, and those of some tiles and dates read back."""
    path = _place(spark, "observations")
    o = observations(spark, d).select("seq", "pixel_id", (F.col("pixel_id") % 4).cast("string").alias("tile"), "ts", "band", "value")
    io.write_observations(o, path, tile="tile")
    got = io.read_observations(spark, path, start="2024-01-05", end="2024-01-24", tiles=["1", "3"])
    return got.select("seq", "pixel_id", F.col("tile").cast("string").alias("tile"), "ts", "band", F.round("value", 6).alias("value"))


QUERIES["observations_round_trip"] = observations_round_trip
ORACLE_SQL["observations_round_trip"] = sql(OBS_SQL, select="SELECT seq, pixel_id, CAST(pixel_id % 4 AS VARCHAR) AS tile, ts, band, round(value, 6) AS value FROM obs WHERE ts BETWEEN DATE '2024-01-05' AND DATE '2024-01-24' AND pixel_id % 4 IN (1, 3)")


def zonal_tables_csv(spark, d):
    """The wide zonal table written as CSV and read back."""
    stats = zonal.zonal_stats(_cells(spark, d), _zones(spark, d)).select("zone", "label", "n", F.round("mean", 6).alias("mean"))
    path = io.to_csv({"zonal stats": stats}, _place(spark, "tables"))[0]
    return spark.read.schema("zone int, label string, n long, mean double").csv(path, header=True)


QUERIES["zonal_tables_csv"] = zonal_tables_csv
ORACLE_SQL["zonal_tables_csv"] = sql(CELLS_SQL, select="SELECT n_nationkey AS zone, l.label, count(value) AS n, round(avg(value), 6) AS mean FROM nation CROSS JOIN (SELECT DISTINCT label FROM cells) l LEFT JOIN cells ON cells.zone = n_nationkey AND cells.label = l.label GROUP BY ALL")


def patterns_csv(spark, d):
    """Monthly means of each band as patterns, written as CSV and read back."""
    o = observations(spark, d).where("value IS NOT NULL").groupBy(F.col("band").alias("pattern"), F.col("ts").alias("date")).agg(F.round(F.avg("value"), 6).alias("value"))
    path = io.to_csv({"patterns": o}, _place(spark, "patterns"))[0]
    return io.read_patterns(spark, path)


QUERIES["patterns_csv"] = patterns_csv
ORACLE_SQL["patterns_csv"] = sql(OBS_SQL, select="SELECT band AS pattern, ts, round(avg(value), 6) AS value FROM obs WHERE value IS NOT NULL GROUP BY ALL")
