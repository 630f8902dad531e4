"""Queries of patches, polygons, texture, mosaics, corrections and orchestration."""

from __future__ import annotations

from pyspark.sql import functions as F

from geocadence.functions.spectral import nd
from geocadence.operators import regions as r
from geocadence.sources.scratch import checkpointed
from geocadence.sources.tables import GRID_SQL, WIDE_SQL, grid, read, sql, wide

QUERIES, ORACLE_SQL = {}, {}


def _patches(spark, d):
    return r.label_patches(grid(spark, d).withColumn("class", (F.col("size") % 3).cast("int")), checkpointed, id_=F.col("y").cast("long") * 1_000_000 + F.col("x"))


_LABEL = """g AS (SELECT y, x, CAST(size % 3 AS INTEGER) AS class, y * 1000000 + x AS id FROM grid), l AS (SELECT a.id, b.id AS o FROM g a JOIN g b ON a.class = b.class AND abs(a.y - b.y) + abs(a.x - b.x) = 1),
reach(id, o) AS (SELECT id, id FROM g UNION SELECT reach.id, l.o FROM reach JOIN l ON l.id = reach.o), p AS (SELECT g.y, g.x, g.class, (SELECT min(o) FROM reach WHERE reach.id = g.id) AS label FROM g)"""


def _rec(select):
    return "WITH RECURSIVE " + GRID_SQL + ",\n" + _LABEL + "\n" + select


QUERIES["patch_labels"] = _patches
ORACLE_SQL["patch_labels"] = _rec("SELECT y, x, class, label FROM p")
QUERIES["mmu_filter"] = lambda spark, d: r.mmu_filter(_patches(spark, d), 4).withColumn("class", F.col("class").cast("double"))
ORACLE_SQL["mmu_filter"] = _rec("SELECT y, x, CAST(CASE WHEN count(*) OVER (PARTITION BY label) >= 4 THEN class END AS DOUBLE) AS class FROM p")
QUERIES["patch_table"] = lambda spark, d: r.patch_table(_patches(spark, d))
ORACLE_SQL["patch_table"] = _rec("""SELECT a.label, a.class, a.pixels, a.pixels * 100.0 / 10000 AS area_ha, y0, y1, x0, x1, a.pixels * 4 - coalesce(n, 0) AS perimeter FROM
 (SELECT label, class, count(*) AS pixels, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1 FROM p GROUP BY ALL) a LEFT JOIN
 (SELECT a.label, count(*) AS n FROM p a JOIN p b ON a.label = b.label AND abs(a.y - b.y) + abs(a.x - b.x) = 1 GROUP BY 1) b ON a.label = b.label""")

_RINGS = {1: [(2.2, 1.1), (20.4, 3.3), (15.6, 25.7), (4.8, 18.9), (2.2, 1.1)], 2: [(12.1, 10.2), (40.3, 12.4), (33.5, 30.6), (12.1, 10.2)]}


def _zones(spark):
    return spark.createDataFrame([(z, [{"x": a, "y": b} for a, b in ring]) for z, ring in _RINGS.items()], "zone int, ring array<struct<x:double,y:double>>")


QUERIES["rasterize"] = lambda spark, d: r.rasterize(grid(spark, d), _zones(spark))
_EDGES = ", ".join(f"({z}, {a[0]}, {a[1]}, {b[0]}, {b[1]})" for z, ring in _RINGS.items() for a, b in zip(ring, ring[1:]))
ORACLE_SQL["rasterize"] = sql(GRID_SQL, f"e(z, ax, ay, cx, cy) AS (VALUES {_EDGES})", "h AS (SELECT y, x, z, count(*) AS n FROM grid CROSS JOIN e WHERE (ay > y + 0.5) <> (cy > y + 0.5) AND x + 0.5 < (cx - ax) * (y + 0.5 - ay) / (cy - ay) + ax GROUP BY ALL)",
    select="SELECT y, x, max(z) AS zone FROM h WHERE n % 2 = 1 GROUP BY ALL")


def mosaic(spark, d):
    g = grid(spark, d).withColumn("v", F.sqrt("size"))
    layers = [g.select("y", "x", F.lit(k).alias("layer"), F.when((F.col("size") + k) % 3 != 0, F.col("v") + k).alias("value")) for k in range(3)]
    return r.mosaic(layers[0].unionByName(layers[1]).unionByName(layers[2]))


QUERIES["mosaic_overlap"] = mosaic
ORACLE_SQL["mosaic_overlap"] = sql(GRID_SQL, "l AS (SELECT y, x, k, CASE WHEN (size + k) % 3 <> 0 THEN sqrt(size) + k END AS v FROM grid CROSS JOIN (SELECT unnest([0, 1, 2]) AS k))", select="SELECT y, x, max_by(v, k) AS value FROM l WHERE v IS NOT NULL GROUP BY ALL")

QUERIES["texture_glcm"] = lambda spark, d: r.texture(grid(spark, d).withColumn("value", F.col("size") / 51), 1, 4).select("y", "x", *[F.round(c, 7).alias(c) for c in ("contrast", "dissimilarity", "homogeneity", "asm", "entropy")])
ORACLE_SQL["texture_glcm"] = sql(GRID_SQL, "g AS (SELECT y, x, CAST(least(3, greatest(0, floor(size / 51.0 * 4))) AS INTEGER) AS i FROM grid)", "w(ey, ex) AS (VALUES (0, 1), (1, 0), (1, 1), (1, -1))",
    "p AS (SELECT a.y, a.x, b.y AS y2, b.x AS x2, a.i, b.i AS j FROM g a CROSS JOIN w JOIN g b ON b.y = a.y + ey AND b.x = a.x + ex)", "q AS (SELECT y, x, y2, x2, i, j FROM p UNION ALL SELECT y, x, y2, x2, j, i FROM p)",
    "n AS (SELECT c.y, c.x, q.i, q.j, count(*) AS n FROM g c JOIN q ON abs(c.y - q.y) <= 1 AND abs(c.x - q.x) <= 1 AND abs(c.y - q.y2) <= 1 AND abs(c.x - q.x2) <= 1 GROUP BY ALL)", "t AS (SELECT *, n / sum(n) OVER (PARTITION BY y, x) AS p FROM n)",
    select="SELECT y, x, round(sum(p * (i - j) * (i - j)), 7) AS contrast, round(sum(p * abs(i - j)), 7) AS dissimilarity, round(sum(p / (1 + (i - j) * (i - j))), 7) AS homogeneity, round(sum(p * p), 7) AS asm, round(-sum(p * ln(p)), 7) AS entropy FROM t GROUP BY ALL")

QUERIES["segmentation_accuracy"] = lambda spark, d: r.segment_overlap(grid(spark, d).select((F.floor(F.col("y") / 6) * 10 + F.floor(F.col("x") / 7)).alias("pred"), (F.floor((F.col("y") + 2) / 7) * 10 + F.floor(F.col("x") / 8)).alias("ref"))).select("ref", F.round("iou", 8).alias("iou"), F.round("over", 8).alias("over"), F.round("under", 8).alias("under"), "matched")
ORACLE_SQL["segmentation_accuracy"] = sql(GRID_SQL, "c AS (SELECT y // 6 * 10 + x // 7 AS pred, (y + 2) // 7 * 10 + x // 8 AS ref FROM grid)", "b AS (SELECT pred, ref, count(*) AS n FROM c GROUP BY ALL)", "s AS (SELECT *, sum(n) OVER (PARTITION BY pred) AS np, sum(n) OVER (PARTITION BY ref) AS nr FROM b)",
    select="SELECT CAST(ref AS BIGINT) AS ref, round(n / (np + nr - n), 8) AS iou, round(1 - n / nr, 8) AS over, round(1 - n / np, 8) AS under, n / (np + nr - n) >= 0.5 AS matched FROM (SELECT *, row_number() OVER (PARTITION BY ref ORDER BY n / (np + nr - n) DESC, pred) AS k FROM s) WHERE k = 1")


def _lit(spark, d):
    return wide(spark, d).withColumn("cos_i", 0.3 + F.col("red") * 3).withColumn("cos_sz", F.lit(0.7)).withColumn("value", F.sqrt("nir") + F.col("red")).withColumn("year", F.year("ts"))


QUERIES["topographic_correction"] = lambda spark, d: r.topographic_correction(_lit(spark, d), by=["year"]).select("seq", F.round("corrected", 7).alias("corrected"))
ORACLE_SQL["topographic_correction"] = sql(WIDE_SQL, "v AS (SELECT seq, year(ts) AS year, 0.3 + red * 3 AS ci, sqrt(nir) + red AS v FROM wide)", "f AS (SELECT year, regr_slope(v, ci) AS m, regr_intercept(v, ci) AS b, count(*) AS n FROM v GROUP BY 1)",
    select="SELECT seq, round(CASE WHEN n >= 100 AND m > 0 THEN v * (0.7 + b / m) / (ci + b / m) ELSE v END, 7) AS corrected FROM v JOIN f USING (year)")
QUERIES["nbar_factor"] = lambda spark, d: wide(spark, d).select("seq", F.round(r.nbar_factor(F.radians(30 + F.col("red") * 40), F.radians(F.col("swir1") * 15), F.radians(F.col("nir") * 100), 0.1690, 0.0227, 0.0574), 8).alias("factor"))


def _pan(spark, d):
    return r.pansharpen_brovey(wide(spark, d).withColumn("pan", F.sqrt("nir")), ["red", "green", "blue"], "pan")


QUERIES["pansharpen_brovey"] = lambda spark, d: _pan(spark, d).select("seq", *[F.round(f"{b}_sharp", 8).alias(b) for b in ("red", "green", "blue")])
ORACLE_SQL["pansharpen_brovey"] = sql(WIDE_SQL, select="SELECT seq, " + ", ".join(f"round({b} * sqrt(nir) / nullif(red * (1/3.0::DOUBLE) + green * (1/3.0::DOUBLE) + blue * (1/3.0::DOUBLE), 0), 8) AS {b}" for b in ("red", "green", "blue")) + " FROM wide")
QUERIES["seed_grid_hexagonal"] = lambda spark, d: r.seed_grid(spark, 60, 80, 10, "hexagonal").select(F.round("y", 6).alias("y"), F.round("x", 6).alias("x"))
ORACLE_SQL["seed_grid_hexagonal"] = "WITH b AS (SELECT i * 10 + 5.0::DOUBLE AS y, j * 10 * sqrt(3) + 5 AS x FROM range(0, 7) a(i) CROSS JOIN range(0, 5) c(j)), u AS (SELECT * FROM b UNION ALL SELECT y + 5, x + 5 * sqrt(3) FROM b) SELECT round(y, 6) AS y, round(x, 6) AS x FROM u WHERE y < 60 AND x < 80"
QUERIES["cva_otsu"] = lambda spark, d: spark.createDataFrame([(round(r.otsu_threshold(wide(spark, d).select(F.sqrt("nir").alias("v")), "v"), 6),)], "threshold double")


def error_profile(spark, d):
    p = read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.sqrt(F.col("p_retailprice")).alias("observed"), F.sqrt(F.col("p_partkey") + 800).alias("predicted"), ((F.col("p_partkey") * 37 % 1009) / 100).alias("di"))
    return r.error_profile(p).select("id", F.round("rmse", 6).alias("rmse"), F.round("mae", 6).alias("mae"))


QUERIES["error_profile"] = error_profile
ORACLE_SQL["error_profile"] = """WITH p AS (SELECT p_partkey AS id, sqrt(p_retailprice) - sqrt(p_partkey + 800) AS e, (p_partkey * 37 % 1009) / 100.0 AS di FROM part),
w AS (SELECT id, sqrt(avg(e * e) OVER w) AS rmse, avg(abs(e)) OVER w AS mae, count(*) OVER w AS n FROM p WINDOW w AS (ORDER BY di, id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) SELECT id, round(rmse, 6) AS rmse, round(mae, 6) AS mae FROM w WHERE n = 5"""


def join_in_time(spark, d):
    """Two cubes on one grid joined in time; grids must match."""
    a = wide(spark, d).select("pixel_id", "ts", "seq", "red").where("year(ts) < 1998")
    b = wide(spark, d).select("pixel_id", "ts", "seq", "red").where("year(ts) >= 1998")
    return a.unionByName(b).groupBy("pixel_id").agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))


QUERIES["join_in_time"] = join_in_time
ORACLE_SQL["join_in_time"] = sql(WIDE_SQL, select="SELECT pixel_id, count(*) AS n, min(ts) AS first, max(ts) AS last FROM wide GROUP BY 1")


def values_at(spark, d):
    """Codes of a map at points, -1 outside."""
    pts = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") / 37).alias("px"), (F.col("c_custkey") % 45 + 0.5).alias("py"))
    keyed = pts.withColumn("x", F.floor("px").cast("int")).withColumn("y", F.floor("py").cast("int"))
    return keyed.join(grid(spark, d).select("y", "x", "class"), ["y", "x"], "left").select("id", F.coalesce("class", F.lit(-1)).alias("code"))


QUERIES["values_at_points"] = values_at
ORACLE_SQL["values_at_points"] = sql(GRID_SQL, select="SELECT c_custkey AS id, coalesce(class, -1) AS code FROM customer LEFT JOIN grid ON x = CAST(floor(c_acctbal / 37) AS INTEGER) AND y = CAST(floor(c_custkey % 45 + 0.5) AS INTEGER)")


def scene_catalogue(spark, d):
    """Scenes chosen by metadata, broadcast to prune the observations that are read."""
    scenes = read(spark, d, "orders").select(F.to_date("o_orderdate").alias("ts"), (F.col("o_orderkey") % 100).alias("cloud")).groupBy("ts").agg(F.min("cloud").alias("cloud"))
    chosen = scenes.where("cloud < 30 AND ts BETWEEN DATE '1996-01-01' AND DATE '1998-12-31'").select("ts")
    return wide(spark, d).join(F.broadcast(chosen), "ts").groupBy("pixel_id").agg(F.count("*").alias("n"), F.round(F.avg(nd(F.sqrt("nir"), F.col("red"))), 8).alias("index_mean"))


QUERIES["scene_catalogue"] = scene_catalogue
ORACLE_SQL["scene_catalogue"] = sql(WIDE_SQL, "s AS (SELECT CAST(o_orderdate AS DATE) AS ts, min(o_orderkey % 100) AS cloud FROM orders GROUP BY 1)",
    select="SELECT pixel_id, count(*) AS n, round(avg((sqrt(nir) - red) / nullif(sqrt(nir) + red, 0)), 8) AS index_mean FROM wide WHERE ts IN (SELECT ts FROM s WHERE cloud < 30 AND ts BETWEEN DATE '1996-01-01' AND DATE '1998-12-31') GROUP BY 1")


def remaining_tiles(spark, d):
    """Tiles of a shard that a manifest does not list as done."""
    tiles = read(spark, d, "part").select(F.col("p_partkey").alias("tile")).where("tile % 3 = 1")
    done = read(spark, d, "part").where("p_size > 25").select(F.col("p_partkey").alias("tile"))
    return tiles.join(done, "tile", "left_anti")


QUERIES["remaining_tiles"] = remaining_tiles
ORACLE_SQL["remaining_tiles"] = "SELECT p_partkey AS tile FROM part WHERE p_partkey % 3 = 1 AND NOT p_size > 25"


def cluster_folds(spark, d):
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    pts = VectorAssembler(inputCols=["y", "x"], outputCol="f").transform(grid(spark, d).select("y", "x"))
    return KMeans(k=5, seed=1, featuresCol="f", predictionCol="fold").fit(pts).transform(pts).select("y", "x", "fold")


QUERIES["spatial_cluster_folds"] = cluster_folds
