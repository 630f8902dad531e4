"""Patches, polygons, texture, mosaics and segment comparison on maps (y, x, value)."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geocadence.operators.ordered import numbered
from geocadence.operators.spatial import offsets


def label_patches(df: DataFrame, checkpoint, *, value: str = "class", connectivity: int = 4, id_: Column | None = None) -> DataFrame:
    """Label of each cell's connected patch of equal class: the smallest cell id of the patch.

    Labels spread along links and jump to the label of their label, which halves the paths of every round, until a
    round changes nothing; each round is written through ``checkpoint`` (a function from table to table), so lineage
    stays short. Cell ids are unique for any int y and x unless ``id_`` gives others.
    """
    cell = F.col("y").cast("long") * (1 << 32) + F.col("x") + (1 << 31) if id_ is None else id_
    cells = checkpoint(df.where(F.col(value).isNotNull()).select("y", "x", value, cell.alias("id")))
    near = offsets(df, 1).where("abs(dy) + abs(dx) = 1" if connectivity == 4 else "abs(dy) + abs(dx) > 0")
    moved = cells.crossJoin(F.broadcast(near)).select((F.col("y") + F.col("dy")).cast("int").alias("y"), (F.col("x") + F.col("dx")).cast("int").alias("x"), F.col(value).alias("_v"), F.col("id").alias("other"))
    links = checkpoint(moved.join(cells, ["y", "x"]).where(F.col("_v") == F.col(value)).select("id", "other"))
    labels = checkpoint(cells.select("id", F.col("id").alias("label")))
    while True:
        around = links.join(labels.select(F.col("id").alias("other"), F.col("label").alias("l")), "other").groupBy("id").agg(F.min("l").alias("m"))
        lower = labels.join(around, "id", "left").select("id", F.least("label", F.coalesce("m", "label")).alias("label"))
        jump = lower.select(F.col("id").alias("label"), F.col("label").alias("to"))
        after = checkpoint(lower.join(jump, "label").select("id", F.col("to").alias("label")))
        changed = after.join(labels.withColumnRenamed("label", "was"), "id").where("label <> was").head(1)
        labels = after
        if not changed:
            break
    return cells.join(labels, "id").select("y", "x", value, "label")


def mmu_filter(patches: DataFrame, least: int, *, value: str = "class") -> DataFrame:
    """Cells of patches below the minimum mapping unit become null."""
    size = patches.groupBy("label").agg(F.count("*").alias("n"))
    return patches.join(size, "label").select("y", "x", F.when(F.col("n") >= least, F.col(value)).alias(value))


def patch_table(patches: DataFrame, *, value: str = "class", cell_area: float = 100.0) -> DataFrame:
    """Pixels, area, bounding box and perimeter (in cell edges) of each patch."""
    key = patches.select("y", "x", F.col("label").alias("l2"))
    near = offsets(patches, 1).where("abs(dy) + abs(dx) = 1")
    sides = patches.crossJoin(F.broadcast(near)).select("label", (F.col("y") + F.col("dy")).cast("int").alias("y"), (F.col("x") + F.col("dx")).cast("int").alias("x"))
    inner = sides.join(key, ["y", "x"]).where("label = l2").groupBy("label").agg(F.count("*").alias("inner_sides"))
    base = patches.groupBy("label", value).agg(F.count("*").alias("pixels"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1"))
    edges = F.col("pixels") * 4 - F.coalesce("inner_sides", F.lit(0))
    return base.join(inner, "label", "left").select("label", value, "pixels", (F.col("pixels") * cell_area / 10000).alias("area_ha"), "y0", "y1", "x0", "x1", edges.alias("perimeter"))


def inside(x: Column, y: Column, ring: Column) -> Column:
    """Is a point inside a ring, array<struct<x,y>> with the first corner repeated at the end? Even-odd rule."""
    n = F.size(ring)

    def crossing(i: Column) -> Column:
        a, b = F.element_at(ring, i), F.element_at(ring, i + 1)
        up = (a["y"] > y) != (b["y"] > y)
        at = (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"]
        return F.when(up & (x < at), 1).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), n - 1), F.lit(0), lambda s, i: s + crossing(i)) % 2 == 1


TILE = 64


def rasterize(cells: DataFrame, zones: DataFrame, *, cell: float = 1.0) -> DataFrame:
    """Zone of each cell whose centre lies in a polygon; of overlapping polygons the last by id wins.

    Cells and polygons meet by tiles of TILE x TILE cells, each polygon in all tiles that its bounding box touches.
    """
    x, y = (F.col("x") + 0.5) * cell, (F.col("y") + 0.5) * cell
    boxed = zones.select("zone", "ring", F.array_min("ring.x").alias("lo_x"), F.array_max("ring.x").alias("hi_x"), F.array_min("ring.y").alias("lo_y"), F.array_max("ring.y").alias("hi_y"))
    tile = lambda c: F.floor(F.col(c) / (cell * TILE))
    tiled = boxed.withColumn("_ty", F.explode(F.sequence(tile("lo_y"), tile("hi_y")))).withColumn("_tx", F.explode(F.sequence(tile("lo_x"), tile("hi_x"))))
    own = cells.select("y", "x", F.floor(F.col("y") / TILE).alias("_ty"), F.floor(F.col("x") / TILE).alias("_tx"))
    # a cell's centre never lies on a tile's edge
    met = own.join(tiled, ["_ty", "_tx"]).where((x >= F.col("lo_x")) & (x <= F.col("hi_x")) & (y >= F.col("lo_y")) & (y <= F.col("hi_y"))).where(inside(x, y, F.col("ring")))
    return met.groupBy("y", "x").agg(F.max("zone").alias("zone"))


def mosaic(layers: DataFrame, *, order: str = "layer", value: str = "value") -> DataFrame:
    """Overlap rule of a virtual mosaic: the last layer that has a value wins."""
    return layers.where(F.col(value).isNotNull()).groupBy("y", "x").agg(F.max(F.struct(order, value)).alias("m")).select("y", "x", F.col(f"m.{value}").alias(value))


def texture(df: DataFrame, radius: int = 3, levels: int = 8, lo: float = 0.0, hi: float = 1.0) -> DataFrame:
    """Grey-level co-occurrence features of each window over pairs at distance 1 in four directions, both ways:
    contrast, dissimilarity, homogeneity, asm, entropy. A pair counts in a window that holds both cells."""
    level = F.least(F.lit(levels - 1), F.greatest(F.lit(0), F.floor((F.col("value") - lo) / (hi - lo) * levels))).cast("int")
    g = df.where(F.col("value").isNotNull()).select("y", "x", level.alias("i"))
    ways = F.broadcast(df.sparkSession.createDataFrame([(0, 1), (1, 0), (1, 1), (1, -1)], "ey int, ex int"))
    other = g.select((F.col("y")).alias("y2"), F.col("x").alias("x2"), F.col("i").alias("j"))
    pairs = g.crossJoin(ways).withColumn("y2", (F.col("y") + F.col("ey")).cast("int")).withColumn("x2", (F.col("x") + F.col("ex")).cast("int")).join(other, ["y2", "x2"])
    window = offsets(df, radius)
    held = pairs.crossJoin(window).select((F.col("y") + F.col("dy")).cast("int").alias("cy"), (F.col("x") + F.col("dx")).cast("int").alias("cx"), "y2", "x2", "i", "j")
    held = held.where((F.abs(F.col("cy") - F.col("y2")) <= radius) & (F.abs(F.col("cx") - F.col("x2")) <= radius))
    both = held.select("cy", "cx", F.explode(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))).alias("p")).groupBy("cy", "cx", "p.i", "p.j").agg(F.count("*").alias("n"))
    d = F.abs(F.col("i") - F.col("j"))
    total = both.groupBy("cy", "cx").agg(
        F.sum("n").alias("t"), F.sum(F.col("n") * d * d).alias("c"), F.sum(F.col("n") * d).alias("ds"), F.sum(F.col("n") / (1 + d * d)).alias("h"),
        F.sum(F.col("n") * F.col("n")).alias("a"), F.sum(F.col("n") * F.log("n")).alias("e"),
    )
    t = F.col("t")
    out = total.select(F.col("cy").alias("y"), F.col("cx").alias("x"), (F.col("c") / t).alias("contrast"), (F.col("ds") / t).alias("dissimilarity"), (F.col("h") / t).alias("homogeneity"), (F.col("a") / (t * t)).alias("asm"), (F.log(t) - F.col("e") / t).alias("entropy"))
    return g.select("y", "x").join(out, ["y", "x"])


def segment_overlap(cells: DataFrame, *, predicted: str = "pred", reference: str = "ref", iou_threshold: float = 0.5) -> DataFrame:
    """Best overlap of each reference object: iou, over- and under-segmentation, matched flag."""
    both = cells.where(F.col(predicted).isNotNull() & F.col(reference).isNotNull()).groupBy(predicted, reference).agg(F.count("*").alias("both"))
    p = cells.where(F.col(predicted).isNotNull()).groupBy(predicted).agg(F.count("*").alias("np"))
    r = cells.where(F.col(reference).isNotNull()).groupBy(reference).agg(F.count("*").alias("nr"))
    j = both.join(p, predicted).join(r, reference)
    iou = F.col("both") / (F.col("np") + F.col("nr") - F.col("both"))
    best = j.groupBy(reference).agg(F.max(F.struct(iou.alias("iou"), (-F.col(predicted)).alias("p"), (1 - F.col("both") / F.col("nr")).alias("o"), (1 - F.col("both") / F.col("np")).alias("u"))).alias("m"))
    return r.join(best, reference, "left").select(reference, F.coalesce("m.iou", F.lit(0.0)).alias("iou"), F.col("m.o").alias("over"), F.col("m.u").alias("under"), (F.coalesce("m.iou", F.lit(0.0)) >= iou_threshold).alias("matched"))


def topographic_correction(df: DataFrame, *, by: Sequence[str], value: str = "value", cos_i: str = "cos_i", cos_sz: str = "cos_sz", min_sample: int = 100) -> DataFrame:
    """C-correction: per group the line value = b + m cos i, c = b / m, value (cos sz + c) / (cos i + c)."""
    fit = df.groupBy(*by).agg(F.regr_slope(value, cos_i).alias("_m"), F.regr_intercept(value, cos_i).alias("_b"), F.count(value).alias("_n"))
    c = F.try_divide("_b", "_m")
    ok = (F.col("_n") >= min_sample) & (F.col("_m") > 0)
    full = F.try_divide(F.col(value) * (F.col(cos_sz) + c), F.col(cos_i) + c)
    return df.join(fit, list(by)).withColumn("corrected", F.when(ok, full).otherwise(F.col(value))).drop("_m", "_b", "_n")


def ross_thick(sz: Column, vz: Column, ra: Column) -> Column:
    """Ross-Thick volumetric kernel; angles in radians."""
    cos_x = F.cos(sz) * F.cos(vz) + F.sin(sz) * F.sin(vz) * F.cos(ra)
    x = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos_x)))
    return ((math.pi / 2 - x) * F.cos(x) + F.sin(x)) / (F.cos(sz) + F.cos(vz)) - math.pi / 4


def li_sparse(sz: Column, vz: Column, ra: Column, h: float = 2.0) -> Column:
    """Reciprocal Li-Sparse geometric kernel with spherical crowns; angles in radians."""
    cos_x = F.cos(sz) * F.cos(vz) + F.sin(sz) * F.sin(vz) * F.cos(ra)
    sec = 1 / F.cos(sz) + 1 / F.cos(vz)
    d2 = F.pow(F.tan(sz), 2) + F.pow(F.tan(vz), 2) - 2 * F.tan(sz) * F.tan(vz) * F.cos(ra)
    cos_t = h * F.sqrt(F.greatest(F.lit(0.0), d2 + F.pow(F.tan(sz) * F.tan(vz) * F.sin(ra), 2))) / sec
    t = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos_t)))
    overlap = (t - F.sin(t) * F.cos(t)) * sec / math.pi
    return overlap - sec + (1 + cos_x) / (F.cos(vz) * F.cos(sz)) / 2


def nbar_factor(sz: Column, vz: Column, ra: Column, f_iso: float, f_geo: float, f_vol: float) -> Column:
    """Reflectance ratio of nadir view to the observed view at the same sun angle."""
    nadir, zero = F.lit(0.0), F.lit(0.0)
    at = lambda v, a: f_iso + f_vol * ross_thick(sz, v, a) + f_geo * li_sparse(sz, v, a)
    return at(nadir, zero) / at(vz, ra)


def pansharpen_brovey(df: DataFrame, bands: Sequence[str], pan: str, weights: Sequence[float] | None = None) -> DataFrame:
    weights = weights or [1 / len(bands)] * len(bands)
    intensity = sum((F.col(b) * w for b, w in zip(bands, weights)), F.lit(0.0))
    return df.withColumns({f"{b}_sharp": F.try_divide(F.col(b) * F.col(pan), intensity) for b in bands})


def otsu_threshold(df: DataFrame, value: str, bins: int = 256) -> float:
    """Otsu's threshold from a histogram of fixed size made on the executors."""
    lo, hi = df.agg(F.min(value), F.max(value)).first()
    if lo is None or lo == hi:
        return float(lo or 0.0)
    k = F.least(F.lit(bins - 1), F.floor((F.col(value) - lo) / (hi - lo) * bins)).cast("int")
    n = [0] * bins
    for r in df.where(F.col(value).isNotNull()).groupBy(k.alias("k")).count().collect():
        n[r["k"]] = r["count"]
    mid = [lo + (i + 0.5) * (hi - lo) / bins for i in range(bins)]
    total, mean = sum(n), sum(a * b for a, b in zip(n, mid))
    best, at, w, m = -1.0, lo, 0, 0.0
    for i in range(bins - 1):
        w, m = w + n[i], m + n[i] * mid[i]
        if 0 < w < total:
            between = w * (total - w) * (m / w - (mean - m) / (total - w)) ** 2
            if between > best:
                best, at = between, lo + (i + 1) * (hi - lo) / bins
    return float(at)


def seed_grid(spark, height: int, width: int, spacing: int, kind: str = "rectangular") -> DataFrame:
    """Superpixel seeds: rectangular, diamond (a second grid half a step off) or hexagonal."""
    half = spacing / 2
    step_x = spacing * math.sqrt(3) if kind == "hexagonal" else spacing
    base = spark.range(0, int(height // spacing) + 1).select((F.col("id") * spacing + half).alias("y")).crossJoin(spark.range(0, int(width // step_x) + 1).select((F.col("id") * step_x + half).alias("x")))
    if kind != "rectangular":
        base = base.unionByName(base.select((F.col("y") + half).alias("y"), (F.col("x") + step_x / 2).alias("x")))
    return base.where((F.col("y") < height) & (F.col("x") < width))


def error_profile(df: DataFrame, window: int = 5, *, di: str = "di", observed: str = "observed", predicted: str = "predicted", key: str = "id") -> DataFrame:
    """Moving-window RMSE and MAE of rows ordered by dissimilarity: each row goes to the places whose window holds it."""
    half = window // 2
    placed = numbered(df, [di, key], "_k").drop("_b", "_m")
    e = F.col(observed) - F.col(predicted)
    sent = placed.select(F.explode(F.sequence(F.col("_k") - half, F.col("_k") + half)).alias("_k"), e.alias("_e"))
    around = sent.groupBy("_k").agg(F.sqrt(F.avg(F.col("_e") * F.col("_e"))).alias("rmse"), F.avg(F.abs("_e")).alias("mae"), F.count("*").alias("_n"))
    return placed.join(around, "_k").where(F.col("_n") == 2 * half + 1).drop("_n", "_k")
