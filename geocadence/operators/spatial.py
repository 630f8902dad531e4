"""Neighbourhood operators on maps (y, x, value): each cell sends its value to the cells whose window holds it.

An offset table is broadcast (its size is the window's, never the map's), so a window of k cells costs one
k-fold explode and one hash aggregate on the cell, combined before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geocadence.functions import special
from geocadence.operators import series
from geocadence.operators.ordered import numbered


def offsets(df: DataFrame, radius: int, shape: str = "square") -> DataFrame:
    rows = [(dy, dx) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1) if shape == "square" or dy * dy + dx * dx <= radius * radius]
    return F.broadcast(df.sparkSession.createDataFrame(rows, "dy int, dx int"))


def spread(df: DataFrame, radius: int, shape: str = "square", keep: tuple[str, ...] = ("value",), by: tuple[str, ...] = ()) -> DataFrame:
    """Rows (by, y, x) of target cells with the ``keep`` columns of each cell in their window, and is_self."""
    moved = df.crossJoin(offsets(df, radius, shape))
    return moved.select(*by, (F.col("y") + F.col("dy")).cast("int").alias("y"), (F.col("x") + F.col("dx")).cast("int").alias("x"), *keep, ((F.col("dy") == 0) & (F.col("dx") == 0)).alias("is_self"))


def gi_star(df: DataFrame, radius: int = 1, shape: str = "square", by: tuple[str, ...] = ()) -> DataFrame:
    """Getis-Ord Gi* per cell: sum over the window of (x - mu) over sigma sqrt((n m - m^2) / (n - 1)), with mean and
    population deviation of the date; a missing centre, n < 2 or sigma 0 give null."""
    valid = df.where(F.col("value").isNotNull())
    stats = valid.groupBy(*by).agg(F.count("*").alias("n"), F.avg("value").alias("mu"), F.stddev_pop("value").alias("sd"))
    sums = spread(valid, radius, shape, by=by).groupBy(*by, "y", "x").agg(F.sum("value").alias("s"), F.count("*").alias("m"), F.max("is_self").alias("own")).where("own")
    j = sums.join(F.broadcast(stats), list(by)) if by else sums.crossJoin(F.broadcast(stats))
    below = F.col("sd") * F.sqrt((F.col("n") * F.col("m") - F.col("m") * F.col("m")) / (F.col("n") - 1))
    z = F.when((F.col("n") >= 2) & (F.col("sd") > 0), F.try_divide(F.col("s") - F.col("m") * F.col("mu"), below))
    return j.select(*by, "y", "x", z.alias("gi"))


def majority_filter(df: DataFrame, size: int = 3, *, value: str = "class") -> DataFrame:
    """Most frequent class of the window; the cell's own class wins ties, else the smallest."""
    own = df.where(F.col(value).isNotNull())
    counted = spread(own, size // 2, keep=(value,)).groupBy("y", "x", value).agg(F.count("*").alias("n"), F.max("is_self").alias("own"))
    best = F.min(F.struct((-F.col("n")).alias("a"), (~F.col("own")).alias("b"), F.col(value).alias("c"))).alias("m")
    got = counted.groupBy("y", "x").agg(best, F.max("own").alias("has")).where("has")
    return got.select("y", "x", F.col("m.c").alias(value))


def buffer_mask(df: DataFrame, distance: int, *, mask: str = "mask") -> DataFrame:
    """Dilate true cells by a disc of ``distance`` cells, within the map."""
    near = spread(df.where(F.col(mask)), distance, "circle", keep=()).select("y", "x").distinct().withColumn("_m", F.lit(True))
    return df.join(near, ["y", "x"], "left").select("y", "x", F.coalesce("_m", F.lit(False)).alias(mask))


def bayesian_filter(probs: DataFrame, window_size: int = 3) -> DataFrame:
    """Arg-max over classes of p times the window mean of p; the smaller class on ties. Input (y, x, class, p)."""
    mean = spread(probs, window_size // 2, keep=("class", "p")).groupBy("y", "x", "class").agg(F.avg("p").alias("mp"))
    scored = probs.join(mean, ["y", "x", "class"]).withColumn("score", F.round(F.col("p") * F.col("mp"), 9))
    best = F.max(F.struct("score", (-F.col("class")).alias("c"))).alias("m")
    return scored.groupBy("y", "x").agg(best).select("y", "x", (-F.col("m.c")).alias("class"), F.col("m.score").alias("score"))


def focal(df: DataFrame, radius: int, shape: str = "square") -> DataFrame:
    """Mean and population deviation of each cell's window."""
    got = spread(df.where(F.col("value").isNotNull()), radius, shape).groupBy("y", "x").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.max("is_self").alias("own"))
    return got.where("own").select("y", "x", "mean", "std")


def slope_aspect(df: DataFrame, cell: float = 1.0) -> DataFrame:
    """Horn's slope (degrees) and aspect (degrees clockwise from north) of a DEM; cells need all eight neighbours."""
    moved = df.where(F.col("value").isNotNull()).crossJoin(offsets(df, 1)).select((F.col("y") + F.col("dy")).cast("int").alias("y"), (F.col("x") + F.col("dx")).cast("int").alias("x"), "dy", "dx", "value")
    # a value sent by (dy, dx) stands at (-dy, -dx) from its target
    weight = lambda a, b: F.when(F.col(b) == 0, 2).otherwise(1) * -F.col(a)
    sums = moved.groupBy("y", "x").agg(F.count("*").alias("n"), F.sum(weight("dx", "dy") * F.col("value")).alias("gx"), F.sum(weight("dy", "dx") * F.col("value")).alias("gy")).where("n = 9")
    gx, gy = F.col("gx") / (8 * cell), F.col("gy") / (8 * cell)
    slope = F.degrees(F.atan(F.sqrt(gx * gx + gy * gy)))
    aspect = F.pmod(F.degrees(F.atan2(-gx, gy)), F.lit(360.0))
    return sums.select("y", "x", slope.alias("slope"), F.when((gx != 0) | (gy != 0), aspect).alias("aspect"))


def resample(df: DataFrame, factor: int, how: str = "average") -> DataFrame:
    """Area resampling onto a grid of ``factor`` times coarser cells: average, min, max, med, mode, sum, rms."""
    v = F.col("value")
    how_to = {"average": F.avg(v), "min": F.min(v), "max": F.max(v), "med": F.median(v), "sum": F.sum(v), "rms": F.sqrt(F.avg(v * v)), "mode": F.mode(v, True)}
    return df.where(v.isNotNull()).groupBy(F.floor(F.col("y") / factor).cast("int").alias("y"), F.floor(F.col("x") / factor).cast("int").alias("x")).agg(how_to[how].alias("value"))


def spatial_blocks(points: DataFrame, size: float, k: int, *, shape: str = "square", selection: str = "systematic", x: str = "x", y: str = "y") -> DataFrame:
    """Fold of each point by its block: squares or hexagons; systematic (row by row) or checkerboard (two folds)."""
    if shape == "square":
        col, row = F.floor(F.col(x) / size), F.floor(F.col(y) / size)
    else:
        # axial coordinates of pointy-top hexagons, rounded in cube coordinates
        q, r = (F.col(x) * (3**0.5) / 3 - F.col(y) / 3) / (size / 3**0.5), (F.col(y) * 2 / 3) / (size / 3**0.5)
        s = -q - r
        rq, rr, rs = F.round(q), F.round(r), F.round(s)
        dq, dr, ds = F.abs(rq - q), F.abs(rr - r), F.abs(rs - s)
        col = F.when((dq > dr) & (dq > ds), -rr - rs).otherwise(rq)
        row = F.when((dq > dr) & (dq > ds), rr).when(dr > ds, -rq - rs).otherwise(rr)
    b = points.withColumn("block_col", col.cast("long")).withColumn("block_row", row.cast("long"))
    if selection == "checkerboard":
        return b.withColumn("fold", F.pmod(F.col("block_col") + F.col("block_row"), F.lit(2)).cast("int"))
    blocks = b.select("block_row", "block_col").distinct()
    ranked = numbered(blocks, ["block_row", "block_col"], "_k").select("block_row", "block_col", (F.col("_k") % k).cast("int").alias("fold"))
    return b.join(ranked, ["block_row", "block_col"])


def variogram(points: DataFrame, cutoff: float, bins: int) -> DataFrame:
    """Empirical semivariogram over all pairs of points (id, x, y, value): pairs within the cutoff meet through
    cells of the cutoff's size, so the work follows the density, not the square of the number of points."""
    cell = lambda c: F.floor(F.col(c) / cutoff)
    a = points.select(F.col("id").alias("i"), F.col("x").alias("xa"), F.col("y").alias("ya"), F.col("value").alias("va"), cell("x").alias("cx"), cell("y").alias("cy"))
    b = points.select(F.col("id").alias("j"), F.col("x").alias("xb"), F.col("y").alias("yb"), F.col("value").alias("vb"), cell("x").alias("bx"), cell("y").alias("by")).crossJoin(offsets(points, 1))
    b = b.select("j", "xb", "yb", "vb", (F.col("bx") + F.col("dx")).alias("cx"), (F.col("by") + F.col("dy")).alias("cy"))
    d = F.sqrt(F.pow(F.col("xa") - F.col("xb"), 2) + F.pow(F.col("ya") - F.col("yb"), 2))
    pairs = a.join(b, ["cx", "cy"]).where("i < j").withColumn("d", d).where((F.col("d") > 0) & (F.col("d") <= cutoff))
    k = F.least(F.lit(bins - 1), F.ceil(F.col("d") / (cutoff / bins)).cast("int") - 1)
    return pairs.groupBy(k.alias("bin")).agg(F.count("*").alias("n"), F.avg("d").alias("distance"), (F.avg(F.pow(F.col("va") - F.col("vb"), 2)) / 2).alias("gamma"))


#: codes of the patterns, cold spots with a minus sign; 0 is no pattern
HOTSPOT_PATTERNS = {1: "new", 2: "consecutive", 3: "intensifying", 4: "persistent", 5: "diminishing", 6: "sporadic", 7: "oscillating", 8: "historical"}


def gi_star_series(df: DataFrame, radius: int = 1, shape: str = "square", lag: int = 1, reference: str = "date") -> DataFrame:
    """Gi* of each cell and step (step, y, x, value): neighbours are the window's cells of the step and of ``lag`` steps
    before; mean, deviation and n are those of the step ("date") or of all steps ("cube")."""
    valid = df.where(F.col("value").isNotNull())
    by = ["step"] if reference == "date" else []
    stats = valid.groupBy(*by).agg(F.count("*").alias("n"), F.avg("value").alias("mu"), F.stddev_pop("value").alias("sd"))
    later = F.explode(F.array([F.struct((F.col("step") + k).alias("step"), F.lit(k == 0).alias("now")) for k in range(lag + 1)]))
    moved = spread(valid, radius, shape, by=("step",)).select(later.alias("t"), "y", "x", "value", "is_self")
    sums = moved.groupBy(F.col("t.step").alias("step"), "y", "x").agg(F.sum("value").alias("s"), F.count("*").alias("m"), F.max(F.col("is_self") & F.col("t.now")).alias("own")).where("own")
    j = sums.join(F.broadcast(stats), by) if by else sums.crossJoin(F.broadcast(stats))
    below = F.col("sd") * F.sqrt((F.col("n") * F.col("m") - F.col("m") * F.col("m")) / (F.col("n") - 1))
    z = F.when((F.col("n") >= 2) & (F.col("sd") > 0), F.try_divide(F.col("s") - F.col("m") * F.col("mu"), below))
    return j.select("step", "y", "x", z.alias("gi"))


def _pattern(hot: str, cold: str, sign: int) -> Column:
    """Code of a cell's pattern of hot dates, null for none: the first definition that holds."""
    h, n = F.col(hot), F.size(hot)
    count = F.size(F.filter(h, lambda v: v))
    mostly = count * 10 >= n * 9
    last_off = F.array_max(F.transform(h, lambda v, i: F.when(v, 0).otherwise(i + 1)))
    other = F.exists(F.slice(cold, F.lit(1), n - 1), lambda v: v)
    rising, falling = F.col("significant") & (F.col("trend") == sign), F.col("significant") & (F.col("trend") == -sign)
    return (
        F.when(~F.element_at(h, -1), F.when(mostly, 8)).when(count == 1, 1)
        .when(mostly, F.when(rising, 3).when(falling, 5).otherwise(4))
        .when(n - last_off == count, 2).when(other, 7).otherwise(6)
    )


def emerging_hotspots(df: DataFrame, radius: int = 1, *, shape: str = "square", lag: int = 1, reference: str = "date", alpha: float = 0.05) -> DataFrame:
    """y, x, category (codes of HOTSPOT_PATTERNS), trend_z, n_hot, n_cold of every cell of (step, y, x, value).

    Gi* of each step, the original Mann-Kendall test of its series, and the pattern of its significant steps. A
    cell with fewer than three steps has no category.
    """
    gi = gi_star_series(df, radius, shape, lag, reference).where("gi IS NOT NULL").withColumn("cell", F.struct("y", "x"))
    test = series.mann_kendall(gi, step="step", key="cell", value="gi", alpha=alpha, min_valid=3)
    limit = special.normal_quantile(1 - alpha / 2)
    z = gi.groupBy("cell").agg(F.array_sort(F.collect_list(F.struct("step", "gi"))).alias("a"))
    hot, cold = F.transform("a", lambda s: s["gi"] > limit), F.transform("a", lambda s: s["gi"] < -limit)
    flags = z.select("cell", hot.alias("hot"), cold.alias("cold")).join(test.select("cell", "trend", F.col("h").alias("significant"), F.col("z").alias("trend_z")), "cell", "left")
    flags = flags.withColumn("trend", F.coalesce("trend", F.lit(0))).withColumn("significant", F.coalesce("significant", F.lit(False)))
    code = F.coalesce(_pattern("hot", "cold", 1), -_pattern("cold", "hot", -1), F.lit(0))
    on = lambda c: F.size(F.filter(c, lambda v: v))
    return flags.select("cell.y", "cell.x", F.when(F.size("hot") >= 3, code).alias("category"), "trend_z", on("hot").alias("n_hot"), on("cold").alias("n_cold"))


def smooth_probs(probs: DataFrame, window_size: int = 9, neigh_fraction: float = 0.5, smoothness: float = 20.0, eps: float = 1e-4) -> DataFrame:
    """Bayesian smoothing of class probabilities (y, x, class, p): each logit is drawn to the mean of the highest
    ``neigh_fraction`` of the window's logits of its class, the more the less those vary.

    Windows are mirrored at the map's edges, the edge cell repeated; the map must be at least half a window wide. A
    missing cell is a missing row; a cell alone in its window keeps its value. At least two logits are used.
    """
    half = window_size // 2
    size = probs.agg((F.max("y") + 1).alias("_h"), (F.max("x") + 1).alias("_w"))
    p = F.least(F.greatest(F.col("p"), F.lit(eps)), F.lit(1 - eps))
    cells = probs.crossJoin(F.broadcast(size)).withColumn("logit", F.ln(p / (1 - p)))

    def copies(c: str, n: str) -> Column:
        """The places of a cell: its own, and those beyond an edge that show it."""
        places = F.array(F.col(c), F.when(F.col(c) < half, -1 - F.col(c)), F.when(F.col(c) >= F.col(n) - half, 2 * F.col(n) - 1 - F.col(c)))
        return F.explode(F.filter(places, lambda v: v.isNotNull()))

    shown = cells.withColumn("_y", copies("y", "_h")).withColumn("_x", copies("x", "_w"))
    shown = shown.select(F.col("_y").alias("y"), F.col("_x").alias("x"), "class", "logit")
    around = spread(shown, half, keep=("class", "logit")).groupBy("y", "x", "class").agg(F.sort_array(F.collect_list("logit"), asc=False).alias("a"))
    used = around.withColumn("t", F.greatest(F.lit(2), F.ceil(F.size("a") * F.lit(neigh_fraction))).cast("int")).withColumn("a_", F.slice("a", F.lit(1), F.col("t")))
    total = F.aggregate("a_", F.lit(0.0), lambda acc, v: acc + v)
    used = used.withColumn("m", total / F.size("a_"))
    spare = F.aggregate("a_", F.lit(0.0), lambda acc, v: acc + (v - F.col("m")) * (v - F.col("m"))) / (F.size("a_") - 1)
    used = used.select("y", "x", "class", F.size("a").alias("n"), "m", F.when(F.size("a_") > 1, spare).alias("s2"))
    s2 = F.when(F.col("s2") < 1e-12, 0.0).otherwise(F.col("s2"))
    mean = (s2 * F.col("logit") + smoothness * F.col("m")) / (s2 + smoothness)
    out = cells.join(used, ["y", "x", "class"])
    return out.select("y", "x", "class", F.when(F.col("n") <= 1, F.col("p")).otherwise(1 / (1 + F.exp(-mean))).alias("smoothed"))
