"""Segments and change events: one event per series, agreement of event maps, segments at dates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SORTS = ("greatest", "newest", "fastest", "longest", "dsnr")


def segments_from_vertices(vertices: DataFrame, *, key: str = "pixel_id", year: str = "year", value: str = "value", rmse: str | None = None) -> DataFrame:
    """Consecutive vertices as segments: seq, y0, y1, v0, v1, change, duration, rate, dsnr."""
    w = W.partitionBy(key).orderBy(year)
    s = vertices.where(F.col(value).isNotNull()).withColumn("y0", F.lag(year).over(w)).withColumn("v0", F.lag(value).over(w)).withColumn("seq", F.row_number().over(w) - 1).where("y0 IS NOT NULL")
    change, duration = F.col(value) - F.col("v0"), F.col(year) - F.col("y0")
    noise = F.try_divide(F.abs(change), F.col(rmse)) if rmse else F.lit(None).cast("double")
    return s.select(key, "seq", "y0", F.col(year).alias("y1"), "v0", F.col(value).alias("v1"), change.alias("change"), duration.alias("duration"), F.try_divide(change, duration).alias("rate"), noise.alias("dsnr"))


def extract_events(segments: DataFrame, event_type: str = "loss", sort_by: str = "greatest", *, min_magnitude: float = 0.0, min_duration: int = 1, pre_val_threshold: float | None = None, key: str = "pixel_id") -> DataFrame:
    """One event per series: of the segments that pass the filters, the first with the highest score.

    The year of detection is the year after the segment's start. Magnitude is -change, change or |change|
    for loss, gain or any, and must be positive. A struct minimum keeps the choice combinable before the shuffle.
    """
    magnitude = {"loss": -F.col("change"), "gain": F.col("change"), "any": F.abs("change")}[event_type]
    s = segments.withColumn("magnitude", magnitude)
    keep = (F.col("magnitude") > 0) & (F.col("magnitude") >= min_magnitude) & (F.col("duration") >= min_duration)
    if pre_val_threshold is not None:
        keep = keep & (F.col("v0") >= pre_val_threshold)
    score: dict[str, Column] = {"greatest": F.col("magnitude"), "newest": F.col("y1").cast("double"), "fastest": F.col("magnitude") / F.col("duration"), "longest": F.col("duration").cast("double"), "dsnr": F.col("dsnr")}
    fields = ["magnitude", "duration", "v0", "v1", "y0", "dsnr"]
    best = F.min(F.struct((-score[sort_by]).alias("s"), "seq", *fields)).alias("m")
    top = s.where(keep).groupBy(key).agg(best)
    m = lambda c: F.col(f"m.{c}")
    return top.select(key, (m("y0") + 1).alias("yod"), m("magnitude").alias("magnitude"), m("duration").alias("duration"), m("v0").alias("pre_val"), m("v1").alias("post_val"), (m("magnitude") / m("duration")).alias("rate"), m("dsnr").alias("dsnr"))


def agreement(maps: list[DataFrame], tolerance: int = 1, *, key: str = "pixel_id", year: str = "yod") -> DataFrame:
    """The year supported by most maps within the tolerance; ties go to more exact matches, then the earliest year.

    Years of a series are gathered into one array (a map gives one at most), so no self-join is needed.
    """
    rows = [m.where(F.col(year) > 0).select(key, F.lit(i).alias("map"), F.col(year).alias("y")) for i, m in enumerate(maps)]
    years = reduce(DataFrame.unionByName, rows).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("map", "y"))).alias("a"))
    ys = F.transform("a", lambda e: e["y"])
    scored = F.transform(ys, lambda y: F.struct(
        (-F.size(F.filter("a", lambda e: F.abs(e["y"] - y) <= tolerance))).alias("support"), (-F.size(F.filter("a", lambda e: e["y"] == y))).alias("exact"), y.alias("y")))
    best = years.withColumn("b", F.array_min(scored))
    agrees = F.transform(F.sequence(F.lit(0), F.lit(len(maps) - 1)), lambda k: F.exists("a", lambda e: (e["map"] == k) & (F.abs(e["y"] - F.col("b.y")) <= tolerance)))
    near = F.filter(ys, lambda y: F.abs(y - F.col("b.y")) <= tolerance)
    return best.select(key, F.col("b.y").alias("yod"), F.size("a").alias("n_detected"), (-F.col("b.support")).alias("n_agree"), (F.array_max(near) - F.array_min(near)).alias("spread"), agrees.alias("agrees"))


def fitted_series(segments: DataFrame, years: DataFrame, *, key: str = "pixel_id", year: str = "year") -> DataFrame:
    """Values on the lines between vertices at given years: an interval join, each year in one segment."""
    y = F.broadcast(years.select(year).distinct())
    first = F.col("seq") == F.min("seq").over(W.partitionBy(key))
    s = segments.withColumn("_first", first)
    inside = ((F.col(year) > F.col("y0")) | (F.col("_first") & (F.col(year) == F.col("y0")))) & (F.col(year) <= F.col("y1"))
    line = F.col("v0") + (F.col("v1") - F.col("v0")) * (F.col(year) - F.col("y0")) / (F.col("y1") - F.col("y0"))
    return s.join(y, inside).select(key, year, line.alias("fitted"))


def segment_at(segments: DataFrame, when: Column, *, key: str = "pixel_id") -> DataFrame:
    """The segment that covers a date; before the first the first, after or in a gap the previous one."""
    s = segments.withColumn("_when", when)
    started = F.max(F.when(F.col("y0") <= F.col("_when"), F.struct("y0", "seq", "y1", "v0", "v1"))).alias("m")
    first = F.min(F.struct("y0", "seq", "y1", "v0", "v1")).alias("f")
    got = s.groupBy(key, "_when").agg(started, first).withColumn("c", F.coalesce("m", "f"))
    return got.select(key, F.col("_when").alias("at"), F.col("c.seq").alias("seq"), F.col("c.y0").alias("y0"), F.col("c.y1").alias("y1"), F.col("c.v0").alias("v0"), F.col("c.v1").alias("v1"))


def predict_harmonic(coefs: list[Column], t: Column) -> Column:
    """a0 + c1 t + sum of a_k cos(k w t) + b_k sin(k w t), w = 2 pi / 365.25, from up to eight coefficients."""
    w = 2 * 3.141592653589793 / 365.25
    total = coefs[0] + coefs[1] * t
    for k in range(1, 1 + (len(coefs) - 2) // 2):
        total = total + coefs[2 * k] * F.cos(k * w * t) + coefs[2 * k + 1] * F.sin(k * w * t)
    return total


def asof_nearest(left: DataFrame, right: DataFrame, tolerance: int, *, key: str, left_ts: str, right_ts: str, left_id: str, value: str) -> DataFrame:
    """For each left row the nearest right row of its key within ``tolerance`` days, the earlier on ties.

    Dates are cut into buckets of the tolerance's length and each left row looks at three of them, so this
    stays an equi-join however long the series are.
    """
    size = max(1, tolerance)
    bucket = lambda c: F.floor(F.unix_date(c) / size)
    a = left.withColumn("_b", F.explode(F.array(bucket(left_ts) - 1, bucket(left_ts), bucket(left_ts) + 1)))
    b = right.select(F.col(key), F.col(right_ts).alias("_t"), F.col(value).alias("_v"), bucket(right_ts).alias("_b"))
    gap = F.abs(F.datediff(left_ts, "_t"))
    near = a.join(b, [key, "_b"]).where(gap <= tolerance)
    best = near.groupBy(left_id).agg(F.min(F.struct(gap.alias("g"), "_t", "_v")).alias("m"))
    return left.join(best, left_id, "left").select(left_id, key, F.col("m._t").alias("matched_ts"), F.col("m._v").alias("matched_value"), F.col("m.g").alias("gap_days"))


def change_vector(df: DataFrame, before: list[str], after: list[str], *, scale: list[float] | None = None, threshold: float = 0.0) -> DataFrame:
    """Change vector analysis: magnitude, direction acos(sum d / (sqrt(B) magnitude)), octant sector, change flag."""
    diffs = [(F.col(a) - F.col(b)) / (scale[i] if scale else 1.0) for i, (b, a) in enumerate(zip(before, after))]
    rho = F.sqrt(sum((d * d for d in diffs), F.lit(0.0)))
    total = sum(diffs, F.lit(0.0))
    cosine = F.try_divide(total, rho * (len(diffs) ** 0.5))
    sector = F.lit(1)
    for k, d in enumerate(diffs[:3]):
        sector = sector + F.when(d > 0, 1 << k).otherwise(0)
    out = df.withColumn("magnitude", rho).withColumn("direction", F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))))
    return out.withColumn("sector", sector.cast("int")).withColumn("change", F.col("magnitude") > threshold)


DATENUM_OF_1970 = 719163 + 366


def synthetic_image(segments: DataFrame, date: Column, bands: list[str], *, key: str = "pixel_id") -> DataFrame:
    """Value of each band at ``date`` under the harmonic model of the segment that covers it.

    ``segments`` is (key, t_start, t_end, one array of up to eight coefficients per band); the segment is the last one
    that has begun, before the first the first.
    """
    s = segments.withColumn("_at", date)
    one = F.struct("t_start", "_at", *bands)
    got = s.groupBy(key).agg(F.max(F.when(F.col("t_start") <= F.col("_at"), one)).alias("m"), F.min(one).alias("f")).withColumn("c", F.coalesce("m", "f"))
    t = F.unix_date("c._at") + DATENUM_OF_1970
    return got.select(key, *[predict_harmonic_array(F.col(f"c.{b}"), t).alias(b) for b in bands])


def predict_harmonic_array(coefs: Column, t: Column) -> Column:
    """``predict_harmonic`` of an array of two, four, six or eight coefficients; missing ones count as 0."""
    return predict_harmonic([F.coalesce(F.get(coefs, F.lit(k)), F.lit(0.0)) for k in range(8)], t)


def water_mask(segments: DataFrame, *, green: str = "green", swir: str = "swir1", threshold: float = 500.0, key: str = "pixel_id") -> DataFrame:
    """Persistent water: in the middle of a pixel's first segment the level a0 + c1 t of green is above that of
    ``swir``, which is below ``threshold``."""
    first = segments.groupBy(key).agg(F.min(F.struct("t_start", "t_end", green, swir)).alias("s"))
    t = F.unix_date("s.t_start") + F.datediff("s.t_end", "s.t_start") / 2 + DATENUM_OF_1970
    level = lambda b: F.col(f"s.{b}")[0] + F.col(f"s.{b}")[1] * t
    return first.select(key, F.coalesce((level(green) > level(swir)) & (level(swir) < threshold), F.lit(False)).alias("water"))


def fusion_plan(fine: DataFrame, coarse: DataFrame, *, pair_tolerance: int = 8, max_gap: int | None = None, key: str = "tile") -> DataFrame:
    """Which pairs of scenes predict which dates, from tables of scene dates (key, ts) alone.

    A pair is a fine date with its nearest coarse date within ``pair_tolerance`` days (the earlier on ties). Each coarse
    date is bracketed by the last pair at or before it and the first at or after it, a pair being placed at its fine
    date; brackets further than ``max_gap`` days away are left out. One row per coarse date with any bracket.
    """
    f = fine.select(key, "ts").where("ts IS NOT NULL").distinct().withColumn("_id", F.struct(key, "ts"))
    c = coarse.select(key, F.col("ts").alias("cts")).where("cts IS NOT NULL").distinct().withColumn("_v", F.col("cts"))
    near = asof_nearest(f, c, pair_tolerance, key=key, left_ts="ts", right_ts="cts", left_id="_id", value="_v").where("matched_ts IS NOT NULL")
    pairs = near.select(key, F.col("_id.ts").alias("ts"), F.struct(F.col("_id.ts").alias("fine"), F.col("matched_ts").alias("coarse")).alias("pair"))
    both = pairs.withColumn("is_pair", F.lit(True)).unionByName(c.select(key, F.col("cts").alias("ts"), F.lit(None).cast("struct<fine:date,coarse:date>").alias("pair"), F.lit(False).alias("is_pair")))
    w = W.partitionBy(key).orderBy("ts")
    # dates of one day see each other's pair on both sides
    before = F.last("pair", ignorenulls=True).over(w.rangeBetween(W.unboundedPreceding, W.currentRow))
    after = F.first("pair", ignorenulls=True).over(w.rangeBetween(W.currentRow, W.unboundedFollowing))
    plan = both.withColumn("b", before).withColumn("a", after).where("NOT is_pair")
    near_enough = lambda side: F.lit(True) if max_gap is None else F.abs(F.datediff("ts", f"{side}.fine")) <= max_gap
    plan = plan.withColumn("b", F.when(near_enough("b"), F.col("b"))).withColumn("a", F.when(near_enough("a"), F.col("a"))).where("a IS NOT NULL OR b IS NOT NULL")
    return plan.select(key, F.col("ts").alias("target"), F.col("b.fine").alias("fine_before"), F.col("b.coarse").alias("coarse_before"), F.col("a.fine").alias("fine_after"), F.col("a.coarse").alias("coarse_after"))
