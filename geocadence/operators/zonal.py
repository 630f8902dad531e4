"""Zonal statistics, accuracy from stratified samples, sampling designs."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from geocadence.functions.special import normal_quantile


def zonal_stats(cells: DataFrame, zones: DataFrame, *, zone: str = "zone", value: str = "value", label: str = "label") -> DataFrame:
    """n, mean, std (population), min, p10, p25, median, p75, p90, max per zone and map; zones without cells are kept."""
    q = lambda p: F.percentile(value, p)
    v = F.col(value)
    got = cells.groupBy(zone, label).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), q(0.1).alias("p10"), q(0.25).alias("p25"),
        q(0.5).alias("median"), q(0.75).alias("p75"), q(0.9).alias("p90"), F.max(v).alias("max"),
    )
    labels = cells.select(label).distinct()
    return zones.select(zone).distinct().crossJoin(F.broadcast(labels)).join(got, [zone, label], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def zonal_wide(stats: DataFrame, labels: list[str], *, zone: str = "zone", label: str = "label", stat: str = "mean") -> DataFrame:
    return stats.groupBy(zone).pivot(label, labels).agg(F.first(stat))


def zonal_areas(cells: DataFrame, *, zone: str = "zone", label: str = "label", value: str = "value", cell_area: float = 100.0, years: bool = False) -> DataFrame:
    """Pixels, area and percent of zone per class: values rounded half away from zero, or floored for years."""
    c = (F.floor(value) if years else F.round(value)).cast("int")
    got = cells.where(F.col(value).isNotNull()).groupBy(zone, label, c.alias("class")).agg(F.count("*").alias("pixels"))
    share = F.col("pixels") * 100.0 / F.sum("pixels").over(W.partitionBy(zone, label))
    return got.withColumn("area_m2", F.round(F.col("pixels") * cell_area, 3)).withColumn("area_ha", F.round(F.col("pixels") * cell_area / 10000, 6)).withColumn("percent", share)


def zonal_transitions(cells: DataFrame, before: str, after: str, *, zone: str = "zone") -> DataFrame:
    return cells.groupBy(zone, F.col(before).alias("from_class"), F.col(after).alias("to_class")).agg(F.count("*").alias("pixels"))


def strata(cells: DataFrame, *, stratum: str = "stratum", cell_area: float = 1.0) -> DataFrame:
    n = cells.where(F.col(stratum).isNotNull()).groupBy(stratum).agg(F.count("*").alias("pixels"))
    return n.withColumn("area", F.col("pixels") * cell_area).withColumn("weight", F.col("pixels") / F.sum("pixels").over(W.partitionBy()))


def sampling_design(pixels: Mapping[str, int], *, expected_ua: float = 0.75, std_error: float = 0.01, n: int | None = None, alloc: str = "proportional", min_per_stratum: int = 50) -> dict[str, int]:
    """Sample sizes per stratum: n = (sum W S / se)^2, then largest remainders with a minimum per stratum."""
    names = sorted(pixels, key=str)
    total = sum(pixels.values())
    w = {k: pixels[k] / total for k in names}
    s = (expected_ua * (1 - expected_ua)) ** 0.5
    if n is None:
        n = round((sum(w[k] * s for k in names) / std_error) ** 2)
    share = {k: 1 / len(names) for k in names} if alloc == "equal" else w
    fixed: dict[str, int] = {}
    while True:
        free = [k for k in names if k not in fixed]
        left, weight = n - sum(fixed.values()), sum(share[k] for k in free)
        exact = {k: max(0, left) * share[k] / weight for k in free}
        low = [k for k in free if exact[k] < min(min_per_stratum, pixels[k])]
        if not low:
            break
        fixed |= {k: min(min_per_stratum, pixels[k]) for k in low}
        if len(fixed) == len(names):
            return fixed
    out = {k: int(exact[k]) for k in free}
    for k in sorted(free, key=lambda k: (-(exact[k] - int(exact[k])), k))[: max(0, left - sum(out.values()))]:
        out[k] += 1
    return out | fixed


def stratified_sample(cells: DataFrame, sizes: Mapping[str, int], *, stratum: str = "stratum", id_: str = "id", seed: int = 42) -> DataFrame:
    """The rows of smallest seeded hash per stratum: the same sample on every run and layout.

    A hash threshold near the wanted share cuts each stratum down before ranking, so no window sees a whole
    stratum; the threshold leaves ten standard deviations of room.
    """
    counts = {r[0]: r[1] for r in cells.groupBy(stratum).count().collect()}
    keep = [(k, int(min(1.0, (n + 10 * (n**0.5) + 10) / max(1, counts.get(k, 1))) * (2**53)), n) for k, n in sizes.items()]
    limits = F.broadcast(cells.sparkSession.createDataFrame(keep, f"_s {cells.schema[stratum].dataType.simpleString()}, _limit long, _n int"))
    h = F.shiftright(F.xxhash64(F.lit(seed), id_), 11).bitwiseAND((1 << 53) - 1)
    few = cells.withColumn("_h", h).join(limits, F.col(stratum) == F.col("_s")).where("_h <= _limit")
    return few.withColumn("_r", F.row_number().over(W.partitionBy(stratum).orderBy("_h", id_))).where("_r <= _n").drop("_h", "_r", "_n", "_s", "_limit")


def accuracy(samples: DataFrame, weights: DataFrame, *, stratum: str = "stratum", mapped: str = "map", reference: str = "ref", confidence: float = 0.95) -> DataFrame:
    """Stratified estimates of overall, user's and producer's accuracy and of areas, with standard errors.

    Means: sum W_h y_h, variance sum W_h^2 s_h^2 / n_h (0 where n_h is 1). Ratios x / y use residuals.
    Output: measure (overall, users, producers, area), class, estimate, se, ci_low, ci_high.
    """
    z = normal_quantile(0.5 + confidence / 2)
    pairs = samples.where(F.col(mapped).isNotNull() & F.col(reference).isNotNull())
    classes = F.broadcast(pairs.select(F.col(mapped).alias("class")).unionByName(pairs.select(F.col(reference).alias("class"))).distinct())
    each = pairs.crossJoin(classes)
    hit = (F.col(mapped) == F.col(reference)).cast("double")
    is_map, is_ref = (F.col(mapped) == F.col("class")).cast("double"), (F.col(reference) == F.col("class")).cast("double")
    forms = F.array(
        F.struct(F.lit("overall").alias("measure"), hit.alias("y"), F.lit(1.0).alias("x")), F.struct(F.lit("users").alias("measure"), (is_map * is_ref).alias("y"), is_map.alias("x")),
        F.struct(F.lit("producers").alias("measure"), (is_map * is_ref).alias("y"), is_ref.alias("x")), F.struct(F.lit("area").alias("measure"), is_ref.alias("y"), F.lit(1.0).alias("x")),
    )
    long = each.select(stratum, "class", F.explode(forms).alias("f")).select(stratum, "class", "f.*")
    w = F.broadcast(weights.select(stratum, "weight"))
    by = long.groupBy(stratum, "measure", "class").agg(F.count("*").alias("n"), F.avg("y").alias("my"), F.avg("x").alias("mx"), F.var_samp("y").alias("vy"), F.var_samp("x").alias("vx"), F.covar_samp("y", "x").alias("cov")).join(w, stratum)
    total = by.groupBy("measure", "class").agg(F.sum(F.col("weight") * F.col("my")).alias("ty"), F.sum(F.col("weight") * F.col("mx")).alias("tx"))
    r = F.try_divide(F.col("ty"), F.col("tx"))
    part = F.pow("weight", 2) * F.when(F.col("n") > 1, F.greatest(F.lit(0.0), F.col("vy") + r * r * F.col("vx") - 2 * r * F.col("cov"))).otherwise(0.0) / F.col("n")
    out = by.join(total, ["measure", "class"]).groupBy("measure", "class", "ty", "tx").agg(F.sum(part).alias("v"))
    out = out.withColumn("estimate", r).withColumn("se", F.try_divide(F.sqrt("v"), F.col("tx")))
    return out.select("measure", "class", "estimate", "se", (F.col("estimate") - z * F.col("se")).alias("ci_low"), (F.col("estimate") + z * F.col("se")).alias("ci_high"))


def confusion(samples: DataFrame, *, mapped: str = "map", reference: str = "ref") -> DataFrame:
    return samples.where(F.col(mapped).isNotNull() & F.col(reference).isNotNull()).groupBy(F.col(mapped).alias("map_class"), F.col(reference).alias("ref_class")).agg(F.count("*").alias("n"))


def area_shares(samples: DataFrame, weights: DataFrame, mapped: DataFrame, *, estimator: str = "difference", stratum: str = "stratum", map_class: str = "map", reference: str = "ref", confidence: float = 0.95) -> DataFrame:
    """class, mapped, estimate, se, ci_low, ci_high: shares of area with the help of the map's own shares.

    ``mapped`` is (class, share) of the whole map. "difference": the mapped share plus the weighted mean of reference
    less map; "ratio": the mapped share times the ratio of both weighted means, null for a class that no sample is
    mapped as. Variances are sums of W_h^2 s_h^2 / n_h, of the residuals y - R x for the ratio.
    """
    if estimator not in ("difference", "ratio"):
        raise ValueError(f"estimator must be 'difference' or 'ratio', not {estimator!r}")
    z = normal_quantile(0.5 + confidence / 2)
    pairs = samples.where(F.col(map_class).isNotNull() & F.col(reference).isNotNull())
    classes = F.broadcast(pairs.select(F.col(map_class).alias("class")).unionByName(pairs.select(F.col(reference).alias("class"))).distinct())
    y, x = (F.col(reference) == F.col("class")).cast("double"), (F.col(map_class) == F.col("class")).cast("double")
    each = pairs.crossJoin(classes).select(stratum, "class", y.alias("y"), x.alias("x"))
    by = each.groupBy(stratum, "class").agg(F.count("*").alias("n"), F.avg("y").alias("my"), F.avg("x").alias("mx"), F.var_samp("y").alias("vy"), F.var_samp("x").alias("vx"), F.covar_samp("y", "x").alias("cov"))
    by = by.join(F.broadcast(weights.select(stratum, "weight")), stratum)
    total = by.groupBy("class").agg(F.sum(F.col("weight") * F.col("my")).alias("ty"), F.sum(F.col("weight") * F.col("mx")).alias("tx"))
    r = F.lit(1.0) if estimator == "difference" else F.try_divide(F.col("ty"), F.col("tx"))
    part = F.pow("weight", 2) * F.when(F.col("n") > 1, F.greatest(F.lit(0.0), F.col("vy") + r * r * F.col("vx") - 2 * r * F.col("cov"))).otherwise(0.0) / F.col("n")
    out = by.join(total, "class").groupBy("class", "ty", "tx").agg(F.sum(part).alias("v"))
    out = out.join(F.broadcast(mapped.select("class", F.col("share").alias("mapped"))), "class", "left").withColumn("mapped", F.coalesce("mapped", F.lit(0.0)))
    if estimator == "difference":
        value, se = F.col("mapped") + F.col("ty") - F.col("tx"), F.sqrt("v")
    else:
        value, se = F.col("mapped") * F.try_divide(F.col("ty"), F.col("tx")), F.col("mapped") * F.try_divide(F.sqrt("v"), F.col("tx"))
    out = out.select("class", "mapped", value.alias("estimate"), se.alias("se"))
    return out.withColumn("ci_low", F.col("estimate") - z * F.col("se")).withColumn("ci_high", F.col("estimate") + z * F.col("se"))


def transition_samples(samples: DataFrame, *, map_from: str = "map_from", map_to: str = "map_to", ref_from: str = "ref_from", ref_to: str = "ref_to") -> DataFrame:
    """``samples`` with map and ref as pairs "from -> to" of classes at two dates, null where one is missing."""
    pair = lambda a, b: F.concat(F.col(a).cast("string"), F.lit(" -> "), F.col(b).cast("string"))
    return samples.withColumn("map", pair(map_from, map_to)).withColumn("ref", pair(ref_from, ref_to))
