"""Queries of the per-series kernels and the global multivariate operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from geocadence.functions.spectral import ENDMEMBERS, ROLES
from geocadence.operators import kernels as k
from geocadence.operators import multivariate as mv
from geocadence.plans.series import _daily
from geocadence.sources.tables import WIDE_SQL, annual, grid, monthly, observations, read, sql, wide

QUERIES, ORACLE_SQL = {}, {}


def _monthly_days(spark, d):
    return monthly(spark, d).withColumn("ts", F.col("month"))


def _q(name, source, kernel, schema, **options):
    QUERIES[name] = lambda spark, d: k.series_apply(source(spark, d), kernel, schema, **options)


_q("whittaker", _daily, lambda t, y: {"smoothed": k.whittaker(t, y, 10.0)}, "smoothed array<double>")
_q("savgol", _daily, lambda t, y: {"smoothed": k.savgol(y)}, "smoothed array<double>")
_q("desawtooth", annual, lambda t, y: {"smoothed": k.desawtooth(y[np.isfinite(y)])}, "smoothed array<double>", ts="year")
_q("mk_hamed_rao", annual, lambda t, y: k.mann_kendall(t, y, "hamed_rao"), k.MK_SCHEMA, ts="year")
_q("mk_yue_wang", annual, lambda t, y: k.mann_kendall(t, y, "yue_wang"), k.MK_SCHEMA, ts="year")
_q("ar_trend", annual, k.ar_trend, k.AR_SCHEMA, ts="year")
_q("landtrendr", annual, k.landtrendr, k.LANDTRENDR_SCHEMA, ts="year")
_q("bfast_monitor", _monthly_days, lambda t, y: k.bfast_monitor(t, y, 10957.0, frequency=365.25), k.BFAST_MONITOR_SCHEMA)
_q("bfast_lite", _monthly_days, lambda t, y: k.bfast_lite(t, y, frequency=365.25), k.BFAST_LITE_SCHEMA)
_q("ewmacd", _monthly_days, lambda t, y: k.ewmacd(t, y, 10591.0), k.EWMACD_SCHEMA)
_q("coded", _monthly_days, k.coded, k.CODED_SCHEMA)
_q("polar_metrics", _monthly_days, k.polar_metrics, k.POLAR_SCHEMA)
_q("phenology", _daily, k.phenology, k.PHENOLOGY_SCHEMA)


def _two_bands(spark, d):
    o = observations(spark, d).where("value IS NOT NULL")
    return o.groupBy("pixel_id", "ts").agg((F.avg("value") * 50).alias("green"), (F.max("value") * 60).alias("swir"))


_q("tmask", _two_bands, k.tmask, "clear array<boolean>, n_clear int", values=("green", "swir"))
_q("omnibus", _two_bands, k.omnibus, k.OMNIBUS_SCHEMA, values=("green", "swir"))
_q("ccdc", lambda s, d: _two_bands(s, d), lambda t, *b: k.ccdc(t, *b, min_days=10), k.CCDC_SCHEMA, values=("green", "swir"))


def twdtw(spark, d):
    day = np.arange(0, 30, 3.0)
    patterns = {"rising": (19723 + day, 20 + day), "falling": (19723 + day, 50 - day), "flat": (19723 + day, np.full(len(day), 35.0))}
    return k.series_apply(_daily(spark, d), k.twdtw_classify(patterns, midpoint=10.0), "label int, distance double, distances array<double>")


QUERIES["twdtw"] = twdtw


def unmix_fcls(spark, d):
    """Fully constrained fractions of each observation, a batch of pixels at a time."""
    import pyarrow as pa

    names = ("gv", "shade", "npv", "soil")
    a = np.array([ENDMEMBERS[n] for n in names], float).T / 10000

    def run(batches):
        for b in batches:
            x = np.stack([b.column(r).to_numpy(zero_copy_only=False) for r in ROLES], axis=1)
            f, e = k.unmix(a, x)
            yield pa.record_batch({"seq": b.column("seq"), **{n: pa.array(f[:, i]) for i, n in enumerate(names)}, "rmse": pa.array(e)})

    return wide(spark, d).select("seq", *ROLES).mapInArrow(run, "seq long, gv double, shade double, npv double, soil double, rmse double")


QUERIES["unmix_fcls"] = unmix_fcls

# ---------------------------------------------------------------- global operators


def _vectors(spark, d):
    """The embeddings with a column for each entry, and those columns' names; entries that a shorter vector lacks are null."""
    e = read(spark, d, "embeddings")
    cols = [f"e{i}" for i in range(e.agg(F.max(F.size("embedding"))).first()[0] or 0)]
    return e.select("vec_id", F.col("label").cast("string").alias("label"), *[F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate(cols)]), cols


def pca(spark, d):
    e, cols = _vectors(spark, d)
    return mv.pca_fit(e, cols, 3).apply(e).select("vec_id", *[F.round(c, 6).alias(c) for c in ("pc1", "pc2", "pc3")])


QUERIES["pca_embeddings"] = pca


def band_moments(spark, d):
    n, mean, cov = mv.moments(wide(spark, d), ["nir", "red"])
    return spark.createDataFrame([(int(n), round(float(mean[0]), 8), round(float(mean[1]), 8), round(float(cov[0, 0]), 8), round(float(cov[0, 1]), 8), round(float(cov[1, 1]), 8))], "n long, mean_nir double, mean_red double, var_nir double, cov_nir_red double, var_red double")


QUERIES["band_moments"] = band_moments
ORACLE_SQL["band_moments"] = sql(WIDE_SQL, select="SELECT count(*) AS n, round(avg(nir), 8) AS mean_nir, round(avg(red), 8) AS mean_red, round(var_pop(nir), 8) AS var_nir, round(covar_pop(nir, red), 8) AS cov_nir_red, round(var_pop(red), 8) AS var_red FROM wide")


def estimate_enl(spark, d):
    return wide(spark, d).groupBy("pixel_id").agg(F.round(F.pow(F.avg("nir"), 2) / F.var_samp("nir"), 6).alias("enl"))


QUERIES["estimate_enl"] = estimate_enl
ORACLE_SQL["estimate_enl"] = sql(WIDE_SQL, select="SELECT pixel_id, round(pow(avg(nir), 2) / var_samp(nir), 6) AS enl FROM wide GROUP BY 1")


def _map_bands(spark, d):
    return grid(spark, d).select("y", "x", F.col("size").cast("double").alias("a"), (F.col("size") * 0.5 + F.col("class")).alias("b"), F.sqrt("value").alias("c"))


def mnf(spark, d):
    t = mv.mnf_fit(_map_bands(spark, d), ["a", "b", "c"])
    return t.apply(_map_bands(spark, d), 2, "mnf").select("y", "x", "mnf1", "mnf2")


QUERIES["mnf"] = mnf
QUERIES["mnf_denoise"] = lambda spark, d: mv.mnf_denoise(_map_bands(spark, d), ["a", "b", "c"], 2).select("y", "x", "a", "b", "c")
QUERIES["eof_maps"] = lambda spark, d: mv.eof(monthly(spark, d), 3)[2]


def imad(spark, d):
    w = wide(spark, d).select("seq", "red", "nir", (F.col("red") * 0.9 + F.col("blue") * 0.1).alias("red2"), (F.col("nir") * 1.1 - F.col("green") * 0.2).alias("nir2"))
    return mv.imad(w, ["red", "nir"], ["red2", "nir2"], rounds=5)[0].select("seq", "mad1", "mad2", "chi2", "p_nochange")


QUERIES["imad"] = imad


def radcal(spark, d):
    w = wide(spark, d).select("seq", "red", "nir", (F.col("red") * 0.9 + F.col("blue") * 0.1).alias("red2"), (F.col("nir") * 1.1 - F.col("green") * 0.2).alias("nir2"))
    fits = mv.radcal(mv.imad(w, ["red", "nir"], ["red2", "nir2"], rounds=3)[0], "nir", "nir2", threshold=0.5)
    return spark.createDataFrame([("nir", *[float(fits[c]) for c in ("slope", "intercept", "r", "n")])], "band string, slope double, intercept double, r double, n double")


QUERIES["radcal"] = radcal


def som(spark, d):
    e, cols = _vectors(spark, d)
    return mv.som_assign(e, cols, mv.som_batch(e, cols, rounds=4)).select("vec_id", "label", "distance")


QUERIES["som_clusters"] = som


def som_purity(spark, d):
    e, cols = _vectors(spark, d)
    got = mv.som_assign(e.withColumnRenamed("label", "class"), cols, mv.som_batch(e, cols, rounds=3))
    return mv.majority_per_neuron(got, "class")


QUERIES["clean_samples_neurons"] = som_purity


def rf(spark, d):
    """Class of every vector by the forest that learned on the vectors of the other parity."""
    e, cols = _vectors(spark, d)
    e = e.withColumn("fold", F.coalesce(F.pmod("vec_id", F.lit(2)), F.lit(0)).cast("int"))
    return mv.cross_validate(e, cols, "label", "fold", (0, 1)).select("vec_id", "predicted")


QUERIES["rf_classify"] = rf
