"""Queries of row-local expressions: indices, quality rules, calendars, codecs."""

from __future__ import annotations

from pyspark.sql import functions as F

from geocadence.functions import calendars, embeddings, quality, spectral
from geocadence.sources.tables import OBS_SQL, WIDE_SQL, observations, read, sql, wide

QUERIES, ORACLE_SQL = {}, {}


def _index(name: str, expression: str) -> None:
    key = f"{name.lower()}_index"
    QUERIES[key] = lambda spark, d: spectral.compute_indices(wide(spark, d), [name]).select("seq", F.round(name, 9).alias("index_value"))
    ORACLE_SQL[key] = sql(WIDE_SQL, select=f"SELECT seq, round({expression}, 9) AS index_value FROM wide")


def _nd(a: str, b: str) -> str:
    return f"({a} - {b}) / nullif({a} + {b}, 0)"


for _name, _pair in {"NDVI": ("nir", "red"), "NBR": ("nir", "swir2"), "NDMI": ("nir", "swir1"), "NDWI": ("green", "nir"), "MNDWI": ("green", "swir1")}.items():
    _index(_name, _nd(*_pair))
_index("EVI", "2.5 * (nir - red) / nullif(nir + 6 * red - 7.5 * blue + 1, 0)")
_index("SAVI", "1.5 * (nir - red) / nullif(nir + red + 0.5, 0)")
# tanh by its definition
_index("kNDVI", f"(exp(2 * pow({_nd('nir', 'red')}, 2)) - 1) / (exp(2 * pow({_nd('nir', 'red')}, 2)) + 1)")


def _linear(weights) -> str:
    return "(" + " + ".join(f"({w} * {r})" for r, w in zip(spectral.ROLES, weights)) + ")"


for _table, _rows in spectral.TASSELED_CAP.items():
    _b, _g, _w = (_linear(_rows[c]) for c in ("brightness", "greenness", "wetness"))
    QUERIES[f"tasseled_cap_{_table}"] = lambda spark, d, t=_table: spectral.tasseled_cap(wide(spark, d), t).select(
        "seq", *[F.round(c, 12).alias(c) for c in ("brightness", "greenness", "wetness", "disturbance")]
    )
    ORACLE_SQL[f"tasseled_cap_{_table}"] = sql(WIDE_SQL, select=f"SELECT seq, round({_b}, 12) AS brightness, round({_g}, 12) AS greenness, round({_w}, 12) AS wetness, round({_b} - {_g} - {_w}, 12) AS disturbance FROM wide")


def normalized_difference(spark, d):
    """Two bands of a long table, brought together by a pivot."""
    o = observations(spark, d).where("band IN ('click', 'view')")
    w = o.groupBy("pixel_id", "ts").pivot("band", ["click", "view"]).agg(F.round(F.avg("value"), 6))
    return w.select("pixel_id", "ts", F.round(spectral.nd(F.col("click"), F.col("view")), 5).alias("nd"))


QUERIES["normalized_difference"] = normalized_difference
ORACLE_SQL["normalized_difference"] = sql(OBS_SQL, select="""SELECT pixel_id, ts, round((a - b) / nullif(a + b, 0), 5) AS nd FROM (
  SELECT pixel_id, ts, round(avg(value) FILTER (band = 'click'), 6) AS a, round(avg(value) FILTER (band = 'view'), 6) AS b
  FROM obs WHERE band IN ('click', 'view') GROUP BY ALL)""")

_SENSORS = {"click": "S2A", "view": "S2B", "signup": "S2C", "purchase": "ETM", "error": "OLI"}


def bandpass_adjust(spark, d):
    o = observations(spark, d).withColumn("sensor", F.create_map(*[F.lit(x) for kv in _SENSORS.items() for x in kv])[F.col("band")])
    o = o.withColumn("role", F.element_at(F.array(*map(F.lit, spectral.ROLES)), (F.col("seq") % 6 + 1).cast("int"))).withColumn("value", F.col("value") / 1000)
    return spectral.bandpass_adjust(o, "sensor", "role").select("seq", F.round("adjusted", 9).alias("adjusted"))


QUERIES["bandpass_adjust"] = bandpass_adjust
_values = ", ".join(f"('{s}', '{b}', {k}, {i})" for s, lines in spectral.BANDPASS.items() for b, (k, i) in lines.items())
ORACLE_SQL["bandpass_adjust"] = sql(OBS_SQL, f"c(s, b, k, i) AS (VALUES {_values})", "o AS (SELECT seq, value / 1000 AS v, CASE band " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _SENSORS.items()) + " END AS s, list_extract(['" + "','".join(spectral.ROLES) + "'], CAST(seq % 6 + 1 AS INTEGER)) AS b FROM obs)",
    select="SELECT seq, round(coalesce(c.k * v + c.i, v), 9) AS adjusted FROM o LEFT JOIN c ON o.s = c.s AND o.b = c.b")


def unmix_linear(spark, d):
    f = spectral.unmix_ols({r: F.col(r) for r in spectral.ROLES})
    w = wide(spark, d).select("seq", *[c.alias(n) for n, c in f.items()])
    return w.select("seq", *[F.round(n, 6).alias(n) for n in f], F.round(spectral.ndfi({n: F.col(n) for n in f}), 4).alias("ndfi"))


def _unmix_sql() -> str:
    import numpy as np

    names = ("gv", "shade", "npv", "soil")
    e = np.array([spectral.ENDMEMBERS[n] for n in names], float).T / 10000.0
    # sum-to-one least squares by elimination of the last fraction: an independent derivation
    base, a = e[:, -1], e[:, :-1] - e[:, -1:]
    p = np.linalg.pinv(a)
    rows = np.vstack([p, -p.sum(axis=0)])
    off = np.append(-p @ base, 1 + (p @ base).sum())
    cols = [f"{n}" for n in names]
    exprs = [" + ".join([repr(float(o))] + [f"({repr(float(w))} * {r})" for r, w in zip(spectral.ROLES, row)]) for row, o in zip(rows, off)]
    inner = ", ".join(f"{x} AS {c}" for c, x in zip(cols, exprs))
    gvs = "(gv / nullif(1 - shade, 0))"
    return sql(WIDE_SQL, f"f AS (SELECT seq, {inner} FROM wide)", select="SELECT seq, " + ", ".join(f"round({c}, 6) AS {c}" for c in cols) + f", round(({gvs} - (npv + soil)) / nullif({gvs} + npv + soil, 0), 4) AS ndfi FROM f")


QUERIES["unmix_linear_ndfi"] = unmix_linear
ORACLE_SQL["unmix_linear_ndfi"] = _unmix_sql()

# ---------------------------------------------------------------- quality

_CODE_SQL = "(seq * 7919 % 1024)"


def _code():
    return F.col("seq") * 7919 % 1024


_MASKS = {
    "fmask": "c IN (0, 1)", "landsat_c2": "c & 59 = 0", "nonzero": "c <> 0", "scl": "c IN (4, 5, 6)",
    "hls_fmask": "c <> 255 AND c & 30 = 0", "force": "c & 799 = 0",
}
for _rule, _test in _MASKS.items():
    _mod = 13 if _rule in ("fmask", "scl") else 1024
    QUERIES[f"qa_{_rule}"] = lambda spark, d, r=_rule, m=_mod: observations(spark, d).select("seq", quality.qa_mask(_code() % m, r).alias("usable"))
    ORACLE_SQL[f"qa_{_rule}"] = sql(OBS_SQL, f"q AS (SELECT seq, {_CODE_SQL} % {_mod} AS c FROM obs)", select=f"SELECT seq, ({_test}) AS usable FROM q")

_FMASKS = {
    "landsat_c2": "WHEN c & 1 <> 0 THEN 255 WHEN c & 10 <> 0 THEN 4 WHEN c & 16 <> 0 THEN 2 WHEN c & 32 <> 0 THEN 3 WHEN c & 128 <> 0 THEN 1",
    "scl": "WHEN c < 2 OR c > 11 THEN 255 WHEN c IN (8, 9, 10) THEN 4 WHEN c IN (2, 3) THEN 2 WHEN c = 11 THEN 3 WHEN c = 6 THEN 1",
    "hls_fmask": "WHEN c = 255 THEN 255 WHEN c & 6 <> 0 THEN 4 WHEN c & 8 <> 0 THEN 2 WHEN c & 16 <> 0 THEN 3 WHEN c & 32 <> 0 THEN 1",
    "force": "WHEN c & 1 <> 0 THEN 255 WHEN c & 6 <> 0 THEN 4 WHEN c & 8 <> 0 THEN 2 WHEN c & 16 <> 0 THEN 3 WHEN c & 32 <> 0 THEN 1",
}
for _rule, _case in _FMASKS.items():
    _mod = 13 if _rule == "scl" else 1024
    QUERIES[f"qa_to_fmask_{_rule}"] = lambda spark, d, r=_rule, m=_mod: observations(spark, d).select("seq", quality.qa_to_fmask(_code() % m, r).alias("fmask"))
    ORACLE_SQL[f"qa_to_fmask_{_rule}"] = sql(OBS_SQL, f"q AS (SELECT seq, {_CODE_SQL} % {_mod} AS c FROM obs)", select=f"SELECT seq, CAST(CASE {_case} ELSE 0 END AS INTEGER) AS fmask FROM q")

QUERIES["modis_summary_weight"] = lambda spark, d: observations(spark, d).select("seq", quality.modis_summary_weight(F.col("qa") % 6 - 1).alias("weight"))
ORACLE_SQL["modis_summary_weight"] = sql(OBS_SQL, select="SELECT seq, CAST(CASE qa % 6 - 1 WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 WHEN 2 THEN 0.2 WHEN 3 THEN 0.2 ELSE 0 END AS DOUBLE) AS weight FROM obs")
QUERIES["modis_state_weight"] = lambda spark, d: observations(spark, d).select("seq", quality.modis_state_weight(F.col("seq") * 7919 % 70000 - 2000).alias("weight"))
ORACLE_SQL["modis_state_weight"] = sql(
    OBS_SQL, "r AS (SELECT seq, seq * 7919 % 70000 - 2000 AS raw FROM obs)", "q AS (SELECT seq, CASE WHEN raw < 0 THEN raw + 65536 ELSE raw END AS c FROM r)",
    select="""SELECT seq, CAST(CASE WHEN c >= 65535 OR c < 0 THEN 0 ELSE least(1.0,
  CASE WHEN c & 3 IN (1, 2) THEN 0.2 ELSE 1 END, CASE WHEN c & 4 <> 0 THEN 0.2 ELSE 1 END, CASE WHEN c & 1024 <> 0 THEN 0.2 ELSE 1 END,
  CASE (c >> 8) & 3 WHEN 3 THEN 0.2 WHEN 2 THEN 0.2 WHEN 1 THEN 0.5 ELSE 1 END, CASE (c >> 6) & 3 WHEN 3 THEN 0.2 WHEN 0 THEN 0.5 ELSE 1 END,
  CASE WHEN c & 8192 <> 0 THEN 0.5 ELSE 1 END, CASE WHEN c & 4096 <> 0 OR c & 32768 <> 0 THEN 0.2 ELSE 1 END, CASE WHEN c & 2048 <> 0 THEN 0.2 ELSE 1 END) END AS DOUBLE) AS weight FROM q""",
)
QUERIES["scl_weight"] = lambda spark, d: observations(spark, d).select("seq", quality.scl_weight(F.col("qa") % 14 - 1).alias("weight"))
ORACLE_SQL["scl_weight"] = sql(OBS_SQL, select="SELECT seq, CAST(CASE WHEN c IN (4, 5) THEN 1 WHEN c IN (6, 7) THEN 0.5 WHEN c IN (2, 3, 8, 9, 10, 11) THEN 0.2 ELSE 0 END AS DOUBLE) AS weight FROM (SELECT seq, qa % 14 - 1 AS c FROM obs)")
QUERIES["stac_clear"] = lambda spark, d: observations(spark, d).select("seq", quality.stac_clear(_code() % 13, "scl").alias("scl_clear"), quality.stac_clear(_code(), "qa_pixel").alias("landsat_clear"))
ORACLE_SQL["stac_clear"] = sql(OBS_SQL, f"q AS (SELECT seq, {_CODE_SQL} AS c FROM obs)", select="SELECT seq, c % 13 IN (4, 5, 6, 7, 11) AS scl_clear, (c & 31 = 0 AND c & 64 <> 0) AS landsat_clear FROM q")


def slc_off_filter(spark, d):
    o = read(spark, d, "orders").withColumn("platform", F.concat(F.lit("landsat-"), (F.col("o_orderkey") % 3 + 6).cast("string"))).withColumn("ts", F.add_months(F.to_date("o_orderdate"), 60))
    return o.where(quality.keep_platform(F.col("platform"), F.col("ts"), ["landsat-7", "landsat-8"])).select("o_orderkey", "platform")


QUERIES["slc_off_filter"] = slc_off_filter
ORACLE_SQL["slc_off_filter"] = """WITH o AS (SELECT o_orderkey, 'landsat-' || CAST(o_orderkey % 3 + 6 AS VARCHAR) AS platform, CAST(o_orderdate + INTERVAL 60 MONTH AS DATE) AS ts FROM orders)
SELECT o_orderkey, platform FROM o WHERE platform IN ('landsat-7', 'landsat-8') AND NOT (platform = 'landsat-7' AND ts > DATE '2003-05-31')"""
QUERIES["nodata_as_null"] = lambda spark, d: observations(spark, d).select("seq", quality.missing_as_null((F.col("qa") % 10).cast("double"), 0.0).alias("value"))
ORACLE_SQL["nodata_as_null"] = sql(OBS_SQL, select="SELECT seq, CAST(nullif(qa % 10, 0) AS DOUBLE) AS value FROM obs")

# ---------------------------------------------------------------- calendars and codecs

QUERIES["calendar_parts"] = lambda spark, d: wide(spark, d).select(
    "seq", calendars.doy365(F.col("ts")).alias("doy"), calendars.week52(F.col("ts")).alias("week"), F.year("ts").alias("year"),
    F.round(calendars.fractional_year(F.col("ts")), 6).alias("fractional"), calendars.ordinal_day(F.col("ts")).alias("ordinal"),
)
_DOY = "(list_extract([0, 31, 59, 90, 120, 151, 181, 212, 243, 273, 304, 334], month(ts)) + day(ts))"
ORACLE_SQL["calendar_parts"] = sql(WIDE_SQL, select=f"""SELECT seq, CAST({_DOY} AS INTEGER) AS doy, CAST(least(ceil({_DOY} / 7.0), 52) AS INTEGER) AS week, CAST(year(ts) AS INTEGER) AS year,
  round(year(ts) + (dayofyear(ts) - 1) / CAST(make_date(year(ts) + 1, 1, 1) - make_date(year(ts), 1, 1) AS DOUBLE), 6) AS fractional, CAST(ts - DATE '1970-01-01' + 719163 AS INTEGER) AS ordinal FROM wide""")


def date_from_names(spark, d):
    o = read(spark, d, "orders").withColumn("ts", F.to_date("o_orderdate"))
    name = (
        F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("LC08_"), F.date_format("ts", "yyyyMMdd"), F.lit("_red.tif")))
        .when(F.col("o_orderkey") % 4 == 1, F.concat(F.lit("scene-"), F.date_format("ts", "yyyy-MM-dd"), F.lit("_nir")))
        .when(F.col("o_orderkey") % 4 == 2, F.concat(F.lit("MOD."), F.date_format("ts", "yyyyDDD"), F.lit(".h10")))
        .otherwise(F.concat(F.lit("yr"), F.date_format("ts", "yyyy")))
    )
    return o.select("o_orderkey", calendars.find_date(name).alias("found"))


QUERIES["date_from_names"] = date_from_names
ORACLE_SQL["date_from_names"] = "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN make_date(year(o_orderdate), 1, 1) ELSE CAST(o_orderdate AS DATE) END AS found FROM orders"
QUERIES["date_from_numbers"] = lambda spark, d: read(spark, d, "orders").select("o_orderkey", calendars.from_number(calendars.fractional_year(F.to_date("o_orderdate"))).alias("back"))
ORACLE_SQL["date_from_numbers"] = "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS back FROM orders"


def embedding_codec(spark, d):
    e = read(spark, d, "embeddings").select("vec_id", embeddings.quantise_curve(F.col("embedding").cast("array<double>")).alias("q"))
    back = embeddings.dequantise_curve(F.col("q"))
    return e.select("vec_id", F.aggregate("q", F.lit(0).cast("long"), lambda a, x: a + x).alias("code_sum"), F.round(F.aggregate(back, F.lit(0.0), lambda a, x: a + x), 6).alias("value_sum"))


QUERIES["embedding_codec"] = embedding_codec
ORACLE_SQL["embedding_codec"] = """WITH u AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
q AS (SELECT vec_id, CAST(sign(v) * round(sqrt(abs(v)) * 127.5) AS INTEGER) AS c FROM u)
SELECT vec_id, CAST(sum(c) AS BIGINT) AS code_sum, round(sum(sign(c) * pow(c / 127.5, 2)), 6) AS value_sum FROM q GROUP BY vec_id"""


def embedding_scaled(spark, d):
    e = read(spark, d, "embeddings").withColumn("s", F.array_max(F.transform("embedding", lambda x: F.abs(x.cast("double")))) / 127)
    e = e.withColumn("q", F.transform("embedding", lambda x: F.round(x.cast("double") / F.col("s")).cast("int")))
    return e.select("vec_id", F.round(F.aggregate(embeddings.dequantise_scaled(F.col("q"), F.col("s")), F.lit(0.0), lambda a, x: a + x), 5).alias("value_sum"))


QUERIES["embedding_scaled_codec"] = embedding_scaled
ORACLE_SQL["embedding_scaled_codec"] = """WITH s AS (SELECT vec_id, embedding, list_max(list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE)))) / 127 AS s FROM embeddings),
u AS (SELECT vec_id, s, CAST(unnest(embedding) AS DOUBLE) AS v FROM s)
SELECT vec_id, round(sum(round(v / s) * s), 5) AS value_sum FROM u GROUP BY vec_id"""
