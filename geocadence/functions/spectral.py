"""Spectral indices, tasseled cap, band-pass adjustment and unmixing as column expressions.

All are row-local and stay inside one projection. A missing band, or a division by zero, gives null.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROLES = ("blue", "green", "red", "nir", "swir1", "swir2")

# Crist (1985), Huang et al. (2002), Baig et al. (2014); blue, green, red, NIR, SWIR1, SWIR2.
TASSELED_CAP = {
    "crist1985": {
        "brightness": (0.2043, 0.4158, 0.5524, 0.5741, 0.3124, 0.2303),
        "greenness": (-0.1603, -0.2819, -0.4934, 0.7940, -0.0002, -0.1446),
        "wetness": (0.0315, 0.2021, 0.3102, 0.1594, -0.6806, -0.6109),
    },
    "huang2002": {
        "brightness": (0.3561, 0.3972, 0.3904, 0.6966, 0.2286, 0.1596),
        "greenness": (-0.3344, -0.3544, -0.4556, 0.6966, -0.0242, -0.2630),
        "wetness": (0.2626, 0.2141, 0.0926, 0.0656, -0.7629, -0.5388),
    },
    "baig2014": {
        "brightness": (0.3029, 0.2786, 0.4733, 0.5599, 0.5080, 0.1872),
        "greenness": (-0.2941, -0.2430, -0.5424, 0.7276, 0.0713, -0.1608),
        "wetness": (0.1511, 0.1973, 0.3283, 0.3407, -0.7117, -0.4559),
    },
}

# HLS v2.0 band-pass adjustment of Sentinel-2 units to OLI, and Roy et al. (2016) ETM+ to OLI
# (ordinary least squares); (slope, intercept) in reflectance.
BANDPASS = {
    "S2A": {"coastal": (0.9959, -0.0002), "blue": (0.9778, -0.0040), "green": (1.0053, -0.0009), "red": (0.9765, 0.0009), "nir": (0.9983, -0.0001), "swir1": (0.9987, -0.0011), "swir2": (1.0030, -0.0012)},
    "S2B": {"coastal": (0.9959, -0.0002), "blue": (0.9778, -0.0040), "green": (1.0075, -0.0008), "red": (0.9761, 0.0010), "nir": (0.9966, 0.0000), "swir1": (1.0000, -0.0003), "swir2": (0.9867, 0.0004)},
    "S2C": {"coastal": (1.0030, 0.0000), "blue": (0.9851, -0.0027), "green": (1.0038, -0.0009), "red": (0.9718, 0.0011), "nir": (0.9995, -0.0003), "swir1": (0.9994, -0.0007), "swir2": (0.9910, 0.0004)},
    "ETM": {"blue": (0.8474, 0.0003), "green": (0.8483, 0.0088), "red": (0.9047, 0.0061), "nir": (0.8462, 0.0412), "swir1": (0.8937, 0.0254), "swir2": (0.9071, 0.0172)},
}

# Endmembers of Souza et al. (2005) with a cloud endmember, reflectance x 10000.
ENDMEMBERS = {
    "gv": (500, 900, 400, 6100, 3000, 1000),
    "shade": (0, 0, 0, 0, 0, 0),
    "npv": (1400, 1700, 2200, 3000, 5500, 3000),
    "soil": (2000, 3000, 3400, 5800, 6000, 5800),
    "cloud": (9000, 9600, 8000, 7800, 7200, 6500),
}

CANDIDATES = {
    "blue": ("blue", "B02", "B2", "SR_B2"),
    "green": ("green", "B03", "B3", "SR_B3"),
    "red": ("red", "B04", "B4", "SR_B4"),
    "nir": ("nir", "nir08", "B08", "B8A", "B8", "SR_B5"),
    "swir1": ("swir1", "swir16", "B11", "SR_B6"),
    "swir2": ("swir2", "swir22", "B12", "SR_B7"),
}


def resolve_band(role: str, available: Sequence[str], band_map: Mapping[str, str] | None = None) -> str:
    """The column of a band role: named by ``band_map``, else the first candidate that is available."""
    if band_map and role in band_map:
        return band_map[role]
    by_lower = {a.lower(): a for a in available}
    for name in (role, *CANDIDATES.get(role, ())):
        if name.lower() in by_lower:
            return by_lower[name.lower()]
    raise KeyError(f"no band for role {role!r} among {list(available)}")


def finite(x: Column) -> Column:
    """Null for NaN and infinities."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def nd(a: Column, b: Column) -> Column:
    """(a - b) / (a + b); null when a + b is 0."""
    return F.try_divide(a - b, a + b)


def _bands(df_cols: Sequence[str], band_map: Mapping[str, str] | None) -> dict[str, Column]:
    out = {}
    for role in ROLES:
        try:
            out[role] = F.col(resolve_band(role, df_cols, band_map))
        except KeyError:
            continue
    return out


def tasseled(components: Mapping[str, Sequence[float]], bands: Mapping[str, Column]) -> dict[str, Column]:
    out = {}
    for name, weights in components.items():
        total = F.lit(0.0)
        for role, w in zip(ROLES, weights):
            total = total + F.lit(w) * bands[role]
        out[name] = total
    return out


def index_expression(name: str, bands: Mapping[str, Column]) -> Column:
    """One of the named indices on reflectance columns."""
    b = bands
    simple = {"NDVI": ("nir", "red"), "NBR": ("nir", "swir2"), "NDMI": ("nir", "swir1"), "NDWI": ("green", "nir"), "MNDWI": ("green", "swir1")}
    if name in simple:
        return nd(b[simple[name][0]], b[simple[name][1]])
    if name == "EVI":
        return F.try_divide(2.5 * (b["nir"] - b["red"]), b["nir"] + 6 * b["red"] - 7.5 * b["blue"] + 1)
    if name == "SAVI":
        return F.try_divide(1.5 * (b["nir"] - b["red"]), b["nir"] + b["red"] + 0.5)
    if name == "kNDVI":
        return F.tanh(F.pow(nd(b["nir"], b["red"]), 2))
    if name in ("TCB", "TCG", "TCW", "TCD"):
        t = tasseled(TASSELED_CAP["crist1985"], b)
        return {"TCB": t["brightness"], "TCG": t["greenness"], "TCW": t["wetness"], "TCD": t["brightness"] - t["greenness"] - t["wetness"]}[name]
    if name == "NDFI":
        return ndfi(unmix_ols(b))
    raise KeyError(name)


def compute_indices(df: DataFrame, indices: Sequence[str], band_map: Mapping[str, str] | None = None) -> DataFrame:
    bands = _bands(df.columns, band_map)
    return df.withColumns({name: finite(index_expression(name, bands)) for name in indices})


def tasseled_cap(df: DataFrame, coefficients: str = "crist1985", band_map: Mapping[str, str] | None = None) -> DataFrame:
    """Add brightness, greenness, wetness and disturbance (brightness - greenness - wetness)."""
    t = tasseled(TASSELED_CAP[coefficients], _bands(df.columns, band_map))
    return df.withColumns(t | {"disturbance": t["brightness"] - t["greenness"] - t["wetness"]})


def bandpass_adjust(df: DataFrame, sensor: str = "sensor", band: str = "band", value: str = "value") -> DataFrame:
    """Reflectance on OLI's scale; sensors and bands without a line keep their values. Broadcasts 27 constants."""
    rows = [(s, b, k, i) for s, lines in BANDPASS.items() for b, (k, i) in lines.items()]
    table = df.sparkSession.createDataFrame(rows, "_s string, _b string, _slope double, _icpt double")
    joined = df.join(F.broadcast(table), (F.col(sensor) == F.col("_s")) & (F.col(band) == F.col("_b")), "left")
    fit = F.coalesce(F.col("_slope") * F.col(value) + F.col("_icpt"), F.col(value))
    return joined.withColumn("adjusted", fit).drop("_s", "_b", "_slope", "_icpt")


def unmix_ols(bands: Mapping[str, Column], sum_to_one: bool = True, endmembers: Sequence[str] = ("gv", "shade", "npv", "soil")) -> dict[str, Column]:
    """Closed-form fractions: least squares, with the sum of fractions held at 1 by a Lagrange multiplier.

    The solution is linear in the bands, so it is a fixed matrix times the band columns.
    """
    e = np.array([ENDMEMBERS[n] for n in endmembers], float).T / 10000.0
    k = e.shape[1]
    if sum_to_one:
        left = np.block([[e.T @ e, np.ones((k, 1))], [np.ones((1, k)), np.zeros((1, 1))]])
        solve = np.linalg.solve(left, np.block([[e.T, np.zeros((k, 1))], [np.zeros((1, e.shape[0])), np.ones((1, 1))]]))[:k]
        weights, offset = solve[:, :-1], solve[:, -1]
    else:
        weights, offset = np.linalg.pinv(e), np.zeros(k)
    out = {}
    for i, name in enumerate(endmembers):
        total = F.lit(float(offset[i]))
        for role, w in zip(ROLES, weights[i]):
            total = total + F.lit(float(w)) * bands[role]
        out[name] = total
    return out


def ndfi(fractions: Mapping[str, Column]) -> Column:
    gvs = F.try_divide(fractions["gv"], 1 - fractions["shade"])
    rest = fractions["npv"] + fractions["soil"]
    return F.try_divide(gvs - rest, gvs + rest)


