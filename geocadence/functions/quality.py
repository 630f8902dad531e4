"""Quality-band rules and weights as bit expressions. Null, negative and NoData codes are never usable."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WMIN, WMID, WMAX = 0.2, 0.5, 1.0


def _bits(code: Column, first: int, last: int) -> Column:
    return F.shiftright(code, first).bitwiseAND((1 << (last - first + 1)) - 1)


def qa_mask(code: Column, rule: str) -> Column:
    c = code.cast("long")
    keeps = {
        "fmask": c.isin(0, 1),
        "landsat_c2": c.bitwiseAND(0x3B) == 0,
        "nonzero": c != 0,
        "scl": c.isin(4, 5, 6),
        "hls_fmask": (c != 255) & (c.bitwiseAND(0x1E) == 0),
        "force": c.bitwiseAND(0x31F) == 0,
    }[rule]
    return F.coalesce((c >= 0) & keeps, F.lit(False))


def qa_to_fmask(code: Column, rule: str) -> Column:
    """0 clear, 1 water, 2 shadow, 3 snow, 4 cloud, 255 no data; the first that applies, in the order listed."""
    c = code.cast("long")
    bit = lambda i: c.bitwiseAND(1 << i) != 0
    none = c.isNull() | (c < 0)
    if rule == "landsat_c2":
        steps = [(none | bit(0), 255), (bit(1) | bit(3), 4), (bit(4), 2), (bit(5), 3), (bit(7), 1)]
    elif rule == "scl":
        steps = [(none | c.isin(0, 1) | (c > 11), 255), (c.isin(8, 9, 10), 4), (c.isin(2, 3), 2), (c == 11, 3), (c == 6, 1)]
    elif rule == "hls_fmask":
        steps = [(none | (c == 255), 255), (bit(1) | bit(2), 4), (bit(3), 2), (bit(4), 3), (bit(5), 1)]
    elif rule == "force":
        steps = [(none | bit(0), 255), (_bits(c, 1, 2) != 0, 4), (bit(3), 2), (bit(4), 3), (bit(5), 1)]
    else:
        raise KeyError(rule)
    out = F
    for condition, value in steps:
        out = out.when(condition, value)
    return out.otherwise(0).cast("int")


def modis_summary_weight(code: Column) -> Column:
    c = code.cast("long")
    return F.when(c == 0, WMAX).when(c == 1, WMID).when(c.isin(2, 3), WMIN).otherwise(0.0)


def modis_state_weight(code: Column) -> Column:
    """Least of the caps whose bits are set; 65535 and codes outside 16 bits weigh 0, negative int16 reads unsigned."""
    raw = code.cast("long")
    c = F.when((raw >= -32768) & (raw < 0), raw.bitwiseAND(0xFFFF)).otherwise(raw)
    cap = lambda condition, w: F.when(condition, w).otherwise(WMAX)
    weight = F.least(
        cap(_bits(c, 0, 1).isin(1, 2), WMIN), cap(_bits(c, 2, 2) == 1, WMIN), cap(_bits(c, 10, 10) == 1, WMIN),
        cap(_bits(c, 8, 9).isin(2, 3), WMIN), cap(_bits(c, 8, 9) == 1, WMID), cap(_bits(c, 6, 7) == 3, WMIN),
        cap(_bits(c, 6, 7) == 0, WMID), cap(_bits(c, 13, 13) == 1, WMID),
        cap((_bits(c, 12, 12) == 1) | (_bits(c, 15, 15) == 1), WMIN), cap(_bits(c, 11, 11) == 1, WMIN),
    )
    return F.when(c.isNull() | (c < 0) | (c >= 65535), 0.0).otherwise(weight)


def scl_weight(code: Column) -> Column:
    c = code.cast("long")
    return F.when(c.isin(4, 5), WMAX).when(c.isin(6, 7), WMID).when(c.isin(2, 3, 8, 9, 10, 11), WMIN).otherwise(0.0)


def stac_clear(code: Column, band: str) -> Column:
    """Clear by a STAC quality band: SCL classes, Landsat QA_PIXEL bits 0-4 clear and 6 set, or HLS Fmask."""
    c = code.cast("long")
    if band == "scl":
        return F.coalesce(c.isin(4, 5, 6, 7, 11), F.lit(False))
    if band == "qa_pixel":
        return F.coalesce((c.bitwiseAND(0x1F) == 0) & (c.bitwiseAND(0x40) != 0), F.lit(False))
    return qa_mask(code, "hls_fmask")


def keep_platform(platform: Column, ts: Column, platforms: list[str] | None = None, slc_off: bool = False) -> Column:
    """Allow-list of platforms; Landsat 7 scenes after its scan-line corrector failed go, unless ``slc_off``."""
    keep = F.lit(True) if platforms is None else platform.isin(platforms)
    return keep if slc_off else keep & ~((platform == "landsat-7") & (ts > F.lit("2003-05-31").cast("date")))


def missing_as_null(value: Column, nodata: float | None) -> Column:
    """NaN and the NoData value become null."""
    value = F.when(~F.isnan(value.cast("double")), value)
    return value if nodata is None else F.nullif(value, F.lit(nodata))
