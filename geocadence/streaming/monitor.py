"""Streaming forms: tumbling composites with a watermark, and an EWMA chart that keeps its state per series."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream_composite(df: DataFrame, days: int = 16, lateness: str = "32 days", *, key: str = "pixel_id", at: str = "at", value: str = "value") -> DataFrame:
    """Mean, extremes and count of valid values per series and tumbling window; later data than the watermark drops."""
    w = df.withWatermark(at, lateness).groupBy(key, F.window(at, f"{days} days").alias("w"))
    out = w.agg(F.count(value).alias("count"), F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"))
    return out.select(key, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "count", "mean", "min", "max")


def stream_ewma(df: DataFrame, centre: float, sigma: float, *, lam: float = 0.3, sigmas: float = 3.0, persistence: int = 3, key: str = "pixel_id", at: str = "at", value: str = "value") -> DataFrame:
    """EWMA chart of (value - centre): one row per observation with z, the flag in control limits, and whether the
    last ``persistence`` flags share a sign. State is four numbers per series; rows older than the last are skipped."""
    schema = f"{key} long, at timestamp, z double, flag int, alarm boolean"

    def step(k, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        z, n, run, last = state.get if state.exists else (0.0, 0, 0, 0)
        rows = pd.concat(list(frames)).dropna(subset=[value]).sort_values(at)
        out = []
        for t, v in zip(rows[at], rows[value]):
            if t.value <= last:
                continue
            n += 1
            z = (v - centre) if n == 1 else (1 - lam) * z + lam * (v - centre)
            limit = sigmas * sigma * (lam / (2 - lam) * (1 - (1 - lam) ** (2 * n))) ** 0.5
            flag = int(z / limit) if limit > 0 else 0
            sign = (flag > 0) - (flag < 0)
            run = (run + sign if run * sign > 0 else sign) if sign else 0
            last = t.value
            out.append((k[0], t, z, flag, abs(run) >= persistence))
        state.update((z, n, run, last))
        yield pd.DataFrame(out, columns=[key, "at", "z", "flag", "alarm"])

    return df.select(key, at, value).groupBy(key).applyInPandasWithState(step, schema, "z double, n long, run int, last long", "append", GroupStateTimeout.NoTimeout)
