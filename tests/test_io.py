"""Sources and sinks."""

import datetime

import numpy as np
import pytest

from geocadence.operators import spatial, zonal
from geocadence.sources import io


def test_maps_take_their_date_from_the_file_name(spark, tmp_path):
    import pandas as pd

    for day in ("2020-01-05", "20200206"):
        pd.DataFrame({"y": [0, 0], "x": [0, 1], "value": [1.0, 2.0]}).to_parquet(f"{tmp_path}/ndvi_{day}.parquet")
    pd.DataFrame({"y": [0], "x": [0], "value": [9.0]}).to_parquet(f"{tmp_path}/nodate.parquet")
    got = io.read_maps(spark, str(tmp_path)).collect()
    assert sorted((str(r.ts), r.x, r.value) for r in got) == [("2020-01-05", 0, 1.0), ("2020-01-05", 1, 2.0), ("2020-02-06", 0, 1.0), ("2020-02-06", 1, 2.0), ("None", 0, 9.0)]


def test_observations_read_only_their_folders(spark, tmp_path):
    day = datetime.date
    rows = [(1, day(2019, 12, 31), 1.0), (1, day(2020, 5, 1), float("nan")), (2, day(2020, 6, 1), -9999.0), (1, day(2021, 1, 1), None), (1, None, 3.0)]
    path = f"{tmp_path}/obs"
    io.write_observations(spark.createDataFrame(rows, "tile int, ts date, value double"), path, tile="tile")
    got = io.read_observations(spark, path, start="2020-01-01", end="2020-12-31", nodata=-9999.0)
    assert sorted((r.tile, r.ts, r.value) for r in got.collect()) == [(1, day(2020, 5, 1), None), (2, day(2020, 6, 1), None)]
    assert len(got.inputFiles()) == 5 and io.read_observations(spark, path).count() == 5
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan


def test_olofsson_example(spark):
    """The published error matrix of Olofsson et al. (2014): with the map's classes as strata the direct, the difference
    and the ratio estimator give one area."""
    matrix = np.array([[66, 0, 5, 4], [0, 55, 8, 12], [1, 0, 153, 11], [2, 1, 9, 313]])
    area = np.array([200000, 150000, 3200000, 6450000])
    rows = [(i, i, j) for i in range(4) for j in range(4) for _ in range(matrix[i, j])]
    samples = spark.createDataFrame(rows, "stratum int, map int, ref int")
    weights = spark.createDataFrame([(i, float(a / area.sum())) for i, a in enumerate(area)], "stratum int, weight double")
    want = np.array([235086.247086247, 129846.153846154, 3175221.44522145, 6459846.15384615])
    error = np.array([34907.2244108116, 21291.5307562577, 87924.2420532232, 92299.6391850609])
    tables = [zonal.accuracy(samples, weights).where("measure = 'area'")]
    tables += [zonal.area_shares(samples, weights, weights.selectExpr("stratum AS class", "weight AS share"), estimator=e) for e in ("difference", "ratio")]
    for t in tables[:2]:
        got = t.toPandas().set_index("class").sort_index()
        np.testing.assert_allclose(got["estimate"] * area.sum(), want, rtol=1e-9)
        np.testing.assert_allclose(got["se"] * area.sum(), error, rtol=1e-9)
    ratio = tables[2].toPandas().set_index("class").sort_index()
    np.testing.assert_allclose(ratio["estimate"] * area.sum(), want, rtol=1e-9)
    direct = zonal.accuracy(samples, weights).toPandas()
    users = direct[direct.measure == "users"].set_index("class").sort_index()["estimate"]
    producers = direct[direct.measure == "producers"].set_index("class").sort_index()["estimate"]
    np.testing.assert_allclose(users, [0.88, 0.733333333333333, 0.927272727272727, 0.963076923076923], rtol=1e-9)
    np.testing.assert_allclose(producers, [0.748661404830841, 0.847156398104265, 0.934508908579693, 0.961608992831456], rtol=1e-9)
    with pytest.raises(ValueError):
        zonal.area_shares(samples, weights, weights, estimator="other")


@pytest.mark.parametrize("hot, cold, trend, want", [
    ("000001", "000000", 0, 1), ("000011", "000000", 0, 2), ("111111", "000000", 1, 3), ("111111", "000000", 0, 4), ("111111", "000000", -1, 5),
    ("010011", "000000", 0, 6), ("010011", "100000", 0, 7), ("1111111110", "0000000000", 0, 8), ("0000", "0000", 0, 0), ("000000", "111111", -1, -3), ("000000", "100011", 0, -6),
])
def test_patterns_of_hot_spots(spark, hot, cold, trend, want):
    from pyspark.sql import functions as F

    row = ([c == "1" for c in hot], [c == "1" for c in cold], trend, trend != 0)
    df = spark.createDataFrame([row], "hot array<boolean>, cold array<boolean>, trend int, significant boolean")
    code = F.coalesce(spatial._pattern("hot", "cold", 1), -spatial._pattern("cold", "hot", -1), F.lit(0))
    assert df.select(code.alias("c")).first().c == want
