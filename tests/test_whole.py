"""Queries do their whole job: every row and column counts, checked by brute force."""

import datetime

import duckdb
import numpy as np
import pandas as pd
import pytest

from geocadence.operators import multivariate, zonal
from geocadence.plans import catalog, kernels


@pytest.fixture(scope="module")
def vectors(sf_dir):
    e = pd.read_parquet(f"{sf_dir}/embeddings.parquet").sort_values("vec_id")
    return e["vec_id"].to_numpy(), np.stack(e["embedding"].to_numpy()).astype(float), e["label"].astype(str).to_numpy()


def brute_di(new, train):
    apart = np.sqrt(((train[:, None] - train[None]) ** 2).sum(axis=2))
    near = np.sqrt(((new[:, None] - train[None]) ** 2).sum(axis=2)).min(axis=1)
    return near / apart[np.triu_indices(len(train), 1)].mean()


def test_aoa_trains_on_every_even_vector(spark, sf_dir, vectors):
    ids, x, _ = vectors
    got = catalog.queries()["aoa_di"](spark, sf_dir).toPandas().sort_values("vec_id")
    assert got["vec_id"].tolist() == ids[ids % 2 == 1].tolist()
    np.testing.assert_allclose(got["di"], brute_di(x[ids % 2 == 1], x[ids % 2 == 0]), atol=2e-6)


def test_dissimilarity_of_many_blocks_copies_and_gaps(spark):
    rng = np.random.default_rng(3)
    train, new = rng.normal(size=(90, 5)), rng.normal(size=(40, 5))
    new[7] = train[11]
    frame = lambda x: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1001, [None] + [1.0] * 4)], "k long, v array<double>")
    got = multivariate.dissimilarity(frame(new), frame(train), key="k", vector="v", block=16).toPandas().sort_values("k")
    np.testing.assert_allclose(got["di"][got["k"] < 1000], brute_di(new, train), atol=1e-9)
    assert got["di"][got["k"] >= 1000].isna().tolist() == [True, True]


def test_variogram_of_the_whole_map(spark, tmp_path):
    ids = np.arange(1500)
    size = ids * 7919 % 50 + 1
    pd.DataFrame({"p_partkey": ids, "p_size": size, "p_retailprice": ids * 1.0}).to_parquet(f"{tmp_path}/part.parquet")
    at, value = np.stack([ids // 50, ids % 50], axis=1), np.sqrt(size)
    i, j = np.triu_indices(len(ids), 1)
    apart = np.sqrt(((at[i] - at[j]) ** 2).sum(axis=1))
    near = apart <= 6.5
    half = (value[i] - value[j])[near] ** 2 / 2
    want = pd.DataFrame({"bin": np.minimum(4, np.ceil(apart[near] / 1.3) - 1).astype(int), "d": apart[near], "g": half}).groupby("bin").agg(n=("d", "size"), distance=("d", "mean"), gamma=("g", "mean"))
    got = catalog.queries()["variogram_bins"](spark, str(tmp_path)).toPandas().set_index("bin").sort_index()
    assert got["n"].tolist() == want["n"].tolist()
    np.testing.assert_allclose(got[["distance", "gamma"]], want[["distance", "gamma"]], atol=1e-6)


def test_asof_matches_every_lineitem(spark, sf_dir):
    x, o = pd.read_parquet(f"{sf_dir}/lineitem.parquet"), pd.read_parquet(f"{sf_dir}/orders.parquet")
    day = lambda c: pd.to_datetime(c).to_numpy().astype("datetime64[D]").astype(int)
    first = o.assign(k=o["o_custkey"] % 50, od=day(o["o_orderdate"])).groupby(["k", "od"])["o_orderkey"].min()
    want = []
    for order, line, k, ship in zip(x["l_orderkey"], x["l_linenumber"], x["l_suppkey"] % 50, day(x["l_shipdate"])):
        near = [(abs(g), ship + g, first[k, ship + g]) for g in range(-8, 9) if (k, ship + g) in first.index]
        gap, _, value = min(near, default=(-1, 0, -1))
        want.append((order, line, k, value, gap))
    got = catalog.queries()["asof_nearest"](spark, sf_dir).toPandas()
    assert not got.duplicated(["l_orderkey", "l_linenumber", "copy"]).any()
    assert sorted(got[["l_orderkey", "l_linenumber", "k", "matched_value", "gap_days"]].fillna(-1).astype(int).itertuples(index=False, name=None)) == sorted(want)


def test_zones_hold_every_customer(spark, sf_dir):
    c = pd.read_parquet(f"{sf_dir}/customer.parquet")
    c = c[c["c_custkey"] % 11 != 0].assign(value=lambda t: np.sqrt(t["c_acctbal"].abs()))
    q = {n: catalog.queries()[n](spark, sf_dir).toPandas() for n in ("zonal_stats", "zonal_stats_wide", "zonal_areas")}
    for n, count in (("zonal_stats", "n"), ("zonal_areas", "pixels")):
        got = q[n].groupby(["zone", "label"])[count].sum()
        assert got[got > 0].to_dict() == c.groupby(["c_nationkey", "c_mktsegment"]).size().to_dict()
    wide = q["zonal_stats_wide"].set_index("zone").loc[3].dropna()
    want = c[c["c_nationkey"] == 3].groupby("c_mktsegment")["value"].mean()
    assert sorted(wide.index) == sorted(want.index)
    np.testing.assert_allclose(wide[want.index].astype(float), want, atol=1e-6)


def test_an_empty_zone_keeps_its_rows(spark):
    cells = spark.createDataFrame([(1, "a", 2.0), (1, "a", 4.0), (1, "b", None)], "zone int, label string, value double")
    stats = zonal.zonal_stats(cells, spark.createDataFrame([(1,), (2,)], "zone int"))
    assert sorted((r.zone, r.label, r.n, r.mean) for r in stats.where("label = 'a'").collect()) == [(1, "a", 2, 3.0), (2, "a", 0, None)]
    wide = {r.zone: (r.a, r.b) for r in zonal.zonal_wide(stats, ["a", "b"]).collect()}
    assert wide == {1: (3.0, None), 2: (None, None)}


def test_components_and_neurons_use_every_entry(spark, sf_dir, vectors):
    ids, x, labels = vectors
    pc = catalog.queries()["pca_embeddings"](spark, sf_dir).toPandas().set_index("vec_id").loc[ids]
    centred = x - x.mean(axis=0)
    top = np.linalg.eigh(centred.T @ centred)[1][:, ::-1][:, :3]
    np.testing.assert_allclose(np.abs(pc), np.abs(centred @ top), atol=1e-5)
    e, cols = kernels._vectors(spark, sf_dir)
    assert len(cols) == x.shape[1]
    w = multivariate.som_batch(e, cols, rounds=4)
    apart = np.sqrt(((x[:, None] - w[None]) ** 2).sum(axis=2))
    got = catalog.queries()["som_clusters"](spark, sf_dir).toPandas().set_index("vec_id").loc[ids]
    np.testing.assert_allclose(got["distance"], apart.min(axis=1), atol=1e-9)
    w = multivariate.som_batch(e, cols, rounds=3)
    neuron = ((x[:, None] - w[None]) ** 2).sum(axis=2).argmin(axis=1)
    top = pd.crosstab(neuron, labels, normalize="index").max(axis=1)
    purity = catalog.queries()["clean_samples_neurons"](spark, sf_dir).toPandas().set_index("label")["purity"]
    np.testing.assert_allclose(purity.sort_index(), top.sort_index(), atol=1e-12)


def test_every_vector_is_classified_out_of_fold(spark, sf_dir, vectors):
    ids, _, labels = vectors
    e, cols = kernels._vectors(spark, sf_dir)
    got = catalog.queries()["rf_classify"](spark, sf_dir).toPandas().set_index("vec_id")["predicted"]
    assert sorted(got.index) == ids.tolist() and set(got) <= set(labels)
    model = multivariate.train_classifier(e.where("vec_id % 2 = 1"), cols, "label")
    want = multivariate.classify(e.where("vec_id % 2 = 0"), model).select("vec_id", "predicted").toPandas().set_index("vec_id")["predicted"]
    assert model.stages[2].getNumTrees == 100 and got[want.index].tolist() == want.tolist()


def medoids(spark, folder, rows):
    """The query and its SQL on (supplier, order, ship date, quantity, price)."""
    frame = pd.DataFrame(rows, columns=["l_suppkey", "l_orderkey", "l_shipdate", "l_quantity", "l_extendedprice"])
    frame = frame.assign(l_linenumber=1, l_shipdate=pd.to_datetime(frame["l_shipdate"]).astype("datetime64[us]"), l_discount=0.0, l_tax=0.0)
    frame.to_parquet(f"{folder}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{folder}/lineitem.parquet'")
    got = catalog.queries()["composite_medoid"](spark, str(folder)).select("pixel_id", "step", "seq", "ts").collect()
    return sorted(map(tuple, got)), sorted(con.execute(f"SELECT pixel_id, step, seq, ts FROM ({catalog.oracle_sql()['composite_medoid']})").fetchall())


def test_medoid_rounds_halves_as_its_sql(spark, tmp_path):
    # both of each pair are equally far from their median; the distance ends in a half at the tenth digit
    rows = [
        (1, 21, "2001-05-12", 2.0, 89165.25), (1, 10, "2001-05-15", 49.0, 5755.25), (2, 67, "1995-03-29", 8.0, 63349.26), (2, 78, "1995-03-22", 18.0, 40759.26),
        (3, 78, "1995-12-04", 50.0, 67776.37), (3, 23, "1995-12-06", 20.0, 4226.37), (4, 27, "1997-08-15", 36.0, 1677.0), (4, 13, "1997-08-12", 18.0, 100167.0),
        (5, 12, "1995-03-02", 49.0, 5951.59), (5, 65, "1995-02-21", 12.0, 45361.59),
    ]
    got, want = medoids(spark, tmp_path, rows)
    assert len(want) == 5 and got == want


def test_medoid_of_observations_that_lack_bands(spark, tmp_path):
    rows = [
        # the third one's price moves the median from the first to the second
        (1, 1, "1995-01-03", 10.0, 10000.0), (1, 2, "1995-01-04", 10.0, 50000.0), (1, 3, "1995-01-02", None, 90000.0),
        (2, 4, "1995-01-05", None, 100.0), (2, 5, "1995-01-04", 1.0, None), (3, 6, "1995-01-05", 1.0, 100.0), (3, 7, "1995-01-02", 1.0, None),
    ]
    got, want = medoids(spark, tmp_path, rows)
    day = lambda d: datetime.date(1995, 1, d)
    assert got == want == [(1, 0, 21, day(4)), (2, 0, 51, day(4)), (3, 0, 61, day(5))]
