"""Global multivariate operators: one small statistic is aggregated on the executors, solved on the driver,
and applied as a projection or by broadcast. What travels is quadratic in the bands, never in the rows.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geocadence.functions import special


def moments(df: DataFrame, cols: Sequence[str], weight: str | None = None) -> tuple[float, np.ndarray, np.ndarray]:
    """Weight total, mean and covariance (divided by the weight total) of complete rows, in one pass.

    Each task sends one partial Gram matrix; they are added up on the driver.
    """
    k = len(cols)
    picked = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)], (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("w"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, shift = np.zeros((k + 1, k + 1)), None
        for b in batches:
            x = np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(k + 1)], axis=1).astype(float)
            x = x[np.isfinite(x).all(axis=1)]
            if not len(x):
                continue
            design = np.column_stack([np.ones(len(x)), x[:, :k]])
            total += design.T @ (design * x[:, k:])
        yield pa.record_batch({"g": pa.array([total.reshape(-1).tolist()], pa.list_(pa.float64()))})

    parts = picked.mapInArrow(run, "g array<double>")
    sums = parts.select(F.posexplode("g").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()
    g = np.array([r["v"] for r in sums]).reshape(k + 1, k + 1) if sums else np.zeros((k + 1, k + 1))
    n = g[0, 0]
    mean = g[0, 1:] / n if n else np.zeros(k)
    return float(n), mean, (g[1:, 1:] / n - np.outer(mean, mean) if n else np.zeros((k, k)))


def _fixed(vectors: np.ndarray) -> np.ndarray:
    """Eigenvectors (columns) with their largest component positive."""
    return vectors * np.sign(vectors[np.argmax(np.abs(vectors), axis=0), np.arange(vectors.shape[1])])


def project(cols: Sequence[str], mean: np.ndarray, matrix: np.ndarray, names: Sequence[str]) -> list[Column]:
    """(x - mean) @ matrix as plain column expressions."""
    out = []
    for j, name in enumerate(names):
        total = F.lit(0.0)
        for i, c in enumerate(cols):
            total = total + (F.col(c) - float(mean[i])) * float(matrix[i, j])
        out.append(total.alias(name))
    return out


@dataclass
class Transform:
    """A fitted linear transform: components = (x - mean) @ forward, x = mean + components @ inverse."""

    bands: list[str]
    mean: np.ndarray
    forward: np.ndarray
    inverse: np.ndarray
    values: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def to_json(self) -> str:
        return json.dumps({"bands": self.bands} | {k: getattr(self, k).tolist() for k in ("mean", "forward", "inverse", "values")})

    @classmethod
    def from_json(cls, text: str) -> Transform:
        d = json.loads(text)
        return cls(d["bands"], *[np.array(d[k]) for k in ("mean", "forward", "inverse", "values")])

    def apply(self, df: DataFrame, k: int | None = None, prefix: str = "pc") -> DataFrame:
        k = k or self.forward.shape[1]
        return df.select("*", *project(self.bands, self.mean, self.forward[:, :k], [f"{prefix}{i + 1}" for i in range(k)]))

    def invert(self, df: DataFrame, k: int, prefix: str = "pc") -> DataFrame:
        out = []
        for j, b in enumerate(self.bands):
            total = F.lit(float(self.mean[j]))
            for i in range(k):
                total = total + F.col(f"{prefix}{i + 1}") * float(self.inverse[i, j])
            out.append(total.alias(b))
        return df.select(*[c for c in df.columns if c not in self.bands], *out)


def pca_fit(df: DataFrame, cols: Sequence[str], k: int | None = None) -> Transform:
    _, mean, cov = moments(df, cols)
    values, vectors = np.linalg.eigh(cov)
    vectors, values = _fixed(vectors[:, ::-1]), values[::-1]
    k = k or len(cols)
    return Transform(list(cols), mean, vectors[:, :k], vectors[:, :k].T, values)


def noise_covariance(df: DataFrame, cols: Sequence[str]) -> np.ndarray:
    """Half the covariance of differences between horizontal and vertical neighbours on a map (y, x)."""
    right = df.select(F.col("y"), (F.col("x") - 1).alias("x"), *[F.col(c).alias(f"n_{c}") for c in cols])
    below = df.select((F.col("y") - 1).alias("y"), F.col("x"), *[F.col(c).alias(f"n_{c}") for c in cols])
    both = df.join(right.unionByName(below), ["y", "x"]).select(*[(F.col(c) - F.col(f"n_{c}")).alias(c) for c in cols])
    n, mean, cov = moments(both, cols)
    return (cov + np.outer(mean, mean)) / 2


def mnf_fit(df: DataFrame, cols: Sequence[str], noise: np.ndarray | None = None) -> Transform:
    """Minimum noise fraction: components by decreasing ratio of total to noise variance."""
    _, mean, cov = moments(df, cols)
    noise = noise_covariance(df, cols) if noise is None else noise
    v, u = np.linalg.eigh(noise)
    white = u / np.sqrt(np.maximum(v, 1e-12))
    values, vectors = np.linalg.eigh(white.T @ cov @ white)
    forward = _fixed(white @ vectors[:, ::-1])
    return Transform(list(cols), mean, forward, np.linalg.inv(forward), values[::-1])


def mnf_denoise(df: DataFrame, cols: Sequence[str], k: int) -> DataFrame:
    t = mnf_fit(df, cols)
    return t.invert(t.apply(df, k, "mnf"), k, "mnf")


def eof(df: DataFrame, modes: int = 3, *, key: str = "pixel_id", step: str = "month", value: str = "value", min_valid: float = 0.8) -> tuple[np.ndarray, np.ndarray, DataFrame]:
    """Empirical orthogonal functions: eigenvalues, principal components (time x mode) and maps (key, eof1..).

    The time x time Gram matrix is summed over series on the executors; series with too few dates are left
    out and remaining gaps count as the mean (0).
    """
    steps = [r[0] for r in df.select(step).distinct().orderBy(step).collect()]
    numbers = df.sparkSession.createDataFrame([(s, i) for i, s in enumerate(steps)], df.select(step, F.lit(0).alias("_i")).schema)
    valid = df.where(F.col(value).isNotNull()).join(F.broadcast(numbers), step)
    series = valid.groupBy(key).agg(F.collect_list("_i").alias("i"), F.collect_list(F.col(value).cast("double")).alias("v")).where(F.size("i") >= min_valid * len(steps))

    def dense(batch: pa.RecordBatch) -> np.ndarray:
        """Series x time anomalies; gaps are 0."""
        at, v = batch.column("i"), batch.column("v")
        size = np.diff(at.offsets.to_numpy())
        row = np.repeat(np.arange(len(size)), size)
        x = np.zeros((len(size), len(steps)))
        flat = v.flatten().to_numpy()
        mean = np.bincount(row, flat, len(size)) / np.maximum(size, 1)
        x[row, at.flatten().to_numpy()] = flat - mean[row]
        return x

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(steps), len(steps)))
        for b in batches:
            x = dense(b)
            total += x.T @ x
        yield pa.record_batch({"i": pa.array(range(total.size), pa.int64()), "v": pa.array(total.reshape(-1))})

    sums = series.mapInArrow(gram, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    flat = np.zeros(len(steps) ** 2)
    for r in sums:
        flat[r["i"]] = r["v"]
    values, vectors = np.linalg.eigh(flat.reshape(len(steps), len(steps)))
    vectors, values = _fixed(vectors[:, ::-1]), np.maximum(values[::-1], 0)
    lead = vectors[:, :modes]

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = dense(b) @ lead
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(y[:, j]) for j in range(modes)]], names=[key, *[f"eof{j + 1}" for j in range(modes)]])

    kind = series.schema[key].dataType.simpleString()
    return values, lead, series.mapInArrow(maps, f"{key} {kind}, " + ", ".join(f"eof{j + 1} double" for j in range(modes)))


# ---------------------------------------------------------------- iteratively re-weighted change detection


def imad(df: DataFrame, before: Sequence[str], after: Sequence[str], *, rounds: int = 30, tol: float = 1e-3) -> tuple[DataFrame, dict]:
    """Multivariate alteration detection by re-weighted canonical correlation: one aggregation per round.

    Returns ``df`` with mad1.., chi2 and p_nochange, and the fit record.
    """
    p = len(before)
    cols = [*before, *after]
    weighted, rho_old, record = df.withColumn("_w", F.lit(1.0)), np.zeros(p), []
    for _ in range(rounds):
        n, mean, cov = moments(weighted, cols, "_w")
        cov = cov * n / max(n - 1, 1)
        sxx, syy, sxy = cov[:p, :p], cov[p:, p:], cov[:p, p:]
        lx = np.linalg.cholesky(sxx + 1e-9 * np.trace(sxx) / p * np.eye(p))
        ly = np.linalg.cholesky(syy + 1e-9 * np.trace(syy) / p * np.eye(p))
        u, s, vt = np.linalg.svd(np.linalg.solve(lx, sxy) @ np.linalg.inv(ly).T)
        a, b = np.linalg.solve(lx.T, u)[:, ::-1], np.linalg.solve(ly.T, vt.T)[:, ::-1]
        rho = np.clip(s[::-1], 0, 1 - 1e-9)
        sign = np.sign((np.diag(1 / np.sqrt(np.diag(sxx))) @ sxx @ a).sum(axis=0))
        a, b = a * sign, b * sign
        b = b * np.sign(np.einsum("ij,ik,kj->j", a, sxy, b))
        var = 2 * (1 - rho)
        matrix = np.vstack([a, -b])
        mads = project(cols, mean, matrix, [f"mad{i + 1}" for i in range(p)])
        out = df.select("*", *mads)
        chi2 = sum((F.pow(F.col(f"mad{i + 1}"), 2) / float(var[i]) for i in range(p)), F.lit(0.0))
        out = out.withColumn("chi2", chi2).withColumn("p_nochange", 1 - chi2_cdf(F.col("chi2"), p))
        record.append(rho.tolist())
        if np.abs(rho - rho_old).max() < tol:
            break
        rho_old, weighted = rho, out.withColumn("_w", F.col("p_nochange"))
    return out, {"rho": record, "iterations": len(record)}


def chi2_cdf(x: Column, df: int) -> Column:
    """Chi-square distribution for whole degrees of freedom: finite sums of elementary functions."""
    half = x / 2
    if df % 2 == 0:
        term, total = F.lit(1.0), F.lit(1.0)
        for k in range(1, df // 2):
            term = term * half / k
            total = total + term
        return 1 - F.exp(-half) * total
    tail = special.normal_two_sided(F.sqrt(x))
    term, total = F.sqrt(x), F.lit(0.0)
    for k in range((df - 1) // 2):
        total = total + term
        term = term * x / (2 * k + 3)
    return 1 - tail - math.sqrt(2 / math.pi) * F.exp(-half) * total


def radcal(df: DataFrame, before: str, after: str, weight: str = "p_nochange", threshold: float = 0.95) -> dict:
    """Orthogonal regression of ``before`` on ``after`` over invariant rows: slope, intercept, r, n."""
    n, mean, cov = moments(df.where(F.col(weight) >= threshold), [after, before])
    sxx, syy, sxy = cov[0, 0], cov[1, 1], cov[0, 1]
    slope = (syy - sxx + math.sqrt((syy - sxx) ** 2 + 4 * sxy**2)) / (2 * sxy) if sxy else float("nan")
    return {"slope": slope, "intercept": mean[1] - slope * mean[0], "r": sxy / math.sqrt(sxx * syy) if sxx * syy > 0 else float("nan"), "n": n}


# ---------------------------------------------------------------- self-organising map


def som_batch(df: DataFrame, cols: Sequence[str], *, rows: int = 3, columns: int = 3, rounds: int = 10, sigma: float = 1.0, seed: int = 42) -> np.ndarray:
    """Batch Kohonen map: per round one aggregation of sums and counts by best neuron, then a neighbourhood product."""
    k = rows * columns
    n, mean, cov = moments(df, cols)
    rng = np.random.default_rng(seed)
    w = mean + rng.normal(size=(k, len(cols))) * np.sqrt(np.maximum(np.diag(cov), 1e-12))
    grid = np.array([(i, j) for i in range(rows) for j in range(columns)], float)
    apart = ((grid[:, None] - grid[None]) ** 2).sum(axis=2)
    for r in range(rounds):
        s = max(0.3, sigma * (1 - r / rounds))
        h = np.exp(-apart / (2 * s * s))
        got = som_assign(df, cols, w).groupBy("label").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in cols]).collect()
        sums, counts = np.zeros_like(w), np.zeros(k)
        for g in got:
            sums[g["label"]], counts[g["label"]] = [g[c] for c in cols], g["n"]
        den = h @ counts
        w = np.where(den[:, None] > 1e-12, (h @ sums) / np.maximum(den[:, None], 1e-12), w)
    return w


def som_assign(df: DataFrame, cols: Sequence[str], w: np.ndarray) -> DataFrame:
    """label and distance of the best neuron, the first on ties; rows with a missing column are left out."""
    complete = df.where(" AND ".join(f"{c} IS NOT NULL" for c in cols)).drop("label", "distance")
    names = complete.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.stack([b.column(names.index(c)).to_numpy(zero_copy_only=False) for c in cols], axis=1).astype(float)
            d = np.stack([((x - n) ** 2).sum(axis=1) for n in w], axis=1)
            best = np.argmin(d, axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(best.astype(np.int32)), pa.array(np.sqrt(d[np.arange(len(d)), best]))], names=[*names, "label", "distance"])

    return complete.mapInArrow(run, T.StructType([*complete.schema.fields, T.StructField("label", T.IntegerType()), T.StructField("distance", T.DoubleType())]))


def majority_per_neuron(assigned: DataFrame, label: str, neuron: str = "label") -> DataFrame:
    """Majority class of each neuron, its purity; ties to the smaller class."""
    n = assigned.groupBy(neuron, label).agg(F.count("*").alias("n"))
    top = n.groupBy(neuron).agg(F.max(F.struct("n", label)).alias("m"), F.sum("n").alias("total"))
    return top.select(neuron, F.col(f"m.{label}").alias("majority"), (F.col("m.n") / F.col("total")).alias("purity"))


# ---------------------------------------------------------------- dissimilarity


def _packed(df: DataFrame, key: str, vector: str, blocks: int, names: Sequence[str]) -> DataFrame:
    """Rows (block, keys, values of all vectors in a row) of complete vectors, dealt into blocks by their key.

    Two blocks go to a partition, as a product of tables has as many tasks as pairs of partitions.
    """
    whole = df.where(F.col(vector).isNotNull() & F.forall(vector, lambda v: v.isNotNull()))
    block = F.pmod(F.xxhash64(key), F.lit(blocks))
    got = whole.groupBy(block.alias(names[0])).agg(F.collect_list(F.struct(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v"))).alias("_p"))
    return got.select(names[0], F.transform("_p", lambda s: s["k"]).alias(names[1]), F.flatten(F.transform("_p", lambda s: s["v"])).alias(names[2])).coalesce(-(-blocks // 2))


def _block(batch: pa.RecordBatch, i: int, keys: str, values: str) -> tuple[np.ndarray, np.ndarray]:
    k = batch.column(keys)[i].values.to_numpy(zero_copy_only=False)
    return k, batch.column(values)[i].values.to_numpy(zero_copy_only=False).reshape(len(k), -1)


def _square_distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None] - 2 * (x @ y.T), 0)


def dissimilarity(new: DataFrame, train: DataFrame, *, key: str, vector: str, block: int = 1024) -> DataFrame:
    """di of each new vector: distance to the nearest training vector over the mean distance of training pairs.

    Both tables are dealt into blocks of about ``block`` vectors, and blocks meet blocks: a pair of blocks is one
    matrix product, so nothing is broadcast and no pair of vectors is a row. Keys are whole numbers, vectors of
    one width; vectors that are null or have a null entry do not train and get a null di.
    """
    n_new, n_train = new.count(), train.count()
    parts = lambda n: max(1, -(-n // block))
    a = _packed(train, key, vector, parts(n_train), ("ba", "ka", "va"))
    b = _packed(train, key, vector, parts(n_train), ("bb", "kb", "vb"))

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, count = [], []
            for i in range(batch.num_rows):
                (ka, x), (kb, y) = _block(batch, i, "ka", "va"), _block(batch, i, "kb", "vb")
                pair = ka[:, None] < kb[None] if batch.column("ba")[i] == batch.column("bb")[i] else np.ones((len(ka), len(kb)), bool)
                total.append(float(np.sqrt(_square_distances(x, y))[pair].sum()))
                count.append(int(pair.sum()))
            yield pa.record_batch({"total": pa.array(total, pa.float64()), "pairs": pa.array(count, pa.int64())})

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                (ka, x), (kb, y) = _block(batch, i, "ka", "va"), _block(batch, i, "kb", "vb")
                best = y[np.argmin(_square_distances(x, y), axis=1)]
                # the product loses digits of small distances; that of the nearest is taken again from the differences
                yield pa.record_batch({"_key": pa.array(ka, pa.int64()), "_d": pa.array(np.sqrt(((x - best) ** 2).sum(axis=1)))})

    mean = a.join(b, F.col("ba") <= F.col("bb")).mapInArrow(spans, "total double, pairs long").agg(F.try_divide(F.sum("total"), F.sum("pairs")).alias("_mean"))
    met = _packed(new, key, vector, parts(n_new), ("ba", "ka", "va")).crossJoin(b)
    near = met.mapInArrow(nearest, "_key long, _d double").groupBy("_key").agg(F.min("_d").alias("_d"))
    out = new.select(key).distinct().join(near, F.col(key) == F.col("_key"), "left").crossJoin(F.broadcast(mean))
    return out.select(key, F.try_divide(F.col("_d"), F.col("_mean")).alias("di"))


# ---------------------------------------------------------------- classification


def train_classifier(df: DataFrame, cols: Sequence[str], label: str, *, trees: int = 100, seed: int = 42):
    """Random forest on the sample table."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import StringIndexer, VectorAssembler

    indexer = StringIndexer(inputCol=label, outputCol="_label", stringOrderType="alphabetAsc")
    forest = RandomForestClassifier(featuresCol="_features", labelCol="_label", numTrees=trees, maxDepth=8, seed=seed)
    return Pipeline(stages=[indexer, VectorAssembler(inputCols=list(cols), outputCol="_features", handleInvalid="skip"), forest]).fit(df)


def classify(df: DataFrame, model, probability: bool = False) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    names = model.stages[0].labels
    out = model.stages[2].transform(model.stages[1].transform(df))
    out = out.withColumn("predicted", F.element_at(F.array(*map(F.lit, names)), F.col("prediction").cast("int") + 1))
    drop = ["_features", "rawPrediction", "prediction"]
    return out.withColumn("probability", vector_to_array("probability")).drop(*drop) if probability else out.drop(*drop, "probability")


def cross_validate(df: DataFrame, cols: Sequence[str], label: str, fold: str, folds: Sequence[int], **options) -> DataFrame:
    """Out-of-fold predictions: one model per fold, trained on the other folds."""
    out = None
    for k in folds:
        got = classify(df.where(F.col(fold) == k), train_classifier(df.where(F.col(fold) != k), cols, label, **options))
        out = got if out is None else out.unionByName(got)
    return out
