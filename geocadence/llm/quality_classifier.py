"""Quality classifier: attention-based multiple-instance learning over the passages of a text.

A text is a bag of passages of PASSAGE words, all of them. A passage is encoded by rates (symbols,
capitals, digits, repeats and the like) and hashed byte pairs, then by one learned layer. A gated
attention, softmax(w . (tanh(V h) * sigmoid(U h))), weighs the passages; the score is a logistic
function of the weighted representation. Only the label of the whole text is known in training.

The net is trained on the driver from at most ``SAMPLE_ROWS`` labelled documents (chosen by hash of
doc_id among rows whose crc32(doc_id) mod 3 is not 1); of these only the encoded passages travel.
Scoring is one pass over whole texts on the executors, without a shuffle.

Cases: null, empty and wordless texts are a bag of one empty passage; texts are taken whole, however long; without
labels of both kinds every score is the known share (0.5 without any); a score of just 0.5 predicts 1; repeated rows
score alike, and a doc_id labelled twice has its greater label; empty tables give empty results; ``scored`` keeps all
columns but one of the name it adds, which it replaces. doc_id, lang, source and labels never enter a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, grams, mix, slices, table

PASSAGE = 128
PAIRS = 64
SAMPLE_ROWS = 4096
HIDDEN, ATTENTION = 24, 12
EPOCHS, BATCH, RATE, DECAY = 40, 64, 0.01, 1e-3
SEED = 20240607


def passages(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(features, row) of every passage of a slice of texts, rows ascending; at least one per row."""
    w = Words(column)
    n, buf = w.n_rows, w.buf
    nth = np.arange(len(w.start)) - w.first[w.row]
    opens = np.flatnonzero(nth % PASSAGE == 0)
    row = w.row[opens]
    empty = np.flatnonzero(np.diff(w.first) == 0)
    x = np.zeros((len(opens), 12 + PAIRS), np.float32)
    if len(opens):
        closes = np.append(opens[1:], len(w.start))
        lo, hi = w.start[opens], w.end[closes - 1]

        def share(flag: np.ndarray, of: np.ndarray) -> np.ndarray:
            sums = np.zeros(len(flag) + 1, np.int64)
            np.cumsum(flag, out=sums[1:])
            return (sums[hi] - sums[lo]) / np.maximum(1, of)

        size, words = hi - lo, closes - opens
        low = buf | 32
        letter = (low >= 97) & (low <= 122)
        upper, digit, wide = (buf >= 65) & (buf <= 90), (buf >= 48) & (buf <= 57), buf >= 128
        punct = (buf > 32) & ~letter & ~digit & ~wide
        h = w.hash
        g, at = grams(h, w.row, 5)
        twice = np.zeros(len(h) + 1, np.int64)
        if len(g):
            r = w.row[at]
            order = np.lexsort((g, r))
            same = (g[order][1:] == g[order][:-1]) & (r[order][1:] == r[order][:-1])
            hit = np.zeros(len(g), bool)
            hit[order[1:][same]] = hit[order[:-1][same]] = True
            np.add.at(twice, at[hit], 1)
            np.add.at(twice, at[hit] + 5, -1)
        covered = np.cumsum(twice)[:-1] > 0
        of = np.repeat(np.arange(len(opens)), words)
        order = np.lexsort((h, of))
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[order][1:] != h[order][:-1]) | (of[order][1:] != of[order][:-1])
        by_word = lambda flag: np.bincount(of[flag], minlength=len(opens)) / words
        length = (w.end - w.start).astype(np.float64)
        mean = np.bincount(of, length, len(opens)) / words
        x[:, 0] = share(np.isin(buf, np.frombuffer(b"#*$%&|<>", np.uint8)), size)
        x[:, 1] = share(upper, share(letter, np.ones(len(size))))
        x[:, 2] = share(digit, size)
        x[:, 3] = share(punct, size)
        x[:, 4] = share((buf == 33) | (buf == 124), words)
        x[:, 5] = by_word(covered)
        x[:, 6] = np.bincount(of[order[fresh]], minlength=len(opens)) / words**0.9
        x[:, 7] = mean / 10
        x[:, 8] = np.sqrt(np.maximum(0, np.bincount(of, length**2, len(opens)) / words - mean**2)) / 10
        x[:, 9] = np.log1p(words)
        x[:, 10] = share(buf == 10, words)
        if len(buf) > 1:
            pair = (mix(buf[:-1].astype(np.uint64) | buf[1:].astype(np.uint64) << np.uint64(8)) % np.uint64(PAIRS)).astype(np.int64)
            where = np.searchsorted(lo, np.arange(len(buf) - 1), "right") - 1
            ok = (where >= 0) & (np.arange(len(buf) - 1) < hi[np.maximum(where, 0)] - 1)
            counts = np.bincount(where[ok] * PAIRS + pair[ok], minlength=len(opens) * PAIRS).reshape(-1, PAIRS)
            x[:, 12:] = np.sqrt(counts / np.maximum(1, size)[:, None])
    if len(empty):
        none = np.zeros((len(empty), x.shape[1]), np.float32)
        none[:, 11] = 1
        x, row = np.concatenate([x, none]), np.concatenate([row, empty])
        order = np.argsort(row, kind="stable")
        x, row = x[order], row[order]
    return x, row


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Net:
    """Encoder, gated attention and logistic head, with hand-written gradients."""

    def __init__(self, width: int, prior: float = 0.5, seed: int = SEED):
        rng = np.random.default_rng(seed)
        init = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
        self.mean, self.scale, self.prior = np.zeros(width), np.ones(width), prior
        self.p = {"E": init(width, HIDDEN), "e": np.zeros(HIDDEN), "V": init(HIDDEN, ATTENTION), "U": init(HIDDEN, ATTENTION), "w": init(ATTENTION), "c": init(HIDDEN), "b": np.zeros(1)}
        self.trained = False

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict:
        """``first``: index of each bag's first passage."""
        p = self.p
        z = (x - self.mean) / self.scale
        h = np.tanh(z @ p["E"] + p["e"])
        t, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        a = (t * g) @ p["w"]
        bag = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(x))))
        a = np.exp(a - np.maximum.reduceat(a, first)[bag])
        a = a / np.add.reduceat(a, first)[bag]
        m = np.add.reduceat(a[:, None] * h, first, axis=0)
        return {"z": z, "h": h, "t": t, "g": g, "a": a, "bag": bag, "m": m, "y": _sigmoid(m @ p["c"] + p["b"])}

    def gradients(self, f: dict, y: np.ndarray, first: np.ndarray) -> dict:
        p = self.p
        d = (f["y"] - y) / len(y)
        dm = d[:, None] * p["c"]
        by = dm[f["bag"]]
        da = (by * f["h"]).sum(axis=1)
        da = f["a"] * (da - np.add.reduceat(f["a"] * da, first)[f["bag"]])
        dtg = da[:, None] * p["w"]
        dt, dg = dtg * f["g"] * (1 - f["t"] ** 2), dtg * f["t"] * f["g"] * (1 - f["g"])
        dh = (f["a"][:, None] * by + dt @ p["V"].T + dg @ p["U"].T) * (1 - f["h"] ** 2)
        return {"E": f["z"].T @ dh, "e": dh.sum(axis=0), "V": f["h"].T @ dt, "U": f["h"].T @ dg, "w": (f["t"] * f["g"]).T @ da, "c": f["m"].T @ d, "b": d.sum(keepdims=True)}

    def fit(self, x: np.ndarray, first: np.ndarray, y: np.ndarray) -> Net:
        """Adam over shuffled batches of bags."""
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        self.trained = True
        ends, rng = np.append(first[1:], len(x)), np.random.default_rng(SEED)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s, step = {k: np.zeros_like(v) for k, v in self.p.items()}, 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(first))
            for i in range(0, len(order), BATCH):
                pick = order[i : i + BATCH]
                at = np.concatenate([np.arange(first[b], ends[b]) for b in pick])
                begin = np.concatenate([[0], np.cumsum(ends[pick] - first[pick])[:-1]])
                got = self.gradients(self.forward(x[at], begin), y[pick], begin)
                step += 1
                for k, v in got.items():
                    v = v + DECAY * self.p[k]
                    m[k], s[k] = 0.9 * m[k] + 0.1 * v, 0.999 * s[k] + 0.001 * v * v
                    self.p[k] = self.p[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def score(self, x: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
        if not n:
            return np.zeros(0)
        if not self.trained:
            return np.full(n, self.prior)
        return self.forward(x, np.searchsorted(row, np.arange(n)))["y"]


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Net:
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").where(~held_out()).groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    chosen = known.orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id").limit(sample_rows)
    rows = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                x, row = passages(part.column("text"))
                cut = np.searchsorted(row, np.arange(part.num_rows + 1))
                yield pa.record_batch({"doc_id": part.column("doc_id").cast(pa.int64()), "quality": part.column("quality"), "x": pa.array([x[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary())})

    got = rows.mapInArrow(run, "doc_id long, quality int, x binary").toArrow().to_pylist()
    got.sort(key=lambda r: (r["doc_id"], r["x"]))
    width = 12 + PAIRS
    if not got or len({r["quality"] for r in got}) < 2:
        return Net(width, float(np.mean([r["quality"] for r in got])) if got else 0.5)
    bags = [np.frombuffer(r["x"], np.float32).reshape(-1, width) for r in got]
    first = np.concatenate([[0], np.cumsum([len(b) for b in bags])[:-1]])
    return Net(width).fit(np.concatenate(bags).astype(np.float64), first, np.array([float(r["quality"]) for r in got]))


def scored(docs: DataFrame, net: Net, out: str = "score") -> DataFrame:
    """Add the score of every whole text to ``docs``."""
    held = docs.sparkSession.sparkContext.broadcast(net)
    base = docs.drop(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = held.value
        for batch in batches:
            for part in slices(batch, "text"):
                yield part.append_column(out, pa.array(net.score(*passages(part.column("text")), part.num_rows)))

    return base.mapInArrow(run, base.withColumn(out, F.lit(0.0)).schema)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    net = fit(docs, table(spark, sf_dir, "labels"))
    slim = scored(docs, net).select("doc_id", held_out().alias("held_out"), "score")
    return slim.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


QUERIES = {"op9_quality_classifier": op9_quality_classifier}
