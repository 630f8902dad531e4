"""Quality rules: statistics of each text, and an isolation forest over them.

Every document's statistics are made from its whole text in one pass and written. Each tree of the forest grows on
TREE_ROWS documents, as the method has it, drawn by hash for that tree from all documents, labelled or not: random
features and random split points isolate odd rows after few splits, so a short mean path length means an anomaly.
Every document is scored once, and the threshold comes from all labelled ones: of the scores that keep at least
``KEEP_SHARE`` of the rows labelled good, the one that separates them best from rows labelled bad. Rows that the base
rules fail take no part in either.

Cases: null counts as empty (all statistics 0, base_failed); texts are taken whole, however long; without rows
labelled good the threshold is the ``KEEP_SHARE`` quantile of all anomalies; without any row nothing
fails but by the base rules; a score equal to the threshold passes; repeated rows are judged alike, and their
first text, by hash, is the one that trees and threshold see; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BYTE_CODE, RADIX, Words, drop_written, grams, mix, prefix_sums, reread, slices, span_hash, table, text_bytes, written

TREES = 100
TREE_ROWS = 256
ROWS_AT_ONCE = 4096
SCORE_BLOCKS = 1 << 12
KEEP_SHARE = 0.99
SEED = 20240607
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
EXTRA = ("n_upper", "n_digit", "n_punct", "n_lines", "n_distinct", "n_letters", "n_letter_words")


def row_sum(flag: np.ndarray, off: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flag) + 1, np.int64)
    np.cumsum(flag, out=sums[1:])
    return sums[off[1:]] - sums[off[:-1]]


def statistics(column: pa.Array) -> dict[str, np.ndarray]:
    """Per row of a slice of texts: the base counts and the further ones the forest sees."""
    w = Words(column)
    n, buf, off = w.n_rows, w.buf, w.off
    heads = (buf & 0xC0) != 0x80
    inside = np.zeros(len(buf) + 1, np.int64)
    if len(w.start):
        np.add.at(inside, w.start, 1)
        np.add.at(inside, w.end, -1)
    inside = np.cumsum(inside)[:-1].astype(bool)
    out = {"n_words": np.diff(w.first).astype(np.int64), "word_chars": row_sum(heads & inside, off), "n_symbols": row_sum(SYMBOLS[buf], off)}
    h = w.hash
    # words covered by a 5-word window that the text holds twice or more
    g, at = grams(h, w.row, 5)
    covered = np.zeros(len(h) + 1, np.int64)
    if len(g):
        row = w.row[at]
        order = np.lexsort((g, row))
        gs, rs = g[order], row[order]
        same = (gs[1:] == gs[:-1]) & (rs[1:] == rs[:-1])
        twice = np.zeros(len(gs), bool)
        twice[1:] |= same
        twice[:-1] |= same
        hit = at[order[twice]]
        np.add.at(covered, hit, 1)
        np.add.at(covered, hit + 5, -1)
    covered = np.cumsum(covered)[:-1] > 0
    out["n_repeat_words"] = np.bincount(w.row[covered], minlength=n).astype(np.int64)
    # lines with a word that equal an earlier line of the text
    ends = np.flatnonzero(buf == 10)
    start = np.union1d(off[:-1], ends + 1)
    start = start[start < len(buf)]
    bounds = np.append(start, len(buf))
    stop = bounds[1:] - (buf[np.maximum(bounds[1:] - 1, 0)] == 10) if len(start) else bounds[:0]
    lrow = np.searchsorted(off, start, "right") - 1
    has = np.searchsorted(w.start, stop, "left") > np.searchsorted(w.start, start, "left")
    start, stop, lrow = start[has], stop[has], lrow[has]
    lh = span_hash(BYTE_CODE[buf], start, stop) if len(start) else np.zeros(0, np.uint64)
    order = np.lexsort((lh, lrow))
    again = np.zeros(len(order), bool)
    again[1:] = (lh[order][1:] == lh[order][:-1]) & (lrow[order][1:] == lrow[order][:-1])
    out["n_dup_lines"] = np.bincount(lrow[order[again]], minlength=n).astype(np.int64)
    out["n_lines"] = np.bincount(lrow, minlength=n).astype(np.int64)
    out["n_upper"] = row_sum((buf >= 65) & (buf <= 90), off)
    out["n_digit"] = row_sum((buf >= 48) & (buf <= 57), off)
    letter = ((buf | 32) >= 97) & ((buf | 32) <= 122) | (buf >= 0x80) & heads
    out["n_letters"] = row_sum(letter, off)
    out["n_punct"] = row_sum((buf < 0x80) & ~(((buf | 32) >= 97) & ((buf | 32) <= 122)) & ~((buf >= 48) & (buf <= 57)) & (buf > 32), off)
    upto = np.append(0, np.cumsum(letter))
    out["n_letter_words"] = np.bincount(w.row[upto[w.end] > upto[w.start]], minlength=n).astype(np.int64)
    order = np.lexsort((h, w.row))
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[order][1:] != h[order][:-1]) | (w.row[order][1:] != w.row[order][:-1])
    out["n_distinct"] = np.bincount(w.row[order[fresh]], minlength=n).astype(np.int64)
    return out


def features(s: dict[str, np.ndarray]) -> np.ndarray:
    """Rates that do not depend on the length of a text."""
    words, chars = np.maximum(1, s["n_words"]), np.maximum(1, s["word_chars"])
    return np.stack([
        s["n_symbols"] / chars, s["n_repeat_words"] / words, s["n_dup_lines"] / np.maximum(1, s["n_lines"]),
        s["n_upper"] / np.maximum(1, s["n_letters"]), s["n_digit"] / chars, s["n_punct"] / chars, s["n_letter_words"] / words,
        s["n_distinct"] ** 1.0 / words ** 0.9, s["word_chars"] / words,
    ], axis=1)


def base_failed(s: dict[str, np.ndarray]) -> np.ndarray:
    return (s["n_words"] < 10) | (100 * s["n_repeat_words"] > 20 * s["n_words"])


# ---------------------------------------------------------------- isolation forest


def _average_path(n: float) -> float:
    return 0.0 if n <= 1 else (1.0 if n <= 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n)


class Forest:
    """Trees as flat arrays: feature (-1 at a leaf), split, children, and the path length of each leaf."""

    def __init__(self, x: np.ndarray, trees: int = TREES, rows: int = TREE_ROWS, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.norm = _average_path(min(rows, max(2, len(x))))
        self.trees = [self._grow(x[rng.choice(len(x), min(rows, len(x)), replace=False)], rng) for _ in range(trees if len(x) else 0)]

    @classmethod
    def of(cls, drawn: list[np.ndarray], seed: int = SEED) -> Forest:
        """A tree of each array of rows; the same forest as of one table that is drawn whole for each tree."""
        out, rng = cls(np.zeros((0, 1))), np.random.default_rng(seed)
        out.norm = _average_path(max(2, max(map(len, drawn))))
        out.trees = [cls._grow(x[rng.choice(len(x), len(x), replace=False)], rng) for x in drawn]
        return out

    @staticmethod
    def _grow(x: np.ndarray, rng) -> tuple:
        feature, split, left, right, depth_of = [], [], [], [], []
        deepest = int(np.ceil(np.log2(max(2, len(x))))) + 4

        def node(at: np.ndarray, depth: int) -> int:
            k = len(feature)
            for column in (feature, split, left, right, depth_of):
                column.append(0)
            part = x[at]
            spread = np.flatnonzero(part.max(axis=0) > part.min(axis=0)) if len(at) > 1 else []
            if depth >= deepest or len(spread) == 0:
                feature[k], depth_of[k] = -1, depth + _average_path(len(at))
                return k
            f = int(rng.choice(spread))
            s = float(rng.uniform(part[:, f].min(), part[:, f].max()))
            feature[k], split[k] = f, s
            low = part[:, f] <= s
            left[k] = node(at[low], depth + 1)
            right[k] = node(at[~low], depth + 1)
            return k

        node(np.arange(len(x)), 0)
        return np.array(feature), np.array(split), np.array(left), np.array(right), np.array(depth_of)

    def anomaly(self, x: np.ndarray) -> np.ndarray:
        """0 to 1, higher for rows that few splits isolate."""
        if not self.trees:
            return np.zeros(len(x))
        total = np.zeros(len(x))
        for feature, split, left, right, depth in self.trees:
            at = np.zeros(len(x), np.int64)
            while True:
                f = feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                v = x[np.arange(len(x)), np.maximum(f, 0)]
                at = np.where(inner, np.where(v <= split[at], left[at], right[at]), at)
            total += depth[at]
        return 2.0 ** (-total / len(self.trees) / max(self.norm, 1e-9))


def calibrate(score: np.ndarray, quality: np.ndarray, keep_share: float = KEEP_SHARE) -> float:
    """``cut`` on arrays: threshold on the anomaly score (rows above it fail), given rows labelled good: among those that keep at least ``keep_share`` of the
    good rows, the one with the best share of rejected bad rows less ten times the share of good rows lost."""
    good, bad = np.sort(score[quality == 1]), np.sort(score[quality == 0])
    floor = float(good[int(np.ceil(keep_share * len(good))) - 1])
    if not len(bad):
        return floor
    steps = np.unique(np.concatenate([good[good >= floor], bad[bad >= floor]]))
    lost = 1 - np.searchsorted(good, steps, "right") / len(good)
    caught = 1 - np.searchsorted(bad, steps, "right") / len(bad)
    best = caught - 10 * lost
    # between two rows the threshold stands midway
    k = int(np.argmax(best))
    above = np.concatenate([good[good > steps[k]][:1], bad[bad > steps[k]][:1]])
    return float((steps[k] + above.min()) / 2) if len(above) else float(steps[k])


MEASURED_SCHEMA = "doc_id long, thash long, " + ", ".join(f"{c} long" for c in BASE) + ", base_failed boolean, x binary"
SCORED_SCHEMA = MEASURED_SCHEMA.replace("x binary", "anomaly double")


def measured(docs: DataFrame) -> DataFrame:
    """Per row: counts, base_failed, and the features as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                s = statistics(part.column("text"))
                x = pa.array([row.tobytes() for row in features(s)], pa.binary())
                yield pa.record_batch({"doc_id": part.column("doc_id").cast(pa.int64()), "thash": part.column("thash"), **{c: pa.array(s[c]) for c in BASE}, "base_failed": pa.array(base_failed(s)), "x": x})

    return docs.select("doc_id", F.xxhash64("text").alias("thash"), "text").mapInArrow(run, MEASURED_SCHEMA)


def _unpacked(column: pa.Array) -> np.ndarray:
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)


def draw_keys(doc_id: np.ndarray, trees: int = TREES) -> np.ndarray:
    """n x trees: a tree takes the documents of the least keys."""
    at = mix(doc_id.astype(np.int64).view(np.uint64) + np.uint64(SEED))
    return mix(at[:, None] + np.arange(1, trees + 1, dtype=np.uint64)[None, :] * np.uint64(RADIX))


def grow(stats: DataFrame) -> Forest:
    """Forest over ``stats`` (a written table of ``measured``): each tree draws from all documents. What reaches the
    driver are some 2 * TREE_ROWS documents a tree, at any size of the table."""
    good = stats.where("NOT base_failed AND doc_id IS NOT NULL").select("doc_id", "thash", "x")
    n = good.select("doc_id").distinct().count()
    if not n:
        return Forest(np.zeros((0, 1)))
    share = 2 * TREE_ROWS / n
    while True:
        last = np.uint64(int(min(share, 1.0) * (2**64 - 2048)) if share < 1 else 2**64 - 1)

        def run(batches: Iterator[pa.RecordBatch], last=last) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array((draw_keys(batch.column("doc_id").to_numpy()) <= last).any(axis=1)))

        got = good.mapInArrow(run, good.schema).toArrow().sort_by([("doc_id", "ascending"), ("thash", "ascending")]).combine_chunks()
        ids = got.column("doc_id").to_numpy()
        once = np.flatnonzero(np.append(True, ids[1:] != ids[:-1])) if len(ids) else np.zeros(0, np.int64)
        keys = draw_keys(ids[once])
        # a tree is complete when all it may take lie below the last key looked at
        if share >= 1 or ((keys <= last).sum(axis=0) >= TREE_ROWS).all():
            break
        share *= 2
    x = _unpacked(got.column("x"))[once]
    return Forest.of([x[np.sort(np.argsort(k, kind="stable")[:TREE_ROWS])] for k in keys.T])


def scored(stats: DataFrame, forest: Forest) -> DataFrame:
    held = stats.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rated(some: list[pa.RecordBatch]) -> pa.Table:
            t = pa.Table.from_batches(some)
            return t.drop_columns(["x"]).append_column("anomaly", pa.array(held.value.anomaly(_unpacked(t.column("x")))))

        some, n = [], 0
        for batch in batches:
            if batch.num_rows:
                some.append(batch)
                n += batch.num_rows
            if n >= ROWS_AT_ONCE:
                yield from rated(some).combine_chunks().to_batches()
                some, n = [], 0
        if some:
            yield from rated(some).combine_chunks().to_batches()

    return stats.mapInArrow(run, SCORED_SCHEMA)


def cut(rated: DataFrame, labels: DataFrame, keep_share: float = KEEP_SHARE) -> float:
    """``calibrate`` over all labelled documents of ``rated`` (a written table of ``scored``), without gathering them:
    counts by score, and running sums over blocks of scores."""
    good = rated.where("NOT base_failed AND doc_id IS NOT NULL").select("doc_id", "thash", "anomaly")
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), "quality").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    first = good.groupBy("doc_id").agg(F.min_by("anomaly", "thash").alias("anomaly"))
    q = F.col("quality")
    counts = first.join(known, "doc_id", "left").groupBy("anomaly").agg(F.count_if(q == 1).alias("good"), F.count_if(q == 0).alias("bad"), F.count("*").alias("n"))
    counts = written(counts.withColumn("block", F.floor(F.col("anomaly") * SCORE_BLOCKS)), "scores")
    n_good, n_bad, n = counts.agg(F.sum("good"), F.sum("bad"), F.sum("n")).first()
    if not n:
        return 2.0
    upto = lambda df, c: prefix_sums(df, "block", ["anomaly"], c, f"to_{c}").withColumn(f"to_{c}", F.col(f"to_{c}") + F.col(c))
    if not n_good:
        # the quantile of all scores, between two ranks if need be
        at = keep_share * (n - 1)
        by_rank = upto(counts, "n")
        low, high = (by_rank.where(F.col("to_n") > k).agg(F.min("anomaly")).first()[0] for k in (int(np.floor(at)), int(np.ceil(at))))
        out = low + (high - low) * (at - np.floor(at))
    else:
        steps = written(upto(upto(reread(counts).where("good + bad > 0"), "good"), "bad"), "steps")
        out = steps.where(F.col("to_good") >= int(np.ceil(keep_share * n_good))).agg(F.min("anomaly")).first()[0]
        if n_bad:
            worth = (1 - F.col("to_bad") / n_bad) - 10 * (1 - F.col("to_good") / n_good)
            out = -steps.where(F.col("anomaly") >= out).agg(F.max(F.struct(worth.alias("worth"), (-F.col("anomaly")).alias("m"))).alias("s")).first().s.m
            # between two rows the threshold stands midway
            above = steps.where(F.col("anomaly") > out).agg(F.min("anomaly")).first()[0]
            out = out if above is None else (out + above) / 2
        drop_written(steps)
    drop_written(counts)
    return float(out)


def fit(docs: DataFrame, labels: DataFrame) -> tuple[Forest, float]:
    """Forest and threshold over all of ``docs`` (doc_id, text)."""
    stats = written(measured(docs), "statistics")
    forest = grow(stats)
    return forest, cut(written(scored(stats, forest), "anomalies"), labels)


def judged(rated: DataFrame, threshold: float) -> DataFrame:
    return rated.select("doc_id", *BASE, "base_failed", "anomaly", (~F.col("base_failed") & (F.col("anomaly") <= threshold)).alias("kept"))


def judge(docs: DataFrame, forest: Forest, threshold: float) -> DataFrame:
    """Statistics, base_failed, anomaly and kept of every whole text."""
    return judged(scored(measured(docs), forest), threshold)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = written(measured(table(spark, sf_dir, "documents")), "statistics")
    rated = written(scored(stats, grow(stats)), "anomalies")
    drop_written(stats)
    return judged(rated, cut(rated, table(spark, sf_dir, "labels")))


QUERIES = {"op8_quality_rules": op8_quality_rules}
