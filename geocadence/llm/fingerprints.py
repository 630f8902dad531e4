"""Document fingerprints: quartile bucket digests of hashed byte triplets.

Every run of three bytes of the UTF-8 text is hashed into one of 256 buckets. The digest writes two
bits per bucket (which quartile of the bucket counts its count falls in) and one byte for the length
on a logarithmic scale: 65 bytes, 130 hex digits. Two digests are compared by the sum of quartile
steps between their buckets plus the length steps, bounded by ``BOUND`` and turned into a likeness
of 0 to 1.

``neighbours`` pairs each document with the next by (doc_id, hash of the text, text) without a global sort: rows
are dealt to ranges of that key, as many as the bytes of the table need, sorted inside each range as a stream,
and the first document of each range also goes to the range before it. Texts are shuffled once.

Cases: null counts as empty; empty and one-byte texts have an all-zero digest with length 0 or 1; texts are taken
whole, however long; equal texts have equal digests; rows of one doc_id are ordered by the hash of their text, so many
of them are several ranges; a single document is its own next. Null doc_ids come first. Empty tables give empty
results. ``with_fingerprint`` keeps all columns but one of the name it adds, which it replaces.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix, reread, shuffle_partitions, slices, table, text_bytes, written

BUCKETS = 256
BOUND = 256
LENGTH_STEPS = 12.0


def digests(column: pa.Array) -> np.ndarray:
    """n x (BUCKETS + 1) codes: quartile of each bucket, then the length code."""
    buf, off = text_bytes(column)
    n = len(off) - 1
    out = np.zeros((n, BUCKETS + 1), np.uint8)
    if len(buf) >= 3:
        b = buf.astype(np.uint64)
        tri = b[:-2] | (b[1:-1] << np.uint64(8)) | (b[2:] << np.uint64(16))
        bucket = (mix(tri + np.uint64(1)) >> np.uint64(56)).astype(np.int64)
        row = np.repeat(np.arange(n), np.diff(off))
        whole = row[:-2] == row[2:]
        counts = np.bincount(row[:-2][whole] * BUCKETS + bucket[whole], minlength=n * BUCKETS).reshape(n, BUCKETS)
        ordered = np.sort(counts, axis=1)
        q1, q2, q3 = (ordered[:, BUCKETS * k // 4 - 1, None] for k in (1, 2, 3))
        out[:, :BUCKETS] = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
    size = np.diff(off)
    out[:, BUCKETS] = np.minimum(255, np.rint(LENGTH_STEPS * np.log2(size + 1.0) / 2)).astype(np.uint8)
    return out


def digest_hex(codes: np.ndarray) -> list[str]:
    q = codes[:, :BUCKETS].reshape(len(codes), BUCKETS // 4, 4)
    packed = q[:, :, 0] | (q[:, :, 1] << 2) | (q[:, :, 2] << 4) | (q[:, :, 3] << 6)
    both = np.concatenate([codes[:, BUCKETS:], packed], axis=1).astype(np.uint8)
    return [row.tobytes().hex() for row in both]


def difference(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Quartile steps between buckets plus length steps beyond one, at most BOUND."""
    d = np.abs(a.astype(np.int16) - b.astype(np.int16))
    return np.minimum(BOUND, d[:, :BUCKETS].sum(axis=1) + np.maximum(0, d[:, BUCKETS] - 1))


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 1.0 - difference(a, b) / BOUND


def from_hex(text: str) -> np.ndarray:
    raw = np.frombuffer(bytes.fromhex(text), np.uint8)
    packed = raw[1:]
    q = np.stack([(packed >> s) & 3 for s in (0, 2, 4, 6)], axis=1).reshape(-1)
    return np.concatenate([q, raw[:1]])[None, :]


def with_fingerprint(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """Add the digest of each whole text."""
    base = docs.drop(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                yield part.append_column(out, pa.array(digest_hex(digests(part.column(text))), pa.string()))

    return base.mapInArrow(run, base.withColumn(out, F.lit("")).schema)


RANGE_BYTES = 16 << 20


def neighbours(docs: DataFrame, per_range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(doc_id, text, range, tail): documents dealt to ranges, each range ending with the first document of the
    next one (``tail`` 1; 2 for the overall first, which follows the last)."""
    spark = docs.sparkSession
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    key = F.col("doc_id").isNotNull().alias("k"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("h")
    slim = d.select(*key, F.octet_length("text").alias("size"))
    keys = written(slim, "text-keys")
    total = keys.select(F.sum("size")).first()[0] or 0
    ranges = max(2 * shuffle_partitions(spark), -(-total // per_range_bytes))
    # one key a range: the first of each, from the keys alone
    dealt = reread(keys).repartitionByRange(ranges, "k", "id", "h")
    firsts = dealt.groupBy(F.spark_partition_id()).agg(F.min(F.struct("k", "id", "h")).alias("m")).collect()
    points = sorted((bool(r["m"]["k"]), r["m"]["id"], r["m"]["h"]) for r in firsts)
    held = spark.sparkContext.broadcast(points)

    @F.pandas_udf("range int, first boolean")
    def place(k: pd.Series, i: pd.Series, h: pd.Series) -> pd.DataFrame:
        points = held.value
        own = list(zip(k.tolist(), i.tolist(), h.tolist()))
        at = [bisect.bisect_right(points, x) - 1 for x in own]
        return pd.DataFrame({"range": np.array(at, np.int32), "first": [points[j] == x for j, x in zip(at, own)]})

    ranged = d.withColumn("at", place(*key)).select("doc_id", "h", "text", "at.range", "at.first")
    # the one key of a range that is first may be several rows: of those the least text
    heads = ranged.where("first").groupBy("range", "doc_id", "h").agg(F.min("text").alias("text"))
    last = len(points) - 1
    before = F.when(F.col("range") == 0, F.lit(last)).otherwise(F.col("range") - 1).cast("int")
    tails = heads.select("doc_id", "h", "text", before.alias("range"), F.when(F.col("range") == 0, 2).otherwise(1).alias("tail"))
    both = ranged.select("doc_id", "h", "text", "range", F.lit(0).alias("tail")).unionByName(tails)
    return both.repartition(ranges, "range").sortWithinPartitions("range", "tail", "doc_id", "h", "text").select("doc_id", "text", "range", "tail")


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stream of rows sorted by range; the last row is held back until its next one is known."""
    held: tuple[int, int | None, str, int] | None = None
    for batch in batches:
        for part in slices(batch, "text"):
            ids, texts = part.column("doc_id").to_pylist(), part.column("text").to_pylist()
            ranges, tails = part.column("range").to_pylist(), part.column("tail").to_pylist()
            rows = ([held] if held else []) + list(zip(ranges, ids, texts, tails))
            held = rows[-1]
            yield from _pairs(rows)


def _pairs(rows: list) -> Iterator[pa.RecordBatch]:
    pairs = [(a, b) for a, b in zip(rows, rows[1:]) if a[3] == 0 and a[0] == b[0]]
    if not pairs:
        return
    texts = [r[2] for r in rows]
    codes = digests(pa.array(texts, pa.large_string()))
    own = [i for i, (a, b) in enumerate(zip(rows, rows[1:])) if a[3] == 0 and a[0] == b[0]]
    edited = []
    for i in own:
        t, k = texts[i], len(texts[i]) // 4
        edited.append(t[: len(t) - k] + texts[i + 1][:k])
    other = digests(pa.array(edited, pa.large_string()))
    mine, after = codes[own], codes[np.array(own) + 1]
    yield pa.record_batch({
        "doc_id": pa.array([rows[i][1] for i in own], pa.int64()),
        "n_chars": pa.array([len(texts[i]) for i in own], pa.int64()),
        "edited_sha256": pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edited]),
        "fingerprint": pa.array(digest_hex(mine)),
        "edited_fingerprint": pa.array(digest_hex(other)),
        "near_edited": pa.array(likeness(mine, other)),
        "near_next": pa.array(likeness(mine, after)),
    })


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(table(spark, sf_dir, "documents")).mapInArrow(_edited, SCHEMA)


QUERIES = {"op7_fingerprints": op7_fingerprints}
