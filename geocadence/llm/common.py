"""Shared pieces of the training-data operators: scratch tables, text slices, word hashing.

Scratch tables go to the folder named by ``spark.checkpoint.dir``; every executor of a cluster
shares it, so a lost executor never takes an intermediate table along.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
SLICE_BYTES = 1 << 19

_own_dir: str | None = None


ARROW_ROWS = 250


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most ARROW_ROWS rows: whole texts are long, and each executor core holds a few batches
    outside the heap, on both sides of the socket. Never raises a smaller setting. Results are lazy and read the
    setting when they run, after the operator has returned, so it stays for the session."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; in a single local process (tests), where none is named, a temporary one."""
    global _own_dir
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir names no folder; executors need one that all of them and the driver share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="scratch-")
    return _own_dir


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: cuts lineage, keeps pruning."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    # small row groups: a writer buffers one per task
    df.write.option("compression", "zstd").option("parquet.block.size", 16 << 20).parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._scratch_path = path
    return back


def reread(df: DataFrame) -> DataFrame:
    """A table made by ``written`` as a relation of its own, for self-joins."""
    back = df.sparkSession.read.schema(df.schema).parquet(df._scratch_path)
    back._scratch_path = df._scratch_path
    return back


def drop_written(df: DataFrame) -> None:
    """Delete a table made by ``written`` that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._scratch_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def prefix_sums(df: DataFrame, block: str, order: list[str], value: str, out: str) -> DataFrame:
    """Exclusive running sum of ``value`` over the rows by (block, order), without one global window.

    Blocks are summed in parallel; only the table of block totals (one row per block) meets in one task.
    """
    from pyspark.sql import Window as W

    totals = df.groupBy(block).agg(F.sum(value).alias("_t"))
    bases = totals.select(F.col(block).alias("_b"), (F.sum("_t").over(W.orderBy(block)) - F.col("_t")).alias("_base"))
    inner = F.sum(value).over(W.partitionBy(block).orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    return (
        df.withColumn("_in", F.coalesce(inner, F.lit(0)))
        .join(bases, F.col(block).eqNullSafe(F.col("_b")))
        .withColumn(out, F.col("_in") + F.col("_base"))
        .drop("_in", "_b", "_base")
    )


# ---------------------------------------------------------------- text slices


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n+1 byte offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()) if column.type != pa.large_string() else column
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    if data is None or n == 0:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    lo, hi = int(offsets[0]), int(offsets[-1])
    return np.frombuffer(data, np.uint8)[lo:hi], offsets - lo


def give_back() -> None:
    """Return freed memory to the system: workers live on between tasks, next to the executor's heap."""
    global _libc
    if _libc is None:
        import ctypes

        try:
            _libc = ctypes.CDLL("libc.so.6")
        except OSError:
            _libc = False
    if _libc:
        _libc.malloc_trim(0)
    pa.default_memory_pool().release_unused()


_libc = None
_since = 0


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about ``limit`` text bytes, so that work arrays stay small."""
    global _since
    _, off = text_bytes(batch.column(batch.schema.get_field_index(column)))
    n, at = batch.num_rows, 0
    while at < n:
        end = int(np.searchsorted(off, off[at] + limit, "right")) - 1
        end = min(n, max(at + 1, end), at + 50_000)
        yield batch.slice(at, end - at)
        at = end
    _since += 1
    if _since % 8 == 0:
        give_back()


# ---------------------------------------------------------------- hashing

_rng = np.random.default_rng(20240607)
BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
RADIX = 0x9E3779B97F4A7C15 | 1
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, radix: int = RADIX) -> tuple[np.ndarray, np.ndarray]:
    """radix**i and radix**-i modulo 2**64 for i < n (radix odd)."""
    have = _powers.get(radix)
    if have is None or len(have[0]) < n:
        size = 1 << max(10, (n - 1).bit_length())
        inverse = pow(radix, -1, 1 << 64)

        def run(r: int) -> np.ndarray:
            x = np.full(size, r, np.uint64)
            x[0] = 1
            return np.cumprod(x, dtype=np.uint64)

        have = run(radix), run(inverse)
        if size > 1 << 23:
            return have[0][:n], have[1][:n]
        _powers[radix] = have
    return have[0][:n], have[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hash(codes: np.ndarray, start: np.ndarray, end: np.ndarray, radix: int = RADIX) -> np.ndarray:
    """Hash of codes[start:end] for each span: equal runs hash alike wherever they stand."""
    up, down = powers(len(codes) + 1, radix)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * up[: len(codes)], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start])


class Words:
    """Words of a slice of texts: byte spans, row of each, and 64-bit hashes."""

    def __init__(self, column: pa.Array, lower: bool = False):
        buf, off = text_bytes(column)
        self.n_rows = len(off) - 1
        self.raw, self.buf, self.off = buf, (LOWER[buf] if lower else buf), off
        if not len(buf):
            self.start = self.end = np.zeros(0, np.int64)
        else:
            inside = ~IS_SPACE[buf]
            edge = np.zeros(len(buf) + 1, bool)
            edge[off] = True
            before = np.empty(len(buf), bool)
            before[0] = False
            before[1:] = inside[:-1]
            before &= ~edge[:-1]
            after = np.empty(len(buf), bool)
            after[-1] = False
            after[:-1] = inside[1:]
            after &= ~edge[1:]
            self.start = np.flatnonzero(inside & ~before)
            self.end = np.flatnonzero(inside & ~after) + 1
        self.row = np.searchsorted(off, self.start, "right") - 1
        #: words of row i are first[i]:first[i + 1]
        self.first = np.searchsorted(self.start, off, "left")

    @property
    def hash(self) -> np.ndarray:
        return span_hash(BYTE_CODE[self.buf], self.start, self.end)


def grams(h: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive codes within one row, and where each starts."""
    if len(h) < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(row[: len(h) - k + 1] == row[k - 1 :])
    out = np.zeros(len(h) - k + 1, np.uint64)
    for i in range(k):
        out = out * np.uint64(RADIX) + h[i : len(h) - k + 1 + i]
    return mix(out[at]), at


# ---------------------------------------------------------------- bounded Bloom filter

BLOOM_BITS_LOG2_MAX = 28


def bloom_bits(keys: DataFrame, key: str) -> tuple[int, np.ndarray]:
    """A Bloom filter over int64 hash keys whose size never exceeds 2**28 bits (32 MB).

    It only spares work: a false positive passes a row that a later exact step rejects, so the
    bound holds at every size and results do not depend on it.
    """
    n = keys.count()
    log2 = min(BLOOM_BITS_LOG2_MAX, max(13, (16 * max(n, 1) - 1).bit_length()))
    piece = max(10, log2 - 8)

    def bits(group: pa.Table) -> pa.Table:
        at = np.unique(group.column("p").to_numpy())
        one = np.zeros(1 << piece, bool)
        one[at & ((1 << piece) - 1)] = True
        return pa.table({"s": pa.array([int(at[0]) >> piece], pa.int64()), "b": pa.array([np.packbits(one).tobytes()], pa.binary())})

    m = (1 << log2) - 1
    pos = keys.select(F.explode(F.array(F.col(key).bitwiseAND(m), F.shiftright(key, 32).bitwiseAND(m))).alias("p"))
    # each piece of the filter is made from distinct bit positions only
    rows = pos.distinct().withColumn("s", F.shiftright("p", piece)).groupBy("s").applyInArrow(bits, "s long, b binary").collect()
    out = np.zeros(1 << (log2 - 3), np.uint8)
    width = 1 << (piece - 3)
    for r in rows:
        out[r["s"] * width : (r["s"] + 1) * width] = np.frombuffer(r["b"], np.uint8)
    return log2, out


def bloom_has(filter_: tuple[int, np.ndarray], h: np.ndarray) -> np.ndarray:
    log2, bits = filter_
    h = h.astype(np.int64, copy=False)
    m = np.int64((1 << log2) - 1)
    a, b = h & m, (h >> np.int64(32)) & m

    def test(p: np.ndarray) -> np.ndarray:
        return (bits[p >> 3] >> (7 - (p & 7)).astype(np.uint8)) & 1 == 1

    hit = test(a)
    hit[hit] = test(b[hit])
    return hit


def as_i64(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)
