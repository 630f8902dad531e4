"""Packing token sequences by cutting-stock column generation.

1. Every document becomes its ids and an end id, cut at multiples of ``capacity``; the pieces, with
   their ids and CRC, are written to the shared folder. Lengths are counted in classes of
   ``capacity / CLASSES`` tokens (a bounded histogram by class and hash slice).
2. A linear program over patterns (how many pieces of each class share a sequence) is solved by column
   generation: the master's duals price classes, a knapsack dynamic program finds the best new pattern.
   Patterns are rounded down; what is left over is packed by greedy patterns of the same kind.
3. Pieces are ranked within their class and dealt to the patterns' slots by rank.
4. A class rounds lengths up, so sequences have small gaps. Some hash slices of the documents are set
   aside before step 2 (as few as fill the gaps); as one token stream they fill every gap exactly.
   What then remains fills further sequences, the last of them cut into powers of two. So sequences
   have no padding at all while any slice is left to fill with.

Only histograms and the pattern table (bounded by classes, slices and capacity) meet on the driver.
Ranks come from windows over (class, hash cell), so a length that a third of all rows share is split.

Cases: a null or empty text is the end id alone; a long text is cut; repeated rows and equal doc_ids
are packed one by one; an empty table gives an empty result; input columns other than doc_id and text
are not used.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BYTE_CODE, IS_SPACE, LOWER, Words, prefix_sums, slices, span_hash, table, written

CAPACITY = 4096
CLASSES = 256
SLICES = 64
END_ID = 2
VOCABULARY = "word_bpe_49k.json"
CELL_ROWS = 100_000
STREAM_BLOCK = 1 << 20
CACHE_WORDS = 1_000_000


# ---------------------------------------------------------------- tokens


class Encoder:
    """Ids of whole texts by way of their chunks: no id of this vocabulary crosses ASCII white space, nor the
    end of a run of letters before an ASCII character that is no letter, and A-Z count as a-z. So each
    distinct chunk is encoded once (in a cache of bounded size) and its ids are laid out again."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self._reset()

    def _reset(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at, self.size = np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.ids, self.used = np.zeros(1 << 16, np.uint16), 0

    def _learn(self, keys: np.ndarray, words: list[str]) -> None:
        parts = [self._ids(words[i : i + 500]) for i in range(0, len(words), 500)]
        size = np.concatenate([x[1] for x in parts])
        total = int(size.sum())
        while self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), np.uint16)])
        self.ids[self.used : self.used + total] = np.concatenate([x[0] for x in parts])
        at = (self.used + np.cumsum(size) - size).astype(np.int32)
        self.used += total
        place = np.searchsorted(self.keys, keys)
        self.keys, self.at, self.size = np.insert(self.keys, place, keys), np.insert(self.at, place, at), np.insert(self.size, place, size)

    def _ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some chunks and how many each has: one text of a chunk a line costs least, and the ids'
        places tell the chunks apart. Where that leaves a chunk without ids, each is encoded alone."""
        got = self.tokenizer.encode("\n".join(words), add_special_tokens=False)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        at = np.fromiter((o[0] for o in got.offsets), np.int64, len(got))
        size = np.bincount(np.searchsorted(ends, at, "right"), minlength=len(words)).astype(np.int32)
        if len(size) == len(words) and size.all() and (np.diff(at) >= 0).all():
            return np.array(got.ids, np.uint16), size
        lists = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        size = np.fromiter(map(len, lists), np.int32, len(lists))
        return np.fromiter(itertools.chain.from_iterable(lists), np.uint16, int(size.sum())), size

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a slice of texts, each text ended by END_ID, and the n+1 offsets of the texts."""
        w = Words(column)
        buf, start, end, row = w.buf, w.start, w.end, w.row
        raw = buf.tobytes()
        if b"OFTEXT|>" not in raw.upper():  # else words stay whole, for the vocabulary's own special strings
            buf = LOWER[buf]
            letter = (buf >= 97) & (buf <= 122)
            cut = np.zeros(len(buf), bool)
            cut[1:] = letter[:-1] & ~letter[1:] & (buf[1:] < 128) & ~IS_SPACE[buf[1:]]
            cut = np.flatnonzero(cut)
            start, end = np.sort(np.concatenate([start, cut])), np.sort(np.concatenate([end, cut]))
            row = np.searchsorted(w.off, start, "right") - 1
            raw = buf.tobytes()
        if len(self.keys) > CACHE_WORDS:
            self._reset()
        keys, order, back = np.unique(span_hash(BYTE_CODE[buf], start, end), return_index=True, return_inverse=True)
        place = np.searchsorted(self.keys, keys)
        fresh = np.ones(len(keys), bool)
        if len(self.keys):
            fresh = self.keys[np.minimum(place, len(self.keys) - 1)] != keys
        if fresh.any():
            first = order[fresh]
            self._learn(keys[fresh], [raw[a:b].decode() for a, b in zip(start[first].tolist(), end[first].tolist())])
            place = np.searchsorted(self.keys, keys)
        at, size = self.at[place][back].astype(np.int64), self.size[place][back].astype(np.int64)
        total = int(size.sum())
        before = np.cumsum(size) - size
        # the end id of text i stands after all ids of texts up to i and the i end ids before it
        steps = np.arange(total)
        out = np.full(total + w.n_rows, END_ID, np.uint16)
        out[np.repeat(row, size) + steps] = self.ids[np.repeat(at - before, size) + steps]
        rows = np.zeros(w.n_rows + 1, np.int64)
        rows[1:] = np.cumsum(np.bincount(row, size, w.n_rows).astype(np.int64) + 1)
        return out, rows


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


PIECE_SCHEMA = "doc_id long, start long, length int, doc_tokens long, ids_crc32 long, ids binary, class int, slice int"


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, classes: int = CLASSES, n_slices: int = SLICES) -> DataFrame:
    """One row per piece of at most ``capacity`` ids (unsigned 16-bit, little-endian, in ``ids``)."""
    width = capacity // classes
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)
        for batch in batches:
            for part in slices(batch, "text"):
                ids, off = encoder.encode(part.column("text"))
                size = np.diff(off)
                n = -(-size // capacity)
                doc = np.repeat(np.arange(len(size)), n)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * capacity
                length = np.minimum(capacity, size[doc] - start)
                begin = off[doc] + start
                raw = [ids[a : a + k] for a, k in zip(begin.tolist(), length.tolist())]
                sums = [crc(x) for x in raw]
                # slices go by the ids themselves, so that they do not depend on the layout of the files
                mixed = (np.array(sums, np.uint64) * np.uint64(0x9E3779B97F4A7C15) + start.astype(np.uint64)) >> np.uint64(40)
                yield pa.record_batch({
                    "doc_id": part.column("doc_id").cast(pa.int64()).take(pa.array(doc)), "start": pa.array(start, pa.int64()),
                    "length": pa.array(length, pa.int32()), "doc_tokens": pa.array(size[doc], pa.int64()), "ids_crc32": pa.array(sums, pa.int64()),
                    "ids": pa.array([x.astype("<u2").tobytes() for x in raw], pa.binary()), "class": pa.array(-(-length // width), pa.int32()),
                    "slice": pa.array((mixed % np.uint64(n_slices)).astype(np.int32)),
                })

    return docs.select("doc_id", "text").mapInArrow(run, PIECE_SCHEMA)


# ---------------------------------------------------------------- cutting stock


def knapsack(price: np.ndarray, size: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Best value and item counts of an unbounded knapsack, by dynamic programming over the capacity."""
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        fit = size <= c
        value = best[c - size[fit]] + price[fit]
        k = int(np.argmax(value)) if len(value) else -1
        if k >= 0 and value[k] > best[c - 1] + 1e-12:
            best[c], pick[c] = value[k], np.flatnonzero(fit)[k]
        else:
            best[c] = best[c - 1]
    counts, c = np.zeros(len(size), np.int64), capacity
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            counts[pick[c]] += 1
            c -= size[pick[c]]
    return float(best[capacity]), counts


def column_generation(size: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 1500) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (one a row) and how often each is used in the linear program's solution.

    Revised simplex on the Gilmore-Gomory master; it may stop after ``rounds`` columns with a feasible solution.
    """
    m = len(size)
    patterns = np.diag(capacity // size).astype(float)
    inverse = np.diag(1.0 / np.diag(patterns))
    x = inverse @ demand
    for _ in range(rounds):
        price = inverse.T @ np.ones(m)
        value, column = knapsack(price, size, capacity)
        if value <= 1 + 1e-6:
            break
        step = inverse @ column
        ratio = np.where(step > 1e-9, x / np.maximum(step, 1e-9), np.inf)
        k = int(np.argmin(ratio))
        if not np.isfinite(ratio[k]):
            break
        x = np.maximum(0, x - step * ratio[k])
        x[k] = ratio[k]
        row = inverse[k] / step[k]
        inverse = inverse - np.outer(step, row)
        inverse[k] = row
        patterns[:, k] = column
    return patterns.T.astype(np.int64), x


def stock_plan(size: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """(pattern, times): rounded linear-program patterns, then greedy ones for the rest. Covers demand exactly."""
    if not len(size):
        return []
    patterns, x = column_generation(size, demand.astype(float), capacity)
    left, plan = demand.copy(), []
    for p, times in sorted(zip(patterns, np.floor(x + 1e-6).astype(np.int64)), key=lambda y: -y[1]):
        times = min([int(times), *(left[p > 0] // p[p > 0]).tolist()])
        if times > 0:
            plan.append((p, times))
            left = left - p * times
    order = np.argsort(-size, kind="stable")
    while left.any():
        room, p = capacity, np.zeros(len(size), np.int64)
        for k in order:
            take = min(int(left[k]), room // int(size[k]))
            p[k], room = take, room - take * int(size[k])
        times = int((left[p > 0] // p[p > 0]).min())
        plan.append((p, times))
        left = left - p * times
    return plan


def choose_plan(count: np.ndarray, tokens: np.ndarray, classes: int, capacity: int) -> tuple[int, list]:
    """How many slices to set aside as filler, and the plan for the other pieces.

    ``count`` and ``tokens`` are slices x (classes + 1). The fewest slices, at first by estimate, whose
    tokens fill all gaps of the others' plan.
    """
    n, total = len(count), int(tokens.sum())
    width = capacity // classes
    waste = (count * np.arange(classes + 1) * width).sum(axis=1) - tokens.sum(axis=1)
    k = int(np.ceil(n * 1.03 * waste.sum() / max(1, total + waste.sum())))
    while True:
        k = min(k, n)
        demand = count[k:].sum(axis=0)
        size = np.flatnonzero(demand)
        plan = [(dict(zip(size.tolist(), p.tolist())), t) for p, t in stock_plan(size, demand[size], classes)]
        gaps = capacity * sum(t for _, t in plan) - int(tokens[k:].sum())
        filler = int(tokens[:k].sum())
        if filler >= gaps or k == n:
            return k, plan
        k += max(1, int(np.ceil((gaps - filler) / max(1, total) * n)))


# ---------------------------------------------------------------- assignment


def _places(plan: list, capacity: int) -> list[tuple]:
    """(class, first rank, end rank, pieces per sequence, first sequence, slot base) of each class in each pattern."""
    at: dict[int, int] = {}
    out, sequence = [], 0
    for pattern, times in plan:
        slot = 0
        for c, a in sorted(pattern.items(), reverse=True):
            if a:
                first = at.get(c, 0)
                out.append((c, first, first + a * times, a, sequence, slot))
                at[c] = first + a * times
                slot += a
        sequence += times
    return out


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, classes: int = CLASSES) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids (unsigned 16-bit)."""
    spark = docs.sparkSession
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path(VOCABULARY)
    cut = written(pieces(docs, vocabulary, capacity, classes).withColumn("uid", F.monotonically_increasing_id()), "pieces")
    cells = cut.groupBy("slice", "class").agg(F.count("*").alias("n"), F.sum("length").alias("t")).collect()
    count, tokens = np.zeros((SLICES, classes + 1), np.int64), np.zeros((SLICES, classes + 1), np.int64)
    for r in cells:
        count[r["slice"], r["class"]], tokens[r["slice"], r["class"]] = r["n"], r["t"]
    k, plan = choose_plan(count, tokens, classes, capacity)
    sequences = sum(t for _, t in plan)
    gaps = capacity * sequences - int(tokens[k:].sum())
    spread = max(1, int(count.sum()) // CELL_ROWS)

    # rank within the class: position in a hash cell plus the sizes of the cells before it
    light = cut.where(F.col("slice") >= k).select("uid", "class", "length")
    light = light.withColumn("cell", F.pmod(F.xxhash64("uid"), F.lit(SLICES * spread)))
    sizes = light.groupBy("class", "cell").agg(F.count("*").alias("n"))
    bases = sizes.select("class", "cell", (F.sum("n").over(W.partitionBy("class").orderBy("cell")) - F.col("n")).alias("base"))
    inner = F.row_number().over(W.partitionBy("class", "cell").orderBy("uid")) - 1
    ranked = light.withColumn("inner", inner).join(bases, ["class", "cell"]).withColumn("rank", F.col("base") + F.col("inner"))
    places = spark.createDataFrame(_places(plan, capacity) or [], "c int, lo long, hi long, a long, seq long, slot int")
    # bounded by patterns x classes per pattern
    dealt = ranked.join(F.broadcast(places), (F.col("class") == F.col("c")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    step = F.col("rank") - F.col("lo")
    dealt = dealt.select("uid", "length", (F.col("seq") + F.floor(step / F.col("a"))).alias("sequence_id"), (F.col("slot") + step % F.col("a")).alias("place"))
    inside = W.partitionBy("sequence_id").orderBy("place")
    dealt = written(dealt.withColumn("offset", F.sum("length").over(inside) - F.col("length")), "packed")

    used = dealt.groupBy("sequence_id").agg(F.sum("length").cast("long").alias("used")).withColumn("gap", capacity - F.col("used")).where("gap > 0")
    used = prefix_sums(used.withColumn("block", F.floor(F.col("sequence_id") / 4096)), "block", ["sequence_id"], "gap", "at")
    fill = cut.where(F.col("slice") < k).select("uid", "doc_id", "start", "length", "doc_tokens", "ids").withColumn("block", F.shiftright("uid", 12))
    places_of = prefix_sums(fill.select("uid", "block", "length"), "block", ["uid"], "length", "at").select("uid", "at")
    fill = fill.drop("block").join(places_of, "uid")
    total = int(tokens[:k].sum())
    filled = _fill(fill, used, gaps, total, sequences, capacity)

    meta = cut.where(F.col("slice") >= k).select("uid", "doc_id", "start", "length", "doc_tokens", "ids_crc32", "ids")
    whole = meta.join(dealt.select("uid", "sequence_id", "offset"), "uid")
    cols = ["doc_id", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "doc_tokens", F.col("sequence_id").cast("long").alias("sequence_id"), F.col("offset").cast("long").alias("offset"), "ids"]
    return whole.select(*cols).unionByName(filled.select(*cols))


FILL_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def _fill(fill: DataFrame, used: DataFrame, gaps: int, total: int, sequences: int, capacity: int) -> DataFrame:
    """Lay the filler stream over the gaps, then over new sequences; blocks of the stream are independent."""
    span = lambda at, size: F.explode(F.sequence(F.floor(at / STREAM_BLOCK), F.floor((at + size - 1) / STREAM_BLOCK)))
    left = fill.withColumn("stream", span(F.col("at"), F.col("length")))
    right = used.select("sequence_id", "used", "gap", "at").withColumn("stream", span(F.col("at"), F.col("gap")))
    after = max(0, total - gaps)
    full, rest = divmod(after, capacity)
    tail = [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]

    def lay(key: tuple, docs: pa.Table, holes: pa.Table) -> pa.Table:
        lo = key[0].as_py() * STREAM_BLOCK
        hi = min(lo + STREAM_BLOCK, total)
        at, length = docs.column("at").to_numpy(), docs.column("length").to_numpy().astype(np.int64)
        h_at, h_seq, h_used = (holes.column(c).to_numpy() for c in ("at", "sequence_id", "used"))
        order = np.argsort(h_at, kind="stable")
        h_at, h_seq, h_used = h_at[order], h_seq[order], h_used[order]
        first = np.arange(max(lo, gaps) - (max(lo, gaps) - gaps) % capacity, min(hi, gaps + full * capacity), capacity) if hi > gaps else np.zeros(0, np.int64)
        ends = gaps + full * capacity + np.concatenate([[0], np.cumsum(tail)[:-1]]).astype(np.int64) if tail else np.zeros(0, np.int64)
        g_at = np.concatenate([h_at, first, ends]).astype(np.int64)
        g_seq = np.concatenate([h_seq, sequences + (first - gaps) // capacity, sequences + full + np.arange(len(tail))]).astype(np.int64)
        g_used = np.concatenate([h_used, np.zeros(len(first) + len(ends))]).astype(np.int64)
        cuts = np.unique(np.concatenate([g_at, at, [lo]]))
        cuts = cuts[(cuts >= lo) & (cuts < hi)]
        stops = np.append(cuts[1:], hi)
        by = np.argsort(at, kind="stable")
        d = by[np.searchsorted(at[by], cuts, "right") - 1] if len(at) else np.zeros(0, np.int64)
        g = np.searchsorted(g_at, cuts, "right") - 1
        ids = [np.frombuffer(x, "<u2") for x in docs.column("ids").to_pylist()]
        begin, size = cuts - at[d], stops - cuts
        parts = [ids[i][a : a + n] for i, a, n in zip(d.tolist(), begin.tolist(), size.tolist())]
        take = pa.array(d)
        return pa.table({
            "doc_id": docs.column("doc_id").take(take), "start": pa.array(docs.column("start").to_numpy()[d] + begin, pa.int64()), "length": pa.array(size, pa.int64()),
            "ids_crc32": pa.array([crc(x) for x in parts], pa.int64()), "doc_tokens": docs.column("doc_tokens").take(take),
            "sequence_id": pa.array(g_seq[g], pa.int64()), "offset": pa.array(g_used[g] + cuts - g_at[g], pa.int64()), "ids": pa.array([x.tobytes() for x in parts], pa.binary()),
        })

    return left.groupBy("stream").cogroup(right.groupBy("stream")).applyInArrow(lay, FILL_SCHEMA)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents")).drop("ids")


QUERIES = {"op1_packing": op1_packing}
