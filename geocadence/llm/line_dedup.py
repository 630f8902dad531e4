"""Line dedup: fuzzy lines by MinHash, one line kept per component.

1. Lines with a word are candidates. Equal lines are one node: a first pass over the texts signs the lines of each
   task once and sends packed records (a 128-bit key, the first place, the signature) to ranges of the key.
2. A line's set is its 8-character shingles, A-Z lower-cased (a shorter line is one shingle). One hash of
   each gives a bin and a value; 36 bins make 12 bands of 3, which lines of similarity 0.8 share with
   probability 0.9998 and those of 0.9 with 1 - 5e-7.
3. ``buckets.linked``: stars inside buckets, exact Jaccard of full shingle sets (0.8), distributed union-find, and
   a second look where a star may have missed a link. Pairs that share a bucket are verified unless fewer
   than FLOOR of the 36 values agree, whose probability at 0.8 is 3e-6 (the bands lose 2e-4); lines of fewer than 36 shingles, whose
   borrowed values are not independent, are verified whatever agrees.
4. Of each component the first line by (doc_id, text hash, line number) stays; all others go.

Cases: a null text has no lines; blank lines are never removed; lines and texts are taken whole, however long;
rows that repeat both doc_id and text are one document (the first line stays in each of them); of equal lines
the first place stays; null doc_ids come last; empty tables give empty results; extra columns of any name pass
through ``dedup_lines``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .buckets import by_part, dealt, linked, log2_parts, meet
from .common import IS_SPACE, LOWER, RADIX, as_i64, bloom_bits, bloom_has, drop_written, mix, reread, shuffle_partitions, slices, span_hash, table, text_bytes, written

SHINGLE = 8
ROWS, BANDS = 3, 12
BINS = ROWS * BANDS
SIMILAR = (80, 100)
FLOOR = 17
FLUSH = 1 << 15
CHARS_AT_ONCE = 1 << 15


def _lines(column: pa.Array) -> tuple:
    """Bytes, and start, end, row, number of every line with a word of a slice of texts."""
    buf, off = text_bytes(column)
    ends = np.flatnonzero(buf == 10)
    start = np.union1d(off[:-1][np.diff(off) > 0], ends + 1)
    start = start[start < len(buf)]
    row = np.searchsorted(off, start, "right") - 1
    stop = np.append(start[1:], len(buf)) if len(start) else start
    stop = stop - (buf[np.maximum(stop - 1, 0)] == 10) if len(start) else stop
    number = np.arange(len(start)) - np.searchsorted(row, row, "left")
    # the first byte that is no space stands before the end
    solid = np.append(np.flatnonzero(~IS_SPACE[buf]), len(buf))
    has = solid[np.searchsorted(solid, start)] < stop if len(start) else np.zeros(0, bool)
    return buf, start[has], stop[has], row[has], number[has]


def _keys(buf: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """n x 2: the 128-bit hash of each line's bytes."""
    raw, digest = buf.tobytes(), xxhash.xxh3_128_digest
    return np.frombuffer(b"".join([digest(raw[a:b]) for a, b in zip(start.tolist(), stop.tolist())]), "<u8").reshape(-1, 2)


def char_shingles(buf: np.ndarray, start: np.ndarray, stop: np.ndarray, k: int = SHINGLE) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """(hashes, spans, first span, last span + 1): all k-character shingles of a run of some CHARS_AT_ONCE bytes of
    spans at a time, so that work arrays stay in the cache; A-Z lower-cased. ``spans`` counts from the first one."""
    low = LOWER[buf]
    at = 0
    while at < len(start):
        end = max(at + 1, int(np.searchsorted(stop, start[at] + CHARS_AT_ONCE, "right")))
        lo, hi = int(start[at]), int(stop[end - 1])
        part = low[lo:hi]
        chars = np.frombuffer(part.tobytes().decode().encode("utf-32-le"), np.uint32)
        if len(chars) == len(part):
            a, b = start[at:end] - lo, stop[at:end] - lo
        else:
            upto = np.zeros(len(part) + 1, np.int32)
            np.cumsum((part & 0xC0) != 0x80, out=upto[1:])
            a, b = upto[start[at:end] - lo].astype(np.int64), upto[stop[at:end] - lo].astype(np.int64)
        # a polynomial of k characters by doubling; past the end of a span it is not looked at
        h, size, done = chars.astype(np.uint64) + np.uint64(1), 1, None
        power, offset, rest = RADIX, 0, k
        while True:
            if rest & 1:
                done = h if done is None else done[: max(0, len(h) - offset)] + np.uint64(pow(RADIX, offset, 1 << 64)) * h[offset:][: len(done)]
                offset += size
            rest >>= 1
            if not rest:
                break
            h = h[: max(0, len(h) - size)] + np.uint64(power) * h[size:]
            size, power = 2 * size, power * power & (1 << 64) - 1
        n = b - a - k + 1
        whole = np.flatnonzero(n > 0)
        inside = np.zeros(len(chars) + 1, np.int8)
        inside[a[whole]] += 1
        inside[b[whole] - k + 1] -= 1
        g = mix(done[np.cumsum(inside[: len(done)], dtype=np.int8).view(bool)])
        of = np.repeat(whole, n[whole])
        short = np.flatnonzero((n <= 0) & (b > a))
        if len(short):
            g = np.concatenate([g, mix(span_hash(chars.astype(np.uint64) * np.uint64(2) + np.uint64(1), a[short], b[short]))])
            of = np.concatenate([of, short])
        yield g, of, at, end
        at = end


def line_signatures(buf: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """n x BINS least 16-bit values of the spans, and which have fewer shingles than bins; an empty bin borrows from a
    filled one that a hash of (bin, attempt) picks."""
    n = len(start)
    all_, count = np.full((n, BINS), 0xFFFFFFFF, np.uint32), np.zeros(n, np.int64)
    for g, of, lo, hi in char_shingles(buf, start, stop):
        sig = all_[lo:hi].reshape(-1)
        bin_ = (g >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)
        # the low half of a mixed hash does not follow its high half, which is the bin
        np.minimum.at(sig, of * BINS + bin_.view(np.int64), g.astype(np.uint32))
        count[lo:hi] = np.bincount(of, minlength=hi - lo)
    empty = all_ == 0xFFFFFFFF
    rest = np.flatnonzero(empty.any(axis=1) & ~empty.all(axis=1))
    part, hole = all_[rest], empty[rest]
    attempt = 0
    numbers = np.arange(BINS, dtype=np.uint64)
    own = part.copy()
    gone = hole.copy()
    while gone.any():
        pick = (mix(numbers * np.uint64(1000003) + np.uint64(attempt + 1)) % np.uint64(BINS)).astype(np.int64)
        r, c = np.nonzero(gone & ~hole[:, pick])
        part[r, c] = own[r, pick[c]]
        gone[r, c] = False
        attempt += 1
    all_[rest] = part
    return (mix(all_.astype(np.uint64)) >> np.uint64(48)).astype(np.uint16), count < BINS


RECORD = np.dtype([("k", "<u8", 2), ("last", "u1"), ("doc", "<i8"), ("th", "<i8"), ("no", "<i4"), ("n", "<i8"), ("few", "u1"), ("sig", "<u2", BINS)])
NODE_SCHEMA = "k1 long, k2 long, doc_id long, thash long, line_no int, n long, few boolean, sig binary"


def _first_places(x: np.ndarray) -> np.ndarray:
    """One record per key: its first place, with the number of places."""
    x = x[np.lexsort((x["no"], x["th"], x["doc"], x["last"], x["k"][:, 1], x["k"][:, 0]))]
    new = np.append(True, (x["k"][1:] != x["k"][:-1]).any(axis=1)) if len(x) else np.zeros(0, bool)
    start = np.flatnonzero(new)
    out = x[start]
    if len(x):
        out["n"] = np.add.reduceat(x["n"], start)
    return out


def line_nodes(docs: DataFrame) -> DataFrame:
    """(id, k1, k2, doc_id, thash, line_no, n, few, sig): distinct lines, their first place and number of places."""
    partitions = shuffle_partitions(docs.sparkSession)
    log2 = log2_parts(partitions)

    def block(held: list[np.ndarray]) -> pa.RecordBatch:
        x = _first_places(np.concatenate(held))
        parts, blobs = dealt(x["k"][:, 0], x, log2)
        return pa.record_batch({"part": pa.array(parts, pa.int32()), "blob": pa.array(blobs, pa.binary())})

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            for part in slices(batch, "text"):
                buf, start, stop, row, number = _lines(part.column("text"))
                doc = part.column("doc_id").cast(pa.int64())
                x = np.zeros(len(start), RECORD)
                x["k"], x["no"], x["n"] = _keys(buf, start, stop), number, 1
                x["last"] = doc.is_null().to_numpy(zero_copy_only=False)[row]
                x["doc"] = doc.fill_null(0).to_numpy()[row]
                x["th"] = part.column("thash").to_numpy()[row]
                # equal lines of a slice are signed once
                order = np.lexsort((x["k"][:, 1], x["k"][:, 0]))
                k = x["k"][order]
                new = np.append(True, (k[1:] != k[:-1]).any(axis=1)) if len(k) else np.zeros(0, bool)
                once, back = order[new], np.cumsum(new) - 1
                # in the order of the text, so that a run of lines is a run of bytes
                by_place = np.argsort(once)
                sig, few = np.empty((len(once), BINS), np.uint16), np.empty(len(once), bool)
                sig[by_place], few[by_place] = line_signatures(buf, start[once[by_place]], stop[once[by_place]])
                x["sig"][order], x["few"][order] = sig[back], few[back]
                held.append(_first_places(x))
                if sum(map(len, held)) >= FLUSH:
                    yield block(held)
                    held = []
        if held:
            yield block(held)

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in by_part(batches, RECORD):
            x = _first_places(x)
            k = np.ascontiguousarray(x["k"])
            raw = np.ascontiguousarray(x["sig"]).tobytes()
            yield pa.record_batch({
                "k1": pa.array(as_i64(k[:, 0])), "k2": pa.array(as_i64(k[:, 1])),
                "doc_id": pa.array(np.ascontiguousarray(x["doc"]), mask=x["last"] > 0), "thash": pa.array(np.ascontiguousarray(x["th"])),
                "line_no": pa.array(np.ascontiguousarray(x["no"])), "n": pa.array(np.ascontiguousarray(x["n"])), "few": pa.array(x["few"] > 0),
                "sig": pa.array([raw[i : i + 2 * BINS] for i in range(0, len(raw), 2 * BINS)], pa.binary()),
            })

    blocks = docs.select("doc_id", F.xxhash64("text").alias("thash"), "text").mapInArrow(make, "part int, blob binary")
    nodes = meet(blocks, partitions).mapInArrow(group, NODE_SCHEMA)
    # numbered once: later readers see the written numbers
    return written(nodes.withColumn("id", F.monotonically_increasing_id()), "line-nodes")


def line_texts(docs: DataFrame, nodes: DataFrame):
    """A function from wanted ids to (id, text): the texts are scanned once, behind a filter of bounded size."""

    def of(ids: DataFrame) -> DataFrame:
        wanted = written(nodes.select("id", "k1", "k2").join(ids, "id"), "wanted")
        held = docs.sparkSession.sparkContext.broadcast(bloom_bits(wanted, "k1"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                # a task sends a line that it has just sent no second time
                sent: set[bytes] = set()
                for part in slices(batch, "text"):
                    buf, start, stop, _, _ = _lines(part.column("text"))
                    k = _keys(buf, start, stop)
                    hit = np.flatnonzero(bloom_has(held.value, as_i64(k[:, 0])))
                    hit = [i for i in hit.tolist() if (x := k[i].tobytes()) not in sent and not sent.add(x)]
                    raw = buf.tobytes()
                    texts = [raw[a:b].decode() for a, b in zip(start[hit].tolist(), stop[hit].tolist())]
                    yield pa.record_batch({"k1": pa.array(as_i64(k[hit, 0])), "k2": pa.array(as_i64(k[hit, 1])), "text": pa.array(texts, pa.string())})

        found = docs.select("text").mapInArrow(run, "k1 long, k2 long, text string")
        # the same line comes from many slices; one text each is enough
        return found.join(reread(wanted), ["k1", "k2"]).select("id", "text").dropDuplicates(["id"])

    return of


def _line_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of each text, as 48 bits of their hashes below 16 bits of its place in the run."""
    buf, off = text_bytes(column)
    values, counts = [], []
    for g, of, lo, hi in char_shingles(buf, off[:-1], off[1:]):
        key = np.sort(of.astype(np.uint64) << np.uint64(48) | g >> np.uint64(16))
        key = key[np.append(True, key[1:] != key[:-1])] if len(key) else key
        counts.append(np.bincount((key >> np.uint64(48)).astype(np.int64), minlength=hi - lo))
        values.append(key & np.uint64((1 << 48) - 1))
    none = np.zeros(0, np.uint64)
    return np.concatenate(values or [none]), np.concatenate([[0], np.cumsum(np.concatenate(counts or [none.astype(np.int64)]))])


def kept_places(docs: DataFrame) -> DataFrame:
    """(k1, k2, doc_id, thash, line_no) of every line that stands in several places or has a link: the one place of
    its component that stays."""
    nodes = line_nodes(docs)
    label = linked(nodes.select("id", "sig", "few"), line_texts(docs, reread(nodes)), _line_sets, BINS, ROWS, SIMILAR, FLOOR)
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "thash", "line_no").alias("place")
    own = reread(nodes).select("k1", "k2", "id", "n", place)
    # written in between, so that a component of many lines is a skewed join, which Spark splits, and never a group
    first = written(label.join(own, F.col("node") == F.col("id")).groupBy("component").agg(F.min("place").alias("first")), "firsts")
    by_node = written(label.join(first, "component").select("node", "first"), "node-firsts")
    out = own.join(by_node, F.col("id") == F.col("node"), "left").where("n > 1 OR first IS NOT NULL")
    out = written(out.select("k1", "k2", F.coalesce("first", "place").alias("first")).select("k1", "k2", "first.doc_id", "first.thash", "first.line_no"), "kept-places")
    for x in (nodes, first, by_node):
        drop_written(x)
    return out


def decisions(docs: DataFrame) -> DataFrame:
    """uid, doc_id, thash, n_lines, line_no, chars (of all lines with a word), removed (line numbers, ascending), one row
    per row of ``docs`` (doc_id, text)."""
    kept = kept_places(docs)
    held = docs.sparkSession.sparkContext.broadcast(bloom_bits(kept, "k1"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = held.value
        for batch in batches:
            for part in slices(batch, "text"):
                buf, start, stop, row, number = _lines(part.column("text"))
                heads = np.zeros(len(buf) + 1, np.int32)
                np.cumsum((buf & 0xC0) != 0x80, out=heads[1:])
                k = _keys(buf, start, stop)
                off = np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32)
                # lines that may have another place
                hit = bloom_has(wanted, as_i64(k[:, 0]))
                some = np.searchsorted(row[hit], np.arange(part.num_rows + 1)).astype(np.int32)
                lists = lambda o, x, t: pa.ListArray.from_arrays(pa.array(o), pa.array(np.ascontiguousarray(x), t))
                yield pa.record_batch({
                    "uid": part.column("uid"), "doc_id": part.column("doc_id").cast(pa.int64()), "thash": part.column("thash"),
                    "line_no": lists(off, number, pa.int32()), "chars": lists(off, heads[stop] - heads[start], pa.int32()),
                    "seen_no": lists(some, number[hit], pa.int32()), "seen_k1": lists(some, as_i64(k[hit, 0]), pa.int64()), "seen_k2": lists(some, as_i64(k[hit, 1]), pa.int64()),
                })

    base = docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", F.xxhash64("text").alias("thash"), "text")
    schema = "uid long, doc_id long, thash long, line_no array<int>, chars array<int>, seen_no array<int>, seen_k1 array<long>, seen_k2 array<long>"
    lines = written(base.mapInArrow(run, schema), "lines")
    seen = lines.select("uid", "doc_id", "thash", F.explode(F.arrays_zip("seen_no", "seen_k1", "seen_k2")).alias("s"))
    seen = seen.select("uid", "doc_id", "thash", F.col("s.seen_no").alias("line_no"), F.col("s.seen_k1").alias("k1"), F.col("s.seen_k2").alias("k2"))
    stay = kept.select("k1", "k2", F.struct("doc_id", "thash", "line_no").alias("stay"))
    # a line of many places is a skewed join, which Spark splits as long as nothing is grouped in the same stage
    gone = written(seen.join(stay, ["k1", "k2"]).where(~F.struct("doc_id", "thash", "line_no").eqNullSafe(F.col("stay"))).select("uid", "line_no"), "gone-lines")
    by_doc = gone.groupBy("uid").agg(F.sort_array(F.collect_list("line_no")).alias("removed"))
    out = reread(lines).join(by_doc, "uid", "left")
    none = F.expr("CAST(array() AS array<int>)")
    return out.select("uid", "doc_id", "thash", F.size("line_no").cast("long").alias("n_lines"), "line_no", "chars", F.coalesce("removed", none).alias("removed"))


def dedup_lines(docs: DataFrame, drop_emptied: bool = True) -> DataFrame:
    """``docs`` with the removed lines cut out of ``text`` (and n_chars brought up to date, if there).

    With ``drop_emptied`` a document goes when lines were removed and no word is left.
    """
    cols = docs.columns
    gone = decisions(docs.select("doc_id", "text")).where(F.size("removed") > 0)
    # rows that repeat doc_id and text lose the same lines
    gone = gone.select(F.col("doc_id").alias("_gone_id"), F.col("thash").alias("_gone_hash"), F.col("removed").alias("_gone")).dropDuplicates(["_gone_id", "_gone_hash"])
    row = F.col("_row")
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("_row"))
    out = own.join(gone, row["doc_id"].cast("long").eqNullSafe(F.col("_gone_id")) & (F.xxhash64(row["text"]) == F.col("_gone_hash")), "left")
    cut = F.array_join(F.filter(F.split(row["text"], "\n"), lambda x, i: ~F.array_contains("_gone", i)), "\n")
    out = out.withColumn("_text", F.when(F.col("_gone").isNull(), row["text"]).otherwise(cut))
    if drop_emptied:
        out = out.where(F.col("_gone").isNull() | F.col("_text").rlike(r"[^\x20\x09-\x0D]"))
    new = {"text": F.col("_text"), "n_chars": F.when(F.col("_gone").isNull(), row["n_chars"]).otherwise(F.char_length("_text").cast("long")) if "n_chars" in cols else None}
    return out.select(*[new.get(c, row[c]).alias(c) for c in cols])


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: lines with a word, removed ones, characters of the others, numbers of the removed lines."""
    d = decisions(table(spark, sf_dir, "documents").select("doc_id", "text"))
    stays = F.filter(F.arrays_zip("line_no", "chars"), lambda x: ~F.array_contains("removed", x["line_no"]))
    chars = F.aggregate(stays, F.lit(0).cast("long"), lambda acc, x: acc + x["chars"])
    return d.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), chars.alias("kept_chars"), F.col("removed").alias("removed_lines"))


QUERIES = {"op2_line_dedup": op2_line_dedup}
