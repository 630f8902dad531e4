"""Candidate search shared by the near-duplicate operators: banded buckets, stars, components.

Nodes are distinct texts with a MinHash signature of ``bins`` 16-bit values. ``rows`` consecutive values make
a band, a band's values a bucket. What is done with the buckets:

1. (bucket, node) pairs travel in packed blocks, sorted and combined by the tasks that make them, and meet by
   ranges of the bucket's hash; only nodes that share a bucket go on. A bucket that fills a task's block
   (``HEAVY`` of ``FLUSH`` nodes) sends its least and greatest node there; its members are dealt at random.
2. Inside a bucket, nodes whose signatures agree in at least ``floor`` of the bins (or have too few shingles for
   that to mean much: ``few``) belong together; such a group is a star around its least node, so n members
   give n - 1 pairs. The floor lies so far below the similarity that it loses less than the bands do; the
   callers state by how much.
3. Star pairs are verified on full sets, and their links make components (large and small stars).
4. A star can miss a link between two members that are both unlike its centre. In groups that span several
   components all alike pairs that lie across components are verified inside a task, each in the first band
   that it shares. Only links leave that task.

Buckets of more than ``BLOCK`` nodes are one group without step 2's search. Before step 4 each member outside its
largest component is paired with the most alike one of another and verified, which joins most of what belongs
together; in step 4 those still outside are dealt against all others in blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RADIX, as_i64, drop_written, mix, reread, shuffle_partitions, slices, written
from .graph import components

FLUSH = 1 << 16
HEAVY = 64
BLOCK = 1024
PAIRS_AT_ONCE = 1 << 15
PAIRS_PER_GROUP = 2000
MEMBERS_PER_SALT = 256
PART_BYTES = 32 << 20

Sets = Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    n, bins = sig.shape
    x = np.broadcast_to(np.arange(bins // rows, dtype=np.uint64)[None, :] + np.uint64(1), (n, bins // rows)).copy()
    s = sig.reshape(n, bins // rows, rows).astype(np.uint64)
    for i in range(rows):
        x = mix(x * np.uint64(RADIX) + s[:, :, i])
    return x


def unpacked(column: pa.Array, bins: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, bins)


# ---------------------------------------------------------------- packed blocks


def dealt(keys: np.ndarray, records: np.ndarray, log2: int) -> tuple[list[int], list[bytes]]:
    """Records sorted by their 64-bit keys, as (part, bytes) of the 2**log2 ranges of keys."""
    part = (keys >> np.uint64(64 - log2)).astype(np.int64) if log2 else np.zeros(len(keys), np.int64)
    cut = np.flatnonzero(np.diff(part)) + 1
    at = [0, *cut.tolist(), len(part)] if len(part) else [0]
    return [int(part[a]) for a in at[:-1]], [records[a:b].tobytes() for a, b in zip(at, at[1:])]


def by_part(batches: Iterator[pa.RecordBatch], dtype) -> Iterator[np.ndarray]:
    """Records of each part of batches sorted by part."""
    held: list[bytes] = []
    last = None
    for batch in batches:
        for p, blob in zip(batch.column("part").to_pylist(), batch.column("blob").to_pylist()):
            if p != last and held:
                yield np.frombuffer(b"".join(held), dtype)
                held = []
            last = p
            held.append(blob)
    if held:
        yield np.frombuffer(b"".join(held), dtype)


def meet(blocks: DataFrame, partitions: int) -> DataFrame:
    return blocks.repartition(partitions, "part").sortWithinPartitions("part")


def log2_parts(partitions: int) -> int:
    """Several parts a partition, so that each is small and partitions are even."""
    return max(0, (8 * partitions - 1).bit_length())


# ---------------------------------------------------------------- buckets

ENTRY = np.dtype([("bucket", "<u8"), ("id", "<i8")])


def shared_members(nodes: DataFrame, bins: int, rows: int) -> DataFrame:
    """(bucket, id, a, n) of nodes that share a bucket: a is its least node, n its number of nodes."""
    spark = nodes.sparkSession
    bands, count = bins // rows, nodes.count()
    partitions = max(shuffle_partitions(spark), -(-count * bands * ENTRY.itemsize // PART_BYTES))
    log2, flush_at, heavy_at = log2_parts(partitions), max(1, FLUSH // bands * 4), HEAVY

    def pack(ids: np.ndarray, sig: np.ndarray) -> Iterator[pa.RecordBatch]:
        flat = band_keys(sig, rows).reshape(-1)
        order = np.argsort(flat)
        one = np.empty(len(flat), ENTRY)
        one["bucket"], one["id"] = flat[order], np.repeat(ids, bands)[order]
        start = np.flatnonzero(np.append(True, one["bucket"][1:] != one["bucket"][:-1]))
        size = np.diff(np.append(start, len(one)))
        crowd = np.repeat(size >= heavy_at, size)
        if crowd.any():
            big = one[crowd]
            big = big[np.lexsort((big["id"], big["bucket"]))]
            first = np.append(True, big["bucket"][1:] != big["bucket"][:-1])
            ends = first | np.append(first[1:], True)
            light = np.concatenate([one[~crowd], big[ends]])
            light, big = light[np.argsort(light["bucket"])], big[~ends]
            spread = mix(big["id"].astype(np.uint64))
            rest = np.argsort(spread)
            parts, blobs = dealt(spread[rest], big[rest], log2)
            yield pa.record_batch({"part": pa.array(parts, pa.int32()), "heavy": pa.array([True] * len(parts)), "blob": pa.array(blobs, pa.binary())})
            one = light
        parts, blobs = dealt(one["bucket"], one, log2)
        yield pa.record_batch({"part": pa.array(parts, pa.int32()), "heavy": pa.array([False] * len(parts)), "blob": pa.array(blobs, pa.binary())})

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[np.ndarray] = []
        sigs: list[np.ndarray] = []
        held = 0
        for batch in batches:
            if batch.num_rows:
                ids.append(batch.column("id").to_numpy())
                sigs.append(unpacked(batch.column("sig"), bins))
                held += batch.num_rows
            if held >= flush_at:
                yield from pack(np.concatenate(ids), np.concatenate(sigs))
                ids, sigs, held = [], [], 0
        if held:
            yield from pack(np.concatenate(ids), np.concatenate(sigs))

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def split() -> Iterator[pa.RecordBatch]:
            # blocks of crowded buckets pass through; their centres come from the others
            for batch in batches:
                crowd = batch.column("heavy").to_numpy(zero_copy_only=False)
                for blob in batch.column("blob").filter(pa.array(crowd)).to_pylist():
                    direct.append(np.frombuffer(blob, ENTRY))
                yield batch.filter(pa.array(~crowd))

        direct: list[np.ndarray] = []
        for x in by_part(split(), ENTRY):
            bucket, order = np.unique(x["bucket"], return_inverse=True)
            x = x[np.bincount(order)[order] > 1]
            x = x[np.lexsort((x["id"], x["bucket"]))]
            start = np.flatnonzero(np.append(True, x["bucket"][1:] != x["bucket"][:-1])) if len(x) else np.zeros(0, np.int64)
            size = np.diff(np.append(start, len(x)))
            yield rows_of(x, np.repeat(x["id"][start], size), np.repeat(size, size))
            while direct:
                yield rows_of(direct.pop())
        while direct:
            yield rows_of(direct.pop())

    def rows_of(x: np.ndarray, a: np.ndarray | None = None, n: np.ndarray | None = None) -> pa.RecordBatch:
        none = pa.nulls(len(x), pa.int64())
        own = pa.array(as_i64(np.ascontiguousarray(x["bucket"]))), pa.array(np.ascontiguousarray(x["id"]))
        return pa.record_batch(dict(zip(("bucket", "id", "a", "n"), (*own, none if a is None else pa.array(a), none if n is None else pa.array(n)))))

    blocks = nodes.select("id", "sig").mapInArrow(make, "part int, heavy boolean, blob binary")
    out = written(meet(blocks, partitions).mapInArrow(group, "bucket long, id long, a long, n long"), "bucket-members")
    loose = out.where("a IS NULL")
    if not loose.head(1):
        return out
    more = loose.groupBy("bucket").agg(F.count("*").alias("_more"))
    centres = out.where("a = id").join(more, "bucket").select("bucket", F.col("a").alias("_a"), (F.col("n") + F.col("_more")).alias("_n"))
    centres = written(centres, "crowded-buckets")
    crowd = reread(out).where("a IS NULL").select("bucket", "id").join(centres, "bucket").select("bucket", "id", F.col("_a").alias("a"), F.col("_n").alias("n"))
    both = out.where("a IS NOT NULL").join(centres, "bucket", "left").select("bucket", "id", "a", F.coalesce("_n", "n").alias("n"))
    return written(both.unionByName(crowd), "all-members")


# ---------------------------------------------------------------- groups inside buckets


def whole_groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], least: int = 8192) -> Iterator[pa.RecordBatch]:
    """Runs of whole groups of batches sorted by ``keys``, of at least ``least`` rows if there are as many."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def joined() -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        return t.to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < least:
            continue
        one = joined()
        cut = np.flatnonzero(edges(one, keys))[-1]
        held, rows = [one], one.num_rows
        if cut:
            yield one.slice(0, cut)
            held, rows = [one.slice(cut)], one.num_rows - cut
        else:
            least = 2 * rows
    if held:
        yield joined()


def edges(batch: pa.RecordBatch, keys: tuple[str, ...]) -> np.ndarray:
    """True where a group starts."""
    new = np.zeros(batch.num_rows, bool)
    new[:1] = True
    for k in keys:
        x = batch.column(batch.schema.get_field_index(k)).to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return new


def pairs_within(new: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs i < j of one group, some PAIRS_AT_ONCE at a time; ``new`` is true where a group starts."""
    n = len(new)
    end = np.append(np.flatnonzero(new)[1:], n)[np.cumsum(new) - 1]
    partners = end - np.arange(n) - 1
    upto = np.cumsum(partners)
    at = 0
    while at < n:
        base = upto[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(upto, base + PAIRS_AT_ONCE, "right")))
        k = partners[at:stop]
        i = np.repeat(np.arange(at, stop), k)
        if len(i):
            yield i, i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(k) - k, k)
        at = stop


def least_reached(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Least index reachable over the edges (i, j)."""
    lab = np.arange(n)
    while len(i):
        m = np.minimum(lab[i], lab[j])
        new = lab.copy()
        np.minimum.at(new, i, m)
        np.minimum.at(new, j, m)
        new = new[new]
        if (new == lab).all():
            break
        lab = new
    return lab


def alike_groups(members: DataFrame, nodes: DataFrame, bins: int, floor: int) -> DataFrame:
    """(bucket, a, id, n, few, sig): groups of nodes of one bucket, each with its least node ``a``."""
    known = nodes.select("id", "few", "sig")
    small = members.where(F.col("n") <= BLOCK).select("bucket", "id").join(known, "id")
    large = members.where(F.col("n") > BLOCK).join(known, "id").select("bucket", "a", "id", "n", "few", "sig")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ("bucket",)):
            sig, few = unpacked(t.column("sig"), bins), t.column("few").to_numpy(zero_copy_only=False)
            own = lab = np.arange(t.num_rows)
            for i, j in pairs_within(edges(t, ("bucket",))):
                # what is joined already needs no look, and no pair is held longer than its run
                apart = lab[i] != lab[j]
                i, j = i[apart], j[apart]
                ok = ((sig[i] == sig[j]).sum(axis=1) >= floor) | few[i] | few[j]
                if ok.any():
                    lab = least_reached(t.num_rows, np.concatenate([i[ok], own]), np.concatenate([j[ok], lab]))
            size = np.bincount(lab, minlength=t.num_rows)[lab]
            keep = np.flatnonzero(size > 1)
            if not len(keep):
                continue
            # rows of a bucket are sorted by id, so the least index is the least node
            ids = t.column("id").to_numpy()
            out = t.take(pa.array(keep))
            yield pa.record_batch({
                "bucket": out.column("bucket"), "a": pa.array(ids[lab[keep]]), "id": out.column("id"), "n": pa.array(size[keep].astype(np.int64)), "few": out.column("few"), "sig": out.column("sig"),
            })

    found = small.repartition("bucket").sortWithinPartitions("bucket", "id").select("bucket", "id", "few", "sig").mapInArrow(run, "bucket long, a long, id long, n long, few boolean, sig binary")
    return written(found.unionByName(large), "alike-groups")


# ---------------------------------------------------------------- verification


def verified(pairs: DataFrame, texts: DataFrame, sets: Sets, similar: tuple[int, int]) -> DataFrame:
    """The (a, b) of ``pairs`` (a written table) whose sets reach the similarity, intersected in full.

    ``texts`` is (id, text) of all their nodes; ``sets(column)`` gives hashes and offsets per row. Pairs are
    dealt by their centre in groups of bounded size, a centre with many partners over several groups, each
    with one copy of the centre's text.
    """
    degree = pairs.groupBy("a").agg(F.count("*").alias("n"))
    shards = max(1, pairs.count() // PAIRS_PER_GROUP)
    keyed = pairs.join(degree, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / MEMBERS_PER_SALT)))
    keyed = written(keyed.select("a", "b", F.pmod(F.xxhash64("a", "salt"), F.lit(shards)).alias("shard")), "dealt-pairs")
    centres = keyed.select("shard", F.col("a").alias("id")).distinct().join(texts, "id").select("shard", F.col("id").alias("a"), "text")
    members = reread(keyed).withColumnRenamed("b", "id").join(reread(texts), "id").select("shard", "a", F.col("id").alias("b"), "text")

    def check(m: pa.Table, c: pa.Table) -> pa.Table:
        where: dict[int, int] = {a: i for i, a in enumerate(c.column("a").to_pylist())}
        centre = [x for part in _parts(c) for x in _split(*sets(part.column("text")))]
        keep_a, keep_b = [], []
        for part in _parts(m):
            for a, b, x in zip(part.column("a").to_pylist(), part.column("b").to_pylist(), _split(*sets(part.column("text")))):
                if alike(x, centre[where[a]], similar):
                    keep_a.append(a)
                    keep_b.append(b)
        return pa.table({"a": pa.array(keep_a, pa.int64()), "b": pa.array(keep_b, pa.int64())})

    out = written(members.groupBy("shard").cogroup(centres.groupBy("shard")).applyInArrow(check, "a long, b long"), "verified")
    drop_written(keyed)
    return out


def alike(x: np.ndarray, y: np.ndarray, similar: tuple[int, int]) -> bool:
    """Whether two sorted sets reach the similarity."""
    up, down = similar
    if len(x) > len(y):
        x, y = y, x
    if not len(x) or len(x) * down < up * len(y):
        return False
    at = np.searchsorted(y, x)
    both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
    return down * both >= up * (len(x) + len(y) - both)


MARKS = 128


def marks(values: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Per set (``n`` values each) the least tag of its values in each of MARKS ranges of their hashes."""
    x = mix(values)
    out = np.full((len(n), MARKS), 0xFFFF, np.uint16)
    np.minimum.at(out.reshape(-1), np.repeat(np.arange(len(n)), n) * MARKS + (x >> np.uint64(57)).astype(np.int64), x.astype(np.uint16))
    return out


def may_be_alike(mark: np.ndarray, n: np.ndarray, i: np.ndarray, j: np.ndarray, similar: tuple[int, int]) -> np.ndarray:
    """False for pairs that surely miss the similarity: where marks of a range differ, one of the sets has a value there
    that the other lacks, so at least as many values are in one set only, and at least as many as the sizes differ by."""
    up, down = similar
    both, apart = n[i] + n[j], np.maximum((mark[i] != mark[j]).sum(axis=1), np.abs(n[i] - n[j]))
    return down * (both - apart) >= up * (both + apart)


def _parts(t: pa.Table) -> Iterator[pa.RecordBatch]:
    for batch in t.combine_chunks().to_batches():
        yield from slices(batch, "text")


def _split(values: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    return [values[a:b] for a, b in zip(off[:-1], off[1:])]


# ---------------------------------------------------------------- links off the stars


def open_members(groups: DataFrame, label: DataFrame) -> DataFrame:
    """(bucket, a, p, q, id, component, side, few, sig) of groups of three or more that span components.

    A group of at most BLOCK is one block. Of a larger one the members outside its largest component (side 1) are
    cut into blocks p, all members (side 0) into blocks q, and each block p meets each q.
    """
    known = groups.where("n > 2").select("bucket", "a", "id", "n").join(label, F.col("id") == F.col("node"), "left")
    known = known.select("bucket", "a", "id", "n", F.coalesce("component", "id").alias("component"))
    size = known.groupBy("bucket", "a", "component").agg(F.count("*").alias("k"))
    most = size.groupBy("bucket", "a").agg(F.max(F.struct("k", "component")).alias("m"), F.sum("k").alias("all"), F.count("*").alias("kinds")).where("kinds > 1")
    spread = most.select(F.col("bucket").alias("_bucket"), F.col("a").alias("_a"), F.col("m.component").alias("main"), F.col("all").alias("all"), (F.col("all") - F.col("m.k")).alias("others"))
    spread = written(spread, "open-groups")
    back = groups.where("n > 2").join(spread, (F.col("bucket") == F.col("_bucket")) & (F.col("a") == F.col("_a")))
    back = back.join(label, F.col("id") == F.col("node"), "left").withColumn("component", F.coalesce("component", "id"))
    blocks = F.when(F.col("all") <= BLOCK, F.lit(1)).otherwise(F.ceil(F.col("all") / BLOCK)).cast("int")
    rest = F.when(F.col("all") <= BLOCK, F.lit(1)).otherwise(F.ceil(F.col("others") / BLOCK)).cast("int")
    mine = lambda k: F.pmod(F.xxhash64("id"), k).cast("int")
    base = ["bucket", "a", "id", "component", "few", "sig"]
    right = back.select(*base, mine(blocks).alias("q"), F.explode(F.sequence(F.lit(0), rest - 1)).alias("p"), F.lit(0).alias("side"))
    left = back.where((F.col("all") > BLOCK) & (F.col("component") != F.col("main"))).select(*base, mine(rest).alias("p"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("q"), F.lit(1).alias("side"))
    return right.unionByName(left)


GROUP = ("bucket", "a", "p", "q")


def _eligible(t: pa.RecordBatch, bins: int, rows: int, floor: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Index pairs across components that are alike by signature, not yet verified, and in the first band that they
    share; with the number of bins that agree."""
    sig, few = unpacked(t.column("sig"), bins), t.column("few").to_numpy(zero_copy_only=False)
    ids, centre, comp, side = (t.column(c).to_numpy() for c in ("id", "a", "component", "side"))
    new = edges(t, GROUP)
    group = np.cumsum(new) - 1
    sided = np.bincount(group, side)[group] > 0
    band = (as_i64(band_keys(sig, rows)).reshape(len(sig), -1) == t.column("bucket").to_numpy()[:, None]).argmax(axis=1)
    for i, j in pairs_within(new):
        ok = (comp[i] != comp[j]) & (ids[i] != centre[i]) & (ids[j] != centre[j]) & (ids[i] != ids[j])
        ok &= ~sided[i] | (side[i] != side[j])
        i, j = i[ok], j[ok]
        if not len(i):
            continue
        same = sig[i] == sig[j]
        agree = same.sum(axis=1)
        first = same.reshape(len(i), bins // rows, rows).all(axis=2).argmax(axis=1) == band[i]
        ok = ((agree >= floor) | few[i] | few[j]) & first
        if ok.any():
            yield i[ok], j[ok], agree[ok]


LAST = (1 << 32) - 1


def best_pairs(members: DataFrame, bins: int, rows: int, floor: int) -> DataFrame:
    """Each member with the most alike eligible one of another component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, GROUP):
            # per member the bins that agree, and below them the partner, the least one greatest; rows of a group are
            # sorted by id. Only this is held, since the pairs of a few blocks are many millions
            best = np.zeros(t.num_rows, np.int64)
            for i, j, agree in _eligible(t, bins, rows, floor):
                np.maximum.at(best, i, (agree + 1) << 32 | LAST - j)
                np.maximum.at(best, j, (agree + 1) << 32 | LAST - i)
            x = np.flatnonzero(best)
            if not len(x):
                continue
            ids = t.column("id").to_numpy()
            y = LAST - (best[x] & LAST)
            both = np.unique(np.stack([np.minimum(ids[x], ids[y]), np.maximum(ids[x], ids[y])], axis=1), axis=0)
            yield pa.record_batch({"a": pa.array(np.ascontiguousarray(both[:, 0])), "b": pa.array(np.ascontiguousarray(both[:, 1]))})

    return members.repartition(*GROUP).sortWithinPartitions(*GROUP, "id").mapInArrow(run, "a long, b long").distinct()


LEFT = "bucket long, a long, p int, q int, id long, component long, side int, few boolean, sig binary"


def still_open(members: DataFrame, bins: int, rows: int, floor: int) -> DataFrame:
    """The members that have an eligible partner."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, GROUP):
            hit = np.zeros(t.num_rows, bool)
            for i, j, _ in _eligible(t, bins, rows, floor):
                hit[i] = hit[j] = True
            if hit.any():
                yield t.filter(pa.array(hit))

    order = [x.split()[0] for x in LEFT.split(", ")]
    return members.repartition(*GROUP).sortWithinPartitions(*GROUP, "id").select(*order).mapInArrow(run, LEFT)


def inside_links(members: DataFrame, texts: DataFrame, sets: Sets, bins: int, rows: int, floor: int, similar: tuple[int, int]) -> DataFrame:
    """All links across components inside what is still open, less those that others of the same task imply."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, GROUP, 256):
            ids, comp = t.column("id").to_numpy(), t.column("component").to_numpy().copy()
            kinds, comp = np.unique(comp, return_inverse=True)
            root = np.arange(len(kinds))

            def find(x: int) -> int:
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            some = [sets(part.column("text")) for part in slices(t, "text")]
            values, n = np.concatenate([x for x, _ in some]), np.concatenate([np.diff(off) for _, off in some])
            own, mark = _split(values, np.append(0, np.cumsum(n))), marks(values, n)
            out: list[tuple[int, int]] = []
            for i, j, _ in _eligible(t, bins, rows, floor):
                now = np.array([find(k) for k in range(len(kinds))])[comp]
                ok = now[i] != now[j]
                i, j = i[ok], j[ok]
                ok = may_be_alike(mark, n, i, j, similar)
                for x, y in zip(i[ok].tolist(), j[ok].tolist()):
                    if find(comp[x]) != find(comp[y]) and alike(own[x], own[y], similar):
                        root[find(comp[x])] = find(comp[y])
                        out.append((min(ids[x], ids[y]), max(ids[x], ids[y])))
            if out:
                yield pa.record_batch({"a": pa.array([x[0] for x in out], pa.int64()), "b": pa.array([x[1] for x in out], pa.int64())})

    full = members.join(texts, "id")
    return full.repartition(*GROUP).sortWithinPartitions(*GROUP, "id").mapInArrow(run, "a long, b long").distinct()


def linked(nodes: DataFrame, texts: Callable[[DataFrame], DataFrame], sets: Sets, bins: int, rows: int, similar: tuple[int, int], floor: int) -> DataFrame:
    """(node, component) of all ``nodes`` (id, sig, few; a written table) that have a link.

    ``texts(ids)`` gives (id, text) of wanted nodes and is called once; it may give null for one that it lacks.
    """
    none = nodes.sparkSession.createDataFrame([], "node long, component long")
    members = shared_members(nodes, bins, rows)
    if not members.head(1):
        return none
    groups = alike_groups(members, nodes, bins, floor)
    drop_written(members)
    if not groups.head(1):
        return none
    near = written(texts(groups.select("id").distinct()), "near-texts")
    pairs = written(groups.where("id <> a").select("a", F.col("id").alias("b")).distinct(), "pairs")
    links = verified(pairs, near, sets, similar)
    drop_written(pairs)
    label = written(components(links), "labels")
    known = lambda: label.where("node <> component").select(F.col("component").alias("a"), F.col("node").alias("b"))
    if groups.where(F.col("n") > BLOCK).head(1):
        more = written(best_pairs(open_members(groups.where(F.col("n") > BLOCK), label), bins, rows, floor), "more-pairs")
        label = written(components(known().unionByName(verified(more, near, sets, similar))), "labels")
        drop_written(more)
    left = written(still_open(open_members(groups, label), bins, rows, floor), "still-open")
    if left.head(1):
        last = written(inside_links(left, near, sets, bins, rows, floor, similar), "inside-links")
        if last.head(1):
            label = written(components(known().unionByName(last)), "labels")
    for x in (groups, near, links, left):
        drop_written(x)
    return label
