"""MinHash near-dedup: one-permutation hashing with optimal densification, banded buckets, star edges.

1. Each text becomes its set of distinct 5-word shingles (64-bit hashes). Texts with the same words form
   one class, represented by its first document; copies are never expanded into pairs.
2. One hash of a shingle gives its bin (of BINS) and its value; a class's signature is the least value
   per bin, and an empty bin borrows from a bin that a hash of (bin, attempt) picks, until one is filled.
3. BANDS bands of ROWS values make buckets; ``buckets.linked`` makes stars of each, verifies pairs on full
   shingle sets, makes components, and looks again where a star may have missed a link.

With 32 bands of 4 a pair of similarity 0.75 shares no bucket with probability 5e-6; a pair that shares one is
verified unless fewer than FLOOR of the 128 values agree, whose probability is 2e-10. Sets of fewer than BINS
shingles, whose borrowed values are not independent, are verified whatever agrees.

Cases: null, empty or wordless texts have 0 shingles and component themselves. Texts of one to four words have one
shingle, their whole word sequence. Texts are taken whole, however long. Null doc_ids are linked with
nothing (component_id null, kept). Rows of one doc_id with different texts are one document in
``components_of``: it joins whatever their texts are linked with; rows that repeat doc_id and text give repeated
results. Of a tie (equal words) the smallest doc_id is the component. Empty tables give empty results. Extra
columns of any name are ignored by ``components_of`` and kept by ``deduplicated``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .buckets import linked
from .common import RADIX, Words, as_i64, grams, mix, reread, slices, span_hash, table, written
from .graph import components

SHINGLE = 5
BINS, ROWS = 128, 4
BANDS = BINS // ROWS
SIMILAR = (75, 100)
#: of BINS: at the similarity, fewer agree with probability 2e-10
FLOOR = 64
BROADCAST_ROWS = 1_000_000
OTHER_RADIX = 0xD1342543DE82EF95 | 1


def shingle_sets(column: pa.Array, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, Words, np.ndarray]:
    """Distinct shingle hashes sorted within each row, their rows, n+1 offsets, the words and their hashes."""
    w = Words(column, lower=True)
    h = w.hash
    g, at = grams(h, w.row, k)
    n = np.diff(w.first)
    short = np.flatnonzero((n > 0) & (n < k))
    whole = span_hash(h, w.first[short], w.first[short + 1]) if len(short) else np.zeros(0, np.uint64)
    g = np.concatenate([g, whole])
    row = np.concatenate([w.row[at], short]).astype(np.int64)
    order = np.lexsort((g, row))
    g, row = g[order], row[order]
    fresh = np.ones(len(g), bool)
    fresh[1:] = (g[1:] != g[:-1]) | (row[1:] != row[:-1])
    g, row = g[fresh], row[fresh]
    return g, row, np.searchsorted(row, np.arange(w.n_rows + 1)), w, h


def signatures(g: np.ndarray, row: np.ndarray, n: int, bins: int = BINS) -> np.ndarray:
    """n x bins least values; rows without shingles are all ones. ``g`` is sorted within each row."""
    out = np.full((n, bins), 0xFFFFFFFF, np.uint32)
    if not len(g):
        return out
    shift = 64 - int(bins).bit_length() + 1
    bin_ = (g >> np.uint64(shift)).astype(np.int64)
    first = np.ones(len(g), bool)
    first[1:] = (bin_[1:] != bin_[:-1]) | (row[1:] != row[:-1])
    value = (mix(g) >> np.uint64(32)).astype(np.uint32)
    # the order within a bin must not be that of the bin number, so take minima of mixed values
    starts = np.flatnonzero(first)
    out[row[starts], bin_[starts]] = np.minimum.reduceat(value, starts)
    filled = np.zeros((n, bins), bool)
    filled[row[starts], bin_[starts]] = True
    some = filled.any(axis=1)
    empty = ~filled & some[:, None]
    own, attempt = out.copy(), 0
    numbers = np.arange(bins, dtype=np.uint64)
    while empty.any():
        pick = (mix(numbers * np.uint64(RADIX) + np.uint64(attempt + 1)) % np.uint64(bins)).astype(np.int64)
        good = empty & filled[:, pick]
        r, c = np.nonzero(good)
        out[r, c] = own[r, pick[c]]
        empty[r, c] = False
        attempt += 1
    return out


def short_values(sig: np.ndarray) -> np.ndarray:
    """16 bits of each value, which is what is kept and compared."""
    return (mix(sig.astype(np.uint64)) >> np.uint64(48)).astype(np.uint16)


SKETCH_SCHEMA = "doc_id long, thash long, n_shingles long, k1 long, k2 long, sig binary"


def sketches(docs: DataFrame) -> DataFrame:
    """Per row: set size, 128-bit key of the word sequence, signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                g, row, off, w, h = shingle_sets(part.column("text"))
                sig = signatures(g, row, w.n_rows)
                a, b = w.first[:-1], w.first[1:]
                yield pa.record_batch({
                    "doc_id": part.column("doc_id").cast(pa.int64()), "thash": part.column("thash"), "n_shingles": pa.array(np.diff(off).astype(np.int64)),
                    "k1": pa.array(as_i64(span_hash(h, a, b))), "k2": pa.array(as_i64(span_hash(h, a, b, OTHER_RADIX))),
                    "sig": pa.array([x.tobytes() for x in short_values(sig)], pa.binary()),
                })

    return docs.select("doc_id", F.xxhash64("text").alias("thash"), "text").mapInArrow(run, SKETCH_SCHEMA)


def _word_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    g, _, off, _, _ = shingle_sets(column)
    return g, off


def classes_of(sketch: DataFrame) -> DataFrame:
    """(k1, k2, id, doc_id, thash, few, sig): one row per distinct word sequence, with its first document."""
    full = sketch.where("n_shingles > 0 AND doc_id IS NOT NULL")
    first = F.min_by(F.struct("n_shingles", "sig"), F.struct("doc_id", "thash")).alias("own")
    out = full.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "thash")).alias("first"), first)
    out = out.select("k1", "k2", F.col("first.doc_id").alias("doc_id"), F.col("first.thash").alias("thash"), (F.col("own.n_shingles") < BINS).alias("few"), F.col("own.sig").alias("sig"))
    # numbered once: later readers see the written numbers
    return written(out.withColumn("id", F.monotonically_increasing_id()), "classes")


def class_texts(docs: DataFrame, classes: DataFrame):
    """A function from wanted class ids to their (id, text); ids are broadcast only below a checked count."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("thash"), "text").where("doc_id IS NOT NULL AND text IS NOT NULL")

    def of(ids: DataFrame) -> DataFrame:
        wanted = written(classes.select("id", "doc_id", "thash").join(ids, "id"), "wanted")
        side = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
        # rows that repeat both doc_id and text give one text
        return texts.join(side, ["doc_id", "thash"]).select("id", "text").dropDuplicates(["id"])

    return of


def class_components(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sketches, classes, and (node, component) of the classes that have a link."""
    sketch = written(sketches(docs), "sketches")
    classes = classes_of(sketch)
    return sketch, classes, linked(classes.select("id", "sig", "few"), class_texts(docs, reread(classes)), _word_sets, BINS, ROWS, SIMILAR, FLOOR)


def first_places(classes: DataFrame, label: DataFrame) -> DataFrame:
    """(k1, k2, first): the first (doc_id, thash) of each class's component. Written in between, so that a component
    of many classes is a skewed join, which Spark splits, and never a group."""
    own = reread(classes).select("k1", "k2", "id", F.struct("doc_id", "thash").alias("place"))
    first = written(label.join(own, F.col("node") == F.col("id")).groupBy("component").agg(F.min("place").alias("first")), "firsts")
    by_node = written(label.join(first, "component").select("node", "first"), "node-firsts")
    return own.join(by_node, F.col("id") == F.col("node"), "left").select("k1", "k2", F.coalesce("first", "place").alias("first"))


def components_of(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, one row per row of ``docs`` (doc_id, text)."""
    sketch, classes, label = class_components(docs)
    known = sketch.where("n_shingles > 0 AND doc_id IS NOT NULL").select("doc_id", "k1", "k2")
    member = known.distinct().join(reread(classes).select("k1", "k2", "id"), ["k1", "k2"]).select("doc_id", "id")
    # a document of several texts joins their classes
    several = member.groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("z")).where("a < z").select("doc_id", "a")
    several = written(several, "documents-of-several-texts")
    if several.head(1):
        star = member.join(several, "doc_id").where("id <> a").select("a", F.col("id").alias("b"))
        label = written(components(label.where("node <> component").select(F.col("component").alias("a"), F.col("node").alias("b")).unionByName(star)), "labels")
    by_class = written(first_places(classes, label).select("k1", "k2", F.col("first.doc_id").alias("component_id")), "components")
    out = sketch.select("doc_id", "n_shingles", "k1", "k2").join(by_class, ["k1", "k2"], "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` with one row's text of each group of near copies: the first by (doc_id, hash of the text).

    Rows are judged by their texts here: a doc_id that names two texts does not make those one group, so no
    text goes unless a near copy of it, or one it is linked with, stays. Rows equal in both go or stay together;
    rows without words or with a null doc_id stay.
    """
    sketch, classes, label = class_components(docs)
    place = F.struct("doc_id", "thash")
    by_class = written(first_places(classes, label), "first-places")
    gone = sketch.where("n_shingles > 0 AND doc_id IS NOT NULL").select("k1", "k2", place.alias("place")).join(by_class, ["k1", "k2"])
    gone = gone.where(F.col("place") != F.col("first")).select(F.col("place.doc_id").alias("_gone_id"), F.col("place.thash").alias("_gone_hash")).distinct()
    gone = written(gone, "gone")
    own = docs.select(F.struct("*").alias("_row"))
    row = F.col("_row")
    out = own.join(gone, (row["doc_id"].cast("long") == F.col("_gone_id")) & (F.xxhash64(row["text"]) == F.col("_gone_hash")), "left_anti")
    return out.select("_row.*")


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components_of(table(spark, sf_dir, "documents"))


QUERIES = {"op4_near_dedup": op4_near_dedup}
