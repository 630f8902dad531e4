"""Substring dedup: suffix automata of reference shards give each text's matching statistics.

A window is WINDOW consecutive words. A word goes when some window over it also starts in a document
with a smaller doc_id.

1. A window's keys are its least hashes of GRAM consecutive words in KEYS orders, so equal windows have
   equal keys. A first pass takes the least and greatest doc_id per key (combined before the shuffle); only
   windows whose every key is in at least two documents can repeat. A Bloom filter of bounded size tells the
   second pass which. Consecutive windows with the same first two keys form a stretch.
2. The stretches are the references; a passage gives the same stretches in any context. Equal stretches
   are one, with the least doc_id. They are dealt to shards by their first key. A shard's task builds the suffix automaton of its stretches per key,
   each state with the least doc_id of the texts it occurs in, and streams the stretches through it:
   the state of the longest match, cut back to WINDOW words, gives each window's least doc_id.
   A key with a single distinct stretch needs no automaton: it is its own only match.
   A key with more than KEY_STRETCHES distinct stretches would be a hot group for one task; its windows
   are dealt one by one, by the hash of the whole window, and only those seen in two documents meet again.
3. Documents learn which of their windows have a smaller least doc_id, and drop the covered words.

The automata go to where a shard's stretches meet rather than by broadcast: what repeats in a corpus
grows with it, so no bound on a broadcast would hold.

Cases: null counts as no words; texts below WINDOW words lose nothing; texts are taken whole, however long; a window
repeated inside one document only stays; rows of equal doc_id never remove each other's words, and repeated rows
lose the same ones; of several documents that start a window the smallest doc_id keeps it; rows with a null doc_id
neither lose words nor take any; empty tables give empty results; ``dedup_substrings`` keeps all columns, whatever
their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, as_i64, bloom_bits, bloom_has, grams, mix, reread, shuffle_partitions, slices, span_hash, table, written

WINDOW = 50
GRAM = 10
KEYS = 4
SHARD_WORDS = 50_000
KEY_STRETCHES = 200
OTHER_RADIX = 0xD1342543DE82EF95 | 1


def window_keys(w: Words, h: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(KEYS x keys, first word) of every window of a slice of texts: its least gram hash in each of KEYS orders."""
    g, at = grams(h, w.row, gram)
    span = window - gram + 1
    if len(g) < span:
        return np.zeros((KEYS, 0), np.uint64), np.zeros(0, np.int64)
    n = len(g) - span + 1
    # grams of one row stand together, so a run of span grams is a window when its ends share the row
    whole = w.row[at[:n]] == w.row[at[span - 1 : span - 1 + n]]
    keys = []
    for k in range(KEYS):
        low, size = (mix(g + np.uint64(k * OTHER_RADIX & (1 << 64) - 1)) if k else g), 1
        while size * 2 <= span:
            low = np.minimum(low[: len(low) - size], low[size:])
            size *= 2
        low = np.minimum(low[:n], low[span - size : span - size + n])
        keys.append(low[whole])
    return np.stack(keys), at[:n][whole]


def stretches(key: np.ndarray, at: np.ndarray, others: np.ndarray | tuple = ()) -> tuple[np.ndarray, np.ndarray]:
    """First and last+1 window of each run of consecutive windows with one key (and one of each of ``others``)."""
    if not len(key):
        none = np.zeros(0, np.int64)
        return none, none
    new = (key[1:] != key[:-1]) | (at[1:] != at[:-1] + 1)
    for other in others:
        new |= other[1:] != other[:-1]
    cut = np.flatnonzero(new) + 1
    return np.concatenate([[0], cut]), np.append(cut, len(key))


def key_rows(docs: DataFrame, window: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                w = Words(part.column("text"))
                keys, at = window_keys(w, w.hash, window, gram)
                first = [stretches(key, at)[0] for key in keys]
                both = [np.stack([as_i64(key[lo]), w.row[at[lo]]], axis=1) for key, lo in zip(keys, first)]
                pairs = np.unique(np.concatenate(both), axis=0)
                yield pa.record_batch({"key": pa.array(pairs[:, 0]), "doc_id": part.column("doc_id").cast(pa.int64()).take(pa.array(pairs[:, 1]))})

    return docs.mapInArrow(run, "key long, doc_id long")


STRETCH_SCHEMA = "key long, c1 long, c2 long, doc_id long, thash long, first int, n int, words string"


def stretch_rows(docs: DataFrame, wanted: tuple, window: int, gram: int) -> DataFrame:
    """The stretches of wanted keys; equal ones of a slice carry their words once."""
    held = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                w = Words(part.column("text"))
                h = w.hash
                keys, at = window_keys(w, h, window, gram)
                hit = np.ones(len(at), bool)
                for one in keys:
                    lo, hi = stretches(one, at)
                    hit &= np.repeat(bloom_has(held.value, as_i64(one[lo])), hi - lo)
                key, at = keys[0][hit], at[hit]
                lo, hi = stretches(key, at, (keys[1][hit],))
                a, b = at[lo], at[hi - 1] + window if len(lo) else at[lo]
                c1, c2 = as_i64(span_hash(h, a, b)), as_i64(span_hash(h, a, b, OTHER_RADIX))
                _, once = np.unique(c1, return_index=True)
                show = np.zeros(len(c1), bool)
                show[once] = True
                raw = w.buf.tobytes()
                words = [b" ".join(raw[w.start[i] : w.end[i]] for i in range(x, y)).decode() if s else None for x, y, s in zip(a.tolist(), b.tolist(), show.tolist())]
                row = w.row[a]
                take = pa.array(row)
                yield pa.record_batch({
                    "key": pa.array(key[lo].view(np.int64)), "c1": pa.array(c1), "c2": pa.array(c2), "doc_id": part.column("doc_id").cast(pa.int64()).take(take),
                    "thash": part.column("thash").take(take), "first": pa.array((a - w.first[row]).astype(np.int32)), "n": pa.array((hi - lo).astype(np.int32)), "words": pa.array(words, pa.string()),
                })

    return docs.mapInArrow(run, STRETCH_SCHEMA)


# ---------------------------------------------------------------- suffix automaton


class Automaton:
    """Suffix automaton of several word sequences; ``least`` of a state is the least doc_id of the
    sequences that hold its strings."""

    def __init__(self, texts: list[list[int]], docs: list[int]):
        self.next: list[dict] = [{}]
        self.link, self.size, self.least = [-1], [0], [min(docs)]
        for words, doc in zip(texts, docs):
            last = 0
            for c in words:
                last = self._extend(last, c)
                if doc < self.least[last]:
                    self.least[last] = doc
        for v in sorted(range(1, len(self.size)), key=self.size.__getitem__, reverse=True):
            up = self.link[v]
            if self.least[v] < self.least[up]:
                self.least[up] = self.least[v]

    def _state(self, size: int, link: int, edges: dict) -> int:
        self.next.append(edges)
        self.size.append(size)
        self.link.append(link)
        self.least.append(2**63 - 1)
        return len(self.size) - 1

    def _extend(self, last: int, c: int) -> int:
        nxt, size, link = self.next, self.size, self.link
        q = nxt[last].get(c)
        if q is not None:
            return q if size[q] == size[last] + 1 else self._clone(last, c, q)
        cur = self._state(size[last] + 1, 0, {})
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[cur] = q if size[q] == size[p] + 1 else self._clone(p, c, q)
        return cur

    def _clone(self, p: int, c: int, q: int) -> int:
        nxt, link = self.next, self.link
        copy = self._state(self.size[p] + 1, link[q], dict(nxt[q]))
        link[q] = copy
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = copy
            p = link[p]
        return copy

    def window_least(self, words: list[int], window: int) -> list[int]:
        """Least doc_id of each window of ``words``: matching statistics cut back to ``window`` words."""
        nxt, link, size = self.next, self.link, self.size
        v, length, out = 0, 0, []
        none = 2**63 - 1
        for i, c in enumerate(words):
            while v and c not in nxt[v]:
                v = link[v]
                length = size[v]
            if c in nxt[v]:
                v, length = nxt[v][c], length + 1
            while size[link[v]] >= window if v else False:
                v = link[v]
                length = size[v]
            if i >= window - 1:
                out.append(self.least[v] if length >= window else none)
        return out


def _shard_windows(t: pa.Table, window: int) -> pa.Table:
    """Least doc_id of every window of every distinct stretch of a shard."""
    keys, docs = t.column("key").to_pylist(), t.column("doc_id").to_pylist()
    by: dict[int, list[int]] = {}
    for i, k in enumerate(keys):
        by.setdefault(k, []).append(i)
    words = t.column("words").to_pylist()
    n = t.column("n").to_pylist()
    least: list[list[int]] = [[]] * len(keys)
    for of in by.values():
        if len(of) == 1:
            least[of[0]] = [docs[of[0]]] * n[of[0]]
            continue
        codes: dict[str, int] = {}
        texts = [[codes.setdefault(x, len(codes)) for x in words[i].split(" ")] for i in of]
        automaton = Automaton(texts, [docs[i] for i in of])
        for i, x in zip(of, texts):
            least[i] = automaton.window_least(x, window)
    return pa.table({"key": t.column("key"), "c1": t.column("c1"), "c2": t.column("c2"), "least": pa.array(least, pa.list_(pa.int64()))})


def _single_windows(window: int, only=None):
    """Windows of the stretches of hot keys by their hashes, with doc_id; or only those a Bloom filter holds, with
    the stretch and place of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "words"):
                w = Words(part.column("words"))
                h = w.hash
                n = part.column("n").to_numpy().astype(np.int64)
                of = np.repeat(np.arange(len(n)), n)
                place = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
                a = w.first[of] + place
                w1 = as_i64(span_hash(h, a, a + window))
                if only is not None:
                    hit = bloom_has(only.value, w1)
                    of, place, a, w1 = of[hit], place[hit], a[hit], w1[hit]
                take = pa.array(of)
                if only is None:
                    yield pa.record_batch({"w1": pa.array(w1), "w2": pa.array(as_i64(span_hash(h, a, a + window, OTHER_RADIX))), "doc_id": part.column("doc_id").take(take)})
                    continue
                yield pa.record_batch({
                    "w1": pa.array(w1), "w2": pa.array(as_i64(span_hash(h, a, a + window, OTHER_RADIX))),
                    "key": part.column("key").take(take), "c1": part.column("c1").take(take), "c2": part.column("c2").take(take),
                    "doc_id": part.column("doc_id").take(take), "place": pa.array(place.astype(np.int32)),
                })

    return run


def removable(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, thash, spans): per document the word spans [first, end) that repeat from a smaller doc_id."""
    base = docs.select("doc_id", F.xxhash64("text").alias("thash"), "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    shared = key_rows(base.select("doc_id", "text"), window, gram).groupBy("key").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
    shared = written(shared.where("lo < hi").select("key"), "window-keys")
    rows = written(stretch_rows(base, bloom_bits(shared, "key"), window, gram), "stretches")
    distinct = written(rows.groupBy("key", "c1", "c2").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"), F.max("words").alias("words")), "distinct-stretches")
    hot = written(distinct.groupBy("key").agg(F.count("*").alias("k")).where(F.col("k") > KEY_STRETCHES).select("key"), "hot-keys")
    some_hot = bool(hot.head(1))
    usual = reread(distinct).join(hot, "key", "left_anti") if some_hot else distinct
    total = distinct.select(F.sum(F.col("n") + window)).first()[0] or 0
    shards = max(1, int(total) // SHARD_WORDS)
    least = usual.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards))).groupBy("shard").applyInArrow(lambda t: _shard_windows(t, window), "key long, c1 long, c2 long, least array<long>")
    if some_hot:
        # a hot key's stretches are spread over all tasks
        stock = written(reread(distinct).join(hot, "key", "left_semi"), "hot-stretches")
        even = lambda: reread(stock).repartition(shuffle_partitions(docs.sparkSession), "c1", "c2")
        schema = "w1 long, w2 long, key long, c1 long, c2 long, doc_id long, place int"
        seen = even().mapInArrow(_single_windows(window), "w1 long, w2 long, doc_id long").groupBy("w1", "w2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
        twice = written(seen.where("least < most").select("w1", "w2", "least"), "hot-windows")
        only = docs.sparkSession.sparkContext.broadcast(bloom_bits(twice, "w1"))
        met = even().mapInArrow(_single_windows(window, only), schema).join(reread(twice), ["w1", "w2"]).where("least < doc_id")
        # least doc_ids by place; at any other place the stretch's own least doc_id is the least
        smaller = met.groupBy("key", "c1", "c2").agg(F.map_from_entries(F.collect_list(F.struct("place", "least"))).alias("m"))
        each = reread(stock).select("key", "c1", "c2", "doc_id", "n").join(smaller, ["key", "c1", "c2"], "left")
        places = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.coalesce(F.try_element_at("m", i), F.col("doc_id")))
        least = least.unionByName(each.select("key", "c1", "c2", places.alias("least")))
    # a stretch whose every window starts first in its own document removes nothing from it
    got = rows.drop("words", "n").join(least, ["key", "c1", "c2"]).where(F.array_min("least") < F.col("doc_id"))
    # covered spans, merged where windows overlap; the rest of a document's spans come from its other stretches
    starts = F.filter(F.transform("least", lambda x, i: F.when(x < F.col("doc_id"), F.col("first") + i)), lambda x: x.isNotNull())
    spans = F.aggregate(
        starts,
        F.expr("CAST(array() AS array<struct<a:int,b:int>>)"),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["b"] >= x),
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["a"].alias("a"), (x + window).cast("int").alias("b")))),
        ).otherwise(F.concat(acc, F.array(F.struct(x.cast("int").alias("a"), (x + window).cast("int").alias("b"))))),
    )
    each = got.select("doc_id", "thash", F.explode(spans).alias("s"))
    return each.groupBy("doc_id", "thash").agg(F.collect_set("s").alias("spans"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            w = Words(part.column("text"))
            raw = w.buf.tobytes()
            n, gone, sha = np.diff(w.first).astype(np.int64), [], []
            for i, spans in enumerate(part.column("spans").to_pylist()):
                a, b = int(w.first[i]), int(w.first[i + 1])
                out = np.zeros(b - a, bool)
                for s in spans or ():
                    out[s["a"] : s["b"]] = True
                keep = np.flatnonzero(~out) + a
                gone.append(int(out.sum()))
                sha.append(hashlib.sha256(b" ".join(raw[x:y] for x, y in zip(w.start[keep].tolist(), w.end[keep].tolist()))).hexdigest())
            yield pa.record_batch({"doc_id": part.column("doc_id"), "n_words": pa.array(n), "n_removed": pa.array(gone, pa.int64()), "kept_sha256": pa.array(sha)})


def _with_spans(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(row, spans): each row of ``docs`` as a struct, whatever its columns are called, and the spans it loses."""
    spans = removable(docs.select("doc_id", "text"), window, gram)
    row = F.col("row")
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return own.join(spans, (row["doc_id"] == F.col("doc_id")) & (F.xxhash64(row["text"]) == F.col("thash")), "left").select("row", "spans")


def dedup_substrings(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``docs`` with repeated words removed from ``text`` (and n_chars brought up to date, if there); texts that lose
    none stay as they are."""
    out = _with_spans(docs, window, gram)
    text = F.col("row")["text"]
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda x: x != "")
    kept = F.filter(words, lambda x, i: ~F.exists("spans", lambda s: (s["a"] <= i) & (i < s["b"])))
    out = out.withColumn("left", F.when(F.col("spans").isNull(), text).otherwise(F.array_join(kept, " ")))
    new = {"text": F.col("left")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("spans").isNull(), F.col("row")["n_chars"]).otherwise(F.char_length("left").cast("long"))
    return out.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = _with_spans(docs, WINDOW, GRAM).select("row.doc_id", "row.text", "spans")
    return rows.mapInArrow(_cut, "doc_id long, n_words long, n_removed long, kept_sha256 string")


QUERIES = {"op3_substring_dedup": op3_substring_dedup}
