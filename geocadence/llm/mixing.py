"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

1. Sources in code point order (null last) weigh 5, 2, 1, repeating, and share ``share`` of all
   tokens; a target stops at ``max_epochs`` times its source and the excess is reshared by weight.
2. Each source is dealt by hash into shards of about ``shard_tokens`` tokens (more where the total is so large
   that there would be over MOST_CELLS of them). Equal blocks of at most ``block_tokens`` tokens, and so small
   that the smallest target is BLOCKS_PER_TARGET of them, go to the (source, shard) cells by highest Sainte-Lague
   quotients votes / (2 q + 1), which gives an integer quota of blocks per cell.
3. In a cell, documents stand in a seeded hash order; their tokens form one stream, cut into blocks.
   The quota takes whole passes over the stream and then its first blocks, so only one document
   of a cell is ever cut and none is taken more than ``max_epochs`` times.

Source and cell totals meet on the driver: their number is that of sources plus at most MOST_CELLS, never that of
documents; they are broadcast up to BROADCAST_ROWS rows and joined beyond. Hot sources are split over their shards.

Cases: null or blank text has size 0 and takes 0; texts are taken whole, however long; a source of size 0 has target
0; repeated rows are documents of their own, in any order among themselves, and a tie of quotients goes to the first
source and shard; an empty table gives an empty result; ``mix`` keeps all columns, whatever their names, and
brings text and n_chars up to date.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE, WORD, table, written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_EPOCHS = 2
BLOCK_TOKENS = 128
BLOCKS_PER_TARGET = 64
SHARD_TOKENS = 1 << 21
MOST_CELLS = 1 << 16
BROADCAST_ROWS = 100_000
SEED = 20240607


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(names: list[str | None], sizes: np.ndarray, weights=WEIGHTS, share: float = SHARE, most: float = MAX_EPOCHS) -> np.ndarray:
    """Tokens each source should give; ``names`` in any order."""
    order = sorted(range(len(names)), key=lambda i: (names[i] is None, names[i] or ""))
    w = np.zeros(len(names))
    for k, i in enumerate(order):
        w[i] = weights[k % len(weights)]
    caps, out = most * sizes.astype(float), np.zeros(len(names))
    free, left = np.ones(len(names), bool), share * float(sizes.sum())
    while free.any():
        give = left * w[free] / w[free].sum()
        over = give > caps[free]
        at = np.flatnonzero(free)
        if not over.any():
            out[at] = give
            break
        out[at[over]] = caps[at[over]]
        left -= caps[at[over]].sum()
        free[at[over]] = False
    return out


def sainte_lague(votes: np.ndarray, seats: int, most: np.ndarray) -> np.ndarray:
    """Integer seats by highest quotients votes / (2 q + 1), no cell above ``most``; ties to the earlier cell.

    A divisor is found by bisection (seats(d) = round(votes / d)); the last few seats go out one by one.
    """
    quota = np.zeros(len(votes), np.int64)
    seats = int(min(seats, most[votes > 0].sum())) if len(votes) else 0
    if seats <= 0:
        return quota
    at = lambda d: np.where(votes > 0, np.minimum(np.floor(np.minimum(votes / d + 0.5, 2.0**62)).astype(np.int64), most), 0)
    low, high = 0.0, float(votes.max()) * 2 + 1
    for _ in range(200):
        mid = (low + high) / 2
        if mid in (low, high):
            break
        if at(mid).sum() > seats:
            low = mid
        else:
            high = mid
    quota = at(high)
    while (rest := seats - int(quota.sum())) > 0:
        open_ = np.flatnonzero((quota < most) & (votes > 0))
        best = open_[np.argsort(-(votes[open_] / (2 * quota[open_] + 1)), kind="stable")[:rest]]
        quota[best] += 1
    return quota


def plan(docs: DataFrame, tokens: Column | None = None, *, share=SHARE, weights=WEIGHTS, max_epochs=MAX_EPOCHS, block_tokens=BLOCK_TOKENS, shard_tokens=SHARD_TOKENS, seed=SEED, text: str = "text", source: str = "source", doc_id: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken; with ``keep``, a struct _row of those columns."""
    spark = docs.sparkSession
    size = word_count(F.col(text)) if tokens is None else tokens
    own = [F.struct(*keep).alias("_row")] if keep else []
    sized = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size.alias("size"), F.xxhash64(F.lit(seed), doc_id, text).alias("_key"), *own)
    # whole texts are not carried into the ordering unless asked for; sizes are read twice, so they are written
    sized = written(sized, "mix-sizes")
    by_source = sized.groupBy("source").agg(F.sum("size").alias("n")).collect()
    names, sizes = [r["source"] for r in by_source], np.array([r["n"] for r in by_source], np.int64)
    goal = targets(names, sizes, weights, share, max_epochs)
    shard_tokens = max(shard_tokens, int(sizes.sum()) // MOST_CELLS)
    if (goal > 0).any():
        block_tokens = max(1, min(block_tokens, int(goal[goal > 0].min()) // BLOCKS_PER_TARGET))
    shards = np.maximum(1, -(-sizes // shard_tokens))
    small = lambda table, n: F.broadcast(table) if n <= BROADCAST_ROWS else table
    rows = [(n, int(s), float(g), int(k)) for n, s, g, k in zip(names, sizes, goal, shards)]
    known = spark.createDataFrame(rows or [], "_source string, source_size long, target double, _shards long")
    dealt = sized.join(small(known, len(rows)), F.col("source").eqNullSafe(F.col("_source"))).withColumn("_shard", F.pmod(F.xxhash64(F.lit(seed + 1), "_key"), F.col("_shards")))
    cells = dealt.groupBy("source", "_shard").agg(F.sum("size").alias("n")).collect()
    at = {n: i for i, n in enumerate(names)}
    n = np.array([c["n"] for c in cells], np.int64)
    which = np.array([at[c["source"]] for c in cells], np.int64)
    order = np.lexsort((np.array([c["_shard"] for c in cells], np.int64), which)) if len(cells) else np.zeros(0, np.int64)
    n, which, cells = n[order], which[order], [cells[i] for i in order]
    votes = np.where(sizes[which] > 0, goal[which] * n / np.maximum(sizes[which], 1), 0.0) if len(cells) else np.zeros(0)
    most = (max_epochs * n) // block_tokens + ((max_epochs * n) % block_tokens > 0)
    quota = sainte_lague(votes, int(round(float(votes.sum()) / block_tokens)), most)
    given = [(c["source"], int(c["_shard"]), int(x), int(min(q * block_tokens, max_epochs * x))) for c, x, q in zip(cells, n, quota)]
    quotas = spark.createDataFrame(given or [], "_qs string, _qk long, _cell long, _take long")
    dealt = dealt.join(small(quotas, len(given)), F.col("source").eqNullSafe(F.col("_qs")) & (F.col("_shard") == F.col("_qk")))
    before = F.coalesce(F.sum("size").over(W.partitionBy("source", "_shard").orderBy("_key", "doc_id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rest = F.when(F.col("_cell") > 0, F.col("_take") % F.col("_cell")).otherwise(F.lit(0))
    passes = F.when(F.col("_cell") > 0, F.floor(F.col("_take") / F.col("_cell"))).otherwise(F.lit(0))
    partly = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("_before")))
    return (
        dealt.withColumn("_before", before)
        .withColumn("taken", (passes * F.col("size") + partly).cast("long"))
        .select("doc_id", "source", "size", "source_size", "target", "taken", *["_row"][: len(own)])
    )


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: the columns of ``docs``, one row per document and pass that takes words of it.

    A whole pass keeps the text as it is; the one document of a cell that is cut keeps its first words.
    """
    cols = docs.columns
    planned = plan(docs, keep=tuple(cols), **options)
    left = F.col("taken") - F.col("_pass") * F.col("size")
    passes = planned.where(F.col("taken") > 0).withColumn("_pass", F.explode(F.sequence(F.lit(0), F.ceil(F.col("taken") / F.col("size")).cast("int") - 1)))
    text = F.col("_row")["text"]
    cut = F.array_join(F.slice(F.filter(F.split(text, SPACE), lambda x: x != ""), F.lit(1), left.cast("int")), " ")
    out = passes.select(*[F.col("_row")[c].alias(c) for c in cols if c != "text"], F.when(left >= F.col("size"), text).otherwise(cut).alias("text"))
    if "n_chars" in cols:
        out = out.withColumn("n_chars", F.char_length("text").cast("long"))
    return out.select(*cols)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan(table(spark, sf_dir, "documents")).select("doc_id", "source", "size", "source_size", "target", "taken")


QUERIES = {"op5_mixing": op5_mixing}
