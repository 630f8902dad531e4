"""URL filters: longest-match host/path rules, and a Bloom filter cascade for the rest.

A cascade answers "is this key listed?" exactly for every key of a known universe. Level 0 encodes
the listed keys; level 1 the unlisted keys that level 0 takes for listed; level 2 the listed keys
that level 1 takes for false positives; and so on until a level errs nowhere. A key's answer is the
parity of the first level that does not hold it.

Keys are dealt to shards by hash and each shard's cascade is built by one task from that shard's
distinct keys (a bounded number). Cascades are broadcast only while their measured total is within
``broadcast_bytes``; beyond that rows and cascades meet by shard.

Cases: a null url, or one without ``://``, has an empty host and path, no rule and the cascade's
answer for the empty host (unlisted). Urls are taken whole, however long. Repeated rows are judged alike; of
rules that fit, the longest wins (two of one length that fit one url are the same rule); empty tables give
empty results. ``judge`` keeps the columns of the input; those named host, path, rule or verdict are replaced by
its own, and names that start with ``_uf_`` are its work columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import reread, table, written

RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
BITS_PER_KEY = 10
HASHES = 7
LATER_BITS_PER_KEY = 2
LATER_HASHES = 1
SHARD_KEYS = 100_000
SALT_ROWS = 100_000
BROADCAST_BYTES = 32 << 20


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_name(host: str, path: str) -> str:
    return host + path


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, by one CASE over the rules, longest first."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, rule_name(h, p)).otherwise(name), F.when(fits, action).otherwise(verdict)
    return name, verdict


# ---------------------------------------------------------------- cascade


def _hashes(keys: list[str], level: int) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join([xxhash.xxh3_128_digest(k.encode(), seed=level) for k in keys]), "<u8").reshape(-1, 2) >> np.uint64(1)
    return both[:, 0].astype(np.int64), both[:, 1].astype(np.int64) | 1


def _positions(keys: list[str], level: int, bits: int, hashes: int) -> np.ndarray:
    low, high = _hashes(keys, level)
    steps = np.arange(hashes, dtype=np.int64)[:, None]
    return ((low[None, :] % bits) + steps * (high[None, :] % bits)) % bits


def _holds(level: tuple[int, int, np.ndarray], number: int, keys: list[str]) -> np.ndarray:
    bits, hashes, data = level
    if not keys or not bits:
        return np.zeros(len(keys), bool)
    p = _positions(keys, number, bits, hashes)
    return np.all((data[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1, axis=0)


def build_cascade(listed: list[str], others: list[str]) -> list[tuple[int, int, np.ndarray]]:
    """Levels that separate ``listed`` from ``others`` (disjoint, each without repeats) exactly."""
    levels, inside, outside = [], listed, others
    while inside:
        n = len(levels)
        # a shard's first level does most of the work; later ones only meet its few errors
        per_key, hashes = (BITS_PER_KEY, HASHES) if n == 0 else (LATER_BITS_PER_KEY, LATER_HASHES)
        if n > 12:
            per_key, hashes = BITS_PER_KEY, HASHES
        bits = max(64, per_key * len(inside)) | 1
        data = np.zeros(bits // 8 + 1, np.uint8)
        p = np.unique(_positions(inside, n, bits, hashes))
        np.bitwise_or.at(data, p >> 3, (1 << (p & 7)).astype(np.uint8))
        level = (bits, hashes, data)
        wrong = _holds(level, n, outside)
        levels.append(level)
        inside, outside = [k for k, w in zip(outside, wrong) if w], inside
    return levels


def cascade_has(levels: list[tuple[int, int, np.ndarray]], keys: list[str]) -> np.ndarray:
    """Membership of each key: listed when the first level that does not hold it has an odd number."""
    answer, alive = np.zeros(len(keys), bool), np.arange(len(keys))
    for n, level in enumerate(levels):
        held = _holds(level, n, [keys[i] for i in alive])
        answer[alive[~held]] = n % 2 == 1
        alive = alive[held]
        if not len(alive):
            return answer
    answer[alive] = len(levels) % 2 == 1
    return answer


def shard_of(key: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(shards)).cast("int")


def cascades(universe: DataFrame, shards: int) -> DataFrame:
    """(shard, levels) from a table of distinct (key, listed); each shard's levels are one struct array."""

    def build(group: pa.Table) -> pa.Table:
        keys, listed = group.column("key").to_pylist(), group.column("listed").to_numpy()
        levels = build_cascade([k for k, x in zip(keys, listed) if x], [k for k, x in zip(keys, listed) if not x])
        return pa.table({
            "shard": pa.array([group.column("shard")[0].as_py()], pa.int32()),
            "bits": pa.array([[x[0] for x in levels]], pa.list_(pa.int64())),
            "hashes": pa.array([[x[1] for x in levels]], pa.list_(pa.int32())),
            "data": pa.array([[x[2].tobytes() for x in levels]], pa.list_(pa.binary())),
        })

    return (
        universe.withColumn("shard", shard_of(F.col("key"), shards))
        .groupBy("shard")
        .applyInArrow(build, "shard int, bits array<long>, hashes array<int>, data array<binary>")
    )


def _levels(bits, hashes, data) -> list:
    return [(b, h, np.frombuffer(d, np.uint8)) for b, h, d in zip(bits, hashes, data)]


def listed_column(rows: DataFrame, key: str, universe: DataFrame, out: str = "listed") -> DataFrame:
    """Add boolean ``out``: is ``key`` listed in ``universe`` (distinct key, listed)? Exact for its keys."""
    shards = max(1, -(-universe.count() // SHARD_KEYS))
    built = written(cascades(universe, shards), "cascades")
    size = built.select(F.sum(F.aggregate("data", F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x)))).first()[0] or 0
    schema = rows.withColumn(out, F.lit(True)).withColumn("_uf_shard", shard_of(F.col(key), shards)).schema
    dealt = rows.withColumn(out, F.lit(True)).withColumn("_uf_shard", shard_of(F.col(key), shards))

    def answered(batch, levels: dict):
        # each distinct key of a batch is hashed once; equal keys have equal shards
        column = batch.column(key).fill_null("")
        column = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).dictionary_encode()
        keys, of = column.dictionary.to_pylist(), column.indices.to_numpy()
        which = np.zeros(len(keys), np.int64)
        which[of] = batch.column("_uf_shard").to_numpy()
        got = np.zeros(len(keys), bool)
        for s in np.unique(which):
            at = np.flatnonzero(which == s)
            got[at] = cascade_has(levels.get(int(s), []), [keys[i] for i in at])
        return batch.set_column(batch.schema.get_field_index(out), out, pa.array(got[of]))

    if size <= BROADCAST_BYTES:
        held = rows.sparkSession.sparkContext.broadcast(
            {r["shard"]: (list(r["bits"]), list(r["hashes"]), [bytes(x) for x in r["data"]]) for r in built.collect()}
        )

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            levels = {s: _levels(*x) for s, x in held.value.items()}
            for b in batches:
                yield answered(b, levels)

        return dealt.mapInArrow(run, schema).drop("_uf_shard")

    # Too large to broadcast: a shard's rows and its cascade meet in tasks of some SALT_ROWS rows; hot keys are split.
    sizes = written(dealt.groupBy("_uf_shard").agg(F.ceil(F.count("*") / SALT_ROWS).cast("int").alias("_uf_salts")), "shard-salts")
    left = dealt.join(sizes, "_uf_shard").withColumn("_uf_salt", F.floor(F.rand(7) * F.col("_uf_salts")).cast("int")).drop("_uf_salts")
    salts = reread(sizes).select(F.col("_uf_shard").alias("shard"), F.explode(F.sequence(F.lit(0), F.col("_uf_salts") - 1)).alias("_uf_salt"))
    right = built.join(salts, "shard")
    names = [f.name for f in schema]

    def meet(rows_: pa.Table, filters: pa.Table) -> pa.Table:
        f = filters.to_pylist()
        levels = {x["_uf_shard"]: _levels(x["bits"], x["hashes"], x["data"]) for x in f}
        return answered(rows_.select(names), levels)

    return (
        left.groupBy("_uf_shard", "_uf_salt")
        .cogroup(right.withColumnRenamed("shard", "_uf_shard").groupBy("_uf_shard", "_uf_salt"))
        .applyInArrow(meet, schema)
        .drop("_uf_shard")
    )


def judge(pages: DataFrame, listed_hosts: DataFrame | None = None, url: str = "url", rules=RULES) -> DataFrame:
    """Add host, path, rule and verdict to ``pages``.

    ``listed_hosts`` (host) is the block list for urls that no rule fits. By default it holds the
    hosts with at least one page that a rule blocks.
    """
    host, path = url_host(F.col(url)), url_path(F.col(url))
    base = pages.drop("host", "path", "rule", "verdict").withColumn("host", host).withColumn("path", path)
    name, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    ruled = base.withColumn("rule", name).withColumn("_uf_ruled", verdict)
    if listed_hosts is None:
        universe = ruled.groupBy(F.col("host").alias("key")).agg(F.coalesce(F.max(F.col("_uf_ruled") == "block"), F.lit(False)).alias("listed"))
    else:
        marked = listed_hosts.select(F.col("host").alias("key"), F.lit(True).alias("listed"))
        universe = ruled.select(F.col("host").alias("key"), F.lit(False).alias("listed")).unionByName(marked).groupBy("key").agg(F.max("listed").alias("listed"))
    out = listed_column(ruled, "host", written(universe, "url-keys"), "_uf_listed")
    return out.withColumn("verdict", F.coalesce("_uf_ruled", F.when(F.col("_uf_listed"), "block").otherwise("allow"))).drop("_uf_ruled", "_uf_listed")


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


QUERIES = {"op10_url_filters": op10_url_filters}
ORACLE_SQL = {
    "op10_url_filters": r"""
WITH u AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r(action, h, p) AS (VALUES ('allow','org','/'),('block','example.org','/es/'),('block','example.org','/en/1'),('allow','com','/fr/'),('block','com','/de/')),
m AS (
  SELECT u.page_id, u.host, u.path, max_by(h || p, length(h || p)) AS rule, max_by(action, length(h || p)) AS ruled
  FROM u LEFT JOIN r ON (u.host = h OR u.host LIKE '%.' || h) AND starts_with(u.path, p)
  GROUP BY ALL),
l AS (SELECT host, coalesce(bool_or(ruled = 'block'), false) AS listed FROM m GROUP BY host)
SELECT m.page_id, m.host, m.path, m.rule, coalesce(m.ruled, CASE WHEN l.listed THEN 'block' ELSE 'allow' END) AS verdict
FROM m JOIN l USING (host)"""
}
