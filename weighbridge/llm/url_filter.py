"""URL rules by Bloom filter cascades: exact membership of listed keys without joins.

A rule is a host and a path prefix. The key universe of a corpus is every key a
URL of it could match: each suffix of its host (on label boundaries) with each
prefix of its path that is as long as some rule's path. A cascade for a list
``L`` over the universe ``U`` alternates: level 0 encodes ``L``, level 1 those
keys of ``U - L`` that level 0 lets through, level 2 those of ``L`` that level 1
lets through, and so on until nothing is left over. A key's verdict is the parity
of the first level that rejects it: exact for all of ``U``.

Keys are sharded by hash. Each shard's cascade is built in one task over at most
some ``SHARD`` keys, and the shards' filters together are a table of bits, a
few per listed key. While that table is under ``MAX_BROADCAST`` bytes it is broadcast
and each URL probes its keys locally, longest first; beyond that the
distinct keys probe their own shard's filter where it was built and only the matched
ones are kept.

Defined cases: a null URL, or one without ``://``, has empty host and path and
matches no rule; a rule with a null or empty host, or a null path, is
ignored; a URL without a rule gets the ``default`` verdict, here that of not being
listed. A rule listed both ways blocks. Longest means the longest host, then the longest path, so ties do not arise. Very long URLs
and hosts are judged whole; repeated rows are judged each; empty tables of URLs give no rows, empty tables of rules the default for all. Other columns are
kept as they are, but for those named ``host``, ``path``, ``rule``, ``verdict`` and the operator's own, which are replaced.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weighbridge.llm.common import ascii_lower, materialize

SHARD = 500_000
MAX_BROADCAST = 64 << 20
RATE = 0.01  # false positives a level lets through


def host_path(urls: DataFrame, url_col: str = "url") -> DataFrame:
    """Adds ``host`` and ``path``."""
    rest = F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"(?s)://([^/?#]*)([^?#]*)", 1)
    path = F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"(?s)://([^/?#]*)([^?#]*)", 2)
    return urls.withColumn("host", ascii_lower(rest)).withColumn("path", path)


def _hashes(keys: list[str]) -> np.ndarray:
    """Two 64-bit hashes of each key."""
    import xxhash

    raw = b"".join(xxhash.xxh128_digest(k.encode()) for k in keys)
    return np.frombuffer(raw, np.uint64).reshape(-1, 2)


def _probe(hashes: np.ndarray, level: int, bits: np.ndarray, k: int) -> np.ndarray:
    """Positions of each key in a level's bit array."""
    h = hashes + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % 2**64)  # every level hashes anew
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return (h[:, :1] + (h[:, 1:] | np.uint64(1)) * np.arange(1, k + 1, dtype=np.uint64)) % np.uint64(len(bits) * 8)


def _passes(hashes: np.ndarray, level: int, bits: np.ndarray, k: int) -> np.ndarray:
    at = _probe(hashes, level, bits, k)
    return ((bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)


def build_cascade(listed: np.ndarray, others: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Levels ``(hash functions, bytes)`` for the keys' hashes; ``listed`` and ``others`` are disjoint."""
    levels = []
    inside, outside = listed, others
    while len(inside):
        level = len(levels)
        bits = np.zeros(max(8, math.ceil(len(inside) * -math.log(RATE) / math.log(2) ** 2 / 8)), np.uint8)
        k = max(1, round(-math.log2(RATE)))
        at = _probe(inside, level, bits, k).ravel()
        np.bitwise_or.at(bits, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        levels.append((k, bits))
        inside, outside = outside[_passes(outside, level, bits, k)], inside
    return levels


def member(hashes: np.ndarray, levels: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """Whether keys of the universe are listed."""
    state = np.full(len(hashes), len(levels) % 2 == 1)
    open_ = np.arange(len(hashes))
    for level, (k, bits) in enumerate(levels):
        passed = _passes(hashes[open_], level, bits, k)
        state[open_[~passed]] = level % 2 == 1
        open_ = open_[passed]
    return state


def candidate_keys(rows: DataFrame, lengths: list[int], labels: list[int]) -> DataFrame:
    """Adds ``keys``: the keys each row's ``host`` and ``path`` could match, longest first.

    ``lengths`` and ``labels``: the path lengths and the numbers of host labels that rules have. A host's suffixes of other
    numbers of labels match no rule, so a host of any length has as many keys as these allow."""
    have = F.when(F.col("host") == "", 0).otherwise(F.length("host") - F.length(F.replace("host", F.lit("."), F.lit(""))) + 1)
    suffixes = [F.when(F.col("_labels") >= n, F.substring_index("host", ".", -n)) for n in sorted(labels, reverse=True)]
    none = F.array().cast("array<string>")
    cuts = F.filter(F.array(*[F.lit(n) for n in sorted(lengths, reverse=True)]) if lengths else F.array().cast("array<int>"), lambda n: n <= F.length("path"))
    rows = rows.withColumn("_labels", have).withColumns(
        {
            "_hosts": F.array_compact(F.array(*suffixes)) if suffixes else none,
            "_cuts": F.transform(cuts, lambda n: F.substring(F.col("path"), F.lit(1), n)),
        }
    )
    return rows.withColumn("keys", F.flatten(F.transform("_hosts", lambda h: F.transform(F.col("_cuts"), lambda p: F.concat(h, p)))))


def _cascades(universe: DataFrame, shards: int) -> DataFrame:
    """``shard, list, level, k, bits``: the cascades of ``universe`` (``key, block, allow``), a shard a group."""

    def build(pdf):
        import pandas as pd

        hashes, out = _hashes(pdf["key"].tolist()), []
        for name in ("block", "allow"):
            on = pdf[name].to_numpy(bool)
            for level, (k, bits) in enumerate(build_cascade(hashes[on], hashes[~on])):
                out.append((int(pdf["shard"].iloc[0]), name, level, k, bits.tobytes()))
        return pd.DataFrame(out, columns=["shard", "list", "level", "k", "bits"])

    dealt = universe.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int"))
    return dealt.groupBy("shard").applyInPandas(build, "shard int, list string, level int, k int, bits binary")


def _by_shard(rows) -> dict:
    out: dict = {}
    for r in sorted(rows, key=lambda r: r["level"]):
        out.setdefault((r["shard"], r["list"]), []).append((r["k"], np.frombuffer(r["bits"], np.uint8)))
    return out


def judge_urls(urls: DataFrame, rules: DataFrame, default: str = "allow", url_col: str = "url", max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """``urls`` with ``host, path, rule, verdict``; ``rules`` has ``action`` (allow or block), ``host``, ``path``."""
    spark = urls.sparkSession
    rules = rules.where((F.col("host") != "") & F.col("path").isNotNull() & F.col("action").isin("allow", "block"))
    n_labels = F.size(F.split("host", r"\.")).alias("labels")
    rules = rules.select(F.col("action"), F.concat(ascii_lower(F.col("host")), "path").alias("key"), F.length("path").alias("cut"), n_labels)
    lengths = [r["cut"] for r in rules.select("cut").distinct().collect()]  # as many as there are path lengths
    labels = [r["labels"] for r in rules.select("labels").distinct().collect()]
    kept = [c for c in urls.columns if c not in ("host", "path", "rule", "verdict", "keys", "_cuts", "_hosts", "_labels")]
    judged = candidate_keys(host_path(urls.select(*kept), url_col), lengths, labels)
    listed = rules.groupBy("key").agg(F.max(F.col("action") == "block").alias("block"))
    seen = judged.select(F.explode("keys").alias("key")).distinct()
    universe = seen.join(listed, "key", "left").select("key", F.coalesce("block", F.lit(False)).alias("block"), F.coalesce(~F.col("block"), F.lit(False)).alias("allow"))
    universe = materialize(universe, "cascade-keys")
    shards = max(1, math.ceil(universe.count() / SHARD))
    filters = materialize(_cascades(universe, shards), "cascade")
    size = filters.agg(F.coalesce(F.sum(F.length("bits") + 64), F.lit(0)).alias("n")).first()["n"]
    if size > max_broadcast:
        return _judge_sharded(spark, judged, universe, filters, shards, kept, default)
    cascades = spark.sparkContext.broadcast(_by_shard(filters.collect()))

    def run(batches):
        for batch in batches:
            n = batch.num_columns
            lists, shard_of = batch.column(n - 2).to_pylist(), batch.column(n - 1).to_pylist()
            flat = [k for ks in lists for k in ks]
            found = _members(flat, [s for ss in shard_of for s in ss], cascades.value)
            rule, verdict, at = [], [], 0
            for ks in lists:
                hit = next((i for i in range(at, at + len(ks)) if found[i]), None)
                rule.append(None if hit is None else flat[hit])
                verdict.append(default if hit is None else found[hit])
                at += len(ks)
            yield pa.RecordBatch.from_arrays([*batch.columns[: n - 2], pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names=[*batch.schema.names[: n - 2], "rule", "verdict"])

    shard_ids = F.transform("keys", lambda k: F.pmod(F.xxhash64(k), F.lit(shards)).cast("int"))
    rows = judged.select(*kept, "host", "path", "keys", shard_ids.alias("_shards"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-2]]
    return rows.mapInArrow(run, ", ".join([*fields, "rule string", "verdict string"]))


def _members(keys: list[str], shards: list[int], cascades: dict) -> list[str | None]:
    """``block``, ``allow`` or None (not listed) for each key."""
    hashes, shards = _hashes(keys), np.array(shards, np.int64)
    out = np.full(len(keys), None, object)
    for name in ("allow", "block"):
        for shard in np.unique(shards).tolist():
            at = np.flatnonzero(shards == shard)
            out[at[member(hashes[at], cascades.get((shard, name), []))]] = name
    return out.tolist()


def _judge_sharded(spark, judged: DataFrame, universe: DataFrame, filters: DataFrame, shards: int, kept: list[str], default: str) -> DataFrame:
    """For filters too large to broadcast: each shard's keys meet its filter, then
    URLs take their longest matched key."""

    def probe(keys, bits):
        import pandas as pd

        rows = _by_shard(bits.to_dict("records"))
        found = _members(keys["key"].tolist(), keys["shard"].tolist(), rows) if len(keys) else []
        return pd.DataFrame({"key": keys["key"], "action": found}).dropna()

    dealt = universe.select("key", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int").alias("shard"))
    matched = dealt.groupBy("shard").cogroup(filters.groupBy("shard")).applyInPandas(probe, "key string, action string")
    rows = judged.select(*kept, "host", "path", "keys").withColumn("_row", F.monotonically_increasing_id())
    rows = materialize(rows, "cascade-rows")
    hits = rows.select("_row", F.posexplode("keys").alias("_at", "key")).join(matched, "key")
    first = hits.groupBy("_row").agg(F.min(F.struct("_at", F.col("key").alias("rule"), F.col("action").alias("verdict"))).alias("hit"))
    return rows.join(first, "_row", "left").select(
        *kept, "host", "path", F.col("hit.rule").alias("rule"), F.coalesce(F.col("hit.verdict"), F.lit(default)).alias("verdict")
    )
