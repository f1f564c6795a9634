"""Embedding near-duplicates: Euclidean p-stable hashing with exact cosine checks.

Vectors are compared when their labels (and lengths) are equal and not null.
On the unit sphere ``cosine >= c`` is a distance of at most
``r = sqrt(2 - 2c)``. A table's key is ``k`` quantised projections
``floor((x . g + u) / w)`` with Gaussian ``g`` and uniform ``u``; ``w = 12 r``.
From the number ``n`` of distinct vectors, ``k`` makes unrelated (orthogonal)
vectors meet about once in ``n`` and the number of tables brings the
chance to miss a pair exactly at ``c`` to ``miss``; closer pairs are missed less.

Equal vectors of a label are one class and cost nothing more. Buckets with one
class are dropped before any vector moves; larger ones are cut into blocks and each
pair of blocks is one group of bounded size, checked by matrix products in double
precision. A pair that shares several tables counts in its first one only.
No pair is emitted: a block pair returns, per class, its number of
linked vectors and one link to its local component.

Defined cases: a null, empty, zero or non-finite vector, or one with null
components, and a null label link with nothing (``n_links`` 0, its own component).
A row with a null id has its links counted, but names no component (null where no
member has an id). Ids lie below 2^62 and name one vector each; repeated rows are
copies of each other and link; vectors of different lengths link with nothing of the other length, however long; an empty table
gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weighbridge.llm.common import components, lookup, materialize, roots

BLOCK = 1024  # classes of a bucket's block
SEED = 11
NAMELESS = 1 << 62


def _same_key(width: float) -> float:
    """Chance that two points ``1`` apart share a projection quantised to ``width``."""
    spread = math.erfc(width / math.sqrt(2))
    return 1 - spread - 2 / (math.sqrt(2 * math.pi) * width) * (1 - math.exp(-width * width / 2))


def tables_for(n: int, cosine: float, miss: float = 1e-4) -> tuple[float, int, int]:
    """Width, projections per table and number of tables for ``n`` distinct vectors."""
    radius = math.sqrt(max(2 - 2 * cosine, 1e-12))
    width = 12 * radius
    near, far = _same_key(12), _same_key(width / math.sqrt(2))
    k = max(1, math.ceil(math.log(max(n, 2)) / -math.log(far)))
    return width, k, max(1, math.ceil(math.log(miss) / math.log(1 - near**k)))


def unit_rows(flat: np.ndarray, dim: int) -> np.ndarray:
    x = flat.reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def bucket_keys(x: np.ndarray, width: float, k: int, tables: int) -> np.ndarray:
    """``len(x) x tables`` 64-bit keys."""
    rng = np.random.default_rng([SEED, x.shape[1], k, tables])
    g = rng.standard_normal((x.shape[1], k * tables))
    u = rng.uniform(0, width, k * tables)
    mix = rng.integers(1, 2**63, k * tables, dtype=np.int64) | 1
    cell = np.floor((x @ g + u) / width).astype(np.int64) * mix
    key = np.bitwise_xor.reduce((cell ^ (cell >> 29)).reshape(len(x), tables, k) * 0x1F3D5B79A2C4E687, axis=2)
    return key ^ (key >> 32)


def _keys_of(classes: DataFrame, width: float, k: int, tables: int) -> DataFrame:
    """``rep, label, dim, size, vec, keys``; vec is little-endian double, normalised, keys are ``tables`` longs."""

    def run(batches):
        for batch in batches:
            lists = batch.column(3).to_pylist()
            dims = np.array([len(v) for v in lists], np.int32)
            vec, keys = [b""] * len(lists), [b""] * len(lists)
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                x = unit_rows(np.array([lists[i] for i in at], np.float64), dim)
                key = bucket_keys(x, width, k, tables)
                for j, i in enumerate(at.tolist()):
                    vec[i], keys[i] = x[j].tobytes(), key[j].tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(dims), batch.column(2), pa.array(vec, pa.binary()), pa.array(keys, pa.binary())],
                names=["rep", "label", "dim", "size", "vec", "keys"],
            )

    rows = classes.select("rep", "label", "size", "embedding")
    return rows.mapInArrow(run, f"rep long, label {classes.schema['label'].dataType.simpleString()}, dim int, size long, vec binary, keys binary")


def _explode(batches):
    for batch in batches:
        keys = [np.frombuffer(b, np.int64) for b in batch.column(3).to_pylist()]
        tables = len(keys[0]) if keys else 0
        at = np.repeat(np.arange(len(keys)), tables)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0).take(pa.array(at)),
                batch.column(1).take(pa.array(at)),
                batch.column(2).take(pa.array(at)),
                pa.array(np.tile(np.arange(tables, dtype=np.int32), len(keys))),
                pa.array(np.concatenate(keys) if keys else np.empty(0, np.int64)),
            ],
            names=["rep", "label", "dim", "tab", "bucket"],
        )


def _check_group(tab: int, cosine: float, block, own, reps, sizes, vecs, keys):
    """Links inside one pair of blocks: per class its linked vectors, and local component links."""
    left = np.flatnonzero(own == block[0])
    right = left if block[0] == block[1] else np.flatnonzero(own == block[1])
    links = np.zeros(len(reps), np.int64)
    pairs = []
    for at in range(0, len(left), 256):
        part = left[at : at + 256]
        x, y = np.nonzero(vecs[part] @ vecs[right].T >= cosine)
        i, j = part[x], right[y]
        if block[0] == block[1]:
            i, j = i[i < j], j[i < j]
        for t in range(tab):
            later = keys[i, t] != keys[j, t]
            i, j = i[later], j[later]
        np.add.at(links, i, sizes[j])
        np.add.at(links, j, sizes[i])
        if len(i):
            root = roots(len(reps), i, j)
            child = np.flatnonzero(root != np.arange(len(reps)))
            pairs.append(np.stack([child, root[child]]))
    if pairs:
        i, j = np.concatenate(pairs, axis=1)
        root = roots(len(reps), i, j)
        at = np.flatnonzero(links)
        return reps[at], links[at], reps[root[at]]
    return None


def near_links(classes: DataFrame, cosine: float, miss: float = 1e-4) -> DataFrame:
    """``rep, links, root``: partial link counts of classes (``rep, label, size, embedding``) and component links."""
    n = classes.count()
    width, k, tables = tables_for(n, cosine, miss)
    keyed = materialize(_keys_of(classes, width, k, tables), "lsh-keys")
    label_type = classes.schema["label"].dataType.simpleString()
    spots = keyed.select("rep", "label", "dim", "keys").mapInArrow(_explode, f"rep long, label {label_type}, dim int, tab int, bucket long")
    spots = materialize(spots, "lsh-spots")
    key = ["label", "dim", "tab", "bucket"]
    shared = spots.groupBy(*key).agg(F.count(F.lit(1)).alias("held")).where("held > 1")
    shared = materialize(shared.withColumn("blocks", F.ceil(F.col("held") / BLOCK).cast("int")), "lsh-shared")
    total = n * tables
    met = lookup(spots, shared, key, ["blocks"], "held", total, "rep", how="inner")
    met = met.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select(*key, F.least("own", "other").alias("b0"), F.greatest("own", "other").alias("b1"), "own", "rep")
    group = [*key, "b0", "b1"]
    dealt = met.join(keyed.select("rep", "size", "vec", "keys"), "rep").select(*group, "own", "rep", "size", "vec", "keys")
    dealt = dealt.repartition(*group).sortWithinPartitions(*group)

    def match(batches):
        def flush(key, rows):
            if len(rows) < 2:
                return None
            own, reps, sizes, vecs, keys = zip(*rows, strict=True)
            out = _check_group(
                key[2], cosine, key[4:], np.array(own), np.array(reps), np.array(sizes),
                np.frombuffer(b"".join(vecs)).reshape(len(rows), -1), np.frombuffer(b"".join(keys), np.int64).reshape(len(rows), -1),
            )
            return out and pa.RecordBatch.from_arrays([pa.array(c) for c in out], names=["rep", "links", "root"])

        last, rows = None, []
        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            for row in zip(*cols, strict=True):
                if row[:6] != last:
                    if (out := flush(last, rows)) is not None:
                        yield out
                    last, rows = row[:6], []
                rows.append(row[6:])
        if (out := flush(last, rows)) is not None:
            yield out

    return dealt.mapInArrow(match, "rep long, links long, root long")


def embedding_groups(vectors: DataFrame, cosine: float = 0.98, miss: float = 1e-4, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``id_col, n_links, component_id, kept``, one row per vector."""
    vec, part = F.col("embedding"), F.col("label")
    usable = part.isNotNull() & vec.isNotNull() & (F.size("embedding") > 0)
    usable &= F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    usable &= F.exists("embedding", lambda v: v != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("embedding"), F.col(label_col).alias("label"))
    rows = rows.withColumn("usable", F.coalesce(usable, F.lit(False)))
    # two hashes with different seeds: a 128-bit key of label and vector
    vkey = ["v0", "v1"]
    for name, seed in zip(vkey, (1, 2), strict=True):
        rows = rows.withColumn(name, F.when(F.col("usable"), F.xxhash64(F.lit(seed), "label", "embedding")))
    good = rows.where("usable")
    classes = good.groupBy(*vkey).agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("size"), F.first("label").alias("label"), F.first("embedding").alias("embedding"))
    # a class is named by its smallest id; classes without ids get names above all ids
    nameless = F.lit(NAMELESS) + F.col("v0").bitwiseAND((1 << 61) - 1)
    classes = materialize(classes.withColumn("rep", F.coalesce("first_id", nameless)), "lsh-class")
    found = materialize(near_links(classes.select("rep", "label", "size", "embedding"), cosine, miss), "lsh-found")
    stars = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")), "lsh")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    named = classes.select(*vkey, "rep", "size").join(links, "rep", "left").join(stars.select(F.col("hi").alias("rep"), "lo"), "rep", "left")
    named = named.select(
        *vkey, "size",
        (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"),
        F.coalesce("lo", "rep").alias("root"),
    )
    total = classes.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first()["n"]
    out = lookup(rows.select("id", *vkey), named, vkey, ["n_links", "root"], "size", total, "id")
    component = F.when(F.coalesce("root", "id") < NAMELESS, F.coalesce("root", "id"))
    return out.select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
    )
