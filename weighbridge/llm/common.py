"""Helpers shared by the operators: skew-safe lookups, numpy union-find and
connected components over link tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weighbridge.session import ensure_checkpoint_dir, materialize

#: A key is hot when it holds more than this share of the rows, so at most
#: ``HOT_KEYS`` keys are hot: the proven bound of the broadcast side.
HOT_KEYS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lookup(rows: DataFrame, entries: DataFrame, keys: list[str], values: list[str], size: str, total: int, spread: str, how: str = "left") -> DataFrame:
    """Join ``rows`` to ``entries`` (unique on ``keys``; ``size`` = rows that hold
    the key, adding up to ``total``) so that no key gathers in one task.

    Keys with over ``total / HOT_KEYS`` rows, at most ``HOT_KEYS`` of them, are
    broadcast; their rows are then salted by ``spread`` in the shuffled join
    that serves all other keys.
    """
    # not a literal: the optimizer would take a constant out of the join keys, and the salt with it
    zero = F.pmod(F.xxhash64(*keys), F.lit(1)).cast("int")
    is_hot = F.col(size) * HOT_KEYS > F.lit(int(total))
    hot = entries.where(is_hot).select(*keys, F.struct(*values).alias("_hot"))
    cold = entries.where(~is_hot).select(*keys, F.struct(*values).alias("_cold"), zero.alias("_salt"))
    salt = F.when(F.col("_hot").isNotNull(), 1 + F.pmod(F.xxhash64(spread), F.lit(65_521))).otherwise(0).cast("int")
    out = rows.join(F.broadcast(hot), keys, "left").withColumn("_salt", salt).join(cold, [*keys, "_salt"], "left")
    found = F.coalesce("_hot", "_cold")
    if how == "inner":
        out = out.where(found.isNotNull())
    return out.select(*rows.columns, *[found[v].alias(v) for v in values])


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest node index of each of ``n`` nodes' component under links ``a - b``."""
    root = np.arange(n, dtype=np.int64)
    while a.size:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if np.array_equal(before, root):
            break
    return root


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def components(links: DataFrame, label: str) -> DataFrame:
    """``hi, lo``: every node of a component of two or more nodes, except its
    smallest, with that smallest node. ``links`` has long columns ``a, b``.

    Alternates large-star and small-star steps: each node hands its
    larger neighbours, then its smaller ones, to its smallest neighbour, until
    nothing changes. Each round is a written table, so a lost executor repeats
    one round at most; hubs are spread by :func:`lookup`.
    """
    links = links.where(F.col("a") != F.col("b"))
    edges = materialize(links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), f"{label}-links")
    state = _digest(edges)
    while state[0]:
        ends = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = ends.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("size"))
        larger = lookup(ends, least, ["u"], ["m"], "size", 2 * state[0], "v").where((F.col("v") > F.col("u")))
        large = materialize(larger.select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct(), f"{label}-large")
        n_large = large.count()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"), F.count(F.lit(1)).alias("size"))
        lower = lookup(large, least, ["hi"], ["m"], "size", n_large, "lo")
        small = lower.select("hi", F.col("m").alias("lo")).unionByName(
            lower.where(F.col("lo") != F.col("m")).select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        )
        edges = materialize(small.distinct(), f"{label}-small")
        before, state = state, _digest(edges)
        if before == state:
            break
    return edges


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@contextmanager
def bucketed(df: DataFrame, buckets: int, key: str, label: str) -> Iterator[DataFrame]:
    """``df`` as a table bucketed by ``key``, its files below the checkpoint folder, for as long as the context lasts."""
    spark, name = df.sparkSession, f"{label}_{uuid.uuid4().hex}"
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/weighbridge-tables/{name}"
    try:
        df.write.bucketBy(buckets, key).format("parquet").option("path", path).saveAsTable(name)
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
