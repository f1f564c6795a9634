"""Dense ranks and exact medians without sending a whole group to one task.

``row_number() OVER (PARTITION BY key ORDER BY ...)`` puts every row of a key
into one task; if one repository holds a third of all rows, that task does a
third of the work. Here the rows are range-partitioned on ``(key, order...)``
instead, so a hot key is cut into many sorted slices. Each row's rank is its
position inside its slice plus the sizes of the key's earlier slices; the
per-(key, slice) table has at most ``keys + slices`` rows.

The sorted, numbered rows are written as a table in the checkpoint folder
before the two passes that read them, so a lost executor cannot renumber them
differently.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weighbridge.session import ensure_checkpoint_dir, materialize

_LOCAL_BITS = (1 << 33) - 1  # monotonically_increasing_id: partition << 33 | row in partition


def rank_within(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    out: str = "rank",
    n_slices: int | None = None,
) -> DataFrame:
    """Add ``out`` = 1-based position of each row within its ``keys`` group in ``order``.

    ``order`` must be a total order inside a group (end it with a unique column).
    ``keys`` may be empty: one global ranking, still computed in parallel.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    if n_slices is None:
        n_slices = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    key_cols = [F.col(k) for k in keys]
    sort_cols = key_cols + list(order)
    ranged = df.repartitionByRange(n_slices, *sort_cols).sortWithinPartitions(*sort_cols)
    tagged = materialize(
        ranged.withColumn("_slice", F.spark_partition_id()).withColumn(
            "_pos", F.monotonically_increasing_id().bitwiseAND(F.lit(_LOCAL_BITS))
        ),
        "ranked",
    )
    slices = tagged.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_n"), F.min("_pos").alias("_pos0"))
    before = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1) if keys else (
        W.orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    )
    slices = slices.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    ranked = tagged.join(slices.select(*keys, "_slice", "_off", "_pos0"), [*keys, "_slice"])
    return ranked.withColumn(out, (F.col("_off") + F.col("_pos") - F.col("_pos0") + 1).cast("long")).drop(
        "_slice", "_pos", "_off", "_pos0"
    )


def exact_median_half_up(df: DataFrame, value: str, out: str = "median") -> DataFrame:
    """One row: the exact median of ``value`` (mean of the middle two, rounded half up; none → 0).

    Equal values are counted first (partial sums per task), so a hot value is one row;
    the distinct values are then range-partitioned and their counts summed along the slices.
    """
    spark = df.sparkSession
    n_slices = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    counts = df.select(F.col(value).cast("long").alias("_v")).where(F.col("_v").isNotNull()).groupBy("_v").agg(F.count(F.lit(1)).alias("_n"))
    ranged = materialize(counts.repartitionByRange(n_slices, "_v").withColumn("_slice", F.spark_partition_id()), "values")
    slices = ranged.groupBy("_slice").agg(F.sum("_n").alias("_s"))  # at most n_slices rows
    before = W.orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    slices = slices.select("_slice", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_off"))
    inside = W.partitionBy("_slice").orderBy("_v").rowsBetween(W.unboundedPreceding, 0)
    last = F.col("_off") + F.sum("_n").over(inside)
    placed = ranged.join(slices, "_slice").withColumn("_last", last).withColumn("_first", F.col("_last") - F.col("_n") + 1)
    n = ranged.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    at = lambda k: F.max(F.when(F.lit(k).between(F.col("_first"), F.col("_last")), F.col("_v")))
    middle = (at((n - 1) // 2 + 1) + at(n // 2 + 1)) / 2
    return placed.agg(F.coalesce(F.floor(middle + F.lit(0.5)), F.lit(0)).cast("long").alias(out))
