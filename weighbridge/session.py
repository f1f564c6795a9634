"""Session helpers: a tuned local session for tests and the bench, and the
shared checkpoint folder used to cut lineage in iterative jobs."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "weighbridge") -> SparkSession:
    """A local session with AQE on and the UI off (tests, bench, examples)."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("WEIGHBRIDGE_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder the cluster names, setting one only when unset.

    On a cluster ``spark.checkpoint.dir`` must name shared storage; we read it
    from the session. Only a local master (tests, the bench) may fall back to a
    fresh folder under the system temp directory.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        try:
            conf_dir = spark.conf.get("spark.checkpoint.dir")
        except Exception:  # noqa: BLE001 - unset config raises in some versions
            conf_dir = None
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir() or conf_dir
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set: name a shared folder (HDFS, S3, ...) "
            "so iterative jobs can cut their lineage"
        )
    local_dir = tempfile.mkdtemp(prefix="weighbridge-ckpt-")
    sc.setCheckpointDir(local_dir)
    return sc.getCheckpointDir() or local_dir


def materialize(df, label: str = "step"):
    """Write ``df`` as a parquet table under the checkpoint folder and read it back.

    Cuts the lineage like ``checkpoint()`` (the table lives in the shared
    folder the cluster names, so it survives lost executors), but costs one
    job: an RDD checkpoint computes its input once for the action and again to
    write it. Each call gets a fresh folder.
    """
    import uuid

    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/weighbridge-tables/{label}-{uuid.uuid4().hex}"
    df.write.mode("error").parquet(path)
    out = spark.read.parquet(path)
    out.table_path = path
    return out


def dealt_out(df):
    """``df`` dealt out row by row to as many tasks as a shuffle has, for work whose cost the bytes read do not show.

    The number is given, so adaptive execution does not draw small partitions together again.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))


def discard(*tables) -> None:
    """Remove tables that :func:`materialize` wrote and nothing will read again."""
    for df in tables:
        spark, name = df.sparkSession, getattr(df, "table_path", None)
        if name:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
