"""Scan only repositories that have no result yet.

Batch: ``pending_repos`` is a ``left_anti`` join of the snapshot's repositories
against the result table (any existing result counts as done, errors too).

Stream: the manifest (one row ``(repo_id, n_files)`` per repository) and the files of a snapshot arrive in any
order. Both feed the stream, the files by their keys and the data file that holds them, without their text. What is known of
repositories that are not complete yet is a stored table of pending keys, a version per micro-batch. A
micro-batch adds its rows to it, audits, inside ``foreachBatch``, every repository whose ``n_files`` files are all there,
reading only the data files that hold them, and stores what is still pending as the next version. So a file that
arrives after its manifest row wakes its repository up, and finished repositories cost nothing any more.

Results go to a :class:`weighbridge.sinks.results.ResultStore`. The stream's checkpoint and the pending table lie beside them
(``_stream``, ``_pending``), so a restart goes on where it ended. A replayed batch starts from the version before it
and finds the results it wrote, if it did; of two streams at once one result counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weighbridge.plans.audit import audit
from weighbridge.session import discard, ensure_checkpoint_dir, materialize
from weighbridge.sinks.results import ResultStore

SNAPSHOT_SCHEMA = "repo_id string, rel_path string, content string"
MANIFEST_SCHEMA = "repo_id string, n_files long"
PENDING_SCHEMA = "repo_id string, n_files long, rel_path string, source string"


def pending_repos(repos: DataFrame, results: DataFrame) -> DataFrame:
    return repos.select("repo_id").distinct().join(results.select("repo_id").distinct(), "repo_id", "left_anti")


def complete_repos(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Repositories of the manifest whose files are all there; keys only, no text."""
    wanted = manifest.groupBy("repo_id").agg(F.max("n_files").alias("n_files"))
    there = files.select("repo_id", "rel_path").join(wanted, "repo_id", "left_semi").distinct()
    there = there.groupBy("repo_id").agg(F.count(F.lit(1)).alias("n"))
    return wanted.join(there, "repo_id", "left").where(F.coalesce("n", F.lit(0)) >= F.col("n_files")).select("repo_id")


def _scan(files: DataFrame, ready: DataFrame, store: ResultStore, scanned_at: str, **audit_options) -> None:
    # written once: the audit reads its files many times, and each time would join them to the repositories anew
    files = materialize(files.select("repo_id", "rel_path", "content"), "scanned")
    a = audit(files, repos=ready, **audit_options)
    store.write(a.scan_results(scanned_at), a.findings)
    a.release()
    discard(files)


def scan_pending(manifest: DataFrame, files: DataFrame, results_dir: str, scanned_at: str, **audit_options) -> None:
    """Audits the listed repositories that have no result and whose files are all there, and stores their results."""
    store = ResultStore(manifest.sparkSession, results_dir)
    pending = manifest.join(pending_repos(manifest, store.done()), "repo_id", "left_semi")
    ready = materialize(complete_repos(pending, files), "ready")
    _scan(files.join(ready, "repo_id", "left_semi"), ready, store, scanned_at, **audit_options)
    discard(ready)


class PendingTable:
    """Keys of repositories without a result: ``path/v=<batch>``, one version per micro-batch."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        self.fs = self.folder.getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, version: int):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/v={version}")

    def versions(self) -> list[int]:
        """Finished versions, in order."""
        if not self.fs.exists(self.folder):
            return []
        found = [int(s.getPath().getName()[2:]) for s in self.fs.listStatus(self.folder) if s.getPath().getName().startswith("v=")]
        done = self.spark._jvm.org.apache.hadoop.fs.Path
        return sorted(v for v in found if self.fs.exists(done(f"{self.path}/v={v}/_SUCCESS")))

    def before(self, batch: int) -> DataFrame:
        known = [v for v in self.versions() if v < batch]
        if not known:
            return self.spark.createDataFrame([], PENDING_SCHEMA)
        return self.spark.read.schema(PENDING_SCHEMA).parquet(f"{self.path}/v={known[-1]}")

    def store(self, batch: int, rows: DataFrame) -> None:
        """Writes the batch's version; the one before it stays, for a replay."""
        rows.write.mode("overwrite").parquet(f"{self.path}/v={batch}")
        for v in [v for v in self.versions() if v < batch][:-1]:
            self.fs.delete(self._at(v), True)


def scan_arrivals(arrived: DataFrame, batch: int, results_dir: str, scanned_at: str, **audit_options) -> None:
    """One micro-batch: ``arrived`` rows (``repo_id, n_files, rel_path, source``) join the pending ones; complete repositories are audited."""
    spark = arrived.sparkSession
    store, table = ResultStore(spark, results_dir), PendingTable(spark, f"{results_dir}/_pending")
    rows = arrived.select("repo_id", "n_files", "rel_path", "source").unionByName(table.before(batch))
    # a file that arrived twice counts once, from one of its sources
    rows = rows.groupBy("repo_id", "rel_path").agg(F.max("n_files").alias("n_files"), F.min("source").alias("source"))
    open_rows = materialize(rows.join(store.done(), "repo_id", "left_anti"), "pending")
    known = open_rows.groupBy("repo_id").agg(F.max("n_files").alias("n_files"), F.count("rel_path").alias("n"))
    ready = materialize(known.where(F.col("n") >= F.col("n_files")).select("repo_id"), "ready")
    if not ready.isEmpty():
        wanted = open_rows.where("rel_path IS NOT NULL").join(ready, "repo_id", "left_semi").select("repo_id", "rel_path", "source")
        sources = [r["source"] for r in wanted.select("source").distinct().collect()]  # names of data files, as any reader lists them
        files = spark.read.schema(SNAPSHOT_SCHEMA).parquet(*sources) if sources else spark.createDataFrame([], SNAPSHOT_SCHEMA)
        if sources:
            files = files.withColumn("source", F.col("_metadata.file_path")).join(wanted, ["repo_id", "rel_path", "source"], "left_semi").drop("source")
        _scan(files, ready, store, scanned_at, **audit_options)
    table.store(batch, open_rows.join(ready, "repo_id", "left_anti").select("repo_id", "n_files", "rel_path", "source"))
    discard(open_rows, ready)


def incremental_scan(
    spark: SparkSession,
    snapshot_dir: str,
    manifest_dir: str,
    results_dir: str,
    scanned_at: str,
    checkpoint_location: str | None = None,
    available_now: bool = True,
    **audit_options,
):
    """Start (and, with ``available_now``, finish) the stream; returns the query handle."""
    ensure_checkpoint_dir(spark)
    text, count = F.lit(None).cast("string"), F.lit(None).cast("long")
    listed = spark.readStream.schema(MANIFEST_SCHEMA).parquet(manifest_dir).select("repo_id", "n_files", text.alias("rel_path"), text.alias("source"))
    files = spark.readStream.schema("repo_id string, rel_path string").parquet(snapshot_dir)
    files = files.select("repo_id", count.alias("n_files"), "rel_path", F.col("_metadata.file_path").alias("source"))

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        scan_arrivals(batch, batch_id, results_dir, scanned_at, **audit_options)

    writer = listed.unionByName(files).writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint_location or f"{results_dir}/_stream")
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    query = writer.start()
    if available_now:
        query.awaitTermination()
    return query
