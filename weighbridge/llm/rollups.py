"""Delta-maintained token rollups with idempotent batch commits.

A batch of changes (``source, lang, tokenizer, op, old_tokens, new_tokens``) becomes
signed deltas: an insert adds its new count, a delete takes its old count away,
a revision adds the difference. The deltas of a batch are summed before they are
stored (partial sums per task first, so a source with most of the rows is no hot key).

The store is a folder of parquet tables. ``deltas/<batch>-<attempt>`` holds
one batch's sums and ``commits`` one row per finished attempt, written after it. Totals are the sum over
committed batches, one attempt each (the smallest name), so a batch applied
again, or by two writers at once, counts once; an attempt that died before its
commit row counts never. :meth:`compact` folds batches into one attempt that names them, and
:meth:`vacuum` removes what no longer counts, so neither the files nor the commit rows grow with the batches ever applied.

Defined cases: null source, language or tokenizer are groups of their own; a null count
is 0; an unknown or null op is an error, for dropping it would falsify totals; groups
whose documents and tokens are all 0 are not listed; empty batches commit; repeated rows are changes each. Counts are
numbers, so a very long text is no case of its own, and other columns are ignored, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ["source", "lang", "tokenizer"]
TOTALS = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


def signed_deltas(changes: DataFrame) -> DataFrame:
    """``source, lang, tokenizer, n_docs, n_tokens`` sums of a batch of changes."""
    op = F.col("op")
    old, new = (F.coalesce(F.col(c).cast("long"), F.lit(0)) for c in ("old_tokens", "new_tokens"))
    wrong = F.raise_error(F.concat(F.lit("unknown change: "), F.coalesce(op, F.lit("null"))))
    docs = F.when(op == "insert", 1).when(op == "delete", -1).when(op == "revise", 0).otherwise(wrong.cast("int"))
    tokens = F.when(op == "insert", new).when(op == "delete", -old).otherwise(new - old)
    return changes.groupBy(*KEYS).agg(F.sum(docs).cast("long").alias("n_docs"), F.sum(tokens).alias("n_tokens"))


def diff_changes(old: DataFrame, new: DataFrame, key: str = "doc_id") -> DataFrame:
    """Changes from one snapshot (``key, source, lang, tokenizer, n_tokens``) to another.
    A document that moved to another group is a delete and an insert. ``key`` is not null."""
    on = [key, *KEYS]
    a, b = old.select(*on, F.col("n_tokens").alias("old_tokens")).alias("a"), new.select(*on, F.col("n_tokens").alias("new_tokens")).alias("b")
    same = F.lit(True)
    for c in on:
        same &= F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    gone, came = F.col(f"b.{key}").isNull(), F.col(f"a.{key}").isNull()
    both = a.join(b, same, "full_outer").where(gone | came | (F.col("old_tokens") != F.col("new_tokens")))
    op = F.when(came, "insert").when(gone, "delete").otherwise("revise")
    return both.select(*[F.when(came, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c) for c in KEYS], op.alias("op"), "old_tokens", "new_tokens")


class RollupStore:
    """Token totals under ``path``, a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        start = spark.createDataFrame([], "attempt string, batches array<string>")
        start.write.mode("append").parquet(f"{self.path}/commits")

    def _commits(self) -> DataFrame:
        return self.spark.read.schema("attempt string, batches array<string>").parquet(f"{self.path}/commits")

    @staticmethod
    def _live(commits: list) -> list:
        """Commit rows that count: larger sets of batches first, then by name, none that repeats a batch."""
        seen, live = set(), []
        for r in sorted(commits, key=lambda r: (-len(r["batches"]), r["attempt"])):
            if not seen & set(r["batches"]):
                seen |= set(r["batches"])
                live.append(r)
        return live

    def committed(self) -> set[str]:
        return {b for r in self._commits().collect() for b in r["batches"]}

    def _write(self, sums: DataFrame, name: str, batches: list[str]) -> None:
        attempt = f"{name}-{uuid.uuid4().hex}"
        sums.write.parquet(f"{self.path}/deltas/{attempt}")
        row = self.spark.createDataFrame([(attempt, batches)], "attempt string, batches array<string>")
        row.coalesce(1).write.mode("append").parquet(f"{self.path}/commits")

    def apply(self, batch: str, changes: DataFrame) -> bool:
        """Commits a batch; False when it had been committed before."""
        if batch in self.committed():
            return False
        self._write(signed_deltas(changes), "batch", [batch])
        return True

    def _sums(self, live: list) -> DataFrame:
        if not live:
            return self.spark.createDataFrame([], TOTALS)
        deltas = self.spark.read.schema(TOTALS).parquet(*[f"{self.path}/deltas/{r['attempt']}" for r in live])
        sums = deltas.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return sums.where((F.col("n_docs") != 0) | (F.col("n_tokens") != 0))

    def totals(self) -> DataFrame:
        return self._sums(self._live(self._commits().collect()))

    def compact(self) -> None:
        """One attempt for all batches so far; older attempts no longer count.

        The commits are read once: the sums and the batches that the new attempt names are those of the same rows, so a batch
        that is committed meanwhile stays an attempt of its own."""
        live = self._live(self._commits().collect())
        self._write(self._sums(live), "base", sorted(b for r in live for b in r["batches"]))

    def vacuum(self) -> int:
        """Removes the sums and commit rows of attempts that no longer count; returns their number.

        Sums go before their commit row, so a run that dies half-way is finished by the next one. Attempts without a commit
        row stay: they may be about to get one. Not to be run beside a compaction or beside readers of totals taken before
        the last one, whose attempts it removes; batches may be applied meanwhile."""
        rows = self._commits().withColumn("file", F.col("_metadata.file_path")).collect()
        live = {r["attempt"] for r in self._live(rows)}
        gone = [r for r in rows if r["attempt"] not in live]
        for r in gone:
            self._remove(f"{self.path}/deltas/{r['attempt']}")
            self._remove(r["file"])  # one commit row a file
        return len(gone)

    def _remove(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
