"""Results of corpus scans, one per repository, in a store that several writers may share.

A write adds its rows as an *attempt* (``results/attempt=.../`` and ``findings/attempt=.../``: every finding as a row), and then
one file to the log, named by the next free number and created exclusively; it holds the attempt's name. An attempt
without a log file never counts. Of several attempts with a result for a repository the one with the smallest
number counts, with its findings: results, once read, stay, a batch written again changes nothing, and of two writers at
once one wins. Readers filter by joins on the log; nothing is rewritten.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RESULTS = (
    "repo_id string, url string, owner string, repo string, status string, scanned_at string, commit string, error string, grade string, "
    "score int, no_context boolean, always_on_tokens long, on_demand_tokens long, on_demand_count long, truncates boolean, has_email boolean, "
    "has_private_ip boolean, has_credential boolean"
)
FINDINGS = "repo_id string, file string, line int, rule_ord int, item_ord array<long>, severity string, code string, message string, suggestion string"


def _columns(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


class ResultStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # ---- writing ---------------------------------------------------------------
    def write(self, results: DataFrame, findings: DataFrame) -> str:
        """Adds ``results`` (flat study rows) and their ``findings``; returns the attempt's name once it counts."""
        attempt = uuid.uuid4().hex
        cast = lambda df, schema: df.select(*[F.col(c).cast(t) for c, t in (f.split(" ", 1) for f in schema.split(", "))])
        cast(findings, FINDINGS).write.parquet(f"{self.path}/findings/attempt={attempt}")
        cast(results, RESULTS).write.parquet(f"{self.path}/results/attempt={attempt}")
        self._commit(attempt)
        return attempt

    def _commit(self, attempt: str) -> None:
        jvm = self.spark._jvm
        log = jvm.org.apache.hadoop.fs.Path(f"{self.path}/log")
        fs = log.getFileSystem(self.spark._jsc.hadoopConfiguration())
        fs.mkdirs(log)
        number = max((int(s.getPath().getName().split(".")[0]) for s in fs.listStatus(log)), default=-1) + 1
        while True:
            try:
                out = fs.create(jvm.org.apache.hadoop.fs.Path(f"{self.path}/log/{number:020d}.json"), False)
            except Py4JJavaError as e:
                if "AlreadyExists" not in e.java_exception.getClass().getName():
                    raise
                number += 1
                continue
            try:
                out.write((json.dumps({"number": number, "attempt": attempt}) + "\n").encode())
            finally:
                out.close()
            return

    # ---- reading ---------------------------------------------------------------
    def _log(self) -> DataFrame:
        schema = "number long, attempt string"
        try:
            return self.spark.read.schema(schema).json(f"{self.path}/log").where("attempt IS NOT NULL")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def _rows(self, kind: str, schema: str) -> DataFrame:
        """Rows of the attempts in the log, with their ``number``."""
        try:
            rows = self.spark.read.schema(f"{schema}, attempt string").parquet(f"{self.path}/{kind}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            rows = self.spark.createDataFrame([], f"{schema}, attempt string")
        return rows.join(self._log(), "attempt").drop("attempt")

    def _counting(self) -> DataFrame:
        """``repo_id, number``: the attempt that counts for each repository."""
        return self._rows("results", "repo_id string").groupBy("repo_id").agg(F.min("number").alias("number"))

    def done(self) -> DataFrame:
        """``repo_id`` of the repositories that have a result."""
        return self._counting().select("repo_id")

    def results(self) -> DataFrame:
        columns = _columns(RESULTS)
        best = self._rows("results", RESULTS).groupBy("repo_id").agg(F.min_by(F.struct(*columns), "number").alias("r"))
        return best.select("r.*")

    def findings(self) -> DataFrame:
        """Every finding of the results that count."""
        return self._rows("findings", FINDINGS).join(self._counting(), ["repo_id", "number"], "left_semi").select(*_columns(FINDINGS))
