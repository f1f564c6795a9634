"""Readers for snapshots, repository lists and stored scan results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weighbridge.functions.text import js_trim


def load_snapshot(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A snapshot table ``(repo_id, rel_path, content)``.

    Content stored as binary is decoded as UTF-8 with bad sequences replaced by
    U+FFFD, as a Node ``readFile(..., "utf8")`` would. A file that could not be
    read at all has null content; the audit reports it instead of failing.
    """
    df = spark.read.format(fmt).load(path)
    content = F.col("content")
    if dict(df.dtypes).get("content") == "binary":
        content = F.make_valid_utf8(content.cast("string"))
    extra = ["path_class"] if "path_class" in df.columns else []  # keeps partition pruning available
    return df.select("repo_id", "rel_path", content.alias("content"), *extra)


def lines_to_urls(lines: DataFrame, line_col: str = "line") -> DataFrame:
    """Repository-list lines → URLs: drop CR line ends, trim, drop blanks and ``#`` comments."""
    url = js_trim(F.regexp_replace(F.col(line_col), r"\r\z", ""))
    out = lines.withColumn("url", url).where((F.col("url") != "") & ~F.col("url").startswith("#"))
    return out.drop(line_col)


def read_repo_list(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).withColumnRenamed("value", "line")
    return lines_to_urls(lines)


FINDING_BRIEF = T.StructType([T.StructField("severity", T.StringType()), T.StructField("code", T.StringType())])


def scan_result_schema() -> T.StructType:
    health = T.StructType(
        [
            T.StructField("grade", T.StringType()),
            T.StructField("score", T.LongType()),
            T.StructField("noContext", T.BooleanType()),
            T.StructField("findings", T.ArrayType(FINDING_BRIEF)),
        ]
    )
    budget = T.StructType(
        [
            T.StructField("alwaysOnTokens", T.LongType()),
            T.StructField("onDemandTokens", T.LongType()),
            T.StructField("onDemandCount", T.LongType()),
        ]
    )
    report = T.StructType([T.StructField("health", health), T.StructField("budget", budget)])
    return T.StructType(
        [
            T.StructField("url", T.StringType()),
            T.StructField("owner", T.StringType()),
            T.StructField("repo", T.StringType()),
            T.StructField("status", T.StringType()),
            T.StructField("scannedAt", T.StringType()),
            T.StructField("commit", T.StringType()),
            T.StructField("error", T.StringType()),
            T.StructField("report", report),
        ]
    )


def read_scan_results(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Read per-repository result documents: pretty-printed JSON, one per file
    (``multi_line``), or JSON lines as written by :func:`scan_result_documents`."""
    return spark.read.schema(scan_result_schema()).option("multiLine", str(multi_line).lower()).json(path)
