"""Documents of any length as ordered lines.

A document (one per repository) is a run of sections: texts that occur once, and lists with a line per
item. Lists are numbered by a range-partitioned rank, so their separators and the lines' order are known without
gathering a repository; all items but a list's first open with a comma. The first line names the repository; the lines
of a document, one after another, are one JSON text.

:func:`write_documents` deals all lines by range and writes them in order, so a repository with a third of all lines is
written by many tasks: by repository, a folder each, whose part files in the order of their names are the document (for tools that
want a file per repository), or bundled, all documents one after another in the part files of one folder.
:func:`read_documents` reads bundles and numbers their lines again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weighbridge.plans.ranking import rank_within

PLACE = ["section", "p", "q"]
OPENS = r'^\{(?:"properties":\{)?"repository":"((?:[^"\\]|\\.)*)"'


def repository() -> Column:
    """The field that an opening line starts with, after its brace or that of a bag of properties."""
    return F.concat(F.lit('"repository":'), F.expr("substring(to_json(array(repo_id)), 2, length(to_json(array(repo_id))) - 2)"))


def once(df: DataFrame, line: Column) -> DataFrame:
    """A section of one line per repository."""
    zero = F.lit(0).cast("long")
    return df.select("repo_id", zero.alias("p"), zero.alias("q"), line.alias("line"))


def listed(df: DataFrame, json: Column, order: list[Column]) -> DataFrame:
    """A section with one line per row, in ``order`` (a total order inside a repository)."""
    keys = {f"_k{i}": c for i, c in enumerate(order)}
    rows = df.select("repo_id", json.alias("json"), *[c.alias(k) for k, c in keys.items()])
    ranked = rank_within(rows, ["repo_id"], [F.col(k).asc_nulls_first() for k in keys], out="p")
    return ranked.select("repo_id", "p", F.lit(0).cast("long").alias("q"), separated(F.col("p"), F.col("json")).alias("line"))


def separated(position: Column, json: Column) -> Column:
    return F.when(position > 1, F.concat(F.lit(","), json)).otherwise(json)


def document_lines(*sections: DataFrame) -> DataFrame:
    """``repo_id, section, p, q, line`` of all documents; ``(section, p, q)`` orders a document's lines."""
    out = None
    for i, rows in enumerate(sections):
        rows = rows.select("repo_id", F.lit(i).alias("section"), "p", "q", "line")
        out = rows if out is None else out.unionByName(rows)
    return out


def write_documents(lines: DataFrame, path: str, by_repository: bool = True, mode: str = "error", lines_per_file: int = 200_000) -> None:
    """Every document in part files of at most ``lines_per_file`` lines, in ``path/repo_id=.../`` or bundled in ``path``."""
    ordered = lines.repartitionByRange("repo_id", *PLACE).sortWithinPartitions("repo_id", *PLACE)
    if by_repository:
        out = ordered.select("repo_id", F.col("line").alias("value")).write.partitionBy("repo_id")
    else:
        out = ordered.select(F.col("line").alias("value")).write
    out.mode(mode).option("maxRecordsPerFile", lines_per_file).text(path)


def read_documents(spark, path: str) -> DataFrame:
    """``repo_id, position, line``: the lines of bundled documents, numbered from 0 in each.

    A file holds a bounded number of lines; a document that began in an earlier file is found through the last
    opening line of each file, one short row per file."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.split(F.rtrim("value", F.lit("\n")), "\n").alias("lines"))
    rows = files.select("file", F.posexplode("lines").alias("i", "line"))
    name = F.regexp_extract("line", OPENS, 1)
    opened = F.from_json(F.concat(F.lit('["'), name, F.lit('"]')), "array<string>")[0]
    rows = rows.withColumn("opens", F.when(F.col("line").rlike(OPENS), opened))
    spot = lambda at: F.when(F.col("opens").isNotNull(), F.struct(F.col("opens").alias("repo_id"), at.alias("at")))
    each = rows.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.max_by(spot(F.col("i")), F.when(F.col("opens").isNotNull(), F.col("i"))).alias("last"))
    before = W.orderBy(F.length("file"), "file").rowsBetween(W.unboundedPreceding, -1)  # a row per file
    each = each.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))
    open_at = F.when(F.col("last").isNotNull(), F.struct(F.col("last.repo_id").alias("repo_id"), (F.col("first") + F.col("last.at")).alias("at")))
    each = each.select("file", "first", F.last(open_at, ignorenulls=True).over(before).alias("carried"))
    rows = rows.join(each, "file").withColumn("g", F.col("first") + F.col("i"))
    inside = W.partitionBy("file").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("doc", F.coalesce(F.last(spot(F.col("g")), ignorenulls=True).over(inside), "carried"))
    return rows.select(F.col("doc.repo_id").alias("repo_id"), (F.col("g") - F.col("doc.at")).alias("position"), "line")
