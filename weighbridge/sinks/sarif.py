"""SARIF 2.1.0: one document per repository, as ordered lines (:mod:`weighbridge.sinks.documents`).

The first line names the repository in the document's properties, opens the run and names its rules: the distinct codes of the repository's findings by first
appearance, at most one per code. Then comes a line per finding, in the order of findings, and a closing line, which for a
repository without context files holds a note instead of an empty clean run. Null optional fields (``region``
without a line, ``locations`` without a file) drop out of ``to_json`` by themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weighbridge import dims
from weighbridge.operators.findings import finding_place
from weighbridge.sinks.documents import document_lines, listed, once, repository

TOOL_NAME = "weighbridge"


def _level() -> Column:
    sev = F.col("severity")
    return F.when(sev == "error", F.lit(dims.SARIF_LEVEL["error"])).when(sev == "warn", F.lit(dims.SARIF_LEVEL["warn"])).otherwise(
        F.lit(dims.SARIF_LEVEL["info"])
    )


def _result() -> Column:
    region = F.when(F.col("line") > 0, F.struct(F.col("line").alias("startLine"))).alias("region")
    spot = F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), region)
    location = F.when(F.col("file").isNotNull(), F.array(F.struct(spot.alias("physicalLocation"))))
    return F.struct(
        F.col("code").alias("ruleId"), _level().alias("level"), F.struct(F.col("message").alias("text")).alias("message"), location.alias("locations")
    )


def sarif_lines(findings: DataFrame, health: DataFrame, version: str = "0.1.0", collation: str = "UTF8_BINARY") -> DataFrame:
    """``repo_id, section, p, q, line``: the documents of all repositories of ``health``."""
    place = finding_place(collation)
    first = findings.groupBy("repo_id", "code").agg(F.min(F.struct(*place)).alias("first"))
    codes = first.groupBy("repo_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "code"))), lambda x: x["code"]).alias("codes"))
    rule = lambda c: F.struct(c.alias("id"), c.alias("name"), F.struct(c.alias("text")).alias("shortDescription"))
    repos = health.select("repo_id", "no_context").join(codes, "repo_id", "left")
    rules = F.transform(F.coalesce("codes", F.array().cast("array<string>")), rule)
    driver = F.struct(F.lit(TOOL_NAME).alias("name"), F.lit(version).alias("version"), rules.alias("rules"))
    opening = F.concat(
        F.lit('{"properties":{'),
        repository(),
        F.lit(f'}},"$schema":"{dims.SARIF_SCHEMA}","version":"2.1.0","runs":[{{"tool":'),
        F.to_json(F.struct(driver.alias("driver"))),
        F.lit(',"results":['),
    )
    note = F.struct(F.lit("note").alias("level"), F.struct(F.lit(dims.SARIF_NO_CONTEXT).alias("text")).alias("message"))
    told = F.to_json(F.array(F.struct(F.lit(True).alias("executionSuccessful"), F.array(note).alias("toolExecutionNotifications"))))
    closing = F.concat(F.lit("]"), F.when(F.col("no_context"), F.concat(F.lit(',"invocations":'), told)).otherwise(""), F.lit("}]}"))
    results = listed(findings, F.to_json(_result()), [*place, F.col("code"), F.col("message")])
    return document_lines(once(repos, opening), results, once(repos, closing))
