"""Resolving an ``@import`` spec against the importing file's directory."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weighbridge.functions.text import dirname


def resolve_import(importer_path: Column, spec: Column) -> Column:
    """Root-relative path of ``spec`` seen from ``importer_path``'s directory.

    ``.`` and empty segments drop out, ``..`` pops one directory. A spec that
    is absolute or climbs above the snapshot root cannot be seen in the
    snapshot and resolves to null (reported as unresolved).
    """
    d = dirname(importer_path)
    joined = F.when(d == "", spec).otherwise(F.concat(d, F.lit("/"), spec))
    start = F.struct(F.array().cast("array<string>").alias("st"), F.lit(False).alias("bad"))

    def step(acc: Column, seg: Column) -> Column:
        st, bad = acc["st"], acc["bad"]
        n = F.size(st)
        popped = F.struct(F.slice(st, F.lit(1), n - 1).alias("st"), bad.alias("bad"))
        above = F.struct(st.alias("st"), F.lit(True).alias("bad"))
        pushed = F.struct(F.concat(st, F.array(seg)).alias("st"), bad.alias("bad"))
        return (
            F.when((seg == "") | (seg == "."), acc)
            .when(seg == "..", F.when(n == 0, above).otherwise(popped))
            .otherwise(pushed)
        )

    def whole(acc: Column) -> Column:
        return F.when(~acc["bad"] & (F.size(acc["st"]) > 0), F.array_join(acc["st"], "/"))

    # most paths have no segment that the walk would drop or pop, and are their own result
    framed = F.concat(F.lit("/"), joined, F.lit("/"))
    plain = ~(framed.contains("//") | framed.contains("/./") | framed.contains("/../"))
    walked = F.aggregate(F.split(joined, "/"), start, step, whole)
    return F.when(~spec.startswith("/"), F.when(plain, joined).otherwise(walked))


def path_order(path: Column, collation: str = "UTF8_BINARY") -> Column:
    """The key that sorts paths: binary, or by an ICU collation (``"UNICODE"``)."""
    return path if collation == "UTF8_BINARY" else F.collate(path, collation)
