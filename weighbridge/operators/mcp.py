"""Tool-server configs: servers per repository and the token cost of their
statically declared tool schemas (inline, or in a manifest file next to the
config). Malformed or wrongly shaped configs give no rows, never an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weighbridge import dims
from weighbridge.functions.paths import resolve_import
from weighbridge.operators.classify import path_class
from weighbridge.functions.tokens import with_tokens
from weighbridge.session import dealt_out, materialize

# ---- fixed values: how a JSON list or object opens (whatever a reader may skip before it) ----
JSON_OPENS = r"^[\s\x00-\x20\x{FEFF}]*[\[{]"
MAY_OPEN = r"^[\s\x00-\x20\x{FEFF}\[{]"


def _vtype(v: Column) -> Column:
    return F.schema_of_variant(v)


def _in_key_order(configs: DataFrame, entries: str) -> DataFrame:
    """``configs`` with one row per server: ``server, ord, entry`` of the JSON object's ``entries``.

    Servers come as JSON readers list them: integer-like names first in numeric order, then by first
    position; a repeated name has its last value. Names are brought together by one sort of the row's array, whose
    neighbours tell the first and last of each name, so the work is linear in the servers but for two sorts.
    Each step is a column of its own: what a lambda names must not be an expression that is evaluated anew per element.
    """
    numbered = F.transform(entries, lambda e, i: F.struct(e["key"].alias("name"), i.alias("i"), e["value"].alias("entry")))
    by_name = configs.withColumn("_s", F.sort_array(numbered))  # natural order; array_sort would interpret a comparison
    names = F.transform("_s", lambda e: e["name"])
    none = F.array(F.lit(None).cast("string"))
    beside = by_name.withColumns(
        {
            # one longer than the array: the last pair has no entry
            "_first": F.zip_with("_s", F.concat(none, names), lambda e, before: F.when(e.isNotNull() & ~before.eqNullSafe(e["name"]), e)),
            "_last": F.zip_with("_s", F.concat(F.slice(names, 2, F.greatest(F.size("_s"), F.lit(1))), none), lambda e, after: F.when(e.isNotNull() & ~after.eqNullSafe(e["name"]), e)),
        }
    )
    number = lambda e: F.when(e["name"].rlike(r"^(?:0|[1-9][0-9]{0,8})$"), e["name"].cast("int")).otherwise(1_000_000_000)
    whole = F.zip_with(
        F.array_compact("_first"),
        F.array_compact("_last"),
        lambda f, z: F.struct(number(f).alias("n"), f["i"].alias("i"), f["name"].alias("name"), z["entry"].alias("entry")),
    )
    ordered = beside.withColumn("_o", F.sort_array(whole))
    kept = [c for c in configs.columns if c != entries]
    # outer: else the optimizer would test the array before the scan's rows are projected, and compute all of it again
    rows = ordered.select(*kept, F.posexplode_outer("_o").alias("ord", "e")).where(F.col("ord").isNotNull())
    return rows.select(*kept, F.col("e.name").alias("server"), F.col("ord").cast("int").alias("ord"), F.col("e.entry").alias("entry"))


def server_table(files: DataFrame, config_path: str = ".mcp.json") -> DataFrame:
    """``repo_id, config_path, server, ord, inline_tools, manifest_path``, written once: the manifest lookup and its join read it.

    A config is parsed once, into its servers' raw text; a server is parsed once, into the three fields that name its tools;
    only a non-empty inline list is then cut out as JSON. Configs compress so well that millions lie in one
    piece of a file, which one task reads: their texts are dealt out row by row before they are parsed.
    """
    scope = files.where(F.col("path_class") == "config") if ("path_class" in files.columns and config_path.lower().endswith(".json")) else files
    # a text that neither names the field of servers nor holds any character by an escape (nor is null) declares none
    names_servers = F.col("content").contains("mcpServers") | F.col("content").contains("\\")
    cfg = scope.where((F.col("rel_path") == config_path) & names_servers).select(
        "repo_id", F.col("rel_path").alias("config_path"), "content"
    )
    cfg = dealt_out(cfg)
    corrupt = {"columnNameOfCorruptRecord": "_bad"}
    parsed = cfg.withColumn("p", F.from_json("content", "struct<mcpServers: map<string, string>, _bad: string>", corrupt))
    # no filter on what was parsed: it would be parsed again for the filter
    entries = F.when(F.col("p._bad").isNull(), F.map_entries("p.mcpServers"))
    s = _in_key_order(parsed.select("repo_id", "config_path", entries.alias("all")), "all")
    # an entry is an object's text; anything else (a number, a list, null) declares no tools
    fields = "struct<tools: array<string>, toolsFile: variant, manifest: variant>"
    # and an object whose text names none of the three fields, nor any character by an escape, declares none either
    names_tools = F.col("entry").contains("tools") | F.col("entry").contains("manifest") | F.col("entry").contains("\\")
    s = s.withColumn("f", F.when(F.col("entry").startswith("{") & names_tools, F.from_json("entry", fields)))
    inline = F.coalesce(F.size("f.tools") > 0, F.lit(False))
    ref = F.when(F.col("f.toolsFile").isNotNull() & ~F.is_variant_null("f.toolsFile"), F.col("f.toolsFile")).otherwise(F.col("f.manifest"))
    s = s.withColumns({"inline": inline, "ref": ref})
    path = F.when(~F.col("inline") & (_vtype(F.col("ref")) == "STRING"), F.try_variant_get("ref", "$", "string"))
    s = s.withColumn("ref", path)
    return materialize(
        s.select(
            "repo_id", "config_path", "server", "ord",
            F.when(F.col("inline"), F.get_json_object("entry", "$.tools")).alias("inline_tools"),
            F.when(F.col("ref").isNotNull(), resolve_import(F.col("config_path"), F.col("ref"))).alias("manifest_path"),
        ),
        "servers",
    )


def mcp_servers(files: DataFrame, config_path: str = ".mcp.json") -> DataFrame:
    """``repo_id, config_path, server, ord, tools_json``: one row per server, ``tools_json`` null when none.

    ``tools_json`` is the compact JSON of the tool list: a non-empty inline
    ``tools`` array wins; else ``toolsFile`` (or, when that is null/absent,
    ``manifest``) names a manifest relative to the config: a top-level array
    (even empty) or a non-empty ``{"tools": [...]}``.
    """
    s = server_table(files, config_path)
    # Manifest contents: stream the snapshot against the few referenced paths. Text that opens neither a list nor an
    # object declares no tools, so it is left where it is read: only its row takes part in the join. The join is an
    # inner one with distinct paths: a semi join would be made below the projection, on whole texts.
    referring, others = s.where(F.col("manifest_path").isNotNull()), s.where(F.col("manifest_path").isNull())
    keys = ["repo_id", "rel_path"]
    wanted = referring.select("repo_id", F.col("manifest_path").alias("rel_path")).distinct()
    if "path_class" in files.columns:
        # a path's class follows from its name, so the join prunes by directory too
        keys = ["path_class", *keys]
        wanted = wanted.withColumn("path_class", path_class(F.col("rel_path")))
    # the first character settles most texts, without the pattern that needs all of the text decoded
    opens = F.substring("content", 1, 1).rlike(MAY_OPEN) & F.col("content").rlike(JSON_OPENS)
    manifest = F.when(opens, F.col("content")).alias("manifest")
    found = files.select(*keys, manifest).join(wanted, keys)
    # one parse tells a manifest's shape; its tools are cut out of the text of the few that have some
    m = found.select("repo_id", F.col("rel_path").alias("manifest_path"), "manifest")
    m = m.withColumn("mv", F.try_parse_json("manifest"))
    listed = F.size(F.try_variant_get("mv", "$.tools", "array<variant>"))
    m = m.withColumns({"is_list": _vtype(F.col("mv")).startswith("ARRAY"), "listed": F.coalesce(listed, F.lit(-1))})
    from_manifest = F.when(F.col("is_list"), F.get_json_object("manifest", "$")).when(F.col("listed") > 0, F.get_json_object("manifest", "$.tools"))
    manifests = m.select("repo_id", "manifest_path", from_manifest.alias("manifest_tools"))
    out = ["repo_id", "config_path", "server", "ord"]
    joined = referring.join(manifests, ["repo_id", "manifest_path"], "left")
    joined = joined.select(*out, F.coalesce("inline_tools", "manifest_tools").alias("tools_json"))
    return joined.unionByName(others.select(*out, F.col("inline_tools").alias("tools_json")))


def mcp_costs(servers: DataFrame, weigher: str = "bpe", **token_opts) -> DataFrame:
    """``repo_id, server, ord, tokens, note``: tokens of the compact tool JSON; none → 0 with a note."""
    counted = with_tokens(servers, "tools_json", "tokens", weigher=weigher, **token_opts)
    none = F.col("tools_json").isNull()
    return counted.select(
        "repo_id",
        "server",
        "ord",
        F.when(none, F.lit(0)).otherwise(F.col("tokens")).cast("long").alias("tokens"),
        F.when(none, F.lit(dims.OFFLINE_NOTE)).alias("note"),
    )
