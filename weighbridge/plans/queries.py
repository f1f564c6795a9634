"""Registered queries: ``name -> (spark, sf_dir) -> DataFrame`` and, where SQL
can express it, the DuckDB oracle for the same rows.

Every query reads the given tables (through the fixture views derived from
them) over whole tables and whole texts. Budget queries that must match SQL
use the ``bytes4`` weigher; ``q_token_count_bpe`` is the exact BPE count and has
no SQL oracle.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weighbridge import dims
from weighbridge.functions.placeholders import is_placeholder, is_reserved_email_domain, shannon_entropy, with_secret_features
from weighbridge.functions.text import js_trim
from weighbridge.functions.tokens import bytes4, with_tokens
from weighbridge.functions.urls import owner_repo
from weighbridge.operators import budget as B
from weighbridge.operators import health as H
from weighbridge.operators import study as S
from weighbridge.operators.findings import size_findings
from weighbridge.operators.secrets import SECRET_RULES, classify_matches, secret_matches
from weighbridge.plans import oracle as O
from weighbridge.plans.audit import Audit, audit
from weighbridge.session import ensure_checkpoint_dir, materialize
from weighbridge.sinks.documents import read_documents, write_documents
from weighbridge.sinks.json_report import report_lines
from weighbridge.sinks.results import ResultStore
from weighbridge.sinks.sarif import sarif_lines
from weighbridge.sources.fixtures import repos_v, snapshot, urls_v
from weighbridge.sources.readers import lines_to_urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

GATE_SPEC = "error,imports/unresolved"
MODEL = "claude-opus"
SCANNED_AT = "2026-07-02T00:00:00.000Z"


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


def fixture_audit(spark: SparkSession, sf_dir: str, weigher: str = "bytes4", **kw) -> Audit:
    return audit(snapshot(spark, sf_dir), repos=repos_v(spark, sf_dir), weigher=weigher, model=MODEL, **kw)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- scan ---------------------------------------------------------------------
@register("q_scan", O.build("SELECT repo_id, rel_path, kind, load, bytes, lines FROM ctx", "ctx"))
def q_scan(spark, sf):
    return fixture_audit(spark, sf).context.drop("content")


FINDING_OUT = ["repo_id", "file", "line", "severity", "code", "message", "suggestion"]
_FIRST = "min({'f': file, 'r': rule_ord, 'i': item_ord})"
SQL_FINDING_OUT = "repo_id, file, line, severity, code, message, suggestion"


@register("q_size_findings", O.build(f"SELECT {SQL_FINDING_OUT} FROM size_f", "size_f"))
def q_size_findings(spark, sf):
    return size_findings(fixture_audit(spark, sf).context).select(*FINDING_OUT)


O.block("size_f_small", ["ctx"], O._size_findings(60, 8192))


@register("q_size_findings_small", O.build(f"SELECT {SQL_FINDING_OUT} FROM size_f_small", "size_f_small"))
def q_size_findings_small(spark, sf):
    return size_findings(fixture_audit(spark, sf).context, max_lines=60, max_bytes=8192).select(*FINDING_OUT)


# ---- imports ------------------------------------------------------------------
@register("q_import_edges", O.build("SELECT * FROM edges", "edges"))
def q_import_edges(spark, sf):
    return fixture_audit(spark, sf).edges


@register("q_import_closure", O.build("SELECT repo_id, root_path, node_path FROM reach", "reach(repo_id, root_path, node_path)"))
def q_import_closure(spark, sf):
    return fixture_audit(spark, sf).reach.select("repo_id", "root_path", "node_path")


@register("q_unresolved", O.build("SELECT repo_id, root_path, spec, array_to_string(place, '.') AS place FROM unres", "unres"))
def q_unresolved(spark, sf):
    place = F.array_join(F.transform("place", lambda x: x.cast("string")), ".").alias("place")
    return fixture_audit(spark, sf).unresolved.select("repo_id", "root_path", "spec", place)


@register(
    "q_claimed_imports",
    O.build(
        f"SELECT c.repo_id, c.importer_path, c.imported_path, {O.B4.format(x='s.content')} AS tokens "
        "FROM claims c JOIN snap s ON s.repo_id = c.repo_id AND s.rel_path = c.imported_path",
        "claims", "snap",
    ),
)
def q_claimed_imports(spark, sf):
    a = fixture_audit(spark, sf)
    tok = a.token_table.where(~F.col("is_context")).select("repo_id", F.col("rel_path").alias("imported_path"), "tokens")
    return a.claims.join(tok, ["repo_id", "imported_path"])


# ---- secrets ------------------------------------------------------------------
@register(
    "q_secret_scan",
    O.build("SELECT repo_id, rel_path AS file, line, final_code AS code, severity, value_sha, value_mask FROM sc", "sc"),
)
def q_secret_scan(spark, sf):
    a = fixture_audit(spark, sf)
    m = classify_matches(secret_matches(a.context, ["repo_id", "rel_path"]))
    return m.select("repo_id", F.col("rel_path").alias("file"), "line", F.col("final_code").alias("code"), "severity", "value_sha", "value_mask")


def _words(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents")
    w = docs.select(F.explode(F.split(F.col("text"), "[ \n]+", -1)).alias("word")).where(F.col("word") != "")
    return w.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


SQL_WORDS = (
    "words AS (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(text, '[ \\n]+')) AS word FROM documents) "
    "WHERE word <> '' GROUP BY word)"
)


@register(
    "q_placeholder",
    f"WITH {SQL_WORDS} SELECT word, n, {O._placeholder(O._js_trim('word'))} AS is_placeholder FROM words",
)
def q_placeholder(spark, sf):
    return _words(spark, sf).select("word", "n", is_placeholder(F.col("word")).alias("is_placeholder"))


@register(
    "q_entropy",
    f"WITH {SQL_WORDS} SELECT word, round(list_entropy(string_split(word, '')), 9) AS entropy FROM words",
)
def q_entropy(spark, sf):
    return _words(spark, sf).select("word", F.round(shannon_entropy(F.col("word")), 9).alias("entropy"))


_SQL_DOC_LINES = (
    "dl AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line_text, "
    "CAST(generate_subscripts(string_split(text, chr(10)), 1) AS INTEGER) AS line FROM documents)"
)
_CHECKED_IDX = [i for i, r in enumerate(SECRET_RULES) if r[5]]


@register(
    "q_real_secret",
    f"WITH {_SQL_DOC_LINES}, dm AS ({O._secret_match_union('dl', 'doc_id')}) "
    "SELECT doc_id, line, code, sha256(value) AS value_sha, CAST(length(" + O._js_trim('value') + ") AS INTEGER) AS len16, "
    f"{O._placeholder(O._js_trim('value'))} AS is_placeholder, "
    f"(NOT {O._placeholder(O._js_trim('value'))} AND length(" + O._js_trim('value') + ") >= 16 AND list_entropy(string_split(" + O._js_trim('value') + ", '')) >= 3.5) AS is_real "
    f"FROM dm WHERE rule_idx IN ({', '.join(map(str, _CHECKED_IDX))})",
)
def q_real_secret(spark, sf):
    docs = _table(spark, sf, "documents").select("doc_id", F.col("text").alias("content"))
    m = secret_matches(docs, ["doc_id"]).where(F.col("rule_idx").isin(_CHECKED_IDX))
    m = with_secret_features(m, "value", "_s")
    return m.select(
        "doc_id", "line", "code", F.sha2("value", 256).alias("value_sha"), F.col("_s_len16").alias("len16"),
        F.col("_s_placeholder").alias("is_placeholder"), F.col("_s_real").alias("is_real"),
    )


@register(
    "q_reserved_email",
    f"WITH {_SQL_DOC_LINES}, dm AS ({O._secret_match_union('dl', 'doc_id')}) "
    "SELECT lower(regexp_extract(value, '[^@]*$')) AS domain, count(*) AS n, "
    + O._reserved("lower(regexp_extract(value, '[^@]*$'))")
    + " AS is_reserved "
    "FROM dm WHERE code = 'secrets/email' GROUP BY 1, 3",
)
def q_reserved_email(spark, sf):
    docs = _table(spark, sf, "documents").select("doc_id", F.col("text").alias("content"))
    m = secret_matches(docs, ["doc_id"]).where(F.col("code") == "secrets/email")
    d = F.lower(F.substring_index(F.col("value"), "@", -1))
    return m.groupBy(d.alias("domain")).agg(F.count(F.lit(1)).alias("n")).withColumn(
        "is_reserved", is_reserved_email_domain(F.col("domain"))
    )


# ---- findings and health ------------------------------------------------------
@register(
    "q_findings",
    O.build(
        f"SELECT {SQL_FINDING_OUT}, sev_rank, CASE WHEN file IS NOT NULL AND line > 0 THEN file || ':' || CAST(line AS VARCHAR) "
        "ELSE coalesce(file, '') END AS location, array_to_string(item_ord, '.') AS place FROM findings",
        "findings",
    ),
)
def q_findings(spark, sf):
    from weighbridge.operators.findings import finding_location

    f = fixture_audit(spark, sf).findings
    place = F.array_join(F.transform("item_ord", lambda x: x.cast("string")), ".").alias("place")
    return f.select(*FINDING_OUT, "sev_rank", finding_location(F.col("file"), F.col("line")).alias("location"), place)


@register(
    "q_distinct_suggestions",
    O.build(
        "SELECT repo_id, suggestion, first.f AS first_file, "
        "CAST(row_number() OVER (PARTITION BY repo_id ORDER BY first, suggestion) AS BIGINT) AS pos FROM ("
        f"SELECT repo_id, suggestion, {_FIRST} AS first FROM findings WHERE suggestion IS NOT NULL GROUP BY repo_id, suggestion)",
        "findings",
    ),
)
def q_distinct_suggestions(spark, sf):
    return fixture_audit(spark, sf).distinct_suggestions


@register("q_health", O.build("SELECT * FROM health", "health"))
def q_health(spark, sf):
    return fixture_audit(spark, sf).health


def _gate_sql(spec: str) -> str:
    min_rank, codes = H.parse_fail_on(spec)
    sev = f"sev_rank >= {min_rank}" if min_rank is not None else "false"
    code = f"code IN ({', '.join(O.q(c) for c in codes)})" if codes else "false"
    return O.build(
        "SELECT r.repo_id, CAST(coalesce(g.matched, 0) AS BIGINT) AS matched, CAST(coalesce(g.sev_matches, 0) AS BIGINT) AS sev_matches, "
        "CAST(coalesce(g.code_matches, 0) AS BIGINT) AS code_matches, coalesce(g.matched, 0) > 0 AS tripped FROM repos_v r LEFT JOIN ("
        f"SELECT repo_id, count(*) FILTER (WHERE {sev} OR {code}) AS matched, count(*) FILTER (WHERE {sev}) AS sev_matches, "
        f"count(*) FILTER (WHERE {code}) AS code_matches FROM findings GROUP BY repo_id) g ON g.repo_id = r.repo_id",
        "repos_v", "findings",
    )


@register("q_gate", _gate_sql(GATE_SPEC))
def q_gate(spark, sf):
    return fixture_audit(spark, sf).fail_on(GATE_SPEC)


def _label_case() -> str:
    parts = []
    for code, (one, many) in dims.PROBLEM_LABELS.items():
        parts.append(f"WHEN code = {O.q(code)} THEN CAST(n AS VARCHAR) || ' ' || CASE WHEN n = 1 THEN {O.q(one)} ELSE {O.q(many)} END")
    return "CASE " + " ".join(parts) + " END"


@register(
    "q_problem_summary",
    O.build(
        f"SELECT repo_id, code, CAST(n AS BIGINT) AS n, CAST(worst_rank AS INTEGER) AS worst_rank, {_label_case()} AS label, "
        "CAST(row_number() OVER (PARTITION BY repo_id ORDER BY worst_rank DESC, n DESC, first) AS INTEGER) AS pos FROM ("
        f"SELECT repo_id, code, count(*) AS n, max(sev_rank) AS worst_rank, {_FIRST} AS first FROM findings "
        f"WHERE code IN ({', '.join(O.q(c) for c in dims.PROBLEM_LABELS)}) GROUP BY repo_id, code)",
        "findings",
    ),
)
def q_problem_summary(spark, sf):
    return fixture_audit(spark, sf).problem_summary


@register(
    "q_finding_groups",
    O.build(
        "SELECT repo_id, code, CAST(n AS BIGINT) AS n, CAST(worst_rank AS INTEGER) AS worst_rank, first.f AS first_file, "
        "CAST(row_number() OVER (PARTITION BY repo_id ORDER BY worst_rank DESC, n DESC, first) AS INTEGER) AS pos FROM ("
        f"SELECT repo_id, code, count(*) AS n, max(sev_rank) AS worst_rank, {_FIRST} AS first FROM findings GROUP BY repo_id, code)",
        "findings",
    ),
)
def q_finding_groups(spark, sf):
    return fixture_audit(spark, sf).finding_groups


@register(
    "q_top_suggestions",
    O.build(
        "SELECT repo_id, CAST(pos AS INTEGER) AS pos, suggestion, CAST(greatest(nd - 3, 0) AS BIGINT) AS n_more FROM ("
        "SELECT repo_id, suggestion, row_number() OVER (PARTITION BY repo_id ORDER BY key) AS pos, count(*) OVER (PARTITION BY repo_id) AS nd FROM ("
        "SELECT repo_id, suggestion, min({'r': -sev_rank, 'f': file, 'o': rule_ord, 'i': item_ord}) AS key FROM findings "
        "WHERE suggestion IS NOT NULL GROUP BY repo_id, suggestion)) WHERE pos <= 3",
        "findings",
    ),
)
def q_top_suggestions(spark, sf):
    return fixture_audit(spark, sf).top_suggestions


# ---- tool servers -------------------------------------------------------------
@register("q_mcp_servers", O.build("SELECT * FROM mcp_srv", "mcp_srv"))
def q_mcp_servers(spark, sf):
    return fixture_audit(spark, sf).mcp_servers.select("repo_id", "server", "ord", "tools_json")


@register("q_mcp_cost", O.build("SELECT * FROM mcp_cost", "mcp_cost"))
def q_mcp_cost(spark, sf):
    return fixture_audit(spark, sf).mcp_costs


# ---- budget -------------------------------------------------------------------
ENTRY_OUT = ["repo_id", "label", "tokens", "load", "note", "own_tokens", "imported_tokens", "n_imports"]


@register("q_budget_entries", O.build(f"SELECT {', '.join(ENTRY_OUT)} FROM entries", "entries"))
def q_budget_entries(spark, sf):
    return fixture_audit(spark, sf).budget_entries.select(*ENTRY_OUT)


@register(
    "q_budget_totals",
    O.build(
        "SELECT *, CAST(200000 AS BIGINT) AS context_window, round(always_on_tokens / 200000.0 * 100.0, 1) AS window_pct FROM totals",
        "totals",
    ),
)
def q_budget_totals(spark, sf):
    return fixture_audit(spark, sf).budget.drop("est_cost_usd")


@register(
    "q_cost",
    O.build(
        f"SELECT repo_id, always_on_tokens, round(always_on_tokens / 1000000.0 * {dims.PRICING_USD_PER_MTOK[MODEL]}, 9) AS est_cost_usd FROM totals",
        "totals",
    ),
)
def q_cost(spark, sf):
    b = fixture_audit(spark, sf).budget
    return b.select("repo_id", "always_on_tokens", F.round("est_cost_usd", 9).alias("est_cost_usd"))


@register(
    "q_budget_rank",
    O.build(
        f"SELECT repo_id, label, tokens, load, CAST(row_number() OVER (PARTITION BY repo_id ORDER BY {O.ENTRY_ORDER}) AS BIGINT) AS rank FROM entries",
        "entries",
    ),
)
def q_budget_rank(spark, sf):
    return fixture_audit(spark, sf).budget_ranked.select("repo_id", "label", "tokens", "load", "rank")


@register(
    "q_budget_share",
    O.build(
        "SELECT e.repo_id, e.label, e.tokens, CAST(floor(e.tokens * 100.0 / CASE WHEN t.always_on_tokens + t.on_demand_tokens = 0 THEN 1 "
        "ELSE t.always_on_tokens + t.on_demand_tokens END + 0.5) AS BIGINT) AS share_pct FROM entries e JOIN totals t ON t.repo_id = e.repo_id",
        "entries", "totals",
    ),
)
def q_budget_share(spark, sf):
    return fixture_audit(spark, sf).budget_shares.select("repo_id", "label", "tokens", "share_pct")


@register(
    "q_budget_topk",
    O.build(
        "SELECT repo_id, label, tokens, load, CAST(NULL AS INTEGER) AS pos, CAST(1 AS BIGINT) AS n_entries FROM entries WHERE load = 'always' "
        "UNION ALL SELECT repo_id, label, tokens, load, CAST(pos AS INTEGER), CAST(1 AS BIGINT) FROM ("
        "SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY tokens DESC, src_ord, file_path NULLS FIRST, server_ord NULLS FIRST) AS pos "
        "FROM entries WHERE load = 'ondemand') WHERE pos <= 5 "
        "UNION ALL SELECT repo_id, 'more', CAST(sum(tokens) AS BIGINT), 'ondemand', 6, CAST(count(*) AS BIGINT) FROM ("
        "SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY tokens DESC, src_ord, file_path NULLS FIRST, server_ord NULLS FIRST) AS pos "
        "FROM entries WHERE load = 'ondemand') WHERE pos > 5 GROUP BY repo_id",
        "entries",
    ),
)
def q_budget_topk(spark, sf):
    return fixture_audit(spark, sf).budget_top


@register("q_token_count_bpe")
def q_token_count_bpe(spark, sf):
    """Exact BPE counts of every context file (no SQL oracle: the tokenizer is not SQL)."""
    ctx = fixture_audit(spark, sf, weigher="bpe").context.select("repo_id", "rel_path", "content")
    return with_tokens(ctx, weigher="bpe").drop("content")


@register(
    "q_conversation_budget",
    "SELECT conv_id, CAST(sum(CASE WHEN role = 'system' THEN ceil(strlen(text) / 4.0) ELSE 0 END) AS BIGINT) AS always_on_tokens, "
    "CAST(sum(CASE WHEN role = 'system' THEN 0 ELSE ceil(strlen(text) / 4.0) END) AS BIGINT) AS on_demand_tokens, "
    "CAST(count(*) FILTER (WHERE role <> 'system') AS BIGINT) AS on_demand_count, "
    "round(sum(CASE WHEN role = 'system' THEN ceil(strlen(text) / 4.0) ELSE 0 END) / 200000.0 * 100.0, 1) AS window_pct "
    "FROM conversations GROUP BY conv_id",
)
def q_conversation_budget(spark, sf):
    """Re-aimed budget: a conversation's system turns are always-on, the other turns on demand."""
    c = _table(spark, sf, "conversations")
    entries = c.select(
        F.col("conv_id"),
        bytes4(F.col("text")).alias("tokens"),
        F.when(F.col("role") == "system", F.lit("always")).otherwise(F.lit("ondemand")).alias("load"),
    )
    always = F.col("load") == "always"
    per = entries.groupBy("conv_id").agg(
        F.sum(F.when(always, F.col("tokens")).otherwise(0)).cast("long").alias("always_on_tokens"),
        F.sum(F.when(~always, F.col("tokens")).otherwise(0)).cast("long").alias("on_demand_tokens"),
        F.count_if(~always).cast("long").alias("on_demand_count"),
    )
    return per.withColumn("window_pct", F.round(F.col("always_on_tokens") / 200000.0 * 100.0, 1))


# ---- URLs and repository lists -----------------------------------------------
@register(
    "q_owner_repo",
    "SELECT page_id, url, regexp_replace(coalesce(p[-2], 'owner'), '[^A-Za-z0-9._-]', '-', 'g') AS owner, "
    "regexp_replace(coalesce(p[-1], 'repo'), '[^A-Za-z0-9._-]', '-', 'g') AS repo FROM ("
    "SELECT page_id, url, list_filter(regexp_split_to_array(regexp_replace(regexp_replace(url, '(?i)\\.git$', ''), '/+$', ''), '[/:]'), lambda x: x <> '') AS p "
    "FROM pages)",
)
def q_owner_repo(spark, sf):
    pages = _table(spark, sf, "pages")
    owner, repo = owner_repo(F.col("url"))
    return pages.select("page_id", "url", owner.alias("owner"), repo.alias("repo"))


@register(
    "q_repo_list",
    "SELECT line_no, url FROM (SELECT line_no, regexp_replace(regexp_replace(line, '\\r$', ''), '^\\s+|\\s+$', '', 'g') AS url FROM ("
    "SELECT page_id AS line_no, CASE WHEN page_id % 7 = 0 THEN '' WHEN page_id % 7 = 1 THEN '# ' || url "
    "WHEN page_id % 7 = 2 THEN '  ' || url || chr(13) WHEN page_id % 7 = 3 THEN chr(9) || url || '.git/ ' ELSE url END AS line FROM pages)) "
    "WHERE url <> '' AND NOT starts_with(url, '#')",
)
def q_repo_list(spark, sf):
    return lines_to_urls(urls_v(spark, sf)).select("line_no", "url")


# ---- corpus study -------------------------------------------------------------
def _results(spark, sf):
    return fixture_audit(spark, sf).scan_results(SCANNED_AT)


def _shared_path(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _stored(spark, sf) -> ResultStore:
    """A result store that two writers have filled with the same scan."""
    a, store = fixture_audit(spark, sf), ResultStore(spark, _shared_path(spark, "results"))
    results = materialize(a.scan_results(SCANNED_AT), "results")
    for _ in range(2):
        store.write(results, a.findings)
    a.release()
    return store


@register(
    "q_study_summary",
    O.build(
        "SELECT CAST(count(*) AS BIGINT) AS n_total, CAST(count(*) FILTER (WHERE status = 'ok') AS BIGINT) AS n_ok, "
        "CAST(count(*) FILTER (WHERE status = 'n/a') AS BIGINT) AS n_na, CAST(count(*) FILTER (WHERE status = 'error') AS BIGINT) AS n_error, "
        "CAST(coalesce((SELECT floor(median(always_on_tokens) + 0.5) FROM results WHERE status = 'ok'), 0) AS BIGINT) AS always_median, "
        "CAST(coalesce(min(always_on_tokens) FILTER (WHERE status = 'ok'), 0) AS BIGINT) AS always_min, "
        "CAST(coalesce(max(always_on_tokens) FILTER (WHERE status = 'ok'), 0) AS BIGINT) AS always_max, "
        "CAST(count(*) FILTER (WHERE status = 'ok' AND always_on_tokens > 2000) AS BIGINT) AS n_over_low, "
        "CAST(CASE WHEN count(*) FILTER (WHERE status = 'ok') = 0 THEN 0 ELSE floor(count(*) FILTER (WHERE status = 'ok' AND always_on_tokens > 2000) * 100.0 / count(*) FILTER (WHERE status = 'ok') + 0.5) END AS BIGINT) AS pct_over_low, "
        "CAST(count(*) FILTER (WHERE status = 'ok' AND always_on_tokens > 8000) AS BIGINT) AS n_over_high, "
        "CAST(CASE WHEN count(*) FILTER (WHERE status = 'ok') = 0 THEN 0 ELSE floor(count(*) FILTER (WHERE status = 'ok' AND always_on_tokens > 8000) * 100.0 / count(*) FILTER (WHERE status = 'ok') + 0.5) END AS BIGINT) AS pct_over_high, "
        "CAST(count(*) FILTER (WHERE status = 'ok' AND truncates) AS BIGINT) AS n_truncates, "
        "CAST(CASE WHEN count(*) FILTER (WHERE status = 'ok') = 0 THEN 0 ELSE floor(count(*) FILTER (WHERE status = 'ok' AND truncates) * 100.0 / count(*) FILTER (WHERE status = 'ok') + 0.5) END AS BIGINT) AS pct_truncates, "
        f"substr({O.q(SCANNED_AT)}, 1, 10) AS scan_date FROM results",
        "results",
    ),
)
def q_study_summary(spark, sf):
    return S.study_summary(_results(spark, sf))


@register(
    "q_study_histogram",
    O.build(
        "SELECT g.grade, CAST(g.grade_ord AS INTEGER) AS grade_ord, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repos FROM "
        "(SELECT * FROM (VALUES ('A', 0), ('B', 1), ('C', 2), ('D', 3), ('F', 4)) t(grade, grade_ord)) g "
        "LEFT JOIN (SELECT grade, count(*) AS n FROM results WHERE status = 'ok' GROUP BY grade) c ON c.grade = g.grade",
        "results",
    ),
)
def q_study_histogram(spark, sf):
    return S.study_grade_histogram(_results(spark, sf))


@register(
    "q_study_prevalence",
    O.build(
        "SELECT CAST(count(*) AS BIGINT) AS n_ok, CAST(count(*) FILTER (WHERE has_email) AS BIGINT) AS n_email, "
        "CAST(CASE WHEN count(*) = 0 THEN 0 ELSE floor(count(*) FILTER (WHERE has_email) * 100.0 / count(*) + 0.5) END AS BIGINT) AS pct_email, "
        "CAST(count(*) FILTER (WHERE has_private_ip) AS BIGINT) AS n_private_ip, "
        "CAST(CASE WHEN count(*) = 0 THEN 0 ELSE floor(count(*) FILTER (WHERE has_private_ip) * 100.0 / count(*) + 0.5) END AS BIGINT) AS pct_private_ip, "
        "CAST(count(*) FILTER (WHERE has_credential) AS BIGINT) AS n_credential, "
        "CAST(CASE WHEN count(*) = 0 THEN 0 ELSE floor(count(*) FILTER (WHERE has_credential) * 100.0 / count(*) + 0.5) END AS BIGINT) AS pct_credential "
        "FROM results WHERE status = 'ok'",
        "results",
    ),
)
def q_study_prevalence(spark, sf):
    return S.study_prevalence(_results(spark, sf))


@register(
    "q_study_ranking",
    O.build(
        "SELECT CAST(row_number() OVER (ORDER BY always_on_tokens DESC, owner || '/' || repo, repo_id) AS BIGINT) AS rank, "
        "owner || '/' || repo AS name, repo_id, grade, always_on_tokens, CASE WHEN truncates THEN 'yes' ELSE 'no' END AS truncates "
        "FROM results WHERE status = 'ok'",
        "results",
    ),
)
def q_study_ranking(spark, sf):
    return S.study_ranking(_results(spark, sf))


@register(
    "q_scan_results",
    O.build(
        "SELECT repo_id, status, grade, always_on_tokens, truncates, has_email, has_private_ip, has_credential FROM results",
        "results",
    ),
)
def q_scan_results(spark, sf):
    """The study's results written to a result store by two writers, and read back: one result counts."""
    return _stored(spark, sf).results().select(
        "repo_id", "status", "grade", "always_on_tokens", "truncates", "has_email", "has_private_ip", "has_credential"
    )


@register(
    "q_stored_findings",
    O.build("SELECT repo_id, file, line, severity, code, message, suggestion FROM findings", "findings"),
)
def q_stored_findings(spark, sf):
    """Every finding of the stored results, read back from the store."""
    return _stored(spark, sf).findings().select("repo_id", "file", "line", "severity", "code", "message", "suggestion")


@register(
    "q_incremental_scan",
    O.build(
        "SELECT repo_id, status, grade, always_on_tokens, truncates, has_email, has_private_ip, has_credential FROM results",
        "results",
    ),
)
def q_incremental_scan(spark, sf):
    """The study's results built in two runs: half of the repositories first, then whichever have no result yet."""
    from weighbridge.streaming.incremental import scan_pending

    files, repos = snapshot(spark, sf), repos_v(spark, sf)
    manifest = repos.join(files.groupBy("repo_id").agg(F.count(F.lit(1)).alias("n")), "repo_id", "left")
    manifest = manifest.select("repo_id", F.coalesce("n", F.lit(0)).alias("n_files"))
    out = _shared_path(spark, "scan")
    for run in (manifest.where(F.pmod(F.xxhash64("repo_id"), F.lit(2)) == 0), manifest):
        scan_pending(run, files, out, SCANNED_AT, weigher="bytes4", model=MODEL)
    r = ResultStore(spark, out).results()
    return r.select("repo_id", "status", "grade", "always_on_tokens", "truncates", "has_email", "has_private_ip", "has_credential")


# ---- documents -----------------------------------------------------------------
def _written(spark, lines: DataFrame, name: str) -> DataFrame:
    """Documents written as a bundle, and their lines read back without leading commas."""
    path = _shared_path(spark, name)
    write_documents(lines, path, by_repository=False)
    return read_documents(spark, path).withColumn("json", F.ltrim("line", F.lit(",")))


def _sarif_back(spark, sf) -> DataFrame:
    a = fixture_audit(spark, sf)
    return _written(spark, sarif_lines(a.findings, a.health), "sarif")


@register("q_sarif")
def q_sarif(spark, sf):
    """SARIF 2.1.0 documents, one per repository, as ordered lines (rows only; structure is covered by pytest)."""
    a = fixture_audit(spark, sf)
    return sarif_lines(a.findings, a.health)


@register(
    "q_sarif_results",
    O.build(
        "SELECT repo_id, file AS uri, code AS rule_id, CASE severity WHEN 'error' THEN 'error' WHEN 'warn' THEN 'warning' ELSE 'note' END AS level, "
        "CASE WHEN line > 0 THEN line END AS start_line, message, "
        "CAST(row_number() OVER (PARTITION BY repo_id ORDER BY file, rule_ord, item_ord, code, message) - 1 AS BIGINT) AS position FROM findings",
        "findings",
    ),
)
def q_sarif_results(spark, sf):
    """The results of the written SARIF documents, read back from their text, with their positions in the repository."""
    place = "physicalLocation struct<artifactLocation: struct<uri: string>, region: struct<startLine: int>>"
    result = f"struct<ruleId: string, level: string, message: struct<text: string>, locations: array<struct<{place}>>>"
    rows = _sarif_back(spark, sf).where(F.col("json").startswith('{"ruleId":')).withColumn("r", F.from_json("json", result))
    spot = F.col("r.locations")[0]["physicalLocation"]
    return rows.select(
        "repo_id",
        spot["artifactLocation"]["uri"].alias("uri"),
        F.col("r.ruleId").alias("rule_id"),
        F.col("r.level").alias("level"),
        spot["region"]["startLine"].alias("start_line"),
        F.col("r.message.text").alias("message"),
        (F.col("position") - 1).cast("long").alias("position"),
    )


@register(
    "q_sarif_rules",
    O.build(
        "SELECT repo_id, CAST(row_number() OVER (PARTITION BY repo_id ORDER BY first) - 1 AS INTEGER) AS position, code AS rule_id FROM "
        "(SELECT repo_id, code, min({'file': file, 'rule_ord': rule_ord, 'item_ord': item_ord}) AS first FROM findings GROUP BY repo_id, code)",
        "findings",
    ),
)
def q_sarif_rules(spark, sf):
    """The rules of the written SARIF documents, in the order in which their repositories' findings have them."""
    opening = _sarif_back(spark, sf).where(F.col("position") == 0)
    text = F.concat("json", F.lit("]}]}"))  # the opening line alone, closed
    runs = F.from_json(text, "struct<runs: array<struct<tool: struct<driver: struct<rules: array<struct<id: string>>>>>>>")["runs"]
    return opening.select("repo_id", F.posexplode(runs[0]["tool"]["driver"]["rules"]["id"]).alias("position", "rule_id"))


def _report_back(spark, sf) -> DataFrame:
    return _written(spark, report_lines(fixture_audit(spark, sf)), "report")


@register(
    "q_json_report",
    O.build(
        "SELECT h.repo_id, h.grade, CAST(h.score AS BIGINT) AS score, h.no_context, t.always_on_tokens, t.on_demand_tokens, t.on_demand_count, "
        "round(t.always_on_tokens / 1000000.0::DOUBLE * 5.0::DOUBLE, 9) AS est_cost_usd FROM health h JOIN totals t ON t.repo_id = h.repo_id",
        "health",
        "totals",
    ),
)
def q_json_report(spark, sf):
    """Score and totals of the written payloads, read back from their opening and middle lines."""
    rows = _report_back(spark, sf)
    health = F.from_json(F.concat("json", F.lit("]}}")), "struct<health: struct<grade: string, score: long, noContext: boolean>>")["health"]
    top = rows.where(F.col("position") == 0).select("repo_id", health.alias("h"))
    budget = F.from_json(
        F.concat(F.lit("{"), F.substring("json", 4, 1_000_000), F.lit("]}}")),
        "struct<budget: struct<alwaysOnTokens: long, onDemandTokens: long, onDemandCount: long, estCostUsd: double>>",
    )["budget"]
    middle = rows.where(F.col("json").startswith(']},"budget":')).select("repo_id", budget.alias("b"))
    return top.join(middle, "repo_id").select(
        "repo_id", F.col("h.grade").alias("grade"), F.col("h.score").alias("score"), F.col("h.noContext").alias("no_context"),
        F.col("b.alwaysOnTokens").alias("always_on_tokens"), F.col("b.onDemandTokens").alias("on_demand_tokens"),
        F.col("b.onDemandCount").alias("on_demand_count"), F.round("b.estCostUsd", 9).alias("est_cost_usd"),
    )


@register(
    "q_json_findings",
    O.build(
        "SELECT repo_id, CAST(row_number() OVER (PARTITION BY repo_id ORDER BY file, rule_ord, item_ord, code, message) AS INTEGER) AS position, "
        "severity, code, message, suggestion, file, CASE WHEN line > 0 THEN line END AS line FROM findings",
        "findings",
    ),
)
def q_json_findings(spark, sf):
    """The findings of the written payloads, read back from their lines, in their order."""
    fields = "struct<severity: string, code: string, message: string, suggestion: string, file: string, line: int>"
    rows = _report_back(spark, sf).where(F.col("json").startswith('{"severity":')).withColumn("f", F.from_json("json", fields))
    position = F.row_number().over(W.partitionBy("repo_id").orderBy("position")).alias("position")
    return rows.select("repo_id", position, "f.*")


@register(
    "q_json_entries",
    O.build(
        f"SELECT repo_id, CAST(row_number() OVER (PARTITION BY repo_id ORDER BY {O.ENTRY_ORDER}) AS INTEGER) AS position, label, tokens, load, note, "
        "own_tokens, imported_tokens, CASE WHEN n_imports IS NULL THEN NULL ELSE (SELECT string_agg(imported_path, ' ' ORDER BY imported_path) FROM claims c "
        "WHERE c.repo_id = entries.repo_id AND c.importer_path = entries.label) END AS imports FROM entries",
        "entries",
        "claims",
    ),
)
def q_json_entries(spark, sf):
    """The budget entries of the written payloads with the files they fold in, read back from their lines, heaviest first."""
    rows = _report_back(spark, sf)
    opens, name = F.col("json").startswith('{"label":'), F.col("json").startswith('"')
    rows = rows.where(opens | name).withColumn("position", F.sum(opens.cast("int")).over(W.partitionBy("repo_id").orderBy("position")).cast("int"))
    closed = F.when(F.col("json").endswith("["), F.concat("json", F.lit("]}"))).otherwise(F.col("json"))
    fields = "struct<label: string, tokens: long, load: string, note: string, ownTokens: long, importedTokens: long>"
    heads = rows.where(opens).select("repo_id", "position", F.from_json(closed, fields).alias("e"))
    names = rows.where(name).groupBy("repo_id", "position").agg(F.array_join(F.array_sort(F.collect_list(F.from_json(F.concat(F.lit("["), "json", F.lit("]")), "array<string>")[0])), " ").alias("imports"))
    return heads.join(names, ["repo_id", "position"], "left").select(
        "repo_id", "position", "e.label", "e.tokens", "e.load", "e.note", F.col("e.ownTokens").alias("own_tokens"), F.col("e.importedTokens").alias("imported_tokens"), "imports"
    )


@register("q_snapshot_scan", O.build("SELECT repo_id, rel_path, kind, load, bytes, lines FROM ctx", "ctx"))
def q_snapshot_scan(spark, sf):
    """The context scan over a snapshot laid out by path class, written and loaded again."""
    from weighbridge.operators.classify import scan_context_files
    from weighbridge.sinks.writers import write_snapshot
    from weighbridge.sources.readers import load_snapshot

    path = _shared_path(spark, "snapshot")
    write_snapshot(snapshot(spark, sf), path)
    return scan_context_files(load_snapshot(spark, path)).select("repo_id", "rel_path", "kind", "load", "bytes", "lines")
