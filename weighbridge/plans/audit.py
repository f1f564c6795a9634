"""The audit as one lazy plan over a snapshot of many repositories.

``audit(files)`` returns an :class:`Audit` whose attributes are DataFrames;
nothing runs until one of them is used. The context table is derived once and
shared by health and budget (the audited tool scanned and tokenized twice).
"""

from __future__ import annotations

from concurrent.futures import Future, ThreadPoolExecutor
from functools import cached_property

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weighbridge import dims
from weighbridge.functions.tokens import with_tokens
from weighbridge.operators import budget as B
from weighbridge.operators import health as H
from weighbridge.operators.classify import scan_context_files
from weighbridge.operators.findings import size_findings, union_findings, unresolved_findings
from weighbridge.operators.imports import ImportForest, claim_imports, extract_edges, fold_edges, import_closure, import_forest, target_scope, text_facts, unresolved_imports
from weighbridge.operators.mcp import mcp_costs, mcp_servers
from weighbridge.operators.secrets import secret_findings
from weighbridge.session import materialize


class Audit:
    def __init__(
        self,
        files: DataFrame,
        repos: DataFrame | None = None,
        model: str | None = None,
        window: int = dims.DEFAULT_CONTEXT_WINDOW,
        mcp_path: str = ".mcp.json",
        weigher: str = "bpe",
        dedupe: bool = True,
        ranks_path: str | None = None,
        pattern: str | None = None,
        max_lines: int = dims.MAX_LINES,
        max_bytes: int = dims.MAX_BYTES,
        keep_reserved_email: bool = False,
        path_collation: str = "UTF8_BINARY",
    ):
        keep = ["path_class"] if "path_class" in files.columns else []
        self.files = files.select("repo_id", "rel_path", "content", *keep)
        self._repos = repos
        self.model = model
        self.window = window
        self.mcp_path = mcp_path
        self.weigher = weigher
        self.token_opts = {"dedupe": dedupe, "ranks_path": ranks_path, "pattern": pattern}
        self.max_lines = max_lines
        self.max_bytes = max_bytes
        self.keep_reserved_email = keep_reserved_email
        self.path_collation = path_collation

    def release(self) -> None:
        """Give back what the audit keeps on executors; its tables can still be used."""
        for name in ("context", "text_facts", "context_rows", "token_table", "findings", "health", "mcp_costs", "budget_entries"):
            if name in self.__dict__:
                self.__dict__[name].unpersist()

    # ---- scan ------------------------------------------------------------------
    @cached_property
    def repos(self) -> DataFrame:
        if self._repos is not None:
            return self._repos.select("repo_id")
        return self.files.select("repo_id").distinct()

    @cached_property
    def errors(self) -> DataFrame:
        """``repo_id, rel_path, error``: files the snapshot could not read (null
        content). The job goes on; a repository where a context file is unreadable
        gets the ``error`` status in the study. An ``IS NULL`` scan, which parquet
        null-count statistics prune to almost nothing."""
        return self.files.where(F.col("content").isNull()).select("repo_id", "rel_path", F.lit("unreadable").alias("error"))

    @cached_property
    def _context(self) -> DataFrame:
        return scan_context_files(self.files)

    @cached_property
    def context(self) -> DataFrame:
        """Context files with their text, kept (memory and disk) for callers that read it several times."""
        return self._context.persist(StorageLevel.MEMORY_AND_DISK)

    @cached_property
    def texts(self) -> DataFrame:
        """Context files with their text, as the audit itself reads them. The tokenizer and the secret scan both
        read texts, which are kept for them; where byte counts weigh, the secret scan alone does, and nothing is kept
        (what was kept by :attr:`context` is used)."""
        return self.context if self.weigher == "bpe" else self._context

    @cached_property
    def text_facts(self) -> DataFrame:
        """Sizes and import specs of every file that an import tree can hold, as short rows: kept, so edges, sizes,
        byte weights and unreadable files cost one reading of the texts."""
        return text_facts(self.files).persist(StorageLevel.MEMORY_AND_DISK)

    @cached_property
    def context_rows(self) -> DataFrame:
        """Context files without their text: all that imports, size rules, health and byte weights need; kept."""
        rows = self.texts.drop("content") if self.weigher == "bpe" else scan_context_files(self.text_facts)
        return rows.persist(StorageLevel.MEMORY_AND_DISK)

    @cached_property
    def context_errors(self) -> DataFrame:
        """``repo_id, rel_path``: unreadable context files. Any other unreadable file
        is at most a broken import."""
        return scan_context_files(self.text_facts.where(~F.col("readable"))).select("repo_id", "rel_path")

    # ---- imports ---------------------------------------------------------------
    @cached_property
    def edges(self) -> DataFrame:
        """Import edges, computed once (one narrow regex pass) and checkpointed:
        the closure, unresolved specs and budget all read this short table."""
        edges = extract_edges(self.files, self.text_facts)
        out = materialize(edges, "edges")
        edges.raw_rows.unpersist()
        return out

    @cached_property
    def reach(self) -> DataFrame:
        return import_closure(self.fold, self.context_rows.select("repo_id", "rel_path"))

    @cached_property
    def fold(self) -> DataFrame:
        return fold_edges(self.edges)

    @cached_property
    def forest(self) -> ImportForest:
        """Files with one importer, and the heads of their trees: read by claims and broken specs."""
        return import_forest(self.fold)

    @cached_property
    def claims(self) -> DataFrame:
        return claim_imports(self.fold, self.context_rows.select("repo_id", "rel_path"), self.path_collation, self.forest)

    @cached_property
    def unresolved(self) -> DataFrame:
        return unresolved_imports(self.edges, self.fold, self.context_rows.select("repo_id", "rel_path"), self.forest)

    # ---- tokens ----------------------------------------------------------------
    def _weighed(self, rows: DataFrame) -> DataFrame:
        return with_tokens(rows, "content", "tokens", weigher=self.weigher, **self.token_opts).drop("content")

    @cached_property
    def token_table(self) -> DataFrame:
        """``repo_id, rel_path, is_context, load, tokens`` for context files and claimed imports."""
        own = ["repo_id", "rel_path", F.lit(True).alias("is_context"), "load"]
        wanted = self.claims.select("repo_id", F.col("imported_path").alias("rel_path")).distinct()
        other = ["repo_id", "rel_path", F.lit(False).alias("is_context"), F.lit(None).cast("string").alias("load")]
        importable = F.col("rel_path").rlike(dims.IMPORTABLE_NAME)
        if self.weigher == "bytes4":  # of the sizes that are kept, so no text is read again or shuffled
            tokens = F.ceil(F.col("bytes") / 4).cast("long").alias("tokens")
            folded = self.text_facts.where(importable).select(*other, tokens)
            t = self.context_rows.select(*own, tokens).unionByName(folded.join(wanted, ["repo_id", "rel_path"], "left_semi"))
        else:
            ctx = self.texts.select(*own, "content")
            folded = target_scope(self.files).where(importable).select(*other, "content")
            t = self._weighed(ctx.unionByName(folded.join(wanted, ["repo_id", "rel_path"], "left_semi")))
        out = t.select("repo_id", "rel_path", "is_context", "load", F.coalesce(F.col("tokens"), F.lit(0)).cast("long").alias("tokens"))
        # keys and counts only (no text): kept for the budget's several readers
        return out.persist(StorageLevel.MEMORY_AND_DISK)

    @cached_property
    def imported(self) -> DataFrame:
        """``repo_id, importer_path, imported_tokens, n_imports`` for each importer that claimed files."""
        tok = self.token_table.where(~F.col("is_context")).select(
            "repo_id", F.col("rel_path").alias("imported_path"), "tokens"
        )
        return self.claims.join(tok, ["repo_id", "imported_path"]).groupBy("repo_id", "importer_path").agg(
            F.sum("tokens").cast("long").alias("imported_tokens"), F.count(F.lit(1)).cast("long").alias("n_imports")
        )

    # ---- health ----------------------------------------------------------------
    @cached_property
    def findings(self) -> DataFrame:
        """All findings; persisted (they are short rows, read by health, gate,
        summaries, SARIF and the study flags)."""
        return union_findings(
            size_findings(self.context_rows, self.max_lines, self.max_bytes),
            secret_findings(self.texts, self.keep_reserved_email),
            unresolved_findings(self.unresolved),
        ).persist(StorageLevel.MEMORY_AND_DISK)

    @cached_property
    def health(self) -> DataFrame:
        # one short row per repository, read by several sections of a report: kept
        return H.health(self.repos, self.context_rows, self.findings).persist(StorageLevel.MEMORY_AND_DISK)

    def fail_on(self, spec: str) -> DataFrame:
        return H.fail_on_gate(self.repos, self.findings, spec)

    @cached_property
    def problem_summary(self) -> DataFrame:
        return H.problem_summary(self.findings, collation=self.path_collation)

    @cached_property
    def finding_groups(self) -> DataFrame:
        return H.finding_groups(self.findings, collation=self.path_collation)

    @cached_property
    def distinct_suggestions(self) -> DataFrame:
        return H.distinct_first_seen(self.findings, collation=self.path_collation)

    @cached_property
    def top_suggestions(self) -> DataFrame:
        return H.top_suggestions(self.findings, collation=self.path_collation)

    # ---- tool servers and budget ----------------------------------------------
    @cached_property
    def mcp_servers(self) -> DataFrame:
        return mcp_servers(self.files, self.mcp_path)

    @cached_property
    def _mcp_costs(self) -> DataFrame:
        return mcp_costs(self.mcp_servers, self.weigher, **self.token_opts)

    @cached_property
    def _mcp_costs_ahead(self) -> Future:
        """:attr:`_mcp_costs`, on its way: configs are parsed, work for every core, while imports are claimed, rounds of small
        jobs that leave most cores idle. Neither reads anything of the other."""
        pool = ThreadPoolExecutor(1)
        costs = pool.submit(inheritable_thread_target(self.files.sparkSession)(lambda: self._mcp_costs))
        pool.shutdown(wait=False)
        return costs

    @cached_property
    def mcp_costs(self) -> DataFrame:
        # one short row per server: kept for callers that read it several times
        return self._mcp_costs.persist(StorageLevel.MEMORY_AND_DISK)

    @cached_property
    def _entries(self) -> DataFrame:
        costs = self._mcp_costs_ahead
        ctx_tok = self.token_table.where(F.col("is_context"))
        return B.budget_entries(ctx_tok, self.imported, costs.result())

    @cached_property
    def budget_entries(self) -> DataFrame:
        # short rows, read by totals, ranks, shares and the top entries: kept, so the joins below are made once
        return self._entries.persist(StorageLevel.MEMORY_AND_DISK)

    @cached_property
    def budget(self) -> DataFrame:
        # totals alone read the entries once: rows are kept only where budget_entries is asked for, and then used here too
        return B.budget_totals(self.repos, self._entries, self.model, self.window)

    @cached_property
    def budget_ranked(self) -> DataFrame:
        return B.budget_rank(self.budget_entries, self.path_collation)

    @cached_property
    def budget_shares(self) -> DataFrame:
        return B.budget_share(self.budget_entries, self.budget)

    @cached_property
    def budget_top(self) -> DataFrame:
        return B.budget_top_on_demand(self.budget_entries, collation=self.path_collation)

    # ---- corpus ----------------------------------------------------------------
    def scan_results(self, scanned_at: str, urls: DataFrame | None = None) -> DataFrame:
        from weighbridge.operators.study import scan_results

        self._mcp_costs_ahead  # the budget's; findings are made first
        return scan_results(self, scanned_at, urls)


def audit(files: DataFrame, **options) -> Audit:
    return Audit(files, **options)
