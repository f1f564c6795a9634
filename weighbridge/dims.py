"""Fixed values the results depend on, stated once, in natural order.

These must equal the audited tool's values for the results to match; they are
plain data, used as literals in column expressions (a CASE over a handful of
literals beats any join) or as tiny dimension DataFrames for reports.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# ---- fixed values: context file names and their kind -------------------------
EXACT_KINDS = {
    "CLAUDE.md": "claude",
    "CLAUDE.local.md": "claude",
    "AGENTS.md": "agents",
    "GEMINI.md": "gemini",
    ".cursorrules": "cursor",
    ".windsurfrules": "windsurf",
    "copilot-instructions.md": "copilot",
    "CONTEXT_FOR_AI.md": "other",
}
SKILL_NAME = "SKILL.md"  # kind "skill", loaded on demand
RULE_SUFFIX = ".mdc"  # kind "cursor", loaded on demand

# ---- fixed values: discovery limits ------------------------------------------
IGNORE_DIRS = ["node_modules", ".git", "dist", "build", ".next", "vendor", "coverage"]
MAX_DEPTH = 6  # at most this many parent directories

# ---- fixed values: file names an @import can reach, and config files -------
IMPORTABLE_NAME = r"(?i)\.(markdown|mdx|mdc|md|txt|rst)\z"
CONFIG_NAME = r"(?i)\.json\z"

# ---- fixed values: health rules ----------------------------------------------
MAX_LINES = 200
MAX_BYTES = 32 * 1024
SEVERITY_RANK = {"info": 1, "warn": 2, "error": 3}
SEVERITY_PENALTY = {"info": 2, "warn": 8, "error": 25}
GRADE_FLOORS = [("A", 90), ("B", 80), ("C", 70), ("D", 60)]  # else "F"
GRADES = ["A", "B", "C", "D", "F"]

# ---- fixed values: budget ----------------------------------------------------
PRICING_USD_PER_MTOK = {
    "claude-opus": 5.0,
    "claude-sonnet": 3.0,
    "claude-haiku": 1.0,
    "gpt-default": 2.5,
}
DEFAULT_CONTEXT_WINDOW = 200_000
ON_DEMAND_TOP = 5
TOP_SUGGESTIONS = 3
OFFLINE_NOTE = "schemas not available offline"

# ---- fixed values: finding codes ---------------------------------------------
CODE_TOO_LONG = "budget/too-long"
CODE_OVER_TRUNCATION = "budget/over-truncation-limit"
CODE_UNRESOLVED = "imports/unresolved"
CODE_PLACEHOLDER = "secrets/placeholder"
# problem codes with their summary noun (singular, plural); placeholder is not a problem
PROBLEM_LABELS = {
    "budget/too-long": ("file too long", "files too long"),
    "budget/over-truncation-limit": ("truncated (>32 KiB)", "truncated (>32 KiB)"),
    "imports/unresolved": ("broken import", "broken imports"),
    "secrets/email": ("email in context", "emails in context"),
    "secrets/private-ip": ("private IP in context", "private IPs in context"),
    "secrets/private-key": ("private key in context", "private keys in context"),
    "secrets/aws-key": ("AWS key in context", "AWS keys in context"),
    "secrets/openai-key": ("API key in context", "API keys in context"),
    "secrets/bearer": ("bearer token in context", "bearer tokens in context"),
    "secrets/generic-token": ("token in context", "tokens in context"),
}
CREDENTIAL_CODES = [
    "secrets/generic-token",
    "secrets/openai-key",
    "secrets/bearer",
    "secrets/aws-key",
    "secrets/private-key",
]
PII_CODES = ["secrets/email", "secrets/private-ip"]

# ---- fixed values: suggestion and message texts ------------------------------
SUGGEST_SECRET_PII = "Remove or redact this — context files are committed and sent to the agent on every run."
SUGGEST_SECRET = "Remove this value and inject it at runtime instead — context files are committed AND logged."
SUGGEST_UNRESOLVED = "Fix or remove this @import — the referenced file wasn't found."
# {limit} is the limit asked for; %s and %d are a finding's own values, in the order named
MESSAGE_TOO_LONG = '%s is %d lines (recommended <= {limit}); tail may be ignored ("lost in the middle")%s.'  # path, lines, hint
MESSAGE_OVER_TRUNCATION = "%s is %s KiB; some agents truncate past {limit} KiB%s."  # path, KiB, hint
MESSAGE_UNRESOLVED = '%s imports "@%s" which could not be resolved (file missing or unreadable).'  # path, spec
SUGGEST_TOO_LONG = "Trim %s to the essentials, or split it via @imports and move task-specific guidance into on-demand skills."  # path
SUGGEST_OVER_TRUNCATION = (  # path, KiB
    "Split %s (%s KiB): move stable, rarely-read sections into @imported files or on-demand skills so the always-on core stays under {limit} KiB."
)
ON_DEMAND_HINT = " — on-demand, so it only costs tokens when invoked, not every turn"

# ---- fixed values: SARIF -----------------------------------------------------
SARIF_SCHEMA = "https://json.schemastore.org/sarif-2.1.0.json"
SARIF_LEVEL = {"error": "error", "warn": "warning", "info": "note"}
SARIF_NO_CONTEXT = "No agent context files found — nothing to audit (health is N/A)."


def _literal_table(spark: SparkSession, names: list[str], rows: list[tuple]) -> DataFrame:
    """A small fixed table built JVM-side (no Python data transfer)."""
    from pyspark.sql import functions as F

    structs = [F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row)]) for row in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))


def grade_dim(spark: SparkSession) -> DataFrame:
    return _literal_table(spark, ["grade", "grade_ord"], [(g, i) for i, g in enumerate(GRADES)])
