"""Secret and personal-data scan over context files.

Plan: one combined regex prefilter on the whole text (narrow, JVM-side) →
only files that hit are split into numbered lines → only lines that hit are
matched per rule → captured values are classified with native placeholder,
length and entropy tests. No Python runs and raw values never leave the
operator: findings keep a SHA-256 and a mask.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weighbridge import dims
from weighbridge.functions.placeholders import is_reserved_email_domain, with_secret_features
from weighbridge.operators.findings import _finish

# ---- fixed values: secret rules (public formats; order = report order) -------
# (code, Java regex, capture group, severity, what the message calls it, checked)
# "checked" captures pass through looks_like_real_secret; failures become
# secrets/placeholder (info).
SECRET_RULES = [
    ("secrets/private-key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, "error", "private key", False),
    ("secrets/aws-key", r"(?<![A-Za-z0-9_])AKIA[0-9A-Z]{16}(?![A-Za-z0-9_])", 0, "error", "AWS access key", False),
    ("secrets/openai-key", r"(?<![A-Za-z0-9_])sk-(?:proj-)?[A-Za-z0-9_-]{16,}", 0, "error", "API key", True),
    ("secrets/bearer", r"(?i)bearer\s+([A-Za-z0-9._~+/=-]{16,})", 1, "error", "bearer token", True),
    ("secrets/generic-token", r"""(?i)(?:api[_-]?key|token|secret|password)\s*[:=]\s*["']?([^\s"']{8,})""", 1, "error", "token", True),
    # each run of local-part characters is tried once, from its start (or the last match's end)
    ("secrets/email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", 0, "warn", "email address", False),
    ("secrets/private-ip", r"(?<![A-Za-z0-9_.])(?:10\.\d{1,3}\.\d{1,3}\.\d{1,3}|172\.(?:1[6-9]|2\d|3[01])\.\d{1,3}\.\d{1,3}|192\.168\.\d{1,3}\.\d{1,3})(?!\.*[A-Za-z0-9_])", 0, "warn", "private IP address", False),
]
ANY_SECRET = "|".join(f"(?:{rule[1]})" for rule in SECRET_RULES)

# Literal needles, one list per rule (same order): a rule's regex can only match
# text that contains one of its needles ("lower:" needles are searched in the
# lower-cased text). Substring search is far cheaper than any regex, so the
# regexes run only on the few lines that can match.
RULE_NEEDLES = [
    ["PRIVATE KEY"],
    ["AKIA"],
    ["sk-"],
    ["lower:bearer"],
    ["lower:api", "lower:token", "lower:secret", "lower:password"],
    ["@"],
    ["10.", "172.", "192.168."],
]


def _needle_hit(raw: Column, low: Column, needles: list[str]) -> Column:
    hit = None
    for n in needles:
        h = low.contains(n[len("lower:"):]) if n.startswith("lower:") else raw.contains(n)
        hit = h if hit is None else (hit | h)
    return hit


def any_needle(text: Column) -> Column:
    """Any rule's needle present (null: null).

    The text, and its lower-cased form where no exact needle is found, are the one element of an array that a lambda names:
    a filter would evaluate either anew for each needle. Lower-casing once and searching costs less than a ``(?i)`` alternation.
    """
    exact = [n for needles in RULE_NEEDLES for n in needles if not n.startswith("lower:")]
    folded = [n for needles in RULE_NEEDLES for n in needles if n.startswith("lower:")]
    return F.exists(
        F.array(text),
        lambda raw: _needle_hit(raw, raw, exact) | F.exists(F.array(F.lower(raw)), lambda low: _needle_hit(low, low, folded)),
    )


def _mask(v: Column) -> Column:
    n = F.length(v)
    return F.when(n <= 8, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.substring(v, 1, 4), F.repeat(F.lit("*"), n - 4)))


def _tag(idx: int, code: str):
    def tag(v: Column, i: Column) -> Column:
        return F.struct(F.lit(idx).alias("rule_idx"), i.alias("match_idx"), F.lit(code).alias("code"), v.alias("value"))

    return tag


def secret_matches(texts: DataFrame, key_cols: list[str], text_col: str = "content") -> DataFrame:
    """Raw rule hits: ``*key_cols, line, rule_idx, match_idx, code, value`` (1-based line)."""
    t = F.col(text_col)
    # 1) whole texts: literal needles only
    cand = texts.where(any_needle(t))
    # 2) numbered lines of the candidate texts; keep lines with a needle
    lines = cand.select(*key_cols, F.posexplode(F.split(t, "\n", -1)).alias("line_idx", "line_text"))
    raw, low = F.col("line_text"), F.col("_low")
    lines = lines.where(any_needle(raw)).withColumn("_low", F.lower(raw))
    # 3) per rule, the regex runs only where that rule's needle is present
    empty = F.array().cast("array<struct<rule_idx:int,match_idx:int,code:string,value:string>>")
    per_rule = []
    for idx, (code, regex, group, _sev, _what, _checked) in enumerate(SECRET_RULES):
        hits = F.transform(F.regexp_extract_all(raw, F.lit(regex), group), _tag(idx, code))
        per_rule.append(F.when(_needle_hit(raw, low, RULE_NEEDLES[idx]), hits).otherwise(empty))
    return lines.select(
        *key_cols,
        (F.col("line_idx") + 1).cast("int").alias("line"),
        F.explode(F.flatten(F.array(*per_rule))).alias("m"),
    ).select(*key_cols, "line", "m.rule_idx", "m.match_idx", "m.code", "m.value")


def _valid_private_ip(v: Column) -> Column:
    octets = F.split(v, r"\.")
    return F.forall(octets, lambda o: o.try_cast("int") <= 255)


def classify_matches(matches: DataFrame, keep_reserved_email: bool = False) -> DataFrame:
    """Add ``final_code, severity, value_sha, value_mask``; drop reserved e-mails and bad IPs."""
    code, value = F.col("code"), F.col("value")
    checked = code.isin([r[0] for r in SECRET_RULES if r[5]])
    sev = None
    for rcode, _re, _g, rsev, _w, _c in SECRET_RULES:
        sev = F.when(code == rcode, F.lit(rsev)) if sev is None else sev.when(code == rcode, F.lit(rsev))
    domain = F.substring_index(value, "@", -1)
    out = matches.where(~((code == "secrets/private-ip") & ~_valid_private_ip(value)))
    out = out.withColumn("_reserved", (code == "secrets/email") & is_reserved_email_domain(domain))
    if not keep_reserved_email:
        out = out.where(~F.col("_reserved"))
    out = with_secret_features(out, "value", "_s")
    demoted = F.col("_reserved") | (checked & ~F.col("_s_real"))
    final_code = F.when(demoted, F.lit(dims.CODE_PLACEHOLDER)).otherwise(code)
    severity = F.when(demoted, F.lit("info")).otherwise(sev)
    return out.select(
        *matches.columns,
        final_code.alias("final_code"),
        severity.alias("severity"),
        F.sha2(value, 256).alias("value_sha"),
        _mask(value).alias("value_mask"),
    )


def secret_findings(context: DataFrame, keep_reserved_email: bool = False) -> DataFrame:
    """Findings rows (``FINDING_COLUMNS``) for every secret hit in the context files."""
    m = classify_matches(secret_matches(context, ["repo_id", "rel_path"]), keep_reserved_email)
    what = None
    for rcode, _re, _g, _s, rwhat, _c in SECRET_RULES:
        what = F.when(F.col("code") == rcode, F.lit(rwhat)) if what is None else what.when(F.col("code") == rcode, F.lit(rwhat))
    is_placeholder = F.col("final_code") == dims.CODE_PLACEHOLDER
    message = F.when(
        is_placeholder,
        F.format_string("%s line %d: %s looks like a documentation placeholder (%s).", F.col("rel_path"), F.col("line"), what, F.col("value_mask")),
    ).otherwise(F.format_string("%s line %d: possible %s (%s).", F.col("rel_path"), F.col("line"), what, F.col("value_mask")))
    suggestion = F.when(F.col("final_code").isin(dims.PII_CODES), F.lit(dims.SUGGEST_SECRET_PII)).otherwise(
        F.lit(dims.SUGGEST_SECRET)
    )
    item = F.array(F.col("line").cast("long"), F.col("rule_idx").cast("long"), F.col("match_idx").cast("long"))
    return _finish(
        m.select(
            "repo_id",
            F.col("rel_path").alias("file"),
            "line",
            F.lit(3).alias("rule_ord"),
            item.alias("item_ord"),
            "severity",
            F.col("final_code").alias("code"),
            message.alias("message"),
            suggestion.alias("suggestion"),
        )
    )
