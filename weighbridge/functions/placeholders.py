"""Telling documentation placeholders from real secrets, as native columns.

Every test is a JVM-side expression (``rlike``, higher-order functions), so
the secret scan stays inside whole-stage code generation; no Python runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weighbridge.functions.text import js_trim, utf16_length

# ---- fixed values: placeholder patterns (Java syntax, in the audited order) ----
# JavaScript's end-of-input "$" is written "\z" (Java's "$" also matches before a
# final line break); "(?i)" marks the patterns that ignore case.
PLACEHOLDER_PATTERNS = [
    r"(?i)^(changeme|change[-_]me|example|placeholder|dummy|fake|sample|test|testing|redacted|none|null|n/?a|foo|bar|baz|todo|secret|password|token|apikey|key|value)\z",
    r"(?i)^your[-_]",
    r"(?i)[-_]here\z",
    r"(?i)^emulate[-_]",
    r"(?i)^(foo|bar|baz)([-_/].*)?\z",
    r"(?i)(^|[-_])(example|placeholder|dummy|fake|sample|redacted|changeme|your|test|todo)([-_]|\z)",
    r"(?i)[-_](api[-_]?key|api[-_]?token|api[-_]?secret|access[-_]?token)\z",
    r"(?i)^(your|my|the|a|some)[-_].*[-_](key|token|secret)\z",
    r"(?i)^x{3,}\z",
    r"(?i)^(x[-_]){2,}x\z",
    r"\*{3,}",
    r"^<.+>\z",
    r"^\$\{.+\}\z",
    r"^%.+%\z",
    r"^\{\{.+\}\}\z",
    r"(?i)^sk-(proj-)?x{2,}\z",
    r"(?i)^m0-x{2,}\z",
    r"(?i)^pk[-_]test[-_]",
]

# ---- fixed values: secret thresholds and reserved e-mail domains --------------
MIN_SECRET_LEN = 16  # UTF-16 code units
MIN_SECRET_ENTROPY = 3.5  # bits per character
RESERVED_EMAIL_DOMAINS = ["example.com", "example.net", "example.org"]
RESERVED_EMAIL_TLDS = [".example", ".test", ".invalid", ".localhost"]


def is_placeholder(value: Column, trimmed: bool = False) -> Column:
    v = value if trimmed else js_trim(value)
    test = None
    for pattern in PLACEHOLDER_PATTERNS:
        hit = v.rlike(pattern)
        test = hit if test is None else (test | hit)
    return test


def shannon_entropy(value: Column) -> Column:
    """Bits per character: counts per code point, divided by the UTF-16 length.

    The characters are sorted and counted in one fold, so the cost is
    ``n log n`` per value rather than ``n * distinct``.
    """
    n = utf16_length(value).cast("double")
    chars = F.array_sort(F.split(value, ""))

    def term(run: Column) -> Column:
        p = run.cast("double") / n
        return F.when(run > 0, -p * F.log2(p)).otherwise(F.lit(0.0))

    start = F.struct(F.lit(None).cast("string").alias("prev"), F.lit(0).alias("run"), F.lit(0.0).alias("bits"))

    def step(acc: Column, ch: Column) -> Column:
        same = acc["prev"].eqNullSafe(ch)
        return F.when(same, F.struct(acc["prev"].alias("prev"), (acc["run"] + 1).alias("run"), acc["bits"].alias("bits"))).otherwise(
            F.struct(ch.alias("prev"), F.lit(1).alias("run"), (acc["bits"] + term(acc["run"])).alias("bits"))
        )

    bits = F.aggregate(chars, start, step, lambda acc: acc["bits"] + term(acc["run"]))
    return F.when(n > 0, bits).otherwise(F.lit(0.0))


def looks_like_real_secret(value: Column) -> Column:
    """Not a placeholder, at least 16 UTF-16 units, and entropy of at least 3.5 bits.

    For a DataFrame, prefer :func:`with_secret_features`, which computes each
    part once as its own column.
    """
    v = js_trim(value)
    return ~is_placeholder(v, trimmed=True) & (utf16_length(v) >= MIN_SECRET_LEN) & (shannon_entropy(v) >= MIN_SECRET_ENTROPY)


def with_secret_features(df: DataFrame, value_col: str, prefix: str = "_s") -> DataFrame:
    """Add ``{prefix}_trim, _placeholder, _len16, _entropy, _real`` for ``value_col``.

    Each step is its own projection, so the trimmed value is computed once
    and the generated code stays small; the cheap tests come first.
    """
    t, ph, ln, en = (f"{prefix}_trim", f"{prefix}_placeholder", f"{prefix}_len16", f"{prefix}_entropy")
    out = df.withColumn(t, js_trim(F.col(value_col)))
    out = out.withColumns({ph: is_placeholder(F.col(t), trimmed=True), ln: utf16_length(F.col(t))})
    needs_entropy = ~F.col(ph) & (F.col(ln) >= MIN_SECRET_LEN)
    out = out.withColumn(en, F.when(needs_entropy, shannon_entropy(F.col(t))))
    return out.withColumn(f"{prefix}_real", F.coalesce(needs_entropy & (F.col(en) >= MIN_SECRET_ENTROPY), F.lit(False)))


def is_reserved_email_domain(domain: Column) -> Column:
    d = F.lower(domain)
    test = None
    for base in RESERVED_EMAIL_DOMAINS:
        hit = (d == base) | d.endswith("." + base)
        test = hit if test is None else (test | hit)
    for tld in RESERVED_EMAIL_TLDS:
        test = test | d.endswith(tld)
    return test
