import math
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weighbridge.functions.placeholders import (
    PLACEHOLDER_PATTERNS,
    is_placeholder,
    is_reserved_email_domain,
    looks_like_real_secret,
    shannon_entropy,
)

# one positive and one near miss per pattern, in pattern order
PAIRS = [
    ("changeme", "changemeplease"),
    ("your_api_key", "myyour_key1234567"),
    ("api_key_here", "api_key_there"),
    ("emulate-google-secret", "simulate-google"),
    ("foo/bar", "food"),
    ("my-example-value", "counterexample9Q"),
    ("stripe-api-key", "stripeapikeyz"),
    ("my-x-secret", "my-x-secrets9"),
    ("xxxxx", "xxyx"),
    ("x-x-x", "x-x"),
    ("abc***def", "ab**cd"),
    ("<token>", "<>"),
    ("${API_KEY}", "${}"),
    ("%API_KEY%", "%%"),
    ("{{API_KEY}}", "{{}}"),
    ("sk-xxxx", "sk-xxxy"),
    ("m0-xxx", "m0-x"),
    ("pk_test_abc", "pktest_abc"),
]


def _eval(spark, values, expr):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    return [r[0] for r in df.select(expr(F.col("v"))).collect()]


def test_placeholder_patterns(spark):
    pos = _eval(spark, [p for p, _ in PAIRS], is_placeholder)
    neg = _eval(spark, [n for _, n in PAIRS], is_placeholder)
    assert all(pos), [p for (p, _), ok in zip(PAIRS, pos) if not ok]
    assert not any(neg), [n for (_, n), bad in zip(PAIRS, neg) if bad]


def test_placeholder_trims_and_ignores_case(spark):
    assert _eval(spark, ["  ChangeMe ", "\tYOUR-token", "TODO"], is_placeholder) == [True, True, True]


def test_looks_like_real_secret(spark):
    cases = {
        "abcdefghijklmno": False,  # 15 units
        "a1b2c3d4e5f6g7h8": True,  # 16 distinct chars: 4 bits
        "aaaaaaaabbbbbbbb": False,  # entropy 1
        "f33e61083db5dbdf4bd2369d2f80176e57f7fda2": True,  # hex
        "  f33e61083db5dbdf4bd2369d2f80176e  ": True,  # trimmed first
        "your-api-key": False,
        "m0-your-api-key": False,
        "hunter2": False,
        "abcd1234abcdxyz9": True,  # exactly 3.5 bits
    }
    got = _eval(spark, list(cases), looks_like_real_secret)
    assert dict(zip(cases, got)) == cases


def test_reserved_domains(spark):
    cases = {"example.com": True, "a.example.org": True, "notexample.com": False, "x.test": True, "EXAMPLE.NET": True,
             "mail.example": True, "corp.io": False, "x.localhost": True, "y.invalid": True}
    assert dict(zip(cases, _eval(spark, list(cases), is_reserved_email_domain))) == cases


def _entropy_model(s: str) -> float:
    if not s:
        return 0.0
    n = len(s.encode("utf-16-le")) // 2
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values())


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(min_size=0, max_size=30), min_size=1, max_size=20))
def test_entropy_matches_model(spark, values):
    got = _eval(spark, values, shannon_entropy)
    for v, g in zip(values, got):
        assert abs(g - _entropy_model(v)) < 1e-9, (v, g)


def _py_placeholder(v: str) -> bool:
    import re

    t = v.strip()
    return any(re.search(p.replace(r"\z", r"\Z"), t, re.ASCII) for p in PLACEHOLDER_PATTERNS)


ALPHABET = st.sampled_from(list("xX-_*<>{}$%/aeiourstkyn0m1p ") + ["your", "key", "test", "sk-", "token", "here", "foo"])


@settings(max_examples=25, deadline=None)
@given(st.lists(st.lists(ALPHABET, min_size=1, max_size=8).map("".join), min_size=1, max_size=30))
def test_placeholder_dialect_matches_python_model(spark, values):
    got = _eval(spark, values, is_placeholder)
    assert got == [_py_placeholder(v) for v in values]
