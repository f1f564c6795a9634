"""Decontamination and licence scan: masks, planted cases, odd input."""

import itertools
import random
import re
from collections import Counter

from weighbridge.llm import decontam, licenses


def test_masks_are_lossless():
    cases = [(w, w * decontam.SUBSTITUTIONS // decontam.WINDOW) for w in range(decontam.MIN_TOKENS, decontam.WINDOW + 1)]
    for width, wrong in cases:
        for bad in itertools.combinations(range(width), wrong):
            assert any(all(s + o not in bad for o in m) for m in decontam.MASKS for s in range(width - m[-1]))


def test_planted_overlaps(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK", 40)
    rnd = random.Random(1)
    words = [f"w{i}" for i in range(3000)]
    prose = lambda n: rnd.choices(words, k=n)
    items = [prose(n) for n in (8, 12, 13, 30, 60)] + [prose(5)]
    bench = [(i, " ".join(w)) for i, w in enumerate(items)] + [(6, None), (7, ""), (None, " ".join(items[3])), (8, " ".join(items[3]))]

    def damaged(tokens, n):
        tokens = list(tokens)
        for i in rnd.sample(range(len(tokens)), n):
            tokens[i] = "zz"
        return tokens

    docs, want = [], set()
    for i, item in enumerate(items[:5]):
        for wrong in (0, 1, 2):
            lost = wrong > min(len(item), 13) * 2 // 13
            text = " ".join([*prose(rnd.randrange(40)), *damaged(item[:13], wrong), *prose(5)])
            docs.append((len(docs), text.upper().replace(" ", ", \n") if wrong else text))
            if not lost:
                want.add((len(docs) - 1, i))
    docs += [(50, " ".join(items[3])), (50, "x"), (51, " ".join(prose(20_000) + items[4] + prose(3))), (52, None), (53, ""), (None, " ".join(items[3])), (54, "w1 " * 5000), (55, " ".join(prose(300)))]
    want |= {(50, 3), (51, 4)}
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, item string, h int")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.overlaps(df, spark.createDataFrame(bench, "item_id long, text string")).collect()}
    assert got == want | {(d, 8) for d, i in want if i == 3}
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert decontam.overlaps(empty, spark.createDataFrame(bench, "item_id long, text string")).collect() == []
    assert decontam.overlaps(df, spark.createDataFrame([], "item_id long, text string")).collect() == []


def test_short_items_match_exactly(spark, monkeypatch, tmp_path):
    """Plain search for items of one to seven tokens, hits broadcast and shuffled, and the query's SQL."""
    import duckdb

    from weighbridge.llm.queries import OP2_SQL

    rnd = random.Random(7)
    words = [f"v{i}" for i in range(12)]
    bench = [(i, " ".join(rnd.choices(words, k=1 + i % 7))) for i in range(21)] + [(30, "v1 v2"), (31, "v1 v2"), (32, None), (33, " . "), (34, "zebra Quagga"), (None, "v3")]
    bench.append((40, " ".join(f"u{i}" for i in range(9))))
    docs = [(i, " ".join(rnd.choices(words, k=rnd.randrange(0, 30)))) for i in range(40)]
    docs += [(100, "a ZEBRA, quagga!"), (101, "zebra x quagga"), (102, None), (103, ""), (None, "v1 v2"), (104, "v1 " * 3000 + "v2"), (105, "u0 u1 u2 zz u4 u5 u6 u7 u8")]
    want = set()
    for d, text in docs:
        w = _split(text)
        for i, item in bench:
            v = _split(item)
            if d is not None and i is not None and v and any(w[k : k + len(v)] == v for k in range(len(w))):
                want.add((d, i, len(v)))
    want.add((105, 40, 9))
    df, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    for block in (decontam.BLOCK, 50):
        monkeypatch.setattr(decontam, "BLOCK", block)
        got = {(r["doc_id"], r["item_id"], r["item_tokens"]) for r in decontam.overlaps(df, items).collect()}
        assert got == want
    long_only = decontam.overlaps(df, items, min_tokens=decontam.MIN_TOKENS).collect()
    assert {(r["doc_id"], r["item_id"]) for r in long_only} == {(105, 40)}
    con = duckdb.connect()
    for name, table in (("documents", df), ("benchmark", items)):
        table.coalesce(1).write.parquet(str(tmp_path / name))
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}/*.parquet'")
    assert {(d, i, n) for d, i, _, _, n in con.execute(OP2_SQL).fetchall()} == want


def _split(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def brute_licences(rows, known, dice=0.8):
    """Every span of every text against every template, by counters."""
    found = set()
    templates = {(name, tuple(_split(body))) for name, body in known if len(_split(body)) > 1}
    for doc, text in rows:
        w = _split(text)
        grams, spans = list(zip(w, w[1:], strict=False)), []
        for name, t in templates:
            bag, n = Counter(zip(t, t[1:], strict=False)), len(t) - 1
            scored = []
            for s in range(len(grams)):
                if grams[s] not in bag:
                    continue
                span = grams[s : s + n]
                shared = sum((Counter(span) & bag).values())
                if 2 * shared >= dice * (len(span) + n) - 1e-9:
                    scored.append((2 * shared / (len(span) + n), s, len(span), shared))
            for d, s, size, shared in scored:
                if not any((d2, -s2) > (d, -s) for d2, s2, *_ in scored if abs(s2 - s) < n):
                    spans.append((shared, d, name, s, size, t))
        for a in spans:
            over = [b for b in spans if b[2:] != a[2:] and b[5] != a[5] and b[3] <= a[3] + a[4] and a[3] <= b[3] + b[4]]
            if not any((-b[0], -b[1], b[2], b[3]) < (-a[0], -a[1], a[2], a[3]) for b in over):
                found.add((doc, a[3], a[4] + 1, a[2], a[0], round(a[1], 6)))
    return found


def test_licences(spark, monkeypatch):
    mit = dict(licenses.TEMPLATES[:12])["MIT"]
    paragraphs = mit.replace("conditions: The", "conditions:\n\nThe").replace("Software. THE", "Software.\n\nTHE")
    code = "\n".join(f"int f{i}(void) {{ return {i}; }}" for i in range(60))
    line = "Released under the MIT License."
    rnd = random.Random(6)
    filler = lambda n: " ".join(rnd.choices(["the", "software", "of", "is", "in", "this", "license", "under", "a", "zz"], k=n))
    rows = [
        (1, f"prose here\n{line}\nmore prose"), (2, "LICENSED under the apache licence, version 2.0"), (3, f"Copyright (c) 2020 Foo\n\n{paragraphs}\n{code}"),
        (4, f"Copyright 2020 Foo. {line} All other text here."), (5, None), (6, ""), (7, "Licensed under CC BY-NC 4.0.\r\nLicensed under CC BY 4.0."), (8, "license"),
        (9, "word " * 100_000), (None, line), (1, line), (10, f"// SPDX-License-Identifier: MIT\n{code}"), (11, " ".join([line] * 40)), (12, f"{filler(300)} {mit.replace('sublicense, ', '')} {filler(300)}"),
        (13, mit.rsplit(" ", 20)[0]), (14, "This work is licensed under the GNU General Public License, version 3."), (15, next(t for n, t in licenses.TEMPLATES[12:] if n == "Apache-2.0").replace(". ", ".\n * ")),
        *[(20 + i, filler(rnd.randrange(400))) for i in range(30)],
    ]
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id long, text string, license string, row int, s int").repartition(3)
    want = brute_licences(rows, licenses.TEMPLATES)
    for block in (500_000, 600):
        monkeypatch.setattr(licenses, "BLOCK", block)
        got = licenses.scan_licenses(df, licenses.templates(spark)).collect()
        assert {(r["doc_id"], r["start"], r["n_words"], r["license"], r["shared"], round(r["dice"], 6)) for r in got} == want and len(got) == len(want)
    of = lambda i: sorted((r["license"], r["start"]) for r in got if r["doc_id"] == i)
    assert of(1) == [("MIT", 0), ("MIT", 2)] and of(3) == [("MIT", 4)] and of(4) == [("MIT", 3)] and of(None) == [("MIT", 0)] and of(10) == [("MIT", 0)]
    assert [x for x, _ in of(7)] == ["CC-BY-4.0", "CC-BY-NC-4.0"] and len(of(11)) == 40 and of(12) == [("MIT", 300)] and of(14) == [("GPL-3.0", 0)]
    assert [x for x, _ in of(15)] == ["Apache-2.0"] and [x for x, _ in of(13)] == ["MIT"] and not [of(i) for i in (2, 5, 6, 8, 9) if of(i)]
    assert licenses.scan_licenses(df.limit(0), licenses.templates(spark)).collect() == []
    assert licenses.scan_licenses(df, licenses.templates(spark).limit(0)).collect() == []
