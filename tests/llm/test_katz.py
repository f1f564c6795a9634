"""Katz scores against a plain recursive model over dictionaries."""

import math
import random
import zlib
from collections import Counter, defaultdict

import pytest

from weighbridge.llm import katz

LOW = katz.LOW


def tokens(text):
    return (text or "").encode().lower().split() + ["END"]


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


class Model:
    def __init__(self, texts):
        self.uni, self.bi = Counter(), defaultdict(Counter)
        for t in texts:
            ts = tokens(t)
            self.uni.update(ts)
            for h, w in zip(["START", *ts], ts, strict=False):
                self.bi[h][w] += 1
        self.n = sum(self.uni.values())
        self.d1 = self.discount(Counter(self.uni.values()))
        self.d2 = self.discount(Counter(c for ws in self.bi.values() for c in ws.values()))

    @staticmethod
    def discount(of):
        n = [of[r] for r in range(1, LOW + 2)]
        d = katz.discounts(n)
        return lambda c: c if c > LOW else d[c] * c

    def p1(self, w):
        low = any(c <= LOW for c in self.uni.values())
        over = self.n if low and sum(map(self.d1, self.uni.values())) < self.n else self.n + 1
        if w in self.uni:
            return self.d1(self.uni[w]) / over
        return 1 - sum(self.d1(c) for c in self.uni.values()) / over

    def p(self, h, w):
        after = self.bi.get(h)
        if not after:
            return self.p1(w)
        total = sum(after.values())
        over = total if any(c <= LOW for c in after.values()) else total + 1
        if w in after:
            return self.d2(after[w]) / over
        left = 1 - sum(self.d2(c) for c in after.values()) / over
        return left / (1 - sum(self.p1(x) for x in after)) * self.p1(w)

    def score(self, text):
        ts = tokens(text)
        return sum(math.log10(self.p(h, w)) for h, w in zip(["START", *ts], ts, strict=False))


def corpus(seed, n):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    out = []
    for i in range(n):
        text = " ".join(rnd.choices(words, weights, k=rnd.randrange(0, 40)))
        if i % 5 == 0:
            text += f" only{i}\tHOT pair hot pair HOT pair"
        out.append((i, text))
    return [*out, (n, None), (n + 1, ""), (n + 2, "  \n "), (n + 3, "ü Ü É é"), (None, "w1 w2 w3"), (0, out[0][1])]


@pytest.mark.parametrize("seed,n,chunk,parts,hot", [(1, 120, 300, 3, 10_000), (2, 60, 10_000, 4, 10), (3, 1, 5, 2, 10_000)])
def test_scores_equal_the_plain_model(spark, monkeypatch, seed, n, chunk, parts, hot):
    monkeypatch.setattr(katz, "HOT", hot)
    rows = corpus(seed, n)
    model = Model([t for i, t in rows if not held(i)])
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as score", "'x' as chunk").repartition(3)
    got = katz.katz_scores(df, chunk_tokens=chunk, parts=parts).collect()
    assert len(got) == len(rows)
    want = defaultdict(list)
    for i, t in rows:
        want[i].append(t)
    for r in got:
        t = want[r["doc_id"]][0]
        ts = tokens(t)
        assert r["held_out"] == held(r["doc_id"]) and r["n_tokens"] == len(ts)
        assert r["n_known"] == sum(w in model.uni for w in ts) and r["train_tokens"] == model.n
        base = sum(math.log10((model.uni[w] + 1) / (model.n + len(model.uni) + 1)) for w in ts)
        assert r["base_score"] == pytest.approx(base, abs=1e-8)
        assert r["score"] == pytest.approx(model.score(t), abs=1e-8)
    for h in ["START", b"w0", b"hot", b"unknown"]:
        assert sum(model.p(h, w) for w in [*model.uni, "UNSEEN"]) == pytest.approx(1)


def test_empty_and_untrained(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert katz.katz_scores(empty, parts=2).collect() == []
    out_id = next(i for i in range(100) if held(i))
    got = katz.katz_scores(spark.createDataFrame([(out_id, "a b")], "doc_id long, text string"), parts=2).collect()
    assert [(r["score"], r["base_score"], r["n_known"]) for r in got] == [(0.0, 0.0, 0)]


def good_turing(of):
    """Katz's discounts for counts 1 .. 5, in plain arithmetic."""
    seen = [r for r in range(1, 7) if of[r]]
    gap = [(nxt - prev) / 2 for prev, nxt in zip([0, *seen], [*seen[1:], 2 * seen[-1] - seen[-2]], strict=False)]
    x, y = [math.log(r) for r in seen], [math.log(of[r] / g) for r, g in zip(seen, gap, strict=True)]
    mx, my = sum(x) / len(x), sum(y) / len(y)
    slope = sum((a - mx) * (b - my) for a, b in zip(x, y, strict=True)) / sum((a - mx) ** 2 for a in x)
    assert slope < -1
    fitted = {r: r**slope for r in range(1, 7)}
    out, raw = [], True
    for r in range(1, 6):
        for n in (of, fitted):
            if n is of and not (raw and of[r]):
                continue
            cut = 6 * n[6] / n[1]
            d = ((r + 1) * n[r + 1] / (r * n[r]) - cut) / (1 - cut)
            if 0 < d < 1:
                break
            raw = False
        out.append(d)
    return out


def test_discounts_are_good_turing_on_documents(spark):
    uni, pairs = Counter(), Counter()
    for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text").toLocalIterator():
        if not held(r["doc_id"]):
            ts = tokens(r["text"])
            uni.update(ts)
            pairs.update(zip(["START", *ts], ts, strict=False))
    for counts, as_is in ((uni, 3), (pairs, 3)):
        of = Counter(counts.values())
        n = [of[r] for r in range(1, LOW + 2)]
        d = katz.discounts(n)[1:]
        assert d == pytest.approx(good_turing(of)) and ((d > 0) & (d < 1)).all()
        half = [(r - 0.5) / r for r in range(1, LOW + 1)]
        assert all(abs(a - b) > 1e-3 for a, b in zip(d, half, strict=True))
        cut = 6 * n[5] / n[0]
        turing = [((r + 1) * n[r] / (r * n[r - 1]) - cut) / (1 - cut) for r in range(1, LOW + 1)]
        assert d[:as_is] == pytest.approx(turing[:as_is]) and not 0 < turing[as_is] < 1


def test_discounts_of_small_data():
    half = [(r - 0.5) / r for r in range(1, LOW + 1)]
    for n in ([0, 4, 2, 1, 1, 1], [4, 0, 2, 1, 1, 1], [0] * 6, [10, 8, 0, 0, 0, 0]):  # the last: no fall as fast as 1 / r
        assert katz.discounts(n)[1:] == pytest.approx(half)
    for n in ([10, 2, 0, 0, 0, 0], [100, 30, 0, 8, 9, 1], [9, 1, 5, 1, 1, 0]):
        d = katz.discounts(n)[1:]
        assert ((d > 0) & (d < 1)).all() and d != pytest.approx(half)
