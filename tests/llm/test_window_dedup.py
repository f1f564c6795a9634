"""Removal of repeated windows against a plain version that compares word sequences."""

import hashlib
import random

import numpy as np
import pytest

from weighbridge.llm import tally, window_dedup
from weighbridge.llm.window_dedup import remove_repeats


def brute(docs, window):
    split = [(i, (t or "").encode().split()) for i, t in docs]
    first = {}
    for i, words in split:
        for a in range(len(words) - window + 1):
            key = tuple(words[a : a + window])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    out = []
    for i, words in split:
        gone = set()
        for a in range(len(words) - window + 1):
            if i is not None and first[tuple(words[a : a + window])] < i:
                gone.update(range(a, a + window))
        kept = [w for j, w in enumerate(words) if j not in gone]
        out.append((i, len(words), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out


def same(got, docs, window):
    got, want = sorted(map(tuple, got), key=str), sorted(brute(docs, window), key=str)
    assert got == want
    return sum(r[2] for r in want)


def corpus(n=150, letters="abc", long=30):
    rnd = random.Random(11)
    passages = [[rnd.choice(letters) + rnd.choice("xyz") for _ in range(rnd.choice([5, 9, 40]))] for _ in range(6)]
    docs = []
    for i in rnd.sample(range(1000), n):
        words = [rnd.choice(letters) * rnd.choice([1, 2]) for _ in range(rnd.randrange(long))]
        for p in rnd.sample(passages, rnd.choice([0, 1, 2])):
            at = rnd.randrange(len(words) + 1)
            words[at:at] = p if rnd.random() < 0.7 else p[: len(p) // 2]
        docs.append((i, rnd.choice([" ", "\x0b", "\n  "]).join(words)))
    copies = [(2000 + i, docs[0][1]) for i in range(30)] + [(i, docs[1][1]) for i in (-5, 3000, 3000, None, None)]
    odd = [(4001, None), (4002, ""), (4003, " \t"), (4004, "a " * 300), (4005, "a " * 500), (4006, "a b " * 200), (4007, "é b c\x1cd é"), (None, "a " * 300)]
    return [*docs, *copies, *odd]


def frame(spark, docs, parts=3):
    return spark.createDataFrame([(i, t, 1, "m") for i, t in docs], "doc_id long, text string, n_words int, chunk string").repartition(parts)


@pytest.mark.parametrize("window,gram,letters", [(5, 2, "abc"), (8, 8, "abc"), (8, 1, "ab"), (3, 2, "abcdefghijklmnopqrstuvwxyz")])
def test_same_as_plain_version(spark, monkeypatch, window, gram, letters):
    docs = corpus(letters=letters)
    assert same(remove_repeats(frame(spark, docs), window, gram).collect(), docs, window)
    monkeypatch.setattr(tally, "OWNER_KEYS", 700)  # many owners, many chunks, a sketch full of collisions
    monkeypatch.setattr(window_dedup, "ROOM", 0.1)
    same(remove_repeats(frame(spark, docs, 5), window, gram, chunk_bytes=400).collect(), docs, window)


def test_production_parameters(spark):
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choices("abcdefgh", k=3))
    base = [word() for _ in range(400)]
    edits = []
    for i in range(40):
        w = list(base)
        for _ in range(i % 7):
            w[rnd.randrange(400)] = word()
        edits.append((100 + i, " ".join(w)))
    exact = [(1, " ".join(word() for _ in range(30)) + " " + " ".join(base[:n]) + " " + word()) for n in (49, 50)]
    docs = [*edits, *exact, (50, " ".join(base[10:60])), (51, "z " * 4000 + " ".join(base)), (52, "z " * 4001)]
    same(remove_repeats(frame(spark, docs)).collect(), docs, 50)


def test_given_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    same(remove_repeats(df, 20, 8).collect(), [(r["doc_id"], r["text"]) for r in df.collect()], 20)


def test_empty_table_and_short_texts(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert remove_repeats(none).collect() == []
    docs = [(1, "a b"), (2, "a b"), (None, None)]
    same(remove_repeats(spark.createDataFrame(docs, none.schema)).collect(), docs, 50)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("windows")]


def test_sketch_never_counts_too_low():
    rnd = np.random.default_rng(3)
    m = rnd.integers(0, 1 << 63, 5000, dtype=np.uint64)
    m = np.concatenate([m, m[:700], m[:50]])
    for bits in (5, 12, 20):
        keys, at, counts = np.unique(window_dedup.cells(m, bits), return_inverse=True, return_counts=True)
        _, inverse, true = np.unique(m, return_inverse=True, return_counts=True)
        assert (counts[at.reshape(2, -1)].min(axis=0) >= true[inverse]).all() and len(keys) <= 2 << bits
