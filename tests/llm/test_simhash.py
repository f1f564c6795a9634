"""SimHash fingerprints and groups against plain Python."""

import random

import numpy as np
import pytest
import xxhash

from weighbridge.llm import common, simhash


def fingerprint(text, shingle=4):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in "\x20\t\n\x0b\x0c\r" else c for c in lowered).split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def grouped(fps, max_bits=4):
    """Smallest id reachable, for ``{id: fingerprint}``."""
    ids = sorted(fps)
    group = {i: i for i in ids}

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if (fps[i] ^ fps[j]).bit_count() <= max_bits:
                a, b = sorted((find(i), find(j)))
                group[b] = a
    return {i: find(i) for i in ids}


def corpus(n=150):
    rnd = random.Random(4)
    vocab = [f"w{i}" for i in range(400)] + ["Ünï", "É", "É", "a b"]
    texts = [" ".join(rnd.choices(vocab, k=rnd.choice([1, 2, 3, 4, 30, 120]))) for _ in range(n)]
    for i in range(0, n, 3):  # near copies, chains of them, exact copies
        words = texts[i].split()
        if words:
            words[rnd.randrange(len(words))] = "changed"
        texts.append("  " + "\t".join(words).upper() + "\n")
        texts.append(texts[i])
    return [*enumerate([*texts, None, "", " \n ", "x" * 200_000, "long " * 50_000, "a b"])]


def test_groups_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 8)
    rows = corpus()
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, fp int, component_id string").repartition(5)
    got = {r["doc_id"]: r for r in simhash.simhash_groups(df).collect()}
    fps = {i: fingerprint(t) for i, t in rows}
    want = grouped(fps)
    assert len(got) == len(rows)
    for i in fps:
        assert got[i]["fingerprint"] == f"{fps[i]:016x}" and got[i]["component_id"] == want[i]


@pytest.mark.parametrize("max_bits", [1, 4, 7])
def test_pairs_of_dense_fingerprints(spark, monkeypatch, max_bits):
    """Many fingerprints near each other, in several blocks, link as all pairs do."""
    monkeypatch.setattr(simhash, "BLOCK", 50)
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 2**63, 6, dtype=np.uint64)
    fps = set()
    for _ in range(700):
        x = int(rng.choice(centres))
        for b in rng.choice(64, rng.integers(0, 9), replace=False).tolist():
            x ^= 1 << b
        fps.add(x)
    fps = {i: f for i, f in enumerate(sorted(fps | {int(f) for f in rng.integers(0, 2**63, 300, dtype=np.uint64)}))}
    df = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)), i) for i, f in fps.items()], "fp long, rep long")
    pairs = simhash.near_pairs(df, max_bits).collect()
    for p in pairs:  # links join rows of one component only
        assert p["a"] != p["b"]
    stars = {r["hi"]: r["lo"] for r in common.components(simhash.near_pairs(df, max_bits), "t").collect()}
    assert {i: stars.get(i, i) for i in fps} == grouped(fps, max_bits)


def test_descent_equals_comparing_with_every_vantage_point():
    rng = np.random.default_rng(9)
    fps = rng.integers(0, 2**64, 3000, dtype=np.uint64)
    points, radii = simhash.build_tree(fps[:900])
    over = np.bitwise_count(fps[:, None] ^ points[None, :]).astype(np.int16) - radii
    inside = over <= 0
    want = np.where(inside.any(axis=1), inside.argmax(axis=1), len(points))
    home, row, shard = simhash.descend(fps, points, radii, 4)
    near = np.argwhere((over <= 4) & (np.arange(len(points)) < want[:, None]))
    assert np.array_equal(home, want) and sorted(zip(row.tolist(), shard.tolist(), strict=True)) == [tuple(x) for x in near.tolist()]


def test_null_ids_repeated_rows_and_empty(spark):
    rows = [(None, "a b c d e"), (2, "a b c d e"), (2, "a b c d e"), (1, "A B C D E"), (None, None)]
    got = simhash.simhash_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in got) == [(0, 0), (0, 0), (1, 1), (2, 1), (2, 1)]
    assert simhash.simhash_groups(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert simhash.simhash_groups(spark.createDataFrame([(None, "x")], "doc_id long, text string")).count() == 1


def test_components_of_chains_and_hubs(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 400)] + [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(60)]
    group = {n: n for e in edges for n in e}
    for _ in group:
        for a, b in edges:
            group[a] = group[b] = min(group[a], group[b])
    got = {r["hi"]: r["lo"] for r in common.components(spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    assert got == {n: r for n, r in group.items() if n != r}
