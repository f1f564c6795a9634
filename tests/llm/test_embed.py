"""Embedding links against all pairs."""

import math

import numpy as np

from weighbridge.llm import embed_dedup


def brute(rows, cosine=0.98):
    def usable(v, label):
        return label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    links = {i: set() for i, _, _ in rows}
    good = [(i, np.array(v, float), label) for i, v, label in rows if usable(v, label)]
    for n, (i, a, la) in enumerate(good):
        for j, b, lb in good[n + 1 :]:
            if la == lb and len(a) == len(b) and a @ b / math.sqrt((a @ a) * (b @ b)) >= cosine:
                links[i].add(j)
                links[j].add(i)
    out = {}
    for i in sorted(links):
        if i not in out:
            todo = [i]
            while todo:
                x = todo.pop()
                if x not in out:
                    out[x] = i
                    todo += links[x]
    return {i: (len(links[i]), out[i], out[i] == i) for i in links}


def test_links_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "BLOCK", 7)
    rng = np.random.default_rng(2)
    vectors, base = [], rng.standard_normal((12, 16))
    for _ in range(220):
        c = base[rng.integers(12)]
        vectors.append((c * rng.uniform(0.5, 2) + rng.standard_normal(16) * rng.choice([0.0, 0.02, 0.1, 0.2])).astype(np.float32).tolist())
    vectors += [vectors[0]] * 20 + [[-x for x in vectors[0]], [2 * x for x in vectors[1]]]
    labels = [int(rng.integers(2)) for _ in vectors]
    rows = [(i, v, label) for i, (v, label) in enumerate(zip(vectors, labels, strict=True))]
    n = len(rows)
    rows += [(n, None, 1), (n + 1, [], 1), (n + 2, [0.0] * 16, 1), (n + 3, [float("nan")] * 16, 1), (n + 4, [None] * 16, 1), (n + 5, vectors[0], None)]
    rows += [(n + 6, [float("inf")] + [1.0] * 15, 0), (n + 7, [1.0, 2.0], 0), (n + 8, [1.0, 2.0], 0), (n + 9, [1e30, 2e30], 0)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, label int, size int, rep string").repartition(4)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embed_dedup.embedding_groups(df).collect()}
    assert got == brute(rows)


def test_recall_on_the_given_vectors(spark):
    from weighbridge.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = brute(rows)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in QUERIES["op6_embed_dedup"](spark, sf).collect()}
    linked = sum(v[0] for v in want.values())
    assert sum(v[0] for v in got.values()) >= 0.9 * linked and got == want


def test_empty_null_ids_and_formula(spark):
    schema = "vec_id long, embedding array<double>, label int"
    assert embed_dedup.embedding_groups(spark.createDataFrame([], schema)).collect() == []
    rows = [(None, [1.0, 0.0], 1), (5, [1.0, 0.0], 1), (5, [1.0, 0.0], 1), (None, [0.0, 1.0], 1)]
    got = sorted((r["vec_id"] or 0, r["n_links"], r["component_id"] or 0, r["kept"]) for r in embed_dedup.embedding_groups(spark.createDataFrame(rows, schema)).collect())
    assert got == [(0, 0, 0, False), (0, 2, 5, False), (5, 2, 5, True), (5, 2, 5, True)]
    for n in (10, 10_000, 10**9):
        width, k, tables = embed_dedup.tables_for(n, 0.98)
        assert (1 - embed_dedup._same_key(12) ** k) ** tables <= 1e-4
