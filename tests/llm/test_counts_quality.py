"""Rollups and the quality classifier."""

import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from weighbridge.llm import quality
from weighbridge.llm.rollups import RollupStore, diff_changes

CHANGE = "source string, lang string, tokenizer string, op string, old_tokens long, new_tokens long"


def totals(store):
    return {(r["source"], r["lang"], r["tokenizer"]): (r["n_docs"], r["n_tokens"]) for r in store.totals().collect()}


def test_batches_commit_once(spark, tmp_path):
    store = RollupStore(spark, str(tmp_path))
    assert totals(store) == {}
    load = spark.createDataFrame([("a", "en", "t1", "insert", None, 5), ("a", "en", "t1", "insert", 9, 7), (None, "en", "t1", "insert", None, 1), ("b", None, "t1", "insert", None, None)], CHANGE)
    assert store.apply("1", load) and not store.apply("1", load)
    fix = spark.createDataFrame([("a", "en", "t1", "revise", 5, 2), ("b", None, "t1", "delete", 0, None)], CHANGE)
    assert store.apply("2", fix)
    want = {("a", "en", "t1"): (2, 9), (None, "en", "t1"): (1, 1)}
    assert totals(store) == want
    store._write(load.groupBy("source", "lang", "tokenizer").agg({"new_tokens": "sum"}).selectExpr("source", "lang", "tokenizer", "1L as n_docs", "`sum(new_tokens)` as n_tokens"), "batch", ["1"])
    # a second writer's attempt of batch 1 (one document a group): one of the two counts, whole
    assert totals(store) in (want, {("a", "en", "t1"): (1, 9), (None, "en", "t1"): (1, 1)})
    other = RollupStore(spark, str(tmp_path / "other"))
    for name, changes in (("1", load), ("2", fix)):
        other.apply(name, changes)
    other.compact()
    assert totals(other) == want and not other.apply("2", fix) and other.apply("3", load.limit(0)) and totals(other) == want
    with pytest.raises(Exception, match="unknown change"):
        other.apply("4", spark.createDataFrame([("a", "en", "t1", None, 1, 1)], CHANGE))
    assert totals(other) == want


def test_a_batch_committed_while_compacting_is_kept(spark, tmp_path):
    row = lambda n: spark.createDataFrame([("a", "en", "t", "insert", None, n, "x", 1)], CHANGE + ", n_docs string, batches int")
    store, other = RollupStore(spark, str(tmp_path)), RollupStore(spark, str(tmp_path))
    store.apply("1", row(5))
    write = store._write

    def meanwhile(sums, name, batches):
        other.apply("2", row(7))
        write(sums, name, batches)

    store._write = meanwhile
    store.compact()
    assert totals(store) == {("a", "en", "t"): (2, 12)} and not other.apply("2", row(7))
    store._write = write
    store.compact()
    store.compact()
    assert totals(other) == {("a", "en", "t"): (2, 12)}


def test_vacuum_removes_what_no_longer_counts(spark, tmp_path):
    row = lambda n: spark.createDataFrame([("a", "en", "t", "insert", None, n)], CHANGE)
    store, path = RollupStore(spark, str(tmp_path)), tmp_path / "deltas"
    assert store.vacuum() == 0
    for i, n in enumerate([5, 7, 11]):
        store.apply(str(i), row(n))
    store._write(store.totals().limit(0), "batch", ["1"])  # a second attempt, of which one counts
    kept = totals(store)
    assert store.vacuum() == 1 and totals(store) == kept and len(list(path.iterdir())) == 3
    store.compact()
    (path / "batch-unfinished").mkdir()  # no commit row yet
    assert store.vacuum() == 3 and totals(store) == kept
    names = {p.name.split("-")[0] for p in path.iterdir()}
    assert names == {"base", "batch"} and len(list(path.iterdir())) == 2 and store._commits().count() == 1
    assert not store.apply("2", row(1)) and store.apply("3", row(1)) and store.vacuum() == 0
    assert totals(store)[("a", "en", "t")] == (kept[("a", "en", "t")][0] + 1, kept[("a", "en", "t")][1] + 1)


def test_snapshot_differences(spark):
    schema = "doc_id long, source string, lang string, tokenizer string, n_tokens long"
    old = spark.createDataFrame([(1, "a", "en", "t", 3), (2, "a", None, "t", 4), (3, "a", "en", "t", 5)], schema)
    new = spark.createDataFrame([(1, "a", "en", "t", 3), (2, "a", None, "t", 6), (4, "b", "en", "t", 7)], schema)
    got = {(r["source"], r["lang"], r["op"], r["old_tokens"], r["new_tokens"]) for r in diff_changes(old, new).collect()}
    assert got == {("a", None, "revise", 4, 6), ("a", "en", "delete", 5, None), ("b", "en", "insert", None, 7)}


def test_held_out_accuracy(spark):
    from weighbridge.llm.queries import QUERIES

    sf = "/root/testdata/sf0.1"
    rows = QUERIES["op9_quality"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert len(rows) > 100 and all(zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in rows)
    assert sum(r["predicted"] == r["quality"] for r in rows) / len(rows) > 0.97
    low, high = ([r["score"] for r in rows if r["quality"] == q] for q in (0, 1))
    assert sum(a < b for a in low for b in high) / (len(low) * len(high)) > 0.98


def plain_ftrl(rows, epochs=3):
    """FTRL-proximal over dictionaries, one feature at a time."""
    z, n = {}, {}

    def weight(f):
        if abs(z.get(f, 0.0)) <= quality.L1:
            return 0.0
        return -(z[f] - math.copysign(quality.L1, z[f])) / ((quality.BETA + math.sqrt(n[f])) / quality.ALPHA + quality.L2)

    def vector(text):
        words = re.findall(rb"[A-Za-z0-9_\x80-\xff]+|[^\sA-Za-z0-9_\x80-\xff]+", text.encode())
        found = Counter()
        for i, word in enumerate(words):
            one = zlib.crc32(word)
            found[one % (quality.DIM - 2) + 2] += 1
            if i:
                before = zlib.crc32(words[i - 1])
                two = (before * 0x9E3779B1 + one * 0x85EBCA77) % (1 << 64)
                found[1 if before == one else (two ^ (two >> 29)) % (quality.DIM - 2) + 2] += 1
        size = max(2 * len(words) - 1, 1) if words else 1
        return {0: 1.0} | {f: c / math.sqrt(size) for f, c in found.items()}

    for _ in range(epochs):
        for text, label in rows:
            x = vector(text)
            w = {f: weight(f) for f in x}
            error = 1 / (1 + math.exp(-sum(w[f] * v for f, v in x.items()))) - label
            for f, v in x.items():
                g, before = error * v, n.get(f, 0.0)
                z[f] = z.get(f, 0.0) + g - (math.sqrt(before + g * g) - math.sqrt(before)) / quality.ALPHA * w[f]
                n[f] = before + g * g
    return lambda text: 1 / (1 + math.exp(-sum(weight(f) * v for f, v in vector(text).items())))


def test_scores_equal_plain_ftrl(spark):
    rnd = random.Random(7)
    good, bad = [f"g{i}" for i in range(30)], [f"b{i}" for i in range(30)]
    texts = [" ".join(rnd.choices(good if i % 2 else bad, k=rnd.randrange(1, 40)) + rnd.choices(["the", "the", ",", "é", "..."], k=5)) for i in range(120)]
    docs = spark.createDataFrame([*enumerate(texts), (3, texts[3])], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 110)], "doc_id long, quality int")
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    places = spark.range(110).selectExpr("id", "pmod(xxhash64(id, 3), 1099511627776) AS place").orderBy("place").collect()
    order = [r["id"] for r in places if not held(r["id"])]
    for bound in (quality.MAX_FEATURES, 1500):
        taken, total = [], 0
        for i in order:
            total += len(quality.features(texts[i].encode()))
            if total > bound:
                break
            taken.append(i)
        score = plain_ftrl([(texts[i], i % 2) for i in taken])
        w = quality.fit(docs, labels, quality.fold(F.col("doc_id"), 3) == 1, max_features=bound)
        got = {r["doc_id"]: r["s"] for r in docs.select("doc_id", quality.scorer(spark, w)(F.col("text")).alias("s")).collect()}
        assert len(taken) == len(order) or bound == 1500
        assert all(abs(got[i] - score(t)) < 1e-4 for i, t in enumerate(texts))


def test_odd_rows_and_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, None, 9.0), (None, "", 9.0), (2, "a " * 200_000, 9.0), (2, "x", 9.0)], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = quality.classify(docs, none).collect()
    assert len(got) == 4 and {(r["score"], r["predicted"]) for r in got} == {(0.5, 1)}
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (2, 0), (None, 0), (3, None), (4, 0)], "doc_id long, quality int")
    assert all(0 <= r["score"] <= 1 for r in quality.classify(docs, labels).collect())
    assert quality.classify(docs.limit(0), labels).collect() == []
    assert quality.accepted(docs, none).columns == docs.columns
