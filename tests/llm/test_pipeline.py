"""The pipeline's stages on one table, each against the operator's own result; and a run against plain models."""

import re
import zlib

import numpy as np

import corpus_pipeline
from test_counts_quality import plain_ftrl
from test_simhash import fingerprint, grouped
from weighbridge.llm import decontam, quality, simhash

SF = "/root/testdata/sf0.01"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("labels", "benchmark"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontaminate", "pack"]
    odd = spark.createDataFrame([(None, None, None, None, None), (10**9, "", "en", "s", 0)], docs.schema)
    docs = docs.unionByName(odd)
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"] for r in docs.select("doc_id").collect()}
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        kept = {r["doc_id"] for r in spark.read.parquet(str(tmp_path / name)).select("doc_id").collect()}
        if name == "quality":
            gone = {r["doc_id"] for r in quality.classify(docs, labels).where("predicted = 0").collect()}
        elif name == "near_duplicates":
            gone = {r["doc_id"] for r in simhash.simhash_groups(docs).collect() if r["doc_id"] != r["component_id"]} - {None}
        elif name == "decontaminate":
            gone = {r["doc_id"] for r in decontam.overlaps(docs, bench).collect()}
        else:
            gone = set()
        assert kept == before - gone and (name == "pack" or (gone and out.columns == docs.columns))
        docs = spark.read.parquet(str(tmp_path / name))


def test_stages_take_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_run_and_registration(spark):
    import __spark_entry__ as entry

    assert entry.queries()["pipeline"] is corpus_pipeline.run
    names = set(entry.queries())
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert rows.count() > 0 and "sequence_id" in rows.columns


def plain_overlap(text, items):
    """Whether some window of an item has few enough substitutions, in any alignment with the text."""
    split = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    words = split(text)
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    row = np.array([number[w] for w in words], np.int64)
    for item in map(split, items):
        n, w = len(item), min(len(item), 13)
        if n < 8:
            continue
        want = np.array([number.get(t, -1) for t in item], np.int64)
        if (want < 0).sum() == n:
            continue
        edge = np.full(n, -2, np.int64)
        same = np.lib.stride_tricks.sliding_window_view(np.concatenate([edge, row, edge]), n) == want
        run = np.cumsum(np.pad(same, ((0, 0), (1, 0))), axis=1)
        if (run[:, w:] - run[:, :-w]).max() >= w - w * 2 // 13:
            return True
    return False


def test_run_equals_plain_models(spark):
    """The documents that ``run`` packs are those that plain FTRL, all pairs of fingerprints and all alignments leave,
    and the pieces are the tokens of those documents, each once."""
    import public_tokenizers
    from tokenizers import Tokenizer

    sf = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").where("doc_id IS NOT NULL AND quality IS NOT NULL")
    places = labels.selectExpr("doc_id", "quality", "pmod(xxhash64(doc_id, 3), 1099511627776) AS place").orderBy("place").collect()
    known = [(docs[r["doc_id"]], r["quality"]) for r in places if r["doc_id"] in docs and zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1]
    score = plain_ftrl([(t or "", y) for t, y in known])
    scores = {i: score(t or "") for i, t in docs.items()}
    assert all(abs(v - 0.5) > 1e-4 for v in scores.values())  # none near enough to the border for rounding to matter
    left = {i: t for i, t in docs.items() if scores[i] >= 0.5}
    groups = grouped({i: fingerprint(t) for i, t in left.items()})
    left = {i: t for i, t in left.items() if groups[i] == i}
    items = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    left = {i: t for i, t in left.items() if not plain_overlap(t, items)}

    pieces = corpus_pipeline.run(spark, sf).collect()
    assert {r["doc_id"] for r in pieces} == set(left) and 0 < len(left) < len(docs)
    encoder = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    taken, used = {i: [] for i in left}, {}
    for r in pieces:
        taken[r["doc_id"]].append(r)
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, text in left.items():
        ids, at = [*encoder.encode(text or "", add_special_tokens=False).ids, 1], 0
        for r in sorted(taken[i], key=lambda r: r["start"]):
            part = np.array(ids[r["start"] : r["start"] + r["length"]], "<u4")
            assert r["start"] == at and len(part) == r["length"] and zlib.crc32(part.tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids)
            at += r["length"]
        assert at == len(ids)
    for rows in used.values():
        at = 0
        for offset, length in sorted(rows):
            assert offset == at
            at += length
        assert at <= 2048
