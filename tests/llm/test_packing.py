"""Packing: exact round trip, limits, padding, equal ids of both tokenizer libraries."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from weighbridge.llm import packing

SIGNS = "abcABC'stredmvl  \n\n09.,!?-éüßñçŒłŽабвЖ你好日本ひらカタ—…’“”¡¿«»ªº²½µ\t\u00a0\x1c"


def texts(n=150):
    rnd = random.Random(3)
    out = ["".join(rnd.choices(SIGNS, k=rnd.choice([1, 5, 80, 900]))) for _ in range(n)]
    return [*out, None, "", "<|endoftext|>", "y" * 6000, "word " * 9000, out[0], out[0]]


def check(rows, docs, limits=(2048, 512, 2048)):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    of, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        of[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    assert set(of) == {i for i, _ in docs}
    for i, text in docs:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        at = 0
        for r in sorted(of[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["length"] > 0
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= limits[0] and len(pieces) <= limits[1] and sum(r["loss_tokens"] for r in pieces) <= limits[2]
        assert at == limits[0] or at & (at - 1) == 0  # nothing is padded


@pytest.mark.parametrize("limits", [(2048, 512, 2048), (256, 3, 100), (64, 64, 7)])
def test_round_trip_within_limits(spark, limits):
    docs = list(enumerate(texts()))
    df = spark.createDataFrame([(i, t, (7 * i) % 60 if i % 4 else None, "x") for i, t in docs], "doc_id long, text string, prompt int, length string").repartition(3)
    check(packing.pack_documents(df, None, *limits, loss_from="prompt").collect(), docs, limits)


def test_both_libraries_agree(spark):
    path, ranks = packing.default_tokenizer()
    both, one = packing.Encoder(path, ranks, public_tokenizers.PATTERN), packing.Encoder(path, None, None)
    given = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    plain = 0
    for text in [*given, *texts(3000)]:
        assert np.array_equal(both.encode(text), one.encode(text))
        plain += bool(text and packing.PLAIN.fullmatch(text))
    assert plain > len(given)


def test_empty_null_ids_and_impossible_limits(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack_documents(none).collect() == []
    got = packing.pack_documents(spark.createDataFrame([(None, None), (None, "a")], none.schema)).collect()
    assert sum(r["length"] for r in got) == 3 and {r["doc_id"] for r in got} == {None}
    packer = packing.Packer(8, 2, 0)
    packer.add([(1, 0, np.arange(3), 0, 3)])
    with pytest.raises(ValueError, match="no room"):
        packer.fill(8)


def test_query_and_stage_have_the_ids_of_the_file_as_loaded(spark, tmp_path):
    import corpus_pipeline
    from weighbridge.llm import queries

    end = "<|endoftext|>"
    given = [f"a {end} b", end, f"{end}{end}\n", f"你好{end} \U0001f600", f"{end} word " * 900, end[:-1], "< |endoftext|>", "plain", None]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(given)}
    assert want[0] == [64, 220, 50256, 275, 1] and 50256 not in want[5] + want[6]
    docs = spark.createDataFrame(list(enumerate(given)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for out in (queries.op3_packing(spark, str(tmp_path)), corpus_pipeline.pack(spark, docs, str(tmp_path))):
        length = dict.fromkeys(want, 0)
        for r in out.collect():
            ids = want[r["doc_id"]]
            piece = ids[r["start"] : r["start"] + r["length"]]
            assert r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(np.array(piece, "<u4").tobytes())
            length[r["doc_id"]] += r["length"]
        assert length == {i: len(ids) for i, ids in want.items()}
    path, ranks = packing.default_tokenizer()
    both = packing.Encoder(path, ranks, public_tokenizers.PATTERN, as_loaded=True)
    for text in [*given, *texts(300)]:
        assert both.encode(text).tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids
