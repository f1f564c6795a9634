"""Tokenizer alignment against a plain version: byte ranges compared token by token, counts in dictionaries."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from weighbridge.llm import align, tally
from weighbridge.llm.packing import default_tokenizer

SIGNS = "abcdeABC  \n\n 09.,-éßçŁЖ你好日本\t ́\U0001f600<>s|/ﬁ①\x00"


def texts(n=120):
    rnd = random.Random(5)
    out = ["".join(rnd.choices(SIGNS, k=rnd.choice([1, 4, 40, 600]))) for _ in range(n)]
    odd = [None, "", " ", "  ", "\n", "a\n b \n", "x ", "a▁b", "▁", "<|endoftext|> <s></s><unk>", "<0x41>", "word " * 3000, "y" * 5000, "　 a"]
    return [*out, *odd, out[0], out[0]]


def plain_tokens():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    # the usual table of byte-level BPE, written out the long way
    keep = [b_ for b_ in range(256) if 33 <= b_ <= 126 or 161 <= b_ <= 172 or b_ >= 174]
    chars, extra = {}, 0
    for byte in range(256):
        if byte in keep:
            chars[chr(byte)] = byte
        else:
            chars[chr(256 + extra)] = byte
            extra += 1
    a_bytes = lambda i: bytes(chars[c] for c in a.id_to_token(i))

    def b_bytes(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if p.startswith("<0x") and p.endswith(">") and len(p) == 6 else p.replace("▁", " ").encode()

    def of(text):
        if not text:
            return [], []
        x = [(i, a_bytes(i)) for i in a.encode(" " + text, add_special_tokens=False).ids]
        y = [(i, b_bytes(i)) for i in b.encode(text)]
        want = (" " + text).encode()
        return (x, y) if b"".join(t for _, t in x) == want and b"".join(t for _, t in y) == want else ([], [])

    return of


def brute(docs):
    of, corpus, found = plain_tokens(), Counter(), []
    for doc, text in docs:
        x, y = of(text)
        spans = []
        for tokens in (x, y):
            at, out = 0, []
            for i, t in tokens:
                out.append((at, at + len(t), i))
                at += len(t)
            spans.append(out)
        links, j0 = [], 0
        for s, e, i in spans[0]:
            while j0 < len(spans[1]) and spans[1][j0][1] <= s:
                j0 += 1
            j = j0
            while j < len(spans[1]) and spans[1][j][0] < e:
                links.append((i, spans[1][j][2]))
                j += 1
        cuts = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups, start = [], 0
        for c in cuts:
            side = [",".join(str(i) for s, e, i in tokens if start <= s and e <= c) for tokens in spans] if len(cuts) < 400 else None
            groups.append(side)
            start = c
        text_of = ";".join("|".join(g) for g in groups) if None not in groups else None
        corpus.update(links)
        found.append((doc, len(x), len(y), len(cuts), links, text_of))
    top = defaultdict(int)
    for (_, b), n in corpus.items():
        top[b] = max(top[b], n)
    return [
        (doc, nx, ny, nc, len(links), sum(corpus[p] == top[p[1]] for p in links), sum(corpus[p] for p in links), t)
        for doc, nx, ny, nc, links, t in found
    ]


def compare(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, *map(str, r[1:7]))
    got = sorted((tuple(r) for r in got), key=key)
    want = sorted(want, key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:7] == w[:7]
        if w[7] is not None:
            assert g[7] == (hashlib.sha256(w[7].encode()).hexdigest() if w[7] else "")


def test_same_as_plain_version(spark, monkeypatch):
    docs = [*enumerate(texts()), (None, "a null id, twice"), (None, "a null id, twice"), (3, "id 3 again")]
    df = spark.createDataFrame([(i, t, 9, "c") for i, t in docs], "doc_id long, text string, n_a int, chunk string").repartition(3)
    want = brute(docs)
    compare(align.align_tokenizers(df).collect(), want)
    compare(align.align_tokenizers(df, tokenizer=(default_tokenizer()[0], None), chunk_bytes=700).collect(), want)
    monkeypatch.setattr(tally, "OWNER_KEYS", 500)  # many owners
    compare(align.align_tokenizers(df, chunk_bytes=5000).collect(), want)


def test_given_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    compare(align.align_tokenizers(df).collect(), brute([(r["doc_id"], r["text"]) for r in df.collect()]))


def test_empty_table_and_nothing_but_empty_texts(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert align.align_tokenizers(none).collect() == []
    got = align.align_tokenizers(spark.createDataFrame([(1, None), (2, ""), (3, "▁")], none.schema)).collect()
    assert sorted(map(tuple, got)) == [(i, 0, 0, 0, 0, 0, 0, "") for i in (1, 2, 3)]


def test_segments_encode_as_the_whole_text():
    b = align.PieceTokens(align.default_pieces())
    assert b.local
    given = [t for t in texts(4000) if t]
    for text, got, want in zip(given, b.encode(given), b.model.encode(given), strict=True):
        assert got.tolist() == want, text


def test_lanes_change_nothing(monkeypatch):
    tokens = align.tokenizers_of_worker(*default_tokenizer(), align.default_pieces())
    given = ["word " * 2000, None, "éßЖ你好日本 " * 700, "", "y" * 9000, "short"]
    one = align.align_texts(given, *tokens)
    for lane in (1, 3, 64):
        monkeypatch.setattr(align, "LANE", lane)
        got = align.align_texts(given, *tokens)
        for k in ("a_cut", "b_cut"):
            assert np.array_equal(one[k], got[k])
        links = lambda x: sorted(zip(x["link_a"].tolist(), x["link_b"].tolist(), strict=True))
        assert links(one) == links(got)
