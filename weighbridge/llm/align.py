"""Alignment of two tokenizers' tokens over a corpus, by lockstep vectorised merging.

Each text, with one space before it, is encoded by A (byte-level BPE; its entries decode to bytes) and by B
(pieces; B adds the space itself; U+2581 is a space and ``<0xHH>`` a byte). Both token sequences cover the same
bytes, so their end offsets are merged: a chunk's documents are the lanes of one NumPy state vector of A and B
pointers. Each step links every lane's current A and B token (their byte ranges overlap), advances the pointer
whose token ends first, and both where they end together, which is a cut between two groups; lanes that have
reached their end are compacted away. A document of many tokens enters as several lanes that meet at offsets where
tokens of both end, so that no long document holds the vector open alone.

How often an id pair is linked in the whole corpus is summed by the owners of
:mod:`weighbridge.llm.tally`: a chunk sends its distinct pairs, and gets their totals back. The highest count of each
B id, at most one row per entry of B's vocabulary, is broadcast. Nothing else goes through the driver.

Defined cases: texts that are null, empty, or whose joined A or B bytes differ from space and text (a literal U+2581)
have no tokens: zeros and an empty ``groups_sha256``. Strings of special tokens are plain text. A null id is returned as any
other; repeated rows count and are returned as often as they occur; an empty table gives no rows; a very long text is
one document of many lanes, whole; ties for a B id's highest count all count; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weighbridge.llm import tally
from weighbridge.llm.katz import pack, pack_sorted, unpack, unpack_sorted
from weighbridge.llm.packing import Encoder, default_tokenizer
from weighbridge.session import materialize

CHUNK = 4 << 20  # bytes of text
LANE = 512  # A tokens of a lane, or more where both tokenizers' ends do not meet
WORDS = 1 << 18  # encoded segments that a Python worker remembers
MIX, UNMIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


# ---- the two encoders --------------------------------------------------------------
def byte_of_char() -> dict[str, int]:
    """Byte-level BPE writes printable bytes as themselves and the others, in order, as characters from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteTokens:
    """A: ids of texts and the bytes of each id."""

    def __init__(self, path: str, ranks: str | None):
        import public_tokenizers

        self.encoder = Encoder.of_worker(path, ranks, ranks and public_tokenizers.PATTERN, False)
        exact, chars = self.encoder.exact, byte_of_char()
        added = {i: t.content.encode() for i, t in exact.get_added_tokens_decoder().items()}
        entries = {i: added.get(i) or bytes(chars[c] for c in s) for s, i in exact.get_vocab(with_added_tokens=True).items()}
        self.bytes = [entries.get(i, b"") for i in range(max(entries) + 1)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [self.encoder.encode(" " + t).astype(np.int64) for t in texts]


class PieceTokens:
    """B: ids of texts and the bytes of each id.

    No piece holds a space after another sign, or a line feed beside another sign: merges stay inside the
    segments between those places, so a segment is encoded once and remembered. A model for which that does not hold, and
    a text with the space sign itself, is encoded whole."""

    SEGMENT = re.compile(r"(?: +|\n)[^ \n]*")

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.vocab_size()
        pieces = [self.model.id_to_piece(i) for i in range(n)]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.space = self.model.piece_to_id("▁")
        probe = ["a  b ", "  ", "ﬁ ①\n\n x", "é ́"]
        crossing = any(re.search("[^▁]▁", p) or ("\n" in p and len(p) > 1) for p in pieces)
        self.known: dict[str, list[int]] = {}
        self.local = not crossing and all(self._joined([t]) == self.model.encode([t]) for t in probe)

    def _joined(self, texts: list[str]) -> list[list[int]]:
        cut = [self.SEGMENT.findall(" " + t) for t in texts]
        known = self.known
        if len(known) > WORDS:
            known.clear()
        new = list({s for parts in cut for s in parts if s not in known})
        for s, ids in zip(new, self.model.encode([s[1:] if s[0] == " " else s for s in new], num_threads=1), strict=True):
            # a line feed comes after the space that B adds; a lone last space is that space
            known[s] = ids[1:] if s[0] == "\n" else ids or [self.space]
        return [[i for s in parts for i in known[s]] for parts in cut]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list = [None] * len(texts)
        whole = [i for i, t in enumerate(texts) if not self.local or "▁" in t]
        for i, ids in zip(whole, self.model.encode([texts[i] for i in whole], num_threads=1) if whole else [], strict=True):
            out[i] = ids
        rest = [i for i in range(len(texts)) if out[i] is None]
        for i, ids in zip(rest, self._joined([texts[i] for i in rest]), strict=True):
            out[i] = ids
        return [np.array(ids, np.int64) for ids in out]


@lru_cache(maxsize=4)
def tokenizers_of_worker(path: str, ranks: str | None, pieces: str) -> tuple[ByteTokens, PieceTokens]:
    return ByteTokens(path, ranks), PieceTokens(pieces)


def joined(ids: np.ndarray, table: list[bytes]) -> bytes:
    return b"".join(map(table.__getitem__, ids.tolist()))


# ---- lockstep ------------------------------------------------------------------------
def lanes(a_ends: np.ndarray, b_ends: np.ndarray, a_docs: np.ndarray, b_docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First A and B token of each lane; ``a_docs``, ``b_docs``: first tokens of the documents (and the ends).

    A lane opens at each document and at the first common end after every ``LANE`` A tokens of one."""
    at = np.searchsorted(b_ends, a_ends)
    meets = np.flatnonzero(b_ends[np.minimum(at, len(b_ends) - 1)] == a_ends) + 1  # A tokens that follow a common end
    targets = np.concatenate([np.arange(a + LANE, z, LANE) for a, z in zip(a_docs[:-1].tolist(), a_docs[1:].tolist(), strict=True)] or [[]]).astype(np.int64)
    opens = meets[np.minimum(np.searchsorted(meets, targets), len(meets) - 1)] if len(meets) else targets[:0]
    a_first = np.unique(np.concatenate([a_docs[:-1], opens[opens < len(a_ends)]]))
    b_first = np.where(a_first == 0, 0, at[np.maximum(a_first - 1, 0)] + 1)
    return a_first, b_first


def lockstep(a_ends: np.ndarray, b_ends: np.ndarray, a_first: np.ndarray, b_first: np.ndarray):
    """Links ``(a, b)`` as token positions, and the cuts: flags of the A and B tokens that end a group.

    ``a_ends``, ``b_ends``: increasing end offsets of all documents' tokens, one document's bytes after another's."""
    a, b = a_first.copy(), b_first.copy()
    stop = np.append(a_first[1:], len(a_ends))
    a_cut, b_cut = np.zeros(len(a_ends), bool), np.zeros(len(b_ends), bool)
    links_a, links_b = [], []
    while len(a):
        links_a.append(a)
        links_b.append(b)
        ends_a, ends_b = a_ends[a], b_ends[b]
        step_a, step_b = ends_a <= ends_b, ends_b <= ends_a
        both = step_a & step_b
        a_cut[a[both]] = True
        b_cut[b[both]] = True
        a, b = a + step_a, b + step_b
        left = ~both | (a < stop)
        if not left.all():
            a, b, stop = a[left], b[left], stop[left]
    empty = np.empty(0, np.int64)
    return np.concatenate([empty, *links_a]), np.concatenate([empty, *links_b]), a_cut, b_cut


@lru_cache(maxsize=2)
def _digits(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of each id below ``size``, one more byte for a sign, and their number."""
    text = [str(i).encode() for i in range(size)]
    wide = max(map(len, text)) + 1
    return np.array(text, f"S{wide}").view(np.uint8).reshape(size, wide), np.array([len(t) for t in text])


def group_texts(a_ids, b_ids, a_cut, b_cut, a_docs, b_docs) -> list[bytes]:
    """``a1,a2|b1;a3|b2,b3`` of each document: the ids of each group's A tokens, then of its B tokens."""
    n = len(a_ids) + len(b_ids)
    if n == 0:
        return [b""] * (len(a_docs) - 1)
    a_group, b_group = np.cumsum(a_cut) - a_cut, np.cumsum(b_cut) - b_cut
    a_after = np.flatnonzero(a_cut) + 1  # A tokens of the groups so far, this one included
    b_before = np.append(0, np.flatnonzero(b_cut) + 1)
    a_at, b_at = np.arange(len(a_ids)) + b_before[a_group], np.arange(len(b_ids)) + a_after[b_group]
    ids, sign = np.empty(n, np.int64), np.empty(n, np.uint8)
    ids[a_at], ids[b_at] = a_ids, b_ids
    sign[a_at], sign[b_at] = np.where(a_cut, ord("|"), ord(",")), np.where(b_cut, ord(";"), ord(","))
    digits, sizes = _digits(int(ids.max()) + 1 if ids.max() >= 65_536 else 65_536)
    rows, size = digits[ids], sizes[ids]
    rows[np.arange(n), size] = sign
    flat = rows[np.arange(rows.shape[1]) <= size[:, None]].tobytes()
    ends = np.append(0, np.cumsum(size + 1))[a_docs + b_docs].tolist()
    return [flat[x : y - 1] if y > x else b"" for x, y in zip(ends, ends[1:], strict=False)]


def align_texts(texts: list[str | None], a: ByteTokens, b: PieceTokens) -> dict:
    """Tokens, links and groups of a chunk's texts, as flat arrays; ``a_docs``/``b_docs`` bound each text's tokens."""
    given = [i for i, t in enumerate(texts) if t]
    a_of, b_of = [np.empty(0, np.int64)] * len(texts), [np.empty(0, np.int64)] * len(texts)
    some = [texts[i] for i in given]
    for i, text, x, y in zip(given, some, a.encode(some), b.encode(some), strict=True):
        want = (" " + text).encode()
        if joined(x, a.bytes) == want and joined(y, b.bytes) == want:
            a_of[i], b_of[i] = x, y
    a_docs = np.cumsum([0, *map(len, a_of)])
    b_docs = np.cumsum([0, *map(len, b_of)])
    empty = np.empty(0, np.int64)
    a_ids, b_ids = np.concatenate([empty, *a_of]), np.concatenate([empty, *b_of])
    a_ends = np.cumsum(np.array([len(x) for x in a.bytes])[a_ids])
    b_ends = np.cumsum(np.array([len(x) for x in b.bytes])[b_ids])
    first = lanes(a_ends, b_ends, a_docs, b_docs) if len(a_ids) else (empty, empty)
    link_a, link_b, a_cut, b_cut = lockstep(a_ends, b_ends, *first)
    return dict(a_docs=a_docs, b_docs=b_docs, a_ids=a_ids, b_ids=b_ids, link_a=link_a, link_b=link_b, a_cut=a_cut, b_cut=b_cut)


# ---- the corpus ------------------------------------------------------------------------
CHUNK_SCHEMA = (
    "chunk long, n_keys long, keys binary, counts binary, ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, "
    "n_links array<long>, groups array<string>, linked binary, ranks binary, times binary"
)


def chunk_rows(docs: DataFrame, path: str, ranks: str | None, pieces: str, chunk_bytes: int, id_col: str, text_col: str) -> DataFrame:
    """One row per chunk: what is known of each of its documents, its distinct pairs with their counts (``keys``, ``counts``),
    and each document's distinct pairs (``linked`` of them: their ``ranks`` among the keys, their ``times``)."""

    def close(chunk, ids, texts):
        got = align_texts(texts, *tokenizers_of_worker(path, ranks, pieces))
        a_docs, b_docs = got["a_docs"], got["b_docs"]
        n = len(texts)
        doc = np.searchsorted(a_docs, got["link_a"], side="right") - 1
        pair = ((got["a_ids"][got["link_a"]].astype(np.uint64) << np.uint64(32)) | got["b_ids"][got["link_b"]].astype(np.uint64)) * MIX
        keys, rank, counts = np.unique(pair, return_inverse=True, return_counts=True)
        own, times = np.unique((doc << 32) | rank, return_counts=True)
        per_doc = lambda flags, ends: np.diff(np.append(0, np.cumsum(flags))[ends]).tolist()
        texts_of = group_texts(got["a_ids"], got["b_ids"], got["a_cut"], got["b_cut"], a_docs, b_docs)
        linked = np.bincount(own >> 32, minlength=n)
        return pa.RecordBatch.from_pydict(
            {
                "chunk": pa.array([chunk]),
                "n_keys": pa.array([len(keys)]),
                "keys": pa.array([pack_sorted(keys)], pa.binary()),
                "counts": pa.array([pack(counts.astype(np.uint32))], pa.binary()),
                "ids": pa.array([ids], pa.list_(pa.int64())),
                "n_a": pa.array([np.diff(a_docs).tolist()]),
                "n_b": pa.array([np.diff(b_docs).tolist()]),
                "n_groups": pa.array([per_doc(got["a_cut"], a_docs)]),
                "n_links": pa.array([np.bincount(doc, minlength=n).tolist()]),
                "groups": pa.array([[hashlib.sha256(t).hexdigest() if t else "" for t in texts_of]]),
                "linked": pa.array([pack(linked.astype(np.uint32))], pa.binary()),
                "ranks": pa.array([pack(np.diff(own & 0xFFFFFFFF, prepend=0).astype(np.int32))], pa.binary()),
                "times": pa.array([pack(times.astype(np.uint32))], pa.binary()),
            }
        )

    def run(batches):
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 33
        ids, texts, size = [], [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                ids.append(doc)
                texts.append(text)
                size += len(text or "")
                if size >= chunk_bytes:
                    yield close(chunk, ids, texts)
                    ids, texts, size, chunk = [], [], 0, chunk + 1
        if ids:
            yield close(chunk, ids, texts)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, CHUNK_SCHEMA)


def _best_of_owner(keys: np.ndarray, totals: np.ndarray) -> list[int]:
    """``b, highest total, b, ...`` of an owner's pairs."""
    b = (keys * UNMIX & np.uint64(0xFFFFFFFF)).astype(np.int64)
    order = np.lexsort((totals, b))
    last = np.flatnonzero(np.append(np.diff(b[order]) != 0, True)) if len(b) else np.empty(0, np.int64)
    return np.column_stack([b[order][last], totals[order][last]]).ravel().tolist()


def align_tokenizers(
    docs: DataFrame,
    tokenizer: tuple[str, str | None] | None = None,
    pieces: str | None = None,
    chunk_bytes: int = CHUNK,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every row.

    ``tokenizer``: A's file, and the same vocabulary as ranks or None; ``pieces``: B's model file."""
    spark = docs.sparkSession
    path, ranks = tokenizer or default_tokenizer()
    chunks = materialize(chunk_rows(docs, path, ranks, pieces or default_pieces(), chunk_bytes, id_col, text_col), "align-chunks")
    asked = tally.ask(chunks, tally.owners(tally.count_asked(chunks)))
    told = materialize(tally.answer(asked, lambda t: pack(t.astype(np.uint64)), _best_of_owner, "array<long>"), "align-totals")
    at = F.explode(F.sequence(F.lit(0), (F.size("summary") / 2 - 1).cast("int"))).alias("i")
    tops = told.where(F.size("summary") > 0).select("summary", at).select(F.col("summary")[F.col("i") * 2].alias("b"), F.col("summary")[F.col("i") * 2 + 1].alias("n"))
    tops = tops.groupBy("b").agg(F.max("n").alias("n")).collect()  # at most one row per entry of B's vocabulary
    best = np.zeros(max((r["b"] for r in tops), default=0) + 1, np.int64)
    for r in tops:
        best[r["b"]] = r["n"]
    highest = spark.sparkContext.broadcast(best)

    def run(chunk_table, told_table):
        row = chunk_table.to_pylist()[0]
        replies = sorted((r["part"], r["reply"]) for r in told_table.to_pylist())
        totals = np.concatenate([np.empty(0, np.int64), *[unpack(r, np.uint64).astype(np.int64) for _, r in replies]])
        top = totals == highest.value[(unpack_sorted(row["keys"]) * UNMIX & np.uint64(0xFFFFFFFF)).astype(np.int64)]
        linked, times = unpack(row["linked"], np.uint32).astype(np.int64), unpack(row["times"], np.uint32).astype(np.int64)
        rank = np.cumsum(unpack(row["ranks"], np.int32).astype(np.int64))
        ends = np.append(0, np.cumsum(linked))
        add = lambda x: np.diff(np.append(0, np.cumsum(x))[ends])
        out = {"id": pa.array(row["ids"], pa.int64())}
        out |= {k: pa.array(row[k], pa.int64()) for k in ("n_a", "n_b", "n_groups", "n_links")}
        out |= {"n_best": pa.array(add(times * top[rank])), "count_sum": pa.array(add(times * totals[rank]))}
        return pa.table(out | {"groups_sha256": pa.array(row["groups"], pa.string())})

    schema = "id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    kept = chunks.drop("n_keys", "counts").groupBy("chunk")
    out = kept.cogroup(told.select("chunk", "part", "reply").groupBy("chunk")).applyInArrow(run, schema)
    return out.withColumnRenamed("id", id_col)
