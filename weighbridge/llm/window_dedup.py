"""Exact removal of repeated passages: count-min prefilter over windows, then exact grouping of what it lets through.

A window is ``WINDOW`` consecutive words of a document. Each word covered by a window whose word sequence also starts in a
document with a smaller id is removed.

Windows are sketched through their anchors: of the ``GRAM``-word sequences inside a window, the one with the smallest
hash. Equal windows have equal anchors, so an anchor's count is no less than the number of documents that hold any of its
windows, and neighbouring windows share an anchor: a run of them is a segment, one entry in place of some eighteen.

1. *Sketch.* Each chunk (some MB of text in one task) makes a count-min sketch of its segments' anchors: two rows of
   counters, 16 for each segment of the corpus. Counter ranges are owned (:mod:`weighbridge.llm.tally`): owners
   merge the chunks' sketches and tell each chunk the merged counts of its counters. The smaller of an anchor's
   two counts is never too low, so windows estimated at one document are done with, and none that repeats is lost.
2. *Exact grouping.* Segments estimated repeated are grouped by their whole word sequence (two 64-bit hashes): all but the smallest
   document of a group lose all windows of the segment. Where a group is not all of its anchor's segments, the windows of
   its smallest document are grouped one by one, which finds repeats that begin or end inside a segment.

Chunks ask owners and are answered in the order they asked, so a passage that a third of all documents hold is one entry
per chunk, and texts stay where they were first written: a table bucketed by chunk below the checkpoint folder.

Defined cases: null texts have no words; documents of fewer words than a window lose none; a null id neither loses words nor
takes any; rows that repeat an id are documents of the same id, so neither loses to the other; the input decides, not what is
left, so a run of equal words is judged like any text; very long texts are one chunk, whole; an empty table gives no
rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weighbridge.llm import tally
from weighbridge.llm.common import bucketed
from weighbridge.llm.katz import _by_part, owner, pack, pack_sorted, unpack, unpack_sorted
from weighbridge.session import materialize

WINDOW, GRAM = 50, 16
CHUNK = 4 << 20  # bytes of text
ROOM = 16  # counters of a sketch row for each segment
BASES = np.array([0x9E3779B97F4A7C15, 0xD1342543DE82EF95], np.uint64)
EMPTY = hashlib.sha256(b"").hexdigest()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Hashes of any word range of a sequence, equal for equal ranges wherever they stand."""

    def __init__(self, words: np.ndarray, lane: int):
        n = len(words)
        base = np.full(n + 1, BASES[lane])
        base[0] = 1
        self.powers = np.cumprod(base, dtype=np.uint64)
        base[1:] = np.uint64(pow(int(BASES[lane]), -1, 1 << 64))
        self.inverse = np.cumprod(base, dtype=np.uint64)
        self.sums = np.append(np.uint64(0), np.cumsum(words * self.powers[:n], dtype=np.uint64))

    def of(self, start: np.ndarray, length) -> np.ndarray:
        length = np.asarray(length, np.int64)
        return mix((self.sums[start + length] - self.sums[start]) * self.inverse[start] + length.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


def word_hashes(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each word, texts after one another."""
    import xxhash

    local: dict = defaultdict(count().__next__)
    ranks = [np.fromiter(map(local.__getitem__, words), np.int64, len(words)) for words in texts]
    table = np.frombuffer(b"".join(map(xxhash.xxh128_digest, local)), "<u8").reshape(-1, 2)
    flat = np.concatenate([np.empty(0, np.int64), *ranks])
    return table[flat, 0], table[flat, 1]


def anchors(grams: np.ndarray, starts: np.ndarray, window: int, gram: int) -> np.ndarray:
    """The smallest of the ``window - gram + 1`` gram hashes in each window."""
    span, wide, low = window - gram + 1, 1, grams
    while 2 * wide <= span:
        low = np.minimum(low, np.concatenate([low[wide:], low[len(low) - min(wide, len(low)) :]])[: len(low)])
        wide *= 2
    return np.minimum(low[starts], low[starts + span - wide])


class Windows:
    """Hashes of a chunk's words and windows."""

    def __init__(self, texts: list[list[bytes]]):
        self.size = np.array([len(t) for t in texts], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.lanes = [Rolling(h, lane) for lane, h in enumerate(word_hashes(texts))]

    def segments(self, window: int, gram: int) -> dict:
        """Runs of windows with one anchor: ``doc``, ``at`` (first window, from the document's start), ``n`` windows, ``m``, ``k1``, ``k2``."""
        held = np.maximum(self.size - window + 1, 0)
        doc = np.repeat(np.arange(len(held)), held)
        at = np.arange(len(doc)) - np.repeat(np.cumsum(held) - held, held)
        starts = at + self.first[doc]
        total = int(self.size.sum())
        if not len(doc):
            none = np.empty(0, np.int64)
            return {"doc": none, "at": none, "n": none, "m": none.astype(np.uint64), "k1": none.astype(np.uint64), "k2": none.astype(np.uint64)}
        grams = self.lanes[0].of(np.arange(total - gram + 1), gram)
        m = anchors(grams, starts, window, gram)
        new = np.ones(len(doc), bool)
        new[1:] = (np.diff(doc) != 0) | (m[1:] != m[:-1])
        first = np.flatnonzero(new)
        n = np.diff(np.append(first, len(doc)))
        k1, k2 = (lane.of(starts[first], n + window - 1) for lane in self.lanes)
        return {"doc": doc[first], "at": at[first], "n": n, "m": m[first], "k1": k1, "k2": k2}

    def keys(self, doc: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
        start = self.first[doc] + at
        return self.lanes[0].of(start, window), self.lanes[1].of(start, window)


# ---- chunks ---------------------------------------------------------------------------
CHUNK_SCHEMA = (
    "chunk long, n_segments long, ids array<long>, n_words array<long>, kept array<string>, sizes binary, texts binary, "
    "doc binary, at binary, n binary, m binary, k1 binary, k2 binary"
)


def chunk_rows(docs: DataFrame, window: int, gram: int, chunk_bytes: int, id_col: str, text_col: str) -> DataFrame:
    """One row per chunk: its documents with the SHA-256 of all their words, the texts of those that have windows,
    and their segments."""

    def close(chunk, ids, texts):
        import zstandard

        words = [(t or b"").split() for t in texts]
        long = [len(w) >= window and i is not None for w, i in zip(words, ids, strict=True)]
        found = Windows([w if x else [] for w, x in zip(words, long, strict=True)]).segments(window, gram)
        packed = {k: pa.array([pack(np.diff(found[k], prepend=0).astype(np.int32) if k in ("doc", "at") else found[k].astype(np.uint32))], pa.binary()) for k in ("doc", "at", "n")}
        return pa.RecordBatch.from_pydict(
            {
                "chunk": pa.array([chunk]),
                "n_segments": pa.array([len(found["doc"])]),
                "ids": pa.array([ids], pa.list_(pa.int64())),
                "n_words": pa.array([[len(w) for w in words]]),
                "kept": pa.array([[hashlib.sha256(b" ".join(w)).hexdigest() for w in words]]),
                "sizes": pa.array([pack(np.array([len(t) if x else 0 for t, x in zip(texts, long, strict=True)], np.int64))], pa.binary()),
                "texts": pa.array([zstandard.ZstdCompressor(level=3).compress(b"".join(t for t, x in zip(texts, long, strict=True) if x))], pa.binary()),
                **packed,
                **{k: pa.array([pack(found[k])], pa.binary()) for k in ("m", "k1", "k2")},
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
                size += len(text or b"")
                if size >= chunk_bytes:
                    yield close(chunk, ids, texts)
                    ids, texts, size, chunk = [], [], 0, chunk + 1
        if ids:
            yield close(chunk, ids, texts)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, CHUNK_SCHEMA)


def cells(m: np.ndarray, bits: int) -> np.ndarray:
    """An anchor's counter in each of the sketch's two rows, as the top bits of a key: the row, then the counter."""
    rows = [mix(m ^ np.uint64(salt)) >> np.uint64(64 - bits) for salt in (0x2545F4914F6CDD1D, 0x9FB21C651E98DF25)]
    return np.stack([r << np.uint64(63 - bits) | np.uint64(j << 63) for j, r in enumerate(rows)])


def sketches(chunks: DataFrame, bits: int) -> DataFrame:
    """``chunk, keys, counts``: each chunk's counters that are not 0."""

    def run(batches):
        for batch in batches:
            for chunk, m in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                keys, counts = np.unique(cells(unpack(m, np.uint64), bits), return_counts=True)
                yield pa.RecordBatch.from_pydict({"chunk": [chunk], "keys": [pack_sorted(keys)], "counts": [pack(counts.astype(np.uint32))]})

    return chunks.where("n_segments > 0").select("chunk", "m").mapInArrow(run, "chunk long, keys binary, counts binary")


ASK = ["part", "chunk", "k1", "k2", "low", "n"]
ASK_SCHEMA = "part long, chunk long, k1 binary, k2 binary, low binary, n binary"


def _ask(chunk: int, k1, k2, low, n, parts: int) -> pa.Table:
    """Requests about keys sorted by ``(k1, k2)``: the chunk's smallest id of each, and how often it holds it."""
    ends = np.searchsorted(owner(k1, parts), np.arange(parts + 1))
    rows = [(p, chunk, pack_sorted(k1[a:b]), pack(k2[a:b]), pack(low[a:b]), pack(n[a:b].astype(np.uint32))) for p, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)) if b > a]
    columns = list(zip(*rows, strict=True)) or [[]] * 6
    return pa.table([pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.int64(), *[pa.binary()] * 4], strict=True)], names=ASK)


def grouped(asked: DataFrame) -> DataFrame:
    """``chunk, part, less, total``: for each key in the order asked, whether a smaller id holds it elsewhere, and how often all chunks do."""

    def run(batches):
        for part, rows in _by_part(batches):
            k1 = [unpack_sorted(r[1]) for r in rows]
            sizes = np.cumsum([len(k) for k in k1])[:-1]
            k1, k2 = np.concatenate(k1), np.concatenate([unpack(r[2], np.uint64) for r in rows])
            low, n = np.concatenate([unpack(r[3], np.int64) for r in rows]), np.concatenate([unpack(r[4], np.uint32) for r in rows]).astype(np.int64)
            order = np.lexsort((k2, k1))
            new = np.ones(len(order), bool)
            new[1:] = (np.diff(k1[order]) != 0) | (np.diff(k2[order]) != 0)
            first = np.flatnonzero(new)
            of = np.empty(len(order), np.int64)
            of[order] = np.cumsum(new) - 1
            least, total = np.minimum.reduceat(low[order], first), np.add.reduceat(n[order], first)
            less, total = np.split(least[of] < low, sizes), np.split(np.minimum(total[of], 0xFFFFFFFF).astype(np.uint32), sizes)
            columns = [pa.array([r[0] for r in rows], pa.int64()), pa.array([part] * len(rows), pa.int64())]
            columns += [pa.array([np.packbits(x).tobytes() for x in less], pa.binary()), pa.array([pack(x) for x in total], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["chunk", "part", "less", "total"])

    dealt = asked.repartition("part").sortWithinPartitions("part", "chunk")
    return dealt.mapInArrow(run, "chunk long, part long, less binary, total binary")


class Chunk:
    """A chunk row with what it has been told so far."""

    def __init__(self, chunk_table: pa.Table, told_table: pa.Table, window: int, bits: int):
        self.row, self.window = chunk_table.to_pylist()[0], window
        self.ids = self.row["ids"]
        self.doc, self.at = (np.cumsum(unpack(self.row[k], np.int32).astype(np.int64)) for k in ("doc", "at"))
        self.n = unpack(self.row["n"], np.uint32).astype(np.int64)
        told = defaultdict(list)
        for r in sorted(told_table.to_pylist(), key=lambda r: (r["kind"], r["part"])):
            told[r["kind"]].append(r)
        m = unpack(self.row["m"], np.uint64)
        held, at = np.unique(cells(m, bits), return_inverse=True)
        counts = np.concatenate([np.zeros(0, np.uint32), *[unpack(r["total"], np.uint32) for r in told["sketch"]]])
        assert len(counts) == len(held)
        estimate = counts[at.reshape(2, -1)].min(axis=0) if len(m) else counts
        self.seg = np.flatnonzero(estimate > 1)  # segments estimated repeated
        k1, k2 = (unpack(self.row[k], np.uint64)[self.seg] for k in ("k1", "k2"))
        seg_id = self.id_of(self.doc[self.seg])
        # the chunk's groups of equal segments, sorted by key; ``lead``: the segment of the smallest id
        order = np.lexsort((seg_id, k2, k1))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(k1[order]) != 0) | (np.diff(k2[order]) != 0)
        first = np.flatnonzero(new)
        self.group = np.empty(len(order), np.int64)
        self.group[order] = np.cumsum(new) - 1
        self.lead = order[first]
        self.k1, self.k2, self.low, self.count = k1[self.lead], k2[self.lead], seg_id[self.lead], np.bincount(self.group, minlength=len(first))
        self.seg_id, self.estimate = seg_id, estimate[self.seg][self.lead]
        if told["group"]:
            total = [unpack(r["total"], np.uint32) for r in told["group"]]
            self.less = np.concatenate([self._bits(r["less"], len(t)) for r, t in zip(told["group"], total, strict=True)])
            self.total = np.concatenate(total)
        else:
            self.less, self.total = np.zeros(0, bool), np.zeros(0, np.uint32)
        self.window_told = told["window"]

    @staticmethod
    def _bits(data: bytes, size: int) -> np.ndarray:
        return np.unpackbits(np.frombuffer(data, np.uint8), count=int(size)).astype(bool)

    def id_of(self, doc: np.ndarray) -> np.ndarray:
        return np.array([0 if i is None else i for i in self.ids], np.int64)[doc]

    def words(self, docs) -> list[list[bytes]]:
        """Words of the documents in ``docs``; none of the others."""
        import zstandard

        ends, wanted = np.cumsum(unpack(self.row["sizes"], np.int64)), set(docs)
        texts = zstandard.ZstdDecompressor().decompress(self.row["texts"])
        return [texts[(int(ends[i - 1]) if i else 0) : int(ends[i])].split() if i in wanted else [] for i in range(len(self.ids))]

    def single(self, words: list[list[bytes]] | None = None) -> tuple:
        """Windows to be grouped one by one: those of each group's smallest document, where the group is not all of its anchor's
        segments and no other chunk has a smaller one. ``(doc, at)`` of each, its place among the distinct windows, and
        these, sorted, with their smallest ids."""
        lead = self.seg[self.lead[(self.total < self.estimate) & ~self.less]]
        doc = np.repeat(self.doc[lead], self.n[lead])
        at = np.arange(len(doc)) - np.repeat(np.cumsum(self.n[lead]) - self.n[lead], self.n[lead]) + np.repeat(self.at[lead], self.n[lead])
        w1, w2 = Windows(words or self.words(doc.tolist())).keys(doc, at, self.window)
        ids = self.id_of(doc)
        order = np.lexsort((ids, w2, w1))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(w1[order]) != 0) | (np.diff(w2[order]) != 0)
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(new) - 1
        first = order[new]
        return doc, at, place, w1[first], w2[first], ids[first]

    def finish(self) -> pa.Table:
        """The chunk's documents, without the words that repeat."""
        id_, kept, n_words = self.ids, list(self.row["kept"]), self.row["n_words"]
        removed = [0] * len(id_)
        # segments of all but the smallest document of their group
        gone = self.seg[(self.seg_id > self.low[self.group]) | self.less[self.group]] if len(self.seg) else self.seg
        doc, start, stop = self.doc[gone], self.at[gone], self.at[gone] + self.n[gone] + self.window - 1
        # a document that loses all its words needs no text
        todo = (self.total < self.estimate) & ~self.less
        wanted = {*doc.tolist(), *self.doc[self.seg[self.lead[todo]]].tolist()}
        words = self.words(wanted) if wanted else [[]] * len(id_)
        if todo.any():
            s_doc, s_at, place, w1, _, low = self.single(words)
            sizes = np.diff(np.searchsorted(owner(w1, self.parts), np.arange(self.parts + 1)))
            less = np.concatenate([np.zeros(0, bool), *[self._bits(r["less"], sizes[r["part"]]) for r in self.window_told]])
            lost = less[place] | (low[place] < self.id_of(s_doc))
            doc, start = np.concatenate([doc, s_doc[lost]]), np.concatenate([start, s_at[lost]])
            stop = np.concatenate([stop, s_at[lost] + self.window])
        order = np.argsort(doc, kind="stable")
        doc, start, stop = doc[order], start[order], stop[order]
        bounds = np.searchsorted(doc, np.arange(len(id_) + 1)).tolist()
        for i in np.unique(doc).tolist():
            a, b = bounds[i], bounds[i + 1]
            change = np.zeros(len(words[i]) + 1, np.int64)
            np.add.at(change, start[a:b], 1)
            np.add.at(change, stop[a:b], -1)
            covered = np.cumsum(change[:-1]) > 0
            removed[i] = int(covered.sum())
            kept[i] = hashlib.sha256(b" ".join(words[i][j] for j in np.flatnonzero(~covered).tolist())).hexdigest()
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
        return pa.table([pa.array(c, t) for c, t in zip((id_, n_words, removed, kept), types, strict=True)], names=["id", "n_words", "n_removed", "kept_sha256"])

    parts = 1


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, chunk_bytes: int = CHUNK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_words, n_removed, kept_sha256`` of every row: the words left, joined by one space, as SHA-256."""
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with bucketed(chunk_rows(docs, window, gram, chunk_bytes, id_col, text_col), buckets, "chunk", "windows") as chunks:
        segments = chunks.agg(F.coalesce(F.sum("n_segments"), F.lit(0))).first()[0]
        bits = min(62, max(10, math.ceil(math.log2(max(1, segments) * ROOM))))
        parts = tally.owners(2 * segments)
        merged = tally.answer(tally.ask(sketches(chunks, bits), parts), lambda t: pack(np.minimum(t, 0xFFFFFFFF).astype(np.uint32)))
        told = materialize(merged.select("chunk", "part", F.lit("sketch").alias("kind"), F.lit(None).cast("binary").alias("less"), F.col("reply").alias("total")), "windows-sketch")
        light = ["chunk", "ids", "doc", "at", "n", "m", "k1", "k2"]

        def ask_groups(chunk_table, told_table):
            c = Chunk(chunk_table, told_table, window, bits)
            return _ask(c.row["chunk"], c.k1, c.k2, c.low, c.count, parts)

        asked = chunks.select(*light).groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(ask_groups, ASK_SCHEMA)
        groups = materialize(grouped(asked).withColumn("kind", F.lit("group")), "windows-groups")
        told = told.unionByName(groups)

        def ask_windows(chunk_table, told_table):
            c = Chunk(chunk_table, told_table, window, bits)
            _, _, _, w1, w2, low = c.single()
            return _ask(c.row["chunk"], w1, w2, low, np.ones(len(w1)), parts)

        asked = chunks.select(*light, "sizes", "texts").groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(ask_windows, ASK_SCHEMA)
        told = told.unionByName(materialize(grouped(asked).withColumn("kind", F.lit("window")), "windows-single"))

        def finish(chunk_table, told_table):
            c = Chunk(chunk_table, told_table, window, bits)
            c.parts = parts
            return c.finish()

        out = chunks.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(finish, "id long, n_words long, n_removed long, kept_sha256 string")
        out = materialize(out, "windows-kept")
    return out.withColumnRenamed("id", id_col)
