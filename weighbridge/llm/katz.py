"""Katz backoff language model over words: Good-Turing discounts, exactly normalised backoff.

Tokens are a text's runs of non-blank characters after A-Z is lower-cased, then one
end; the first token's history is a start mark. With ``c`` the training counts,

    p(w | h) = d(c(h, w)) c(h, w) / c(h)     if the pair was seen
             = alpha(h) p(w)                 otherwise (p(w) if h was never a history)
    p(w)     = d(c(w)) c(w) / N              if the word was seen
             = what is left of 1             for all unseen words as one outcome

``d`` is Katz's discount from the Good-Turing estimate for counts up to 5: from the counts
of counts as they are up to the first ``r`` whose discount is not between 0 and 1, and from
there on from a log-linear fit of them (Simple Good-Turing). Half a count is taken off only where
no type was seen once or twice, or where the fit does not fall as fast as ``1 / r``, so that Good-Turing
estimates discount nothing. A
distribution in which no count is low enough to be discounted divides by one more, so that
something is always left. ``alpha(h)`` is what the seen pairs leave of 1 over the mass
of the words not seen after ``h``: every history's probabilities add up to 1.

Words are known by their XXH64. Documents are tokenized once into chunks of about
``CHUNK`` tokens, rows of a table bucketed by chunk. A chunk's distinct words, and then its
distinct pairs, go with their counts to the key partition that owns them (words by
hash; pairs by their history's hash, or by their word's where the history has over
``1 / HOT`` of all tokens, so that no history fills a partition). An owner
sums the counts of all chunks and answers each chunk in the order it was asked, and the
answers, tables partitioned by chunk, complete the chunk's scores. What is
shuffled grows with the distinct words and pairs of chunks, not with their occurrences,
so a hot word, pair or document group is one entry per chunk and owner.

Defined cases: null and empty texts are the end alone; a null id counts as training data and is
scored; repeated rows count and are scored as often as they occur; without training
data every probability is 1 and every score 0; a very long text is a chunk of its own, whole; ties do not arise, counts
being all that decides. Other columns are ignored, whatever their names.

The chunk table lies below the checkpoint folder and is removed when the scores are written.
"""

from __future__ import annotations

from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weighbridge.llm.common import bucketed, materialize

CHUNK = 2 << 20  # tokens
HOT = 10_000
LOW = 5  # counts up to this are discounted
END, START = b" end", b" start"  # no word holds a blank


# ---- arrays as compressed bytes -------------------------------------------------
def pack(array: np.ndarray) -> bytes:
    """Byte planes, compressed: small numbers cost little more than a bit or two."""
    import zstandard

    planes = np.ascontiguousarray(array).view(np.uint8).reshape(-1, array.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(data: bytes, dtype) -> np.ndarray:
    import zstandard

    size = np.dtype(dtype).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).view(dtype).ravel()


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, np.uint64), dtype=np.uint64)


def owner(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Key partition of each hash: equal ranges, so that sorted hashes have sorted owners."""
    return ((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


# ---- the model's arithmetic -----------------------------------------------------
def discounts(counts_of_counts) -> np.ndarray:
    """``d[0..LOW]`` (``d[0]`` unused) from the numbers of types seen 1 .. LOW + 1 times."""
    n = np.concatenate([[0.0], np.asarray(counts_of_counts, float)])
    r = np.arange(1, LOW + 1)
    half = np.concatenate([[1.0], (r - 0.5) / r])
    if not n[1] or not n[2]:
        return half

    def katz(ratio, cut):  # ratio: the estimated count over the count
        return (ratio - cut) / (1 - cut) if cut < 1 else np.zeros(LOW)

    turing = katz((r + 1) * n[2:] / (r * np.maximum(n[1:-1], 1)), (LOW + 1) * n[LOW + 1] / n[1])
    usable = np.logical_and.accumulate((turing > 0) & (turing < 1) & (n[1:-1] > 0))
    slope = _fall(n)
    smooth = katz((1 + 1 / r) ** (slope + 1), (LOW + 1.0) ** (slope + 1)) if slope < -1 else half[1:]
    return np.concatenate([[1.0], np.where(usable, turing, smooth)])


def _fall(n: np.ndarray) -> float:
    """Slope of the least-squares line through ``log Z_r`` over ``log r``: each ``n[r] > 0`` averaged over
    the gap to its neighbours that are not 0."""
    r = np.flatnonzero(n).astype(float)
    below = np.append(0.0, r[:-1])
    z = n[n > 0] / ((np.append(r[1:], 2 * r[-1] - below[-1]) - below) / 2)
    x, y = np.log(r) - np.log(r).mean(), np.log(z)
    return float((x * y).sum() / (x * x).sum())


def discounted(c: np.ndarray, d: np.ndarray) -> np.ndarray:
    return np.where(c <= LOW, d[np.minimum(c, LOW)], 1.0) * c


class Words:
    """Unigram distribution from the total, the types and their counts of counts."""

    def __init__(self, total: int, types: int, counts_of_counts):
        self.total, self.types, self.d = int(total), int(types), discounts(counts_of_counts)
        low = np.asarray(counts_of_counts, float)[:LOW]
        taken = (low * np.arange(1, LOW + 1) * (1 - self.d[1:])).sum()
        self.over = self.total + (taken <= 0)  # nothing discounted: divide by one more
        self.unseen = (taken + (taken <= 0)) / self.over

    def p(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, discounted(c, self.d) / self.over, self.unseen)


# ---- chunks ---------------------------------------------------------------------
def chunk_rows(docs: DataFrame, folds: int, out_fold: int, chunk_tokens: int, id_col: str, text_col: str) -> DataFrame:
    """``chunk, doc_ids, null_ids, held, sizes, words, train, vocab``: tokens as ranks in the chunk's sorted vocabulary."""
    from weighbridge.llm.quality import fold

    def run(batches):
        import xxhash
        from pyspark import TaskContext
        from collections import defaultdict

        chunk = TaskContext.get().partitionId() << 33

        def close(ids, held, sizes, parts, local):
            vocab = np.array([xxhash.xxh64_intdigest(w) for w in local], np.uint64)
            order = np.argsort(vocab)
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order), dtype=np.uint32)
            words, sizes = rank[np.concatenate(parts)], np.array(sizes, np.int64)
            train = np.bincount(words[np.repeat(~np.array(held), sizes)], minlength=len(order)).astype(np.uint32)
            known = np.array([i is not None for i in ids])
            return pa.RecordBatch.from_pydict(
                {
                    "chunk": pa.array([chunk]),
                    "doc_ids": pa.array([pack(np.array([i or 0 for i in ids], np.int64))], pa.binary()),
                    "null_ids": pa.array([pack((~known).astype(np.uint8))], pa.binary()),
                    "held": pa.array([pack(np.array(held, np.uint8))], pa.binary()),
                    "sizes": pa.array([pack(sizes)], pa.binary()),
                    "words": pa.array([pack(words)], pa.binary()),
                    "train": pa.array([pack(train)], pa.binary()),
                    "vocab": pa.array([pack_sorted(vocab[order])], pa.binary()),
                }
            )

        def fresh():
            local = defaultdict(count().__next__)
            return [], [], [], [], local

        state, tokens = fresh(), 0
        for batch in batches:
            for doc, out, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                ids, held, sizes, parts, local = state
                words = (text or b"").lower().split()
                words.append(END)
                parts.append(np.fromiter(map(local.__getitem__, words), np.int64, len(words)))
                ids.append(doc)
                held.append(out)
                sizes.append(len(words))
                tokens += len(words)
                if tokens >= chunk_tokens:
                    yield close(*state)
                    state, tokens, chunk = fresh(), 0, chunk + 1
        if state[0]:
            yield close(*state)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), (fold(F.col(id_col), folds) == out_fold).alias("held"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, "chunk long, doc_ids binary, null_ids binary, held binary, sizes binary, words binary, train binary, vocab binary")


def word_requests(chunks: DataFrame, parts: int) -> DataFrame:
    """``part, chunk, keys, counts``: each chunk's words and training counts by owner."""

    def run(batches):
        for batch in batches:
            for chunk, vocab, train in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                vocab, train = unpack_sorted(vocab), unpack(train, np.uint32)
                ends = np.searchsorted(owner(vocab, parts), np.arange(parts + 1))
                for p in np.flatnonzero(np.diff(ends)).tolist():
                    a, b = ends[p], ends[p + 1]
                    yield pa.RecordBatch.from_pydict({"part": [p], "chunk": [chunk], "keys": [pack_sorted(vocab[a:b])], "counts": [pack(train[a:b])]})

    return chunks.select("chunk", "vocab", "train").mapInArrow(run, "part long, chunk long, keys binary, counts binary")


def _by_part(batches):
    """``(part, rows)`` of batches sorted by their first column."""
    last, rows = None, []
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if row[0] != last and rows:
                yield last, rows
                rows = []
            last = row[0]
            rows.append(row[1:])
    if rows:
        yield last, rows


def _sum_keys(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An index of each distinct key, each row's distinct key, and the summed counts."""
    order = np.argsort(keys)
    new = np.ones(len(keys), bool)
    new[1:] = np.diff(keys[order]) != 0
    inverse = np.empty(len(keys), np.int32)
    inverse[order] = np.cumsum(new, dtype=np.int32) - 1
    first = order[new]
    return first, inverse, np.bincount(inverse, weights=counts, minlength=len(first)).astype(np.int64)


def _counts_of_counts(totals: np.ndarray) -> list[int]:
    return np.bincount(totals[totals <= LOW + 1], minlength=LOW + 2)[1 : LOW + 2].tolist()


def word_answers(requests: DataFrame) -> DataFrame:
    """``chunk, part, counts, stats``: total counts in the order asked; one row per owner has its
    ``[tokens, types, types seen once, ..., LOW + 1 times]``."""

    def run(batches):
        for part, rows in _by_part(batches):
            keys = [unpack_sorted(r[1]) for r in rows]
            _, inverse, totals = _sum_keys(np.concatenate(keys), np.concatenate([unpack(r[2], np.uint32) for r in rows]))
            answer = np.split(totals[inverse].astype(np.uint64), np.cumsum([len(k) for k in keys])[:-1])
            stats = [int(totals.sum()), int((totals > 0).sum()), *_counts_of_counts(totals)]
            yield pa.RecordBatch.from_pydict(
                {
                    "chunk": pa.array([r[0] for r in rows], pa.int64()),
                    "part": pa.array([part] * len(rows), pa.int64()),
                    "counts": pa.array([pack(a) for a in answer], pa.binary()),
                    "stats": pa.array([stats] + [None] * (len(rows) - 1), pa.list_(pa.int64())),
                }
            )

    dealt = requests.repartition("part").sortWithinPartitions("part", "chunk")
    return dealt.mapInArrow(run, "chunk long, part long, counts binary, stats array<long>")


def _sum_stats(answers: DataFrame, size: int) -> list[int]:
    row = answers.where(F.col("stats").isNotNull()).agg(*[F.coalesce(F.sum(F.col("stats")[i]), F.lit(0)).alias(f"s{i}") for i in range(size)]).first()
    return list(row)


class ChunkPairs:
    """A chunk's distinct (history, word) pairs, in the order their owners are asked."""

    def __init__(self, row: dict, word_counts: np.ndarray, total: int, parts: int):
        import xxhash

        sizes, words = unpack(row["sizes"], np.int64), unpack(row["words"], np.uint32)
        self.sizes, self.words, self.held = sizes, words, unpack(row["held"], np.uint8).astype(bool)
        vocab = unpack_sorted(row["vocab"])
        end = int(np.searchsorted(vocab, np.uint64(xxhash.xxh64_intdigest(END))))
        # the start mark is history number len(vocab); it is followed once by each training document
        self.hashes = np.append(vocab, np.uint64(xxhash.xxh64_intdigest(START)))
        self.counts = np.append(word_counts, word_counts[end])
        first = np.cumsum(sizes) - sizes
        history = np.empty(len(words), np.uint64)
        history[1:] = words[:-1]
        history[first] = len(vocab)
        keys, self.pair, = np.unique((history << np.uint64(32)) | words, return_inverse=True)[:2]
        train = np.repeat(~self.held, sizes)
        self.train = np.bincount(self.pair[train], minlength=len(keys)).astype(np.uint32)
        self.h, self.w = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
        self.hot = self.counts[self.h] * HOT > total
        self.part = owner(np.where(self.hot, self.hashes[self.w] * np.uint64(0x9E3779B97F4A7C15), self.hashes[self.h]), parts)
        self.order = np.lexsort((self.hashes[self.h], self.part))  # by owner, then history; stable, so then by word
        self.ends = np.searchsorted(self.part[self.order], np.arange(parts + 1))

    def ask(self):
        """``(part, history hashes, pairs of each, hot flags, history counts, words, word counts, training counts)``."""
        for p in np.flatnonzero(np.diff(self.ends)).tolist():
            at = self.order[self.ends[p] : self.ends[p + 1]]
            starts = self.starts(at)
            h, w = self.h[at[starts]], self.w[at]
            yield p, self.hashes[h], np.diff(np.append(starts, len(at))), self.hot[at[starts]], self.hashes[w], self.counts[w], self.train[at]

    def starts(self, at: np.ndarray) -> np.ndarray:
        """Where a new history begins in pairs ``at``."""
        return np.flatnonzero(np.diff(self.h[at], prepend=-1))


def _pairs_of(chunk_table, answer_table, total: int, parts: int) -> tuple[dict, ChunkPairs]:
    row = chunk_table.to_pylist()[0]
    answers = sorted((r for r in answer_table.to_pylist() if r["kind"] == 0), key=lambda r: r["part"])
    word_counts = np.concatenate([unpack(r["counts"], np.uint64) for r in answers]).astype(np.int64)
    return row, ChunkPairs(row, word_counts, total, parts)


ASK = ["part", "chunk", "h", "n", "hot", "w", "c_w", "train"]


def pair_requests(chunks: DataFrame, answers: DataFrame, total: int, parts: int) -> DataFrame:
    def run(chunk_table, answer_table):
        _, pairs = _pairs_of(chunk_table, answer_table, total, parts)
        chunk = chunk_table.column("chunk")[0].as_py()
        rows = [
            (p, chunk, pack_sorted(h), pack(n.astype(np.uint32)), pack(hot.astype(np.uint8)), _pack48(w), pack(c_w.astype(np.uint64)), pack(train))
            for p, h, n, hot, w, c_w, train in pairs.ask()
        ]
        kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 6]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=ASK)

    left, right = chunks.groupBy("chunk"), answers.groupBy("chunk")
    return left.cogroup(right).applyInArrow(run, "part long, chunk long, h binary, n binary, hot binary, w binary, c_w binary, train binary")


def _pack48(hashes: np.ndarray) -> bytes:
    """The top 48 bits: within one history's words, enough to tell them apart."""
    return np.ascontiguousarray(hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:]).tobytes()


def _unpack48(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, 2:] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def pair_answers(requests: DataFrame, words: Words) -> DataFrame:
    """``chunk, part, counts, full, at, mass, stats, hot``: total counts of the pairs in the order asked; per
    history whether none of its counts is low; for non-hot histories with an unseen pair, at position ``at``, their ``mass``:
    the sums of counts by 1 .. LOW and above, and of the seen words' probabilities. ``stats``: counts of counts;
    ``hot``: one row per owner has its share of the hot histories' masses."""
    size = LOW + 2

    def run(batches):
        for part, rows in _by_part(batches):
            h = [unpack_sorted(r[1]) for r in rows]
            n = [unpack(r[2], np.uint32).astype(np.int64) for r in rows]
            hot_h = np.concatenate([unpack(r[3], np.uint8) for r in rows]).astype(bool)
            lengths = [int(x.sum()) for x in n]
            all_h, all_n = np.concatenate(h), np.concatenate(n)
            h_keys, h_first, h_of = np.unique(all_h, return_index=True, return_inverse=True)
            of = np.repeat(h_of, all_n)  # each pair's history
            w = np.concatenate([_unpack48(r[4]) for r in rows])
            mixed = (w ^ (w >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93) + h_keys[of] * np.uint64(0x9E3779B97F4A7C15)
            del w
            first, inverse, totals = _sum_keys(mixed, np.concatenate([unpack(r[6], np.uint32) for r in rows]))
            del mixed
            of = of[first]  # from here on each distinct pair's history
            c_w = np.concatenate([unpack(r[5], np.uint64) for r in rows])[first].astype(np.int64)
            del first
            seen = totals > 0
            mass = np.zeros((len(h_keys), size))
            rows_of, c = of[seen], totals[seen]
            for r in range(1, LOW + 1):
                mass[:, r - 1] = np.bincount(rows_of[c == r], minlength=len(h_keys)) * r
            mass[:, LOW] = np.bincount(rows_of[c > LOW], weights=c[c > LOW], minlength=len(h_keys))
            mass[:, LOW + 1] = np.bincount(rows_of, weights=words.p(c_w[seen]), minlength=len(h_keys))
            full = mass[:, :LOW].sum(axis=1) == 0
            is_hot = hot_h[h_first]
            counts = totals[inverse].astype(np.uint32 if totals.max(initial=0) < 1 << 32 else np.uint64)
            stats, out = _counts_of_counts(totals), []
            at_pair = at_h = 0
            for i, row in enumerate(rows):
                got = counts[at_pair : at_pair + lengths[i]]
                mine = h_of[at_h : at_h + len(n[i])]
                bare = np.bincount(np.repeat(np.arange(len(mine)), n[i])[got == 0], minlength=len(mine)) > 0
                at = np.flatnonzero(bare & ~is_hot[mine])
                out.append((row[0], part, pack(got.astype(np.uint64)), pack(full[mine].astype(np.uint8)), pack(at), pack(mass[mine[at]].ravel())))
                at_pair, at_h = at_pair + lengths[i], at_h + len(n[i])
            hot_rows = [{"h": int(k), "mass": m} for k, m in zip(h_keys[is_hot].view(np.int64), mass[is_hot].tolist(), strict=True)]
            kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 4]
            arrays = [pa.array(c_, k) for c_, k in zip(zip(*out, strict=True), kinds, strict=True)]
            rest = [None] * (len(rows) - 1)
            arrays.append(pa.array([stats, *rest], pa.list_(pa.int64())))
            arrays.append(pa.array([hot_rows, *rest], pa.list_(pa.struct([("h", pa.int64()), ("mass", pa.list_(pa.float64()))]))))
            yield pa.RecordBatch.from_arrays(arrays, names=["chunk", "part", "counts", "full", "at", "mass", "stats", "hot"])

    dealt = requests.repartition("part").sortWithinPartitions("part", "chunk")
    schema = "chunk long, part long, counts binary, full binary, at binary, mass binary, stats array<long>, hot array<struct<h: long, mass: array<double>>>"
    return dealt.mapInArrow(run, schema)


def _left_over(mass: np.ndarray, d: np.ndarray, over: np.ndarray) -> np.ndarray:
    """``alpha`` of histories from their masses and denominators."""
    taken = (mass[:, :LOW] * d[1:]).sum(axis=1) + mass[:, LOW]
    return np.maximum(1 - taken / over, 0.0) / (1 - mass[:, LOW + 1])


def katz_scores(docs: DataFrame, folds: int = 7, out_fold: int = 2, chunk_tokens: int = CHUNK, parts: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row; learns from
    rows whose id's fold is not ``out_fold``."""
    spark = docs.sparkSession
    rows = chunk_rows(docs, folds, out_fold, chunk_tokens, id_col, text_col)
    with bucketed(rows, int(spark.conf.get("spark.sql.shuffle.partitions")), "chunk", "katz") as chunks:
        # as many owners as chunks: what an owner holds does not grow with the corpus
        out, total = _scored(chunks, parts or max(1, chunks.count()))
    return out.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def _scored(chunks: DataFrame, parts: int) -> tuple[DataFrame, int]:
    """The scores of the chunks' documents, as a written table, and the number of training tokens."""
    spark = chunks.sparkSession
    asked = materialize(word_answers(word_requests(chunks, parts)), "katz-words")
    total, types, *once = _sum_stats(asked, LOW + 3)
    words = Words(total, types, once)
    kind = asked.select("chunk", "part", F.lit(0).alias("kind"), "counts")
    told = materialize(pair_answers(pair_requests(chunks, kind, total, parts), words), "katz-pairs")
    d = discounts(_sum_stats(told, LOW + 1))
    hot = told.select(F.explode("hot").alias("r")).groupBy("r.h").agg(*[F.sum(F.col("r.mass")[i]).alias(f"m{i}") for i in range(LOW + 2)])
    hot_rows = hot.collect()  # at most HOT histories
    hot_mass = spark.sparkContext.broadcast({r["h"]: list(r)[1:] for r in hot_rows})

    def run(chunk_table, answer_table):
        row, pairs = _pairs_of(chunk_table, answer_table, total, parts)
        got = np.zeros(len(pairs.h), np.int64)
        over, alpha = pairs.counts.astype(float), np.ones(len(pairs.counts))
        for r in (r for r in answer_table.to_pylist() if r["kind"] == 1):
            at = pairs.order[pairs.ends[r["part"]] : pairs.ends[r["part"] + 1]]
            got[at] = unpack(r["counts"], np.uint64).astype(np.int64)
            mine = pairs.h[at[pairs.starts(at)]]
            over[mine] = pairs.counts[mine] + unpack(r["full"], np.uint8)
            bare = mine[unpack(r["at"], np.int64)]
            if len(bare):
                mass = unpack(r["mass"], np.float64).reshape(-1, LOW + 2)
                known = pairs.counts[bare] > 0
                alpha[bare[known]] = _left_over(mass[known], d, over[bare[known]])
        for h in np.unique(pairs.h[pairs.hot]).tolist():
            mass = np.array([hot_mass.value[int(pairs.hashes[h].view(np.int64))]])
            over[h] = pairs.counts[h] + (mass[0, :LOW].sum() == 0)
            alpha[h] = _left_over(mass, d, over[h : h + 1])[0]
        seen, h, w = got > 0, pairs.h, pairs.w
        p = np.empty(len(got))
        p[seen] = discounted(got[seen], d) / over[h[seen]]
        p[~seen] = alpha[h[~seen]] * words.p(pairs.counts[w[~seen]])
        doc = np.repeat(np.arange(len(pairs.sizes)), pairs.sizes)
        c = pairs.counts[pairs.words]
        base = np.log10((c + 1) / (total + types + 1))
        add = lambda x: np.bincount(doc, weights=x, minlength=len(pairs.sizes))
        return pa.table(
            {
                "id": pa.array(unpack(row["doc_ids"], np.int64), mask=unpack(row["null_ids"], np.uint8).astype(bool)),
                "held_out": pa.array(pairs.held),
                "n_tokens": pa.array(pairs.sizes),
                "n_known": pa.array(add(c > 0).astype(np.int64)),
                "base_score": pa.array(add(base)),
                "score": pa.array(add(np.log10(p)[pairs.pair.ravel()])),
            }
        )

    both = kind.unionByName(told.select("chunk", "part", F.lit(1).alias("kind"), "counts", "full", "at", "mass"), allowMissingColumns=True)
    schema = "id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    scored = chunks.groupBy("chunk").cogroup(both.groupBy("chunk")).applyInArrow(run, schema)
    return materialize(scored, "katz-scores"), total
