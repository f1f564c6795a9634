"""SimHash near-duplicates, exact within a Hamming distance, by a vantage-point tree.

A document's words are its text's runs of non-blank characters after A-Z is
lower-cased; its features are the space-joined shingles of ``shingle`` words
with repeats (a shorter text is one shingle; a text without words has the
fingerprint zero and links like any other). A fingerprint bit is set when over
half of the shingles' XXH64 values (seed 42) have it.

Equal fingerprints are one class, so copies cost nothing more. A vantage-point
tree built on a bounded, seeded sample of the fingerprints splits the space:
each node is a vantage point with a radius, whatever lies inside the ball
belongs to the node's shard, whatever lies outside goes on to the next node.
With ``d`` the largest distance that links, a fingerprint at distance
``radius < x <= radius + d`` from a vantage point is also sent to that shard as
a query (the ball's boundary overlaps its surroundings); beyond that the
triangle inequality rules the shard out. Every pair within ``d`` therefore meets in
the home shard of the one that left the tree first. Every fingerprint is
indexed; the sample decides only where the balls lie, so the result is exact.
A shard's home rows are cut into blocks of bounded size and queries are
streamed past them, so a dense ball needs no large task.

Defined cases: null and empty texts have the fingerprint zero. A null id is
returned with its fingerprint and a null ``component_id`` and links to nothing.
Repeated rows are returned as often as they occur; ties need no rule, a group being named by its smallest id; very long
texts are hashed whole; an empty table gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weighbridge.llm.common import components, lookup, materialize, roots

LEAF = 8  # sample fingerprints inside a vantage point's ball
MAX_SAMPLE = 65_536
BLOCK = 4096  # home rows of a shard that one task holds
NODES, BATCH = 64, 8192  # vantage points, and fingerprints, compared at a time (some MB of distances)


def text_fingerprint(text: bytes | None, shingle: int) -> int:
    """Unsigned 64-bit SimHash of one UTF-8 text."""
    import xxhash

    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    if len(words) > shingle:
        starts, ends = starts[: len(words) - shingle + 1], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    values = np.array([digest(joined[a:b], 42) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], dtype="<u8")
    counts = np.zeros(64, np.int64)
    for at in range(0, len(values), 32_768):
        part = values[at : at + 32_768]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(values), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, fp``: one row per input row; ``fp`` is the fingerprint as a signed long."""

    def run(batches):
        for batch in batches:
            fps = np.array([text_fingerprint(t, shingle) for t in batch.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, "id long, fp long")


def build_tree(sample: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vantage points and radii, in the order a fingerprint passes them."""
    rest, points, radii = sample, [], []
    while rest.size:
        d = np.bitwise_count(rest ^ rest[0])
        radius = int(np.partition(d, min(LEAF, rest.size) - 1)[min(LEAF, rest.size) - 1])
        points.append(rest[0])
        radii.append(radius)
        rest = rest[d > radius]
    return np.array(points, np.uint64), np.array(radii, np.int16)


def descend(fps: np.ndarray, points: np.ndarray, radii: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Passes fingerprints down the tree as one batch: the home shard of each (``len(points)``: outside every ball), and the
    boundary shards passed on the way, as ``row, shard``.

    A fingerprint leaves the batch in the ball that takes it, and no node below is compared with it; a ball
    whose radius it exceeds by more than ``max_bits`` is dropped by the triangle bound."""
    home = np.full(len(fps), len(points), np.int64)
    rows, shards, left = [np.empty(0, np.int64)], [np.empty(0, np.int64)], np.arange(len(fps))
    for at in range(0, len(points), NODES):
        if not len(left):
            break
        over = np.bitwise_count(fps[left, None] ^ points[None, at : at + NODES]).astype(np.int16) - radii[at : at + NODES]
        inside = over <= 0
        first = np.where(inside.any(axis=1), inside.argmax(axis=1), over.shape[1])
        row, shard = np.nonzero((over <= max_bits) & (np.arange(over.shape[1]) < first[:, None]))
        rows.append(left[row])
        shards.append(at + shard)
        taken = first < over.shape[1]
        home[left[taken]] = at + first[taken]
        left = left[~taken]
    return home, np.concatenate(rows), np.concatenate(shards)


def near_pairs(classes: DataFrame, max_bits: int) -> DataFrame:
    """``a, b``: links that connect the same classes as all pairs of ``classes``
    (``fp, rep``, distinct) at ``max_bits`` or fewer differing bits."""
    spark = classes.sparkSession
    n = classes.count()
    if n == 0:
        return spark.createDataFrame([], "a long, b long")
    size = min(MAX_SAMPLE, math.ceil(16 * math.sqrt(n)))
    picked = classes.where(F.pmod(F.xxhash64("fp", F.lit(7)), F.lit(max(n, 1))) < size).select("fp").limit(2 * MAX_SAMPLE)
    sample = np.array(sorted(r["fp"] for r in picked.collect()), np.int64).view(np.uint64)
    points, radii = build_tree(np.random.default_rng(7).permutation(sample))
    tree = spark.sparkContext.broadcast((points, radii))

    def place(batches):
        points, radii = tree.value
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            counts = np.zeros(len(points) + 1, np.int64)
            for at in range(0, len(fps), BATCH):
                counts += np.bincount(descend(fps[at : at + BATCH], points, radii, 0)[0], minlength=len(points) + 1)
            used = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], names=["shard", "n"])

    # one row per ball, a number bounded by the sample
    held = classes.select("fp").mapInArrow(place, "shard long, n long").groupBy("shard").agg(F.sum("n").alias("n")).collect()
    parts = np.ones(len(points) + 1, np.int64)
    for r in held:
        parts[r["shard"]] = max(1, math.ceil(r["n"] / BLOCK))
    blocks = spark.sparkContext.broadcast(parts)

    def send(batches):
        points, radii = tree.value
        parts = blocks.value
        for batch in batches:
            all_fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            all_reps = batch.column(1).to_numpy(zero_copy_only=False)
            for at in range(0, len(all_fps), BATCH):
                fps, reps = all_fps[at : at + BATCH], all_reps[at : at + BATCH]
                home, row, shard = descend(fps, points, radii, max_bits)
                own = ((fps * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % parts[home]
                # queries: boundary shards passed before home, and the later blocks of a home cut in several
                wide = np.flatnonzero(parts[home] > 1)
                row, shard = np.concatenate([row, wide]), np.concatenate([shard, home[wide]])
                times = parts[shard]
                ends = np.cumsum(times)
                block = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - times, times)
                row, shard = np.repeat(row, times), np.repeat(shard, times)
                keep = (shard != home[row]) | (block > own[row])
                row, shard, block = row[keep], shard[keep], block[keep]
                row = np.concatenate([np.arange(len(fps)), row])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([home, shard]).astype(np.int32)),
                        pa.array(np.concatenate([own, block]).astype(np.int32)),
                        pa.array(np.arange(len(row)) >= len(fps)),
                        pa.array(fps[row].view(np.int64)),
                        pa.array(reps[row]),
                    ],
                    names=["shard", "block", "query", "fp", "rep"],
                )

    def match(batches):
        key, fps, reps = None, None, None
        for batch in batches:
            shard, block, query, fp, rep = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            fp = fp.view(np.uint64)
            new = np.flatnonzero((np.diff(shard) != 0) | (np.diff(block) != 0)) + 1
            for lo, hi in zip([0, *new.tolist()], [*new.tolist(), len(shard)], strict=True):
                if lo == hi:
                    continue
                if key != (shard[lo], block[lo]):
                    key, fps, reps = (shard[lo], block[lo]), np.empty(0, np.uint64), np.empty(0, np.int64)
                first = lo + int(np.searchsorted(query[lo:hi], True))
                held = len(fps)
                fps, reps = np.concatenate([fps, fp[lo:first]]), np.concatenate([reps, rep[lo:first]])
                # new home rows against all home rows so far, then queries against all home rows
                for a, b, at in ((lo, first, held), (first, hi, None)):
                    for s in range(a, b, 512):
                        e = min(s + 512, b)
                        x, y = np.nonzero(np.bitwise_count(fp[s:e, None] ^ fps[None, :]) <= max_bits)
                        if at is not None:  # home rows meet themselves and each other once
                            once = y < x + (s - lo) + at
                            x, y = x[once], y[once]
                        if len(x):
                            nodes, flat = np.unique(np.concatenate([rep[s:e][x], reps[y]]), return_inverse=True)
                            root = roots(len(nodes), flat[: len(x)], flat[len(x) :])
                            child = np.flatnonzero(root != np.arange(len(nodes)))
                            yield pa.RecordBatch.from_arrays([pa.array(nodes[child]), pa.array(nodes[root[child]])], names=["a", "b"])

    sent = classes.select("fp", "rep").mapInArrow(send, "shard int, block int, query boolean, fp long, rep long")
    dealt = sent.repartition("shard", "block").sortWithinPartitions("shard", "block", "query")
    return dealt.mapInArrow(match, "a long, b long")


def simhash_groups(docs: DataFrame, shingle: int = 4, max_bits: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, fingerprint, component_id``: the hex fingerprint of each row and the
    smallest id of the rows reachable by links."""
    fps = materialize(fingerprints(docs, shingle, id_col, text_col), "simhash-fp")
    known = fps.where(F.col("id").isNotNull())
    classes = materialize(known.groupBy("fp").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("size")), "simhash-class")
    stars = components(near_pairs(classes, max_bits), "simhash")
    named = classes.join(stars.select(F.col("hi").alias("rep"), "lo"), "rep", "left").select(
        "fp", "size", F.coalesce("lo", "rep").alias("component_id")
    )
    total = classes.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first()["n"]
    out = lookup(fps, named, ["fp"], ["component_id"], "size", total, "id")
    return out.select(
        F.col("id").alias(id_col),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"),
    )
