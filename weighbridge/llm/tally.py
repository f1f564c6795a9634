"""Totals of sketch cells or packed keys over all chunks of a corpus, answered to each chunk in the order it asked.

A chunk (some MB of text held by one task) sends its distinct keys with their counts, cut by
key owner; an owner sums what all chunks sent and hands each chunk its totals back. What is shuffled
grows with the distinct keys of chunks, a few bytes each, so a key that a third of all rows hold is one
entry per chunk. Keys are hashes: owners, as many as the keys need at ``OWNER_KEYS`` each, get even shares.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weighbridge.llm.katz import _by_part, _sum_keys, owner, pack, pack_sorted, unpack, unpack_sorted

OWNER_KEYS = 2 << 20  # asked keys that one owner holds


def owners(asked_keys: int) -> int:
    """Number of owners for so many asked keys in all."""
    return max(1, math.ceil(asked_keys / OWNER_KEYS))


def ask(chunks: DataFrame, parts: int) -> DataFrame:
    """``part, chunk, keys, counts`` of ``chunks`` (``chunk``, sorted distinct ``keys`` and their ``counts``, packed)."""

    def run(batches):
        for batch in batches:
            for chunk, keys, counts in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                keys, counts = unpack_sorted(keys), unpack(counts, np.uint32)
                ends = np.searchsorted(owner(keys, parts), np.arange(parts + 1))
                for p in np.flatnonzero(np.diff(ends)).tolist():
                    a, b = ends[p], ends[p + 1]
                    yield pa.RecordBatch.from_pydict({"part": [p], "chunk": [chunk], "keys": [pack_sorted(keys[a:b])], "counts": [pack(counts[a:b])]})

    return chunks.select("chunk", "keys", "counts").mapInArrow(run, "part long, chunk long, keys binary, counts binary")


def answer(asked: DataFrame, reply: Callable[[np.ndarray], bytes], summary: Callable | None = None, kind: str = "binary") -> DataFrame:
    """``chunk, part, reply, summary``: ``reply`` of the totals in the order asked; one row per owner has the
    ``summary`` (of Arrow type ``kind``) of its distinct keys and totals."""

    def run(batches):
        for part, rows in _by_part(batches):
            keys = [unpack_sorted(r[1]) for r in rows]
            flat = np.concatenate(keys)
            first, inverse, totals = _sum_keys(flat, np.concatenate([unpack(r[2], np.uint32) for r in rows]))
            told = np.split(totals[inverse], np.cumsum([len(k) for k in keys])[:-1])
            of_owner = summary(flat[first], totals) if summary else None
            rest = [None] * (len(rows) - 1)
            yield pa.RecordBatch.from_pydict(
                {
                    "chunk": pa.array([r[0] for r in rows], pa.int64()),
                    "part": pa.array([part] * len(rows), pa.int64()),
                    "reply": pa.array([reply(t) for t in told], pa.binary()),
                    "summary": pa.array([of_owner, *rest], pa.list_(pa.int64()) if kind != "binary" else pa.binary()),
                }
            )

    dealt = asked.repartition("part").sortWithinPartitions("part", "chunk")
    return dealt.mapInArrow(run, f"chunk long, part long, reply binary, summary {kind}")


def count_asked(chunks: DataFrame) -> int:
    return chunks.agg(F.coalesce(F.sum("n_keys"), F.lit(0))).first()[0]
