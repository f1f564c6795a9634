"""Benchmark decontamination by spaced-seed hashing. DataFrame functions only.

Tokens are runs of letters and digits in lower case, compared by XXH64. A seed
hashes the tokens that a fixed mask keeps and ignores the others, so a substitution
at an ignored position does not hide a match. Test and training seeds meet in a hash
join; each hit fixes an alignment of a document and a benchmark item, and the
tokens of the item around it are then compared one by one.

A document overlaps an item if, in some alignment, a window of ``WINDOW`` tokens
of the item (the whole item if shorter) has at most ``allowed`` substitutions, two
per 13 tokens. The masks are lossless for this: every window with so few
substitutions contains a seed free of them (a test tries all cases).

Items under ``MIN_TOKENS`` tokens are too short for the masks: a mask of all their tokens, one for each such
length that the benchmark holds, meets their exact runs, and only those count. ``min_tokens`` leaves
shorter items out where a phrase of few words must not condemn a document.

The benchmark's seeds are broadcast in blocks of about ``BLOCK`` rows, dealt by seed, item and position, so that a seed
shared by most items is spread as well, with one pass over the texts a block. Hits are flat rows, one an
alignment; up to ``BLOCK`` of them are broadcast, more are joined by shuffle, where a document's text meets its hits
as a stream. Only documents with hits are read again, and each alignment carries an item's length of token hashes, never a text.

Defined cases: null and empty texts overlap nothing; rows
with a null id cannot be named and are not reported; a repeated id is reported once per
item with its best row (ties by matches are one row); items with equal texts are all reported; very long texts are scanned whole;
empty tables give no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weighbridge.llm.common import materialize

#: Kept token positions; at least two masks, none contiguous.
MASKS = ((0, 1, 2, 4, 5), (0, 1, 3, 4, 6))
WINDOW = 13
MIN_TOKENS = 8
SUBSTITUTIONS = 2  # in a whole window; in items of MIN_TOKENS and more that are shorter, their share, rounded down
BLOCK = 250_000


def token_hashes(text: Column) -> Column:
    words = F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def with_seeds(rows: DataFrame, keep: list[str], masks: list[tuple[int, ...]]) -> DataFrame:
    """``keep, pos, mask, seed``: one row per token position and mask that fits there; ``rows`` has ``h``, token hashes."""
    span = 1 + max(m[-1] for m in masks)
    shifted = F.arrays_zip(*[F.slice("h", 1 + i, F.greatest(F.size("h") - i, F.lit(0))).alias(f"t{i}") for i in range(span)])
    at = rows.where(F.size("h") > min(m[-1] for m in masks)).select(*keep, F.posexplode(shifted).alias("pos", "t"))
    seeds = [F.when(F.col(f"t.t{m[-1]}").isNotNull(), F.xxhash64(F.lit(i), *[F.col(f"t.t{o}") for o in m])) for i, m in enumerate(masks)]
    return at.select(*keep, "pos", F.posexplode(F.array(*seeds)).alias("mask", "seed")).where(F.col("seed").isNotNull())


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", min_tokens: int = 1) -> DataFrame:
    """``id_col, item_col, window_matches, matched_tokens, item_tokens``: each document and item of at least ``min_tokens`` that overlap,
    with the most equal tokens in a window and in the whole item in one alignment."""
    items = benchmark.select(F.col(item_col).alias("item"), token_hashes(F.col(item_text)).alias("h"))
    items = materialize(items.where(F.col("item").isNotNull() & (F.size("h") >= max(min_tokens, 1))).distinct(), "decontam-items")
    short = sorted(r["n"] for r in items.select(F.size("h").alias("n")).where(F.col("n") < MIN_TOKENS).distinct().collect())
    masks = [*MASKS, *[tuple(range(n)) for n in short]]
    # a long item asks with the spaced masks, a short one with the mask of its length
    asks = F.when(F.col("n") >= MIN_TOKENS, F.col("mask") < len(MASKS)).otherwise(F.get(F.array(*[F.lit(m[-1] + 1) for m in masks]), "mask") == F.col("n"))
    asks = asks & ((F.col("n") >= MIN_TOKENS) | (F.col("mask") >= len(MASKS)))
    seeds = with_seeds(items.withColumn("n", F.size("h")), ["item", "n"], masks).where(asks)
    seeds = materialize(seeds.select("item", "n", F.col("pos").alias("item_pos"), "seed").distinct(), "decontam-seeds")
    blocks = max(1, math.ceil(seeds.count() / BLOCK))

    texts = docs.select(F.col(id_col).alias("id"), token_hashes(F.col(text_col)).alias("h")).where(F.col("id").isNotNull())
    hits = None
    for block in range(blocks):
        part = seeds.where(F.pmod(F.xxhash64("seed", "item", "item_pos"), F.lit(blocks)) == block)
        met = with_seeds(texts, ["id"], masks).join(F.broadcast(part), "seed")
        met = met.select("id", "item", "n", (F.col("pos") - F.col("item_pos")).alias("shift"))
        hits = met if hits is None else hits.unionByName(met)
    hits = materialize(hits.distinct(), "decontam-hits")

    ids, found = hits.select("id").distinct(), hits
    if hits.count() <= BLOCK:
        ids, found = F.broadcast(ids), F.broadcast(found)
    # the semi-join goes below the tokenizing, which is then done once per document that has hits
    again = texts.join(ids, "id", "left_semi").join(found, "id")
    seg = F.slice("h", F.greatest(F.col("shift"), F.lit(0)) + 1, F.col("n"))
    aligned = again.select("id", "item", "shift", seg.alias("seg")).join(items, "item")
    skip = F.greatest(-F.col("shift"), F.lit(0))
    same = F.transform("h", lambda x, i: F.when(F.get("seg", i - skip) == x, 1).otherwise(0))
    size = F.least(F.size("h"), F.lit(WINDOW))
    checked = aligned.select("id", "item", F.size("h").alias("n"), same.alias("same"), size.alias("w"))
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, b: a + b)
    inside = F.array_max(F.transform(F.sequence(F.lit(1), F.size("same") - F.col("w") + 1), lambda j: total(F.slice("same", j, F.col("w")))))
    checked = checked.select("id", "item", "n", "w", inside.alias("window_matches"), total(F.col("same")).alias("matched_tokens"))
    allowed = F.when(F.col("n") >= MIN_TOKENS, F.floor(F.col("w") * SUBSTITUTIONS / WINDOW)).otherwise(0)
    need = F.col("w") - allowed
    best = checked.where(F.col("window_matches") >= need).groupBy("id", "item", "n").agg(
        F.max(F.struct("window_matches", "matched_tokens")).alias("b")
    )
    return best.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "b.window_matches", "b.matched_tokens", F.col("n").alias("item_tokens"))
