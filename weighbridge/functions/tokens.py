"""Token counting: an exact byte-level BPE count (one Arrow-batched UDF)
and ``bytes4`` (``ceil(octet_length / 4)``), a native weigher with an exact SQL
equivalent, used where results must be checked against SQL.

The BPE vocabulary and split pattern are parameters. The default is the public
50k byte-level vocabulary shipped with the ``public_tokenizers`` package; a
user who has the ``o200k_base`` ranks file passes its path and pattern to get
those counts instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers as P

    return P.path("byte_bpe_50k.tiktoken"), P.PATTERN


def bpe_token_count(ranks_path: str | None = None, pattern: str | None = None):
    """An Arrow UDF ``string -> long``: exact BPE token count; empty text → 0.

    Special-token strings in the text are encoded as ordinary text, so no
    content can fail the job. The UDF is self-contained (it references no
    module of this package), so executors need only ``tiktoken``: the ranks file (a few
    MB at most, whatever the data) is read by the driver and broadcast; the encoder is built
    once per Python worker and kept in a worker-level module object across tasks.
    Texts are decoded and encoded one at a time, their ids in an array of four bytes each, so a
    worker holds an Arrow batch and one text's tokens, whatever the batch's length.
    """
    if ranks_path is None or pattern is None:
        d_path, d_pat = default_vocabulary()
        ranks_path = ranks_path or d_path
        pattern = pattern or d_pat
    with open(ranks_path, "rb") as fh:
        ranks_file = SparkSession.active().sparkContext.broadcast(fh.read())

    def bpe_tokens(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import base64 as _b64
        import sys as _sys
        import types as _types

        import pyarrow as _pa

        cache = _sys.modules.get("_weighbridge_bpe_cache")
        if cache is None:
            cache = _types.ModuleType("_weighbridge_bpe_cache")
            cache.encoders = {}
            _sys.modules["_weighbridge_bpe_cache"] = cache
        enc = cache.encoders.get((ranks_path, pattern))
        if enc is None:
            import tiktoken

            ranks = {}
            for line in ranks_file.value.splitlines():
                if line.strip():
                    tok, rank = line.split()
                    ranks[_b64.b64decode(tok)] = int(rank)
            enc = tiktoken.Encoding(
                name=f"weighbridge_{len(cache.encoders)}", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}
            )
            cache.encoders[(ranks_path, pattern)] = enc
        def count(text: str) -> int:
            return len(enc.encode_to_numpy(text, disallowed_special=()))

        for texts in batches:
            yield _pa.array((count(t.as_py()) if t.is_valid else None for t in texts), _pa.int64())

    return F.arrow_udf(bpe_tokens, "long")


def bytes4(content: Column) -> Column:
    """``ceil(octet_length / 4)``: a fast native weigher, exact in SQL, not a BPE count."""
    return F.ceil(F.octet_length(content) / 4).cast("long")


def with_tokens(
    df: DataFrame,
    content_col: str = "content",
    out_col: str = "tokens",
    weigher: str = "bpe",
    dedupe: bool = True,
    ranks_path: str | None = None,
    pattern: str | None = None,
) -> DataFrame:
    """Add a token count for ``content_col``.

    ``bpe`` with ``dedupe`` tokenizes each distinct text once: texts are keyed
    by SHA-256, reduced to one copy per key with a map-side partial aggregate
    (so a text copied a million times crosses the shuffle once per map task),
    counted by the UDF, and the counts (key, long) are joined back. The text
    column itself never rejoins the rows.
    """
    if weigher == "bytes4":
        return df.withColumn(out_col, bytes4(F.col(content_col)))
    if weigher != "bpe":
        raise ValueError(f"unknown weigher {weigher!r}")
    udf = bpe_token_count(ranks_path, pattern)
    if not dedupe:
        return df.withColumn(out_col, udf(F.col(content_col)))
    keyed = df.withColumn("_h", F.sha2(F.col(content_col), 256))
    distinct = keyed.where(F.col("_h").isNotNull()).groupBy("_h").agg(F.any_value(content_col).alias("_t"))
    counted = distinct.select("_h", udf(F.col("_t")).alias(out_col))
    return keyed.join(counted, "_h", "left").drop("_h")
