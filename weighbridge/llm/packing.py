"""Sequence packing as vector bin packing under limits on tokens, segments and loss-bearing tokens.

Each task packs the documents of its own partition as it tokenizes them, so no
token crosses the network. Pieces wait in a bounded pool. A sequence is filled
by the dot-product heuristic: of the pieces that fit in every dimension, the one
whose demand vector (tokens, one segment, loss-bearing tokens, each over its limit) has
the largest product with what is left of the sequence, each dimension weighted by the
pool's mean demand. When no piece fits whole, the heaviest is cut to the gap.
A sequence that a limit other than tokens closes early, and a partition's last
tokens, end at a power of two, where no padding is due; what is over goes back to the pool.

Tokenizing: the ids are those of the tokenizer file. Plain texts (:data:`PLAIN`) may be encoded
by a second library from the same vocabulary, which tests hold to be equal; all others are
encoded by the tokenizer's own. The string of an added token (``<|endoftext|>``) in a text is ordinary text,
or with ``as_loaded`` that token's id, as the file has it when loaded.

Defined cases: null and empty texts are the end id alone; a null id is packed like any
other; repeated rows are packed as often as they occur; with ``loss_from`` (a column of
token offsets) ids before it bear no loss, null counts as 0; a very long text is cut into pieces of a sequence's
length at most, whole; of pieces that fit equally well the first in the pool goes; an empty table gives no rows. Other columns are
ignored, whatever their names.
``sequence_id`` is the partition number times 2^33 plus a counter: a repeated task repeats it.
"""

from __future__ import annotations

import re
import sys
import types
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts of common letters and signs whose Unicode classes have long been settled, with no
#: run of over 4,096 characters without a blank.
_SIGNS = "!-~\u00a1-\u024f\u0400-\u0481\u048a-\u04ff\u2010-\u2027\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5"
PLAIN = re.compile(f"(?:[{_SIGNS}]{{0,4096}}+[ \n]++)*+[{_SIGNS}]{{0,4096}}+")
POOL_PIECES = 1024
POOL_TOKENS = 4 << 20


def default_tokenizer() -> tuple[str, str]:
    """The tokenizer file and the same vocabulary as ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


class Encoder:
    """Ids of texts as the tokenizer file at ``path`` has them, as little-endian unsigned 32-bit.

    ``ranks`` (optional) names the same vocabulary as ranks with the tokenizer's split ``pattern``: a second
    library then encodes plain texts several times faster, with the same ids. ``as_loaded``: strings of added
    tokens in a text are those tokens, not ordinary text."""

    def __init__(self, path: str, ranks: str | None, pattern: str | None, as_loaded: bool = False):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.exact, self.quick = Tokenizer.from_file(path), None
        self.exact.encode_special_tokens = not as_loaded
        self.added = [t.content for t in self.exact.get_added_tokens_decoder().values()] if as_loaded else []
        if ranks:
            import base64

            import tiktoken

            with open(ranks, "rb") as lines:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.quick = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    @classmethod
    def of_worker(cls, *args) -> Encoder:
        """One encoder for all tasks of a Python worker."""
        shared = sys.modules.setdefault("_packing_encoders", types.ModuleType("_packing_encoders")).__dict__
        key = "|".join(map(str, args))
        if key not in shared:
            shared[key] = cls(*args)
        return shared[key]

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, "<u4")
        if self.quick and not any(t in text for t in self.added) and PLAIN.fullmatch(text):
            return self.quick.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)
        return np.array(self.exact.encode(text, add_special_tokens=False).ids, "<u4")


class Packer:
    """Fills sequences from a pool of pieces ``(doc, start, ids, loss_from, doc_tokens)``."""

    def __init__(self, max_tokens: int, max_segments: int, max_loss: int):
        self.limits = np.array([max_tokens, max_segments, max_loss], float)
        self.pieces: list[tuple] = []
        self.need = np.zeros((0, 3))  # demand of each piece
        self.tokens = 0

    @staticmethod
    def _demand(piece) -> tuple[int, int, int]:
        doc, start, ids, loss_from, total = piece
        return len(ids), 1, max(0, start + len(ids) - max(start, loss_from))

    def add(self, pieces: list[tuple]) -> None:
        self.pieces += pieces
        self.need = np.concatenate([self.need, np.array([self._demand(p) for p in pieces], float).reshape(-1, 3)])
        self.tokens += sum(len(p[2]) for p in pieces)

    def _take(self, i: int, length: int | None = None) -> tuple:
        """Piece ``i``, or its first ``length`` ids (the rest stays)."""
        doc, start, ids, loss_from, total = self.pieces[i]
        if length is None or length == len(ids):
            last = len(self.pieces) - 1
            self.pieces[i], self.need[i] = self.pieces[last], self.need[last]
            self.pieces.pop()
            self.need = self.need[:last]
            length = len(ids)
        else:
            self.pieces[i] = (doc, start + length, ids[length:], loss_from, total)
            self.need[i] = self._demand(self.pieces[i])
        self.tokens -= length
        return (doc, start, ids[:length], loss_from, total)

    def _cut(self, piece, room: np.ndarray) -> int:
        """Ids of a piece's front that fit in ``room``."""
        doc, start, ids, loss_from, total = piece
        free = max(0, min(len(ids), loss_from - start))  # ids without loss
        return int(min(len(ids), room[0], free + room[2]))

    def fill(self, capacity: int) -> list[tuple]:
        """One sequence of at most ``capacity`` tokens, closed at it or at a power of two."""
        room = self.limits.copy()
        room[0] = capacity
        out: list[tuple] = []
        weight = (self.need.mean(axis=0) / self.limits) / self.limits
        while room[0] > 0 and room[1] > 0 and self.pieces:
            fits = (self.need <= room).all(axis=1)
            gain = (self.need * (weight * room / self.limits)).sum(axis=1)
            if fits.any():
                piece = self._take(int(np.where(fits, gain, -1.0).argmax()))
            else:
                i = int(gain.argmax())
                length = self._cut(self.pieces[i], room)
                if length == 0:  # no room for loss: a piece that opens without it, if any
                    i = next((j for j, p in enumerate(self.pieces) if self._cut(p, room)), None)
                    if i is None:
                        break
                    length = self._cut(self.pieces[i], room)
                piece = self._take(i, length)
            out.append(piece)
            room -= self._demand(piece)
        if not out:
            raise ValueError("the limits leave no room for a single token")
        used = capacity - int(room[0])
        over = 0 if used == int(self.limits[0]) else used - (1 << (used.bit_length() - 1))
        back = []
        while over:
            doc, start, ids, loss_from, total = out.pop()
            keep = max(0, len(ids) - over)
            back.append((doc, start + keep, ids[keep:], loss_from, total))
            if keep:
                out.append((doc, start, ids[:keep], loss_from, total))
            over -= len(ids) - keep
        if back:
            self.add(back)
        return out

    def sequences(self, low: int = 0):
        """Fills sequences while the pool holds more than ``low`` pieces or too many tokens; with 0, empties it."""
        full = int(self.limits[0])
        while self.pieces and (low == 0 or len(self.pieces) > low or self.tokens > POOL_TOKENS):
            yield self.fill(full if self.tokens >= full else 1 << (self.tokens.bit_length() - 1))


def pack_documents(
    docs: DataFrame,
    tokenizer: tuple[str, str | None] | None = None,
    max_tokens: int = 2048,
    max_segments: int = 512,
    max_loss: int | None = None,
    end_id: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
    loss_from: str | None = None,
    as_loaded: bool = False,
) -> DataFrame:
    """``tokenizer``: the tokenizer file, and the same vocabulary as ranks or None. ``as_loaded``: added tokens'
    strings in a text get those tokens' ids.

    Returns ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens``, one row per piece."""
    (path, ranks), max_loss = tokenizer or default_tokenizer(), max_loss or max_tokens
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens"]

    def run(batches):
        from pyspark import TaskContext

        import public_tokenizers

        encoder, packer = Encoder.of_worker(path, ranks, ranks and public_tokenizers.PATTERN, as_loaded), Packer(max_tokens, max_segments, max_loss)
        sequence = TaskContext.get().partitionId() << 33
        end = np.array([end_id], "<u4")

        def rows(sequences):
            nonlocal sequence
            out = []
            for pieces in sequences:
                offset = 0
                for doc, start, ids, free, total in pieces:
                    out.append((doc, start, len(ids), zlib.crc32(ids), total, sequence, offset, max(0, start + len(ids) - max(start, free))))
                    offset += len(ids)
                sequence += 1
            columns = list(zip(*out, strict=True)) or [[]] * 8
            types_ = [doc_type, *[pa.int64()] * 7]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types_, strict=True)], names=names)

        doc_type = None
        for whole in batches:
            doc_type = whole.schema.types[0]
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                for doc, text, f in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    ids = np.concatenate([encoder.encode(text), end])
                    packer.add([(doc, s, ids[s : s + max_tokens], f, len(ids)) for s in range(0, len(ids), max_tokens)])
                yield rows(packer.sequences(POOL_PIECES))
        if doc_type is not None:
            yield rows(packer.sequences())

    free = F.coalesce(F.col(loss_from).cast("long"), F.lit(0)) if loss_from else F.lit(0).cast("long")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), free.alias("free"))
    return rows.mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long")
