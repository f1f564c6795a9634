"""Prefix trie against a plain version that holds every rebuilt conversation as a tuple."""

import hashlib
import random
import zlib
from collections import defaultdict

import pyarrow as pa
import pytest

from weighbridge.llm import prefix_trie
from weighbridge.llm.prefix_trie import FORWARD, SpillingQueue, conversation_trie, time_forward


def digest(role, text):
    h = hashlib.blake2b(b"%d:%s%s" % (len(role), role, text), digest_size=16).digest()
    return int.from_bytes(h[:8], "little", signed=True), int.from_bytes(h[8:], "little", signed=True)


def brute(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append((turn is not None, turn or 0, *digest(role.encode(), text.encode()), role, text))
    turns = {c: [x[4:] for x in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c in turns:
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = tuple(turns.get(base, [])[:h]) + tuple(turns[c][h:])
    members, kids = defaultdict(set), defaultdict(set)
    for c, seq in rebuilt.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].add(c)
            if d:
                kids[seq[: d - 1]].add(seq[:d])
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        words = len(node[-1][1].encode().split()) if node else 0
        leaves[node] = sum(leaves[k] for k in kids[node]) if kids[node] else 1
        saved[node] = (len(members[node]) - 1) * words + sum(saved[k] for k in kids[node])
    out = []
    for node, ids in members.items():
        ends = ",".join(str(c) for c in sorted(ids) if rebuilt[c] == node)
        parent = min(members[node[:-1]]) if node else None
        out.append((min(ids), len(node), parent, len(ids), len(kids[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def conversations(n=120, seed=1):
    rnd = random.Random(seed)
    common = [("system", "you are a helpful assistant"), ("user", "hello there"), ("assistant", "hi\x0b how are you")]
    rows = []
    for c in range(-25, n):
        if rnd.random() < 0.2:
            continue
        turns = common[: rnd.choice([0, 0, 1, 2, 3, 3])] + [(rnd.choice(["user", None, ""]), rnd.choice(["a b", "a  b", "", None, "c d e", f"u {c}"])) for _ in range(rnd.choice([0, 1, 1, 2, 5]))]
        numbers = rnd.choice([list(range(len(turns))), [None, *range(1, len(turns))], [5] * len(turns)])
        rows += [(c, t, *turn) for t, turn in zip(numbers, turns, strict=False)]
    copies = [(c, i, "user", f"same {i}") for c in range(400, 460) for i in range(5)]
    long = [(777, i, "user", f"turn {i % 7}") for i in range(300)] + [(778, i, "user", f"turn {i % 7}") for i in range(290)]
    odd = [(None, 1, "user", "no id"), (900, 1, "user", "twice"), (900, 1, "user", "twice"), (901, 0, "user", "w " * 30_000)]
    return [*rows, *copies, *long, *odd]


def frame(spark, rows, parts=3):
    df = spark.createDataFrame([(*r, 3, "k") for r in rows], "conv_id long, turn long, role string, text string, pos int, k1 string")
    return df.repartition(parts)


def same(got, rows):
    assert sorted(map(tuple, got), key=str) == sorted(brute(rows), key=str)


@pytest.mark.parametrize("shard,slice_", [(16, 1 << 16), (0.3, 50), (0, 7)])
def test_same_as_plain_version(spark, monkeypatch, shard, slice_):
    monkeypatch.setattr(prefix_trie, "SHARD", shard)
    monkeypatch.setattr(prefix_trie, "SLICE", slice_)
    monkeypatch.setattr(prefix_trie, "ENDS", 16)
    rows = conversations()
    same(conversation_trie(frame(spark, rows)).collect(), rows)


def test_empty_table_and_single_rows(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversation_trie(none).collect() == []
    assert conversation_trie(spark.createDataFrame([(None, 1, "a", "b")], none.schema)).collect() == []
    for rows in ([(21, None, None, None)], [(c, 0, "u", "x") for c in range(1, 6)]):  # conversations left without turns
        same(conversation_trie(spark.createDataFrame(rows, none.schema)).collect(), rows)


def test_queue_spills_and_keeps_every_message():
    rnd = random.Random(4)
    queue, sent = SpillingQueue(limit=50), defaultdict(lambda: [0, 0])
    for level in range(9, -1, -1):
        for name in range(40):
            assert queue.take(level, name) == tuple(sent.pop((level, name), (0, 0)))
            for _ in range(rnd.randrange(12) if level else 0):
                to, leaves, saved = rnd.randrange(40), rnd.randrange(5), rnd.randrange(1 << 40)
                queue.push((1 - level, to, leaves, saved))
                sent[level - 1, to][0] += leaves
                sent[level - 1, to][1] += saved
    assert not sent and len(queue.runs) > 10 and not queue.heap and not queue.heads


def test_time_forward_in_several_batches(monkeypatch):
    monkeypatch.setattr(prefix_trie, "QUEUE", 3)
    rows = [(3, i, 2, i // 2, 1, 10) for i in range(8)] + [(2, i, 1, 0, 0, 1) for i in range(4)] + [(1, 0, None, None, 0, 0)]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[a : a + 3], strict=True)], names=FORWARD) for a in range(0, len(rows), 3)]
    out = [r for b in time_forward(iter(batches)) for r in b.to_pylist()]
    assert [r["saved"] for r in out[8:]] == [21, 21, 21, 21, 84] and out[-1]["leaves"] == 8
