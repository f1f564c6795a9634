"""WARC bundles: exact round trip, seek tables, random access."""

import base64
import hashlib

import zstandard

from weighbridge.llm import warc

PAGES = [
    (3, "http://a/\r\nx", "same"), (1, "http://b/", "same"), (2, None, "same"), (4, "http://c/é", "ünïcode \r\n\r\n WARC/1.1"),
    (5, "u", None), (6, "u", ""), (7, "u", "long " * 300_000), (8, "u", "other"), (8, "u", "other"), (None, "n", "same"), (None, None, "alone"),
]


def pages(spark, rows=PAGES):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, payload string, refers_to int")
    return df.repartition(3)


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def test_round_trip_and_roles(spark, tmp_path):
    path = str(tmp_path / "out")
    got = warc.archive_pages(pages(spark), frame_bytes=64, bundle_bytes=200, path=path).collect()
    assert len(got) == len(PAGES)
    kinds = sorted((r["page_id"] or 0, r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"] or 0) for r in got)
    want = []
    first = {"same": 1, "": 5, "other": 8}
    for n, (i, _, html) in enumerate(PAGES):
        target = first.get(html or "") if i is not None else None
        revisit = target is not None and (i != target or n == 8)
        want.append((i or 0, len((html or "").encode()), digest(html), "revisit" if revisit else "response", target if revisit else 0))
    assert kinds == sorted(want)
    for file in tmp_path.joinpath("out").glob("part-*"):
        data = file.read_bytes()
        frames = warc.read_seek_table(data)
        plain = b"".join(zstandard.ZstdDecompressor().decompress(data[s : s + n], max_output_size=p) for s, n, p in frames)
        assert plain.startswith(b"WARC/1.1\r\n") and len(data) == sum(n for _, n, _ in frames) + 8 + 8 * len(frames) + 9
    index = warc.read_bundles(spark, path)
    wanted = spark.createDataFrame([(4,), (7,)], "page_id long")
    read = {r["page_id"]: bytes(r["payload"]).decode() for r in warc.read_records(spark, path, index, wanted).collect()}
    assert read == {4: PAGES[3][2], 7: PAGES[6][2]}


def test_minimum_size_and_empty_table(spark, tmp_path):
    got = warc.archive_pages(pages(spark), min_bytes=5, path=str(tmp_path / "a")).collect()
    assert sorted(r["page_id"] or 0 for r in got if r["record_type"] == "revisit") == [8]
    assert warc.archive_pages(pages(spark, []), path=str(tmp_path / "b")).collect() == []
