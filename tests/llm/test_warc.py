"""Seekable archives: round trips, revisits, damaged and abandoned bundles."""

import base64
import glob
import hashlib
import io
import os
import struct

import pytest
import zstandard
from pyspark.sql import functions as F

from arbiterlake.llm import warc

SCHEMA = "page_id long, url string, html string"
PAGES = [
    (5, "http://a/5", "<p>one</p>"), (3, "http://a/3", "<p>one</p>"), (9, None, "<p>one</p>"), (7, "http://a/7", None), (8, "http://a/8", ""), (None, "http://a/n", "<p>one</p>"),
    (1, "http://a/1?x=%20\r\nX: y", "é漢🙂\r\n\r\nWARC/1.1\r\n" * 50), (2, "u", "x" * 300_000), (4, "u", "x" * 300_000), (6, "v", "twice"), (6, "v", "twice"), (6, "v", "twice"), (10, "v", "twice"),
    (11, "b", "other url"), (11, "a", "other url"), (None, None, "alone"), (None, None, "alone"),
]


def want(pages, min_bytes=0):
    order = lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or "")
    out, first = [], {}
    for doc, url, html in sorted(pages, key=order):
        raw = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        new = len(raw) < min_bytes or digest not in first
        out.append((doc, len(raw), digest, "response" if new else "revisit", None if new else first[digest]))
        first.setdefault(digest, doc)
    return sorted(out, key=str)


def shown(records):
    return sorted(((None if r.id is None else int(r.id), r.payload_bytes, r.payload_digest, r.record_type, None if r.refers_to is None else int(r.refers_to)) for r in records), key=str)


@pytest.mark.parametrize("min_bytes, frame_bytes, bundle_bytes", [(0, 1 << 20, 1 << 28), (6, 100, 300), (0, 1, 1)])
def test_round_trip(spark, tmp_path, min_bytes, frame_bytes, bundle_bytes):
    path = f"file://{tmp_path}/w"
    df = spark.createDataFrame(PAGES, SCHEMA).withColumn("digest", F.lit("clash")).withColumn("size", F.lit(1)).repartition(3)
    index = warc.write_bundles(df, path, min_bytes=min_bytes, frame_bytes=frame_bytes, bundle_bytes=bundle_bytes)
    read = warc.read_bundles(spark, path, split_frames=2).collect()
    assert shown(read) == want(PAGES, min_bytes) and index.count() == len(PAGES)
    by_name = {r.record_id: r for r in read}
    assert len(by_name) == len(PAGES)
    for r in read:
        if r.record_type == "revisit":
            full = by_name[r.refers_to_record]
            assert full.record_type == "response" and full.payload_digest == r.payload_digest and full.id == r.refers_to and r.payload is None
        else:
            assert (None if r.id is None else int(r.id), bytes(r.payload).decode()) in {(i, h or "") for i, _, h in PAGES}
    places = {(r.record_id, r.bundle, r.frame, r.offset) for r in read}
    assert places == {(r.record_id, r.bundle, r.frame, r.offset) for r in index.collect()}
    assert {r.url for r in read if r.id == "1"} == {"http://a/1?x=%20%0D%0AX: y"}
    some = [r for r in read if r.record_type == "response"][:4]
    names = spark.createDataFrame([(r.record_id,) for r in [*some, some[0]]] + [("none",), (None,)], "record_id string")
    assert sorted(warc.fetch_records(spark, path, names).collect()) == sorted(some)


def test_files_follow_the_formats(spark, tmp_path):
    warc.write_bundles(spark.createDataFrame(PAGES, SCHEMA).coalesce(1), f"file://{tmp_path}/w", frame_bytes=200)
    (name,) = glob.glob(f"{tmp_path}/w/bundles/*")
    with open(name, "rb") as f:
        raw = f.read()
    frames = warc.read_table(type("File", (io.BytesIO,), {"size": lambda self: len(raw)})(raw))
    whole = b"".join(zstandard.ZstdDecompressor().decompress(raw[at : at + packed]) for at, packed, _ in frames)  # each frame by itself
    assert [size for _, _, size in frames] == [len(zstandard.ZstdDecompressor().decompress(raw[at : at + packed])) for at, packed, _ in frames]
    end = frames[-1][0] + frames[-1][1]
    assert struct.unpack_from("<II", raw, end) == (0x184D2A5E, len(raw) - end - 8) and struct.unpack("<I", raw[-4:]) == (0x8F92EAB1,)
    assert zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read() == whole  # as one stream too
    at, kinds = 0, []
    while at < len(whole):
        headers, _, at = warc.parse(whole, at)
        kinds.append(headers["warc-type"])
    assert kinds[0] == "warcinfo" and len(kinds) == len(PAGES) + 1


def test_abandoned_bundles_go_and_damage_is_found(spark, tmp_path):
    os.makedirs(f"{tmp_path}/w/bundles")
    with open(f"{tmp_path}/w/bundles/left.warc.zst", "wb") as f:
        f.write(b"half a bundle")
    df = spark.createDataFrame(PAGES, SCHEMA)
    warc.write_bundles(df, f"file://{tmp_path}/w")
    assert not os.path.exists(f"{tmp_path}/w/bundles/left.warc.zst")
    digest = warc.base32_sha1(b"abc")
    raw = warc.record_of("response", "x", "d", [("WARC-Payload-Digest", f"sha1:{digest}")], b"HTTP/1.1 200 OK\r\nContent-Length: 3\r\n\r\nabd")
    with pytest.raises(ValueError, match="damaged"):
        warc._read(raw, 0, "b", 0, True)


def test_empty_and_other_names(spark, tmp_path):
    index = warc.write_bundles(spark.createDataFrame([], SCHEMA), f"file://{tmp_path}/e")
    assert index.count() == 0 and warc.read_bundles(spark, f"file://{tmp_path}/e").count() == 0
    df = spark.createDataFrame([("x", "u", b"\xff\x00"), ("y", "u", b"\xff\x00")], "digest string, size string, payload binary")
    warc.write_bundles(df, f"file://{tmp_path}/n", id_col="digest", url_col="size", payload_col="payload")
    assert sorted((r.id, r.record_type, r.refers_to, r.payload and bytes(r.payload)) for r in warc.read_bundles(spark, f"file://{tmp_path}/n").collect()) == [("x", "response", None, b"\xff\x00"), ("y", "revisit", "x", None)]
