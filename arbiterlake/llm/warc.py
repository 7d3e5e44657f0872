"""Web archives as bundles of independent Zstandard frames that can be entered anywhere.

Tasks write records into frames of about ``frame_bytes`` and frames into bundles; a bundle ends with a
skippable frame that lists every frame's packed and unpacked size, so a reader takes the table from the end of
the file and unpacks the frames it wants. An index maps each record to its bundle, its frame and its place in
the unpacked frame. Records of equal payloads are written once: one is the response, the others are revisits
that name it. Which one that is comes from a small table of digests that occur twice or more; payloads pass
through one join with it and go straight into the bundles.

Bundles have names that no other attempt of a task uses, and the index, which Spark commits with the tasks,
names those that count: what a lost executor leaves behind is deleted and never read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from datetime import datetime, timezone
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_batches, hold, materialize, shuffle_partitions

#: Fixed values of the seekable format: a skippable frame, and the mark at the end of its table.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
#: Rows of one Arrow batch, and unpacked bytes after which a reader hands on what it has.
ROWS, HELD = 256, 16 << 20

INDEX = "record_id string, id string, record_type string, bundle string, frame int, offset long, length long"
RECORD = "record_id string, id string, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to_record string, refers_to string, bundle string, frame int, offset long"


def filesystem(path: str):
    """The Arrow file system of ``path`` and the path within it; executors reach the same one."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


class BundleWriter:
    """One bundle: records gather in a frame, frames in the file, the table of frames at its end."""

    def __init__(self, where, path: str, frame_bytes: int):
        import zstandard

        self.out, self.frame_bytes = where.open_output_stream(path, compression=None), frame_bytes
        self.packer = zstandard.ZstdCompressor(level=3, write_checksum=True)
        self.sizes: list[tuple[int, int]] = []
        self.open: list[bytes] = []
        self.held = self.written = 0

    def add(self, record: bytes) -> tuple[int, int]:
        """The frame's number and the record's place in it."""
        if self.held and self.held + len(record) > self.frame_bytes:
            self.end_frame()
        at = len(self.sizes), self.held
        self.open.append(record)
        self.held += len(record)
        return at

    def end_frame(self) -> None:
        if self.held:
            packed = self.packer.compress(b"".join(self.open))
            self.out.write(packed)
            self.sizes.append((len(packed), self.held))
            self.written += len(packed)
            self.open, self.held = [], 0

    def close(self) -> None:
        self.end_frame()
        table = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.out.close()


def read_table(file) -> list[tuple[int, int, int]]:
    """Place, packed and unpacked size of every frame, from the table at the end of an open bundle."""
    end = file.size()
    file.seek(end - 9)
    count, flags, mark = struct.unpack("<IBI", file.read(9))
    if mark != SEEKABLE:
        raise ValueError("no table of frames at the end of the bundle")
    width = 12 if flags & 0x80 else 8
    file.seek(end - 9 - count * width)
    table, places, at = file.read(count * width), [], 0
    for i in range(count):
        packed, size = struct.unpack_from("<II", table, i * width)
        places.append((at, packed, size))
        at += packed
    return places


def _line(value: str) -> str:
    """Header value on one line: control characters and percent signs are escaped."""
    return quote(value, safe=" !\"#$&'()*+,/:;<=>?@[\\]^_`{|}~")


def _uri(value: str) -> str:
    """A target URI as it is, but for control characters, which would end its line."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda c: f"%{ord(c[0]):02X}", value)


def record_of(kind: str, record_id: str, date: str, headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    lines = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{record_id}>"), ("WARC-Date", date), *headers, ("Content-Length", str(len(block)))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines if v is not None) + "\r\n").encode() + block + b"\r\n\r\n"


def parse(raw: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers in lower case, block and end of the record at ``at``."""
    stop = raw.index(b"\r\n\r\n", at)
    lines = raw[at:stop].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no record at {at}")
    headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    end = stop + 4 + int(headers["content-length"])
    return headers, raw[stop + 4 : end], end + 4


def base32_sha1(raw: bytes) -> str:
    return base64.b32encode(hashlib.sha1(raw).digest()).decode()


def _response_id(digest: str, doc: str | None, url: str | None) -> str:
    """The same wherever it is made, so that revisits know it; a digest has one response."""
    return str(uuid.uuid5(uuid.NAMESPACE_URL, "\0".join([digest, *("-" if x is None else f"={x}" for x in (doc, url))])))


def decide(df: DataFrame, min_bytes: int) -> DataFrame:
    """Rows (id, url, payload, size, digest) with ``copies``, ``is_response`` and the response's ``ref_id`` and ``ref_url``.

    The response of a digest is the row of its smallest (id, url), nulls last. If that very row occurs
    several times, one row comes out for all of them with their number as ``copies``.
    """
    order = [F.col("id").isNull(), F.col("id"), F.col("url").isNull(), F.col("url")]
    same = df.filter(F.col("size") >= min_bytes).groupBy("digest", "id", "url").agg(F.count("*").alias("n"))
    first = same.groupBy("digest").agg(F.sum("n").alias("rows"), F.min(F.struct(*(c.alias(f"k{i}") for i, c in enumerate(order)), "n")).alias("least")).filter("rows > 1")
    twice = materialize(first.select("digest", F.col("least.k1").alias("ref_id"), F.col("least.k3").alias("ref_url"), F.col("least.n").alias("ref_n")))
    joined = df.join(twice, "digest", "left").withColumn("is_response", F.col("ref_n").isNull() | (F.col("id").eqNullSafe(F.col("ref_id")) & F.col("url").eqNullSafe(F.col("ref_url"))))
    columns = ["digest", "id", "url", "payload", "size", "is_response", "ref_id", "ref_url"]
    repeated = F.col("is_response") & (F.coalesce("ref_n", F.lit(1)) > 1)
    plain = joined.filter(~repeated).select(*columns, F.lit(1).cast("long").alias("copies"))
    if twice.filter("ref_n > 1").isEmpty():
        return plain
    rest = df.join(twice.filter("ref_n > 1"), "digest").filter(F.col("id").eqNullSafe(F.col("ref_id")) & F.col("url").eqNullSafe(F.col("ref_url")))
    one = rest.groupBy("digest").agg(*(F.first(c).alias(c) for c in ("id", "url", "payload", "size", "ref_id", "ref_url")), F.count("*").alias("copies"))
    return plain.unionByName(one.withColumn("is_response", F.lit(True)).select(*columns, "copies"))


def write_bundles(
    df: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0,
    frame_bytes: int = 1 << 20, bundle_bytes: int = 256 << 20, date: str | None = None,
) -> DataFrame:
    """Write every row as a record into bundles below ``path``, and return the index (also written there).

    Of rows with equal payloads of at least ``min_bytes`` the one with the smallest id (then the smallest url,
    nulls last) is a response, the others are revisits that name it; of identical rows one is it. Smaller
    payloads are all responses. The index has ``record_id``, ``id`` (as text), ``record_type``, ``bundle``,
    ``frame``, ``offset`` and ``length`` (within the unpacked frame).

    A null payload is the empty one; null ids and urls are left out of their record; a payload longer than
    ``frame_bytes`` is a frame of its own. Repeated rows are a record each. An empty table gives an empty
    index and no bundle. Other columns are not read, so their names may be any. ``path`` must be one that
    Arrow reaches on driver and executors (a shared mount, HDFS, an object store) and hold no bundles yet.
    """
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    payload = F.coalesce(F.col(f"`{payload_col}`").cast("binary"), F.lit(b""))
    plain = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"), payload.alias("payload"))
    keyed = plain.withColumn("size", F.octet_length("payload").cast("long")).withColumn("digest", F.unhex(F.sha1("payload")))
    where, inside = filesystem(path)
    where.create_dir(f"{inside}/bundles", recursive=True)
    made = decide(keyed, min_bytes).select(
        F.col("id").cast("string"), "url", F.when(F.col("is_response"), F.col("payload")).alias("payload"), "size", "digest", "is_response", F.col("ref_id").cast("string"), "ref_url", "copies"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("warc")
        store, inner = filesystem(path)
        bundle, name = None, ""
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                digest = base64.b32encode(r["digest"]).decode()
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {r['size']}\r\n\r\n".encode()
                own = [("X-Id", None if r["id"] is None else _line(r["id"])), ("WARC-Target-URI", None if r["url"] is None else _uri(r["url"])), ("WARC-Payload-Digest", f"sha1:{digest}")]
                ref_id, ref_url = (r["id"], r["url"]) if r["is_response"] else (r["ref_id"], r["ref_url"])
                response = _response_id(digest if r["size"] >= min_bytes else f"{digest}{uuid.uuid4()}", ref_id, ref_url)
                for copy in range(r["copies"]):
                    if r["is_response"] and not copy:
                        kind, record_id, block = "response", response, head + r["payload"]
                        headers = [*own, ("Content-Type", "application/http;msgtype=response")]
                    else:
                        kind, record_id, block = "revisit", str(uuid.uuid4()), head
                        names = [("WARC-Refers-To", f"<urn:uuid:{response}>"), ("WARC-Refers-To-Target-URI", None if ref_url is None else _uri(ref_url)), ("X-Refers-To-Id", None if ref_id is None else _line(ref_id))]
                        headers = [*own, ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), *names, ("Content-Type", "application/http;msgtype=response")]
                    if bundle is None or bundle.written > bundle_bytes:
                        if bundle:
                            bundle.close()
                        name = f"{uuid.uuid4().hex}.warc.zst"
                        bundle = BundleWriter(store, f"{inner}/bundles/{name}", frame_bytes)
                        bundle.add(record_of("warcinfo", str(uuid.uuid4()), date, [("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
                        bundle.end_frame()
                    raw = record_of(kind, record_id, date, headers, block)
                    frame, offset = bundle.add(raw)
                    rows.append((record_id, r["id"], kind, name, frame, offset, len(raw)))
            yield _batch(INDEX_TYPES, rows)
        if bundle:
            bundle.close()

    with arrow_batches(df.sparkSession, ROWS):
        made.mapInArrow(run, INDEX).write.parquet(f"{path}/index")
    index = df.sparkSession.read.schema(INDEX).parquet(f"{path}/index")
    counted = {r["bundle"] for r in index.select("bundle").distinct().collect()}  # one name per ``bundle_bytes``
    for left in where.get_file_info(_selector(f"{inside}/bundles")):
        if left.base_name not in counted:
            where.delete_file(left.path)
    return index


_TYPES = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
INDEX_TYPES, RECORD_TYPES = ([(n, _TYPES[t]) for n, t in (c.split(" ") for c in ddl.split(", "))] for ddl in (INDEX, RECORD))


def _selector(folder: str):
    from pyarrow import fs

    return fs.FileSelector(folder)


def _batch(types: list, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(types)], names=[n for n, _ in types])


def _read(raw: bytes, at: int, bundle: str, frame: int, with_payload: bool) -> tuple[tuple | None, int]:
    """The record at ``at`` as a row of ``RECORD`` (None for one that describes the bundle), and where it ends."""
    headers, block, end = parse(raw, at)
    kind = headers["warc-type"]
    if kind == "warcinfo":
        return None, end
    head, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"(?i)\r\ncontent-length: (\d+)", head)[1])
    said = headers["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != size or base32_sha1(payload) != said):
        raise ValueError(f"record {headers['warc-record-id']} of {bundle} is damaged")
    text = lambda key: unquote(headers[key]) if key in headers else None
    name = lambda key: headers[key][10:-1] if key in headers else None
    shown = payload if with_payload and kind == "response" else None
    return (name("warc-record-id"), text("x-id"), headers.get("warc-target-uri"), kind, shown, size, said, name("warc-refers-to"), text("x-refers-to-id"), bundle, frame, at), end


def read_bundles(spark: SparkSession, path: str, with_payload: bool = True, split_frames: int = 16) -> DataFrame:
    """All records of the bundles below ``path``, from the files alone: payload, its size and digest, and what a revisit refers to.

    Bundles are cut into runs of ``split_frames`` frames by their tables, so that tasks share a large bundle.
    A revisit has no payload of its own; its size and digest are those of the full payload it stands for.
    Payloads of responses are digested again and must agree with their record. A folder without bundles
    gives no rows. Missing ids and urls come back as null, control characters of urls percent-encoded.
    """
    where, inside = filesystem(path)
    names = [f.base_name for f in where.get_file_info(_selector(f"{inside}/bundles"))]
    bundles = spark.createDataFrame([(n,) for n in names], "bundle string").repartition(max(1, min(len(names), 10 * shuffle_partitions(spark))), "bundle")

    def tables(batches):
        store, inner = filesystem(path)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with store.open_input_file(f"{inner}/bundles/{name}") as file:
                    frames = read_table(file)
                runs = [(name, i, frames[i][0], [p for _, p, _ in frames[i : i + split_frames]]) for i in range(0, len(frames), split_frames)]
                yield pa.RecordBatch.from_pydict({"bundle": [r[0] for r in runs], "frame": pa.array([r[1] for r in runs], pa.int32()), "at": pa.array([r[2] for r in runs], pa.int64()), "packed": pa.array([r[3] for r in runs], pa.list_(pa.int64()))})

    def records(batches):
        import zstandard

        store, inner = filesystem(path)
        unpack, rows, held = zstandard.ZstdDecompressor(), [], 0
        for batch in batches:
            for r in batch.to_pylist():
                with store.open_input_file(f"{inner}/bundles/{r['bundle']}") as file:
                    file.seek(r["at"])
                    for i, packed in enumerate(r["packed"]):
                        raw, at = unpack.decompress(file.read(packed)), 0
                        held += len(raw) if with_payload else 4096
                        while at < len(raw):
                            row, at = _read(raw, at, r["bundle"], r["frame"] + i, with_payload)
                            if row:
                                rows.append(row)
                        if held > HELD:
                            yield _batch(RECORD_TYPES, rows)
                            rows, held = [], 0
        if rows:
            yield _batch(RECORD_TYPES, rows)

    runs = bundles.mapInArrow(tables, "bundle string, frame int, at long, packed array<long>")
    return runs.repartition(shuffle_partitions(spark), "bundle", "frame").mapInArrow(records, RECORD)


def fetch_records(spark: SparkSession, path: str, wanted: DataFrame, record_col: str = "record_id") -> DataFrame:
    """The records that ``wanted`` names, through the index: only their frames are unpacked, each once a task.

    Unknown and null names give no row, repeated ones one row.
    """
    index = spark.read.schema(INDEX).parquet(f"{path}/index")
    names = wanted.select(F.col(f"`{record_col}`").alias("record_id")).distinct()
    places = index.join(names, "record_id").select("bundle", "frame", "offset")
    dealt = places.repartition(shuffle_partitions(spark), "bundle", "frame").sortWithinPartitions("bundle", "frame", "offset")

    def run(batches):
        import zstandard

        store, inner = filesystem(path)
        unpack, now, frames, raw = zstandard.ZstdDecompressor(), (None, None), [], b""
        for batch in batches:
            rows, held = [], 0
            for r in batch.to_pylist():
                if (r["bundle"], r["frame"]) != now:
                    with store.open_input_file(f"{inner}/bundles/{r['bundle']}") as file:
                        frames = read_table(file) if r["bundle"] != now[0] else frames
                        at, packed, _ = frames[r["frame"]]
                        file.seek(at)
                        raw, now = unpack.decompress(file.read(packed)), (r["bundle"], r["frame"])
                rows.append(_read(raw, r["offset"], *now, True)[0])
                held += len(rows[-1][4] or b"")
                if held > HELD:
                    yield _batch(RECORD_TYPES, rows)
                    rows, held = [], 0
            if rows:
                yield _batch(RECORD_TYPES, rows)

    return dealt.mapInArrow(run, RECORD)
