"""WARC archives in zstandard: a dictionary in the leading skippable frame, a frame a record.

The layout is the public one for WARC in zstandard: the file starts with a skippable frame
(magic 0x184D2A5D) that holds the dictionary, and each record is a frame of its own, so that
a record is read by seeking to it.  The dictionary is trained on about SAMPLE records,
drawn by a hash of page_id and none above SAMPLE_BYTES.

Each page is a response record, or a revisit record where an equal payload of at least
REVISIT_BYTES has a larger page_id; a revisit keeps the HTTP header, with the full length,
and names the record it refers to.  Records are written where their page is read: only the
digests of payloads are shuffled.  The reader checks version, mandatory headers, lengths,
record ends and the digest of each payload, and raises ValueError on what doesn't fit.

Defined cases: null html is an empty payload; a null url is archived as urn:page:ID; a null
page_id is smaller than any other; rows that repeat a page_id and payload are alike, so all
rows of the largest page_id are responses; an empty table gives no archive.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlineage.llm.common import NULL_ID, cut, new_path, sample, small, storage, write_whole

SKIPPABLE = 0x184D2A5D
SAMPLE, SAMPLE_BYTES, DICTIONARY_BYTES, LEVEL = 200, 1 << 19, 64 << 10, 3
REVISIT_BYTES = 1000
VERSION = b"WARC/1.1"
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _uri(page: int | None) -> str:
    return f"<urn:page:{'null' if page is None else page}>"


def _page(uri: str) -> int | None:
    name = uri.strip("<>").removeprefix("urn:page:")
    return None if name == "null" else int(name)


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """A whole record, uncompressed."""
    digest = hashlib.sha1(payload).digest()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    target = "".join(c if "!" <= c <= "~" else "".join(f"%{b:02X}" for b in c.encode()) for c in url) if url else _uri(page).strip("<>")
    head = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", _uri(page)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", target),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(digest).decode()),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if revisit:
        head[4:4] = [("WARC-Refers-To", _uri(refers_to)), ("WARC-Profile", PROFILE)]
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """A record's headers, payload_bytes, payload_digest (hex) and payload (None for a revisit); ValueError if it's malformed."""
    head, mark, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not mark or lines[0] != VERSION:
        raise ValueError("no WARC/1.1 record")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.decode().partition(":")
        if not colon or not name or name != name.strip() or name.lower() in fields:
            raise ValueError(f"bad header line {line[:80]!r}")
        fields[name.lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise ValueError(f"no {name}")
    if not fields["content-length"].isdigit():
        raise ValueError("bad Content-Length")
    n = int(fields["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError("the record isn't as long as its header says")
    http, mark, payload = rest[:n].partition(b"\r\n\r\n")
    lengths = [int(x.split(b":")[1]) for x in http.split(b"\r\n")[1:] if x.lower().startswith(b"content-length:")]
    scheme, _, digest = fields.get("warc-payload-digest", "").partition(":")
    if not mark or len(lengths) != 1 or scheme != "sha1":
        raise ValueError("no HTTP header, length or digest")
    hexed = base64.b32decode(digest).hex()
    if fields["warc-type"] == "response":
        if len(payload) != lengths[0] or hashlib.sha1(payload).hexdigest() != hexed:
            raise ValueError("the payload has another length or digest")
    elif fields["warc-type"] == "revisit":
        if payload or "warc-refers-to" not in fields or "warc-profile" not in fields:
            raise ValueError("bad revisit record")
        payload = None
    else:
        raise ValueError(f"unknown record type {fields['warc-type']}")
    return {"fields": fields, "payload": payload, "payload_bytes": lengths[0], "payload_digest": hexed}


def train(samples: list[bytes]) -> bytes:
    import zstandard

    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-DICTIONARY_BYTES:] or VERSION


def write(pages: DataFrame, path: str) -> list[str]:
    """Archives of pages (page_id, url, html) under path; the names of the files."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    some = sample(pages, "page_id", SAMPLE).where(F.octet_length("html") < SAMPLE_BYTES).collect()
    dictionary = train([record(r["page_id"], r["url"], r["html"].encode(), None, False) for r in sorted(some, key=str)])
    pages = pages.withColumn("digest", F.sha1(F.encode("html", "utf-8"))).withColumn("bytes", F.octet_length("html"))
    order = F.coalesce("page_id", F.lit(NULL_ID))
    # a row for each payload that several pages share; copies are counted before they are shuffled
    shared = pages.where(F.col("bytes") >= REVISIT_BYTES).groupBy("digest", "bytes").agg(F.max(order).alias("best"), F.min(order).alias("worst")).where("best <> worst").drop("worst")
    shared = small(cut(shared, "shared"))
    placed = pages.join(shared, ["digest", "bytes"], "left").select("page_id", "url", "html", F.when(F.col("best") > order, F.col("best")).alias("refers_to"))

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        press = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=True)
        name, n = f"pages-{TaskContext.get().partitionId():06d}.warc.zst", 0
        todo = (r for b in batches for r in zip(b.column("page_id").to_pylist(), b.column("url").to_pylist(), b.column("html"), b.column("refers_to").to_pylist()))
        first = next(todo, None)
        if first is None:
            return

        def fill(out):
            nonlocal n
            out.write(struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary)
            row = first
            while row is not None:
                page, url, html, refers = row
                out.write(press.compress(record(page, url, html.as_py().encode(), refers, refers is not None)))
                n += 1
                row = next(todo, None)

        write_whole(f"{path}/{name}", fill)
        yield pa.RecordBatch.from_pydict({"name": [name], "records": [n]})

    return sorted(r["name"] for r in placed.mapInArrow(store, "name string, records long").collect())


def records(f, block: int = 1 << 20) -> Iterator[bytes]:
    """The records of an open archive; ValueError if it's cut short or starts with no dictionary."""
    import zstandard

    head = f.read(8)
    if len(head) != 8 or struct.unpack("<II", head)[0] != SKIPPABLE:
        raise ValueError("no dictionary frame")
    size = struct.unpack("<II", head)[1]
    dictionary = f.read(size)
    if len(dictionary) != size:
        raise ValueError("the dictionary is cut short")
    plain = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
    left, frame, got, fed = b"", plain.decompressobj(), [], False
    while data := left or f.read(block):
        left = b""
        got.append(frame.decompress(data))
        fed = not frame.eof  # a short record gives no bytes before its frame is whole
        if frame.eof:
            yield b"".join(got)
            left, frame, got = frame.unused_data, plain.decompressobj(), []
    if fed:
        raise ValueError("the last frame is cut short")


SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Archives -> page_id, payload_bytes, payload_digest, record_type, refers_to; a row a record, every record checked."""
    fields = [f.split()[0] for f in SCHEMA.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name in b.column("name").to_pylist():
                files, at = storage(f"{path}/{name}")
                with files.open_input_stream(at, compression=None) as f:
                    rows = []
                    for data in records(f):
                        r = parse(data)
                        h = r["fields"]
                        rows.append((_page(h["warc-record-id"]), r["payload_bytes"], r["payload_digest"], h["warc-type"], _page(h["warc-refers-to"]) if "warc-refers-to" in h else None))
                        if len(rows) == 4096:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=fields)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=fields)

    listed = spark.createDataFrame([(n,) for n in names], "name string")
    return listed.repartition(max(1, len(names))).mapInArrow(load, SCHEMA)


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes pages' archives in the shared folder and reads them back."""
    path = new_path(pages.sparkSession, "warc")
    return read(pages.sparkSession, path, write(pages, path))
