"""Token-id files: a shared zstandard dictionary, one small frame a document, an offset index.

A file holds, in ascending doc_id order: the magic, one zstandard frame per document (its
ids as little-endian unsigned 32-bit integers, compressed with the shared dictionary), the
index (doc_id, frame offset, frame length, ids; 28 bytes a document), and a footer with the
index's place and the dictionary's SHA-256.  A document is read by one seek and one small
frame.  The dictionary is trained once, on the serialized ids of about SAMPLE documents
(drawn by a hash of doc_id, none above SAMPLE_BYTES), and stored beside the files.

Defined cases: a null or empty text has the end id alone; a null doc_id sorts first and is
kept as null, for which the smallest long stands in the index; rows that repeat a doc_id are
ordered by their number of ids, then their frame; an empty table gives no file; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from collections.abc import Iterator
from io import BytesIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlineage.llm.common import NULL_ID, id_bounds, new_path, range_of, ranges, sample, storage, write_whole
from gridlineage.llm.tokens import END_ID, encoder

MAGIC = b"TOKZ0001"
INDEX = "<qqqI"
FOOTER = "<qq32s8s"
SAMPLE, SAMPLE_BYTES, DICTIONARY_BYTES, LEVEL = 400, 1 << 20, 64 << 10, 3
END = struct.pack("<I", END_ID)


def train(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """Dictionary bytes; a raw-content dictionary where there's too little to train on."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-size:] or b"\0" * 8


def _zstd(dictionary: bytes):
    import zstandard

    data = zstandard.ZstdCompressionDict(dictionary)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=data), zstandard.ZstdDecompressor(dict_data=data)


def write(docs: DataFrame, path: str, vocabulary: str | None = None, files: int | None = None) -> dict:
    """Encodes docs (doc_id, text) into token files under path; gives the manifest, which is also stored there."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    some = sample(docs, "doc_id", SAMPLE).where(F.length("text") * 4 < SAMPLE_BYTES).select("text").collect()
    own = encoder(vocabulary)
    dictionary = train([own.encode(t) + END for t in sorted(r["text"] for r in some)])
    digest = hashlib.sha256(dictionary).digest()
    write_whole(f"{path}/dictionary.zdict", lambda out: out.write(dictionary))
    n = files or ranges(docs)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, (press, _) = encoder(vocabulary), _zstd(dictionary)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                ids = [enc.encode(t.as_py()) + END for t in part.column("text")]
                yield pa.RecordBatch.from_arrays([part.column("file"), part.column("doc_id"), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array([press.compress(i) for i in ids], pa.binary())], names=["file", "doc_id", "n", "frame"])

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = []

        def rows():
            for b in batches:
                yield from zip(*(b.column(c).to_pylist() for c in ("file", "doc_id", "n", "frame")))

        todo = rows()
        ahead = next(todo, None)
        while ahead is not None:
            number, docs_in, tokens = ahead[0], 0, 0

            def fill(out):
                nonlocal ahead, docs_in, tokens
                index = BytesIO()
                out.write(MAGIC)
                at = len(MAGIC)
                while ahead is not None and ahead[0] == number:
                    _, doc, count, frame = ahead
                    out.write(frame)
                    index.write(struct.pack(INDEX, NULL_ID if doc is None else doc, at, len(frame), count))
                    at, docs_in, tokens = at + len(frame), docs_in + 1, tokens + count
                    ahead = next(todo, None)
                out.write(index.getvalue())
                out.write(struct.pack(FOOTER, at, docs_in, digest, MAGIC))

            write_whole(f"{path}/ids-{number:06d}.tok", fill)
            done.append((number, docs_in, tokens))
        cols = list(zip(*done)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["file", "docs", "tokens"])

    placed = docs.withColumn("file", range_of(F.col("doc_id"), id_bounds(docs, n)))
    frames = placed.mapInArrow(encode, "file int, doc_id long, n long, frame binary")
    stored = frames.repartition(n, "file").sortWithinPartitions("file", F.asc_nulls_first("doc_id"), "n", "frame").mapInArrow(store, "file long, docs long, tokens long").collect()
    manifest = {"dictionary_sha256": digest.hex(), "files": [], "docs": 0, "tokens": 0}
    for r in sorted(stored):  # a row a file: bounded by the number of files
        manifest["files"].append({"name": f"ids-{r['file']:06d}.tok", "docs": r["docs"], "tokens": r["tokens"], "start": manifest["tokens"]})
        manifest["docs"] += r["docs"]
        manifest["tokens"] += r["tokens"]
    write_whole(f"{path}/manifest.json", lambda out: out.write(json.dumps(manifest).encode()))
    return manifest


def open_dictionary(path: str, digest: str) -> bytes:
    files, at = storage(f"{path}/dictionary.zdict")
    with files.open_input_stream(at) as f:
        data = f.read()
    if hashlib.sha256(data).hexdigest() != digest:
        raise ValueError("the dictionary isn't the one these files were written with")
    return data


def index_of(f) -> list[tuple[int | None, int, int, int]]:
    """(doc_id, offset, length, ids) of an open random-access file; checks magic and footer."""
    f.seek(0)
    if f.read(8) != MAGIC:
        raise ValueError("not a token file")
    size = f.size()
    f.seek(size - struct.calcsize(FOOTER))
    at, docs, digest, magic = struct.unpack(FOOTER, f.read(struct.calcsize(FOOTER)))
    if magic != MAGIC or at + docs * struct.calcsize(INDEX) + struct.calcsize(FOOTER) != size:
        raise ValueError("a token file is cut or damaged")
    f.seek(at)
    return [(None if d == NULL_ID else d, o, k, n) for d, o, k, n in struct.iter_unpack(INDEX, f.read(docs * struct.calcsize(INDEX)))]


def read_document(path: str, name: str, doc_id: int | None) -> list[bytes]:
    """Ids (bytes) of the documents of one id in one file: a seek and a frame for each."""
    files, at = storage(f"{path}/manifest.json")
    with files.open_input_stream(at) as f:
        _, expand = _zstd(open_dictionary(path, json.loads(f.read())["dictionary_sha256"]))
    out = []
    with files.open_input_file(storage(f"{path}/{name}")[1]) as f:
        for d, o, k, n in index_of(f):
            if d == doc_id:
                f.seek(o)
                out.append(expand.decompress(f.read(k), max_output_size=4 * n))
    return out


def read(spark: SparkSession, path: str) -> DataFrame:
    """Token files under path -> (doc_id, start, n_tokens, ids_crc32), from the files alone."""
    files, at = storage(f"{path}/manifest.json")
    with files.open_input_stream(at) as f:
        manifest = json.loads(f.read())
    digest = manifest["dictionary_sha256"]

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, expand = _zstd(open_dictionary(path, digest))
        for b in batches:
            for name, start in zip(b.column("name").to_pylist(), b.column("start").to_pylist()):
                store, where = storage(f"{path}/{name}")
                with store.open_input_file(where) as f:
                    index = index_of(f)
                    for k in range(0, len(index), 4096):
                        part = index[k : k + 4096]
                        f.seek(part[0][1])
                        starts, crcs = [], []
                        for _, _, length, n in part:
                            ids = expand.decompress(f.read(length), max_output_size=4 * n)
                            if len(ids) != 4 * n:
                                raise ValueError(f"{name}: a frame doesn't hold the ids its index names")
                            starts.append(start)
                            crcs.append(zlib.crc32(ids))
                            start += n
                        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in part], pa.int64()), pa.array(starts, pa.int64()), pa.array([p[3] for p in part], pa.int64()), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    listed = spark.createDataFrame([(f["name"], f["start"]) for f in manifest["files"]], "name string, start long")
    return listed.repartition(max(1, len(manifest["files"]))).mapInArrow(load, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Writes docs' token files in the shared folder and reads them back."""
    path = new_path(docs.sparkSession, "tokens")
    write(docs, path, vocabulary)
    return read(docs.sparkSession, path)
