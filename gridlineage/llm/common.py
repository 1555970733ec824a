"""What the operators of this subpackage share: shared storage, bounded broadcasts, graph components."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The smallest long: stands for a null id wherever rows need a total order.
NULL_ID = -(2**63)
#: The white space of every word contract: 0x20 and 0x09 to 0x0D, as bytes.split() has it.
SPACE = " \t\n\x0b\x0c\r"
#: Rows that a broadcast side may have, whatever the input's size; beyond that a shuffled join is used.
BROADCAST_ROWS = 200_000
_LOCAL: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is set, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="corpus-"))
    return f"file://{_LOCAL[0]}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage, and outlives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def storage(uri: str):
    """(pyarrow file system, path in it) of a URI; a bare path is a local one."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if ":" in uri.split("/")[0] else f"file://{os.path.abspath(uri)}")


def write_whole(uri: str, write) -> None:
    """Writes a file under a name of its own and renames it: a repeated task replaces it by equal bytes."""
    files, path = storage(uri)
    part = f"{path}.{uuid.uuid4().hex}.part"
    files.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with files.open_output_stream(part, compression=None) as out:
        write(out)
    try:
        files.move(part, path)
    except OSError:  # a store that doesn't replace: another attempt has written equal bytes
        if files.get_file_info(path).size != files.get_file_info(part).size:
            files.delete_file(path)
            files.move(part, path)
        else:
            files.delete_file(part)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A join's side, marked for broadcast only if it's counted to have at most so many rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def small_batches(spark: SparkSession, size: str = "8m") -> None:
    """Bounds the bytes, not only the rows, that go to a Python worker at once, so that long texts fit beside its caches."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def release() -> None:
    """Gives memory that this worker process has freed back to the system; idle workers would keep it beside those that run."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: it has no such call
        pass


def fresh(df: DataFrame, name: str) -> str:
    """The name, lengthened until no column of df has it in either case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """docs without the rows (doc_id, mark). Columns as given."""
    id_, mark = fresh(docs, "gone_id"), fresh(docs, "gone_mark")
    gone = small(cut(rows.select(F.col("doc_id").alias(id_), F.col("mark").alias(mark)).distinct(), "gone"))
    return docs.join(gone, (docs["doc_id"].cast("long") == gone[id_]) & (F.xxhash64(docs["text"].cast("string")) == gone[mark]), "left_anti")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_bounds(df: DataFrame, n: int, col: str = "doc_id") -> list[int]:
    """At most n - 1 ascending ids that cut the rows into n ranges of about equal row counts."""
    if n < 2:
        return []
    got = df.select(F.percentile_approx(col, [k / n for k in range(1, n)], 10_000).alias("b")).first()["b"]
    return sorted(set(got or []))


def ranges(df: DataFrame, rows: int = 20_000, most: int = 10_000) -> int:
    """Into how many ranges of ids df is cut: as many as shuffle partitions, more where they'd hold more rows than that."""
    return max(partitions(df.sparkSession), min(most, -(-df.count() // rows)))


def range_of(col, bounds: list[int]):
    """Column: which of the ranges an id is in; equal ids share one, null is in the first.

    Two steps of about the root of the number of ranges each: the block of bounds, then the place in it.
    """
    if not bounds:
        return F.lit(0)
    width = max(1, round(len(bounds) ** 0.5))
    blocks = [bounds[k : k + width] for k in range(0, len(bounds), width)]
    ids = lambda some: F.array(*[F.lit(b).cast("long") for b in some])
    block = F.size(F.filter(ids([b[0] for b in blocks]), lambda b: b <= col))
    place = F.transform(F.array(block), lambda k: F.when(k > 0, (k - 1) * width + F.size(F.filter(F.get(F.array(*map(ids, blocks)), k - 1), lambda b: b <= col))).otherwise(0))
    return F.when(col.isNull(), 0).otherwise(place[0]).cast("int")


def sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """About so many rows, by a hash of their key: the same rows however they're stored; all rows of a key, however many."""
    n = df.count()
    return df if n <= rows else df.where(F.pmod(F.xxhash64(key, F.lit(1)), F.lit(1 << 40)) < int((1 << 40) * rows / n))


def components(edges: DataFrame, name: str = "edges") -> DataFrame:
    """(node, root) of every node in edges (a, b) but the roots: root is the smallest node reachable.

    Large-star and small-star steps alternate until nothing changes; each round is a written table.
    No node ever gathers its neighbours in one row: minima are aggregated map-side and joined back.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), name)
    seen = None
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # large star: every larger neighbour links to the least of the neighbourhood
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: every smaller neighbour, and the node itself, links to the least smaller one
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(low, "a")
        small_star = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(low.select("a", F.col("m").alias("b"))).distinct()
        now = cut(small_star, name)
        state = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if seen == state:
            break
        seen = state
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
