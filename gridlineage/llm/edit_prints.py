"""Document fingerprints by randomised edit embedding.

A random walk over a text's characters, shared by all texts, maps edit distance to Hamming
distance: at each step the walk writes the character it stands on and, by a hash of step and
character, stays or moves on.  After an edit two walks soon fall in step again, so texts of
small edit distance write mostly equal symbols at equal steps.  The time spent on a character
is drawn at once from a table of (step, character class), which gives the same walk.

A fingerprint samples SLOTS steps of the walk: each slot takes the step of least slot hash
that the walk reached, so that texts of similar length sample the same steps, and keeps a
byte of the GRAM characters that the walk stands on.  Likeness is the share of equal slots.
Near pairs are found by banding the slots, and every candidate is verified by its likeness.

Defined cases: a null or empty text has the fingerprint of the empty walk, equal for all of
them; equal texts have equal fingerprints; the whole text is walked, however long; the last
document's next one is the first; rows that repeat a doc_id are ordered by text, and null
ids come first; an empty table gives no row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlineage.llm.common import NULL_ID, components, cut, id_bounds, range_of, ranges, small

SLOTS, GRAM, SEED = 128, 4, 5
#: The walk's random bits repeat after PERIOD steps; characters fall in CLASSES classes.
PERIOD, CLASSES = 1 << 12, 64
ODD = np.arange(1, 2 * GRAM, 2, dtype=np.uint64)
#: Bands of 6 slots: a pair of likeness 0.8 shares one with a chance of 0.998.
BANDS = 21
#: Prints that one bucket compares at once; a larger one is compared in blocks, each pair of blocks a task of its own.
BUCKET = 4096


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Walk:
    """The shared walk: how long it dwells by step and class, and which step each slot samples."""

    def __init__(self, seed: int = SEED):
        steps = _mix(np.arange(PERIOD * CLASSES, dtype=np.uint64) + np.uint64(seed << 32))
        bits = (steps & np.uint64(1)).astype(bool).reshape(PERIOD, CLASSES)
        # from step j on class c the walk leaves after the first step whose bit is set; rows repeat after PERIOD
        self.dwell = np.zeros((PERIOD, CLASSES), dtype=np.int64)
        wait = np.zeros(CLASSES, dtype=np.int64)
        for j in range(2 * PERIOD - 1, -1, -1):
            wait = np.where(bits[j % PERIOD], 1, wait + 1)
            if j < PERIOD:
                self.dwell[j] = wait
        # two characters at once: the sum of both dwells by step and pair of classes
        rows = []
        for start in range(0, PERIOD, 256):  # by blocks, to bound what it takes
            first = self.dwell[start : start + 256]
            pairs = first[:, :, None] + self.dwell[(np.arange(start, start + 256)[:, None] + first) % PERIOD]
            if pairs.max() > 255:
                raise ValueError("choose another seed")
            rows.append(pairs.astype(np.uint8).tobytes())
        self.pairs = b"".join(rows)
        self.mixed = _mix(np.arange(1, 65_537, dtype=np.uint64))
        self.seed, self.upto = seed, 0
        self.low = np.full(SLOTS, 2**64 - 1, dtype=np.uint64)
        self.found: list[tuple[np.ndarray, np.ndarray]] = []

    def _grow(self, n: int) -> None:
        """Each slot's records, the steps that have the least slot hash so far, over the first n steps."""
        upto = max(1 << 14, 1 << (n - 1).bit_length())
        for start in range(self.upto, upto, 1 << 14):
            steps = np.arange(start, start + (1 << 14), dtype=np.uint64)
            for s in range(SLOTS):
                h = np.minimum.accumulate(_mix(steps + np.uint64((self.seed << 48) + (s << 36))))
                before = np.concatenate([self.low[s : s + 1], h[:-1]])
                at = np.flatnonzero((h < before) & (h < self.low[s]))
                if len(at):
                    self.found.append((np.full(len(at), s, dtype=np.int64), at + start))
                    self.low[s] = min(self.low[s], h[-1])
        self.upto = upto
        slot, step = (np.concatenate(x) for x in zip(*self.found))
        order = np.lexsort((step, slot))
        self.steps = step[order]
        self.keys = (slot[order] << 44) + self.steps

    def sampled(self, n: int) -> np.ndarray:
        """The step that each slot samples of a walk of n >= 1 steps."""
        if n > self.upto:
            self._grow(n)
        return self.steps[np.searchsorted(self.keys, (np.arange(SLOTS) << 44) + n) - 1]

    def read(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """(mixed code points, classes) of a text."""
        points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), dtype="<u4")
        if len(points) and points.max() > 65_535:
            mixed = _mix(points.astype(np.uint64) + np.uint64(1))
        else:
            mixed = self.mixed[points]
        return mixed, (mixed >> np.uint64(58)).astype(np.uint8)

    def walk(self, codes: np.ndarray, j: int = 0) -> np.ndarray:
        """The step at which each character is left, starting at step j."""
        first, table, start = codes[: len(codes) // 2 * 2 : 2], self.pairs, j
        both = (first.astype(np.uint16) << 6 | codes[1::2]).tolist()
        even = np.array([j := j + table[(j & 4095) << 12 | c] for c in both], dtype=np.int64)
        begins = np.concatenate([[start], even[:-1]]) if len(even) else even
        out = np.empty(len(codes), dtype=np.int64)
        out[1::2] = even
        out[: 2 * len(even) : 2] = begins + self.dwell[begins & 4095, first]
        if len(codes) % 2:
            out[-1] = j + self.dwell[j & 4095, codes[-1]]
        return out

    def sample(self, mixed: np.ndarray, left: np.ndarray) -> bytes:
        if not len(left):
            return bytes(SLOTS)
        at = np.searchsorted(left, self.sampled(int(left[-1])), side="right")
        padded = np.concatenate([mixed, np.arange(1, GRAM, dtype=np.uint64)])
        gram = _mix((padded[at[:, None] + np.arange(GRAM)] * ODD).sum(axis=1, dtype=np.uint64))
        return (gram >> np.uint64(56)).astype(np.uint8).tobytes()

    def fingerprint(self, text: str | None) -> bytes:
        mixed, codes = self.read(text)
        return self.sample(mixed, self.walk(codes))


_WALKS: list[Walk] = []


def shared_walk() -> Walk:
    if not _WALKS:
        _WALKS.append(Walk())
    return _WALKS[0]


def fingerprint(text: str | None) -> bytes:
    return shared_walk().fingerprint(text)


def likeness(a: bytes, b: bytes) -> float:
    """Share of equal slots."""
    return int((np.frombuffer(a, dtype=np.uint8) == np.frombuffer(b, dtype=np.uint8)).sum()) / SLOTS


def edited(text: str, following: str) -> str:
    """text with its last quarter replaced by as many first characters (or all) of the following one."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare_edits(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> a row each of SCHEMA: its fingerprint, its edited text's, and likenesses to that and the next document's."""
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n = ranges(docs)
    placed = docs.withColumn("part", range_of(F.col("doc_id"), id_bounds(docs, n)))
    # the first document of each range goes to the range before it too, as the next one of that range's last
    order = F.coalesce("doc_id", F.lit(NULL_ID))
    heads = sorted(placed.groupBy("part").agg(F.min(order).alias("head")).collect())  # a row a range
    before = [(h["head"], heads[k - 1]["part"]) for k, h in enumerate(heads)]
    guests = small(docs.sparkSession.createDataFrame(before, "head long, guest_of int"))
    both = placed.withColumn("head", order).join(guests, "head", "left")
    spread = both.select("doc_id", "text", F.explode(F.when(F.col("guest_of").isNull(), F.array(F.struct("part", F.lit(0).alias("guest")))).otherwise(F.array(F.struct("part", F.lit(0).alias("guest")), F.struct(F.col("guest_of").alias("part"), F.lit(1).alias("guest"))))).alias("to")).select("doc_id", "text", "to.part", "to.guest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def pairs():
            held = None
            for b in batches:
                for doc, text, part, guest in zip(b.column("doc_id").to_pylist(), b.column("text"), b.column("part").to_pylist(), b.column("guest").to_pylist()):
                    now = (doc, text.as_py(), part, guest)
                    if held is not None and held[2] == part:
                        yield held, now[1]
                    held = None if guest else now
            # every range ends with a guest, so nothing is left over

        walk, own = shared_walk(), None

        def walked(text: str):
            mixed, codes = walk.read(text)
            left = walk.walk(codes)
            return text, mixed, codes, left, walk.sample(mixed, left)

        for (doc, text, _, _), following in pairs():
            own = own if own is not None and own[0] == text else walked(text)
            next_ = walked(following)
            # the edited text's walk is the text's own up to the edit
            kept, put = len(text) - len(text) // 4, min(len(text) // 4, len(following))
            left = np.concatenate([own[3][:kept], walk.walk(next_[2][:put], int(own[3][kept - 1]) if kept else 0)])
            changed = walk.sample(np.concatenate([own[1][:kept], next_[1][:put]]), left)
            digest = hashlib.sha256(edited(text, following).encode()).hexdigest()
            rows.append((doc, len(text), digest, own[4].hex(), changed.hex(), likeness(own[4], changed), likeness(own[4], next_[4])))
            own = next_
            if len(rows) == 512:
                yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*rows)))), schema=ARROW())
                rows = []
        if rows:
            yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*rows)))), schema=ARROW())

    return spread.repartition(n, "part").sortWithinPartitions("part", "guest", F.asc_nulls_first("doc_id"), "text").mapInArrow(run, SCHEMA)


def ARROW() -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
    return pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in SCHEMA.split(", ")])


def near_groups(docs: DataFrame, least: float = 0.8, bands: int = BANDS) -> DataFrame:
    """docs (doc_id, text) -> doc_id, fingerprint (hex), component_id: documents linked by likeness of at least least.

    Rows that repeat a doc_id are rows of their own; null texts share the empty walk's print; a null doc_id
    never names a component unless all its rows have null; an empty table gives no row.

    Bit-sampled banding: fingerprints equal in all slots of one of the bands are candidates, and
    each is verified.  Only distinct fingerprints are banded.  A bucket emits a spanning forest
    of its verified links; one above BUCKET members is compared in blocks of BUCKET, each pair of
    blocks a task of its own.
    """
    width = SLOTS // bands

    def prints(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([fingerprint(t.as_py()) for t in b.column("text")], pa.binary())], names=["doc_id", "fp"])

    own = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(prints, "doc_id long, fp binary"), "edit-prints")
    distinct = cut(own.groupBy("fp").agg(F.min("doc_id").alias("least")).withColumn("node", F.xxhash64("fp")), "edit-distinct")
    banded = distinct.select("node", "fp", F.explode(F.sequence(F.lit(0), F.lit(bands - 1))).alias("band"))
    banded = banded.select("node", "fp", F.xxhash64("band", F.expr(f"substring(fp, band * {width} + 1, {width})")).alias("key"))
    # keys are counted without the prints, which only those of shared keys need
    sizes = cut(banded.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "edit-sizes")
    held = banded.join(small(sizes), "key")
    blocks = F.ceil(F.col("n") / BUCKET).cast("int")
    mine = F.when(F.col("n") <= BUCKET, F.lit(0)).otherwise(F.pmod(F.hash("fp"), blocks))
    # block i meets every block j: the row goes to each pair (min, max) that holds its own block
    pairs = F.transform(F.sequence(F.lit(0), blocks - 1), lambda j: F.struct(F.least(j, mine).alias("x"), F.greatest(j, mine).alias("y")))
    sent = held.select("key", "node", "fp", F.explode(pairs).alias("p")).select("key", "p.x", "p.y", "node", "fp")

    def verify(batches):
        import itertools

        rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("key", "x", "y", "node", "fp"))))
        for _, group in itertools.groupby(rows, key=lambda r: r[:3]):
            got = list(group)
            if len(got) < 2:
                continue
            prints = np.frombuffer(b"".join(r[4] for r in got), dtype=np.uint8).reshape(-1, SLOTS)
            root, links = np.arange(len(got)), []
            for k in range(len(got) - 1):
                near = np.flatnonzero((prints[k + 1 :] == prints[k]).sum(axis=1) >= least * SLOTS) + k + 1
                for j in near[root[near] != root[k]]:
                    if root[j] != root[k]:
                        links.append((got[k][3], got[j][3]))
                        root[root == root[j]] = root[k]
            if links:
                a, b = zip(*links)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    links = sent.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y").mapInArrow(verify, "a long, b long")
    rooted = distinct.join(components(links, "edit-links"), "node", "left").select("fp", "least", F.coalesce("root", "node").alias("root"))
    rooted = cut(rooted, "edit-rooted")
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return own.join(named, "fp").select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")
