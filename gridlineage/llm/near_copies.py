"""Near copies by exact Jaccard similarity of five-word shingles, 0.8 or more.

A document is the set of the XXH64 (seed 42) hashes of its shingles.  Equal sets are one
print.  Candidates come first from SimHash: the sets' wide fingerprints, indexed under the
one-wildcard variants of their segments (`simhash.wide_links`).  An exact check of their
components leaves groups of true links.  What lies beyond SimHash's reach is found by a second
index, which is exact: only components of its candidates that join different groups are checked.

Two sets of that similarity share one of their first L - ceil(0.8 L) + 1 shingles in
any common order, so each print is indexed under these, those that a sample holds most often
last.  Prints that share an index entry are candidates unless their sizes, or the counts of
their shingles in SLOTS slots, already rule the similarity out.  Of a large set only the shingles
of some hash bits are counted, by a bound that a pair exceeds with a chance of e ** -ODDS.  The
components of candidates hold every component of true links whole, so each is settled by exact
overlaps: in one place, or where its sets take more than BLOCK bytes, in blocks, each pair of
blocks a task of its own.  A bucket emits a spanning forest of its candidates, never its pairs.

A similarity of 0.8 differs in about 15 % of a fingerprint's bits, so op3's three bits of 64
can't reach it: a segment of 16 bits has at most one of them in 28 % of such pairs, one of eight
in 93 %.  Sets of fewer than four shingles have no partner but their equals.

Defined cases: words are those of op3's contract; a text of fewer than five words is one
shingle; null, empty and white-space texts have no shingle and are copies of each other; rows
that repeat a doc_id are told apart by their text; rows with a null doc_id stay; a table may be
empty, and other columns are kept as they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlineage.llm import simhash
from gridlineage.llm.common import components, cut, release, sample, small, without

SHINGLE = 5
#: Slots of the counts that rule candidates out, in the index (two bits each) and where a component is settled.
SLOTS, WIDE = 128, 1024
#: Shingles that are counted of a large set, at least; and the chance, as a logarithm, to lose a pair by that.
COUNTED, ODDS = 75, 28.0
#: Bytes of sets and their counts in a block of a component, two of which are compared at once; and of a run, after which memory is given back.
BLOCK, LARGE = 24 << 20, 8 << 20
#: Rows of a batch of the index, sets that are compared with one at once, and pairs that are remembered as compared.
ROWS, AT_ONCE, REMEMBERED = 20_000, 1024, 1_000_000
#: Documents whose shingles are counted for the order, and shingles that it puts last; they change the work, not the result.
SAMPLE, COMMON = 5000, 50_000


def shingles(text: str | None) -> np.ndarray:
    """Distinct shingle hashes, ascending."""
    import xxhash

    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros(0, dtype=np.uint64)
    parts = [b" ".join(words)] if len(words) < SHINGLE else list(map(b" ".join, zip(*[words[k:] for k in range(SHINGLE)])))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, parts, [42] * len(parts)), dtype=np.uint64, count=len(parts)))


def print_of(own: np.ndarray) -> int:
    """A long that names the set."""
    import xxhash

    return int(np.array(xxhash.xxh64_intdigest(own.tobytes(), 42), dtype=np.uint64).view(np.int64))


def prefix(own: np.ndarray, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The shingles that own is indexed under; common is ascending, counts are its counts in the sample."""
    n = len(own) - -(-4 * len(own) // 5) + 1
    seen = np.zeros(len(own), dtype=np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, own), len(common) - 1)
        seen = np.where(common[at] == own, counts[at], 0)
    return own[np.lexsort((own, seen))[:n]]


def slots(own: np.ndarray, n: int, most: int = 255) -> np.ndarray:
    """Shingles in each slot, so many at most: two sets differ in at least the sum of the differences."""
    return np.minimum(np.bincount((own % np.uint64(n)).astype(np.int64), minlength=n), most).astype(np.uint8)


def level(sizes: np.ndarray) -> np.ndarray:
    """How often a set is halved, by a bit of its hashes each time, to count COUNTED to twice as many."""
    return np.floor(np.log2(np.maximum(sizes, COUNTED) / COUNTED)).astype(np.int64)


def sketch(own: np.ndarray) -> bytes:
    """Slot counts at the set's level, four to a byte; and at the next one, where a set of the similarity can be of that."""
    first, next_ = level(np.array([len(own), 5 * len(own) // 4])).tolist()
    out = b""
    for k in range(first, next_ + 1):
        part = own[(own >> np.uint64(7)) & np.uint64((1 << k) - 1) == 0]  # the low 7 bits choose the slot
        out += (slots(part, SLOTS, 3).reshape(-1, 4) << np.arange(0, 8, 2, dtype=np.uint8)).sum(axis=1, dtype=np.uint8).tobytes()
    return out


def unpacked(sketches: list[bytes]) -> np.ndarray:
    """Slot counts of both levels, a row a sketch; zeros for a level that it doesn't have."""
    held = np.frombuffer(b"".join(x.ljust(SLOTS // 2, b"\0") for x in sketches), dtype=np.uint8)
    return ((held[:, None] >> np.arange(0, 8, 2, dtype=np.uint8)) & 3).reshape(len(sketches), 2 * SLOTS)


def _forest(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Spanning links of n nodes; near(k, others) are those of others that k is linked to."""
    root = np.arange(n)
    out = []
    for k in range(n - 1):
        others = np.flatnonzero(root[k + 1 :] != root[k]) + k + 1
        if len(others):
            for j in near(k, others):
                if root[j] != root[k]:
                    out.append((k, int(j)))
                    root[root == root[j]] = root[k]
    return out


def candidates(sizes: np.ndarray, counts: np.ndarray) -> list[tuple[int, int]]:
    """Spanning links of the prints that sizes and sketches don't rule out."""
    levels = level(sizes)

    def near(k: int, others: np.ndarray) -> np.ndarray:
        s = sizes[others]
        others = others[sizes_fit(s, sizes[k])]
        theirs, own = levels[others], levels[k]
        # sizes this close are at most a level apart: the higher one counts
        a = np.where((theirs > own)[:, None], counts[k, SLOTS:], counts[k, :SLOTS]).astype(np.int16)
        b = np.where((theirs < own)[:, None], counts[others, SLOTS:], counts[others, :SLOTS]).astype(np.int16)
        apart = np.abs(a - b).sum(axis=1, dtype=np.int64)
        most, at = (sizes[others] + sizes[k]) / 9, np.maximum(theirs, own)
        mean = most * 0.5**at  # Bernstein's bound on what of them has those bits
        least = np.where(at == 0, most, mean + ODDS / 3 + np.sqrt((ODDS / 3) ** 2 + 2 * ODDS * mean))
        return others[apart <= least + 1e-6]

    return _forest(len(sizes), near)


def sizes_fit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes can have the similarity."""
    return 4 * np.maximum(a, b) <= 5 * np.minimum(a, b)


def true_links(sets: list[np.ndarray], common: np.ndarray, counts: np.ndarray, groups: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Spanning links of the ascending sets of similarity 0.8 or more, by exact overlaps of those that share an index entry.

    Sets of an equal value in groups are linked already.
    """
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    fine = np.stack([slots(s, WIDE) for s in sets])
    starts = [prefix(s, common, counts) for s in sets]
    keys, docs = np.concatenate(starts), np.repeat(np.arange(len(sets)), [len(x) for x in starts])
    del starts
    order = np.argsort(keys, kind="stable")
    keys, docs = keys[order], docs[order]
    cuts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
    root = np.arange(len(sets)) if groups is None else np.unique(groups, return_inverse=True)[1]
    out, seen = [], set()

    def close(k: int, others: np.ndarray) -> Iterator[int]:
        for at in range(0, len(others), AT_ONCE):
            some = others[at : at + AT_ONCE]
            some = some[root[some] != root[k]]
            apart = np.abs(fine[some].astype(np.int16) - fine[k].astype(np.int16)).sum(axis=1, dtype=np.int64)
            yield from some[9 * apart <= sizes[some] + sizes[k]]

    for r in np.flatnonzero(np.diff(cuts) > 1):
        run = docs[cuts[r] : cuts[r + 1]]
        for at, k in enumerate(run[:-1]):
            others = run[at + 1 :]
            others = others[root[others] != root[k]]
            s = sizes[others]
            others = others[sizes_fit(s, sizes[k])]
            for j in close(k, others):
                if root[j] != root[k] and (pair := int(k) * len(sets) + int(j)) not in seen:
                    if len(seen) == REMEMBERED:  # comparing again changes nothing
                        seen.clear()
                    seen.add(pair)
                    place = np.minimum(np.searchsorted(sets[j], sets[k]), sizes[j] - 1)
                    if 9 * np.count_nonzero(sets[j][place] == sets[k]) >= 4 * (sizes[j] + sizes[k]):
                        out.append((int(k), int(j)))
                        root[root == root[j]] = root[k]
    return out


def _runs(batches: Iterator[pa.RecordBatch], keys: int = 1) -> Iterator[list[pa.RecordBatch]]:
    """Slices of each key of at least two rows; rows come sorted by their first columns, which are the key."""
    key, kept = None, []
    for b in batches:
        own = np.stack([b.column(k).to_numpy(zero_copy_only=False) for k in range(keys)], axis=1)
        if not len(own):
            continue
        starts = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]).any(axis=1)]))
        ends = np.append(starts[1:], len(own))
        # single rows in the middle of a batch have no partner
        use = np.flatnonzero((ends - starts > 1) | (starts == 0) | (ends == len(own)))
        for s, e in zip(starts[use].tolist(), ends[use].tolist()):
            if not kept or (own[s] != key).any():
                if sum(len(x) for x in kept) > 1:
                    yield kept
                key, kept = own[s], []
            kept.append(b.slice(s, e - s))
    if sum(len(x) for x in kept) > 1:
        yield kept


def _column(run: list[pa.RecordBatch], n: int) -> np.ndarray:
    return np.concatenate([b.column(n).to_numpy(zero_copy_only=False) for b in run])


_LINK = "a long, b long"


def _links(prints: np.ndarray, links: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = np.array(links, dtype=np.int64).reshape(-1, 2).T
    return pa.RecordBatch.from_arrays([pa.array(prints[a]), pa.array(prints[b])], names=["a", "b"])


def _with_prints(docs: DataFrame, sets: bool = False) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, mark, print, size), with the wide fingerprint w0, w1, ..., or the set as bytes if asked for."""
    more = ["own"] if sets else [f"w{k}" for k in range(simhash.WORDS)]

    def run(batches):
        for b in batches:
            own = [shingles(t.as_py()) for t in b.column("text")]
            cols = [b.column("doc_id"), b.column("mark"), pa.array([print_of(s) for s in own], pa.int64()), pa.array([len(s) for s in own], pa.int64())]
            if sets:
                cols.append(pa.array([s.tobytes() for s in own], pa.binary()))
            else:
                words = np.array([simhash.wide_fingerprint(s) for s in own], dtype=np.uint64).reshape(len(own), -1)
                cols += [pa.array(np.ascontiguousarray(words[:, k]).view(np.int64)) for k in range(len(more))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "mark", "print", "size", *more])
        release()

    return _plain(docs).mapInArrow(run, "doc_id long, mark long, print long, size long, " + ("own binary" if sets else ", ".join(f"{w} long" for w in more)))


def _plain(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))


def _common(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes, ascending; counts) of those that come three times or more in the sample, COMMON at most."""

    def run(batches):
        for b in batches:
            for t in b.column("text"):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(t.as_py()).view(np.int64))], names=["h"])

    counted = sample(_plain(docs), "doc_id", SAMPLE).mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("n"))
    got = counted.where("n > 2").orderBy(F.desc("n"), "h").limit(COMMON).collect()
    h = np.array([r["h"] for r in got], dtype=np.int64).view(np.uint64)
    order = np.argsort(h)
    return h[order], np.array([r["n"] for r in got], dtype=np.int64)[order]


def near_groups(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) -> (doc_id, mark, component_id long), a row each; mark is the XXH64 of the text; see the module."""
    common, counts = _common(docs)

    def entries(texts):
        """(index keys, print, size, sketch) of each text; a long text comes in parts."""
        for t in texts:
            own = shingles(t.as_py())
            if len(own):
                p, named, counted = prefix(own, common, counts).view(np.int64), print_of(own), sketch(own)
                for at in range(0, len(p), ROWS):
                    yield p[at : at + ROWS], named, len(own), counted

    def index(batches):
        def batch(held):
            each = [len(h[0]) for h in held]
            slots_of = pa.array([h[3] for h in held], pa.binary()).take(pa.array(np.repeat(np.arange(len(held)), each)))
            named, sizes = (np.repeat(np.array([h[k] for h in held], dtype=d), each) for k, d in ((1, np.int64), (2, np.int32)))
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([h[0] for h in held])), pa.array(named), pa.array(sizes), slots_of], names=["key", "print", "size", "slots"])

        for b in batches:
            held, n = [], 0
            for e in entries(b.column("text")):
                held.append(e)
                n += len(e[0])
                if n >= ROWS:
                    yield batch(held)
                    held, n = [], 0
            if held:
                yield batch(held)
        release()

    def candidate(batches):
        for run in _runs(batches, 1):
            ids, first = np.unique(_column(run, 1), return_index=True)
            held = [x for b in run for x in b.column(3).to_pylist()]
            if len(ids) > 1 and (links := candidates(_column(run, 2).astype(np.int64)[first], unpacked([held[k] for k in first]))):
                yield _links(ids, links)
        release()

    def settle(batches):
        for run in _runs(batches, 3):
            ids, first = np.unique(_column(run, 3), return_index=True)
            groups = _column(run, 4)[first]
            own = [x for b in run for x in b.column(5)]
            sets = [np.frombuffer(own[k].as_buffer(), dtype=np.uint64) for k in first]
            del own
            links = true_links(sets, common, counts, groups)
            large = 8 * sum(map(len, sets)) > LARGE
            del sets
            if links:
                yield _links(ids, links)
            if large:
                run.clear()
                release()
        release()

    def settled(links, groups=None):
        """True links of the prints in components of links, between different groups (print, group)."""
        coarse = components(cut(links, "candidates"))
        coarse = cut(coarse.union(coarse.select(F.col("root").alias("node"), "root")).distinct(), "coarse")
        placed = coarse.join(distinct, coarse["node"] == distinct["print"]).select("root", "print", (8 * F.col("size") + WIDE).alias("bytes"))
        placed = placed.withColumn("group", F.col("print")) if groups is None else placed.join(small(groups), "print", "left").withColumn("group", F.coalesce("group", "print"))
        placed = cut(placed.select("root", "print", "group", "bytes"), "placed")
        blocks = placed.groupBy("root").agg(F.ceil(F.sum("bytes") / BLOCK).cast("int").alias("blocks"), F.min("group").alias("low"), F.max("group").alias("high")).where("low <> high")
        mine = F.pmod(F.hash("print"), "blocks")
        wanted = cut(placed.join(blocks, "root").select("root", F.col("print").alias("_print"), "group", "blocks", mine.alias("mine")), "wanted")
        # block i meets every other block j; the one block of a small component meets itself
        pairs = F.when(F.col("blocks") == 1, F.array(F.struct(F.lit(0).alias("x"), F.lit(0).alias("y")))).otherwise(
            F.transform(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: j != F.col("mine")), lambda j: F.struct(F.least(j, "mine").alias("x"), F.greatest(j, "mine").alias("y")))
        )
        sets = _with_prints(rest, sets=True)
        sets = sets.join(small(wanted), sets["print"] == F.col("_print")).select("root", F.explode(pairs).alias("p"), "print", "group", "own").select("root", "p.x", "p.y", "print", "group", "own")
        return cut(sets.repartition("root", "x", "y").sortWithinPartitions("root", "x", "y").mapInArrow(settle, _LINK), "true")

    prints = cut(_with_prints(docs), "prints")
    words = [f"w{k}" for k in range(simhash.WORDS)]
    distinct = cut(prints.groupBy("print").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("size", *words)]), "distinct")
    rest = _plain(docs)
    # copies of a set needn't be indexed: its least document stands for it
    copies = cut(prints.join(distinct.where("n > 1"), "print").where("doc_id <> least").select(F.col("doc_id").alias("_copy"), F.col("mark").alias("_mark")).distinct(), "copies")
    rest = rest.join(small(copies), (rest["doc_id"] == F.col("_copy")) & (rest["mark"] == F.col("_mark")), "left_anti")
    close = settled(simhash.wide_links(distinct.where(F.col("size") >= SHINGLE - 1)))
    groups = components(close)
    groups = cut(groups.union(groups.select("root", "root")).distinct().toDF("print", "group"), "groups")
    spread = rest.mapInArrow(index, "key long, print long, size int, slots binary").repartition("key").sortWithinPartitions("key")
    true = close.union(settled(spread.mapInArrow(candidate, _LINK), groups))
    roots = components(true)
    rooted = cut(distinct.join(roots, distinct["print"] == roots["node"], "left").select("print", "least", F.coalesce("root", "print").alias("root")), "rooted")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = cut(rooted.join(least, "root").select("print", "component_id"), "named")
    return prints.join(small(named), "print").select("doc_id", "mark", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs without those that are in another document's component; rows with a null doc_id stay. Columns as given."""
    return without(docs, near_groups(docs).where("doc_id <> component_id"))
