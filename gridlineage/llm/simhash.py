"""SimHash near duplicates by deletion-variant signatures.

A fingerprint is cut into two 32-bit segments.  Of at most three differing bits, one
segment holds at most one, so two linked fingerprints share a segment with one bit
left out: each fingerprint is indexed under its 64 one-wildcard segment variants, and
rows that are equal in a variant are compared.  Two segments of 64 bits are enough up
to three bits; the plain four-block scheme needs exact blocks of 16 bits and compares
far more pairs.

Only distinct fingerprints enter the index, so copies cost one row each.  A bucket emits
a spanning forest of its links, never its pairs.  A bucket above BUCKET fingerprints is
cut again, by one-wildcard variants of the other segment's halves: there at most 18 bits
are free, so distinct values bound the bucket, and all neighbours are looked up by mask.

Three bits reach almost equal texts only.  For a wider likeness `wide_links` takes fingerprints of
WORDS words: segments of SEGMENT bits, each indexed under its one-wildcard variants, equality
join, and up to RADIUS differing bits in all.  Two that differ so much need not share a variant,
so this is a search with a recall, not a bound; its caller verifies and finds the rest.

Defined cases: null, empty and white-space texts have fingerprint zero and are linked as
any other; equal texts share a component; rows that repeat a doc_id are told apart by text; a
null doc_id never names a component unless all its documents have null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlineage.llm.common import components, cut, release, small, without

BITS = 3
SHINGLE = 3
#: Fingerprints that one bucket compares at once; larger buckets are cut again, exactly.
BUCKET = 8192
#: Of a wide fingerprint: its words of 64 bits, the bits of a segment, and the bits that linked ones may differ in.
WORDS, SEGMENT, RADIUS = 2, 16, 32
#: Rows of a bucket that are compared by offsets, many buckets at once; larger ones are compared row by row.
AT_ONCE = 512


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """64-bit SimHash: bit set if set in over half the XXH64 (seed 42) hashes of the word shingles."""
    import xxhash

    # bytes.lower() and bytes.split() touch ASCII only, as the word contract asks
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    if len(words) < width:
        shingles = [b" ".join(words)]
    else:
        shingles = list(map(b" ".join, zip(*[words[k:] for k in range(width)])))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, [42] * len(shingles)), dtype="<u8", count=len(shingles))
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the uint64 hashes."""
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), 65536):
        ones += np.unpackbits(hashes[k : k + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def wide_fingerprint(hashes: np.ndarray) -> list[int]:
    """WORDS words of a SimHash: the bits of the hashes, then of their splitmix64 values, of those of these, and so on."""
    out = []
    for k in range(WORDS):
        if k:
            hashes = hashes + np.uint64(0x9E3779B97F4A7C15)
            hashes = (hashes ^ (hashes >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            hashes = (hashes ^ (hashes >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            hashes = hashes ^ (hashes >> np.uint64(31))
        out.append(majority(hashes))
    return out


def with_fingerprints(docs: DataFrame, column: str = "simhash") -> DataFrame:
    """docs (doc_id, text) -> (doc_id, mark, column): XXH64 of the text, the fingerprint as a long of the same bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = np.fromiter((fingerprint(t.as_py()) for t in b.column("text")), dtype=np.uint64, count=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("mark"), pa.array(got.view(np.int64))], names=["doc_id", "mark", column])

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text")).mapInArrow(run, f"doc_id long, mark long, {column} long")


def forest(values: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Spanning links of distinct uint64 values that differ in at most bits bits; compared in blocks."""
    root = np.arange(len(values))
    out = []
    for k in range(len(values) - 1):
        near = np.flatnonzero(np.bitwise_count(values[k + 1 :] ^ values[k]) <= bits) + k + 1
        for j in near[root[near] != root[k]]:
            if root[j] != root[k]:
                out.append((k, int(j)))
                root[root == root[j]] = root[k]
    return out


def masked_forest(values: np.ndarray, free: int, bits: int) -> list[tuple[int, int]]:
    """The same for any number of distinct values that differ only in the bits of the mask free (at most 20)."""
    places = [k for k in range(64) if free >> k & 1]
    if len(places) > 20:
        raise ValueError("too many free bits")
    packed = sum((((values >> np.uint64(p)) & np.uint64(1)) << np.uint64(k) for k, p in enumerate(places)), np.zeros(len(values), np.uint64))
    at = np.full(1 << len(places), -1, dtype=np.int64)
    at[packed] = np.arange(len(values))
    out = []
    for n in range(1, bits + 1):
        for some in combinations(range(len(places)), n):
            m = sum(1 << k for k in some)
            other = at[packed ^ np.uint64(m)]
            mine = np.flatnonzero(other > np.arange(len(values)))
            out.append(np.stack([mine, other[mine]]))
    pairs = np.concatenate(out, axis=1)
    from_, to = pairs
    return _stars(len(values), from_, to)


def _stars(n: int, from_: np.ndarray, to: np.ndarray) -> list[tuple[int, int]]:
    """Links of n nodes to the smallest one of their component."""
    label = np.arange(n)
    while True:  # labels fall to the smallest index of each component
        low = label.copy()
        np.minimum.at(low, from_, label[to])
        np.minimum.at(low, to, label[from_])
        low = low[low]
        if (low == label).all():
            return [(int(k), int(v)) for k, v in enumerate(label) if k != v]
        label = low


def _groups(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[int, np.ndarray, bool]]:
    """(key, values, whole) of rows sorted by key; a longer group comes in parts, marked as not whole."""
    key, kept, count, whole = None, [], 0, True
    for b in batches:
        keys, values = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
        if not len(keys):
            continue
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        for s, e in zip(starts, [*starts[1:], len(keys)]):
            if keys[s] != key:
                if count and (count > 1 or not whole):
                    yield key, np.concatenate(kept), whole
                key, kept, count, whole = keys[s], [], 0, True
            part = values[s:e]
            while count + len(part) > most:
                kept.append(part[: most - count])
                whole = False
                yield key, np.concatenate(kept), whole
                part, kept, count = part[most - count :], [], 0
            kept.append(part)
            count += len(part)
    if count and (count > 1 or not whole):
        yield key, np.concatenate(kept), whole


def _variants(prints: DataFrame) -> DataFrame:
    """(key, fp): 64 rows a fingerprint; the key holds segment, wildcard place and the segment without that bit."""
    v = prints.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i"))
    return v.select(F.expr("(CAST(i AS BIGINT) << 32) | ((CASE WHEN i < 32 THEN fp ELSE shiftrightunsigned(fp, 32) END) & 4294967295L & ~shiftleft(1L, i % 32))").alias("key"), "fp")


def _halves(hot: DataFrame) -> DataFrame:
    """Second cut: of the other segment's two 16-bit halves, one differs in at most one bit."""
    v = hot.select("key", "fp", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("j"))
    other = "(CASE WHEN shiftright(key, 32) < 32 THEN shiftrightunsigned(fp, 32) ELSE fp END)"
    return v.select("key", F.expr(f"(CAST(j AS BIGINT) << 16) | (shiftrightunsigned({other}, CASE WHEN j < 16 THEN 0 ELSE 16 END) & 65535L & ~shiftleft(1L, j % 16))").alias("key2"), "fp")


_EDGE = "key long, a long, b long"


def _edges(key: int, values: np.ndarray, links: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = np.array(links, dtype=np.int64).reshape(-1, 2).T
    signed = values.view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), key, dtype=np.int64)), pa.array(signed[a]), pa.array(signed[b])], names=["key", "a", "b"])


def links(prints: DataFrame, bits: int = BITS, bucket: int = BUCKET) -> DataFrame:
    """(a, b) of distinct fingerprints (fp long): links that span every component at up to bits <= 3 differing bits."""
    if not 0 <= bits <= 3:
        raise ValueError("two segments with one wildcard find up to three differing bits")

    def near(batches):
        for key, values, whole in _groups(batches, bucket):
            values = values.view(np.uint64)
            if whole:
                yield _edges(key, values, forest(values, bits))
            else:  # members of a bucket that is cut again: b is null
                signed = values.view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(signed), key, dtype=np.int64)), pa.array(signed), pa.nulls(len(signed), pa.int64())], names=["key", "a", "b"])

    spread = _variants(prints).repartition("key").sortWithinPartitions("key", "fp")
    first = cut(spread.mapInArrow(near, _EDGE), "links")
    hot = first.where("b IS NULL").select("key", F.col("a").alias("fp"))
    found = first.where("b IS NOT NULL").select("a", "b")
    if hot.limit(1).count():
        def again(batches):
            kept: dict = {}
            now = None
            for b in batches:
                k1, k2, fp = (b.column(n).to_numpy(zero_copy_only=False) for n in ("key", "key2", "fp"))
                for x, y, z in zip(k1.tolist(), k2.tolist(), fp.tolist()):
                    if (x, y) != now:
                        yield from bounded(now, kept)
                        now, kept = (x, y), []
                    kept.append(z)
            yield from bounded(now, kept)

        def bounded(now, kept):
            if now is None or len(kept) < 2:
                return
            values = np.array(kept, dtype=np.int64).view(np.uint64)
            free = 0
            i, j = now[0] >> 32, now[1] >> 16
            low = 0 if i < 32 else 32  # where the first segment lies
            free |= 1 << (low + i % 32)
            other, half = 32 - low, 0 if j < 16 else 16
            free |= 1 << (other + half + j % 16)
            free |= 0xFFFF << (other + 16 - half)
            yield _edges(now[0], values, forest(values, bits) if len(values) <= 512 else masked_forest(values, free, bits))

        more = _halves(hot).repartition("key", "key2").sortWithinPartitions("key", "key2", "fp").mapInArrow(again, _EDGE)
        found = found.union(more.select("a", "b"))
    return found


def _whole_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of rows sorted by the first, cut only where that changes."""
    kept: list = []
    for b in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        if not b.num_rows:
            continue
        last = int(np.searchsorted(cols[0], cols[0][-1]))
        if last or (kept and kept[-1][0][0] != cols[0][0]):
            kept.append([c[:last] for c in cols])
            yield [np.concatenate(c) for c in zip(*kept)]
            kept = []
        kept.append([c[last:] for c in cols])
    if kept:
        yield [np.concatenate(c) for c in zip(*kept)]


def bucket_links(keys: np.ndarray, sizes: np.ndarray, near: Callable[[np.ndarray, np.ndarray], np.ndarray], most: int = AT_ONCE) -> list[tuple[int, int]]:
    """Links that span what is near within each run of equal keys, of sizes up to 5/4 of the smaller; near(i, j) tells which pairs of rows are.

    keys are below 2 ** 31; rows come sorted by key and size, so a row meets only those that follow it up to its reach.
    """
    rows = np.arange(len(keys))
    sizes = sizes.astype(np.int64)
    reach = np.searchsorted((keys << 32) | sizes, (keys << 32) | (5 * sizes // 4), side="right")
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    ends = np.append(starts[1:], len(keys))
    hot = np.maximum.reduceat(reach - rows, starts) > most
    links = []
    for s, e in zip(starts[hot].tolist(), ends[hot].tolist()):
        root = np.arange(s, e)
        for k in range(s, e - 1):
            others = np.flatnonzero(root[k - s + 1 : reach[k] - s] != root[k - s]) + k + 1
            others = others[near(np.full(len(others), k), others)]
            if len(others):
                met, first = np.unique(root[others - s], return_index=True)
                links.extend((k, j) for j in others[first].tolist())
                root[np.isin(root, met)] = root[k - s]
    i = rows[~np.repeat(hot, ends - starts)]
    found, step = [], 0
    while len(i):
        step += 1
        i = i[i + step < reach[i]]
        hit = i[near(i, i + step)]
        found.append(np.stack([hit, hit + step]))
    if found:
        links.extend(_stars(len(keys), *np.concatenate(found, axis=1)))
    return links


def wide_links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """prints (print, size, w0, w1, ...: longs) -> (a, b): links that span, in each bucket, the prints up to radius bits apart, of sizes up to 5/4 of the smaller."""
    words = [f"w{k}" for k in range(WORDS)]
    each = 64 // SEGMENT
    # i is the wildcard's place in the whole fingerprint; the key holds it and its segment without that bit
    word = "CASE " + " ".join(f"WHEN i < {64 * (k + 1)} THEN {w}" for k, w in enumerate(words)) + " END"
    key = f"(CAST(i AS BIGINT) << {SEGMENT}) | (shiftrightunsigned({word}, CAST({SEGMENT} * ((i DIV {SEGMENT}) % {each}) AS INT)) & {(1 << SEGMENT) - 1}L & ~shiftleft(1L, i % {SEGMENT}))"
    variants = prints.select("print", F.col("size").cast("int").alias("size"), *words, F.explode(F.sequence(F.lit(0), F.lit(64 * WORDS - 1))).alias("i")).select(F.expr(key).alias("key"), "size", "print", *words)

    def near(batches):
        for keys, sizes, ids, *held in _whole_runs(batches):
            held = [w.view(np.uint64) for w in held]
            if links := bucket_links(keys, sizes, lambda i, j: sum(np.bitwise_count(w[i] ^ w[j]).astype(np.int64) for w in held) <= radius):
                a, b = np.array(links, dtype=np.int64).T
                yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b])], names=["a", "b"])
        release()

    return variants.repartition("key").sortWithinPartitions("key", "size").mapInArrow(near, "a long, b long")


def near_groups(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """docs (doc_id, text, ...) -> (doc_id, mark, simhash long, component_id long), a row each; see the module."""
    prints = cut(with_fingerprints(docs), "prints")
    distinct = prints.groupBy(F.col("simhash").alias("fp")).agg(F.min("doc_id").alias("least"))
    distinct = cut(distinct, "distinct")
    roots = components(links(distinct.select("fp"), bits))
    rooted = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = cut(rooted, "rooted")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = cut(rooted.join(least, "root").select(F.col("fp").alias("simhash"), "component_id"), "named")
    return prints.join(small(named), "simhash").select("doc_id", "mark", "simhash", "component_id")


def one_of_each(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """docs without those that are in another document's component; rows with a null doc_id stay. Columns as given."""
    return without(docs, near_groups(docs, bits).where("doc_id <> component_id"))
