"""Packing into windows by Karmarkar-Karp multiway differencing.

Documents go by a hash of their id into partitions; each is cut into groups of about
GROUP_TOKENS tokens as it streams.  In a group every piece starts as a partial partition
of k windows, one of them filled.  The two partial partitions of the largest imbalance
are merged with opposing imbalances (the fullest window with the emptiest), until one is
left with near-equal windows.  k starts at the fewest windows that could hold the group;
what a window holds above its capacity is cut off and moved into the room of others, for
which that many windows always have room.  Where pieces aren't to be cut, the count rises
until no window is above its capacity.  Documents of a window or more give full
windows first; what is left of them is a piece like any other.

Defined cases: a null or empty text is the end id alone; null and repeated doc_ids are
packed as rows of their own; an empty table gives no row; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlineage.llm.tokens import END_ID, encoder

WINDOW = 4096
#: Tokens, and documents, of a group that is packed at once: bounds memory, and one not quite full window a group.
GROUP_TOKENS, GROUP_DOCS = 512 * WINDOW, 1 << 17
#: Characters that one partition packs.
PARTITION_CHARS = 16_000_000


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """Karmarkar-Karp: the items of each of k parts, by multiway differencing."""
    if not sizes or k < 1:
        return [[] for _ in range(max(0, k))]
    left, right = [], []  # inner nodes of the trees of joined windows; leaves are items
    items = len(sizes)
    heap = []
    for i, s in enumerate(sizes):
        heap.append((-(s if k > 1 else 0), i, None, None))
    heapq.heapify(heap)

    def whole(entry):
        """(sums, nodes) of the windows, fullest first; an item takes no room for them until it's merged."""
        _, i, sums, nodes = entry
        if sums is None:
            sums, nodes = np.zeros(k, dtype=np.int64), np.full(k, -1, dtype=np.int64)
            sums[0], nodes[0] = sizes[i], i
        return sums, nodes

    serial = items
    while len(heap) > 1:
        (a, an), (b, bn) = whole(heapq.heappop(heap)), whole(heapq.heappop(heap))
        b, bn = b[::-1], bn[::-1]
        both = np.flatnonzero((an >= 0) & (bn >= 0))
        nodes = np.where(an >= 0, an, bn)
        if len(both):
            nodes[both] = items + len(left) + np.arange(len(both))
            left.extend(an[both].tolist())
            right.extend(bn[both].tolist())
        sums = a + b
        order = np.argsort(-sums, kind="stable")
        sums, nodes = sums[order], nodes[order]
        heapq.heappush(heap, (-int(sums[0] - sums[-1]), serial, sums, nodes))
        serial += 1
    parts = []
    for node in whole(heap[0])[1].tolist():
        part, todo = [], [node]
        while todo:
            n = todo.pop()
            if n >= items:
                todo += [left[n - items], right[n - items]]
            elif n >= 0:
                part.append(n)
        parts.append(sorted(part))
    return parts


def pack(sizes: list[int], window: int = WINDOW, cuts: bool = True) -> list[list[tuple[int, int, int]]]:
    """Windows of (document, start, length): each token of each size lies in one of them once; without cuts, pieces below a window stay whole."""
    out, rest, starts = [], [], []
    for d, n in enumerate(sizes):
        full = n // window * window
        out += [[(d, s, window)] for s in range(0, full, window)]
        if n > full:
            rest.append(d)
            starts.append(full)
    pieces = [sizes[d] - s for d, s in zip(rest, starts)]
    total = sum(pieces)
    k = -(-total // window)
    while pieces:
        parts = difference(pieces, k)
        loads = [sum(pieces[i] for i in p) for p in parts]
        if cuts or max(loads) <= window:
            break
        k += 1
    else:
        return out
    cut: list[tuple[int, int, int]] = []
    windows: list[list[tuple[int, int, int]]] = []
    for p, load in zip(parts, loads):
        held = [(rest[i], starts[i], pieces[i]) for i in p]
        while load > window:  # the tail of the longest piece moves on
            j = max(range(len(held)), key=lambda x: held[x][2])
            d, s, n = held[j]
            m = min(load - window, n - 1) if n > 1 else 1
            cut.append((d, s + n - m, m))
            held[j : j + 1] = [(d, s, n - m)] if n > m else []
            load -= m
        windows.append(held)
    for held in windows:
        room = window - sum(n for _, _, n in held)
        while room and cut:
            d, s, n = cut.pop()
            m = min(room, n)
            held.append((d, s, m))
            if n > m:
                cut.append((d, s + m, n - m))
            room -= m
    return out + [w for w in windows if w]


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def sequences(docs: DataFrame, window: int = WINDOW, vocabulary: str | None = None, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """docs (doc_id, text) -> a row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    end = np.array([END_ID], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = encoder(vocabulary)
        number = TaskContext.get().partitionId() << 40
        kept: list[tuple[int | None, bytes]] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal number, held
            rows = []
            for w in pack([len(i) // 4 for _, i in kept], window):
                offset = 0
                for d, s, n in w:
                    doc, ids = kept[d]
                    rows.append((doc, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)]), len(ids) // 4, number, offset))
                    offset += n
                number += 1
            kept.clear()
            held = 0
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=names)

        for b in batches:
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
                ids = enc.encode(text.as_py()) + end
                kept.append((doc, ids))
                held += len(ids) // 4
                if held >= group_tokens or len(kept) >= GROUP_DOCS:
                    yield flush()
        if kept:
            yield flush()

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    n = 1 + chars // PARTITION_CHARS
    # the text is in the key so that rows which share an id still spread
    return docs.repartition(n, F.xxhash64("doc_id", "text")).sortWithinPartitions("doc_id", "text").mapInArrow(run, SCHEMA)
