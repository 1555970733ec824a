"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources they're in).  A flow
goes from each pattern, at most REPEATS times its words and at a marginal cost that grows
with each repetition, through the sources that it's in, to the sources' quotas.  The flow
fixes how many words each pattern gives: whole rounds of all its documents, and a rest that
goes to documents in the order of a seeded hash; the document at the edge is taken in part.

The edge is found from a histogram of the hash (BUCKETS buckets a pattern), then within the
one bucket it lies in; each document then decides alone, by a plan of one row a pattern.
No source, however large, is sorted or gathered in one task.

Defined cases: null source is a source of its own, last in order; a text without words has
size 0 and is never taken; rows that repeat a doc_id at the edge share the rest by size;
an empty table gives no row.  The plan is bounded by PATTERNS, and more of them is an error.
"""

from __future__ import annotations

import json
from heapq import heappop, heappush

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridlineage.llm.common import NULL_ID, cut, small

REPEATS, SEED, WEIGHTS, BUCKETS, PATTERNS = 3, 17, (5, 2, 1), 4096, 50_000
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def order(source: str | None) -> tuple:
    return source is None, source or ""


def targets(sizes: dict, total: int, weights=WEIGHTS, most: int = REPEATS) -> dict:
    """Each source's share of total by weight, at most `most` times its size; excess is shared again by weight."""
    names = sorted(sizes, key=order)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    done: dict = {}
    while len(done) < len(names):
        left = [s for s in names if s not in done]
        rest, over = total - sum(done.values()), sum(weight[s] for s in left)
        share = {s: rest * weight[s] / over for s in left}
        full = [s for s in left if share[s] > most * sizes[s]]
        if not full:
            return {s: float(x) for s, x in (done | share).items()}
        done |= {s: float(most * sizes[s]) for s in full}
    return done


class Flow:
    """Min-cost flow by successive shortest paths with potentials (Dijkstra)."""

    def __init__(self, nodes: int):
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[int] = []
        self.cost: list[int] = []

    def add(self, a: int, b: int, room: int, cost: int) -> int:
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
            self.cost.append(c)
        return len(self.to) - 2

    def run(self, source: int, sink: int) -> int:
        n, sent = len(self.out), 0
        height = [0] * n
        while True:
            far, by, todo = [None] * n, [-1] * n, [(0, source)]
            far[source] = 0
            while todo:
                d, x = heappop(todo)
                if d > far[x]:
                    continue
                for e in self.out[x]:
                    y = self.to[e]
                    if self.room[e] and (far[y] is None or d + self.cost[e] + height[x] - height[y] < far[y]):
                        far[y] = d + self.cost[e] + height[x] - height[y]
                        by[y] = e
                        heappush(todo, (far[y], y))
            if far[sink] is None:
                return sent
            most = max(d for d in far if d is not None)
            for x in range(n):
                height[x] += most if far[x] is None else far[x]
            path, x = [], sink
            while x != source:
                path.append(by[x])
                x = self.to[by[x] ^ 1]
            step = min(self.room[e] for e in path)
            for e in path:
                self.room[e] -= step
                self.room[e ^ 1] += step
            sent += step


def route(patterns: dict[tuple, int], quotas: dict, most: int = REPEATS) -> dict[tuple, int]:
    """Words that each pattern (a tuple of sources) gives, of its size, to meet the quotas at least repetition cost."""
    sources, keys = sorted(quotas, key=order), list(patterns)
    flow = Flow(2 + len(keys) + len(sources))
    at = {s: 2 + len(keys) + k for k, s in enumerate(sources)}
    arcs = {}
    for k, p in enumerate(keys):
        arcs[p] = [flow.add(0, 2 + k, patterns[p], 2 * r + 1) for r in range(most)]  # sums to r * r
        for s in p:
            flow.add(2 + k, at[s], most * patterns[p], 0)
    for s in sources:
        flow.add(at[s], 1, int(quotas[s]), 0)
    flow.run(0, 1)
    return {p: sum(flow.room[e ^ 1] for e in arcs[p]) for p in keys}


def _facts(docs: DataFrame, sources: Column, text: str = "text") -> DataFrame:
    """docs with _size, _pattern (JSON of the sorted sources), _key (seeded hash), _id."""
    some = F.coalesce(F.array_sort(F.array_distinct(sources)), F.array(F.lit(None).cast("string")))
    return docs.withColumns({
        "_size": words(F.col(text)),
        "_pattern": F.to_json(F.when(F.size(some) > 0, some).otherwise(F.array(F.lit(None).cast("string")))),
        "_key": F.xxhash64(F.lit(SEED), F.col("doc_id").cast("long")),
        "_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)),
    })


_BUCKET = f"shiftrightunsigned(_key, {64 - BUCKETS.bit_length() + 1})"


def plan(facts: DataFrame) -> tuple[DataFrame, dict, dict]:
    """(a row a pattern: rounds and edge; sizes by source; targets by source) of facts (_size, _pattern, _key, _id)."""
    spark = facts.sparkSession
    rows = facts.groupBy("_pattern").agg(F.sum("_size").alias("n")).limit(PATTERNS + 1).collect()
    if len(rows) > PATTERNS:
        raise ValueError(f"more than {PATTERNS} patterns of sources")
    patterns = {r["_pattern"]: (tuple(json.loads(r["_pattern"])), r["n"]) for r in rows}
    sizes: dict = {}
    for p, n in patterns.values():
        for s in p:
            sizes[s] = sizes.get(s, 0) + n
    goals = targets(sizes, sum(n for _, n in patterns.values()))
    given = route({p: n for p, n in sorted(patterns.values(), key=lambda x: [order(s) for s in x[0]])}, goals)
    parts = [(k, given[p] // n if n else 0, given[p] % n if n else 0) for k, (p, n) in patterns.items()]
    rests = small(spark.createDataFrame(parts, "_pattern string, _rounds long, _rest long"))
    by = Window.partitionBy("_pattern").orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hist = facts.groupBy("_pattern", F.expr(_BUCKET).alias("_b")).agg(F.sum("_size").alias("n")).withColumn("upto", F.sum("n").over(by))
    edge = hist.join(rests, "_pattern").where("upto - n <= _rest AND _rest < upto").select("_pattern", "_b", (F.col("_rest") - F.col("upto") + F.col("n")).alias("left"))
    edge = small(cut(edge, "edge"))
    inside = facts.withColumn("_b", F.expr(_BUCKET)).join(edge, ["_pattern", "_b"]).groupBy("_pattern", "_b", "_key", "_id").agg(F.sum("_size").alias("n"), F.first("left").alias("left"))
    by = Window.partitionBy("_pattern", "_b").orderBy("_key", "_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = inside.withColumn("upto", F.sum("n").over(by)).where("upto - n <= left AND left < upto")
    found = found.select("_pattern", F.col("_b").alias("_eb"), F.col("_key").alias("_ek"), F.col("_id").alias("_ei"), (F.col("left") - F.col("upto") + F.col("n")).alias("_part"), F.col("n").alias("_edge_size"))
    return cut(rests.join(found, "_pattern", "left").drop("_rest"), "plan"), sizes, goals


def _taken() -> Column:
    b = f"({_BUCKET})"
    before = f"({b} < _eb OR ({b} = _eb AND (_key < _ek OR (_key = _ek AND _id < _ei))))"
    return F.expr(f"_rounds * _size + CASE WHEN _eb IS NULL THEN 0 WHEN {before} THEN _size WHEN _key = _ek AND _id = _ei THEN (_part * _size) DIV _edge_size ELSE 0 END")


def mix(docs: DataFrame, sources: Column | None = None) -> DataFrame:
    """docs (doc_id, text, source) -> doc_id, sources (JSON), size, source_size and target (of its first source), taken."""
    sources = F.array(F.col("source").cast("string")) if sources is None else sources
    facts = cut(_facts(docs, sources).select("doc_id", "_size", "_pattern", "_key", "_id"), "facts")
    rows, sizes, goals = plan(facts)
    named = docs.sparkSession.createDataFrame([(json.dumps([s], ensure_ascii=False, separators=(",", ":")), sizes[s], goals[s]) for s in sizes], "one string, source_size long, target double")
    first = F.to_json(F.array(F.element_at(F.from_json("_pattern", "array<string>"), 1)), {"ignoreNullFields": "false"})
    named = named.withColumn("one", F.to_json(F.from_json("one", "array<string>"), {"ignoreNullFields": "false"}))
    joined = facts.join(small(rows), "_pattern").withColumn("one", first).join(small(named), "one")
    return joined.select("doc_id", F.col("_pattern").alias("sources"), F.col("_size").alias("size"), "source_size", "target", _taken().cast("long").alias("taken"))


def take(docs: DataFrame, sources: Column | None = None) -> DataFrame:
    """The mix as documents: a row for each time a document is taken, the one at the edge cut after its last word taken."""
    sources = F.array(F.col("source").cast("string")) if sources is None else sources
    facts = cut(_facts(docs.select("doc_id", "text", "source"), sources).select("_size", "_pattern", "_key", "_id"), "facts")
    rows, _, _ = plan(facts)
    # the table's own columns travel in a struct, so that none can clash with a name used here
    whole = docs.select(F.struct("*").alias("_doc"), "doc_id", F.col("text").cast("string").alias("text"), sources.alias("_sources"))
    chosen = _facts(whole, F.col("_sources")).join(small(rows), "_pattern").withColumn("_taken", _taken().cast("long")).where("_taken > 0")
    each = chosen.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.ceil(F.col("_taken") / F.col("_size")).cast("int"))))
    left = F.col("_taken") - (F.col("_copy") - 1) * F.col("_size")
    blank = r"[\x20\x09-\x0D]"
    tail = F.expr(f"element_at(split(text, r'{blank}+', CAST(_taken - (_copy - 1) * _size AS INT) + 1 + CASE WHEN text RLIKE r'^{blank}' THEN 1 ELSE 0 END), -1)")
    short = F.regexp_replace(F.expr("left(text, length(text) - length(_tail))"), blank + r"+\z", "")
    part = left < F.col("_size")
    each = each.withColumn("_tail", F.when(part, tail)).withColumn("text", F.when(part, short).otherwise(F.col("text")))
    own = lambda c: F.col("_doc").getField(c)
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("_tail").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(own("n_chars"))
    return each.select(*(new.get(c, own(c)).alias(c) for c in docs.columns))
