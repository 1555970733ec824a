"""Merges to a fixpoint, overlay folds and macro projects on small cases."""

import json
import struct

import pytest

from gridlineage.operators import grouping, lookup, overlay
from gridlineage.sources import vba_project


def test_boxes_merge_to_a_fixpoint(spark):
    rows = [(1, 1, 1, 5, 1), (1, 6, 1, 9, 1), (1, 4, 1, 7, 1), (1, 1, 3, 2, 3), (1, 1, 4, 2, 4), (2, 1, 1, 1, 1), (2, 3, 1, 3, 1)]
    got = grouping.merge_boxes(spark.createDataFrame(rows, "sheet_id long, r1 long, c1 long, r2 long, c2 long")).collect()
    assert sorted(map(tuple, got)) == [(1, 1, 1, 9, 1), (1, 1, 3, 2, 4), (2, 1, 1, 1, 1), (2, 3, 1, 3, 1)]


EVENTS = [
    (1, 1, "set_label", "a", "A"), (1, 2, "set_label", "b", "B"), (1, 3, "merge_bindings", "a", json.dumps(["b"])), (1, 4, "set_reconciliation_flag", "a", "required"),
    (1, 5, "split_binding", "a", json.dumps(["c", "d"])), (1, 6, "set_label", "c", "C"), (1, 7, "disable_binding", "d", None), (1, 8, "set_orphan_status", "c", "true"),
]


def test_overlay_fold(spark):
    df = spark.createDataFrame(EVENTS, "overlay int, id int, action string, binding string, value string").repartition(3)
    got = {r["binding"]: r for r in overlay.fold(df).collect()}
    assert [b for b, r in got.items() if r["active"]] == ["c"] and got["c"]["label"] == "C" and got["c"]["orphan"] and got["c"]["flag"] == "required"
    assert got["a"]["members"] == ["a", "b"] and overlay.gaps(df).count() == 0
    bad = df.union(spark.createDataFrame([(1, 9, "disable_binding", "zz", None)], df.schema))
    assert overlay.fold(bad, strict=False).count() == 4
    with pytest.raises(Exception, match="isn't active"):
        overlay.fold(bad).collect()


def test_match_stops_at_the_first_element_beyond(spark):
    array = [5.0, 7.0, 3.0, 9.0, 8.0, 20.0, 1.0]
    values = [0.0, 5.0, 6.0, 7.0, 8.5, 9.0, 19.0, 30.0]
    a = spark.createDataFrame(list(enumerate(array, 1)), "pos int, v double")
    got = {r["value"]: r["pos"] for r in lookup.match_approximate(spark.createDataFrame([(v,) for v in values], "value double"), a, 1).collect()}
    for v in values:
        want = None
        for k, x in enumerate(array, 1):
            if x > v:
                break
            want = k
        assert got[v] == want


def compound(streams: dict[str, bytes]) -> bytes:
    """A compound file with one storage, VBA, of streams padded past the mini stream's limit."""
    padded = {k: v + b"\0" * (4096 - len(v)) if len(v) < 4096 else v for k, v in streams.items()}
    names = list(padded)
    entries = [("Root Entry", 5, 1, 0xFFFFFFFE, 0), ("VBA", 1, 2, 0, 0)]
    at, fat, body = 3, [0xFFFFFFFD, 2, 0xFFFFFFFE], b""
    for n in names:
        count = -(-len(padded[n]) // 512)
        entries.append((n, 2, 0xFFFFFFFF, at, len(padded[n])))
        fat += [*range(at + 1, at + count), 0xFFFFFFFE]
        body += padded[n].ljust(512 * count, b"\0")
        at += count
    directory = b""
    for k, (name, kind, child, start, size) in enumerate(entries):
        raw = (name + "\0").encode("utf-16-le")
        right = k + 1 if kind == 2 and k + 1 < len(entries) else 0xFFFFFFFF
        directory += raw.ljust(64, b"\0") + struct.pack("<HBBIII", len(raw), kind, 1, 0xFFFFFFFF, right, child) + b"\0" * 36 + struct.pack("<IQ", start, size)
    assert len(directory) <= 1024 and len(fat) <= 128
    head = bytes.fromhex("D0CF11E0A1B11AE1") + b"\0" * 16 + struct.pack("<HHHHH", 62, 3, 0xFFFE, 9, 6) + b"\0" * 6 + struct.pack("<IIIIIIIII", 0, 1, 1, 0, 4096, 0xFFFFFFFE, 0, 0xFFFFFFFE, 0)
    head += struct.pack("<109I", 0, *[0xFFFFFFFF] * 108)
    return head + struct.pack("<128I", *fat, *[0xFFFFFFFF] * (128 - len(fat))) + directory.ljust(1024, b"\0") + body


def test_macro_project(tmp_path):
    import io
    import zipfile

    source = b'Attribute VB_Name = "M"\r\nSub Go()\r\nEnd Sub\r\n'
    record = lambda kind, data: struct.pack("<HI", kind, len(data)) + data
    version = struct.pack("<HI", 9, 4) + b"\0" * 6
    listing = record(3, struct.pack("<H", 1252)) + version + record(0x19, b"M") + record(0x1A, b"M") + record(0x31, struct.pack("<I", 10)) + record(0x21, b"") + record(0x2B, b"")
    book = io.BytesIO()
    with zipfile.ZipFile(book, "w") as z:
        z.writestr("xl/vbaProject.bin", compound({"dir": vba_project.compress_literals(listing), "M": b"x" * 10 + vba_project.compress_literals(source)}))
    (name, kind, text), = vba_project.extract(book.getvalue())
    assert (name, kind) == ("M", "standard") and text.startswith(source.decode())


def test_decompression_of_copies():
    # literals "abcd", then a copy of eight from four back; the offset takes four bits
    token = (4 - 1) << 12 | (8 - 3)
    body = bytes([0b00010000]) + b"abcd" + struct.pack("<H", token)
    data = b"\x01" + struct.pack("<H", 0xB000 | (len(body) - 1)) + body
    assert vba_project.decompress(data) == b"abcdabcdabcd"


def test_range_join_of_all_heights(spark):
    import random

    from gridlineage.operators import grid

    rng = random.Random(3)
    cells = [(s, rng.randint(1, 3000), rng.randint(1, 5)) for s in (1, 2) for _ in range(400)]
    rects = [(s, k, r, 1, r + h - 1, rng.randint(1, 5)) for k, h in enumerate([1, 2, 3, 4, 5, 7, 8, 9, 64, 100, 1024, 3000, 1 << 20] * 3) for s in (1, 2) for r in [rng.randint(1, 2500)]]
    got = grid.in_rectangles(spark.createDataFrame(cells, "sheet_id int, row int, col int"), spark.createDataFrame(rects, "sheet_id int, id int, r1 int, c1 int, r2 int, c2 int"))
    want = sorted((s, y, x, k) for s, y, x in cells for t, k, r1, c1, r2, c2 in rects if s == t and r1 <= y <= r2 and c1 <= x <= c2)
    assert sorted((r["sheet_id"], r["row"], r["col"], r["id"]) for r in got.collect()) == want


def test_components_of_cycles_by_colouring(spark):
    from gridlineage.operators import graph

    edges = [(k, k % 5 + 1) for k in range(1, 6)] + [(10, 11), (11, 12), (12, 10), (12, 13), (13, 14), (14, 13), (5, 10), (20, 20), (30, 31), (31, 32), (14, 40), (41, 1)]
    got = {r["node"]: r["cycle"] for r in graph.cycles(spark.createDataFrame(edges, "src int, dst int")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 10: 10, 11: 10, 12: 10, 13: 13, 14: 13, 20: 20}
    chain = spark.range(9).selectExpr("cast(id AS int) AS src", "cast(id + 1 AS int) AS dst")
    nodes = spark.range(10).selectExpr("cast(id AS int) AS node")
    assert {r["node"]: r["level"] for r in graph.levels(chain, nodes).collect()} == {k: 9 - k for k in range(10)}
    assert graph.reachable(chain, nodes.where("node = 3")).count() == 6


@pytest.mark.parametrize("order", [1, -1])
def test_approximate_match_keeps_arrays_apart(spark, order):
    import random

    from gridlineage.operators import lookup

    rng = random.Random(order)
    arrays = {k: [float(rng.randint(0, 20)) for _ in range(rng.randint(1, 12))] for k in "abc"}
    array = spark.createDataFrame([(k, p, v) for k, vs in arrays.items() for p, v in enumerate(vs, 1)], "sheet string, pos int, v double")
    values = spark.createDataFrame([(k, float(x)) for k in arrays for x in range(-1, 22)], "sheet string, value double")
    want = {}
    for k, vs in arrays.items():
        for x in range(-1, 22):
            stop = next((p for p, v in enumerate(vs) if (v > x if order > 0 else v < x)), len(vs))
            want[k, float(x)] = stop or None
    assert {(r["sheet"], r["value"]): r["pos"] for r in lookup.match_approximate(values, array, order, ("sheet",)).collect()} == want


def test_similar_pairs_are_those_of_all_pairs(spark):
    import random

    from gridlineage.operators import vba

    rng = random.Random(4)
    word = lambda: f"w{min(rng.randint(0, 60), rng.randint(0, 60))}"
    base = [[word() for _ in range(rng.randint(0, 12))] for _ in range(30)]
    near = lambda: [w if rng.random() < 0.9 else word() for w in rng.choice(base)]
    x, y = ([(rng.choice("mn"), f"{side}{k // 2}", "sub", near()) for k in range(120)] for side in "ab")
    x.append(x[0])
    got = vba.similar_pairs(spark.createDataFrame(x, "module_a string, name_a string, kind string, ta array<string>"), spark.createDataFrame(y, "module_b string, name_b string, kind_b string, tb array<string>"), ("module_a", "module_b"), 0.7)
    want = sorted((a[1], b[1], a[3], b[3]) for a in x for b in y if a[0] == b[0] and set(a[3]) | set(b[3]) and len(set(a[3]) & set(b[3])) / len(set(a[3]) | set(b[3])) >= 0.7)
    assert sorted(p for r in got.collect() for p in [(r["name_a"], r["name_b"], r["ta"], r["tb"])] * (r["ma"] * r["mb"])) == want
    # all pairs of one module would be 4e7
    many = spark.range(6_400).selectExpr("'m' AS module", "concat('p', id) AS name", "'sub' AS kind", "transform(sequence(1, 30), i -> concat('t', id * 100 + i)) AS tokens")
    assert vba.match_procedures(many, many.selectExpr("module", "concat('q', name) AS name", "kind", "tokens")).count() == 6_400


def test_a_close_runner_up_hinders_no_rename_but_a_tie_does(spark):
    from gridlineage.operators import diff

    rows = [("a", "x", 1.0, 0.0), ("a", "y", 0.95, 0.0), ("b", "x", 0.95, 0.0), ("b", "y", 1.0, 0.0), ("c", "z", 0.9, 0.5), ("c", "w", 0.9, 0.2)]
    scores = spark.createDataFrame(rows, "sheet_a string, sheet_b string, score double, cells double")
    found = lambda **more: sorted((r["sheet_a"], r["sheet_b"]) for r in diff.mutual_best(scores, **more).collect())
    assert found() == [("a", "x"), ("b", "y")]
    assert found(second="cells") == [("a", "x"), ("b", "y"), ("c", "z")]


def test_cycles_and_long_chains_in_few_rounds(spark, monkeypatch):
    from gridlineage.operators import graph

    kept, real = [], graph.keep
    monkeypatch.setattr(graph, "keep", lambda d: kept.append(1) or real(d))
    chain = [(k, k + 1) for k in range(100, 220)]
    edges = [(1, 2), (2, 3), (3, 1), (3, 100), (220, 300), (300, 301), (301, 300)]
    got = {r["node"]: r["cycle"] for r in graph.cycles(spark.createDataFrame(chain + edges, "src int, dst int")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 300: 300, 301: 300}
    assert len(kept) < 60  # peeling takes a round of each two links


def test_islands_of_a_wide_group_span_by_span(spark):
    from gridlineage.operators import grid

    rows = [("a", k) for k in (1, 65535, 65536, 65537, 131071, 131072, 200000)] + [(None, k) for k in (-1, 0, 1)]
    d = spark.createDataFrame(rows, "s string, k long")
    want = {("a", 1, 1, 1), ("a", 65535, 65537, 3), ("a", 131071, 131072, 2), ("a", 200000, 200000, 1), (None, -1, 1, 3)}
    got = grid.wide_islands(d, ["s"], "k")
    assert {tuple(r) for r in got.collect()} == want
