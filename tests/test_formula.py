"""Formula functions on single formulas."""

import pytest
from hypothesis import given
from hypothesis import strategies as st

from gridlineage.functions import formula
from gridlineage.operators import diff, vba


def test_tokens_and_names_that_look_like_references():
    kinds = [(t.kind, t.text) for t in formula.tokens("=ZZZ1+T0+Data!$A$1:B2+SUM('It''s'!C:C,3:4)&\"a\"\"b\"+Tbl[[#All],[x]]+#REF!")]
    assert kinds == [
        ("name", "ZZZ1"), ("op", "+"), ("name", "T0"), ("op", "+"), ("range", "Data!$A$1:B2"), ("op", "+"), ("function", "SUM"), ("op", "("), ("cols", "'It''s'!C:C"), ("op", ","), ("rows", "3:4"), ("op", ")"),
        ("op", "&"), ("string", '"a""b"'), ("op", "+"), ("structured", "Tbl[[#All],[x]]"), ("op", "+"), ("error", "#REF!"),
    ]
    with pytest.raises(ValueError):
        formula.tokens("=A1 ~ B2")


@pytest.mark.parametrize("text", ["A1+B2*C3^2^D4", "-A1%", "IF(A1>=2,\"x\",{1,2;3})", "SUM(,A1)", "(A1+2)*3", "1&2=3", "A1:B2", "F()"])
def test_parse_and_write_round_trip(text):
    tree = formula.parse("=" + text)
    assert formula.parse(formula.write(tree)) == tree


def test_precedence():
    tree = formula.parse("=1&2=3")
    assert tree.text == "&" and tree.args[1].text == "="
    power = formula.parse("=2^3^2")
    assert power.args[0].text == "2" and power.args[1].text == "^"
    for bad in ("=", "=A1+", "=(A1", "=F(1", "=1 2"):
        with pytest.raises(ValueError):
            formula.parse(bad)


def test_r1c1_and_back():
    f = "=SUM($A$1:B3)+C$5*$D6+Other!A:A-$3:4&\"A1\""
    r = formula.to_r1c1(f, 5, 3)
    assert r == "=SUM(R1C1:R[-2]C[-1])+R5C*R[1]C4+Other!C[-2]:C[-2]-R3:R[-1]&\"A1\""
    assert formula.to_a1(r, 5, 3) == f
    assert formula.to_a1("=R[-9]C", 5, 3) == "=#REF!"


@given(st.integers(1, 1000), st.integers(1, 500), st.integers(1, 1000), st.integers(1, 500), st.booleans(), st.booleans())
def test_r1c1_round_trip_everywhere(row, col, y, x, fixed_row, fixed_col):
    f = f"={'$' * fixed_col}{formula.column_letters(x)}{'$' * fixed_row}{y}"
    assert formula.to_a1(formula.to_r1c1(f, row, col), row, col) == f


@given(st.integers(1, 16384))
def test_letters(n):
    assert formula.column_number(formula.column_letters(n)) == n


def test_shift():
    assert formula.shift("=A1+$B$2+C$3+$D4+E:E+5:6+\"A1\"", 2, 1) == "=B3+$B$2+D$3+$D6+F:F+7:8+\"A1\""
    assert formula.shift("=A1", -1, 0) == "=#REF!"


def test_edges():
    got = formula.edges("=A1+A1:A1+B2:B1+OFFSET(C1,1,1)+INDEX(D1:D2,1)+[Book]S!A1+rate+'x y'!A:A", 1, 1, "S")
    assert got == [("cell", "S", 1, 1, 1, 1), ("range", "S", 1, 2, 2, 2), ("dynamic", "DYNAMIC:OFFSET", 0, 0, 0, 0), ("dynamic", "DYNAMIC:INDEX", 0, 0, 0, 0), ("range", "S", 1, 4, 2, 4), ("external", "[Book]S!A1", 0, 0, 0, 0), ("name", "rate", 0, 0, 0, 0), ("range", "x y", 1, 1, 1048576, 1)]


def test_rewrite_through_maps():
    f = "=R5C2+R[1]C+'Old'!R7C1&\"R5C2\""
    assert formula.rewrite_r1c1(f, {"Old": "New one"}, {5: 6}, {}) == "=R6C2+R[1]C+'New one'!R7C1&\"R5C2\""
    assert formula.rewrite_r1c1(f, {}, {7: None}, {}) is None


def test_words():
    assert formula.explain("=IF(A1>2,SUM(B1:B3),-C1)", {"B1:B3": "costs"}) == "if A1 is more than 2 then the sum of costs, else minus C1"
    assert formula.substitute("=SUM(B1:B3)+D1", {"B1:B3": "costs"}) == "=SUM(costs)+D1"


@given(st.lists(st.sampled_from("abc"), max_size=9), st.lists(st.sampled_from("abc"), max_size=9))
def test_alignment_is_a_longest_common_subsequence(a, b):
    import itertools

    pairs = diff.align(a, b)
    assert all(a[i] == b[j] for i, j in pairs) and all(x[0] < y[0] and x[1] < y[1] for x, y in itertools.pairwise(pairs))
    best = {}
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i, j] = 1 + best.get((i + 1, j + 1), 0) if a[i] == b[j] else max(best.get((i + 1, j), 0), best.get((i, j + 1), 0))
    assert len(pairs) == best.get((0, 0), 0)


def test_macro_procedures():
    source = 'Option Explicit\n#If Win64 Then\nPrivate Function Rate(x As Double, _\n    y) As Double\n  Rate = x * y \' note\nEnd Function\n#Else\nSub Go()\nEnd Sub\n#End If\nProperty Get P() As Long\nP = 1\nEnd Property\n'
    got = vba.procedures(source)
    assert [(p["name"], p["kind"], p["is_public"], p["compile_branch"]) for p in got] == [("Rate", "function", False, "Win64"), ("Go", "sub", True, "!Win64"), ("P", "property_get", True, None)]
    assert got[0]["parameters"] == ["x As Double", "y"] and got[0]["return_type"] == "Double" and (got[0]["line_start"], got[0]["line_end"]) == (3, 6)
    assert vba.canonical_body('X = 1 : Y = "A: B" \' c\nRem no\n  z  =  X') == 'x = 1\ny = "A: B"\nz = x'


@pytest.mark.parametrize(
    "text, written, found",
    [
        ("=é1+A1", "é1+A1", [("name", "é1", 0, 0, 0, 0), ("cell", "S", 1, 1, 1, 1)]),
        ("=SUM(A1:B2 B1:C3)", "SUM(A1:B2 B1:C3)", [("range", "S", 1, 1, 2, 2), ("range", "S", 1, 2, 3, 3)]),
        ("=LAMBDA(x,x+A1)(3)", "LAMBDA(x,x+A1)(3)", [("cell", "S", 1, 1, 1, 1)]),
        ("=SUM(T!A1:T!B2)", "SUM(T!A1:T!B2)", [("range", "T", 1, 1, 2, 2)]),
        ("=SUM({1,2;3,4},A1)", "SUM({1,2;3,4},A1)", [("cell", "S", 1, 1, 1, 1)]),
        ("=S1:S3!A1", "S1:S3!A1", [("cell", "S1:S3", 1, 1, 1, 1)]),
        ("=Größe!A1", "Größe!A1", [("cell", "Größe", 1, 1, 1, 1)]),
        ("=LET(rate,A1,rate+other)", "LET(rate,A1,rate+other)", [("cell", "S", 1, 1, 1, 1), ("name", "other", 0, 0, 0, 0)]),
        ("=IF( A1 , B1, (C1) )", "IF(A1,B1,(C1))", [("cell", "S", 1, k, 1, k) for k in (1, 2, 3)]),
    ],
)
def test_forms_of_references(text, written, found):
    assert formula.write(formula.parse(text)) == written
    assert formula.edges(text, 1, 1, "S") == found


def test_what_cannot_be_read_is_marked():
    assert formula.edges_or_mark("=A1+(", 1, 1, "S") == [("unparsed", "UNPARSED", 0, 0, 0, 0)]
    assert formula.edges_or_mark("=" + "(" * 5000 + "A1" + ")" * 5000, 1, 1, "S")[0][0] == "unparsed"


def test_alignment_of_long_axes_in_bounded_memory():
    import random
    import tracemalloc

    rng = random.Random(5)
    once = [str(k) for k in range(4000)]
    again = [str(rng.randint(0, 1500)) for _ in range(4000)]
    for rows in (once, again):
        kept = [x for x in rows if rng.random() < 0.9]
        tracemalloc.start()
        pairs = diff.align(rows, kept)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert len(pairs) == len(kept) and all(rows[i] == kept[j] for i, j in pairs)
        assert peak < 4_000_000  # a table of both sides takes over 100 MB


@given(st.lists(st.sampled_from("abcdef"), max_size=12), st.lists(st.sampled_from("abcdef"), max_size=12))
def test_alignment_takes_the_places_of_the_whole_table(a, b):
    rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            rows[i][j] = rows[i + 1][j + 1] + 1 if a[i] == b[j] else max(rows[i + 1][j], rows[i][j + 1])
    want, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            want.append((i, j))
            i, j = i + 1, j + 1
        elif rows[i][j + 1] == rows[i][j]:
            j += 1
        else:
            i += 1
    assert diff._common(a, b) == want


@given(st.permutations(range(9)))
def test_rising_places_are_those_of_the_table(places):
    assert [(i, places[i]) for i in diff._rising(places)] == diff._common(places, list(range(9)))
