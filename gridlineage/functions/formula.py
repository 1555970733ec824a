"""Formulas: tokens, syntax tree, references, R1C1 forms, shifting and renaming.

Plain functions on one formula, and Arrow UDFs over them.  Apply the UDFs to distinct
formulas, which are far fewer than cells.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from gridlineage.functions.address import MAX_COL, MAX_ROW

# Functions whose result can't be read from the formula's text alone.
OPAQUE = ("INDIRECT", "OFFSET", "GETPIVOTDATA", "CELL", "INFO")
TRANSPARENT = ("INDEX", "XLOOKUP", "CHOOSE")
# Binding powers of the infix operators; & binds less than comparisons, a blank between references intersects them.
POWERS = {"&": 1, "=": 2, "<>": 2, "<": 2, ">": 2, "<=": 2, ">=": 2, "+": 3, "-": 3, "*": 4, "/": 4, "^": 6, " ": 8, ":": 9}

_CELL = r"\$?[A-Za-z]{1,3}\$?[0-9]{1,10}"
_SHEET = r"(?:'(?:[^']|'')*'|\[[^\]]+\][A-Za-z0-9_.]*|[^\W\d][\w.]*(?::[^\W\d][\w.]*)?)!"
_TOKEN = re.compile(
    rf"""(?P<space>\s+)
    |(?P<string>"(?:[^"]|"")*")
    |(?P<error>\#(?:REF!|N/A|VALUE!|DIV/0!|NAME\?|NULL!|NUM!))
    |(?P<range>(?:{_SHEET})?{_CELL}:{_CELL}(?![\w(!]))
    |(?P<cell>(?:{_SHEET})?{_CELL}(?![\w(.!]))
    |(?P<cols>(?:{_SHEET})?\$?[A-Za-z]{{1,3}}:\$?[A-Za-z]{{1,3}}(?![\w(!]))
    |(?P<rows>(?:{_SHEET})?\$?[0-9]{{1,7}}:\$?[0-9]{{1,7}}(?![0-9]))
    |(?P<number>(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)
    |(?P<structured>[^\W\d][\w.]*\[(?:[^\[\]]|\[[^\[\]]*\])*\])
    |(?P<function>[^\W\d][\w.]*(?=\())
    |(?P<name>(?:{_SHEET})?(?:[^\W\d]|\\)[\w.\\]*)
    |(?P<op><>|<=|>=|[-+*/^&=<>%(),;{{}}:@\#])""",
    re.X,
)
_PART = re.compile(r"(\$?)([A-Za-z]{1,3})(\$?)([0-9]{1,10})\Z")


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    start: int


def column_number(letters: str) -> int:
    n = 0
    for c in letters.upper():
        n = 26 * n + ord(c) - 64
    return n


def column_letters(n: int) -> str:
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def _is_cell(text: str, last_row: int = MAX_ROW) -> bool:
    m = _PART.match(text)
    return bool(m) and column_number(m[2]) <= MAX_COL and 1 <= int(m[4]) <= last_row


def tokens(formula: str, last_row: int = MAX_ROW) -> list[Token]:
    """Tokens without white space; names that only look like references (T0, ZZZ1) are names.

    last_row: of the sheets that the formula is of, here and below; tables that stand for sheets may have more rows than a workbook's.
    """
    text = formula[1:] if formula.startswith("=") else formula
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"can't read {text[at : at + 20]!r}")
        kind, word = m.lastgroup, m[0]
        if kind in ("cell", "range") and not all(_is_cell(p, last_row) for p in word.rpartition("!")[2].split(":")):
            kind = "name"
            word = re.compile(rf"(?:{_SHEET})?[\w.$]+").match(text, at)[0]
        if kind != "space":
            out.append(Token(kind, word, at))
        at += len(word)
    return out


@dataclass(frozen=True)
class Node:
    """kind: const, ref, call, unary, binary, array; text: value, reference, name or operator."""

    kind: str
    text: str
    args: tuple[Node, ...] = ()

    def __str__(self) -> str:
        return write(self)


REFS = ("cell", "range", "cols", "rows", "structured", "name")


def parse(formula: str, last_row: int = MAX_ROW) -> Node:
    """Syntax tree by operator precedence; ^ joins to the right, % follows its operand."""
    todo = tokens(formula, last_row)
    body = formula[1:] if formula.startswith("=") else formula
    at = 0

    def peek() -> str | None:
        return todo[at].text if at < len(todo) and todo[at].kind == "op" else None

    def take(text: str) -> None:
        nonlocal at
        if peek() != text:
            raise ValueError(f"{text} is missing")
        at += 1

    def arguments(close: str) -> tuple[Node, ...]:
        nonlocal at
        args: list[Node] = []
        while peek() != close:
            if peek() in (",", ";"):
                args.append(Node("const", ""))
            else:
                args.append(expression(0))
            if peek() in (",", ";"):
                at += 1
                if peek() == close:
                    args.append(Node("const", ""))
            elif peek() != close:
                raise ValueError("an argument doesn't end")
        at += 1
        return tuple(args)

    def rows() -> Node:
        """An array; of several rows, each is an array of its own."""
        nonlocal at
        out: list[list[Node]] = [[]]
        while peek() != "}":
            out[-1].append(expression(0))
            if peek() == ";":
                out.append([])
            if peek() in (",", ";"):
                at += 1
            elif peek() != "}":
                raise ValueError("an array doesn't end")
        at += 1
        return Node("array", "{}", tuple(out[0])) if len(out) == 1 else Node("array", "{}", tuple(Node("array", ";", tuple(r)) for r in out))

    def crossed(left: Node) -> bool:
        """Whether a blank stands between two references, which intersects them."""
        t = todo[at] if at < len(todo) else None
        if t is None or not (t.kind in REFS or t.kind == "function" or t.text == "(") or not body[t.start - 1 : t.start].isspace():
            return False
        return left.kind in ("ref", "call") or left.text in (":", " ", "()")

    def operand() -> Node:
        nonlocal at
        if at >= len(todo):
            raise ValueError("the formula ends too soon")
        t = todo[at]
        at += 1
        if t.kind == "function":
            take("(")
            return Node("call", t.text.upper(), arguments(")"))
        if t.kind in REFS:
            return Node("const", t.text.upper()) if t.text.upper() in ("TRUE", "FALSE") else Node("ref", t.text)
        if t.kind in ("number", "string", "error"):
            return Node("const", t.text)
        if t.text in "+-@":
            return Node("unary", t.text, (expression(5),))
        if t.text == "(":
            inner = expression(0)
            take(")")
            return Node("unary", "()", (inner,))
        if t.text == "{":
            return rows()
        raise ValueError(f"{t.text} isn't expected here")

    def expression(least: int) -> Node:
        nonlocal at
        left = operand()
        while at < len(todo):
            op = " " if crossed(left) else peek()
            if op == " ":
                if POWERS[op] < least:
                    break
                left = Node("binary", op, (left, expression(POWERS[op] + 1)))
            elif op == "(" and left.kind == "call":  # a LAMBDA that is called at once
                at += 1
                left = Node("call", "", (left, *arguments(")")))
            elif op in ("%", "#"):
                at += 1
                left = Node("unary", op, (left,))
            elif op in POWERS and POWERS[op] >= max(least, 1):
                at += 1
                left = Node("binary", op, (left, expression(POWERS[op] if op == "^" else POWERS[op] + 1)))
            else:
                break
        return left

    tree = expression(0)
    if at < len(todo):
        raise ValueError(f"{todo[at].text} is left over")
    return tree


def write(node: Node, ref: Callable[[str], str] = str) -> str:
    """Formula text of a tree, references through ref."""
    if node.kind == "ref":
        return ref(node.text)
    if node.kind == "const":
        return node.text
    args = [write(a, ref) for a in node.args]
    if node.kind == "call":
        return f"{node.text}({','.join(args)})" if node.text else f"{args[0]}({','.join(args[1:])})"
    if node.kind == "array":
        rows = node.args and all(a.kind == "array" and a.text == ";" for a in node.args)
        return ",".join(args) if node.text == ";" else "{" + (";" if rows else ",").join(args) + "}"
    if node.kind == "binary":
        return f"{args[0]}{node.text}{args[1]}"
    if node.text == "()":
        return f"({args[0]})"
    return args[0] + node.text if node.text in "%#" else node.text + args[0]


def walk(node: Node) -> Iterator[Node]:
    yield node
    for a in node.args:
        yield from walk(a)


def references(formula: str) -> list[tuple[str, str]]:
    """(kind, text) of the references, in order, repeats included."""
    return [(t.kind, t.text) for t in tokens(formula) if t.kind in REFS and t.text.upper() not in ("TRUE", "FALSE")]


def bound_names(tree: Node) -> set[str]:
    """Names that LET and LAMBDA bind in a tree, in lower case."""
    bound: set[str] = set()
    for node in walk(tree):
        if node.kind == "call" and node.text in ("LET", "LAMBDA", "_XLFN.LET", "_XLFN.LAMBDA"):
            names = node.args[:-1:2] if node.text.endswith("LET") else node.args[:-1]
            bound |= {a.text.lower() for a in names if a.kind == "ref"}
    return bound


def functions(formula: str) -> list[str]:
    return sorted({t.text.upper() for t in tokens(formula) if t.kind == "function"})


def _each_reference(formula: str, change: Callable[[str, str], str], last_row: int = MAX_ROW) -> str:
    """The formula with change(kind, text) for each cell, range, whole column and row; all else as it was."""
    head = "=" if formula.startswith("=") else ""
    text, out, at = formula[len(head) :], [], 0
    for t in tokens(formula, last_row):
        if t.kind in ("cell", "range", "cols", "rows"):
            out += [text[at : t.start], change(t.kind, t.text)]
            at = t.start + len(t.text)
    return head + "".join(out) + text[at:]


def _split(ref: str) -> tuple[str, str]:
    sheet, mark, local = ref.rpartition("!")
    return sheet + mark, local


def to_r1c1(formula: str, row: int, col: int, last_row: int = MAX_ROW) -> str:
    """R1C1 form as seen from a cell: relative parts as offsets, absolute ones as numbers."""

    def number(mark: str, n: int, base: int, letter: str) -> str:
        return f"{letter}{n}" if mark else letter + (f"[{n - base}]" if n != base else "")

    def part(p: str) -> str:
        a, c, b, r = _PART.match(p).groups()
        return number(b, int(r), row, "R") + number(a, column_number(c), col, "C")

    def change(kind: str, ref: str) -> str:
        sheet, local = _split(ref)
        if kind in ("cell", "range"):
            return sheet + ":".join(map(part, local.split(":")))
        if kind == "cols":
            return sheet + ":".join(number("$" * p.startswith("$"), column_number(p.strip("$")), col, "C") for p in local.split(":"))
        return sheet + ":".join(number("$" * p.startswith("$"), int(p.strip("$")), row, "R") for p in local.split(":"))

    return _each_reference(formula, change, last_row)


_R1C1 = re.compile(r"(?<![A-Za-z0-9_.])R(?:\[(-?\d+)\]|(\d+))?C(?:\[(-?\d+)\]|(\d+))?(?![A-Za-z0-9_(\[])")
_EXTENT = re.compile(r"(?<![A-Za-z0-9_.\])])([RC])(?:\[(-?\d+)\]|(\d+))?:\1(?:\[(-?\d+)\]|(\d+))?(?![A-Za-z0-9_(\[])")


def to_a1(formula: str, row: int, col: int) -> str:
    """A1 form of an R1C1 formula at a cell; #REF! where an offset leaves the sheet."""

    def change(m: re.Match) -> str:
        dr, r, dc, c = m.groups()
        y = int(r) if r else row + int(dr or 0)
        x = int(c) if c else col + int(dc or 0)
        if not (1 <= y <= MAX_ROW and 1 <= x <= MAX_COL):
            return "#REF!"
        return ("$" if c else "") + column_letters(x) + ("$" if r else "") + str(y)

    def extent(m: re.Match) -> str:
        rows = m[1] == "R"
        ends = []
        for offset, fixed in ((m[2], m[3]), (m[4], m[5])):
            n = int(fixed) if fixed else (row if rows else col) + int(offset or 0)
            if not 1 <= n <= (MAX_ROW if rows else MAX_COL):
                return "#REF!"
            ends.append("$" * bool(fixed) + (str(n) if rows else column_letters(n)))
        return ":".join(ends)

    parts = re.split(r'("(?:[^"]|"")*")', formula)
    return "".join(p if k % 2 else _R1C1.sub(change, _EXTENT.sub(extent, p)) for k, p in enumerate(parts))


def shift(formula: str, rows: int, cols: int, last_row: int = MAX_ROW) -> str:
    """The formula as if filled by so many rows and columns; absolute parts stay, lost references become #REF!."""

    def part(p: str) -> str:
        a, c, b, r = _PART.match(p).groups()
        x, y = column_number(c) + (0 if a else cols), int(r) + (0 if b else rows)
        return f"{a}{column_letters(x)}{b}{y}" if 1 <= x <= MAX_COL and 1 <= y <= last_row else "#REF!"

    def change(kind: str, ref: str) -> str:
        sheet, local = _split(ref)
        if kind in ("cell", "range"):
            moved = [part(p) for p in local.split(":")]
            return "#REF!" if "#REF!" in moved else sheet + ":".join(moved)
        out = []
        for p in local.split(":"):
            fixed, p = p.startswith("$"), p.strip("$")
            n = (column_number(p) + (0 if fixed else cols)) if kind == "cols" else int(p) + (0 if fixed else rows)
            if not 1 <= n <= (MAX_COL if kind == "cols" else last_row):
                return "#REF!"
            out.append("$" * fixed + (column_letters(n) if kind == "cols" else str(n)))
        return sheet + ":".join(out)

    return _each_reference(formula, change, last_row)


def rewrite_r1c1(formula: str, sheets: dict[str, str], rows: dict[int, int | None], cols: dict[int, int | None]) -> str | None:
    """Absolute references through maps of sheets, rows and columns; None where a target was deleted."""
    lost = False

    def moved(n: str | None, table: dict[int, int | None]) -> str | None:
        nonlocal lost
        if n is None:
            return None
        got = table.get(int(n), int(n))
        lost = lost or got is None
        return str(got)

    def change(m: re.Match) -> str:
        dr, r, dc, c = m.groups()
        r, c = moved(r, rows), moved(c, cols)
        return "R" + (r or (f"[{dr}]" if dr else "")) + "C" + (c or (f"[{dc}]" if dc else ""))

    def sheet(m: re.Match) -> str:
        name = m[1].replace("''", "'") if m[1] else m[2]
        new = sheets.get(name, name)
        plain = re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", new)
        return (new if plain else "'" + new.replace("'", "''") + "'") + "!"

    parts = re.split(r'("(?:[^"]|"")*")', formula)
    out = "".join(p if k % 2 else re.sub(r"(?:'((?:[^']|'')*)'|([A-Za-z_][A-Za-z0-9_.]*))!", sheet, _R1C1.sub(change, p)) for k, p in enumerate(parts))
    return None if lost else out


def edges(formula: str, row: int, col: int, sheet: str, last_row: int = MAX_ROW) -> list[tuple[str, str, int, int, int, int]]:
    """(kind, sheet or text, r1, c1, r2, c2) that a formula reads: cell, range, external or dynamic; each once, in order.

    A range of one cell is a cell.  An opaque function gives one dynamic edge and hides its arguments; a transparent one keeps them.
    """
    found: dict[tuple, None] = {}

    def add(kind: str, where: str, box: tuple[int, int, int, int] = (0, 0, 0, 0)) -> None:
        found.setdefault((kind, where, *box))

    def refer(text: str) -> None:
        token = tokens(text, last_row)[0]
        where, local = _split(text)
        where = where[:-1]
        if "[" in where and token.kind != "structured":
            return add("external", text)
        name = where[1:-1].replace("''", "'") if where.startswith("'") else where
        if token.kind in ("cell", "range"):
            ends = [_PART.match(p).groups() for p in local.split(":")]
            ys, xs = [int(e[3]) for e in ends], [column_number(e[1]) for e in ends]
        elif token.kind == "cols":
            xs, ys = [column_number(p.strip("$")) for p in local.split(":")], [1, MAX_ROW]
        elif token.kind == "rows":
            ys, xs = [int(p.strip("$")) for p in local.split(":")], [1, MAX_COL]
        else:
            return None if text.lower() in bound else add("name", text)
        box = (min(ys), min(xs), max(ys), max(xs))
        add("cell" if box[:2] == box[2:] else "range", name or sheet, box)

    def visit(node: Node) -> None:
        if node.kind == "call" and node.text in OPAQUE:
            return add("dynamic", f"DYNAMIC:{node.text}")
        if node.kind == "call" and node.text in TRANSPARENT:
            add("dynamic", f"DYNAMIC:{node.text}")
        if node.kind == "ref":
            refer(node.text)
        if node.kind == "binary" and node.text == ":" and (whole := _joined(*node.args, last_row)):
            return refer(whole)
        for a in node.args:
            visit(a)

    tree = parse(formula, last_row)
    bound = bound_names(tree)
    visit(tree)
    return list(found)


def _joined(first: Node, last: Node, last_row: int) -> str | None:
    """The range of two cells of one sheet, each of which may name it."""
    if first.kind != "ref" or last.kind != "ref":
        return None
    (sheet, a), (other, b) = _split(first.text), _split(last.text)
    return f"{sheet}{a}:{b}" if other.lower() in ("", sheet.lower()) and _is_cell(a, last_row) and _is_cell(b, last_row) else None


def edges_or_mark(formula: str, row: int, col: int, sheet: str) -> list[tuple[str, str, int, int, int, int]]:
    """edges, or one of kind unparsed where the formula can't be read, so that it's counted rather than lost."""
    try:
        return edges(formula, row, col, sheet)
    except (ValueError, RecursionError):
        return [("unparsed", "UNPARSED", 0, 0, 0, 0)]


def explain(formula: str, names: dict[str, str] | None = None) -> str:
    """A formula in words, references by their names."""
    # Words of operators and common functions.
    words = {"+": "plus", "-": "minus", "*": "times", "/": "divided by", "^": "to the power of", "&": "joined with", "=": "equals", "<>": "differs from", "<": "is less than", ">": "is more than", "<=": "is at most", ">=": "is at least", ":": "to", " ": "crossed with"}
    calls = {"SUM": "the sum of", "AVERAGE": "the average of", "MIN": "the least of", "MAX": "the largest of", "COUNT": "the count of"}

    def say(n: Node) -> str:
        if n.kind == "ref":
            return (names or {}).get(n.text, n.text)
        if n.kind == "const":
            return n.text or "nothing"
        args = [say(a) for a in n.args]
        if n.kind == "call" and n.text == "IF" and len(args) >= 2:
            return f"if {args[0]} then {args[1]}" + (f", else {args[2]}" if len(args) > 2 else "")
        if n.kind == "call":
            return f"{calls.get(n.text, n.text + ' of')} {' and '.join(args)}"
        if n.kind == "binary":
            return f"{args[0]} {words[n.text]} {args[1]}"
        if n.kind == "array":
            return "the list of " + ", ".join(args)
        return {"-": f"minus {args[0]}", "%": f"{args[0]} per cent", "()": args[0]}.get(n.text, args[0])

    return say(parse(formula))


def substitute(formula: str, names: dict[str, str]) -> str:
    """The formula with references replaced by names where there are some."""
    return _each_reference(formula, lambda _, ref: names.get(ref, ref))


def udf(function: Callable, kind: str):
    """Arrow UDF of a function of one formula (and more columns); null where it's null or can't be read."""
    from pyspark.sql import functions as F

    def safe(*args):
        if any(a is None for a in args):
            return None
        try:
            return function(*args)
        except (ValueError, RecursionError):  # the latter of nesting beyond Python's
            return None

    return F.udf(safe, kind, useArrow=True)


EDGE = "array<struct<kind:string,target:string,r1:int,c1:int,r2:int,c2:int>>"


def masked(formula: str) -> str:
    """The formula with string literals, and names bound by LET and LAMBDA, blanked out; its length stays."""
    out = re.sub(r'"(?:[^"]|"")*"', lambda m: '"' + " " * (len(m[0]) - 2) + '"', formula)
    try:
        bound = bound_names(parse(formula))
    except ValueError:
        return out
    for name in bound:
        out = re.sub(rf"(?<![A-Za-z0-9_.]){re.escape(name)}(?![A-Za-z0-9_.(])", " " * len(name), out, flags=re.I)
    return out


def pivots(formula: str) -> list[tuple[str, list[str]]]:
    """(function, arguments as text) of pivot and cube calls."""
    return [(n.text, [write(a) for a in n.args]) for n in walk(parse(formula)) if n.kind == "call" and (n.text == "GETPIVOTDATA" or n.text.startswith("CUBE"))]


def offsets(formula: str, sheet: str) -> list[tuple[str, str, int, int, int, int]]:
    """(kind, sheet, r1, c1, r2, c2) of each OFFSET call on a cell or range: static with the exact rectangle where all numbers are
    literal, else volatile with the base's top left; a base that isn't a reference is left out."""
    out = []
    for n in walk(parse(formula)):
        if n.kind != "call" or n.text != "OFFSET" or len(n.args) < 3 or n.args[0].kind != "ref":
            continue
        base = [e for e in edges("=" + n.args[0].text, 1, 1, sheet) if e[0] in ("cell", "range")]
        if not base:
            continue
        _, where, r1, c1, r2, c2 = base[0]
        numbers = []
        for a in n.args[1:]:
            sign = -1 if a.kind == "unary" and a.text == "-" else 1
            a = a.args[0] if a.kind == "unary" and a.text in "+-" else a
            numbers.append(sign * int(float(a.text)) if a.kind == "const" and re.fullmatch(r"[0-9]+(\.0*)?", a.text) else (0 if a.kind == "const" and not a.text else None))
        if None in numbers:
            out.append(("via_offset_volatile", where, r1, c1, r1, c1))
            continue
        y, x = r1 + numbers[0], c1 + numbers[1]
        high = numbers[2] if len(numbers) > 2 and numbers[2] else r2 - r1 + 1
        wide = numbers[3] if len(numbers) > 3 and numbers[3] else c2 - c1 + 1
        if y >= 1 and x >= 1 and y + high - 1 <= MAX_ROW and x + wide - 1 <= MAX_COL:
            out.append(("via_offset_static", where, y, x, y + high - 1, x + wide - 1))
    return out
