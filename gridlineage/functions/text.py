"""Text predicates and formula text rewrites as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Placeholder texts.
PLACEHOLDERS = ("-", "–", "—", "tbc", "tbd", "na", "n/a", "n.a.", "n\\a")
# Pattern of a section header.
SECTION_HEADER = r"(?i)^\s*(\d+\.\s+\S|[A-Z]\.\s+\S|section\s+\S)"


def is_placeholder(text: Column) -> Column:
    return F.lower(F.trim(text)).isin(*PLACEHOLDERS)


def is_section_header(text: Column) -> Column:
    return text.rlike(SECTION_HEADER)


# Pattern of a header that names a scenario.
SCENARIO_HEADER = r"(?i)%|base|shock|stress|flat|scenario|scen|\b(up|down)\b"


def is_scenario_header(text: Column) -> Column:
    """A header that names a scenario: a per cent sign, or one of the scenario words."""
    return text.rlike(SCENARIO_HEADER)


def time_index(text: Column) -> Column:
    """The whole number that a header stands for: all digits, a whole number as text, else its first word of one to four digits; null for scenarios."""
    t = F.trim(text)
    number = F.when(t.rlike(r"^[-+]?\d+(\.\d*)?([eE][-+]?\d+)?$"), t.try_cast("double"))
    whole = F.when(F.abs(number - F.round(number)) < 1e-6, F.round(number).cast("long"))
    first = F.nullif(F.regexp_extract(t, r"\b(\d{1,4})\b", 1), F.lit("")).cast("long")
    return F.when(number.isNotNull(), whole).when(~is_scenario_header(t), first)


def is_time_axis(indices: Column) -> Column:
    """Whether an array of time indices, in order, is a continuous axis: at least five known, 70 % of all, rising, most steps 1 (80 % rounded down, 3 at least)."""
    known = F.filter(indices, lambda n: n.isNotNull())
    n = F.size(known)
    steps = F.zip_with(F.slice(known, 2, F.greatest(n, F.lit(1))), F.slice(known, 1, F.greatest(n - 1, F.lit(0))), lambda b, a: b - a)
    ones = F.size(F.filter(steps, lambda d: d == 1))
    fits = (n >= 5) & (n / F.nullif(F.size(indices), F.lit(0)) >= 0.7) & F.forall(steps, lambda d: d > 0) & (ones >= F.greatest(F.lit(3), F.floor((n - 1) * 0.8)))
    return F.coalesce(fits, F.lit(False))


def function_names(formula: Column) -> Column:
    """Distinct upper-case function names of a formula, in order of the alphabet; string literals don't count."""
    bare = F.regexp_replace(formula, '"(?:[^"]|"")*"', '""')
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(bare, F.lit(r"([A-Za-z_][A-Za-z0-9_.]*)\("), F.lit(1)), F.upper)))


def volatile_kind(name: Column) -> Column:
    up = F.upper(name)
    return (
        F.when(up.isin("NOW", "TODAY"), "time")
        .when(up.isin("RAND", "RANDBETWEEN", "RANDARRAY"), "random")
        .when(up.isin("CELL", "INFO"), "workbook_meta")
        .when(up.isin("RTD", "HYPERLINK"), "external_link")
        .when(up.isin("OFFSET", "INDIRECT"), "address_computed")
    )


# A text literal, or a reference with its sheet: to a table, a rectangle, columns, rows, a cell.  No word bounds, so that LOG10 begins with a cell.
_BRACKETS = r"[^\[\]]*(?:\[[^\[\]]*\][^\[\]]*)*"
_CELL = r"\$?[A-Za-z]{1,3}\$?\d{1,7}"
_TABLE = rf"[A-Za-z_][\w.]*\[{_BRACKETS}\]|\[[@#][^\]]+\]"
_LITERAL_OR_REFERENCE = r'(?U)"[^"]*(?:""[^"]*)*"|(?:(?:\'[^\']*\'|[A-Za-z_][\w.]*)!)?(?:' + rf"{_TABLE}|{_CELL}:{_CELL}|\$?[A-Za-z]{{1,3}}:\$?[A-Za-z]{{1,3}}|\$?\d{{1,7}}:\$?\d{{1,7}}|{_CELL})"


def canonical_a1(formula: Column) -> Column:
    """Family key: literals and references by kind, without sheets, in upper case, one blank for white space; null without a parenthesis."""
    body = F.regexp_replace(formula, "^=", "")
    kind = lambda m: (
        F.when(m.startswith('"'), "STR")
        .when(m.endswith("]"), "CELLRANGE")
        .when(m.rlike("[A-Za-z]$"), "COLRANGE")
        .when(m.rlike(rf"(?U):{_CELL}$"), "CELLRANGE")
        .when(m.rlike(r"(?U):\$?\d{1,7}$"), "ROWRANGE")
        .otherwise("CELL")
    )
    between = F.split(body, _LITERAL_OR_REFERENCE)  # one more than there are matches
    kinds = F.transform(F.regexp_extract_all(body, F.lit(_LITERAL_OR_REFERENCE), F.lit(0)), kind)
    joined = F.array_join(F.zip_with(between, kinds, lambda text, k: F.concat(F.coalesce(text, F.lit("")), F.coalesce(k, F.lit("")))), "")
    f = F.trim(F.regexp_replace(F.upper(joined), r"(?U)\s+", " "))
    return F.when(F.contains(f, F.lit("(")), F.concat(F.when(formula.startswith("="), "=").otherwise(""), f))


def change_kind(old: Column, new: Column) -> Column:
    """reference_shift if two R1C1 formulas are equal but for absolute numbers, else logic_change; null if equal."""
    bare = lambda f: F.regexp_replace(f, r"([RC])\d+", "$1*")
    return F.when(old == new, None).when(bare(old) == bare(new), "reference_shift").otherwise("logic_change")


def plain_sheet_quotes(formula: Column) -> Column:
    """'Calc'! -> Calc! outside string literals, where the name needs no quotes."""
    # odd parts of a split at double quotes are outside of literals
    parts = F.transform(F.split(formula, '"'), lambda p, i: F.when(i % 2 == 0, F.regexp_replace(p, r"'([A-Za-z_][A-Za-z0-9_]*)'!", "$1!")).otherwise(p))
    return F.array_join(parts, '"')


def is_numeric(text: Column) -> Column:
    return F.trim(text).rlike(r"^[-+]?(\d+(\.\d*)?|\.\d+)([eE][-+]?\d+)?%?$")


def is_id_code(text: Column) -> Column:
    """An identifier rather than a label: no blank, digits and capitals mixed."""
    return text.rlike(r"^[A-Z0-9_.-]*[0-9][A-Z0-9_.-]*$") & text.rlike("[A-Z]")


def clean_label(text: Column) -> Column:
    """A label without repeated white space and trailing marks."""
    return F.regexp_replace(F.trim(F.regexp_replace(text, r"\s+", " ")), r"[\s:;,.-]+$", "")


def is_label(text: Column) -> Column:
    t = clean_label(text)
    return F.coalesce((F.length(t) >= 2) & ~is_numeric(t) & ~is_placeholder(t) & t.rlike("[A-Za-z]"), F.lit(False))


def numbers_close(a: Column, b: Column) -> Column:
    """Both numbers, and equal up to 1e-9 of the larger."""
    x, y = a.try_cast("double"), b.try_cast("double")
    return F.coalesce(F.abs(x - y) <= 1e-9 * F.greatest(F.abs(x), F.abs(y)), F.lit(False))
