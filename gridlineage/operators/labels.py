"""Labels, classification and confidence of bindings, as column expressions and small aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridlineage.functions.text import function_names, is_numeric

# Base score of a label candidate by its type.
BASE = {
    "named_exact": 0.95, "named_subset": 0.95, "named_superset": 0.90, "table_column_headers": 0.85, "table_header_row": 0.80,
    "merged_above": 0.70, "merged_left": 0.70, "scan_above": 0.65, "scan_below": 0.60, "row_segment": 0.60, "col_segment": 0.60,
    "scan_left": 0.55, "sheet_name": 0.45,
}


def candidate_score(kind: Column, text: Column, distance: Column, multi_cell: Column) -> Column:
    """Score of a label candidate, at most 1; numbers at most 0.3."""
    base = F.lit(0.1)
    for name, score in BASE.items():
        base = F.when(kind == name, score).otherwise(base)
    n = F.length(text)
    scan = kind.startswith("scan_")
    s = (
        base
        + F.when(text.rlike("[A-Za-z]"), 0.2).otherwise(0.0)
        + F.when(n.between(5, 50), 0.1).otherwise(0.0)
        - F.when(n < 3, 0.2).otherwise(0.0)
        - F.when(n > 100, 0.1).otherwise(0.0)
        + F.when(multi_cell, 0.1).otherwise(0.0)
        + F.when(scan & (distance <= 2), 0.05).when(scan & (distance >= 5), -0.15).otherwise(0.0)
    )
    return F.least(F.lit(1.0), F.when(is_numeric(text), F.least(s, F.lit(0.3))).otherwise(s))


def select_label(candidates: DataFrame, by: str) -> DataFrame:
    """(by, label, kind, score): the best candidate; the first of equals (by place).  A partial aggregate, no sort."""
    best = F.min(F.struct((-F.round("score", 9)).alias("s"), "place", "text", "kind")).alias("_b")
    return candidates.groupBy(by).agg(best).select(by, F.col("_b.text").alias("label"), F.col("_b.kind").alias("kind"), F.round(-F.col("_b.s"), 6).alias("score"))


def disambiguate(labels: DataFrame, label: str, sheet: str, row: str) -> DataFrame:
    """Adds unique_label: a label that comes several times gets its sheet, or its row where the sheet has it several times."""
    n = F.count("*").over(Window.partitionBy(label))
    m = F.count("*").over(Window.partitionBy(label, sheet))
    return labels.withColumn("unique_label", F.when(n == 1, F.col(label)).when(m == 1, F.concat(F.col(label), F.lit(" ("), F.col(sheet), F.lit(")"))).otherwise(F.concat(F.col(label), F.lit(" (Row "), F.col(row).cast("string"), F.lit(")"))))


def sheet_prefix(labels: DataFrame, sheet: str, label: str, least: float = 0.9) -> DataFrame:
    """(sheet, prefix, share): the first word that at least this share of a sheet's labels begins with."""
    word = labels.select(sheet, F.split(F.trim(label), r"\s+")[0].alias("prefix"))
    n = word.groupBy(sheet, "prefix").agg(F.count("*").alias("n"))
    best = n.groupBy(sheet).agg(F.min(F.struct((-F.col("n")).alias("m"), "prefix")).alias("b"), F.sum("n").alias("total"))
    share = -F.col("b.m") / F.col("total")
    return best.select(sheet, F.col("b.prefix").alias("prefix"), F.round(share, 6).alias("share")).where(F.col("share") >= least)


# Words in the names of sheets, by type; the first type with a word in the name holds.
CALCULATION_NAMES = ("projection", "calculation", "engine", "model", "cashflow", "output")
ASSUMPTION_NAMES = ("assumption", "parameter", "config", "mortality", "lapse", "rate", "table", "expense", "commission", "inflation", "interest", "tax", "premium")
POLICYHOLDER_NAMES = ("input", "data", "policyholder", "policy")

# Words in labels and sheet names that speak for a class, as regular expressions between word bounds.
ASSUMPTION_LABELS = (
    "mortality", "morbidity", "lapse", "surrender", "expense", "salary", "inflation", "discount", "yield", "interest rate", "bonus", "crediting rate", "profit.?sharing", "management action", "strategy",
    "assumptions?", "rate", "factor", "percentage", "%", "stress", "scenario", "best.?estimate", "adverse", "optimistic", "pessimistic", "cso", "table",
)
POLICYHOLDER_LABELS = ("policy", "age", "date of birth", "dob", "sex", "gender", "premium", "sum assured", "product code", "duration")
RESULT_LABELS = ("bel", "best estimate", "reserve", "liability", "scr", "capital", "pvfp", "embedded value", "profit", "total", "summary", "aggregat", "output", "result")
RATE_LABELS = ("rate", "factor", "percentage", "%", "stress", "scenario")
ASSUMPTION_SHEETS = ("assumptions?", "rates", "parameters", "tables?", "interest", "expenses?", r"discount\w*", "curve", r"scenario\w*")
POLICYHOLDER_SHEETS = ("policyholder", "policy", "data")
RESULT_SHEETS = ("results?", "outputs?", "report", "summary")

# Functions whose use asks for a reconciliation, and those that only format or locate.
CHECKED_FUNCTIONS = (
    "SUM", "AVERAGE", "COUNT", "COUNTA", "COUNTIF", "COUNTIFS", "MIN", "MAX", "STDEV", "STDEVP", "VAR", "VARP", "PERCENTILE", "VLOOKUP", "HLOOKUP", "INDEX", "MATCH", "XLOOKUP", "LOOKUP", "NPV", "IRR", "PV", "FV", "PMT", "RATE",
    "NPER", "IPMT", "PPMT", "IF", "IFS", "SWITCH", "CHOOSE", "DATE", "EDATE", "YEARFRAC", "DATEDIF", "EOMONTH", "NETWORKDAYS", "SUMIF", "SUMIFS", "AVERAGEIF", "AVERAGEIFS", "SUMPRODUCT",
)
HELPER_FUNCTIONS = ("TEXT", "CONCATENATE", "CONCAT", "TRIM", "UPPER", "LOWER", "LEFT", "RIGHT", "MID", "LEN", "SUBSTITUTE", "REPLACE", "ROW", "COLUMN", "CELL", "INDIRECT", "OFFSET", "ADDRESS", "VALUE", "N", "T")


def sheet_type(name: Column) -> Column:
    """Class of a sheet by words of its name; calculation comes before assumption before policyholder."""
    n = F.lower(name)
    return F.when(n.rlike("|".join(CALCULATION_NAMES)), "calculation").when(n.rlike("|".join(ASSUMPTION_NAMES)), "assumption").when(n.rlike("|".join(POLICYHOLDER_NAMES)), "policyholder").otherwise("unknown")


def words(patterns: tuple[str, ...]) -> str:
    """One regular expression for any of the words, in either case."""
    return rf"(?i)\b({'|'.join(patterns)})\b"


def rates_prevail(values: Column) -> Column:
    """Whether over half of the values (array of struct number, text) are numbers from 0 to 1; false for none."""
    return _over_half(values, lambda v: F.coalesce(v["number"].between(0, 1), F.lit(False)))


def inputs_prevail(values: Column) -> Column:
    """Whether over half of the values look like data of a policy: codes of up to three letters or digits, whole numbers from 2 to 120, numbers above 1000."""
    whole = lambda n: (n == F.floor(n)) & (n > 1) & (n <= 120)
    return _over_half(values, lambda v: F.coalesce(v["text"].rlike(r"^[\p{L}\p{N}]{1,3}$"), whole(v["number"]) | (v["number"] > 1000), F.lit(False)))


def _over_half(values: Column, fits) -> Column:
    return F.coalesce((F.size(values) > 0) & (F.size(F.filter(values, fits)) / F.nullif(F.size(values), F.lit(0)) > 0.5), F.lit(False))


def class_scores(label: Column, sheet: Column, has_formula: Column, is_link: Column, n_consumers: Column, n_providers: Column, values: Column | None = None) -> dict[str, Column]:
    """Scores of the four classes, the first named first where they are equal.

    is_link: all formulas are references or numbers alone; n_consumers and n_providers: variables that read this one, and that it reads;
    values: some of its values, as an array of struct (number, text).  Terms are added in a fixed order, because equal sums decide by it.
    """
    holds = lambda text, patterns: F.coalesce(text.rlike(words(patterns)), F.lit(False))
    add = lambda *parts: sum((F.when(c, F.lit(float(w))).otherwise(0.0) for c, w in parts), F.lit(0.0))
    none = F.lit(False)
    link, rate = has_formula & is_link, holds(label, RATE_LABELS)
    source, sink = n_providers == 0, n_consumers == 0
    assumed, insured = holds(label, ASSUMPTION_LABELS), holds(label, POLICYHOLDER_LABELS)
    data = add(
        (insured, 0.6), (insured & rate, -0.25), (holds(sheet, POLICYHOLDER_SHEETS), 0.3), (source, 0.1), (none if values is None else inputs_prevail(values), 0.4),
        (has_formula & ~source & link, -0.1), (has_formula & ~source & ~link, -0.5),
    )
    calculation = add((~link, 0.4), (link, 0.4 * 0.3), (~sink, 0.4), (~source, 0.2))
    return {
        "Assumption": add(
            (assumed, 0.6), (assumed & rate, 0.15), (holds(sheet, ASSUMPTION_SHEETS), 0.3), (source, 0.1), (~source & link, 0.05), (~has_formula & (n_consumers >= 5), 0.3),
            (none if values is None else rates_prevail(values), 0.4),
        ),
        "Policyholder Data": F.greatest(F.lit(0.0), data),
        "Calculation": F.when(~has_formula, 0.0).when(source, 0.1).otherwise(calculation),
        "Result": add((holds(label, RESULT_LABELS), 0.6), (holds(sheet, RESULT_SHEETS), 0.2), (sink, 0.5), (has_formula, 0.3)),
    }


def classify(scores: dict[str, Column], least: float = 0.2) -> tuple[Column, Column]:
    """(class, score): the largest score, the first of equals, at most 1; Unclassified below the least."""
    best = F.greatest(*scores.values())
    name = F.lit(None).cast("string")
    for k in reversed(list(scores)):
        name = F.when(scores[k] == best, k).otherwise(name)
    return F.when(best < least, "Unclassified").otherwise(name), F.least(F.lit(1.0), best)


def hard_rule(proposed: Column, sheet: Column, has_formula: Column) -> Column:
    """A formula on a calculation sheet can't be an input of any class."""
    return F.when((sheet_type(sheet) == "calculation") & has_formula & proposed.isin("Assumption", "Policyholder Data"), "Calculation").otherwise(proposed)


def is_link(formula: Column) -> Column:
    """A formula of references, sheet names and numbers alone."""
    return formula.rlike(r"^=?[A-Za-z0-9\\.\s!$:]+$")


def has_arithmetic(formula: Column) -> Column:
    """Whether a formula has a sum, difference, product, quotient or power of two operands; signs, names and literals don't count."""
    f = F.regexp_replace(formula, '"[^"]*(?:""[^"]*)*"|\'[^\']*(?:\'\'[^\']*)*\'!', "0")
    f = F.regexp_replace(f, r"\[[^\[\]]*(?:\[[^\[\]]*\][^\[\]]*)*\]", "")
    f = F.regexp_replace(f, r"(?<![A-Za-z0-9_.$])(\d+\.?\d*|\.\d+)[eE][+-]?\d+", "0")
    return f.rlike(r"[\p{L}\p{N}_.)}%#?]\s*[-+*/^]")


def reconciliation(override: Column, role: Column, formula: Column) -> Column:
    """(required, rationale) of a variable by the first rule that fits: its override, its role, no formula, arithmetic, checked functions, helpers alone, its role."""
    say = lambda required, why: F.struct(F.lit(required).alias("required"), (why if isinstance(why, Column) else F.lit(why)).alias("rationale"))
    used = function_names(formula)
    checked = F.array_intersect(used, F.array(*map(F.lit, CHECKED_FUNCTIONS)))
    helpers = F.array(*map(F.lit, HELPER_FUNCTIONS))
    named = lambda text, of: F.concat(F.lit(text + " ("), F.array_join(F.slice(F.array_sort(of), 1, 3), ", "), F.lit(")"))
    # The rationales.
    return (
        F.when(override.isNotNull(), F.struct(override["required"].alias("required"), override["rationale"].alias("rationale")))
        .when(role == "Result", say(True, "Key model output requiring verification"))
        .when(role == "Helper", say(False, "Structural or formatting helper, not a calculation"))
        .when(formula.isNull(), say(False, "Constant value, no calculation to verify"))
        .when(has_arithmetic(formula), say(True, "Contains mathematical calculations"))
        .when(F.size(checked) > 0, say(True, named("Uses actuarial formula pattern", checked)))
        .when((F.size(used) > 0) & (F.size(F.array_except(used, helpers)) == 0), say(False, named("Formatting/structural helper functions only", used)))
        .when(role == "Calculation", say(True, "Intermediate calculation in model flow"))
        .when(role.isin("Policyholder Data", "Assumption"), say(False, "Input data, no calculation to verify"))
        .otherwise(say(False, "No clear reconciliation requirement detected"))
    )


def generated_label(formula: Column, sources: Column) -> Column:
    """A label from a formula and the labels of what it reads (array of struct label, score, in order); null where none can be made.

    A sum or average of a range takes the first source's label, a net present value the second's, if its score is above 0.5; two cells
    joined by an operator take both.  A null or Unlabelled source gives none.
    """
    known = lambda n: F.when(F.try_element_at(sources, F.lit(n))["label"] != "Unlabelled", F.try_element_at(sources, F.lit(n))["label"])
    sure = lambda n: F.when((F.try_element_at(sources, F.lit(n))["score"] > 0.5) & (known(n) != ""), known(n))
    pair = r"^=[A-Z]+[0-9]+\s*([+\-*/])\s*[A-Z]+[0-9]+$"
    sign = F.regexp_extract(formula, pair, 1)
    sign = F.when(sign == "*", "\u00d7").when(sign == "-", "\u2212").otherwise(sign)
    both = F.when((F.size(sources) == 2) & (known(1) != "") & (known(2) != ""), F.concat_ws(" ", known(1), sign, known(2)))
    total = r"(?i)^={}\([A-Z]+[0-9]+:[A-Z]+[0-9]+\)"
    return (
        F.when(formula.rlike(total.format("SUM")), F.concat(F.lit("Total "), sure(1)))
        .when(formula.rlike(total.format("AVERAGE")), F.concat(F.lit("Average "), sure(1)))
        .when(formula.rlike(r"(?i)^=NPV\("), F.coalesce(F.concat(F.lit("NPV of "), sure(2)), F.lit("Net Present Value")))
        .when(formula.rlike(pair), both)
    )


def wants_label(score: Column, kind: Column, name: Column) -> Column:
    """Whether a label should be made: results below 0.95 or named by their sheet, calculations below 0.6 or named by their sheet below 0.95."""
    by_sheet = kind == "sheet_name"
    return F.coalesce(F.when(name == "Result", by_sheet | (score < 0.95)).when(name == "Calculation", (by_sheet & (score < 0.95)) | (score < 0.6)), F.lit(False))


def weighted(parts: list[tuple[float, Column]]) -> Column:
    return sum((w * c for w, c in parts), F.lit(0.0))


def steps(x: Column, levels: list[tuple[float, float]], otherwise: float) -> Column:
    """Value of the first level that x reaches."""
    out = F.lit(otherwise)
    for least, value in reversed(levels):
        out = F.when(x >= least, value).otherwise(out)
    return out


def label_confidence(base: Column, match: Column, parent: Column, child: Column, retrieval: Column, gap: Column) -> Column:
    """Weighted confidence of a label from its score, formula match, context and the gap to the runner-up."""
    match = F.when(match >= 0.7, 0.9).when(match >= 0.4, 0.7).when(match > 0, 0.5).otherwise(0.3)
    near = lambda c: F.when(c.isNull(), 0.5).otherwise(steps(c, [(0.5, 0.9), (0.3, 0.7), (0.1, 0.6)], 0.4))
    return F.least(F.lit(1.0), weighted([(0.3, base), (0.2, match), (0.2, near(parent)), (0.2, near(child)), (0.1, F.coalesce(retrieval, F.lit(0.5)))]) * (1 - F.greatest(F.lit(0.0), F.least(F.lit(0.3), 0.3 - gap))))


def class_confidence(clarity: Column, position: Column, coherence: Column) -> Column:
    return weighted([(0.4, clarity), (0.3, position), (0.3, steps(coherence, [(0.95, 0.9), (0.8, 0.7), (0.6, 0.5)], 0.3))])


def triage(reasons: dict[str, tuple[Column, float]], label_reasons: set[str]) -> tuple[Column, Column]:
    """(confidence, three strongest reasons): label and structure start at 0.5, each reason that holds adds its impact; the least counts."""
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    part = lambda names: clamp(F.lit(0.5) + sum((F.when(reasons[r][0], reasons[r][1]).otherwise(0.0) for r in reasons if r in names), F.lit(0.0)))
    both = F.least(part(label_reasons), part(set(reasons) - label_reasons))
    held = F.filter(F.array(*(F.when(c, F.struct(F.lit(-abs(w)).alias("w"), F.lit(r).alias("r"))) for r, (c, w) in reasons.items())), lambda s: s.isNotNull())
    return both, F.transform(F.slice(F.array_sort(held), 1, 3), lambda s: s["r"])


def entity_type(rows: Column, cols: Column, has_formula: Column) -> Column:
    return F.when((rows == 1) & (cols == 1), "scalar").when((rows > 1) & (cols > 1), "table").when(has_formula, "time_series").otherwise("vector")


def replay(events: DataFrame, key: str, order: str, action: str, value: str) -> DataFrame:
    """Overlay state of last-write-wins actions: (key, action, value, n) of the event of the largest order."""
    return events.groupBy(key, action).agg(F.max(F.struct(order, value))[value].alias(value), F.count("*").alias("n"))


def header_context(candidates: DataFrame, by: str) -> DataFrame:
    """(by, layers): labels by role (primary, group, axis, title, sheet) in order, each (role, text without case) once."""
    roles = F.array(*map(F.lit, ("primary", "group", "axis", "title", "sheet")))
    once = candidates.groupBy(by, "role", F.lower("text").alias("_t")).agg(F.min(F.struct("place", "text")).alias("_best"))
    item = F.struct(F.array_position(roles, F.col("role")).alias("r"), F.col("_best.place").alias("p"), F.col("_best.text").alias("t"))
    return once.groupBy(by).agg(F.array_sort(F.collect_list(item)).alias("l")).select(by, F.transform("l", lambda s: s["t"]).alias("layers"))


def regions(cells: DataFrame, sheet: str, margin: int = 7) -> DataFrame:
    """(sheet, r1, c1, r2, c2): bounds of a sheet's cells widened by a margin, from 1."""
    box = cells.groupBy(sheet).agg(F.min("row").alias("a"), F.min("col").alias("b"), F.max("row").alias("c"), F.max("col").alias("d"))
    return box.select(sheet, F.greatest(F.lit(1), F.col("a") - margin).alias("r1"), F.greatest(F.lit(1), F.col("b") - margin).alias("c1"), (F.col("c") + margin).alias("r2"), (F.col("d") + margin).alias("c2"))


def review(cases: DataFrame, confidence: str, least: float = 0.7) -> DataFrame:
    """Cases below the least confidence."""
    return cases.where(F.col(confidence) < least)
