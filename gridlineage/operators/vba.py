"""Macro text: procedures, calls, token similarity, retrieval."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridlineage.operators.graph import keep


def bare(body: Column) -> Column:
    """Macro text without string literals, comments and line continuations."""
    b = F.regexp_replace(F.regexp_replace(body, r" _\r?\n", " "), '"(?:[^"\\r\\n]|"")*"', '""')
    return F.regexp_replace(b, r"(?im)('|^\s*rem\b).*$", "")


def calls(bodies: DataFrame, names: DataFrame) -> DataFrame:
    """(caller, callee): names (upper case) that a body calls outside of strings and comments; each once."""
    words = F.array_distinct(F.transform(F.regexp_extract_all(bare(F.col("body")), F.lit(r"\b([A-Za-z_][A-Za-z0-9_]*)\s*[(\s,]"), F.lit(1)), F.upper))
    return bodies.select("caller", F.explode(words).alias("name")).join(names, "name").select("caller", F.col("name").alias("callee"))


def prefer_callee(found: DataFrame) -> DataFrame:
    """Of several procedures of a called name, the one in the caller's module and branch, then in its module, then the first."""
    near = F.when((F.col("caller_module") == F.col("module")) & F.col("caller_branch").eqNullSafe(F.col("branch")), 0).when(F.col("caller_module") == F.col("module"), 1).otherwise(2)
    w = Window.partitionBy("caller", "callee").orderBy(near, "module", "procedure_id")
    return found.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two sets of tokens; null for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union)


def retrieve(chunks: DataFrame, question: str, by: list[str], order: str, most: int = 5, budget: int = 4000) -> DataFrame:
    """The best chunks for a question, with rank and score, within a token budget of four characters each; at least one of each group.

    chunks: name, identifiers, comments (arrays of lower-case tokens), chars, procedure.  A word of the question counts 3 in the name, 2
    among identifiers, 1 in comments; the score is their sum to that of all words in the name.  Where there are more chunks than `most`,
    those after the third whose procedure is among the first three gain 0.1.
    """
    asked = sorted({w for w in re.split(r"[\s._-]+", question.lower()) if len(w) > 2})
    if not asked:
        return chunks.withColumns({"score": F.lit(0.0), "rank": F.lit(0)}).where("false")
    words = F.array(*map(F.lit, asked))
    in_name = F.split(F.lower("name"), r"[\s._]+")
    shared = lambda a: F.size(F.array_intersect(F.coalesce(a, F.array().cast("array<string>")), words))
    raw = shared(in_name) * 3 + shared(F.col("identifiers")) * 2 + shared(F.col("comments"))
    w = Window.partitionBy(*by)
    hit = chunks.withColumn("_raw", raw).where("_raw > 0").withColumn("score", F.least(F.lit(1.0), F.col("_raw") / (3.0 * len(asked))))
    first = hit.withColumn("_first", F.row_number().over(w.orderBy(F.desc("score"), order)))
    beside = F.array_contains(F.collect_set(F.when(F.col("_first") <= 3, F.col("procedure"))).over(w), F.col("procedure"))
    near = (F.count("*").over(w) > most) & (F.col("_first") > 3) & beside
    again = first.withColumn("_near", F.col("score") + F.when(near, 0.1).otherwise(0.0))
    ranked = again.withColumn("rank", F.row_number().over(w.orderBy(F.desc("_near"), "_first")))
    used = F.sum("chars").over(w.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    kept = ranked.where(F.col("rank") <= most).withColumn("_used", used).where((F.col("_used") <= 4 * budget) | (F.col("rank") == 1))
    return kept.drop("_raw", "_first", "_near", "_used")


# Names that run by themselves, and the events of controls and of workbooks and sheets outside their own modules.
AUTO_NAMES = ("auto_open", "auto_close", "auto_exec", "auto_add", "auto_remove")
CONTROL_EVENTS = (
    "click", "change", "dblclick", "enter", "exit", "keydown", "keypress", "keyup", "mousedown", "mouseup", "mousemove", "afterupdate", "beforeupdate", "spindown", "spinup", "gotfocus", "lostfocus", "beforedragover", "beforedropordrop", "scroll", "error",
)
BOOK_EVENTS = (
    "workbook_open", "workbook_beforesave", "workbook_beforeclose", "workbook_aftersave", "workbook_newsheet", "workbook_sheetchange", "workbook_activate", "workbook_deactivate", "worksheet_change", "worksheet_selectionchange",
    "worksheet_beforedoubleclick", "worksheet_beforerightclick", "worksheet_activate", "worksheet_deactivate", "worksheet_calculate",
)


def module_kind(name: Column, source: Column) -> Column:
    """standard, class, form or document, by a module's name and the attributes in its text."""
    has = lambda text: F.coalesce(F.contains(source, F.lit(text)), F.lit(False))
    # Class ids of workbooks and sheets.
    book = has("0{00020819") | has("0{00020820")
    low = F.lower(name)
    return (
        F.when(low.endswith(".frm"), "form")
        .when(has("VB_PredeclaredId = True"), F.when(book, "document").otherwise("class"))
        .when(has("VB_Creatable") | has("VB_Exposed") | low.endswith(".cls"), "class")
        .otherwise("standard")
    )


def event_of(name: Column, kind: Column, module: Column) -> Column:
    """(kind, control, event) of the event that runs a procedure, null for others; kind is the procedure's, module its module's kind."""
    n = F.lower(name)
    none = F.lit(None).cast("string")
    event = lambda what, rest, control=none: F.struct(F.lit(what).alias("kind"), control.alias("control"), rest.alias("event"))
    after = lambda head: F.replace(n, F.lit(head), F.lit(""))
    last, control = F.substring_index(n, "_", -1), F.regexp_extract(n, "^(.*)_", 1)
    return (
        F.when(n.isin(*AUTO_NAMES), event("legacy_auto", after("auto_")))
        .when(kind != "sub", None)
        .when((module == "document") & n.startswith("workbook_"), event("workbook", after("workbook_")))
        .when((module == "document") & n.startswith("worksheet_"), event("worksheet", after("worksheet_")))
        .when(module.isin("class", "document") & n.startswith("application_"), event("application", after("application_")))
        .when(module.isin("class", "document", "form") & F.contains(n, F.lit("_")) & last.isin(*CONTROL_EVENTS), event("control", last, control))
        .when(n.isin(*BOOK_EVENTS), event("workbook_or_worksheet", n))
    )


def sheet_affinity(links: DataFrame) -> DataFrame:
    """(module, main, others): the sheet that a module touches most, ties to the first name, and the others in order."""
    n = links.groupBy("module", "sheet").agg(F.count("*").alias("n"))
    best = n.groupBy("module").agg(F.min(F.struct((-F.col("n")).alias("m"), "sheet"))["sheet"].alias("main"), F.array_sort(F.collect_list("sheet")).alias("all"))
    others = F.array_join(F.filter("all", lambda s: s != F.col("main")), ",")
    return best.select("module", "main", F.when(F.size("all") > 1, others).alias("others"))


_HEAD = re.compile(r"^\s*(?:(Public|Private|Friend)\s+)?(?:Static\s+)?(Sub|Function|Property\s+(?:Get|Let|Set))\s+([A-Za-z_]\w*)\s*(?:\(((?:[^()]|\(\s*\))*)\))?(?:\s+As\s+([\w.]+))?", re.I)
_END = re.compile(r"^\s*End\s+(Sub|Function|Property)\b", re.I)


def procedures(source: str) -> list[dict]:
    """Procedures of a module's text: name, kind, visibility, parameters, return type, lines, body, conditional branch."""
    out: list[dict] = []
    branches: list[str] = []
    now: dict | None = None
    lines = re.sub(r" _\r?\n\s*", " \x00", source).splitlines()
    number = 0
    for line in lines:
        number += 1
        first, text = number, line.replace("\x00", "")
        number += line.count("\x00")
        if m := re.match(r"\s*#(If|ElseIf)\s+(.*?)\s+Then", text, re.I):
            branches[-1:] = [] if m[1].lower() == "elseif" and branches else branches[-1:]
            branches.append(m[2].strip())
        elif re.match(r"\s*#Else\b", text, re.I) and branches:
            branches[-1] = branches[-1][1:] if branches[-1].startswith("!") else "!" + branches[-1]
        elif re.match(r"\s*#End\s+If", text, re.I) and branches:
            branches.pop()
        elif now is None and (m := _HEAD.match(text)):
            kind = re.sub(r"\s+", "_", m[2].lower())
            params = [p.strip() for p in (m[4] or "").split(",") if p.strip()]
            now = {"name": m[3], "kind": kind, "is_public": (m[1] or "public").lower() == "public", "parameters": params, "return_type": m[5], "line_start": first, "compile_branch": "&".join(b.replace("::", "__") for b in branches) or None, "body": [text]}
        elif now is not None:
            now["body"].append(text)
            if _END.match(text):
                out.append(now | {"line_end": number, "body": "\n".join(now["body"])})
                now = None
    return out


PROCEDURE = "name string, kind string, is_public boolean, parameters array<string>, return_type string, line_start int, line_end int, compile_branch string, body string"


def split_modules(modules: DataFrame) -> DataFrame:
    """modules (module, source) -> a row a procedure."""
    read = F.udf(lambda s: [tuple(p[c.split()[0]] for c in PROCEDURE.split(", ")) for p in procedures(s)] if s else [], f"array<struct<{', '.join(c.replace(' ', ':', 1) for c in PROCEDURE.split(', '))}>>", useArrow=True)
    return modules.select("module", F.inline(read("source")))


def canonical_body(source: str) -> str:
    """Macro text for comparing: no comments, one line a statement, one blank for white space, lower case outside of strings."""
    out = []
    for line in re.sub(r" _\r?\n", " ", source).splitlines():
        parts = re.split(r'("(?:[^"]|"")*")', line)
        kept, done = [], False
        for k, p in enumerate(parts):
            if done:
                break
            if k % 2 == 0:
                p, mark, _ = p.partition("'")
                done = bool(mark)
                p = re.sub(r"\s*:\s*(?!=)", "\n", re.sub(r"\s+", " ", p.lower()))
            kept.append(p)
        text = "".join(kept).strip()
        if text and not re.match(r"rem\b", text):
            out += [x.strip() for x in text.split("\n") if x.strip()]
    return "\n".join(out)


_REF = re.compile(r"""(?:(?:Work)?Sheets\s*\(\s*"(?P<sheet>[^"]+)"\s*\)\s*\.\s*)?(?:Range\s*\(\s*"(?P<range>[^"]+)"\s*\)|Cells\s*\(\s*(?P<row>\d+)\s*,\s*(?P<col>\d+)\s*\)|\[(?P<short>\$?[A-Z]{1,3}\$?\d+(?::\$?[A-Z]{1,3}\$?\d+)?)\]|(?P<dynamic>(?:Range|Cells)\s*\())(?=(?P<rest>[^\r\n:]*))""", re.I)
_FORMAT = re.compile(r"^\s*\.\s*(?:Interior|Font|Borders|NumberFormat|ColumnWidth|RowHeight|HorizontalAlignment|Select|Activate)\b", re.I)


def static_refs(body: str) -> list[tuple[str | None, str, str, str]]:
    """(sheet, address, access, precision) of the cells that macro text names: access is read, write or read_write, precision exact or dynamic.

    Strings that aren't addresses and comments don't count; formatting alone is left out.
    """
    from gridlineage.functions.formula import column_letters

    out: dict[tuple, None] = {}
    for line in re.sub(r" _\r?\n", " ", body).splitlines():
        line = re.sub(r"'(?=(?:[^\"]*\"[^\"]*\")*[^\"]*$).*", "", line)
        assign = re.search(r"(?<![<>=:])=(?!=)", line) if not re.match(r"\s*(?:If|ElseIf|While|Until|Loop|Do|Case|Select)\b", line, re.I) else None
        for m in _REF.finditer(line):
            if _FORMAT.match(m["rest"]):
                continue
            at = m["range"] or m["short"] or (f"{column_letters(int(m['col']))}{m['row']}" if m["row"] else "")
            left = assign is not None and m.start() < assign.start()
            access = "write" if left else "read"
            if left and at and re.search(rf"(?<![A-Z0-9]){re.escape(at)}(?![0-9])", line[assign.end() :]):
                access = "read_write"
            out.setdefault((m["sheet"], at.replace("$", "").upper(), access, "exact" if at else "dynamic"))
    return list(out)


def value_pastes(body: str) -> list[tuple[str, str]]:
    """(to, from) addresses of lines that assign one range's .Value to another's; error handlers are left out."""
    out, handler = [], False
    for line in re.sub(r" _\r?\n", " ", body).splitlines():
        if re.match(r"\s*(?:err\w*|\w*error\w*|\w*handler\w*)\s*:\s*$", line, re.I):
            handler = True
        m = re.match(r"""\s*(?:.*?\.)?Range\s*\(\s*"([^"]+)"\s*\)\s*\.\s*Value2?\s*=\s*(?:.*?\.)?Range\s*\(\s*"([^"]+)"\s*\)\s*\.\s*Value2?\s*$""", line, re.I)
        if m and not handler:
            out.append((m[1].replace("$", "").upper(), m[2].replace("$", "").upper()))
    return out


def similar_pairs(x: DataFrame, y: DataFrame, key: tuple[str, str], least: float, few: int = 16) -> DataFrame:
    """Rows of x (kind, ta) and y (kind_b, tb) of equal key and kind whose tokens' jaccard is at least `least`, as column s.

    Exact without all pairs: two such sets share one of their rarest n - ceil(least * n) + 1 tokens, n those of either, so that only
    rows which share one of those meet; where a side has but few rows of a key, all do.  Equal rows are one with their count, m.
    """

    def side(d: DataFrame, p: str, key: str, kind: str) -> DataFrame:
        d = d.groupBy(*d.columns).agg(F.count("*").alias(f"m{p}")).where(f"size(t{p}) > 0")
        own = F.xxhash64(key, kind, *(c for c in d.columns if c not in (key, kind, f"m{p}")))
        return keep(d.withColumns({"_key": F.col(key), "_kind": F.col(kind), f"_i{p}": own}))

    on = ["_key", "_kind"]
    x, y = side(x, "a", key[0], "kind"), side(y, "b", key[1], "kind_b")
    count = lambda d, name: d.groupBy(*on).agg(F.count("*").alias(name))
    many = keep(count(x, "_na").join(count(y, "_nb").hint("merge"), on).where(F.least("_na", "_nb") > few).select(*on))

    def words(d: DataFrame, p: str) -> DataFrame:
        # a token is its hash: one that two share lets a pair meet, no more
        return d.join(many, on, "left_semi").select(*on, F.col(f"_i{p}").alias("_i"), F.explode(F.transform(F.array_distinct(f"t{p}"), lambda w: F.xxhash64(w))).alias("_w"))

    often = words(x, "a").unionByName(words(y, "b")).groupBy(*on, "_w").agg(F.count("*").alias("_n"))

    def rare(d: DataFrame, p: str) -> DataFrame:
        ranked = words(d, p).join(often.hint("merge"), [*on, "_w"]).groupBy(*on, "_i").agg(F.sort_array(F.collect_list(F.struct("_n", "_w"))).alias("_ws"))
        n = F.size("_ws")
        first = F.slice("_ws", F.lit(1), (n - F.ceil(n * least - 1e-9) + 1).cast("int"))
        return ranked.select(*on, F.col("_i").alias(f"_i{p}"), F.explode(first["_w"]).alias("_w"))

    met = rare(x, "a").join(rare(y, "b").hint("merge"), [*on, "_w"]).select(*on, "_ia", "_ib").distinct()
    blocked = met.join(x.hint("merge"), [*on, "_ia"]).join(y.hint("merge"), [*on, "_ib"])
    direct = x.join(many, on, "left_anti").join(y.hint("merge"), on)
    pairs = direct.unionByName(blocked).withColumn("s", jaccard(F.col("ta"), F.col("tb")))
    return pairs.where(F.col("s") >= least).drop(*on, "_ia", "_ib")


def match_procedures(a: DataFrame, b: DataFrame, same: float = 0.5, renamed: float = 0.7, floor: int = 20) -> DataFrame:
    """(module_a, name_a, module_b, name_b, step): procedures (module, name, kind, tokens) of two versions.

    Step 1 takes equal module, name and kind; 2 the one best body of the same name in another module; 3 the one best body in
    the same module under another name, both of at least `floor` tokens.  A match must be unique on both sides.
    """
    x = a.select(F.col("module").alias("module_a"), F.col("name").alias("name_a"), F.col("kind").alias("kind"), F.col("tokens").alias("ta"))
    y = b.select(F.col("module").alias("module_b"), F.col("name").alias("name_b"), F.col("kind").alias("kind_b"), F.col("tokens").alias("tb"))
    ka, kb = ["module_a", "name_a", "kind"], ["module_b", "name_b", "kind_b"]
    out = x.join(y.hint("merge"), (F.col("module_a") == F.col("module_b")) & (F.col("name_a") == F.col("name_b")) & (F.col("kind") == F.col("kind_b"))).select(*ka, *kb, F.lit(1).alias("step"))
    for step, key, least in ((2, ("name_a", "name_b"), same), (3, ("module_a", "module_b"), renamed)):
        free_a = x.join(out.hint("merge"), ka, "left_anti")
        free_b = y.join(out.hint("merge"), kb, "left_anti")
        pairs = similar_pairs(free_a, free_b, key, least)
        if step == 3:
            pairs = pairs.where(F.least(F.size("ta"), F.size("tb")) >= floor)
        once = lambda keys: F.sum(F.col("ma") * F.col("mb")).over(Window.partitionBy(*keys))
        found = pairs.withColumn("_a", once(ka)).withColumn("_b", once(kb)).where("_a = 1 AND _b = 1").select(*ka, *kb, F.lit(step).alias("step"))
        out = out.unionByName(keep(found))
    return out.select("module_a", "name_a", "module_b", "name_b", "step")
