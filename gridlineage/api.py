"""The three verbs: extract workbooks into tables, document them, compare two versions.

One job takes a whole corpus: every table carries its workbook, and every join and group has
it in its key.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridlineage.functions import address, formula, text
from gridlineage.operators import diff as compare
from gridlineage.operators import edges, graph, grid, grouping, labels, names, series
from gridlineage.sources import xlsx


@dataclass
class Extract:
    """Tables of a corpus; write() and load() keep them as Parquet."""

    sheets: DataFrame
    cells: DataFrame
    edges: DataFrame
    bindings: DataFrame
    members: DataFrame
    binding_edges: DataFrame
    families: DataFrame
    table_candidates: DataFrame
    names: DataFrame
    tables: DataFrame
    validations: DataFrame
    comments: DataFrame

    def write(self, path: str) -> None:
        for f in fields(self):
            getattr(self, f.name).write.mode("overwrite").parquet(f"{path}/{f.name}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Extract:
        return cls(**{f.name: spark.read.parquet(f"{path}/{f.name}") for f in fields(cls)})


def extract(spark: SparkSession, path: str) -> Extract:
    """Tables of every workbook under path; workbooks are named by their place under it."""
    read = lambda part: _placed(xlsx.read(spark, path, part), path)
    sheets, defined, tables = (graph.keep(read(part)) for part in ("sheets", "names", "tables"))  # small, and read by several steps
    to_r1c1 = formula.udf(formula.to_r1c1, "string")
    raw = read("cells").join(sheets.select("workbook", "sheet_id", "sheet_name"), ["workbook", "sheet_id"])
    cells = raw.select(
        "workbook", "sheet_id", "sheet_name", "row", "col", "a1", "formula_a1", "value", "data_type",
        F.concat_ws(":", "workbook", address.pack(F.col("sheet_id"), F.col("row"), F.col("col"))).alias("cell"),
        to_r1c1("formula_a1", "row", "col").alias("formula_r1c1"),
        text.canonical_a1(F.col("formula_a1")).alias("canonical"),
    )
    cells = graph.keep(cells)  # parsed once, then read by every step
    found = graph.keep(cell_edges(cells, sheets, defined, tables))
    bindings, members = group(cells, found)
    binding_edges = collapse(cells, found, members)
    tops = bindings.where("binding_type = 'formula'").join(cells.select("workbook", "sheet_id", F.col("row").alias("r1"), F.col("col").alias("c1"), "canonical"), ["workbook", "sheet_id", "r1", "c1"])
    families = series.families(tops.withColumn("sheet", F.concat_ws("#", "workbook", "sheet_id")), "sheet", "canonical", ["r1", "c1"], "binding_id")
    columns = bindings.where("c1 = c2").select(F.concat_ws("#", "workbook", "sheet_id").alias("sheet"), "r1", "r2", F.col("c1").alias("col"), F.when(F.col("binding_type") == "constant", "input").otherwise("calc").alias("class"))
    return Extract(sheets, cells, found, bindings, members, binding_edges, families, series.table_candidates(columns), defined, tables, read("validations"), read("comments"))


def _placed(table: DataFrame, path: str) -> DataFrame:
    """table with workbook as its place under path; the file's name where path is the workbook itself."""
    root = re.sub(r"^[a-z0-9]+:/+", "/", path).rstrip("/")
    whole = F.regexp_replace("workbook", r"^[a-z0-9]+:/+", "/")
    under = F.when(whole.startswith(root + "/"), F.substring(whole, len(root) + 2, 1 << 20)).otherwise(F.substring_index(whole, "/", -1))
    return table.withColumn("workbook", under)


def cell_edges(cells: DataFrame, sheets: DataFrame, defined: DataFrame | None = None, tables: DataFrame | None = None) -> DataFrame:
    """(workbook, from_cell, kind, target, to_sheet_id, r1, c1, r2, c2) of every formula; sheet names are matched without case.

    Defined names and table references give the edges of what they stand for, references across sheets one edge a sheet.  What isn't
    found is kind external with an UNRESOLVED: target; a formula that can't be read is one edge of kind unparsed.
    """
    read = formula.udf(formula.edges_or_mark, formula.EDGE)
    at = ["workbook", "from_cell", "sheet_name", "row"]
    box = ["r1", "c1", "r2", "c2"]
    e = cells.where("formula_a1 IS NOT NULL").select("workbook", F.col("cell").alias("from_cell"), "sheet_name", "row", F.inline(read("formula_a1", "row", "col", "sheet_name")))
    e = graph.keep(e)  # formulas are parsed once
    unresolved = F.concat(F.lit("UNRESOLVED:"), "target")
    plain, found = e.where("kind <> 'name'"), None
    named, tabled = (e.where((F.col("kind") == "name") & (F.col("target").contains("[") if t else ~F.col("target").contains("["))) for t in (False, True))
    if defined is not None:
        uses = named.select("workbook", F.col("from_cell").alias("id"), "sheet_name", F.substring_index("target", "!", -1).alias("name"), F.when(F.col("target").contains("!"), F.regexp_replace(F.regexp_extract("target", "^(.*)!", 1), "^'|'$", "")).otherwise(F.col("sheet_name")).alias("sheet"))
        stored = defined.select("workbook", "name", "scope", F.array_join("destinations", "\n").alias("target"), "is_external")
        meant = names.resolve(uses.select("workbook", "id", "sheet", "name").distinct(), stored, ("workbook",))
        each = meant.select("workbook", F.col("id").alias("from_cell"), F.explode(F.split("target", "\n")).alias("text"))
        known = each.where("NOT startswith(text, 'UNRESOLVED:')").select("text").distinct().select("text", F.inline(read(F.concat(F.lit("="), "text"), F.lit(1), F.lit(1), F.lit(""))))
        plain = plain.unionByName(each.join(known, "text").withColumns({"sheet_name": F.lit(""), "row": F.lit(0)}).select(*at, "kind", "target", *box))
        lost = each.where("startswith(text, 'UNRESOLVED:')").select("workbook", "from_cell", F.lit("external").alias("kind"), F.col("text").alias("target"), F.lit(None).cast("int").alias("to_sheet_id"), *(F.lit(0).alias(c) for c in box))
        found = lost
    else:
        plain = plain.unionByName(named)
    if tables is not None:
        ends = address.parse_a1(F.col("ref"))
        rects = tables.select("workbook", "name", "sheet_id", *(ends[c].cast("int").alias(c) for c in box), "header_rows", "totals_rows", "columns")
        held = names.structured(tabled.select("workbook", F.col("from_cell").alias("id"), F.col("target").alias("ref"), "row"), rects, ("workbook",))
        one = (F.col("r1") == F.col("r2")) & (F.col("c1") == F.col("c2"))
        held = held.join(sheets.select("workbook", "sheet_id", "sheet_name"), ["workbook", "sheet_id"]).select("workbook", F.col("id").alias("from_cell"), F.when(one, "cell").otherwise("range").alias("kind"), F.col("sheet_name").alias("target"), F.col("sheet_id").alias("to_sheet_id"), *box, "ref")
        lost = tabled.join(held.select("workbook", "from_cell", F.col("ref").alias("target")), ["workbook", "from_cell", "target"], "left_anti").select("workbook", "from_cell", F.lit("external").alias("kind"), unresolved.alias("target"), F.lit(None).cast("int").alias("to_sheet_id"), *box)
        held = held.drop("ref").unionByName(lost)
        found = held if found is None else found.unionByName(held)
    else:
        plain = plain.unionByName(tabled)
    placed = F.col("kind").isin("cell", "range")
    known = sheets.select("workbook", F.lower("sheet_name").alias("_s"), F.col("sheet_id").alias("to_sheet_id"))
    joined = plain.withColumn("_s", F.when(placed, F.lower("target"))).join(known, ["workbook", "_s"], "left").drop("_s")
    across = joined.where(placed & F.col("to_sheet_id").isNull() & F.col("target").contains(":"))
    spans = across.select("workbook", "from_cell", "kind", "target", *box, F.substring_index("target", ":", 1).alias("first"), F.substring_index("target", ":", -1).alias("last"))
    sheet_of = names.three_d(spans, sheets, ("workbook",)).withColumnRenamed("sheet_id", "to_sheet_id")
    gone = placed & F.col("to_sheet_id").isNull()
    rest = joined.join(sheet_of.select("workbook", "from_cell", "target").distinct(), ["workbook", "from_cell", "target"], "left_anti")
    rest = rest.withColumn("target", F.when(gone, unresolved).otherwise(F.col("target"))).withColumn("kind", F.when(gone, "external").otherwise(F.col("kind")))
    columns = ["workbook", "from_cell", "kind", "target", "to_sheet_id", *box]
    out = rest.select(*columns).unionByName(sheet_of.select(*columns))
    return (out if found is None else out.unionByName(found.select(*columns))).distinct()


def group(cells: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bindings, members): rectangles of equal R1C1 formulas, and of constants that are alike in being read by ranges, without
    those of placeholders or section headers that nothing reads."""
    sheet = ["workbook", "sheet_id"]
    ranges = found.where("kind = 'range'").select("workbook", F.col("to_sheet_id").alias("sheet_id"), "r1", "c1", "r2", "c2").distinct()
    # texts that decide whether a binding is a variable; any other text is as good as x
    telling = F.when(text.is_placeholder(F.col("value")) | text.is_section_header(F.col("value")) | (F.trim("value") == ""), F.col("value")).otherwise("x")
    constants = cells.where("formula_a1 IS NULL AND value IS NOT NULL AND value <> ''").select(*sheet, "row", "col", "cell", "a1", (~F.col("data_type").isin("n", "b", "e")).alias("is_text"), telling.alias("telling"))
    key = F.concat_ws("#", "workbook", "sheet_id").alias("key")
    read = grid.in_rectangles(constants.select(key, "row", "col", "cell"), ranges.select(key, "r1", "c1", "r2", "c2"), "key").select("cell").distinct().withColumn("read", F.lit("read"))
    marked = constants.join(read, "cell", "left").withColumn("sig", F.concat(F.lit("constant:"), F.coalesce("read", F.lit(""))))
    formulas = cells.where("formula_r1c1 IS NOT NULL").select(*sheet, "row", "col", "cell", "a1", F.lit(False).alias("is_text"), F.lit("x").alias("telling"), F.concat(F.lit("formula:"), "formula_r1c1").alias("sig"))
    every = marked.drop("read").unionByName(formulas)
    rects = grid.rectangles(every.select(*sheet, "sig", "row", "col"), [*sheet, "sig"])
    ident = F.sha2(F.concat_ws("::", "workbook", "sheet_id", "sig", "r1", "c1", "r2", "c2"), 256)
    at = F.concat(address.a1(F.col("r1"), F.col("c1")), F.when((F.col("r1") < F.col("r2")) | (F.col("c1") < F.col("c2")), F.concat(F.lit(":"), address.a1(F.col("r2"), F.col("c2")))).otherwise(""))
    rects = graph.keep(rects.select(*sheet, "sig", "r1", "c1", "r2", "c2", ident.alias("binding_id"), at.alias("address_a1"), F.split("sig", ":")[0].alias("binding_type")))
    held = grid.in_rectangles(every.select(F.concat_ws("#", *sheet, "sig").alias("key"), "row", "col", "cell", "is_text", "telling"), rects.select(F.concat_ws("#", *sheet, "sig").alias("key"), "r1", "c1", "r2", "c2", "binding_id"), "key")
    held = graph.keep(held.select("cell", F.col("binding_id").alias("binding"), "is_text", "telling"))
    # placeholders and section headers that no formula reads aren't variables; constants that ranges read were told apart above
    exact = found.where("kind = 'cell'").select(F.concat_ws(":", "workbook", address.pack(F.col("to_sheet_id"), F.col("r1"), F.col("c1"))).alias("cell")).distinct()
    unread = rects.where("sig = 'constant:'").select(F.col("binding_id").alias("binding"))
    loose = held.join(unread, "binding", "left_semi")
    noise = grouping.noise(loose.select(F.col("binding").alias("id"), F.col("telling").alias("value"), "is_text", F.lit(False).alias("has_formula")), loose.join(exact, "cell", "left_semi").select(F.col("binding").alias("id")))
    noise = graph.keep(noise.select("id"))
    rects = rects.join(noise.withColumnRenamed("id", "binding_id"), "binding_id", "left_anti")
    return rects.drop("sig"), held.select("cell", "binding").join(noise.withColumnRenamed("id", "binding"), "binding", "left_anti")


def collapse(cells: DataFrame, found: DataFrame, members: DataFrame) -> DataFrame:
    """Binding edges with their kinds."""
    key = lambda w, s: F.concat_ws("#", w, s)
    exact = found.where("kind = 'cell'").select("from_cell", F.concat_ws(":", "workbook", address.pack(F.col("to_sheet_id"), F.col("r1"), F.col("c1"))).alias("to_cell"))
    by_cell = edges.collapse_cells(exact, members).withColumn("kind", F.lit("formula"))
    dynamic = found.where("kind = 'dynamic'").select("from_cell").distinct().withColumn("is_dynamic", F.lit(True))
    wide = found.where("kind = 'range'").join(dynamic, "from_cell", "left").select("from_cell", key("workbook", "to_sheet_id").alias("sheet_id"), "r1", "c1", "r2", "c2", F.coalesce("is_dynamic", F.lit(False)).alias("is_dynamic"))
    placed = cells.select("cell", key("workbook", "sheet_id").alias("sheet_id"), "row", "col")
    return edges.merge_kinds(by_cell.unionByName(edges.collapse_ranges(wide, placed, members)))


def document(x: Extract) -> DataFrame:
    """A row a variable: label from the nearest text left or above, class, entity type, dependencies in order; as columns and as JSON."""
    texts = x.cells.where("formula_a1 IS NULL").where(text.is_label(F.col("value"))).select("workbook", "sheet_id", "row", "col", F.col("value").alias("text"))
    b = x.bindings
    left = grid.nearest(b.select("binding_id", "workbook", "sheet_id", F.col("r1").alias("row"), F.col("c1").alias("col")), texts, ["workbook", "sheet_id", "row"], "col")
    above = grid.nearest(b.select("binding_id", "workbook", "sheet_id", F.col("r1").alias("row"), F.col("c1").alias("col")), texts, ["workbook", "sheet_id", "col"], "row")
    candidates = left.select("binding_id", "text", "distance", F.lit("scan_left").alias("kind"), F.lit(1).alias("place")).unionByName(above.select("binding_id", "text", "distance", F.lit("scan_above").alias("kind"), F.lit(0).alias("place")))
    multi = b.select("binding_id", ((F.col("r2") > F.col("r1")) | (F.col("c2") > F.col("c1"))).alias("multi"))
    scored = candidates.join(multi, "binding_id").withColumn("score", labels.candidate_score(F.col("kind"), F.col("text"), F.col("distance"), F.col("multi")))
    chosen = labels.select_label(scored, "binding_id")
    links = graph.neighbours(x.binding_edges.select(F.col("from_binding").alias("src"), F.col("to_binding").alias("dst"))).withColumnRenamed("node", "binding_id")
    reads = x.binding_edges.groupBy(F.col("from_binding").alias("binding_id")).agg(F.array_sort(F.collect_list("to_binding")).alias("dependencies"))
    d = b.join(x.sheets.select("workbook", "sheet_id", "sheet_name"), ["workbook", "sheet_id"]).join(chosen, "binding_id", "left").join(links, "binding_id", "left").join(reads, "binding_id", "left").join(_samples(x), "binding_id", "left")
    is_formula = F.col("binding_type") == "formula"
    label = F.coalesce("label", F.concat_ws("!", "sheet_name", "address_a1"))
    scores = labels.class_scores(label, F.col("sheet_name"), is_formula, F.coalesce("is_link", F.lit(False)), F.coalesce("n_dependents", F.lit(0)), F.coalesce("n_precedents", F.lit(0)), F.col("values"))
    name, score = labels.classify(scores)
    ruled = labels.hard_rule(name, F.col("sheet_name"), is_formula)
    by_hand = F.lit(None).cast("struct<required:boolean,rationale:string>")
    rows, cols = F.col("r2") - F.col("r1") + 1, F.col("c2") - F.col("c1") + 1
    out = d.select("workbook", "sheet_name", "address_a1", "binding_id", label.alias("label"), ruled.alias("class"), F.round(score, 6).alias("confidence"), labels.entity_type(rows, cols, is_formula).alias("entity_type"), F.coalesce("dependencies", F.array().cast("array<string>")).alias("dependencies"), labels.reconciliation(by_hand, ruled, F.col("formula")).alias("reconciliation"))
    return out.withColumn("spec", F.to_json(F.struct(*(c for c in out.columns if c != "workbook"))))


def _samples(x: Extract, most: int = 5) -> DataFrame:
    """(binding_id, values, formula, is_link): the first values of a binding, its first formula, and whether all its formulas are links."""
    c = x.members.select("cell", F.col("binding").alias("binding_id")).join(x.cells.select("cell", "row", "col", "value", "data_type", "formula_a1"), "cell")
    number = F.when(F.col("data_type").isin("n", "b"), F.col("value").try_cast("double"))
    first = c.where("value IS NOT NULL").withColumn("_k", F.row_number().over(Window.partitionBy("binding_id").orderBy("row", "col"))).where(F.col("_k") <= most)
    values = first.groupBy("binding_id").agg(F.collect_list(F.struct(number.alias("number"), F.when(number.isNull(), F.col("value")).alias("text"))).alias("values"))
    formulas = c.where("formula_a1 IS NOT NULL").groupBy("binding_id").agg(F.min_by("formula_a1", F.struct("row", "col")).alias("formula"), F.bool_and(labels.is_link(F.col("formula_a1"))).alias("is_link"))
    return values.join(formulas, "binding_id", "full")


def markdown(documented: DataFrame) -> DataFrame:
    """(workbook, sheet_name, page): a page of Markdown a sheet, its variables in order of address."""
    line = F.concat(F.lit("| "), "label", F.lit(" | "), "address_a1", F.lit(" | "), "class", F.lit(" | "), "entity_type", F.lit(" |"))
    pages = documented.groupBy("workbook", "sheet_name").agg(F.array_sort(F.collect_list(F.struct("address_a1", line.alias("line")))).alias("lines"))
    head = F.concat(F.lit("# "), F.col("sheet_name"), F.lit("\n\n| Variable | Cells | Class | Type |\n| --- | --- | --- | --- |\n"))
    return pages.select("workbook", "sheet_name", F.concat(head, F.array_join(F.transform("lines", lambda s: s["line"]), "\n")).alias("page"))


def diff(a: Extract, b: Extract) -> DataFrame:
    """Changes from a to b in their total order: workbook, type, key, details; workbooks are matched by place in the corpus, or as the only ones, sheets by name.

    Cells that kept formula and value don't show; a recalculated value that only one side has cached isn't a change.
    """
    books = [x.sheets.select("workbook").distinct().limit(2).count() for x in (a, b)]
    # one workbook each: they are versions of each other, whatever their names
    book = (F.lit("") if books == [1, 1] else F.col("workbook")).alias("workbook")

    def cells(x: Extract) -> DataFrame:
        return x.cells.select(book, F.concat_ws("!", "sheet_name", "a1").alias("key"), F.struct("formula_a1", "value").alias("v"))

    close = (F.col("_a.formula_a1").eqNullSafe(F.col("_b.formula_a1"))) & (
        F.col("_a.value").eqNullSafe(F.col("_b.value")) | text.numbers_close(F.col("_a.value"), F.col("_b.value")) | (F.col("_a.formula_a1").isNotNull() & (F.col("_a.value").isNull() != F.col("_b.value").isNull()))
    )
    keys = ["workbook", "key"]
    c = compare.keyed(cells(a), cells(b), keys, "v", close)
    kind = text.change_kind(F.col("old.formula_a1"), F.col("new.formula_a1"))
    c = c.select("workbook", F.concat(F.lit("CELL_"), "change").alias("type"), "key", F.to_json(F.struct("old", "new", kind.alias("kind"))).alias("details"))

    def sheets(x: Extract) -> DataFrame:
        return x.sheets.select(book, F.col("sheet_name").alias("key"), F.lit("").alias("v")).distinct()

    def named(x: Extract) -> DataFrame:
        return x.names.select(book, F.concat_ws("!", "scope", "name").alias("key"), F.array_join("destinations", ",").alias("v"))

    def tabled(x: Extract) -> DataFrame:
        return x.tables.select(book, F.col("name").alias("key"), F.concat_ws("!", "sheet_id", "ref", F.array_join("columns", ",")).alias("v"))

    where = lambda x: x.bindings.join(x.sheets.select("workbook", "sheet_id", "sheet_name"), ["workbook", "sheet_id"]).select("workbook", "binding_id", F.concat_ws("!", "sheet_name", "address_a1").alias("key"), "binding_type")

    def bound(x: Extract) -> DataFrame:
        return where(x).select(book, "key", F.col("binding_type").alias("v"))

    def linked(x: Extract) -> DataFrame:
        src, dst = (where(x).select(book, F.col("binding_id").alias(f"{end}_binding"), F.col("key").alias(end)) for end in ("from", "to"))
        return x.binding_edges.join(src, "from_binding").join(dst.drop("workbook"), "to_binding").select("workbook", F.concat_ws(" -> ", "from", "to").alias("key"), F.concat_ws(":", "kind", "edge_count").alias("v"))

    out = c
    for name, table in (("SHEET", sheets), ("NAME", named), ("TABLE", tabled), ("BINDING", bound), ("EDGE", linked)):
        d = compare.keyed(table(a), table(b), keys, "v")
        out = out.unionByName(d.select("workbook", F.concat(F.lit(f"{name}_"), "change").alias("type"), "key", F.to_json(F.struct("old", "new")).alias("details")))
    return compare.in_order(out)


def register_views(x: Extract) -> None:
    """Views of the tables for user SQL."""
    x.cells.createOrReplaceTempView("agent_cells")
    where = x.sheets.select("workbook", "sheet_id", "sheet_name")
    placed = x.bindings.join(where, ["workbook", "sheet_id"])
    placed.createOrReplaceTempView("agent_bindings")
    ends = placed.select("binding_id", "sheet_name", "address_a1")
    src = ends.toDF("from_binding", "from_sheet", "from_address")
    dst = ends.toDF("to_binding", "to_sheet", "to_address")
    x.binding_edges.join(src, "from_binding").join(dst, "to_binding").createOrReplaceTempView("agent_binding_dependencies")
    x.edges.createOrReplaceTempView("agent_dependencies")
    x.families.createOrReplaceTempView("agent_formula_families")
    x.table_candidates.createOrReplaceTempView("agent_table_candidates")
