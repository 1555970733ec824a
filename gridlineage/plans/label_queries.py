"""Queries of labelling, classification, confidence and overlays."""

from pyspark.sql import functions as F

from gridlineage.functions import text
from gridlineage.operators import labels
from gridlineage.plans.catalog import query

_TYPES = "['named_exact', 'scan_above', 'scan_left', 'sheet_name', 'table_column_headers', 'other']"
_CANDIDATES = f"""SELECT p_partkey % 700 AS binding, p_partkey AS place, list_extract({_TYPES}, CAST(p_partkey % 6 + 1 AS INT)) AS kind, CASE WHEN p_size % 7 = 0 THEN CAST(p_size AS VARCHAR) WHEN p_size % 7 = 1 THEN 'x' ELSE p_name END AS text, p_size % 7 + 1 AS distance, p_size > 20 AS multi FROM part"""
_CSCORE = """least(1.0, CASE WHEN regexp_matches(text, '^[-+]?[0-9]+$') THEN least(s, 0.3) ELSE s END)"""
_SCORED = f"""SELECT binding, place, kind, text, {_CSCORE} AS score FROM (SELECT *, CASE kind WHEN 'named_exact' THEN 0.95 WHEN 'scan_above' THEN 0.65 WHEN 'scan_left' THEN 0.55 WHEN 'sheet_name' THEN 0.45 WHEN 'table_column_headers' THEN 0.85 ELSE 0.1 END
+ CASE WHEN regexp_matches(text, '[A-Za-z]') THEN 0.2 ELSE 0 END + CASE WHEN length(text) BETWEEN 5 AND 50 THEN 0.1 ELSE 0 END - CASE WHEN length(text) < 3 THEN 0.2 ELSE 0 END - CASE WHEN length(text) > 100 THEN 0.1 ELSE 0 END
+ CASE WHEN multi THEN 0.1 ELSE 0 END + CASE WHEN kind LIKE 'scan%' AND distance <= 2 THEN 0.05 WHEN kind LIKE 'scan%' AND distance >= 5 THEN -0.15 ELSE 0 END AS s FROM ({_CANDIDATES}))"""


def _scored(t):
    k, s = F.col("p_partkey"), F.col("p_size")
    kinds = F.array(*map(F.lit, ("named_exact", "scan_above", "scan_left", "sheet_name", "table_column_headers", "other")))
    c = t.part.select((k % 700).alias("binding"), k.alias("place"), F.element_at(kinds, (k % 6 + 1).cast("int")).alias("kind"), F.when(s % 7 == 0, s.cast("string")).when(s % 7 == 1, "x").otherwise(F.col("p_name")).alias("text"), (s % 7 + 1).alias("distance"), (s > 20).alias("multi"))
    return c.withColumn("score", labels.candidate_score(*(F.col(x) for x in ("kind", "text", "distance", "multi"))))


@query(f"SELECT binding, place, round(score, 6)::DOUBLE AS score FROM ({_SCORED})")
def label_score(t):
    return _scored(t).select("binding", "place", F.round("score", 6).alias("score"))


@query(f"""WITH s AS ({_SCORED}), r AS (SELECT *, row_number() OVER (PARTITION BY binding ORDER BY round(score, 9) DESC, place) AS k FROM s) SELECT binding, text AS label, kind, round(score, 6)::DOUBLE AS score FROM r WHERE k = 1""")
def label_select(t):
    return labels.select_label(_scored(t), "binding")


@query("""SELECT p_partkey, CASE WHEN count(*) OVER (PARTITION BY p_type) = 1 THEN p_type WHEN count(*) OVER (PARTITION BY p_type, p_brand) = 1 THEN p_type || ' (' || p_brand || ')' ELSE p_type || ' (Row ' || p_partkey || ')' END AS unique_label FROM part""")
def duplicate_disambiguation(t):
    return labels.disambiguate(t.part, "p_type", "p_brand", "p_partkey").select("p_partkey", "unique_label")


@query("""WITH w AS (SELECT user_id % 50 AS sheet, CASE WHEN user_id % 3 = 0 THEN 'click' ELSE split_part(event_type, '_', 1) END AS prefix, count(*) AS n FROM events GROUP BY 1, 2),
b AS (SELECT sheet, arg_min(prefix, (-n, prefix)) AS prefix, max(n) / sum(n) AS share FROM w GROUP BY sheet) SELECT sheet, prefix, round(share, 6)::DOUBLE AS share FROM b WHERE round(share, 6) >= 0.3""")
def sheet_prefix(t):
    name = F.when(F.col("user_id") % 3 == 0, "click").otherwise(F.replace(F.col("event_type"), F.lit("_"), F.lit(" ")))
    return labels.sheet_prefix(t.events.select((F.col("user_id") % 50).alias("sheet"), name.alias("label")), "sheet", "label", 0.3)


_SHEET = "CASE WHEN regexp_matches(lower({0}), 'projection|calculation|engine|model|cashflow|output') THEN 'calculation' WHEN regexp_matches(lower({0}), 'assumption|parameter|config|mortality|lapse|rate|table|expense|commission|inflation|interest|tax|premium') THEN 'assumption' WHEN regexp_matches(lower({0}), 'input|data|policy') THEN 'policyholder' ELSE 'unknown' END"


@query(f"""SELECT doc_id, {_SHEET.format('text')} AS kind FROM documents""")
def sheet_type(t):
    return t.documents.select("doc_id", labels.sheet_type(F.col("text")).alias("kind"))


_SHEETS = "['Projection', 'Mortality table', 'Policyholder data', 'Results', 'Scenarios', 'Sheet1', 'Discount curve']"
_LABELS = "['Mortality rate', 'Policy number', 'Best estimate reserve', 'Age', 'Premium factor', 'Total cash', 'CSO', 'Notes', 'width', 'Sum assured']"
_BASE = f"""SELECT doc_id, list_extract({_LABELS}, CAST(doc_id % 10 + 1 AS INT)) AS label, list_extract({_SHEETS}, CAST(doc_id % 7 + 1 AS INT)) AS sheet, doc_id % 3 > 0 AS f, doc_id % 5 = 1 AS link, doc_id % 8 AS consumers, doc_id % 4 AS providers,
CAST((length(text) % 5 + length(text) % 7) AS DOUBLE) / 4 AS a, CAST(length(text) % 3000 AS DOUBLE) AS b, substr(text, 1, CAST(doc_id % 5 + 1 AS INT)) AS c FROM documents"""
_RATES = "(CASE WHEN a BETWEEN 0 AND 1 THEN 1 ELSE 0 END + CASE WHEN b BETWEEN 0 AND 1 THEN 1 ELSE 0 END) / 3.0 > 0.5"
_INPUTS = "({0} + {1} + CASE WHEN regexp_full_match(c, '[\\p{{L}}\\p{{N}}]{{1,3}}') THEN 1 ELSE 0 END) / 3.0 > 0.5".format(*(f"CASE WHEN ({x} = floor({x}) AND {x} > 1 AND {x} <= 120) OR {x} > 1000 THEN 1 ELSE 0 END" for x in "ab"))
_HOLDS = "regexp_matches({0}, '(?i)\\b({1})\\b')"
_RATE = _HOLDS.format("label", "rate|factor|percentage|%|stress|scenario")


def _sum(*parts: tuple[str, float]) -> str:
    return " + ".join(f"CASE WHEN {c} THEN {w}::DOUBLE ELSE 0::DOUBLE END" for c, w in parts)


_SCORES = f"""SELECT doc_id, sheet, f, {_sum(('ka', 0.6), ('ka AND kr', 0.15), (_HOLDS.format('sheet', 'assumptions?|rates|parameters|tables?|interest|expenses?|discount[a-z]*|curve|scenario[a-z]*'), 0.3), ('providers = 0', 0.1), ('providers > 0 AND f AND link', 0.05), ('NOT f AND consumers >= 5', 0.3), ('vr', 0.4))} AS assumption,
greatest(0::DOUBLE, {_sum(('kp', 0.6), ('kp AND kr', -0.25), (_HOLDS.format('sheet', 'policyholder|policy|data'), 0.3), ('providers = 0', 0.1), ('vi', 0.4), ('f AND providers > 0 AND link', -0.1), ('f AND providers > 0 AND NOT link', -0.5))}) AS policyholder,
CASE WHEN NOT f THEN 0::DOUBLE WHEN providers = 0 THEN 0.1::DOUBLE ELSE {_sum(('NOT link', 0.4), ('link', 0.12), ('consumers > 0', 0.4), ('providers > 0', 0.2))} END AS calculation,
{_sum((_HOLDS.format('label', 'bel|best estimate|reserve|liability|scr|capital|pvfp|embedded value|profit|total|summary|aggregat|output|result'), 0.6), (_HOLDS.format('sheet', 'results?|outputs?|report|summary'), 0.2), ('consumers = 0', 0.5), ('f', 0.3))} AS result
FROM (SELECT *, {_RATE} AS kr, {_RATES} AS vr, {_INPUTS} AS vi,
{_HOLDS.format('label', 'mortality|morbidity|lapse|surrender|expense|salary|inflation|discount|yield|interest rate|bonus|crediting rate|profit.?sharing|management action|strategy|assumptions?|rate|factor|percentage|%|stress|scenario|best.?estimate|adverse|optimistic|pessimistic|cso|table')} AS ka,
{_HOLDS.format('label', 'policy|age|date of birth|dob|sex|gender|premium|sum assured|product code|duration')} AS kp FROM ({_BASE}))"""


def _base(t):
    k, n = F.col("doc_id"), F.length("text")
    pick = lambda names, by: F.element_at(F.array(*map(F.lit, names)), (k % by + 1).cast("int"))
    label = pick(("Mortality rate", "Policy number", "Best estimate reserve", "Age", "Premium factor", "Total cash", "CSO", "Notes", "width", "Sum assured"), 10)
    sheet = pick(("Projection", "Mortality table", "Policyholder data", "Results", "Scenarios", "Sheet1", "Discount curve"), 7)
    value = lambda number, text: F.struct(number.cast("double").alias("number"), text.cast("string").alias("text"))
    none = F.lit(None)
    values = F.array(value((n % 5 + n % 7) / 4, none), value(n % 3000, none), value(none, F.substring("text", F.lit(1), (k % 5 + 1).cast("int"))))
    d = t.documents.select(k, label.alias("label"), sheet.alias("sheet"), (k % 3 > 0).alias("f"), (k % 5 == 1).alias("link"), (k % 8).alias("consumers"), (k % 4).alias("providers"), values.alias("v"))
    scores = labels.class_scores(*(F.col(c) for c in ("label", "sheet", "f", "link", "consumers", "providers", "v")))
    return d.select("*", *(v.alias(c) for c, v in scores.items()))


_NAMES = ("Assumption", "Policyholder Data", "Calculation", "Result")


@query(f"SELECT doc_id, round(assumption, 6)::DOUBLE AS assumption, round(policyholder, 6)::DOUBLE AS policyholder, round(calculation, 6)::DOUBLE AS calculation, round(result, 6)::DOUBLE AS result FROM ({_SCORES})")
def classifier_scores(t):
    return _base(t).select("doc_id", *(F.round(F.col(f"`{k}`"), 6).alias(k.split()[0].lower()) for k in _NAMES))


@query(f"""WITH b AS (SELECT *, greatest(assumption, policyholder, calculation, result) AS m FROM ({_SCORES})), c AS (SELECT *, CASE WHEN m < 0.2 THEN 'Unclassified' WHEN assumption = m THEN 'Assumption' WHEN policyholder = m THEN 'Policyholder Data' WHEN calculation = m THEN 'Calculation' ELSE 'Result' END AS class FROM b)
SELECT doc_id, class, round(least(1.0, m), 6)::DOUBLE AS confidence, CASE WHEN f AND sheet = 'Projection' AND class IN ('Assumption', 'Policyholder Data') THEN 'Calculation' ELSE class END AS ruled FROM c""")
def hard_rules(t):
    name, score = labels.classify({k: F.col(f"`{k}`") for k in _NAMES})
    return _base(t).withColumn("class", name).withColumn("confidence", F.round(score, 6)).select("doc_id", "class", "confidence", labels.hard_rule(F.col("class"), F.col("sheet"), F.col("f")).alias("ruled"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN c_custkey % 2 = 0 WHEN c_mktsegment = 'BUILDING' THEN TRUE WHEN c_mktsegment = 'MACHINERY' THEN FALSE ELSE list_extract([FALSE, TRUE, TRUE, FALSE, c_mktsegment = 'HOUSEHOLD', TRUE], CAST(c_custkey % 6 + 1 AS INT)) END AS required,
CASE WHEN c_custkey % 11 = 0 THEN 'by hand' WHEN c_mktsegment = 'BUILDING' THEN 'Key model output requiring verification' WHEN c_mktsegment = 'MACHINERY' THEN 'Structural or formatting helper, not a calculation' ELSE list_extract(['Constant value, no calculation to verify', 'Contains mathematical calculations', 'Uses actuarial formula pattern (IF, INDEX, MATCH)', 'Formatting/structural helper functions only (CONCAT, LEFT)',
CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'Intermediate calculation in model flow' WHEN 'FURNITURE' THEN 'Input data, no calculation to verify' ELSE 'No clear reconciliation requirement detected' END, 'Contains mathematical calculations'], CAST(c_custkey % 6 + 1 AS INT)) END AS rationale FROM customer""")
def reconciliation_flag(t):
    k, seg = F.col("c_custkey"), F.col("c_mktsegment")
    role = F.when(seg == "BUILDING", "Result").when(seg == "MACHINERY", "Helper").when(seg == "HOUSEHOLD", "Calculation").when(seg == "FURNITURE", "Assumption").otherwise("Other")
    formulas = (None, "=A1+B2", '=IF(A1="x-y",MATCH(B1,C:C,-1),INDEX(\'Q-1\'!A1:B2,1E-3))', '=CONCAT(LEFT(A1,2),"a*b")', "=-A1", "=CONCAT(A1,(B2)^2)")
    f = F.element_at(F.array(*map(F.lit, formulas)), (k % 6 + 1).cast("int"))
    by_hand = F.when(k % 11 == 0, F.struct((k % 2 == 0).alias("required"), F.lit("by hand").alias("rationale")))
    return t.customer.select("c_custkey", labels.reconciliation(by_hand, role, f).alias("r")).select("c_custkey", "r.required", "r.rationale")


@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN CASE WHEN p_size > 25 THEN 'Total ' || p_brand END WHEN 1 THEN CASE WHEN p_size > 25 THEN 'Average ' || p_brand END WHEN 2 THEN 'NPV of ' || p_type WHEN 3 THEN p_brand || ' ' || chr(215) || ' ' || p_type ELSE NULL END AS label,
CASE WHEN p_size > 40 THEN p_size <= 47 OR p_partkey % 2 = 0 WHEN p_size > 20 THEN p_size < 30 OR (p_partkey % 2 = 0) ELSE FALSE END AS wanted FROM part""")
def generated_label(t):
    k, size = F.col("p_partkey"), F.col("p_size")
    formulas = F.array(*map(F.lit, ("=SUM(U7:U607)", "=average(A1:A9)/2", "=NPV(A1,B1:B9)", "=A1 * B1", "=A1*B1*C1")))
    made = labels.generated_label(F.element_at(formulas, (k % 5 + 1).cast("int")), F.array(F.struct(F.col("p_brand").alias("label"), (size / 50).alias("score")), F.struct(F.col("p_type").alias("label"), F.lit(0.9).alias("score"))))
    return t.part.select("p_partkey", made.alias("label"), labels.wants_label(size / 50, F.when(k % 2 == 0, "sheet_name").otherwise("scan_left"), F.when(size > 40, "Result").when(size > 20, "Calculation").otherwise("Assumption")).alias("wanted"))


_NEAR = "CASE WHEN {0} >= 0.5 THEN 0.9 WHEN {0} >= 0.3 THEN 0.7 WHEN {0} >= 0.1 THEN 0.6 ELSE 0.4 END"


@query(f"""WITH s AS (SELECT c_custkey, (c_custkey % 10) / 10.0 AS a, (c_custkey % 7) / 7.0 AS b, (c_custkey % 4) / 4.0 AS c, c_nationkey / 25.0 AS g FROM customer)
SELECT c_custkey, round(least(1.0, (0.3 * a + 0.2 * CASE WHEN b >= 0.7 THEN 0.9 WHEN b >= 0.4 THEN 0.7 WHEN b > 0 THEN 0.5 ELSE 0.3 END + 0.2 * {_NEAR.format('c')} + 0.2 * 0.5 + 0.1 * 0.5) * (1 - greatest(0.0, least(0.3, 0.3 - g)))), 6)::DOUBLE AS label_confidence,
round(0.4 * a + 0.3 * b + 0.3 * CASE WHEN c >= 0.95 THEN 0.9 WHEN c >= 0.8 THEN 0.7 WHEN c >= 0.6 THEN 0.5 ELSE 0.3 END, 6)::DOUBLE AS class_confidence FROM s""")
def confidence_weighted(t):
    k = F.col("c_custkey")
    a, b, c, g = (k % 10) / 10.0, (k % 7) / 7.0, (k % 4) / 4.0, F.col("c_nationkey") / 25.0
    none = F.lit(None).cast("double")
    return t.customer.select("c_custkey", F.round(labels.label_confidence(a, b, c, none, none, g), 6).alias("label_confidence"), F.round(labels.class_confidence(a, b, c), 6).alias("class_confidence"))


@query("""WITH s AS (SELECT p_partkey, p_size < 10 AS generic, length(p_name) < 12 AS short, p_size > 30 AS strong, p_partkey % 3 = 0 AS single, p_partkey % 5 = 0 AS dense FROM part),
c AS (SELECT *, greatest(0.0, least(1.0, 0.5 + CASE WHEN generic THEN -0.25 ELSE 0 END + CASE WHEN short THEN -0.15 ELSE 0 END + CASE WHEN strong THEN 0.2 ELSE 0 END)) AS l, greatest(0.0, least(1.0, 0.5 + CASE WHEN single THEN -0.2 ELSE 0 END + CASE WHEN dense THEN 0.15 ELSE 0 END)) AS st FROM s)
SELECT p_partkey, round(least(l, st), 6)::DOUBLE AS confidence, round(least(l, st), 6) < 0.6 AS enrich, array_to_string(list_slice(list_filter([CASE WHEN generic THEN 'generic' END, CASE WHEN single THEN 'single' END, CASE WHEN strong THEN 'strong' END, CASE WHEN dense THEN 'dense' END, CASE WHEN short THEN 'short' END], lambda x: x IS NOT NULL), 1, 3), ',') AS reasons FROM c""")
def triage_score(t):
    s, k = F.col("p_size"), F.col("p_partkey")
    conf, why = labels.triage({"generic": (s < 10, -0.25), "short": (F.length("p_name") < 12, -0.15), "strong": (s > 30, 0.20), "single": (k % 3 == 0, -0.20), "dense": (k % 5 == 0, 0.15)}, {"generic", "short", "strong"})
    return t.part.select("p_partkey", F.round(conf, 6).alias("confidence"), (F.round(conf, 6) < 0.6).alias("enrich"), F.array_join(why, ",").alias("reasons"))


@query("""SELECT s_suppkey, CASE WHEN r = 1 AND c = 1 THEN 'scalar' WHEN r > 1 AND c > 1 THEN 'table' WHEN s_acctbal > 0 THEN 'time_series' ELSE 'vector' END AS entity FROM (SELECT *, s_suppkey % 3 + 1 AS r, s_nationkey % 2 + 1 AS c FROM supplier)""")
def entity_type(t):
    return t.supplier.select("s_suppkey", labels.entity_type(F.col("s_suppkey") % 3 + 1, F.col("s_nationkey") % 2 + 1, F.col("s_acctbal") > 0).alias("entity"))


@query("""SELECT user_id, event_type, arg_max(props, event_id) AS props, count(*) AS n FROM events GROUP BY 1, 2""")
def overlay_replay(t):
    return labels.replay(t.events, "user_id", "event_id", "event_type", "props")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice ELSE o_totalprice * (1 + (o_orderkey % 5) * 5e-10) END IS NOT NULL AND abs(o_totalprice - CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice ELSE o_totalprice * (1 + (o_orderkey % 5) * 5e-10) END) <= 1e-9 * greatest(abs(o_totalprice), abs(CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice ELSE o_totalprice * (1 + (o_orderkey % 5) * 5e-10) END)) AS close FROM orders""")
def numeric_equivalence(t):
    k, v = F.col("o_orderkey"), F.col("o_totalprice")
    other = F.when(k % 3 == 0, v).otherwise(v * (1 + (k % 5) * 5e-10))
    return t.orders.select("o_orderkey", text.numbers_close(v, other).alias("close"))


@query("""SELECT p_partkey, regexp_replace(trim(regexp_replace(p_name || '  :', '\\s+', ' ', 'g')), '[\\s:;,.-]+$', '') AS label, regexp_matches(p_brand, '^[A-Z0-9_.-]*[0-9][A-Z0-9_.-]*$') AND regexp_matches(p_brand, '[A-Z]') AS is_code FROM part""")
def label_hygiene(t):
    return t.part.select("p_partkey", text.clean_label(F.concat("p_name", F.lit("  :"))).alias("label"), text.is_id_code(F.col("p_brand")).alias("is_code"))
