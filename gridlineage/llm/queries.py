"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlineage.llm import edit_prints, mixing, packing, quality_model, secret_scan, simhash, text_rules, token_files, url_filter, warc_files
from gridlineage.llm.common import table


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of every document, written and read back."""
    return token_files.round_trip(table(spark, sf_dir, "documents"))


def op2_edit_prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text, and their likeness."""
    return edit_prints.compare_edits(table(spark, sf_dir, "documents"))


def edit_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second half of op2's method: documents grouped by banding and verification of their edit fingerprints."""
    return edit_prints.near_groups(table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    found = simhash.near_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("simhash"), 16, "0")).alias("fingerprint"), "component_id")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    return mixing.mix(table(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of every page's url; a page's outcome is the label of its id, bad if of low quality or toxic."""
    labels = table(spark, sf_dir, "labels")
    outcomes = labels.select(F.col("doc_id").alias("page_id"), F.greatest(1 - F.col("quality"), F.col("toxic")).alias("bad"))
    return url_filter.judge(table(spark, sf_dir, "pages"), outcomes)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document in its window."""
    return packing.sequences(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance weight, sampling key and verdict of every document."""
    return quality_model.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record of every page, written to archives and read back."""
    return warc_files.round_trip(table(spark, sf_dir, "pages"))


def op9_text_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict of every document."""
    return text_rules.judge(table(spark, sf_dir, "documents"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of every document."""
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus pipeline's last stage."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_token_files, op2_edit_prints, edit_groups, op3_simhash, op4_mixing, op5_url_filter, op6_packing, op7_quality, op8_warc, op9_text_rules, op10_secrets, pipeline]
    return {f.__name__: f for f in own}


#: SQL of what doesn't need a hash, model or file format that SQL lacks; the rest is tested against brute force.
OP8_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
b AS (SELECT html, max(page_id) AS best FROM p WHERE strlen(html) >= 1000 GROUP BY html)
SELECT p.page_id, strlen(p.html)::BIGINT AS payload_bytes, sha1(p.html) AS payload_digest,
       CASE WHEN b.best > p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN b.best > p.page_id THEN b.best END AS refers_to
FROM p LEFT JOIN b ON p.html = b.html
"""

_STRENGTH = "least(greatest(m * (1 - m) / greatest(s - m * m - m * (1 - m) * k, 1e-9) - 1, 2.0), 1000.0)"
_MOMENTS = "sum(bad) / sum(n) AS m, count(*) / sum(n) AS k, sum(bad * bad / n) / sum(n) AS s"
_BAD = "{0}.a / ({0}.a + {0}.b) - 2.0 * sqrt({0}.a * {0}.b / (({0}.a + {0}.b) * ({0}.a + {0}.b) * ({0}.a + {0}.b + 1))) > 0.5"
OP5_SQL = f"""
WITH url_parts AS (SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
page AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM url_parts),
bare AS (SELECT *, string_split(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '.') AS l FROM page),
depth AS (SELECT *, CASE WHEN regexp_matches(array_to_string(l, '.'), '^[0-9]+([.][0-9]+){{3}}$') OR starts_with(l[1], '[') THEN 0
  WHEN len(l) > 1 AND list_contains(['ac', 'co', 'com', 'edu', 'gov', 'mil', 'net', 'org'], l[-2]) AND regexp_matches(l[-1], '^[a-z]{{2}}$') THEN 2 ELSE 1 END AS deep FROM bare),
place AS (SELECT page_id, host, path, CASE WHEN deep = 0 THEN array_to_string(l, '.') ELSE array_to_string(l[-least(deep + 1, len(l)):], '.') END AS domain, CASE WHEN deep = 0 THEN '[]' ELSE array_to_string(l[-deep:], '.') END AS suffix FROM depth),
outcome AS (SELECT page_id, host, domain, suffix, greatest(1 - quality, toxic)::DOUBLE AS bad FROM place JOIN labels ON page_id = doc_id WHERE greatest(1 - quality, toxic) IS NOT NULL),
every AS (SELECT coalesce(sum(bad), 0) + 1.0 AS a, count(*) - coalesce(sum(bad), 0) + 1.0 AS b FROM outcome),
hosts AS (SELECT host, domain, suffix, count(*)::DOUBLE AS n, sum(bad) AS bad FROM outcome WHERE host <> '' GROUP BY ALL),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY ALL),
top AS (SELECT m, {_STRENGTH} AS t FROM (SELECT {_MOMENTS} FROM suffixes)),
of_suffix AS (SELECT suffix, {_STRENGTH} AS t FROM (SELECT suffix, {_MOMENTS} FROM domains GROUP BY suffix)),
of_domain AS (SELECT domain, {_STRENGTH} AS t FROM (SELECT domain, {_MOMENTS} FROM hosts GROUP BY domain)),
by_suffix AS (SELECT suffix, t * m + bad AS a, t * (1 - m) + n - bad AS b FROM suffixes, top),
by_domain AS (SELECT domain, t * (p.a / (p.a + p.b)) + bad AS a, t * (1 - p.a / (p.a + p.b)) + n - bad AS b FROM domains JOIN of_suffix USING (suffix) JOIN by_suffix p USING (suffix)),
by_host AS (SELECT host, t * (p.a / (p.a + p.b)) + bad AS a, t * (1 - p.a / (p.a + p.b)) + n - bad AS b FROM hosts JOIN of_domain USING (domain) JOIN by_domain p USING (domain)),
verdict AS (SELECT page_id, place.host, path, CASE WHEN h.host IS NOT NULL THEN {_BAD.format("h")} WHEN d.domain IS NOT NULL THEN {_BAD.format("d")} WHEN s.suffix IS NOT NULL THEN {_BAD.format("s")} ELSE {_BAD.format("every")} END AS bad
  FROM every, place LEFT JOIN by_host h ON h.host = place.host LEFT JOIN by_domain d ON d.domain = place.domain AND place.host <> '' LEFT JOIN by_suffix s ON s.suffix = place.suffix AND place.host <> ''),
ruled AS (SELECT *, CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/' WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
  WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/' WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM verdict)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN bad THEN 'block' ELSE 'allow' END AS verdict FROM ruled
"""

_JSD = """sqrt(greatest(0.0, list_sum(list_transform(range(1, len({p}) + 1), lambda i: (CASE WHEN {p}[i] > 0 THEN {p}[i] / list_sum({p}) * log2(2 * ({p}[i] / list_sum({p})) / ({p}[i] / list_sum({p}) + {q}[i] / list_sum({q}))) ELSE 0 END
 + CASE WHEN {q}[i] > 0 THEN {q}[i] / list_sum({q}) * log2(2 * ({q}[i] / list_sum({q})) / ({p}[i] / list_sum({p}) + {q}[i] / list_sum({q}))) ELSE 0 END) / 2))))"""
_COUNTS = ", ".join(f"(length(t) - length(regexp_replace(t, '{p}+', '', 'g')))::DOUBLE AS k{i}" for i, p in enumerate([r"\p{Ll}", r"\p{Lu}", r"\p{Nd}", r"[.,;:!?''\"()-]", "[#*$%&|<>]", r"[ \t\n\x0b\f\r]"]))
OP9_SQL = f"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, lang, t, regexp_extract_all(t, '[^ \\t\\n\\x0b\\f\\r]+') AS w FROM d),
g AS (SELECT *, list_transform(range(1, greatest(len(w) - 3, 1)), lambda i: list_slice(w, i, i + 4)) AS g FROM w),
gx AS (SELECT doc_id, unnest(g) AS gram, unnest(range(1, len(g) + 1)) AS i FROM g),
gh AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM gx) WHERE n > 1),
gr AS (SELECT doc_id, count(DISTINCT i + o)::BIGINT AS n FROM gh, (SELECT unnest(range(5)) AS o) GROUP BY doc_id),
c AS (SELECT w.doc_id, lang, w, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \\t\\n\\x0b\\f\\r]')) AS ls, coalesce(gr.n, 0) AS n_repeat_words, length(t)::DOUBLE AS len, {_COUNTS} FROM w LEFT JOIN gr USING (doc_id)),
k AS (SELECT *, [k0, k1, k2, k3, k4, k5, len - k0 - k1 - k2 - k3 - k4 - k5] AS ks FROM c),
lr AS (SELECT lang, [sum(k0), sum(k1), sum(k2), sum(k3), sum(k4), sum(k5), sum(ks[7])] AS rc FROM k GROUP BY lang),
wc AS (SELECT lang, x, count(*) AS n FROM (SELECT lang, unnest(w) AS x FROM w) GROUP BY ALL),
wt AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, x) AS r, sum(n) OVER (PARTITION BY lang) AS total FROM wc),
top AS (SELECT lang, list(x ORDER BY n DESC, x) AS rw, list(n::DOUBLE ORDER BY n DESC, x) || [(any_value(total) - sum(n))::DOUBLE] AS rs FROM wt WHERE r <= 16 GROUP BY lang),
i AS (SELECT k.*, rc, rw, rs, list_transform(rw, lambda x: len(list_filter(w, lambda y: y = x))::DOUBLE) AS pc FROM k LEFT JOIN lr ON lr.lang IS NOT DISTINCT FROM k.lang LEFT JOIN top ON top.lang IS NOT DISTINCT FROM k.lang),
j AS (SELECT *, pc || [n_words - list_sum(pc)] AS ps FROM i),
v AS (SELECT *, CASE WHEN list_sum(ks) = 0 OR list_sum(rc) = 0 THEN 0.0 ELSE {_JSD.format(p='ks', q='rc')} END AS cd, CASE WHEN rw IS NULL OR n_words = 0 THEN 0.0 ELSE {_JSD.format(p='ps', q='rs')} END AS wd, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM j)
SELECT doc_id, n_words, word_chars, n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, n_repeat_words, base_failed, round(cd, 6)::DOUBLE AS class_distance, round(wd, 6)::DOUBLE AS word_distance,
  NOT base_failed AND NOT (word_chars >= 200 AND cd > 0.3 OR n_words >= 80 AND wd > 0.3) AS kept FROM v
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_url_filter": OP5_SQL, "op8_warc": OP8_SQL, "op9_text_rules": OP9_SQL}
