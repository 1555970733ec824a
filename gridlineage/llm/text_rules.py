"""Quality rules by distribution divergence; DataFrame functions only.

Two histograms of each document, its character classes and its words as each of the
language's COMMON most common words and the rest, are compared to references of its language,
which are counted over the whole corpus; words are compared as they're written.  The measure
is the Jensen-Shannon distance (base 2, so 0 to 1).  A document fails where a distance is
above its limit; documents below the minimum length are not judged by that histogram.

Defined cases: a null or empty text has no words, counts of 0, and fails the base rule of
ten words; a null language is a language of its own; equal rows get equal results; a table
may be empty; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlineage.llm.common import SPACE, cut, small

SYMBOLS = "#*$%&|<>"
COMMON = 16
MIN_CHARS, MIN_WORDS = 200, 80
#: The 0.999 quantiles of labelled good documents, 0.23 and 0.26 at scale 0.1, rounded up to tenths.
CLASS_LIMIT, WORD_LIMIT = 0.3, 0.3
SPLIT = r"[\x20\x09-\x0D]+"
#: Character classes, beside white space and the rest; no character is in two.
CLASSES = {"lower": r"\p{Ll}", "upper": r"\p{Lu}", "digit": r"\p{Nd}", "point": r"[.,;:!?'\"()-]", "symbol": r"[#*$%&|<>]"}
N_CLASSES = len(CLASSES) + 2
#: Repeated hashes of one text that are sought by value; more are found by a sort, with the same result.
FEW = 64


def word_array(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPLIT))


def _repeats() -> tuple[str, str, str, str]:
    """SQL of: window hashes, those found twice or more, positions of windows found twice or more, words that those cover."""
    five = "_hashes"
    for k in range(2, 6):
        five = f"zip_with({five}, slice(_hashes, {k}, size(_hashes)), (x, y) -> xxhash64(x, y))"
    windows = f"CASE WHEN size(_hashes) >= 5 THEN slice({five}, 1, size(_hashes) - 4) ELSE array() END"
    # few repeated hashes are sought by value, many by sorting (hash, position)
    some = "transform(filter(transform(_windows, (h, i) -> IF(array_contains(_twice, h), i, -1)), i -> i >= 0), i -> i)"
    many = (
        "transform(array(sort_array(transform(_windows, (h, i) -> struct(h AS h, i AS i)))), "
        "s -> sort_array(transform(filter(s, (x, i) -> (i > 0 AND s[i - 1].h = x.h) OR (i < size(s) - 1 AND s[i + 1].h = x.h)), x -> x.i)))[0]"
    )
    again = f"CASE WHEN size(_twice) = 0 THEN array() WHEN size(_twice) <= {FEW} THEN {some} ELSE {many} END"
    covered = (
        "CAST(CASE WHEN size(_again) = 0 THEN 0 ELSE 5 + aggregate(sequence(1, size(_again)), 0, "
        "(n, k) -> n + CASE WHEN k < size(_again) THEN least(5, _again[k] - _again[k - 1]) ELSE 0 END) END AS BIGINT)"
    )
    twice = "CASE WHEN size(array_distinct(_windows)) = size(_windows) THEN array() ELSE transform(array(sort_array(_windows)), s -> array_distinct(filter(s, (h, i) -> i > 0 AND s[i - 1] = h)))[0] END"
    return windows, twice, again, covered


def _distance(p: str, n: str, q: str, m: str) -> str:
    """Jensen-Shannon distance of two arrays of counts of sums n and m; 0 where one is empty."""
    term = "CASE WHEN {0} > 0 THEN {0} * log2(2 * {0} / (d.x + d.y)) ELSE 0 END"
    scaled = f"zip_with({p}, {q}, (x, y) -> struct(x / {n} AS x, y / {m} AS y))"
    return f"CASE WHEN {n} > 0 AND {m} > 0 THEN sqrt(greatest(CAST(0 AS DOUBLE), aggregate({scaled}, CAST(0 AS DOUBLE), (s, d) -> s + ({term.format('d.x')} + {term.format('d.y')}) / 2))) ELSE CAST(0 AS DOUBLE) END"


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.col("lang").cast("string").alias("_lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))


def common_words(docs: DataFrame) -> DataFrame:
    """(_lang, ref_words, ref_counts, ref_hashes, ref_total): each language's COMMON words, their counts, and that of all words."""
    words = _plain(docs).select("_lang", F.explode(word_array(F.col("_text"))).alias("w"))
    counts = cut(words.groupBy("_lang", "w").agg(F.count("*").alias("n")), "word-counts")
    total = counts.groupBy("_lang").agg(F.sum("n").cast("double").alias("ref_total"))
    best = _top(counts).withColumnRenamed("_lang", "_of")
    return total.join(best, F.col("_lang").eqNullSafe(F.col("_of"))).drop("_of")


def _top(counts: DataFrame) -> DataFrame:
    from pyspark.sql.window import Window

    # two steps: the best of each of 64 parts of a language, then the best of those
    part = counts.withColumn("_part", F.pmod(F.hash("w"), F.lit(64)))
    for by in (["_lang", "_part"], ["_lang"]):
        ranked = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "w"))
        part = part.withColumn("_r", ranked).where(F.col("_r") <= COMMON)
    return part.groupBy("_lang").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "w"))).alias("top")).select("_lang", F.expr("transform(top, t -> t.w)").alias("ref_words"), F.expr("transform(top, t -> CAST(-t.m AS DOUBLE))").alias("ref_counts"), F.expr("transform(top, t -> xxhash64(t.w))").alias("ref_hashes"))


def facts(docs: DataFrame, refs: DataFrame) -> DataFrame:
    """docs (doc_id, text, lang), refs of common_words -> doc_id, _lang, base counts, _classes, _shares, ref_counts, ref_total.

    One pass over the texts.  Few steps, each of which drops what the next one needn't carry.
    """
    d = _plain(docs)
    d = d.join(refs.withColumnRenamed("_lang", "_of"), d["_lang"].eqNullSafe(F.col("_of")), "left")
    keep = ["doc_id", "_lang", "ref_counts", "ref_total"]
    lines = F.filter(F.split("_text", "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    d = d.select(*keep, "ref_hashes", F.length("_text").alias("_chars"), word_array(F.col("_text")).alias("_words"), lines.alias("_lines"))
    d = d.select(
        *keep, "_chars",
        F.size("_words").cast("long").alias("n_words"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.array_join("_words", "").alias("_joined"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_hashes"),
        "ref_hashes",
    )
    # each common word's count is by how many hashes its removal takes
    shares = ", ".join(f"CASE WHEN {k} < size(ref_hashes) THEN CAST(size(_hashes) - size(array_remove(_hashes, ref_hashes[{k}])) AS DOUBLE) END" for k in range(COMMON))
    windows, twice, again, covered = _repeats()
    first, *others = CLASSES.values()
    d = d.select(*keep, "_chars", "n_words", "n_dup_lines", F.expr(f"slice(array({shares}), 1, size(ref_hashes))").alias("_shares"), F.length("_joined").alias("_held"), F.regexp_replace("_joined", first + "+", "").alias("_left"), F.expr(windows).alias("_windows"))
    d = d.select("*", F.expr(twice).alias("_twice"))
    # lengths of what is left without the first class, without the first two, and so on
    left = [F.length("_left")]
    for k in range(len(others)):
        left.append(F.length(F.regexp_replace("_left", "[" + "".join(others[: k + 1]) + "]+", "")))
    d = d.select(*keep, "_chars", "n_words", "n_dup_lines", "_shares", "_held", F.array(F.col("_held"), *left).alias("_steps"), F.expr(again).alias("_again"))
    counts = [(F.col("_steps")[k] - F.col("_steps")[k + 1]).cast("double") for k in range(len(CLASSES))]
    classes = F.array(*counts, (F.col("_chars") - F.col("_held")).cast("double"), F.col("_steps")[len(CLASSES)].cast("double"))
    symbols = F.col("_steps")[len(CLASSES) - 1] - F.col("_steps")[len(CLASSES)]
    return d.select(*keep, "n_words", F.col("_held").cast("long").alias("word_chars"), symbols.cast("long").alias("n_symbols"), "n_dup_lines", F.expr(covered).alias("n_repeat_words"), F.col("_chars").cast("double").alias("_chars"), classes.alias("_classes"), "_shares")


def class_sums(d: DataFrame) -> DataFrame:
    """(_of, ref_classes, ref_chars): the characters of each class over all of a language's documents."""
    sums = d.groupBy("_lang").agg(*(F.sum(F.col("_classes")[i]).alias(f"c{i}") for i in range(N_CLASSES)), F.sum("_chars").alias("ref_chars"))
    return sums.select(F.col("_lang").alias("_of"), F.array(*(F.col(f"c{i}") for i in range(N_CLASSES))).alias("ref_classes"), "ref_chars")


def judge(docs: DataFrame) -> DataFrame:
    """docs -> doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, class_distance, word_distance, kept."""
    refs = small(cut(common_words(docs), "common-words"))
    d = cut(facts(docs, refs), "text-facts")
    sums = small(cut(class_sums(d), "class-sums"))
    d = d.join(sums, d["_lang"].eqNullSafe(sums["_of"]), "left")
    d = d.withColumn("_n", F.col("n_words").cast("double"))
    shares = "concat(_shares, array(_n - aggregate(_shares, CAST(0 AS DOUBLE), (s, x) -> s + x)))"
    words = "concat(ref_counts, array(ref_total - aggregate(ref_counts, CAST(0 AS DOUBLE), (s, x) -> s + x)))"
    d = d.withColumn("_class", F.expr(_distance("_classes", "_chars", "ref_classes", "ref_chars")))
    d = d.withColumn("_word", F.expr(f"CASE WHEN ref_total IS NULL THEN CAST(0 AS DOUBLE) ELSE {_distance(shares, '_n', words, 'ref_total')} END"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    far = ((F.col("word_chars") >= MIN_CHARS) & (F.col("_class") > CLASS_LIMIT)) | ((F.col("n_words") >= MIN_WORDS) & (F.col("_word") > WORD_LIMIT))
    return d.withColumn("base_failed", failed).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.round("_class", 6).alias("class_distance"), F.round("_word", 6).alias("word_distance"), (~failed & ~far).alias("kept"))
