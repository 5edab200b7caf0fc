"""Line-first quality rules.

Every line is held against rules first: punctuation (no sentence mark in a long line, or little but signs), navigation (short items
parted by bars or arrows) and boilerplate (notices of cookies, scripts, rights and the like). Failing lines are removed; a document
that loses more than ``max_lost`` of its characters is rejected, as is one that fails the base limits on words and repetition. All
of it is built from column functions on the rows themselves: no shuffle, no Python.

Repeated five-word windows are found by sorting 64-bit hashes of the windows, only in texts where the hashes are not distinct.

Defined results: null text counts as empty; empty text has no words, fails the base and is not kept. Very long texts are handled
whole, in time n log n. Repeated rows are judged alike. An empty table gives an empty result. Only the id and text columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

BLANK = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
# The line rules, in expressions that other engines read alike.
NO_SENTENCE = r"^[^.!?;:,…।॥؟،؛۔。！？；：，、．।።៖។᙮՞՝։]*$"
BARS = r"[|»›•·]"
BOILERPLATE = r"(?i)(cookie (policy|settings|notice)|accept (all )?cookies|enable javascript|javascript is (disabled|required)|all rights reserved|terms (of use|of service|and conditions)|privacy policy|skip to (main )?content|sign up for our newsletter|click here to|lorem ipsum)"


@dataclass(frozen=True)
class Options:
    min_words: int = 10
    repeat_percent: int = 20
    long_line: int = 12
    max_signs: float = 0.35
    max_lost: float = 0.5


def failing(line: Column, options: Options) -> Column:
    """Whether a line that has a word fails a rule."""
    words = F.size(F.split(F.trim(line, F.lit(" \t\n\x0b\f\r")), BLANK))
    bars = F.length(line) - F.length(F.regexp_replace(line, BARS, ""))
    signs = F.length(F.regexp_replace(line, r"[\p{L}\p{N}\s]", ""))
    punctuation = ((words >= options.long_line) & line.rlike(NO_SENTENCE)) | (signs > options.max_signs * F.length(line))
    navigation = (bars >= 3) & (3 * bars >= words)
    return punctuation | navigation | line.rlike(BOILERPLATE)


def measured(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", options: Options = Options()) -> DataFrame:
    """doc_id, the base counts, and the lines with the failing ones marked (lines: array of line, bad)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    rows = rows.select(
        "doc_id",
        "text",
        F.filter(F.split("text", BLANK), lambda w: w != "").alias("words"),
        F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    rows = rows.withColumn("h", F.transform("words", lambda w: F.xxhash64(w)))
    window = F.transform(F.sequence(F.lit(0), F.size("h") - 5), lambda i: F.xxhash64(*[F.col("h")[i + k] for k in range(5)]))
    rows = rows.withColumn("windows", F.when(F.size("h") >= 5, window).otherwise(F.array().cast("array<bigint>")))
    rows = rows.withColumn("sorted", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda x, k: F.coalesce(F.get(F.col("sorted"), k)["h"] == x["h"], F.lit(False))
    repeated = F.filter("sorted", lambda x, k: same(x, k - 1) | same(x, k + 1))
    rows = rows.withColumn("at", F.sort_array(F.transform(repeated, lambda x: x["i"])))
    covered = F.aggregate(F.transform("at", lambda p, k: F.least(F.lit(5), F.get(F.col("at"), k + 1) - p)), F.lit(0), lambda a, x: a + x)
    return rows.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("text", " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("sorted").isNull(), 0).otherwise(covered).cast("long").alias("n_repeat_words"),
        F.transform("lines", lambda x: F.struct(x.alias("line"), failing(x, options).alias("bad"))).alias("lines"),
    )


def judged(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", options: Options = Options()) -> DataFrame:
    """doc_id, the base counts, base_failed, lost_chars, line_chars, kept, and cleaned: the text without its failing lines."""
    rows = measured(docs, id_col=id_col, text_col=text_col, options=options)
    chars = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda n, x: n + F.length(x["line"]))
    rows = rows.withColumn("line_chars", chars(F.col("lines"))).withColumn("lost_chars", chars(F.filter("lines", lambda x: x["bad"])))
    failed = (F.col("n_words") < options.min_words) | (100 * F.col("n_repeat_words") > options.repeat_percent * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed)
    cleaned = F.array_join(F.transform(F.filter("lines", lambda x: ~x["bad"]), lambda x: x["line"]), "\n")
    kept = ~F.col("base_failed") & (F.col("lost_chars") <= F.lit(options.max_lost) * F.col("line_chars"))
    return rows.withColumn("kept", kept).withColumn("cleaned", cleaned).drop("lines")


def op4_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judged(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP4_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '{BLANK}'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents
), g AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, w FROM d WHERE len(w) >= 5
), v AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS s FROM g
), r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM v) WHERE n > 1
), c AS (SELECT doc_id, sum(least(5, coalesce(nxt - i, 5))) AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM r) GROUP BY doc_id
), l AS (SELECT doc_id, unnest(lines) AS line FROM d
), m AS (
  SELECT doc_id, length(line) AS chars, len(regexp_split_to_array(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{BLANK}')) AS words, length(line) - length(regexp_replace(line, '{BARS}', '', 'g')) AS bars,
    length(regexp_replace(line, '[\p{{L}}\p{{N}}\s]', '', 'g')) AS signs, regexp_matches(line, '{NO_SENTENCE}') AS unmarked, regexp_matches(line, '{BOILERPLATE}') AS boiler FROM l
), q AS (
  SELECT doc_id, sum(chars) AS chars, sum(CASE WHEN (words >= 12 AND unmarked) OR signs > 0.35 * chars OR (bars >= 3 AND 3 * bars >= words) OR boiler THEN chars ELSE 0 END) AS lost FROM m GROUP BY doc_id
), b AS (
  SELECT d.doc_id, cast(len(w) AS bigint) AS n_words, length(translate(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS word_chars,
    length(text) - length(translate(text, '{SYMBOLS}', '')) AS n_symbols, cast(len(lines) - len(list_distinct(lines)) AS bigint) AS n_dup_lines,
    cast(coalesce(c.n, 0) AS bigint) AS n_repeat_words, coalesce(q.lost, 0) <= 0.5 * coalesce(q.chars, 0) AS enough FROM d LEFT JOIN c ON d.doc_id = c.doc_id LEFT JOIN q ON d.doc_id = q.doc_id
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND enough AS kept FROM b
"""
