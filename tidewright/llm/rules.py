"""Quality rules: a threshold table compiled into one projection, without user functions."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm.common import table, words

WINDOW = 5
#: (measure, comparison that fails, threshold); thresholds of ratios are exact decimals, compared as products.
BASE = [("n_words", "<", 10), ("repeat_ratio", ">", 0.20)]
TABLE = [
    ("symbol_ratio", ">", 0.10),       # symbols per word
    ("dup_line_ratio", ">", 0.50),     # repeated lines among lines with a word
    ("mean_word_chars", ">", 30),
    ("mean_word_chars", "<", 1.5),
    ("shout_ratio", ">", 0.60),        # capital letters among the characters of words
    ("pipe_ratio", ">", 0.25),         # lone separators per word
    ("long_stop_ratio", "<", 0.005),   # stop words per word, in texts of 100 words and more
]
#: Each measure as (numerator, denominator) over the counts of a text; without a denominator the text passes.
MEASURES = {
    "n_words": ("n_words", "one"), "repeat_ratio": ("n_repeat_words", "n_words"), "symbol_ratio": ("n_symbols", "n_words"),
    "dup_line_ratio": ("n_dup_lines", "n_lines"), "mean_word_chars": ("word_chars", "n_words"), "shout_ratio": ("n_capitals", "word_chars"),
    "pipe_ratio": ("n_pipes", "n_words"), "long_stop_ratio": ("n_stops", "n_long_words"),
}
SYMBOLS = "#*$%&|<>"
#: Common function words of English, German, French and Spanish; a long text with hardly any is no prose.
STOP_WORDS = ["the", "and", "of", "to", "in", "that", "der", "die", "und", "das", "le", "la", "les", "de", "et", "el", "los", "que", "en", "un", "is", "a"]
LONG = 100


def forms(stop_words: list) -> list:
    """Each word as it is, capitalised and in capitals."""
    return [x for w in stop_words for x in dict.fromkeys((w, w.capitalize(), w.upper()))]


def only(text: Column, chars: str) -> Column:
    """The text without all characters but those of a character class."""
    return F.regexp_replace(text, f"[^{chars}]++", "")


def fails(measure: str, op: str, threshold: float) -> Column:
    """Whether a text fails a rule: its counts against an exact fraction, so that no ratio is decided by rounding."""
    limit = Fraction(str(threshold))
    top, bottom = MEASURES[measure]
    left, right = F.col(top) * limit.denominator, F.col(bottom) * limit.numerator
    return (F.col(bottom) > 0) & (left < right if op == "<" else left > right)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: list = BASE, table_: list = TABLE, stop_words: list = STOP_WORDS) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, failed) per row.

    Words in repeated windows are those of any window of 5 words found twice or more in the text,
    first one included. Windows are compared by a 64-bit hash of their words' 64-bit hashes; texts whose
    hashes are all distinct stop there, the others sort (hash, position) and add up what repeated windows cover.

    A null text counts as empty: no words, so it fails. Texts of any length are measured whole. Repeated
    rows and null ids stay, other columns are ignored, an empty table gives no rows. A ratio just at its
    threshold passes. ``failed`` lists the failing rules, by name. ``base_failed`` goes by the rules of
    ``base``, whatever they are. No shuffle and no Python: every measure is an expression over the row.
    """
    t = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.col(id_col).alias("doc_id"), t.alias("t"))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = d.select("doc_id", words(F.col("t")).alias("ws"), lines.alias("lines"), only(F.col("t"), "#*$%&|<>").alias("symbols"), F.length(only(F.col("t"), "A-Z")).cast("long").alias("n_capitals"))
    # from here on a row has numbers and hashes, no text
    d = d.select(
        "doc_id", F.size("ws").cast("long").alias("n_words"), F.length(F.array_join("ws", "")).cast("long").alias("word_chars"), "n_capitals",
        F.size(F.filter("ws", lambda w: w.isin(forms(stop_words)))).cast("long").alias("n_stops"), F.length("symbols").cast("long").alias("n_symbols"),
        (F.length("symbols") - F.length(F.replace("symbols", F.lit("|"), F.lit("")))).cast("long").alias("n_pipes"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), F.size("lines").cast("long").alias("n_lines"),
        F.when(F.size("ws") >= WINDOW, F.transform("ws", lambda w: F.xxhash64(w))).alias("h"))
    counts = [c for c in d.columns if c != "h"]
    h = F.transform(F.slice("h", 1, F.size("h") - WINDOW + 1), lambda x, i: F.xxhash64(x, *[F.get(F.col("h"), i + k) for k in range(1, WINDOW)]))
    d = d.select(*counts, F.when(F.col("h").isNotNull(), h).alias("h"))
    at = F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    dup = F.filter("at", lambda x, k: (F.get(F.col("at"), k - 1)["h"] == x["h"]) | (F.get(F.col("at"), k + 1)["h"] == x["h"]))
    pos = F.sort_array(F.transform("dup", lambda x: x["i"]))
    cover = F.aggregate(F.transform("pos", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("pos"), k + 1) - p, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x)
    d = d.select(*counts, F.when(F.size("h") > F.size(F.array_distinct("h")), at).alias("at"))
    d = d.select(*counts, F.when(F.col("at").isNotNull(), dup).alias("dup"))
    d = d.select(*counts, F.when(F.col("dup").isNotNull(), pos).alias("pos"))
    d = d.select(
        *counts, F.coalesce(F.when(F.col("pos").isNotNull(), cover), F.lit(0)).cast("long").alias("n_repeat_words"),
        F.when(F.col("n_words") >= LONG, F.col("n_words")).otherwise(0).cast("long").alias("n_long_words"), F.lit(1).cast("long").alias("one"))
    named = lambda rules: [F.when(fails(*r), F.lit(f"{r[0]} {r[1]} {r[2]:g}")) for r in rules]
    d = d.withColumn("base", F.array_compact(F.array(*named(base)).cast("array<string>"))).withColumn("more", F.array_compact(F.array(*named(table_)).cast("array<string>")))
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (F.size("base") > 0).alias("base_failed"),
                    F.concat("base", "more").alias("failed")).withColumn("kept", F.size("failed") == 0)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d),
g AS (SELECT doc_id, i, CASE WHEN lead(w, 4) OVER o IS NOT NULL THEN [w, lead(w, 1) OVER o, lead(w, 2) OVER o, lead(w, 3) OVER o, lead(w, 4) OVER o] END AS gram FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
f AS (SELECT doc_id, i, gram IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, gram) > 1 AS twice FROM g),
c AS (SELECT doc_id, max(CAST(twice AS INT)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS covered FROM f),
n AS (SELECT doc_id, CAST(sum(covered) AS BIGINT) AS n_repeat_words FROM c GROUP BY doc_id),
l AS (SELECT doc_id, len(ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
        length(t) - length(replace(t, '|', '')) AS n_pipes, length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_capitals,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
        len(list_filter(ws, lambda x: x IN (STOPS))) AS n_stops FROM d),
m AS (SELECT l.*, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM l LEFT JOIN n USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR 2 * n_dup_lines > len(lines)
         OR word_chars > 30 * n_words OR 2 * word_chars < 3 * n_words OR 5 * n_capitals > 3 * word_chars OR 4 * n_pipes > n_words
         OR (n_words >= 100 AND 200 * n_stops < n_words)) AS kept
FROM b
""".replace("STOPS", ", ".join(f"'{x}'" for x in forms(STOP_WORDS)))
