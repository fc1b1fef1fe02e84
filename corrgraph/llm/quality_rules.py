"""Quality rules, lines first. DataFrame operations only.

Every line is tested by three rules, and a line that fails one is removed:

* punctuation: it has LINE_SYMBOLS or more symbols a word, or no letter or digit at all;
* navigation: a short line of menu words, or one with two or more menu separators;
* boilerplate: a notice (rights, licence, cookies, scripts) that is most of a short line.

A document that loses more than MAX_LOST of its word characters to removed lines is rejected, and so
is one that fails the base rules (too few words, or too many words in repeated five-word windows).

Repeated windows are found within the row: windows are hashed to 64 bits (two different windows of
one document share a hash with a chance near n^2 / 2^65), and only documents in which some hash
repeats have their windows sorted. No rows are exploded or shuffled, so skew has nothing to act on.

Defined results: null text has no words and fails the base rules, as does an empty one; rows are
judged one by one, so repeated rows give repeated results; other columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corrgraph.llm.common import SPACE, WORD, documents, text_of

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: Symbols a word from which a line fails, and the share of word characters whose loss rejects.
LINE_SYMBOLS = 0.5
MAX_LOST = 0.5
#: A notice or a menu is looked for in lines of at most so many words.
SHORT_LINE = 20

SYMBOLS = r"[#*$%&|<>]"
#: Fixed patterns of the line rules.
MENU = r"(?i)^\s*(home|menu|log ?in|sign (in|up)|register|search|contact( us)?|about( us)?|next|previous|prev|back to top|read more|skip to content|share|site ?map|subscribe)\b[^.!?]{0,40}$"
SEPARATORS = r"\S\s*([|»›·•]|::|>>)\s*\S.*\S\s*([|»›·•]|::|>>)\s*\S"
NOTICE = r"(?i)(all rights reserved|licen[sc]ed under|released under the|creative commons|terms (of|and) (use|service|conditions)|privacy policy|cookie(s| policy)|enable javascript|lorem ipsum|copyright\b|\(c\) ?\d{4}|©)"


def let(value: Column, body) -> Column:
    """body(value) with the value worked out once, not once for each element that a lambda visits."""
    return F.element_at(F.transform(F.array(value), body), 1)


def word_chars(line: Column) -> Column:
    return F.length(F.regexp_replace(line, SPACE + "+", ""))


def words_in(line: Column) -> Column:
    return F.regexp_count(line, F.lit(WORD))


def line_fails(line: Column) -> Column:
    """Whether a line breaks one of the three rules; a line without words breaks none."""
    n = words_in(line)
    symbols = F.regexp_count(line, F.lit(SYMBOLS))
    short = n <= SHORT_LINE
    return (n > 0) & (
        (symbols >= LINE_SYMBOLS * n)
        | ~F.rlike(line, F.lit(r"[\p{L}\p{N}]"))
        | (short & (F.rlike(line, F.lit(MENU)) | F.rlike(line, F.lit(SEPARATORS)) | F.rlike(line, F.lit(NOTICE))))
    )


def window_hashes(words: Column) -> Column:
    return F.when(
        F.size(words) >= WINDOW,
        F.transform(F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW))),
    ).otherwise(F.array().cast("array<bigint>"))


def covered(hashes: Column) -> Column:
    """Words under windows that occur twice or more."""

    def by_place(order: Column) -> Column:
        # order: windows by (hash, place); one is repeated if a neighbour has its hash
        same = lambda i, j: F.get(order, i)["h"].eqNullSafe(F.get(order, j)["h"])
        return F.array_sort(
            F.transform(
                F.filter(F.transform(order, lambda x, i: F.struct(x["p"].alias("p"), (((i > 0) & same(i, i - 1)) | same(i, i + 1)).alias("r"))), lambda x: x["r"]),
                lambda x: x["p"],
            )
        )

    def reach(places: Column) -> Column:
        return F.aggregate(
            places,
            F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).cast("long").alias("end")),
            lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW).cast("long"), p + WINDOW - a["end"])).alias("n"), (p + WINDOW).alias("end")),
            lambda a: a["n"],
        )

    entries = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.cast("long").alias("p"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(
        let(entries, lambda order: let(by_place(order), reach))
    )


def quality(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: the base measures, both verdicts, and the cleaned text."""
    text = text_of(text_col)
    words = F.filter(F.split(text, SPACE + "+", -1), lambda w: w != "")
    lines = F.filter(F.split(text, "\n", -1), lambda line: words_in(line) > 0)
    judged = F.transform(F.split(text, "\n", -1), lambda line: F.struct(line.alias("line"), line_fails(line).alias("fails")))
    of = lambda xs, fails: F.transform(F.filter(xs, lambda x: x["fails"] == F.lit(fails)), lambda x: x["line"])
    lost = lambda xs: F.aggregate(of(xs, True), F.lit(0).cast("long"), lambda a, x: a + word_chars(x).cast("long"))
    measured = df.select(
        F.col(f"`{id_col}`").alias("_id"),
        F.length(F.regexp_replace(text, SPACE + "+", "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), let(window_hashes(w), covered).alias("r"))).alias("_words"),
        let(judged, lambda xs: F.struct(lost(xs).alias("lost"), F.array_join(of(xs, False), "\n").alias("clean"))).alias("_judged"),
    )
    n, repeated = F.col("_words.n"), F.col("_words.r")
    failed = (n < MIN_WORDS) | (100 * repeated > MAX_REPEAT_PERCENT * n)
    return measured.select(
        F.col("_id").alias(id_col),
        n.alias("n_words"),
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        repeated.alias("n_repeat_words"),
        failed.alias("base_failed"),
        (~failed & (F.col("_judged.lost") <= MAX_LOST * F.col("word_chars"))).alias("kept"),
        F.col("_judged.lost").alias("lost_chars"),
        F.col("_judged.clean").alias("clean_text"),
    )


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    """quality() with a digest of the cleaned text in its place."""
    return quality(documents(spark, sf_dir)).withColumn("clean_sha256", F.sha2("clean_text", 256)).drop("clean_text")


OP6_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
lines AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, unnest(generate_series(1, len(string_split(t, chr(10))))) AS nth FROM d),
seen AS (
  SELECT doc_id, line, nth, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
         len(regexp_extract_all(line, '[#*$%&|<>]')) AS s,
         length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')) AS c
  FROM lines),
judged AS (
  SELECT *, n > 0 AND (s >= 0.5 * n OR NOT regexp_matches(line, '[\pL\pN]')
         OR (n <= 20 AND (regexp_matches(line, '{menu}') OR regexp_matches(line, '{separators}') OR regexp_matches(line, '{notice}')))) AS fails
  FROM seen),
lost AS (
  SELECT doc_id,
         sum(CASE WHEN n > 0 THEN 1 ELSE 0 END) - count(DISTINCT CASE WHEN n > 0 THEN line END) AS n_dup_lines,
         sum(CASE WHEN fails THEN c ELSE 0 END) AS lost_chars,
         sha256(coalesce(string_agg(line, chr(10) ORDER BY nth) FILTER (WHERE NOT fails), '')) AS clean_sha256
  FROM judged GROUP BY doc_id),
win AS (
  SELECT doc_id, i, ws[i:i+4] AS x FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 4)) AS i FROM w WHERE len(ws) >= 5)),
rep AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS k FROM win),
cov AS (SELECT doc_id, count(DISTINCT p) AS r FROM (SELECT doc_id, unnest(generate_series(i, i + 4)) AS p FROM rep WHERE k > 1) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, n_dup_lines, coalesce(r, 0) AS n_repeat_words, lost_chars, clean_sha256
  FROM w JOIN lost USING (doc_id) LEFT JOIN cov USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND lost_chars <= 0.5 * word_chars AS kept, CAST(lost_chars AS BIGINT) AS lost_chars, clean_sha256
FROM b
""".replace("{menu}", MENU).replace("{separators}", SEPARATORS).replace("{notice}", NOTICE)
