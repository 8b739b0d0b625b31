"""Quality rules over words and lines, and cross-document line frequency.

Built-in functions only.  Words are runs of characters other than the six ASCII blanks.

A line is normalised (lower case, runs of blanks and digits become one space, trimmed) and hashed.  A
host's line is too frequent if it occurs in more than ``least`` distinct texts of the host and in more
than ``share`` per cent of them; exact copies of a text count once.  Such lines are removed, and a
document that loses more than ``depleted`` per cent of its normalised characters is rejected.

Lines are counted before each shuffle, so a line that a third of all documents share is one row per
task.  The table of frequent lines is written and read back: Spark sends it to all tasks only if its
size is below the session's threshold, and shuffles otherwise.

Defined results: NULL text has no words and no lines.  NULL and empty host are one host.  Rows that are
repeated whole are judged alike; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.session import landed

BLANK = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
LEAST, SHARE, DEPLETED = 10, 1, 80


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANK + "+", -1), "")


def repeated_words(words: Column) -> Column:
    """Number of words in three-word windows that occur twice or more in the text.

    Window hashes are sorted together with their places; neighbours of equal hash repeat.  The places of
    repeated windows, in order, each cover up to three words that the next one does not."""

    def windows(h: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size(h) - 3),
            lambda i: F.struct(F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2)).alias("h"), i.alias("i")),
        )

    def repeats(s: Column) -> Column:
        return F.transform(
            F.filter(s, lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"])),
            lambda x: x["i"],
        )

    def covered(p: Column) -> Column:
        gaps = F.transform(p, lambda v, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - v, F.lit(3))))
        return F.aggregate(gaps, F.lit(0).cast("bigint"), lambda a, g: a + g)

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    many = _let(hashed, lambda h: _let(F.sort_array(windows(h)), lambda s: _let(F.sort_array(repeats(s)), covered)))
    return F.when(F.size(words) >= 4, many).otherwise(F.lit(0).cast("bigint"))


def base_rules(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and the row's key."""
    text = F.coalesce("text", F.lit(""))
    lined = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    return (
        docs.select("doc_id", row_key().alias("_row"), "text", words_of(F.col("text")).alias("_w"))
        .select(
            "doc_id", "_row",
            F.size("_w").cast("bigint").alias("n_words"),
            F.char_length(F.array_join("_w", "")).cast("bigint").alias("word_chars"),
            F.char_length(F.regexp_replace(text, f"[^{SYMBOLS}]+", "")).cast("bigint").alias("n_symbols"),
            _let(lined, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("bigint")).alias("n_dup_lines"),
            repeated_words(F.col("_w")).alias("n_repeat_words"),
        )
        .withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    )


def row_key() -> Column:
    """Names a row by its content."""
    return F.xxhash64(F.col("doc_id").cast("string"), F.lit(1), F.col("source"), F.lit(2), "text")


def normalised_lines(text: Column) -> Column:
    """Array of the normalised lines that are not empty."""
    flat = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09\x0B-\x0D0-9]+", " ")
    return F.filter(F.transform(F.split(flat, "\n", -1), lambda x: F.trim(x)), lambda x: x != "")


def line_table(docs: DataFrame) -> DataFrame:
    """One row per line: row key, host, hash of the text, place, hash and length of the line, length of all lines."""
    return (
        docs.select(
            row_key().alias("_row"), F.coalesce("source", F.lit("")).alias("host"),
            F.xxhash64("text").alias("copy"), normalised_lines(F.col("text")).alias("_l"),
        )
        .withColumn("total", F.aggregate("_l", F.lit(0).cast("bigint"), lambda a, x: a + F.char_length(x)))
        .select("_row", "host", "copy", "total", F.posexplode("_l").alias("place", "_x"))
        .select("_row", "host", "copy", "total", "place", F.xxhash64("_x").alias("line"), F.char_length("_x").alias("size"))
    )


def frequent_lines(lines: DataFrame, docs: DataFrame, least: int = LEAST, share: int = SHARE) -> DataFrame:
    """host, line, n_texts of the lines above the limits."""
    hosts = docs.groupBy(F.coalesce("source", F.lit("")).alias("host")).agg(F.count_distinct(F.xxhash64("text")).alias("host_texts"))
    return (
        lines.groupBy("host", "line").agg(F.count_distinct("copy").alias("n_texts")).where(F.col("n_texts") > least)
        .join(hosts, "host").where(100 * F.col("n_texts") > share * F.col("host_texts"))
        .select("host", "line", "n_texts")
    )


def depleted_rows(lines: DataFrame, frequent: DataFrame, percent: int = DEPLETED) -> DataFrame:
    """Keys of rows that lose more than ``percent`` of their normalised characters."""
    return (
        lines.join(frequent.select("host", "line"), ["host", "line"])
        .select("_row", "total", "place", "size").distinct()  # rows may be repeated
        .groupBy("_row", "total").agg(F.sum("size").alias("lost"))
        .where(100 * F.col("lost") > percent * F.col("total")).select("_row")
    )


def judge(docs: DataFrame) -> DataFrame:
    """The base columns and ``kept``: false if a base rule or the line rule rejects the document."""
    docs = docs.select("doc_id", "text", "source")
    lines = landed(line_table(docs), "lines")
    frequent = landed(frequent_lines(lines, docs), "frequent-lines")
    gone = depleted_rows(lines, frequent).withColumn("_gone", F.lit(True))
    return base_rules(docs).join(gone, "_row", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.col("_gone").isNull()).alias("kept"),
    )


ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS host FROM documents),
w AS (SELECT doc_id, text, list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l
      FROM d),
g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) >= 3),
t AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM g),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM t WHERE n > 1) GROUP BY 1),
b AS (SELECT w.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
             length(regexp_replace(text, '[^{SYMBOLS}]+', '', 'g'))::BIGINT AS n_symbols,
             (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN r USING (doc_id)),
e AS (SELECT doc_id, host, text, trim(x, ' ') AS line
      FROM (SELECT doc_id, host, text, unnest(string_split(regexp_replace(lower(text), '[\\x20\\x09\\x0B-\\x0D0-9]+', ' ', 'g'), chr(10))) AS x FROM d)
      WHERE trim(x, ' ') <> ''),
h AS (SELECT host, count(DISTINCT text) AS host_texts FROM d GROUP BY 1),
f AS (SELECT host, line FROM (SELECT host, line, count(DISTINCT text) AS n FROM e GROUP BY 1, 2) JOIN h USING (host)
      WHERE n > {LEAST} AND 100 * n > {SHARE} * host_texts),
gone AS (SELECT doc_id FROM e LEFT JOIN (SELECT host, line, true AS hit FROM f) USING (host, line)
         GROUP BY 1 HAVING 100 * coalesce(sum(length(line)) FILTER (WHERE hit), 0) > {DEPLETED} * sum(length(line)))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND doc_id NOT IN (SELECT doc_id FROM gone) AS kept
FROM b
"""
