"""Quality rules with cross-document line frequency, in DataFrame functions only.

A line is normalised (white space runs made one space, trimmed, lower-cased, digits made 0) and hashed. A line found in
more than ``max_share`` of one host's documents, and in more than ``max_docs``, is removed there; the count is a floor
only, so that a few copies on a small host are not taken for boilerplate. A document is rejected when too little is left
of it: fewer than ``min_words`` words, or less than ``min_share`` of its words.

The host of a document is its ``source``. Lines are counted with partial sums before the shuffle, so a line that a
third of all documents hold is a few rows per task when it arrives.

Defined cases: a null text has no words and fails the base rules; a null source is a host of its own; each row is a
document of its own, repeated ids included; an empty table gives an empty result; other columns are ignored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import SPACE, WORD, table, written
from tessera.operators.kept import dealt

MAX_SHARE, MAX_DOCS, MIN_WORDS, MIN_SHARE = 0.05, 5, 10, 0.3
SYMBOLS = r"[#*$%&|<>]"


def repeated_words(words: Column, width: int = 5) -> Column:
    """Words within windows of ``width`` words that occur twice or more among ``words``, the first occurrence included.

    Words are hashed once, as column ``__hashes``, and windows by the hashes of their words. Window hashes are compared as
    plain numbers to see whether any repeats; only then are they sorted with their places."""
    n = F.size(words)

    def covered(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def of(s: Column) -> Column:
            last = F.size(s) - 1
            same = lambda x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce((k < last) & (F.get(s, k + 1)["h"] == x["h"]), F.lit(False))
            at = F.sort_array(F.transform(F.filter(s, same), lambda x: x["i"]))
            start = F.struct(F.lit(-width).alias("to"), F.lit(0).alias("sum"))
            step = lambda acc, i: F.struct(i.alias("to"), (acc["sum"] + F.least(F.lit(width), i - acc["to"])).alias("sum"))
            return F.aggregate(at, start, step, lambda acc: acc["sum"])

        return F.element_at(F.transform(F.array(placed), of), 1)

    hashes = F.transform(F.sequence(F.lit(0), n - width), lambda i: F.xxhash64(*(F.get("__hashes", i + k) for k in range(width))))
    some = F.size(F.array_distinct("__windows")) < F.size("__windows")
    return hashes, F.when(some, covered(F.col("__windows"))).otherwise(F.lit(0)).cast("long")


def line_key(line: Column) -> Column:
    return F.xxhash64(F.lower(F.regexp_replace(F.trim(F.regexp_replace(line, SPACE + "+", " ")), "[0-9]", "0")))


def with_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, host, lines, and the base statistics); ``lines`` has hash and number of words of each line with a word."""
    rows = docs.select("doc_id", F.col("source").alias("host"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("__text"))
    rows = rows.withColumn("__words", F.filter(F.split("__text", SPACE + "+"), lambda w: w != ""))
    rows = rows.withColumn("n_words", F.size("__words").cast("long"))
    rows = rows.withColumn("word_chars", (F.length("__text") - F.regexp_count("__text", F.lit(SPACE))).cast("long"))
    rows = rows.withColumn("n_symbols", F.regexp_count("__text", F.lit(SYMBOLS)).cast("long"))
    rows = rows.withColumn("__lines", F.filter(F.split("__text", "\n"), lambda x: x.rlike(WORD)))
    rows = rows.withColumn("n_dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"))
    hashes, repeated = repeated_words(F.col("__words"))
    rows = rows.withColumn("__hashes", F.transform("__words", lambda w: F.xxhash64(w)))
    rows = rows.withColumn("__windows", F.when(F.col("n_words") >= 6, hashes).otherwise(F.array().cast("array<bigint>")))
    rows = rows.withColumn("n_repeat_words", repeated)
    lines = F.transform("__lines", lambda x: F.struct(line_key(x).alias("hash"), F.regexp_count(x, F.lit(WORD)).alias("words")))
    return rows.select("doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", lines.alias("lines"))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def line_frequency(docs: DataFrame, max_share: float = MAX_SHARE, max_docs: int = MAX_DOCS, min_words: int = MIN_WORDS, min_share: float = MIN_SHARE) -> DataFrame:
    """Base statistics of each document, its words in lines that are too frequent on its host, and whether it is kept."""
    rows = written(with_statistics(docs).withColumn("__row", F.monotonically_increasing_id()), "lines")
    each = rows.select("host", F.explode(F.array_distinct("lines.hash")).alias("hash"))
    hosts = rows.groupBy(F.col("host").alias("of")).agg(F.greatest(F.count("*") * max_share, F.lit(float(max_docs))).alias("limit"))
    found = each.groupBy("host", "hash").agg(F.count("*").alias("n")).where(F.col("n") > max_docs)
    frequent = found.join(hosts, F.col("host").eqNullSafe(F.col("of"))).where(F.col("n") > F.col("limit"))
    frequent = written(frequent.select(F.col("host").alias("__host"), F.col("hash").alias("__hash")), "frequent-lines")
    lines = rows.select("__row", "host", F.explode("lines").alias("line")).select("__row", "host", "line.hash", "line.words")
    hit = lines.join(frequent, F.col("host").eqNullSafe(F.col("__host")) & (F.col("hash") == F.col("__hash")))
    lost = hit.groupBy("__row").agg(F.sum("words").alias("n_line_words"))
    left = F.col("n_words") - F.col("n_line_words")
    judged = rows.drop("lines").join(lost, "__row", "left").withColumn("n_line_words", F.coalesce("n_line_words", F.lit(0)).cast("long"))
    judged = judged.withColumn("base_failed", base_failed())
    depleted = (left < min_words) | (left < min_share * F.col("n_words"))
    return judged.withColumn("kept", ~F.col("base_failed") & ~((F.col("n_line_words") > 0) & depleted)).drop("__row")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and cross-document line frequency of every document."""
    return line_frequency(dealt(table(spark, sf_dir, "documents"))).drop("host")


OP2_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, source AS host, coalesce(text, '') AS t FROM documents),
words AS (SELECT rid, doc_id, host, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM docs),
windows AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS c
  FROM (SELECT rid, i, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - 3, 1))) AS i FROM words))),
covered AS (
  SELECT rid, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT rid, unnest(range(i, i + 5)) AS p FROM windows WHERE c > 1) GROUP BY rid),
lines AS (
  SELECT rid, host, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
         md5(lower(regexp_replace(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g')), '[0-9]', '0', 'g'))) AS k
  FROM (SELECT rid, host, unnest(string_split(t, chr(10))) AS line FROM words)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dups AS (SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines GROUP BY rid),
hosts AS (SELECT host, greatest(count(*) * 0.05::DOUBLE, 5) AS most FROM docs GROUP BY host),
counted AS (SELECT host, k, count(DISTINCT rid) AS n FROM lines GROUP BY host, k),
frequent AS (SELECT c.host, c.k FROM counted c JOIN hosts h ON c.host IS NOT DISTINCT FROM h.host WHERE c.n > h.most),
lost AS (
  SELECT l.rid, sum(l.n) AS n_line_words FROM lines l JOIN frequent f ON l.k = f.k AND l.host IS NOT DISTINCT FROM f.host GROUP BY l.rid),
stats AS (
  SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(d.n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(c.n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
         CAST(coalesce(l.n_line_words, 0) AS BIGINT) AS n_line_words
  FROM words w LEFT JOIN dups d USING (rid) LEFT JOIN covered c USING (rid) LEFT JOIN lost l USING (rid)),
based AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM stats)
SELECT *, NOT base_failed AND NOT (n_line_words > 0 AND (n_words - n_line_words < 10 OR n_words - n_line_words < 0.3 * n_words)) AS kept
FROM based
"""
