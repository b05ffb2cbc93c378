"""Mixing sources to target weights by hash-threshold histograms.

Every document has a 60-bit hash of its id and text. A source whose target is q times its size and a rest takes all
its documents q times, and once more those with a hash below the source's threshold. Thresholds come from nested
histograms: sizes are summed by source and 12-bit hash bucket, the budget falls into one bucket, and only that
bucket's documents are summed again by their next 24 bits, and once more by the last 24. Nothing is sorted by document.
The documents on the edge itself, which share one hash, are numbered by partition counts, and as many of them are taken
as come nearest to the budget.

Defined cases: a null text has size 0; a null source is a source, ordered last; rows with equal id and text share a
hash, and where the threshold falls among them the first few by number are taken once more; a source of size 0 has
target 0 and takes nothing; an empty table gives an empty result; other columns are ignored by ``mix`` and kept by
``apply_mix``, whatever their names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import WORD, fresh, table, written
from tessera.operators.kept import dealt

BITS = (12, 24, 24)  # of the hash, by level
WEIGHTS = (5, 2, 1)


def doc_size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def doc_hash(doc_id: Column, text: Column) -> Column:
    """60 bits of the MD5 of id and text; the same in any SQL engine."""
    key = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, sum(BITS) // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = 3) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Targets share the total by weight; one stops at ``most`` times its source. In ascending order of that stop over
    weight, the stopped sources come first, and what is left over the remaining weight is the rest's common share.
    The windows without partitions hold one row per source, never documents."""
    every = W.orderBy(F.col("source").asc_nulls_last())
    n = F.row_number().over(every) - 1
    weight = F.lit(float(weights[-1]))
    for k in reversed(range(len(weights) - 1)):
        weight = F.when(n % len(weights) == k, F.lit(float(weights[k]))).otherwise(weight)
    rows = sizes.withColumn("__w", weight)
    by = W.orderBy((F.col("source_size") * most / F.col("__w")), F.col("source").asc_nulls_last())
    before, after = by.rowsBetween(W.unboundedPreceding, -1), by.rowsBetween(0, W.unboundedFollowing)
    total = F.sum("source_size").over(W.partitionBy())
    share = (total - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))).cast("double") / F.sum("__w").over(after)
    rows = rows.withColumn("__share", share).withColumn("__stopped", F.col("source_size") * most <= F.col("__share") * F.col("__w"))
    common = F.min(F.when(~F.col("__stopped"), F.struct(F.col("source_size") * most / F.col("__w"), F.col("source").isNull(), "source", "__share"))).over(W.partitionBy())["__share"]
    target = F.when(F.col("__stopped"), (F.col("source_size") * most).cast("double")).otherwise(common * F.col("__w"))
    return rows.select("source", "source_size", target.alias("target"))


def thresholds(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, source_size, target, copies, below, edge, among) from ``rows`` (source, size, hash): a document is taken ``copies``
    times, and once more if its hash is less than ``below``, or is that of the edge and its number there under ``edge``.
    ``among``: how many documents share the edge's hash."""
    size, target = F.col("source_size"), F.col("target")
    copies = F.when(size > 0, F.floor(target / size)).otherwise(F.lit(0)).cast("long")
    state = targets.withColumn("copies", copies).withColumn("__left", F.when(size > 0, target - F.col("copies") * size).otherwise(F.lit(0.0))).withColumn("below", F.lit(None).cast("long")).withColumn("__at", F.lit(0).cast("long"))
    state = written(state, "mix-state")
    for level in range(len(BITS)):
        shift = sum(BITS[level + 1 :])
        histogram = rows.groupBy("source", F.shiftright("hash", shift).alias("__b")).agg(F.sum("size").alias("__sum"), F.count("*").alias("__n"))
        cum = F.sum("__sum").over(W.partitionBy("source").orderBy("__b").rowsBetween(W.unboundedPreceding, 0))
        histogram = histogram.withColumn("__cum", cum)
        h, s = histogram.alias("h"), state.alias("s")
        over = h.join(s, F.col("h.source").eqNullSafe(F.col("s.source"))).where(F.col("h.__cum") > F.col("s.__left"))
        edge = over.groupBy(F.col("s.source").alias("source")).agg(F.min(F.struct(F.col("h.__b").alias("b"), F.col("h.__cum").alias("cum"), F.col("h.__sum").alias("sum"), F.col("h.__n").alias("n"))).alias("e")).alias("e")
        state = s.join(edge, F.col("s.source").eqNullSafe(F.col("e.source")), "left").select("s.source", "source_size", "target", "copies", (F.col("__left") - (F.col("e.cum") - F.col("e.sum"))).alias("__left"), "below", F.col("e.b").alias("__at"), F.col("e.sum").alias("__edge"), F.col("e.n").alias("__among"))
        state = written(state, "mix-state")
        if shift:
            r, s = rows.alias("r"), state.where("__at is not null").alias("s")
            rows = r.join(s, F.col("r.source").eqNullSafe(F.col("s.source")) & (F.shiftright("r.hash", shift) == F.col("s.__at")), "left_semi")
            rows = written(rows, "mix-edge")
    at = F.col("__at")
    nearest = F.floor(F.col("__left") * F.col("__among") / F.col("__edge") + 0.5)  # of the documents on the edge
    nothing = F.lit(1 << sum(BITS))
    return state.select("source", "source_size", "target", "copies", F.coalesce(at, nothing).alias("below"), F.coalesce(nearest, F.lit(0)).cast("long").alias("edge"), F.coalesce("__among", F.lit(0)).alias("among"))


def plan_mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = 3) -> tuple[DataFrame, DataFrame]:
    """The narrow rows (doc_id, source, size, hash) of all documents, and each source's thresholds."""
    rows = written(docs.select("doc_id", "source", doc_size(F.col("text")).alias("size"), doc_hash(F.col("doc_id"), F.col("text")).alias("hash")), "mix-rows")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    return rows, written(thresholds(rows.select("source", "size", "hash"), source_targets(sizes, weights, most)), "mix-plan")


def with_times(rows: DataFrame, plan: DataFrame, source: str, hashed: str, out: str) -> DataFrame:
    """``rows`` and, as column ``out``, how often the plan takes each; ``hashed`` names the column of their hash.

    Only where several rows share the hash on the edge are those written and numbered: rows of a partition in order,
    after all those of the partitions before it."""
    names = fresh(rows, "p_source", "p_copies", "p_below", "p_edge", "p_among", "tied_row", "tied_part", "c_source", "c_part", "c_before")
    p_source, p_copies, p_below, p_edge, p_among, number, part, c_source, c_part, before = names
    narrow = plan.select(*(F.col(c).alias(n) for c, n in zip(("source", "copies", "below", "edge", "among"), names)))
    joined = rows.join(narrow, F.col(source).eqNullSafe(F.col(p_source)))
    below, here = F.col(hashed) < F.col(p_below), F.col(hashed) == F.col(p_below)
    if plan.where("among > 1").isEmpty():
        more = below | (here & (F.col(p_edge) > 0))
        return joined.withColumn(out, F.col(p_copies) + F.when(more, 1).otherwise(0)).drop(*names[:5])
    plain = joined.where(~here | (F.col(p_among) <= 1)).withColumn(out, F.col(p_copies) + F.when(below | (here & (F.col(p_edge) > 0)), 1).otherwise(0))
    tied = written(joined.where(here & (F.col(p_among) > 1)).withColumn(number, F.monotonically_increasing_id()).withColumn(part, F.shiftright(number, 33)), "mix-tied")
    counts = tied.groupBy(p_source, part).agg(F.count("*").alias(before))
    counts = counts.withColumn(before, F.sum(before).over(W.partitionBy(p_source).orderBy(part).rowsBetween(W.unboundedPreceding, -1)))
    c = counts.select(F.col(p_source).alias(c_source), F.col(part).alias(c_part), F.coalesce(before, F.lit(0)).alias(before))
    local = F.row_number().over(W.partitionBy(p_source, part).orderBy(number)) - 1  # a group is a task's rows of one source
    tied = tied.withColumn(number, local).join(c, F.col(p_source).eqNullSafe(F.col(c_source)) & (F.col(part) == F.col(c_part)))
    tied = tied.withColumn(out, F.col(p_copies) + F.when(F.col(number) + F.col(before) < F.col(p_edge), 1).otherwise(0))
    return plain.drop(*names[:5]).unionByName(tied.select(*plain.drop(*names[:5]).columns))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = 3) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken): words that the mix takes of each document."""
    rows, plan = plan_mix(docs, weights, most)
    timed = with_times(rows, plan, "source", "hash", "times").alias("r")
    joined = timed.join(plan.select(F.col("source").alias("of"), "source_size", "target"), F.col("source").eqNullSafe(F.col("of")))
    taken = F.when(F.col("source_size") > 0, F.col("size") * F.col("times")).otherwise(F.lit(0)).cast("long")
    return joined.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"))


def apply_mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = 3) -> DataFrame:
    """The mixed documents, with the input's columns: each row as often as the mix takes it. A document without words stays once."""
    _, plan = plan_mix(docs, weights, most)
    hashed, times, one = fresh(docs, "mix_hash", "mix_times", "mix_one")
    timed = with_times(docs.withColumn(hashed, doc_hash(F.col("doc_id"), F.col("text"))), plan, "source", hashed, times)
    n = F.when(doc_size(F.col("text")) > 0, F.col(times)).otherwise(F.lit(1)).cast("int")
    return timed.withColumn(one, F.explode(F.array_repeat(F.lit(0), n))).select(*docs.columns)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed by weights 5, 2, 1; targets stop at 3 times a source's size."""
    return mix(dealt(table(spark, sf_dir, "documents"))).select("doc_id", "size", "source_size", "target", "taken")


OP9_SQL = r"""
WITH rows AS (
  SELECT doc_id, source,
         CAST(length(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')), 1, 15) AS BIGINT) AS hash
  FROM documents),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM rows GROUP BY source),
weighted AS (
  SELECT source, source_size,
         CAST(CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS w
  FROM sizes),
shared AS (
  SELECT *, source_size * 3 / w AS ratio,
         CAST(sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (ORDER BY source_size * 3 / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
           / sum(w) OVER (ORDER BY source_size * 3 / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share
  FROM weighted),
common AS (SELECT share FROM shared WHERE source_size * 3 > share * w ORDER BY ratio, source NULLS LAST LIMIT 1),
targets AS (
  SELECT source, source_size,
         CASE WHEN source_size * 3 <= share * w THEN CAST(source_size * 3 AS DOUBLE) ELSE (SELECT share FROM common) * w END AS target
  FROM shared),
planned AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS copies FROM targets),
summed AS (
  SELECT r.doc_id, r.size, p.source_size, p.target, p.copies,
         p.target - p.copies * p.source_size AS budget,
         sum(r.size) OVER (PARTITION BY r.source ORDER BY r.hash RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
         sum(r.size) OVER (PARTITION BY r.source, r.hash) AS own,
         count(*) OVER (PARTITION BY r.source, r.hash) AS among,
         row_number() OVER (PARTITION BY r.source, r.hash) - 1 AS number
  FROM rows r JOIN planned p ON r.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN source_size = 0 THEN 0 ELSE size * (copies + CASE WHEN upto <= budget OR (own > 0 AND number < floor((budget - (upto - own)) * among / own + 0.5)) THEN 1 ELSE 0 END) END AS BIGINT) AS taken
FROM summed
"""
