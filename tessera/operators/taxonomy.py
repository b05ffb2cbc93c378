"""Skills and role families: matching, document frequency, presence vectors, adjacency, classification."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import vocabulary as V
from tessera.functions.text import c

GENERIC_TITLE = r"(?i)^((senior|sr\.?|junior|jr\.?|lead|principal|staff|experienced|expert|mid)\s+)*(software\s+)?(engineer|developer|programmer|analyst|specialist|manager|consultant|architect)(\s+(i{1,3}|iv|v|\d+))?$"


def word(term: str) -> str:
    return r"\b" + re.escape(term.lower()) + r"\b"


def skills_in(text: Column | str, skills: list[tuple[str, list[str]]] = V.SKILLS) -> Column:
    """Skills whose alias occurs in the text, in the vocabulary's order."""
    low = F.lower(F.coalesce(c(text), F.lit("")))
    return F.array_compact(F.array(*(F.when(low.rlike("|".join(word(a) for a in aliases)), F.lit(name)) for name, aliases in skills)))


def family_of(text: Column | str, families: dict[str, list[str]] = V.FAMILIES) -> Column:
    """The family with most keywords found; of equals the one found earliest, then the first listed."""
    low = F.lower(F.coalesce(c(text), F.lit("")))
    entries = []
    for k, (name, words) in enumerate(families.items()):
        at = [F.nullif(F.regexp_instr(low, F.lit(word(w))), F.lit(0)) for w in words]
        hits = sum((a.isNotNull().cast("int") for a in at), F.lit(0))
        first = F.coalesce(F.least(*at), F.lit(0)) if len(at) > 1 else F.coalesce(at[0], F.lit(0))
        entries.append(F.struct(hits.alias("hits"), (-first).alias("early"), F.lit(-k).alias("ord"), F.lit(name).alias("name")))
    best = F.array_max(F.array(*entries))
    return F.when(best["hits"] > 0, best["name"])


def classify_job(title: Column | str, responsibility: Column | str, description: Column | str) -> Column:
    """(family, confidence): from the title; from the text only where the title is generic; else unknown."""
    by_title, generic = family_of(title), F.coalesce(c(title), F.lit("")).rlike(GENERIC_TITLE)
    by_text = F.when(generic, F.coalesce(family_of(responsibility), family_of(description)))
    return F.struct(F.coalesce(by_title, by_text).alias("family"), F.when(by_title.isNotNull(), "title").when(by_text.isNotNull(), "jd_fallback").otherwise("unknown").alias("confidence"))


def idf(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, df, idf) of ``terms`` (term) in ``docs`` (doc, terms array): ln(N / df), ln N if absent, 0 for no documents."""
    n = docs.agg(F.count("*").alias("n"))
    df = docs.select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    out = terms.join(df, "term", "left").na.fill(0, ["df"]).crossJoin(n)  # n is one row
    return out.select("term", "df", F.when(F.col("n") == 0, 0.0).otherwise(F.log(F.col("n") / F.greatest("df", F.lit(1)))).alias("idf"))


def presence(docs: DataFrame, weights: DataFrame) -> DataFrame:
    """(family, term, weight): share of the family's documents with the term, times its idf."""
    total = docs.groupBy("family").agg(F.count("*").alias("n"))
    found = docs.select("family", F.explode(F.array_distinct("terms")).alias("term")).groupBy("family", "term").agg(F.count("*").alias("k"))
    return found.join(total, "family").join(weights, "term").select("family", "term", (F.col("k") / F.col("n") * F.col("idf")).alias("weight"))


def cosine(vectors: DataFrame, floor: float | None = None) -> DataFrame:
    """(a, b, affinity) of all pairs of families of ``vectors`` (family, term, weight): 1 with itself, ``floor`` at least.

    Families are a vocabulary, not data; the join is on terms."""
    norms = vectors.groupBy("family").agg(F.sqrt(F.sum(F.col("weight") ** 2)).alias("norm"))
    x, y = vectors.select(F.col("family").alias("a"), "term", F.col("weight").alias("wa")), vectors.select(F.col("family").alias("b"), "term", F.col("weight").alias("wb"))
    dots = x.join(y, "term").groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("dot"))
    pairs = norms.select(F.col("family").alias("a"), F.col("norm").alias("na")).crossJoin(norms.select(F.col("family").alias("b"), F.col("norm").alias("nb")))
    value = F.when(F.col("a") == F.col("b"), 1.0).otherwise(F.coalesce(F.try_divide(F.col("dot"), F.col("na") * F.col("nb")), F.lit(0.0)))
    return pairs.join(dots, ["a", "b"], "left").select("a", "b", (F.greatest(value, F.lit(floor)) if floor is not None else value).alias("affinity"))


def with_overrides(matrix: DataFrame, overrides: DataFrame) -> DataFrame:
    """``overrides`` (a, b, value) replace pairs of ``matrix`` (a, b, affinity) in both directions; of several for a pair the
    greatest."""
    both = overrides.select("a", "b", "value").unionByName(overrides.select(F.col("b").alias("a"), F.col("a").alias("b"), "value")).groupBy("a", "b").agg(F.max("value").alias("value"))
    return matrix.join(both, ["a", "b"], "left").select("a", "b", F.coalesce("value", "affinity").alias("affinity"))


def vocabulary(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(name,) for name, _ in V.SKILLS], "term string")
