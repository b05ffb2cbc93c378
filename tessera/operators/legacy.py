"""The first version's dataset in one composition: category rows and fetched postings to scored, sorted rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import rules, titles
from tessera.operators.companies import first_source
from tessera.operators.discovery import row_postings

TITLE_CHARS = 200


def company_facts(rows: DataFrame) -> DataFrame:
    """(company, industry, size, hint): of each company's rows (place, company, category, size, city) the first's industry and
    size, and the first place that is stated."""
    return rows.groupBy("company").agg(F.min_by("category", "place").alias("industry"), F.min_by("size", "place").alias("size"), F.min_by("city", F.when(F.coalesce("city", F.lit("")) != "", F.col("place"))).alias("hint"))


def dataset(rows: DataFrame, fetched: DataFrame, scores: DataFrame, descriptions: DataFrame | None = None, relevant_only: bool = True) -> DataFrame:
    """Rows (company, title, url, location, city, is_remote, industry, best_score, ...) of category ``rows`` (place, company,
    category, size, title, level, city, url, updated) and ``fetched`` postings (company, title, url, location, description).

    A company's fetched postings stand before its category rows. Empty descriptions are filled from ``descriptions`` (url,
    text); titles over ``TITLE_CHARS`` are whole pages, not titles, and go; places are inferred, and those abroad go where
    ``relevant_only``. Best first, then by company and title."""
    none = F.lit(None).cast("string")
    listed = row_postings(rows).withColumn("rank", F.lit(1))
    own = fetched.select("company", "title", "location", "url", F.coalesce("description", F.lit("")).alias("description"), none.alias("department"), none.alias("employment_type"), none.alias("posted_at")).withColumn("rank", F.lit(0))
    used = first_source(own.unionByName(listed).withColumnRenamed("company", "company_id"), "rank").withColumnRenamed("company_id", "company").drop("rank")
    used = used.where((F.coalesce("title", F.lit("")) != "") & (F.length("title") <= TITLE_CHARS))
    if descriptions is not None:
        said = descriptions.groupBy("url").agg(F.max("text").alias("said"))
        used = used.join(said, "url", "left").withColumn("description", F.coalesce(F.nullif("description", F.lit("")), "said", F.lit(""))).drop("said")
    facts = company_facts(rows)
    placed = used.join(facts, "company", "left").withColumn("p", titles.infer_location("location", "title", "description", none, "hint"))
    out = placed.select("company", "title", "url", "description", "p.location", "p.city", "p.is_remote", "industry", "size", "department", "employment_type", "posted_at")
    if relevant_only:
        out = out.where(rules.relevant_location("location"))
    best = scores.groupBy("url").agg(F.max("score").alias("best_score"))
    return out.join(best, "url", "left").orderBy(F.col("best_score").desc_nulls_last(), F.lower("company"), F.lower("title"), "url")
