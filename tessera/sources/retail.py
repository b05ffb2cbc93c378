"""Captured listings and details of single-company boards, directories and batch files, as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.text import c, strip_html


def positional(pages: DataFrame, rows: str, fields: dict[str, str]) -> DataFrame:
    """Postings of ``pages`` (page, payload) whose items are arrays: ``rows`` is the JSON path of the list, ``fields`` maps
    names, id among them, to paths within an item. Of rows with one id the last wins; a payload that can't be read has none."""
    items = F.expr(f"variant_get(try_parse_json(payload), '{rows}', 'array<variant>')")
    each = pages.select("page", F.posexplode(items).alias("at", "j"))
    read = each.select("page", "at", *(F.expr(f"try_variant_get(j, '{path}', 'string')").alias(name) for name, path in fields.items()))
    last = W.partitionBy("id").orderBy(F.desc("page"), F.desc("at"))
    return read.where("id is not null").withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n", "page", "at")


def cards(pages: DataFrame, pattern: str, names: list[str]) -> DataFrame:
    """One row per match of ``pattern`` in ``pages`` (page, html), its groups named in order; an absent group is empty."""
    matches = F.regexp_extract_all("html", F.lit("(?s)" + pattern), F.lit(0))
    each = pages.select("page", F.posexplode(matches).alias("at", "m"))
    return each.select("page", "at", *(F.trim(F.coalesce(F.regexp_extract("m", "(?s)" + pattern, i + 1), F.lit(""))).alias(n) for i, n in enumerate(names)))


def with_details(listed: DataFrame, details: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """Listed rows with their details, whose fields win unless null; and the keys listed without a detail."""
    shared = [n for n in details.columns if n != key and n in listed.columns]
    both = listed.alias("l").join(details.alias("d"), key)
    fields = [F.coalesce(F.col(f"d.{n}"), F.col(f"l.{n}")).alias(n) if n in shared else F.col(f"l.{n}") for n in listed.columns if n != key]
    extra = [F.col(f"d.{n}") for n in details.columns if n != key and n not in shared]
    return both.select(key, *fields, *extra), listed.join(details.select(key), key, "left_anti").select(key).distinct()


def slim(jobs: DataFrame, base: str) -> DataFrame:
    """Rows of a search board: texts joined, locations decoded from JSON texts, the date read, the address made whole."""
    html = F.concat_ws("", "description", "basic_qualifications", "preferred_qualifications")
    decoded = F.transform("locations", lambda x: F.coalesce(F.get_json_object(x, "$.locationNonStemming"), F.get_json_object(x, "$.location")))
    known = F.coalesce(F.filter(decoded, lambda x: x.isNotNull()), F.array().cast("array<string>"))
    posted = F.date_format(F.try_to_date(F.regexp_replace("posted_date", r"\s+", " "), "MMMM d, yyyy"), "yyyy-MM-dd")
    return jobs.select(
        F.coalesce("id_icims", "id").alias("id"), "title", F.coalesce(F.nullif("job_family", F.lit("")), "job_category").alias("department"), F.col("job_category").alias("category"), F.col("job_schedule_type").alias("employment_type"),
        F.when((F.size(known) == 0) & F.col("location").isNotNull(), F.array("location")).otherwise(known).alias("locations"), posted.alias("posted_at"), html.alias("html"), strip_html(html).alias("description"), F.concat(F.lit(base), "job_path").alias("url"),
    ).orderBy(F.col("posted_at").desc_nulls_last(), "id")


def directory(pages: DataFrame) -> DataFrame:
    """(page, name, domain) of ``pages`` (page, text): cards of a name, an empty line, a domain and a kind of company."""
    card = r"(?m)^[ \t]*(\S[^\n]*?)[ \t]*\n[ \t]*\n[ \t]*((?:www\.)?[a-zA-Z0-9][\w-]*(?:\.[a-zA-Z0-9-]+)+)/?[ \t]*\n[ \t]*(?:High-Tech Company|Multinational Corporation)[ \t]*$"
    text = F.replace(F.coalesce("text", F.lit("")), F.lit("\r"), F.lit(""))
    each = pages.select("page", F.explode(F.regexp_extract_all(text, F.lit(card), F.lit(0))).alias("m"))
    return each.select("page", F.regexp_extract("m", card, 1).alias("name"), F.regexp_extract("m", card, 2).alias("domain"))


def slugs(name: Column | str) -> Column:
    """Guesses at a company's board: its name without brackets and legal forms, run together and hyphenated."""
    base = F.lower(F.regexp_replace(F.regexp_replace(F.coalesce(c(name), F.lit("")), r"\s*\([^)]*\)", ""), r"(?i)\b(ltd\.?|inc\.?|llc|corp\.?|co\.?)(?!\w)", ""))
    return F.filter(F.array_distinct(F.array(F.regexp_replace(base, "[^a-z0-9]", ""), F.regexp_replace(F.regexp_replace(base, "[^a-z0-9]+", "-"), "^-+|-+$", ""))), lambda s: s != "")


def batch(spark, path: str) -> DataFrame:
    """Postings of a batch file as fetched ones: an array of objects, or one a line."""
    schema = "id string, title string, url string, location string, locations array<string>, department string, timeType string, descriptionText string, postedTs string"
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    place = F.coalesce("location", F.array_join("locations", ", "))
    return rows.where("title is not null").select("id", "title", "url", place.alias("location"), "department", F.col("timeType").alias("employment_type"), F.coalesce("descriptionText", F.lit("")).alias("description"), F.substring("postedTs", 1, 10).alias("posted_at"))
