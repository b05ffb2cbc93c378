"""Data work of a research run on companies: which pages to use, what of them to read, whom to credit, what to keep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators import caches, export, gate

TTL_DAYS = 14
ERRORS = ("no search results", "no page named this company", "pages said nothing")


def to_research(companies: DataFrame, cache: DataFrame, now: str, days: int = TTL_DAYS) -> tuple[DataFrame, DataFrame]:
    """(companies with their stored research, companies to research) of ``companies`` (company_id, ...): stored research counts
    up to ``days`` old, inclusive."""
    keyed = companies.withColumn("key", caches.research_key("company_id"))
    found = caches.look_up(keyed, cache, now, days * 24 + 1e-6)
    return found.where("hit").drop("hit", "key"), found.where("not hit").drop("hit", "value", "key")


def gathered(hits: DataFrame, most: int = 3) -> DataFrame:
    """(company_id, topic, url, text) of search ``hits`` (company_id, topic, query, by_domain, place, url, text, snippet): the first
    ``most`` of each query, the text or else the snippet, a URL once. Hits of queries by domain are used where there are
    any, else those by name."""
    said = F.coalesce(F.nullif("text", F.lit("")), F.nullif("snippet", F.lit("")))
    rows = hits.withColumn("said", said).where(F.col("said").isNotNull() & (F.col("place") <= most))
    one = rows.groupBy("company_id", "topic", "by_domain", "url").agg(F.min_by("said", F.struct("place", "query")).alias("text"))
    best = one.groupBy("company_id", "topic").agg(F.max("by_domain").alias("by_domain"))
    return one.join(best, ["company_id", "topic", "by_domain"]).select("company_id", "topic", "url", "text")


def naming(pages: DataFrame, companies: DataFrame) -> DataFrame:
    """The pages of companies with a domain (company_id, company, domain) that name the company; all pages of the others."""
    own = companies.select("company_id", "company", "domain")
    rows = pages.join(own, "company_id")
    known = F.coalesce("domain", F.lit("")) != ""
    return rows.where(~known | gate.mentions_company("url", "text", "domain", "company")).select(*pages.columns)


def context(pages: DataFrame, questions: DataFrame, passages: int = 4, size: int = 900) -> DataFrame:
    """(company_id, topic, url, chunk, text): the ``passages`` chunks of a company's pages that answer a topic's question (topic,
    text) best, by BM25 over all pages of the topic, in the order of page and chunk."""
    cut = export.chunks(pages.select(F.struct("company_id", "topic", "url").alias("id"), "text"), size)
    of = cut.select("id.*", "chunk", "text")
    scored = scores(of, questions)
    w = W.partitionBy("company_id", "topic").orderBy(F.desc("score"), "url", "chunk")
    return scored.withColumn("n", F.row_number().over(w)).where(F.col("n") <= passages).select("company_id", "topic", "url", "chunk", "text").orderBy("company_id", "topic", "url", "chunk")


def scores(chunks: DataFrame, questions: DataFrame, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """``chunks`` (topic, ...) with their BM25 score for their own topic's question; statistics are those of the topic."""
    from tessera.functions.text import search_tokens

    rows = chunks.withColumn("w", search_tokens("text")).withColumn("len", F.size("w"))
    stats = rows.groupBy("topic").agg(F.count("*").alias("n"), F.avg("len").alias("mean"))
    asked = questions.select("topic", F.array_distinct(search_tokens("text")).alias("asked"))
    own = rows.join(F.broadcast(asked), "topic").withColumn("hit", F.filter("w", lambda x: F.array_contains("asked", x)))  # topics are a handful
    df = own.select("topic", F.explode(F.array_distinct("hit")).alias("t")).groupBy("topic", "t").agg(F.count("*").alias("df"))
    weight = df.join(stats, "topic").select("topic", "t", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    by_topic = weight.groupBy("topic").agg(F.map_from_entries(F.collect_list(F.struct("t", "idf"))).alias("idf"))  # a question's words
    both = own.join(stats, "topic").join(by_topic, "topic", "left")
    tf = lambda t: F.size(F.filter("hit", lambda x: x == t))
    part = lambda t: F.coalesce(F.try_element_at("idf", t), F.lit(0.0)) * tf(t) * (k1 + 1) / (tf(t) + k1 * (1 - b + b * F.col("len") / F.col("mean")))
    total = F.aggregate(F.array_distinct("hit"), F.lit(0.0), lambda acc, t: acc + part(t))
    return both.select(*chunks.columns, F.round(total, 6).alias("score"))


def attributed(answers: DataFrame, read: DataFrame, keys: Column) -> DataFrame:
    """(company_id, topic, sources, attribution, error) of ``answers`` (company_id, topic, fields map, cited array): the cited pages
    that were read, else all pages read; an answer whose key fields (``keys``) say nothing has none."""
    pages = read.groupBy("company_id", "topic").agg(F.array_sort(F.collect_set("url")).alias("pages"))  # a topic's context: a few pages
    rows = answers.join(pages, ["company_id", "topic"], "left")
    silent = gate.no_answer(F.col("fields"), keys)
    cited = F.array_sort(F.array_intersect(F.coalesce("cited", F.array().cast("array<string>")), F.coalesce("pages", F.array().cast("array<string>"))))
    some = F.size(cited) > 0
    return rows.select("company_id", "topic", F.when(~silent, F.when(some, cited).otherwise(F.col("pages"))).alias("sources"), F.when(~silent, F.when(some, "cited").otherwise("consulted")).alias("attribution"), F.when(silent, ERRORS[2]).alias("error"))


def without_pages(companies: DataFrame, topics: DataFrame, found: DataFrame, kept: DataFrame) -> DataFrame:
    """(company_id, topic, error) of topics that had no search result, or no page that names the company."""
    every = companies.select("company_id").crossJoin(F.broadcast(topics.select("topic")))  # topics are a handful
    had = found.select("company_id", "topic").distinct().withColumn("had", F.lit(True))
    has = kept.select("company_id", "topic").distinct()
    missing = every.join(has, ["company_id", "topic"], "left_anti").join(had, ["company_id", "topic"], "left")
    return missing.select("company_id", "topic", F.when(F.col("had"), ERRORS[1]).otherwise(ERRORS[0]).alias("error"))
