"""Small tables about postings, companies, runs and calls. Each is one aggregate or one window over the columns it names."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import urls
from tessera.functions import vocabulary as V
from tessera.functions.text import c, normalize_company

# --- fixed values
AMOUNT = r"[^.\n]*(?:[$€£₪]|USD|ILS|NIS)\s?\d[\d,.]*[^.\n]*"
TERM = re.compile(r"[0-9A-Za-z֐-׿#+.]+")
HEALTHY_SHARE = 0.3


def department_coverage(jobs: DataFrame) -> DataFrame:
    """One row: postings, different departments, postings with one."""
    return jobs.agg(F.count("*").alias("total"), F.count_distinct("department").alias("departments"), F.count("department").alias("filled"))


def family_report(jobs: DataFrame, samples: int = 20) -> DataFrame:
    """(family, n, pct, samples) of ``jobs`` (id, title, family): a family's share and its first titles by id."""
    name = F.coalesce("family", F.lit("(unknown)"))
    counts = jobs.groupBy(name.alias("family")).agg(F.count("*").alias("n"))
    first = W.partitionBy("family").orderBy("id")
    heads = jobs.select(name.alias("family"), "id", F.coalesce("title", F.lit("")).alias("title")).withColumn("r", F.row_number().over(first)).where(F.col("r") <= samples)
    lists = heads.groupBy("family").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "title"))), lambda x: x["title"]).alias("samples"))
    total = counts.agg(F.sum("n").alias("all"))  # one row
    return counts.join(lists, "family").crossJoin(F.broadcast(total)).select("family", "n", F.round(100 * F.col("n") / F.col("all"), 1).alias("pct"), "samples")


def run_stats(results: DataFrame) -> DataFrame:
    """One row of ``results`` (company_id, outcome, new, closed): companies checked, skipped and failed, postings new and closed."""
    is_ = lambda x: F.count_if(F.col("outcome") == x)
    return results.agg(is_("checked").alias("checked"), is_("skipped").alias("skipped"), is_("failed").alias("failures"), F.coalesce(F.sum("new"), F.lit(0)).alias("new"), F.coalesce(F.sum("closed"), F.lit(0)).alias("closed"))


def best_board(jobs: DataFrame) -> DataFrame:
    """(company_id, board, n): the hosted board that most of a company's URLs refer to, of equals the first by name."""
    counts = jobs.select("company_id", urls.board("url").alias("board")).where("board is not null").groupBy("company_id", "board").agg(F.count("*").alias("n"))
    return counts.withColumn("r", F.row_number().over(W.partitionBy("company_id").orderBy(F.desc("n"), "board"))).where("r = 1").drop("r")


def healthy(postings: DataFrame, least: float = HEALTHY_SHARE) -> DataFrame:
    """(company_id, n, evident, hinted, healthy) of ``postings`` (company_id, url, trusted, evident): all from trusted
    sources, or enough with evidence, or enough with job-shaped URLs."""
    shares = postings.groupBy("company_id").agg(F.count("*").alias("n"), F.avg(F.coalesce("evident", F.lit(False)).cast("int")).alias("evident"), F.avg(F.coalesce(urls.job_url_hint("url"), F.lit(False)).cast("int")).alias("hinted"), F.bool_and(F.coalesce("trusted", F.lit(False))).alias("trusted"))
    return shares.select("company_id", "n", "evident", "hinted", (F.col("trusted") | (F.col("evident") >= least) | (F.col("hinted") >= least)).alias("healthy"))


def cost_summary(calls: DataFrame) -> DataFrame:
    """(node, model, calls, tokens_in, tokens_out, seconds) of recorded calls."""
    return calls.groupBy("node", "model").agg(F.count("*").alias("calls"), *(F.sum(x).alias(x) for x in ("tokens_in", "tokens_out", "seconds")))


def duplicate_keys(companies: DataFrame) -> DataFrame:
    """(kind, key, ids) of names and hosts that more than one company has."""
    kinds = F.array(F.struct(F.lit("name").alias("kind"), normalize_company("display_name").alias("key")), F.struct(F.lit("host").alias("kind"), urls.host("career_url").alias("key")))
    keys = companies.select("id", F.inline(kinds)).where("key is not null and key != ''")
    shared = keys.groupBy("kind", "key").agg(F.count_distinct("id").alias("ids")).where("ids > 1")
    return shared


def salary_snippets(jobs: DataFrame, most: int = 5) -> DataFrame:
    """(company_id, id, snippet): the sentence that states an amount first, of a company's first open postings with one."""
    said = F.regexp_extract(F.coalesce("description", F.lit("")), r"(?:^|(?<=[.\n]))" + AMOUNT, 0)  # from a sentence's start only: linear in the text
    rows = jobs.where("status != 'closed'").select("company_id", "id", F.regexp_replace(F.trim(said), r"\.+$", "").alias("snippet")).where("snippet != ''")
    return rows.withColumn("r", F.row_number().over(W.partitionBy("company_id").orderBy("id"))).where(F.col("r") <= most).drop("r")


def highlight(text: Column | str, q: str, before: str = "<mark>", after: str = "</mark>") -> Column:
    """``text`` with the query's terms of two characters or more marked, longest first."""
    terms = sorted({t for t in TERM.findall(q or "") if len(t) > 1}, key=lambda t: (-len(t), t))
    return F.regexp_replace(c(text), "(?iu)(" + "|".join(re.escape(t) for t in terms) + ")", before + "$1" + after) if terms else c(text)


def ranked_at(jobs: DataFrame, scores: DataFrame, host: str, least: float = 0) -> DataFrame:
    """Open postings whose URL names ``host``, with their best score (0 without), at least ``least``; best first."""
    best = scores.groupBy(F.col("job_id").alias("id")).agg(F.max("score").alias("best"))
    rows = jobs.where((F.col("status") != "closed") & F.contains(F.lower("url"), F.lit(host))).join(best, "id", "left").withColumn("best", F.coalesce("best", F.lit(0)))
    return rows.where(F.col("best") >= least).orderBy(F.desc("best"), "id")


def needs_review(companies: DataFrame, techmap: DataFrame) -> DataFrame:
    """Companies without an address: undecided ones first, then those with rows of the map, then by name."""
    known = techmap.select(normalize_company("company").alias("__key")).distinct().withColumn("has_techmap", F.lit(True))
    rows = companies.where("career_url is null").withColumn("__key", normalize_company("display_name")).join(known, "__key", "left").drop("__key")
    return rows.withColumn("has_techmap", F.coalesce("has_techmap", F.lit(False))).orderBy(F.col("review_decision").isNotNull(), ~F.col("has_techmap"), F.lower("display_name"), "id")


def to_scrape(companies: DataFrame, techmap: DataFrame) -> DataFrame:
    """Companies that are not to be skipped and have an address or rows of the map."""
    known = techmap.select(normalize_company("company").alias("__key")).distinct().withColumn("__has", F.lit(True))
    rows = companies.where(~F.col("review_decision").eqNullSafe("skip")).withColumn("__key", normalize_company("display_name")).join(known, "__key", "left")
    return rows.where("career_url is not null or __has").select(*companies.columns)


def report_order(found: DataFrame) -> DataFrame:
    """Postings by their company's best score, then its name, then their own score."""
    top = F.max("best_score").over(W.partitionBy("company_id"))
    return found.withColumn("company_score", top).orderBy(F.col("company_score").desc_nulls_last(), F.lower("display_name"), "company_id", F.col("best_score").desc_nulls_last(), "id")
