"""Repairs of stored postings and companies: each is a frame of all rows, corrected where a rule says so.

Every repair is idempotent, reads its columns once and shuffles nothing, unless a table of corrections is joined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import rules, text, titles
from tessera.functions import vocabulary as V
from tessera.operators import jobs as J
from tessera.operators import taxonomy

HEBREW = "[֐-׿]"


def changed(rows: DataFrame, where: Column, **values: Column) -> DataFrame:
    """``rows`` with columns replaced where the condition holds; a null condition changes nothing."""
    hit = F.coalesce(where, F.lit(False))
    return rows.withColumns({name: F.when(hit, value).otherwise(F.col(name)) for name, value in values.items()})


def fold_departments(jobs: DataFrame, raw: DataFrame | None = None) -> DataFrame:
    """Departments folded into the canonical ones, from the raw value (id, raw) where one is known."""
    if raw is None:
        return jobs.withColumn("department", rules.department("department"))
    first = raw.groupBy("id").agg(F.min("raw").alias("__raw"))
    return jobs.join(first, "id", "left").withColumn("department", rules.department(F.coalesce("__raw", "department"))).drop("__raw")


def clean_names(companies: DataFrame) -> DataFrame:
    """Bilingual company names without their Hebrew words."""
    return companies.withColumn("display_name", text.english_name("display_name"))


def close_navigation(jobs: DataFrame, now: str) -> DataFrame:
    """Open rows whose title is site furniture, closed with a reason."""
    junk = text.collapse("title").rlike(V.NAV_LABEL) | rules.site_furniture("title")
    return changed(jobs, (F.col("status") != "closed") & junk, closed_at=F.lit(now), closed_reason=F.lit("not a job: site navigation"), status=F.lit("closed"))


def resplit_titles(jobs: DataFrame) -> DataFrame:
    """Titles without the parts of a card; one of which nothing would be left stays."""
    title = titles.card("title")["title"]
    return changed(jobs, title != "", title=title)


def fix_remote(jobs: DataFrame) -> DataFrame:
    """The remote flag is cleared where neither location, title nor text says so."""
    stated = rules.is_remote("location") | rules.is_remote("title") | rules.is_remote("description")
    return changed(jobs, F.col("is_remote") & ~stated, is_remote=F.lit(False))


def fix_locations(jobs: DataFrame) -> DataFrame:
    """A location that reads NaN is null; a title that names a place abroad takes the city away."""
    rows = changed(jobs, F.col("location").isin("NaN", "nan"), location=F.lit(None).cast("string"))
    place = F.coalesce(titles.trailing_place("title"), F.lit("Outside Israel"))
    return changed(rows, F.col("city").isNotNull() & titles.names_foreign_place("title"), location=place, city=F.lit(None).cast("string"))


def backfill_families(jobs: DataFrame, version: str) -> DataFrame:
    """Family and confidence of rows that another taxonomy's version classified."""
    found = taxonomy.classify_job("title", F.lit(""), "description")
    stale = ~F.col("taxonomy_version").eqNullSafe(version)
    return changed(jobs, stale, family=found["family"], family_confidence=found["confidence"], taxonomy_version=F.lit(version))


def apply_translations(jobs: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Titles replaced by ``mapping`` (title, english), the original kept; and (title, problem) of Hebrew titles that are
    missing there and entries that no posting uses. An empty or Hebrew translation is not applied."""
    good = mapping.where((F.coalesce("english", F.lit("")) != "") & ~text.contains_hebrew("english")).groupBy("title").agg(F.min("english").alias("__english"))
    rows = changed(jobs.join(good, "title", "left"), F.col("__english").isNotNull(), title_original=F.coalesce("title_original", "title"), source_language=F.lit("he"))
    rows = rows.withColumn("title", F.coalesce("__english", "title")).select(*jobs.columns)
    hebrew, entries = jobs.where(F.col("title").rlike(HEBREW)).select("title").distinct(), mapping.select("title").distinct()
    problems = hebrew.join(entries, "title", "left_anti").withColumn("problem", F.lit("missing")).unionByName(entries.join(hebrew, "title", "left_anti").withColumn("problem", F.lit("unused")))
    return rows, problems


def poisoned(cache: DataFrame) -> DataFrame:
    """``cache`` (key, value) without values that are still Hebrew."""
    return cache.where(~text.contains_hebrew("value"))


def non_jobs(jobs: DataFrame, state: DataFrame) -> DataFrame:
    """(…, reason) of rows that are no postings and that no one has flagged."""
    return J.purge(jobs.withColumn("reason", rules.non_job_reason("title", "url")).where("reason is not null"), state)


def merge_duplicates(jobs: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """Closed rows with an open sibling, and all rows with them reopened."""
    twins = J.duplicate_closed(jobs)
    ids = twins.select("id", F.lit(True).alias("__twin")).distinct()
    rows = changed(jobs.join(ids, "id", "left"), F.col("__twin"), status=F.lit("seen"), last_seen=F.lit(now), closed_at=F.lit(None).cast("string"), closed_reason=F.lit(None).cast("string"))
    return twins, rows.drop("__twin")


def url_audit(jobs: DataFrame, statuses: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """Postings with those that a recorded status (url, status) calls broken closed, and counts by class."""
    worst = statuses.groupBy("url").agg(F.min("status").alias("__http"))
    seen = jobs.join(worst.withColumn("__has", F.lit(True)), "url", "left").withColumn("__class", F.when(F.col("__has"), rules.url_status_class("__http")))
    rows = changed(seen, (F.col("__class") == "broken") & (F.col("status") != "closed"), closed_at=F.lit(now), closed_reason=F.concat(F.lit("http "), F.col("__http").cast("string")), status=F.lit("closed"))
    return rows.select(*jobs.columns), seen.where("__class is not null").groupBy(F.col("__class").alias("url_class")).agg(F.count("*").alias("n"))


def banner_audit(attempts: DataFrame) -> DataFrame:
    """(id, verdict) of captured tries (id, status, html): closed if any try says so, else open if any page was read, else blocked or error."""
    gone = rules.posting_gone(F.lit(None).cast("string"), F.lit(None).cast("string"), "status", "html").isNotNull()
    read = F.col("status") < 400
    of = attempts.groupBy("id").agg(F.bool_or(gone).alias("gone"), F.bool_or(read).alias("read"), F.bool_or(F.col("status") == 429).alias("blocked"))
    yes = lambda name: F.coalesce(F.col(name), F.lit(False))
    return of.select("id", F.when(yes("gone"), "closed").when(yes("read"), "open").when(yes("blocked"), "blocked").otherwise("error").alias("verdict"))
