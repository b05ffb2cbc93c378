"""The registry of companies, which source of a company's postings counts, and what a posting's own page adds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import rules, titles, urls
from tessera.functions import vocabulary as V
from tessera.functions.text import c, loose_company, normalize_company, visible_text
from tessera.operators import listing, taxonomy

DECISIONS = ("keep", "skip")


def resolve(wanted: DataFrame, companies: DataFrame) -> DataFrame:
    """``wanted`` (name, career_url) with the company each one already is (company_id, matched_by): by its key, else its
    address's host, else its loose key; of several the smallest id. Keys are aggregated first, so none multiplies rows."""
    out = wanted
    for how, of in (("key", lambda n, u: normalize_company(n)), ("host", lambda n, u: urls.host(u)), ("loose", lambda n, u: loose_company(n))):
        keyed = companies.select(of("display_name", "career_url").alias(f"__{how}"), "id").where(f"__{how} is not null and __{how} != ''").groupBy(f"__{how}").agg(F.min("id").alias(f"__id_{how}"))
        out = out.withColumn(f"__{how}", of("name", "career_url")).join(keyed, f"__{how}", "left").drop(f"__{how}")
    by = F.when(F.col("__id_key").isNotNull(), "key").when(F.col("__id_host").isNotNull(), "host").when(F.col("__id_loose").isNotNull(), "loose")
    return out.select(*wanted.columns, F.coalesce("__id_key", "__id_host", "__id_loose").alias("company_id"), by.alias("matched_by"))


def register(wanted: DataFrame, companies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new rows: id, display_name, career_url; refused rows with the company they collide with). Of new names with one
    id the first by name is taken."""
    known = resolve(wanted, companies)
    fresh = known.where("company_id is null").select(F.regexp_replace(F.regexp_replace(F.trim("name"), r"(?U)[^\w\s-]", ""), r"[\s-]+", "_").alias("id"), F.col("name").alias("display_name"), "career_url")
    fresh = fresh.withColumn("id", F.lower("id")).withColumn("__n", F.row_number().over(W.partitionBy("id").orderBy("display_name", F.col("career_url").asc_nulls_last()))).where("__n = 1").drop("__n")
    return fresh, known.where("company_id is not null")


def set_career_urls(companies: DataFrame, updates: DataFrame) -> DataFrame:
    """Addresses of ``updates`` (id, career_url); one that is set clears the decision."""
    new = updates.groupBy("id").agg(F.max("career_url").alias("__url"))
    rows = companies.join(new, "id", "left")
    hit = F.col("__url").isNotNull()
    return rows.withColumn("review_decision", F.when(~hit, F.col("review_decision"))).withColumn("career_url", F.coalesce("__url", "career_url")).select(*companies.columns)


def set_decision(companies: DataFrame, company_id: str, decision: str | None) -> DataFrame:
    """An unknown decision is a ValueError, an unknown company a KeyError."""
    if decision is not None and decision not in DECISIONS:
        raise ValueError(decision)
    if companies.where(F.col("id") == company_id).isEmpty():
        raise KeyError(company_id)
    return companies.withColumn("review_decision", F.when(F.col("id") == company_id, F.lit(decision).cast("string")).otherwise(F.col("review_decision")))


def first_source(rows: DataFrame, priority: Column | str) -> DataFrame:
    """Of each company's rows those of its first source. The least priority is aggregated and joined, as a company may
    hold many rows."""
    at = rows.withColumn("__p", c(priority))
    least = at.groupBy("company_id").agg(F.min("__p").alias("__p"))
    return at.join(least, ["company_id", "__p"], "left_semi").select(*rows.columns)


def with_fallback(results: DataFrame) -> DataFrame:
    """(company_id, strategy) used, of ``results`` (company_id, place, strategy, healthy, failed): the first healthy one
    in order; else the first, unless it failed."""
    best = F.min(F.when(F.col("healthy") & ~F.col("failed"), F.struct("place", "strategy")))
    first = F.min(F.struct("place", "strategy", "failed"))
    used = results.groupBy("company_id").agg(best.alias("best"), first.alias("first"))
    return used.select("company_id", F.coalesce("best.strategy", F.when(~F.col("first.failed"), F.col("first.strategy"))).alias("strategy"))


def located(jobs: DataFrame, companies: DataFrame, category_rows: DataFrame) -> DataFrame:
    """Postings with location, city and is_remote inferred from what they say, their company's office (companies: id,
    display_name, address_city) and the first place that its category rows (place, company, city) state."""
    hints = category_rows.withColumn("__key", normalize_company("company")).where("__key != '' and city is not null").groupBy("__key").agg(F.min_by("city", "place").alias("__hint"))
    own = companies.select(F.col("id").alias("company_id"), F.col("address_city").alias("__office"), normalize_company("display_name").alias("__key"))
    rows = jobs.join(own.join(hints, "__key", "left").drop("__key"), "company_id", "left")
    rows = rows.withColumn("__p", titles.infer_location("location", "title", "description", "__office", "__hint"))
    keep = [x for x in jobs.columns if x not in ("location", "city", "is_remote")]
    return rows.select(*keep, "__p.location", "__p.city", "__p.is_remote")


def html_listing(links: DataFrame, plans: DataFrame, pages: DataFrame, known: DataFrame, most: int = 50) -> DataFrame:
    """Postings of listing pages: links judged by their plans, the site's own first, ``most`` a page; a posting that is not yet
    ``known`` (url) is enriched from its page, a known one keeps what is stored."""
    found = listing.postings(listing.by_plan(links, plans), most).select("page_id", F.col("href").alias("url"), "title", "place")
    return enrich(found, pages, known)


def synthesize(companies: DataFrame, special: tuple[str, ...] = ()) -> DataFrame:
    """(company_id, kind, board) of the plan that a company's address alone calls for; ``special`` are parts of addresses of
    sites with a feed of their own."""
    board = urls.board("career_url")
    none = F.coalesce(F.trim("career_url"), F.lit("")) == ""
    if special:
        own = F.coalesce(*(F.when(F.contains(F.lower("career_url"), F.lit(h)), F.lit(h)) for h in special))
        kind = F.when(none, "techmap_only").when(board.isNotNull(), "ats_api").when(own.isNotNull(), "special_case").otherwise("html_listing")
        return companies.select(F.col("id").alias("company_id"), kind.alias("kind"), F.when(~none, F.coalesce(board, own)).alias("board"))
    return companies.select(F.col("id").alias("company_id"), F.when(none, "techmap_only").when(board.isNotNull(), "ats_api").otherwise("html_listing").alias("kind"), F.when(~none, board).alias("board"))


def evidence(page: Column | str, title: Column | str, url: Column | str, stored: Column | None = None) -> Column:
    """What speaks for a page being a posting."""
    html = F.coalesce(c(page), F.lit(""))
    return F.struct(
        (F.size(listing.json_ld(html)) > 0).alias("jsonld_jobposting"),
        html.rlike(r"(?is)<(?:a|button|input)\b[^>]*\bapply|<(?:a|button)\b[^>]*>[^<]*\bapply").alias("apply_cta"),
        F.regexp_count(visible_text(html), F.lit(V.SECTION_HEADER)).alias("requirement_sections"),
        taxonomy.family_of(title).alias("role_family_from_title"), urls.href_shape(url).alias("url_shape"),
        (stored if stored is not None else F.lit(False)).alias("previously_stored"),
    )


def enrich(listed: DataFrame, pages: DataFrame, known: DataFrame) -> DataFrame:
    """Listed postings (url, title) with what their pages (requested_url, url, status, html) say: title, description, date,
    evidence, outcome of the fetch and why it is gone. Postings whose URL is ``known`` (url) are marked, and a posting
    without a page stays as it was. One page per address: the smallest final address."""
    one = pages.groupBy(F.col("requested_url").alias("__url")).agg(F.min(F.struct("url", "status", "html")).alias("p"))
    stored = known.select(F.col("url").alias("__url"), F.lit(True).alias("__stored")).distinct()
    rows = listed.withColumn("__url", F.col("url")).join(one, "__url", "left").join(stored, "__url", "left")
    rows = rows.withColumn("__stored", F.coalesce("__stored", F.lit(False))).withColumn("__ld", listing.json_ld("p.html"))
    stated = titles.detail_titles("p.html", F.transform("__ld", lambda x: x["title"]))
    said = F.nullif(F.get("__ld", F.lit(0))["description"], F.lit(""))
    read = rows.withColumns({
        "fetch_status": F.when(F.col("p").isNotNull(), rules.fetch_outcome("p.status", "p.html")),
        "gone_reason": F.when(F.col("p").isNotNull(), rules.posting_gone("url", "p.url", "p.status", "p.html")),
        "title": F.coalesce(titles.authoritative(stated, "title"), "title"),
        "description": F.nullif(visible_text(F.coalesce(said, F.col("p.html"))), F.lit("")) if "description" not in listed.columns else F.coalesce(F.nullif("description", F.lit("")), F.nullif(visible_text(F.coalesce(said, F.col("p.html"))), F.lit(""))),
        "posted_at": F.nullif(F.get("__ld", F.lit(0))["posted_at"], F.lit("")),
    })
    return read.withColumn("job_evidence", evidence("p.html", "title", "url", F.col("__stored"))).drop("__url", "p", "__stored", "__ld")
