"""Feeds of single sites, files of earlier versions, and other projects' caches, as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import c, collapse, normalize_company, posted_date, snake_id, strip_html

POSTING = ("title", "location", "url", "description", "department", "employment_type", "posted_at")
# --- fixed values: fields of the two feeds
STATUS_FEED = "array<struct<status:int,jobTitle:string,jobId:string,area:string,description:string,employmentType:string,openDate:string>>"
SHORT_FEED = "array<struct<tl:string,dc:string,ct:string,tp:string,jc:string,id:string>>"
STATE_KEYS = {"liked": "liked", "hidden": "hidden", "sent": "sent", "reached": "reached_out"}


def _in_country(place: Column) -> Column:
    """Areas and town names of a feed that has one country only."""
    return F.when(collapse(place) != "", F.concat(collapse(place), F.lit(", Israel"))).otherwise("Israel")


def status_feed(payloads: DataFrame, site: Column | str) -> DataFrame:
    """(page_id and a posting's columns) of ``payloads`` (page_id, payload): rows whose status is 1 and that have a title.
    ``site`` is the address before the id."""
    rows = payloads.select("page_id", F.inline(F.from_json("payload", STATUS_FEED))).where("status = 1").where(collapse("jobTitle") != "")
    url = F.when(F.col("jobId").isNotNull(), F.concat(c(site), F.lit("?id="), F.col("jobId"))).otherwise(c(site))
    cols = (collapse("jobTitle"), _in_country(F.col("area")), url, strip_html(F.coalesce("description", F.lit(""))), F.lit(None).cast("string"), F.col("employmentType"), posted_date("openDate"))
    return rows.select("page_id", *(x.alias(n) for x, n in zip(cols, POSTING)))


def short_feed(payloads: DataFrame, site: Column | str) -> DataFrame:
    """The same of a feed with abbreviated keys: rows with a title and an id."""
    rows = payloads.select("page_id", F.inline(F.from_json("payload", SHORT_FEED))).where((collapse("tl") != "") & (collapse("id") != ""))
    blank = lambda x: F.nullif(collapse(x), F.lit(""))
    cols = (collapse("tl"), _in_country(F.col("ct")), F.concat(c(site), collapse("id")), strip_html(F.coalesce("dc", F.lit(""))), blank("jc"), blank("tp"), F.lit(None).cast("string"))
    return rows.select("page_id", *(x.alias(n) for x, n in zip(cols, POSTING)))


#: Sites with a feed of their own, by a part of the career address; the reader, and the address before a posting's id.
SPECIAL = {"elbitsystemscareer.com": (status_feed, "https://elbitsystemscareer.com/jobs/"), "jobs.iai.co.il": (short_feed, "https://jobs.iai.co.il/job/")}


def special(payloads: DataFrame, fragment: str) -> DataFrame:
    reader, site = SPECIAL[fragment]
    return reader(payloads, F.lit(site))


def sibling_cache(entries: DataFrame) -> DataFrame:
    """(company_key and a posting's columns) of another project's cache ``entries`` (name, positions: JSON list): rows with a
    title, under the company's key; of names with one key the last."""
    rows = entries.withColumn("company_key", normalize_company("name")).where("company_key != ''")
    last = rows.groupBy("company_key").agg(F.max_by("positions", "name").alias("positions"))
    kind = "array<struct<" + ",".join(f"{n}:string" for n in POSTING) + ">>"
    out = last.select("company_key", F.inline(F.from_json("positions", kind))).withColumn("title", F.trim("title"))
    return out.where("title is not null and title != ''").select("company_key", *POSTING)


def addresses(spark: SparkSession, path: str) -> DataFrame:
    """(company_key, city): the first branch with a city of each company in a JSON object of names and branches."""
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,array<struct<city:string>>>")).alias("name", "branches"))
    city = F.get(F.filter("branches", lambda b: F.coalesce(b["city"], F.lit("")) != ""), F.lit(0))["city"]
    rows = raw.select(normalize_company("name").alias("company_key"), city.alias("city")).where("company_key != '' and city is not null")
    return rows.groupBy("company_key").agg(F.min("city").alias("city"))


def browser_state(exported: DataFrame, jobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(flags of known postings, one row per list with how many were applied and how many are unknown) of ``exported`` (list,
    job_id), the lists of a browser: liked, hidden, sent, reached."""
    field = F.create_map(*(F.lit(x) for kv in STATE_KEYS.items() for x in kv))
    rows = exported.withColumn("flag", F.try_element_at(field, F.col("list"))).where("flag is not null").select("flag", "job_id").distinct()
    known = rows.join(jobs.select(F.col("id").alias("job_id")).distinct().withColumn("known", F.lit(True)), "job_id", "left")
    state = known.where("known").groupBy("job_id").agg(*(F.bool_or(F.col("flag") == f).alias(f) for f in STATE_KEYS.values()))
    counts = known.groupBy("flag").agg(F.count_if("known").alias("applied"), F.count_if(F.col("known").isNull()).alias("unknown"))
    return state, counts


LEGACY = "name string, career_url string, last_checked string, jobs array<struct<id:string,title:string,url:string,location:string,description:string,status:string,posted_at:string,scores:map<string,double>>>"


def legacy_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per company file of the first version: (name, career_url, last_checked, jobs)."""
    return spark.read.schema(LEGACY).json(path, multiLine=True).where("name is not null")


def migrate_legacy(files: DataFrame, career_pages: DataFrame, review: DataFrame, cities: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(companies, jobs, scores) of ``legacy_files``. The scrape list ``career_pages`` (name, career_url) adds companies that
    were never scraped, and its address wins; ``review`` (name, decision) and ``cities`` (company_key, city) meet by key."""
    named = files.select("name", "career_url", "last_checked").unionByName(career_pages.select("name", "career_url", F.lit(None).cast("string").alias("last_checked")))
    listed = career_pages.groupBy(snake_id("name").alias("id")).agg(F.max(F.struct("career_url")).alias("listed"))
    rows = named.withColumn("id", snake_id("name")).groupBy("id").agg(F.min("name").alias("display_name"), F.max("career_url").alias("own"), F.max("last_checked").alias("last_checked"))
    decided = review.groupBy(normalize_company("name").alias("company_key")).agg(F.max("decision").alias("review_decision"))
    rows = rows.join(listed, "id", "left").withColumn("company_key", normalize_company("display_name")).join(decided, "company_key", "left").join(cities, "company_key", "left")
    companies = rows.select("id", "display_name", F.when(F.col("listed").isNotNull(), F.col("listed.career_url")).otherwise(F.col("own")).alias("career_url"), "review_decision", "last_checked", F.col("city").alias("address_city"))
    jobs = files.select(snake_id("name").alias("company_id"), F.inline("jobs"))
    kept = jobs.withColumn("status", F.coalesce("status", F.lit("seen"))).withColumn("description", F.coalesce("description", F.lit("")))
    scores = jobs.where("scores is not null").select(F.col("id").alias("job_id"), F.explode("scores").alias("profile_id", "score"))
    return companies, kept.drop("scores"), scores


def verify_migration(files: DataFrame, jobs: DataFrame, fields: tuple[str, ...] = ("title", "url", "location", "description", "status", "posted_at")) -> DataFrame:
    """(id, field, stored, stated): every field of every posting in which the store differs from the files, and postings that
    only one of them has. An empty text and null are the same; the two defaults of the store count as stated."""
    stated = files.select(F.inline("jobs")).withColumn("status", F.coalesce("status", F.lit("seen")))
    side = lambda df, name: df.select("id", F.lit(True).alias(f"in_{name}"), F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.nullif(F.col(f).cast("string"), F.lit("")).alias(name)) for f in fields))).alias("x")).select("id", f"in_{name}", "x.*")
    both = side(stated, "stated").join(side(jobs, "stored"), ["id", "field"], "full_outer")
    missing = F.col("in_stated").isNull() | F.col("in_stored").isNull()
    problems = both.where(missing | ~F.col("stated").eqNullSafe(F.col("stored")))
    whole = F.when(missing, F.lit("*")).otherwise(F.col("field"))
    return problems.select("id", whole.alias("field"), F.when(~missing, F.col("stored")).alias("stored"), F.when(~missing, F.col("stated")).alias("stated")).distinct()
