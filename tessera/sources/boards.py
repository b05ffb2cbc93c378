"""Captured payloads of hosted boards to one posting shape. Each provider is a mapping of fields, applied by from_json."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import collapse, posted_date, strip_html

FIELDS = ("title", "url", "location", "department", "employment_type", "description", "posted_at")


def _join(*parts: str) -> Column:
    return F.nullif(F.array_join(F.array_compact(F.array(*(F.nullif(F.col(p), F.lit("")) for p in parts))), ", "), F.lit(""))


def _c(name: str) -> Column:
    return F.col(name)


#: provider: (schema of the payload, array of items, field mapping, filter of items)
PROVIDERS: dict[str, tuple] = {
    "greenhouse": ("jobs array<struct<title:string,absolute_url:string,location:struct<name:string>,offices:array<struct<name:string>>,departments:array<struct<name:string>>,content:string,updated_at:string>>", "jobs", lambda: {"title": _c("j.title"), "url": _c("j.absolute_url"), "location": F.coalesce(F.nullif(_c("j.location.name"), F.lit("")), F.array_join("j.offices.name", ", ")), "department": F.get("j.departments.name", F.lit(0)), "description": _c("j.content"), "posted_at": _c("j.updated_at")}, None),
    "lever": ("jobs array<struct<text:string,hostedUrl:string,categories:struct<location:string,team:string,commitment:string>,descriptionPlain:string,createdAt:bigint>>", "jobs", lambda: {"title": _c("j.text"), "url": _c("j.hostedUrl"), "location": _c("j.categories.location"), "department": _c("j.categories.team"), "employment_type": _c("j.categories.commitment"), "description": _c("j.descriptionPlain"), "posted_at": _c("j.createdAt").cast("string")}, None),
    "ashby": ("jobs array<struct<title:string,jobUrl:string,applyUrl:string,location:string,department:string,employmentType:string,descriptionHtml:string,publishedAt:string>>", "jobs", lambda: {"title": _c("j.title"), "url": F.coalesce("j.jobUrl", "j.applyUrl"), "location": _c("j.location"), "department": _c("j.department"), "employment_type": _c("j.employmentType"), "description": _c("j.descriptionHtml"), "posted_at": _c("j.publishedAt")}, None),
    "workable": ("results array<struct<title:string,shortcode:string,city:string,country:string,department:string,employment_type:string,description:string,published_on:string>>", "results", lambda: {"title": _c("j.title"), "url": F.concat(F.lit("https://apply.workable.com/"), "board", F.lit("/j/"), "j.shortcode"), "location": _join("j.city", "j.country"), "department": _c("j.department"), "employment_type": _c("j.employment_type"), "description": _c("j.description"), "posted_at": _c("j.published_on")}, None),
    "comeet": ("positions array<struct<name:string,url_active_page:string,location:struct<name:string,country:string>,department:string,employment_type:string,internal:boolean,details:array<struct<value:string>>,time_updated:string>>", "positions", lambda: {"title": _c("j.name"), "url": _c("j.url_active_page"), "location": F.concat(F.coalesce("j.location.name", F.lit("")), F.when(F.col("j.location.country") == "IL", ", Israel").otherwise("")), "department": _c("j.department"), "employment_type": _c("j.employment_type"), "description": F.array_join("j.details.value", "\n"), "posted_at": _c("j.time_updated")}, "not coalesce(j.internal, false)"),
    "recruitee": ("offers array<struct<title:string,careers_url:string,location:string,department:string,employment_type_code:string,description:string,requirements:string,published_at:string,status:string>>", "offers", lambda: {"title": _c("j.title"), "url": _c("j.careers_url"), "location": _c("j.location"), "department": _c("j.department"), "employment_type": _c("j.employment_type_code"), "description": F.concat_ws("\n", "j.description", "j.requirements"), "posted_at": _c("j.published_at")}, "coalesce(j.status, 'published') = 'published'"),
    "bamboohr": ("result array<struct<id:string,jobOpeningName:string,departmentLabel:string,employmentStatusLabel:string,location:struct<city:string,state:string>,isRemote:boolean>>", "result", lambda: {"title": _c("j.jobOpeningName"), "url": F.concat(F.lit("https://"), "board", F.lit(".bamboohr.com/careers/"), "j.id"), "location": F.concat(F.coalesce(_join("j.location.city", "j.location.state"), F.lit("")), F.when(F.col("j.isRemote"), " (Remote)").otherwise("")), "department": _c("j.departmentLabel"), "employment_type": _c("j.employmentStatusLabel")}, None),
    "breezy": ("jobs array<struct<name:string,url:string,location:struct<name:string,country:struct<name:string>>,department:string,type:struct<name:string>,published_date:string>>", "jobs", lambda: {"title": _c("j.name"), "url": _c("j.url"), "location": F.coalesce("j.location.name", "j.location.country.name"), "department": _c("j.department"), "employment_type": _c("j.type.name"), "posted_at": _c("j.published_date")}, None),
    "hibob": ("jobAdDetails array<struct<id:string,title:string,department:string,employmentType:string,site:string,country:string,description:string,publishedAt:string>>", "jobAdDetails", lambda: {"title": _c("j.title"), "url": F.concat(F.lit("https://"), "board", F.lit(".careers.hibob.com/jobs/"), "j.id"), "location": _join("j.site", "j.country"), "department": _c("j.department"), "employment_type": _c("j.employmentType"), "description": _c("j.description"), "posted_at": _c("j.publishedAt")}, None),
    "smartrecruiters": ("content array<struct<id:string,name:string,releasedDate:string,location:struct<city:string,country:string>,department:struct<label:string>,typeOfEmployment:struct<label:string>>>", "content", lambda: {"title": _c("j.name"), "url": F.concat(F.lit("https://jobs.smartrecruiters.com/"), "board", F.lit("/"), "j.id"), "location": _join("j.location.city", "j.location.country"), "department": _c("j.department.label"), "employment_type": _c("j.typeOfEmployment.label"), "posted_at": _c("j.releasedDate")}, None),
    "workday": ("jobPostings array<struct<title:string,externalPath:string,locationsText:string,postedOn:string>>", "jobPostings", lambda: {"title": _c("j.title"), "url": F.concat("board_url", "j.externalPath"), "location": _c("j.locationsText")}, None),
    "eightfold": ("positions array<struct<name:string,canonicalPositionUrl:string,location:string,department:string,job_description:string,t_create:bigint,isPrivate:boolean>>", "positions", lambda: {"title": _c("j.name"), "url": _c("j.canonicalPositionUrl"), "location": _c("j.location"), "department": _c("j.department"), "description": _c("j.job_description"), "posted_at": (_c("j.t_create") * 1000).cast("string")}, "not coalesce(j.isPrivate, false)"),
}


def postings(payloads: DataFrame, provider: str) -> DataFrame:
    """Postings of ``payloads`` (company_id, board, board_url, payload): FIELDS, and the provider. A payload that can't be
    read has no postings; postings without a title are dropped. A bare list counts as the list of items."""
    schema, items, mapping, keep = PROVIDERS[provider]
    body = F.when(F.ltrim("payload").startswith("["), F.concat(F.lit(f'{{"{items}":'), "payload", F.lit("}"))).otherwise(F.col("payload"))
    rows = payloads.select("company_id", "board", "board_url", F.explode(F.from_json(body, schema)[items]).alias("j"))
    if keep:
        rows = rows.where(keep)
    fields = mapping()
    out = rows.select("company_id", F.lit(provider).alias("provider"), *(fields.get(f, F.lit(None)).cast("string").alias(f) for f in FIELDS))
    out = out.withColumn("title", collapse("title")).withColumn("posted_at", posted_date("posted_at")).withColumn("description", strip_html("description"))
    return out.where("title != ''")


def personio(spark, path: str) -> DataFrame:
    """Postings of an XML feed."""
    schema = "id string, name string, office string, department string, employmentType string, createdAt string, jobDescriptions struct<jobDescription:array<struct<name:string,value:string>>>"
    rows = spark.read.schema(schema).option("rowTag", "position").xml(path)
    return rows.select(F.lit("personio").alias("provider"), collapse("name").alias("title"), "id", F.col("office").alias("location"), "department", F.col("employmentType").alias("employment_type"), strip_html(F.array_join("jobDescriptions.jobDescription.value", "\n")).alias("description"), posted_date("createdAt").alias("posted_at")).where("title != ''")
