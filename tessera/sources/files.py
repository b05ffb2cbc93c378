"""Sources kept as files: category CSVs, contact exports with a preamble, referral JSON, plans, profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.text import collapse, normalize_company

TECHMAP = "company STRING, category STRING, size STRING, title STRING, level STRING, city STRING, url STRING, updated STRING"


def techmap(spark: SparkSession, path: str) -> DataFrame:
    """Category CSVs: trimmed, blanks null, query cut off the URL, the file's name as category, rows without company or title dropped."""
    rows = spark.read.csv(path, header=True, schema=TECHMAP, enforceSchema=False).withColumn("category", F.regexp_extract(F.input_file_name(), r"([^/]+)\.csv$", 1))
    rows = rows.select(*(F.nullif(F.trim(F.col(x)), F.lit("")).alias(x) for x in rows.columns))
    return rows.withColumn("url", F.substring_index("url", "?", 1)).where("company is not null and title is not null")


def connections(spark: SparkSession, path: str) -> DataFrame:
    """Contacts (company, company_key, name, position, url) after a free-text preamble; one per company, name and URL, the first."""
    lines = spark.read.text(path, wholetext=False).withColumn("line", F.monotonically_increasing_id())
    cells = F.transform(F.split(F.lower("value"), ","), lambda x: F.trim(x))
    header = lines.where(F.array_contains(cells, "first name") & F.array_contains(cells, "last name") & F.array_contains(cells, "company")).orderBy("line").limit(1).collect()
    if not header:
        return spark.createDataFrame([], "company string, company_key string, name string, position string, url string")
    names = [x.strip() for x in header[0]["value"].split(",")]
    schema = ", ".join(f"`{n}` string" for n in names)
    body = lines.where(F.col("line") > header[0]["line"]).where(F.trim("value") != "")
    rows = body.select("line", F.from_csv("value", F.lit(schema)).alias("r"))
    pick = lambda n: F.col(f"r.`{n}`") if n in names else F.lit(None).cast("string")
    rows = rows.select("line", collapse(pick("Company")).alias("company"), collapse(F.concat_ws(" ", pick("First Name"), pick("Last Name"))).alias("name"), F.trim(pick("Position")).alias("position"), F.trim(pick("URL")).alias("url")).where("company != ''")
    rows = rows.withColumn("company_key", normalize_company("company"))
    w = W.partitionBy("company_key", F.lower("name"), F.lower(F.coalesce("url", F.lit("")))).orderBy("line")
    return rows.withColumn("n", F.row_number().over(w)).where("n = 1").select("company", "company_key", "name", "position", "url")


REFERRALS = "companies array<struct<company string, also_posted_as array<string>, jobs array<struct<title string, link string, locations array<string>, seniority_group array<string>, field string, requirements array<string>, exp_years_min int, first_seen string, last_seen string, contact string>>>>"


def referrals(spark: SparkSession, path: str) -> DataFrame:
    """Nested referral JSON as rows."""
    c = spark.read.schema(REFERRALS).json(path, multiLine=True).select(F.explode("companies").alias("c"))
    j = c.select("c.company", "c.also_posted_as", F.explode("c.jobs").alias("j"))
    years = F.when(F.col("j.exp_years_min").isNotNull(), F.concat(F.lit("At least "), F.col("j.exp_years_min").cast("string"), F.lit(" years of experience.")))
    return j.select("company", "also_posted_as", "j.title", F.col("j.link").alias("url"), F.array_join("j.locations", ", ").alias("location"), F.concat_ws("\n", years, F.array_join("j.requirements", "\n")).alias("description"), F.col("j.field").alias("department"), F.col("j.first_seen").alias("posted_at"), "j.contact")


def plans(spark: SparkSession, path: str, version: int = 1) -> DataFrame:
    """Plans, one JSON file per company; unreadable ones are skipped and older versions are stale."""
    schema = "company_id string, schema_version int, career_url string, derived_by string, derived_at string, status string, strategy struct<kind:string,provider:string,board:string,url_shape:string,include_url:string>, _corrupt string"
    rows = spark.read.schema(schema).json(path, multiLine=True, columnNameOfCorruptRecord="_corrupt").where("company_id is not null").drop("_corrupt")
    return rows.withColumn("status", F.when(F.col("schema_version") < version, "stale").otherwise(F.col("status"))).orderBy("company_id")


def profiles(spark: SparkSession, path: str) -> DataFrame:
    """Profile texts, one file each: (profile_id, text)."""
    rows = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    return rows.select(F.regexp_extract("file", r"([^/]+)\.\w+$", 1).alias("profile_id"), F.col("value").alias("text"))


def write_versioned(df: DataFrame, root: str, version: int) -> str:
    """A table's next version in a folder of its own; readers open the highest that has _SUCCESS."""
    path = f"{root}/v={version:08d}"
    df.write.mode("overwrite").parquet(path)
    return path
