"""Schemas of the engine's tables."""

COMPANIES = "id STRING, display_name STRING, career_url STRING, review_decision STRING, host STRING, industry STRING, size STRING, address_city STRING, last_checked STRING, connection_count INT"
JOBS = (
    "id STRING, company_id STRING, title STRING, url STRING, description STRING, location STRING, city STRING, is_remote BOOLEAN, department STRING, employment_type STRING, status STRING, "
    "first_seen STRING, last_seen STRING, posted_at STRING, closed_at STRING, closed_reason STRING, years_required INT, is_referral BOOLEAN, referral_contact STRING, source_language STRING, "
    "title_original STRING, description_original STRING, scrape_source STRING, family STRING, canonical_title STRING, family_confidence STRING, taxonomy_version STRING, fetch_status STRING, work_mode STRING"
)
JOB_SCORES = "job_id STRING, profile_id STRING, score DOUBLE, coverage DOUBLE, confidence STRING, matched ARRAY<STRING>, cache_key STRING"
JOB_STATE = "job_id STRING, liked BOOLEAN, hidden BOOLEAN, sent BOOLEAN, reached_out BOOLEAN, updated_at STRING"
CONTACTS = "company_id STRING, name STRING, position STRING, url STRING"
SCRAPED = "company_id STRING, id STRING, title STRING, url STRING, location STRING, description STRING, department STRING, posted_at STRING"
REQUIREMENT = "kind STRING, text STRING, canonical STRING, years INT, bucket STRING, ord INT"
FLAGS = ("liked", "hidden", "sent", "reached_out")
