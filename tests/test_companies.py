import json

import pytest

from tessera.operators import companies as C


def known(spark):
    return spark.createDataFrame([("a", "Acme Ltd", "https://www.acme.io/jobs", None), ("b", "Beta (Israel)", None, "skip"), ("c", "Acme", None, None)], "id string, display_name string, career_url string, review_decision string")


def test_resolve_and_register(spark):
    wanted = spark.createDataFrame([("ACME inc", "https://other.io"), ("New One", "https://acme.io/x"), ("Beta.io", None), ("Gamma-Delta Ltd", None), ("gamma delta ltd", None), (None, None)], "name string, career_url string")
    got = {r.name: (r.company_id, r.matched_by) for r in C.resolve(wanted, known(spark)).collect()}
    assert got["ACME inc"] == ("a", "key") and got["New One"] == ("a", "host") and got["Beta.io"][0] == "b" and got["Gamma-Delta Ltd"] == (None, None) and got[None] == (None, None)
    fresh, refused = C.register(wanted.where("name is not null"), known(spark))
    assert [(r.id, r.display_name) for r in fresh.collect()] == [("gamma_delta_ltd", "Gamma-Delta Ltd")] and refused.count() == 3


def test_decisions(spark):
    rows = C.set_career_urls(known(spark), spark.createDataFrame([("b", "https://b.io"), ("a", None)], "id string, career_url string"))
    assert {r.id: (r.career_url, r.review_decision) for r in rows.collect()} == {"a": ("https://www.acme.io/jobs", None), "b": ("https://b.io", None), "c": (None, None)}
    assert {r.id: r.review_decision for r in C.set_decision(known(spark), "c", "keep").collect()} == {"a": None, "b": "skip", "c": "keep"}
    with pytest.raises(ValueError):
        C.set_decision(known(spark), "c", "maybe")
    with pytest.raises(KeyError):
        C.set_decision(known(spark), "z", None)


def test_sources_and_fallback(spark):
    rows = spark.createDataFrame([("a", 2, 1), ("a", 1, 2), ("a", 1, 3), ("b", 3, 4)], "company_id string, p int, id int")
    assert sorted(r.id for r in C.first_source(rows, "p").collect()) == [2, 3, 4]
    results = spark.createDataFrame([("a", 0, "x", False, True), ("a", 1, "y", True, False), ("b", 0, "x", False, False), ("b", 1, "y", False, False), ("c", 0, "x", False, True)], "company_id string, place int, strategy string, healthy boolean, failed boolean")
    assert {r.company_id: r.strategy for r in C.with_fallback(results).collect()} == {"a": "y", "b": "x", "c": None}


def test_enrich(spark):
    ld = json.dumps({"@type": "JobPosting", "title": "Backend Engineer", "description": "<p>Build it</p>", "datePosted": "2026-01-02T00"})
    page = f'<script type="application/ld+json">{ld}</script><h1>Backend Engineer</h1><p>Requirements: Python</p><a href="/apply">Apply now</a>'
    listed = spark.createDataFrame([("https://x.io/jobs/1", "Backend Engineer Tel Aviv"), ("https://x.io/jobs/2", "Data Engineer"), ("https://x.io/jobs/3", "QA Engineer")], "url string, title string")
    pages = spark.createDataFrame([("https://x.io/jobs/1", "https://x.io/jobs/1", 200, page), ("https://x.io/jobs/2", "https://x.io/jobs/2", 404, "")], "requested_url string, url string, status int, html string")
    got = {r.url[-1]: r for r in C.enrich(listed, pages, listed.where("url like '%2'").select("url")).collect()}
    one = got["1"]
    assert (one.title, one.description, one.posted_at, one.fetch_status, one.gone_reason) == ("Backend Engineer", "Build it", "2026-01-02", "ok", None)
    assert (one.job_evidence.jsonld_jobposting, one.job_evidence.apply_cta, one.job_evidence.requirement_sections, one.job_evidence.role_family_from_title, one.job_evidence.previously_stored) == (True, True, 1, "backend", False)
    assert got["2"].gone_reason == "http 404" and got["2"].job_evidence.previously_stored
    assert (got["3"].title, got["3"].description, got["3"].fetch_status, got["3"].gone_reason) == ("QA Engineer", None, None, None)
