import pytest
from pyspark.sql import functions as F

from tessera.functions import titles
from tessera.operators import repairs

CARDS = {
    "Senior MLOps Engineer Full-time Senior Tel Aviv": ("Senior MLOps Engineer", "Tel Aviv", "Full-time"),
    "Engineering | Senior Backend Engineer | Tel Aviv": ("Senior Backend Engineer", "Tel Aviv", None),
    "Test Engineer, Senior": ("Test Engineer, Senior", None, None),
    "Sales Associate": ("Sales Associate", None, None),
    "Senior DevOps Engineer Dallas HQ": ("Senior DevOps Engineer", "Dallas HQ", None),
    "Enterprise Account Executive Dallas, TX": ("Enterprise Account Executive", "Dallas, TX", None),
    "Head of London Sales": ("Head of London Sales", None, None),
    "Solutions Engineer - USA": ("Solutions Engineer", "USA", None),
    "ABOUT US": ("ABOUT US", None, None),
    "Backend Engineer (Remote)": ("Backend Engineer (Remote)", None, None),
    "Data Engineer Location: Haifa, Israel": ("Data Engineer", "Haifa, Israel", None),
    "Tel Aviv Backend Engineer": ("Backend Engineer", "Tel Aviv", None),
    "Data Scientist · Remote · Full-time · Apply now": ("Data Scientist", "Remote", "Full-time"),
    "Platform Engineer Hybrid Apply now →": ("Platform Engineer", None, None),
    "Head of Office Operations": ("Head of Office Operations", None, None),
    "Full-time": ("", None, "Full-time"),
    "": ("", None, None),
    None: ("", None, None),
}


def test_card(spark):
    rows = spark.createDataFrame([(t,) for t in CARDS], "t string").select("t", titles.card("t").alias("c"))
    assert {r.t: tuple(r.c) for r in rows.collect()} == CARDS
    again = rows.select("c.title", titles.card("c.title")["title"].alias("again"))
    assert again.where("title != again").count() == 0


@pytest.mark.parametrize(
    ("card", "stated", "want"),
    [
        ("Tel Aviv Backend Engineer Full-time", ["Careers at X", "Backend Engineer"], "Backend Engineer"),
        ("Senior Backend Engineer", ["Backend Engineer"], None),
        ("More Details", ["Job opportunity: Data Scientist", "X"], "Data Scientist"),
        ("More Details", ["Sorry, you have been blocked", "Data Scientist"], None),
        ("Backend Engineer", [], None),
        ("", ["Backend Engineer"], None),
    ],
)
def test_authoritative(spark, card, stated, want):
    rows = spark.createDataFrame([(card, stated)], "card string, stated array<string>")
    assert rows.select(titles.authoritative("stated", "card")).first()[0] == want


def test_detail_titles(spark):
    page = "<title>Data Engineer | Acme</title><h1 class=x>Data <b>Engineer</b></h1><meta property='og:title' content=\"DE &amp; more\">"
    got = spark.createDataFrame([(page,), (None,)], "p string").select(titles.detail_titles("p")).collect()
    assert [r[0] for r in got] == [["Data Engineer", "DE & more", "Data Engineer | Acme", "Data Engineer", "Acme"], []]


def test_infer_location(spark):
    cases = [
        (("Haifa, Israel", "x", "", None, None), ("Haifa", "Haifa", False)),
        (("London,  United Kingdom", "x", "join our Tel Aviv team", None, None), ("London, United Kingdom", None, False)),
        ((None, "Customer Success Manager Dallas HQ", "", "Tel Aviv", None), ("Dallas HQ", None, False)),
        (("", "x", "", "Rehovot", None), ("Rehovot", "Rehovot", False)),
        (("Israel", "x", "", None, "Haifa"), ("Haifa", "Haifa", False)),
        (("Israel", "x", "", None, None), ("Israel", None, False)),
        ((None, "x", "work from home", None, None), ("Remote", None, True)),
        ((None, None, None, None, None), (None, None, False)),
    ]
    rows = spark.createDataFrame([(i, *c) for i, (c, _) in enumerate(cases)], "i int, l string, t string, d string, o string, h string")
    got = {r.i: tuple(r.x) for r in rows.select("i", titles.infer_location("l", "t", "d", "o", "h").alias("x")).collect()}
    assert got == {i: w for i, (_, w) in enumerate(cases)}


JOB = "id string, company_id string, title string, url string, description string, location string, city string, is_remote boolean, status string, last_seen string, closed_at string, closed_reason string, title_original string, source_language string, department string, family string, family_confidence string, taxonomy_version string"


def rows(spark, *jobs):
    names = [x.split()[0] for x in JOB.split(", ")]
    return spark.createDataFrame([tuple(j.get(n) for n in names) for j in jobs], JOB)


def test_repairs(spark):
    r = rows(
        spark,
        {"id": "1", "title": "About Us", "status": "new", "is_remote": True, "description": "distributed systems", "location": "NaN", "city": "Tel Aviv", "department": "R&D"},
        {"id": "2", "title": "Account Manager, London", "status": "seen", "is_remote": True, "location": "remote", "city": "Tel Aviv", "taxonomy_version": "v2", "family": "kept"},
        {"id": "3", "title": None, "status": "closed"},
    )
    closed = {x.id: (x.status, x.closed_reason) for x in repairs.close_navigation(r, "now").collect()}
    assert closed == {"1": ("closed", "not a job: site navigation"), "2": ("seen", None), "3": ("closed", None)}
    assert {x.id: x.is_remote for x in repairs.fix_remote(r).collect()} == {"1": False, "2": True, "3": None}
    assert {x.id: (x.location, x.city) for x in repairs.fix_locations(r).collect()} == {"1": (None, "Tel Aviv"), "2": ("London", None), "3": (None, None)}
    assert {x.id: x.title for x in repairs.resplit_titles(r).collect()} == {"1": "About Us", "2": "Account Manager", "3": None}
    assert {x.id: (x.family, x.taxonomy_version) for x in repairs.backfill_families(r, "v2").collect()} == {"1": (None, "v2"), "2": ("kept", "v2"), "3": (None, "v2")}
    raw = spark.createDataFrame([("2", "Engineering")], "id string, raw string")
    assert {x.id: x.department is None for x in repairs.fold_departments(r, raw).collect()}["2"] is False
    once = repairs.close_navigation(repairs.fix_locations(r), "now")
    assert sorted(map(str, once.collect())) == sorted(map(str, repairs.close_navigation(repairs.fix_locations(once), "later").collect()))


def test_translations_and_cache(spark):
    r = rows(spark, {"id": "1", "title": "מהנדס"}, {"id": "2", "title": "מנהל"}, {"id": "3", "title": "Writer"}, {"id": "4", "title": "טבח"})
    mapping = spark.createDataFrame([("מהנדס", "Engineer"), ("מנהל", "מנהל"), ("אחר", "Other")], "title string, english string")
    done, problems = repairs.apply_translations(r, mapping)
    assert {x.id: (x.title, x.title_original, x.source_language) for x in done.collect()} == {"1": ("Engineer", "מהנדס", "he"), "2": ("מנהל", None, None), "3": ("Writer", None, None), "4": ("טבח", None, None)}
    assert {(x.title, x.problem) for x in problems.collect()} == {("טבח", "missing"), ("אחר", "unused")}
    assert repairs.poisoned(mapping.selectExpr("title as key", "english as value")).count() == 2


def test_audits(spark):
    r = rows(spark, {"id": "1", "company_id": "c", "title": "A", "url": "https://x/jobs/9?t=1", "status": "closed"}, {"id": "2", "company_id": "c", "title": "A", "url": "https://x/jobs/9", "status": "new"}, {"id": "3", "company_id": "c", "title": "B", "url": "https://x/jobs/7", "status": "new"})
    twins, merged = repairs.merge_duplicates(r, "now")
    assert [x.id for x in twins.collect()] == ["1"] and {x.id: x.status for x in merged.collect()} == {"1": "seen", "2": "new", "3": "new"}
    out, counts = repairs.url_audit(r, spark.createDataFrame([("https://x/jobs/7", 404), ("https://x/jobs/9", 429)], "url string, status int"), "now")
    assert {x.id: (x.status, x.closed_reason) for x in out.collect()} == {"1": ("closed", None), "2": ("new", None), "3": ("closed", "http 404")}
    assert {x.url_class: x.n for x in counts.collect()} == {"broken": 1, "blocked": 1}
    tries = spark.createDataFrame([("a", 200, "this job is no longer available"), ("a", 200, "apply here"), ("b", 200, "apply"), ("c", 429, ""), ("d", 500, None), ("e", 404, "")], "id string, status int, html string")
    assert {x.id: x.verdict for x in repairs.banner_audit(tries).collect()} == {"a": "closed", "b": "open", "c": "blocked", "d": "error", "e": "closed"}
    assert repairs.non_jobs(r.withColumn("title", F.lit("About Us")), spark.createDataFrame([("2",)], "job_id string")).count() == 2
