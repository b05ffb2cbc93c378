"""The store, reads of it, caches, the index, the gate, discovery and feeds, on small rows."""

import io
import json
import random
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from tessera.functions import vocabulary as V
from tessera.operators import caches, discovery, gate, listing, reads, scoring
from tessera.plans import index
from tessera.plans import search as S
from tessera.sources import feeds, store


def test_versions_survive_a_broken_write(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}")
    with pytest.raises(KeyError):
        s.read("jobs")
    for k in range(4):
        assert s.write("jobs", spark.range(k + 1)) == k + 1
    assert s.read("jobs").count() == 4 and [p.name for p in sorted((tmp_path / "jobs").iterdir())] == ["v=00000003", "v=00000004"]
    (tmp_path / "jobs" / "v=00000009").mkdir()  # a run that died before it was done
    assert s.read("jobs").count() == 4 and s.write("jobs", spark.range(7)) == 5


def test_migrations_run_once_and_in_order(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}")
    first = {1: "jobs := select 1 as id, 'a' as title", 2: "jobs := select *, false as remote from jobs; flags := select id from jobs"}
    assert s.migrate(first) == 2
    assert s.read("jobs").collect()[0].asDict() == {"id": 1, "title": "a", "remote": False} and s.read("flags").count() == 1
    assert s.migrate({**first, 1: "jobs := select 9 as id", 3: "jobs := select *, 3 as n from jobs"}) == 3  # an applied number never runs again
    assert s.read("jobs").columns == ["id", "title", "remote", "n"]
    assert store.shared(spark, f"file://{tmp_path}") is store.shared(spark, f"file://{tmp_path}")


def test_documents_and_pages(spark, tmp_path):
    path = f"file://{tmp_path}/x.json"
    assert store.read_json(spark, path, 7) == 7
    store.write_json(spark, path, {"a": "é"})
    store.write_json(spark, path, {"a": [1]})
    assert store.read_json(spark, path) == {"a": [1]}
    assert store.put_plan(spark, f"file://{tmp_path}", {"company_id": "acme", "status": "verified"}).endswith("/acme.json")
    rows = spark.createDataFrame([(1, "</script>")], "id int, t string")
    assert store.page("<b>{{title}}</b>{{rows}}", rows, title="T") == '<b>T</b>[{"id":1,"t":"<\\/script>"}]'
    with pytest.raises(ValueError):
        store.page("{{rows}}", spark.range(3), most=2)


def test_profiles(spark, tmp_path):
    registry = {}
    for want in ("dana_cohen", "dana_cohen_2", "dana_cohen_3"):
        got, registry = store.register_profile(registry, " Dana  Cohen! ", ".docx", "now")
        assert got == want and registry[got]["filename"] == f"{want}.docx"
    assert list(store.remove_profile(registry, "dana_cohen_2")) == ["dana_cohen", "dana_cohen_3"]
    assert store.with_overrides({}, "p", {"backend": "boost"}) == {"p": {"backend": "boost"}} and store.with_overrides({"p": {"a": "block"}}, "p", {}) == {}
    with pytest.raises(ValueError):
        store.with_overrides({}, "p", {"backend": "maybe"})
    body = io.BytesIO()
    space = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    with zipfile.ZipFile(body, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{space}"><w:body><w:p><w:r><w:t>Dana </w:t></w:r><w:r><w:t>Cohen</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>Skills: Python</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>')
    (tmp_path / "a.docx").write_bytes(body.getvalue())
    (tmp_path / "b.txt").write_text("plain")
    (tmp_path / "c.pdf").write_bytes(b"%PDF")
    got = {r.profile_id: r.text for r in store.cv_texts(spark, f"file://{tmp_path}").collect()}
    assert got == {"a": "Dana Cohen\nSkills: Python", "b": "plain", "c": None}
    assert store.scoring_bundle({"weights": {"must": 0.6, "seniority": 0.15}})["weights"]["must"] == 0.6
    for bad in ({"weights": {"must": 0.9}}, {"weights": {"other": 0}}):
        with pytest.raises(ValueError):
            store.scoring_bundle(bad)


def test_index_answers_as_the_texts_do(spark):
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "node.js", "c++", "Émile", "data-base", "R&D"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 3))) or None, " ".join(rng.choices(words, k=rng.randint(0, 8))) or None) for i in range(120)]
    jobs = spark.createDataFrame([(i, "c", t, d, "new", 0) for i, t, d in rows], "id int, company_id string, title string, description string, status string, x int")
    companies = spark.createDataFrame([("c", "C", 1)], "id string, display_name string, connection_count int")
    half = jobs.where("id < 60")
    kept = index.update(index.build(half.withColumn("title", F.lit("old text"))), jobs, spark.createDataFrame([(5,)], "id int"))  # inserts, changes, a deletion that comes back
    plain, indexed = S.Search(jobs, companies), S.Search(jobs, companies, index=kept.persist())
    for f in (S.Filters(q="alpha"), S.Filters(q="alpha beta", scope="title"), S.Filters(q="node.js"), S.Filters(q="emile gamma"), S.Filters(q="+ -"), S.Filters(q="alpha +"), S.Filters(q="old"), S.Filters(exclude="alpha beta"), S.Filters(exclude="node.js"), S.Filters(q="beta", exclude="gamma data.base")):
        assert {r.id for r in indexed.rows(f).collect()} == {r.id for r in plain.rows(f).collect()}, f


def test_caches(spark):
    cache = spark.createDataFrame([("a", "2026-01-01T00:00:00", "old"), ("a", "2026-01-02T00:00:00", "new"), ("b", "not a time", "x"), ("c", "2025-01-01T00:00:00", "stale"), ("d", "2026-01-02T00:00:00", None)], "key string, stored_at string, value string")
    wanted = spark.createDataFrame([(k,) for k in "abcde"], "key string")
    got = {r.key: (r.value, r.hit) for r in caches.look_up(wanted, cache, "2026-01-02T10:00:00", 24).collect()}
    assert got == {"a": ("new", True), "b": (None, False), "c": (None, False), "d": (None, False), "e": (None, False)}
    assert {r.key for r in caches.misses(wanted.union(wanted), cache, "2026-01-02T10:00:00", 24).collect()} == set("bcde")
    fetched = spark.createDataFrame([("b", "fine"), ("c", None), ("e", "שלום עולם")], "key string, value string")
    after = {r.key: r.value for r in caches.store(cache.where("key != 'a'"), fetched, "2026-01-03T00:00:00", caches.untranslated("value")).where("key in ('b', 'c', 'e')").collect()}
    assert after == {"b": "fine", "c": "stale"}  # failures are never stored


def test_reads(spark):
    state = spark.createDataFrame([("1", True, False, False, None)], "job_id string, liked boolean, hidden boolean, sent boolean, reached_out boolean")
    ids = spark.createDataFrame([("1",), ("2",), ("2",)], "job_id string")
    assert {tuple(r) for r in reads.flags_of(ids, state).collect()} == {("1", True, False, False, False), ("2", False, False, False, False)}
    with pytest.raises(ValueError):
        reads.ids_with(state, "loved")
    companies = spark.createDataFrame([("a", "A", "soft"), ("b", "B", None)], "id string, display_name string, industry string")
    with pytest.raises(ValueError):
        reads.upsert_companies(companies, companies.withColumn("colour", F.lit(1)))
    got = {tuple(r) for r in reads.upsert_companies(companies, spark.createDataFrame([("a", None), ("c", "new")], "id string, industry string")).collect()}
    assert got == {("a", "A", None), ("b", "B", None), ("c", None, "new")}
    urls = spark.createDataFrame([("https://user@www.Acme.io:8080/x",), (None,), ("acme",)], "u string")
    assert [r[0] for r in urls.select(reads.company_domain("u")).collect()] == ["acme.io", None, None]
    bad = spark.createDataFrame([('{"apply_cta": true}',), ("{oops",), ("[1]",), (None,)], "job_evidence string")
    assert [r[0] and r[0].apply_cta for r in reads.decoded(bad).collect()] == [True, None, None, None]


def test_gate(spark):
    rows = spark.createDataFrame([("Series C round, C++ and Java", "x"), ("JavaScript only", "y"), ("We use C daily", "z"), (None, "n")], "t string, k string")
    assert {r.k: r.x for r in rows.select("k", gate.languages("t").alias("x")).collect()} == {"x": ["C++", "Java"], "y": ["JavaScript"], "z": ["C"], "n": []}
    page = spark.createDataFrame([("https://conifer.com", "Conifer Health Solutions", "conifers.ai", "Conifers Ltd."), ("u", "about Conifers, the firm", "", "Conifers Ltd."), ("https://www.conifers.ai/x", "", "conifers.ai", "Conifers"), ("u", "a co", "", "Co")], "url string, t string, d string, c string")
    assert [r[0] for r in page.select(gate.mentions_company("url", "t", "d", "c")).collect()] == [False, True, True, False]
    assert gate.taxonomy_version() == gate.taxonomy_version() != gate.taxonomy_version({"a": ["b"]}) and len(gate.taxonomy_version()) == 12
    assert gate.engine_version(scoring) == gate.engine_version(scoring) != gate.engine_version(scoring, config={"must": 1}) != gate.engine_version(listing)
    texts = spark.createDataFrame([("text", ["a"]), ("", ["a", "b"]), (None, None)], "t string, k array<string>")
    assert [r[0] for r in texts.select(gate.cv_text("t", "k")).collect()] == ["text", "Skills: a, b", ""]


def test_scores_name_gaps_and_refuse_what_is_no_posting(spark):
    kind = "profile_id string, family string, families map<string,double>, seniority string, years int, education array<string>, certifications array<string>, languages array<string>, places array<string>, roles array<string>, evidence int, skills array<struct<canonical:string,strength:string,recency:int>>"
    p = spark.createDataFrame([("p1", "backend", {"backend": 1.0}, "mid", 7, [], [], [], [], [], 80, [("python", "strong", 1)])], kind)
    evidence = lambda cta: (False, cta, 0, None)
    jobs = spark.createDataFrame([("a", "Senior Backend Engineer", "Requirements:\n- Python is a must\n- Kafka is a must\nNice to have:\n- Redis and more of it all", None), ("b", "About us", "We do deep things with Python, and we do them very well indeed.", None), ("c", "Backend Engineer", "Requirements:\n- Python is a must, in all that we do here every day", evidence(False)), ("d", "Backend Engineer", "", evidence(True))], "id string, title string, description string, job_evidence struct<jsonld_jobposting:boolean,apply_cta:boolean,requirement_sections:int,role_family_from_title:string>")
    got = {r.job_id: r for r in scoring.score_jobs(jobs, p, spark.createDataFrame([("python", 2.0)], "term string, idf double"), spark.createDataFrame([("backend", "backend", 1.0)], "a string, b string, affinity double")).collect()}
    assert got["a"].gaps == ["Missing must-have: Kafka is a must", "Seniority is 1 level(s) less senior than the job", "Missing nice-to-have: Redis and more of it all"]
    assert got["a"].summary == f"This CV scores {got['a'].score}/100 ({got['a'].band}), covering 1 of 2 must-have requirements. Biggest gap: Missing must-have: Kafka is a must."
    assert (got["b"].score, got["b"].confidence, got["c"].score, got["c"].confidence) == (0, "title_only", 0, "title_only")
    assert got["a"].confidence == "full" and got["d"].score > 0 and got["d"].confidence == "title_only"


def test_an_induced_pattern_accepts_its_own_links(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for page in range(40):
        host, kind = f"acme-{page}.io", page % 4
        for i in range(rng.randint(1, 6)):
            n = rng.randint(100, 10**6)
            href = {0: f"https://www.{host}/careers/r-and-d/{n}-dev", 1: f"https://{host}/jobs.aspx?lang=en&id={n}", 2: f"https://{host}/en/jobs/{'x/' * (i % 2)}{n}", 3: f"http://{host}/a+b/(c)/{n}/"}[kind]
            rows.append((page, i, href, True))
        rows.append((page, 90, f"https://{host}/about/team", False))
    df = spark.createDataFrame(rows, "page_id int, index int, href string, is_job boolean")
    from tessera.functions import urls

    df = df.withColumn("href_shape", urls.href_shape("href"))
    plans = listing.induce(df)
    hit = df.join(plans, "page_id").select("page_id", "is_job", F.regexp_like("href", F.col("include_url")).alias("hit")).collect()
    assert len(hit) == len(rows) and all(r.hit == r.is_job for r in hit)
    want = {0: "acme-0.io|careers/r-and-d|3", 1: "acme-1.io|?id,lang"}
    assert {r.page_id: r.url_shape for r in plans.where("page_id < 2").collect()} == want
    mixed = spark.createDataFrame([(1, 0, "https://a.io/x/1", True, "s"), (1, 1, "https://b.io/x/2", True, "s")], "page_id int, index int, href string, is_job boolean, href_shape string")
    assert listing.induce(mixed).first().include_url is None


def test_a_hop_replaces_a_landing_page(spark):
    plans = spark.createDataFrame([("a", "html_listing", None, None, "verified", 1, "https://a/jobs"), ("b", "html_listing", None, None, "verified", 2, "https://b/jobs"), ("c", "html_listing", None, None, "verified", 0, "https://c/jobs")], "company_id string, kind string, board string, reason string, status string, baseline long, hop_url string")
    second = spark.createDataFrame([("a", "html_listing", None, None, "verified", 7), ("b", "html_listing", None, None, "verified", 2), ("c", "ats_api", "lever:c", None, "verified", None)], "company_id string, kind string, board string, reason string, status string, baseline long")
    got = {r.company_id: (r.kind, r.board, r.baseline, r.listing_url) for r in discovery.after_hop(plans, second).collect()}
    assert got == {"a": ("html_listing", None, 7, "https://a/jobs"), "b": ("html_listing", None, 2, None), "c": ("ats_api", "lever:c", None, "https://c/jobs")}


def test_listing_links(spark):
    rows = [("See all open roles", "/x", True), ("Jobs", "/x", True), ("Backend Engineer", "/careers/jobs/", True), ("Backend Engineer", "/jobs/?id=3", False), ("Backend Engineer", "/careers/jobs/12", False), ("Open Source Engineer", "/x/1", False), ("Find your next job", "/y", True)]
    got = spark.createDataFrame([(t, f"https://a.io{u}", w) for t, u, w in rows], "t string, u string, w boolean").select("t", "u", "w", discovery.listing_link("t", "u").alias("g")).collect()
    assert [(r.t, r.g) for r in got] == [(t, w) for t, _, w in rows]
    assert discovery.with_reject(["a"], "a") == ["a"] and discovery.with_reject(["a"], "b") == ["a", "b"]
    with pytest.raises(ValueError):
        discovery.with_reject([], "(")


def test_plain_and_column_denials_agree(spark):
    from tessera.functions import rules

    rows = ["Home", "Backend Engineer", "x" * 121, "jobs@acme.io", "https://acme.io/x", "12345678", "מפתח תוכנה", "[#tag-tag", "About us", "view all", "Team lead, R&D"]
    got = spark.createDataFrame([(r,) for r in rows], "t string").select("t", (~rules.denied_text("t")).alias("ok")).collect()
    assert [r.ok for r in got] == [discovery.reads_like_posting(r.t) for r in got]
    assert V.NAV_LABEL.startswith("(?i)")


def test_files_of_earlier_versions(spark, tmp_path):
    (tmp_path / "addresses.json").write_text(json.dumps({"Acme Ltd.": [{"city": ""}, {"city": "Haifa"}], "Beta": [{"street": "x"}]}))
    assert [tuple(r) for r in feeds.addresses(spark, f"file://{tmp_path}/addresses.json").collect()] == [("acme", "Haifa")]
    (tmp_path / "companies").mkdir()
    (tmp_path / "companies" / "acme.json").write_text(json.dumps({"name": "Acme Ltd.", "career_url": "https://old", "jobs": [{"id": "1", "title": "Dev", "scores": {"p": 70.0}}, {"id": "2", "title": "QA", "status": "closed"}]}))
    (tmp_path / "companies" / "_meta.json").write_text("{}")
    files = feeds.legacy_files(spark, f"file://{tmp_path}/companies/*.json")
    pages = spark.createDataFrame([("Acme Ltd.", "https://new"), ("Gamma", None)], "name string, career_url string")
    review = spark.createDataFrame([("ACME", "skip")], "name string, decision string")
    companies, jobs, scores = feeds.migrate_legacy(files, pages, review, feeds.addresses(spark, f"file://{tmp_path}/addresses.json"))
    assert {(r.id, r.career_url, r.review_decision, r.address_city) for r in companies.collect()} == {("acme_ltd", "https://new", "skip", "Haifa"), ("gamma", None, None, None)}
    assert {(r.id, r.company_id, r.status, r.description) for r in jobs.collect()} == {("1", "acme_ltd", "seen", ""), ("2", "acme_ltd", "closed", "")}
    assert [tuple(r) for r in scores.collect()] == [("1", "p", 70.0)]
    assert feeds.verify_migration(files, jobs).count() == 0
    broken = jobs.where("id = '1'").withColumn("title", F.lit("x"))
    assert {(r.id, r.field) for r in feeds.verify_migration(files, broken).collect()} == {("1", "title"), ("2", "*")}


def test_research_pages(spark):
    from tessera.operators import research as R

    companies = spark.createDataFrame([("a", "Conifers Ltd.", "conifers.ai"), ("b", "Beta", None), ("c", "Gamma", "g.io"), ("d", "Delta", None)], "company_id string, company string, domain string")
    hits = spark.createDataFrame([
        ("a", "size", "q1", True, 1, "https://x/1", "Conifers has 50 people in all", "s"), ("a", "size", "q1", True, 2, "https://x/2", None, "Conifer Realty has 900"), ("a", "size", "q1", True, 4, "https://x/4", "conifers.ai", None),
        ("a", "size", "q2", False, 1, "https://x/9", "Conifers by name", None), ("b", "size", "q", False, 1, "https://y/1", "", "Beta snippet"), ("c", "size", "q", True, 1, "https://z", "another firm", None),
    ], "company_id string, topic string, query string, by_domain boolean, place int, url string, text string, snippet string")
    found = R.gathered(hits)
    assert {(r.company_id, r.url) for r in found.collect()} == {("a", "https://x/1"), ("a", "https://x/2"), ("b", "https://y/1"), ("c", "https://z")}
    kept = R.naming(found, companies)
    assert {(r.company_id, r.url) for r in kept.collect()} == {("a", "https://x/1"), ("b", "https://y/1")}
    topics = spark.createDataFrame([("size", "how many people")], "topic string, text string")
    assert {(r.company_id, r.error) for r in R.without_pages(companies, topics, found, kept).collect()} == {("c", "no page named this company"), ("d", "no search results")}
    read = R.context(kept, topics)
    assert [(r.company_id, r.url) for r in read.collect()] == [("a", "https://x/1"), ("b", "https://y/1")]
    answers = spark.createDataFrame([("a", "size", {"size": "50"}, ["https://x/1", "https://made-up"]), ("b", "size", {"size": "unknown"}, None)], "company_id string, topic string, fields map<string,string>, cited array<string>")
    got = {r.company_id: (r.sources, r.attribution, r.error) for r in R.attributed(answers, read, F.array(F.lit("size"))).collect()}
    assert got == {"a": (["https://x/1"], "cited", None), "b": (None, None, "pages said nothing")}
    cache = spark.createDataFrame([("a", "2026-01-01T00:00:00", "kept"), ("b", "2025-12-01T00:00:00", "old")], "key string, stored_at string, value string")
    have, need = R.to_research(companies, cache, "2026-01-15T00:00:00")
    assert {r.company_id for r in have.collect()} == {"a"} and {r.company_id for r in need.collect()} == {"b", "c", "d"}


def test_legacy_dataset(spark):
    from tessera.operators import legacy

    rows = spark.createDataFrame([(0, "A", "soft", "11-50", "Dev", "senior", None, "u1", None), (1, "A", "other", "x", "QA", None, "Haifa", "u2", None), (2, "B", "bio", None, "Analyst", None, "Berlin", "u3", None), (3, "B", "bio", None, "x" * 201, None, "Lod", "u4", None)], "place int, company string, category string, size string, title string, level string, city string, url string, updated string")
    fetched = spark.createDataFrame([("A", "Backend Dev", "f1", None, "text"), ("A", "Ops", "f2", "Remote", None)], "company string, title string, url string, location string, description string")
    scores = spark.createDataFrame([("f2", 80.0), ("f2", 20.0), ("f1", 10.0)], "url string, score double")
    got = legacy.dataset(rows, fetched, scores, spark.createDataFrame([("f2", "filled")], "url string, text string")).collect()
    assert [(r.company, r.title, r.city, r.industry, r.best_score, r.description) for r in got] == [("A", "Ops", "Haifa", "soft", 80.0, "filled"), ("A", "Backend Dev", "Haifa", "soft", 10.0, "text")]
    assert [r.title for r in legacy.dataset(rows, fetched, scores, relevant_only=False).collect()] == ["Ops", "Backend Dev", "Analyst"]


def test_referral_titles_against_brute_force(spark):
    from difflib import SequenceMatcher

    from tessera.operators import jobs as J

    rng = random.Random(8)
    words = ["senior", "backend", "back", "end", "engineer", "developer", "data", "qa", "lead", "ops"]
    title = lambda: " ".join(rng.choices(words, k=rng.randint(1, 4)))
    jobs = [(i, "abc"[i % 3], title(), f"https://x.io/{i}") for i in range(150)]
    asked = [("AB"[i % 2], title(), f"https://x.io/{rng.randint(0, 400)}?utm_source=a" if i % 3 else None) for i in range(60)]
    got = J.merge_referrals(spark.createDataFrame(jobs, "id int, company_id string, title string, url string"), spark.createDataFrame([("a", "A"), ("b", "B"), ("c", "C")], "id string, display_name string"), spark.createDataFrame([(c, None, t, u, "x") for c, t, u in asked], "company string, also_posted_as array<string>, title string, url string, contact string"), "now").collect()
    want = []
    for c, t, u in asked:
        near = [i for i, of, s, v in jobs if of == c.lower() and ((u or "").split("?")[0] == v or SequenceMatcher(None, t, s).ratio() >= 0.75)]
        want.append((c.lower(), t, u, min(near, default=None)))
    key = lambda r: tuple(map(str, r))
    assert sorted(((r.company_id, r.title, r.url, r.job_id) for r in got), key=key) == sorted(want, key=key)


def test_command_line(spark, tmp_path, capsys):
    from tessera import __main__ as cli

    s = store.Store(spark, f"file://{tmp_path}")
    s.write("jobs", spark.createDataFrame([("1", "a", "Backend Engineer", "Python", "new", "https://x/jobs/1", "Haifa", "Haifa, Israel", None, "ok", "2026-01-01", "backend"), ("2", "a", "Sales Manager", "", "closed", "u", None, None, None, "ok", None, None)], "id string, company_id string, title string, description string, status string, url string, city string, location string, work_mode string, fetch_status string, posted_at string, family string"))
    s.write("companies", spark.createDataFrame([("a", "Acme")], "id string, display_name string"))
    s.write("job_scores", spark.createDataFrame([("1", "p", 70.0)], "job_id string, profile_id string, score double"))
    for args in (["refresh"], ["search", "--query", "q=python"], ["facets", "--dimension", "city"], ["export", "--out", f"{tmp_path}/out"], ["audit"], ["worklist", "open"]):
        assert cli.main(["--root", f"file://{tmp_path}", *args]) == 0
    said = capsys.readouterr().out
    assert "1 in all" in said and "'kept': 1" in said and s.read("search_index").count() == 5 and spark.read.json(f"{tmp_path}/out").count() == 1


@pytest.fixture(scope="module")
def site():
    """A web site on this machine."""
    import threading
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

    class Handler(BaseHTTPRequestHandler):
        def answer(self, body: bytes, kind="text/html; charset=utf-8", status=200):
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.end_headers()
            self.wfile.write(body)

        def do_GET(self):
            if self.path == "/old":
                self.send_response(302)
                self.send_header("Location", "/page")
                self.end_headers()
            elif self.path.startswith("/page"):
                self.answer("<p>é</p>".encode())
            elif self.path == "/data.json":
                self.answer(b"{}", "application/json")
            elif self.path.startswith("/board/"):
                _, _, board, start, size = self.path.split("/")
                n = {"a": 23, "b": 0, "bad": 15}[board]
                if board == "bad" and int(start) >= 10:
                    return self.answer(b"oops", "application/json")
                items = [{"id": i} for i in range(int(start), min(n, int(start) + int(size)))]
                self.answer(json.dumps({"data": {"items": items}, "n": n}).encode(), "application/json")
            else:
                self.answer(b"", status=404)

        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            items = list(range(asked["offset"], min(45, asked["offset"] + asked["limit"])))
            self.answer(json.dumps({"jobPostings": items, "total": 45}).encode(), "application/json")

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_fetch(spark, site):
    from tessera.sources import fetch

    asked = spark.createDataFrame([(f"{site}/{p}",) for p in ("page", "page", "old", "none", "data.json")] + [("http://127.0.0.1:1/x",), ("no address",), (None,)], "url string")
    got = {r.requested_url: r for r in fetch.fetch(asked, delay=0.0).collect()}
    assert len(got) == 6
    one = lambda p: got[f"{site}/{p}"]
    assert (one("page").status, one("page").html, one("page").error) == (200, "<p>é</p>", None)
    assert (one("old").url, one("old").html) == (f"{site}/page", "<p>é</p>")
    assert (one("none").status, one("none").error) == (404, "http 404") and (one("data.json").html, one("data.json").error) == (None, "type application/json")
    assert got["http://127.0.0.1:1/x"].status is None and got["no address"].error == "ValueError"
    assert [len(r.html) for r in fetch.fetch(spark.createDataFrame([(f"{site}/page/long",)], "url string"), delay=0.0, most=3).collect()] == [3]


def test_paged_boards(spark, site):
    from tessera.sources import fetch

    how = {"url": site + "/board/{board}/{start}/{size}", "items": "data.items", "total": "n", "size": "10", "delay": "0"}
    items = fetch.boards(spark, "smartrecruiters", ["a", "b", "bad"], **how)
    rows = items.collect()
    assert sorted(json.loads(r.item)["id"] for r in rows if r.board == "a") == list(range(23)) and not [r for r in rows if r.board == "b"]
    assert [r.error for r in rows if r.board == "bad" and r.error] == ["not json"] and {r.board for r in fetch.whole_boards(items).collect()} == {"a"}
    assert fetch.boards(spark, "smartrecruiters", ["a"], **{**how, "cap": "10"}).count() == 10
    assert fetch.boards(spark, "smartrecruiters", ["a"], **{**how, "total": ""}).count() == 23
    posted = fetch.boards(spark, "workday", ["x"], url=site + "/jobs", delay="0").collect()
    assert sorted(int(r.item) for r in posted) == list(range(45))


def test_recompute_scores_only_what_changed(spark):
    kind = "profile_id string, text string, family string, families map<string,double>, seniority string, years int, education array<string>, certifications array<string>, languages array<string>, places array<string>, roles array<string>, evidence int, skills array<struct<canonical:string,strength:string,recency:int>>"
    p = spark.createDataFrame([("p1", "cv", "backend", {"backend": 1.0}, "mid", 7, [], [], [], [], [], 80, [("python", "strong", 1)])], kind)
    jobs = spark.createDataFrame([(str(i), "Backend Engineer", f"Requirements:\n- Python is a must, at company {i} as everywhere", "closed" if i == 3 else "new") for i in range(5)], "id string, title string, description string, status string")
    idf, matrix = spark.createDataFrame([("python", 2.0)], "term string, idf double"), spark.createDataFrame([("backend", "backend", 1.0)], "a string, b string, affinity double")
    empty = spark.createDataFrame([("0", "gone", 5.0, 1.0, "full", [], "k")], "job_id string, profile_id string, score double, coverage double, confidence string, matched array<string>, cache_key string")
    first = scoring.recompute(jobs, p, empty, idf, matrix, "v1").persist()
    assert {(r.job_id, r.profile_id) for r in first.collect()} == {(i, "p1") for i in "0124"} and all(r.score > 50 for r in first.collect())
    marked = first.withColumn("score", F.lit(-1.0))
    again = {r.job_id: r.score for r in scoring.recompute(jobs.withColumn("title", F.when(F.col("id") == "2", "Senior Backend Engineer").otherwise(F.col("title"))), p, marked, idf, matrix, "v1").collect()}
    assert [i for i, s in sorted(again.items()) if s != -1] == ["2"]
    assert all(r.score != -1 for r in scoring.recompute(jobs, p, marked, idf, matrix, "v2").collect())
    assert scoring.recompute(jobs, p.limit(0), marked, idf, matrix, "v2").count() == 4


def test_a_board_of_many_plans_is_not_one_tasks(spark):
    kind = F.expr("CASE id % 3 WHEN 0 THEN 'ats_api' WHEN 1 THEN 'external_board' ELSE 'html_listing' END")
    plans = spark.range(9000).select(F.col("id").alias("company_id"), kind.alias("kind"), F.expr("CASE WHEN id < 8980 THEN 'lever:hot' WHEN id < 8990 THEN 'lever:other' END").alias("board")).coalesce(1)
    fetched = spark.createDataFrame([(b, str(i), None, None) for i, b in enumerate(["lever:hot", "lever:other", "lever:nobody", None] * 5)], "board string, title string, url string, location string").coalesce(1)
    want = sorted((i, str(j), "ats_api" if i % 3 == 0 else "external_board") for i in range(8990) if i % 3 < 2 for j in range(0 if i < 8980 else 1, 20, 4))
    plain = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in plain}
    try:
        for k, v in plain.items():
            spark.conf.set(k, v)
        got = discovery.by_strategy(plans, fetched).select("company_id", "title", "source", F.spark_partition_id().alias("task")).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted((r.company_id, r.title, r.source) for r in got) == want
    tasks = [r.task for r in got]
    assert max(map(tasks.count, set(tasks))) < 0.75 * len(want)


def test_every_contact_of_a_page_is_given(spark):
    own = spark.range(1400).select((F.col("id") % 2).alias("company_id"), F.format_string("N%04d", "id").alias("name"), F.lit("x").alias("position"), F.col("id").cast("string").alias("url"))
    got = reads.contacts_of(own, spark.createDataFrame([(1,), (1,)], "company_id long")).collect()
    assert [(r.company_id, r.url, r.place) for r in sorted(got, key=lambda r: r.place)] == [(1, str(2 * i + 1), i + 1) for i in range(700)]


def test_a_word_that_the_title_cuts_is_not_the_texts(spark, tmp_path):
    import duckdb

    import __spark_entry__ as entry

    pad = lambda end: ("word " * 12)[: 60 - len(end)] + end
    texts = [pad(" of the") + "rein, this", pad(" of the") + " this", pad(" the") + "rein of the this", pad(" this") + "tle the", "of the this", pad(" und") + "er", pad(" in") + "of of the", None, "of therein this"]
    spark.createDataFrame([(i, x, "en", "s", len(x or "")) for i, x in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name, want in (("fts_and", [1, 2, 4]), ("fts_phrase_exclude", [1, 2, 4]), ("fts_title", [5])):
        got = sorted(r.id for r in entry.queries()[name](spark, str(tmp_path)).collect())
        assert got == want == sorted(x for (x,) in con.execute(entry.oracle_sql()[name]).fetchall()), name
    jobs = spark.createDataFrame([(i, "s", (x or "")[:60], x) for i, x in enumerate(texts)], "id int, company_id string, title string, description string")
    own = spark.createDataFrame([("s", "S")], "id string, display_name string")
    for f in (S.Filters(q="the this"), S.Filters(q="of.the", exclude="in"), S.Filters(q="und", scope="title"), S.Filters(q="+")):
        plain, indexed = S.Search(jobs, own, cut_titles=True), S.Search(jobs, own, index=index.build(jobs), cut_titles=True)
        assert {r.id for r in plain.rows(f).collect()} == {r.id for r in indexed.rows(f).collect()}, f


def test_a_search_folds_letters_as_its_sql_and_needs_no_source(spark, tmp_path):
    import duckdb

    import __spark_entry__ as entry

    texts = ["of the İn", "of the İ n", "of İthe", "OF THE ΣΑΣ", "of\U0001e4d0the", "of the \U0001e030in", "of the \u0870 in", "of Þe the of", "Óf the this", "of the this", "ÓF THE THIS", None, "of-the a\u0307nd", "of the"]
    rows = [(i, x, "en", None if i % 3 == 0 else "s", len(x or "")) for i, x in enumerate([*texts, *texts])]
    rows += [(9, *rows[9][1:]), (10, *rows[10][1:])]  # copies of a row
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name, n in (("fts_phrase_exclude", 18), ("fts_and", 8), ("fts_title", 0)):
        got = sorted(r.id for r in entry.queries()[name](spark, str(tmp_path)).collect())
        assert got == sorted(x for (x,) in con.execute(entry.oracle_sql()[name]).fetchall()), name
        assert len(got) == n, name


def test_index_is_built_in_runs_and_without_a_shuffle(spark, monkeypatch):
    import pyarrow as pa

    rng = random.Random(5)
    rows = [(i, rng.choices("abc", k=rng.randint(0, 2)), rng.choices("abcdefgh", k=rng.choice((0, 3, 40)))) for i in range(400)]
    monkeypatch.setattr(index, "WORDS", 1500)
    batches = [pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows[i : i + 150])], ["id", "title", "text"]) for i in range(0, 400, 150)]
    runs = [x.to_pylist() for x in index._runs(iter(batches))]
    assert len(runs) > 2 and all([(r["token"], r["id"]) for r in x] == sorted((r["token"], r["id"]) for r in x) for x in runs)
    at = lambda words, w: [k for k, x in enumerate(words) if x == w]
    want = {(w, i): (at(t, w), at(d, w)) for i, t, d in rows for w in {*t, *d}}
    assert {(r["token"], r["id"]): (r["title_at"], r["text_at"]) for x in runs for r in x} == want and sum(map(len, runs)) == len(want)
    assert list(index._runs(iter([batches[0].slice(0, 0)]))) == []
    jobs = spark.createDataFrame([(i, " ".join(t), " ".join(d)) for i, t, d in rows], "id int, title string, description string")
    built = index.build(jobs)
    assert "Exchange" not in built._jdf.queryExecution().executedPlan().toString()
    assert {(r.token, r.id): (r.title_at, r.text_at) for r in built.collect()} == want


def test_repeated_postings_are_never_broadcast(spark):
    plans = spark.range(5020).select(F.col("id").alias("company_id"), F.lit("ats_api").alias("kind"), F.expr("CASE WHEN id < 5000 THEN 'lever:hot' ELSE 'lever:other' END").alias("board"))
    none = F.lit(None).cast("string")
    fetched = spark.range(9).select(F.expr("CASE id % 3 WHEN 0 THEN 'lever:hot' WHEN 1 THEN 'lever:other' END").alias("board"), F.col("id").cast("string").alias("title"), none.alias("url"), none.alias("location"))
    found = discovery.by_strategy(plans, fetched)
    joins = re.findall(r"(\w+Join) \[board#\d+, block#\d+", found._jdf.queryExecution().sparkPlan().toString())
    assert joins == ["SortMergeJoin"]
    want = [(i, str(j)) for i in range(5020) for j in range(0 if i < 5000 else 1, 9, 3)]
    assert sorted((r.company_id, r.title) for r in found.collect()) == want
