import json
import os
import random

import pytest
from pyspark.sql import functions as F

from tessera import schemas
from tessera.operators import export, jobs, listing, scoring, taxonomy
from tessera.sources import boards, files
from tessera.streaming import runs

STORED = "company_id string, id string, title string, url string, description string, location string, status string, first_seen string, last_seen string, posted_at string, closed_at string, closed_reason string"


def stored(spark, *rows):
    return spark.createDataFrame([("c", i, t, f"https://x/jobs/{i}", d, "Haifa", s, "d0", "d0", None, None, None) for i, t, d, s in rows], STORED)


def scraped(spark, *rows):
    return spark.createDataFrame([("c", *r) for r in rows], "company_id string, id string, title string, description string, posted_at string")


def run(spark, may_close=True):
    return spark.createDataFrame([("c", "d1", may_close)], "company_id string, now string, may_close boolean")


def test_diff(spark):
    old = stored(spark, ("1", "Engineer Full-time Haifa", "", "new"), ("2", "Analyst", "x", "seen"), ("3", "Lead", "x", "closed"))
    new = scraped(spark, ("1", "Engineer", "text", None), ("3", "Lead", None, None), ("4", "Writer", None, "2020-01-01"), ("4", "Writer", None, "2020-01-01"))
    got = {r.id: r for r in jobs.diff(old, new, run(spark)).collect()}
    assert {k: v.change for k, v in got.items()} == {"1": "seen", "2": "closed", "3": "reopened", "4": "new"}
    assert (got["1"].title, got["1"].description, got["1"].last_seen, got["1"].status) == ("Engineer", "text", "d1", "seen")
    assert (got["2"].closed_at, got["2"].closed_reason) == ("d1", "not on the listing") and got["3"].closed_at is None
    assert (got["4"].status, got["4"].first_seen) == ("new", "2020-01-01") and got["4"].description == ""
    assert {r.change for r in jobs.diff(old, new.limit(0), run(spark, False)).collect()} == {"kept"}
    again = jobs.diff(jobs.diff(old, new, run(spark)).drop("change"), new, run(spark))
    assert {r.id: r.status for r in again.collect()} == {"1": "seen", "2": "closed", "3": "seen", "4": "seen"}


def test_duplicates_reopen_delete_purge(spark):
    rows = stored(spark, ("1", "A", "", "closed"), ("2", "A", "", "new")).withColumn("url", F.lit("https://x/jobs/9?t=1"))
    assert [r.open_sibling_id for r in jobs.duplicate_closed(rows).collect()] == ["2"]
    live = spark.createDataFrame([("https://x/jobs/9/#a",)], "url string")
    assert {r.status for r in jobs.reopen_by_url(rows, live, "now").collect()} == {"seen", "new"}
    closed = spark.createDataFrame([("https://x/jobs/9", "gone")], "url string, reason string")
    assert {r.closed_reason for r in jobs.close_by_url(rows, closed, "now").collect()} == {None, "gone"}
    state = spark.createDataFrame([("1", True, False, False, False, "x")], schemas.JOB_STATE)
    assert [r.id for r in jobs.purge(rows.select("id"), state).collect()] == ["2"]
    with pytest.raises(ValueError):
        jobs.set_state(state, rows, "1", "now", loved=True)
    with pytest.raises(KeyError):
        jobs.set_state(state, rows, "9", "now", liked=True)
    got = {r.job_id: (r.liked, r.hidden) for r in jobs.set_state(state, rows, "1", "now", hidden=True).collect()}
    assert got == {"1": (True, True)}
    scores = spark.createDataFrame([("1", "p", 1.0)], "job_id string, profile_id string, score double")
    assert jobs.prune_scores(scores, []).count() == 1 and jobs.prune_scores(scores, ["q"]).count() == 0
    assert [x.count() for x in jobs.delete(rows, scores, state, rows.where("id = '1'"))] == [1, 0, 0]


def test_referrals_first_alias_and_title_ratio(spark):
    companies = spark.createDataFrame([("acme", "Acme Ltd"), ("beta", "Beta")], "id string, display_name string")
    old = stored(spark, ("1", "Senior Backend Engineer", "", "new")).withColumn("company_id", F.lit("beta"))
    refs = spark.createDataFrame([("Unknown", ["Beta Inc", "Acme"], "Backend Engineer, Senior", None, "Dana"), ("Acme", None, "Writer", None, None), ("Nobody", [], "X", None, None)], "company string, also_posted_as array<string>, title string, url string, contact string")
    got = {r.title: (r.company_id, r.job_id) for r in jobs.merge_referrals(old, companies, refs, "now", 0.5).collect()}
    assert got == {"Backend Engineer, Senior": ("beta", "1"), "Writer": ("acme", None)}


def test_idf_and_cosine(spark):
    docs = spark.createDataFrame([(1, ["a", "b"], "x"), (2, ["a"], "y")], "doc int, terms array<string>, family string")
    terms = spark.createDataFrame([("a",), ("b",), ("z",)], "term string")
    got = {r.term: r.idf for r in taxonomy.idf(docs, terms).collect()}
    assert got["a"] == 0 and abs(got["b"] - 0.6931471805599453) < 1e-12 and got["z"] == got["b"]
    assert {r.idf for r in taxonomy.idf(docs.limit(0), terms).collect()} == {0.0}
    matrix = taxonomy.cosine(taxonomy.presence(docs, taxonomy.idf(docs, terms)), 0.1)
    assert {(r.a, r.b): r.affinity for r in matrix.collect()} == {("x", "x"): 1.0, ("x", "y"): 0.1, ("y", "x"): 0.1, ("y", "y"): 1.0}
    over = spark.createDataFrame([("x", "y", 0.7)], "a string, b string, value double")
    assert {r.affinity for r in taxonomy.with_overrides(matrix, over).where("a != b").collect()} == {0.7}


def test_families(spark):
    got = spark.createDataFrame([("Product Manager - AI Infrastructure",), ("Engineer",), (None,), ("DevOps / SRE",)], "t string").select(taxonomy.family_of("t").alias("f")).collect()
    assert [r.f for r in got] == ["product", None, None, "devops_sre"]
    assert [scoring.Families().of(t) for t in ("Product Manager - AI Infrastructure", "Engineer", "DevOps / SRE")] == ["product", None, "devops_sre"]


def test_sections_and_segments():
    text = "Intro here. Responsibilities: Design things. Requirements 5+ years of experience with Python Strong Kubernetes skills. Familiarity with Kafka is a plus. Nice to have: AWS"
    got = scoring.sections(text)
    assert [b for b, _ in got] == ["other", "responsibility", "must", "must", "must", "must", "nice"]
    assert scoring.segments("work with Python\n• Lead teams; used it Daily basis") == ["work with Python", "Lead teams; used it", "Daily basis"]
    assert [r[0] for b, s in got if b == "must" for r in scoring.requirements_of(b, s, scoring.Skills())] == ["must", "must", "must", "nice"]
    assert scoring.sections("the job requirements before applying") == [("other", "the job requirements before applying")]


def test_scores(spark):
    rows = spark.createDataFrame([("j1", "Senior Backend Engineer", "Requirements: Python experience is a must. Kubernetes required. Kafka required."), ("j2", "Data Scientist", "")], "id string, title string, description string")
    person = "profile_id string, family string, families map<string,double>, seniority string, years int, education array<string>, certifications array<string>, languages array<string>, places array<string>, roles array<string>, evidence int, skills array<struct<canonical:string,strength:string,recency:int>>"
    make = lambda *skills: spark.createDataFrame([("p", "backend", {"backend": 1.0}, "senior", 7, [], [], [], [], [], 80, list(skills))], person)
    idf = spark.createDataFrame([("python", 2.0), ("kubernetes", 5.0)], "term string, idf double")
    matrix = spark.createDataFrame([("backend", "backend", 1.0), ("backend", "data_science", 0.2)], "a string, b string, affinity double")
    score = lambda *skills: {r.job_id: r for r in scoring.score_jobs(rows, make(*skills), idf, matrix).collect()}
    few, more = score(("python", "strong", 1)), score(("python", "strong", 1), ("kubernetes", "strong", 5))
    assert few["j1"].gates == ["missing_skills"] and few["j1"].score <= 55
    assert more["j1"].score > few["j1"].score and more["j1"].matched == ["kubernetes", "python"] and more["j1"].gates == []
    assert more["j1"].coverage == round(100 * (2 + 0.7 * 5) / 8)
    assert more["j2"].score <= 35 and "family_fit_low" in more["j2"].gates and more["j2"].confidence == "title_only"


def test_bands_and_precision(spark):
    got = spark.createDataFrame([(s,) for s in (100, 85, 84, 70, 50, 30, 29, 0)], "s int").select(scoring.band("s").alias("b")).collect()
    assert [r.b for r in got] == ["strong match", "strong match", "good match", "good match", "partial match", "weak match", "not a fit", "not a fit"]
    rows = spark.createDataFrame([("p", 9, 1, 1), ("p", 8, 0, 2), ("p", 7, 1, 3), ("q", 1, 1, 4)], "profile_id string, score int, fit int, id int")
    assert scoring.precision_at(rows, 2).first()[0] == 0.5


PAGE = """<nav><a href="/about-our-team">About our team</a></nav><div><ul><li><a href="/careers/eng/1-backend"><h3>Backend Engineer</h3><p>Haifa</p></a></li><li><a href="/careers/eng/2-data">Data Engineer role</a></li><li><a href="/careers/eng/3-ops">DevOps Engineer</a></li>
<li><a href="/careers/eng/1-backend#x">Backend again</a></li></ul><a href="/careers/all-engineering">All engineering teams</a><a href="/blog/post-one">Read this blog post</a><a href="mailto:x@y.z">Mail us now</a></div>"""


def test_listing_chain(spark):
    pages = spark.createDataFrame([(1, "https://x.io/careers", PAGE), (2, "https://x.io/careers", None)], "page_id int, url string, html string")
    links = listing.candidates(pages)
    judged = {r.href: (r.title, r.verdict) for r in listing.chain(links).collect()}
    assert len(judged) == 6
    assert judged["https://x.io/careers/eng/1-backend"][0] == "Backend Engineer"
    assert {h for h, (_, v) in judged.items() if v.accept} == {f"https://x.io/careers/eng/{x}" for x in ("1-backend", "2-data", "3-ops")}
    why = {h.rsplit("/", 1)[1]: v.filter for h, (_, v) in judged.items() if not v.accept}
    assert why == {"about-our-team": "url_shape", "all-engineering": "category_prefix", "post-one": "cta_label"}
    assert listing.postings(listing.chain(links), 2).count() == 2
    shape = listing.chain(links, shape="x.io|careers/eng|3", least=9)
    assert shape.where("verdict.accept").count() == 3


def test_json_ld():
    assert [p["title"] for p in listing.job_postings(json.dumps({"@graph": [{"@type": "JobPosting", "title": "A"}, {"@type": ["Thing", "JobPosting"], "title": "B"}]}))] == ["A", "B"]
    assert listing.job_postings("{") == []


def test_export(spark):
    rows = [("Brandlight", "Backend Engineer", "https://linkedin.com/x", "Haifa", "Haifa", "ok"), ("Brandlight AI Ltd.", "backend  engineer", "https://boards.greenhouse.io/b/jobs/1?utm_source=z", "Haifa", None, "empty"), ("X", "Sales Manager", "u", None, None, "ok"), ("Y", "Platform Engineer", "u", None, "Berlin", "ok"), ("SQLink", "DevOps", "u2", None, "", "ok")]
    found = spark.createDataFrame([(c, t, u, y, p, None, f, "2026-01-01T00") for c, t, u, y, p, f in rows], "display_name string, title string, url string, city string, location string, work_mode string, fetch_status string, posted_at string")
    out, report = export.export(found)
    assert [(r.company, r.url, r.is_agency) for r in out.collect()] == [("Brandlight AI Ltd.", "https://boards.greenhouse.io/b/jobs/1", False), ("SQLink", "u2", True)]
    r = report.first()
    assert (r.found, r.kept, r.dropped_by_title, r.dropped_by_location, r.deduped, r.not_ok_fetch) == (5, 2, 1, 1, 1, 1)


@pytest.mark.parametrize("least", [0.5, 0.8])
def test_similar_classes_hold_the_pairs_of_brute_force(spark, least):
    import random

    rng = random.Random(3)
    texts = [("cd"[i % 2], i, " ".join(rng.choices("abcdefghijkl", k=rng.randint(3, 14)))) for i in range(80)]
    texts += [("c", 100 + i, texts[4][2]) for i in range(30)]  # copies
    texts += [("d", 200 + i, "z " * 40 + f"end{i}") for i in range(4)] + [("c", 300, ""), ("c", 301, ""), ("c", 302, None), (None, 303, "a b")]
    got = export.similar_classes(spark.createDataFrame(texts, "company_id string, id long, text string"), least, 30, at_once=50).collect()
    assert sum(r.kind == "words" for r in got if r.company_id == "c" and r.b >= 100) == 30  # a row a copy, not a pair for each two
    words = {x: set((x or "").split()) for _, _, x in texts}
    first = {k: {(r.company_id, r.b): r.a for r in got if r.kind == k} for k in ("words", "head")}
    like = {(r.company_id, r.a, r.b) for r in got if r.kind == "like"}
    for i, (c, a, x) in enumerate(texts):
        for d, b, y in texts[i + 1 :]:
            if c == d:
                w = sorted(first["words"].get((c, n), n) for n in (a, b))
                found = first["head"].get((c, a), a) == first["head"].get((c, b), b) or w[0] == w[1] or (c, *w) in like
                both = words[x] | words[y]
                assert found == (c is not None and ((x is not None and y is not None and x[:30] == y[:30]) or bool(both) and len(words[x] & words[y]) / len(both) >= least)), (x, y)


def test_jaccard_documents_finds_a_near_copy(spark, tmp_path):
    from tessera.plans import catalogue

    long = [f"word{i}" for i in range(200)]
    rows = [(1, " ".join(long), "s"), (2, " ".join(["new", *long[1:]]), "s"), (3, " ".join(long), "s"), (4, " ".join(["other", *long[1:]]), "r")]
    spark.createDataFrame([(i, x, "en", c, len(x)) for i, x, c in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in catalogue.QUERIES["jaccard_documents"](spark, str(tmp_path)).collect()}
    assert got == {("s", "words", 1, 3), ("s", "head", 1, 3), ("s", "like", 1, 2)}


def test_bm25(spark):
    p = spark.createDataFrame([(1, "python spark data"), (2, "java"), (3, "python python")], "passage_id int, text string")
    q = spark.createDataFrame([(1, "python")], "query_id int, text string")
    assert [r.passage_id for r in export.bm25(p, q).orderBy("rank").collect()] == [3, 1]
    assert export.chunks(spark.createDataFrame([(1, "x" * 2000)], "id int, text string")).count() == 3


def test_bm25_chunks_against_brute_force(spark):
    import math
    import random
    import re

    rng = random.Random(5)
    words = ["".join(rng.choices("abcdé9", k=3)) for _ in range(60)]
    texts = [(i, " ".join(rng.choices(words, k=rng.randint(0, 200)))) for i in range(40)] + [(40, None), (41, "")]
    texts += [(50 + i, texts[3][1]) for i in range(6)]  # copies: equal scores
    asked = [(i, " ".join(rng.choices(words, k=30))) for i in range(25)] + [(25, "zzzzz"), (26, None)]
    got = export.bm25_chunks(spark.createDataFrame(texts, "id long, text string").repartition(3), spark.createDataFrame(asked, "query_id long, text string"), 4, 90).collect()
    cut = {(i, j): re.findall(r"[^\W_]+", x[90 * j : 90 * j + 90].replace("é", "e")) for i, x in ((i, x or "") for i, x in texts) for j in range(max(1, -(-len(x) // 90)))}
    mean = sum(map(len, cut.values())) / len(cut)
    want = set()
    for q, x in asked:
        score = {}
        for w in set((x or "").replace("é", "e").split()):
            df = sum(w in c for c in cut.values())
            for at, c in cut.items():
                if w in c:
                    tf = c.count(w)
                    score[at] = score.get(at, 0) + math.log(1 + (len(cut) - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(c) / mean))
        want |= {(q, *at, round(s, 5), k + 1) for k, (at, s) in enumerate(sorted(((at, round(s, 6)) for at, s in score.items()), key=lambda y: (-y[1], y[0]))[:4])}
    assert {(r.query_id, r.id, r.chunk, round(r.score, 5), r["rank"]) for r in got} == want


def test_bm25_passages_asks_every_item_of_all_documents(spark, tmp_path):
    from tessera.plans import catalogue

    asked = [(i, " ".join(["common"] * 14) + f" tail{i}") for i in range(30)]
    spark.createDataFrame(asked, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, "x " * 900 + f"tail{i}") for i in range(30)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.query_id, r.id, r.chunk) for r in catalogue.QUERIES["bm25_passages"](spark, str(tmp_path)).collect()}
    assert got == {(i, i, 2) for i in range(30)}  # by the last word of the item, in the last chunk of its document


def test_embedding_cosine_search_against_brute_force(spark, tmp_path):
    import random

    import numpy as np

    from tessera.plans import catalogue

    rng = random.Random(6)
    rows = [(i, [float(rng.randint(-3, 3)) for _ in range(4)]) for i in range(130)]  # small whole numbers: many equal scores
    rows[47] = (47, [0.0] * 4)
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(r.query_id, r.vec_id, r.score) for r in catalogue.QUERIES["embedding_cosine_search"](spark, str(tmp_path)).collect()}
    v = np.array([x for _, x in rows])
    want = set()
    for q in range(0, 130, 20):
        with np.errstate(invalid="ignore"):
            s = np.round(v @ v[q] / np.sqrt((v * v).sum(1) * (v[q] * v[q]).sum()), 6)
        best = sorted((i for i in range(130) if i != q), key=lambda i: (np.inf if np.isnan(s[i]) else -s[i], i))[:5]
        want |= {(q, i, float(s[i])) for i in best}
    assert got == want and len({q for q, _, _ in got}) == 7


def test_boards(spark):
    payload = {"jobs": [{"title": " A  B ", "absolute_url": "u", "location": {"name": ""}, "offices": [{"name": "TLV"}], "content": "&lt;p&gt;x&lt;/p&gt;", "updated_at": "2026-01-02T00"}, {"title": ""}]}
    rows = spark.createDataFrame([("c", "b", None, json.dumps(payload)), ("c", "b", None, "{broken"), ("c", "b", None, None)], "company_id string, board string, board_url string, payload string")
    got = boards.postings(rows, "greenhouse").collect()
    assert [(r.title, r.location, r.description, r.posted_at) for r in got] == [("A B", "TLV", "x", "2026-01-02")]
    lever = rows.limit(1).withColumn("payload", F.lit(json.dumps([{"text": "T", "categories": {"team": "R"}, "createdAt": 1700000000000}])))
    assert [(r.title, r.department, r.posted_at) for r in boards.postings(lever, "lever").collect()] == [("T", "R", "2023-11-14")]
    for name in boards.PROVIDERS:
        assert boards.postings(rows.where("payload is null"), name).count() == 0


def test_files(spark, tmp_path):
    (tmp_path / "cyber.csv").write_text("company,category,size,title,level,city,url,updated\n Acme ,x,, Dev ,,,http://a?b=1,\n,x,,Dev,,,,\n")
    assert [(r.company, r.title, r.url, r.category) for r in files.techmap(spark, str(tmp_path / "cyber.csv")).collect()] == [("Acme", "Dev", "http://a", "cyber")]
    (tmp_path / "c.csv").write_text("Notes:\nsome text\n\nFirst Name,Last Name,URL,Company,Position\nDana,Lev,u1,Acme Ltd,Dev\nDANA,LEV,U1,Acme,CTO\nNoa,Bar,u2,,x\n")
    assert [(r.name, r.company_key, r.position) for r in files.connections(spark, str(tmp_path / "c.csv")).collect()] == [("Dana Lev", "acme", "Dev")]
    (tmp_path / "r.json").write_text(json.dumps({"companies": [{"company": "A", "also_posted_as": ["B"], "jobs": [{"title": "T", "link": "u", "locations": ["X", "Y"], "requirements": ["r1"], "exp_years_min": 3, "contact": "Z"}]}]}))
    r = files.referrals(spark, str(tmp_path / "r.json")).first()
    assert (r.company, r.location, r.description) == ("A", "X, Y", "At least 3 years of experience.\nr1")
    d = tmp_path / "plans"
    d.mkdir()
    (d / "a.json").write_text(json.dumps({"company_id": "a", "schema_version": 0, "status": "verified"}))
    (d / "b.json").write_text("{nope")
    assert [(r.company_id, r.status) for r in files.plans(spark, str(d)).collect()] == [("a", "stale")]


def test_stream_equals_batch(spark, tmp_path):
    e = spark.createDataFrame([(i, f"2024-01-0{1 + i % 3} 0{i % 9}:00:00", i % 2, "view" if i % 4 else "buy") for i in range(40)], "event_id int, ts string, user_id int, event_type string").withColumn("ts", F.col("ts").cast("timestamp"))
    e.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    q = runs.posting_counts(stream).writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    key = lambda r: (r.day, r.event_type, r.n)
    assert sorted(map(key, spark.sql("select * from counts").collect())) == sorted(map(key, runs.posting_counts(e).collect()))
    assert runs.visits(e).agg(F.sum("n")).first()[0] == 40


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.001"), reason="no test tables")
def test_catalogue_against_sql(spark):
    import duckdb

    import __spark_entry__ as entry

    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '/root/testdata/sf0.001/{name}.parquet'")
    for name in ("search_page", "facet_city", "score_distribution", "fts_and", "scrape_diff", "url_identity", "family_classify", "weighted_coverage"):
        got = entry.queries()[name](spark, "/root/testdata/sf0.001").toPandas()
        want = con.execute(entry.oracle_sql()[name]).df()[list(got.columns)]
        rows = lambda d: sorted(map(str, d.astype(object).where(d.notna(), None).itertuples(index=False, name=None)))
        assert rows(got) == rows(want), name
    assert entry.entry(spark).count() > 0


def test_halves_of_coverage_round_as_in_the_tables_order(spark, tmp_path):
    """Orders whose share is half a point, their lines dealt over files that Spark reads in another order."""
    import duckdb
    import pyarrow as pa
    import pyarrow.parquet as pq

    from tessera.plans import registry

    rng, parts, n = random.Random(1), [[], [], [], []], 0
    while n < 1000:
        lines = [(rng.choice("RAN"), rng.randint(1, 50)) for _ in range(10)]
        q = sum(x for _, x in lines)
        if 2 * (10 * sum({"R": 10, "A": 7, "N": 3}[f] * x for f, x in lines) % q) == q:
            for f, x in lines:
                rng.choices(parts, (1, 2, 3, 4))[0].append((n, float(x), f, "F"))
            n += 1
    (tmp_path / "lineitem.parquet").mkdir()
    for i, rows in enumerate(parts):
        pq.write_table(pa.table(dict(zip(("l_orderkey", "l_quantity", "l_returnflag", "l_linestatus"), zip(*rows)))), tmp_path / f"lineitem.parquet/part-{i}.parquet")
    con = duckdb.connect(config={"threads": 1})
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = sorted(con.execute(registry.ORACLE_SQL["weighted_coverage"]).fetchall())
    got = registry.QUERIES["weighted_coverage"](spark, str(tmp_path)).collect()
    assert sorted((r.id, r.coverage, r.unmet) for r in got) == want


def test_coverage_without_weights(spark):
    rows = spark.createDataFrame([("a", None, 1.0, 0), ("b", 0.0, 1.0, 1), ("c", 2.0, None, 2), ("c", 2.0, 1.0, 3), ("c", None, 1.0, 4)], "id string, weight double, strength double, place int")
    got = rows.groupBy("id").agg(scoring.coverage(F.col("weight"), F.col("strength"), F.col("place")).alias("x")).collect()
    assert {r.id: r.x for r in got} == {"a": 100, "b": 0, "c": 50}
