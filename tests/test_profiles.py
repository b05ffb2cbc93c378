import pytest
from pyspark.sql import functions as F

from tessera.functions import vocabulary as V
from tessera.operators import cv, scoring, tuning

TEXT = """Dana Lev
Summary: builder, 2001 - 2002
Experience
Hailo
Senior Backend Engineer    04/2022 - present
- Designed Kafka services
  that reduced cost by 30%
- Wrote docs
Frontend Developer | Acme | Jan 2015 to 2017
• React pages
Skills: Python, Kafka
Technologies
Docker
Education
B.Sc. Computer Science 2010 - 2014
Fluent in English, based in Haifa
"""


def test_profiles(spark):
    idf = spark.createDataFrame([("kafka", 7.0), ("react", 1.0)], "term string, idf double")
    got = {r.profile_id: r for r in cv.profiles(spark.createDataFrame([("a", TEXT), ("b", ""), ("c", None)], "profile_id string, text string"), idf, 2026).collect()}
    a = got["a"]
    assert (a.family, a.seniority, a.years, a.evidence) == ("backend", "senior", 11, 50)
    assert a.families == {"backend": 1.0} and a.signature == ["kafka"]
    assert {s.canonical: (s.strength, s.recency) for s in a.skills} == {"kafka": ("strong", 0), "react": ("strong", 9), "python": ("weak", None), "docker": ("weak", None)}
    assert a.roles == ["Senior Backend Engineer Designed Kafka services that reduced cost by 30% Wrote docs", "Frontend Developer React pages"]
    assert a.education and a.languages == ["Fluent in"] or a.languages == ["Fluent in English"]
    for p in "bc":
        assert (got[p].family, got[p].seniority, got[p].years, got[p].evidence, got[p].skills, got[p].families) == (None, "mid", None, 0, [], {})


@pytest.mark.parametrize(
    ("above", "beside", "want"),
    [("Backend Engineer", "Acme", ("Backend Engineer", "Acme", True)), ("Acme", "Backend Engineer", ("Backend Engineer", "Acme", True)), ("- x", "Lead, Acme", ("Lead", "Acme", False)), ("", "", ("", None, False)), ("Lead", "", ("Lead", None, True)), ("- bullet", "Lead", ("Lead", None, False))],
)
def test_headline(above, beside, want):
    assert cv.headline(above, beside) == want


def test_overrides_and_recent_fraction(spark):
    r = spark.range(1).select(F.expr("map('backend', 1.0D, 'sales', 0.4D)").alias("a"), F.expr("map('backend', 'block', 'devops_sre', 'boost', 'nonsense', 'boost')").alias("o"), F.expr("map_from_arrays(array(), array())").cast("map<string,string>").alias("e"))
    x = r.select(cv.with_overrides(F.col("a"), F.col("o")).alias("x"), cv.with_overrides(F.col("a"), F.col("e")).alias("same")).first()
    assert x.x == {"backend": 0.0, "sales": round(0.4 / 0.65, 4), "devops_sre": 1.0} and x.same == {"backend": 1.0, "sales": 0.4}
    roles = spark.range(1).select(F.expr("array(named_struct('family', 'a', 'start', 2020, 'end', cast(null as int), 'present', true), named_struct('family', 'b', 'start', 2010, 'end', 2022, 'present', false), named_struct('family', 'b', 'start', 2010, 'end', cast(null as int), 'present', false))").alias("r"))
    assert roles.select(cv.recent_fraction(F.col("r"), F.lit("a"), 2026)).first()[0] == pytest.approx(5 / 6)


def test_penalty_of_another_family(spark):
    jobs = spark.createDataFrame([("1", "Backend Engineer", "Requirements:\n- Sales account executive work with Python\n- Python services"), ("2", "Backend Engineer", "Requirements:\n- Python services")], "id string, title string, description string")
    profile = spark.createDataFrame([("p", "backend", {"backend": 1.0}, "mid", 5, [], [], [], [], [], 0, [("python", "strong", 0)])], "profile_id string, family string, families map<string,double>, seniority string, years int, education array<string>, certifications array<string>, languages array<string>, places array<string>, roles array<string>, evidence int, skills array<struct<canonical:string,strength:string,recency:int>>")
    idf, matrix = spark.createDataFrame([("python", 2.0)], "term string, idf double"), spark.createDataFrame([("backend", "backend", 1.0), ("sales", "backend", 0.1)], "a string, b string, affinity double")
    got = {r.job_id: r.score for r in scoring.score_jobs(jobs, profile, idf, matrix).collect()}
    assert got == {"2": round(87.5), "1": round(87.5 - V.FAMILY_FIT["penalty"])}
    near = matrix.withColumn("affinity", F.lit(0.9))
    assert len({r.score for r in scoring.score_jobs(jobs, profile, idf, near).collect()}) == 1


def test_search_against_brute_force(spark):
    import random

    rng = random.Random(5)
    rows = [(i, f"p{i % 2}", rng.randint(0, 100), rng.choice([0, 40, 70, 100]), rng.randint(0, 100), rng.randint(0, 100), rng.random() < 0.3, [(rng.random(), 1.0)] if rng.random() < 0.5 else [], 0, rng.randint(0, 2), 0, rng.random(), rng.choice(["fit", "maybe", "not_fit"]), None, 99 if i == 3 else None) for i in range(40)]
    names = "id must senior nice evidence signature clashes unmet missing gap fit label min_score max_score".split()
    ex = spark.createDataFrame(rows, "id int, profile_id string, must int, senior int, nice int, evidence int, signature boolean, clashes array<struct<affinity:double,weight:double>>, unmet int, missing int, gap int, fit double, label string, min_score int, max_score int")
    table = tuning.trials(spark, 12, 3)
    assert [tuple(r) for r in table.collect()] == [tuple(r) for r in tuning.trials(spark, 12, 3).collect()]
    assert all(abs(sum(r[f"t_{k}"] for k in V.SEARCH_WEIGHTS) - 1) < 1e-9 for r in table.collect())

    def score(x, t):
        raw = sum(t[f"t_{k}"] * x[n] for k, n in (("must", "must"), ("seniority", "senior"), ("nice", "nice"), ("evidence", "evidence")))
        raw += t["t_signature_bonus"] if x["signature"] else 0
        raw -= t["t_penalty"] * sum(c[1] for c in x["clashes"] if c[0] < t["t_adjacent"])
        own = max(0, min(100, round(raw), V.GATES["missing_skills"] if x["missing"] >= V.GATES["missing_skills_from"] else 100))
        s = round(x["fit"] * own)
        return max(0, min(100, min(s, int(t["t_cap"])) if x["fit"] < t["t_gate"] else s))

    want = {}
    for t in table.collect():
        all_rows = [dict(zip(["id", "profile_id", *names[1:]], r)) for r in rows]
        scored = [(x, score(x, t)) for x in all_rows]
        p = []
        for who in ("p0", "p1"):
            top = sorted(((x, s) for x, s in scored if x["profile_id"] == who), key=lambda y: (-y[1], y[0]["id"]))
            p.append(sum(x["label"] == "fit" for x, _ in top[:10]) / 10)
        want[t.trial] = (any(x["max_score"] is not None and s > x["max_score"] for x, s in scored), round(sum(p) / 2, 9), 0.0)
    got = {r.trial: (r.rejected, round(r.precision_at_10, 9), r.precision_at_30) for r in tuning.evaluate(ex, table, (10, 30)).collect()}
    assert got == want
    best = tuning.search(ex, 12, 3, (10, 30)).first()
    assert best.evaluated + best.rejected_trials == 12
    assert best.precision_at_10 == pytest.approx(max(p for r, p, _ in want.values() if not r))
    with pytest.raises(ValueError):
        tuning.evaluate(ex, table, (10, 30), most=3)


def test_weight_search_best_is_of_500_trials(spark, tmp_path):
    from tessera.plans import catalogue

    spark.range(120).selectExpr("id AS doc_id", "concat('s', id % 2) AS source").write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(120).selectExpr("id AS doc_id", "cast(id % 3 = 0 AS int) AS quality").write.parquet(f"{tmp_path}/labels.parquet")
    (best,) = catalogue.QUERIES["weight_search_best"](spark, str(tmp_path)).collect()
    assert best.evaluated + best.rejected_trials == 500
