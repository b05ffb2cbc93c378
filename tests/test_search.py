import pytest
from pyspark.sql import functions as F

from tessera.plans import search as S

JOBS = "id string, company_id string, title string, description string, city string, department string, source_language string, status string, is_remote boolean, is_referral boolean, years_required int, posted_at string, first_seen string"


@pytest.fixture(scope="module")
def engine(spark):
    rows = [
        ("j1", "acme", "Senior Backend Engineer", "Requirements: Python and Kubernetes", "Tel Aviv", "Software Engineering", "en", "new", False, False, 5, "2026-09-28", "2026-09-28"),
        ("j2", "acme", "Data Scientist", "Requirements: pandas", "Haifa", "Data & AI", "he", "new", False, False, None, None, "2026-01-01"),
        ("j3", "beta", "Platform Engineer", "Requirements: Kubernetes, node.js and Café", "Tel Aviv", None, "en", "seen", True, True, 2, "2026-09-29", "2026-09-29"),
        ("j4", "beta", "C Developer", "", "Haifa", None, "en", "closed", False, False, 1, "2026-09-01", "2026-09-01"),
    ]
    companies = spark.createDataFrame([("acme", "Acme", "Software", 1), ("beta", "beta", "Security", 0), ("none", "None", None, 0)], "id string, display_name string, industry string, connection_count int")
    scores = spark.createDataFrame([("j1", "p", 90.0), ("j1", "q", 10.0), ("j2", "p", 40.0), ("j3", "p", 70.0)], "job_id string, profile_id string, score double")
    state = spark.createDataFrame([("j2", True, False, False, False, "x")], "job_id string, liked boolean, hidden boolean, sent boolean, reached_out boolean, updated_at string")
    return S.Search(spark.createDataFrame(rows, JOBS), companies, state, scores)


def ids(engine, sort="score", number=1, size=50, **f):
    return [r.id for r in engine.search(S.Filters(**f), sort, number, size)[0].collect()]


def test_order_and_pages(engine):
    assert ids(engine) == ["j1", "j3", "j2", "j4"]
    assert ids(engine, number=2, size=2) == ["j2", "j4"] and ids(engine, number=0, size=0) == ["j1"]
    assert ids(engine, "date") == ["j3", "j1", "j4", "j2"] and ids(engine, "company") == ["j1", "j2", "j3", "j4"] and ids(engine, "nonsense") == ids(engine)
    assert engine.search(S.Filters(status="open"), size=1)[1].first().total == 3


def test_words(engine):
    assert ids(engine, q="kubernetes") == ["j1", "j3"] and ids(engine, q="kubernetes", scope="title") == []
    assert ids(engine, q="node.js") == ["j3"] and ids(engine, q="js.node") == [] and ids(engine, q="cafe") == ["j3"]
    assert ids(engine, q="C++") == ["j4"] and ids(engine, q="engineer") == ["j1", "j3"]
    for odd in ("+", "-", "*", '"', "קורות"):
        assert ids(engine, q=odd) == []
    assert ids(engine, exclude="engineer scientist") == ["j4"] and len(ids(engine, exclude="requirements")) == 4 and len(ids(engine, exclude="+")) == 4


@pytest.mark.parametrize(
    ("f", "want"),
    [
        ({"city": "Tel Aviv", "min_score": 80}, {"j1"}),
        ({"min_score": 0}, {"j1", "j2", "j3"}),
        ({"max_years": 3}, {"j2", "j3", "j4"}),
        ({"posted_after": "2026-09-01"}, {"j1", "j3", "j4"}),
        ({"liked": True}, {"j2"}),
        ({"liked": False}, {"j1", "j3", "j4"}),
        ({"status": "new,seen"}, {"j1", "j2", "j3"}),
        ({"status": "open", "exclude_company_id": "acme"}, {"j3"}),
        ({"has_description": False}, {"j4"}),
        ({"has_connection": True}, {"j1", "j2"}),
        ({"is_remote": True, "is_referral": True}, {"j3"}),
        ({"industry": "Software, Security", "language": "he"}, {"j2"}),
        ({"profile": "q", "min_score": 5}, {"j1"}),
    ],
)
def test_filters(engine, f, want):
    assert set(ids(engine, **f)) == want


def test_facets_leave_out_their_own_filter(engine):
    got = {r.value: r.n for r in engine.facet(S.Filters(city="Haifa", status="open"), "city").collect()}
    assert got == {"Tel Aviv": 2, "Haifa": 1}
    assert {r.value for r in engine.facet(S.Filters(city="Haifa", status="open"), "company").collect()} == {"acme"}
    assert {r.dimension: r.total for r in engine.facet_totals(S.Filters()).collect()} == {"company": 2, "city": 2, "department": 2, "industry": 2, "language": 2}
    assert {r.value: r.n for r in engine.years(S.Filters()).collect()} == {5: 1, 2: 1, 1: 1}


def test_company_stats_job_distribution(engine):
    assert {r.id: (r.total_jobs, r.open_jobs) for r in engine.company_stats().collect()} == {"acme": (2, 2), "beta": (2, 1), "none": (0, 0)}
    assert engine.job("j1").first().scores == {"p": 90.0, "q": 10.0} and engine.job("zz").count() == 0
    assert {(r.profile_id, r.bucket): r.n for r in engine.distribution().collect()} == {("p", 90): 1, ("q", 10): 1, ("p", 40): 1, ("p", 70): 1}
    assert [r.id for r in engine.top(S.Filters(), 2).collect()] == ["j1", "j3"]
    assert "description" not in engine.search(S.Filters())[0].columns


def test_url_codec():
    f = S.Filters(q="a b", liked=False, max_years=3, status="open")
    assert S.Filters.decode(f.encode()) == f and S.Filters().encode() == ""
    assert S.Filters.decode("max_years=x&liked=maybe&zzz=1&q=k") == S.Filters(q="k")


def test_plans_prune_columns(spark, engine):
    plan = engine.rows(S.Filters(status="open")).agg(F.count("*"))._jdf.queryExecution().optimizedPlan().toString()
    assert "snippet" not in plan
