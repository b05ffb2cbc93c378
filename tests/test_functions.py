import pytest
from pyspark.sql import functions as F

from tessera.functions import rules, text, urls


def one(spark, expr, *values):
    names = [f"c{i}" for i in range(len(values))]
    schema = ", ".join(f"{n} {'int' if isinstance(v, int) else 'string'}" for n, v in zip(names, values))
    return spark.createDataFrame([values], schema).select(expr(*names)).first()[0]


@pytest.mark.parametrize(
    ("expr", "value", "want"),
    [
        (text.normalize_company, "Xpander AI Ltd.", "xpanderai"),
        (text.export_company, "Brandlight AI Ltd.", "brandlight"),
        (text.export_company, "AI", "ai"),
        (text.loose_company, "monday.com (Formerly DaPulse)", "monday"),
        (text.snake_id, " R&D-Labs  Inc", "rd_labs_inc"),
        (text.snake_id, "!!", "unnamed_company"),
        (text.posted_date, "1700000000000", "2023-11-14"),
        (text.posted_date, "2024-05-01T10:00:00Z", "2024-05-01"),
        (text.normalize_date, "3/7/2024", "2024-03-07"),
        (text.normalize_date, "soon", "soon"),
        (text.frequent_title, "Senior Full-Stack Eng II (Dev)", "fullstack engineer developer"),
        (text.clean_lines, "a  b\n\n c ", "a b\nc"),
        (text.strip_html, "&lt;p&gt;a&amp;nbsp;b&lt;/p&gt;<br>c", "a b\nc"),
        (text.visible_text, "<script>x</script><p>a &amp; b</p><!-- c -->", "a & b"),
        (urls.normalize_job_url, " https://x.io/jobs/1/?utm_source=a&id=5&t=9#top ", "https://x.io/jobs/1?id=5"),
        (urls.normalize_job_url, "https://x.io/jobs/1/", "https://x.io/jobs/1"),
        (urls.normalize_job_url, "", None),
        (urls.href_shape, "https://www.x.io/a/b/c", "x.io|a/b|3"),
        (urls.href_shape, "https://x.io/i.php?z=1&a=2", "x.io|?a,z"),
        (urls.board, "https://boards.greenhouse.io/Acme/jobs/1", "greenhouse:acme"),
        (urls.board, "https://acme.com", None),
        (rules.canonical_city, "Herzilya, IL", "Herzliya"),
        (rules.canonical_city, "Israel", None),
        (rules.english_location, "Remote - TLV", "Remote"),
        (rules.english_location, "אילת", "Eilat"),
        (rules.department, "R & D", "Software Engineering"),
        (rules.department, "Product Security", "Security"),
        (rules.department, "Management", None),
        (rules.department, "Drug Discovery and Validation", None),
        (rules.work_mode, "hybrid, 2 days remote", "hybrid"),
        (rules.title_verdict, "Staffing Lead", "not on the title keep-list"),
        (rules.title_verdict, "Staff Engineer", None),
        (rules.title_verdict, "Platform Analyst", "analyst without engineer"),
    ],
)
def test_strings(spark, expr, value, want):
    assert one(spark, expr, value) == want


def test_two_argument_rules(spark):
    assert one(spark, rules.non_job_reason, "About us", "https://x.io/about") == "nav label"
    assert one(spark, rules.non_job_reason, "Great thing", "https://x.io/blog") == "path segment blog"
    assert one(spark, rules.non_job_reason, "Great thing", "https://x.io/jobs/1") is None
    assert one(spark, rules.non_job_reason, "Great thing", "https://x.io/p") == "no role word, no job-shaped url"
    assert one(spark, rules.seniority, "Engineer", 6) == "senior" and one(spark, rules.seniority, "Head of Data", 1) == "head"
    gone = lambda u, landed, page: rules.posting_gone(u, landed, F.lit(200), page)
    assert one(spark, gone, "https://x/jobs/a/1", "https://x/jobs/a", "ok") == "redirected to https://x/jobs/a"
    assert one(spark, gone, "https://x/jobs/1", "https://x/jobs/1/slug", "ok") is None
    assert one(spark, gone, "https://x/jobs/1", "https://x/jobs", "Just a moment...") is None
    assert one(spark, rules.fetch_outcome, 403, "x") == "blocked" and one(spark, rules.fetch_outcome, 200, " ") == "empty"


def test_null_inputs_do_not_fail(spark):
    null = F.lit(None).cast("string")
    row = spark.range(1).select(text.normalize_company(null), urls.normalize_job_url(null), urls.job_id(null, F.lit("c"), F.lit("t"), null), rules.department(null), rules.relevant_location(null), rules.is_remote(null), text.contains_hebrew(null), rules.non_job_reason(null, null)).first()
    assert row[1] is None and len(row[2]) == 20 and row[4] is True and row[5] is False
