"""Queries over pages: listing links and their verdicts, plans, the discovery cascade, boards, feeds and page texts.

Imported for what it registers; see ``catalogue`` for what the driver's tables stand for. Listing pages are the driver's
pages with cards put in front of their article, as its pages link to nothing but their menu."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import rules, text, titles, urls
from tessera.functions import vocabulary as V
from tessera.operators import companies as C
from tessera.operators import discovery, export, listing, scoring, tuning
from tessera.operators.kept import dealt
from tessera.plans.catalogue import companies, described, query, t
from tessera.sources import feeds, inlined

def null():
    return F.lit(None).cast("string")


def q(pattern: str) -> str:
    """A pattern as the inside of an SQL string."""
    return pattern.replace("'", "''")


# ---------------------------------------------------------------- listing pages


def listing_pages(spark, sf):
    """(page_id, url, html): each page at an address of its own company, with cards of postings and of other links."""
    n = F.col("page_id").cast("string")
    item = lambda href, inside: F.concat(F.lit('<li><a href="'), href, F.lit('">'), F.lit(inside), F.lit("</a></li>"))
    cards = F.concat(
        F.lit("<main><ul>"),
        item(F.concat(F.lit("/careers/jobs/1000"), n), "<h3>Senior Backend Engineer</h3> <span>Haifa</span>"),
        item(F.concat(F.lit("/careers/jobs/2000"), n), "Data Scientist, Tel Aviv"),
        item(F.lit("/careers/jobs"), "See all open roles"),
        item(F.lit("/blog/our-story-today"), "How we work here"),
        F.when(F.col("page_id") % 2 == 1, item(F.lit("https://other.example.org/x"), "Partner portal site")).otherwise(""),
        F.lit("</ul><div><h2>Platform Engineer</h2><a href='/careers/jobs/3000"), n, F.lit("?ref=1'>Apply</a></div></main><article>"),
    )
    return dealt(t(spark, sf, "pages")).select("page_id", F.concat(F.lit("https://www.acme"), n, F.lit(".io/careers")).alias("url"), F.replace("html", F.lit("<article>"), cards).alias("html"))


ANCHORS = r"""WITH nav AS (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)">', 1) AS l, regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1) AS x FROM pages),
cards AS (SELECT page_id, len(l) AS n, [{'href': '/careers/jobs/1000' || page_id, 'text': 'Senior Backend Engineer Haifa', 'heading': 'Senior Backend Engineer', 'g': 1}, {'href': '/careers/jobs/2000' || page_id, 'text': 'Data Scientist, Tel Aviv', 'heading': '', 'g': 1}, {'href': '/careers/jobs', 'text': 'See all open roles', 'heading': '', 'g': 1}, {'href': '/blog/our-story-today', 'text': 'How we work here', 'heading': '', 'g': 1}]
  || CASE WHEN page_id % 2 = 1 THEN [{'href': 'https://other.example.org/x', 'text': 'Partner portal site', 'heading': '', 'g': 1}] ELSE [] END || [{'href': '/careers/jobs/3000' || page_id || '?ref=1', 'text': 'Apply', 'heading': 'Platform Engineer', 'g': 2}] AS c FROM nav),
raw AS (SELECT page_id, i - 1 AS index, l[i] AS href, trim(x[i]) AS text, '' AS heading, 0 AS g, true AS in_chrome FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM nav)
  UNION ALL SELECT page_id, n + i - 1, c[i].href, c[i].text, c[i].heading, c[i].g, false FROM (SELECT *, unnest(range(1, len(c) + 1)) AS i FROM cards)),
whole AS (SELECT *, CASE WHEN href LIKE 'https:%' THEN href ELSE 'https://www.acme' || page_id || '.io' || href END AS u FROM raw),
one AS (SELECT * FROM whole QUALIFY row_number() OVER (PARTITION BY page_id, u ORDER BY index) = 1),
cut AS (SELECT *, regexp_replace(regexp_extract(u, '^https://([^/]*)', 1), '^www\.', '') AS host, list_filter(string_split(regexp_extract(u, '^https://[^/]*([^?]*)', 1), '/'), lambda s: s <> '') AS s, regexp_extract(u, '^https://[^/]*([^?]*)', 1) AS path FROM one),
shaped AS (SELECT *, host || '|' || array_to_string(s[1:len(s) - 1], '/') || '|' || len(s) AS href_shape, CASE WHEN heading <> '' THEN heading ELSE text END AS title FROM cut),
a AS (SELECT page_id, index, text, title, u AS href, in_chrome, href_shape, greatest(count(*) OVER (PARTITION BY page_id, g, href_shape), 1) AS siblings, count(*) OVER (PARTITION BY page_id, href_shape) AS shape_count, count(*) OVER (PARTITION BY page_id) AS batch,
  host = 'acme' || page_id || '.io' AS same_host, starts_with(path, '/careers/') AS under_career_path, regexp_matches(path, '(?i)(job|career|position|opening|vacan|opportunit|\d{3,})') AS has_job_url_hint,
  CASE WHEN title = 'Senior Backend Engineer' THEN 'backend' WHEN title LIKE 'Data Scientist%' THEN 'data_science' WHEN title = 'Platform Engineer' THEN 'infrastructure_platform' END AS role_family, s FROM shaped)
"""
_SHOWN = "page_id, index, text, title, href, in_chrome, href_shape, siblings, shape_count, batch, same_host, under_career_path, has_job_url_hint, role_family"

VERDICTS = (
    ANCHORS
    + rf""", above AS (SELECT DISTINCT page_id, array_to_string(s[1:k], '/') AS at FROM (SELECT page_id, s, unnest(range(1, len(s) - 1)) AS k FROM a WHERE len(s) > 2)),
j AS (SELECT a.*, len(a.s) > 1 AND b.at IS NOT NULL AS category, same_host::INT + under_career_path::INT + has_job_url_hint::INT + (role_family IS NOT NULL)::INT + (siblings >= 3)::INT AS signals FROM a LEFT JOIN above b ON a.page_id = b.page_id AND array_to_string(a.s[1:len(a.s) - 1], '/') = b.at),
v AS (SELECT *, CASE
  WHEN length(text) NOT BETWEEN 8 AND 120 OR regexp_matches(text, '{q(V.NAV_LABEL)}') OR NOT (regexp_matches(text, '[A-Za-z]{{3,}}') OR regexp_matches(text, '[א-ת]{{2,}}')) THEN 'denylist'
  WHEN (regexp_matches(text, '{q(V.CTA_LABEL)}') OR regexp_matches(text, '{q(V.CTA_PREFIX)}')) AND NOT has_job_url_hint AND NOT under_career_path THEN 'cta_label'
  WHEN len(list_intersect(list_transform(s, lambda x: lower(x)), {V.NON_JOB_SEGMENTS!r})) > 0 THEN 'href_marker'
  WHEN category THEN 'category_prefix' WHEN shape_count = 1 AND NOT has_job_url_hint AND batch >= 3 THEN 'url_shape' WHEN in_chrome THEN 'evidence' WHEN signals >= 2 THEN 'accepted' ELSE 'default' END AS f FROM j)
"""
)


def links(spark, sf):
    return listing.candidates(listing_pages(spark, sf), None)


@query(f"{ANCHORS} SELECT {_SHOWN} FROM a")
def anchor_candidates(spark, sf):
    out = links(spark, sf)
    return out.select(*(F.col(c).cast("long").alias(c) if c in ("index", "siblings", "shape_count", "batch") else c for c in _SHOWN.split(", ")))


@query(f"{VERDICTS} SELECT page_id, index, href, f = 'accepted' AS accept, CASE f WHEN 'accepted' THEN 'evidence' ELSE f END AS filter FROM v")
def chain_verdicts(spark, sf):
    return listing.chain(links(spark, sf)).select("page_id", F.col("index").cast("long").alias("index"), "href", "verdict.accept", "verdict.filter")


@query(f"{ANCHORS} SELECT page_id, href_shape, count(*) AS n FROM a GROUP BY 1, 2")
def href_shape_counts(spark, sf):
    return links(spark, sf).groupBy("page_id", "href_shape").agg(F.count("*").alias("n"))


@query(f"{ANCHORS} SELECT page_id, sha1(string_agg(DISTINCT href_shape, ',' ORDER BY href_shape)) AS fingerprint, count(*) AS n FROM a GROUP BY 1")
def page_fingerprints(spark, sf):
    return listing.fingerprint(links(spark, sf))


LABELS = f"{VERDICTS}, l AS (SELECT *, f = 'accepted' AND text <> 'See all open roles' AND NOT regexp_matches(href, '/careers/jobs$') AS is_job FROM v)"


@query(f"{LABELS} SELECT page_id, index, href, is_job, CASE WHEN is_job THEN 'accepted' WHEN f = 'accepted' THEN 'listing' ELSE 'rejected' END AS reason FROM l")
def rule_labels(spark, sf):
    reason = F.when(F.col("is_job"), "accepted").when(F.col("reason").contains("a link to a job listing"), "listing").otherwise("rejected")
    return discovery.rule_labels(links(spark, sf)).select("page_id", F.col("index").cast("long").alias("index"), "href", "is_job", reason.alias("reason"))


@query(f"{VERDICTS} SELECT page_id, href, (row_number() OVER (PARTITION BY page_id ORDER BY same_host DESC, index))::INT AS place FROM v WHERE f = 'accepted' QUALIFY place <= 50")
def listed_postings(spark, sf):
    return listing.postings(listing.chain(links(spark, sf))).select("page_id", "href", "place")


@query("SELECT page_id, 'https://www.acme' || page_id || '.io/careers/jobs' AS hop_url FROM pages")
def best_hops(spark, sf):
    return discovery.best_hop(links(spark, sf))


def _labelled(spark, sf):
    """Links of a part's size: postings under one parent, as a key of one path, on two hosts, or with nothing in common."""
    path = F.expr("CASE p_size % 5 WHEN 0 THEN concat('https://www.acme.io/careers/r-and-d/', p_partkey) WHEN 1 THEN concat('https://acme.io/jobs.aspx?lang=en&id=', p_partkey) WHEN 2 THEN concat('https://acme.io/a/b/', p_partkey, '/x', p_partkey) WHEN 3 THEN concat('https://h', p_partkey % 2, '.io/a/', p_partkey) ELSE concat('https://acme.io/', p_partkey) END")
    rows = t(spark, sf, "part").select(F.col("p_size").alias("page_id"), F.col("p_partkey").cast("int").alias("index"), path.alias("href"), (F.col("p_partkey") % 3 != 0).alias("is_job"))
    return rows.withColumn("href_shape", urls.href_shape("href"))


@query(r"""WITH j AS (SELECT p_size AS page_id, p_partkey AS k, CASE p_size % 5 WHEN 0 THEN 'acme.io|careers/r-and-d|3' WHEN 1 THEN 'acme.io|?id,lang' WHEN 2 THEN 'acme.io|a/b/' || p_partkey || '|4' WHEN 3 THEN 'h' || (p_partkey % 2) || '.io|a|2' ELSE 'acme.io||1' END AS shape FROM part WHERE p_partkey % 3 <> 0),
d AS (SELECT page_id, shape, count(*) AS c, min(k) AS low_k FROM j GROUP BY 1, 2), top AS (SELECT page_id, shape FROM d QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY c DESC, low_k) = 1),
p AS (SELECT page_id, count(DISTINCT k % 2) AS hosts, count(*) AS n, min(k % 2) AS low, min(k) AS k FROM j GROUP BY 1)
SELECT page_id, shape AS url_shape, CASE page_id % 5 WHEN 0 THEN '^https?://(www\.)?acme\.io/careers/r\-and\-d/[^/?#]+/?$' WHEN 1 THEN '^https?://(www\.)?acme\.io/jobs\.aspx\?.*\bid='
WHEN 2 THEN '^https?://(www\.)?acme\.io/a/b/' || CASE WHEN n = 1 THEN k || '/[^/?#]+/?$' ELSE '[^?#]+$' END WHEN 3 THEN CASE WHEN hosts = 1 THEN '^https?://(www\.)?h' || low || '\.io/a/[^/?#]+/?$' END END AS include_url FROM p JOIN top USING (page_id)""")
def induced_plans(spark, sf):
    return listing.induce(_labelled(spark, sf))


@query(f"{LABELS} SELECT page_id, count(*) FILTER (is_job) AS baseline, 'verified' AS status, '^https?://(www\\.)?acme' || page_id || '\\.io/careers/jobs/[^/?#]+/?$' AS include_url FROM l GROUP BY 1")
def html_plans(spark, sf):
    pages = listing_pages(spark, sf)
    return discovery.html_plan(listing.candidates(pages, None), pages).select("page_id", "baseline", "status", "include_url")


@query(rf"""{VERDICTS} SELECT page_id, index, href, f IN ('accepted', 'default', 'evidence', 'url_shape') AND regexp_matches(href, '/careers/jobs/\d+') AS accept FROM v""")
def plan_verdicts(spark, sf):
    host = F.concat(F.lit(r"acme"), F.col("page_id").cast("string"), F.lit(r"\.io"))
    none = F.lit(None).cast("array<string>")
    plans = t(spark, sf, "pages").select("page_id", F.concat(F.lit(r"^https?://(www\.)?"), host, F.lit(r"/careers/jobs/[^/?#]+/?$")).alias("include_url"), F.array(F.concat(F.lit(r"^https?://(www\.)?"), host, F.lit(r"/[^/?#]+/?$"))).alias("exclude_url"), F.lit("no|such|shape").alias("url_shape"), none.alias("explicit_accept"))
    judged = listing.by_plan(links(spark, sf), plans, least=6)
    return judged.select("page_id", F.col("index").cast("long").alias("index"), "href", (F.col("verdict.accept") & (F.col("verdict.filter") == "plan_pattern")).alias("accept"))


# ---------------------------------------------------------------- the cascade


def _captured(spark, sf):
    """Addresses of each kind, and what was captured at them."""
    k = F.col("page_id") % 9
    n = F.col("page_id").cast("string")
    own = F.concat(F.lit("https://www.acme"), n, F.lit(".io/careers"))
    career = F.when(k == 0, "").when(k == 1, F.concat(F.lit("https://jobs.lever.co/acme"), n)).when(k == 2, F.concat(F.lit("https://feed.example/"), n)).otherwise(own)
    companies = t(spark, sf, "pages").select(F.concat(F.lit("c"), n).alias("id"), career.alias("career_url"), F.lit("acme").alias("hint"))
    board = F.lit('<a href="https://boards.greenhouse.io/gamma/jobs/1">a</a><iframe src="//boards.greenhouse.io/gamma/jobs/1"></iframe><a href="https://jobs.lever.co/beta">b</a>')
    data = F.lit('<script type="application/json">{"jobs": [{"title": "A", "url": "/1", "city": "x"}, {"title": "B", "url": "/2", "city": "x"}]}</script>')
    html = F.when(k == 6, board).when(k == 7, F.concat(F.lit("<p>x</p>"), data)).otherwise(F.col("html"))
    page = listing_pages(spark, sf).where(k != 0).select(F.col("url").alias("requested_url"), F.when(k == 5, F.regexp_replace("url", "careers$", "")).otherwise(F.col("url")).alias("url"), F.when(k == 3, 404).when(k == 4, 503).otherwise(200).alias("status"), html.alias("html"))
    return companies, page


@query("""SELECT 'c' || page_id AS company_id, CASE page_id % 9 WHEN 0 THEN 'techmap_only' WHEN 1 THEN 'ats_api' WHEN 2 THEN 'special_case' WHEN 3 THEN 'broken_url' WHEN 4 THEN NULL WHEN 5 THEN 'broken_url' WHEN 6 THEN 'external_board' ELSE 'html_listing' END AS kind,
CASE page_id % 9 WHEN 1 THEN 'lever:acme' || page_id WHEN 2 THEN 'feed.example' WHEN 6 THEN 'greenhouse:gamma' END AS board,
CASE page_id % 9 WHEN 0 THEN 'no career url' WHEN 3 THEN 'http 404' WHEN 4 THEN 'http 503' WHEN 5 THEN 'redirects to homepage' WHEN 7 THEN 'inlined' END AS reason,
CASE WHEN page_id % 9 <> 4 THEN 'verified' END AS status, CASE WHEN page_id % 9 IN (7, 8) THEN 2 END::BIGINT AS baseline FROM pages""")
def discovered_plans(spark, sf):
    known, pages = _captured(spark, sf)
    return discovery.discover(known, pages, ("feed.example",)).drop("hop_url")


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'https://boards.greenhouse.io/gamma/jobs/1' ELSE 'https://jobs.lever.co/beta' END AS board_url, CASE WHEN page_id % 3 = 0 THEN 'greenhouse:gamma' ELSE 'lever:beta' END AS board FROM pages")
def external_boards(spark, sf):
    more = F.when(F.col("page_id") % 3 == 0, '<iframe src="//boards.greenhouse.io/gamma/jobs/1"></iframe>').otherwise("")
    html = F.concat("html", F.lit("""<a class=x href='https://jobs.lever.co/beta'>b</a><a href="https://boards.greenhouse.io/gamma/jobs/1">a</a>"""), more)
    return discovery.external_board(t(spark, sf, "pages").select("page_id", html.alias("html")))


@query("SELECT page_id, 'https://acme.io/' || CASE WHEN page_id % 2 = 0 THEN 'team/join' ELSE 'jobs' END AS career_url FROM pages")
def career_links(spark, sf):
    more = F.when(F.col("page_id") % 2 == 0, "<a href='team/join'>Open <b>Positions</b></a>").otherwise("<a href='mailto:jobs@acme.io'>Jobs</a><a href='/x'>A long label about jobs at our company</a>")
    html = F.concat("html", more, F.lit("<a href='/jobs'>Jobs</a>"))
    return discovery.career_link(t(spark, sf, "pages").select("page_id", F.lit("https://acme.io/").alias("url"), html.alias("html")))


@query("SELECT page_id, upper('b6.00f') AS uid, CASE WHEN page_id % 3 = 2 THEN NULL ELSE repeat('a1', 12) END AS token FROM (SELECT page_id FROM pages WHERE page_id % 3 <> 2)")
def widget_credentials(spark, sf):
    k = F.col("page_id") % 3
    token = F.lit("a1" * 12)
    script = F.when(k == 0, F.concat(F.lit("<script src='https://www.comeet.co/careers-api/2.0/company/b6.00f/positions?token="), token, F.lit("'></script>")))
    script = F.when(k == 1, F.concat(F.lit("<script>COMEET.init({ uid: 'b6.00f', \"token\": '"), token, F.lit("'})</script>"))).otherwise(script)
    pages = t(spark, sf, "pages").select("page_id", discovery.widget(F.concat("html", F.coalesce(script, F.lit("<p>Comeet</p>")))).alias("w"))
    return pages.where("w is not null").select("page_id", "w.uid", "w.token")


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'https://www.comeet.com/jobs/acme/' || p_size || '.00A' END AS listing, CASE WHEN p_size % 2 = 0 THEN 'https://www.comeet.co/careers-api/2.0/company/B6.00F/positions?token=' || p_partkey ELSE 'https://www.comeet.com/jobs/acme' END AS address FROM part")
def board_addresses(spark, sf):
    page = F.expr("CASE p_size % 3 WHEN 0 THEN concat('https://www.comeet.com/jobs/acme/', p_size, '.00A/dev/', p_partkey) ELSE 'https://acme.io/x' END")
    board = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("B6.00F:"), F.col("p_partkey").cast("string"))).otherwise("acme")
    return t(spark, sf, "part").select("p_partkey", discovery.board_page(page).alias("listing"), discovery.board_address(board).alias("address"))


@query("SELECT p_size AS company_id, 'lever:b' || min(p_partkey) AS board, 'https://jobs.lever.co/b' || min(p_partkey) AS url FROM part WHERE p_partkey % 4 = 1 GROUP BY 1")
def first_boards(spark, sf):
    url = F.expr("CASE WHEN p_partkey % 4 = 1 THEN concat('https://jobs.lever.co/b', p_partkey) ELSE concat('https://x.io/', p_partkey) END")
    return discovery.first_board(t(spark, sf, "part").select(F.col("p_size").alias("company_id"), F.col("p_partkey").alias("place"), url.alias("url")))


@query("SELECT c_custkey AS company_id, 'T' || p_partkey AS title, CASE c_custkey % 3 WHEN 0 THEN 'ats_api' WHEN 1 THEN 'external_board' END AS source FROM customer JOIN part ON p_size = c_custkey % 10 WHERE c_custkey % 3 <> 2")
def strategy_postings(spark, sf):
    plans = companies(spark, sf).select(F.col("id").alias("company_id"), F.expr("CASE id % 3 WHEN 0 THEN 'ats_api' WHEN 1 THEN 'external_board' ELSE 'html_listing' END").alias("kind"), F.concat(F.lit("lever:"), (F.col("id") % 10).cast("string")).alias("board"))
    got = t(spark, sf, "part").select(F.concat(F.lit("lever:"), F.col("p_size").cast("string")).alias("board"), F.concat(F.lit("T"), F.col("p_partkey").cast("string")).alias("title"), null().alias("url"), null().alias("location"))
    return discovery.by_strategy(plans, got).select("company_id", "title", "source")


@query("SELECT c_custkey AS company_id, 'T' || s_suppkey AS title, 'Haifa' AS location, 'techmap' AS source FROM customer JOIN supplier ON s_suppkey % 40 = c_custkey WHERE s_suppkey % 5 <> 0")
def techmap_postings(spark, sf):
    rows = t(spark, sf, "supplier").select(F.format_string("Customer#%09d Inc.", F.col("s_suppkey") % 40).alias("company"), F.when(F.col("s_suppkey") % 5 != 0, F.concat(F.lit("T"), F.col("s_suppkey").cast("string"))).alias("title"), F.lit("Haifa").alias("city"), null().alias("url"))
    return discovery.techmap_postings(companies(spark, sf), discovery.techmap_index(rows)).select("company_id", "title", "location", "source")


@query("SELECT s_name AS company, 'T' || s_suppkey AS title, 'n' || s_nationkey AS department, NULL AS location, '' AS description FROM supplier")
def category_rows_as_postings(spark, sf):
    rows = t(spark, sf, "supplier").select(F.col("s_name").alias("company"), F.concat(F.lit("T"), F.col("s_suppkey").cast("string")).alias("title"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("category"), null().alias("url"))
    return discovery.row_postings(rows).select("company", "title", "department", "location", "description")


@query("SELECT 'c' || (page_id % 40) AS company, count(DISTINCT url) FILTER (k IN (0, 2)) AS n FROM (SELECT page_id, url, max(page_id) OVER (PARTITION BY url) % 4 AS k FROM pages) GROUP BY 1 HAVING n > 0")
def domains_audited(spark, sf):
    p = t(spark, sf, "pages")
    answers = p.groupBy("url").agg(F.max("page_id").alias("m")).select("url", F.expr("CASE m % 4 WHEN 0 THEN 404 WHEN 1 THEN 200 WHEN 2 THEN 500 ELSE 403 END").alias("status"))
    own = p.select(F.concat(F.lit("c"), (F.col("page_id") % 40).cast("string")).alias("name"), F.col("url").alias("homepage"), F.when(F.col("page_id") % 2 == 0, F.col("url")).alias("career_url"))
    found = discovery.domain_audit(own.distinct(), answers)
    return found


# ---------------------------------------------------------------- page texts

_VISIBLE = "trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b[^>]*>.*?</script\\s*>', ' ', 'g'), '(?is)<style\\b[^>]*>.*?</style\\s*>', ' ', 'g'), '(?is)<noscript\\b[^>]*>.*?</noscript\\s*>', ' ', 'g'), '(?is)<svg\\b[^>]*>.*?</svg\\s*>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&middot;', '·'), '&copy;', '©'), '&amp;', '&'), '\\s+', ' ', 'g'))"


@query(f"SELECT page_id, md5({_VISIBLE}) AS digest, length({_VISIBLE})::INT AS n, length({_VISIBLE}) < 500 AND regexp_matches(html, '(?i)id=\"(root|app|__next)\"|data-reactroot|ng-app|__NUXT__|enable javascript') AS js_shell, CASE WHEN regexp_matches(html, '{q(V.BLOCKED)}') THEN 'blocked' WHEN trim(html) = '' THEN 'empty' ELSE 'ok' END AS outcome FROM (SELECT page_id, html || CASE page_id % 4 WHEN 0 THEN '<div id=\"root\"></div>' WHEN 1 THEN '<svg><b>Access denied</b></svg>' ELSE '' END AS html FROM pages)")
def visible_text_len(spark, sf):
    html = F.concat("html", F.expr("CASE page_id % 4 WHEN 0 THEN '<div id=\"root\"></div>' WHEN 1 THEN '<svg><b>Access denied</b></svg>' ELSE '' END"))
    said = text.visible_text(html)
    return t(spark, sf, "pages").select("page_id", F.md5(said.cast("binary")).alias("digest"), F.length(said).alias("n"), rules.js_shell(html).alias("js_shell"), rules.fetch_outcome(F.lit(200), html).alias("outcome"))


@query(r"SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script\s*>', '', 'g'), '(?is)<style\b[^>]*>.*?</style\s*>', '', 'g'), '(?s)<!--.*?-->', '', 'g') AS html FROM pages")
def page_snapshots(spark, sf):
    return t(spark, sf, "pages").select("page_id", discovery.snapshot("html").alias("html"))


@query("SELECT page_id, 'https://x.example/a' AS url, length(coalesce(html, '')) > 0 AS there FROM pages")
def captured_pages(spark, sf):
    rows = t(spark, sf, "pages").select("page_id", F.lit("https://x.example/a").alias("requested_url"), F.when(F.col("page_id") % 2 == 0, "").otherwise("https://x.example/a").alias("url"), "html")
    return discovery.make_page(rows).select("page_id", "url", (F.length("text") > 0).alias("there"))


@query("SELECT page_id, 'Kept line.' || chr(10) || 'Backend developer here' AS text FROM pages")
def content_texts(spark, sf):
    n = F.col("page_id").cast("string")
    html = F.concat(F.lit("<nav><a href=/x>Home</a></nav><div class='onetrust-banner'><p>We use cookies "), n, F.lit("</p></div><form><input name=q>Search</form><script>var a;</script><p>Kept <b>line.</b></p><header><h1></h1><a href='/jobs/1'>Backend developer here</a></header><footer>Foot "), n, F.lit("</footer>"))
    return t(spark, sf, "pages").select("page_id", discovery.content_text(html).alias("text"))


@query("SELECT page_id, CASE WHEN boiler THEN '' ELSE 'kept' END AS description FROM (SELECT page_id, v = '' OR contains(lower(v), 'all rights reserved') AND length(v) < 1500 AS boiler FROM (SELECT page_id, " + _VISIBLE + " AS v FROM (SELECT page_id, html || CASE WHEN page_id % 3 = 0 THEN ' All rights reserved' ELSE '' END AS html FROM pages)))")
def page_descriptions(spark, sf):
    from tessera.operators import gate

    said = gate.page_description(F.concat("html", F.when(F.col("page_id") % 3 == 0, " All rights reserved").otherwise("")))
    return t(spark, sf, "pages").select("page_id", F.when(said == "", "").otherwise("kept").alias("description"))


@query("SELECT page_id, 'Role ' || page_id AS title, '2026-01-0' || (1 + page_id % 9) AS posted_at, CASE page_id % 3 WHEN 0 THEN 'Haifa, IL' WHEN 1 THEN 'Remote' END AS location, (1 + page_id % 2)::INT AS n FROM pages")
def page_json_ld(spark, sf):
    n = F.col("page_id").cast("string")
    place = F.expr("""CASE page_id % 3 WHEN 0 THEN '[{"@type":"Place","address":{"addressLocality":"Haifa","addressCountry":{"name":"IL"}}}]' WHEN 1 THEN '{"address":"Remote"}' ELSE 'null' END""")
    one = F.concat(F.lit('{"@type":["Thing","JobPosting"],"title":"Role '), n, F.lit('","datePosted":"2026-01-0'), (1 + F.col("page_id") % 9).cast("string"), F.lit('T10:00","jobLocation":'), place, F.lit("}"))
    blob = F.when(F.col("page_id") % 2 == 1, F.concat(F.lit('{"@graph":['), one, F.lit(',{"@type":"WebPage"},'), one, F.lit("]}"))).otherwise(one)
    html = F.concat("html", F.lit("<script type='application/ld+json'>{bad</script><script type='application/ld+json'>"), blob, F.lit("</script>"))
    found = listing.json_ld(html)
    return t(spark, sf, "pages").select("page_id", found.alias("x")).select("page_id", F.col("x")[0]["title"].alias("title"), F.col("x")[0]["posted_at"].alias("posted_at"), F.col("x")[0]["location"].alias("location"), F.size("x").alias("n"))


@query(r"""WITH r AS (SELECT regexp_replace(lower(regexp_extract(url, '^https?://([^/?#]+)', 1)), '^www\.', '') AS company, rtrim(regexp_extract(url, '^([^?#]*)', 1), '/') || CASE WHEN len(k) > 0 THEN '?' || array_to_string(k, '&') ELSE '' END AS u, url, page_id,
  ['Backend Engineer', 'Sales Manager', 'Data Analyst', 'platform  engineer', 'Gardener'][1 + page_id % 5] AS title, page_id % 7 <> 0 AS here, CASE WHEN page_id % 2 = 0 THEN 'ok' ELSE 'empty' END AS fetch_status
  FROM (SELECT *, list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(lower(x), '^(utm_source|utm_medium|utm_campaign|utm_term|utm_content|v|t)(=|$)')) AS k FROM pages)),
kept AS (SELECT *, lower(regexp_replace(title, '\s+', ' ', 'g')) AS t FROM r WHERE here AND title IN ('Backend Engineer', 'platform  engineer'))
SELECT company, title, u AS url, 'Haifa' AS city, fetch_status, '2026-01-01' AS posted_date FROM kept QUALIFY row_number() OVER (PARTITION BY regexp_replace(regexp_replace(company, '[^a-z0-9]+', '', 'g'), 'ai$', ''), t ORDER BY (fetch_status = 'ok') DESC, url) = 1""")
def export_rows(spark, sf):
    title = F.element_at(F.array(*map(F.lit, ("Backend Engineer", "Sales Manager", "Data Analyst", "platform  engineer", "Gardener"))), (1 + F.col("page_id") % 5).cast("int"))
    rows = t(spark, sf, "pages").select(urls.host("url").alias("display_name"), title.alias("title"), "url", F.lit("Haifa").alias("city"), F.when(F.col("page_id") % 7 == 0, "Berlin").otherwise("Haifa, Israel").alias("location"), null().alias("work_mode"), F.when(F.col("page_id") % 2 == 0, "ok").otherwise("empty").alias("fetch_status"), F.lit("2026-01-01T00:00").alias("posted_at"))
    return export.export(rows)[0].select("company", "title", "url", "city", "fetch_status", "posted_date")


@query("SELECT page_id, 'https://x.example/j/' || k AS url, 'Role ' || k || ' of ' || page_id AS title, CASE WHEN page_id % 2 = 0 THEN 'Haifa' END AS location FROM pages, (SELECT unnest(range(page_id % 4)) AS k FROM pages p2 WHERE false) RIGHT JOIN (SELECT 1) ON true WHERE false UNION ALL SELECT page_id, 'https://x.example/j/' || k, 'Role ' || k || ' of ' || page_id, CASE WHEN page_id % 2 = 0 THEN 'Haifa' END FROM (SELECT page_id, unnest(range(page_id % 4)) AS k FROM pages) WHERE page_id % 4 >= 2")
def inline_postings(spark, sf):
    n = F.col("page_id")
    items = F.transform(F.filter(F.sequence(F.lit(0), F.lit(3)), lambda k: k < n % 4), lambda k: F.struct(F.concat(F.lit("Role "), k.cast("string"), F.lit(" of "), n.cast("string")).alias("title"), F.concat(F.lit("/j/"), k.cast("string")).alias("url"), F.when(n % 2 == 0, F.lit("Haifa")).alias("city"), F.lit("full").alias("type")))
    html = F.concat("html", F.lit('<script type="application/json">{"posts": [{"title": "Blog", "url": "/b"}], "props":'), F.to_json(items), F.lit("}</script>"))
    pages = t(spark, sf, "pages").select("page_id", F.lit("https://x.example/careers").alias("url"), html.alias("html"))
    return inlined.inline_postings(pages).select("page_id", "title", "url", "location")


@query("SELECT item_id AS page_id, CASE WHEN item_id % 2 = 0 THEN '[{\"id\": ' || item_id || ', \"x\": [1, 2]}, {\"id\": 2}]' ELSE '[{\"b\": ' || item_id || '}]' END AS found FROM benchmark")
def embedded_arrays(spark, sf):
    n = F.col("item_id").cast("string")
    data = F.when(F.col("item_id") % 2 == 0, F.concat(F.lit('[{"id": '), n, F.lit(', "x": [1, 2]}, {"id": 2}]'))).otherwise(F.concat(F.lit('[{"bad": nope, "in": [{"b": '), n, F.lit("}]}]")))
    return t(spark, sf, "benchmark").select(F.col("item_id").alias("page_id"), inlined.longest_array(F.concat(F.lit("<script>var a = [1]; x = "), data, F.lit("; y = [{")))
.alias("found"))


# ---------------------------------------------------------------- feeds


@query("SELECT page_id, 'Dev ' || page_id AS title, CASE WHEN page_id % 2 = 0 THEN 'North, Israel' ELSE 'Israel' END AS location, 'https://elbitsystemscareer.com/jobs/?id=' || page_id AS url, 'Say & do' AS description FROM pages")
def status_feed(spark, sf):
    n = F.col("page_id").cast("string")
    area = F.when(F.col("page_id") % 2 == 0, ', "area": "North"').otherwise("")
    payload = F.concat(F.lit('[{"status": 1, "jobTitle": " Dev '), n, F.lit('", "jobId": "'), n, F.lit('", "description": "<p>Say &amp; do</p>"'), area, F.lit('}, {"status": 2, "jobTitle": "Off"}, {"status": 1, "jobTitle": " "}]'))
    return feeds.special(t(spark, sf, "pages").select("page_id", payload.alias("payload")), "elbitsystemscareer.com").select("page_id", "title", "location", "url", "description")


@query("SELECT page_id, 'Dev' AS title, 'Lod, Israel' AS location, 'https://jobs.iai.co.il/job/' || page_id AS url, CASE WHEN page_id % 2 = 0 THEN 'R&D' END AS department FROM pages")
def short_feed(spark, sf):
    n = F.col("page_id").cast("string")
    team = F.when(F.col("page_id") % 2 == 0, "R&D").otherwise("  ")
    payload = F.concat(F.lit('[{"tl": "Dev", "ct": "Lod", "id": "'), n, F.lit('", "jc": "'), team, F.lit('"}, {"tl": "No id"}, {"id": "7"}]'))
    return feeds.special(t(spark, sf, "pages").select("page_id", payload.alias("payload")), "jobs.iai.co.il").select("page_id", "title", "location", "url", "department")


@query("SELECT regexp_replace(lower(s_name), '[^a-z0-9]', '', 'g') AS company_key, 'Dev ' || s_suppkey AS title, 'u' || s_suppkey AS url FROM supplier")
def sibling_cache(spark, sf):
    n = F.col("s_suppkey").cast("string")
    positions = F.concat(F.lit('[{"title": " Dev '), n, F.lit('", "url": "u'), n, F.lit('"}, {"title": " "}, {"url": "x"}]'))
    return feeds.sibling_cache(t(spark, sf, "supplier").select(F.concat("s_name", F.lit(" Ltd.")).alias("name"), positions.alias("positions"))).select("company_key", "title", "url")


@query("SELECT flag, count(DISTINCT doc_id) FILTER (known) AS applied, count(DISTINCT doc_id) FILTER (NOT known) AS unknown FROM (SELECT CASE event_id % 4 WHEN 0 THEN 'liked' WHEN 1 THEN 'hidden' WHEN 2 THEN 'sent' ELSE 'reached_out' END AS flag, user_id AS doc_id, user_id IN (SELECT doc_id FROM documents) AS known FROM events) GROUP BY 1")
def browser_state(spark, sf):
    lists = t(spark, sf, "events").select(F.expr("CASE event_id % 4 WHEN 0 THEN 'liked' WHEN 1 THEN 'hidden' WHEN 2 THEN 'sent' ELSE 'reached' END").alias("list"), F.col("user_id").alias("job_id"))
    return feeds.browser_state(lists, t(spark, sf, "documents").select(F.col("doc_id").alias("id")))[1]


def _legacy(spark, sf):
    job = F.struct(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderpriority").alias("title"), null().alias("url"), null().alias("location"), null().alias("description"), F.when(F.col("o_orderstatus") == "F", "closed").alias("status"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("posted_at"), F.create_map(F.lit("p"), F.col("o_totalprice").cast("double")).alias("scores"))
    rows = t(spark, sf, "orders").join(t(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.groupBy(F.col("c_name").alias("name")).agg(F.lit(None).cast("string").alias("career_url"), F.max("o_orderdate").cast("string").alias("last_checked"), F.collect_list(job).alias("jobs"))  # a file is a company's postings


@query("SELECT o_orderkey::VARCHAR AS id, lower(replace(c_name, '#', '')) AS company_id, CASE WHEN o_orderstatus = 'F' THEN 'closed' ELSE 'seen' END AS status, o_totalprice AS score FROM orders JOIN customer ON c_custkey = o_custkey")
def legacy_migrated(spark, sf):
    none = spark.createDataFrame([], "name string, career_url string, decision string, company_key string, city string")
    _, jobs, scores = feeds.migrate_legacy(_legacy(spark, sf), none.select("name", "career_url"), none.select("name", "decision"), none.select("company_key", "city"))
    return jobs.join(scores.withColumnRenamed("job_id", "id"), "id").select("id", "company_id", "status", F.col("score").cast("double").alias("score"))


@query("SELECT o_orderkey::VARCHAR AS id, CASE o_orderkey % 10 WHEN 1 THEN 'title' WHEN 2 THEN '*' END AS field FROM orders WHERE o_orderkey % 10 IN (1, 2)")
def migration_problems(spark, sf):
    files = _legacy(spark, sf)
    k = F.col("id").cast("long") % 10
    stored = files.select(F.inline("jobs")).withColumn("status", F.coalesce("status", F.lit("seen"))).where(k != 2).withColumn("title", F.when(k == 1, "another").otherwise(F.col("title")))
    return feeds.verify_migration(files, stored).select("id", "field")


# ---------------------------------------------------------------- requirements, weights


@query("""SELECT p_partkey AS id, (3 + CASE WHEN p_size % 3 = 0 THEN 1 ELSE 0 END)::INT AS must, 1 AS nice, (2 + p_size % 7)::INT AS years_required, CASE WHEN p_size % 2 = 0 THEN 'senior' WHEN 2 + p_size % 7 <= 2 THEN 'junior' WHEN 2 + p_size % 7 <= 5 THEN 'mid' ELSE 'senior' END AS seniority,
'backend' AS family, 'python' AS skills, CASE WHEN p_size % 3 = 0 THEN 'degree,skill,years,years' ELSE 'degree,skill,years' END AS kinds FROM part""")
def requirement_fields(spark, sf):
    n = (2 + F.col("p_size") % 7).cast("string")
    body = F.concat(F.col("p_name"), F.lit(" about.\nRequirements:\n- "), n, F.lit("+ years of experience in the field.\n- BSc in something\n- Python is a must\n"), F.when(F.col("p_size") % 3 == 0, "- at least 1 years of experience.\n").otherwise(""), F.lit("Nice to have:\n- Kubernetes"))
    title = F.when(F.col("p_size") % 2 == 0, "Senior Backend Engineer").otherwise("Backend Engineer")
    rows = scoring.extract(t(spark, sf, "part").select(F.col("p_partkey").alias("id"), title.alias("title"), body.alias("description"), "p_size"))
    own = lambda b: F.filter("requirements", lambda r: r["bucket"] == b)
    return rows.select("id", F.size(own("must")).alias("must"), F.size(own("nice")).alias("nice"), "years_required", "seniority", "family", F.array_join(F.array_compact(F.transform(own("must"), lambda r: r["canonical"])), ",").alias("skills"), F.array_join(F.array_sort(F.transform(own("must"), lambda r: r["kind"])), ",").alias("kinds"))


@query("""WITH p AS (SELECT d.source AS profile_id, d.doc_id AS id, d.doc_id % 101 AS must, d.doc_id % 71 AS senior, d.doc_id % 53 AS nice, d.doc_id % 97 AS evidence, CASE WHEN d.doc_id % 3 = 0 THEN b ELSE 0 END AS bonus, CASE WHEN d.doc_id % 2 >= 2 THEN 55 ELSE 100 END AS missing_cap, CASE WHEN d.doc_id % 3 >= 2 THEN 50 ELSE 100 END AS gap_cap, d.doc_id % 10 / 10.0 AS fit, quality = 1 AS fits, trial, wm, ws, wn, we, gate, cap
  FROM documents d JOIN labels USING (doc_id), (VALUES (0, 0.5, 0.25, 0.125, 0.125, 0.25, 35, 10.0), (1, 0.25, 0.25, 0.25, 0.25, 0.5, 25, 0.0), (2, 0.75, 0.0, 0.25, 0.0, 0.125, 40, 20.0)) v(trial, wm, ws, wn, we, gate, cap, b)),
raw AS (SELECT *, greatest(0, least(100, round_even(wm * must + ws * senior + wn * nice + we * evidence + bonus, 0))) AS own FROM p),
s AS (SELECT *, round_even(fit * least(own, missing_cap, gap_cap), 0) AS x FROM raw),
f AS (SELECT *, greatest(0, least(100, CASE WHEN fit < gate THEN least(x, cap) ELSE x END)) AS score FROM s),
r AS (SELECT trial, profile_id, fits, row_number() OVER (PARTITION BY trial, profile_id ORDER BY score DESC, id) AS place, count(*) OVER (PARTITION BY trial, profile_id) AS n FROM f),
g AS (SELECT trial, profile_id, CASE WHEN any_value(n) >= 5 THEN count(*) FILTER (fits AND place <= 5) / 5.0 END AS p5, CASE WHEN any_value(n) >= 10 THEN count(*) FILTER (fits AND place <= 10) / 10.0 END AS p10 FROM r GROUP BY 1, 2)
SELECT trial, false AS rejected, round(coalesce(avg(p5), 0), 9)::DOUBLE AS precision_at_5, round(coalesce(avg(p10), 0), 9)::DOUBLE AS precision_at_10 FROM g GROUP BY 1""")
def weight_trials(spark, sf):
    from tessera.plans.catalogue import _labelled as pairs

    rows = [(0, 0.5, 0.25, 0.125, 0.125, 0.25, 35.0, 10.0, 0.0, 0.5), (1, 0.25, 0.25, 0.25, 0.25, 0.5, 25.0, 0.0, 0.0, 0.5), (2, 0.75, 0.0, 0.25, 0.0, 0.125, 40.0, 20.0, 0.0, 0.5)]
    table = spark.createDataFrame(rows, "trial int, " + ", ".join(f"t_{k} double" for k in (*V.SEARCH_WEIGHTS, *V.SEARCH_FAMILY_FIT)))
    out = tuning.evaluate(pairs(spark, sf), table, (5, 10))
    return out.select("trial", "rejected", F.round("precision_at_5", 9).alias("precision_at_5"), F.round("precision_at_10", 9).alias("precision_at_10"))


@query("SELECT doc_id AS id, CASE WHEN length(coalesce(text, '')) < 200 THEN 1 ELSE 0 END + CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END AS reasons FROM documents WHERE reasons > 0")
def suspicious_postings(spark, sf):
    rows = described(spark, sf).select("id", F.lit("Backend Developer Role").alias("title"), F.when(F.col("id") % 2 == 0, "https://x.example/about").otherwise("https://x.example/jobs/1").alias("url"), "description", F.when(F.col("id") % 3 != 0, "backend").alias("family"))
    return export.suspicions(rows).select("id", F.size("reasons").alias("reasons"))


@query("SELECT p_partkey, p_size % 4 = 0 AS evident FROM part")
def posting_evidence(spark, sf):
    html = F.when(F.col("p_size") % 4 == 0, F.concat(F.lit("<h2>Requirements</h2><button>Apply now</button><p>"), "p_name", F.lit("</p>"))).otherwise(F.concat(F.lit("<p>"), "p_name", F.lit("</p>")))
    e = C.evidence(html, F.col("p_name"), F.lit("https://x.example/a"))
    return t(spark, sf, "part").select("p_partkey", (e["apply_cta"] & (e["requirement_sections"] >= 1) & ~e["jsonld_jobposting"]).alias("evident"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_name END AS title FROM part")
def link_titles(spark, sf):
    card = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("<div><h3>"), "p_name", F.lit("</h3><a href='/1'>Apply</a></div>"))).otherwise(F.concat(F.lit("<div><h3>"), "p_name", F.lit("</h3><a href='/1'>Apply</a><a href='/2'>More</a></div>")))
    a = listing.anchors(card, F.lit("https://x.example/"))
    return t(spark, sf, "part").select("p_partkey", F.nullif(F.get(a, F.lit(0))["heading"], F.lit("")).alias("title"))


@query("SELECT c_custkey, 'Haifa' AS city FROM customer WHERE c_custkey % 2 = 0")
def detail_locations(spark, sf):
    none = null()
    x = titles.infer_location(F.lit("Engineer"), F.lit(""), none, F.when(F.col("c_custkey") % 2 == 0, "Haifa"), none)
    return t(spark, sf, "customer").select("c_custkey", x.alias("x")).where("x.city is not null").select("c_custkey", "x.city")
