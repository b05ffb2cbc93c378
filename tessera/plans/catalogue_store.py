"""Queries over the store: reads and worklists, counts, lookups, flags, caches, the relevance gate, and single-field writes.

Imported for what it registers; see ``catalogue`` for what the driver's tables stand for."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import rules, text, urls
from tessera.functions import vocabulary as V
from tessera.operators import caches, gate, jobs, reads
from tessera.plans import search as S
from tessera.plans.catalogue import BASE, companies, described, postings, query, scores, sources, t, tok

def null():
    return F.lit(None).cast("string")


def stored_postings(spark, sf):
    """Postings with an address where the order key is even, and the columns a store keeps."""
    url = F.when(F.col("id") % 2 == 0, F.concat(F.lit("https://jobs.example.com/"), F.col("id").cast("string")))
    closed = F.when(F.col("status") == "closed", "gone")
    return postings(spark, sf).withColumns({"url": url, "closed_reason": closed, "closed_at": closed, "is_referral": F.lit(False), "referral_contact": null(), "last_seen": F.col("posted_at"), "years_required": (F.col("id") % 7).cast("int")})


STORED = "SELECT o_orderkey AS id, o_custkey AS company_id, o_orderpriority AS title, CASE o_orderstatus WHEN 'F' THEN 'closed' WHEN 'O' THEN 'new' ELSE 'seen' END AS status, CASE WHEN o_orderkey % 2 = 0 THEN 'https://jobs.example.com/' || o_orderkey END AS url, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders"


# ---------------------------------------------------------------- worklists and corpora


@query(f"WITH j AS ({STORED}) SELECT id, url, title, company_id FROM j WHERE url IS NOT NULL AND status <> 'closed'")
def open_with_url(spark, sf):
    return reads.open_with_url(stored_postings(spark, sf))


@query(f"WITH j AS ({STORED}) SELECT id, url, title, company_id, 'gone' AS closed_reason FROM j WHERE url IS NOT NULL AND status = 'closed'")
def closed_with_url(spark, sf):
    return reads.closed_with_url(stored_postings(spark, sf))


@query(f"WITH j AS ({STORED}) SELECT id, company_id, status FROM j WHERE status <> 'closed'")
def open_jobs(spark, sf):
    return reads.open_jobs(stored_postings(spark, sf)).select("id", "company_id", "status")


@query("SELECT o_orderkey AS id, c_name AS company, c_mktsegment AS industry, 'n' || c_nationkey AS company_size FROM orders JOIN customer ON c_custkey = o_custkey")
def jobs_with_company(spark, sf):
    sized = companies(spark, sf).withColumn("size", F.concat(F.lit("n"), F.col("connection_count").cast("string")))
    return reads.with_company(postings(spark, sf), sized).select("id", "company", "industry", "company_size")


def classified(spark, sf):
    """Described postings with their language as family; labelled bad ones are closed."""
    bad = t(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").alias("id")).distinct().withColumn("bad", F.lit(True))
    rows = described(spark, sf).drop("status").join(bad, "id", "left")
    return rows.select("id", "title", "description", F.when(F.col("id") % 3 == 0, None).otherwise(F.col("source_language")).alias("family"), F.when(F.col("bad"), "closed").otherwise("new").alias("status"))


CLASSIFIED = "SELECT doc_id AS id, substr(text, 1, 60) AS title, text AS description, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE lang END AS family FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL) AND length(text) >= 50"


@query(f"SELECT id, family, md5(coalesce(title, '') || '. ' || coalesce(description, '')) AS digest FROM ({CLASSIFIED})")
def corpus_texts(spark, sf):
    return reads.corpus(classified(spark, sf)).select("id", "family", F.md5(F.col("text").cast("binary")).alias("digest"))


@query(f"SELECT family, count(*) AS n, CAST(sum(length(coalesce(title, '')) + 2 + length(coalesce(description, ''))) AS BIGINT) AS chars FROM ({CLASSIFIED}) WHERE family IS NOT NULL GROUP BY 1")
def corpus_by_family(spark, sf):
    return reads.corpus_by_family(classified(spark, sf)).groupBy("family").agg(F.count("*").alias("n"), F.sum(F.length("text")).cast("long").alias("chars"))


@query("SELECT page_id, page_id % 2 = 0 AS jsonld_jobposting, CASE WHEN page_id % 4 <> 3 THEN (page_id % 5)::INT END AS requirement_sections, page_id % 4 = 3 AS none FROM (SELECT page_id, page_id % 4 AS k FROM pages) WHERE k <> 3 UNION ALL SELECT page_id, NULL, NULL, true FROM pages WHERE page_id % 4 = 3")
def evidence_decoded(spark, sf):
    p = t(spark, sf, "pages").select("page_id")
    raw = F.when(F.col("page_id") % 4 == 3, "{broken").otherwise(F.format_string('{"jsonld_jobposting": %s, "requirement_sections": %d, "other": 1}', (F.col("page_id") % 2 == 0).cast("string"), F.col("page_id") % 5))
    out = reads.decoded(p.withColumn("job_evidence", raw))
    return out.select("page_id", "job_evidence.jsonld_jobposting", "job_evidence.requirement_sections", F.col("job_evidence").isNull().alias("none"))


# ---------------------------------------------------------------- counts


@query("SELECT count(*) AS total, count(*) FILTER (o_orderstatus <> 'F') AS open FROM orders")
def job_counts(spark, sf):
    return reads.job_counts(postings(spark, sf))


@query("""WITH s AS (SELECT CAST(l_linenumber AS VARCHAR) AS profile_id, CAST(floor(l_quantity * 2 / 10) * 10 AS INT) AS bucket, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus <> 'F' AND l_linenumber IN (1, 2, 3) GROUP BY 1, 2)
SELECT 'jobs' AS measure, NULL AS profile_id, NULL::INT AS bucket, count(*) AS n FROM orders UNION ALL SELECT 'open', NULL, NULL, count(*) FROM orders WHERE o_orderstatus <> 'F'
UNION ALL SELECT 'companies', NULL, NULL, count(*) FROM customer UNION ALL SELECT 'connections', NULL, NULL, count(*) FROM supplier UNION ALL SELECT 'score', profile_id, bucket, n FROM s""")
def dashboard(spark, sf):
    profiles = spark.createDataFrame([("1",), ("2",), ("3",), ("9",)], "profile_id string")
    return reads.dashboard(postings(spark, sf), companies(spark, sf), scores(spark, sf), t(spark, sf, "supplier"), profiles)


def plans(spark, sf):
    return t(spark, sf, "events").select(F.col("event_type").alias("kind"), (F.col("user_id") % 3).cast("string").alias("status"), F.when(F.col("event_id") % 5 == 0, "rules").otherwise("probe").alias("derived_by"))


@query("""SELECT 'kind' AS of, event_type AS value, count(*) AS n FROM events GROUP BY 2 UNION ALL SELECT 'status', CAST(user_id % 3 AS VARCHAR), count(*) FROM events GROUP BY 2
UNION ALL SELECT 'derived_by', CASE WHEN event_id % 5 = 0 THEN 'rules' ELSE 'probe' END, count(*) FROM events GROUP BY 2""")
def plan_summary(spark, sf):
    return reads.plan_summary(plans(spark, sf))


def flagged(spark, sf):
    q = F.col("quality") == 1
    return t(spark, sf, "labels").where("doc_id is not null").groupBy(F.col("doc_id").alias("job_id")).agg(F.max(q).alias("liked"), F.max(F.col("toxic") == 1).alias("hidden"), F.max(F.col("doc_id") % 10 == 0).alias("sent"), F.max(F.col("doc_id") % 7 == 0).alias("reached_out"))


@query("""WITH l AS (SELECT doc_id, max(quality = 1) AS liked, max(toxic = 1) AS hidden FROM labels WHERE doc_id IS NOT NULL GROUP BY 1), c AS (SELECT source, count(*) AS n FROM documents GROUP BY 1)
SELECT count(*) AS jobs, count(DISTINCT source) AS companies, count(*) FILTER (n > 0) AS with_connection, count(*) FILTER (coalesce(text, '') <> '') AS with_description, count(*) FILTER (d.doc_id % 11 = 0) AS referrals,
count(*) FILTER (liked) AS liked, count(*) FILTER (hidden) AS hidden, count(*) FILTER (l.doc_id % 10 = 0) AS sent, count(*) FILTER (l.doc_id % 7 = 0) AS reached_out FROM documents d JOIN c USING (source) LEFT JOIN l ON l.doc_id = d.doc_id""")
def stat_block(spark, sf):
    rows = described(spark, sf).withColumn("is_referral", F.col("id") % 11 == 0)
    return reads.stat_block(S.joined(rows, sources(spark, sf), flagged(spark, sf), None))


# ---------------------------------------------------------------- lookups


@query("""WITH l AS (SELECT doc_id, max(quality = 1) AS liked, max(toxic = 1) AS hidden FROM labels WHERE doc_id IS NOT NULL GROUP BY 1)
SELECT d.doc_id AS job_id, coalesce(liked, false) AS liked, coalesce(hidden, false) AS hidden, coalesce(l.doc_id % 10 = 0, false) AS sent, coalesce(l.doc_id % 7 = 0, false) AS reached_out FROM documents d LEFT JOIN l ON l.doc_id = d.doc_id""")
def flags_of(spark, sf):
    return reads.flags_of(described(spark, sf).select(F.col("id").alias("job_id")), flagged(spark, sf))


@query("SELECT DISTINCT doc_id AS job_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL")
def ids_with_flag(spark, sf):
    return reads.ids_with(flagged(spark, sf), "hidden")


@query("SELECT l_orderkey AS job_id, CAST(l_linenumber AS VARCHAR) AS profile_id, max(l_quantity * 2) AS score FROM lineitem GROUP BY 1, 2")
def scores_of_jobs(spark, sf):
    return reads.scores_of(scores(spark, sf)).select("job_id", F.explode("scores").alias("profile_id", "v")).select("job_id", "profile_id", "v.score")


@query("""WITH o AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O') SELECT l_orderkey AS job_id, count(DISTINCT l_linenumber) AS profiles, max(l_quantity * 2) AS best FROM lineitem JOIN o ON o_orderkey = l_orderkey GROUP BY 1""")
def scores_of_page(spark, sf):
    ids = postings(spark, sf).where("status = 'new'").select(F.col("id").alias("job_id"))
    out = reads.scores_of(scores(spark, sf), ids)
    return out.select("job_id", F.size("scores").cast("long").alias("profiles"), F.array_max(F.transform(F.map_values("scores"), lambda x: x["score"])).alias("best"))


def contacts(spark, sf):
    return t(spark, sf, "supplier").select(F.col("s_nationkey").alias("company_id"), F.col("s_name").alias("name"), F.lit("x").alias("position"), F.col("s_suppkey").cast("string").alias("url"))


@query("SELECT s_nationkey AS company_id, s_name AS name, 'x' AS position, CAST(s_suppkey AS VARCHAR) AS url, (row_number() OVER (PARTITION BY s_nationkey ORDER BY lower(s_name), s_name))::INT AS place FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def contacts_of_page(spark, sf):
    page = t(spark, sf, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("company_id"))
    return reads.contacts_of(contacts(spark, sf), page)


@query("SELECT s_nationkey AS company_id, count(*) AS n FROM supplier GROUP BY 1")
def contacts_per_company(spark, sf):
    return reads.connection_counts(contacts(spark, sf))


@query("SELECT c_custkey AS id, c_name AS display_name, count(s_suppkey)::INT AS connection_count FROM customer LEFT JOIN (SELECT *, 'Customer#' || lpad(CAST(s_suppkey % 30 AS VARCHAR), 9, '0') AS company FROM supplier) ON company = c_name GROUP BY 1, 2")
def contacts_refreshed(spark, sf):
    own = t(spark, sf, "supplier").select(F.format_string("customer#%09d Ltd.", F.col("s_suppkey") % 30).alias("company"), F.col("s_name").alias("name"), F.lit("x").alias("position"), F.col("s_suppkey").cast("string").alias("url"))
    return jobs.refresh_contacts(companies(spark, sf).drop("connection_count"), own)[0].select("id", "display_name", "connection_count")


@query("SELECT o_orderkey AS id, o_custkey AS company_id, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey))::INT AS place, count(*) OVER (PARTITION BY o_custkey) AS company_rows FROM orders")
def grouped_by_company(spark, sf):
    return reads.by_company(postings(spark, sf), "id").select("id", "company_id", "place", "company_rows")


@query(f"{BASE} SELECT id, company_id, display_name AS company, title, best_score FROM r WHERE status <> 'closed' AND best_score >= 0 ORDER BY best_score DESC NULLS LAST, id LIMIT 30")
def research_selection(spark, sf):
    from tessera.plans.catalogue import engine

    return reads.selected(engine(spark, sf).top(S.Filters(), 30))


@query("SELECT o_custkey AS company_id, min(c_name) AS company FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'P' GROUP BY 1")
def research_companies(spark, sf):
    own = companies(spark, sf).select(F.col("id").alias("company_id"), F.col("display_name").alias("company"))
    return reads.distinct_companies(postings(spark, sf).where("status = 'seen'").join(own, "company_id"))


@query("SELECT o_orderkey AS id, o_custkey AS company_id, c_name AS company, o_orderpriority AS title, coalesce((SELECT max(l_quantity * 2) FROM lineitem WHERE l_orderkey = o_orderkey), 0) AS best_score FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey = 2")
def job_at_url(spark, sf):
    return reads.at_url(stored_postings(spark, sf), companies(spark, sf), scores(spark, sf), "https://jobs.example.com/2/?utm_source=x#top")


@query(r"SELECT page_id, nullif(regexp_replace(regexp_replace(lower(regexp_extract(url, '^https?://([^/?#]*)', 1)), ':.*$', ''), '^www\.', ''), '') AS domain FROM pages")
def company_domains(spark, sf):
    return t(spark, sf, "pages").select("page_id", reads.company_domain(F.regexp_replace("url", "^(https?)://", "$1://user@")).alias("domain"))


@query("SELECT page_id AS id, url AS career_url FROM pages WHERE page_id % 3 = 1")
def career_addresses(spark, sf):
    rows = t(spark, sf, "pages").select(F.col("page_id").alias("id"), F.when(F.col("page_id") % 3 == 0, "").when(F.col("page_id") % 3 == 1, F.col("url")).alias("career_url"))
    return reads.career_urls(rows)


@query("SELECT conv_id, turn, role, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS section FROM conversations")
def section_carry(spark, sf):
    rows = t(spark, sf, "conversations").select("conv_id", "turn", "role")
    return reads.section_carry(rows, "conv_id", "turn", F.when(F.col("role") == "user", F.col("turn")))


@query("""WITH r AS (SELECT o_custkey AS profile_id, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority END AS family, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders)
SELECT profile_id, max(CASE WHEN n = 1 THEN family END) AS newest, coalesce(max(CASE WHEN n = 1 THEN family END), max(CASE WHEN n = 2 THEN family END)) AS family FROM r WHERE n <= 2 GROUP BY 1""")
def latest_family(spark, sf):
    rows = t(spark, sf, "orders").select(F.col("o_custkey").alias("profile_id"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")).alias("family"), F.col("o_orderdate").alias("start"), F.col("o_orderkey").alias("end"))
    newest = rows.groupBy("profile_id").agg(F.max_by("family", F.struct("start", "end")).alias("newest"))
    return reads.latest_family(rows).join(newest, "profile_id").select("profile_id", "newest", "family")


# ---------------------------------------------------------------- writes


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 5 = 1 THEN 99 ELSE (o_orderkey % 7)::INT END AS years_required FROM orders")
def years_set(spark, sf):
    new = postings(spark, sf).where("id % 5 in (0, 1)").select("id", F.when(F.col("id") % 5 == 1, 99).alias("years_required"))
    return reads.set_years(stored_postings(spark, sf), new).select("id", "years_required")


@query(f"WITH j AS ({STORED}) SELECT id, CASE WHEN id % 4 = 1 AND status IN ('new', 'closed') THEN 'seen' ELSE status END AS status, id % 4 = 1 AS is_referral, CASE WHEN id % 4 = 1 THEN 'Dana' END AS referral_contact, CASE WHEN id % 4 = 1 THEN '2030-01-01' ELSE day END AS last_seen, CASE WHEN id % 4 <> 1 AND status = 'closed' THEN 'gone' END AS closed_reason FROM j")
def referrals_marked(spark, sf):
    marks = postings(spark, sf).where("id % 4 = 1").select("id", F.lit("Dana").alias("contact"))
    return reads.mark_referrals(stored_postings(spark, sf), marks, "2030-01-01").select("id", "status", "is_referral", "referral_contact", "last_seen", "closed_reason")


@query("SELECT coalesce(c_custkey, s_suppkey + 1000000) AS id, CASE WHEN s_suppkey IS NOT NULL THEN s_name ELSE c_name END AS display_name, c_mktsegment AS industry FROM customer FULL JOIN (SELECT *, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey ELSE -s_suppkey END AS k FROM supplier) ON c_custkey = k")
def companies_upserted(spark, sf):
    new = t(spark, sf, "supplier").select(F.when(F.col("s_suppkey") % 2 == 0, F.col("s_suppkey")).otherwise(F.col("s_suppkey") + 1000000).alias("id"), F.col("s_name").alias("display_name"))
    return reads.upsert_companies(companies(spark, sf).select("id", "display_name", "industry"), new)


# ---------------------------------------------------------------- the relevance gate and what texts say


def fetched(spark, sf):
    """Part names as titles, addresses and places by their size, for companies by their key."""
    size = F.col("p_size")
    url = F.expr("CASE p_size % 5 WHEN 0 THEN 'https://www.acme.io/jobs/' WHEN 1 THEN 'https://boards.greenhouse.io/beta/jobs/' WHEN 2 THEN 'https://x.example/docs/' WHEN 3 THEN 'https://x.example/jobs/' ELSE 'https://shared.example/jobs/' END")
    title = F.when(size % 6 == 0, "  ").when(size % 6 == 1, F.concat(F.lit("About us "), "p_name")).otherwise(F.concat("p_name", F.lit(" Engineer")))
    return t(spark, sf, "part").select("p_partkey", (F.col("p_partkey") % 4).cast("string").alias("company_id"), title.alias("title"), F.concat(url, F.col("p_partkey").cast("string")).alias("url"), F.expr("CASE p_size % 4 WHEN 0 THEN 'Haifa, Israel' WHEN 1 THEN 'Remote' WHEN 2 THEN NULL ELSE 'Paris, France' END").alias("location"))


@query("""SELECT p_partkey, CASE WHEN p_size % 6 = 0 THEN 'no title' WHEN p_size % 5 = 0 AND p_partkey % 4 <> 0 THEN 'host of another company' WHEN p_size % 5 = 1 AND p_partkey % 4 <> 1 THEN 'board of another company'
WHEN p_size % 6 = 1 THEN 'site furniture' WHEN p_size % 5 = 2 THEN 'not a posting: path segment docs' WHEN p_size % 4 = 3 THEN 'location' END AS refused FROM part""")
def relevance_gate(spark, sf):
    own = spark.createDataFrame([("0", "https://acme.io/careers"), ("1", "https://boards.greenhouse.io/beta"), ("2", "https://shared.example/a"), ("3", "https://shared.example/b"), ("4", "https://boards.greenhouse.io/gamma")], "id string, career_url string")
    return gate.relevance(fetched(spark, sf), own).select("p_partkey", "refused")


@query("SELECT p_partkey, p_size % 3 <> 0 AS relevant FROM part")
def relevant_titles(spark, sf):
    return t(spark, sf, "part").select("p_partkey", gate.relevant_title(F.expr("concat(p_name, CASE p_size % 3 WHEN 0 THEN ' widget' WHEN 1 THEN ' Backend Developer' ELSE ' Data Scientist' END)")).alias("relevant"))


@query("SELECT doc_id, length(coalesce(text, '') || ' All Rights Reserved') < 1500 AS boilerplate, length(coalesce(text, '')) < 1500 AND contains(lower(coalesce(text, '')), 'all rights reserved') AS as_it_is FROM documents")
def boilerplate_texts(spark, sf):
    said = F.concat(F.coalesce("text", F.lit("")), F.lit(" All Rights Reserved"))
    return t(spark, sf, "documents").select("doc_id", gate.boilerplate(said).alias("boilerplate"), gate.boilerplate("text").alias("as_it_is"))


@query("SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN true ELSE p_size % 2 = 1 AND p_size % 3 = 0 END AS unparseable FROM part")
def unparseable_postings(spark, sf):
    title = F.expr("concat(p_name, CASE p_size % 3 WHEN 0 THEN '' ELSE ' Backend Developer' END)")
    evidence = F.when(F.col("p_size") % 4 == 0, F.struct(F.lit(False).alias("jsonld_jobposting"), F.lit(False).alias("apply_cta"), F.lit(0).alias("requirement_sections"), null().alias("role_family_from_title")))
    evidence = F.when(F.col("p_size") % 4 == 2, F.struct(F.lit(False).alias("jsonld_jobposting"), F.lit(True).alias("apply_cta"), F.lit(0).alias("requirement_sections"), null().alias("role_family_from_title"))).otherwise(evidence)
    return t(spark, sf, "part").select("p_partkey", gate.unparseable(title, F.when(F.col("p_size") % 2 == 0, 2).otherwise(0), evidence).alias("unparseable"))


_LANG_SQL = ", ".join(f"CASE WHEN regexp_matches(x, '{p}') THEN '{name}' END" for name, p in gate.LANGUAGES if "(?!" not in p and "(?<" not in p)


@query(f"""WITH x AS (SELECT doc_id, coalesce(text, '') || CASE doc_id % 6 WHEN 0 THEN ' Python and C++.' WHEN 1 THEN ' golang, Ruby; SQL' WHEN 2 THEN ' TypeScript' WHEN 3 THEN ' c# objective-c Shell Scripting' ELSE '' END AS x FROM documents)
SELECT doc_id, array_to_string(list_filter([{_LANG_SQL}], lambda v: v IS NOT NULL), ',') AS languages FROM x""")
def language_tags(spark, sf):
    said = F.concat(F.coalesce("text", F.lit("")), F.expr("CASE doc_id % 6 WHEN 0 THEN ' Python and C++.' WHEN 1 THEN ' golang, Ruby; SQL' WHEN 2 THEN ' TypeScript' WHEN 3 THEN ' c# objective-c Shell Scripting' ELSE '' END"))
    return t(spark, sf, "documents").select("doc_id", F.array_join(F.array_except(gate.languages(said), F.array(F.lit("C"), F.lit("Java"))), ",").alias("languages"))


@query("SELECT doc_id AS id, CASE WHEN doc_id % 4 = 0 THEN 'he' ELSE lang END AS source_language, CASE WHEN doc_id % 4 = 0 THEN 'מפתח תוכנה' END AS title_original, CASE WHEN doc_id % 4 = 0 THEN coalesce(length(text), 0) END AS original_chars FROM documents")
def hebrew_marked(spark, sf):
    rows = described(spark, sf).withColumn("title", F.when(F.col("id") % 4 == 0, "מפתח תוכנה").otherwise(F.col("title")))
    return gate.marked_hebrew(rows).select("id", "source_language", "title_original", F.length("description_original").alias("original_chars"))


@query(r"SELECT page_id, contains(lower(url || chr(10) || html), 'example.com') OR regexp_matches(lower(url || chr(10) || html), '(^|[^\p{L}\p{N}_])casino win([^\p{L}\p{N}_]|$)') OR contains(lower(url), 'casino-win') AS named FROM pages")
def pages_that_name_a_company(spark, sf):
    return t(spark, sf, "pages").select("page_id", gate.mentions_company("url", "html", F.lit("Example.com"), F.lit("Casino-Win Ltd.")).alias("named"))


@query("SELECT event_id, event_id % 3 = 0 AS silent FROM events")
def empty_answers(spark, sf):
    e = t(spark, sf, "events")
    answers = F.create_map(F.lit("size"), F.when(F.col("event_id") % 3 == 0, "unknown").otherwise(F.col("event_type")), F.lit("note"), F.lit("text"))
    return e.select("event_id", gate.no_answer(answers, F.array(F.lit("size"), F.lit("rating"))).alias("silent"))


@query("SELECT page_id, substr(sha1('acme|' || page_id || '|' || url), 1, 16) AS id FROM pages")
def legacy_ids(spark, sf):
    return t(spark, sf, "pages").select("page_id", gate.legacy_id(F.lit("acme"), F.col("page_id").cast("string"), "url").alias("id"))


@query("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'lever:acme' WHEN 1 THEN 'workable:b-c' END AS board FROM part")
def legacy_boards(spark, sf):
    url = F.expr("CASE p_size % 4 WHEN 0 THEN 'https://jobs.lever.co/Acme/1' WHEN 1 THEN 'https://apply.workable.com/b-c/j/2' WHEN 2 THEN 'https://x.recruitee.com/o/3' ELSE 'https://acme.io' END")
    return t(spark, sf, "part").select("p_partkey", gate.legacy_board(url).alias("board"))


@query("SELECT c_custkey, regexp_replace(regexp_replace(lower(c_name), '[^\\w\\s-]', '', 'g'), '[\\s-]+', '_', 'g') AS plan_id FROM customer")
def plan_ids(spark, sf):
    return t(spark, sf, "customer").select("c_custkey", text.snake_id("c_name").alias("plan_id"))


@query("""SELECT doc_id AS id FROM documents WHERE (contains(lower(coalesce(substr(text, 1, 60), '') || ' ' || coalesce(text, '')), 'the') AND contains(lower(coalesce(substr(text, 1, 60), '') || ' ' || coalesce(text, '')), 'ing')) AND NOT (contains(lower(coalesce(substr(text, 1, 60), '')), 'and') OR contains(lower(coalesce(substr(text, 1, 60), '')), 'idiot')) AND doc_id % 40 <= 30""")
def legacy_page(spark, sf):
    rows = described(spark, sf).withColumn("posted_at", F.date_format(F.date_sub(F.lit("2026-01-31").cast("date"), (F.col("id") % 40).cast("int")), "yyyy-MM-dd"))
    return S.legacy_page(rows, "The, ing", True, "both", "and, Idiot", False, 30, "2026-01-31").select("id")


@query(BASE + "SELECT id, display_name, best_score FROM r WHERE status = 'seen' ORDER BY lower(display_name), best_score DESC NULLS LAST, id LIMIT 40")
def legacy_order(spark, sf):
    from tessera.plans.catalogue import engine

    return engine(spark, sf).rows(S.Filters(status="seen")).orderBy(*S.legacy_order("company")).limit(40).select("id", "display_name", "best_score")


@query("""WITH c AS (SELECT c_custkey, c_custkey % 3 AS k FROM customer), h AS (SELECT s_suppkey % 40 AS c, min(s_suppkey) AS p FROM supplier GROUP BY 1)
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN 'Haifa' WHEN o_orderkey % 4 = 1 THEN 'Lod' WHEN k = 0 THEN 'Netanya' WHEN h.c IS NOT NULL THEN 'Holon' WHEN o_orderkey % 4 = 2 THEN 'Israel' END AS city_or_place FROM orders JOIN c ON c_custkey = o_custkey LEFT JOIN h ON h.c = o_custkey""")
def locations_inferred(spark, sf):
    from tessera.operators import companies as C

    place = F.expr("CASE id % 4 WHEN 0 THEN 'Haifa, Israel' WHEN 2 THEN 'Israel' END")
    rows = postings(spark, sf).select("id", "company_id", F.when(F.col("id") % 4 == 1, "Engineer, Lod").otherwise("Engineer").alias("title"), F.lit("").alias("description"), place.alias("location"))
    own = companies(spark, sf).withColumn("address_city", F.when(F.col("id") % 3 == 0, "Netanya"))
    hints = t(spark, sf, "supplier").select(F.col("s_suppkey").alias("place"), F.format_string("Customer#%09d Ltd.", F.col("s_suppkey") % 40).alias("company"), F.lit("Holon").alias("city"))
    return C.located(rows, own, hints).select("id", F.coalesce("city", "location").alias("city_or_place"))


@query("""WITH x AS (SELECT l_orderkey AS job_id, l_linenumber AS p, max(l_quantity) AS q FROM lineitem GROUP BY 1, 2) SELECT job_id, p::VARCHAR AS profile_id FROM x JOIN orders ON o_orderkey = job_id WHERE p IN (1, 2) AND (job_id % 3 = 0 OR p = 2)""")
def stale_scores(spark, sf):
    """Pairs to score anew: the postings whose text has changed (every third), and the profile whose text has."""
    from tessera.operators import scoring

    jobs_ = postings(spark, sf).select("id", "title", "description")
    people = spark.createDataFrame([("1", "cv one"), ("2", "cv two")], "profile_id string, text string")
    before = people.withColumn("text", F.when(F.col("profile_id") == "2", "older").otherwise(F.col("text")))
    stored = scoring.keyed(jobs_.withColumn("title", F.when(F.col("id") % 3 == 0, "older").otherwise(F.col("title"))), before, "v1")
    have = scores(spark, sf).select("job_id", "profile_id").distinct()
    return scoring.stale(scoring.keyed(jobs_, people, "v1"), stored).join(have, ["job_id", "profile_id"], "left_semi").select("job_id", "profile_id")


@query("""WITH r AS (SELECT s_suppkey, s_name, s_suppkey * 4 AS k FROM supplier), m AS (SELECT r.*, o_orderkey FROM r LEFT JOIN orders ON o_orderkey = k AND o_custkey = s_suppkey % 100 + 1)
SELECT count(*) AS jobs, count(*) FILTER (referral) AS referrals, count(*) FILTER (fresh) AS added FROM (SELECT o_orderkey IN (SELECT o_orderkey FROM m WHERE o_orderkey IS NOT NULL) AS referral, false AS fresh FROM orders UNION ALL SELECT true, true FROM m WHERE o_orderkey IS NULL)""")
def referrals_merged(spark, sf):
    who = F.format_string("Customer#%09d Ltd.", F.col("s_suppkey") % 100 + 1)
    asked = t(spark, sf, "supplier").select(who.alias("company"), F.lit(None).cast("array<string>").alias("also_posted_as"), F.concat(F.lit("Referral "), "s_name").alias("title"), F.concat(F.lit("https://jobs.example.com/"), (F.col("s_suppkey") * 4).cast("string"), F.lit("?utm_source=a")).alias("url"), F.lit("Dana").alias("contact"))
    kept = stored_postings(spark, sf).withColumn("id", F.col("id").cast("string"))
    merged = jobs.merge_referrals(kept, companies(spark, sf), asked, "2026-01-01").withColumn("company", F.lit("x"))
    # an address that another company's posting has would give its row's identity twice: give the new ones their own
    merged = merged.withColumn("url", F.when(F.col("job_id").isNull(), F.concat("url", F.lit("&new=1"))).otherwise(F.col("url")))
    out, _ = jobs.with_referrals(kept, merged, companies(spark, sf), "2026-01-01")
    return out.agg(F.count("*").alias("jobs"), F.count_if("is_referral").alias("referrals"), F.count_if(F.col("is_referral") & (F.col("first_seen") == "2026-01-01")).alias("added"))


# ---------------------------------------------------------------- caches


@query("""WITH c AS (SELECT sha1(url) AS key, max(CASE WHEN page_id % 3 = 0 THEN page_id END) AS fresh_id FROM pages GROUP BY 1) SELECT page_id, fresh_id IS NOT NULL AS hit, fresh_id AS value FROM pages p JOIN c ON sha1(p.url) = c.key""")
def page_cache(spark, sf):
    p = t(spark, sf, "pages").select("page_id", caches.page_key("url").alias("key"))
    at = F.when(F.col("page_id") % 3 == 0, F.format_string("2026-01-02T00:%02d:%02d", (F.col("page_id") / 60 % 60).cast("int"), (F.col("page_id") % 60).cast("int"))).when(F.col("page_id") % 3 == 1, "2025-12-01T00:00:00").otherwise("not a time")
    newest = p.groupBy("key").agg(F.max(F.when(F.col("page_id") % 3 == 0, F.col("page_id"))).alias("value"))
    cache = p.withColumn("stored_at", at).drop("page_id").join(newest, "key")
    return caches.look_up(p, cache, "2026-01-02T12:00:00", 24).select("page_id", "hit", "value")


@query("SELECT sha1(url) AS key, count(*) FILTER (page_id % 4 = 0) > 0 AS stored FROM pages GROUP BY 1")
def page_cache_update(spark, sf):
    p = t(spark, sf, "pages").select(caches.page_key("url").alias("key"), "html", (F.col("page_id") % 4 == 0).alias("ok"))
    cache = spark.createDataFrame([], "key string, stored_at string, value string")
    after = caches.store(cache, p.select("key", F.when(F.col("ok"), F.col("html")).alias("value")), "2026-01-02T00:00:00")
    return p.select("key").distinct().join(after.select("key", F.lit(True).alias("s")), "key", "left").select("key", F.coalesce("s", F.lit(False)).alias("stored"))


@query("SELECT doc_id AS id, CASE WHEN doc_id % 4 = 0 THEN 'developer ' || (doc_id % 8) WHEN doc_id % 4 = 1 THEN 'מפתח לא מתורגם ' || (doc_id % 8) ELSE substr(text, 1, 60) END AS title FROM documents")
def titles_translated(spark, sf):
    k = F.col("id") % 8
    title = F.when(F.col("id") % 4 == 0, F.concat(F.lit("מפתח "), k.cast("string"))).when(F.col("id") % 4 == 1, F.concat(F.lit("מפתח לא מתורגם "), k.cast("string"))).otherwise(F.col("title"))
    rows = described(spark, sf).select("id", title.alias("title"))
    cache = spark.createDataFrame([(f"מפתח {k}", f"developer {k}") for k in range(8)] + [(f"מפתח לא מתורגם {k}", f"מפתח לא מתורגם {k}") for k in range(8)], "said string, value string")
    cache = cache.select(caches.text_key("said").alias("key"), F.lit("2026-01-01T00:00:00").alias("stored_at"), "value")
    return caches.translated(rows, cache, "title", "2026-01-02T00:00:00")


# ---------------------------------------------------------------- rules that are plain case analysis


def _department_sql(column: str) -> str:
    """The department rules as SQL; a pattern that looks ahead for words that must be absent becomes two tests."""
    cases = []
    for pattern, name in V.DEPARTMENT_RULES:
        if pattern.startswith("^(?!"):
            absent, present = pattern[len("^(?!.*") :].split(").*", 1)
            test = f"regexp_matches(x, '(?i){present}') AND NOT regexp_matches(x, '(?i){absent}')"
        else:
            test = f"regexp_matches(x, '(?i){pattern}')"
        cases.append(f"WHEN {test} THEN '{name}'")
    return f"CASE WHEN x <> '' AND NOT regexp_matches(x, '{V.NOT_A_DEPARTMENT}') THEN CASE {' '.join(cases)} END END".replace("x", column) if column != "x" else f"CASE WHEN x <> '' AND NOT regexp_matches(x, '{V.NOT_A_DEPARTMENT}') THEN CASE {' '.join(cases)} END END"


_RAW = ["R&D", "Sales Team", "QA Automation", "Clinical validation", "Cloud Ops", "People & Culture", "Management", "Product", "UX Design", "Finance", "Legal", "Marketing", "IT Helpdesk", "Customer Success", "Supply Chain", "Data Science", "Firmware", "Front Office", ""]


@query(f"SELECT c_custkey, {_department_sql('x')} AS department FROM (SELECT c_custkey, trim(({_RAW!r})[1 + c_custkey % {len(_RAW)}] || CASE WHEN c_custkey % 3 = 0 THEN ' ' || lower(c_mktsegment) ELSE '' END) AS x FROM customer)")
def department_fold(spark, sf):
    raw = F.element_at(F.array(*map(F.lit, _RAW)), (1 + F.col("c_custkey") % len(_RAW)).cast("int"))
    said = F.trim(F.concat(raw, F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit(" "), F.lower("c_mktsegment"))).otherwise("")))
    return t(spark, sf, "customer").select("c_custkey", rules.department(said).alias("department"))


_MODES = "CASE doc_id % 5 WHEN 0 THEN ' Hybrid work.' WHEN 1 THEN ' Work from home!' WHEN 2 THEN ' On-site in Haifa' ELSE '' END"


@query(f"SELECT doc_id, CASE WHEN regexp_matches(x, '(?i)\\bhybrid\\b') THEN 'hybrid' WHEN regexp_matches(x, '(?i)\\b(fully remote|remote[- ]first|work from home|100% remote|remote)\\b') THEN 'remote' WHEN regexp_matches(x, '(?i)\\b(on[- ]?site|in[- ]office|office[- ]based)\\b') THEN 'onsite' END AS mode FROM (SELECT doc_id, coalesce(text, '') || {_MODES} AS x FROM documents)")
def work_modes(spark, sf):
    return t(spark, sf, "documents").select("doc_id", rules.work_mode(F.concat(F.coalesce("text", F.lit("")), F.expr(_MODES))).alias("mode"))


@query("SELECT page_id, CASE WHEN page_id % 6 = 0 THEN 'http 404' WHEN page_id % 6 = 1 THEN NULL WHEN page_id % 6 = 2 THEN 'redirected to https://x.example/jobs' WHEN page_id % 6 = 3 THEN 'board says the position is gone' END AS reason FROM pages")
def postings_gone(spark, sf):
    k = F.col("page_id") % 6
    page = F.concat("html", F.when(k == 1, "<p>Checking your browser</p>").when(k == 3, "").otherwise(""))
    page = F.when(k == 3, F.concat(F.lit("<p>This job is no longer available.</p>"), "html")).otherwise(page)
    landed = F.when(k == 2, "https://x.example/jobs").when(k == 3, None).otherwise("https://x.example/jobs/engineer/1")
    return t(spark, sf, "pages").select("page_id", rules.posting_gone(F.lit("https://x.example/jobs/engineer/1"), landed, F.when(k == 0, 404).otherwise(200), page).alias("reason"))


@query("SELECT user_id, event_id, value IS NULL OR event_id % 4 = 3 OR event_id % 4 = 0 AS recheck FROM events")
def needs_recheck(spark, sf):
    at = F.expr("CASE event_id % 4 WHEN 0 THEN '2026-01-01T00:00:00' WHEN 3 THEN 'never' ELSE '2026-01-01T20:00:00' END")
    return t(spark, sf, "events").select("user_id", "event_id", rules.needs_recheck(at, F.lit("2026-01-02T00:00:00").cast("timestamp"), 12).alias("recheck"))


@query("SELECT c_custkey, regexp_replace(regexp_replace(lower(c_name), '\\b(ltd|inc|llc|group|technologies|technology|labs|systems|software|solutions|israel|the)\\b', ' ', 'g'), '[^a-z0-9]+', '', 'g') AS key, regexp_replace(lower(c_name), '[^a-z0-9]+', '', 'g') AS loose FROM customer")
def company_keys(spark, sf):
    return t(spark, sf, "customer").select("c_custkey", text.normalize_company(F.concat("c_name", F.lit(" Technologies Ltd."))).alias("key"), text.loose_company(F.concat(F.lit("The "), "c_name", F.lit(" (formerly X).com"))).alias("loose"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS iso, strftime(o_orderdate, '%Y-%m-%d') AS epoch FROM orders")
def dates_normalized(spark, sf):
    day = F.col("o_orderdate").cast("date")
    us = F.concat_ws("/", F.month(day).cast("string"), F.dayofmonth(day).cast("string"), F.year(day).cast("string"))
    millis = (F.unix_date(day).cast("long") * 86_400_000 + 7).cast("string")
    return t(spark, sf, "orders").select("o_orderkey", text.normalize_date(us).alias("iso"), F.when(F.length(millis).between(12, 13), text.posted_date(millis)).otherwise(F.date_format(day, "yyyy-MM-dd")).alias("epoch"))


@query(f"SELECT doc_id, list_contains({tok('text')}, 'the') AS has FROM documents")
def search_token(spark, sf):
    return t(spark, sf, "documents").select("doc_id", F.array_contains(text.search_tokens("text"), "the").alias("has"))


@query("SELECT page_id, translate(rtrim(base64(encode(rtrim(regexp_extract(url, '^([^?#]*)', 1), '/'))), '='), '+/', '-_') AS id FROM pages WHERE NOT contains(url, '?')")
def job_ids(spark, sf):
    none = F.lit("")
    return t(spark, sf, "pages").where(~F.contains("url", F.lit("?"))).select("page_id", urls.job_id("url", none, none, none).alias("id"))
