"""All queries over the driver's tables, and the SQL that must give the same rows.

The tables stand in for the engine's own: customers are companies, orders are postings (F closed, O new, P seen),
line items are scores (line number: profile; twice the quantity: score), documents are described postings of the
company named by their source, labels are sparse flags, pages are listing pages and events are runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import rules, text, titles, urls
from tessera.functions import vocabulary as V
from tessera.operators import companies as C
from tessera.operators import cv, export, jobs, listing, repairs, reports, scoring, taxonomy, tuning
from tessera.operators.kept import dealt, stored
from tessera.plans import index
from tessera.plans import search as S
from tessera.sources import inlined, retail
from tessera.streaming import runs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# ---------------------------------------------------------------- the engine's tables


def companies(spark, sf):
    return t(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("display_name"), F.col("c_mktsegment").alias("industry"), F.col("c_nationkey").alias("connection_count"))


def postings(spark, sf):
    status = F.when(F.col("o_orderstatus") == "F", "closed").when(F.col("o_orderstatus") == "O", "new").otherwise("seen")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return t(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("company_id"), F.col("o_orderpriority").alias("title"), F.lit("").alias("description"), F.col("o_orderpriority").alias("city"), status.alias("status"), day.alias("posted_at"), day.alias("first_seen"), F.col("o_totalprice").alias("price"))


def scores(spark, sf):
    return t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").cast("string").alias("profile_id"), (F.col("l_quantity") * 2).alias("score"))


def described(spark, sf, deal: bool = False):
    """Documents as described postings; ``deal`` them out for queries that work on each text at length."""
    rows = t(spark, sf, "documents")
    return (dealt(rows) if deal else rows).select(F.col("doc_id").alias("id"), F.col("source").alias("company_id"), F.substring("text", 1, 60).alias("title"), F.col("text").alias("description"), F.col("lang").alias("source_language"), F.lit("new").alias("status"))


def sources(spark, sf):
    """Sources as companies; documents without one share that named ''."""
    return t(spark, sf, "documents").groupBy(F.coalesce("source", F.lit("")).alias("id")).agg(F.count("*").cast("int").alias("connection_count")).select("id", F.col("id").alias("display_name"), "connection_count")


_kept: dict[tuple[str, str, str], DataFrame] = {}


def maintained(spark: SparkSession, sf: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A table that the engine keeps beside the ones it is made from: built once for a folder of tables, then read."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _kept:
        _kept[key] = stored(build(), name)
    return _kept[key]


def engine(spark, sf):
    """Search over the postings, with the best score of each kept as a table."""
    own = scores(spark, sf)
    return S.Search(postings(spark, sf), companies(spark, sf), None, own, best=maintained(spark, sf, "best-scores", lambda: S.best_scores(own)))


def text_search(spark, sf):
    """Search over the described postings, with their tokens kept as an index."""
    own = described(spark, sf).na.fill("", ["company_id"])
    return S.Search(own, sources(spark, sf), index=maintained(spark, sf, "search-index", lambda: index.build(described(spark, sf, True))), cut_titles=True)


BASE = """WITH c AS (SELECT c_custkey AS company_id, c_name AS display_name, c_mktsegment AS industry, c_nationkey AS connection_count FROM customer),
b AS (SELECT l_orderkey AS id, max(l_quantity * 2) AS best_score FROM lineitem GROUP BY 1),
j AS (SELECT o_orderkey AS id, o_custkey AS company_id, o_orderpriority AS title, o_orderpriority AS city, CASE o_orderstatus WHEN 'F' THEN 'closed' WHEN 'O' THEN 'new' ELSE 'seen' END AS status, strftime(o_orderdate, '%Y-%m-%d') AS posted_at FROM orders),
r AS (SELECT * FROM j JOIN c USING (company_id) LEFT JOIN b USING (id))
"""
SHOWN = ("id", "company_id", "display_name", "industry", "city", "status", "posted_at", "best_score")
COLS = ", ".join(SHOWN)


# ---------------------------------------------------------------- search


@query(BASE + f"SELECT {COLS} FROM r WHERE status <> 'closed' ORDER BY best_score DESC NULLS LAST, id LIMIT 50")
def search_page(spark, sf):
    return engine(spark, sf).search(S.Filters(status="open"))[0].select(*SHOWN)


@query(BASE + f"SELECT {COLS} FROM r WHERE status <> 'closed' AND industry IN ('BUILDING', 'MACHINERY') ORDER BY posted_at DESC NULLS LAST, id LIMIT 20 OFFSET 40")
def search_by_date_third_page(spark, sf):
    return engine(spark, sf).search(S.Filters(status="open", industry="BUILDING, MACHINERY"), "date", 3, 20)[0].select(*SHOWN)


@query(BASE + f"SELECT {COLS} FROM r WHERE status IN ('new', 'seen') ORDER BY lower(display_name) NULLS FIRST, id LIMIT 500")
def search_by_company_clamped(spark, sf):
    return engine(spark, sf).search(S.Filters(status="new,seen"), "company", 1, 9999)[0].select(*SHOWN)


@query(BASE + "SELECT count(*) AS total FROM r WHERE status <> 'closed'")
def search_total(spark, sf):
    return engine(spark, sf).search(S.Filters(status="open"))[1]


@query(BASE + f"SELECT {COLS} FROM r WHERE best_score >= 90")
def min_score_null_drop(spark, sf):
    return engine(spark, sf).rows(S.Filters(min_score=90)).select(*SHOWN)


@query(BASE + "SELECT j.id, max(l_quantity * 2) AS best_score FROM j LEFT JOIN lineitem l ON l.l_orderkey = j.id AND l.l_linenumber = 3 WHERE status <> 'closed' GROUP BY j.id HAVING max(l_quantity * 2) >= 50")
def profile_score(spark, sf):
    return engine(spark, sf).rows(S.Filters(status="open", profile="3", min_score=50)).select("id", "best_score")


@query(BASE + "SELECT r.id, n AS years_required FROM r LEFT JOIN (SELECT l_orderkey AS id, max(l_linenumber) AS n FROM lineitem GROUP BY 1) y USING (id) WHERE n IS NULL OR n <= 3")
def max_years_null_kept(spark, sf):
    years = t(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.max("l_linenumber").alias("years_required"))
    return S.Search(postings(spark, sf).join(years, "id", "left"), companies(spark, sf)).rows(S.Filters(max_years=3)).select("id", "years_required")


@query(BASE + "SELECT id, company_id, city FROM r WHERE city IN ('1-URGENT', '5-LOW') AND company_id NOT IN (1, 2, 3) AND posted_at >= '1998-01-01' AND connection_count > 0")
def multi_select(spark, sf):
    f = S.Filters(city="1-URGENT,5-LOW", exclude_company_id="1,2,3", posted_after="1998-01-01", has_connection=True)
    return S.Search(postings(spark, sf), companies(spark, sf)).rows(f).select("id", "company_id", "city")


@query(f"{BASE}SELECT id, title, best_score, row_number() OVER (ORDER BY best_score DESC NULLS LAST, id) AS place FROM r WHERE status <> 'closed' AND best_score >= 0 QUALIFY place <= 25")
def top_postings(spark, sf):
    top = engine(spark, sf).top(S.Filters(), 25)
    return top.select("id", "title", "best_score", F.row_number().over(W.orderBy(F.col("best_score").desc_nulls_last(), "id")).cast("long").alias("place"))


@query(BASE + ", g AS (SELECT *, max(best_score) OVER (PARTITION BY company_id) AS company_score, row_number() OVER (PARTITION BY company_id ORDER BY best_score DESC NULLS LAST, id) AS place FROM r WHERE status <> 'closed') SELECT id, company_id, company_score, place FROM g WHERE place <= 8")
def company_groups(spark, sf):
    return S.grouped(engine(spark, sf).rows(S.Filters(status="open"))).select("id", "company_id", "company_score", F.col("place").cast("long").alias("place"))


def _facet(name: str, column: str, label: str, condition: str):
    ORACLE_SQL[f"facet_{name}"] = f"{BASE}, f AS (SELECT {column} AS value, min({label}) AS label, count(*) AS n FROM r WHERE {condition} AND {column} IS NOT NULL GROUP BY 1) SELECT value, label, n, (SELECT count(*) FROM f) AS total FROM f ORDER BY n DESC, lower(label), value LIMIT 250"
    QUERIES[f"facet_{name}"] = lambda spark, sf: engine(spark, sf).facet(S.Filters(status="open", city="1-URGENT", min_score=60), name)


_facet("city", "city", "city", "status <> 'closed' AND best_score >= 60")
_facet("industry", "industry", "industry", "status <> 'closed' AND city = '1-URGENT' AND best_score >= 60")
_facet("company", "company_id", "display_name", "status <> 'closed' AND city = '1-URGENT' AND best_score >= 60")


@query(BASE + "SELECT 'company' AS dimension, count(DISTINCT company_id) AS total FROM r WHERE status <> 'closed' UNION ALL SELECT 'city', count(DISTINCT city) FROM r WHERE status <> 'closed' UNION ALL SELECT 'industry', count(DISTINCT industry) FROM r WHERE status <> 'closed'")
def facet_totals(spark, sf):
    own = S.Search(postings(spark, sf).withColumns({"department": F.lit(None).cast("string"), "source_language": F.lit(None).cast("string")}), companies(spark, sf))
    return own.facet_totals(S.Filters(status="open")).where(F.col("dimension").isin("company", "city", "industry"))


@query("SELECT lang AS value, lang AS label, count(*) AS n, (SELECT count(DISTINCT lang) FROM documents) AS total FROM documents GROUP BY 1 HAVING lang IS NOT NULL")
def facet_language(spark, sf):
    own = S.Search(described(spark, sf), sources(spark, sf))
    return own.facet(S.Filters(language="en"), "language")


@query("SELECT c_custkey AS id, c_name AS display_name, count(o_orderkey) AS total_jobs, coalesce(sum(CASE WHEN o_orderstatus <> 'F' THEN 1 ELSE 0 END), 0)::BIGINT AS open_jobs FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2")
def company_open_total(spark, sf):
    return engine(spark, sf).company_stats().select("id", "display_name", "total_jobs", "open_jobs")


@query("SELECT CAST(l_linenumber AS VARCHAR) AS profile_id, CAST(floor(l_quantity * 2 / 10) * 10 AS INT) AS bucket, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus <> 'F' GROUP BY 1, 2")
def score_distribution(spark, sf):
    return engine(spark, sf).distribution()


@query("SELECT DISTINCT CAST(l_linenumber AS VARCHAR) AS profile_id FROM lineitem")
def scored_profiles(spark, sf):
    return engine(spark, sf).profiles()


@query("SELECT d.doc_id AS id, coalesce(l.toxic, 0) = 1 AS hidden FROM documents d LEFT JOIN labels l USING (doc_id) WHERE coalesce(l.toxic, 0) = 0")
def state_filter(spark, sf):
    state = t(spark, sf, "labels").select(F.col("doc_id").alias("job_id"), *(F.lit(False).alias(x) for x in ("liked", "sent", "reached_out")), (F.col("toxic") == 1).alias("hidden"))
    return S.Search(described(spark, sf), sources(spark, sf), state).rows(S.Filters(hidden=False)).select("id", "hidden")


TOK = f"""regexp_extract_all(translate(lower(coalesce({{0}}, '')), '{text.ACCENTS[0]}', '{text.ACCENTS[1]}'), '[\\p{{{{L}}}}\\p{{{{N}}}}]+')"""


def tok(column: str) -> str:
    return TOK.format(column).replace("{{", "{").replace("}}", "}")


def _phrase(tokens: str, words: list[str]) -> str:
    return f"contains(' ' || array_to_string({tokens}, ' ') || ' ', ' {' '.join(words)} ')"


@query(f"SELECT doc_id AS id FROM documents WHERE list_contains({tok('text')}, 'the') AND list_contains({tok('text')}, 'this')")
def fts_and(spark, sf):
    return text_search(spark, sf).rows(S.Filters(q="The this")).select("id")


@query(f"SELECT doc_id AS id FROM documents WHERE list_contains({tok('substr(text, 1, 60)')}, 'und')")
def fts_title(spark, sf):
    return text_search(spark, sf).rows(S.Filters(q="Und", scope="title")).select("id")


@query(f"SELECT doc_id AS id FROM documents WHERE {_phrase(tok('text'), ['of', 'the'])} AND NOT (list_contains({tok('substr(text, 1, 60)')}, 'and') OR list_contains({tok('substr(text, 1, 60)')}, 'in'))")
def fts_phrase_exclude(spark, sf):
    return text_search(spark, sf).rows(S.Filters(q="of.the", exclude="and in")).select("id")


@query("SELECT doc_id AS id FROM documents WHERE false")
def fts_no_term(spark, sf):
    return text_search(spark, sf).rows(S.Filters(q="+ -")).select("id")


@query("SELECT doc_id AS id FROM documents WHERE contains(lower(text), 'idiot') OR contains(lower(text), 'stupid')")
def legacy_any(spark, sf):
    return t(spark, sf, "documents").where(S.legacy_match(F.col("text"), "Idiot, stupid", False)).select(F.col("doc_id").alias("id"))


@query("SELECT word, count(*) AS n FROM (SELECT unnest(list_distinct(regexp_extract_all(lower(substr(text, 1, 60)), '\\p{L}{3,}'))) AS word FROM documents) WHERE word NOT IN ('the', 'and') GROUP BY 1 ORDER BY n DESC, word LIMIT 15")
def exclude_suggestions(spark, sf):
    return S.exclude_suggestions(described(spark, sf), ["the", "and"])


@query(f"""WITH p AS (SELECT doc_id AS id, i AS chunk, {tok("substr(text, i * 900 + 1, 900)")} AS w FROM (SELECT doc_id, text, unnest(range(greatest(1, coalesce(CAST(ceil(length(text) / 900.0) AS INT), 1)))) AS i FROM documents)),
asked AS (SELECT DISTINCT item_id AS query_id, unnest({tok('text')}) AS t FROM benchmark), s AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM p),
f AS (SELECT id, chunk, len(w) AS len, unnest(w) AS t FROM p), tf AS (SELECT id, chunk, len, t, count(*) AS tf FROM f WHERE t IN (SELECT t FROM asked) GROUP BY ALL), df AS (SELECT t, count(*) AS df FROM tf GROUP BY 1),
x AS (SELECT query_id, id, chunk, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / mean))), 6) AS score FROM asked JOIN df USING (t) JOIN tf USING (t), s GROUP BY 1, 2, 3)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id, chunk) AS rank FROM x QUALIFY rank <= 4""")
def bm25_passages(spark, sf):
    """Every benchmark item's whole text against the chunks of all documents."""
    asked = t(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return export.bm25_chunks(dealt(t(spark, sf, "documents")).select(F.col("doc_id").alias("id"), "text"), asked)


# ---------------------------------------------------------------- taxonomy


TERMS = ["the", "and", "idiot", "und", "que", "le", "zzz"]
_terms_sql = f"(SELECT unnest({TERMS!r}) AS term)"


def _doc_terms(spark, sf):
    return dealt(t(spark, sf, "documents")).select(F.col("doc_id").alias("doc"), F.col("source").alias("family"), F.array_intersect(text.search_tokens("text"), F.array(*map(F.lit, TERMS))).alias("terms"))


_DT = f"WITH d AS (SELECT doc_id, source AS family, list_intersect(list_distinct({tok('text')}), {TERMS!r}) AS terms FROM documents), x AS (SELECT doc_id, family, unnest(terms) AS term FROM d), i AS (SELECT term, count(x.term) AS df, ln((SELECT count(*) FROM d) / greatest(count(x.term), 1)) AS idf FROM {_terms_sql} LEFT JOIN x USING (term) GROUP BY 1)"


@query(f"{_DT} SELECT term, df, round(idf, 9) AS idf FROM i")
def term_df_idf(spark, sf):
    terms = spark.createDataFrame([(x,) for x in TERMS], "term string")
    return taxonomy.idf(_doc_terms(spark, sf), terms).withColumn("idf", F.round("idf", 9))


_PV = f"{_DT}, p AS (SELECT x.family, x.term, count(*) / (SELECT count(*) FROM d d2 WHERE d2.family = x.family) * any_value(idf) AS weight FROM x JOIN i USING (term) GROUP BY 1, 2)"


@query(f"{_PV} SELECT family, term, round(weight, 9) AS weight FROM p")
def presence_vector(spark, sf):
    terms = spark.createDataFrame([(x,) for x in TERMS], "term string")
    d = _doc_terms(spark, sf)
    return taxonomy.presence(d, taxonomy.idf(d, terms)).withColumn("weight", F.round("weight", 9))


@query(f"{_PV}, n AS (SELECT family, sqrt(sum(weight * weight)) AS norm FROM p GROUP BY 1) SELECT a.family AS a, b.family AS b, round(CASE WHEN a.family = b.family THEN 1.0 ELSE greatest(coalesce((SELECT sum(x.weight * y.weight) FROM p x JOIN p y USING (term) WHERE x.family = a.family AND y.family = b.family), 0) / (a.norm * b.norm), 0.1) END, 8) AS affinity FROM n a, n b")
def family_cosine(spark, sf):
    terms = spark.createDataFrame([(x,) for x in TERMS], "term string")
    d = _doc_terms(spark, sf)
    return taxonomy.cosine(taxonomy.presence(d, taxonomy.idf(d, terms)), 0.1).withColumn("affinity", F.round("affinity", 8))


PART_FAMILIES = {"metal": ["steel", "ring", "bolt"], "colour": ["red", "blue", "green"], "size": ["small", "large"]}


@query("""WITH h AS (SELECT p_partkey, f, ord, count(*) AS hits, min(pos) AS early FROM (
  SELECT p_partkey, f, ord, instr(' ' || p_name || ' ', ' ' || w || ' ') AS pos FROM part, (VALUES ('metal', 0, 'steel'), ('metal', 0, 'ring'), ('metal', 0, 'bolt'), ('colour', 1, 'red'), ('colour', 1, 'blue'), ('colour', 1, 'green'), ('size', 2, 'small'), ('size', 2, 'large')) v(f, ord, w)) WHERE pos > 0 GROUP BY 1, 2, 3)
SELECT p.p_partkey, (SELECT f FROM h WHERE h.p_partkey = p.p_partkey ORDER BY hits DESC, early, ord LIMIT 1) AS family FROM part p""")
def family_classify(spark, sf):
    return t(spark, sf, "part").select("p_partkey", taxonomy.family_of("p_name", PART_FAMILIES).alias("family"))


@query("SELECT p_partkey, CASE WHEN p_size <= 2 THEN 'junior' WHEN p_size <= 5 THEN 'mid' ELSE 'senior' END AS seniority, CASE WHEN p_size IS NULL THEN 'Unspecified' WHEN p_size >= 9 THEN '9+' ELSE CAST(greatest(p_size, 1) AS VARCHAR) END AS bucket FROM part")
def seniority_case(spark, sf):
    return t(spark, sf, "part").select("p_partkey", rules.seniority("p_name", "p_size").alias("seniority"), rules.years_bucket("p_size").alias("bucket"))


@query("SELECT regexp_replace(trim(regexp_replace(lower(substr(text, 1, 60)), '[^\\p{L}\\p{N}_ ]', ' ', 'g')), '\\s+', ' ', 'g') AS title, count(*) AS n FROM documents GROUP BY 1")
def title_frequency(spark, sf):
    return described(spark, sf).groupBy(text.title_key(F.coalesce("title", F.lit(""))).alias("title")).agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- scoring


@query("""SELECT l_orderkey AS id, CAST(round_even(100.0 * sum(CASE WHEN l_returnflag = 'R' THEN 1.0 WHEN l_returnflag = 'A' THEN 0.7 ELSE 0.3 END * l_quantity) / sum(l_quantity), 0) AS INT) AS coverage, count(*) FILTER (l_linestatus = 'F') AS unmet FROM lineitem GROUP BY 1""")
def weighted_coverage(spark, sf):
    name = F.when(F.col("l_returnflag") == "R", "strong").when(F.col("l_returnflag") == "A", "medium").otherwise("weak")
    place = F.struct("_metadata.file_path", "_metadata.row_index")
    rows = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_quantity").alias("weight"), scoring.strength_weight(name).alias("strength"), "l_linestatus", place.alias("place"))
    return rows.groupBy("id").agg(scoring.coverage(F.col("weight"), F.col("strength"), F.col("place")).alias("coverage"), F.count_if(F.col("l_linestatus") == "F").alias("unmet"))


_SC = """WITH x AS (SELECT l_orderkey AS id, CAST(max(l_quantity) * 2 AS INT) AS s, CAST(count(*) FILTER (l_linestatus = 'F') AS INT) AS unmet, CAST(count(*) FILTER (l_returnflag = 'N') AS INT) AS missing, CAST(max(l_linenumber) - 4 AS INT) AS gap FROM lineitem GROUP BY 1),
g AS (SELECT *, greatest(0, least(100, s, CASE WHEN unmet > 0 THEN 45 ELSE 100 END, CASE WHEN missing >= 2 THEN 55 ELSE 100 END, CASE WHEN abs(gap) >= 2 THEN 50 ELSE 100 END)) AS gated FROM x)
SELECT id, CAST(gated AS INT) AS gated, CAST(greatest(0, 100 - 30 * abs(gap)) AS INT) AS seniority_fit, CASE WHEN gated >= 85 THEN 'strong match' WHEN gated >= 70 THEN 'good match' WHEN gated >= 50 THEN 'partial match' WHEN gated >= 30 THEN 'weak match' ELSE 'not a fit' END AS band FROM g"""


@query(_SC)
def gates_and_bands(spark, sf):
    x = t(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg((F.max("l_quantity") * 2).cast("int").alias("s"), F.count_if(F.col("l_linestatus") == "F").cast("int").alias("unmet"), F.count_if(F.col("l_returnflag") == "N").cast("int").alias("missing"), (F.max("l_linenumber") - 4).cast("int").alias("gap"))
    x = x.withColumn("gated", scoring.gates(F.col("s"), F.col("unmet"), F.col("missing"), F.col("gap")).cast("int"))
    return x.select("id", "gated", scoring.seniority_fit(F.col("gap")).cast("int").alias("seniority_fit"), scoring.band("gated").alias("band"))


@query("SELECT o_custkey AS profile_id, o_orderpriority AS family, round(sum(greatest(1.0, 0.5) * greatest(0.0, 1 - (2003 - year(o_orderdate)) / 6.0)), 9) AS w FROM orders GROUP BY 1, 2 HAVING w > 0")
def recency_decay(spark, sf):
    rows = t(spark, sf, "orders").select(F.col("o_custkey").alias("profile_id"), F.col("o_orderpriority").alias("family"), F.year("o_orderdate").alias("end"))
    return rows.groupBy("profile_id", "family").agg(F.round(F.sum(scoring.role_weight(F.col("end") - 1, F.col("end"), 2003)), 9).alias("w")).where("w > 0")


@query("WITH x AS (SELECT d.source AS profile_id, d.n_chars AS score, l.quality AS fit, d.doc_id AS id, count(*) OVER (PARTITION BY d.source) AS n, row_number() OVER (PARTITION BY d.source ORDER BY d.n_chars DESC, d.doc_id) AS r FROM documents d JOIN labels l USING (doc_id)) SELECT round(avg(p), 9) AS precision_at_10 FROM (SELECT profile_id, avg(fit) AS p FROM x WHERE n >= 10 AND r <= 10 GROUP BY 1)")
def precision_at_k(spark, sf):
    rows = t(spark, sf, "documents").join(t(spark, sf, "labels"), "doc_id").select(F.col("source").alias("profile_id"), F.col("n_chars").alias("score"), F.col("quality").alias("fit"), F.col("doc_id").alias("id"))
    return scoring.precision_at(rows, 10).select(F.round("precision_at_10", 9).alias("precision_at_10"))


@query("SELECT l_orderkey AS job_id, CAST(l_linenumber AS VARCHAR) AS profile_id, l_quantity * 2 AS score FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, CAST(l_linenumber AS VARCHAR)) = 1")
def best_profile(spark, sf):
    return scoring.best_profile(scores(spark, sf))


@query()
def extract_requirements(spark, sf):
    rows = described(spark, sf, True).select("id", "title", F.concat(F.lit("Requirements: "), "description").alias("description"))
    return scoring.extract(rows).select("id", F.size("requirements").alias("n"), "years_required", "seniority", "family")


@query()
def score_jobs(spark, sf):
    p = spark.createDataFrame([("p1", "backend", {"backend": 1.0}, "senior", 7, ["BSc"], [], ["English"], [], ["the and of with services"], 80, [("python", "strong", 1)])], "profile_id string, family string, families map<string,double>, seniority string, years int, education array<string>, certifications array<string>, languages array<string>, places array<string>, roles array<string>, evidence int, skills array<struct<canonical:string,strength:string,recency:int>>")
    matrix = spark.createDataFrame([("backend", "backend", 1.0)], "a string, b string, affinity double")
    texts = described(spark, sf, True).select("id", "title", F.concat(F.lit("Requirements: "), "description").alias("description"))
    rows = maintained(spark, sf, "requirements", lambda: scoring.extract(texts))
    return scoring.score_jobs(rows, p, spark.createDataFrame([("python", 2.0)], "term string, idf double"), matrix)


@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL),
x AS (SELECT a.vec_id AS query_id, b.vec_id, round(list_cosine_similarity(a.v, b.v), 6) AS score FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0)
SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC NULLS LAST, vec_id) <= 5""")
def embedding_cosine_search(spark, sf):
    """The five nearest of all vectors for every vector whose id is divisible by 20."""
    e = t(spark, sf, "embeddings").select("vec_id", "embedding")
    return export.cosine_topk(e.where("vec_id % 20 = 0"), e)


# ---------------------------------------------------------------- state


def _runs(spark, sf):
    """Users as companies, thousands of their values as ids: what they had in the first half of the month, and a run over the second."""
    e = t(spark, sf, "events").select(F.col("user_id").alias("company_id"), F.floor(F.col("value")).cast("long").alias("id"), F.col("event_type").alias("title"), (F.dayofmonth("ts") <= 15).alias("early"))
    ids = e.groupBy("company_id", "id", "early").agg(F.min("title").alias("title"))
    old = ids.where("early").select("company_id", "id", "title", F.when(F.col("title") == "error", "closed").otherwise("new").alias("status"), *(F.lit("2024-01-01").alias(x) for x in ("first_seen", "last_seen")), *(F.lit(None).cast("string").alias(x) for x in ("closed_at", "closed_reason")))
    now = ids.where("not early").select("company_id", "id", "title")
    return old, now, now.select("company_id").distinct().select("company_id", F.lit("2024-01-16").alias("now"), (F.col("company_id") % 2 == 0).alias("may_close"))


@query("""WITH e AS (SELECT user_id AS company_id, CAST(floor(value) AS BIGINT) AS id, event_type AS title, day(ts) <= 15 AS early FROM events), i AS (SELECT company_id, id, early, min(title) AS title FROM e GROUP BY 1, 2, 3),
o AS (SELECT company_id, id, CASE WHEN title = 'error' THEN 'closed' ELSE 'new' END AS status FROM i WHERE early), n AS (SELECT company_id, id FROM i WHERE NOT early), r AS (SELECT DISTINCT company_id, company_id % 2 = 0 AS may_close FROM n)
SELECT company_id, id, CASE WHEN o.status IS NULL THEN 'new' WHEN n.id IS NOT NULL AND o.status IN ('new', 'closed') THEN 'seen' WHEN n.id IS NULL AND coalesce(may_close, false) AND o.status <> 'closed' THEN 'closed' ELSE o.status END AS status,
CASE WHEN o.status IS NULL THEN 'new' WHEN n.id IS NOT NULL AND o.status = 'closed' THEN 'reopened' WHEN n.id IS NOT NULL THEN 'seen' WHEN coalesce(may_close, false) AND o.status <> 'closed' THEN 'closed' ELSE 'kept' END AS change
FROM (SELECT *, id AS oid FROM o) o FULL JOIN (SELECT *, id AS nid FROM n) n USING (company_id, id) LEFT JOIN r USING (company_id)""")
def scrape_diff(spark, sf):
    return jobs.diff(*_runs(spark, sf)).select("company_id", "id", "status", "change")


@query("WITH d AS (SELECT doc_id AS id, lang AS company_id, md5(text) AS k, CASE WHEN doc_id % 2 = 0 THEN 'closed' ELSE 'new' END AS status FROM documents WHERE text IS NOT NULL), o AS (SELECT company_id, k, min(id) AS open_sibling_id FROM d WHERE status <> 'closed' GROUP BY 1, 2) SELECT id, company_id, open_sibling_id FROM d JOIN o USING (company_id, k) WHERE status = 'closed'")
def duplicate_closed(spark, sf):
    rows = described(spark, sf).withColumns({"company_id": F.col("source_language"), "status": F.when(F.col("id") % 2 == 0, "closed").otherwise("new")})
    return jobs.duplicate_closed(rows, F.md5(F.col("description").cast("binary"))).select("id", "company_id", "open_sibling_id")


@query("SELECT doc_id, source, md5(text) AS k FROM documents QUALIFY row_number() OVER (PARTITION BY md5(text) ORDER BY (source = 'src0') DESC, doc_id) = 1")
def prefer_dedupe(spark, sf):
    rows = t(spark, sf, "documents").select("doc_id", "source", F.md5(F.col("text").cast("binary")).alias("k"))
    return jobs.prefer(rows, ["k"], (F.col("source") == "src0").desc(), F.col("doc_id"))


@query("SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1")
def first_wins(spark, sf):
    return jobs.prefer(t(spark, sf, "events").select("user_id", "event_type", "event_id", "ts"), ["user_id", "event_type"], F.col("ts"), F.col("event_id")).select("user_id", "event_type", "event_id")


@query("SELECT d.doc_id AS id FROM documents d WHERE d.n_chars < 500 AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def anti_protected(spark, sf):
    doomed = t(spark, sf, "documents").where("n_chars < 500").select(F.col("doc_id").alias("id"))
    return jobs.purge(doomed, t(spark, sf, "labels").select(F.col("doc_id").alias("job_id")))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' AND o_totalprice > 300000 THEN 'seen' WHEN o_orderstatus = 'F' THEN 'closed' WHEN o_orderstatus = 'O' THEN 'new' ELSE 'seen' END AS status FROM orders")
def reopen(spark, sf):
    rows = postings(spark, sf).withColumns({"url": F.concat(F.lit("https://x.example/jobs/"), F.col("id").cast("string"), F.lit("?utm_source=a")), "closed_at": F.lit(None).cast("string"), "closed_reason": F.lit(None).cast("string"), "last_seen": F.lit("1999-01-01")})
    live = rows.where("price > 300000").select(F.concat(F.lit("https://x.example/jobs/"), F.col("id").cast("string"), F.lit("/#top")).alias("url"))
    return jobs.reopen_by_url(rows, live, "2000-01-01").select("id", "status")


@query("SELECT l_orderkey AS job_id, CAST(l_linenumber AS VARCHAR) AS profile_id, l_quantity * 2 AS score FROM lineitem WHERE l_linenumber IN (1, 2)")
def prune_scores(spark, sf):
    return jobs.prune_scores(scores(spark, sf), ["1", "2"])


@query("WITH x AS (SELECT *, count(*) OVER (PARTITION BY o_custkey) AS n, min(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey) AS a FROM orders) SELECT o_orderkey AS id FROM x WHERE o_orderstatus <> 'F' OR (a = 1 AND n > 1)")
def never_empty(spark, sf):
    return jobs.never_empty(postings(spark, sf), F.col("status") == "closed").select("id")


@query("SELECT o_orderkey AS id FROM orders WHERE date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-12-31') <= 30 AND o_orderdate <= DATE '1998-12-31'")
def posted_within(spark, sf):
    rows = postings(spark, sf).where("posted_at <= '1998-12-31'")
    return rows.where(S.posted_within(30, "1998-12-31")).select("id")


@query("SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_counts(spark, sf):
    return runs.posting_counts(t(spark, sf, "events")).withColumn("day", F.col("day").cast("timestamp_ntz"))


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id, min(ts) AS begin, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def visit_sessions(spark, sf):
    return runs.visits(t(spark, sf, "events")).withColumns({"begin": F.col("begin").cast("timestamp_ntz"), "end": F.col("end").cast("timestamp_ntz")})


# ---------------------------------------------------------------- pages


@query("SELECT page_id, rtrim(regexp_extract(url, '^([^?#]*)', 1), '/') || CASE WHEN len(k) > 0 THEN '?' || array_to_string(k, '&') ELSE '' END AS identity FROM (SELECT page_id, url, list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(lower(x), '^(t|_t|ts|_ts|timestamp|cache|_cache|cb|nocache|v|_v|utm_source|utm_medium|utm_campaign|utm_term|utm_content|gclid|fbclid)(=|$)')) AS k FROM pages)")
def url_identity(spark, sf):
    return t(spark, sf, "pages").select("page_id", urls.normalize_job_url("url").alias("identity"))


@query("WITH h AS (SELECT DISTINCT regexp_replace(lower(regexp_extract(url, '^https?://([^/?#]+)', 1)), '^www\\.', '') AS key, page_id % 7 AS id FROM pages) SELECT key, min(id) AS owner FROM h GROUP BY 1 HAVING count(DISTINCT id) = 1")
def host_exclusive(spark, sf):
    rows = t(spark, sf, "pages").select((F.col("page_id") % 7).alias("id"), "url")
    return jobs.exclusive_owner(rows, urls.host("url"))


@query("SELECT regexp_extract(href, '^/([^/?#]*)', 1) AS label, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS href FROM pages) GROUP BY 1")
def nav_links(spark, sf):
    a = t(spark, sf, "pages").select(F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), 1)).alias("href"))
    return a.groupBy(F.regexp_extract("href", "^/([^/?#]*)", 1).alias("label")).agg(F.count("*").alias("n"))


@query(f"""WITH w AS (SELECT source AS c, doc_id AS id, list_sort(list_distinct({tok('text')})) AS w, substr(text, 1, 300) AS head FROM documents WHERE source IS NOT NULL),
r AS (SELECT c, w, min(id) AS id FROM w WHERE len(w) > 0 GROUP BY 1, 2), h AS (SELECT c, head, min(id) AS id FROM w WHERE head IS NOT NULL GROUP BY 1, 2)
SELECT w.c AS company_id, 'words' AS kind, r.id AS a, w.id AS b FROM w JOIN r ON w.c = r.c AND w.w = r.w WHERE w.id <> r.id
UNION ALL SELECT w.c, 'head', h.id, w.id FROM w JOIN h ON w.c = h.c AND w.head = h.head WHERE w.id <> h.id
UNION ALL SELECT x.c, 'like', x.id, y.id FROM r x JOIN r y ON x.c = y.c AND x.id < y.id AND least(len(x.w), len(y.w)) >= 0.8 * greatest(len(x.w), len(y.w))
  WHERE len(list_intersect(x.w, y.w)) >= 0.8 * (len(x.w) + len(y.w) - len(list_intersect(x.w, y.w)))""")
def jaccard_documents(spark, sf):
    """Copies and near-copies among all documents of a source, at the audit's threshold."""
    return export.similar_classes(described(spark, sf, True).select("company_id", "id", F.col("description").alias("text")))


@query()
def fuzzy_title(spark, sf):
    p = t(spark, sf, "part").select("p_name").distinct()
    return p.select("p_name", text.sequence_ratio(F.col("p_name"), F.lit("small red ring")).alias("ratio")).where("ratio >= 0.75")


# ---------------------------------------------------------------- titles, places and repairs


@query("SELECT p_partkey, p_name AS title, 'Tel Aviv' AS location, 'Full-time' AS employment_type FROM part")
def card_titles(spark, sf):
    return dealt(t(spark, sf, "part")).select("p_partkey", titles.card(F.concat("p_name", F.lit(" Full-time Tel Aviv"))).alias("c")).select("p_partkey", "c.*")


@query("SELECT p_partkey, CASE WHEN length(p_name) >= 8 THEN p_name END AS title FROM part")
def page_titles(spark, sf):
    page = F.concat(F.lit("<title>"), "p_name", F.lit(" | Acme</title><h1>Careers</h1>"))
    return dealt(t(spark, sf, "part")).select("p_partkey", titles.authoritative(titles.detail_titles(page), F.concat("p_name", F.lit(" Remote"))).alias("title"))


@query(f"SELECT n_nationkey, CASE WHEN lower(n_name) IN ({', '.join(repr(x) for x in V.COUNTRIES)}) THEN n_name ELSE 'Haifa' END AS location, CASE WHEN lower(n_name) IN ({', '.join(repr(x) for x in V.COUNTRIES)}) THEN NULL ELSE 'Haifa' END AS city, false AS is_remote FROM nation")
def location_cascade(spark, sf):
    none = F.lit(None).cast("string")
    return t(spark, sf, "nation").select("n_nationkey", titles.infer_location("n_name", F.lit(""), none, F.lit("Haifa"), none).alias("x")).select("n_nationkey", "x.*")


_NAV = "CASE o_orderkey % 3 WHEN 0 THEN 'About Us' WHEN 1 THEN 'Backend Engineer' ELSE 'Careers' END"


@query(f"SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 <> 1 OR o_orderstatus = 'F' THEN 'closed' WHEN o_orderstatus = 'O' THEN 'new' ELSE 'seen' END AS status, CASE WHEN o_orderkey % 3 <> 1 AND o_orderstatus <> 'F' THEN 'not a job: site navigation' END AS closed_reason FROM orders")
def close_navigation(spark, sf):
    rows = postings(spark, sf).withColumns({"title": F.expr(_NAV.replace("o_orderkey", "id")), "closed_at": F.lit(None).cast("string"), "closed_reason": F.lit(None).cast("string")})
    return repairs.close_navigation(rows, "1999-01-01").select("id", "status", "closed_reason")


@query("SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN p_name || ', London' ELSE p_name END AS title, CASE WHEN p_size % 2 = 0 THEN 'London' WHEN p_size % 3 = 0 THEN NULL ELSE 'Haifa' END AS location, CASE WHEN p_size % 2 = 0 THEN NULL ELSE 'Haifa' END AS city FROM part")
def fix_locations(spark, sf):
    rows = t(spark, sf, "part").selectExpr("p_partkey as id", "CASE WHEN p_size % 2 = 0 THEN p_name || ', London' ELSE p_name END AS title", "CASE WHEN p_size % 3 = 0 THEN 'NaN' ELSE 'Haifa' END AS location", "'Haifa' AS city")
    return repairs.fix_locations(rows)


@query("SELECT CASE WHEN page_id % 5 = 0 THEN 'broken' WHEN page_id % 5 = 1 THEN 'blocked' WHEN page_id % 5 = 2 THEN 'error' ELSE 'ok' END AS url_class, count(*) AS n FROM (SELECT url, min(page_id) AS page_id FROM pages GROUP BY 1) GROUP BY 1")
def url_audit(spark, sf):
    p = t(spark, sf, "pages").groupBy("url").agg(F.min("page_id").alias("page_id"))
    status = F.expr("CASE page_id % 5 WHEN 0 THEN 404 WHEN 1 THEN 429 WHEN 2 THEN 500 ELSE 200 END").alias("status")
    rows = p.select(F.col("page_id").alias("id"), "url", F.lit("new").alias("status"), *(F.lit(None).cast("string").alias(x) for x in ("closed_at", "closed_reason")))
    return repairs.url_audit(rows, p.select("url", status), "now")[1]


# ---------------------------------------------------------------- reports


@query("SELECT count(*) AS total, count(DISTINCT c_mktsegment) AS departments, count(c_mktsegment) AS filled FROM customer")
def department_coverage(spark, sf):
    return reports.department_coverage(t(spark, sf, "customer").select(F.col("c_mktsegment").alias("department")))


@query("WITH f AS (SELECT coalesce(lang, '(unknown)') AS family, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM documents) SELECT family, count(*) AS n, round(100 * count(*) / (SELECT count(*) FROM documents), 1) AS pct, string_agg(CASE WHEN r <= 20 THEN doc_id::VARCHAR END, ',' ORDER BY doc_id) AS samples FROM f GROUP BY 1")
def family_report(spark, sf):
    rows = t(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").cast("string").alias("title"), F.col("lang").alias("family"))
    return reports.family_report(rows).withColumn("samples", F.array_join("samples", ","))


@query("SELECT count(*) FILTER (user_id % 3 = 0) AS checked, count(*) FILTER (user_id % 3 = 1) AS skipped, count(*) FILTER (user_id % 3 = 2) AS failures, count(*) FILTER (event_type = 'click')::BIGINT AS new, count(*) FILTER (event_type = 'error')::BIGINT AS closed FROM events")
def run_stats(spark, sf):
    e = t(spark, sf, "events").select(F.col("user_id").alias("company_id"), F.expr("CASE user_id % 3 WHEN 0 THEN 'checked' WHEN 1 THEN 'skipped' ELSE 'failed' END").alias("outcome"), (F.col("event_type") == "click").cast("int").alias("new"), (F.col("event_type") == "error").cast("int").alias("closed"))
    return reports.run_stats(e)


@query("WITH x AS (SELECT p_brand AS company_id, 'greenhouse:b' || (p_size % 3) AS board, count(*) AS n FROM part GROUP BY ALL) SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY n DESC, board) = 1")
def best_board(spark, sf):
    return reports.best_board(t(spark, sf, "part").selectExpr("p_brand AS company_id", "concat('https://boards.greenhouse.io/b', p_size % 3, '/jobs/', p_partkey) AS url"))


@query("SELECT s_nationkey AS company_id, count(*) AS n, round(avg(CASE WHEN s_suppkey % 7 = 0 THEN 1 ELSE 0 END), 9) AS evident, round(avg(CASE WHEN s_suppkey % 4 = 0 THEN 1 ELSE 0 END), 9) AS hinted, avg(CASE WHEN s_suppkey % 7 = 0 THEN 1 ELSE 0 END) >= 0.3 OR avg(CASE WHEN s_suppkey % 4 = 0 THEN 1 ELSE 0 END) >= 0.3 AS healthy FROM supplier GROUP BY 1")
def healthy_listings(spark, sf):
    rows = t(spark, sf, "supplier").selectExpr("s_nationkey AS company_id", "s_suppkey % 7 = 0 AS evident", "false AS trusted", "CASE WHEN s_suppkey % 4 = 0 THEN 'https://x.io/careers/a' ELSE 'https://x.io/a' END AS url")
    return reports.healthy(rows).withColumns({"evident": F.round("evident", 9), "hinted": F.round("hinted", 9)})


@query("SELECT event_type AS node, user_id % 3 AS model, count(*) AS calls, sum(event_id % 10)::BIGINT AS tokens_in, sum(event_id % 7)::BIGINT AS tokens_out, sum(event_id % 5)::BIGINT AS seconds FROM events GROUP BY 1, 2")
def cost_summary(spark, sf):
    return reports.cost_summary(t(spark, sf, "events").selectExpr("event_type AS node", "user_id % 3 AS model", "event_id % 10 AS tokens_in", "event_id % 7 AS tokens_out", "event_id % 5 AS seconds"))


@query("SELECT 'host' AS kind, regexp_replace(lower(regexp_extract(url, '^https?://([^/?#]+)', 1)), '^www\\.', '') AS key, count(DISTINCT page_id) AS ids FROM pages GROUP BY 2 HAVING count(DISTINCT page_id) > 1")
def duplicate_hosts(spark, sf):
    return reports.duplicate_keys(t(spark, sf, "pages").select(F.col("page_id").alias("id"), F.lit("").alias("display_name"), F.col("url").alias("career_url")))


@query(r"WITH s AS (SELECT source AS company_id, doc_id AS id, regexp_replace(trim(regexp_extract(coalesce(text, '') || chr(10) || 'Pays $' || doc_id || ' a year.', '[^.\n]*(?:[$€£₪]|USD|ILS|NIS)\s?\d[\d,.]*[^.\n]*')), '\.+$', '') AS snippet FROM documents) SELECT * FROM s WHERE snippet <> '' QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY id) <= 5")
def salary_snippets(spark, sf):
    rows = described(spark, sf, True).withColumn("description", F.concat(F.coalesce("description", F.lit("")), F.lit("\nPays $"), F.col("id").cast("string"), F.lit(" a year.")))
    return reports.salary_snippets(rows)


@query("SELECT p_partkey, regexp_replace(p_name, '(?i)(small|red)', '<mark>\\1</mark>', 'g') AS shown FROM part")
def highlighted(spark, sf):
    return t(spark, sf, "part").select("p_partkey", reports.highlight("p_name", "red small x").alias("shown"))


@query("WITH b AS (SELECT l_orderkey AS id, max(l_quantity * 2) AS best FROM lineitem GROUP BY 1) SELECT o_orderkey AS id, coalesce(best, 0) AS best FROM orders LEFT JOIN b ON b.id = o_orderkey WHERE o_orderstatus <> 'F' AND o_orderkey % 2 = 0 AND coalesce(best, 0) >= 40")
def ranked_at_host(spark, sf):
    rows = postings(spark, sf).withColumn("url", F.expr("CASE WHEN id % 2 = 0 THEN 'https://www.Example.com/x' ELSE 'https://other.io' END"))
    return reports.ranked_at(rows, scores(spark, sf), "example.com", 40).select("id", "best")


# ---------------------------------------------------------------- sources in pages, and profiles


@query("SELECT c_custkey, replace(lower(c_name), '#', '') AS a FROM (SELECT c_custkey, regexp_replace(lower(c_name), '[^a-z0-9]', '', 'g') AS c_name FROM customer)")
def board_slugs(spark, sf):
    return t(spark, sf, "customer").select("c_custkey", F.get(retail.slugs("c_name"), F.lit(0)).alias("a"))


@query("""WITH x AS (SELECT item_id AS page_id, 'lever' AS provider, 'acme' AS board, item_id % 3 + 1 AS n FROM benchmark UNION ALL SELECT item_id, 'greenhouse', 'acmesecurity', 2 FROM benchmark WHERE item_id % 2 = 0 UNION ALL SELECT item_id, 'greenhouse', 'partner', 5 FROM benchmark WHERE item_id % 5 = 0)
SELECT *, (row_number() OVER (PARTITION BY page_id ORDER BY n DESC, provider, board))::INT AS place FROM x""")
def embedded_boards(spark, sf):
    k = F.col("item_id")
    html = F.concat("text", F.repeat(F.lit('<a href="https://jobs.lever.co/acme/1"></a>'), (k % 3 + 1).cast("int")), F.when(k % 2 == 0, r'"https:\/\/boards.greenhouse.io\/acmesecurity" //boards.greenhouse.io/acmesecurity').otherwise(""), F.repeat(F.lit('<a href="https://boards.greenhouse.io/partner">p</a>'), 5))
    rows = t(spark, sf, "benchmark").select(k.alias("page_id"), html.alias("html"), F.when(k % 5 == 0, "").otherwise("acme-security").alias("hint"))
    return inlined.embedded_boards(rows).withColumn("n", F.col("n").cast("long"))


@query("SELECT c_custkey AS profile_id, 'backend' AS family, 2026 - (2010 + c_custkey % 15) AS years, CASE WHEN 2026 - (2010 + c_custkey % 15) <= 2 THEN 'junior' WHEN 2026 - (2010 + c_custkey % 15) <= 5 THEN 'mid' ELSE 'senior' END AS seniority, 75 AS evidence FROM customer")
def cv_profiles(spark, sf):
    body = F.concat(F.lit("Experience\nBackend Engineer | "), "c_name", F.lit(" | "), (2010 + F.col("c_custkey") % 15).cast("string"), F.lit(" - present\n- Designed Kafka services\n- Wrote text\nSkills: Python\n"))
    idf = spark.createDataFrame([("kafka", 7.0)], "term string, idf double")
    return cv.profiles(dealt(t(spark, sf, "customer")).select(F.col("c_custkey").alias("profile_id"), body.alias("text")), idf, 2026).select("profile_id", "family", "years", "seniority", "evidence")


def _labelled(spark, sf):
    d = t(spark, sf, "documents").join(t(spark, sf, "labels"), "doc_id")
    part = lambda k: (F.col("doc_id") % k).cast("int")
    clashes = F.array().cast("array<struct<affinity:double,weight:double>>")
    return d.select(F.col("doc_id").alias("id"), F.col("source").alias("profile_id"), part(101).alias("must"), part(71).alias("senior"), part(53).alias("nice"), part(97).alias("evidence"), (part(3) == 0).alias("signature"), clashes.alias("clashes"), F.lit(0).alias("unmet"), part(2).alias("missing"), part(3).alias("gap"), (F.col("doc_id") % 10 / 10).alias("fit"), F.when(F.col("quality") == 1, "fit").otherwise("not_fit").alias("label"), *(F.lit(None).cast("int").alias(x) for x in ("min_score", "max_score")))


@query()
def weight_search(spark, sf):
    return tuning.evaluate(_labelled(spark, sf), tuning.trials(spark, 50))


@query()
def weight_search_best(spark, sf):
    """The best of all 500 trials."""
    return tuning.search(_labelled(spark, sf))


# ---------------------------------------------------------------- companies


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN c_custkey END AS company_id, CASE WHEN s_suppkey % 2 = 0 AND c_custkey IS NOT NULL THEN 'key' END AS matched_by FROM supplier LEFT JOIN customer ON c_custkey = s_suppkey")
def registry_match(spark, sf):
    known = companies(spark, sf).withColumn("career_url", F.lit(None).cast("string"))
    wanted = t(spark, sf, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 2 == 0, F.format_string("Customer#%09d Ltd.", "s_suppkey")).otherwise(F.col("s_name")).alias("name"), F.lit(None).cast("string").alias("career_url"))
    return C.resolve(wanted, known).select("s_suppkey", "company_id", "matched_by")


@query("SELECT o_custkey AS company_id, o_orderkey AS id FROM orders QUALIFY o_orderpriority = min(o_orderpriority) OVER (PARTITION BY o_custkey)")
def first_source(spark, sf):
    return C.first_source(postings(spark, sf).select("company_id", "id", "title"), "title").select("company_id", "id")


@query("WITH x AS (SELECT user_id AS company_id, CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 ELSE 2 END AS place, event_type AS strategy, max(value) > 60 AS healthy FROM events GROUP BY ALL) SELECT company_id, coalesce((min({'p': place, 's': strategy}) FILTER (healthy)).s, min({'p': place, 's': strategy}).s) AS strategy FROM x GROUP BY 1")
def strategy_fallback(spark, sf):
    e = t(spark, sf, "events").selectExpr("user_id AS company_id", "CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 ELSE 2 END AS place", "event_type AS strategy", "value")
    return C.with_fallback(e.groupBy("company_id", "place", "strategy").agg((F.max("value") > 60).alias("healthy")).withColumn("failed", F.lit(False)))


@query("SELECT p_partkey AS company_id, CASE p_size % 3 WHEN 0 THEN 'techmap_only' WHEN 1 THEN 'ats_api' ELSE 'html_listing' END AS kind, CASE WHEN p_size % 3 = 1 THEN 'lever:acme' END AS board FROM part")
def synthesized_plans(spark, sf):
    return C.synthesize(t(spark, sf, "part").selectExpr("p_partkey AS id", "CASE p_size % 3 WHEN 0 THEN '' WHEN 1 THEN 'https://jobs.lever.co/Acme' ELSE 'https://acme.io/careers' END AS career_url"))
