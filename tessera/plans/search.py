"""Faceted search over postings: one filter builder that list, facets and export share."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace
from functools import reduce
from urllib.parse import parse_qsl, urlencode

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.text import excluded, matches, query_terms
from tessera.plans import index
from tessera.schemas import FLAGS

MOST_PER_DIMENSION, SNIPPET = 250, 320
#: Dimension, filter that it ignores of itself, value, label.
DIMENSIONS = (("company", "company_id", "company_id", "display_name"), ("city", "city", "city", "city"), ("department", "department", "department", "department"), ("industry", "industry", "industry", "industry"), ("language", "language", "source_language", "source_language"))


def csv(value: str | None) -> list[str]:
    return [x.strip() for x in (value or "").split(",") if x.strip()]


@dataclass(frozen=True)
class Filters:
    """What a request may ask for; None does not care."""

    q: str | None = None
    scope: str = "all"
    exclude: str | None = None
    company_id: str | None = None
    exclude_company_id: str | None = None
    city: str | None = None
    department: str | None = None
    industry: str | None = None
    language: str | None = None
    status: str | None = None
    is_remote: bool | None = None
    is_referral: bool | None = None
    has_description: bool | None = None
    max_years: int | None = None
    posted_after: str | None = None
    liked: bool | None = None
    hidden: bool | None = None
    sent: bool | None = None
    reached_out: bool | None = None
    has_connection: bool | None = None
    min_score: float | None = None
    profile: str = "best"

    def encode(self) -> str:
        """As a URL query: defaults left out, false kept where it differs from not caring."""
        return urlencode({f.name: str(v).lower() if isinstance(v, bool) else v for f in fields(self) if (v := getattr(self, f.name)) != f.default and v != ""})

    @classmethod
    def decode(cls, query: str) -> Filters:
        """From a URL query; what is unknown or malformed is ignored."""
        kinds, out = {f.name: str(f.type) for f in fields(cls)}, {}
        for k, v in parse_qsl(query):
            kind = kinds.get(k, "")
            try:
                if kind.startswith("bool") and v in ("true", "false"):
                    out[k] = v == "true"
                elif kind.startswith("int"):
                    out[k] = int(v)
                elif kind.startswith("float"):
                    out[k] = float(v)
                elif kind.startswith("str"):
                    out[k] = v
            except ValueError:
                continue
        return cls(**out)


def best_scores(scores: DataFrame) -> DataFrame:
    """(id, best_score): a table that is kept, so that a request does not aggregate all scores."""
    return scores.groupBy(F.col("job_id").alias("id")).agg(F.max("score").alias("best_score"))


def joined(jobs: DataFrame, companies: DataFrame, state: DataFrame | None, scores: DataFrame | None, profile: str = "best", best: DataFrame | None = None) -> DataFrame:
    """Postings with their company's columns, sparse flags (missing: false) and best_score (null: unscored).

    Scores are aggregated before the join, or come as the kept table ``best``, so a posting stays one row; sizes decide how
    each join runs."""
    own = [x for x in ("display_name", "industry", "connection_count", "size") if x in companies.columns]
    out = jobs.join(companies.select(F.col("id").alias("company_id"), *own), "company_id")
    if state is not None:
        out = out.join(state.select(F.col("job_id").alias("id"), *FLAGS), "id", "left")
    flags = {f: F.coalesce(F.col(f), F.lit(False)) if f in out.columns else F.lit(False) for f in FLAGS}
    out = out.withColumns(flags)
    if scores is None:
        return out.withColumn("best_score", F.lit(None).cast("double"))
    if profile != "best" or best is None:
        best = best_scores(scores if profile == "best" else scores.where(F.col("profile_id") == profile))
    return out.join(best, "id", "left")


def predicate(f: Filters) -> Column:
    """All of a request's filters over the columns of ``joined``."""
    col, tests = F.col, []
    if f.q:
        tests.append(matches(f.q, "title", "description", f.scope))
    if f.exclude and query_terms(f.exclude):
        tests.append(~excluded(f.exclude, "title"))
    for value, column in ((f.company_id, "company_id"), (f.city, "city"), (f.department, "department"), (f.industry, "industry"), (f.language, "source_language")):
        if value:
            tests.append(col(column).isin(csv(value)))
    if f.exclude_company_id:
        tests.append(~col("company_id").isin(csv(f.exclude_company_id)))
    if f.status:
        tests.append(col("status") != "closed" if f.status == "open" else col("status").isin(csv(f.status)))
    for value, column in ((f.is_remote, "is_remote"), (f.is_referral, "is_referral"), *((getattr(f, x), x) for x in FLAGS)):
        if value is not None:
            tests.append(col(column) == value)
    if f.has_description is not None:
        tests.append((col("description") != "") == f.has_description)
    if f.max_years is not None:
        tests.append(col("years_required").isNull() | (col("years_required") <= f.max_years))
    if f.posted_after:
        tests.append(F.coalesce("posted_at", "first_seen") >= f.posted_after)
    if f.has_connection is not None:
        tests.append(col("connection_count") > 0 if f.has_connection else col("connection_count") == 0)
    if f.min_score is not None:
        tests.append(col("best_score") >= f.min_score)
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def order(sort: str | None) -> list[Column]:
    """Sort keys; unknown names sort by score, and the id breaks all ties so pages are stable."""
    keys = {"date": F.coalesce("posted_at", "first_seen").desc_nulls_last(), "company": F.lower("display_name").asc_nulls_first(), "title": F.lower("title").asc_nulls_first()}
    return [keys.get(sort or "", F.col("best_score").desc_nulls_last()), F.col("id").asc()]


def page(found: DataFrame, sort: str | None = "score", number: int = 1, size: int = 50) -> DataFrame:
    size, number = max(1, min(size, 500)), max(1, number)
    return found.orderBy(*order(sort)).offset((number - 1) * size).limit(size)


def list_columns(found: DataFrame) -> DataFrame:
    """List rows: a snippet and the length of the description, never the description."""
    text = F.coalesce("description", F.lit(""))
    return found.withColumn("snippet", F.substring(text, 1, SNIPPET)).withColumn("description_length", F.length(text)).drop("description")


class Search:
    """The engine's read side over four tables, and the tables it keeps beside them: the best score of each posting, and
    the tokens of their texts (see ``index``). Titles that were cut from the texts (``cut_titles``) are searched only where
    titles are asked for: the word they end in may be a piece of one, and their others are in the text."""

    def __init__(self, jobs: DataFrame, companies: DataFrame, state: DataFrame | None = None, scores: DataFrame | None = None, best: DataFrame | None = None, index: DataFrame | None = None, cut_titles: bool = False):
        self.jobs, self.companies, self.state, self.scores, self.best, self.index, self.cut_titles = jobs, companies, state, scores, best, index, cut_titles

    def narrowed(self, f: Filters) -> tuple[DataFrame, Filters]:
        """The postings that the index leaves, and what of the filters it has not settled."""
        rows = self.jobs
        if self.cut_titles and f.scope != "title":
            f = replace(f, scope="text")
        if self.index is not None and f.q:
            rows, f = rows.join(index.having(self.index, f.q, f.scope), "id", "left_semi"), replace(f, q=None)
        if self.index is not None and f.exclude:
            rows, f = rows.join(index.having(self.index, f.exclude, "title", False), "id", "left_anti"), replace(f, exclude=None)
        return rows, f

    def rows(self, f: Filters) -> DataFrame:
        jobs, left = self.narrowed(f)
        return joined(jobs, self.companies, self.state, self.scores, f.profile, self.best).where(predicate(left))

    def search(self, f: Filters, sort: str = "score", number: int = 1, size: int = 50) -> tuple[DataFrame, DataFrame]:
        """(the page, one row with the unpaged total)."""
        found = self.rows(f)
        return list_columns(page(found, sort, number, size)), found.agg(F.count("*").alias("total"))

    def facet(self, f: Filters, dimension: str) -> DataFrame:
        """(value, label, n, total) of one dimension, its own filter left out; most first, cut at MOST_PER_DIMENSION, total before the cut."""
        _, own, value, label = next(d for d in DIMENSIONS if d[0] == dimension)
        found = self.rows(replace(f, **{own: None})).where(F.col(value).isNotNull())
        counts = found.groupBy(F.col(value).alias("value")).agg(F.min(label).alias("label"), F.count("*").alias("n"))
        counts = counts.crossJoin(counts.agg(F.count("*").alias("total")))  # one row
        return counts.orderBy(F.desc("n"), F.lower("label"), "value").limit(MOST_PER_DIMENSION)

    def years(self, f: Filters) -> DataFrame:
        return self.rows(f).where("years_required is not null").groupBy(F.col("years_required").alias("value")).agg(F.count("*").alias("n"))

    def facet_totals(self, f: Filters) -> DataFrame:
        """(dimension, total): distinct values of each dimension."""
        parts = [self.rows(replace(f, **{own: None})).agg(F.count_distinct(value).alias("total")).select(F.lit(name).alias("dimension"), "total") for name, own, value, _ in DIMENSIONS]
        return reduce(DataFrame.unionByName, parts)

    def company_stats(self) -> DataFrame:
        counts = self.jobs.groupBy(F.col("company_id").alias("id")).agg(F.count("*").alias("total_jobs"), F.count_if(F.col("status") != "closed").alias("open_jobs"))
        return self.companies.join(counts, "id", "left").na.fill(0, ["total_jobs", "open_jobs"])

    def job(self, job_id: str) -> DataFrame:
        """The full row of a posting with its scores as a map; no row if unknown."""
        out = joined(self.jobs.where(F.col("id") == job_id), self.companies, self.state, self.scores)
        if self.scores is None:
            return out
        one = self.scores.where(F.col("job_id") == job_id).groupBy(F.col("job_id").alias("id"), "profile_id").agg(F.max("score").alias("score"))
        scores = one.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("profile_id", "score"))).alias("scores"))
        return out.join(scores, "id", "left")

    def profiles(self) -> DataFrame:
        return self.scores.select("profile_id").distinct().orderBy("profile_id")

    def distribution(self, open_only: bool = True) -> DataFrame:
        """(profile_id, bucket, n): tens of scores of all profiles in one pass."""
        scored = self.scores.where("score is not null")
        if open_only:
            scored = scored.join(self.jobs.where("status != 'closed'").select(F.col("id").alias("job_id")), "job_id", "left_semi")
        return scored.groupBy("profile_id", (F.floor(F.col("score") / 10) * 10).cast("int").alias("bucket")).agg(F.count("*").alias("n"))

    def top(self, f: Filters, n: int) -> DataFrame:
        """The best n postings that are open and not hidden."""
        return page(self.rows(replace(f, status="open", hidden=False, min_score=f.min_score or 0)), "score", 1, n)


def grouped(found: DataFrame, shown: int = 8) -> DataFrame:
    """Companies by their best score, and up to ``shown`` postings of each."""
    w = W.partitionBy("company_id")
    return found.withColumn("company_score", F.max("best_score").over(w)).withColumn("place", F.row_number().over(w.orderBy(F.col("best_score").desc_nulls_last(), "id"))).where(F.col("place") <= shown)


def legacy_match(text: Column, terms: str, every: bool) -> Column:
    """Comma-separated substrings, all or any of them."""
    found = [F.lower(text).contains(t.lower()) for t in csv(terms)]
    return reduce((lambda a, b: a & b) if every else (lambda a, b: a | b), found) if found else F.lit(True)


def posted_within(days: int, today: str, posted_at: Column | str = "posted_at") -> Column:
    """Whole days since the posting's date, at most ``days``; a posting without a date is left out."""
    since = F.date_diff(F.lit(today).cast("date"), (F.col(posted_at) if isinstance(posted_at, str) else posted_at).try_cast("date"))
    return F.coalesce(since <= days, F.lit(False))


def legacy_page(found: DataFrame, terms: str = "", every: bool = True, scope: str = "both", exclude: str = "", exclude_every: bool = False, days: int | None = None, today: str = "") -> DataFrame:
    """The rows the first version's page shows: substrings in title, description or both, any or all of them, without rows
    whose title has excluded ones."""
    title, text = F.lower(F.coalesce("title", F.lit(""))), F.lower(F.coalesce("description", F.lit("")))
    hay = {"title": title, "description": text}.get(scope, F.concat(title, F.lit(" "), text))
    keep = legacy_match(hay, terms, every)
    if csv(exclude):
        keep = keep & ~legacy_match(title, exclude, exclude_every)
    if days is not None:
        keep = keep & posted_within(days, today)
    return found.where(keep)


def legacy_order(sort: str) -> list[Column]:
    """The first page's orders; the id breaks ties."""
    score = F.col("best_score").desc_nulls_last()
    keys = {"date": [F.coalesce("posted_at", F.lit("")).desc()], "company": [F.lower("display_name").asc(), score]}
    return [*keys.get(sort, [score]), F.col("id").asc()]


def exclude_suggestions(titles: DataFrame, stop: list[str], n: int = 15) -> DataFrame:
    """Words of three or more letters in most titles."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("title"), F.lit(r"(\p{L}{3,})"), 1))
    return titles.select(F.explode(words).alias("word")).where(~F.col("word").isin(stop)).groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(n)
