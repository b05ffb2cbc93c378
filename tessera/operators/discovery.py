"""From a company's address and captured pages to a plan of how its postings are read.

The cascade is one pass of joins over the pages that were captured; what it still needs (a page one hop away) it names,
and a second pass over that page continues."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import rules, urls
from tessera.functions import vocabulary as V
from tessera.functions.text import c, collapse, normalize_company
from tessera.operators import listing
from tessera.operators.kept import stored
from tessera.sources import inlined

# --- fixed values: words of links that lead to a listing, and paths of listings
ASKING = ("open", "all", "current", "view", "see", "search", "explore", "browse", "find", "our")
LISTED = ("positions", "position", "roles", "role", "jobs", "job", "openings", "opening", "opportunities", "vacancies")
LISTING_LABELS = ("jobs", "positions", "openings", "open positions", "all jobs", "job openings", "vacancies", "open roles", "careers", "משרות", "כל המשרות", "למשרות")
LISTING_PATHS = ("job", "jobs", "opening", "openings", "open-position", "open-positions", "open-role", "open-roles", "position", "positions", "all-jobs", "job-opening", "job-openings", "job-opportunities", "vacancies", "opportunities", "roles", "search-job", "search-jobs")
CAREER_PATHS = ("job", "jobs", "search", "roles", "all", "opening", "openings", "israel", "open-position", "open-positions", "find-a-job")
# --- fixed values: labels of links to a career page, and how long such a label is at most
CAREER_LABELS = ("career", "careers", "jobs", "job openings", "open positions", "open roles", "current openings", "job opportunities")
CAREER_LABEL_CHARS = 30
# --- fixed values: parts of ids and classes of consent widgets
CONSENT = ("cmplz", "cookiebot", "onetrust", "cookieyes", "cky-consent", "osano", "borlabs-cookie", "cc-window", "cookie-notice", "cookie-consent", "gdpr-cookie", "usercentrics", "trustarc", "termly")
#: A landing page with no more postings than this may have its listing one hop away.
FEW = 2


# ---------------------------------------------------------------- links


def listing_text(text: Column | str) -> Column:
    """A label such as "See all open roles": a word that asks, and within 25 characters a word for postings."""
    said = F.lower(collapse(text))
    return F.coalesce(said.rlike(rf"\b({'|'.join(ASKING)})\b.{{0,25}}\b({'|'.join(LISTED)})") | said.isin(*LISTING_LABELS), F.lit(False))


def listing_path(url: Column | str) -> Column:
    s = urls.segments(F.lower(c(url)))
    last, before = F.try_element_at(s, F.lit(-1)), F.try_element_at(s, F.lit(-2))
    return F.coalesce(last.isin(*LISTING_PATHS), F.lit(False)) | F.coalesce(before.isin("career", "careers") & last.isin(*CAREER_PATHS), F.lit(False))


def listing_link(text: Column | str, url: Column | str) -> Column:
    """A link to a listing, which is no posting: by its label, or by a bare listing path."""
    return listing_text(text) | ((urls.part(url, "QUERY") == "") & listing_path(url))


def rule_labels(links: DataFrame) -> DataFrame:
    """(page_id, index, href, href_shape, is_job, reason) of candidate links by rules alone: the chain's verdict, but for
    links to a listing."""
    judged = listing.chain(links)
    leads = listing_link("text", "href")
    ok = F.col("verdict.accept") & ~leads
    reason = F.when(ok, "rules: accepted").when(F.col("verdict.accept"), "rules: a link to a job listing, not a job").otherwise(F.concat(F.lit("rules: "), F.col("verdict.reason")))
    return judged.select("page_id", "index", "href", "href_shape", ok.alias("is_job"), F.substring(reason, 1, 200).alias("reason"))


def recorded_labels(links: DataFrame, recorded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(labels, pages without any): labels ``recorded`` by (page_url, index, is_job, reason) put on ``links``."""
    own = recorded.select("page_url", "index", "is_job", "reason")
    labelled = links.join(own, ["page_url", "index"])
    return labelled, links.select("page_id", "page_url").distinct().join(own, "page_url", "left_anti")


def stated_postings(labels: DataFrame, pages: DataFrame) -> DataFrame:
    """Labels with the addresses that a page's own JSON-LD names as postings set to be ones."""
    found = pages.select("page_id", F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r'(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>'), 1)).alias("blob"))
    named = found.select("page_id", F.explode(json_ld_urls("blob")).alias("href")).distinct().withColumn("__said", F.lit(True))
    rows = labels.join(named, ["page_id", "href"], "left")
    return rows.select(*(x for x in labels.columns if x not in ("is_job", "reason")), (F.col("is_job") | F.col("__said").isNotNull()).alias("is_job"), F.when(F.col("__said"), "json-ld JobPosting").otherwise(F.col("reason")).alias("reason"))


@F.arrow_udf(T.ArrayType(T.StringType()))
def json_ld_urls(blobs: pa.Array) -> pa.Array:
    return pa.array([[p["url"] for p in listing.job_postings(b or "") if isinstance(p.get("url"), str)] for b in blobs.to_pylist()], pa.list_(pa.string()))


def best_hop(links: DataFrame) -> DataFrame:
    """(page_id, hop_url): the link on a page's own site that most likely leads to its listing; of equals the first."""
    home, host = urls.host("page_url"), urls.host("href")
    own = (host == home) | F.endswith(host, F.concat(F.lit("."), home)) | F.endswith(home, F.concat(F.lit("."), host))
    here = F.lower(F.rtrim(F.col("href"), F.lit("/"))) == F.lower(F.rtrim(F.split_part("page_url", F.lit("#"), F.lit(1)), F.lit("/")))
    score = F.when(listing_path("href"), 2).otherwise(0) + F.when(listing_text("text"), 1).otherwise(0)
    rows = links.where(own & ~here).withColumn("score", score).where("score > 0")
    return rows.groupBy("page_id").agg(F.max_by("href", F.struct("score", -F.col("index"))).alias("hop_url"))


def external_board(pages: DataFrame) -> DataFrame:
    """(page_id, board_url, board): the hosted board that most links and frames of a page lead to; of equals the first."""
    target = r"""(?is)<(?:a|iframe)\b[^>]*?\b(?:href|src)\s*=\s*["']([^"']+)"""
    found = pages.select("page_id", F.posexplode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(target), 1)).alias("at", "u"))
    whole = found.withColumn("u", F.when(F.startswith("u", F.lit("//")), F.concat(F.lit("https:"), F.col("u"))).otherwise(F.col("u"))).withColumn("board", urls.board("u")).where("board is not null")
    counts = whole.groupBy("page_id", "u").agg(F.count("*").alias("n"), F.min("at").alias("at"), F.min("board").alias("board"))
    best = counts.groupBy("page_id").agg(F.max_by(F.struct(F.col("u").alias("board_url"), "board"), F.struct("n", -F.col("at"))).alias("b"))
    return best.select("page_id", "b.board_url", "b.board")


def career_link(pages: DataFrame) -> DataFrame:
    """(page_id, career_url): the first link of a home page whose short label names careers."""
    label = F.lower(collapse("a.text"))
    named = label.rlike(r"\b(" + "|".join(re.escape(w) for w in CAREER_LABELS) + r")\b")
    rows = pages.select("page_id", F.explode(listing.anchors("html", "url")).alias("a")).where((label != "") & (F.length(label) <= CAREER_LABEL_CHARS) & named)
    return rows.groupBy("page_id").agg(F.min_by("a.href", "a.index").alias("career_url"))


def render_next(companies: DataFrame, listed: DataFrame) -> DataFrame:
    """The companies (id, career_url) whose plain pages gave no posting (``listed``: company_id): those to render."""
    return companies.where("career_url is not null").join(listed.select(F.col("company_id").alias("id")).distinct(), "id", "left_anti")


# ---------------------------------------------------------------- boards


def board_page(url: Column | str) -> Column:
    """The listing page of a hosted posting's address, which holds the data of all its positions; else null."""
    at = r"(?i)comeet\.com/jobs/([A-Za-z0-9_-]+)/([A-Za-z0-9.]+)"
    slug = F.regexp_extract(c(url), at, 1)
    return F.when(slug != "", F.concat(F.lit("https://www.comeet.com/jobs/"), slug, F.lit("/"), F.regexp_extract(c(url), at, 2)))


def widget(page: Column | str) -> Column:
    """The credentials (uid, token) of a board's widget in a page: from the address it calls, else from its settings."""
    x = F.coalesce(c(page), F.lit(""))
    call = r"(?i)comeet\.(?:co|com)/careers-api/2\.0/company/([A-Z0-9]{2}\.[0-9A-F]{3})/positions/?\?token=([0-9A-Fa-f]{20,64})"
    uid = F.coalesce(F.nullif(F.regexp_extract(x, call, 1), F.lit("")), F.nullif(F.regexp_extract(x, r"""(?i)["']?(?:company[-_]?uid|\buid)["']?\s*[:=]\s*["']([A-Z0-9]{2}\.[0-9A-F]{3})["']""", 1), F.lit("")))
    token = F.coalesce(F.nullif(F.regexp_extract(x, call, 2), F.lit("")), F.nullif(F.regexp_extract(x, r"""["']?token["']?\s*[:=]\s*["']([0-9A-Fa-f]{20,64})["']""", 1), F.lit("")))
    there = F.contains(F.lower(x), F.lit("comeet")) & uid.isNotNull() & token.isNotNull()
    return F.when(there, F.struct(F.upper(uid).alias("uid"), token.alias("token")))


def board_address(board: Column | str) -> Column:
    """Where a two-form board is read: credentials "uid:token" name the API, a slug its hosted page."""
    uid, token = F.substring_index(c(board), ":", 1), F.substring_index(c(board), ":", -1)
    api = F.concat(F.lit("https://www.comeet.co/careers-api/2.0/company/"), uid, F.lit("/positions?token="), token)
    return F.when(F.contains(c(board), F.lit(":")), api).otherwise(F.concat(F.lit("https://www.comeet.com/jobs/"), c(board)))


def first_board(rows: DataFrame) -> DataFrame:
    """(company_id, board, url) of the first address of each company's rows (company_id, place, url) that is a hosted board."""
    found = rows.withColumn("board", urls.board("url")).where("board is not null")
    return found.groupBy("company_id").agg(F.min_by(F.struct("board", "url"), "place").alias("b")).select("company_id", "b.board", "b.url")


def by_strategy(plans: DataFrame, fetched: DataFrame, block: int = 1000) -> DataFrame:
    """Postings (company_id, title, url, location, source) that each plan's own strategy gives: ``plans`` (company_id, kind,
    board), ``fetched`` (board, title, url, location) as boards and feeds gave them. A board is read for all its plans.

    A board that many plans share is joined in blocks of about ``block`` plans, each with the board's postings, so that no
    task has a whole board to multiply; boards of fewer plans are one block, and nothing of them is repeated. The planner
    does not see how often postings are repeated, so they are never a side to broadcast; what is broadcast is a row for each
    board of more than ``block`` plans."""
    direct = plans.where(F.col("kind").isin("ats_api", "external_board", "special_case") & F.col("board").isNotNull()).select("company_id", "board", F.col("kind").alias("source"))
    hot = F.broadcast(direct.groupBy("board").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")).where("blocks > 1"))
    own = direct.join(hot, "board", "left").withColumn("block", F.coalesce(F.pmod(F.xxhash64("company_id"), "blocks").cast("int"), F.lit(0))).drop("blocks")
    got = fetched.join(hot, "board", "left").withColumn("block", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))).drop("blocks")
    return got.hint("merge").join(own, ["board", "block"]).select("company_id", "title", "url", "location", "source")


# ---------------------------------------------------------------- category rows


def techmap_index(rows: DataFrame) -> DataFrame:
    """Category rows with their company's key; rows without one are dropped."""
    return rows.withColumn("company_key", normalize_company("company")).where("company_key != ''")


def techmap_postings(companies: DataFrame, index: DataFrame) -> DataFrame:
    """(company_id, title, location, url, source) of companies that only a category file knows."""
    own = companies.select(F.col("id").alias("company_id"), normalize_company("display_name").alias("company_key"))
    return index.where("title is not null and title != ''").join(own, "company_key").select("company_id", "title", F.col("city").alias("location"), "url", F.lit("techmap").alias("source"))


def row_postings(rows: DataFrame) -> DataFrame:
    """Category rows in the shape of postings."""
    none = F.lit(None).cast("string")
    col = lambda name: F.col(name) if name in rows.columns else none
    return rows.select("company", "title", col("city").alias("location"), "url", F.lit("").alias("description"), col("category").alias("department"), col("level").alias("employment_type"), col("updated").alias("posted_at"))


def as_jobs(postings: DataFrame) -> DataFrame:
    """Postings in the columns of stored rows: evidence and source have other names there."""
    return postings.withColumnsRenamed({"evidence": "job_evidence", "source": "scrape_source"})


# ---------------------------------------------------------------- the cascade


def html_plan(links: DataFrame, pages: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(page_id, status, include_url, exclude_url, url_shape, explicit_accept, baseline): rules or given labels, corrected by
    JSON-LD, induced to patterns; a plan that does not reproduce its labels keeps the accepted addresses instead."""
    links = stored(links, "links")
    labelled = stored(stated_postings(rule_labels(links) if labels is None else labels, pages), "labels")
    patterns = listing.induce(labelled)
    patterns = stored(patterns.join(listing.excludes(labelled.join(links.select("page_id", "index"), ["page_id", "index"], "left_semi")), "page_id", "left"), "patterns")
    accepted = labelled.where("is_job").groupBy("page_id").agg(F.count("*").alias("baseline"), F.array_sort(F.collect_set("href")).alias("named"))
    none = F.lit(None).cast("array<string>")
    tried = listing.by_plan(links, patterns.withColumn("explicit_accept", none)).join(labelled.select("page_id", "index", "is_job"), ["page_id", "index"])
    holds = listing.plan_holds(tried)
    out = links.select("page_id").distinct().join(patterns, "page_id", "left").join(accepted, "page_id", "left").join(holds, "page_id", "left")
    ok = F.coalesce(F.col("holds") & (F.col("baseline") > 0), F.lit(False))
    return out.select("page_id", F.when(ok, "verified").otherwise("unverified").alias("status"), F.when(ok, F.col("include_url")).alias("include_url"), "exclude_url", "url_shape", F.when(~ok, F.col("named")).alias("explicit_accept"), F.coalesce("baseline", F.lit(0)).alias("baseline"))


def discover(companies: DataFrame, pages: DataFrame, special: tuple[str, ...] = (), links: DataFrame | None = None) -> DataFrame:
    """(company_id, kind, board, reason, status, baseline, hop_url): a plan for each of ``companies`` (id, career_url, hint)
    from captured ``pages`` (requested_url, url, status, html).

    The first that holds: no address; a hosted board; a site with a feed of its own; a page that is gone or lands on the
    home page; a board the page links or embeds; postings inlined in it; its links. Where a page has hardly a posting,
    hop_url names the link to look at next. Without a page, or on an error, kind is null and the reason says why."""
    asked = F.col("career_url")
    page = pages.groupBy(F.col("requested_url").alias("page_id")).agg(F.min(F.struct("url", "status", "html")).alias("p")).select("page_id", "p.*")
    sound = page.where("status < 400")
    links = stored(listing.candidates(sound.select("page_id", "url", "html")) if links is None else links, "links")
    plan = stored(html_plan(links, sound), "html-plans")
    counts = links.groupBy("page_id").agg(F.count("*").alias("n_links"))
    inline = inlined.inline_postings(sound.select("page_id", "url", "html")).groupBy("page_id").agg(F.count("*").alias("n_inline"))
    hints = companies.select(F.col("career_url").alias("page_id"), F.concat_ws(" ", "id", "hint").alias("hint")).where("page_id is not null").groupBy("page_id").agg(F.min("hint").alias("hint"))
    inside = inlined.embedded_boards(sound.join(hints, "page_id").select("page_id", "html", "hint")).where("place = 1").select("page_id", F.concat_ws(":", "provider", "board").alias("inside"))
    outside = external_board(sound).select("page_id", F.col("board").alias("outside"), F.col("board_url"))
    rows = companies.withColumn("page_id", asked)
    for side in (page.select("page_id", F.col("url").alias("landed"), F.col("status").alias("code")), plan, counts, inline, inside, outside, best_hop(links)):
        rows = rows.join(side, "page_id", "left")
    fragment = F.coalesce(*(F.when(F.contains(F.lower(asked), F.lit(h)), F.lit(h)) for h in special)) if special else F.lit(None).cast("string")
    none = F.coalesce(F.trim(asked), F.lit("")) == ""
    home = (F.rtrim(urls.part("landed", "PATH"), F.lit("/")) == "") & (F.rtrim(urls.part("career_url", "PATH"), F.lit("/")) != "")
    n_inline, baseline = F.coalesce("n_inline", F.lit(0)), F.coalesce("baseline", F.lit(0))
    code = F.col("code").cast("string")

    def choice(kind, board=None, reason=None, status="verified", n=None) -> Column:
        text = lambda x: x.cast("string") if isinstance(x, Column) else F.lit(x).cast("string")
        return F.struct(text(kind).alias("kind"), text(board).alias("board"), text(reason).alias("reason"), text(status).alias("status"), (n if n is not None else F.lit(None)).cast("long").alias("baseline"))

    by_data = choice("html_listing", reason="inlined", n=n_inline)
    by_links = choice("html_listing", status=F.col("status"), n=baseline)
    found = (
        F.when(none, choice("techmap_only", reason="no career url"))
        .when(urls.board("career_url").isNotNull(), choice("ats_api", urls.board("career_url")))
        .when(fragment.isNotNull(), choice("special_case", fragment))
        .when(F.col("code").isNull(), choice(None, reason="no page", status=None))
        .when(F.col("code").isin(404, 410), choice("broken_url", reason=F.concat(F.lit("http "), code)))
        .when(F.col("code") >= 400, choice(None, reason=F.concat(F.lit("http "), code), status=None))
        .when(home, choice("broken_url", reason="redirects to homepage"))
        .when(F.col("outside").isNotNull(), choice("external_board", F.col("outside")))
        .when(F.col("inside").isNotNull(), choice("ats_api", F.col("inside")))
        .when(F.col("n_links").isNull(), F.when(n_inline > 0, by_data).otherwise(choice("techmap_only", reason="no anchors on page", status="unverified")))
        .when((baseline <= FEW) & (n_inline > baseline), by_data)
        .otherwise(by_links)
    )
    rows = rows.withColumn("__plan", found)
    hop = F.when((F.col("__plan.kind") == "html_listing") & F.col("__plan.reason").isNull() & (baseline <= FEW), F.col("hop_url"))
    return rows.select(F.col("id").alias("company_id"), "__plan.*", hop.alias("hop_url"))


def after_hop(plans: DataFrame, second: DataFrame) -> DataFrame:
    """Plans with that of the page one hop away (``second``: company_id and the columns of a plan) where it is another kind
    than a listing, or a listing with more postings."""
    better = (F.col("s.kind") != "html_listing") | (F.coalesce("s.baseline", F.lit(0)) > F.coalesce("o.baseline", F.lit(0)))
    rows = plans.alias("o").join(second.where(F.col("kind").isNotNull() & ~F.col("kind").isin("techmap_only", "broken_url")).alias("s"), "company_id", "left")
    use = F.coalesce(better, F.lit(False))
    return rows.select("company_id", *(F.when(use, F.col(f"s.{x}")).otherwise(F.col(f"o.{x}")).alias(x) for x in plans.columns if x not in ("company_id", "hop_url")), F.when(use, F.col("o.hop_url")).alias("listing_url"))


# ---------------------------------------------------------------- pages as text


INLINE = frozenset("a abbr b bdi cite code em font i kbd label mark q s small span strong sub sup time u".split())


class _Content(HTMLParser):
    """A page's text without scripts, consent widgets, and parts of its frame that hold no link that reads like a posting.

    Each open element keeps its text until it closes; then it goes to the element around it, or nowhere."""

    def __init__(self, job_like):
        super().__init__(convert_charrefs=True)
        self.job_like, self.frames, self.anchor = job_like, [["", [], False, False]], None  # tag, text, dropped, holds a posting's link

    def handle_starttag(self, tag, attrs):
        if tag in listing.VOID:
            return
        own = dict(attrs)
        marks = f"{own.get('id') or ''} {own.get('class') or ''}".lower()
        self.frames.append([tag, [], tag in ("script", "style", "svg", "noscript") or any(m in marks for m in CONSENT), False])
        if tag == "a" and "href" in own:
            self.anchor = []

    def handle_data(self, data):
        self.frames[-1][1].append(data)
        if self.anchor is not None:
            self.anchor.append(data)

    def handle_endtag(self, tag):
        if tag == "a" and self.anchor is not None:
            self.frames[-1][3] = self.frames[-1][3] or self.job_like(" ".join("".join(self.anchor).split()))
            self.anchor = None
        if any(f[0] == tag for f in self.frames[-64:]):
            while self._close() != tag:
                pass

    def _close(self) -> str:
        tag, text, dropped, linked = self.frames.pop()
        if not dropped and (linked or tag not in ("nav", "header", "footer", "form")):
            edge = [] if tag in INLINE else ["\n"]
            self.frames[-1][1] += [*edge, *text, *edge] if text else []
        self.frames[-1][3] = self.frames[-1][3] or (linked and not dropped)
        return tag

    def result(self) -> str:
        while len(self.frames) > 1:
            self._close()
        return "\n".join(x for x in (" ".join(line.split()) for line in "".join(self.frames[0][1]).split("\n")) if x)


def reads_like_posting(text: str) -> bool:
    """The plain-Python twin of ``not rules.denied_text``, for a parser to ask."""
    if not 8 <= len(text) <= 120 or re.search(V.NAV_LABEL, text) or re.search(r"^\[#|#\]$|^[\w.+-]+@[\w-]+\.[\w.-]+\??$|(?i:^(https?://|www\.))", text):
        return False
    return bool(re.search("[A-Za-z]{3,}|[א-ת]{2,}", text))


@F.arrow_udf(T.StringType())
def content_text(pages: pa.Array) -> pa.Array:
    """The text of each page without its frame."""

    def one(page: str | None) -> str:
        parser = _Content(reads_like_posting)
        parser.feed(page or "")
        return parser.result()

    return pa.array([one(p) for p in pages.to_pylist()], pa.string())


def snapshot(page: Column | str) -> Column:
    """A page as it is kept: without scripts, styles, images in code and comments, in which no link can stand."""
    return F.regexp_replace(F.coalesce(c(page), F.lit("")), r"(?is)<(script|style|noscript|svg)\b[^>]*>.*?</\1\s*>|<!--.*?-->", "")


def make_page(pages: DataFrame) -> DataFrame:
    """Captured responses (requested_url, url, status, html, fetched_at) with their visible text and whether they are a shell."""
    from tessera.functions.text import visible_text

    return pages.withColumn("url", F.coalesce(F.nullif("url", F.lit("")), "requested_url")).withColumn("text", visible_text("html")).withColumn("is_js_shell", rules.js_shell("html"))


# ---------------------------------------------------------------- audits


def with_reject(patterns: list[str], pattern: str) -> list[str]:
    """The reject list with a pattern; one that is no pattern is a ValueError, one that is there already changes nothing."""
    try:
        re.compile(pattern)
    except re.error as e:
        raise ValueError(f"not a pattern: {pattern!r}") from e
    return patterns if pattern in patterns else [*patterns, pattern]


def domain_audit(companies: DataFrame, answers: DataFrame) -> DataFrame:
    """(company, n): companies with an address that is broken or in error, among their home page and a differing career page:
    ``companies`` (name, homepage, career_url), ``answers`` (url, status)."""
    own = companies.select("name", F.explode(F.array_distinct(F.array_compact(F.array("homepage", "career_url")))).alias("url"))
    status = answers.groupBy("url").agg(F.max("status").alias("status"))
    bad = own.join(status, "url", "left").withColumn("class", rules.url_status_class("status")).where(F.col("class").isin("broken", "error", "unreachable"))
    return bad.groupBy(F.col("name").alias("company")).agg(F.count("*").alias("n"))


def near_postings(rows: DataFrame, k: int) -> DataFrame:
    """The first ``k`` of each page, by index."""
    return rows.withColumn("n", F.row_number().over(W.partitionBy("page_id").orderBy("index"))).where(F.col("n") <= k).drop("n")
