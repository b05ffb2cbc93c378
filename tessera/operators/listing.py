"""Listing pages to accepted postings: anchors with features, then a chain of filters that denies by default."""

from __future__ import annotations

import json
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import rules, urls
from tessera.functions import vocabulary as V
from tessera.functions.text import collapse
from tessera.operators.taxonomy import family_of

ANCHOR = T.ArrayType(T.StructType([T.StructField(n, t) for n, t in (("index", T.IntegerType()), ("text", T.StringType()), ("heading", T.StringType()), ("href", T.StringType()), ("path", T.StringType()), ("grandparent", T.IntegerType()), ("in_chrome", T.BooleanType()))]))
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
SKIP = ("#", "javascript:", "mailto:", "tel:")


HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))


class _Element:
    """An open element: how many anchors and which heading its closed parts had, and an anchor right inside it."""

    __slots__ = ("tag", "number", "anchors", "heading", "anchor")

    def __init__(self, tag: str, number: int):
        self.tag, self.number, self.anchors, self.heading, self.anchor = tag, number, 0, "", None


class _Anchors(HTMLParser):
    """Anchors with their text, path and grandparent, and the heading in them or, where an anchor is the only one of its
    parent, the heading beside it; any markup is accepted."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[_Element] = [_Element("", 0)]
        self.count, self.found, self.open, self.words = 0, [], None, None

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            self._end()
            above = self.stack[1:]
            self.open = {"href": dict(attrs).get("href") or "", "text": [], "heading": "", "path": ">".join(e.tag for e in above), "grandparent": above[-2].number if len(above) > 1 else 0, "in_chrome": any(e.tag in ("nav", "header", "footer") for e in above)}
            self.stack[-1].anchors += 1
            self.stack[-1].anchor = self.open
        if tag in HEADINGS:
            self.words = []
        if tag not in VOID:
            self.count += 1
            self.stack.append(_Element(tag, self.count))

    def handle_endtag(self, tag):
        if tag == "a":
            self._end()
        if tag in HEADINGS and self.words is not None:
            said, self.words = " ".join(" ".join(self.words).split()), None
            self.stack[-1].heading = self.stack[-1].heading or said
            if self.open and said and not self.open["heading"]:
                self.open["heading"] = said
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                self._close(i)
                break

    def handle_data(self, data):
        if self.open:
            self.open["text"].append(data)
        if self.words is not None:
            self.words.append(data)

    def _close(self, to: int) -> None:
        while len(self.stack) > to:
            e = self.stack.pop()
            if e.anchors == 1 and e.anchor is not None and not e.anchor["heading"]:
                e.anchor["heading"] = e.heading
            if self.stack:
                self.stack[-1].anchors += e.anchors
                self.stack[-1].heading = self.stack[-1].heading or e.heading

    def _end(self):
        if self.open:
            self.found.append(self.open)
            self.open = None

    def finish(self) -> list[dict]:
        self._end()
        self._close(1)
        return self.found


def anchors_of(page: str | None, base: str | None) -> list[dict]:
    parser = _Anchors()
    parser.feed(page or "")
    out = []
    for a in parser.finish():
        href = a["href"].strip()
        if not href or href.lower().startswith(SKIP):
            continue
        try:
            absolute = urljoin(base or "", href)
        except ValueError:
            continue
        out.append({"index": len(out), "text": " ".join(" ".join(a["text"]).split()), "heading": a["heading"], "href": absolute.split("#")[0], "path": a["path"], "grandparent": a["grandparent"], "in_chrome": a["in_chrome"]})
    return out


@F.arrow_udf(ANCHOR)
def anchors(pages: pa.Array, bases: pa.Array) -> pa.Array:
    kind = pa.list_(pa.struct([("index", pa.int32()), ("text", pa.string()), ("heading", pa.string()), ("href", pa.string()), ("path", pa.string()), ("grandparent", pa.int32()), ("in_chrome", pa.bool_())]))
    return pa.array([anchors_of(p, b) for p, b in zip(pages.to_pylist(), bases.to_pylist())], kind)


def candidates(pages: DataFrame, cap: int | None = 200) -> DataFrame:
    """One row per distinct link of ``pages`` (page_id, url, html), first in page order, with the features filters ask for.

    ``cap`` links a page at most are looked at, the feature of a listing crawl; None looks at all."""
    rows = pages.select("page_id", "url", F.explode(anchors("html", "url")).alias("a")).select("page_id", F.col("url").alias("page_url"), "a.*")
    first = W.partitionBy("page_id", "href").orderBy("index")
    rows = rows.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
    if cap is not None:
        rows = rows.withColumn("__k", F.row_number().over(W.partitionBy("page_id").orderBy("index"))).where(F.col("__k") <= cap).drop("__k")
    rows = rows.withColumn("title", F.when(F.col("heading") != "", F.col("heading")).otherwise(F.col("text"))).withColumn("href_shape", urls.href_shape("href"))
    rows = rows.withColumn("siblings", F.greatest(F.count("*").over(W.partitionBy("page_id", "grandparent", "href_shape")), F.lit(1)))
    rows = rows.withColumn("shape_count", F.count("*").over(W.partitionBy("page_id", "href_shape"))).withColumn("batch", F.count("*").over(W.partitionBy("page_id")))
    return rows.withColumns({"same_host": urls.host("href") == urls.host("page_url"), "under_career_path": F.startswith(urls.part("href", "PATH"), F.concat(F.rtrim(urls.part("page_url", "PATH"), F.lit("/")), F.lit("/"))), "has_job_url_hint": urls.job_url_hint("href"), "role_family": family_of("title")})


def category_pages(links: DataFrame) -> DataFrame:
    """(page_id, index) of links whose parent path is a strict prefix of a sibling's.

    Each link's ancestors are exploded and met by equality, so no two links of a page are compared."""
    parents = links.select("page_id", "index", urls.parents("href").alias("p")).where(F.size("p") > 0)
    above = parents.where(F.size("p") > 1).select("page_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("p") - 1), lambda k: F.array_join(F.slice("p", F.lit(1), k), "/"))).alias("at")).distinct()
    return parents.withColumn("at", F.array_join("p", "/")).join(above, ["page_id", "at"], "left_semi").select("page_id", "index").withColumn("is_category", F.lit(True))


def verdict(*tests: tuple[Column, bool, str, Column | str]) -> Column:
    """The first test that holds: (condition, accept, filter, reason); denied if none does."""
    out = F.when(F.lit(False), F.lit(None).cast("struct<accept:boolean,filter:string,reason:string>"))
    for condition, accept, name, reason in tests:
        out = out.when(condition, F.struct(F.lit(accept).alias("accept"), F.lit(name).alias("filter"), (F.lit(reason) if isinstance(reason, str) else reason).cast("string").alias("reason")))
    return out.otherwise(F.struct(F.lit(False).alias("accept"), F.lit("default").alias("filter"), F.lit("no filter accepted it").alias("reason")))


def signals() -> Column:
    return sum((F.coalesce(x, F.lit(False)).cast("int") for x in (F.col("same_host"), F.col("under_career_path"), F.col("has_job_url_hint"), F.col("role_family").isNotNull(), F.col("siblings") >= 3)), F.lit(0))


def chain(links: DataFrame, reject: list[str] = (), include: str | None = None, exclude: list[str] = (), accept: list[str] = (), shape: str | Column | None = None, least: int = 2, more: list[tuple] = ()) -> DataFrame:
    """``links`` with a verdict: hard rejects, then a plan's patterns, then shape and evidence. ``more``: further tests of
    the plan; ``shape`` may differ by row, and rows without one are held to the page's own shapes."""
    rows = links.join(category_pages(links), ["page_id", "index"], "left")
    text, href = collapse("text"), F.col("href")
    tests = [
        (rules.denied_text("text"), False, "denylist", "nav/boilerplate text"),
        ((text.rlike(V.CTA_LABEL) | text.rlike(V.CTA_PREFIX)) & ~F.col("has_job_url_hint") & ~F.col("under_career_path"), False, "cta_label", "no job-shaped destination"),
        (rules.non_job_host(href), False, "href_marker", "maps link"),
        (rules.non_job_segment(href).isNotNull(), False, "href_marker", F.concat(F.lit("path segment "), rules.non_job_segment(href))),
        *((href.rlike(p), False, "reject_list", f"matches reject pattern {p}") for p in reject),
        (F.coalesce("is_category", F.lit(False)), False, "category_prefix", "category overview of a sibling posting"),
        *((href.rlike(p), False, "plan_pattern", f"plan exclude {p}") for p in exclude),
    ]
    if include:
        tests.append((href.rlike(include), True, "plan_pattern", "plan include_url"))
    if accept:
        tests.append((href.isin(list(accept)), True, "plan_pattern", "plan explicit_accept"))
    tests += more
    wanted = shape if isinstance(shape, Column) else F.lit(shape).cast("string")
    tests.append((F.col("href_shape") == wanted, True, "url_shape", "matches plan url_shape"))
    tests.append((wanted.isNull() & (F.col("shape_count") == 1) & ~F.col("has_job_url_hint") & (F.col("batch") >= 3), False, "url_shape", "singleton url shape without a job hint"))
    tests += [(F.col("in_chrome"), False, "evidence", "inside nav/header/footer"), (signals() >= least, True, "evidence", F.concat(signals().cast("string"), F.lit(" positive signals")))]
    return rows.withColumn("verdict", verdict(*tests)).drop("is_category")


def by_plan(links: DataFrame, plans: DataFrame, reject: list[str] = (), least: int = 2) -> DataFrame:
    """``links`` judged each by its page's plan: ``plans`` (page_id, include_url, exclude_url array, url_shape,
    explicit_accept array), any of them null. The order is that of ``chain``."""
    own = plans.select("page_id", F.col("include_url").alias("p_include"), F.col("exclude_url").alias("p_exclude"), F.col("url_shape").alias("p_shape"), F.col("explicit_accept").alias("p_accept"))
    none = F.array().cast("array<string>")
    href = F.col("href")
    hits = {
        "__out": F.exists(F.coalesce("p_exclude", none), lambda p: F.regexp_like(href, p)),
        "__in": F.coalesce(F.regexp_like(href, F.col("p_include")), F.lit(False)),
        "__named": F.array_contains(F.coalesce("p_accept", none), href),
    }
    rows = links.join(own, "page_id", "left").withColumns(hits)
    tests = [(F.col("__out"), False, "plan_pattern", "plan exclude"), (F.col("__in"), True, "plan_pattern", "plan include_url"), (F.col("__named"), True, "plan_pattern", "plan explicit_accept")]
    judged = chain(rows, reject, shape=F.col("p_shape"), least=least, more=tests)
    return judged.drop("p_include", "p_exclude", "p_shape", "p_accept", *hits)


def postings(judged: DataFrame, cap: int = 50) -> DataFrame:
    """Accepted links, same host first, ``cap`` a page."""
    w = W.partitionBy("page_id").orderBy(F.desc("same_host"), "index")
    return judged.where("verdict.accept").withColumn("place", F.row_number().over(w)).where(F.col("place") <= cap)


def fingerprint(links: DataFrame) -> DataFrame:
    """(page_id, fingerprint, n): digest of the distinct link shapes."""
    return links.groupBy("page_id").agg(F.sha1(F.array_join(F.sort_array(F.collect_set("href_shape")), ",").cast("binary")).alias("fingerprint"), F.count("*").alias("n"))


def job_postings(blob: str) -> list[dict]:
    """JobPosting objects of a JSON-LD text: an object, a list or a graph."""
    try:
        data = json.loads(blob)
    except ValueError:
        return []
    found, todo = [], [data]
    while todo:
        x = todo.pop(0)
        if isinstance(x, list):
            todo = x + todo
        elif isinstance(x, dict):
            kind = x.get("@type")
            if kind == "JobPosting" or isinstance(kind, list) and "JobPosting" in kind:
                found.append(x)
            todo = (x["@graph"] if isinstance(x.get("@graph"), list) else []) + todo
    return found


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("title", "description", "posted_at", "location")])))
def json_ld(pages: pa.Array) -> pa.Array:
    """The JSON-LD postings of each page."""
    import re

    def place(x) -> str | None:
        x = x[0] if isinstance(x, list) and x else x
        if not isinstance(x, dict):
            return x if isinstance(x, str) else None
        a = x.get("address", x)
        if isinstance(a, str):
            return a
        name = lambda v: v.get("name") if isinstance(v, dict) else v
        return ", ".join(str(v) for v in (name(a.get(k)) for k in ("addressLocality", "addressRegion", "addressCountry")) if v) or None

    out = []
    for page in pages.to_pylist():
        blobs = re.findall(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>", page or "")
        out.append([{"title": str(p.get("title") or ""), "description": str(p.get("description") or ""), "posted_at": str(p.get("datePosted") or "")[:10], "location": place(p.get("jobLocation"))} for b in blobs for p in job_postings(b)])
    return pa.array(out, pa.list_(pa.struct([(n, pa.string()) for n in ("title", "description", "posted_at", "location")])))


def escaped(text: Column) -> Column:
    """A text as a pattern that matches it alone."""
    return F.regexp_replace(text, r"([^\w/])", r"\\$1")


def induce(labelled: DataFrame) -> DataFrame:
    """(page_id, url_shape, include_url) of ``labelled`` (page_id, index, href, href_shape, is_job): the commonest shape of a
    page's postings (of equals the first on the page), and a pattern of their addresses, or null.

    On one host, postings that are query strings of one path share a key, the one whose values differ most; else their
    paths share a beginning. Beginnings are counted as rows: the longest that all of a page's postings have."""
    rows = labelled.where("is_job")
    path, pairs, segments = urls.part("href", "PATH"), urls.query_pairs("href"), urls.segments("href")
    rows = rows.select("page_id", "index", "href_shape", urls.host("href").alias("host"), path.alias("path"), pairs.alias("pairs"), urls.parents("href").alias("up"), F.size(segments).alias("depth"))
    flat = (F.size("pairs") > 0) & (F.col("depth") <= 1)
    page = rows.groupBy("page_id").agg(F.count("*").alias("n"), F.min("host").alias("host"), F.max("host").alias("last_host"), F.bool_and(flat).alias("flat"), F.min("path").alias("path"), F.max("path").alias("last_path"), F.min("depth").alias("depth"), F.max("depth").alias("last_depth"))
    shapes = rows.groupBy("page_id", "href_shape").agg(F.count("*").alias("k"), F.min("index").alias("at"))
    shape = shapes.groupBy("page_id").agg(F.max_by("href_shape", F.struct("k", -F.col("at"))).alias("url_shape"))
    begins = rows.where(F.size("up") > 0).select("page_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("up")), lambda k: F.slice("up", F.lit(1), k))).alias("begin"))
    common = begins.groupBy("page_id", "begin").agg(F.count("*").alias("k")).join(page.select("page_id", "n"), "page_id").where("k = n")
    prefix = common.groupBy("page_id").agg(F.max_by("begin", F.size("begin")).alias("begin"))
    keys = rows.select("page_id", "index", F.explode("pairs").alias("pair")).select("page_id", "index", F.split_part("pair", F.lit("="), F.lit(1)).alias("key"), F.expr("substring(pair, instr(pair, '=') + 1)").alias("value"))
    shared = keys.groupBy("page_id", "key").agg(F.count_distinct("index").alias("k"), F.count_distinct("value").alias("values")).join(page.select("page_id", "n"), "page_id").where("k = n")
    best = shared.groupBy("page_id").agg(F.min_by("key", F.struct(-F.col("values"), "key")).alias("key"))
    out = page.join(shape, "page_id").join(prefix, "page_id", "left").join(best, "page_id", "left")
    site = F.concat(F.lit(r"^https?://(www\.)?"), escaped(F.col("host")))
    by_key = F.when((F.col("path") == F.col("last_path")) & F.col("key").isNotNull(), F.concat(site, escaped(F.col("path")), F.lit(r"\?.*\b"), escaped(F.col("key")), F.lit("=")))
    tail = F.when((F.col("depth") == F.col("last_depth")) & (F.col("depth") == F.size("begin") + 1), r"[^/?#]+/?$").otherwise(r"[^?#]+$")
    by_path = F.when(F.col("begin").isNotNull(), F.concat(site, F.lit("/"), escaped(F.array_join("begin", "/")), F.lit("/"), tail))
    pattern = F.when(F.col("host") == F.col("last_host"), F.when(F.col("flat"), by_key).otherwise(by_path))
    return out.select("page_id", "url_shape", pattern.alias("include_url"))


def excludes(labelled: DataFrame, most: int = 10) -> DataFrame:
    """(page_id, exclude_url): patterns of the shapes that rejected links have and accepted ones do not, the first ``most``
    in the page's order (a plan keeps no more); shapes of query keys have none."""
    shapes = labelled.where("href_shape is not null and href_shape not like '%|?%'").groupBy("page_id", "href_shape").agg(F.bool_or("is_job").alias("job"), F.min("index").alias("at"))
    first = shapes.where("not job").withColumn("r", F.row_number().over(W.partitionBy("page_id").orderBy("at", "href_shape"))).where(F.col("r") <= most)
    part = F.split("href_shape", r"\|")
    pattern = F.concat(F.lit(r"^https?://(www\.)?"), escaped(part[0]), F.lit("/"), F.when(part[1] != "", F.concat(escaped(part[1]), F.lit("/"))).otherwise(""), F.lit("[^/?#]+/?$"))
    return first.groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", pattern.alias("p")))), lambda x: x["p"]).alias("exclude_url"))


def plan_holds(judged: DataFrame) -> DataFrame:
    """(page_id, holds): all labelled postings accepted and nothing else labelled accepted."""
    ok = F.col("verdict.accept")
    return judged.groupBy("page_id").agg((F.coalesce(F.min(ok.cast("int") == F.col("is_job").cast("int")), F.lit(True))).alias("holds"))
