"""What a posting must pass before it is stored, and what its text and page say about it being one."""

from __future__ import annotations

import hashlib
import inspect
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import rules, text, urls
from tessera.functions import vocabulary as V
from tessera.functions.text import c
from tessera.operators import jobs as J
from tessera.operators.taxonomy import family_of, skills_in

# --- fixed values: texts that no description has, and from which length on one such line says nothing
BOILERPLATE = ("manage consent", "store and/or access device information", "subscribe to our newsletter", "view preferences", "manage services", "manage {vendor_count} vendors", "all rights reserved")
BOILERPLATE_CHARS = 1500

# --- fixed values: programming languages as the page tags them; C alone is told from C++, C# and "Series C"
LANGUAGES = [
    ("C++", r"(?i)\bc\+\+"), ("C#", r"(?i)\bc#"), ("Objective-C", r"(?i)\bobjective-c\b"), ("Python", r"(?i)\bpython\b"), ("JavaScript", r"(?i)\bjavascript\b"),
    ("TypeScript", r"(?i)\btypescript\b"), ("Java", r"(?i)\bjava\b(?!\s*script)"), ("Go", r"(?i)\bgolang\b"), ("Ruby", r"(?i)\bruby\b"), ("PHP", r"(?i)\bphp\b"),
    ("Swift", r"(?i)\bswift\b"), ("Kotlin", r"(?i)\bkotlin\b"), ("Rust", r"(?i)\brust\b"), ("Scala", r"(?i)\bscala\b"), ("Perl", r"(?i)\bperl\b"),
    ("MATLAB", r"(?i)\bmatlab\b"), ("SQL", r"(?i)\bsql\b"), ("Bash/Shell", r"(?i)\bbash\b|\bshell scripting\b"), ("C", r"(?<!Series )(?<![A-Za-z0-9#+.-])C(?![A-Za-z0-9#+&-])"),
]

#: Providers that the first version of the resolver knew.
FIRST_PROVIDERS = ("greenhouse", "lever", "ashby", "workable", "comeet")


def relevance(fetched: DataFrame, companies: DataFrame) -> DataFrame:
    """``fetched`` (company_id, title, url, location) with ``refused``: the first reason against storing a row, or null.

    In order: no title; a host, then a hosted board, that exactly one other company has; site furniture; no posting;
    a place abroad. Owners are keys that one company alone has, so the joins add columns, never rows."""
    hosts = J.exclusive_owner(companies, urls.host("career_url")).select(F.col("key").alias("__host"), F.col("owner").alias("__host_owner"))
    boards = J.exclusive_owner(companies, urls.board("career_url")).select(F.col("key").alias("__board"), F.col("owner").alias("__board_owner"))
    rows = fetched.withColumn("title", F.trim("title")).withColumn("__host", urls.host("url")).withColumn("__board", urls.board("url"))
    rows = rows.join(hosts, "__host", "left").join(boards, "__board", "left")
    other = lambda owner: F.coalesce(F.col(owner) != F.col("company_id"), F.lit(False))
    why = rules.non_job_reason("title", "url")
    reason = (
        F.when(F.coalesce("title", F.lit("")) == "", "no title")
        .when(other("__host_owner"), "host of another company")
        .when(other("__board_owner"), "board of another company")
        .when(rules.site_furniture("title"), "site furniture")
        .when(why.isNotNull(), F.concat(F.lit("not a posting: "), why))
        .when(~rules.relevant_location("location"), "location")
    )
    return rows.withColumn("refused", reason).select(*fetched.columns, "refused")


def relevant_title(title: Column | str) -> Column:
    """Whether a title names any role family."""
    return (F.coalesce(c(title), F.lit("")) != "") & family_of(title).isNotNull()


def boilerplate(said: Column | str) -> Column:
    """A short text with a line that descriptions never have."""
    low = F.lower(F.coalesce(c(said), F.lit("")))
    return (F.length(low) < BOILERPLATE_CHARS) & F.exists(F.array(*map(F.lit, BOILERPLATE)), lambda m: F.contains(low, m))


def page_description(page: Column | str) -> Column:
    """A page's visible text as a description: empty where it is boilerplate."""
    said = text.visible_text(page)
    return F.when(boilerplate(said), "").otherwise(said)


def unparseable(title: Column | str, asked: Column, evidence: Column | None = None) -> Column:
    """Whether nothing says that a text is a posting: evidence without any sign (where there is evidence), or neither
    requirements (``asked``: how many) nor a title of a role family."""
    nothing = (F.coalesce(asked, F.lit(0)) == 0) & ~relevant_title(title)
    if evidence is None:
        return nothing
    sign = F.coalesce(evidence["jsonld_jobposting"], F.lit(False)) | F.coalesce(evidence["apply_cta"], F.lit(False)) | (F.coalesce(evidence["requirement_sections"], F.lit(0)) >= 1) | evidence["role_family_from_title"].isNotNull()
    return (evidence.isNotNull() & ~sign) | nothing


def languages(said: Column | str) -> Column:
    """The programming languages a text names, in the list's order."""
    x = F.coalesce(c(said), F.lit(""))
    return F.array_compact(F.array(*(F.when(x.rlike(p), F.lit(name)) for name, p in LANGUAGES)))


def cv_skills(said: Column | str) -> Column:
    """The vocabulary's skills in a CV, in its order."""
    return skills_in(said)


def cv_text(said: Column | str, keywords: Column | str) -> Column:
    """A profile's text; without one, a skills section of its keywords."""
    words = F.array_join(F.coalesce(c(keywords), F.array().cast("array<string>")), ", ")
    return F.coalesce(F.nullif(c(said), F.lit("")), F.when(words != "", F.concat(F.lit("Skills: "), words)).otherwise(""))


def marked_hebrew(rows: DataFrame) -> DataFrame:
    """Postings in Hebrew marked as such, with their texts kept as the originals, so that a later pass can translate them."""
    hit = text.contains_hebrew("title") | text.contains_hebrew("description")
    to = {"source_language": F.lit("he"), "title_original": F.coalesce("title", F.lit("")), "description_original": F.coalesce("description", F.lit(""))}
    base = [x for x in rows.columns if x not in to]
    old = {x: F.col(x) if x in rows.columns else F.lit(None).cast("string") for x in to}
    return rows.select(*base, *(F.when(hit, v).otherwise(old[k]).alias(k) for k, v in to.items()))


def mentions_company(url: Column | str, said: Column | str, domain: Column | str, company: Column | str) -> Column:
    """Whether a page names the company: its domain anywhere, else its name without the legal form as a whole phrase."""
    low = F.lower(F.concat_ws("\n", c(url), c(said)))
    own = F.lower(F.coalesce(c(domain), F.lit("")))
    bare = F.regexp_replace(F.coalesce(c(company), F.lit("")), r"(?i)\b(ltd|inc|llc|plc|gmbh|co|corp|corporation|limited)\b\.?", "")
    name = F.lower(F.btrim(bare, F.lit(" ,.-")))
    padded = lambda x: F.concat(F.lit(" "), F.regexp_replace(x, r"(?U)[^\w]+", " "), F.lit(" "))
    return ((own != "") & F.contains(low, own)) | ((F.length(name) > 2) & F.contains(padded(low), padded(name)))


def no_answer(answers: Column, keys: Column) -> Column:
    """Whether none of the key fields of ``answers`` (a map of texts) says anything."""
    silent = F.array(F.lit(""), F.lit("[]"), F.lit("{}"), F.lit("unknown"), F.lit("no_data"))
    return ~F.exists(keys, lambda k: F.coalesce(~F.array_contains(silent, F.coalesce(F.try_element_at(answers, k), F.lit(""))), F.lit(False)))


def legacy_id(company: Column | str, title: Column | str, url: Column | str) -> Column:
    """The first version's posting id: sixteen digits over company, title and address."""
    raw = F.concat(c(company), F.lit("|"), c(title), F.lit("|"), F.coalesce(c(url), F.lit("")))
    return F.substring(F.sha1(raw.cast("binary")), 1, 16)


def legacy_board(url: Column | str) -> Column:
    """The board of an address among the providers the first resolver knew, else null."""
    found = urls.board(url)
    return F.when(F.substring_index(found, ":", 1).isin(*FIRST_PROVIDERS), found)


def taxonomy_version(families: dict | None = None, titles: dict | None = None) -> str:
    """Twelve digits over the taxonomy: stored classifications of another version are made anew."""
    parts = [json.dumps(x, sort_keys=True, ensure_ascii=False) for x in (families or V.FAMILIES, titles or dict(V.SENIORITY_TITLES))]
    return hashlib.sha256("\0".join(parts).encode()).hexdigest()[:12]


def engine_version(*modules, config: dict | None = None) -> str:
    """Twelve digits over the source of ``modules`` and the scoring constants: a change of either makes stored scores stale."""
    digest = hashlib.sha256()
    for module in sorted(modules, key=lambda m: m.__name__):
        digest.update(inspect.getsource(module).encode())
    digest.update(json.dumps(config or {"weights": V.WEIGHTS, "gates": V.GATES, "bands": V.BANDS, "family_fit": V.FAMILY_FIT, "strength": V.STRENGTH}, sort_keys=True).encode())
    return digest.hexdigest()[:12]
