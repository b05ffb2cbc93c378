"""Deterministic rules over titles, locations, departments and pages, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import urls
from tessera.functions import vocabulary as V
from tessera.functions.text import c, collapse, visible_text, words_pattern


def first_match(text: Column, rules: list[tuple[str, str]], otherwise: Column | None = None) -> Column:
    """The value of the first pattern (value, pattern) found in ``text``."""
    out = reduce(lambda acc, r: acc.when(text.rlike(r[1]), r[0]), rules, F.when(F.lit(False), F.lit(None).cast("string")))
    return out.otherwise(otherwise) if otherwise is not None else out


def department(raw: Column | str) -> Column:
    text = collapse(raw)
    return F.when((text != "") & ~text.rlike(V.NOT_A_DEPARTMENT), first_match(text, [(name, "(?i)" + p) for p, name in V.DEPARTMENT_RULES]))


def department_for(family: Column | str, raw: Column | str) -> Column:
    pairs = F.create_map(*(F.lit(x) for kv in V.FAMILY_DEPARTMENT.items() for x in kv))
    return F.coalesce(F.try_element_at(pairs, c(family)), department(raw))


def is_remote(location: Column | str) -> Column:
    return F.coalesce(c(location).rlike(words_pattern(V.REMOTE_TERMS)), F.lit(False))


def relevant_location(location: Column | str) -> Column:
    """Remote, in the country, or not stated."""
    terms = [a for aliases in V.CITY_ALIASES.values() for a in aliases]
    return (F.coalesce(c(location), F.lit("")) == "") | is_remote(location) | F.coalesce(c(location).rlike(words_pattern(terms)), F.lit(False))


def canonical_city(location: Column | str) -> Column:
    return first_match(c(location), [(name.title(), words_pattern(aliases)) for name, aliases in V.CITY_ALIASES.items() if name != "israel"])


def english_location(location: Column | str) -> Column:
    x = F.nullif(c(location), F.lit(""))
    return F.when(x.isNull(), None).when(is_remote(x), "Remote").otherwise(F.coalesce(canonical_city(x), F.when(x.rlike("[֐-׿]"), "Israel").otherwise(F.trim(x))))


def work_mode(text: Column | str) -> Column:
    return first_match(F.coalesce(c(text), F.lit("")), [("hybrid", r"(?i)\bhybrid\b"), ("remote", r"(?i)\b(fully remote|remote[- ]first|work from home|100% remote|remote)\b"), ("onsite", r"(?i)\b(on[- ]?site|in[- ]office|office[- ]based)\b")])


def seniority(title: Column | str, years: Column | str) -> Column:
    by_years = F.when(c(years) <= 2, "junior").when(c(years) <= 5, "mid").when(c(years).isNotNull(), "senior").otherwise("mid")
    return first_match(F.coalesce(c(title), F.lit("")), V.SENIORITY_TITLES, by_years)


def seniority_level(name: Column | str) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in V.SENIORITY_LEVEL.items() for x in kv)), c(name))


def title_verdict(title: Column | str) -> Column:
    """Null to keep, else why an export drops the title."""
    x = F.coalesce(c(title), F.lit(""))
    return (
        F.when(x.rlike(words_pattern(V.TITLE_DROP)), "title drop-list")
        .when(x.rlike(words_pattern(V.TITLE_DROP_UNLESS_ENGINEER)) & ~x.rlike(r"(?i)\bengineer(ing)?\b"), "analyst without engineer")
        .when(~x.rlike(words_pattern(V.TITLE_KEEP)), "not on the title keep-list")
    )


def is_agency(company: Column | str) -> Column:
    return F.coalesce(c(company).rlike(words_pattern(V.AGENCY_MARKERS)), F.lit(False))


def site_furniture(text: Column | str) -> Column:
    x = collapse(text)
    return (x != "") & x.rlike(V.NAV_PREFIX) & ~x.rlike(V.ROLE_WORD)


def denied_text(text: Column | str) -> Column:
    """Link texts that are no title: too short or long, a nav label, a form token, an address, or hardly letters."""
    x = F.trim(F.coalesce(c(text), F.lit("")))
    return ~F.length(x).between(8, 120) | x.rlike(V.NAV_LABEL) | x.rlike(r"^\[#|#\]$") | x.rlike(r"^[\w.+-]+@[\w-]+\.[\w.-]+\??$") | x.rlike(r"(?i)^(https?://|www\.)") | ~(x.rlike("[A-Za-z]{3,}") | x.rlike("[א-ת]{2,}"))


def non_job_host(url: Column | str) -> Column:
    return reduce(lambda a, h: a | F.lower(c(url)).contains(h), V.NON_JOB_HOSTS, F.lit(False))


def non_job_segment(url: Column | str) -> Column:
    """The first path segment that never holds postings, or null."""
    return F.try_element_at(F.filter(urls.segments(F.lower(c(url))), lambda s: s.isin(V.NON_JOB_SEGMENTS)), F.lit(1))


def non_job_reason(title: Column | str, url: Column | str) -> Column:
    """Why a stored row is no posting, or null."""
    x, hint = collapse(title), urls.job_url_hint(url)
    return F.when(
        (x != "") & (F.coalesce(c(url), F.lit("")) != ""),
        F.when(x.rlike(V.NAV_LABEL), "nav label")
        .when(non_job_host(url), "href marker")
        .when(non_job_segment(url).isNotNull(), F.concat(F.lit("path segment "), non_job_segment(url)))
        .when(hint, None)
        .when(x.rlike(V.CTA_LABEL) | x.rlike(V.CTA_PREFIX), "call to action, no job-shaped url")
        .when(~x.rlike(V.ROLE_WORD), "no role word, no job-shaped url"),
    )


def fetch_outcome(status: Column | str, page: Column | str) -> Column:
    text = F.coalesce(c(page), F.lit(""))
    return F.when(c(status).isin(401, 403, 429) | text.rlike(V.BLOCKED), "blocked").when(F.trim(text) == "", "empty").otherwise("ok")


def posting_gone(url: Column | str, landed: Column | str, status: Column | str, page: Column | str) -> Column:
    """Why a posting is no longer live, or null; a wall says nothing about it."""
    return (
        F.when(c(status).isin(404, 410), F.concat(F.lit("http "), c(status).cast("string")))
        .when(F.coalesce(c(page), F.lit("")).rlike(V.BLOCKED), None)
        .when(F.coalesce(c(landed), F.lit("")).eqNullSafe("") == F.lit(False), F.when(urls.bounced_up(url, landed), F.concat(F.lit("redirected to "), c(landed))).when(F.substring(visible_text(page), 1, 4000).rlike(V.GONE), "board says the position is gone"))
        .when(F.substring(visible_text(page), 1, 4000).rlike(V.GONE), "board says the position is gone")
    )


def js_shell(page: Column | str) -> Column:
    return (F.length(visible_text(page)) < 500) & F.coalesce(c(page), F.lit("")).rlike(r'(?i)id="(root|app|__next)"|data-reactroot|ng-app|__NUXT__|enable javascript')


def years_bucket(years: Column | str) -> Column:
    return F.when(c(years).isNull(), "Unspecified").when(c(years) >= 9, "9+").otherwise(F.greatest(c(years), F.lit(1)).cast("string"))


def url_status_class(status: Column | str) -> Column:
    """Only 404 and 410 count as broken."""
    return F.when(c(status).isin(404, 410), "broken").when(c(status).isin(401, 403, 429), "blocked").when(c(status) >= 400, "error").when(c(status).isNull(), "unreachable").otherwise("ok")


def needs_recheck(last_checked: Column | str, now: Column, hours: int = 12) -> Column:
    """Unless it was checked in the last hours; what can't be read is checked again."""
    at = F.try_to_timestamp(c(last_checked))
    return F.coalesce(at + F.make_dt_interval(hours=F.lit(hours)) <= now, F.lit(True))
