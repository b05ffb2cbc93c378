"""Profiles from CV texts.

Reading a text's lines is a walk with memory (which section, which role), so one Arrow function returns what the lines
say: roles, the text of the skills section, and what fixed patterns find. All that is derived from it, skills, seniority,
families, years and evidence, is expressions. CVs are few; postings are not read here."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import rules
from tessera.functions import vocabulary as V
from tessera.operators import scoring
from tessera.operators.scoring import GENERIC, Families, Skills

DATES = re.compile(rf"(?i)((?:{V.CV_MONTH}\.?\s+|\d{{1,2}}/)?\d{{4}})\s*(?:[-–—]|to)\s*((?:{V.CV_MONTH}\.?\s+|\d{{1,2}}/)?\d{{4}}|{V.CV_NOW})")
GLYPH, JOB_WORD = re.compile(V.CV_BULLET), re.compile(V.CV_JOB_WORD)
_headers = sorted([*((w, "experience") for w in V.CV_EXPERIENCE_HEADERS), *((w, "skills") for w in V.CV_SKILLS_HEADERS), *((w, "other") for w in V.CV_OTHER_HEADERS)], key=lambda h: -len(h[0]))
HEADERS = [(re.compile(rf"(?i)^{re.escape(w)}(?=$|[:\s])\s*:?\s*(.*)$"), kind) for w, kind in _headers]

ROLE = T.StructType([T.StructField("title", T.StringType()), T.StructField("company", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("present", T.BooleanType()), T.StructField("bullets", T.ArrayType(T.StringType())), T.StructField("family", T.StringType()), T.StructField("skills", T.ArrayType(T.StringType()))])
READ = T.StructType([T.StructField("roles", T.ArrayType(ROLE)), *(T.StructField(n, T.ArrayType(T.StringType())) for n in ("listed", "education", "certifications", "languages")), T.StructField("location", T.StringType())])


def _year(text: str) -> int | None:
    m = re.search(r"\d{4}", text)
    return int(m[0]) if m else None


def header(line: str) -> tuple[str, str] | None:
    """(kind of section, text beside the header) if the line begins one."""
    return next(((kind, m[1]) for p, kind in HEADERS if (m := p.match(line.strip()))), None)


def headline(above: str, beside: str) -> tuple[str, str | None, bool]:
    """(title, company, whether the line above belongs to the role) of the text beside a role's dates and the line above.

    Two parts beside the dates are title and company. Else the line above is the title, unless only the text beside the
    dates names a job: then the line above is the company."""
    beside = beside.strip(" -|,:–—")
    parts = re.split(r"\s*[|,]\s*", beside)
    if beside and len(parts) > 1:
        return parts[0].strip(), parts[1].strip(), False
    above = above.strip()
    if not above or above[0] in "-*•●‣⁃" or DATES.search(above):
        return beside, None, False
    if not beside:
        return above, None, True
    swapped = JOB_WORD.search(beside) and not JOB_WORD.search(above)
    return (beside, above, True) if swapped else (above, beside, True)


def roles_of(lines: list[str]) -> list[dict]:
    """Roles in the order of the text. Only dates within experience, or before any header, begin a role; lines after it
    are its bullets, and where bullets are marked, an unmarked line goes on with the one before."""
    where, kinds = "experience", []
    for line in lines:
        found = header(line)
        where = found[0] if found else where
        kinds.append(where)
    starts = []
    for i, line in enumerate(lines):
        m = DATES.search(line) if kinds[i] == "experience" else None
        if m:
            title, company, above = headline(lines[i - 1] if i else "", line[: m.start()] + line[m.end() :])
            if title:
                starts.append((i, i - above, title, company, m))
    out = []
    for k, (i, _, title, company, m) in enumerate(starts):
        until = starts[k + 1][1] if k + 1 < len(starts) else len(lines)
        body = [x for x, kind in zip(lines[i + 1 : until], kinds[i + 1 : until]) if kind == "experience"]
        marked, bullets = any(GLYPH.match(x) for x in body), []
        for x in body:
            words = GLYPH.sub("", x.strip() + " ").strip()
            if not words or words == company or header(x) or DATES.search(x):
                continue
            if marked and bullets and not GLYPH.match(x):
                bullets[-1] += " " + words
            else:
                bullets.append(words)
        now = re.fullmatch(rf"(?i){V.CV_NOW}", m[2].strip()) is not None
        out.append({"title": title, "company": company, "start": _year(m[1]), "end": None if now else _year(m[2]), "present": now, "bullets": bullets})
    return out


def skills_text(lines: list[str]) -> str:
    """What stands beside the skills headers, or below those that stand alone."""
    out, inside = [], False
    for line in lines:
        found = header(line)
        if found:
            inside = found[0] == "skills" and not found[1]
            out += [found[1]] if found[0] == "skills" else []
        elif inside:
            out.append(line)
    return "\n".join(out)


@F.arrow_udf(READ)
def read_cv(texts: pa.Array) -> pa.Array:
    skills, families, rows = Skills(), Families(), []
    every = {n: re.compile(p) for n, p in (("education", V.DEGREE), ("certifications", V.CERTIFICATION), ("languages", V.LANGUAGE))}
    places = [re.compile(V.LOCATION), re.compile(V.CV_CITY)]
    for text in texts.to_pylist():
        text = text or ""
        lines = [x.rstrip() for x in text.splitlines()]
        roles = roles_of(lines)
        for r in roles:
            said = " ".join(r["bullets"])
            r["family"] = families.of(r["title"]) or (families.of(said) if GENERIC.match(" ".join(r["title"].split())) else None)
            r["skills"] = skills.find(f"{r['title']} {said}")
        found = {n: [m[0].strip() for m in p.finditer(text)] for n, p in every.items()}
        place = next((m[0].strip() for p in places if (m := p.search(text))), None)
        rows.append({"roles": sorted(roles, key=lambda r: -(r["start"] or 0)), "listed": skills.find(skills_text(lines)), **found, "location": place})
    texts_of = pa.list_(pa.string())
    role = pa.struct([("title", pa.string()), ("company", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("present", pa.bool_()), ("bullets", texts_of), ("family", pa.string()), ("skills", texts_of)])
    return pa.array(rows, pa.struct([("roles", pa.list_(role)), *((n, texts_of) for n in ("listed", *every)), ("location", pa.string())]))


def evidence_depth(bullets: Column) -> Column:
    """Share of bullets that state scale, ownership or an outcome, times 150, at most 100; 0 without bullets."""
    hits = F.size(F.filter(bullets, lambda b: b.rlike(V.EVIDENCE_MARKER)))
    return F.when(F.size(bullets) > 0, F.least(F.lit(100), F.bround(150.0 * hits / F.size(bullets)).cast("int"))).otherwise(0)


def skill_evidence(roles: Column, listed: Column, now_year: int) -> Column:
    """(canonical, strength, recency) per skill: strong from roles, at the least known recency of those after the first
    whose recency is known; weak if only listed."""
    recent = lambda r: F.when(r["present"], 0).otherwise(F.greatest(F.lit(0), F.lit(now_year) - r["end"]))
    names = F.array_distinct(F.flatten(F.transform(roles, lambda r: r["skills"])))

    def strong(name: Column) -> Column:
        ages = F.transform(F.filter(roles, lambda r: F.array_contains(r["skills"], name)), recent)
        first = F.get(ages, F.lit(0))
        return F.struct(name.alias("canonical"), F.lit("strong").alias("strength"), F.when(first.isNotNull(), F.array_min(F.array_compact(ages))).cast("int").alias("recency"))

    weak = F.transform(F.array_except(listed, names), lambda n: F.struct(n.alias("canonical"), F.lit("weak").alias("strength"), F.lit(None).cast("int").alias("recency")))
    return F.concat(F.transform(names, strong), weak)


def families(roles: Column, now_year: int) -> Column:
    """Family to affinity, the strongest at 1: durations that fade with the years since a role ended."""
    end = lambda r: F.when(r["present"], F.lit(now_year)).otherwise(F.coalesce(r["end"], F.lit(now_year)))
    known = F.filter(roles, lambda r: r["family"].isNotNull() & r["start"].isNotNull())
    weighed = F.transform(known, lambda r: F.struct(r["family"].alias("family"), (F.greatest((end(r) - r["start"]).cast("double"), F.lit(0.5)) * scoring.decay(F.greatest(F.lit(now_year) - end(r), F.lit(0)))).alias("w")))
    names = F.array_distinct(F.transform(weighed, lambda x: x["family"]))
    sums = F.transform(names, lambda n: F.struct(n.alias("family"), F.aggregate(F.filter(weighed, lambda x: x["family"] == n), F.lit(0.0), lambda a, x: a + x["w"]).alias("w")))
    top = F.array_max(F.transform(sums, lambda s: s["w"]))
    return F.map_from_entries(F.transform(F.filter(sums, lambda s: s["w"] > 0), lambda s: F.struct(s["family"], F.round(s["w"] / top, 4))))


def recent_fraction(roles: Column, family: Column, now_year: int, window: int = 5) -> Column:
    """Share of the years worked within the window that were in ``family``; null without any."""
    low = now_year - window
    end = lambda r: F.when(r["present"], F.lit(now_year)).otherwise(r["end"])
    worked = lambda r: F.when(end(r).isNull() | r["start"].isNull(), 0).otherwise(F.greatest(F.lit(0), F.least(end(r), F.lit(now_year)) - F.greatest(r["start"], F.lit(low))))
    years = lambda rs: F.aggregate(rs, F.lit(0), lambda a, r: a + worked(r))
    return F.try_divide(years(F.filter(roles, lambda r: r["family"] == family)).cast("double"), years(roles).cast("double"))


def with_overrides(affinity: Column, overrides: Column) -> Column:
    """``affinity`` with ``overrides`` (family to boost or block): a blocked family has 0, a boosted one the greatest
    plus a quarter, then all are scaled to a greatest of 1."""
    known = F.array(*map(F.lit, V.FAMILIES))
    names = F.array_distinct(F.concat(F.map_keys(affinity), F.array_intersect(known, F.map_keys(F.map_filter(overrides, lambda _, v: v == "boost")))))
    blocked = lambda n: F.coalesce(F.try_element_at(overrides, n) == "block", F.lit(False))
    top = F.coalesce(F.array_max(F.transform(F.filter(F.map_keys(affinity), lambda n: ~blocked(n)), lambda n: F.try_element_at(affinity, n))), F.lit(0.0))
    of = lambda n: F.when(blocked(n), 0.0).when(F.try_element_at(overrides, n) == "boost", top + 0.25).otherwise(F.coalesce(F.try_element_at(affinity, n), F.lit(0.0)))
    values = F.transform(names, of)
    best = F.array_max(values)
    return F.when(F.coalesce(F.size(overrides), F.lit(0)) > 0, F.map_from_arrays(names, F.transform(values, lambda v: F.when(best > 0, F.round(v / best, 4)).otherwise(v)))).otherwise(affinity)


def profiles(cvs: DataFrame, idf: DataFrame, now_year: int) -> DataFrame:
    """Profiles, as ``score_jobs`` takes them, of ``cvs`` (profile_id, text and, if there, overrides map). Null and empty
    texts give a profile without roles or skills."""
    known = idf.agg(F.map_from_entries(F.collect_list(F.struct("term", "idf"))).alias("__idf"))  # one row, of a vocabulary
    rows = cvs.withColumn("__r", read_cv("text"))
    rows = rows.select("profile_id", *(["overrides"] if "overrides" in cvs.columns else []), "__r.*")
    rows = rows.withColumns({"skills": skill_evidence(F.col("roles"), F.col("listed"), now_year), "families": families(F.col("roles"), now_year)})
    if "overrides" in cvs.columns:
        rows = rows.withColumn("families", with_overrides(F.col("families"), F.col("overrides")))
    rows = rows.crossJoin(F.broadcast(known))
    first, years = F.get("roles", F.lit(0)), F.lit(now_year) - F.array_min(F.transform("roles", lambda r: r["start"]))
    by_years = F.when(years <= 2, "junior").when(years <= 5, "mid").when(years.isNotNull(), "senior").otherwise("mid")
    signature = F.array_sort(F.transform(F.filter("skills", lambda s: (s["strength"] == "strong") & (F.coalesce(F.try_element_at("__idf", s["canonical"]), F.lit(0.0)) >= V.SIGNATURE_IDF)), lambda s: s["canonical"]))
    text_of = F.transform("roles", lambda r: F.concat_ws(" ", F.array(r["title"]), r["bullets"]))
    return rows.select(
        "profile_id",
        F.get(F.filter(F.transform(F.slice("roles", 1, 2), lambda r: r["family"]), lambda f: f.isNotNull()), F.lit(0)).alias("family"),
        "families", rules.first_match(F.coalesce(first["title"], F.lit("")), V.CV_SENIORITY, by_years).alias("seniority"), years.cast("int").alias("years"),
        "education", "certifications", "languages", F.array_compact(F.array("location")).alias("places"), text_of.alias("roles"),
        evidence_depth(F.flatten(F.transform("roles", lambda r: r["bullets"]))).alias("evidence"), "skills", F.array_distinct(signature).alias("signature"),
    )
