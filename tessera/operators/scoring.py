"""Requirements from posting texts, and the deterministic score of a posting for a profile.

Texts become arrays of structs inside the row, so no posting is shuffled to be read. A score joins a posting's
requirements with a profile by expressions alone; profiles are few and sit in a side whose size the planner knows."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import vocabulary as V
from tessera.functions.rules import seniority, seniority_level
from tessera.functions.text import c
from tessera.operators.kept import stored
from tessera.operators.taxonomy import GENERIC_TITLE, word

#: A line end, a bullet, a sentence's end, or white space between a lower-case end and a capitalised word.
SEGMENT = re.compile(r"[\r\n]+|[•●‣⁃]+|(?<=[.!?])\s+(?=[A-Z0-9])|(?<=[a-z0-9)%])(\s+)(?=[A-Z][a-z]{2,})")
CONNECTORS, LAST_WORD = frozenset(V.NO_BREAK_AFTER), re.compile(r"\w+$")
HEADER, SOFT, HARD, BULLET_YEARS = re.compile(V.SECTION_HEADER), re.compile(V.SOFTENER), re.compile(V.HARD_WORD), re.compile(V.YEARS_BULLET)
YEARS = [re.compile(p) for p in V.YEARS_TOTAL]
#: kind, what a text must hold for its pattern to match, pattern
KINDS = [
    ("degree", ("sc", "bachelor", "master", "ph", "doctorate", "degree"), re.compile(V.DEGREE)),
    ("certification", ("certif", "cissp", "ccna", "ccnp", "pmp", "ckad", "cka", "oscp"), re.compile(V.CERTIFICATION)),
    ("language", ("fluent", "native", "speaker", "proficiency", "required", "fluency"), re.compile(V.LANGUAGE)),
    ("location", ("site", "hybrid", "must be", "relocation", "based in"), re.compile(V.LOCATION)),
]
GENERIC = re.compile(GENERIC_TITLE)
BULLET = re.compile(r"^\s*[-*•●‣⁃]\s*|^\s*\d+[.)]\s*")
REQUIREMENT = T.StructType([T.StructField(n, T.IntegerType() if n == "years" else T.StringType()) for n in ("bucket", "kind", "text", "canonical", "years", "reads_as")])
FOUND = T.StructType([T.StructField("requirements", T.ArrayType(REQUIREMENT)), T.StructField("years", T.IntegerType()), T.StructField("family", T.StringType()), T.StructField("confidence", T.StringType())])


def segments(text: str) -> list[str]:
    """Bullet-like pieces; a capitalised word after a connector ("with Python") does not begin one."""
    out, at = [], 0
    for m in SEGMENT.finditer(text):
        if m[1]:
            last = LAST_WORD.search(text, max(at, m.start() - 8), m.start())
            if last and last[0] in CONNECTORS:
                continue
        out.append(text[at : m.start()].strip())
        at = m.end()
    out.append(text[at:].strip())
    return [s for s in out if s]


def sections(text: str) -> list[tuple[str, str]]:
    """(bucket, bullet) in order: each header owns what follows it, and text before the first is 'other'."""
    out, bucket, at = [], "other", 0
    for m in [*HEADER.finditer(text), None]:
        out += [(bucket, s) for s in segments(text[at : m.start() if m else len(text)])]
        if m:
            name, at = m[1].strip().lower(), m.end()
            bucket = "nice" if name in V.NICE_HEADERS else "responsibility" if name in V.RESPONSIBILITY_HEADERS else "must"
    return out


class Skills:
    """Skills of a vocabulary in a text: a plain search rules out nearly all, a word search settles the rest."""

    def __init__(self, skills: list[tuple[str, list[str]]] = V.SKILLS):
        self.known = [(name, [(a.lower(), re.compile(word(a))) for a in aliases]) for name, aliases in skills]

    def within(self, text: str) -> Skills:
        """The skills that can occur in any part of the text."""
        low, out = text.lower(), Skills([])
        out.known = [k for k in self.known if any(a in low for a, _ in k[1])]
        return out

    def find(self, text: str) -> list[str]:
        low = text.lower()
        return [name for name, aliases in self.known if any(a in low and p.search(low) for a, p in aliases)]


def bullet_years(text: str) -> int | None:
    m = BULLET_YEARS.search(text) if "year" in text.lower() else None
    return int(m[1] or m[3]) if m else None


def requirements_of(bucket: str, line: str, skills: Skills) -> list[tuple]:
    """One requirement per skill of a bullet, else one of the bullet's kind."""
    text = BULLET.sub("", line).strip()
    if not text:
        return []
    where = "nice" if bucket == "nice" or not HARD.search(text) and SOFT.search(text) else "must"
    found, years = skills.find(text), bullet_years(text)
    if found:
        return [(where, "skill", text, s, years if len(found) == 1 else None) for s in found]
    low = text.lower()
    kind = next((k for k, marks, p in KINDS if any(x in low for x in marks) and p.search(text)), None) or ("years" if years is not None or "year" in low and re.search(r"\byears?\b", low) else "domain")
    return [(where, kind, text, None, years if kind == "years" else None)]


class Families:
    """The family with most keywords in a text; of equals the one found earliest, then the first listed."""

    def __init__(self, families: dict[str, list[str]] = V.FAMILIES):
        self.known = [(name, [(w.lower(), re.compile(word(w))) for w in words]) for name, words in families.items()]

    def within(self, text: str) -> Families:
        """The families whose keywords can occur in any part of the text."""
        low, out = text.lower(), Families({})
        out.known = [(name, own) for name, words in self.known if (own := [w for w in words if w[0] in low])]
        return out

    def of(self, text: str) -> str | None:
        low, best = text.lower(), (0, 0, None)
        for name, words in self.known:
            at = [m.start() for w, p in words if w in low and (m := p.search(low))]
            if at and (best[2] is None or (len(at), -min(at)) > best[:2]):
                best = (len(at), -min(at), name)
        return best[2]


@F.arrow_udf(FOUND)
def read_posting(titles: pa.Array, texts: pa.Array) -> pa.Array:
    """Requirements, the most years stated outside nice-to-haves, and the role family: from the title, from the text
    only where the title is generic."""
    skills, families, rows = Skills(), Families(), []
    for title, text in zip(titles.to_pylist(), texts.to_pylist()):
        title, text = title or "", text or ""
        bullets, own, near = sections(text), skills.within(text), families.within(text)
        asked = [dict(zip(("bucket", "kind", "text", "canonical", "years"), r), reads_as=near.of(r[2]) if r[0] == "must" else None) for b, line in bullets if b in ("must", "nice") for r in requirements_of(b, line, own)]
        years = [int(m[1]) for b, line in bullets if b != "nice" and "year" in line.lower() for p in YEARS for m in p.finditer(line)]
        family, confidence = families.of(title), "title"
        if family is None and GENERIC.match(" ".join(title.split())):
            family, confidence = families.of(" ".join(line for b, line in bullets if b == "responsibility")) or families.of(text), "jd_fallback"
        rows.append({"requirements": asked, "years": max(years, default=None), "family": family, "confidence": confidence if family else "unknown"})
    struct = pa.struct([("bucket", pa.string()), ("kind", pa.string()), ("text", pa.string()), ("canonical", pa.string()), ("years", pa.int32()), ("reads_as", pa.string())])
    return pa.array(rows, pa.struct([("requirements", pa.list_(struct)), ("years", pa.int32()), ("family", pa.string()), ("confidence", pa.string())]))


def extract(jobs: DataFrame) -> DataFrame:
    """``jobs`` (id, title, description) with requirements, years_required, seniority, family and its confidence."""
    rows = jobs.withColumn("__r", read_posting("title", F.coalesce("description", F.lit(""))))
    rows = rows.withColumns({"requirements": F.col("__r.requirements"), "years_required": F.col("__r.years"), "family": F.col("__r.family"), "family_confidence": F.col("__r.confidence")})
    return rows.withColumn("seniority", seniority("title", "years_required")).drop("__r")


# ---------------------------------------------------------------- matching and scoring


def strength_weight(name: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in V.STRENGTH.items() for x in kv)), name)


def skill_strength(evidence: Column, recency: Column, same_family: Column) -> Column:
    """evidence: strong, weak or null."""
    return F.when(evidence.isNull(), "none").when((evidence == "strong") & (recency > V.STALE_YEARS), "medium").when(evidence == "strong", "strong").when(same_family, "medium").otherwise("weak")


def years_strength(have: Column, need: Column) -> Column:
    return F.when(have.isNull() | need.isNull(), "none").when(have >= need, "strong").when(have >= need - 1, "medium").otherwise("none")


def long_words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda w: F.length(w) > 3))


def list_strength(entries: Column, text: Column) -> Column:
    low = F.lower(text)
    hit = F.exists(F.coalesce(entries, F.array().cast("array<string>")), lambda e: low.contains(F.lower(e)) | F.contains(F.lower(e), low) | (F.size(F.array_intersect(long_words(e), long_words(text))) >= 2))
    return F.when(hit, "strong").otherwise("none")


def domain_strength(roles: Column, text: Column) -> Column:
    """The first role (title, bullets) that shares a long word decides."""
    shared = F.filter(F.transform(F.coalesce(roles, F.array().cast("array<string>")), lambda r: F.size(F.array_intersect(long_words(r), long_words(text)))), lambda n: n > 0)
    first = F.get(shared, F.lit(0))
    return F.when(first >= 3, "strong").when(first >= 1, "weak").otherwise("none")


def coverage(weight: Column, strength: Column, place: Column) -> Column:
    """Aggregate: share of requirement weight that is matched, 0 to 100, rounded half to even; 100 for none.

    Doubles are added in the order of ``place``: where the share is half a point, another order rounds to another number, and
    a plain sum's order depends on how the rows are split and on which task ends first."""
    zero = F.lit(0.0)
    rows = F.array_sort(F.collect_list(F.when(weight.isNotNull(), F.struct(place.alias("place"), weight.cast("double").alias("total"), (strength * weight).cast("double").alias("part")))))
    added = lambda s, r: F.struct(*((s[x] + F.coalesce(r[x], zero)).alias(x) for x in ("total", "part")))
    share = lambda s: F.when(s["total"] > 0, F.bround(100.0 * s["part"] / s["total"])).otherwise(0)
    return F.when(F.count(weight) == 0, 100).otherwise(F.aggregate(rows, F.struct(zero.alias("total"), zero.alias("part")), added, share)).cast("int")


def seniority_fit(gap: Column) -> Column:
    return F.greatest(F.lit(0), 100 - 30 * F.abs(gap))


def gates(score: Column, unmet_hard: Column, missing_skills: Column, gap: Column) -> Column:
    g = V.GATES
    capped = F.least(
        score,
        F.when(unmet_hard > 0, g["unmet_hard"]).otherwise(100),
        F.when(missing_skills >= g["missing_skills_from"], g["missing_skills"]).otherwise(100),
        F.when(F.abs(gap) >= g["seniority_gap_from"], g["seniority_gap"]).otherwise(100),
    )
    return F.greatest(F.lit(0), F.least(F.lit(100), capped))


def gate_names(unmet_hard: Column, missing_skills: Column, gap: Column, fit: Column) -> Column:
    g = V.GATES
    return F.array_compact(F.array(F.when(unmet_hard > 0, "unmet_hard_requirement"), F.when(missing_skills >= g["missing_skills_from"], "missing_skills"), F.when(F.abs(gap) >= g["seniority_gap_from"], "seniority_gap"), F.when(fit < V.FAMILY_FIT["gate"], "family_fit_low")))


def band(score: Column | str) -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for low, name in V.BANDS:
        out = out.when(c(score) >= low, name)
    return out


def final_score(must: Column, senior: Column, nice: Column, evidence: Column, bonus: Column, penalty: Column, unmet: Column, missing: Column, gap: Column, fit: Column, w: dict = V.WEIGHTS, f: dict = V.FAMILY_FIT) -> Column:
    """The score of its parts; ``w`` and ``f`` may hold columns, as a search for weights has them."""
    raw = w["must"] * must + w["seniority"] * senior + w["nice"] * nice + w["evidence"] * evidence
    own = F.greatest(F.lit(0), F.least(F.lit(100), F.bround(raw + bonus - penalty))).cast("int")
    score = F.bround(fit * gates(own, unmet, missing, gap)).cast("int")
    return F.greatest(F.lit(0), F.least(F.lit(100), F.when(fit < f["gate"], F.least(score, F.lit(f["cap"]).cast("int"))).otherwise(score)))


def decay(ended_years_ago: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - ended_years_ago / V.DECAY_YEARS)


def role_weight(start: Column, end: Column, now_year: int) -> Column:
    return F.greatest(end - start, F.lit(0.5)) * decay(F.lit(now_year) - end)


def affinity(roles: DataFrame, now_year: int) -> DataFrame:
    """(profile_id, family, weight) of ``roles`` (profile_id, family, start, end), the best family at 1."""
    sums = roles.where("family is not null").groupBy("profile_id", "family").agg(F.sum(role_weight(F.col("start"), F.col("end"), now_year)).alias("w"))
    top = F.max("w").over(W.partitionBy("profile_id"))
    return sums.select("profile_id", "family", F.round(F.try_divide(F.col("w"), top), 4).alias("weight")).where("weight is not null")


def fits(weights: DataFrame, matrix: DataFrame) -> DataFrame:
    """(profile_id, fits): the best path from a profile's families to each family, as a map. Rows are profiles by families."""
    paths = weights.join(matrix.select(F.col("a").alias("family"), F.col("b").alias("__to"), "affinity"), "family").groupBy("profile_id", "__to").agg(F.max(F.col("weight") * F.col("affinity")).alias("fit"))
    return paths.groupBy("profile_id").agg(F.map_from_entries(F.collect_list(F.struct("__to", "fit"))).alias("fits"))


def family_fit(family: Column, by_family: Column) -> Column:
    """A posting without a family is neutral; one that no path reaches has the floor."""
    return F.when(family.isNull(), V.FAMILY_FIT["unknown"]).otherwise(F.coalesce(F.try_element_at(by_family, family), F.lit(V.FAMILY_FIT["floor"])))


def with_profiles(rows: DataFrame, profiles: DataFrame, most: int = 2000) -> DataFrame:
    """Every row for every profile. Profiles are broadcast once counted to be no more than ``most``; beyond, rows are
    dealt out by profile."""
    if profiles.count() <= most:
        return rows.crossJoin(F.broadcast(profiles))
    groups = profiles.withColumn("__g", F.pmod(F.xxhash64("profile_id"), F.lit(64)))
    return rows.withColumn("__g", F.explode(F.sequence(F.lit(0), F.lit(63))).cast("long")).join(groups, "__g").drop("__g")


def match(jobs: DataFrame, profiles: DataFrame, idf: DataFrame, matrix: DataFrame) -> DataFrame:
    """The parts of a score of ``jobs`` (id, title, description) for ``profiles`` (profile_id, skills array of (canonical,
    strength, recency), signature array, family, families map, seniority, years, education, certifications, languages,
    places, roles, evidence).

    (id, profile_id, must, senior, nice, evidence, signature, clashes, unmet, missing, gap, fit, named, chars); clashes are
    (affinity, weight) of matched must-haves that read as another family than the posting's. All of a posting's
    requirements are matched within its row: there is no shuffle of postings. Postings that have been read already (see
    ``extract``) are not read again."""
    known = idf.agg(F.map_from_entries(F.collect_list(F.struct("term", "idf"))).alias("__idf"))  # one row, of a vocabulary
    near = matrix.groupBy("a", "b").agg(F.max("affinity").alias("x")).agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("\u0000", "a", "b"), "x"))).alias("__near"))
    known = known.crossJoin(near)  # one row each, of vocabularies
    weights = profiles.select("profile_id", F.explode("families").alias("family", "weight"))
    people = profiles.join(fits(weights, matrix), "profile_id", "left").crossJoin(F.broadcast(known))
    people = people.select(*(F.col(c).alias(f"p_{c}") if c != "profile_id" else F.col(c) for c in people.columns))
    along = [x for x in ("title", "job_evidence") if x in jobs.columns]
    read = jobs if {"requirements", "family", "seniority"} <= set(jobs.columns) else extract(jobs)
    asked = read.select("id", F.col("family"), "seniority", "requirements", F.length("description").alias("chars"), *along)
    rows = with_profiles(asked, people)
    same = F.coalesce(F.col("p_family") == F.col("family"), F.lit(False))

    def strength(r: Column) -> Column:
        own = F.get(F.filter("p_skills", lambda s: s["canonical"] == r["canonical"]), F.lit(0))
        return (
            F.when(r["kind"] == "skill", skill_strength(own["strength"], own["recency"], same))
            .when(r["kind"] == "years", years_strength(F.col("p_years"), r["years"]))
            .when(r["kind"] == "degree", list_strength(F.col("p_education"), r["text"]))
            .when(r["kind"] == "certification", list_strength(F.col("p_certifications"), r["text"]))
            .when(r["kind"] == "language", list_strength(F.col("p_languages"), r["text"]))
            .when(r["kind"] == "location", list_strength(F.col("p_places"), r["text"]))
            .otherwise(domain_strength(F.col("p_roles"), r["text"]))
        )

    weight = lambda r: F.when(r["kind"] == "skill", F.coalesce(F.try_element_at("p___idf", r["canonical"]), F.lit(1.0))).otherwise(F.lit(1.0))
    rows = rows.withColumn("m", F.transform("requirements", lambda r: F.struct(r["bucket"].alias("bucket"), r["kind"].alias("kind"), r["canonical"].alias("canonical"), r["reads_as"].alias("reads_as"), r["text"].alias("text"), strength(r).alias("s"), weight(r).alias("w"))))

    def covered(bucket: str) -> Column:
        own = F.filter("m", lambda x: x["bucket"] == bucket)
        total = F.aggregate(own, F.lit(0.0), lambda a, x: a + x["w"])
        hit = F.aggregate(own, F.lit(0.0), lambda a, x: a + x["w"] * strength_weight(x["s"]))
        return F.when(F.size(own) == 0, 100).when(total > 0, F.bround(100.0 * hit / total)).otherwise(0).cast("int")

    unmatched = lambda kinds: F.size(F.filter("m", lambda x: (x["bucket"] == "must") & (x["s"] == "none") & x["kind"].isin(kinds)))
    gap = seniority_level("p_seniority") - seniority_level("seniority")
    rows = rows.withColumns({"must": covered("must"), "nice": covered("nice"), "unmet": unmatched(["degree", "certification", "language", "location"]), "missing": unmatched(["skill"]), "gap": gap, "fit": family_fit(F.col("family"), F.col("p_fits"))})
    named = F.array_distinct(F.array_compact(F.transform("m", lambda x: x["canonical"])))
    other = F.filter("m", lambda x: (x["bucket"] == "must") & (x["s"] != "none") & (x["reads_as"] != F.col("family")))
    clashes = F.transform(other, lambda x: F.struct(F.coalesce(F.try_element_at("p___near", F.concat_ws("\u0000", x["reads_as"], F.col("family"))), F.lit(0.0)).alias("affinity"), strength_weight(x["s"]).alias("weight")))
    own = F.coalesce(F.col("p_signature"), F.array().cast("array<string>")) if "signature" in profiles.columns else F.array().cast("array<string>")
    matched = F.array_sort(F.array_distinct(F.array_compact(F.transform("m", lambda x: F.when(x["s"] != "none", x["canonical"])))))
    return rows.select("id", "profile_id", "must", seniority_fit(F.col("gap")).alias("senior"), "nice", F.col("p_evidence").alias("evidence"), (F.size(F.array_intersect(named, own)) >= 2).alias("signature"), clashes.alias("clashes"), "unmet", "missing", "gap", "fit", matched.alias("matched"), "chars", gaps(F.col("m"), same, F.col("gap")).alias("gaps"), covered_counts(F.col("m")).alias("covered"), (F.size("requirements") == 0).alias("asks_nothing"), *along)


def gaps(m: Column, same_family: Column, gap: Column, most: int = 3) -> Column:
    """What keeps a score down, the weightiest first: must-haves without a match, another family, another level, must-haves
    that are hardly shown, nice-to-haves without a match."""
    lines = lambda bucket, strength, lead: F.transform(F.filter(m, lambda x: (x["bucket"] == bucket) & (x["s"] == strength)), lambda x: F.concat(F.lit(lead), x["text"]))
    level = F.concat(F.lit("Seniority is "), F.abs(gap).cast("string"), F.lit(" level(s) "), F.when(gap > 0, "more senior").otherwise("less senior"), F.lit(" than the job"))
    family = F.when(~same_family, "Recent role family does not match the job's role family")
    every = F.concat(lines("must", "none", "Missing must-have: "), F.array_compact(F.array(family, F.when(gap != 0, level))), lines("must", "weak", "Weak evidence for must-have: "), lines("nice", "none", "Missing nice-to-have: "))
    return F.slice(every, 1, most)


def covered_counts(m: Column) -> Column:
    """(matched, asked) must-haves."""
    must = F.filter(m, lambda x: x["bucket"] == "must")
    return F.struct(F.size(F.filter(must, lambda x: x["s"] != "none")).alias("matched"), F.size(must).alias("asked"))


def summary(score: Column, name: Column, covered: Column, found: Column) -> Column:
    """A score in two sentences."""
    first = F.format_string("This CV scores %d/100 (%s), covering %d of %d must-have requirements.", score, name, covered["matched"], covered["asked"])
    worst = F.get(found, F.lit(0))
    return F.concat(first, F.when(worst.isNull(), " No significant gaps identified.").otherwise(F.concat(F.lit(" Biggest gap: "), worst, F.lit("."))))


def penalty(clashes: Column, f: dict = V.FAMILY_FIT) -> Column:
    """Taken off for must-haves of families that are not adjacent."""
    far = F.filter(clashes, lambda x: x["affinity"] < f["adjacent"])
    return F.coalesce(F.aggregate(far, F.lit(0.0), lambda a, x: a + x["weight"]), F.lit(0.0)) * f["penalty"]


def total(w: dict = V.WEIGHTS, f: dict = V.FAMILY_FIT) -> Column:
    """The score of a row of ``match``."""
    bonus = F.when(F.col("signature"), f["signature_bonus"]).otherwise(0.0)
    return final_score(F.col("must"), F.col("senior"), F.col("nice"), F.col("evidence"), bonus, penalty(F.col("clashes"), f), F.col("unmet"), F.col("missing"), F.col("gap"), F.col("fit"), w, f)


def score_jobs(jobs: DataFrame, profiles: DataFrame, idf: DataFrame, matrix: DataFrame) -> DataFrame:
    """Scores of ``jobs`` for ``profiles``, as ``match`` takes them: (job_id, profile_id, score, band, coverage, gates,
    matched, gaps, summary, confidence). A posting of which nothing says that it is one scores 0 (see ``gate.unparseable``;
    its evidence counts where ``jobs`` has job_evidence), and is title_only like one with hardly a description."""
    from tessera.operators.gate import unparseable

    rows = match(jobs, profiles, idf, matrix)
    evidence = F.col("job_evidence") if "job_evidence" in jobs.columns else None
    nothing = unparseable("title", F.when(F.col("asks_nothing"), 0).otherwise(1), evidence)
    rows = rows.withColumn("score", F.when(nothing, 0).otherwise(total()).cast("int"))
    sure = ~nothing & (F.coalesce("chars", F.lit(0)) >= V.FULL_CONFIDENCE_CHARS)
    return rows.select(F.col("id").alias("job_id"), "profile_id", "score", band("score").alias("band"), F.col("must").alias("coverage"), gate_names(F.col("unmet"), F.col("missing"), F.col("gap"), F.col("fit")).alias("gates"), "matched", "gaps", summary(F.col("score"), band("score"), F.col("covered"), F.col("gaps")).alias("summary"), F.when(sure, "full").otherwise("title_only").alias("confidence"))


def cache_key(*parts: Column) -> Column:
    """Sixteen digits over everything a score depends on."""
    return F.substring(F.sha2(F.concat_ws("\u0000", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)).cast("binary"), 256), 1, 16)


def stale(pairs: DataFrame, scores: DataFrame) -> DataFrame:
    """Pairs (job_id, profile_id, cache_key) without a score of that key."""
    return pairs.join(scores.select("job_id", "profile_id", "cache_key"), ["job_id", "profile_id", "cache_key"], "left_anti")


def keyed(jobs: DataFrame, profiles: DataFrame, engine: str, most: int = 2000) -> DataFrame:
    """(job_id, profile_id, cache_key) of every posting for every profile (profile_id, text, overrides): over the engine's
    version, all that a score reads of the posting, and the profile's text and overrides."""
    own = [F.col(x) if x in jobs.columns else F.lit(None) for x in ("title", "description", "department", "location", "employment_type", "family")]
    evidence = F.to_json("job_evidence") if "job_evidence" in jobs.columns else F.lit(None)
    body = jobs.select(F.col("id").alias("job_id"), cache_key(*own, evidence).alias("__body"))
    who = profiles.select("profile_id", cache_key(F.col("text"), F.col("overrides") if "overrides" in profiles.columns else F.lit(None)).alias("__who"))
    return with_profiles(body, who, most).select("job_id", "profile_id", cache_key(F.lit(engine), F.col("__body"), F.col("__who")).alias("cache_key"))


def recompute(jobs: DataFrame, profiles: DataFrame, scores: DataFrame, idf: DataFrame, matrix: DataFrame, engine: str, force: bool = False) -> DataFrame:
    """The scores after a run: those of profiles that are gone are dropped, those whose key is unchanged stay, and open
    postings with another key are scored anew. Without profiles nothing changes: a registry that is not loaded looks so."""
    if profiles.isEmpty():
        return scores
    live = jobs.where("status != 'closed'")
    kept = scores.join(profiles.select("profile_id").distinct(), "profile_id", "left_semi").select(*scores.columns)
    wanted = keyed(live, profiles, engine)
    need = stored(wanted if force else stale(wanted, kept), "stale-scores")
    rows = live.join(need.select(F.col("job_id").alias("id")).distinct(), "id", "left_semi")
    made = stored(score_jobs(rows, profiles, idf, matrix), "new-scores").join(need, ["job_id", "profile_id"])  # a join over the expressions of a score would take the planner minutes
    cols = {"score": F.col("score").cast("double"), "coverage": F.col("coverage").cast("double")}
    made = made.select(*(cols.get(x, F.col(x)).alias(x) for x in scores.columns))
    return kept.join(made.select("job_id", "profile_id"), ["job_id", "profile_id"], "left_anti").select(*scores.columns).unionByName(made)


def best_profile(scores: DataFrame) -> DataFrame:
    """(job_id, profile_id, score): the best; of equals the first profile."""
    w = W.partitionBy("job_id").orderBy(F.col("score").desc_nulls_last(), "profile_id")
    return scores.withColumn("__n", F.row_number().over(w)).where("__n = 1").select("job_id", "profile_id", "score")


def precision_at(labelled: DataFrame, k: int) -> DataFrame:
    """Mean over profiles with k labels or more of the share of fits among their k best: (profile_id, score, fit, id)."""
    w = W.partitionBy("profile_id")
    top = labelled.withColumn("__n", F.count("*").over(w)).withColumn("__r", F.row_number().over(w.orderBy(F.desc("score"), "id"))).where((F.col("__n") >= k) & (F.col("__r") <= k))
    return top.groupBy("profile_id").agg(F.avg(F.col("fit").cast("double")).alias("p")).agg(F.avg("p").alias(f"precision_at_{k}"))
