"""State of postings over collection runs. Tables have no in-place updates, so each operator returns the next version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.rules import department
from tessera.functions.text import normalize_company, sequence_ratio, title_key
from tessera.functions.urls import board, host, job_id, normalize_job_url
from tessera.operators.kept import stored
from tessera.schemas import FLAGS

FILL = ("url", "location", "city", "department", "employment_type", "description")
REFRESH = ("posted_at", "fetch_status", "work_mode", "is_remote", "years_required", "scrape_source")


def diff(jobs: DataFrame, scraped: DataFrame, runs: DataFrame) -> DataFrame:
    """Postings after a run: ``scraped`` (company_id, id, title, ...), ``runs`` (company_id, now, may_close).

    New ids are inserted, seen ones stay or reopen, empty fields are filled, and what a run that may close did not see
    is closed. Companies without a run keep their rows. Column ``change`` names what happened: new, seen, reopened,
    closed or kept."""
    w = W.partitionBy("company_id", "id").orderBy(*(F.col(x) for x in scraped.columns if x not in ("company_id", "id")))
    new = scraped.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n").withColumn("__new", F.lit(True))
    old, n, r = jobs.withColumn("__old", F.lit(True)).alias("o"), new.alias("n"), runs.alias("r")
    both = old.join(n, ["company_id", "id"], "full_outer").join(r, "company_id", "left")
    seen, stored = F.col("__new").isNotNull(), F.col("__old").isNotNull()
    closes = stored & ~seen & F.coalesce(F.col("r.may_close"), F.lit(False)) & (F.col("o.status") != "closed")
    change = F.when(~stored, "new").when(seen & (F.col("o.status") == "closed"), "reopened").when(seen, "seen").when(closes, "closed").otherwise("kept")
    now, both_side = F.col("r.now"), set(scraped.columns)

    def value(c: str) -> Column:
        o, s = F.col(f"o.{c}"), F.col(f"n.{c}") if c in both_side else F.lit(None)
        if c == "status":
            return F.when(~stored, "new").when(seen & o.isin("new", "closed"), "seen").when(closes, "closed").otherwise(o)
        if c == "first_seen":
            return F.when(~stored, F.coalesce(F.col("n.posted_at") if "posted_at" in both_side else F.lit(None), now)).otherwise(o)
        if c == "last_seen":
            return F.when(seen, now).otherwise(o)
        if c in ("closed_at", "closed_reason"):
            return F.when(closes, now if c == "closed_at" else F.lit("not on the listing")).when(seen, None).otherwise(o)
        if c == "department" and c in both_side:
            s = department(s)
        if c == "description":
            return F.when(F.trim(F.coalesce(o, F.lit(""))) != "", o).otherwise(F.coalesce(s, F.lit("")))
        if c == "title":  # a later run may cut card text off a title, never rename it
            return F.when(~stored, s).when((F.length(s) > 0) & (F.length(s) < F.length(o)) & F.contains(o, s), s).otherwise(o) if c in both_side else o
        if c in REFRESH:
            return F.coalesce(s, o)
        if c in FILL:
            return F.when(F.trim(F.coalesce(o.cast("string"), F.lit(""))) != "", o).otherwise(F.coalesce(s, o))
        return F.when(~stored, s).otherwise(o)

    return both.select("company_id", "id", *(value(c).alias(c) for c in jobs.columns if c not in ("company_id", "id")), change.alias("change"))


def may_close(rows: Column, trusted: Column, baseline: Column) -> Column:
    return (rows > 0) | trusted | (F.coalesce(baseline, F.lit(0)) > 0)


def close_by_url(jobs: DataFrame, closed: DataFrame, now: str) -> DataFrame:
    """Close open postings whose identity is in ``closed`` (url, reason)."""
    wanted = closed.select(normalize_job_url("url").alias("__url"), F.col("reason").alias("__reason")).where("__url is not null").groupBy("__url").agg(F.max("__reason").alias("__reason"))
    hit = F.col("__reason").isNotNull() & (F.col("status") != "closed")
    out = jobs.withColumn("__url", normalize_job_url("url")).join(wanted, "__url", "left")
    return out.select(*(F.when(hit, {"status": F.lit("closed"), "closed_at": F.lit(now), "closed_reason": F.col("__reason")}[c]).otherwise(F.col(c)).alias(c) if c in ("status", "closed_at", "closed_reason") else F.col(c) for c in jobs.columns))


def reopen_by_url(jobs: DataFrame, live: DataFrame, now: str) -> DataFrame:
    """Reopen, as seen, closed postings whose identity is in ``live`` (url)."""
    wanted = live.select(normalize_job_url("url").alias("__url")).where("__url is not null").distinct().withColumn("__live", F.lit(True))
    hit = F.col("__live").isNotNull() & (F.col("status") == "closed")
    out = jobs.withColumn("__url", normalize_job_url("url")).join(wanted, "__url", "left")
    new = {"status": F.lit("seen"), "closed_at": F.lit(None), "closed_reason": F.lit(None), "last_seen": F.lit(now)}
    return out.select(*(F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in jobs.columns))


def duplicate_closed(jobs: DataFrame, key: Column | None = None) -> DataFrame:
    """Closed postings with an open one of the same identity at the same company (open_sibling_id: the smallest).

    Open identities are aggregated first, so copies of one posting never multiply."""
    rows = jobs.withColumn("__key", normalize_job_url("url") if key is None else key).where("__key is not null")
    live = rows.where("status != 'closed'").groupBy("company_id", "__key").agg(F.min("id").alias("open_sibling_id"))
    return rows.where("status = 'closed'").join(live, ["company_id", "__key"]).drop("__key")


def exclusive_owner(companies: DataFrame, key: Column) -> DataFrame:
    """(key, owner) of keys that exactly one company has."""
    return companies.select(key.alias("key"), "id").where("key is not null and key != ''").groupBy("key").agg(F.min("id").alias("owner"), F.max("id").alias("__last")).where("owner = __last").drop("__last")


def foreign_host(jobs: DataFrame, companies: DataFrame) -> DataFrame:
    """Postings on a host that belongs to another company alone."""
    owner = exclusive_owner(companies, host("career_url")).withColumnRenamed("key", "__host")
    return jobs.withColumn("__host", host("url")).join(owner, "__host").where("owner != company_id").drop("__host")


def foreign_board(jobs: DataFrame, companies: DataFrame) -> DataFrame:
    owner = exclusive_owner(companies, board("career_url")).withColumnRenamed("key", "__board")
    return jobs.withColumn("__board", board("url")).join(owner, "__board").where("owner != company_id").drop("__board")


def delete(jobs: DataFrame, scores: DataFrame, state: DataFrame, doomed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without ``doomed`` (id)."""
    ids = doomed.select("id").distinct()
    child = ids.withColumnRenamed("id", "job_id")
    return jobs.join(ids, "id", "left_anti"), scores.join(child, "job_id", "left_anti"), state.join(child, "job_id", "left_anti")


def purge(doomed: DataFrame, state: DataFrame) -> DataFrame:
    """What may be deleted: doomed rows that no one has flagged."""
    return doomed.join(state.select(F.col("job_id").alias("id")), "id", "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` replace those of equal keys; only its columns that are not null change."""
    o, n = old.alias("o"), new.alias("n")
    cols = [F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) if c in new.columns else F.col(f"o.{c}") for c in old.columns if c not in keys]
    return o.join(n, keys, "full_outer").select(*keys, *cols)


def set_state(state: DataFrame, jobs: DataFrame, job_id: str, now: str, **flags: bool) -> DataFrame:
    """Merge flags of one posting. Unknown flags are a ValueError, unknown postings a KeyError."""
    if wrong := set(flags) - set(FLAGS):
        raise ValueError(f"unknown flags: {sorted(wrong)}")
    if jobs.where(F.col("id") == job_id).isEmpty():
        raise KeyError(job_id)
    new = state.sparkSession.range(1).select(F.lit(job_id).alias("job_id"), *(F.lit(v).alias(k) for k, v in flags.items()), F.lit(now).alias("updated_at"))
    return upsert(state, new, ["job_id"]).na.fill(False, list(FLAGS))


def prune_scores(scores: DataFrame, profiles: list[str]) -> DataFrame:
    """Scores of known profiles; without any known profile nothing is deleted."""
    return scores.where(F.col("profile_id").isin(profiles)) if profiles else scores


def refresh_contacts(companies: DataFrame, contacts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Contacts (company, name, position, url) by company key: the companies with counts, and the contact rows. Contacts without
    a name are none, and equal rows are one."""
    keyed = companies.select(F.col("id").alias("company_id"), normalize_company("display_name").alias("__key"))
    rows = contacts.withColumn("__key", normalize_company("company")).join(keyed, "__key").select("company_id", "name", "position", "url").where("name is not null and name != ''").distinct()
    counts = rows.groupBy(F.col("company_id").alias("id")).agg(F.count("*").cast("int").alias("connection_count"))
    return companies.drop("connection_count").join(counts, "id", "left").na.fill(0, ["connection_count"]), rows


def merge_referrals(jobs: DataFrame, companies: DataFrame, referrals: DataFrame, now: str, least: float = 0.75) -> DataFrame:
    """Referrals (company, also_posted_as, title, url, contact) matched to stored postings: (company_id, title, url, contact, job_id or null).

    A company matches by its name or the first alias that hits; a posting by equal URL or by a title ratio of ``least``, the
    smallest id winning. URLs meet by equality. Titles are compared once for each two that differ, not for each two
    postings, and only where their lengths, and the letters they share, allow the ratio at all."""
    names = F.array_union(F.array("company"), F.coalesce("also_posted_as", F.array().cast("array<string>")))
    rows = referrals.withColumn("__row", F.monotonically_increasing_id())
    rows = stored(rows, "referrals")  # the numbers must not change when a task runs again
    keyed = companies.groupBy(normalize_company("display_name").alias("__key")).agg(F.min("id").alias("company_id"))
    hits = rows.select("__row", F.posexplode(F.transform(names, lambda x: normalize_company(x))).alias("__pos", "__key")).join(keyed, "__key")
    own = hits.groupBy("__row").agg(F.min_by("company_id", "__pos").alias("company_id"))
    known = jobs.select("company_id", F.col("id").alias("__id"), normalize_job_url("url").alias("__url"), title_key("title").alias("__title"))
    matched = rows.join(own, "__row").withColumn("__u", normalize_job_url("url")).withColumn("__t", title_key("title"))
    by_url = matched.select("__row", "company_id", F.col("__u").alias("__url")).join(known, ["company_id", "__url"]).select("__row", "__id")
    titles = known.groupBy("company_id", "__title").agg(F.min("__id").alias("__id"))
    asked = matched.select("company_id", "__t").distinct()
    pairs = asked.join(titles, "company_id").where(may_be_near(F.col("__t"), F.col("__title"), least))
    near = pairs.where(sequence_ratio("__t", "__title") >= least).groupBy("company_id", "__t").agg(F.min("__id").alias("__id"))
    by_title = matched.select("__row", "company_id", "__t").join(near, ["company_id", "__t"]).select("__row", "__id")
    first = by_url.unionByName(by_title).groupBy("__row").agg(F.min("__id").alias("job_id"))
    return matched.join(first, "__row", "left").select("company_id", "title", "url", "contact", "job_id", F.lit(now).alias("at"))


def with_referrals(jobs: DataFrame, merged: DataFrame, companies: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """(jobs, new companies) after ``merge_referrals``: matched postings are tagged, the others added as new referrals, and
    nothing is closed. ``merged`` has also company (its name); a company that no name matched is new."""
    from tessera.functions.text import snake_id
    from tessera.operators.reads import mark_referrals

    tagged = mark_referrals(jobs, merged.where("job_id is not null").select(F.col("job_id").alias("id"), "contact"), now)
    fresh = merged.where("job_id is null").withColumn("company_id", F.coalesce("company_id", snake_id("company")))
    none = F.lit("")
    fresh = fresh.withColumn("id", job_id("url", "company", "title", none)).where("title is not null and title != ''")
    one = fresh.groupBy("id").agg(*(F.min(c).alias(c) for c in ("company_id", "company", "title", "url", "contact")))
    one = one.join(jobs.select("id"), "id", "left_anti")
    to = {"status": F.lit("new"), "is_referral": F.lit(True), "referral_contact": F.col("contact"), "first_seen": F.lit(now), "last_seen": F.lit(now), "description": F.lit("")}
    kind = {f.name: f.dataType for f in jobs.schema}
    added = one.select(*(to.get(c, F.col(c) if c in one.columns else F.lit(None)).cast(kind[c]).alias(c) for c in jobs.columns))
    known = companies.select(F.col("id").alias("company_id"))
    new = one.select("company_id", "company").join(known, "company_id", "left_anti").groupBy(F.col("company_id").alias("id")).agg(F.min("company").alias("display_name"))
    return tagged.unionByName(added), new


def may_be_near(a: Column, b: Column, least: float) -> Column:
    """Whether two texts can have a ratio of ``least``: the ratio is twice the matched characters over both lengths, and no
    more match than the shorter text has, or than there are of each letter in both."""
    both = F.length(a) + F.length(b)
    letters = "abcdefghijklmnopqrstuvwxyz "
    count = lambda x, c: F.length(x) - F.length(F.replace(x, F.lit(c), F.lit("")))
    other = lambda x: F.length(F.translate(x, letters, ""))
    shared = sum((F.least(count(a, c), count(b, c)) for c in letters), F.least(other(a), other(b)))
    return (2 * F.least(F.length(a), F.length(b)) >= least * both - 1e-9) & (2 * shared >= least * both - 1e-9)


def prefer(rows: DataFrame, key: list[str], *better: Column) -> DataFrame:
    """One row per key: the first by ``better``."""
    return rows.withColumn("__n", F.row_number().over(W.partitionBy(*key).orderBy(*better))).where("__n = 1").drop("__n")


def never_empty(rows: DataFrame, gone: Column) -> DataFrame:
    """Without postings that look gone, unless all of a company's (more than one) do."""
    w = W.partitionBy("company_id")
    return rows.withColumn("__gone", gone).withColumn("__all", F.min(F.col("__gone").cast("int")).over(w)).withColumn("__n", F.count("*").over(w)).where(~F.col("__gone") | ((F.col("__all") == 1) & (F.col("__n") > 1))).drop("__gone", "__all", "__n")


def plan_health(previous: DataFrame) -> DataFrame:
    """Next status of plans (status, empty_runs, yield, baseline, changed, labelled): two empty runs, or a yield down by
    seven tenths on a changed page, make a plan stale; one makes it suspect."""
    empty = F.col("yield") == 0
    runs = F.when(empty, F.col("empty_runs") + 1).otherwise(0)
    fell = (F.col("baseline") > 0) & (F.col("yield") < 0.3 * F.col("baseline")) & F.col("changed")
    status = F.when((runs >= 2) | fell, "stale").when(empty, "stale_suspect").when(F.col("labelled"), "verified").otherwise("unverified")
    return previous.withColumn("status", status).withColumn("empty_runs", runs).withColumn("baseline", F.when(~empty, F.greatest("baseline", "yield")).otherwise(F.col("baseline")))


def discovery(companies: DataFrame, plans: DataFrame, cooldown_days: int, today: str, most: int) -> DataFrame:
    """Companies whose page needs a plan: missing ones first, then stale past their cooldown, then unverified; ``most`` at once."""
    joined = companies.join(plans.select(F.col("company_id").alias("id"), "status", "derived_by", "derived_at"), "id", "left")
    old = F.date_diff(F.lit(today).cast("date"), F.col("derived_at").cast("date")) >= cooldown_days
    rank = F.when(F.col("status").isNull(), 0).when((F.col("status") == "stale") & old, 1).when((F.col("derived_by") == "rules") & (F.col("status") == "unverified"), 2)
    return joined.withColumn("__rank", rank).where("__rank is not null").orderBy("__rank", "id").limit(most).drop("__rank")


def scores_wide(scores: DataFrame, profiles: list[str]) -> DataFrame:
    """One row per posting with score_<profile> of the profiles named; null without a score."""
    return scores.where(F.col("profile_id").isin(profiles)).groupBy("job_id").agg(*(F.max(F.when(F.col("profile_id") == p, F.col("score"))).alias(f"score_{p}") for p in profiles))


def scores_long(wide: DataFrame) -> DataFrame:
    """(job_id, profile_id, score) of columns score_<profile>, without nulls."""
    names = [n for n in wide.columns if n.startswith("score_")]
    pairs = F.array(*(F.struct(F.lit(n.removeprefix("score_")).alias("profile_id"), F.col(n).alias("score")) for n in names))
    return wide.select("job_id", F.inline(pairs)).where("score is not null")


def finish_run(history: DataFrame, run_id: str, now: str, status: str) -> DataFrame:
    """The history with one run ended; runs that have ended already stay."""
    hit = (F.col("id") == run_id) & F.col("ended_at").isNull()
    return history.withColumn("status", F.when(hit, status).otherwise(F.col("status"))).withColumn("ended_at", F.when(hit, now).otherwise(F.col("ended_at")))


def crash_orphans(history: DataFrame, running: list[str], now: str) -> DataFrame:
    """Runs without an end that are not running are crashed."""
    hit = F.col("ended_at").isNull() & ~F.col("id").isin(running)
    return history.withColumn("status", F.when(hit, "crashed").otherwise(F.col("status"))).withColumn("ended_at", F.when(hit, now).otherwise(F.col("ended_at")))
