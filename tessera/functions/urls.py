"""URL identity and shape."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import vocabulary as V
from tessera.functions.text import c


def part(url: Column | str, what: str) -> Column:
    return F.coalesce(F.try_parse_url(c(url), F.lit(what)), F.lit(""))


def host(url: Column | str) -> Column:
    return F.regexp_replace(F.lower(part(url, "HOST")), r"^www\.", "")


def segments(url: Column | str) -> Column:
    return F.filter(F.split(part(url, "PATH"), "/"), lambda s: s != "")


def parents(url: Column | str) -> Column:
    s = segments(url)
    return F.when(F.size(s) > 1, F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(1)))).otherwise(F.array().cast("array<string>"))


def query_pairs(url: Column | str) -> Column:
    return F.filter(F.split(part(url, "QUERY"), "&"), lambda p: p != "")


def normalize_job_url(url: Column | str) -> Column:
    """Identity of a posting: no fragment, no tracking keys, no trailing slash; other keys stay, in order."""
    bare = F.split_part(F.trim(c(url)), F.lit("#"), F.lit(1))
    kept = F.filter(query_pairs(bare), lambda p: ~F.lower(F.split_part(p, F.lit("="), F.lit(1))).isin(V.VOLATILE_QUERY_KEYS))
    kept = F.transform(kept, lambda p: F.when(p.contains("="), p).otherwise(F.concat(p, F.lit("="))))
    base = F.rtrim(F.split_part(bare, F.lit("?"), F.lit(1)), F.lit("/"))
    return F.nullif(F.when(F.size(kept) > 0, F.concat(base, F.lit("?"), F.array_join(kept, "&"))).otherwise(base), F.lit(""))


def job_id(url: Column | str, company: Column | str, title: Column | str, location: Column | str) -> Column:
    """Unpadded URL-safe base64 of the normalised URL; without one, a digest of company, title and location."""
    packed = F.translate(F.regexp_replace(F.base64(normalize_job_url(url).cast("binary")), r"[\r\n=]", ""), "+/", "-_")
    return F.coalesce(packed, F.substring(F.sha1(F.concat_ws("|", c(company), c(title), c(location)).cast("binary")), 1, 20))


def href_shape(url: Column | str) -> Column:
    s, keys = segments(url), F.array_sort(F.array_distinct(F.transform(query_pairs(url), lambda p: F.split_part(p, F.lit("="), F.lit(1)))))
    flat = (F.size(query_pairs(url)) > 0) & (F.size(s) <= 1)
    return F.when(flat, F.concat(host(url), F.lit("|?"), F.array_join(keys, ","))).otherwise(F.concat_ws("|", host(url), F.array_join(parents(url), "/"), F.size(s).cast("string")))


def job_url_hint(url: Column | str) -> Column:
    keys = F.array_join(F.transform(query_pairs(url), lambda p: F.split_part(p, F.lit("="), F.lit(1))), "&")
    return part(url, "PATH").rlike(V.JOB_URL_HINT) | keys.rlike(V.JOB_URL_HINT) | part(url, "QUERY").rlike(r"\d{3,}")


def bounced_up(url: Column | str, landed: Column | str) -> Column:
    """Whether a redirect ended at an ancestor of the page asked for, or at an error."""
    start, end = F.rtrim(part(url, "PATH"), F.lit("/")), F.rtrim(part(landed, "PATH"), F.lit("/"))
    return F.contains(part(landed, "QUERY"), F.lit("error=")) | ((end != "") & (end != start) & F.startswith(start, F.concat(end, F.lit("/"))))


#: Providers of hosted boards in the order they are tried: name, pattern of host and path whose first group is the board.
BOARDS = [
    ("greenhouse", r"(?:boards|job-boards)(?:\.eu)?\.greenhouse\.io/(?:embed/job_board\?for=)?([\w-]+)"),
    ("lever", r"jobs(?:\.eu)?\.lever\.co/([\w.-]+)"),
    ("ashby", r"jobs\.ashbyhq\.com/([\w.%-]+)"),
    ("workable", r"apply\.workable\.com/([\w-]+)"),
    ("comeet", r"comeet\.com/jobs/([\w.-]+)"),
    ("recruitee", r"([\w-]+)\.recruitee\.com"),
    ("bamboohr", r"([\w-]+)\.bamboohr\.com"),
    ("breezy", r"([\w-]+)\.breezy\.hr"),
    ("hibob", r"([\w-]+)\.careers\.hibob\.com"),
    ("smartrecruiters", r"(?:jobs|careers)\.smartrecruiters\.com/([\w-]+)"),
    ("personio", r"([\w-]+)\.jobs\.personio\.(?:de|com)"),
    ("eightfold", r"([\w-]+)\.eightfold\.ai"),
    ("workday", r"([\w-]+)\.wd\d+\.myworkdayjobs\.com"),
]


def board(url: Column | str) -> Column:
    """'provider:board' of the first provider whose address it is, else null."""
    return F.coalesce(*(F.when(c(url).rlike("(?i)" + p), F.concat(F.lit(name + ":"), F.lower(F.regexp_extract(c(url), "(?i)" + p, 1)))) for name, p in BOARDS))
