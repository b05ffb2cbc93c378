"""Text functions as column expressions: search tokens, keys, cleaning, dates."""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import vocabulary as V

#: Accented letters that search folds, and what they become.
ACCENTS = ("àáâãäåçèéêëìíîïñòóôõöùúûüýÿšžœ", "aaaaaaceeeeiiiinooooouuuuyyszo")
#: The same with capitals, and the capitals that lower-case by their neighbours or into two characters, folded one by one.
FOLDS = (ACCENTS[0] + ACCENTS[0].upper() + "\u212bİΣ", ACCENTS[1] * 2 + "aiσ")
#: Letters and digits of Unicode 14 and 15, which patterns of Java 17 don't know as such.
NEWER = "870-887 889-88e 8b5 8c8-8c9 c5d cdd 170d 171f 1b4c 2c2f 2c5f 9ffd-9fff a7c0-a7c1 a7d0-a7d1 a7d3 a7d5-a7d9 a7f2-a7f4 10570-1057a 1057c-1058a 1058c-10592 10594-10595 10597-105a1 105a3-105b1 105b3-105b9 105bb-105bc 10780-10785 10787-107b0 107b2-107ba 10f70-10f81 11071-11072 11075 1123f-11240 11740-11746 11ab0-11abf 11f02 11f04-11f10 11f12-11f33 11f50-11f59 12f90-12ff0 1342f 13441-13446 16a70-16abe 16ac0-16ac9 1aff0-1aff3 1aff5-1affb 1affd-1affe 1b11f-1b122 1b132 1b155 1d2c0-1d2d3 1df00-1df1e 1df25-1df2a 1e030-1e06d 1e290-1e2ad 1e4d0-1e4eb 1e4f0-1e4f9 1e7e0-1e7e6 1e7e8-1e7eb 1e7ed-1e7ee 1e7f0-1e7fe 2a6de-2a6df 2b735-2b739 31350-323af"
#: Runs of letters and digits.
TOKEN = r"([\p{L}\p{N}[\x{870}-\x{10ffff}&&[" + re.sub(r"[0-9a-f]+", r"\\x{\g<0>}", NEWER).replace(" ", "") + "]]]+)"


def c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def words_pattern(terms: list[str]) -> str:
    """Any of ``terms`` as whole words, in any case and script."""
    return r"(?iU)(?<!\w)(" + "|".join(re.escape(t) for t in terms) + r")(?!\w)"


def search_tokens(text: Column | str) -> Column:
    """Lower-case, accent-free runs of letters and digits."""
    return F.regexp_extract_all(F.lower(F.translate(F.coalesce(c(text), F.lit("")), *FOLDS)), F.lit(TOKEN), 1)


def query_terms(raw: str | None) -> list[list[str]]:
    """The terms of a query, each as the tokens that must stand next to each other; [] for a term without any."""
    fold = str.maketrans(*ACCENTS)
    return [re.findall(r"[^\W_]+", t.lower().translate(fold)) for t in re.findall(r"[0-9A-Za-z֐-׿#+.]+", raw or "")]


def has_term(tokens: Column, term: list[str]) -> Column:
    """Whether the tokens hold the term, a phrase of one or more tokens."""
    if not term:
        return F.lit(False)
    if len(term) == 1:
        return F.array_contains(tokens, term[0])
    joined = F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" "))
    return F.array_contains(tokens, term[0]) & joined.contains(f" {' '.join(term)} ")


def matches(raw: str | None, title: Column | str, description: Column | str, scope: str = "all") -> Column:
    """All terms in title or description (in one of them alone with scope title or text); a query without terms matches
    nothing."""
    terms = query_terms(raw)
    found = F.lit(bool(terms))
    t, d = search_tokens(title), search_tokens(description)
    for term in terms:
        hits = {"title": has_term(t, term), "text": has_term(d, term)}
        found = found & hits.get(scope, hits["title"] | hits["text"])
    return found


def excluded(raw: str | None, title: Column | str) -> Column:
    """Any term in the title; a query without terms excludes nothing."""
    found, t = F.lit(False), search_tokens(title)
    for term in query_terms(raw):
        found = found | has_term(t, term)
    return found


def collapse(text: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c(text), F.lit("")), r"\s+", " "))


def clean_lines(text: Column | str) -> Column:
    """Spaces within lines collapsed, blank lines dropped."""
    lines = F.transform(F.split(F.coalesce(c(text), F.lit("")), r"\r?\n"), lambda x: F.trim(F.regexp_replace(x, r"[\s ]+", " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def normalize_company(name: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c(name), F.lit(""))), r"\b(" + "|".join(V.COMPANY_SUFFIXES) + r")\b", " "), "[^a-z0-9]+", "")


def loose_company(name: Column | str) -> Column:
    bare = F.regexp_replace(F.coalesce(c(name), F.lit("")), r"\([^)]*\)", " ")
    return normalize_company(F.regexp_replace(bare, r"(?i)\.(com|io|ai|co)\b", " "))


def export_company(name: Column | str) -> Column:
    key = normalize_company(name)
    cut = F.regexp_replace(key, "ai$", "")
    return F.when(F.length(cut) > 0, cut).otherwise(key)


def snake_id(name: Column | str) -> Column:
    kept = F.trim(F.regexp_replace(F.lower(F.coalesce(c(name), F.lit(""))), r"(?U)[^\w\s-]", ""))
    return F.coalesce(F.nullif(F.regexp_replace(kept, r"[\s-]+", "_"), F.lit("")), F.lit("unnamed_company"))


def posted_date(raw: Column | str) -> Column:
    """Epoch milliseconds as a date, else the first ten characters."""
    text = c(raw).cast("string")
    millis = F.date_format(F.timestamp_millis(text.try_cast("long")), "yyyy-MM-dd")
    return F.when(text.rlike(r"^\d{12,13}$"), millis).otherwise(F.nullif(F.substring(text, 1, 10), F.lit("")))


def normalize_date(raw: Column | str) -> Column:
    """M/D/YYYY as ISO, else unchanged."""
    return F.coalesce(F.date_format(F.try_to_date(c(raw), "M/d/yyyy"), "yyyy-MM-dd"), c(raw))


def contains_hebrew(text: Column | str) -> Column:
    """At least a fifth of the letters are Hebrew."""
    letters = F.regexp_count(c(text), F.lit(r"\p{L}"))
    return F.coalesce((letters > 0) & (F.regexp_count(c(text), F.lit("[א-ת]")) >= 0.2 * letters), F.lit(False))


def english_name(name: Column | str) -> Column:
    """Without Hebrew words, if any Latin word is left."""
    kept = F.filter(F.split(collapse(name), " "), lambda w: ~w.rlike("[֐-׿]"))
    return F.when(F.exists(kept, lambda w: w.rlike("[A-Za-z]")), F.array_join(kept, " ")).otherwise(c(name))


def title_key(title: Column | str) -> Column:
    """Lower-case title without punctuation, in any script."""
    return collapse(F.regexp_replace(F.lower(F.coalesce(c(title), F.lit(""))), r"(?U)[^\w ]", " "))


SENIORITY_WORDS = r"\b(senior|sr\.?|junior|jr\.?|lead|principal|staff|chief|head|director|vp|vice president|mid[\s-]?level|mid|entry[\s-]?level|intern(ship)?|associate|experienced|expert|i{1,3}|iv|v|[0-9]+)\b"
ABBREVIATIONS = [(r"\bsw\b", "software"), (r"\bswe\b", "software engineer"), (r"\beng(ineer(ing)?)?\b", "engineer"), (r"\bdev\b", "developer"), (r"\bdevs\b", "developers"), (r"\bfull[\s-]?stack\b", "fullstack"), (r"\bfront[\s-]?end\b", "frontend"), (r"\bback[\s-]?end\b", "backend"), (r"\bops\b", "operations"), (r"\bpm\b", "product manager")]


def frequent_title(title: Column | str) -> Column:
    """A title without script remnants, seniority and numbers, abbreviations spelled out."""
    text = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c(title), F.lit(""))), "[֐-׿]+", " "), r"[^a-z0-9\s/&+-]", " ")
    for short, full in ABBREVIATIONS:
        text = F.regexp_replace(text, short, full)
    return collapse(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, SENIORITY_WORDS, " "), r"\b\d+\b", " "), "[-/]", " "))


def visible_text(page: Column | str) -> Column:
    """The text of a page: no scripts, styles or markup; the commonest references decoded; space collapsed."""
    text = F.regexp_replace(F.coalesce(c(page), F.lit("")), r"(?is)<(script|style|noscript|svg)\b[^>]*>.*?</\1\s*>|<!--.*?-->", " ")
    text = F.regexp_replace(text, r"(?s)<[^>]*>", " ")
    for ref, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&")):
        text = F.replace(text, F.lit(ref), F.lit(char))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


@F.arrow_udf(T.StringType())
def strip_html(pages: pa.Array) -> pa.Array:
    """Text with line breaks kept at block ends; all character references decoded, even those that hide tags."""

    def one(page: str | None) -> str | None:
        if page is None:
            return None
        text = entities.unescape(page)
        text = re.sub(r"(?i)<br\s*/?>|</(p|div|li|h[1-6]|tr|ul|ol)>", "\n", text)
        lines = (re.sub(r"[ \t\xa0]+", " ", x).strip() for x in entities.unescape(re.sub(r"<[^>]*>", "", text)).split("\n"))
        return "\n".join(x for x in lines if x)

    return pa.array([one(p) for p in pages.to_pylist()], pa.string())


@F.arrow_udf(T.DoubleType())
def sequence_ratio(a: pa.Array, b: pa.Array) -> pa.Array:
    """Ratio of matching blocks of two strings."""
    from difflib import SequenceMatcher

    return pa.array([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a.to_pylist(), b.to_pylist())], pa.float64())
