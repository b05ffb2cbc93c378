"""Caches as tables: a key, when it was stored, and what was found. One lookup and one update serve fetched pages,
category files, research, translations and parsed profiles; they differ in key, age and what counts as a failure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import c, contains_hebrew


def page_key(url: Column | str) -> Column:
    return F.sha1(c(url).cast("binary"))


def text_key(text: Column | str) -> Column:
    return F.sha2(c(text).cast("binary"), 256)


def research_key(company_id: Column | str) -> Column:
    """A company's id with what no file name may hold replaced."""
    return F.regexp_replace(c(company_id), "[^A-Za-z0-9_.-]+", "_")


def fresh(stored_at: Column | str, now: Column | str, hours: float) -> Column:
    """Younger than ``hours``; a time that cannot be read is not."""
    at = F.try_to_timestamp(c(stored_at).cast("string"))
    age = F.unix_micros(c(now).cast("timestamp")) - F.unix_micros(at)
    return F.coalesce(age < F.lit(int(hours * 3_600_000_000)), F.lit(False))


def look_up(wanted: DataFrame, cache: DataFrame, now: str, hours: float | None = None) -> DataFrame:
    """``wanted`` (key, ...) with ``value`` and ``hit``: the newest fresh entry of ``cache`` (key, stored_at, value).

    Entries are reduced to one a key before the join; an entry without a value is none."""
    entries = cache.where("value is not null")
    if hours is not None:
        entries = entries.where(fresh("stored_at", F.lit(now), hours))
    newest = entries.groupBy("key").agg(F.max_by("value", "stored_at").alias("value"))
    return wanted.join(newest, "key", "left").withColumn("hit", F.col("value").isNotNull())


def misses(wanted: DataFrame, cache: DataFrame, now: str, hours: float | None = None) -> DataFrame:
    """The distinct keys that have to be fetched."""
    return look_up(wanted, cache, now, hours).where("not hit").select(*wanted.columns).dropDuplicates(["key"])


def store(cache: DataFrame, fetched: DataFrame, now: str, failed: Column | None = None) -> DataFrame:
    """The cache with ``fetched`` (key, value) in it. Failures are never stored: they would be hits for ever after."""
    bad = F.col("value").isNull() if failed is None else F.col("value").isNull() | failed
    good = fetched.where(~F.coalesce(bad, F.lit(True))).groupBy("key").agg(F.max("value").alias("value")).withColumn("stored_at", F.lit(now))
    return cache.join(good.select("key"), "key", "left_anti").unionByName(good.select(*cache.columns))


def untranslated(value: Column | str) -> Column:
    """What a translation cache must not keep: an answer that is still Hebrew."""
    return contains_hebrew(value)


def translated(rows: DataFrame, cache: DataFrame, column: str, now: str) -> DataFrame:
    """Rows with ``column`` replaced by its stored translation, where it is Hebrew and there is one that is not."""
    kept = cache.where(~untranslated("value"))
    need = rows.withColumn("key", F.when(contains_hebrew(column), text_key(column)))
    found = look_up(need, kept, now)
    return found.withColumn(column, F.coalesce("value", column)).select(*rows.columns)
