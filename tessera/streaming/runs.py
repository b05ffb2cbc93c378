"""Collection runs and sightings as streams."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def posting_counts(events: DataFrame, every: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(day, event_type, n) with late events up to ``late``; works on batches and streams alike."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", late) if events.isStreaming else rows
    return rows.groupBy(F.window("ts", every).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("day"), "event_type", "n")


def first_sightings(events: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def visits(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, begin, end, n) of events no further apart than ``gap``."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", late) if events.isStreaming else rows
    return rows.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("begin"), F.col("w.end").alias("end"), "n")


def apply_runs(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str):
    """Each micro-batch of scraped rows goes through ``apply`` (the batch diff), once per batch id."""
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def health(runs_of: DataFrame) -> DataFrame:
    """Plan health as a stream: of ``runs_of`` (company_id, at, yield, changed, labelled) every run with the status that
    ``jobs.plan_health`` gives it, (company_id, at, status, empty_runs, baseline). State per company is two numbers."""

    def step(key, frames, state):
        empty_runs, baseline = state.get if state.exists else (0, 0)
        runs = pd.concat(list(frames)).sort_values("at", kind="stable")
        out = []
        for r in runs.itertuples(index=False):
            found = int(getattr(r, "found"))
            empty_runs = 0 if found else empty_runs + 1
            fell = bool(baseline > 0 and found < 0.3 * baseline and r.changed)
            status = "stale" if empty_runs >= 2 or fell else "stale_suspect" if not found else "verified" if r.labelled else "unverified"
            baseline = max(baseline, found)
            out.append((key[0], r.at, status, empty_runs, baseline))
        state.update((empty_runs, baseline))
        yield pd.DataFrame(out, columns=["company_id", "at", "status", "empty_runs", "baseline"])

    rows = runs_of.withColumnRenamed("yield", "found")
    return rows.groupBy("company_id").applyInPandasWithState(step, "company_id string, at string, status string, empty_runs int, baseline int", "empty_runs int, baseline int", "append", "NoTimeout")
