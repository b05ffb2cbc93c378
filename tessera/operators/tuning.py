"""A seeded search for score weights against labelled pairs.

Trials are a small table drawn on the driver; every labelled pair is scored under every trial by one broadcast join, and
what a trial is worth is a grouped aggregate. Nothing is scored on the driver."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import vocabulary as V
from tessera.operators import scoring


def trials(spark: SparkSession, n: int = 500, seed: int = 0) -> DataFrame:
    """(trial, the four weights, which sum to 1, and the five family coefficients)."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        raw = {k: rng.uniform(*bounds) for k, bounds in V.SEARCH_WEIGHTS.items()}
        weights = {k: v / sum(raw.values()) for k, v in raw.items()}
        fit = {k: rng.uniform(*bounds) for k, bounds in V.SEARCH_FAMILY_FIT.items()}
        fit["cap"] = float(round(fit["cap"]))
        rows.append((i, *weights.values(), *fit.values()))
    names = [*V.SEARCH_WEIGHTS, *V.SEARCH_FAMILY_FIT]
    return spark.createDataFrame(rows, "trial int, " + ", ".join(f"t_{k} double" for k in names))


def evaluate(examples: DataFrame, table: DataFrame, ks: tuple[int, int] = (20, 50), most: int = 5000) -> DataFrame:
    """Per trial: rejected (a pair's score is below its min_score or above its max_score), and the mean precision at each
    of ``ks`` over profiles with that many pairs, 0 without such profiles.

    ``examples`` are rows of ``scoring.match`` with label, min_score and max_score; of equal scores the smaller id goes
    first. Trials are broadcast once counted to be no more than ``most``."""
    if table.count() > most:
        raise ValueError(f"more than {most} trials")
    w = {k: F.col(f"t_{k}") for k in V.SEARCH_WEIGHTS}
    f = {**V.FAMILY_FIT, **{k: F.col(f"t_{k}") for k in V.SEARCH_FAMILY_FIT}}
    scored = examples.crossJoin(F.broadcast(table)).withColumn("score", scoring.total(w, f))
    broken = F.coalesce(F.col("score") < F.col("min_score"), F.lit(False)) | F.coalesce(F.col("score") > F.col("max_score"), F.lit(False))
    own = W.partitionBy("trial", "profile_id")
    ranked = scored.select("trial", "profile_id", broken.alias("broken"), (F.col("label") == "fit").alias("fits"), F.row_number().over(own.orderBy(F.desc("score"), "id")).alias("place"), F.count("*").over(own).alias("n"))
    by_profile = ranked.groupBy("trial", "profile_id").agg(F.bool_or("broken").alias("broken"), *(F.when(F.first("n") >= k, F.count_if(F.col("fits") & (F.col("place") <= k)) / k).alias(f"p{k}") for k in ks))
    return by_profile.groupBy("trial").agg(F.bool_or("broken").alias("rejected"), *(F.coalesce(F.avg(f"p{k}"), F.lit(0.0)).alias(f"precision_at_{k}") for k in ks))


def search(examples: DataFrame, n: int = 500, seed: int = 0, ks: tuple[int, int] = (20, 50)) -> DataFrame:
    """The trial with the greatest sum of precisions among those not rejected, of equals the first, with its weights and
    how many were evaluated and rejected; no row if all were rejected."""
    table = trials(examples.sparkSession, n, seed)
    of = evaluate(examples, table, ks)
    counts = of.agg(F.count_if(~F.col("rejected")).alias("evaluated"), F.count_if("rejected").alias("rejected_trials"))
    best = of.where("not rejected").orderBy(F.desc(sum((F.col(f"precision_at_{k}") for k in ks), F.lit(0.0))), "trial").limit(1)
    return best.drop("rejected").join(F.broadcast(table), "trial").crossJoin(counts)  # one row each
