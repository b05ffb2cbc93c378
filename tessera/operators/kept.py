"""Intermediate tables that more than one step reads, and small tables dealt out to all cores."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame


def stored(df: DataFrame, what: str) -> DataFrame:
    """``df`` written as Parquet under ``spark.checkpoint.dir`` and read again, so that a lost executor costs nothing and the
    planner knows its size; kept in the executors where that is unset (a local session)."""
    root = df.sparkSession.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        return df.persist()
    path = f"{root.rstrip('/')}/tessera/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


SPLIT = 4 << 20  # bytes of the smallest split that files are read in


def dealt(rows: DataFrame) -> DataFrame:
    """``rows`` read from files, dealt out to all cores where the files are too small to be split for as many: at under 4 MB a
    core, one file would keep one core busy. Larger tables are returned as they are. The size is the planner's."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(cores) if size < cores * SPLIT else rows
