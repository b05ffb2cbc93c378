"""What the training-data operators share: tables, shared scratch space, Arrow text buffers."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the contracts: a run of anything but ASCII white space (Java regex class).
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc32_mod(column: str, modulus: int) -> Column:
    """crc32 of an id written as text, modulo ``modulus``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Only a local master, whose tasks all run on this machine, may do without."""
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not getattr(context, "_tessera_root", None):
            context._tessera_root = "file://" + tempfile.mkdtemp(prefix="tessera-")
        root = context._tessera_root
    return root.rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder name under the shared root; the folder goes when the driver ends."""
    path = f"{shared_root(spark)}/tessera/{what}-{uuid.uuid4().hex}"
    atexit.register(discard, spark, path)
    return path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder of any Hadoop file system; a session that is over leaves nothing to do it with."""
    if spark.sparkContext._jsc is None or spark.sparkContext._jsc.sc().isStopped():
        return
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def written(df: DataFrame, what: str) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet under the shared root and read it again.

    The files survive lost executors, and their known size lets the planner decide on broadcasts."""
    path = scratch(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def arrow_rows(spark: SparkSession, rows: int = 512) -> None:
    """Rows of an Arrow batch, for results that are computed after the operator has returned: long texts are common, so
    few rows bound a worker's memory. A session that allows fewer already keeps its setting."""
    if not 0 < int(spark.conf.get(BATCH)) <= rows:
        spark.conf.set(BATCH, str(rows))


@contextmanager
def batch_rows(spark: SparkSession, rows: int = 512) -> Iterator[None]:
    """Rows of an Arrow batch while the block runs; the session's setting comes back after it."""
    before = spark.conf.get(BATCH)
    spark.conf.set(BATCH, str(rows))
    try:
        yield
    finally:
        spark.conf.set(BATCH, before)


def give_back() -> None:
    """Return memory that a finished batch no longer needs, before the next one comes: workers live on between stages."""
    pa.default_memory_pool().release_unused()


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Each name, with as many underscores in front as it takes to clash with no column of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a string array and each text's bounds; a null text is empty."""
    texts = pa.array(texts.to_pylist(), pa.large_string()) if not pa.types.is_large_string(texts.type) and not pa.types.is_string(texts.type) else texts
    wide = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(wide.buffers()[1], np.int64, len(wide) + 1, wide.offset * 8)
    raw = wide.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = 1 << 19, lead: int = 0) -> Iterator[tuple[int, int, int, np.ndarray, int]]:
    """Cut a text buffer into pieces of about ``most`` bytes: (start, end, first text, text of each byte, lead).

    Small texts share a piece; a longer one is cut, and each later piece of it starts ``lead`` bytes early."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        start, end = int(offsets[i]), int(offsets[j])
        if j > i + 1 or end - start <= most:
            yield start, end, i, np.repeat(np.arange(i, j), np.diff(offsets[i : j + 1])), 0
        else:
            for a in range(start, end, most):
                b, early = min(end, a + most), min(lead, a - start)
                yield a - early, b, i, np.full(b - a + early, i), early
        i = j
