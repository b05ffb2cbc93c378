"""Token counts behind a digest cache: content and tokenizer-version digests are joined to stored counts, only
distinct misses are encoded, and their counts are appended to the cache.

Which row encodes a digest is settled without moving the texts. Digests are grouped, and the missing ones marked in
bitmaps of a fixed number of slots, at most 64 MB together: slots with a missing digest, and slots where a digest is
repeated or stored already. A row whose slot misses nothing is done; one whose slot is in the first bitmap only holds
a missing text that is there once, and is encoded where it lies; only the rows of slots in both are grouped by digest,
partial groups first, so that a text with very many copies arrives as one row a task.

Defined cases: a null text counts as empty (0 tokens); repeated texts are encoded once, whatever their ids; null or
repeated ids keep their rows; an empty table gives an empty result; other columns of the input are ignored."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import batch_rows, scratch, table, written
from tessera.llm.encoders import encoder
from tessera.operators.kept import dealt

SLOTS = 1 << 28  # 2 bits each
CACHE = T.StructType([T.StructField("content", T.BinaryType()), T.StructField("version", T.StringType()), T.StructField("n_tokens", T.LongType())])


def tokenizer_version(path: str) -> str:
    """Digest of the vocabulary file: another vocabulary never reads this one's counts."""
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()[:32]


def open_cache(spark: SparkSession, path: str) -> str:
    """Make an empty cache at ``path`` unless there is one."""
    spark.createDataFrame([], CACHE).write.mode("ignore").parquet(path)
    return path


def _encode(path: str, drops_space: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            counts: list[int] = []
            for i in range(0, len(texts), 64):
                counts += encoder(path, drops_space).counts(texts[i : i + 64])
            yield pa.RecordBatch.from_arrays([b.column("content"), pa.array(counts, pa.int64())], ["content", "n_tokens"])

    return run


def _bit(bitmap: Column, place: Column) -> Column:
    """Whether the bit at ``place`` (from 0) of a bitmap is set; of none, none is."""
    byte = F.conv(F.hex(F.substr(bitmap, (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.call_function("bit_get", byte, (place % 8).cast("int")), F.lit(0)) == 1


def count_tokens(docs: DataFrame, tokenizer: str, cache: str, drops_space: bool = False, slots: int = SLOTS) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of ``docs`` (doc_id, text), and new counts appended to the table at ``cache``.

    Two runs at once may append a digest twice, with the same count; readers take one."""
    spark = docs.sparkSession
    version = tokenizer_version(tokenizer)
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("content"))
    known = lambda: spark.read.schema(CACHE).parquet(cache).where(F.col("version") == version).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))
    slot = F.pmod(F.xxhash64("content"), F.lit(slots)) + 1
    bucket, place = F.bitmap_bucket_number(slot), F.bitmap_bit_position(slot)
    seen = rows.groupBy("content").agg(F.count("*").alias("n")).join(known().withColumn("stored", F.lit(True)), "content", "left")
    seen = seen.select(bucket.alias("bucket"), place.alias("place"), F.col("stored").isNull().alias("missing"), (F.col("stored").isNotNull() | (F.col("n") > 1)).alias("shared"))
    maps = seen.groupBy("bucket").agg(F.expr("bitmap_construct_agg(place) FILTER (WHERE missing)").alias("missing"), F.expr("bitmap_construct_agg(place) FILTER (WHERE shared)").alias("shared"))
    maps = F.broadcast(written(maps, "token-maps"))  # `slots` / 32768 rows of 8 KB at most
    bit = lambda name: _bit(F.col(name), place)
    asked = rows.select("content", "text").join(maps, bucket == F.col("bucket"), "left").where(bit("missing"))
    alone = asked.where(~bit("shared")).select("content", "text")
    together = asked.where(bit("shared")).groupBy("content").agg(F.first("text").alias("text")).join(known().select("content"), "content", "left_anti")
    with batch_rows(spark):
        counts = alone.unionByName(together).mapInArrow(_encode(tokenizer, drops_space), "content binary, n_tokens long")
        counts.select("content", F.lit(version).alias("version"), "n_tokens").write.mode("append").parquet(cache)
    stored = written(known(), "counts")  # a side without an aggregate of its own, so a digest with very many rows can be split
    return rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "content").join(stored, "content").select("doc_id", "n_bytes", "n_tokens")


def op4_token_counts(spark: SparkSession, sf_dir: str, most: int = 1024) -> DataFrame:
    """Every document's tokens in byte_bpe_50k.json, from a cache that starts empty on each call."""
    import public_tokenizers

    cache = open_cache(spark, scratch(spark, "token-cache"))
    counted = count_tokens(dealt(table(spark, sf_dir, "documents")), public_tokenizers.path("byte_bpe_50k.json"), cache)
    return counted.withColumn("over_limit", F.col("n_tokens") > most)
