"""SimHash near-duplicates by anchor-point covering.

Two of the 64 bits are set aside and the rest are two segments of 31 bits. Fingerprints that differ in at most 4 bits
differ in at most 2 of one segment. In a segment, the anchors are the words of the perfect Hamming [31, 26] code:
covering radius 1, so any point has exactly one anchor within 1. Of two points within 2 of each other a point midway
is within 1 of both, and that point's anchor is within 2 of both: so each fingerprint is replicated to its 16
anchors within the covering radius plus half of the segment's threshold (the other end replicates over the other
half), and every link shows at some anchor. There the full 64 bits are compared.

An anchor's fingerprints give the edges of a spanning forest, never all pairs. An anchor with more than ``block``
fingerprints is cut into blocks, and pairs of blocks are compared in tasks of their own, so none is left out.
Components follow from large-star and small-star rounds on the distributed edges.

Defined cases: a null or empty text has fingerprint zero; a null id never is a component's id unless it has no other
(then null); repeated rows have equal fingerprints and share a component; an empty table gives an empty result;
other columns are ignored by ``components`` and kept by ``keep_one``."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import batch_rows, fresh, give_back, table, written
from tessera.operators.kept import dealt

THRESHOLD, SEGMENT, BLOCK = 4, 31, 4096


def fingerprints(texts: list[bytes | None], width: int = 4, seed: int = 42) -> np.ndarray:
    """64-bit SimHash over shingles of ``width`` words, A-Z lower-cased; bit k is 1 if set in over half the hashes."""
    from xxhash import xxh64_intdigest

    out = np.zeros(len(texts), np.uint64)
    for i, t in enumerate(texts):
        words = t.lower().split() if t else []
        if not words:
            continue
        joined = b" ".join(words)
        if len(words) <= width:
            out[i] = xxh64_intdigest(joined, seed)
            continue
        lens = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lens + 1) - 1
        spans = zip((ends - lens)[: 1 - width].tolist(), ends[width - 1 :].tolist())
        votes, n = np.zeros(64, np.int64), 0
        while part := [xxh64_intdigest(joined[a:b], seed) for a, b in islice(spans, 1 << 14)]:
            votes += np.unpackbits(np.array(part, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
            n += len(part)
        out[i] = np.packbits(2 * votes > n, bitorder="little").view(np.uint64)[0]
    return out


@F.arrow_udf(T.LongType())
def fingerprint(texts: pa.Array) -> pa.Array:
    give_back()
    return pa.array(fingerprints(texts.cast(pa.binary()).to_pylist()).view(np.int64))


def _flips() -> np.ndarray:
    """For each syndrome, the 16 changes of a 31-bit word that lead to code words within distance 2 (a code word's own is repeated)."""
    out = np.zeros((32, 16), np.uint64)
    for s in range(1, 32):
        pairs = [(1 << (s - 1))] + [(1 << (i - 1)) | (1 << ((i ^ s) - 1)) for i in range(1, 32) if i != s and i < i ^ s]
        out[s] = pairs
    return out


def anchors(fps: np.ndarray) -> np.ndarray:
    """The anchors (n x 32) of fingerprints: 16 of each segment; the second segment's have bit 31 set."""
    flips, mask = _flips(), np.uint64((1 << SEGMENT) - 1)
    out = np.empty((len(fps), 32), np.int64)
    for k in range(2):
        word = fps >> np.uint64(k * SEGMENT) & mask
        syndrome = np.zeros(len(fps), np.int64)
        for i in range(1, SEGMENT + 1):
            syndrome ^= (word >> np.uint64(i - 1) & np.uint64(1)).astype(np.int64) * i
        out[:, 16 * k : 16 * k + 16] = (word[:, None] ^ flips[syndrome] | np.uint64(k << SEGMENT)).astype(np.int64)
    return out


def _replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fps = b.column("fp").to_numpy(zero_copy_only=False).astype(np.int64)
        for i in range(0, len(fps), 4096):
            part = fps[i : i + 4096]
            at = anchors(part.view(np.uint64))
            keep = np.ones(at.shape, bool)
            keep[:, 1:16] = at[:, 1:16] != at[:, :1]  # a code word has one anchor only
            keep[:, 17:] = at[:, 17:] != at[:, 16:17]
            yield pa.RecordBatch.from_arrays([pa.array(at[keep]), pa.array(np.repeat(part, keep.sum(1)))], ["anchor", "fp"])


def forest(fps: np.ndarray, threshold: int = THRESHOLD) -> list[tuple[np.ndarray, np.ndarray]]:
    """Edges of a spanning forest of the fingerprints that differ in at most ``threshold`` bits."""
    rest, edges = fps[1:], []
    front = fps[:1]
    while len(rest):
        parent = np.full(len(rest), -1)
        for i in range(0, len(front), 256):
            near = np.bitwise_count(front[i : i + 256, None] ^ rest[None, :]) <= threshold
            hit = near.any(0) & (parent < 0)
            parent[hit] = i + near[:, hit].argmax(0)
        found = parent >= 0
        if found.any():
            edges.append((front[parent[found]], rest[found]))
            front, rest = rest[found], rest[~found]
        else:
            front, rest = rest[:1], rest[1:]
    return edges


def _link(keys: list[str], block: int, threshold: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From rows sorted by ``keys``: edges (a, b), and rows (anchor, fp, block) of groups of more than ``block``."""

    def out(a=(), b=(), anchor=None, fp=None, number=None) -> pa.RecordBatch:
        if anchor is None:
            n = len(a)
            return pa.RecordBatch.from_arrays([pa.array(np.asarray(a, np.uint64).view(np.int64)), pa.array(np.asarray(b, np.uint64).view(np.int64)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32())], ["a", "b", "anchor", "fp", "block"])
        n = len(fp)
        return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array(np.full(n, anchor)), pa.array(fp.view(np.int64)), pa.array(np.full(n, number, np.int32))], ["a", "b", "anchor", "fp", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held, hot = None, np.zeros(0, np.uint64), -1  # hot: blocks already given out of the held group

        def flush() -> Iterator[pa.RecordBatch]:
            if hot >= 0 and len(held):
                yield out(anchor=held_key[0], fp=held, number=hot)
            elif len(held) > 1:
                for a, b in forest(held, threshold):
                    yield out(a, b)

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
            fps = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            new = np.ones(len(fps), bool)
            new[1:] = np.any([c[1:] != c[:-1] for c in cols], axis=0)
            starts = np.flatnonzero(new)
            ends = np.append(starts[1:], len(fps))
            if held_key == tuple(c[0] for c in cols):
                held = np.concatenate([held, fps[: ends[0]]])
                starts, ends = starts[1:], ends[1:]
            while len(held) > block:
                hot += 1
                yield out(anchor=held_key[0], fp=held[:block], number=hot)
                held = held[block:]
            if not len(starts):
                continue
            yield from flush()
            held_key, held, hot = tuple(c[starts[-1]] for c in cols), fps[starts[-1] : ends[-1]], -1
            starts, ends = starts[:-1], ends[:-1]
            two = starts[ends - starts == 2]
            near = np.bitwise_count(fps[two] ^ fps[two + 1]) <= threshold
            a, b = [fps[two[near]]], [fps[two[near] + 1]]
            for i in np.flatnonzero(ends - starts > 2):
                group = fps[starts[i] : ends[i]]
                if len(group) > block:
                    for k, j in enumerate(range(0, len(group), block)):
                        yield out(anchor=cols[0][starts[i]], fp=group[j : j + block], number=k)
                    continue
                for x, y in forest(group, threshold):
                    a.append(x)
                    b.append(y)
            if sum(map(len, a)):
                yield out(np.concatenate(a), np.concatenate(b))
        yield from flush()

    return run


LINKS = "a long, b long, anchor long, fp long, block int"


def links(distinct: DataFrame, threshold: int = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) that connect whatever fingerprints of ``distinct`` (fp) are linked, through links of at most ``threshold`` bits."""
    if threshold > 4:
        raise ValueError("two segments with a Hamming code each cover thresholds up to 4")
    copies = distinct.select("fp").mapInArrow(_replicate, "anchor long, fp long")
    with batch_rows(distinct.sparkSession, 20_000):
        found = written(copies.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_link(["anchor"], block, threshold), LINKS), "simhash-links")
    edges = found.where("a is not null").select("a", "b")
    hot = found.where("anchor is not null").select("anchor", "fp", "block")
    if hot.isEmpty():
        return edges
    blocks = written(hot.groupBy("anchor").agg((F.max("block") + 1).alias("n")), "simhash-hot")
    paired = hot.join(blocks, "anchor").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    paired = paired.select("anchor", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "fp")
    by_pair = paired.repartition("anchor", "i", "j").sortWithinPartitions("anchor", "i", "j")
    with batch_rows(distinct.sparkSession, 20_000):
        more = written(by_pair.mapInArrow(_link(["anchor", "i", "j"], 2 * block, threshold), LINKS), "simhash-blocks")
    return edges.unionByName(more.select("a", "b"))


def connected(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node that each node of ``edges`` (a, b) reaches. Alternating large and small stars;
    each round is written, and the driver sees one count and checksum of it. The least neighbours are written before they
    are joined: broadcast while they are small, and beyond that a plain shuffle side, so that adaptive execution can
    split a node with very many neighbours."""
    mark = lambda e: e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    edges = edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = written(edges, "stars")
    seen = None
    while seen != (now := mark(edges)):
        seen = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "star-least")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        large = written(large.distinct(), "stars")
        least = written(large.groupBy("u").agg(F.min("v").alias("m")), "star-least")
        small = large.join(least, "u")
        small = small.select("u", F.col("m").alias("v")).unionByName(small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        edges = written(small.distinct(), "stars")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))


def component_ids(prints: DataFrame, row: str = "doc_id") -> DataFrame:
    """(fp, component_id, component_row) of each distinct fingerprint of ``prints`` (doc_id, fp): the component's smallest
    id, and the smallest ``row`` among its documents with that id."""
    least = lambda: F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(row).alias("row")))
    distinct = written(prints.groupBy("fp").agg(least().alias("__least")), "fingerprints")
    labels = connected(links(distinct))
    joined = distinct.join(labels, F.col("fp") == F.col("node"), "left").withColumn("__label", F.coalesce("label", "fp"))
    joined = joined.select("fp", "__least", "__label")
    first = written(joined.groupBy("__label").agg(F.min("__least").alias("__first")), "component-first")  # known size: see connected
    return written(joined.join(first, "__label").select("fp", F.col("__first.id").alias("component_id"), F.col("__first.row").alias("component_row")), "components")


def components(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) of every document."""
    with batch_rows(docs.sparkSession):
        prints = written(docs.select("doc_id", fingerprint(F.col("text").cast("string")).alias("fp")), "prints")
    return prints.join(component_ids(prints), "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents without near-duplicates: of each component one row, the first written with the smallest id.

    Rows are numbered as they are written; the numbers of the rows that stay are hashed, and texts pass them once,
    dealt out by number and unsorted."""
    print_, row, kept = fresh(docs, "__fp", "__row", "__kept")
    with batch_rows(docs.sparkSession):
        rows = written(docs.withColumn(print_, fingerprint(F.col("text").cast("string"))).withColumn(row, F.monotonically_increasing_id()), "printed")
    ids = component_ids(rows.select("doc_id", F.col(print_).alias("fp"), F.col(row).alias("row")), "row")
    chosen = ids.select(F.col("component_row").alias(kept)).distinct()
    return rows.join(chosen.hint("shuffle_hash"), F.col(row) == F.col(kept), "left_semi").select(*docs.columns)


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document; links at 4 or fewer differing bits."""
    found = components(dealt(table(spark, sf_dir, "documents")))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
