"""Export of postings with a report of what was dropped, and audits of stored rows."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import rules, urls
from tessera.functions.text import collapse, export_company, search_tokens
from tessera.operators.jobs import prefer
from tessera.operators.kept import stored


def export(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, one report row) of ``found`` (display_name, title, url, city, location, work_mode, fetch_status, posted_at).

    Location, then title, then one row per company, title and city: a hosted board's link before an aggregator's, a
    fetched page before one that was not, then the first by URL."""
    staged = found.withColumn("__place", rules.relevant_location("location")).withColumn("__verdict", rules.title_verdict("title"))
    kept = staged.where("__place and __verdict is null").withColumns({"__c": export_company("display_name"), "__t": F.lower(collapse("title")), "__y": F.lower(F.coalesce("city", F.lit("")))})
    rows = prefer(kept, ["__c", "__t", "__y"], urls.board("url").isNull(), F.col("fetch_status").eqNullSafe("ok").cast("int").desc(), F.col("url"))
    counts = staged.agg(F.count("*").alias("found"), F.count_if(~F.col("__place")).alias("dropped_by_location"), F.count_if(F.col("__place") & F.col("__verdict").isNotNull()).alias("dropped_by_title"))
    report = counts.crossJoin(rows.agg(F.count("*").alias("kept"), F.count_if(~F.col("fetch_status").eqNullSafe("ok")).alias("not_ok_fetch")))  # one row each
    report = report.withColumn("deduped", F.col("found") - F.col("dropped_by_location") - F.col("dropped_by_title") - F.col("kept"))
    out = rows.select(F.col("display_name").alias("company"), "title", urls.normalize_job_url("url").alias("url"), "city", "work_mode", rules.is_agency("display_name").alias("is_agency"), "fetch_status", F.substring("posted_at", 1, 10).alias("posted_date"))
    return out.orderBy(F.lower("company"), F.lower("title"), "url"), report


def suspicions(jobs: DataFrame) -> DataFrame:
    """``jobs`` (id, title, url, description, family) with a list of reasons to doubt each; most first."""
    text = F.coalesce("description", F.lit(""))
    reasons = F.array_compact(F.array(F.when(F.length(text) < 200, "short description"), F.when(F.col("family").isNull(), "no role family"), F.when(~urls.job_url_hint("url"), "url not job-shaped"), F.when(rules.denied_text("title"), "title reads like navigation")))
    return jobs.withColumn("reasons", reasons).where(F.size("reasons") > 0).orderBy(F.desc(F.size("reasons")), "id")


def _buckets(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """How often the words of a partition, by their hash, fall into each of ``size`` buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(size, np.int64)
        for b in batches:
            seen += np.bincount(b.column("w").flatten().to_numpy() & (size - 1), minlength=size)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(seen[at], pa.int64())], ["bucket", "n"])

    return run


def _prefixes(often: np.ndarray, least: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The rarest words of each set, so many that two sets at least ``least`` similar share one: (company_id, id, n, t, place)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, n = b.column("w").flatten().to_numpy(), pc.list_value_length(b.column("w")).to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(len(n)), n)
            order = np.lexsort((words, often[words & (len(often) - 1)], row))
            place = np.arange(len(words)) - np.repeat(np.cumsum(n) - n, n)
            keep = place < (n - np.ceil(least * n - 1e-9).astype(np.int64) + 1)[row]
            at = pa.array(row[keep])
            yield pa.RecordBatch.from_arrays([b.column("company_id").take(at), b.column("id").take(at), pa.array(n[row[keep]]), pa.array(words[order][keep]), pa.array(place[keep])], ["company_id", "id", "n", "t", "place"])

    return run


#: Longs of a set's parities: bit i is whether an odd number of its words has the hash i.
PARITIES = 8


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of each text once and in order, and a key of the set: null if it is empty."""
    for b in batches:
        w, n = b.column("w").flatten().to_numpy(), pc.list_value_length(b.column("w")).to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(len(n)), n)
        order = np.lexsort((w, row))
        w, row = w[order], row[order]
        new = np.ones(len(w), bool)
        new[1:] = (w[1:] != w[:-1]) | (row[1:] != row[:-1])
        w, row = w[new], row[new]
        ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(n)))]).astype(np.int32)
        keys = [hashlib.md5(w[x:y].tobytes()).hexdigest() if y > x else None for x, y in zip(ends, ends[1:])]
        odd = np.bincount(row * 64 * PARITIES + (w >> 20 & 64 * PARITIES - 1), minlength=len(n) * 64 * PARITIES).astype(np.uint8) & 1
        odd = np.packbits(odd).view(np.int64).reshape(len(n), PARITIES)
        cols = [b.column("company_id"), b.column("id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(w)), b.column("head"), pa.array(keys, pa.string())]
        yield pa.RecordBatch.from_arrays([*cols, *(pa.array(np.ascontiguousarray(odd[:, i])) for i in range(PARITIES))], ["company_id", "id", "w", "head", "words", *(f"s{i}" for i in range(PARITIES))])


def _alike(least: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The pairs of a group whose sets, which come along, are at least ``least`` similar."""

    def run(pairs: pa.Table, sets: pa.Table) -> pa.Table:
        words = {i: frozenset(w) for i, w in zip(sets["id"].to_pylist(), sets["w"].to_pylist())}
        keep = []
        for a, b in zip(pairs["a"].to_pylist(), pairs["b"].to_pylist()):
            both = len(words[a] & words[b])
            keep.append(both / (len(words[a]) + len(words[b]) - both) >= least)
        found = pairs.filter(pa.array(keep, pa.bool_()))
        return pa.table({"company_id": found["company_id"], "kind": pa.array(["like"] * len(found), pa.string()), "a": found["a"], "b": found["b"]})

    return run


def similar_classes(texts: DataFrame, least: float = 0.8, prefix: int = 300, buckets: int = 1 << 18, at_once: int = 20_000) -> DataFrame:
    """(company_id, kind, a, b) of equal beginnings and of word sets at least ``least`` similar within a company, without a
    pair for each two copies.

    ``words`` and ``head``: b has the word set, or the beginning, of a, the smallest id that has it. ``like``: a and b are
    the smallest ids of word sets at least ``least`` similar. Two texts are a pair where they have the same beginning, or
    the same word set that is not empty, or where the smallest ids of their word sets are ``like``. Words are compared by
    their 64-bit hashes. Which words count as rare is counted in buckets; it decides how many candidates there are only. About
    ``at_once`` candidates are compared together."""
    kind = {f.name: f.dataType.simpleString() for f in texts.schema}
    rows = texts.where("company_id is not null").select("company_id", "id", F.transform(search_tokens("text"), lambda x: F.xxhash64(x)).alias("w"), F.sha2(F.substring("text", 1, prefix), 256).alias("head"))
    rows = stored(rows.mapInArrow(_sets, f"company_id {kind['company_id']}, id {kind['id']}, w array<long>, head string, words string, " + ", ".join(f"s{i} long" for i in range(PARITIES))), "word-sets")
    keys = rows.select("company_id", "id", F.explode(F.create_map(F.lit("words"), "words", F.lit("head"), "head")).alias("kind", "key")).where("key is not null")
    first = keys.groupBy("company_id", "kind", "key").agg(F.min("id").alias("a"))
    member = stored(keys.join(first, ["company_id", "kind", "key"]).where(F.col("id") != F.col("a")).select("company_id", "kind", "a", F.col("id").alias("b")), "copies")
    copies = member.where("kind = 'words'").select("company_id", F.col("b").alias("id"))
    sets = rows.where("words is not null").select("company_id", "id", "w").join(copies, ["company_id", "id"], "left_anti")
    often = np.zeros(buckets, np.int64)
    for r in rows.select("w").mapInArrow(_buckets(buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).where("n > 1").collect():  # at most ``buckets`` rows
        often[r.bucket] = r.n
    rare = sets.mapInArrow(_prefixes(often, least), f"company_id {kind['company_id']}, id {kind['id']}, n long, t long, place long")
    a, b = rare.alias("a"), rare.alias("b")
    shared = F.least(F.col("a.n") - F.col("a.place"), F.col("b.n") - F.col("b.place"))  # no more words can be shared from the first shared one on
    enough = shared * (1 + least) >= least * (F.col("a.n") + F.col("b.n")) - 1e-6
    met = a.join(b, (F.col("a.company_id") == F.col("b.company_id")) & (F.col("a.t") == F.col("b.t")) & (F.col("a.id") < F.col("b.id")) & enough)
    pairs = stored(met.select(F.col("a.company_id").alias("company_id"), F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct(), "candidates")
    odd = rows.select("company_id", "id", F.size("w").alias("n"), *(f"s{i}" for i in range(PARITIES)))
    sides = [odd.toDF("company_id", x, f"{x}n", *(f"{x}s{i}" for i in range(PARITIES))) for x in "ab"]
    differ = sum((F.bit_count(F.col(f"as{i}").bitwiseXOR(F.col(f"bs{i}"))) for i in range(PARITIES)), F.lit(0))  # at least as many words are in one set only
    near = pairs.join(sides[0], ["company_id", "a"]).join(sides[1], ["company_id", "b"]).where(differ * (1 + least) <= (1 - least) * (F.col("an") + F.col("bn")) + 1e-6)
    pairs = stored(near.select("company_id", "a", "b"), "near")
    lowest = pairs.groupBy("company_id", F.col("b").alias("a")).agg(F.min("a").alias("m"))
    further = lowest.select("company_id", F.col("a").alias("m"), F.col("m").alias("least_m"))
    lowest = lowest.join(further, ["company_id", "m"], "left").select("company_id", "a", F.coalesce("least_m", "m").alias("m"))
    own = ["company_id", "m", "part"]  # sets go once to each part of their group, not once to each of its pairs
    dealt = stored(pairs.join(lowest, ["company_id", "a"], "left").select("company_id", F.coalesce("m", "a").alias("m"), "a", "b"), "groups")
    parts = dealt.groupBy("company_id", "m").agg(F.ceil(F.count("*") / at_once).alias("parts"))
    dealt = dealt.join(parts, ["company_id", "m"]).select("company_id", "m", F.pmod(F.xxhash64("b"), "parts").alias("part"), "a", "b")
    need = dealt.select(*own, F.explode(F.array("a", "b")).alias("id")).distinct().join(rows.select("company_id", "id", "w"), ["company_id", "id"])
    need = need.select(*(F.col(x).alias(f"n_{x}") for x in own), "id", "w")
    like = dealt.groupBy(*own).cogroup(need.groupBy(*(f"n_{x}" for x in own))).applyInArrow(_alike(least), f"company_id {kind['company_id']}, kind string, a {kind['id']}, b {kind['id']}")
    return member.unionByName(like)


def bm25(passages: DataFrame, queries: DataFrame, k: int = 4, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(query_id, passage_id, score, rank): the k best of ``passages`` (passage_id, text) for ``queries`` (query_id, text)."""
    tokens = passages.select("passage_id", search_tokens("text").alias("w")).withColumn("len", F.size("w"))
    stats = tokens.agg(F.count("*").alias("n"), F.avg("len").alias("mean"))
    tf = tokens.select("passage_id", "len", F.explode("w").alias("t")).groupBy("passage_id", "len", "t").agg(F.count("*").alias("tf"))
    df = tf.groupBy("t").agg(F.count("*").alias("df"))
    asked = queries.select("query_id", F.explode(F.array_distinct(search_tokens("text"))).alias("t"))
    hits = asked.join(df, "t").join(tf, "t").crossJoin(stats)  # stats is one row
    weight = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("mean")))
    scored = hits.groupBy("query_id", "passage_id").agg(F.round(F.sum(weight), 6).alias("score"))
    return scored.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "passage_id"))).where(F.col("rank") <= k)


def chunks(texts: DataFrame, size: int = 900) -> DataFrame:
    """(id, chunk, text) pieces of fixed length."""
    n = F.greatest(F.ceil(F.length("text") / size).cast("int"), F.lit(1))
    return texts.select("id", F.posexplode(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substr(F.col("text"), i * size + 1, F.lit(size)))).alias("chunk", "text"))


def _counts(terms: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(id, chunk, w) to (id, chunk, len, terms, tf): the tokens, and how often each of ``terms`` is among them, by its number."""
    known = pa.array(terms, pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w = b.column("w")
            lengths = pc.list_value_length(w).to_numpy(zero_copy_only=False).astype(np.int64)
            at = pc.index_in(w.flatten(), known).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(len(lengths)), lengths)
            row, at = row[at >= 0], at[at >= 0]
            both, tf = np.unique(row * max(len(terms), 1) + at, return_counts=True)
            row, at = both // max(len(terms), 1), both % max(len(terms), 1)
            ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(lengths)))]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (at, tf)]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("chunk"), pa.array(lengths), *lists], ["id", "chunk", "len", "terms", "tf"])

    return run


def _sums(terms: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A partition's chunks with each term, all its chunks (-1) and their tokens (-2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, tokens = np.zeros(terms, np.int64), 0, 0
        for b in batches:
            df += np.bincount(b.column("terms").flatten().to_numpy(), minlength=terms)
            n, tokens = n + b.num_rows, tokens + int(b.column("len").to_numpy().sum())
        there = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([*there, -1, -2], pa.int32()), pa.array([*df[there], n, tokens], pa.int64())], ["t", "n"])

    return run


def _best(asked: list[np.ndarray], idf: np.ndarray, mean: float, k: int, k1: float, b: float, block: int = 256) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The ``k`` best passages of a partition for each query; of equal scores, the first by id and chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[float, int, int]]] = [[] for _ in asked]
        least = np.zeros(len(asked))
        for rows in batches:
            ids, chunk, lengths = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("id", "chunk", "len"))
            tf = rows.column("tf").flatten().to_numpy().astype(np.float64)
            at = rows.column("terms").flatten().to_numpy()
            row = np.repeat(np.arange(len(ids)), pc.list_value_length(rows.column("terms")).to_numpy(zero_copy_only=False))
            there, place = np.unique(at, return_inverse=True)
            weights = np.zeros((len(ids), len(there)))
            weights[row, place] = idf[at] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * lengths[row] / mean))
            where = np.full(len(idf), -1)
            where[there] = np.arange(len(there))
            for first in range(0, len(asked), block):
                has = np.zeros((len(there), min(block, len(asked) - first)))
                for q, own in enumerate(asked[first : first + block]):
                    own = where[own]
                    has[own[own >= 0], q] = 1
                scores = np.round(weights @ has, 6)
                hit = (scores > 0) & (scores >= least[first : first + block])
                for q in np.flatnonzero(hit.any(axis=0)):
                    i = np.flatnonzero(hit[:, q])
                    if len(i) > k:
                        i = i[np.lexsort((chunk[i], ids[i], -scores[i, q]))[:k]]
                    found = best[first + q] + [(-float(scores[j, q]), int(ids[j]), int(chunk[j])) for j in i]
                    best[first + q] = sorted(found)[:k]
                    if len(best[first + q]) == k:
                        least[first + q] = -best[first + q][-1][0]
        out = [(q, i, c, -s) for q, own in enumerate(best) for s, i, c in own]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int32(), pa.float64()))], ["__q", "id", "chunk", "score"])

    return run


def bm25_chunks(texts: DataFrame, queries: DataFrame, k: int = 4, size: int = 900, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(query_id, id, chunk, score, rank): ``bm25`` of every query (query_id, text) over the chunks of every text (id, text).

    The queries' words go to the tasks; a chunk is scored against all queries where it is, and a task passes on its k
    best for each. Texts are read twice: for how many chunks have a word, and for the scores."""
    spark = texts.sparkSession
    asked = queries.select("query_id", F.array_distinct(search_tokens("text")).alias("w")).collect()
    terms = sorted({x for r in asked for x in r.w})
    place = {x: i for i, x in enumerate(terms)}
    pieces = chunks(texts, size).select(F.col("id").cast("long").alias("id"), F.col("chunk").cast("int").alias("chunk"), search_tokens("text").alias("w"))
    counts = pieces.mapInArrow(_counts(terms), "id long, chunk int, len long, terms array<int>, tf array<int>")
    seen = {r.t: r.n for r in counts.mapInArrow(_sums(len(terms)), "t int, n long").groupBy("t").agg(F.sum("n").alias("n")).collect()}  # the queries' words and two more
    df, n = np.array([seen.get(i, 0) for i in range(len(terms))]), seen.get(-1, 0)
    idf, mean = np.log(1 + (n - df + 0.5) / (df + 0.5)), seen.get(-2, 0) / max(n, 1)
    of = [np.array([place[x] for x in r.w], np.int64) for r in asked]
    best = counts.where(F.size("terms") > 0).mapInArrow(_best(of, idf, mean, k, k1, b), "__q long, id long, chunk int, score double")
    w = W.partitionBy("__q").orderBy(F.desc("score"), "id", "chunk")
    top = best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    names = spark.createDataFrame([(i, r.query_id) for i, r in enumerate(asked)], f"__q long, query_id {queries.schema['query_id'].dataType.simpleString()}")
    return top.join(names, "__q").select("query_id", "id", "chunk", "score", F.col("rank").cast("long").alias("rank"))


def _blocks(prefix: str, size: int = 1024) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Up to ``size`` rows (vec_id, embedding) in one, by id: their ids and the doubles of their vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, size):
                part = b.slice(at, size)
                ids, vectors = part.column("vec_id").to_numpy(), part.column("embedding")
                matrix = vectors.flatten().to_numpy().astype(np.float64).reshape(len(ids), -1)
                order = np.argsort(ids, kind="stable")
                yield pa.RecordBatch.from_arrays([pa.array([ids[order].tobytes()]), pa.array([matrix[order].tobytes()])], [f"{prefix}_ids", f"{prefix}_vectors"])

    return run


def _nearest(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The ``k`` best of a block of vectors for each query of a block; of equal scores, the first by id; without a score, last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                asked, ids = np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["v_ids"], np.int64)
                q, v = (np.frombuffer(row[f"{x}_vectors"]).reshape(len(n), -1) for x, n in (("q", asked), ("v", ids)))
                with np.errstate(invalid="ignore", divide="ignore"):
                    scores = np.round(q @ v.T / np.sqrt((q * q).sum(1)[:, None] * (v * v).sum(1)), 6)
                scores[np.isnan(scores)] = -2.0
                scores[asked[:, None] == ids] = -3.0
                at = np.argsort(-scores, axis=1, kind="stable")[:, :k]
                found = np.take_along_axis(scores, at, axis=1)
                keep = found > -3
                score = pa.array(found[keep], pa.float64(), mask=found[keep] == -2)
                yield pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(asked[:, None], at.shape)[keep]), pa.array(ids[at][keep]), score], ["query_id", "vec_id", "score"])

    return run


def cosine_topk(queries: DataFrame, vectors: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, vec_id, score): the ``k`` most similar of ``vectors`` to each of ``queries`` (both vec_id, embedding), itself excepted.

    Blocks of queries meet blocks of vectors, and only the best of a block for each query are passed on."""
    sides = []
    for rows, x in ((queries, "q"), (vectors, "v")):
        rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where("vec_id is not null and embedding is not null")
        sides.append(rows.mapInArrow(_blocks(x), f"{x}_ids binary, {x}_vectors binary"))
    best = sides[1].crossJoin(sides[0]).mapInArrow(_nearest(k), "query_id long, vec_id long, score double")  # blocks of both
    w = W.partitionBy("query_id").orderBy(F.col("score").desc_nulls_last(), "vec_id")
    return best.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).select("query_id", "vec_id", "score")


__all__ = ["bm25", "bm25_chunks", "chunks", "cosine_topk", "export", "similar_classes", "suspicions"]
