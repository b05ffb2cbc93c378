"""A stored index for text search: which posting has which token where, kept up with inserts, updates and deletions.

The index has one row per posting and distinct token, with the token's places in the title and in the description. It is
stored in runs of about a million words, each by token, so a query reads the pages of its own tokens and nothing else: words
are settled by their rows, phrases by places that follow each other. No text is read again."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import query_terms, search_tokens

ROWS, WORDS = 64, 1 << 20  # postings read at once, and words after which a run is written


def _run(parts: list[list[pa.Array]]) -> pa.RecordBatch:
    """(token, id, title_at, text_at) of postings' ids, title tokens and text tokens, by token and place among the postings."""
    ids, *fields = (pa.concat_arrays(x) for x in zip(*parts))
    sizes = [np.asarray(x.value_lengths(), np.int64) for x in fields]
    row = np.concatenate([np.repeat(np.arange(len(ids)), n) for n in sizes])
    at = np.concatenate([np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) for n in sizes]).astype(np.int32)
    coded = pa.concat_arrays([x.flatten() for x in fields]).dictionary_encode()
    by_token = pc.array_sort_indices(coded.dictionary)
    rank = np.empty(len(by_token), np.int64)
    rank[np.asarray(by_token)] = np.arange(len(by_token))
    key = rank[np.asarray(coded.indices)] * len(ids) + row
    order = np.argsort(key, kind="stable")  # a token's places in the title, then those in the text
    first = np.flatnonzero(np.diff(key[order], prepend=-1))
    title, at = order < sizes[0].sum(), at[order]

    def lists(of: np.ndarray) -> pa.Array:
        ends = np.cumsum(np.add.reduceat(of, first, dtype=np.int64))
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(at[of], pa.int32()))

    heads = order[first]
    tokens = coded.dictionary.take(coded.indices.take(pa.array(heads)))
    return pa.RecordBatch.from_arrays([tokens, ids.take(pa.array(row[heads])), lists(title), lists(~title)], ["token", "id", "title_at", "text_at"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The runs of (id, title, text), texts as their tokens."""
    parts, words = [], 0
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            own = batch.slice(start, ROWS).columns
            n = sum(len(x.flatten()) for x in own[1:])
            if not n:
                continue
            parts, words = [*parts, own], words + n
            if words >= WORDS:
                yield _run(parts)
                parts, words = [], 0
    if parts:
        yield _run(parts)


def build(jobs: DataFrame) -> DataFrame:
    """(token, id, title_at, text_at) of ``jobs`` (id, title, description), in runs by token; nothing is shuffled or sorted
    beyond a run."""
    rows = jobs.select("id", search_tokens("title").alias("title"), search_tokens("description").alias("text"))
    return rows.mapInArrow(_runs, f"token string, id {dict(rows.dtypes)['id']}, title_at array<int>, text_at array<int>")


def update(index: DataFrame, changed: DataFrame, deleted: DataFrame | None = None) -> DataFrame:
    """The index after postings were inserted or changed (``changed``: id, title, description) and deleted (id)."""
    gone = changed.select("id") if deleted is None else changed.select("id").unionByName(deleted.select("id"))
    kept = index.join(gone.distinct(), "id", "left_anti").select("token", "id", "title_at", "text_at")
    return kept.unionByName(build(changed)).repartitionByRange("token").sortWithinPartitions("token", "id")


def _phrase(at: list[Column]) -> Column:
    """Whether some place of the first token is followed by the others', each at the next place."""
    return F.exists(at[0], lambda p: _all([F.array_contains(x, p + k) for k, x in enumerate(at[1:], 1)]))


def _all(tests: list[Column]) -> Column:
    out = F.lit(True)
    for x in tests:
        out = out & x
    return out


def having(index: DataFrame, raw: str, scope: str = "all", every: bool = True) -> DataFrame:
    """(id) of postings that have all of a query's terms, or any of them (``every`` false), in title or description, or with
    scope title or text in that one alone. A term without a token is nowhere; a query without terms finds nothing."""
    terms = query_terms(raw)
    words = sorted({w for t in terms for w in t})
    rows = index.where(F.col("token").isin(words)) if words else index.where(F.lit(False))
    fields = {"title": ("title_at",), "text": ("text_at",)}.get(scope, ("title_at", "text_at"))
    if len(fields) == 1:
        rows = rows.where(F.size(fields[0]) > 0)
    found = lambda w: F.struct(*(F.flatten(F.collect_list(F.when(F.col("token") == w, F.col(x)))).alias(x) for x in fields))
    at = rows.groupBy("id").agg(F.lit(0).alias("_"), *(found(w).alias(f"w{k}") for k, w in enumerate(words)))  # a query's tokens at most

    def has(term: list[str]) -> Column:
        if not term:
            return F.lit(False)
        own = [F.col(f"w{words.index(w)}") for w in term]
        hit = F.lit(False)
        for field in fields:
            hit = hit | (_phrase([x[field] for x in own]) if len(own) > 1 else F.size(own[0][field]) > 0)
        return hit

    tests = [has(t) for t in terms]
    if every:
        return at.where(_all(tests)).select("id")
    return at.where(~_all([~x for x in tests])).select("id")
