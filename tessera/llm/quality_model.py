"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics come from whole texts. The trees are grown with numpy on the driver from a bounded sample of labelled
documents (``sample`` rows, chosen by a hash of the id) and flattened into arrays, which score any number of
documents by vectorised traversal.

Defined cases: a null text is empty and gets a score like any other; labels that are null or repeated are harmless;
documents with one id stand for it by the
least of their statistics; without labels, or with one kind only, every score is the share of label 1 (0.5 without any); an empty table gives an
empty result; other columns are ignored by ``score_column``'s callers and kept by ``keep_good``."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import arrow_rows, batch_rows, crc32_mod, give_back, slices, table, text_buffer
from tessera.operators.kept import dealt

SAMPLE, THRESHOLD = 20_000, 0.3
_CLASSES = [b" \t\r\x0b\x0c", b"\n", bytes(range(97, 123)), bytes(range(65, 91)), b"0123456789", b".", b",", b"!?", b"|", b"#$%&*<>@^~\\", b"'\"()[]{}", b"-_/+=:;`", bytes(range(194, 245)), bytes(range(128, 194))]


def _class_of() -> np.ndarray:
    out = np.full(256, len(_CLASSES), np.int64)
    for k, members in enumerate(_CLASSES):
        out[list(members)] = k
    return out


CLASS, KINDS = _class_of(), len(_CLASSES) + 1
N_FEATURES = KINDS + 10


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of ``N_FEATURES`` document statistics for each text."""
    data, offsets = text_buffer(texts)
    n = len(offsets) - 1
    kinds, starts = np.zeros((n, KINDS)), np.zeros(n)
    for a, b, first, owner, _ in slices(offsets):
        kind = CLASS[data[a:b]]
        here = owner[-1] + 1 - first if len(owner) else 0
        kinds[first : first + here] += np.bincount((owner - first) * KINDS + kind, minlength=here * KINDS).reshape(here, KINDS)
        word = kind > 1
        begin = word.copy()
        begin[1:] &= ~word[:-1] | (owner[1:] != owner[:-1])
        if len(begin) and a > offsets[first]:  # a cut within a text: a word that goes on has been counted
            begin[0] &= CLASS[data[a - 1]] <= 1
        starts[first : first + here] += np.bincount(owner[begin] - first, minlength=here)
    size = np.diff(offsets).astype(float)
    distinct, repeated, upper, longest = (np.zeros(n) for _ in range(4))
    for i, t in enumerate(texts.cast(pa.binary()).to_pylist()):
        if not t:
            continue
        words, lines = t.split(), t.split(b"\n")
        distinct[i] = len(set(words))
        repeated[i] = len(lines) - len(set(lines))
        longest[i] = max(map(len, lines))
    per_byte, words = np.maximum(size, 1), np.maximum(starts, 1)
    letters = kinds[:, 2] + kinds[:, 3] + kinds[:, 12]
    upper = kinds[:, 3] / np.maximum(letters, 1)
    out = [kinds / per_byte[:, None], np.log1p(size), np.log1p(starts), letters / words, distinct / words, distinct / np.sqrt(words), repeated / (kinds[:, 1] + 1), np.log1p(longest), starts / (kinds[:, 1] + 1), upper, kinds[:, 9] / words]
    return np.column_stack(out).astype(np.float32)


@dataclass
class Trees:
    """Complete trees of one depth, flattened: node k's children are 2k+1 and 2k+2; a leaf's value is its own."""

    feature: np.ndarray  # trees x inner nodes
    cut: np.ndarray  # trees x inner nodes; left where the statistic is at most the cut
    value: np.ndarray  # trees x leaves
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        depth = int(np.log2(self.value.shape[1])) if self.value.size else 0
        for feature, cut, value in zip(self.feature, self.cut, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            total += value[node - len(feature)]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def grow(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, bins: int = 64, rate: float = 0.2, l2: float = 1.0) -> Trees:
    """Boost logistic loss. Each level of a tree is one histogram of gradients by node, statistic and bin."""
    inner, leaves = 2**depth - 1, 2**depth
    share = (y.sum() + 0.5 * (len(y) == 0)) / max(len(y), 1)
    share = min(max(share if len(y) else 0.5, 1e-6), 1 - 1e-6)
    base = float(np.log(share / (1 - share)))
    empty = Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), base)
    if len(y) == 0 or y.min() == y.max():
        return empty
    n, m = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
    binned = np.column_stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)])
    cuts = np.full((m, bins), np.inf)
    for j, e in enumerate(edges):
        cuts[j, : len(e)] = e
    flat = binned + np.arange(m) * bins
    margin = np.full(n, base)
    made: list[tuple] = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = y - p, p * (1 - p)
        node = np.zeros(n, np.int64)
        feature, cut, value = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(leaves)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            key = ((node - first)[:, None] * (m * bins) + flat).ravel()
            g = np.bincount(key, np.repeat(grad, m), width * m * bins).reshape(width, m, bins).cumsum(2)
            h = np.bincount(key, np.repeat(hess, m), width * m * bins).reshape(width, m, bins).cumsum(2)
            gt, ht = g[:, :, -1:], h[:, :, -1:]
            gain = g**2 / (h + l2) + (gt - g) ** 2 / (ht - h + l2) - gt**2 / (ht + l2)
            gain[(h < 1) | (ht - h < 1) | np.isinf(cuts)[None]] = 0
            best = gain.reshape(width, -1).argmax(1)
            split = gain.reshape(width, -1)[np.arange(width), best] > 1e-9
            at = first + np.arange(width)
            feature[at] = np.where(split, best // bins, 0)
            cut[at] = np.where(split, cuts[best // bins, best % bins], np.inf)
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > cut[node])
        leaf = node - inner
        value = rate * np.bincount(leaf, grad, leaves) / (np.bincount(leaf, hess, leaves) + l2)
        margin += value[leaf]
        made.append((feature, cut, value))
    return Trees(*(np.array(c) for c in zip(*made)), base)


@F.arrow_udf(T.ArrayType(T.FloatType()))
def statistics_udf(texts: pa.Array) -> pa.Array:
    x = statistics(texts)
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, N_FEATURES), pa.int32()), pa.array(x.ravel()))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees:
    """Trees from ``docs`` (doc_id, text) and ``labels`` (doc_id, quality): about ``sample`` labelled documents at most."""
    marked = labels.where("quality is not null and doc_id is not null").select("doc_id", F.col("quality").cast("double").alias("quality"))
    share = sample / max(marked.count(), 1)
    if share < 1:
        marked = marked.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    marked = marked.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    taken = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(marked), "doc_id")  # about `sample` rows at most
    with batch_rows(docs.sparkSession):  # of rows with one id, the least statistics stand for it, so reruns agree
        seen = taken.select("doc_id", "quality", statistics_udf("text").alias("x")).groupBy("doc_id").agg(F.first("quality").alias("quality"), F.min("x").alias("x")).toPandas().sort_values("doc_id")
    x = np.array(seen["x"].tolist(), np.float32).reshape(-1, N_FEATURES)
    return grow(x, seen["quality"].to_numpy(float))


def score_column(trees: Trees, text: str = "text") -> Column:
    @F.arrow_udf(T.DoubleType())
    def score(texts: pa.Array) -> pa.Array:
        give_back()
        return pa.array(trees.score(statistics(texts)))

    return score(F.coalesce(F.col(text).cast("string"), F.lit("")))


def fit_tables(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Trees:
    """Trees from the table labels, without the rows held out."""
    return fit(docs, table(spark, sf_dir, "labels").where(crc32_mod("doc_id", 5) != 0))


def keep_good(docs: DataFrame, trees: Trees, threshold: float = THRESHOLD) -> DataFrame:
    arrow_rows(docs.sparkSession)
    return docs.where(score_column(trees) >= threshold)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document; labels are learned only where crc32(doc_id) mod 5 is not 0."""
    arrow_rows(spark)
    docs = dealt(table(spark, sf_dir, "documents"))
    scored = docs.select("doc_id", (crc32_mod("doc_id", 5) == 0).alias("held_out"), score_column(fit_tables(spark, docs, sf_dir)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
