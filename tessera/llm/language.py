"""Language identification by prediction by partial matching (PPM, escape method C with exclusion).

Each language has a byte context tree of orders 0 to 3, frozen after training. In a context seen n times with t
different next bytes, a byte seen c times costs -log2(c / (n + t)) bits, and an escape to the next shorter context
-log2(t / (n + t)); bytes already excluded by a longer context count no more. A text's code length in a language is the
sum of its bytes' costs, and the language of the shortest code is predicted.

Trees are sparse: sorted arrays of the grams that were seen and their counts, and for each context its totals and what
is left of the next shorter context's totals after exclusion. As nothing changes while scoring, the exact cost of every
gram that any language of a block of ``BLOCK`` languages has seen is tabled once, in a hash table of grams; other grams
are costed from the trees when they turn up. So memory follows the grams seen, for any number of languages, and no
context is left out.

Trees come from a bounded sample: about ``per_lang`` documents of each language, chosen by a hash of id and text, whole.
Rows with equal id and text are in it together; the driver gets their distinct grams, not their rows.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; null languages are not learned from;
without anything to learn from, all is ``und``; repeated rows and ids, and null ids, are harmless; an empty table gives
an empty result; other columns are ignored by ``predict``'s callers and kept by ``keep_known``."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import arrow_rows, batch_rows, crc32_mod, give_back, slices, table, text_buffer
from tessera.operators.kept import dealt

ORDER, PER_LANG, BLOCK = 3, 2000, 8
PAD = 10  # a text begins as if after line feeds
RESULT = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())])


def padded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes with ORDER pads before each text, the place of each text byte in them, and the new bounds."""
    n = len(offsets) - 1
    bounds = offsets + ORDER * np.arange(n + 1)
    out = np.full(bounds[-1] if n else 0, PAD, np.uint8)
    place = np.arange(len(data)) + np.repeat(ORDER * np.arange(1, n + 1), np.diff(offsets))
    out[place] = data
    return out, place, bounds


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of (ORDER + 1)-byte grams by language."""
    for b in batches:
        give_back()
        langs = b.column("lang").to_pylist()
        for lang in dict.fromkeys(langs):
            texts = b.column("text").filter(pa.array([x == lang for x in langs]))
            data, place, _ = padded(*text_buffer(texts))
            gram = np.zeros(len(place), np.uint32)
            for k in range(ORDER + 1):
                gram = gram << np.uint32(8) | data[place - ORDER + k]
            kinds, n = np.unique(gram, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(kinds), pa.string()), pa.array(kinds.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])


def _at(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each of ``wanted`` in sorted ``keys``, and whether it is there."""
    at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
    return at, keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool)


class Tree:
    """The context tree of one language, from its grams of ORDER + 1 bytes (as big-endian numbers) and their counts."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        self.grams, self.counts = [], []  # by order: sorted grams of order + 1 bytes
        for k in range(ORDER + 1):
            keys, where = np.unique(grams.astype(np.int64) & ((1 << 8 * (k + 1)) - 1), return_inverse=True)
            self.grams.append(keys.astype(np.uint32))
            self.counts.append(np.bincount(where, counts, len(keys)).astype(np.int64))
        self.contexts, self.total, self.kinds = [], [], []  # by order: sorted contexts of that many bytes
        self.rest_total, self.rest_kinds = [], []  # what the next shorter context has besides the bytes seen here
        for k in range(ORDER + 1):
            contexts, where = np.unique(self.grams[k] >> 8, return_inverse=True)
            total, kinds = np.bincount(where, self.counts[k], len(contexts)), np.bincount(where, minlength=len(contexts))
            self.contexts.append(contexts.astype(np.uint32))
            self.total.append(total)
            self.kinds.append(kinds)
            if k:
                short = self.grams[k] & np.uint32((1 << 8 * k) - 1)
                at, _ = _at(self.grams[k - 1], short)
                up, _ = _at(self.contexts[k - 1], contexts & ((1 << 8 * (k - 1)) - 1))
                self.rest_total.append(self.total[k - 1][up] - np.bincount(where, self.counts[k - 1][at], len(contexts)))
                self.rest_kinds.append(self.kinds[k - 1][up] - kinds)
            else:
                self.rest_total.append(np.zeros(len(contexts)))
                self.rest_kinds.append(256 - kinds)

    def costs(self, grams: np.ndarray) -> np.ndarray:
        """Bits of the last byte of each gram after the bytes before it."""
        cost = np.zeros(len(grams))
        open_, excluded = np.arange(len(grams)), np.full(len(grams), -1)  # grams not settled; the longer context escaped from
        for k in range(ORDER, -1, -1):
            if not len(open_):
                return cost
            gram = grams[open_] & np.uint32((1 << 8 * (k + 1)) - 1)
            context, known = _at(self.contexts[k], gram >> np.uint32(8))
            if not len(self.contexts[k]):
                continue
            total = np.where(known, self.total[k][context], 0)
            kinds = np.where(known, self.kinds[k][context], 0)
            after = excluded >= 0
            if after.any():
                total[after], kinds[after] = self.rest_total[k + 1][excluded[after]], self.rest_kinds[k + 1][excluded[after]]
            at, hit = _at(self.grams[k], gram)
            hit &= total > 0
            with np.errstate(divide="ignore", invalid="ignore"):
                step = np.where(hit, self.counts[k][at], kinds) / (total + kinds)
                cost[open_] -= np.where(total > 0, np.log2(step), 0)
            excluded = np.where(known, context, -1)[~hit]
            open_ = open_[~hit]
        unseen = 256 - (self.kinds[0][0] if len(self.kinds[0]) else 0)
        cost[open_] += np.log2(max(unseen, 1))
        return cost


class Costs:
    """The costs in some languages of all grams that any of them has seen, in a hash table; of other grams, from the trees."""

    def __init__(self, trees: list[Tree]):
        self.trees = trees
        grams = np.unique(np.concatenate([t.grams[ORDER] for t in trees]))
        self.table = np.column_stack([t.costs(grams) for t in trees]).astype(np.float32)
        self.bits = max(4, int(np.ceil(np.log2(4 * max(len(grams), 1)))))
        self.key, self.row = np.zeros(1 << self.bits, np.uint32), np.full(1 << self.bits, -1, np.int32)
        rows, slot = np.arange(len(grams), dtype=np.int32), self._slot(grams)
        while len(rows):  # each free slot takes one gram, the others move on
            free = np.flatnonzero(self.row[slot] < 0)
            taken, first = np.unique(slot[free], return_index=True)
            self.row[taken], self.key[taken] = rows[free[first]], grams[rows[free[first]]]
            rest = np.ones(len(rows), bool)
            rest[free[first]] = False
            rows, slot = rows[rest], slot[rest] + 1 & (1 << self.bits) - 1

    def _slot(self, grams: np.ndarray) -> np.ndarray:
        return (grams * np.uint32(2654435769) >> np.uint32(32 - self.bits)).astype(np.int64)

    def of(self, grams: np.ndarray) -> np.ndarray:
        """grams x languages."""
        slot = self._slot(grams)
        row = self.row[slot]
        wrong = np.flatnonzero((row >= 0) & (self.key[slot] != grams))
        at = slot[wrong]
        while len(wrong):
            at = at + 1 & (1 << self.bits) - 1
            row[wrong] = self.row[at]
            more = (row[wrong] >= 0) & (self.key[at] != grams[wrong])
            wrong, at = wrong[more], at[more]
        new = row < 0
        if not new.any():
            return self.table[row]
        out = self.table[np.maximum(row, 0)] if len(self.table) else np.zeros((len(grams), len(self.trees)), np.float32)
        kinds, where = np.unique(grams[new], return_inverse=True)
        out[new] = np.column_stack([t.costs(kinds) for t in self.trees])[where]
        return out


@dataclass
class Model:
    """The languages, and the costs of blocks of them."""

    langs: list[str]
    blocks: list[Costs]

    def code_lengths(self, texts: pa.Array) -> np.ndarray:
        """Bits of each text in each language."""
        data, offsets = text_buffer(texts)
        out = np.zeros((len(offsets) - 1, len(self.langs)))
        for a, b, first, owner, lead in slices(offsets, 1 << 18, ORDER):
            sym = data[a:b].astype(np.uint32)
            begin = np.ones(len(owner), bool)
            begin[1:] = owner[1:] != owner[:-1]
            since = np.arange(len(sym)) - np.maximum.accumulate(np.where(begin, np.arange(len(sym)), 0))
            gram = sym.copy()
            for k in range(1, ORDER + 1):  # a byte before the text's first is a pad
                before = np.full(len(sym), PAD, np.uint32)
                before[k:] = np.where(since[k:] >= k, sym[:-k], PAD)
                gram |= before << np.uint32(8 * k)
            gram = gram[lead:]
            starts = np.flatnonzero(begin)  # the first byte of a piece counts as one; a piece with a lead has no other
            for i, block in enumerate(self.blocks):
                if len(gram):
                    cost = block.of(gram)
                    out[owner[starts], i * BLOCK : i * BLOCK + cost.shape[1]] += np.add.reduceat(cost, starts, axis=0, dtype=np.float64)
        return out

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        import regex

        letter = regex.compile(r"\p{L}")
        known = np.array([bool(t and letter.search(t)) for t in texts.to_pylist()], bool)
        if not self.langs:
            return ["und"] * len(known), np.zeros(len(known))
        bits = self.code_lengths(texts)
        best = bits.argmin(1)
        score = 1 / np.exp2(np.maximum(bits.min(1, keepdims=True) - bits, -1000)).sum(1)
        return [self.langs[k] if ok else "und" for k, ok in zip(best, known)], np.where(known, score, 0.0)


def build(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
    """The model of each language's counts (grams of ORDER + 1 bytes, how often)."""
    langs = sorted(counts)
    trees = [Tree(*counts[x]) for x in langs]
    return Model(langs, [Costs(trees[i : i + BLOCK]) for i in range(0, len(trees), BLOCK)])


def fit(docs: DataFrame, per_lang: int = PER_LANG) -> Model:
    """A model of ``docs`` (doc_id, text, lang)."""
    rows = docs.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    many = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row per language
    wanted = F.lit(False)
    for lang, n in many.items():
        wanted = wanted | ((F.col("lang") == lang) & (F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) < int(1_000_000 * min(1, per_lang / n))))
    with batch_rows(docs.sparkSession):
        grams = rows.where(wanted).select("lang", "text").mapInArrow(_grams, "lang string, gram long, n long")
        found = grams.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()  # the distinct grams of a bounded sample
    found = found.sort_values(["lang", "gram"])
    return build({lang: (g["gram"].to_numpy(), g["n"].to_numpy()) for lang, g in found.groupby("lang")})


def predict(spark: SparkSession, model: Model, text: str = "text") -> Column:
    """A struct (lang, score) for each text."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf(RESULT)
    def run(texts: pa.Array) -> pa.Array:
        langs, scores = shared.value.predict(texts)
        give_back()
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores)], ["lang", "score"])

    return run(F.col(text).cast("string"))


def keep_known(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The documents whose language is known with at least that score."""
    arrow_rows(docs.sparkSession)
    return docs.where(predict(docs.sparkSession, model)["score"] >= least)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; learned only where crc32(doc_id) mod 4 is not 2."""
    arrow_rows(spark)
    docs = dealt(table(spark, sf_dir, "documents"))
    model = fit(docs.where(crc32_mod("doc_id", 4) != 2))
    found = docs.select("doc_id", (crc32_mod("doc_id", 4) == 2).alias("held_out"), predict(spark, model).alias("p"))
    return found.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))
