"""Each training-data operator against brute force, with nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import hashlib
import io
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import html_text, language, mixing, neighbours, packing, quality_model, quality_rules, simhash, tokens, warc
from tessera.llm.common import scratch, slices, text_buffer
from tessera.llm.encoders import ChunkEncoder

tokenizers = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows, extra=False):
    df = spark.createDataFrame([(i, t, l, s, None if t is None else len(t)) for i, t, l, s in rows], DOCS)
    if extra:
        for c in ("size", "hash", "fp", "score", "length", "copies", "content", "anchor", "label", "p", "x"):
            df = df.withColumn(c, F.lit("clash"))
    return df


def words(rng, n, letters="abcdefghij"):
    return " ".join("".join(rng.choices(letters, k=rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def sample():
    rng = random.Random(7)
    rows = [(i, words(rng, rng.randint(1, 60)), "en" if i % 2 else "fr", f"s{i % 4}") for i in range(60)]
    copy = rows[3][1]
    rows += [(100 + i, copy, "en", "s0") for i in range(40)]  # a large group of copies
    rows += [(200, None, None, None), (201, "", "en", None), (202, " \n\t ", "en", "s1"), (None, "no id here", "en", "s1"), (5, rows[5][1], "en", "s1"), (203, words(rng, 30000), "en", "s2"), (204, "é ñ 漢字 😀", "fr", "s3")]
    return rows


# ---------------------------------------------------------------- 1: WARC


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, type string, path string")


def test_warc_round_trip(spark):
    rows = [(1, "http://a/1", "<p>x</p>", "t", "p"), (7, "http://a/7", "<p>x</p>", "t", "p"), (3, None, None, "t", "p"), (4, "http://a/ b", "", "t", "p"), (None, "u", "<p>x</p>", "t", "p"), (8, "u", "é" * 70000, "t", "p"), (7, "again", "<p>x</p>", "t", "p")]
    files = warc.write_archives(pages(spark, rows), scratch(spark, "t"), roll=500)
    back = warc.read_archives(files, with_payload=True).collect()
    assert {r.kind for r in back} == {"record"} and len(back) == len(rows)
    assert sorted((r.type, r.payload_bytes) for r in back) == sorted([("revisit", 8), ("response", 8), ("response", 8), ("revisit", 0), ("response", 0), ("revisit", 8), ("response", 140000)])
    assert {r.refers_to_id for r in back if r.type == "revisit"} == {"<urn:page:7>", "<urn:page:4>"}
    assert {bytes(r.payload) for r in back if r.record_id == "<urn:page:8>"} == {("é" * 70000).encode()}


def test_warc_empty_table(spark):
    assert warc.read_archives(warc.write_archives(pages(spark, []), scratch(spark, "t"))).count() == 0


@pytest.mark.parametrize("packed", [True, False])
def test_warc_salvage(packed):
    rng = random.Random(1)
    made = [warc.record(i, "http://x", bytes(rng.choices(range(97, 123), k=400)), None) for i in range(12)]
    if not packed:
        made = [zlib.decompress(x, 31) for x in made]
    starts = np.cumsum([0, *map(len, made)])
    data = bytearray(b"".join(made))
    data[starts[3] + len(made[3]) // 2] ^= 0xFF  # a flipped byte
    data[starts[6] : starts[6] + 10] = b"\0" * 10  # a lost header
    data = bytes(data[:-9]) + b""  # a file cut short
    found = list(warc.salvage(io.BytesIO(data), len(data)))
    assert sum(x.length for x in found if x.inner is None) == len(data)  # every byte is in a record or a gap
    lost = (3, 6) if packed else (3, 6, 11)  # of the last member only the trailer is cut off, and its record is whole
    assert [x.record.headers["warc-record-id"] for x in found if x.record] == [f"<urn:page:{i}>" for i in range(12) if i not in lost]
    assert [x.place for x in found if x.record is None and x.inner is None] == [starts[3], starts[6], starts[11]]
    assert all(x.reason for x in found if x.record is None)


def names(found):
    return [int(x.record.headers["warc-record-id"][10:-1]) for x in found if x.record]


def test_warc_salvage_inside_members():
    rng = random.Random(3)
    plain = [zlib.decompress(warc.record(i, "http://x", bytes(rng.choices(range(97, 123), k=700)), None), 31) for i in range(9)]
    bad = bytearray(plain[4])
    bad[-60] ^= 0xFF  # its digest differs
    whole = b"".join([*plain[:4], bytes(bad), *plain[5:]])
    packed = zlib.compressobj(6, zlib.DEFLATED, 31)
    one = packed.compress(whole) + packed.flush()
    single = warc.record(20, "http://x", b"alone", None)
    data = one + single
    found = list(warc.salvage(io.BytesIO(data), len(data)))
    assert names(found) == [0, 1, 2, 3, 5, 6, 7, 8, 20]
    gap = [x for x in found if x.record is None]
    assert [(x.place, x.inner, x.inner_length) for x in gap] == [(0, sum(map(len, plain[:4])), len(bad))] and "digest" in gap[0].reason
    assert found[-1].place == len(one) and found[-1].length == len(single)

    cut = one[: len(one) * 2 // 3] + single  # the member breaks off
    found = list(warc.salvage(io.BytesIO(cut), len(cut)))
    assert names(found)[:4] == [0, 1, 2, 3] and names(found)[-1] == 20
    assert any(x.record is None and x.inner is None and x.place == 0 and x.length == len(cut) - len(single) for x in found)

    trailer = one[:-8] + bytes(4) + one[-4:] + single  # all records sound, the member's own sum wrong
    found = list(warc.salvage(io.BytesIO(trailer), len(trailer)))
    assert names(found) == [0, 1, 2, 3, 5, 6, 7, 8, 20] and any("gzip" in (x.reason or "") for x in found)


def test_warc_large_member_in_little_memory():
    import tracemalloc

    packed = zlib.compressobj(1, zlib.DEFLATED, 31)
    plain = zlib.decompress(warc.record(1, "http://x", b"ab" * 50_000, None), 31)
    data = b"".join(packed.compress(plain) for _ in range(400)) + packed.flush()  # 40 MB unpacked
    tracemalloc.start()
    assert sum(1 for x in warc.salvage(io.BytesIO(data), len(data)) if x.record) == 400
    assert tracemalloc.get_traced_memory()[1] < 8 << 20
    tracemalloc.stop()


def test_warc_salvage_garbage():
    for data in (b"", b"nothing here", b"\x1f\x8b\x08" * 50, b"WARC/1.0\r\nContent-Length: 5\r\n\r\nab", b"WARC/1.0\r\nContent-Length: 99999999999\r\n\r\nab", zlib.compress(b"x" * 9999, wbits=31)):
        found = list(warc.salvage(io.BytesIO(data), len(data)))
        assert all(x.record is None for x in found) and sum(x.length or 0 for x in found if x.inner is None) == len(data)


# ---------------------------------------------------------------- 2: quality rules


def brute_base(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen = {}
    for i in range(len(w) - 4):
        seen.setdefault(tuple(w[i : i + 5]), []).append(i)
    covered = {j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(spark, sample):
    rng = random.Random(3)
    common = "Subscribe to our letter today please"
    rows = [(1000 + i, f"{common}\n{words(rng, 3 if i % 2 else 40)}", "en", "h1") for i in range(8)] + [(2000, "a b c d e f a b c d e g a b c d e\n\nx\nx\n # | <x>", "en", "h2")] + sample
    got = quality_rules.line_frequency(docs(spark, rows, True), max_share=0.05, max_docs=5, min_words=10, min_share=0.5).collect()
    assert len(got) == len(rows)
    want = sorted(((i if i is not None else -1), *brute_base(t)) for i, t, _, _ in rows)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    by = {r.doc_id: r for r in got}
    assert [by[1000 + i].kept for i in range(8)] == [i % 2 == 0 for i in range(8)]  # the short ones are depleted
    assert by[1000].n_line_words == 6 and not by[200].kept and by[200].base_failed
    assert quality_rules.line_frequency(docs(spark, [])).count() == 0


def test_line_limit_is_a_share_of_the_host_and_folds_white_space(spark):
    rng = random.Random(5)
    variants = ["Share this  page 1 now", "\tShare this page 2 now", " share\tTHIS page 3 now\r", "Share this page 44 now"]
    rows = [(i, f"{words(rng, 30)}\n{variants[i % 3]}" if i < 24 else words(rng, 30), "en", "big") for i in range(400)]
    rows += [(1000 + i, f"{words(rng, 30)}\n{variants[i % 3]}" if i < 24 else words(rng, 30), "en", None) for i in range(500)]
    rows += [(2000 + i, f"{words(rng, 30)}\n{variants[0]}", "en", "small") for i in range(5)]
    got = {r.doc_id: r for r in quality_rules.line_frequency(docs(spark, rows)).collect()}
    assert all(got[i].n_line_words == (5 if i < 24 else 0) for i in range(400))  # 24 of 400 are over 5 %
    assert all(got[1000 + i].n_line_words == 0 for i in range(500))  # 24 of 500 are not
    assert all(got[2000 + i].n_line_words == 0 for i in range(5))  # the floor
    assert all(r.kept for r in got.values())


# ---------------------------------------------------------------- 3: quality classifier


def test_trees_learn_and_flatten():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 5)).astype(np.float32)
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    trees = quality_model.grow(x[:2000], y[:2000])
    assert ((trees.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.95

    def walk(row):
        total = trees.base
        for f, c, v in zip(trees.feature, trees.cut, trees.value):
            k = 0
            while k < len(f):
                k = 2 * k + 1 + int(row[f[k]] > c[k])
            total += v[k - len(f)]
        return 1 / (1 + np.exp(-total))

    assert np.allclose([walk(r) for r in x[:50]], trees.score(x[:50]))
    assert np.allclose(quality_model.grow(x[:0], y[:0]).score(x[:3]), 0.5)
    assert np.allclose(quality_model.grow(x, np.ones(len(x))).score(x[:3]), 1, atol=1e-4)


def test_quality_cases(spark, sample):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(None, 1, 0), (3, None, 0), (5, 1, 0)], "doc_id long, quality int, toxic int")
    d = docs(spark, sample, True)
    trees = quality_model.fit(d, labels)
    got = d.select("doc_id", quality_model.score_column(trees).alias("s")).collect()
    assert len(got) == len(sample) and all(0 <= r.s <= 1 for r in got)
    kept = quality_model.keep_good(d, trees, 0.0)
    assert kept.columns == d.columns and kept.count() == len(sample)
    assert quality_model.fit(docs(spark, []), labels.limit(0)).score(np.zeros((1, quality_model.N_FEATURES)))[0] == 0.5


def test_statistics_do_not_depend_on_batches(monkeypatch):
    texts = pa.array(["ab, C!\n1|", None, "", "x " * 5000, "é"])
    whole = quality_model.statistics(texts)
    monkeypatch.setattr(quality_model, "slices", lambda o: slices(o, 64))
    cut = quality_model.statistics(texts)
    keep = [i for i in range(whole.shape[1])]
    assert np.allclose(whole[[0, 1, 2, 4]][:, keep], cut[[0, 1, 2, 4]][:, keep])


def test_statistics_against_brute_force_over_cuts(monkeypatch):
    rng = random.Random(8)
    texts = ["x" * 300, "", "one two\nthree  four\none two", "é" * 90 + " b", *("".join(rng.choices("ab \n,.X1é", k=rng.randint(1, 400))) for _ in range(60))]
    for most in (1 << 21, 64, 7):
        monkeypatch.setattr(quality_model, "slices", lambda o, most=most: slices(o, most))
        x = quality_model.statistics(pa.array(texts))
        for t, row in zip(texts, x):
            raw = t.encode()
            n_words = len(re.findall(rb"[^ \t\r\x0b\x0c\n]+", raw))
            lines = raw.split(b"\n")
            k = quality_model.KINDS
            assert np.allclose(row[k : k + 2], [np.log1p(len(raw)), np.log1p(n_words)], rtol=1e-5)
            assert np.isclose(row[k + 6], np.log1p(max(map(len, lines))) if raw else 0, rtol=1e-5)
            assert np.isclose(row[1], raw.count(b"\n") / max(len(raw), 1), rtol=1e-5)
            assert np.isclose(row[k + 5], (len(lines) - len(set(lines)) if raw else 0) / (raw.count(b"\n") + 1), rtol=1e-5)


def test_first_tree_takes_the_best_split():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 9, (300, 3)).astype(np.float32)
    y = ((x[:, 1] > 4) | (rng.random(300) < 0.1)).astype(float)
    trees = quality_model.grow(x, y, trees=1, depth=1, l2=1.0)
    p = y.mean()
    g, h = y - p, np.full(len(y), p * (1 - p))
    gain = {(j, c): sum(g[m].sum() ** 2 / (h[m].sum() + 1) for m in (x[:, j] <= c, x[:, j] > c)) for j in range(3) for c in range(8)}
    f, c = max(gain, key=gain.get)
    assert trees.feature[0, 0] == f and ((x[:, f] <= trees.cut[0, 0]) == (x[:, f] <= c)).all()
    for leaf, m in enumerate((x[:, f] <= c, x[:, f] > c)):
        assert np.isclose(trees.value[0, leaf], 0.2 * g[m].sum() / (h[m].sum() + 1))


def test_fit_is_the_same_on_reruns_with_repeated_ids(spark):
    rng = random.Random(9)
    rows = [(i % 40, words(rng, rng.randint(3, 40)), "en", "s") for i in range(160)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    a = quality_model.fit(docs(spark, rows).repartition(6), labels)
    b = quality_model.fit(docs(spark, rows[::-1]).repartition(3), labels)
    assert all(np.array_equal(p, q) for p, q in ((a.feature, b.feature), (a.cut, b.cut), (a.value, b.value)))


# ---------------------------------------------------------------- 4: token counts


def test_chunks_equal_the_library():
    from tokenizers import Tokenizer

    rng = random.Random(5)
    alphabet = [*" \n\t aB1'!é́Σ漢😀\x1c.,İ", "<|endoftext|>", "'ll", " ", "<|ENDOFTEXT|>", "मॣ"]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 30))) for _ in range(3000)] + ["", "İ. x", "a  b\n\n c"]
    for name, drops in (("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)):
        t, e = Tokenizer.from_file(tokenizers.path(name)), ChunkEncoder(tokenizers.path(name), drops, 500)
        want = [t.encode(x, add_special_tokens=False).ids for x in texts]
        assert e.counts(texts) == [len(w) for w in want]
        assert e.ids(texts) == [np.asarray(w, "<u4").tobytes() for w in want]


def test_digest_cache(spark, sample):
    path = tokenizers.path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    cache = tokens.open_cache(spark, scratch(spark, "cache"))
    d = docs(spark, sample, True)
    got = tokens.count_tokens(d, path, cache).collect()
    want = sorted((-1 if i is None else i, len((x or "").encode()), len(t.encode(x or "").ids)) for i, x, _, _ in sample)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want
    stored = spark.read.parquet(cache)
    assert stored.select("content").distinct().count() == len({x or "" for _, x, _, _ in sample})
    n = stored.count()
    assert n == len({x or "" for _, x, _, _ in sample})  # one encode a digest
    tokens.count_tokens(d, path, cache)
    assert spark.read.parquet(cache).count() == n  # all hits
    spark.createDataFrame([(bytes(32), "another", 9)], tokens.CACHE).write.mode("append").parquet(cache)
    assert tokens.count_tokens(docs(spark, [(1, "new text", "en", "s")]), path, cache).first().n_tokens == len(t.encode("new text").ids)
    assert tokens.count_tokens(docs(spark, []), path, cache).count() == 0


@pytest.mark.parametrize("slots", [tokens.SLOTS, 1 << 15, 8])
def test_equal_rows_are_encoded_once(spark, slots):
    path = tokenizers.path("byte_bpe_50k.json")
    rows = [(1, "the same text", "en", "s")] * 500 + [(None, "no id here", "en", "s")] * 300 + [(i, f"text number {i % 40}", "en", "s") for i in range(60)] + [(None, f"lone {i}", "en", "s") for i in range(50)]
    cache = tokens.open_cache(spark, scratch(spark, "cache"))
    spark.createDataFrame([(hashlib.sha256(b"lone 3").digest(), tokens.tokenizer_version(path), 77)], tokens.CACHE).write.mode("append").parquet(cache)
    got = tokens.count_tokens(docs(spark, rows).repartition(5), path, cache, slots=slots).collect()
    assert len(got) == len(rows) and sum(r.n_tokens == 77 for r in got) == 1  # a stored count is not made again
    assert spark.read.parquet(cache).count() == len({t for _, t, _, _ in rows})


# ---------------------------------------------------------------- 5: packing


def check_packing(got, capacity):
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= capacity
    return len(by)


def test_packing(spark, sample):
    from tokenizers import Tokenizer

    path = tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    got = packing.pack_documents(docs(spark, sample, True), path, 256).collect()
    want = []
    for i, x, _, _ in sample:
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 0]
        for k, a in enumerate(range(0, len(ids), 256)):
            part = np.asarray(ids[a : a + 256], "<u4").tobytes()
            want.append((-1 if i is None else i, k, a, len(part) // 4, zlib.crc32(part)))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    n = check_packing(got, 256)
    assert n <= -(-sum(w[3] for w in want) // 256) + 1
    assert packing.pack_documents(docs(spark, []), path, 256).count() == 0
    named = spark.createDataFrame([("a", "x y z"), ("b", None), (None, "x"), ("a", "x y z")], "doc_id string, text string")
    assert sorted((r.doc_id or "", r.length) for r in packing.pack_documents(named, path, 256).collect()) == [("", 2), ("a", 4), ("a", 4), ("b", 1)]


def test_many_empty_texts_are_packed(spark):
    rows = spark.range(5000).selectExpr("id AS doc_id", "'' AS text")
    assert check_packing(packing.pack_documents(rows, tokenizers.path("word_bpe_49k.json"), 2048).collect(), 2048) == 3


def fewest(lengths, capacity):
    """Brute force over all partitions of a few pieces."""
    best = [len(lengths)]

    def place(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + lengths[i] <= capacity and bins[k] not in bins[:k]:
                bins[k] += lengths[i]
                place(i + 1, bins)
                bins[k] -= lengths[i]
        place(i + 1, [*bins, lengths[i]])

    place(0, [])
    return best[0]


def test_bin_completion_against_brute_force():
    rng = random.Random(2)
    for _ in range(150):
        capacity = rng.choice([10, 20, 37])
        lengths = sorted((rng.randint(1, capacity) for _ in range(rng.randint(1, 12))), reverse=True)
        histogram = {n: lengths.count(n) for n in lengths}
        assert counted(packing.solve(histogram, capacity), histogram, capacity) == fewest(lengths, capacity)


def test_never_worse_than_best_fit_and_no_recursion():
    rng = random.Random(11)
    for histogram in ({1: 5000}, {2: 1500}, {1: 3000, 2047: 4}, {2: 1500, 3: 7, 2046: 1}, *({rng.randint(1, 2048): rng.randint(1, 400) for _ in range(60)} for _ in range(5))):
        made = counted(packing.solve(histogram, 2048, 20_000), histogram, 2048)
        assert packing.least(histogram, 2048) <= made <= counted(packing.best_fit(histogram, 2048), histogram, 2048)


def test_undominated_fillings_against_brute_force():
    from itertools import product

    rng = random.Random(6)
    for _ in range(60):
        capacity = rng.choice([12, 20])
        lengths = sorted(rng.sample(range(1, capacity), rng.randint(1, 5)))
        left = {n: rng.randint(1, 3) for n in lengths}
        big = capacity - rng.randint(1, capacity - 1)
        room = capacity - big
        every = [dict(zip(lengths, c)) for c in product(*(range(left[n] + 1) for n in lengths)) if sum(n * k for n, k in zip(lengths, c)) <= room]
        got, _, whole = packing.completions(left, capacity, big, room, 10**6, 10**6)
        assert whole
        key = lambda d: tuple(sorted((n, k) for n, k in d if k))
        kept = {key(f) for f in got}
        assert kept <= {key(d.items()) for d in every}
        for d in every:  # nothing that fits can be added to a kept filling
            if key(d.items()) in kept:
                waste = room - sum(n * k for n, k in d.items())
                assert not any(d[n] < left[n] and n <= waste for n in lengths)
        assert min(room - sum(n * k for n, k in d.items()) for d in every) == min(room - sum(n * k for n, k in f) for f in got)


def counted(bins, histogram, capacity):
    used = {}
    for times, own in bins:
        assert times > 0 and sum(own) <= capacity
        for n in own:
            used[n] = used.get(n, 0) + times
    assert used == histogram
    return sum(t for t, _ in bins)


@pytest.mark.parametrize("m", [1, 10, 1000])
def test_skewed_lengths_are_packed_perfectly(m):
    histogram = {n: m for n in (224, 288, 352, 736, 64, 896)} | {768: 2 * m}
    assert counted(packing.solve(histogram, 2048), histogram, 2048) == 2 * m


def test_best_fit_bound_and_branches_against_brute_force():
    rng = random.Random(4)
    for _ in range(150):
        capacity = rng.choice([10, 20, 37])
        lengths = sorted((rng.randint(1, capacity) for _ in range(rng.randint(1, 10))), reverse=True)
        histogram = {n: lengths.count(n) for n in lengths}
        rooms = []
        for n in lengths:
            fit = [r for r in rooms if r >= n]
            if fit:
                rooms.remove(min(fit))
            rooms.append((min(fit) if fit else capacity) - n)
        assert counted(packing.best_fit(histogram, capacity), histogram, capacity) == len(rooms)
        assert packing.least(histogram, capacity) <= fewest(lengths, capacity)
        worst = [(1, [n]) for n in lengths]
        assert counted(packing.branch(histogram, capacity, worst, 0), histogram, capacity) == fewest(lengths, capacity)



# ---------------------------------------------------------------- 6: language


def test_ppm_costs_are_exact():
    import math

    train = ["abra abra", "cadabra", ""]
    data, place, _ = language.padded(*text_buffer(pa.array(train)))
    gram = np.zeros(len(place), np.int64)
    for k in range(4):
        gram = gram << 8 | data[place - 3 + k]
    kinds, n = np.unique(gram, return_counts=True)
    model = language.build({"xx": (kinds, n)})

    def bits(text):
        counts = {}
        for x in train:
            b = b"\n\n\n" + x.encode()
            for i in range(3, len(b)):
                for k in range(4):
                    d = counts.setdefault(b[i - k : i], {})
                    d[b[i]] = d.get(b[i], 0) + 1
        b, total = b"\n\n\n" + text.encode(), 0.0
        for i in range(3, len(b)):
            out = set()
            for k in range(3, -1, -1):
                d = {y: m for y, m in counts.get(b[i - k : i], {}).items() if y not in out}
                if not d:
                    continue
                total_n = sum(d.values()) + len(d)
                if b[i] in d:
                    total -= math.log2(d[b[i]] / total_n)
                    break
                total -= math.log2(len(d) / total_n)
                out |= set(d)
            else:
                total += math.log2(256 - len(out))
        return total

    texts = ["abracadabra", "zebra é", "", "a", "brab rab" * 40]
    assert np.allclose(model.code_lengths(pa.array(texts))[:, 0], [bits(x) for x in texts], rtol=1e-5)


def test_many_languages_leave_no_context_out():
    rng = random.Random(12)
    counts, own = {}, {}
    for j in range(40):  # five blocks
        letters = "".join(rng.sample("abcdefghijklmnopqrstuvwxyzäöüßñéèà", 12))
        text = words(rng, 400, letters)
        data, place, _ = language.padded(*text_buffer(pa.array([text])))
        gram = sum(data[place - 3 + k].astype(np.int64) << (8 * (3 - k)) for k in range(4))
        counts[f"l{j:02d}"], own[f"l{j:02d}"] = np.unique(gram, return_counts=True), words(rng, 30, letters)
    model = language.build(counts)
    assert len(model.blocks) == 5 and model.predict(pa.array([own[x] for x in model.langs]))[0] == model.langs
    whole = model.code_lengths(pa.array([own[x] for x in model.langs]))
    for j in (0, 7, 8, 39):  # a language costs the same alone and among others
        alone = language.build({model.langs[j]: counts[model.langs[j]]})
        assert np.allclose(alone.code_lengths(pa.array([own[x] for x in model.langs]))[:, 0], whole[:, j], rtol=1e-5)


def test_language_long_texts_are_whole(monkeypatch):
    rng = random.Random(1)
    data, place, _ = language.padded(*text_buffer(pa.array([words(rng, 300)])))
    gram = sum(data[place - 3 + k].astype(np.int64) << (8 * (3 - k)) for k in range(4))
    kinds, n = np.unique(gram, return_counts=True)
    model, texts = language.build({"a": (kinds, n), "b": (kinds[:50], n[:50])}), pa.array([words(rng, 900), None, "x", words(rng, 50)])
    whole = model.code_lengths(texts)
    monkeypatch.setattr(language, "slices", lambda o, most, lead: slices(o, 97, lead))
    assert np.allclose(whole, model.code_lengths(texts), rtol=1e-6)


def test_language_cases(spark, sample):
    rng = random.Random(4)
    rows = [(300 + i, words(rng, 40, "abcde"), "aa", "s") for i in range(20)] + [(400 + i, words(rng, 40, "uvwxyz"), "zz", "s") for i in range(20)] + [(500, "123 !!", "aa", "s"), (501, None, "aa", "s"), (502, "²", "aa", "s"), (503, "abab", None, "s")]
    d = docs(spark, rows, True)
    model = language.fit(d)
    got = {r.doc_id: r.p for r in d.select("doc_id", language.predict(spark, model).alias("p")).collect()}
    assert all(got[300 + i].lang == "aa" and got[400 + i].lang == "zz" for i in range(20))
    assert [got[i].lang for i in (500, 501, 502)] == ["und"] * 3 and got[503].lang == "aa"
    assert all(0 <= p.score <= 1 for p in got.values())
    kept = language.keep_known(d, model)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == set(got) - {500, 501, 502}
    nothing = language.fit(docs(spark, []))
    assert d.select(language.predict(spark, nothing).alias("p")).first().p.lang == "und"


# ---------------------------------------------------------------- 7: neighbours


def test_neighbours_recall_and_cases(spark):
    rng = np.random.default_rng(3)
    vectors = [(i, rng.normal(size=8).tolist()) for i in range(1500)] + [(2000 + i, [1.0] * 8) for i in range(300)]
    vectors += [(5001, None), (5002, [0.0] * 8), (5003, [float("nan")] * 8), (5004, [1.0] * 7), (None, [1.0] * 8), (5005, [None] + [1.0] * 7), (5100, [1.0] * 8)]
    df = spark.createDataFrame([(i, v, 1, "c") for i, v in vectors], "vec_id long, embedding array<float>, label int, score string")
    got = neighbours.nearest(df, F.col("vec_id") % 100 == 0, leaf_rows=128).collect()
    sound = [(i, np.asarray(v, np.float32).astype(float)) for i, v in vectors if i is not None and v is not None and len(v) == 8 and None not in v and np.isfinite(v).all() and any(v)]
    ids, m = np.array([i for i, _ in sound]), np.array([v for _, v in sound])
    hit = total = 0
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((m - m[ids == q][0]) ** 2).sum(1))
        d[ids == q] = np.inf
        o = np.lexsort((ids, d))[:10]
        own = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [r for r, _, _ in own] == list(range(1, 11))
        assert own == sorted(own, key=lambda r: (r[2], r[1]))
        assert all(abs(s - d[ids == v][0]) < 1e-12 for _, v, s in own)
        hit, total = hit + len(set(ids[o]) & {v for _, v, _ in own}), total + 10
        if q >= 2000:
            assert [v for _, v, _ in own] == ids[o].tolist()  # ties go to the smaller id
    assert hit / total >= 0.9
    assert neighbours.nearest(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    assert neighbours.nearest(df.where("vec_id in (0, 1, 2)"), F.col("vec_id") % 100 == 0).count() == 2


def test_neighbours_repeated_rows_and_other_lengths(spark):
    rng = np.random.default_rng(5)
    base = [(i, rng.normal(size=6).tolist()) for i in range(1, 60)]
    rows = [(100, [0.1] * 6), (100, [5.0] * 6), (200, [0.2] * 6), (200, [0.2] * 6), *base, (300, [1.0, 2.0]), (301, [1.0, 2.5]), (302, [9.0, 2.5]), (400, [7.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.nearest(df, F.col("vec_id") % 100 == 0, sure=0.999999).collect()
    want = []
    for q, v in [r for r in rows if r[0] % 100 == 0]:
        near = sorted((float(np.sqrt(((np.array(v) - np.array(w)) ** 2).sum())), i) for i, w in rows if i != q and len(w) == len(v))[:10]
        want += [(q, k + 1, i, round(d, 9)) for k, (d, i) in enumerate(near)]
    assert sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in got) == sorted(want)


@pytest.mark.parametrize("leaf_rows", [8192, 512])
def test_neighbours_verify_few_vectors_where_they_cluster(spark, leaf_rows):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(60, 32))
    m = (centres[rng.integers(0, 60, 6000)] + 0.3 * rng.normal(size=(6000, 32))).astype(np.float32).astype(float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<float>")
    found = neighbours.searched(df, F.col("vec_id") % 100 == 0, leaf_rows=leaf_rows).cache()
    assert neighbours.verified_share(found, len(m)) < 0.15
    got = {}
    for r in found.where("vec_id is not null").withColumn("r", F.row_number().over(neighbours.best())).where("r <= 10").collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hit = 0
    for q in range(0, 6000, 100):
        d = ((m - m[q]) ** 2).sum(1)
        d[q] = np.inf
        hit += len(got[q] & set(np.argsort(d, kind="stable")[:10].tolist()))
    assert hit / 600 >= 0.9


def test_chi_square():
    assert abs(neighbours.chi_square(15.507, 8) - 0.95) < 1e-4 and abs(neighbours.chi_square(neighbours.reach(0.9)) - 0.9) < 1e-9


def test_walk_is_in_order_of_projected_distance():
    rng = np.random.default_rng(3)
    points, q = rng.normal(size=(700, 4)), rng.normal(size=4)
    given = list(neighbours.Tree(points).walk(q))
    far, rows = np.concatenate([f for f, _ in given]), np.concatenate([r for _, r in given])
    assert sorted(rows.tolist()) == list(range(700)) and (np.diff(far) >= 0).all() and np.allclose(far, ((points[rows] - q) ** 2).sum(1))


# ---------------------------------------------------------------- 8: HTML

PROSE = "The first thing to say, and it is said, is this: a text goes on. It has commas, stops, and more than a few words."


def page_of(main, before="", after=""):
    return f"<html><head><title>T</title><style>p{{}}</style><script>var t='</p>';</script></head><body><header><h1>Site</h1></header><nav><ul><li><a href=/a>Home</a></li></ul></nav><!-- ad -->{before}{main}{after}<aside><p>Side, text. Here.</p></aside><form><input name=q><button>Go</button></form><footer>&copy; x</footer></body></html>"


@pytest.mark.parametrize("tag", ["article", "main", "div", "section", "td"])
def test_html_main_text(tag):
    main = f"<{tag}><h1>The title, and more.</h1><p><b>{PROSE}<br>more<p>Second &amp; last &lt;b&gt;, it is. {PROSE}</p><p>Short</p><ul><li>One, thing. {PROSE}</li></ul><p>{PROSE}</p></{tag}>"
    main = f"<table><tr>{main}</tr></table>" if tag == "td" else main
    want = ["The title, and more.", f"{PROSE} more", f"Second & last <b>, it is. {PROSE}", "Short", f"One, thing. {PROSE}", PROSE]
    assert html_text.main_text(page_of(main, "<div class=ad>Buy, now! Cheap.</div>", "<div class=x><p>We use cookies.</p></div>")) == "\n\n".join(want)


def test_html_ratio_decides():
    """A block as long as the article but without its punctuation, or within links, is not content; by text length alone it would be."""
    tags = " ".join(f"tag{i}" for i in range(60))
    links = "".join(f"<a href=/{i}>linked words, number {i}.</a> " for i in range(20))
    page = page_of(f"<div class=a><h2>Head, line.</h2><p>{PROSE}</p><p>{PROSE}</p></div>", f"<div class=cloud>{tags}</div>", f"<div class=more>{links}</div>")
    want = "\n\n".join(["Head, line.", PROSE, PROSE])
    assert html_text.main_text(page) == want
    fuse = html_text.fuse
    try:
        html_text.fuse = lambda chars, marks, nodes, linked: chars
        assert "tag7" in html_text.main_text(page)
    finally:
        html_text.fuse = fuse


def brute_ratios(page):
    """Every path by its labels, every sum and mean by a walk over all blocks."""
    found, paths = html_text.blocks(page)

    def chain(p):
        out = []
        while p:
            out.append(paths.label[p])
            p = paths.parent[p]
        return tuple(reversed(out))

    def fused(texts):
        chars = sum(len(t) for t, _ in texts)
        return chars * (html_text.FLOOR + sum(len(html_text.PUNCTUATION.findall(t)) * (1 - k / len(t)) for t, k in texts) / len(texts)) * (1 - sum(k for _, k in texts) / chars)

    rows = [(chain(p), t, k) for t, p, k in found]
    out = {}
    for path in {c for c, _, _ in rows}:
        levels = [[(t, k) for c, t, k in rows if c == path], [(t, k) for c, t, k in rows if c[:-1] == path[:-1]]]
        if len(path) > 1:
            levels.append([(t, k) for c, t, k in rows if c[:-1] == path[:-2]])
        parts = [(w, fused(x)) for w, x in zip(html_text.WEIGHTS, levels) if x]
        out[path] = sum(w * f for w, f in parts) / sum(w for w, _ in parts)
    return {c: out[c] for c, _, _ in rows}, rows


def test_html_ratios_against_brute_force():
    rng = random.Random(4)
    for _ in range(80):
        tags = ["div", "p", "ul", "li", "section", "h2", "blockquote", "a", "b", "div class=x", "div class=y", "td", "table"]
        page = "".join(rng.choice([f"<{rng.choice(tags)}>", f"</{rng.choice(tags).split()[0]}>", PROSE[: rng.randint(1, 80)], " word. ", "x, "]) for _ in range(rng.randint(1, 120)))
        ratios, rows = brute_ratios(page)
        threshold = np.std(list(ratios.values())) if ratios else 0
        if any(abs(r - threshold) < 1e-9 for r in ratios.values()):
            continue
        assert html_text.main_text(page) == "\n\n".join(t for c, t, _ in rows if ratios[c] >= threshold)


@pytest.mark.parametrize("page", ["<svg>" * 200_000, "<div>x" * 170_000, "<ul><li><ul>" + "<div>" * 60_000 + "<li></li>" * 60_000, "<p>x" * 250_000, "<b>" * 150_000 + "</i>" * 150_000, "<table><tr><td>x" * 60_000])
def test_html_time_is_linear(page):
    import time

    began = time.process_time()
    html_text.main_text(page)
    assert time.process_time() - began < 6  # quadratic work would take minutes


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.01"), reason="no test tables")
def test_html_quality_without_article_elements():
    import pyarrow.parquet as pq

    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet")["html"].to_pylist()
    right = kept = wanted = given = 0
    for p in pages:
        body = re.search(r"<article>(.*)</article>", p, re.S)[1]
        want = [x for x, _, _ in html_text.blocks(f"<div>{body}</div>")[0]]
        got = html_text.main_text(re.sub(r"(</?)article", r"\1div", p)).split("\n\n")
        right += got == want
        kept += sum(len(x) for x in want if x in got)
        wanted, given = wanted + sum(map(len, want)), given + sum(map(len, got))
    assert right / len(pages) > 0.93 and kept / wanted > 0.995 and kept / given > 0.99


def test_html_without_article():
    page = '<body><div id=menu><a href=x>Home</a> <a href=y>About</a></div><div class=wrap><div class=text><h2>Head, line.</h2><p>One, two, three. Four, five. Six and seven. Eight, nine.</p><p>Six, seven; eight. Nine. Ten and more, and more, of it.</p></div><div class="sidebar"><p>Other.</p></div></div><div>© 2020</div></body>'
    assert html_text.main_text(page) == "Head, line.\n\nOne, two, three. Four, five. Six and seven. Eight, nine.\n\nSix, seven; eight. Nine. Ten and more, and more, of it."


@pytest.mark.parametrize("page", [None, "", "   ", "<", "<p", "<!--", "<script>x", "<a href='", "</p></div>", "<p>" * 3000, "<div>" * 2000 + "x", "<x y=\"" * 2000])
def test_html_odd_pages(page):
    assert isinstance(html_text.main_text(page), str)


def test_html_table(spark):
    df = spark.createDataFrame([(1, "u", page_of(f"<p>{PROSE}</p>"), "c"), (2, None, None, "c"), (None, "u", "<p>Plain, text.</p>", "c"), (4, "u", "<p>" + "word, " * 50000 + "</p>", "c")], "page_id long, url string, html string, text string")
    got = {r.page_id: r.text for r in html_text.extract(df).collect()}
    assert got[2] == "" and got[None] == "Plain, text." and len(got[4]) == 300000 - 1
    assert html_text.extract(df.limit(0)).count() == 0


# ---------------------------------------------------------------- 9: mixing


def brute_mix(rows):
    import hashlib

    size = lambda x: len(re.findall(r"[^\x20\x09-\x0D]+", x or ""))
    names = sorted({s for *_, s in rows}, key=lambda s: (s is None, s or ""))
    sums = {s: sum(size(x) for _, x, _, q in rows if q == s) for s in names}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, free, left = {}, list(names), sum(sums.values())
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total >= 3 * sums[s]]
        if not over:
            target |= {s: left * weight[s] / total for s in free}
            break
        for s in over:
            target[s] = 3.0 * sums[s]
        left -= sum(3 * sums[s] for s in over)
        free = [s for s in free if s not in over]
    out = []
    for s in names:
        own = {}
        for i, x, _, q in rows:
            if q == s:
                h = int(hashlib.md5(f"{'' if i is None else i}|{x or ''}".encode()).hexdigest()[:15], 16)
                own.setdefault(h, []).append((i, size(x)))
        copies = int(target[s] // sums[s]) if sums[s] else 0
        budget, done = target[s] - copies * sums[s], 0
        for h in sorted(own):
            n, among = sum(k for _, k in own[h]), len(own[h])
            more = among if done + n <= budget or not n else max(0, min(among, int((budget - done) * among / n + 0.5)))
            done += n
            out += [(-1 if i is None else i, k, sums[s], round(target[s], 6), k * (copies + (j < more)) if sums[s] else 0) for j, (i, k) in enumerate(own[h])]
    return sorted(out)


def test_mixing(spark, sample):
    got = mixing.mix(docs(spark, sample, True)).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in got) == brute_mix(sample)
    assert all(r.taken <= 3 * r["size"] for r in got)
    assert mixing.mix(docs(spark, [])).count() == 0
    assert [r.taken for r in mixing.mix(docs(spark, [(1, None, None, None), (2, "", None, "s")])).collect()] == [0, 0]


def test_mixing_equal_rows_come_near_their_target(spark):
    rows = [(1, "ten words are here and all of them are equal", "en", "a")] * 1000 + [(None, "one two three", "en", "b")] * 700 + [(i, "a b c d", "en", "c") for i in range(300)]
    d = docs(spark, rows).repartition(7)
    got = mixing.mix(d).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in got) == brute_mix(rows)
    for s in ("a", "b", "c"):
        own = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 10
    clash = d.withColumn("__source", F.lit("x")).withColumn("mix_hash", F.lit("y")).withColumn("p_below", F.lit("z")).withColumn("Mix_Times", F.lit(1))
    mixed = mixing.apply_mix(clash)
    assert mixed.columns == clash.columns and {(r["__source"], r.mix_hash, r.p_below) for r in mixed.select("__source", "mix_hash", "p_below").distinct().collect()} == {("x", "y", "z")}
    n = {r.source: r.n for r in mixed.groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert n == {s: sum(r.taken // r["size"] for r in got if r.source == s) for s in ("a", "b", "c")}


def test_apply_mix_repeats_rows(spark, sample):
    d = docs(spark, sample, True)
    mixed = mixing.apply_mix(d)
    assert mixed.columns == d.columns
    taken = {}
    for r in mixing.mix(d).collect():
        taken[r.doc_id] = max(taken.get(r.doc_id, 0), r.taken // r["size"] if r["size"] else 1)
    n = {r.doc_id: r.n for r in mixed.where("doc_id != 5").groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert n == {k: v for k, v in taken.items() if v and k not in (None, 5)}


# ---------------------------------------------------------------- 10: SimHash


def brute_print(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    s = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] * bool(w)
    h = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in s]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def brute_components(prints):
    label = list(range(len(prints)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i][1] ^ prints[j][1]).count("1") <= 4:
                label[root(i)] = root(j)
    least = {}
    for k, (i, _) in enumerate(prints):
        if i is not None:
            least[root(k)] = min(least.get(root(k), 1 << 62), i)
    return [least.get(root(k)) for k in range(len(prints))]


def test_simhash(spark, sample):
    rows = [*sample, (600, "Ünïcode A B c d E", "en", "s"), (601, None, None, None)]
    got = simhash.components(docs(spark, rows, True)).collect()
    prints = [(i, brute_print(t)) for i, t, _, _ in rows]
    key = lambda r: (-1 if r[0] is None else r[0], r[1], -1 if r[2] is None else r[2])
    assert sorted(key((r.doc_id, r.fp % 2**64, r.component_id)) for r in got) == sorted(key((i, p, c)) for (i, p), c in zip(prints, brute_components(prints)))
    assert simhash.components(docs(spark, [])).count() == 0


def test_links_lose_no_component(spark):
    rng = random.Random(9)
    fps = []
    for _ in range(40):
        base = rng.getrandbits(64)
        fps.append(base)
        for _ in range(rng.randint(0, 12)):
            for b in rng.sample(range(64), rng.randint(1, 5)):
                base ^= 1 << b
            fps.append(base)
    fps = list(dict.fromkeys(fps))
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    want = brute_components(list(enumerate(fps)))
    for block in (simhash.BLOCK, 2):  # with blocks of two, most anchors are cut up
        found = simhash.connected(simhash.links(df, block=block)).collect()
        label = {r.node % 2**64: r.label % 2**64 for r in found}
        groups = {}
        for f, w in zip(fps, want):
            groups.setdefault(w, set()).add(label.get(f, f))
        assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_anchors_cover():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**63, 500, dtype=np.uint64)
    y = x.copy()
    for i in range(500):
        for b in rng.choice(64, 4, replace=False):
            y[i] ^= np.uint64(1) << np.uint64(b)
    assert all(set(a) & set(b) for a, b in zip(simhash.anchors(x), simhash.anchors(y)))


def test_keep_one(spark, sample):
    d = docs(spark, [*sample, (5, sample[5][1], "en", "s1")], True)
    d = d.withColumn("__row", F.lit("mine")).withColumn("__FP", F.lit("mine")).withColumn("__kept", F.lit(3)).withColumn("row", F.lit(4))
    kept = simhash.keep_one(d)
    assert kept.columns == d.columns and [tuple(r) for r in kept.select("__row", "__FP", "__kept", "row").distinct().collect()] == [("mine", "mine", 3, 4)]
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids))
    assert set(ids) == {r.component_id for r in simhash.components(d).collect()}


# ---------------------------------------------------------------- what they share


def test_shared_folder_and_batches(spark):
    from types import SimpleNamespace

    from tessera.llm import common

    cluster = SimpleNamespace(sparkContext=SimpleNamespace(master="spark://host:7077", getConf=lambda: SimpleNamespace(get=lambda k, d: None)))
    with pytest.raises(ValueError):
        common.shared_root(cluster)
    asked = SimpleNamespace(sparkContext=SimpleNamespace(master="spark://host:7077", getConf=lambda: SimpleNamespace(get=lambda k, d: "hdfs://x/y/")))
    assert common.shared_root(asked) == "hdfs://x/y"
    before = spark.conf.get(common.BATCH)
    with pytest.raises(KeyError), common.batch_rows(spark, 7):
        assert spark.conf.get(common.BATCH) == "7"
        raise KeyError
    assert spark.conf.get(common.BATCH) == before
    with common.batch_rows(spark, 3):
        common.arrow_rows(spark)
        assert spark.conf.get(common.BATCH) == "3"  # a session that allows fewer keeps its setting
    assert common.fresh(spark.createDataFrame([], "A int, _b int"), "a", "b", "_b", "c") == ["_a", "b", "__b", "c"]
