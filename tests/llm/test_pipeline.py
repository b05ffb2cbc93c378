"""The pipeline's stages against the operators they call, on the smallest tables."""

import os

import pytest

import corpus_pipeline
from tessera.llm import language, mixing, quality_model, simhash
from tessera.llm.common import crc32_mod, table

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="no test tables")


def test_stages(spark):
    docs = first = table(spark, SF, "documents")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        seen.append((name, docs.toPandas()))
        docs = stage(spark, docs, SF)
    trees = quality_model.fit_tables(spark, first, SF)
    good = first.where(quality_model.score_column(trees) >= 0.3)
    assert sorted(seen[1][1].doc_id) == sorted(r.doc_id for r in good.collect())
    langs = language.fit(good.where(crc32_mod("doc_id", 4) != 2))
    known = [r.doc_id for r in good.select("doc_id", language.predict(spark, langs).alias("p")).collect() if r.p.lang != "und" and r.p.score >= 0.5]
    assert sorted(seen[2][1].doc_id) == sorted(known)
    left = spark.createDataFrame(seen[2][1])
    assert set(seen[3][1].doc_id) == {r.component_id for r in simhash.components(left).collect()}
    mixed = mixing.mix(spark.createDataFrame(seen[3][1])).toPandas()
    counts = seen[4][1].groupby("doc_id").size()
    assert {k: v for k, v in counts.items()} == {r.doc_id: (r.taken // r.words if r.words else 1) for r in mixed.rename(columns={"size": "words"}).itertuples() if r.taken or not r.words}
    for _, frame in seen[1:]:
        assert list(frame.columns) == first.columns
    packed = docs.toPandas()
    assert packed[packed.piece == 0].shape[0] == len(seen[4][1])
    assert packed.groupby("sequence_id").length.sum().max() <= 2048


DOCS = "doc_id long, text string, lang string, source string, n_chars long, __row string, __fp string, __hash int, edge string, length string"


@pytest.mark.parametrize("empty", [False, True])
def test_stages_on_odd_rows(spark, tmp_path, empty):
    """Nulls in every column, empty and very long texts, repeated rows and ids, columns with names the stages use, no rows."""
    import random

    rng = random.Random(2)
    say = lambda n, letters="abcdefgh": " ".join("".join(rng.choices(letters, k=rng.randint(2, 6))) for _ in range(n)) + "."
    rows = [(i, say(60, "abcdefgh" if i % 2 else "stuvwxyz"), "aa" if i % 2 else "zz", f"s{i % 3}") for i in range(60)]
    rows += [(7, rows[7][1], "aa", "s1")] * 30 + [(None, rows[5][1], "aa", None)] * 10 + [(100, None, None, None), (101, "", "aa", "s0"), (102, "²", "aa", "s0"), (103, say(40_000), "aa", "s2"), (7, say(50), "aa", "s1")]
    made = [(i, t, lang, s, None if t is None else len(t), "r", "f", 1, "e", "x") for i, t, lang, s in rows]
    docs = spark.createDataFrame([] if empty else made, DOCS).repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([] if empty else [(i, 1 if i < 50 else 0, 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        docs = spark.createDataFrame(stage(spark, docs, str(tmp_path)).collect(), docs.schema)
        assert docs.columns == columns, name
        assert name == "mixing sources" or docs.count() <= before
        assert {(r["__row"], r["__fp"], r.edge) for r in docs.collect()} <= {("r", "f", "e")}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert len([r for r in packed if r.piece == 0]) == docs.count() and (empty == (not packed))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(packed)
