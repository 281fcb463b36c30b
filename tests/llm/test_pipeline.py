"""The pipeline's stages against brute force, one after another."""

import data
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siltstone.llm import decontam, neardup, quality, substrings
from siltstone.llm.queries import QUERIES, SQL, held_out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("sf")
    good = [(i, data.words(i, 70) + ".") for i in range(100)]
    bad = [(i, " ".join(w.upper() + "!!" for w in data.words(i, 60).split())) for i in range(200, 240)]
    item, shared = data.words(901, 30), data.words(902, 50)
    more = [(300, good[3][1]), (301, data.edited(good[4][1], 60)), (302, f"{data.words(303, 40)} {item} {data.words(304, 20)}"), (305, f"{data.words(305, 30)} {shared}"), (306, f"{shared} {data.words(306, 30)}"), (307, ""), (308, None)]
    data.documents(spark, good + bad + more).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(d, 1, 0) for d, _ in good] + [(d, 0, 0) for d, _ in bad], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return str(root)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "substring_dedup", "decontamination", "sentencepiece"]
    for name, stage in corpus_pipeline.STAGES:
        before = sorted((r["doc_id"], r["text"]) for r in docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect())
        out = corpus_pipeline.written(stage(spark, docs, folder), f"test-{name}")
        after = sorted((r["doc_id"], r["text"]) for r in out.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect())
        if name != "sentencepiece":
            assert out.columns == corpus_pipeline.COLUMNS
        if name == "quality":
            labels = spark.read.parquet(f"{folder}/labels.parquet").where(~held_out(F.col("doc_id")))
            scores = quality.quality_scores(docs.select("doc_id", "text"), quality.fit_ranking(docs, labels))
            keep = {r["doc_id"] for r in scores.where(F.col("quality_score") >= quality.CUT).collect()}
            assert after == [x for x in before if x[0] in keep]
            assert set(range(100)) <= keep and not keep & set(range(200, 240))
        elif name == "near_dedup":
            assert after == sorted(x for x, r in zip(before, neardup.brute_force(before, 5), strict=True) if r[3])
        elif name == "substring_dedup":
            digests = {d: h for d, _, _, h in substrings.brute_force(before)}
            import hashlib

            assert all(hashlib.sha256(" ".join(t.split()).encode()).hexdigest() == digests[d] for d, t in after) and len(after) == len(before)
        elif name == "decontamination":
            items = [(1, data.words(901, 30))]
            assert len(after) == len(before) and all(n == 0 for _, n, _ in decontam.brute_force(after, items).values())
            assert all(t == dict(before)[d] for d, t in after if not decontam.brute_force([(d, dict(before)[d])], items)[d][1])
        else:
            assert after == before and all((len(r["ids"]) == r["n_tokens"]) for r in out.collect())
        docs = out


def test_pipeline_of_nothing(spark, tmp_path):
    data.empty(spark).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "one two")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = corpus_pipeline.run(spark, str(tmp_path))
    assert found.count() == 0 and set(corpus_pipeline.COLUMNS) <= set(found.columns)


def test_registry(spark):
    names = {n.split("_")[0] for n in QUERIES}
    assert names == {f"op{k}" for k in range(1, 11)} and set(SQL) <= set(QUERIES)
