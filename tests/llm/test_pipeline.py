"""The pipeline against its stages done by brute force on a small corpus."""

import shutil

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strandloom.llm import mixing, quality_rules

from .test_llm import WORD, brute_components, brute_cut, ids_of

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("sf")
    spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 90").write.parquet(f"{d}/documents.parquet")
    shutil.copy(f"{SF}/labels.parquet", f"{d}/labels.parquet")
    return str(d)


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns
    model = quality_rules.fit_rules(docs, spark.read.parquet(f"{small}/labels.parquet"))
    want = {r.doc_id for r in quality_rules.judge(docs, model).collect() if r.kept}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.collect()
        docs = stage(spark, docs, small).persist()
        assert docs.columns == columns
        rows = docs.collect()
        if name == "quality_rules":
            assert {r.doc_id for r in rows} == want
        elif name == "near_dedup":
            _, low = brute_components([(r.doc_id, r.text) for r in before], 5)
            assert sorted(r.doc_id for r in rows) == sorted(d for d in low if low[d] == d)
        elif name == "suffix_dedup":
            cut = brute_cut([(r.text or "").encode() for r in before])
            removed = {r.doc_id: c[1] for r, c in zip(before, cut, strict=True)}
            texts = {r.doc_id: r.text for r in before}
            assert len(rows) == len(before)
            for r in rows:
                lost = len(texts[r.doc_id].encode()) - len(r.text.encode())
                assert removed[r.doc_id] <= lost <= removed[r.doc_id] + 8 * (removed[r.doc_id] > 0)
        elif name == "mixing":
            times = {r.doc_id: r.taken // max(1, r.size) for r in mixing.mix(spark.createDataFrame(before, docs.schema)).collect()}
            got = {r.doc_id: r["count"] for r in docs.groupBy("doc_id").count().collect()}
            assert got == {d: n for d, n in times.items() if n}
    left = docs.collect()
    packed = corpus_pipeline.run(spark, small).agg(F.sum("length").alias("n")).first().n
    assert packed == sum(len(ids_of(r.text)) + 1 for r in left)
    assert all(WORD.search(r.text) for r in left)
