"""What operators leave behind while and after they run."""

import corpus_pipeline
from strandloom.llm import common, near_dedup, packing, suffix_dedup
from strandloom.llm.common import table
from strandloom.llm.wordcode import encoder, tokenizer_path

DATA = "/root/testdata/sf0.001"


def test_suffix_dedup_writes_few_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_dir", lambda _: str(tmp_path))
    assert suffix_dedup.cut_repeats(table(spark, DATA, "documents").repartition(8), "doc_id").count() > 0
    assert not list(tmp_path.glob("strandloom/*anchors*"))
    assert all(len(list(x.glob("part-*"))) <= 1 for x in tmp_path.glob("strandloom/*"))
    assert spark.sparkContext._jsc.getPersistentRDDs().isEmpty()


def test_suffix_dedup_holds_no_shuffle_behind_its_blocks(spark, tmp_path, monkeypatch):
    held, wrote, on_disk, durable = [], [], suffix_dedup.on_disk, suffix_dedup.durable
    monkeypatch.setattr(common, "shared_dir", lambda _: str(tmp_path))
    monkeypatch.setattr(suffix_dedup, "on_disk", lambda df: held.append(df._jdf.queryExecution().sparkPlan().toString()) or on_disk(df))
    monkeypatch.setattr(suffix_dedup, "durable", lambda df, what, *a: wrote.append(what) or durable(df, what, *a))
    docs = table(spark, DATA, "documents")
    cut = suffix_dedup.cut_repeats(docs.unionByName(docs), "doc_id")
    assert held and not any(x in plan for plan in held for x in ("Join", "Aggregate"))
    assert wrote.count("twice") == wrote.count("rows") == 1
    assert not list(tmp_path.glob("strandloom/twice*")) + list(tmp_path.glob("strandloom/rows*"))
    assert cut.agg({"n_removed": "sum"}).first()[0] > 0


def test_a_packing_task_empties_the_memo(spark):
    def words(batches):
        for _ in batches:
            pass
        import pyarrow as pa

        yield pa.RecordBatch.from_arrays([pa.array([len(encoder(path)._numbers)], pa.int64())], names=["n"])

    path = tokenizer_path()
    assert packing.stage(spark, table(spark, DATA, "documents").coalesce(1), DATA).count() > 0
    held = spark.range(8, numPartitions=8).mapInArrow(words, "n long").collect()
    assert {r.n for r in held} == {0}


def test_forgotten_words_are_learned_again():
    coder = encoder(tokenizer_path())
    first = coder.encode(b"Some words, and some again. Done.")
    coder.forget()
    again = coder.encode(b"Some words, and some again. Done.")
    assert len(first[0]) and first[0].tolist() == again[0].tolist() and first[1].tolist() == again[1].tolist()


def test_near_dedup_leaves_only_what_its_result_reads(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_dir", lambda _: str(tmp_path))
    docs = table(spark, DATA, "documents")
    out = near_dedup.stage(spark, docs, DATA)
    left = [x.name.split("-")[0] for x in tmp_path.glob("strandloom/*")]
    assert left == ["kept"]
    kept = near_dedup.near_duplicates(docs, near_dedup.SHINGLE_WORDS).where("kept").select("doc_id")
    assert sorted(r.doc_id for r in out.select("doc_id").collect()) == sorted(r.doc_id for r in kept.collect())


def test_the_pipeline_leaves_only_what_its_last_stage_reads(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_dir", lambda _: str(tmp_path))
    assert corpus_pipeline.run(spark, DATA).count() > 0
    assert sorted(x.name.split("-")[0] for x in tmp_path.glob("strandloom/*")) == ["mixing", "pieces"]
