"""Every pipeline stage and operator on odd tables: clashing names, nulls, repeats, no rows."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strandloom.llm import mixing, packing, quality_rules, suffix_dedup

CLASHES = "d e body row was_null kept_bytes size key tie slice source_size target cut_key ranges sha packed n rep comp probability kept i0 k1 text_ copies times ties".split()
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", *CLASHES]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHES)
WORDS = [a + b for a in "bdfgklmnprst" for b in ("a", "ol", "in", "er", "esto")]


def odd_rows():
    rnd = random.Random(4)
    prose = lambda n: " ".join(rnd.choice(WORDS) for _ in range(n))
    texts = [prose(rnd.randrange(25, 120)) for _ in range(30)]
    passage = prose(90)
    texts += [f"{prose(30)}\n{passage}\n{prose(30)}" for _ in range(4)] + [None, "", " \n", "é" * 250, prose(20_000)]
    rows = [(k, t, "en" if k % 3 else None, f"s{k % 3}" if k % 5 else None, len(t) if t is not None else None) for k, t in enumerate(texts)]
    rows += [rows[2], rows[2], rows[34], (2, prose(50), "en", "s1", 9), (None, prose(40), "de", "s2", 9), (None, None, None, None, None)]
    return [(*r, *(f"{c}-value" for c in CLASHES)) for r in rows]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    rows = odd_rows()
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_on_odd_and_empty_tables(spark, sf_dir, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(3)
    empty = spark.createDataFrame([], SCHEMA)
    out = stage(spark, docs, sf_dir)
    if name != "packing":
        assert out.columns == COLUMNS and out.dtypes == docs.dtypes and stage(spark, empty, sf_dir).columns == COLUMNS
        for r in out.collect():
            assert all(r[c] == f"{c}-value" for c in CLASHES)
    else:
        assert out.columns[:7] == "doc_id start length ids_crc32 doc_tokens sequence_id offset".split()
    assert stage(spark, empty, sf_dir).count() == 0


def test_suffix_stage_keeps_rows_and_cuts_passages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = suffix_dedup.stage(spark, docs, sf_dir).collect()
    before = docs.collect()
    assert Counter(r.doc_id for r in out) == Counter(r.doc_id for r in before)
    for r in out:
        was = [b for b in before if b.doc_id == r.doc_id]
        if r.doc_id in (30, 31, 32, 33):
            assert len(was[0].text) - len(r.text) > 200 and r.n_chars == len(r.text)
        elif r.doc_id == 37:
            assert r.text == ""  # it repeats within itself
        elif r.doc_id not in (2, 34, None):
            assert r.text == was[0].text and r.n_chars == was[0].n_chars
    copied = Counter(r.text for r in before if r.doc_id == 2).most_common(1)[0]
    assert copied[1] == 3 and len(copied[0].encode()) >= 200 and sum(r.doc_id == 2 and r.text == "" for r in out) == 3


def test_mixing_stage_takes_what_the_mix_takes(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    count = lambda t: len((t or "").split())
    plain = [r for r in docs.collect()]
    size = Counter()
    for r in plain:
        size[r.source] += count(r.text)
    target = {r.source: r.target for r in mixing.source_targets(docs.select("source", F.lit(0).alias("size")).limit(0).union(spark.createDataFrame(list(size.items()), "source string, size long"))).collect()}
    taken, largest = Counter(), Counter()
    out = mixing.stage(spark, docs, sf_dir).collect()
    again = mixing.stage(spark, docs.repartition(5), sf_dir).collect()
    assert Counter(out) == Counter(again)
    for r in out:
        taken[r.source] += count(r.text)
    for r in plain:
        largest[r.source] = max(largest[r.source], count(r.text))
    for s, t in target.items():
        assert abs(taken[s] - t) <= largest[s] / 2 + 1
    most = Counter(plain)
    assert all(n <= 3 * most[r] for r, n in Counter(out).items())


@pytest.mark.parametrize("times", [7, 400])
def test_mixing_cuts_among_alike_rows(spark, times):
    """One row repeated, so that every cut falls among ties, beside a small source."""
    rows = [(1, "a b c d", "s0")] * times + [(k, "a b", "s1") for k in range(2, 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    target = {r.source: r.target for r in mixing.source_targets(docs.select("source", F.when(F.col("source") == "s0", 4).otherwise(2).cast("long").alias("size"))).collect()}
    staged = Counter(r.source for r in mixing.stage(spark, docs, "").collect())
    mixed = mixing.mix(docs).collect()
    for s, size in (("s0", 4), ("s1", 2)):
        assert abs(staged[s] * size - target[s]) <= size / 2 + 1
        assert abs(sum(r.taken for r in mixed if r.size == size) - target[s]) <= size / 2 + 1


def test_quality_stage_equals_judge(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = quality_rules.fit_rules(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    kept = Counter(r.doc_id for r in quality_rules.judge(docs, model).collect() if r.kept)
    assert Counter(r.doc_id for r in quality_rules.stage(spark, docs, sf_dir).collect()) == kept


@pytest.mark.parametrize("part", [0, 1])
def test_suffix_dedup_survives_collisions_of_half_a_key(spark, monkeypatch, part):
    """Either word of a text's name and of a context's may be the same for all."""
    texts, contexts = suffix_dedup.text_keys, suffix_dedup.context_keys
    rows = [(k, f"{k} " * 60 + " ".join(f"w{j * (1 + k // 3)}" for j in range(120))) for k in range(9)] + [(20, "same " * 80), (21, "same " * 80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    want = Counter(map(tuple, suffix_dedup.cut_repeats(docs, "doc_id").collect()))
    monkeypatch.setattr(suffix_dedup, "text_keys", lambda body: tuple(F.lit(0).cast("long") if k == part else c for k, c in enumerate(texts(body))))
    monkeypatch.setattr(suffix_dedup, "context_keys", lambda body, at: tuple(0 if k == part else c for k, c in enumerate(contexts(body, at))))
    assert Counter(map(tuple, suffix_dedup.cut_repeats(docs, "doc_id").collect())) == want




def test_packing_does_not_depend_on_the_split(spark):
    """Tiny documents fill one sequence, however many tasks read them; short windows add up."""
    docs = spark.createDataFrame([(k, "a few words " * (1 + k % 3)) for k in range(16)], "doc_id long, text string")
    for parts in (1, 4, 16):
        got = packing.pack(docs.repartition(parts)).collect()
        assert len({r.sequence_id for r in got}) == 1 and sorted(r.doc_id for r in got) == list(range(16))
        at = 0
        for r in sorted(got, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length


def test_first_fit():
    rnd = random.Random(5)
    for n in (0, 1, 2, 50, 300):
        sizes, names = [rnd.randrange(1, 100) for _ in range(n)], rnd.sample(range(10_000), n)
        into, shift = packing.first_fit(sizes, names, 100)
        windows = {}
        for s, home, at in zip(sizes, into, shift, strict=True):
            windows.setdefault(home, []).append((at, at + s))
        assert set(windows) <= set(names) and all(names[k] == into[k] for k in range(n) if shift[k] == 0)
        for spans in windows.values():
            spans.sort()
            assert spans[0][0] == 0 and spans[-1][1] <= 100 and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
        assert len(windows) <= 1.3 * sum(sizes) / 100 + 1


def test_sentences_are_cut_only_where_they_are_long():
    rnd = random.Random(6)
    at, docs, sentences = 0, [], []
    for _ in range(400):
        for _ in range(rnd.randrange(1, 12)):
            at += rnd.randrange(5, 60)
            sentences.append(at)
        docs.append(at)
    positions, penalties = packing.candidate_cuts(np.array(docs), np.array(sentences))
    chosen = positions[packing.plan_cuts(positions.tolist(), penalties.tolist(), 2048)]
    assert set(chosen.tolist()) <= {0, *docs, *sentences}
    assert (len(chosen) - 1) * 2048 < 1.03 * at + 2048
