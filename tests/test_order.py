import hashlib
import random

from pyspark.sql import functions as F

from strandloom.functions import order
from strandloom.operators import provenance
from strandloom.sources import store
from strandloom.streaming.compaction import Compactor
from strandloom.streaming.loop import Config, Loop, RunState


def test_order_over_buckets(spark, monkeypatch):
    monkeypatch.setattr(order, "SPAN", 7)
    rnd = random.Random(4)
    rows = [(k, rnd.choice([None, 1, 2, 5]), rnd.choice(["a", "b", None])) for k in rnd.sample(range(200), 90)]
    df = spark.createDataFrame(rows, "pos long, v int, chrom string").repartition(5)
    rows.sort()
    sums = {r.pos: (r.upto, r.before) for r in order.running_sum(order.running_sum(df, "pos", F.col("v"), "upto"), "pos", F.col("v"), "before", own=False).collect()}
    last = {r.pos: r.last for r in order.carried(df, "pos", F.col("v"), "last").collect()}
    total, kept = 0, None
    for pos, v, _ in rows:
        kept = kept if v is None else v
        assert sums[pos] == (total + (v or 0), total) and last[pos] == kept
        total += v or 0
    places = {r.k: (r.chrom, r.pos) for r in order.numbered(df, {"_c": F.col("chrom"), "_p": F.floor(F.col("pos") / 10)}, ["chrom", "pos"], "k").collect()}
    assert [places[k] for k in range(90)] == sorted(((c, p) for p, _, c in rows), key=lambda x: (x[0] is not None, x[0], x[1]))
    none = spark.createDataFrame([], "pos long, v int, chrom string")
    assert order.running_sum(none, "pos", F.col("v"), "s").count() == order.carried(none, "pos", F.col("v"), "s").count() == 0


def test_content_md5_streams(spark):
    lines = spark.createDataFrame([(2, "b"), (0, "#x"), (1, "a")], "line_no long, value string")
    assert provenance.content_md5(lines).first()[0] == hashlib.md5(b"a\nb\n").hexdigest()
    assert provenance.content_md5(lines.limit(0)).first()[0] == hashlib.md5(b"").hexdigest()


def test_balanced_chunks():
    assert store.balanced_chunks([("a", 7), ("b", 5), ("c", 4), ("d", 3), ("e", 1)], 2) == [["a", "d"], ["b", "c", "e"]]


def test_store_resumes(spark, tmp_path):
    path = str(tmp_path / "stats")
    rows = lambda *r: spark.createDataFrame(list(r), "acc string, status string")
    store.save(rows(("a", "accepted"), ("b", "error")), path, 0)
    store.save(rows(("b", "rejected"), ("c", "error")), path, 1)
    store.save(rows(("b", "accepted"), ("c", "error")), path, 1)
    kept = store.load(spark, path, "acc string, status string")
    assert sorted(map(tuple, kept.collect())) == [("a", "accepted"), ("b", "accepted"), ("c", "error")]
    done, todo = store.resume(spark.createDataFrame([(x,) for x in "abcd"], "acc string"), kept)
    assert sorted(r.acc for r in done.collect()) == ["a", "b"] and sorted(r.acc for r in todo.collect()) == ["c", "d"]


def test_compaction(spark, tmp_path):
    schema, folder = "qname string, chrom string, pos0 long", str(tmp_path / "c")
    made = [(f"r{k}", f"chr{k % 2}", 100 - k) for k in range(10)]
    for n in range(5):
        Compactor(spark, folder, every=2, partitions=2).add(n, spark.createDataFrame(made[2 * n : 2 * n + 2], schema))
    c = Compactor(spark, folder, every=2)
    assert c.pending() == [4] and c._committed("merged") == [1, 3] and sorted(map(tuple, c.records().collect())) == sorted(made)
    c.records().where("qname = 'r0'").write.parquet(f"{folder}/batches/upto-1")  # as if the stop came before the delete
    assert sorted(map(tuple, c.records().collect())) == sorted(made)


def test_a_step_touches_few_of_many_runs():
    loop = Loop([RunState(f"R{k}", 100, 50.0 + k % 3, yield_=[None, 0.5][k % 2]) for k in range(50_000)], None, Config(batch_size=10))
    assert len(loop.pools) == 2
    loop.model.add({("chr1", 0): 5.0, ("chr1", 1): 1.0})
    picked = []
    for step in range(40):
        loop.estimate()
        r = loop.choose(step)
        loop.claim(r, step)
        r.used, r.bad = 1, True  # each run once
        picked.append(r.accession)
    assert len(set(picked)) == 40 and len(loop.touched) == 40 and all(int(a[1:]) % 2 == 0 for a in picked)


def test_untouched_runs_are_drawn_by_length():
    n = {"A": 0, "B": 0}
    for seed in range(600):
        loop = Loop([RunState("A", 100, 300.0), RunState("B", 100, 100.0)], None, Config(batch_size=10, seed=seed))
        loop.model.add({("chr1", 0): 5.0})
        loop.estimate()
        n[loop.choose(0).accession] += 1
    assert 400 < n["A"] < 500
