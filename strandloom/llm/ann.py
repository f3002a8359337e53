"""Approximate nearest neighbours by largest inner product: sharded robust-pruned graphs.

Equal vectors form a class; only classes are indexed, so copies cost nothing and lose
nothing.  Classes are dealt to shards by norm, in ranges of a factor ``NORMS``, and in a range by
hash: inside a shard the largest inner products are then nearly the nearest directions, which a
graph finds, and no long vector hides the others.  Each shard builds a directed graph: vectors
are inserted in growing batches, a greedy beam search from the entry point proposes
neighbours, and relaxed pruning keeps a neighbour only if no kept one is closer to it by the
factor ``ALPHA``.  One more coordinate turns inner products into distances for building.
A beam search queries every shard; the candidates are scored in double precision, merged,
and spread over the members of their classes.

Shards hold up to about ``SHARD_ROOT * sqrt(n)`` classes, ``LEAST_SHARD`` at least, so that the work of
searching all shards grows as n to the power 1.5 and a shard still fits a worker.  A row for
the search holds one shard's graph and one block of ``BLOCK`` query vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import durable, shuffle_width, table

NEIGHBOURS = 20
EVERY = 20
DEGREE, SLACK, BUILD_BEAM, SEARCH_BEAM, ALPHA = 32, 56, 56, 96, 1.2
LEAST_SHARD, SHARD_ROOT, BLOCK, FIRST, BATCH = 8192, 32, 1024, 256, 1024
NORMS = 1.1


def beam_search(vectors: np.ndarray, links: np.ndarray, entry: int, queries: np.ndarray, beam: int, product: bool) -> tuple[np.ndarray, np.ndarray]:
    """Ids and keys (smaller is nearer) of the ``beam`` nearest nodes that greedy search finds
    for each query, all queries a step at a time.  Missing places hold id -1 and key inf."""
    b, n = len(queries), len(vectors)
    ids, keys, done = np.full((b, beam), -1), np.full((b, beam), np.inf, np.float32), np.ones((b, beam), bool)
    seen = np.zeros((b, n + 1), bool)  # the last column stands for id -1
    seen[:, n] = True
    norms = None if product else (vectors * vectors).sum(1)

    def distances(rows: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        dots = np.matmul(vectors[nodes], queries[rows][:, :, None])[:, :, 0]
        return -dots if product else norms[nodes] - 2 * dots

    rows = np.arange(b)
    ids[:, 0], keys[:, :1], done[:, 0], seen[:, entry] = entry, distances(rows, np.full((b, 1), entry)), False, True
    while len(rows):
        place = done[rows].argmin(1)
        more = ~done[rows, place]
        rows, place = rows[more], place[more]
        if not len(rows):
            break
        done[rows, place] = True
        near = links[ids[rows, place]]
        fresh = ~seen[rows[:, None], near]
        seen[rows[:, None], near] = True
        key = np.where(fresh, distances(rows, np.where(fresh, near, 0)), np.inf).astype(np.float32)
        all_keys = np.concatenate([keys[rows], key], 1)
        order = np.argpartition(all_keys, beam - 1, 1)[:, :beam]
        order = np.take_along_axis(order, np.take_along_axis(all_keys, order, 1).argsort(1, kind="stable"), 1)
        keys[rows] = np.take_along_axis(all_keys, order, 1)
        ids[rows] = np.take_along_axis(np.concatenate([ids[rows], np.where(fresh, near, -1)], 1), order, 1)
        done[rows] = np.take_along_axis(np.concatenate([done[rows], ~fresh], 1), order, 1) | np.isinf(keys[rows])
    return np.where(np.isinf(keys), -1, ids), keys


def robust_prune(vectors: np.ndarray, nodes: np.ndarray, candidates: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """For each node the kept candidates (at most ``degree``, padded by -1)."""
    out = np.full((len(nodes), degree), -1)
    for a in range(0, len(nodes), 512):
        c, p = np.sort(candidates[a : a + 512], 1), nodes[a : a + 512]
        alive = (c >= 0) & (c != p[:, None])
        alive[:, 1:] &= c[:, 1:] != c[:, :-1]
        x = vectors[c]
        squares = (x * x).sum(2)
        far = ((x - vectors[p][:, None]) ** 2).sum(2)
        order = np.where(alive, far, np.inf).argsort(1, kind="stable")
        c, far, alive, x, squares = (np.take_along_axis(m, order if m.ndim == 2 else order[:, :, None], 1) for m in (c, far, alive, x, squares))
        between = squares[:, :, None] + squares[:, None] - 2 * np.matmul(x, x.transpose(0, 2, 1))
        rows = np.arange(len(p))
        for k in range(degree):
            first = alive.argmax(1)
            any_left = alive[rows, first]
            if not any_left.any():
                break
            out[a + rows[any_left], k] = c[rows, first][any_left]
            alive[rows, first] = False
            alive &= ~(alpha * alpha * between[rows, first] <= far)
    return out


def build_graph(vectors: np.ndarray) -> tuple[np.ndarray, int]:
    """Links (n x width, padded by -1) and entry point of the graph of distinct vectors."""
    n = len(vectors)
    squares = (vectors.astype(np.float64) ** 2).sum(1)
    x = np.concatenate([vectors, np.sqrt(np.maximum(0, squares.max() - squares))[:, None].astype(np.float32)], 1)
    links, used = np.full((n, SLACK), -1), np.zeros(n, np.int64)

    def put(nodes: np.ndarray, kept: np.ndarray) -> None:
        links[nodes] = -1
        links[nodes, : kept.shape[1]] = kept
        used[nodes] = (kept >= 0).sum(1)

    def insert(nodes: np.ndarray, candidates: np.ndarray) -> None:
        kept = robust_prune(x, nodes, candidates)
        put(nodes, kept)
        target, source = kept[kept >= 0], np.repeat(nodes, (kept >= 0).sum(1))
        order = np.argsort(target, kind="stable")
        target, source = target[order], source[order]
        heads, starts, counts = np.unique(target, return_index=True, return_counts=True)
        room = used[heads] + counts <= SLACK
        fits = np.repeat(room, counts)
        slot = np.arange(len(target)) - np.repeat(starts, counts) + np.repeat(used[heads], counts)
        links[target[fits], slot[fits]] = source[fits]
        used[heads[room]] += counts[room]
        full = np.flatnonzero(~room)
        if len(full):
            wide = np.full((len(full), SLACK + int(counts[full].max())), -1)
            wide[:, :SLACK] = links[heads[full]]
            for k, f in enumerate(full):
                wide[k, SLACK : SLACK + counts[f]] = source[starts[f] : starts[f] + counts[f]]
            put(heads[full], robust_prune(x, heads[full], wide))

    center = x.mean(0)
    entry = int(((x - center) ** 2).sum(1).argmin())
    order = np.random.default_rng(7).permutation(n)
    order = np.concatenate([[entry], order[order != entry]])
    first = order[:FIRST]
    insert(first, np.tile(first, (len(first), 1)))
    at = len(first)
    while at < n:
        nodes = order[at : at + min(BATCH, at)]
        found, _ = beam_search(x, links, entry, x[nodes], BUILD_BEAM, False)
        insert(nodes, found)
        at += len(nodes)
    over = np.flatnonzero(used > DEGREE)
    put(over, robust_prune(x, over, links[over]))
    links.sort(1)
    links[:, 1:][links[:, 1:] == links[:, :-1]] = -1  # links in both directions may have met
    links[:] = -np.sort(-links, 1)
    used[:] = (links >= 0).sum(1)
    _reach_all(x, links, used, entry)
    return links[:, : max(1, int(used.max()))].astype(np.int32), entry


def _reach_all(x: np.ndarray, links: np.ndarray, used: np.ndarray, entry: int) -> None:
    """Link every node that no path leads to from a near reachable node with room."""
    reached = np.zeros(len(x), bool)
    wave = np.array([entry])
    while True:
        while len(wave):
            reached[wave] = True
            wave = np.unique(links[wave])
            wave = wave[wave >= 0]
            wave = wave[~reached[wave]]
        lost = np.flatnonzero(~reached)
        if not len(lost):
            return
        room = np.flatnonzero(reached & (used < DEGREE + 8))
        near = room[((x[room] - x[lost[0]]) ** 2).sum(1).argmin()]
        links[near, used[near]] = lost[0]
        used[near] += 1
        wave = lost[:1]


def usable(embeddings: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, e): one row for each id whose vector has only finite components, not all zero,
    and the most common length.  Of several vectors of one id the smallest counts."""
    e = F.col("e")
    v = embeddings.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<float>").alias("e")).where(F.col("vec_id").isNotNull() & e.isNotNull() & (F.size(e) > 0))
    bad = F.exists(e, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    v = v.where(~bad & F.exists(e, lambda c: c != 0)).groupBy("vec_id").agg(F.min("e").alias("e"))
    return v


def nearest(embeddings: DataFrame, k: int = NEIGHBOURS, every: int = EVERY) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` nearest found of each query.

    Queries are the usable vectors whose id is divisible by ``every``.  Nulls, zeros and
    non-finite vectors take no part; equal scores rank by id; repeated rows count once; fewer
    than k candidates give all of them; an empty table gives no rows.
    """
    spark = embeddings.sparkSession
    v = durable(usable(embeddings), "vectors")
    size = v.groupBy(F.size("e").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if size is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = size[0]
    v = v.where(F.size("e") == dim)
    classes = durable(v.groupBy("e").agg(F.min("vec_id").alias("rep")), "classes")
    member = durable(v.join(classes, "e").select("rep", "vec_id"), "members")
    n = classes.count()
    norm = F.sqrt(F.aggregate("e", F.lit(0.0), lambda t, c: t + c.cast("double") * c.cast("double")))
    classes = classes.withColumn("range", F.round(F.log(norm) / math.log(NORMS)).cast("int"))  # equal norms up to rounding share a range
    # at most some 2,000 rows: as many ranges as the exponents of floats span
    ranges = sorted((r["range"], math.ceil(r["count"] / max(LEAST_SHARD, int(SHARD_ROOT * math.sqrt(n))))) for r in classes.groupBy("range").count().collect())
    starts = np.cumsum([0, *(p for _, p in ranges)]).tolist()
    shards = starts[-1]
    plan = spark.createDataFrame([(r, s, p) for (r, p), s in zip(ranges, starts, strict=False)], "range int, start int, parts int")

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rep")
        x = np.stack(pdf["e"].to_numpy()).astype(np.float32)
        links, entry = build_graph(x)
        return pd.DataFrame({"shard": pdf["shard"].iloc[:1], "ids": [pdf["rep"].to_numpy(np.int64).tobytes()], "vectors": [x.tobytes()], "links": [links.tobytes()], "entry": [entry]})

    dealt = classes.join(F.broadcast(plan), "range").withColumn("shard", (F.col("start") + F.pmod(F.xxhash64("rep"), F.col("parts"))).cast("int")).select("shard", "rep", "e")
    graphs = dealt.groupBy("shard").applyInPandas(build, "shard int, ids binary, vectors binary, links binary, entry int")
    graphs = durable(graphs, "graphs")
    asked = member.where(F.col("vec_id") % every == 0)
    asked_classes = durable(classes.join(asked.select("rep").distinct(), "rep", "left_semi"), "asked")
    blocks = max(1, math.ceil(asked_classes.count() / BLOCK))
    block = asked_classes.groupBy(F.pmod(F.xxhash64("rep", F.lit(1)), F.lit(blocks)).alias("block")).agg(F.collect_list("rep").alias("q_ids"), F.flatten(F.collect_list("e")).alias("q_vectors"))
    tasks = block.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).join(graphs, "shard")
    take = k + 1

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = {c: batch.column(c)[r] for c in ("q_ids", "q_vectors", "ids", "vectors", "links", "entry")}
                x = np.frombuffer(row["vectors"].as_buffer(), np.float32).reshape(-1, dim)
                links = np.frombuffer(row["links"].as_buffer(), np.int32).reshape(len(x), -1)
                ids = np.frombuffer(row["ids"].as_buffer(), np.int64)
                q_ids = row["q_ids"].values.to_numpy()
                q = row["q_vectors"].values.to_numpy().reshape(-1, dim).astype(np.float32)
                for a in range(0, len(q), 256):
                    part = q[a : a + 256]
                    found = beam_search(x, links, row["entry"].as_py(), part, SEARCH_BEAM, True)[0][:, : take + 8]
                    score = (x[found].astype(np.float64) * part[:, None].astype(np.float64)).sum(2)
                    score[found < 0] = -np.inf
                    best = np.lexsort((ids[found], -score))[:, :take]
                    found, score = np.take_along_axis(found, best, 1), np.take_along_axis(score, best, 1)
                    ok = found >= 0
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q_ids[a : a + 256], found.shape[1])[ok.ravel()]), pa.array(ids[found[ok]]), pa.array(score[ok])], names=["q", "rep", "score"])

    found = tasks.repartition(max(1, min(shards * blocks, 8 * shuffle_width(spark))), "shard", "block").mapInArrow(search, "q long, rep long, score double")
    by_score = [F.desc("score"), F.asc("rep")]
    top = found.withColumn("r", F.row_number().over(W.partitionBy("q").orderBy(*by_score))).where(F.col("r") <= take).select("q", "rep", "score")
    # of each class the least ids are enough; salting keeps a class of any size in many tasks
    salted = member.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    least = salted.withColumn("r", F.row_number().over(W.partitionBy("rep", "salt").orderBy("vec_id"))).where(F.col("r") <= take)
    least = least.withColumn("r", F.row_number().over(W.partitionBy("rep").orderBy("vec_id"))).where(F.col("r") <= take).select("rep", "vec_id")
    rows = top.join(least, "rep").withColumn("r", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).where(F.col("r") <= take)
    lists = rows.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("r", "vec_id", "score"))).alias("hits"))
    answered = asked.select(F.col("rep").alias("q"), F.col("vec_id").alias("query_id")).join(lists, "q")
    own = F.slice(F.filter("hits", lambda h: h["vec_id"] != F.col("query_id")), 1, k)
    hit = answered.select("query_id", F.posexplode(own).alias("pos", "hit"))
    return hit.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
