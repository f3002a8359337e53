"""MinHash near-dedup with SetSketch registers.

Sketch: register j holds floor(1 - log_b x) for the least x over the shingles of
exponential variates, truncated to 16 bits (Ertl, 2021).  Registers of a union are the
larger of both, and the chance that two agree follows the Jaccard similarity.

Link search.  Documents with equal shingle sets form a class, a node of the graph, whatever
their ids are: rows of one doc_id with different texts are different documents.  A node is
named by its least doc_id, or by a spare number if another class has the same or it has none.
Bands of ``ROWS`` registers put nodes into buckets.  Components
need no more than a spanning set of links, so a few rounds first compare each member of a
bucket with the bucket's pivot; then, for every bucket that still holds more than one
component, all pairs across components are compared: by a join in buckets of up to
``SMALL`` members; elsewhere members outside the bucket's largest component meet each other
in blocks of ``BLOCK``, and meet the largest component in blocks that intersect full sets
through an index and let only links out.  No task holds an unbounded bucket and no pair is
dropped.  Candidate pairs are first estimated from the registers by joint likelihood and
then confirmed on the full shingle sets.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_PATTERN, bound_batches, discard, durable, spread_join, table, written
from .components import connected_components
from .shingles import shingle_set

SHINGLE_WORDS, SIMILARITY = 5, 80  # words; per cent
BANDS, ROWS = 40, 5
BASE, RATE = 1.001, 20.0
ROUNDS = ((0, 5), (5, 40))  # bands of the pivot rounds
SMALL, BLOCK, ASKS = 32, 1024, 256
CELL_SHINGLES = 1 << 20  # of the members, and of the asking documents, of a cell that holds full sets
MARGIN = 0.2  # seven standard deviations of the estimate: misses far less than the bands do

REGISTERS = BANDS * ROWS
_SEEDS = (np.arange(1, REGISTERS + 1, dtype=np.uint32) * np.uint32(0x9E3779B1))[:, None]
_M1, _M2 = np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Registers (uint16) of a set that is not empty."""
    h = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    least = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    for a in range(0, len(h), 1024):
        t = h[None, a : a + 1024] ^ _SEEDS
        t *= _M1
        t ^= t >> np.uint32(15)
        t *= _M2
        np.minimum(least, t.min(1), out=least)
    x = -np.log1p(-(least + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, 65535).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union."""
    return np.maximum(a, b)


def jaccard_estimate(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Most likely Jaccard similarity of each row of registers, given the set sizes, over a
    grid of 101 values from 0 to the greatest that the sizes allow."""
    u = (size_a / (size_a + size_b))[:, None]
    v = 1 - u
    j = np.linspace(0, 1, 101)[None] * np.minimum(u / v, v / u)
    p = lambda x: -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / np.log(BASE)
    more, less = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    pm, pl = p(u - v * j), p(v - u * j)
    value = more * np.log(pm) + less * np.log(pl) + (a.shape[1] - more - less) * np.log(np.maximum(1e-12, 1 - pm - pl))
    return np.take_along_axis(j, value.argmax(1)[:, None], 1)[:, 0]


def sketches(docs: DataFrame, size: int, carried: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, ``carried`` long columns, n_shingles, digest (null for an empty set), registers and
    the compressed text of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            counts, digests, registers, bodies = [], [], [], []
            for x in batch.column("text"):
                data = x.as_py() or b""
                s = shingle_set(data, size)
                counts.append(len(s))
                digests.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                registers.append(sketch(s).tobytes() if len(s) else None)
                bodies.append(pack.compress(data) if len(s) else None)
            made = [pa.array(counts, pa.int64()), *(pa.array(c, pa.binary()) for c in (digests, registers, bodies))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in first), *made], names=[*first, "n_shingles", "digest", "registers", "body"])

    first = ["doc_id", *carried]
    ready = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *carried, F.col("text").cast("binary").alias("text"))
    return ready.mapInArrow(run, "".join(f"{c} long, " for c in first) + "n_shingles long, digest binary, registers binary, body binary")


def unpacked_set(body: bytes, size: int) -> np.ndarray:
    return shingle_set(zstandard.ZstdDecompressor().decompress(body), size)


def band_keys(reps: DataFrame) -> DataFrame:
    """(rep, band, key) for every band of every representative."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = np.uint64(0x9E3779B97F4A7C15)
        for batch in batches:
            if not batch.num_rows:
                continue
            r = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, BANDS, ROWS).astype(np.uint64)
            key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), r.shape[:2]).copy()
            for j in range(ROWS):
                key = (key ^ r[:, :, j]) * p
                key ^= key >> np.uint64(29)
            flat = pa.array(key.reshape(-1).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * BANDS), flat)], names=["rep", "keys"])

    keys = reps.select("rep", "registers").mapInArrow(run, "rep long, keys array<long>")
    return keys.select("rep", F.posexplode("keys").alias("band", "key"))


def estimated(pairs: DataFrame, reps: DataFrame, per_cent: int) -> DataFrame:
    """The pairs (a, b) whose sizes and registers allow the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ra, rb = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("ra", "rb"))
                j = jaccard_estimate(ra, rb, batch.column("na").to_numpy(), batch.column("nb").to_numpy())
                yield batch.select(["a", "b"]).filter(pa.array(j >= per_cent / 100 - MARGIN))

    one = reps.select(F.col("rep").alias("a"), F.col("registers").alias("ra"), F.col("n").alias("na"))
    two = reps.select(F.col("rep").alias("b"), F.col("registers").alias("rb"), F.col("n").alias("nb"))
    both = pairs.join(one, "a").join(two, "b").where(100 * F.least("na", "nb") >= per_cent * F.greatest("na", "nb"))
    return both.select("a", "b", "ra", "rb", "na", "nb").mapInArrow(run, "a long, b long")


def confirmed(pairs: DataFrame, bodies: DataFrame, size: int, per_cent: int) -> DataFrame:
    """Whether each pair is a link, on the full sets: (a, b, linked)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: OrderedDict[int, np.ndarray] = OrderedDict()

        def of(key: int, body: pa.Scalar) -> np.ndarray:
            if key not in kept:
                kept[key] = unpacked_set(body.as_py(), size)
                if len(kept) > 64:
                    kept.popitem(last=False)
            return kept[key]

        for batch in batches:
            linked = []
            for a, b, ta, tb in zip(*(batch.column(c).to_pylist() for c in ("a", "b")), batch.column("ta"), batch.column("tb"), strict=True):
                x, y = of(a, ta), of(b, tb)
                both = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * both >= per_cent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

    one, two = (bodies.select(F.col("rep").alias(x), F.col("body").alias("t" + x)) for x in "ab")
    return pairs.join(one, "a").join(two, "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long, linked boolean")


def _across(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What buckets of (key, band, rep, comp) that hold several components leave to compare: pairs
    (a, b) of small buckets, cells of large ones, and (main, rep): documents to hold against all
    members of the component ``main``."""
    about = rows.groupBy("key").agg(F.count("*").alias("m"), F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 < c1")
    open_rows = rows.join(about.select("key", "m"), "key")
    small = open_rows.where(F.col("m") <= SMALL)
    other = small.select("key", F.col("rep").alias("b"), F.col("comp").alias("cb"))
    pairs = small.select("key", F.col("rep").alias("a"), "comp").join(other, "key").where("a < b and comp <> cb").select("a", "b")
    # in large buckets the members outside the largest component meet each other block by block,
    # and the largest component as a whole, once for all buckets that they share
    large = open_rows.where(F.col("m") > SMALL)
    sizes = large.groupBy("key", "comp").agg(F.count("*").alias("k"))
    main = sizes.groupBy("key").agg(F.max(F.struct("k", "comp")).alias("top"), F.sum("k").alias("all"))
    main = main.select("key", F.col("top.comp").alias("main"), F.ceil((F.col("all") - F.col("top.k")) / BLOCK).cast("int").alias("blocks"))
    minor = large.join(main, "key").where("comp <> main")
    asks = minor.select("main", "rep").distinct()
    here, there = (F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows_of = minor.select("key", "band", here.alias("i"), there.alias("j"), F.lit(False).alias("asks"), "rep", "comp")
    cells = rows_of.unionByName(minor.select("key", "band", there.alias("i"), here.alias("j"), F.lit(True).alias("asks"), "rep", "comp"))
    return pairs, cells, asks


def _block_pairs(cells: DataFrame, reps: DataFrame, per_cent: int) -> DataFrame:
    """Pairs of the blocks that their registers allow.

    A pair leaves the first bucket that it shares only: what two documents are in the earlier
    bucket, a pair of a small one, of a block, or one of them in the largest component, has them
    compared there."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rep")
        asks = pdf["asks"].to_numpy(bool)
        rep, comp, n = (pdf[c].to_numpy() for c in ("rep", "comp", "n"))
        regs = np.frombuffer(b"".join(pdf["registers"]), np.uint16).reshape(-1, REGISTERS)
        bands = regs.reshape(-1, BANDS, ROWS)[:, : int(pdf["band"].iloc[0])]
        rest, a, b = np.flatnonzero(~asks), [], []
        for k in np.flatnonzero(asks):
            can = rest[(comp[rest] != comp[k]) & (rep[rest] < rep[k]) & (100 * np.minimum(n[rest], n[k]) >= per_cent * np.maximum(n[rest], n[k]))]
            if len(can):
                j = jaccard_estimate(regs[can], regs[k : k + 1], n[can], np.full(len(can), n[k]))
                hit = can[j >= per_cent / 100 - MARGIN]
                hit = hit[~(bands[hit] == bands[k]).all(2).any(1)]
                a.append(np.minimum(rep[hit], rep[k]))
                b.append(np.maximum(rep[hit], rep[k]))
        return pd.DataFrame({"a": np.concatenate([*a, np.zeros(0, np.int64)]), "b": np.concatenate([*b, np.zeros(0, np.int64)])})

    return cells.join(reps.select("rep", "n", "registers"), "rep").groupBy("key", "i", "j").applyInPandas(run, "a long, b long")


def _links_into(asks: DataFrame, labels: DataFrame | None, reps: DataFrame, bodies: DataFrame, size: int, per_cent: int) -> DataFrame:
    """Links (a, b) between the documents of ``asks`` (main, rep) and the members of their ``main``
    component, on the full sets.  A ``main`` without a label is a document that is still alone,
    its only member.

    A cell holds a block of members and a block of asking documents, whose shingles it indexes;
    only links leave it.  Blocks are bounded by documents and by shingles."""
    sizes = reps.select("rep", "n")
    blocks_of = lambda most: F.ceil(F.greatest(F.count("*") / most, F.sum("n") / CELL_SHINGLES)).cast("int")
    n = asks.join(sizes, "rep").groupBy("main").agg(blocks_of(ASKS).alias("ask_blocks"))
    member = n.select(F.col("main").alias("rep"), "main", "ask_blocks")
    if labels is not None:
        linked = labels.withColumnRenamed("comp", "main")
        member = linked.join(n, "main").select(*member.columns).union(member.join(linked.select("main"), "main", "left_anti").select(*member.columns))
    m = member.join(sizes, "rep").groupBy("main").agg(blocks_of(BLOCK).alias("blocks"))
    i, j = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"), F.pmod(F.xxhash64("rep"), F.col("ask_blocks")).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    members = member.join(m, "main").select("main", i.alias("i"), every("ask_blocks").alias("j"), F.lit(False).alias("asks"), "rep")
    asking = asks.join(n, "main").join(m, "main").select("main", every("blocks").alias("i"), j.alias("j"), F.lit(True).alias("asks"), "rep")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        asking = pdf[pdf["asks"]]
        sets = [unpacked_set(x, size) for x in asking["body"]]
        flat, owner = np.concatenate([*sets, np.zeros(0, np.uint64)]), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        known, start = np.unique(flat, return_index=True)
        end = np.append(start[1:], len(flat))
        sizes, asked = np.array([len(x) for x in sets]), asking["rep"].to_numpy()
        a, b = [], []
        for rep, body in zip(pdf["rep"][~pdf["asks"]], pdf["body"][~pdf["asks"]], strict=True):
            own = unpacked_set(body, size)
            at = np.searchsorted(known, own).clip(max=len(known) - 1)
            at = at[known[at] == own]
            count = end[at] - start[at]
            places = np.repeat(start[at] - (np.cumsum(count) - count), count) + np.arange(count.sum())
            both = np.bincount(owner[places], minlength=len(sets))
            hit = asked[100 * both >= per_cent * (len(own) + sizes - both)]
            a += [min(rep, x) for x in hit]
            b += [max(rep, x) for x in hit]
        return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    cells = members.unionByName(asking).join(bodies, "rep")
    return cells.groupBy("main", "i", "j").applyInPandas(run, "a long, b long")


def _classes(s: DataFrame, n_docs: int, n_shingles: int) -> tuple[DataFrame, bool]:
    """digest, least doc_id, rep (the node), n, registers and body of each class of equal shingle
    sets, and whether nodes are all named by doc_ids."""
    full = s.where("digest is not null").groupBy("digest")
    first = [F.first(c).alias(n) for c, n in (("n_shingles", "n"), ("registers", "registers"), ("body", "body"))]
    width = 500 + 4 * n_shingles // max(1, n_docs)
    classes = durable(full.agg(F.min("doc_id").alias("doc_id"), *first), "classes", n_docs, width)
    clash = classes.groupBy("doc_id").agg(F.count("*").alias("times")).where("times > 1 or doc_id is null")
    if clash.isEmpty():
        return classes.withColumn("rep", F.col("doc_id")), True
    about = classes.agg(F.count("*").alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).first()
    names = classes.select("digest", "doc_id")
    shared = spread_join(names.where("doc_id is not null"), clash.where("doc_id is not null"), ["doc_id"], "times", about.n).select("digest")
    number = F.monotonically_increasing_id()
    if about.high is None or about.high < 1 << 62:
        spare = number + F.lit(1 << 62)
    elif about.low >= -(1 << 62):
        spare = -number - F.lit((1 << 62) + 1)
    else:  # ids at both ends: number all
        shared, spare = names.select("digest"), number
    spares = durable(shared.union(names.where("doc_id is null").select("digest")).distinct().select("digest", spare.alias("spare")), "spares")
    return durable(classes.join(spares, "digest", "left").withColumn("rep", F.coalesce("spare", "doc_id")).drop("spare"), "nodes", about.n, width), False


def _components(docs: DataFrame, size: int, per_cent: int, carried: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, ``carried`` columns, n_shingles, the node that names the component (null for an
    empty set) and component_id of every row of ``docs``."""
    s = durable(sketches(docs, size, carried), "sketches")
    about = s.agg(F.count("*").alias("n"), F.sum("n_shingles").alias("shingles")).first()
    n_docs = about.n
    classes, by_id = _classes(s, n_docs, about.shingles or 0)
    reps = classes.select("rep", "n", "registers")
    keys = band_keys(reps)
    shared = keys.groupBy("key").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi").select("key")
    members = durable(keys.join(shared, "key"), "members", 8 * n_docs, 20)
    bodies = classes.select("rep", "body").join(members.select("rep").distinct(), "rep", "left_semi")
    bodies = durable(bodies, "bodies", n_docs, 100 + 4 * (about.shingles or 0) // max(1, n_docs))

    labels = None  # (rep, comp) of representatives that are linked to others
    tested = None

    def labelled(rows: DataFrame) -> DataFrame:
        if labels is None:
            return rows.withColumn("comp", F.col("rep"))
        return rows.join(labels, "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))

    def settle(pairs: DataFrame, more: DataFrame | None = None) -> None:
        """Confirm pairs and merge the components that they, and ``more`` links, connect."""
        nonlocal labels, tested
        seen = durable(confirmed(pairs, bodies, size, per_cent), "confirmed", n_docs, 20)
        tested = seen if tested is None else tested.union(seen)
        links = seen.where("linked").select("a", "b")
        links = links if more is None else links.union(more)
        links = links if labels is None else links.union(labels.where("rep <> comp").select(F.col("comp"), F.col("rep")))
        found = connected_components(links, n_docs)
        labels = None if found is None else found.select(F.col("node").alias("rep"), F.col("component").alias("comp"))

    for first, last in ROUNDS:
        rows = labelled(members.where((F.col("band") >= first) & (F.col("band") < last)))
        pivot = rows.groupBy("key").agg(F.min(F.struct(F.xxhash64("rep", F.lit(first)), F.col("rep"), F.col("comp"))).alias("p"), F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 < c1")
        pairs = rows.join(pivot.select("key", F.col("p.rep").alias("pivot"), F.col("p.comp").alias("pc")), "key").where("comp <> pc")
        pairs = pairs.select(F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested.select("a", "b"), ["a", "b"], "left_anti")
        settle(estimated(pairs, reps, per_cent))
    still_open = durable(labelled(members).select("key", "band", "rep", "comp"), "open", 8 * n_docs, 24)
    small, cells, asks = _across(still_open)
    # written first: a pair may share 40 buckets, and the optimiser would test it before it is made distinct
    fresh = lambda pairs: durable(pairs.distinct(), "pairs", n_docs, 20).join(tested.select("a", "b"), ["a", "b"], "left_anti")
    rest = estimated(fresh(small), reps, per_cent).union(fresh(_block_pairs(cells, reps, per_cent)))
    settle(rest.distinct(), _links_into(asks, labels, reps, bodies, size, per_cent))
    discard(members, bodies, still_open)
    named = labelled(classes.select("digest", "doc_id", "rep"))
    if by_id:
        named = named.select("digest", "comp", F.col("comp").alias("least"))
    else:
        named = named.join(named.groupBy("comp").agg(F.min("doc_id").alias("least")), "comp").select("digest", "comp", "least")
    out = s.select("doc_id", *carried, "n_shingles", "digest").join(named, "digest", "left")
    return out.select("doc_id", *carried, "n_shingles", "comp", F.when(F.col("comp").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def near_duplicates(docs: DataFrame, size: int = SHINGLE_WORDS, per_cent: int = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of ``docs``.

    Null and empty texts, and texts without words, have an empty set and stand alone.  Each row
    is a document: rows of one doc_id link by their texts only, and rows without a doc_id link
    like others, but name no component, so component_id is null where all ids of a component
    are.  ``kept`` compares doc_id and component_id null-safely.  Extra columns are not read; an
    empty table gives no rows.
    """
    bound_batches(docs.sparkSession)
    out = _components(docs, size, per_cent)
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=2)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, 0.8), with its columns.

    The row of least doc_id stays (null ids last), of several texts under that id one that does
    not depend on the order of rows, and of rows that repeat it one.  Rows of one id with
    different texts are different documents.  Texts without words have no duplicates, so all
    their rows stay; an empty table stays empty.
    """
    bound_batches(spark)
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    doc_id = F.col("doc_id").cast("long")
    keys = {"i0": F.coalesce(doc_id, F.lit(0)), "i1": doc_id.isNull().cast("long"), "k1": F.xxhash64(F.lit(1), text), "k2": F.xxhash64(F.lit(2), text)}
    on = list(keys)
    ready = docs.select(F.struct(*docs.columns).alias("row"), doc_id.alias("doc_id"), F.col("text"), *[c.alias(n) for n, c in keys.items()])
    with written() as made:
        found = _components(ready.drop("row"), SHINGLE_WORDS, SIMILARITY, tuple(on)).where("comp is not null")
        rows = found.groupBy("comp", *on).agg(F.count("*").alias("times"))
        best = rows.groupBy("comp").agg(F.min(F.struct("i1", "i0", "k1", "k2", "times")).alias("b"))
        best = durable(best.select(*[F.col("b")[c].alias(c) for c in on], F.col("b.times").alias("times")), "kept")
    # only the names of the kept rows are read from here on; sketches and classes are about as large as the texts
    discard(*(t for t in made if t is not best))
    worded = ready.where(F.col("text").rlike(WORD_PATTERN))
    one = worded.join(best.where("times = 1"), on, "left_semi").select("row")
    repeated = best.where("times > 1")
    if not repeated.isEmpty():
        total = best.agg(F.sum("times")).first()[0]
        one = one.union(spread_join(worded, repeated, on, "times", total).dropDuplicates(on).select("row"))
    return one.union(ready.where(~F.coalesce(F.col("text").rlike(WORD_PATTERN), F.lit(False))).select("row")).select("row.*")


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), g AS (
  SELECT doc_id, CASE WHEN len(words) >= 2 THEN list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) WHEN len(words) = 1 THEN words ELSE [] END AS grams FROM w
), n AS (SELECT doc_id, CAST(coalesce(len(grams), 0) AS BIGINT) AS n_shingles FROM g
), s AS (SELECT doc_id, hash(unnest(grams)) AS h FROM g
), p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.h = y.h AND x.doc_id < y.doc_id GROUP BY 1, 2
), l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * common >= 80 * (na.n_shingles + nb.n_shingles - common)
), e AS (SELECT a, b FROM l UNION SELECT b, a FROM l
), r AS (SELECT a AS x, b AS y FROM e UNION SELECT r.x, e.b FROM r JOIN e ON r.y = e.a
), c AS (SELECT x, min(y) AS low FROM r GROUP BY x)
SELECT n.doc_id, n_shingles, least(n.doc_id, coalesce(low, n.doc_id)) AS component_id, n.doc_id = least(n.doc_id, coalesce(low, n.doc_id)) AS kept
FROM n LEFT JOIN c ON n.doc_id = c.x
"""
