"""Suffix-array dedup: remove every byte of a 200-byte string that starts twice.

1. Anchors.  In each 200-byte window of a text the 32-byte string of least hash is the
   window's anchor (the leftmost of equals), so equal windows have equal anchors at equal
   offsets.  Runs of windows with one anchor make one row: anchor hash, the hash of all the
   bytes its windows span (the context), document key, place.  Contexts and documents are
   named by 128 bits: among 10**13 contexts the chance that any two meet is about 10**-13.
2. Anchors that occur once cannot hold a repeated window; they go.  A context that occurs
   twice is repeated throughout.  Both come from partial aggregates; rows of very frequent
   anchors and contexts meet them by broadcast, so no task gathers them.
3. Anchors with several contexts: one copy of each context goes to a run-length index
   (``runindex``) by anchor; overlapping contexts of one document are joined first, so each
   byte stands once.  Its matching statistics tell which windows start elsewhere.  Anchors
   with over ``HOT`` contexts are split over several indexes, and their windows meet by hash in
   one aggregate more.
4. Windows become byte ranges by document and are cut out of the text.

Documents with equal texts are one key; all their bytes go if the text has 200 bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, discard, durable, give_back, on_disk, spread_join, table
from .runindex import RunIndex

WINDOW = 200
GRAM = 32  # a power of two
INDEX_BYTES = 1 << 18
HOT = 2048

_CHUNK = 1 << 18
_M = 0x9E3779B97F4A7C15


def anchor_rows(text: np.ndarray, ends: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of the texts that lie end to end in ``text`` (at most 2**20 bytes; places take the low 20 bits of a key): hash, place,
    first window and number of windows, by place."""
    none = np.zeros(0, np.int64)
    if len(text) < window:
        return none.astype(np.uint64), none, none, none
    h, step, factor = text.astype(np.uint64) + np.uint64(1), 1, _M
    while step < GRAM:
        h = h[:-step] * np.uint64(factor) + h[step:]
        step, factor = step * 2, factor * factor & (1 << 64) - 1
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    key = (h & np.uint64(0xFFFFFFFFFFF00000)) | np.arange(len(h), dtype=np.uint64)
    span, have = window - GRAM + 1, 1
    while have * 2 <= span:
        key = np.minimum(key[:-have], key[have:])
        have *= 2
    if have < span:
        key = np.minimum(key[: len(key) - (span - have)], key[span - have :])
    place = (key & np.uint64(0xFFFFF)).astype(np.int64)
    owner = np.searchsorted(ends, np.arange(len(place)), side="right")
    first = np.flatnonzero(np.arange(len(place)) + window <= ends[owner])
    if not len(first):
        return none.astype(np.uint64), none, none, none
    place, owner = place[first], owner[first]
    head = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (owner[1:] != owner[:-1]) | (first[1:] != first[:-1] + 1)]))
    return h[place[head]], place[head], first[head], np.diff(np.append(head, len(first)))


def context_keys(body: bytes, at: int) -> tuple[int, int]:
    """Two words that name the bytes of a context and where its anchor stands in it."""
    h = xxhash.xxh3_128_intdigest(body, at)
    return h & (1 << 64) - 1, h >> 64


def text_keys(body: Column) -> tuple[Column, Column]:
    """Two words that name a text."""
    return F.xxhash64(F.lit(1), body), F.xxhash64(F.lit(2), body)


def _chunks(rows: Iterator[tuple[tuple[int, int], bytes]]) -> Iterator[list[tuple[tuple[int, int], int, bytes]]]:
    """Groups of (key, first byte, bytes) of at most ``_CHUNK`` bytes; longer texts are cut into
    pieces that overlap by a window less one byte."""
    held, size = [], 0
    for key, data in rows:
        for a in range(0, max(1, len(data) - WINDOW + 1), _CHUNK - WINDOW):
            piece = data[a : a + _CHUNK]
            if size + len(piece) > _CHUNK:
                yield held
                held, size = [], 0
            held.append((key, a, piece))
            size += len(piece)
            if a + len(piece) == len(data):
                break
    if held:
        yield held


def anchors(texts: DataFrame) -> DataFrame:
    """(d, e, anchor, context, more, first, windows) of the rows (d, e, body) of ``texts``; context
    and more name the context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = ((k, x.as_py()) for k, x in zip(zip(*(batch.column(c).to_pylist() for c in (0, 1)), strict=True), batch.column(2), strict=True))
            for group in _chunks((k, x) for k, x in rows if len(x) >= WINDOW):
                whole = b"".join(x for _, _, x in group)
                ends = np.cumsum([len(x) for _, _, x in group])
                h, place, first, count = anchor_rows(np.frombuffer(whole, np.uint8), ends)
                owner = np.searchsorted(ends, first, side="right")
                base = np.array([a for _, a, _ in group])[owner] - np.concatenate([[0], ends[:-1]])[owner]
                context = np.array([context_keys(whole[s : s + c + WINDOW - 1], p - s) for p, s, c in zip(place.tolist(), first.tolist(), count.tolist(), strict=True)], np.uint64).reshape(-1, 2).view(np.int64)
                key = np.array([k for k, _, _ in group], np.int64)[owner]
                made = [key[:, 0], key[:, 1], h.view(np.int64), context[:, 0], context[:, 1], first + base, count.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in made], names=["d", "e", "anchor", "context", "more", "first", "windows"])
        give_back()

    return texts.mapInArrow(run, "d long, e long, anchor long, context long, more long, first long, windows int")


def index_windows(pdf: pd.DataFrame) -> tuple[pd.DataFrame, list[np.ndarray]]:
    """The rows (d, e, first, windows, body) in text order, and for each a mask over its windows:
    which start elsewhere in the group."""
    pdf = pdf.sort_values(["d", "e", "first"], kind="stable")
    pieces, ends, at = [], [], []
    size, open_d, open_end = 0, None, 0
    for d, first, body in zip(zip(pdf["d"].tolist(), pdf["e"].tolist(), strict=True), pdf["first"].tolist(), pdf["body"].tolist(), strict=True):
        if d == open_d and first < open_end:
            at.append(size - (open_end - first))
            body = body[open_end - first :]
        else:
            if size:
                ends.append(size)
            at.append(size)
        if body:
            pieces.append(body)
            size += len(body)
            open_end = first + len(body) if d != open_d or first >= open_end else open_end + len(body)
        open_d = d
    ends.append(size)
    long_enough = RunIndex(np.frombuffer(b"".join(pieces), np.uint8), np.array(ends)).matching_statistics() >= WINDOW
    return pdf, [long_enough[a : a + w] for a, w in zip(at, pdf["windows"].tolist(), strict=True)]


def _ranges(mask: np.ndarray) -> tuple[list[int], list[int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return edge[::2].tolist(), edge[1::2].tolist()


def repeated_ranges(texts: DataFrame) -> DataFrame:
    """(d, e, ranges): byte ranges, first and end, that repeated windows cover, for the rows
    (d, e, body) of ``texts``.  Ranges of a document may touch or overlap."""
    name, own = ["anchor", "context", "more"], ["d", "e"]
    found = on_disk(anchors(texts))
    n = found.count()
    place = F.xxhash64("d", "e", "first")
    # both tables that are made of the anchors are files, so that their shuffles go; blocks would hold them
    twice = found.groupBy("anchor").agg(F.min(place).alias("o1"), F.max(place).alias("o2"), F.count("*").alias("times")).where("o1 < o2")
    twice = durable(twice.select("anchor", "times"), "twice", n // 8, 16)
    left = twice.agg(F.sum("times")).first()[0] or 0
    rows, n = durable(spread_join(found, twice, ["anchor"], "times", n).drop("times"), "rows", left), left
    discard(found, twice)
    contexts = rows.groupBy(*name).agg(F.min(place).alias("o1"), F.max(place).alias("o2"), F.count("*").alias("times"), F.min(F.struct("d", "e", "first", "windows")).alias("one"))
    contexts = durable(contexts.select(*name, (F.col("o1") < F.col("o2")).alias("whole"), "times", "one.*"), "contexts", n)
    mixed = contexts.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1")
    asked = spread_join(contexts.drop("times"), mixed, ["anchor"], "n", n).withColumn("salts", F.ceil(F.col("n") / HOT).cast("int"))
    asked = durable(asked.withColumn("salt", F.pmod("context", F.col("salts")).cast("int")), "asked", n)
    total = asked.agg(F.sum(F.col("windows") + WINDOW - 1)).first()[0] or 0
    groups = max(1, -(-total // INDEX_BYTES))
    cell = [*name, "first", "windows", "whole", "salts", "salt"]
    wanted = asked.groupBy(*own).agg(F.collect_list(F.struct(*cell)).alias("wanted"))
    unpack = zstandard.ZstdDecompressor

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                body, cells = unpack().decompress(batch.column("packed")[r].as_py()), batch.column("wanted")[r].values
                cells = pa.RecordBatch.from_struct_array(cells)
                first, windows = cells.column("first").to_pylist(), cells.column("windows").to_pylist()
                parts = [body[a : a + w + WINDOW - 1] for a, w in zip(first, windows, strict=True)]
                keys = [pa.repeat(batch.column(c)[r], len(parts)) for c in own]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(parts, pa.binary()), *(cells.column(c) for c in cell)], names=[*own, "body", *cell])

    one_each = packed(texts).dropDuplicates(own)
    cells = one_each.join(wanted, own).mapInArrow(cut, "d long, e long, body binary, anchor long, context long, more long, first long, windows int, whole boolean, salts int, salt int")
    group = F.when(F.col("salts") == 1, F.pmod("anchor", F.lit(groups))).otherwise(F.xxhash64("anchor", "salt"))

    def look_up(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, masks = index_windows(pdf)
        found = [_ranges(m) for m in masks]
        out = pdf[name].copy()
        out["lo"], out["hi"] = [f[0] for f in found], [f[1] for f in found]
        # windows of split anchors may match in another index; those that matched here are marked
        # already, so one of each kind speaks for them there
        loose, spoken = [], set()
        for m, salts, body in zip(masks, pdf["salts"], pdf["body"], strict=True):
            own = []
            for k in range(len(m)) if salts > 1 else ():
                digest = xxhash.xxh3_128_digest(body[k : k + WINDOW])
                if not m[k] or digest not in spoken:
                    own.append({"at": k, "hash": digest})
                if m[k]:
                    spoken.add(digest)
            loose.append(own)
        out["loose"] = loose
        give_back()
        return out

    looked = cells.withColumn("group", group).groupBy("group").applyInPandas(look_up, "anchor long, context long, more long, lo array<int>, hi array<int>, loose array<struct<at int, hash binary>>")
    looked = durable(looked, "looked-up", asked.count(), 128)
    loose = looked.select(*name, F.inline("loose"))
    here = F.struct("context", "more")
    met = loose.groupBy("hash").agg(F.min(here).alias("c1"), F.max(here).alias("c2"), F.count("*").alias("n")).where("c1 < c2").select("hash", "n")
    span = lambda lo, hi: F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))
    crossed = spread_join(loose, met, ["hash"], "n", n).groupBy(*name).agg(F.collect_list(span(F.col("at"), F.col("at") + 1)).alias("parts"))
    partial = looked.select(*name, F.transform(F.arrays_zip("lo", "hi"), lambda r: span(r["lo"], r["hi"])).alias("parts")).where(F.size("parts") > 0)
    partial = partial.unionByName(crossed).groupBy(*name).agg(F.flatten(F.collect_list("parts")).alias("parts"))
    # contexts of anchors with one context alone were not looked up
    known = contexts.select(*name, "times", "whole", F.array(span(F.lit(0), F.col("windows"))).alias("all")).join(partial, name, "left")
    known = known.select(*name, "times", F.when(F.col("whole"), F.col("all")).otherwise(F.col("parts")).alias("parts")).where("parts is not null")
    known = durable(known, "known", contexts.count())
    hits = spread_join(rows.select(*own, *name, "first"), known, name, "times", n)
    placed = F.transform("parts", lambda p: F.struct((F.col("first") + p["lo"]).alias("lo"), (F.col("first") + p["hi"] + WINDOW - 1).alias("hi")))
    ranges = durable(hits.select(*own, placed.alias("r")).groupBy(*own).agg(F.flatten(F.collect_set("r")).alias("ranges")), "ranges", n)
    discard(rows, contexts, asked, looked, known)
    return ranges


def packed(texts: DataFrame) -> DataFrame:
    """(d, e, packed): bodies compressed, for the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([pack.compress(x.as_py()) for x in batch.column(2)], pa.binary())], names=["d", "e", "packed"])

    return texts.mapInArrow(run, "d long, e long, packed binary")


def cut_repeats(docs: DataFrame, *carried: str | Column, text: bool = False) -> DataFrame:
    """``carried`` columns of every row of ``docs`` with n_bytes, n_removed, n_spans,
    kept_sha256 and, if asked for, the bytes that stay (``kept_bytes``).

    Null texts are empty.  Each row is a document, so a repeated row is a copy.  Nulls in
    other columns are carried; an empty table gives no rows.
    """
    bound_batches(docs.sparkSession)
    body = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    d, e = text_keys(body)
    names = docs.select(*carried).columns
    ask = F.struct(*carried) if names else F.struct(F.lit(0).alias("none"))
    all_rows = docs.select(ask.alias("row"), d.alias("d"), e.alias("e"), body.alias("body"))
    long_rows = all_rows.where(F.octet_length("body") >= WINDOW).select("d", "e", "body")
    ranges = repeated_ranges(long_rows)
    copies = long_rows.groupBy("d", "e").agg(F.count("*").alias("n")).where("n > 1").select("d", "e", F.lit(True).alias("copied"))
    verdict = durable(ranges.join(copies, ["d", "e"], "full"), "verdicts", ranges.count(), 256)
    discard(ranges)

    ready = all_rows.select("d", "e", F.octet_length("body").cast("long").alias("n_bytes"), F.sha2("body", 256).alias("sha"), "row", "body")

    def pack(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = zstandard.ZstdCompressor(level=1)
        for bodies in batches:
            yield pd.Series([c.compress(x) for x in bodies])

    ready = ready.withColumn("packed", F.pandas_udf(pack, "binary")(F.col("body"))).drop("body")
    joined = ready.join(verdict, ["d", "e"], "left")
    whole = F.coalesce("copied", F.lit(False))
    cut = (F.col("ranges").isNotNull()) & ~whole
    schema = "n_removed long, n_spans long, sha string, kept_bytes binary"

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = zstandard.ZstdDecompressor()
        for pdf in batches:
            out = []
            for body, ranges, sha, whole_text, size in zip(pdf["packed"], pdf["ranges"], pdf["sha"], pdf["whole"], pdf["n_bytes"], strict=True):
                if whole_text:
                    out.append((size, 1, hashlib.sha256(b"").hexdigest(), b""))
                elif ranges is None:
                    out.append((0, 0, sha, c.decompress(body) if text else None))
                else:
                    data, kept, at, spans = c.decompress(body), [], 0, 0
                    end = -1
                    for lo, hi in sorted((r["lo"], r["hi"]) for r in ranges):
                        if lo > end:
                            kept.append(data[at:lo])
                            spans += 1
                        end = at = max(end, hi)
                    kept.append(data[at:])
                    rest = b"".join(kept)
                    out.append((size - len(rest), spans, hashlib.sha256(rest).hexdigest(), rest if text else None))
            yield pd.DataFrame(out, columns=["n_removed", "n_spans", "sha", "kept_bytes"])

    need = F.struct(F.when(cut | F.lit(text), F.col("packed")).alias("packed"), F.when(cut, F.col("ranges")).alias("ranges"), "sha", whole.alias("whole"), "n_bytes")
    done = joined.select("row", "n_bytes", F.pandas_udf(apply, schema)(need).alias("r"))
    extra = [F.col("r.kept_bytes")] if text else []
    return done.select(*[F.col("row")[c].alias(c) for c in names], "n_bytes", "r.n_removed", "r.n_spans", F.col("r.sha").alias("kept_sha256"), *extra)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_repeats(table(spark, sf_dir, "documents"), F.col("doc_id").cast("long").alias("doc_id"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without repeated passages, all rows and columns.

    A character that a cut splits goes too.  n_chars, if there, follows a text that was cut.
    Null texts stay null; of rows that repeat a text of 200 bytes or more all texts are emptied;
    an empty table stays empty.
    """

    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for bodies in batches:
            yield pd.Series([bytes(x).decode("utf-8", "ignore") for x in bodies], dtype=object)

    # the text travels compressed; in its place the row says whether it was null
    cut = cut_repeats(docs, F.struct(*[F.col("text").isNull().alias(c) if c == "text" else F.col(c) for c in docs.columns]).alias("doc"), text=True)
    doc = F.col("doc")
    text = F.when(~doc["text"], F.pandas_udf(decode, "string")(F.col("kept_bytes")))
    cut = cut.select("doc", "n_removed", text.alias("cut_text"))
    made = {"text": F.col("cut_text")}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.when(F.col("n_removed") > 0, F.length("cut_text").cast("long")).otherwise(doc["n_chars"])
    return cut.select(*[(made[c] if c in made else doc[c]).alias(c) for c in docs.columns])
