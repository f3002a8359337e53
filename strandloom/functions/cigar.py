"""CIGAR strings as column expressions: everything stays inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

CLOSE_GAP, LEAST_INTRON, MOST_INTRON, MOST_QUERY_GAP, LEAST_END_BLOCK, MOST_SPAN = 14, 32, 350_000, 5, 8, 400_000

_SPANS = "array<struct<start:bigint,end:bigint>>"


def operations(cigar: Column) -> Column:
    """array<struct<op, len>>; null for null and '*'."""
    parts = F.regexp_extract_all(cigar, F.lit(r"(\d+[A-Z=])"), F.lit(1))
    parsed = F.transform(parts, lambda p: F.struct(F.substring(p, -1, 1).alias("op"), F.substr(p, F.lit(1), F.length(p) - 1).cast("long").alias("len")))
    return F.when(cigar != "*", parsed)


def _total(ops: Column, kinds: tuple[str, ...]) -> Column:
    return F.aggregate(ops, F.lit(0).cast("long"), lambda n, o: n + F.when(o["op"].isin(*kinds), o["len"]).otherwise(0))


def reference_span(ops: Column) -> Column:
    """Reference bases from the first to the last aligned base, deletions and skips included."""
    return _total(ops, ("M", "D", "N", "=", "X"))


def aligned_query(ops: Column) -> Column:
    """Query bases inside the alignment, without clips."""
    return _total(ops, ("M", "I", "=", "X"))


def is_spliced(ops: Column) -> Column:
    return F.coalesce(F.exists(ops, lambda o: o["op"] == "N"), F.lit(False))


def has_long_gap(ops: Column, least: int = CLOSE_GAP) -> Column:
    return F.coalesce(F.exists(ops, lambda o: o["op"].isin("D", "N") & (o["len"] > least)), F.lit(False))


def introns(pos0: Column, ops: Column) -> Column:
    """1-based inclusive (start, end) of every N operation."""
    start = F.struct((pos0 + 1).cast("long").alias("at"), F.array().cast(_SPANS).alias("found"))

    def step(s: Column, o: Column) -> Column:
        span = F.array(F.struct(s["at"].alias("start"), (s["at"] + o["len"] - 1).alias("end")))
        moves = o["op"].isin("M", "D", "N", "=", "X")
        return F.struct((s["at"] + F.when(moves, o["len"]).otherwise(0)).alias("at"), F.when(o["op"] == "N", F.concat(s["found"], span)).otherwise(s["found"]).alias("found"))

    return F.aggregate(ops, start, step, lambda s: s["found"])


def _blocks(pos0: Column, ops: Column) -> Column:
    """Maximal matching blocks (q, t, n): query and target start, length."""
    kind = "array<struct<q:bigint,t:bigint,n:bigint>>"
    start = F.struct(F.lit(1).cast("long").alias("q"), (pos0 + 1).cast("long").alias("t"), F.array().cast(kind).alias("b"))

    def step(s: Column, o: Column) -> Column:
        last = F.get(s["b"], F.size(s["b"]) - 1)
        joined = F.coalesce((last["q"] + last["n"] == s["q"]) & (last["t"] + last["n"] == s["t"]), F.lit(False))
        grown = F.concat(F.slice(s["b"], 1, F.greatest(F.size(s["b"]) - 1, F.lit(0))), F.array(F.struct(last["q"].alias("q"), last["t"].alias("t"), (last["n"] + o["len"]).alias("n"))))
        added = F.concat(s["b"], F.array(F.struct(s["q"].alias("q"), s["t"].alias("t"), o["len"].alias("n"))))
        match, gap, insert = o["op"].isin("M", "=", "X"), o["op"].isin("D", "N"), o["op"] == "I"
        return F.struct(
            (s["q"] + F.when(match | insert, o["len"]).otherwise(0)).alias("q"),
            (s["t"] + F.when(match | gap, o["len"]).otherwise(0)).alias("t"),
            F.when(~match, s["b"]).when(joined, grown).otherwise(added).alias("b"),
        )

    return F.aggregate(ops, start, step, lambda s: s["b"])


def hint_introns(pos0: Column, ops: Column) -> Column:
    """Introns (start, end) that pass the hint rules.

    Gaps of up to 14 bases close, gaps of 32 to 350,000 are introns, any other gap drops the
    alignment, as does an unknown operation or a span of over 400,000 bases.  An intron needs a
    query gap of up to 5 behind the block before it; the first needs a first, and the last a
    last block of 8 bases.
    """
    none = F.array().cast(_SPANS)
    known = F.forall(ops, lambda o: o["op"].isin("M", "=", "X", "D", "N", "I", "S", "H", "P"))
    found = _let(_blocks(pos0, ops), lambda b: _let(_linked(b), lambda linked: _let(_kept(linked), lambda kept: _gaps(b, kept))))
    return F.coalesce(F.when(known, found), none)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once for each row, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _linked(b: Column) -> Column:
    """Blocks with what follows them: the gap before, and whether the query goes on closely."""
    return F.transform(
        b,
        lambda x, i: F.struct(
            x["t"].alias("begin"),
            (x["t"] + x["n"] - 1).alias("end"),
            F.coalesce(F.get(b, i + 1)["q"] - x["q"] - x["n"] <= MOST_QUERY_GAP, F.lit(False)).alias("near"),
            (x["t"] - (F.get(b, i - 1)["t"] + F.get(b, i - 1)["n"])).alias("gap"),
        ),
    )


def _kept(linked: Column) -> Column:
    """Blocks after closing short gaps; null if a gap is neither short nor an intron."""

    def step(kept: Column, x: Column) -> Column:
        last = F.element_at(kept, -1)
        closed = F.concat(F.slice(kept, 1, F.size(kept) - 1), F.array(F.struct(last["begin"].alias("begin"), x["end"].alias("end"), x["near"].alias("near"), last["gap"].alias("gap"))))
        return F.when(x["gap"].between(LEAST_INTRON, MOST_INTRON), F.concat(kept, F.array(x))).when(x["gap"] <= CLOSE_GAP, closed)

    return F.aggregate(F.slice(linked, 2, F.greatest(F.size(linked), F.lit(1))), F.slice(linked, 1, 1), step)


def _gaps(b: Column, kept: Column) -> Column:
    """Gaps between kept blocks that count; null if there are none to look at."""
    m = F.size(kept)
    edge = lambda x: x["end"] - x["begin"] + 1 >= LEAST_END_BLOCK
    gaps = F.transform(
        F.sequence(F.lit(1), m - 1),
        lambda k: F.struct(
            (F.element_at(kept, k)["end"] + 1).alias("start"),
            (F.element_at(kept, k + 1)["begin"] - 1).alias("end"),
            (F.element_at(kept, k)["near"] & ((k > 1) | edge(F.element_at(kept, k))) & ((k < m - 1) | edge(F.element_at(kept, k + 1)))).alias("ok"),
        ),
    )
    good = F.transform(F.filter(gaps, lambda g: g["ok"]), lambda g: F.struct(g["start"].alias("start"), g["end"].alias("end")))
    span = F.element_at(b, -1)["t"] + F.element_at(b, -1)["n"] - F.element_at(b, 1)["t"]
    return F.when(kept.isNotNull() & (m >= 2), F.when(span <= MOST_SPAN, good))
