"""The sampling loop: the driver decides, Spark scans.

One step: pick a run, fetch its next batch, gate it, add its tiles and junctions to the
state, re-estimate.  Scans and aggregates are Spark jobs over the batch's records; the state
that decisions need (pooled and per-run tile counts) is small and lives on the driver.
Ties are broken by hash and seed, so a run repeats exactly.
"""

from __future__ import annotations

import hashlib
import math
from collections import deque
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import introns as I
from ..operators import quality, tiles
from ..operators.estimate import TileModel

OK, INCOMPLETE, NO_DATA = 0, 2, 3


class BatchProvider(Protocol):
    """Where batches come from: recorded tables, simulations, or an aligner behind an interface."""

    def fetch(self, accession: str, n: int, x: int) -> DataFrame | None:
        """Alignment records of spots n to x of a run; None if they cannot be had."""


class RecordedProvider:
    """Batches from a table of alignments with ``run`` and ``spot`` columns."""

    def __init__(self, aln: DataFrame):
        self.aln = aln

    def fetch(self, accession: str, n: int, x: int) -> DataFrame | None:
        return self.aln.where((F.col("run") == accession) & F.col("spot").between(n, x))


@dataclass
class Config:
    batch_size: int = 50_000
    max_batches: int = 1000
    tile_size: int = 5000
    least_unique_pct: float = 5.0
    least_mapq: int = 60
    lam: float = 3.0
    pseudo: float = 0.1
    cost: float = 0.0
    seed: int = 1
    stop_without_profit: bool = False
    bootstrap: bool = False
    in_flight: int = 1
    merge_batches: int = 1
    least_mult: int = 1
    refresh_every: int = 25
    unprocessed_weight: float = 1.0
    trace_every: int = 0


@dataclass
class RunState:
    accession: str
    total_spots: int
    avg_len: float = 100.0
    prior: dict = field(default_factory=dict)
    yield_: float | None = None
    status: str = ""
    rank: int = 0
    counts: dict = field(default_factory=dict)
    times: int = 0
    umr_pct: float = 0.0
    spliced_pct: float = 0.0
    bad: bool = False
    used: int = 0
    profit: float = 0.0
    order: list[int] | None = None

    def batches(self, size: int) -> int:
        return max(1, math.ceil(self.total_spots / size))

    def own_counts(self) -> dict:
        """Real plus prior counts."""
        out = dict(self.prior)
        for t, n in self.counts.items():
            out[t] = out.get(t, 0.0) + n
        return out

    def visit_order(self, size: int, seed: int) -> list[int]:
        """Batches by hash, the last (possibly short) one last; made on the first pick."""
        if self.order is None:
            n = self.batches(size)
            key = lambda k: hashlib.md5(f"{seed}:{self.accession}:{k}".encode()).hexdigest()
            self.order = sorted(range(n - 1), key=key) + [n - 1]
        return self.order


def weighted_key(text: str, weight: float) -> float:
    """Exponential variate of rate ``weight`` from a hash of the text."""
    u = (int(hashlib.md5(text.encode()).hexdigest()[:13], 16) + 1) / (16**13 + 1)
    return -math.log(u) / max(weight, 1e-9)


class Pool:
    """Untouched runs that expect the same reads, and so share one profit.

    Their order is drawn once, by exponential keys over their lengths: taken in turn they are a
    length-weighted draw without replacement, and a step costs no pass over them."""

    def __init__(self, factor: float, runs: list[RunState], seed: int):
        self.factor, self.profit = factor, 0.0
        self.order = sorted(runs, key=lambda r: (weighted_key(f"{seed}:{r.accession}", r.avg_len), r.accession), reverse=True)
        self.left = {r.accession for r in runs}
        self.weight = sum(max(r.avg_len, 1e-9) for r in runs)

    def first(self) -> RunState:
        while self.order[-1].accession not in self.left:
            self.order.pop()
        return self.order[-1]

    def take(self, r: RunState) -> bool:
        """Whether the run was here; it no longer is."""
        if r.accession not in self.left:
            return False
        self.left.remove(r.accession)
        self.weight -= max(r.avg_len, 1e-9)
        return True


class Loop:
    """Runs with counts or claims of their own are estimated one by one, untouched ones by pool, so
    a step costs as much as there are touched runs and pools, however many runs are listed."""

    def __init__(self, runs: list[RunState], provider: BatchProvider, config: Config):
        self.runs, self.provider, self.config = runs, provider, config
        self.model = TileModel(config.lam, config.pseudo)
        self.avg_umr = self.avg_spliced = 100.0
        self.timings: list[dict] = []
        self.introns: dict[tuple, int] = {}
        self.trace: list[tuple[int, float]] = []
        self.db_log: list[tuple[int, str, str]] = []
        self.db_version = 0
        self.refreshes: list[tuple[int, str]] = []
        self.done = 0
        self.queue = deque(r.accession for r in sorted((r for r in runs if r.rank > 0), key=lambda r: r.rank))
        self.by = {r.accession: r for r in runs}
        self.touched: list[RunState] = []
        alike: dict[float, list[RunState]] = {}
        for r in runs:
            (self.touched if r.prior or r.counts or r.used or r.times or r.bad else alike.setdefault(self.factor(r), [])).append(r)
        self.pools = {f: Pool(f, rs, config.seed) for f, rs in alike.items()}
        self.claimed, self.useful = sum(r.used for r in runs), any(r.times for r in runs)
        pooled: dict = {}
        for r in runs:
            for t in r.prior:
                pooled.setdefault(t, 0.0)
        self.model.add(pooled)

    def is_open(self, r: RunState) -> bool:
        return not r.bad and r.used < r.batches(self.config.batch_size)

    def open_runs(self) -> list[RunState]:
        """Touched runs that have batches left."""
        return [r for r in self.touched if self.is_open(r)]

    def factor(self, r: RunState) -> float:
        """Share of the average reads that an untouched run should give."""
        return max(0.01, min(1.0, r.yield_)) if r.yield_ is not None else self.config.unprocessed_weight if r.status == "unprocessed" else 1.0

    def reads_of(self, r: RunState | Pool) -> float:
        """Useful reads that one batch of the run, or of any run of the pool, should give."""
        if isinstance(r, RunState) and r.times:
            return (r.umr_pct + r.spliced_pct) / 100 * self.config.batch_size
        factor = r.factor if isinstance(r, Pool) else self.factor(r)
        return factor * (self.avg_umr + self.avg_spliced) / 100 * self.config.batch_size

    def profit_of(self, r: RunState | Pool, extra: np.ndarray | None = None) -> float:
        p = self.model.distribution({} if isinstance(r, Pool) else r.own_counts())
        return self.model.profit(p, self.reads_of(r), extra) - self.config.cost * self.config.batch_size

    def able(self) -> list[RunState | Pool]:
        return [*self.open_runs(), *(p for p in self.pools.values() if p.left)]

    def estimate(self) -> None:
        """Profits with the averages of the step before, then new averages."""
        for r in self.able():
            r.profit = self.profit_of(r)
        seen = [r for r in self.open_runs() if r.times]
        self.avg_umr = (400 + sum(r.umr_pct for r in seen)) / (4 + len(seen))
        self.avg_spliced = (400 + sum(r.spliced_pct for r in seen)) / (4 + len(seen))

    def draw(self, tied: list[RunState | Pool], step: int) -> RunState:
        """One of equally good runs, by length-weighted keys from a hash; a pool weighs as much as
        its runs together and gives the next of its order."""

        def key(r: RunState | Pool) -> tuple[float, str]:
            name, weight = (f"pool {r.factor}", r.weight) if isinstance(r, Pool) else (r.accession, r.avg_len)
            return weighted_key(f"{self.config.seed}:{step}:{name}", weight), name

        best = min(tied, key=key)
        if isinstance(best, Pool):
            best.first().profit = best.profit
            return best.first()
        return best

    def choose(self, step: int, expected: list[np.ndarray] = ()) -> RunState | None:
        """The run of largest profit; with batches in flight, over counts plus their expected gains.

        Profits only fall when gains are added, so runs are visited by falling old profit and
        the visit ends when no later one can win."""
        while self.queue:
            r = self.by.get(self.queue.popleft())
            if r is not None and self.is_open(r):
                pool = self.pools.get(self.factor(r))
                r.profit = pool.profit if pool and r.accession in pool.left else r.profit
                return r
        able = self.able()
        if not able:
            return None
        if not len(expected):
            best = max(r.profit for r in able)
            return self.draw([r for r in able if r.profit >= best - 1e-9], step)
        extra = np.zeros(len(self.model.x))
        for g in expected:
            extra[: len(g)] += g
        fresh: list[tuple[float, RunState | Pool]] = []
        top = -math.inf
        for r in sorted(able, key=lambda r: -r.profit):
            if r.profit < top - 1e-9:
                break
            fresh.append((self.profit_of(r, extra), r))
            top = max(top, fresh[-1][0])
        return self.draw([r for p, r in fresh if p >= top - 1e-9], step)

    def claim(self, r: RunState, step: int) -> tuple[int, int, int]:
        """(first batch, batches, last batch) of the run: neighbours join while the run stays best."""
        pool = self.pools.get(self.factor(r))
        if pool and pool.take(r):
            self.touched.append(r)
        order = r.visit_order(self.config.batch_size, self.config.seed)
        taken = set(order[: r.used])
        k = order[r.used]
        r.used += 1
        self.claimed += 1
        last = k
        budget = min(self.config.merge_batches, self.config.max_batches - self.claimed + 1)
        if budget > 1 and r.times and not r.bad:
            expected = [self.model.gain_of(self.model.distribution(r.own_counts()), self.reads_of(r))]
            while not self.queue and last - k + 1 < budget and last + 1 < r.batches(self.config.batch_size) and last + 1 not in taken:
                if self.choose(step, expected) is not r:
                    break
                last += 1
                order.remove(last)
                order.insert(r.used, last)
                r.used += 1
                self.claimed += 1
                expected.append(expected[0])
        return k, last - k + 1, last

    def measure(self, r: RunState, k: int, count: int) -> dict:
        """Fetch, gate and scan one batch; touches no state, so batches in flight may overlap."""
        c = self.config
        n, x = k * c.batch_size, min((k + count) * c.batch_size - 1, r.total_spots - 1)
        out = {"n": n, "x": x, "ok": False, "uniq": 0.0, "spliced": 0.0, "tiles": {}, "introns": []}
        aln = self.provider.fetch(r.accession, n, x)
        if aln is None:
            return out
        aln = aln.persist()
        out["uniq"] = quality.uniqueness_long(aln, c.least_mapq).first().uniq_pct
        out["ok"] = out["uniq"] >= c.least_unique_pct
        if out["ok"]:
            # one batch's tiles and junctions: bounded by the batch, not by the data
            out["tiles"] = {(t.chrom, t.tile_idx): float(t.n) for t in tiles.umr_per_tile(aln, c.tile_size).collect()}
            out["spliced"] = tiles.read_totals(aln).first().n_spliced
            out["introns"] = [tuple(i) for i in I.intron_multiset(aln).collect()]
        aln.unpersist()
        return out

    def apply(self, r: RunState, count: int, m: dict) -> None:
        """Add a measured batch to the state; any failure ends the run for good."""
        c, spots = self.config, m["x"] - m["n"] + 1
        if m["ok"] and not r.bad:
            umr_pct, spliced = 100 * sum(m["tiles"].values()) / spots, 100 * m["spliced"] / spots
            r.umr_pct += (umr_pct - r.umr_pct) * count / (r.times + count)
            r.spliced_pct += (spliced - r.spliced_pct) * count / (r.times + count)
            r.times += count
            self.useful = True
            for t, v in m["tiles"].items():
                r.counts[t] = r.counts.get(t, 0.0) + v
            self.model.add(m["tiles"])
            self.add_introns(m["introns"])
        r.bad |= not m["ok"]
        before, self.done = self.done, self.done + count
        self.timings.append({"batch": len(self.timings), "accession": r.accession, "n": m["n"], "x": m["x"], "n_batches": count, "db_version": self.db_version, "success": int(m["ok"]), "uniq_pct": m["uniq"], "score": self.model.score()})
        if c.trace_every and self.done // c.trace_every > before // c.trace_every:
            self.trace.append((self.done, self.model.score()))

    def add_introns(self, rows: list[tuple]) -> None:
        """Sum multiplicities.  The database gets a version only when a junction is new in it; the
        coordinate file is also refreshed every ``refresh_every`` batches, for its scores."""
        added = []
        for *key, mult in rows:
            key = tuple(key)
            before = self.introns.get(key, 0)
            self.introns[key] = before + mult
            if before < self.config.least_mult <= before + mult:
                added.append(key)
        if added:
            self.db_version += 1
            self.db_log += [(self.db_version, "+", "\t".join(map(str, k))) for k in sorted(added)]
            self.refreshes.append((self.done, "database"))
        if added or (self.config.refresh_every and len(self.timings) % self.config.refresh_every == self.config.refresh_every - 1):
            self.refreshes.append((self.done, "coordinates"))

    def intron_table(self, spark: SparkSession) -> DataFrame:
        """Junctions with the multiplicity that the splice database asks for."""
        rows = [(*k, m) for k, m in self.introns.items() if m >= self.config.least_mult]
        return spark.createDataFrame(rows, "chrom string, start long, end long, strand string, mult long")

    def run(self) -> int:
        """Exit code: 0, or 3 when no batch was usable."""
        if self.config.bootstrap:
            self.queue = deque(r.accession for r in self.runs)
        self.estimate()
        step = claimed = 0
        flying: list[tuple] = []
        with ThreadPoolExecutor(max(1, self.config.in_flight)) as pool:
            while True:
                while len(flying) < self.config.in_flight and claimed < self.config.max_batches:
                    r = self.choose(step, [f[3] for f in flying])
                    if r is None or (self.config.stop_without_profit and self.useful and r.profit <= 0):
                        break
                    k, count, _ = self.claim(r, step)
                    gain = self.model.gain_of(self.model.distribution(r.own_counts()), self.reads_of(r)) * count
                    flying.append((r, count, pool.submit(self.measure, r, k, count), gain))
                    claimed += count
                    step += 1
                if not flying:
                    break
                r, count, task, _ = flying.pop(0)  # the earliest one, so that timing changes nothing
                self.apply(r, count, task.result())
                self.estimate()
        return OK if self.useful else NO_DATA
