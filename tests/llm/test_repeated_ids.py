"""Near-dedup where rows share ids, lack them, or repeat, against brute force over rows."""

import itertools
import random
from collections import Counter

import pytest

from strandloom.llm import near_dedup

SCHEMA = "doc_id long, text string, rep long, comp string, row string, i0 long, k1 string, times int, body string"
WORDS = [a + b for a in "kmprst" for b in ("a", "ol", "in", "er")]


def rows_of(seed, ids):
    rnd = random.Random(seed)
    rows = []
    for _ in range(14):
        words = [rnd.choice(WORDS) for _ in range(rnd.randrange(40, 90))]
        for _ in range(rnd.randrange(1, 5)):
            other = list(words)
            for _ in range(rnd.randrange(3)):
                other[rnd.randrange(len(other))] = f"x{rnd.randrange(9)}"
            rows.append((ids(rnd), " ".join(other)))
    rows += [rows[0], rows[0], (None, rows[3][1]), (None, "a text of its own without an id"), (None, None), (7, ""), (7, " \n"), (7, None), (7, ""), (3, "one")]
    return rows


def components(rows, size):
    sets = []
    for _, text in rows:
        w = (text or "").lower().split()
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set()))
    name = list(range(len(rows)))
    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and name[a] != name[b]:
            name = [name[a] if n == name[b] else n for n in name]
    groups = {}
    for k, n in enumerate(name):
        groups.setdefault(n, []).append(k)
    return sets, list(groups.values())


@pytest.mark.parametrize("ids", [lambda rnd: rnd.randrange(6), lambda rnd: rnd.choice([-(2**63), 2**63 - 1, 5]), lambda rnd: rnd.choice([2**63 - 1, 5, 6])])
def test_rows_of_one_id_are_different_documents(spark, ids):
    rows = rows_of(3, ids)
    df = spark.createDataFrame([(*r, 1, "c", "r", 2, "k", 3, "b") for r in rows], SCHEMA).repartition(3)
    sets, groups = components(rows, 2)
    want = Counter()
    for g in groups:
        low = min((rows[k][0] for k in g if rows[k][0] is not None), default=None)
        want.update((rows[k][0], len(sets[k]), low, rows[k][0] == low) for k in g)
    got = near_dedup.near_duplicates(df, size=2).collect()
    assert Counter(tuple(r) for r in got) == want


def test_stage_keeps_a_row_of_each_group(spark):
    rows = rows_of(5, lambda rnd: rnd.randrange(6))
    df = spark.createDataFrame([(*r, 1, "c", "r", 2, "k", 3, "b") for r in rows], SCHEMA).repartition(3)
    sets, groups = components(rows, 5)
    kept = near_dedup.stage(spark, df, "")
    assert kept.columns == df.columns
    left = Counter((r.doc_id, r.text) for r in kept.collect())
    for g in groups:
        own = [(rows[k][0], rows[k][1]) for k in g]
        if sets[g[0]]:
            here = [x for x in set(own) if left[x]]
            assert len(here) == 1 and left[here[0]] == 1
            ids = [d for d, _ in own if d is not None]
            assert here[0][0] == (min(ids) if ids else None)
            del left[here[0]]
    assert left == Counter((rows[k][0], rows[k][1]) for g in groups for k in g if not sets[k])
