import pytest

from strandloom.plans import formats, queries, stored  # noqa: F401
from strandloom.plans.registry import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(df):
    cols = sorted(df.columns)
    rows = df[cols].astype(object).where(df[cols].notna(), None).values.tolist()
    return sorted([tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows], key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DATA).toPandas()
    if name in ORACLES:
        assert plain(got) == plain(duck.sql(ORACLES[name]).df())


def test_greedy_full_picks_beyond_twenty(spark):
    picks = QUERIES["greedy_full"](spark, "/root/testdata/sf0.01").collect()
    assert len(picks) > 50 and [r.rank for r in picks] == list(range(1, len(picks) + 1)) and len({r.acc for r in picks}) == len(picks)
