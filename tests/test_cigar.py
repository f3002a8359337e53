import pytest
from pyspark.sql import functions as F

from strandloom.functions import cigar as C

#: CIGAR at position 100 and the introns that pass the hint rules.
CASES = [
    ("20M100N20M", [(121, 220)]),
    ("7M100N20M", []),
    ("20M100N7M", []),
    ("8M100N8M", [(109, 208)]),
    ("20M100N3M100N20M", [(121, 220), (224, 323)]),
    ("20M10D20M100N20M", [(151, 250)]),
    ("20M14N20M", []),
    ("20M20D20M100N20M", []),
    ("20M31N20M", []),
    ("20M32N20M", [(121, 152)]),
    ("20M40D20M", [(121, 160)]),
    ("20M350000N20M", [(121, 350120)]),
    ("20M350001N20M", []),
    ("20M6I100N20M", []),
    ("20M5I100N20M", [(121, 220)]),
    ("5S20M100N20M3H", [(121, 220)]),
    ("10=10X100N20M", [(121, 220)]),
    ("10M2I10M100N20M", [(121, 220)]),
    ("20M200000N20M200000N20M", []),
    ("40M", []),
]


def test_hint_rules(spark):
    rows = spark.createDataFrame([(k, c) for k, (c, _) in enumerate(CASES)], "k int, cigar string")
    got = rows.select("k", C.hint_introns(F.lit(100).cast("long"), C.operations(F.col("cigar"))).alias("h")).collect()
    for r in got:
        assert [(x.start, x.end) for x in r.h] == CASES[r.k][1], CASES[r.k]


@pytest.mark.parametrize("cigar,introns,span,aligned", [("30M200N30M", [(130, 329)], 260, 60), ("5S10M2I3D4M6N7M", [(117, 122)], 30, 23), ("*", None, None, None)])
def test_walk(spark, cigar, introns, span, aligned):
    ops = C.operations(F.col("c"))
    r = spark.createDataFrame([(cigar,)], "c string").select(C.introns(F.lit(99).cast("long"), ops).alias("i"), C.reference_span(ops).alias("s"), C.aligned_query(ops).alias("a"), C.is_spliced(ops).alias("n")).first()
    assert (None if r.i is None else [(x.start, x.end) for x in r.i]) == introns
    assert (r.s, r.a) == (span, aligned)
    assert r.n == bool(introns)
