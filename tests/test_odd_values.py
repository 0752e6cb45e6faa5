"""Values that the smallest tables do not hold: zeros, negatives, unknown and infinite ones."""

import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from larkspan.functions import scalar as s
from larkspan.operators import agreement
from larkspan.plans.more import ORACLE, QUERIES
from tests.oracle import TABLES, differences

SMALL = "/root/testdata/sf0.001"
CASES = {
    "zeros": "CASE WHEN event_id % 7 = 0 THEN 0.0 WHEN event_id % 97 = 1 THEN -0.0 ELSE value END",
    "unknown": "CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_type = 'click' THEN NULL ELSE value END",
    "negative": "CASE WHEN event_id % 11 = 0 THEN -value ELSE value END",
    "mostly_zeros": "CASE WHEN event_id % 3 > 0 THEN 0.0 ELSE value END",
    "infinite": "CASE WHEN event_id % 13 = 0 THEN 'inf'::DOUBLE WHEN event_id % 13 = 1 THEN 'nan'::DOUBLE ELSE value END",
    "tiny_and_huge": "CASE WHEN event_id % 9 = 0 THEN 5e-324 WHEN event_id % 9 = 1 THEN 1e308 ELSE value END",
    "no_baseline": "CASE WHEN event_type = 'view' THEN NULL ELSE value END",
}


def tables(at, value):
    for t in TABLES:
        if t != "events":
            os.symlink(f"{SMALL}/{t}.parquet", at / f"{t}.parquet")
    duckdb.connect().execute(f"COPY (SELECT * REPLACE ({value} AS value) FROM '{SMALL}/events.parquet') TO '{at}/events.parquet' (FORMAT parquet)")
    return str(at)


@pytest.mark.parametrize("case", list(CASES))
@pytest.mark.parametrize("name", ["residual_report", "pitch_scalars"])
def test_odd_values_give_the_rows_of_the_sql(spark, tmp_path, name, case):
    assert differences(spark, tables(tmp_path, CASES[case]), QUERIES[name], ORACLE[name]) is None


def test_residual_report_counts_zeros(spark):
    rows = spark.createDataFrame([("a", v) for v in (0.0, 0.0, 1.0, 2.0, 4.0)] + [("b", 0.0)], "s string, value double")
    base = spark.createDataFrame([(v,) for v in (0.0, 1.0, 2.0)], "value double")
    got = {r.s: r for r in agreement.residual_report(rows, base, "value", "s").collect()}
    assert got["a"].median == 1.0 and got["a"].n == 5 and got["a"].z == 0
    assert got["b"].median == 0 and got["b"].z == -math.inf and not got["b"].flagged
    none = agreement.residual_report(rows, base.where(F.col("value") < 0), "value", "s").collect()
    assert len(none) == 2 and all(r.z is None and r.flagged is None for r in none)


def test_cents_of_zero_and_below(spark):
    hz = spark.createDataFrame([(0, 0.0), (1, -1.0), (2, None), (3, 440.0), (4, math.inf)], "i int, hz double")
    cents = s.hz_to_cents("hz")
    got = {r.i: (r.c, r.f) for r in hz.select("i", cents.alias("c"), s.fold_octave(cents).alias("f")).collect()}
    assert got[0][0] == -math.inf and math.isnan(got[0][1])
    assert math.isnan(got[1][0]) and math.isnan(got[1][1])
    assert got[2] == (None, None) and got[3] == (0.0, 0.0)
    assert got[4][0] == math.inf and math.isnan(got[4][1])
