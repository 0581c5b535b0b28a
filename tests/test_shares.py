"""Exact sums of shares of any denominators."""

import random
from datetime import date, timedelta
from fractions import Fraction

from pyspark.sql import functions as F

from groundledger.functions.shares import shares_whole
from groundledger.operators.intervals import whole_at_pivots
from groundledger.operators.validation import validation_findings, whole_shares

PRIMES = (999_983, 999_979, 999_961, 999_959, 999_953)


def exact(shares):
    return sum((Fraction(x) for x in shares), Fraction(0)) == 1


def five(rest):
    """Four shares over primes near a million, and the fifth that makes them one, or almost."""
    first = [Fraction(200_000 + k, p) for k, p in enumerate(PRIMES[:4])]
    last = 1 - sum(first) + (0 if rest else Fraction(1, 10**40))
    return [f"{x.numerator}/{x.denominator}" for x in (*first, last)]


def test_arrays_of_shares(spark):
    cases = [five(True), five(False), [f"1/{p}" for p in PRIMES], ["1/2", "01 / 02"], ["1"], ["1", "0/5"], [], ["1/0"], ["x"], [None], ["1/3", "1/3", "1/3"], ["9" * 50 + "/" + "9" * 50], None, ["१/२", "1/2"]]
    found = [r.w for r in spark.createDataFrame([(k, c) for k, c in enumerate(cases)], "k int, shares array<string>").orderBy("k").select(shares_whole("shares").alias("w")).collect()]
    assert found == [True, False, False, True, True, True, False, None, None, None, True, True, None, None]


def test_five_primes_are_not_malformed(spark):
    columns = "deed_id int, VILLAGE string, KHASRA string, KHATA string, AREA string, AREA_UNIT string, DATE string, MUTATION string, shares array<string>, declared_khasra string, previous_area double"
    plain = ("v", "1", "2", "3", "BIGHA", "2001-01-01", None)
    rows = [(1, *plain, five(True), None, None), (2, *plain, five(False), None, None), (3, *plain, ["1/2", "half"], None, None)]
    found = {(r.deed_id, r.rule) for r in validation_findings(spark.createDataFrame(rows, columns), F.lit("2002-01-01").cast("date")).collect()}
    assert found == {(2, "SHARES_DO_NOT_TOTAL_ONE"), (3, "MALFORMED_SHARE")}


def test_shares_over_time(spark):
    rng = random.Random(4)
    day = date(2000, 1, 1)
    rows = [("big", day, None, s) for s in five(True)] + [("near", day, day + timedelta(9), s) for s in five(False)]
    rows += [("p", day, None, "1/1"), ("q", day, day, "1/2"), ("q", day, None, "1/2"), ("q", day + timedelta(1), None, "3/6"), ("r", day, None, "bad"), ("s", day + timedelta(3), day, "1/1")]
    for key in "abcdefgh":
        for _ in range(12):
            start = day + timedelta(rng.randrange(6))
            rows.append((key, start, rng.choice([None, start + timedelta(rng.randrange(5))]), f"{rng.randrange(1, 4)}/{rng.choice([2, 3, 4, 7, 12, *PRIMES])}"))
    frame = spark.createDataFrame(rows, "k string, valid_from date, valid_to date, share string").repartition(3)
    found = {(r.k, r.pivot): r.whole for r in whole_at_pivots(frame, "k", "share").collect()}
    good = [r for r in rows if r[3] != "bad" and (r[2] is None or r[2] >= r[1])]
    want = {(k, at): exact(s for q, a, b, s in good if q == k and a <= at and (b is None or b >= at)) for k, at, _, _ in good}
    assert found == want and want["big", day] and not want["near", day] and want["q", day + timedelta(1)]


def test_shares_of_a_parcel_are_summed_before_documents_meet_them(spark):
    rows = [("one", x) for x in five(True)] + [("more", x) for x in five(False)] + [("many", "1/60000")] * 60_000 + [("bad", "1/2"), ("bad", "half"), ("none", None), ("null", None), ("null", "1")]
    found = {r.k: (r.some_shares, r.whole) for r in whole_shares(spark.createDataFrame(rows, "k string, share string").repartition(3), "k").collect()}
    assert found == {"one": (True, True), "more": (True, False), "many": (True, True), "bad": (True, None), "null": (True, True)}


def test_findings_carry_no_list_of_shares(spark):
    """each document held all shares of its parcel, so their number grew with the square of the tables."""
    from groundledger.plans.land_rules import x01_validation_findings

    plan = x01_validation_findings(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    joined = plan[: plan.index("Join ")]
    assert "some_shares" in plan and "array<string>" not in joined and "shares#" not in plan.replace("some_shares#", "")
