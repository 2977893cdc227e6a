"""Detectors and checks on hand-made cases."""

import random
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tracewright.functions import parsing
from tracewright.operators import cleaning, detectors, evaluation, features

T0 = datetime(2024, 1, 1)


def txns(spark, rows):
    """rows: (account, node, time, debit, credit)."""
    data = [(i, a, n, t, Decimal(str(d)), Decimal(str(c))) for i, (a, n, t, d, c) in enumerate(rows)]
    df = spark.createDataFrame(data, "seq long, account_id string, node string, ts timestamp_ntz, debit decimal(18,2), credit decimal(18,2)")
    return df.withColumn("t", F.unix_micros(F.col("ts").cast("timestamp"))).withColumn("amount", F.greatest("debit", "credit"))


def test_fan_out_window_is_inclusive(spark):
    rows = [("A", "B", T0 + timedelta(hours=10), 6000, 0), ("A", "C", T0 + timedelta(hours=12), 6000, 0), ("A", "D", T0 + timedelta(hours=33), 5000, 0), ("A", "E", T0 + timedelta(hours=58), 5000, 0)]
    (r,) = detectors.fan_out(txns(spark, rows)).collect()
    assert (r.peers, r.total, r.txns, r.severity) == (4, 22000.0, 4, "HIGH")
    rows[-1] = ("A", "E", T0 + timedelta(hours=58, seconds=1), 5000, 0)
    assert detectors.fan_out(txns(spark, rows)).count() == 0


def test_smurfing_band(spark):
    rows = [("A", "B", T0, 35000, 0), ("A", "C", T0 + timedelta(days=3), 49999.99, 0), ("A", "B", T0 + timedelta(days=14), 40000, 0), ("A", "D", T0, 50000, 0), ("A", "D", T0, 34999.99, 0)]
    (r,) = detectors.smurfing(txns(spark, rows)).collect()
    assert (r.txns, r.peers, r.total) == (3, 2, 124999.99)


def test_round_trip_bounds(spark):
    rows = [("A", "B", T0, 10000, 0), ("A", "B", T0, 0, 8000), ("A", "B", T0 + timedelta(days=4), 0, 5000), ("A", "B", T0 + timedelta(days=30), 0, 7000)]
    (r,) = detectors.round_trips(txns(spark, rows)).collect()
    assert (r.ratio, r.gap_days, r.severity) == (0.7, 30.0, "MEDIUM")


def test_burst_flags_every_member(spark):
    rows = [("A", "B", T0 + timedelta(minutes=m), 10, 0) for m in (1, 11, 26, 41)]
    assert detectors.bursts(txns(spark, rows)).count() == 4


def test_layering_follows_no_cycle(spark):
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    rows = [("A", "B", T0, 50000, 0), ("B", "C", T0 + timedelta(hours=72), 48000, 0), ("C", "D", T0 + timedelta(hours=73), 46000, 0), ("D", "A", T0 + timedelta(hours=74), 45000, 0)]
    found = {r.path: (r.hops, r.skim) for r in detectors.layering(txns(spark, rows)).collect()}
    assert found["A>B>C>D"] == (3, 0.08) and set(found) == {"A>B>C>D", "B>C>D>A"}


def test_chains_are_counted_as_they_are_listed(spark):
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    rng = random.Random(4)
    rows = [(f"A{rng.randrange(14)}", f"A{rng.randrange(8)}", T0 + timedelta(hours=rng.choice([0, 24, 72, 96, 100, 144, 168, 216, 240])), rng.choice([9999.99, 10000, 20000, 30000.01]), 0) for _ in range(90)]
    table = txns(spark, rows + [rows[0], ("A9", "A9", T0, 50000, 0)])
    start = F.substring_index("path", ">", 1)
    listed = detectors.layering(table).groupBy(start.alias("account_id"), "hops", "severity").agg(F.count(F.lit(1)).alias("chains"), F.min("skim").alias("least_skim"), F.max("skim").alias("most_skim"))
    counted = detectors.layering_counts(table)
    assert counted.dtypes == listed.dtypes and set(counted.collect()) == set(listed.collect()) and counted.count() > 20
    assert detectors.layering_counts(table.limit(0)).count() == 0


def test_sixty_million_chains_are_counted(spark):
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    rows = [(f"S{i}", "H", T0, 20000, 0) for i in range(6000)] + [("H", f"1.{i}", T0 + timedelta(hours=1), 20000, 0) for i in range(10)]
    rows += [(f"{k}.{i}", f"{k + 1}.{j}", T0 + timedelta(hours=k + 1), 20000, 0) for k in (1, 2, 3) for i in range(10) for j in range(10)]
    got = detectors.layering_counts(txns(spark, rows)).groupBy("hops").agg(F.sum("chains").alias("n")).collect()
    assert {r.hops: r.n for r in got} == {3: 600_000 + 1000 + 10_000, 4: 6_000_000 + 10_000, 5: 60_000_000}


def test_velocity_leaves_out_the_row_and_later_ties(spark):
    rows = [("A", "B", T0, 100, 0), ("A", "B", T0 + timedelta(hours=24), 50, 0), ("A", "B", T0 + timedelta(hours=24), 25, 0)]
    got = [(r.sum_24h, r.n_24h) for r in features.velocity(txns(spark, rows), [24]).orderBy("seq").collect()]
    assert got == [(0.0, 0), (100.0, 1), (150.0, 2)]


def test_balance_breach_and_suspect(spark):
    rows = txns(spark, [("A", "", T0, 0, 0), ("A", "", T0 + timedelta(1), 0, 50), ("A", "", T0 + timedelta(2), 20, 0), ("A", "", T0 + timedelta(3), 0, 0)])
    seen = rows.withColumn("balance", F.element_at(F.array(*map(F.lit, (100, 150, 131, 140))), (F.col("seq") + 1).cast("int")).cast("decimal(18,2)"))
    checked = cleaning.balance_breaches(seen)
    assert [r.seq for r in checked.filter("is_breach").collect()] == [3]
    (s,) = cleaning.suspects(checked).collect()
    assert (s.ratio, s.severity) == (0.25, "MEDIUM")


def test_iqr(spark):
    rows = txns(spark, [("A", "", T0, 100 + 10 * i, 0) for i in range(9)] + [("A", "", T0, 5000, 0)])
    (r,) = cleaning.iqr_outliers(rows).collect()
    assert (r.side, r.amount, r.fence) == ("DEBIT", 5000.0, 302.5)


def test_beneficiary(spark):
    got = {r.node: r for r in detectors.beneficiaries(txns(spark, [("A", "B", T0, 100, 0), ("A", "C", T0, 100, 0), ("A", "D", T0, 400, 0)])).collect()}
    assert (got["D"].z, got["D"].is_new_high_value, got["D"].is_high_value) == (1.414, True, False)
    assert (got["B"].z, got["B"].is_new_high_value) == (-0.707, False)


def test_beneficiary_by_single_payments(spark):
    """The largest payment counts, not a total, and against the account's debit rows; blank counterparties have no row but count there."""
    paid = [("A", "B", T0, 100, 0)] * 10 + [("A", "C", T0, 800, 0), ("A", "", T0, 1000, 0), ("Z", "B", T0, 5, 0)]
    got = {(r.account_id, r.node): r for r in detectors.beneficiaries(txns(spark, paid)).collect()}
    assert set(got) == {("A", "B"), ("A", "C"), ("Z", "B")}
    assert (got["A", "B"].z, got["A", "C"].z, got["Z", "B"].z) == (-0.443, 1.883, 0.0)  # mean 233.33, spread 300.92
    assert [got[k].is_new_high_value for k in sorted(got)] == [False, True, True]


def test_rows_without_a_time_are_no_burst(spark):
    midnight = T0.replace(hour=0, minute=0, second=0)
    assert not detectors.bursts(txns(spark, [("A", "B", midnight, 10, 0)] * 4)).collect()
    assert len(detectors.bursts(txns(spark, [("A", "B", midnight + timedelta(minutes=1), 10, 0)] * 4)).collect()) == 4


def test_pairs_of_empty_balances_are_no_breach(spark):
    rows = txns(spark, [("A", "", T0, 0, 0), ("A", "", T0 + timedelta(1), 0, 50), ("A", "", T0 + timedelta(2), 0, 70)])
    seen = rows.withColumn("balance", F.element_at(F.array(*map(F.lit, (0, 0, 9))), (F.col("seq") + 1).cast("int")).cast("decimal(18,2)"))
    assert [r.seq for r in cleaning.balance_breaches(seen).filter("is_breach").collect()] == [2]


def test_iqr_of_both_sides(spark):
    """Credits are fenced as debits are; an account of equal debits has no fence."""
    rows = txns(spark, [("A", "", T0, 0, 100 + 10 * i) for i in range(9)] + [("A", "", T0, 0, 5000)] + [("B", "", T0, 100, 0)] * 9 + [("B", "", T0, 900, 0)])
    assert [(r.account_id, r.side, r.amount) for r in cleaning.iqr_outliers(rows).collect()] == [("A", "CREDIT", 5000.0)]


def test_areas_of_scores_that_differ_late(spark):
    rows = [(0.12341, 1), (0.12342, 0), (0.12343, 1), (0.9, 1), (0.1, 0)]
    r = evaluation.areas(spark.createDataFrame(rows, "score double, label long")).first()
    assert (r.roc_auc, r.average_precision) == (0.833333, 0.916667)


@pytest.mark.parametrize(("raw", "value", "sign"), [("5,195.00Cr", 5195, "+"), ("(1,234.50)", 1234.5, "-"), ("-500", 500, "-"), ("Dr 20.00", 20, "-"), ("Rs. 75.50", 75.5, ""), ("nil", 0, ""), ("12.3.4", 0, ""), ("$100", 100, ""), ("75.50/-", 75.5, ""), ("1,200.00 *", 1200, ""), ("INR 5.00 only", 5, "")])
def test_amounts(spark, raw, value, sign):
    r = spark.createDataFrame([(raw,)], "x string").select(parsing.amount_value(F.col("x")).alias("v"), parsing.amount_sign(F.col("x")).alias("s")).first()
    assert (float(r.v), r.s) == (value, sign)


@pytest.mark.parametrize(("raw", "day"), [("05/03/2024", "2024-03-05"), ("23-FEB- 2025", "2025-02-23"), ("15/05/25 10:20", "2025-05-15"), ("O5/03/2024", "2024-03-05"), ("12/25/2024", "2024-12-25"), ("31/02/2024", "")])
def test_dates(spark, raw, day):
    assert spark.createDataFrame([(raw,)], "x string").select(parsing.parse_date(F.col("x")).alias("d")).first().d == day


def test_average_precision(spark):
    scored = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.7, 1), (0.6, 0)], "score double, label long")
    r = evaluation.areas(scored).first()
    assert (r.average_precision, r.roc_auc) == (0.833333, 0.75)


def test_windows_of_a_busy_account_against_brute_force(spark):
    import random

    from tracewright.config import HOUR

    draw = random.Random(5)
    rows = [(draw.choice("AB"), draw.choice(["p", "q", "r", "s", " ", None]), draw.randrange(0, 400) * HOUR, i, Decimal(draw.randrange(1, 9))) for i in range(150)]
    for width, peers, txns, total in [(10 * HOUR, 3, 1, 10), (72 * HOUR, 4, 20, 60), (HOUR, 2, 2, 5), (1000 * HOUR, 5, 1, 0)]:
        want = {}
        for account in "AB":
            mine = sorted((r for r in rows if r[0] == account), key=lambda r: (r[2], r[3]))
            for _, _, t, _, _ in mine:
                inside = [r for r in mine if t <= r[2] <= t + width]
                n = len({r[1] for r in inside if r[1] and r[1].strip()})
                if n >= peers and len(inside) >= txns and sum(r[4] for r in inside) >= total:
                    want[account] = (n, len(inside), float(sum(r[4] for r in inside)))
                    break
        df = spark.createDataFrame(rows, "account_id string, node string, t long, seq long, amount decimal(18,2)")
        got = {r.account_id: (r.peers, r.txns, r.total) for r in detectors.anchored(df, width, peers, txns, total, 9).collect()}
        assert got == want, width
