"""Registered account queries on small tables of events."""

import json
from datetime import timedelta

import pytest

from tests.test_detectors import T0
from tracewright.plans import catalog

KEYS = "event_id long, user_id long, event_type string, value double, ts timestamp_ntz, props string"


@pytest.fixture
def query(spark, tmp_path):
    """Runs a query on rows (account, counterparty, hours, amount; below 0 is received)."""

    def run(name, rows):
        data = [(i, a, "purchase" if v > 0 else "refund", abs(v) / 1000, T0 + timedelta(hours=h), json.dumps({"k": b})) for i, (a, b, h, v) in enumerate(rows)]
        spark.createDataFrame(data, KEYS).write.mode("overwrite").parquet(f"{tmp_path}/events.parquet")
        return catalog.queries()[name](spark, str(tmp_path)).collect()

    return run


def name(*accounts):
    return ">".join(f"ACC{a:06}" for a in accounts)


CHAIN = [(1, 2, 0, 50000.0), (2, 3, 48, 49000.0), (3, 4, 120, 48000.0), (4, 9, 400, 10.0), (4, 1, 600, 20.0)]


def test_graph_queries_follow_small_payments(query):
    rows = [(1, 2, 0, 5.0), (2, 3, 1, 20000.0), (3, 4, 2, 7.0), (7, 8, 3, 9000.0), (8, 9, 4, -50000.0)]
    least = {1: 1, 2: 1, 3: 1, 4: 1, 7: 7, 8: 7}
    assert {(r.node, r.component) for r in query("wcc", rows)} == {(name(a), name(b)) for a, b in least.items()}
    assert {(r.node, r.hop) for r in query("ego_graph", rows)} == {(name(1), 0), (name(2), 1), (name(3), 2)}


def test_hops_of_up_to_three_days_are_followed(query):
    assert [(r.account_id, r.hops, r.chains, r.least_skim) for r in query("layering", CHAIN)] == [(name(1), 3, 1, 0.04)]
    quick = [(a, b, h / 20, v) for a, b, h, v in CHAIN]
    assert {r.path for r in query("layering_maximal", quick)} == {name(1, 2, 3, 4)} and not query("layering_maximal", CHAIN)
    assert name(1, 2, 3, 4) in {r.path for r in query("money_trail_forward", CHAIN)}


def test_all_flags_reach_the_score(query):
    trip = [(5, 6, 0, 10000.0), (5, 6, 48, -9000.0), (6, 5, 700, 1.0)]
    outlier = [(7, 20, 30 * i, 100.0 + i) for i in range(1, 10)] + [(7, 20, 400, 9000.0)]
    got = {r.account_id: r for r in query("risk_scores", CHAIN + trip + outlier)}
    flagged = lambda flag: {a for a, r in got.items() if flag in r.active_patterns.split(" | ")}
    assert flagged("LAYERING") == {name(a) for a in (1, 2, 3, 4)}
    assert flagged("ROUND_TRIP") == {name(5), name(6)}
    assert flagged("HIGH_VALUE") == {name(7)}
    # Of the rows whose movement the made-up balance drops (every seventh), 14 has an earlier one of its account.
    assert flagged("BALANCE_BREACH") == {name(7)}
    assert got[name(6)].score == 20.0 + 5.0
    assert got[name(9)].active_patterns == "NONE" if name(9) in got else True


def test_blank_counterparties_are_no_peers(query):
    rows = [(1, b, 1 + h, 9000.0) for h, b in enumerate(["2", "3", "4", "5"])]
    assert [r.peers for r in query("fan_out", rows)] == [4]
