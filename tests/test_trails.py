"""Money trails, subsumption and the isolation forest on hand-made cases."""

import random
from datetime import timedelta

import numpy as np
import pytest

from tests.test_detectors import T0, txns
from tracewright.operators import forest, trails


@pytest.fixture
def chain(spark):
    hour = lambda n: T0 + timedelta(hours=n)
    rows = [
        ("A", "B", hour(0), 10000, 0),
        ("B", "C", hour(5), 9500, 0),
        ("B", "C", hour(6), 9900, 0),
        ("B", "shop", hour(500), 50, 0),
        ("C", "D", hour(9), 9000, 0),
        ("D", "A", hour(10), 10, 0),
        ("C", "B", hour(200), 1, 0),
    ]
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    return txns(spark, rows)


def test_forward_trail_takes_the_nearest_amount(spark, chain):
    found = {(r.path, r.seqs, r.terminal, r.loss) for r in trails.trails(chain, spark.createDataFrame([("A",)], "node string")).collect()}
    assert found == {("A>B>shop", "0", "EXTERNAL_COUNTERPARTY", 0.0), ("A>B>C>D", "0>2>4", "dead_end", 0.1)}


def test_backward_trail(spark, chain):
    found = {(r.path, r.terminal) for r in trails.trails(chain, spark.createDataFrame([("D",)], "node string"), forward=False).collect()}
    assert found == {("D>C>B>A", "dead_end")}


def test_no_roots_no_trails(spark, chain):
    assert trails.trails(chain, spark.createDataFrame([("nobody",)], "node string")).count() == 0


def test_subsets_of_chains_go(spark):
    chains = spark.createDataFrame([("A>B>C", "1>2"), ("A>B>C>D", "1>2>3"), ("X>Y>Z", "7>8"), ("X>Z>Y", "5>6")], "path string, seqs string")
    assert {r.path for r in trails.maximal_chains(chains).collect()} == {"A>B>C>D", "X>Y>Z"}


def test_chains_through_one_account_are_not_compared_in_pairs(spark):
    rng = random.Random(5)
    paths = {">".join(["hub", *rng.sample("ABCDEFGHIJ", rng.randint(2, 6))]) for _ in range(150)}
    rows = [(path, str(k)) for k, path in enumerate(sorted(paths)) for k in (k, k + 1000)]
    found = trails.maximal_chains(spark.createDataFrame(rows, "path string, seqs string"))
    of = lambda chain: set(chain[0].split(">"))
    plain = {a for a in rows if not any(of(a) < of(b) or of(a) == of(b) and b < a for b in rows)}
    assert {tuple(r) for r in found.collect()} == plain
    many = spark.range(100_000).selectExpr("concat('hub>sub>', id, '>end') AS path", "cast(id AS string) AS seqs")
    assert trails.maximal_chains(many).count() == 100_000


def test_forest_ranks_an_outlier_first(spark):
    rng = np.random.default_rng(1)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(400, 2)))] + [(400, 9.0, -9.0), (401, float("nan"), None)]
    table = spark.createDataFrame(rows, "seq long, a double, b double")
    model = forest.fit(table, "seq", ["a", "b"], trees=50)
    flagged = forest.flag(forest.score(table, "seq", model), 0.01)
    top = flagged.orderBy("score", ascending=False).first()
    assert (top.seq, top.tier, top.is_flagged, flagged.count()) == (400, "Critical", True, 402)
    assert forest.score(table.repartition(3), "seq", forest.fit(table.repartition(3), "seq", ["a", "b"], trees=50)).filter("seq = 400").first().raw == forest.score(table, "seq", model).filter("seq = 400").first().raw


def test_empty_table_has_an_empty_forest(spark):
    table = spark.createDataFrame([], "seq long, a double")
    assert forest.flag(forest.score(table, "seq", forest.fit(table, "seq", ["a"], trees=3))).count() == 0
