"""The synthetic ledger, case files, label reports and the forest's saved form."""

import numpy as np
from pyspark.sql import functions as F

from tracewright.operators import cases, evaluation, forest, synthetic


def test_ledger_balances(spark):
    people = synthetic.population(spark, 200).cache()
    assert people.filter("is_fraud").count() == 14
    events = synthetic.legitimate(people, "2024-01-01", 2).unionByName(synthetic.fraudulent(people, "2024-01-01"))
    book = synthetic.ledger(people, events).cache()
    assert book.count() == book.select("transaction_id").distinct().count() > 2000
    opening = {r.account_id: r.opening_balance for r in people.collect()}
    for account, rows in book.orderBy("account_id", "transaction_id").toPandas().groupby("account_id"):
        balance = opening[account]
        for r in rows.itertuples():
            balance += r.credit - r.debit
            assert balance == r.balance, account
            assert r.channel != "UPI" or balance >= 100
    pairs = book.filter("utr_ref LIKE 'UTR%'").groupBy("utr_ref").agg(F.sum("debit").alias("d"), F.sum("credit").alias("c"), F.count("*").alias("n")).collect()
    assert pairs and all(p.n == 2 and p.d == p.c for p in pairs)
    assert synthetic.ledger(people, events.repartition(7)).exceptAll(book).count() == 0
    assert synthetic.ring_summary(people).count() == 2


def test_cases(spark):
    log = spark.createDataFrame([("c1", 1, "open", "a", False), ("c1", 2, "closed", "a", False), ("c2", 1, "open", "b", False), ("c3", 1, "open", "c", False), ("c3", 2, "open", "c", True)], "case_id string, version long, status string, note string, is_deleted boolean")
    assert {(r.case_id, r.status) for r in cases.latest(log).collect()} == {("c1", "closed"), ("c2", "open")}
    more = cases.change(log, spark.createDataFrame([("c2", "closed")], "case_id string, status string"))
    assert [tuple(r) for r in more.collect()] == [("c2", 2, "closed", "b", False)]
    assert {(r.case_id, r.status) for r in cases.latest(log.unionByName(more)).collect()} == {("c1", "closed"), ("c2", "closed")}
    txns = spark.createDataFrame([("A", "Bob", "2024-01-01", "10:00:00", "UPI", "FOOD", 50.0, 0.0, 1), ("A", "Ann", "2024-01-02", "10:00:00", "ATM", "CASH", 0.0, 500.0, 2)], "account_id string, counterparty_name string, date string, time string, channel string, narration string, debit double, credit double, seq long")
    assert [r.seq for r in cases.search(txns, account="A").collect()] == [2, 1]
    assert [r.seq for r in cases.search(txns, channel="atm", least=100, text="cash", start="2024-01-02").collect()] == [2]
    assert [r.seq for r in cases.page(cases.search(txns), 2, 1).collect()] == [1]


def test_label_reports(spark):
    d = spark.createDataFrame([("R1", "mule", "x", True, True, 0.9), ("R1", "origin", "x", True, False, 0.1), (None, "none", "y", False, True, 0.8), (None, "none", "y", False, False, 0.2), (None, "none", "z", None, False, 0.2)], "ring_id string, role string, persona string, is_fraud boolean, detected boolean, max_score double")
    (r,) = evaluation.rings(d).collect()
    assert tuple(r) == ("R1", 2, 1, 50.0, 0.5, "mule, origin")
    assert {(p.persona, p.accounts, p.false_alarms, p.false_alarm_pct) for p in evaluation.personas(d).collect()} == {("y", 2, 1, 50.0), ("z", 1, 0, 0.0)}
    scores = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.7, 1), (0.6, 0)], "score double, label long")
    assert tuple(evaluation.best_threshold(scores).first()) == (0.7, 0.8)
    assert [t.n for t in evaluation.tier_counts(spark.createDataFrame([("Low",), ("Low",)], "tier string")).orderBy("place").collect()] == [0, 2, 0, 0, 0]


def test_forest_saved_and_importance(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(i, float(rng.normal()), 1.0, int(i < 5)) for i in range(400)]
    rows = [(i, a + 20 * y, b, y) for i, a, b, y in rows]
    table = spark.createDataFrame(rows, "seq long, a double, b double, label long").cache()
    model = forest.fit(table, "seq", ["a", "b"], trees=20, rows=64)
    forest.save(model, spark, str(tmp_path / "m"))
    again = forest.load(spark, str(tmp_path / "m"))
    assert sorted(forest.score(table, "seq", model).collect()) == sorted(forest.score(table, "seq", again).collect())
    shares = forest.importance(table, "seq", model, repeats=1)
    assert shares[0][0] == "a" and shares[0][1] == 1.0 and shares[1] == ("b", 0.0)
    setting, found = forest.grid_search(table, "seq", ["a", "b"], table.select("seq", "label"), [{"trees": 1, "rows": 2}, {"trees": 20, "rows": 64}])
    assert setting == {"trees": 20, "rows": 64} and found > 0.9
