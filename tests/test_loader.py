"""Files for the models, cleaning of cells, labels and what a run leaves behind."""

import json

import pytest
from pyspark.sql import functions as F

from tracewright.functions import parsing
from tracewright.operators import cases, cleaning, evaluation
from tracewright.sources import loader, reports


def test_clean_amounts(spark):
    cells = {"(1,234.50)": ("1234.50", "-1234.50"), "₹ 75": ("75.00", "75.00"), "10.00Dr": ("10.00", "-10.00"), "CR 5": ("5.00", "5.00"), "d 5.5": ("5.50", "-5.50"), "-3": ("3.00", "-3.00"), "nil": ("0.00", "0.00"), "1.2.3": ("1.23", "1.23"), "INR 2 only": ("2.00", "2.00"), "words": ("0.00", "0.00"), "": ("0.00", "0.00"), ".5": ("0.50", "0.50"), None: ("0.00", "0.00")}
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    got = df.select("c", parsing.clean_amount(F.col("c")).cast("string").alias("a"), parsing.clean_amount(F.col("c"), True).cast("string").alias("b"), parsing.is_corrected(F.col("c")).alias("k")).collect()
    assert {r.c: (r.a, r.b) for r in got} == cells
    assert {r.c for r in got if not r.k} == {"nil", "words", "", None, ".5"}


def test_moments(spark):
    rows = [("05/03/2024", "10:20"), ("2024-03-05", "9:05:07 pm"), ("05-Mar-2024", "12:01 AM"), ("05/03/2024", "25:00"), ("05/03/2024", None), ("soon", "10:20"), (None, None)]
    got = spark.createDataFrame(rows, "d string, t string").select(F.date_format(parsing.moment(F.col("d"), F.col("t")), "yyyy-MM-dd HH:mm:ss").alias("m")).collect()
    assert [r.m for r in got] == ["2024-03-05 10:20:00", "2024-03-05 21:05:07", "2024-03-05 00:01:00", "2024-03-05 00:00:00", "2024-03-05 00:00:00", None, None]


def test_load(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Txn ID, Acc ID,Txn Date,Debit Amount,Credit Amount,Closing Balance,Remarks,Mode!\n2,B,02/01/2024,,\"1,000\",5,tea ,upi\n1,A,01/01/2024,10.5,,4,nan,\n1,A,01/01/2024,10.5,,4,other,\n3,A,never,0,0,0,,\n")
    rows = loader.load(spark, str(tmp_path / "a.csv"))
    got = [(r.transaction_id, r.account_id, str(r.date_parsed), float(r.amount), float(r.abs_amount), r.txn_type, r.narration, r.bank_name, r.is_duplicate) for r in rows.collect()]
    assert got == [("3", "A", "None", 0, 0, "unknown", None, "UNKNOWN", False), ("1", "A", "2024-01-01", -10.5, 10.5, "debit", None, "UNKNOWN", False), ("1", "A", "2024-01-01", -10.5, 10.5, "debit", "OTHER", "UNKNOWN", True), ("2", "B", "2024-01-02", 1000, 1000, "credit", "TEA", "UNKNOWN", False)]
    assert loader.load_report(rows).first().asDict() == {"total_rows": 4, "accounts": 2, "duplicates": 1, "date_errors": 1}
    with pytest.raises(ValueError, match="balance"):
        loader.usual_columns(spark.range(1).selectExpr("1 AS account_id", "2 AS date", "3 AS debit", "4 AS credit"))
    made = loader.usual_columns(spark.range(2).selectExpr("'a' AS account_id", "'b' AS ACCOUNT_ID", "'2' AS date", "'3' AS debit", "'4' AS credit", "'5' AS balance").toDF("account_id", "Account ID", "date", "debit", "credit", "balance"))
    assert {r.account_id for r in made.collect()} == {"a"} and len({r.transaction_id for r in made.collect()}) == 2


def test_labels_and_their_files(spark, tmp_path):
    (tmp_path / "gt").mkdir()
    (tmp_path / "gt" / "Transaction_labels.csv").write_text("transaction_id,label\n1,TRUE\n2,no\n2,yes\n")
    (tmp_path / "gt" / "rings.csv").write_text("account_id,ring_id\nA,r1\n")
    txns, rings = loader.labels(spark, str(tmp_path / "gt"))
    assert txns.count() == 3 and rings.first().ring_id == "r1"
    scored = spark.createDataFrame([(1, "A", 0.9, True), (2, "B", 0.1, False), (3, "A", 0.8, True), (4, None, 0.2, False)], "transaction_id long, account_id string, score double, is_flagged boolean").withColumn("seq", F.col("transaction_id"))
    people = spark.createDataFrame([("A", "1", "r1", "mule", "p", True, 0.9), ("B", None, None, None, "p", False, 0.1)], "account_id string, is_fraud string, ring_id string, role string, persona string, detected boolean, max_score double")
    assert [(r.transaction_id, r.acc_is_fraud, r.is_fraud_gt) for r in evaluation.labelled(scored, people, txns).orderBy("transaction_id").collect()] == [(1, True, True), (2, False, True), (3, True, False), (4, False, False)]
    assert [r.is_fraud_gt for r in evaluation.labelled(scored, people).orderBy("transaction_id").collect()] == [True, False, True, False]
    out = str(tmp_path / "out")
    reports.label_files(evaluation.labelled(scored, people, txns), people.withColumn("is_fraud", F.col("is_fraud") == "1"), out)
    ids = lambda name: [r.transaction_id for r in spark.read.parquet(f"{out}/{name}").collect()]
    assert (ids("caught"), ids("missed")) == ([1], [2])
    assert json.loads(spark.read.text(f"{out}/report").first().value) == {"tp": 1, "fp": 1, "tn": 1, "fn": 1}
    reports.scored_files(scored, scored.agg(F.count(F.lit(1)).alias("n")), out, 1)
    assert [r.seq for r in spark.read.parquet(f"{out}/top_flagged").collect()] == [1] and spark.read.parquet(f"{out}/scored").count() == 4
    scored.write.option("header", "true").csv(f"{out}/again")
    back = loader.reload(spark, f"{out}/again", ["score"], ["is_flagged"])
    assert sorted((r.transaction_id, r.score, r.is_flagged) for r in back.collect()) == [("1", 0.9, True), ("2", 0.1, False), ("3", 0.8, True), ("4", 0.2, False)]


def test_flags_are_described(spark):
    rows = spark.createDataFrame([(1, "BAD", True, False), (2, "", None, True), (3, None, False, False)], "seq long, clean_flags string, is_duplicate boolean, is_ocr_row boolean")
    with_flags, clean = cleaning.parted(rows)
    assert {r.seq: r.flag_description for r in with_flags.collect()} == {1: "BAD | " + cleaning.FLAG_REASONS["is_duplicate"], 2: cleaning.FLAG_REASONS["is_ocr_row"]}
    assert [r.seq for r in clean.collect()] == [3]
    kinds = spark.createDataFrame([("image",), ("PNG",), ("csv",), (None,)], "k string").select(cleaning.is_scanned(F.col("k")).alias("s"), cleaning.amount_flag(F.lit(None).cast("double"), F.lit(0.0)).alias("z"))
    assert [(r.s, r.z) for r in kinds.collect()] == [(True, "ZERO_DEBIT_AND_CREDIT"), (True, "ZERO_DEBIT_AND_CREDIT"), (False, "ZERO_DEBIT_AND_CREDIT"), (False, "ZERO_DEBIT_AND_CREDIT")]


def test_trail_files_and_summaries(spark, tmp_path):
    roots = spark.createDataFrame([("A",), ("B",), ("A",)], "node string")
    trails = spark.createDataFrame([("A", "A>C", 1), ("A", "A>D>E", 2)], "root string, path string, hops int")
    reports.trail_files(roots, trails, trails.limit(0), str(tmp_path))
    got = {(r.account, r.direction): (r.hops, r.trails, r.status) for r in spark.read.parquet(f"{tmp_path}/manifest").collect()}
    none = (0, 0, "no_internal_counterparties")
    assert got == {("A", "forward"): (3, 2, "ok"), ("A", "backward"): none, ("B", "forward"): none, ("B", "backward"): none}
    report = spark.createDataFrame([(1234567, 5, None)], "rows_input long, accounts long, nodes long")
    lines = [r.value for r in reports.summary(report, "RUN", reports.ANALYTICS).collect()]
    assert lines[1] == "RUN" and "  Rows analysed           : 1,234,567" in lines and "  Graph nodes             : 0" in lines and "RISK SCORE DISTRIBUTION" not in lines
    scores = spark.createDataFrame([("A", 80.0, "CRITICAL", "FAN_IN"), ("B", 80.0, "CRITICAL", "NONE"), ("C", 1.0, "LOW", "NONE")], "account_id string, score double, tier string, active_patterns string")
    reasons = spark.createDataFrame([("A", "many senders")], "account_id string, reasons string")
    top = [r.value for r in reports.top_accounts(scores, reasons, 2).collect()]
    assert top[0] == "  [CRITICAL] A            Score: 80.0" and top[2].endswith("many senders") and len(top) == 6
    reports.save_summary(reports.summary(report, "RUN", reports.ANALYTICS), f"{tmp_path}/s")
    assert [r.value for r in spark.read.text(f"{tmp_path}/s").collect()] == lines


def test_rings(spark):
    members = spark.createDataFrame([("r", "A", "mule", 5.0), ("r", "Z", "mule", 5.0), ("q", "A", "mule", 1.0)], "ring_id string, account_id string, role string, amount double")
    people = spark.createDataFrame([("A", "Ann", "SBI", 0.5)], "account_id string, holder string, bank string, risk double")
    assert [tuple(r) for r in cases.ring_members(members, people, "r").collect()] == [("A", "Ann", "SBI", "mule", 5.0, 0.5)]
    assert [r.ring_id for r in cases.rings_by_amount(members.withColumn("ring_id", F.concat("ring_id", "account_id"))).collect()] == ["rA", "rZ", "qA"]
