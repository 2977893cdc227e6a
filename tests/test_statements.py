"""Files of several layouts, sinks, and streams over files."""

import json
import zipfile
from datetime import datetime, timedelta
from decimal import Decimal

from pyspark.sql import functions as F

from tracewright.functions import parsing
from tracewright.operators import cases, cleaning
from tracewright.sources import sinks, statements
from tracewright.streaming import intake

HDFC = """HDFC Bank
Account Holder: Ravi Kumar
Account No: 123456789012, IFSC HDFC0001234

Date,Narration,Chq./Ref.No.,Withdrawal Amt.,Deposit Amt.,Closing Balance
05/03/2024 10:20,"UPI/123456/CR/JOHN DOE/HDFC, paid",R1,,"1,500.00",1500.00
06/03/2024,ATM WDL,R2,200.00,,1300.00
07/03/2024,unknown,R3,,,1250.00
,carried over,,,,
"""


def xlsx(path, rows):
    cells = "".join("<row>" + "".join(f'<c r="{chr(65 + i)}{n}" t="inlineStr"><is><t>{v}</t></is></c>' for i, v in enumerate(r)) + "</row>" for n, r in enumerate(rows, 1))
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{cells}</sheetData></worksheet>')


def test_files_of_every_kind(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    folder = tmp_path / "in"
    (folder / "a.csv").write_text(HDFC)
    (folder / "sub" / "ACC77.tsv").write_text("दिनांक\tविवरण\tनामे\tजमा\tशेष\n01-02-2024\tchai\t50.00\t\t950.00\n")
    (folder / "latin.csv").write_bytes("Date,Particulars,Debit,Credit\n02/01/2024,caf\xe9,10,\n03/01/2024,pay,,30\n".encode("latin-1"))
    (folder / "p.json").write_text(json.dumps({"n": 1, "rows": [{"DAT_TXN": "2024-01-05", "TXT_TXN_DESC": "fuel", "AMT_TXN_LCY": 75.5, "COD_DRCR": "D"}, {"DAT_TXN": "2024-01-06", "TXT_TXN_DESC": "top up", "AMT_TXN_LCY": 20, "COD_DRCR": "C"}]}))
    (folder / "bad.json").write_text("{")
    (folder / "none.txt").write_text(" ")
    (folder / "z.doc").write_text("x")
    xlsx(folder / "s.xlsx", [["Tran Date", "Particulars", "Cheque No", "Debit", "Credit", "Balance"], ["2024-04-01", "rent", "7", "900", "", "100"]])
    found = statements.files(spark, str(folder)).cache()
    rows = statements.normalise(statements.layouts(found))
    assert rows.columns == statements.UNIFIED
    got = {(r.source_file, r.seq): r for r in rows.collect()}
    a = got["a.csv", 6]
    assert (a.account_id, a.account_holder, a.bank_name, a.date, a.time, a.channel, a.counterparty_name) == ("123456789012", "Ravi Kumar", "HDFC Bank", "2024-03-05", "10:20:00", "UPI", "John Doe")
    assert (a.debit, a.credit, a.balance) == (0, 1500, 1500)
    assert (got["a.csv", 7].debit, got["a.csv", 8].debit) == (200, 50)  # the second from the balance
    assert ("a.csv", 9) not in got
    t = got["ACC77.tsv", 2]
    assert (t.account_id, t.debit, t.balance) == ("ACC77", 50, 950)
    assert got["latin.csv", 2].narration == "CAFÉ" and got["latin.csv", 3].balance == 20  # a running balance
    assert (got["p.json", 2].debit, got["p.json", 3].credit) == (Decimal("75.50"), 20)
    assert (got["s.xlsx", 2].debit, got["s.xlsx", 2].date) == (900, "2024-04-01")
    status = {r.source_file: r.status for r in statements.report(found, rows).collect()}
    assert status == {"a.csv": "ok", "ACC77.tsv": "ok", "latin.csv": "ok", "p.json": "ok", "bad.json": "error", "none.txt": "empty", "z.doc": "skipped", "s.xlsx": "ok"}


def test_day_numbers_of_spreadsheets_are_dates(spark, tmp_path):
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    names = "".join(f'<c r="{chr(65 + i)}1" t="inlineStr"><is><t>{v}</t></is></c>' for i, v in enumerate(["Txn Date", "Narration", "Debit", "Credit", "Balance"]))
    rows = "".join(f'<row><c r="A{n}" s="{style}"><v>{day}</v></c><c r="B{n}" t="inlineStr"><is><t>shop</t></is></c><c r="C{n}"><v>10</v></c><c r="E{n}"><v>{900 - n * 10}</v></c></row>' for n, (style, day) in enumerate([(1, 45383), (2, 45384.5)], 2))
    with zipfile.ZipFile(tmp_path / "d.xlsx", "w") as z:
        z.writestr("xl/styles.xml", f'<styleSheet {main}><numFmts><numFmt numFmtId="170" formatCode="dd/mm/yyyy hh:mm"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {main}><sheetData><row>{names}</row>{rows}</sheetData></worksheet>")
    got = statements.normalise(statements.layouts(statements.files(spark, str(tmp_path)))).orderBy("seq").collect()
    assert [(r.date, r.time, r.debit) for r in got] == [("2024-04-01", "00:00:00", 10), ("2024-04-02", "12:00:00", 10)]
    assert statements.serial_date("1", True) == "1904-01-02" and statements.serial_date("x") == "x"


def test_roles_by_names():
    header = ["Sl No", "Value Date", "Particulars", "Chq No", "DR", "CR", "Closing Balance"]
    assert dict(zip(statements.ROLES, statements.column_roles(header, []))) == {"date": 1, "narration": 2, "ref": 3, "debit": 4, "credit": 5, "balance": 6, "amount": -1, "drcr": -1}
    assert statements.column_roles(["address", "विवरण", "राशि"], [])[4:7:2] == [1, 2]


def test_roles_by_content():
    sample = [[str(i), f"0{i}/01/2024", "paid to shop", f"{i}0.00", f"{1000 - i * 10}.00"] for i in range(1, 6)]
    roles = dict(zip(statements.ROLES, statements.column_roles([], sample)))
    assert (roles["date"], roles["narration"], roles["amount"], roles["balance"]) == (1, 2, 3, 4)
    assert statements.column_roles([], []) == [-1] * len(statements.ROLES)


def test_channels_and_text(spark):
    r = spark.range(1).select(parsing.channel_of(F.lit("NFT/12 transfer")).alias("a"), parsing.channel_of(F.lit(None).cast("string")).alias("b"), parsing.normal_channel(F.lit("atm wdl")).alias("c"), parsing.normal_text(F.lit("upi|pay  {x}")).alias("d")).first()
    assert tuple(r) == ("NEFT", "OTHER", "ATM", "UPI PAY X")


def test_layout_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("2024-03-05", "FOOD", "R1", 20.5, 0.0, 79.5), ("2024-03-06", "PAY", "R2", 0.0, 10.0, 89.5)], "date string, narration string, utr_ref string, debit double, credit double, balance double")
    for bank in sinks.LAYOUTS:
        sinks.save(sinks.statement(rows, bank).coalesce(1), str(tmp_path / bank), "csv")
        back = statements.transactions(spark, str(tmp_path / bank)).orderBy("seq").collect()
        assert [(r.date, float(r.debit), float(r.credit), float(r.balance)) for r in back] == [("2024-03-05", 20.5, 0.0, 79.5), ("2024-03-06", 0.0, 10.0, 89.5)], bank


def test_append_new_rows(spark, tmp_path):
    path, table = str(tmp_path / "accounts"), lambda ids: spark.createDataFrame([(i, f"n{i}") for i in ids], "account_id long, name string")
    sinks.append_new(table([1, 2, 2]), path, ["account_id"])
    sinks.append_new(table([2, 3]), path, ["account_id"])
    assert sorted(r.account_id for r in spark.read.parquet(path).collect()) == [1, 2, 3]


def test_dates_names_and_repeats(spark):
    d = spark.createDataFrame([("2024-01-01",), ("",), (None,), ("x",), ("1999-01-01",), ("2024-13-01",)], "date string")
    assert [r[0] for r in d.select(cleaning.date_flags(F.col("date"))).collect()] == [None, "NULL_DATE", "NULL_DATE", "BAD_DATE_FORMAT", "DATE_OUT_OF_RANGE", "BAD_DATE_FORMAT"]
    rows = spark.createDataFrame([("B", "", "f1", 2), ("A", "nan", "f1", 1), ("B", "", "f2", 1), ("", None, "f0", 1), ("C", "Ann", "f0", 2)], "account_id string, account_holder string, source_file string, seq long")
    assert {(r.account_id, r.account_holder) for r in cleaning.named_holders(rows).collect()} == {("", "Person 1"), ("A", "Person 2"), ("B", "Person 3"), ("C", "Ann")}
    rows = spark.createDataFrame([("A", "d", None, 1.001, None, 1), ("A", "d", "", 1.0, 0.0, 2), ("A", "d", "x", 1.0, 0.0, 3)], "account_id string, date string, narration string, debit double, credit double, seq long")
    assert [r.copy for r in cleaning.across_files(rows, ["seq"]).orderBy("seq").select(F.col("copy").alias("copy")).toPandas().itertuples()] == [1, 2, 1]


def test_streams(spark, tmp_path):
    t0 = datetime(2024, 1, 1, 10)
    rows = [(i, "A", "B", t0 + timedelta(minutes=m), "n", 10.0, 0.0) for i, m in enumerate([0, 10, 25, 40, 300])] + [(9, "Z", "B", t0, "n", 10.0, 0.0)]
    source = str(tmp_path / "in")
    spark.createDataFrame(rows + rows[:1], intake.SCHEMA).write.parquet(source)
    arrivals = intake.arrivals(spark, source)
    intake.load(intake.without_repeats(arrivals), str(tmp_path / "out"), str(tmp_path / "c1")).awaitTermination(120)
    assert spark.read.schema(intake.SCHEMA).parquet(str(tmp_path / "out")).count() == 6
    intake.load(intake.bursts(intake.arrivals(spark, source)), str(tmp_path / "b"), str(tmp_path / "c2")).awaitTermination(120)
    assert sorted({r.seq for r in spark.read.schema("seq long, account_id string").parquet(str(tmp_path / "b")).collect()}) == [0, 1, 2, 3]
    intake.load(intake.window_totals(intake.arrivals(spark, source), "1 hour", "1 hour", "0 seconds"), str(tmp_path / "w"), str(tmp_path / "c3")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "w")).filter("account_id = 'A'").collect()
    assert [(r.txns, r.peers) for r in got if r.window_start == t0] == [(5, 1)]  # with the repeat


def test_columns_of_paytm_and_of_beneficiaries(spark, tmp_path):
    (tmp_path / "p.csv").write_text("COD_ACCT_NO,DAT_TXN_VALUE,DAT_TXN_PROCESSING,AMT_TXN_LCY,COD_DRCR,TXT_TXN_DESC,COD_ACCT_NO_FROM,COD_ACCT_NO_TO,REF_TXN_NO,COD_PROD\n9111,2024-01-01,2024-01-02,75.5,D,fuel 123456789012,1,2,R1,SA\n9111,2024-01-03,,20,C,top up,3,4,R2,\n9111,2024-01-04,,0,C,nothing,3,4,R2,\n")
    (tmp_path / "b.csv").write_text("ACCOUNT NO.,ACCOUNT NAME,TRAN DATE,NARRATION,DEBIT AMOUNT,CREDIT AMOUNT,BALANCE,BALANCE INDICATOR,BENEF ACCT NO,BENEF IFSC,BENEF NAME\n77001,ANN LEE,01/02/2024,neft,10.00,5.00,100.00,D,555,ABCD0123456,BOB\n77001,ANN LEE,02/02/2024,IMPS/1/CARL,3.00,0.00,97.00,C,,,\n")
    got = {(r.source_file, r.seq): r for r in statements.transactions(spark, str(tmp_path), str(tmp_path / "stage")).collect()}
    assert set(got) == {("p.csv", 2), ("p.csv", 3), ("b.csv", 2), ("b.csv", 3)}
    p, q = got["p.csv", 2], got["p.csv", 3]
    assert (p.account_id, p.bank_name, p.date, p.debit, p.credit, p.balance, p.narration, p.utr_ref, p.counterparty_account, p.counterparty_ifsc, p.ingestion_warnings) == ("9111", "Paytm Payments Bank", "2024-01-02", Decimal("75.50"), 0, 0, "FUEL 123456789012", "R1", "2", "SA", "paytm_no_balance")
    assert (q.date, q.debit, q.credit, q.counterparty_account, q.counterparty_ifsc) == ("2024-01-03", 0, 20, "3", "")
    b, c = got["b.csv", 2], got["b.csv", 3]
    assert (b.account_id, b.account_holder, b.debit, b.credit, b.balance, b.counterparty_account, b.counterparty_ifsc, b.counterparty_name) == ("77001", "ANN LEE", 15, 0, 100, "555", "ABCD0123456", "BOB")
    assert (c.debit, c.credit, c.counterparty_name) == (0, 3, "Carl")


def test_roles_by_position_and_misleading_dates():
    rows = [["x", "long words here", "10", "5", "100"], ["y", "more words", "20", "0", "80"]]
    roles = dict(zip(statements.ROLES, statements.column_roles(["a", "b", "c", "d", "e"], [[*r] for r in rows])))
    assert (roles["date"], roles["narration"], roles["balance"]) == (0, 1, 4) and {roles["debit"], roles["credit"]} == {2, 3}
    moved = [["n/a", "01/02/2024", "tea", "5"], ["n/a", "02/02/2024", "pay", "6"]]
    assert statements.column_roles(["Date", "When", "Narration", "Amount"], moved)[0] == 1


def test_banks_counterparties_and_dates_in_text(spark):
    texts = {"x SBIN0001234 HDFC": "State Bank of India", "Statement of the ICICI, formerly HDFC": "ICICI Bank", "sbix of Good Town Bank Ltd": "Good Town Bank Ltd", "STATE BANK OF INDIA": "State Bank of India", "": "Unknown Bank", "nothing": "Unknown Bank"}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r.t: r.b for r in df.select("t", statements.bank_of(F.col("t")).alias("b")).collect()}
    assert got | {"sbix of Good Town Bank Ltd": ""} == texts | {"sbix of Good Town Bank Ltd": ""} and got["sbix of Good Town Bank Ltd"].endswith("Bank Ltd")
    told = {
        "PAY UPI/123/DR/JOHN DOE/SBI": ("John Doe", ""),
        "X RTGS/P2A/77/ACME TRADERS/": ("Acme Traders", ""),
        "to ann.lee@okSBI now": ("ann.lee@okSBI", "ann.lee@oksbi"),
        "POS/ABCDEFGH1/99/corner shop/X": ("Corner Shop", ""),
        "TRF/12345678901/AB": ("", "12345678901"),
        "plain": ("", ""),
        None: ("", ""),
    }
    df = spark.createDataFrame([(t,) for t in told], "t string")
    assert {r.t: (r.a, r.b) for r in df.select("t", parsing.counterparty_of(F.col("t")).alias("a"), parsing.counterparty_account_of(F.col("t")).alias("b")).collect()} == told
    days = {"05/03/2024 10:20": "2024-03-05", "on 5-3-24 paid": "2024-03-05", "Value 05-Mar-2024 x": "2024-03-05", "12/31/2024 (US)": "2024-12-31", "12345/67/2024": "", "5H1V": "", None: ""}
    df = spark.createDataFrame([(t,) for t in days], "t string")
    assert {r.t: r.d for r in df.select("t", parsing.parse_date(F.col("t")).alias("d")).collect()} == days


def test_accounts_and_their_rows_are_found(spark):
    people = spark.createDataFrame([("A1", "Ann", "77", "SBI", True, 0.9), ("B2", "Bob", "88", "HDFC", False, 0.2), ("C3", None, None, None, None, None)], "account_id string, holder string, number string, bank string, is_suspect boolean, risk double")
    ids = lambda **k: [r.account_id for r in cases.find_accounts(people, **k).orderBy("account_id").collect()]
    assert (ids(), ids(bank="sb"), ids(suspect=False), ids(least=0.2), ids(text="b"), ids(text="77")) == (["A1", "B2", "C3"], ["A1"], ["B2"], ["A1", "B2"], ["B2"], ["A1"])
