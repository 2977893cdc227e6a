"""Parsers of lines and of words at places, one layout a test."""

from tracewright.sources import lines, statements


def table(spark, text):
    return spark.createDataFrame([("f", i, t) for i, t in enumerate(text.split("\n"), 1)] + [("g", 1, None), ("g", 2, "")], "path string, seq long, line string")


def cells(found):
    return [tuple(r.cells) for r in found.orderBy("seq").collect()]


def test_yes_bank(spark):
    text = "YES BANK\nTXN DATE VALUE DATE DESCRIPTION\nlost before the page\nPAGE 1\nUPI payment to\n05-MAR-2024 05-MAR-2024 JOHN 100.00 0.00 1,900.00\n06-MAR-2024 06-MAR-2024 SALARY 0.00 50.00 1,950.00\n1,950.00\nshort\nstray words\n06-MAR no row\n07-MAR-2024 07-MAR-2024 X Y 1.00 0.00 1,949.00"
    assert cells(lines.yes_bank(table(spark, text))) == [
        ("05-MAR-2024", "UPI payment to JOHN", "", "100.00", "0.00", "1,900.00"),
        ("06-MAR-2024", "SALARY", "", "0.00", "50.00", "1,950.00"),
        ("07-MAR-2024", "X Y", "", "1.00", "0.00", "1,949.00"),
    ]


def test_baroda(spark):
    text = "words before\n01-01-24 no start yet 1.00 2.00 3.00Cr\nDATE PARTICULARS WITHDRAWAL\n-----\nNEFT from\n02-01-24 ACME 0.00 500.00 1,500.00Cr\n03-01-2024 ATM 200.00 1,300.00Cr\nPAGE 2 TOTAL\n04-01-24 no amounts"
    assert cells(lines.baroda(table(spark, text))) == [("02-01-24", "NEFT from ACME", "", "0.00", "500.00", "1,500.00Cr"), ("03-01-2024", "ATM", "", "", "", "1,300.00Cr")]


def test_dated_lines(spark):
    text = "Some bank\nDate Particulars Amount Balance\nB/F 100.00(Cr)\n01/02/24 UPI TEA . 20.00(Cr) 80.00(Cr)\n02-02-2024 02-02-2024 PAY 50.00 130.00\nPage 1\n03/02/2024S12 LONG TEXT 30.00\n\n100.00\n04/02/2024 BOTH 40.00 0.00 60.00\n05/02/2024 MARKED 0.00 15.00CR 75.00 CR\n06/02/2024 OVER 100.00 25.00DR\n07/02/2024 ONE 5.00\nTotal 1.00 2.00"
    assert cells(lines.dated_lines(table(spark, text))) == [
        ("01/02/24", "UPI TEA", "", "20.00", "0.00", "80.00Cr"),
        ("02-02-2024", "PAY", "", "0.00", "50.00", "130.00"),
        ("03/02/2024", "LONG TEXT", "S12", "30.00", "0.00", "100.00"),
        ("04/02/2024", "BOTH", "", "40.00", "0.00", "60.00"),
        ("05/02/2024", "MARKED", "", "0.00", "15.00", "75.00 CR"),
        ("06/02/2024", "OVER", "", "100.00", "0.00", "25.00DR"),
    ]
    # No line of names: the first row begins, and nothing before it tells its side.
    assert cells(lines.dated_lines(table(spark, "hello\n01/02/24 A 5.00 9.00\n02/02/24 B 1.00 8.00"))) == [("01/02/24", "A", "", "0.00", "5.00", "9.00"), ("02/02/24", "B", "", "1.00", "0.00", "8.00")]


def test_kerala(spark):
    text = "KERALA GRAMIN BANK\n01-02-2024  TO CASH  100.00DR  900.00\n02/02/2024\tBY  NEFT\t50.00\t950.00\n03-02-2024  X  950.00\n04-02-2024  1.00Cr\nno date  1.00  2.00"
    assert cells(lines.kerala(table(spark, text))) == [("01-02-2024", "TO CASH", "", "100.00DR", "", "900.00"), ("02/02/2024", "BY NEFT", "", "", "50.00", "950.00"), ("04-02-2024", "", "", "", "1.00Cr", "")]


def test_cells_parted_by_spaces(spark):
    text = "bank\nDate  Narration  Debit  Credit  Balance\n01/02/2024  TEA  20.00  0.00  80.00\n02/02/2024  PAY TO\nA SHOP IN TOWN  5.00  0.00  75.00\npage 2 of 3\n03/02/2024  ONLY"
    found = lines.spaced(table(spark, text))
    assert found.first().header == ["Date", "Narration", "Debit", "Credit", "Balance"]
    assert cells(found) == [("01/02/2024", "TEA", "20.00", "0.00", "80.00"), ("02/02/2024", "PAY TO A SHOP IN TOWN", "5.00", "0.00", "75.00"), ("03/02/2024", "ONLY", "", "", "")]


def words(spark, rows, page=1):
    return [("f", page, float(x), float(y), t) for y, row in rows for x, t in row]


WORDS = "path string, page int, x double, y double, text string"


def test_idfc(spark):
    top = (60, [(12, "Date"), (382, "Debit"), (452, "Credit"), (519, "Balance")])
    rows = words(spark, [top, (70, [(127, "UPI/1/"), (170, "JOHN")]), (80, [(12, "05/03/2024"), (40, "10:20"), (127, "paid"), (380, "100.00"), (520, "900.00")]), (90, [(12, "Page"), (30, "1")]), (100, [(130, "lost")])])
    rows += words(spark, [top, (80, [(12, "06/03/2024"), (127, "pay"), (455, "50.00"), (515, "950.00"), (560, None)])], 2)
    assert cells(lines.idfc(spark.createDataFrame(rows, WORDS))) == [("05/03/2024 10:20", "UPI/1/ JOHN paid", "", "100.00", "", "900.00"), ("06/03/2024", "pay", "", "", "50.00", "950.00")]


def test_rbl(spark):
    date = lambda y, d, x=30: (y, [(x, d), (80, "CASH"), (222, "C1"), (272, d), (371, "5.00"), (492, "95.00")])
    rows = words(spark, [date(20, "01-Jan-2024"), (40, [(30, "DATE"), (371, "WITHDRAWAL")]), date(60, "02-Jan-2024"), date(80, "03-Jan-2024", 61), (100, [(30, "TOTAL"), (371, "5.00")])])
    assert cells(lines.rbl(spark.createDataFrame(rows, WORDS))) == [("02-Jan-2024", "CASH", "C1", "5.00", "", "95.00")]


def test_places_of_names(spark):
    head = (50, [(10, "Date"), (100, "Narration"), (200, "Debit"), (203, "(INR)"), (300, "Balance")])
    rows = words(spark, [(10, [(10, "My"), (40, "bank")]), head, (70, [(12, "01/02/2024"), (95, "TEA"), (205, "20.00"), (301, "80.00")]), (90, [(12, "page")])])
    found = lines.placed(spark.createDataFrame(rows, WORDS), ["date", "narration", "debit", "balance"])
    assert found.first().header == ["Date", "Narration", "Debit (INR)", "Balance"] and cells(found) == [("01/02/2024", "TEA", "20.00", "80.00")]


def test_the_first_parser_that_finds_rows_wins(spark, tmp_path):
    files = {
        "y.txt": "YES BANK\nAccount No: 123456789\n\n05-MAR-2024 05-MAR-2024 JOHN 100.00 0.00 1,900.00",
        "b.txt": "Bank of Baroda\nAccount Number: 777777777\nDATE PARTICULARS WITHDRAWAL\n02-01-24 ACME 0.00 500.00 1,500.00Cr\n03-01-24 ATM 200.00 1,300.00Cr",
        "d.txt": "Any bank\nDate Particulars\n01/02/24 UPI TEA 20.00 80.00\n02/02/24 PAY 5.00 75.00",
        "s.txt": "Date  Narration  Debit  Credit  Balance\n01/02/2024  TEA  20.00  0.00  80.00",
        "n.txt": "nothing here at all",
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    found = statements.files(spark, str(tmp_path))
    rows = statements.normalise(statements.layouts(found))
    got = sorted((r.source_file, r.account_id, r.date, r.narration, float(r.debit), float(r.credit), float(r.balance)) for r in rows.collect())
    assert got == [
        ("b.txt", "777777777", "2024-01-02", "ACME", 0, 500, 1500),
        ("b.txt", "777777777", "2024-01-03", "ATM", 200, 0, 1300),
        ("d.txt", "d", "2024-02-01", "UPI TEA", 0, 20, 80),
        ("d.txt", "d", "2024-02-02", "PAY", 5, 0, 75),
        ("s.txt", "s", "2024-02-01", "TEA", 20, 0, 80),
        ("y.txt", "123456789", "2024-03-05", "JOHN", 100, 0, 1900),
    ]
    assert {r.source_file: r.status for r in statements.report(found, rows).collect()}["n.txt"] == "normalization_error"
