"""Transactions out of text that is no table: lines of bank layouts, wrapped lines, fixed widths, and words at places on a page.

Every parser takes lines (path, seq, line) or words (path, page, x, y, text) and returns tables of rows: path, seq, header, cells. They are
column expressions and windows within one file, whose size is bounded. A file without a fitting line gives no row. Null lines count as empty.
cascade() tries the parsers in order and keeps for each file the first one that found rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import parsing

FIELDS = ["Date", "Narration", "Ref No", "Debit", "Credit", "Balance"]

# Names that tell a bank with a layout of its own, by parser.
MARKS = {"idfc": ["idfc", "pioneer"], "yes_bank": ["yes bank", "yesb"], "rbl": ["ratnakar", "rbl bank"], "baroda": ["bank of baroda", "barb"], "kerala": ["kerala gramin"]}
# Lines of Yes Bank, and words of lines that are no part of a narration.
YES_ROW = r"^(\d{2}-[A-Z]{3}-\d{4})\s+(\d{2}-[A-Z]{3}-\d{4})\s+(.+?)\s+([\d,]+\.\d{2})\s+([\d,]+\.\d{2})\s+([\d,]+\.\d{2})$"
YES_SKIP = ["TXN DATE", "VALUE DATE", "DESCRIPTION", "REFERENCE", "STATEMENT OF ACCOUNT", "CUSTOMER ID", "ACCOUNT NO", "PERIOD", "OPENING BALANCE", "CLOSING BALANCE", "PAGE"]
# Lines of Bank of Baroda with five and with four columns, and words of lines that count for nothing.
BARODA_FULL = r"^(\d{2}-\d{2}-\d{2,4})\s+(.+?)\s+([\d,]+\.\d{2})\s+([\d,]+\.\d{2})\s+([\d,]+\.\d{2}(?:Cr|Dr)?)$"
BARODA_SHORT = r"^(\d{2}-\d{2}-\d{2,4})\s+(.+?)\s+([\d,]+\.\d{2})(?:Cr|Dr)?\s+([\d,]+\.\d{2}(?:Cr|Dr)?)$"
BARODA_SKIP = ["PAGE", "TOTAL", "CLOSING BALANCE", "OPENING BALANCE", "HELPLINE", "BRANCH", "MICR", "IFSC"]
# Left edges of the columns of IDFC and RBL pages, their dates, and words of lines that count for nothing.
IDFC_BANDS = [12, 83, 127, 382, 452, 519]
IDFC_DATE = r"^\d{1,2}/\d{2}/\d{2,4}$"
IDFC_SKIP = ["statement of account", "customer id", "account no", "statement for", "page", "generated"]
IDFC_WORDS = ["statement", "of", "account", "customer", "id", "no", "for", "to", "trans", "date", "and", "value", "time", "transaction", "details", "cheque", "debit", "credit", "balance"]
RBL_BANDS = [30, 77, 222, 272, 371, 439, 492]
RBL_DATE = r"^\d{2}-[A-Za-z]{3}-\d{4}$"
RBL_SKIP = ["STATEMENT OF", "PERIOD :", "CLOSING BALANCE", "OPENING BALANCE", "PAGE", "TOTAL"]
#: A date at the left of these pages starts before this place; words grouped to one line lie within this height.
MARGIN, IDFC_HEIGHT, WORD_HEIGHT = 60, 6, 4
# Words of lines before the first row, starts of lines that are no rows, amounts.
DATED_WORDS = ["withdraw", "deposit", "debit", "credit", "amount", "balance", "particular"]
NO_ROWS = ["Id Date", "Total(", "Total ", "Closing Balance", "Manager/", "Date :", "***", "Report for the Period", "Service OutLet", "Page"]
AMOUNT = r"[\d,]+\.\d{2}(?:\s?\(?(?:CR|DR)\)?)?"
# Words of the header line of a table without marks between cells, and of lines that are left out of it.
TABLE_WORDS = ["date", "debit", "credit", "balance", "narration", "description", "withdrawal", "deposit", "particulars", "remarks", "amount", "ref", "cheque", "txn", "post"]
TABLE_SKIP = ["account holder", "ifsc", "page", "statement period", "generated"]


def _has(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def _trimmed(lines: DataFrame) -> DataFrame:
    """Lines without spaces around; empty ones go."""
    return lines.select("path", "seq", F.regexp_replace("line", r"^\s+|\s+$", "").alias("line")).filter("line <> ''")


def _rows(d: DataFrame, *cells: Column) -> DataFrame:
    """A table with FIELDS as its header."""
    text = F.array(*[F.coalesce(c.cast("string"), F.lit("")) for c in cells])
    return d.select("path", "seq", F.array(*[F.lit(f) for f in FIELDS]).alias("header"), text.alias("cells"))


def led(d: DataFrame, within: list[str], *kept: str) -> DataFrame:
    """The lines of kind 'row' with lead: the texts of kind 'more' after the last 'row' or 'cut' before them, joined by spaces."""
    before = Window.partitionBy(*within).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    part = F.coalesce(F.sum((F.col("kind") != "more").cast("int")).over(before), F.lit(0))
    more = F.array_sort(F.collect_list(F.when(F.col("kind") == "more", F.struct("seq", F.col("text").alias("t")))))
    ends = d.withColumn("part", part).groupBy(*within, "part").agg(F.concat_ws(" ", F.transform(more, lambda m: m.t)).alias("lead"), F.max(F.when(F.col("kind") == "row", F.struct("seq", *kept))).alias("r"))
    return ends.filter("r IS NOT NULL").select(*within, "r.*", "lead")


def _after(d: DataFrame, is_start: Column) -> DataFrame:
    """The lines after the first one that is a start."""
    so_far = Window.partitionBy("path").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return d.withColumn("begun", F.coalesce(F.max(is_start).over(so_far), F.lit(False))).filter("begun").drop("begun")


def yes_bank(lines: DataFrame) -> DataFrame:
    """Two dates, narration, debit, credit and balance; lines before a row lead its narration, notes of the page end that."""
    d, line = _trimmed(lines), F.col("line")
    ended = _has(F.upper(line), YES_SKIP) | (F.length(line) <= 5) | line.rlike(r"^[\d,]+\.\d{2}|^\d{2}-[A-Z]{3}")
    kind = F.when(_has(F.upper(line), YES_SKIP), "cut").when(line.rlike(YES_ROW), "row").when(ended, "cut").otherwise("more")
    d = led(d.withColumn("kind", kind).withColumn("text", line), ["path"], "line")
    part = lambda i: F.regexp_extract("line", YES_ROW, i)
    return _rows(d, part(1), F.trim(F.concat_ws(" ", "lead", part(3))), F.lit(""), part(4), part(5), part(6))


def baroda(lines: DataFrame) -> DataFrame:
    """Five columns, or four without the sides: there the balance's change tells the movement later."""
    d, line = _trimmed(lines).filter("NOT line RLIKE '^-+$'"), F.col("line")
    starts = line.contains("DATE") & _has(line, ["WITHDRAWAL", "PARTICULARS"])
    d = _after(d, starts).filter(~starts & ~_has(F.upper(line), BARODA_SKIP))
    kind = F.when(line.rlike(BARODA_SHORT) | line.rlike(BARODA_FULL), "row").when(line.rlike(r"^\d{2}-\d{2}") | (F.length(line) <= 3), "cut").otherwise("more")
    d = led(d.withColumn("kind", kind).withColumn("text", line), ["path"], "line")
    full = line.rlike(BARODA_FULL)
    either = lambda i, j: F.when(full, F.regexp_extract("line", BARODA_FULL, i)).otherwise(F.regexp_extract("line", BARODA_SHORT, j))
    side = lambda i: F.when(full, F.regexp_extract("line", BARODA_FULL, i)).otherwise("")
    return _rows(d, either(1, 1), F.trim(F.concat_ws(" ", "lead", either(2, 2))), F.lit(""), side(3), side(4), either(5, 4))


def _signed(raw: Column) -> Column:
    value = parsing.amount_value(raw)
    return F.when(raw.rlike(r"(?i)dr\)?$"), -value).otherwise(value)


def dated_lines(lines: DataFrame) -> DataFrame:
    """Lines of a date, a narration and amounts, of which the last is the balance; if only one is there, a line of one amount after it is.

    Rows begin after a line of column names or an opening balance, or with the first line that is a row. With one more amount the balance's
    change from the row before (or the opening balance) tells its side, without one before it an overdrawn balance a debit, else a credit. Of two more
    amounts each goes to the side that its own mark names, and without marks the first is the debit and the second the credit.
    """
    low, line = F.lower("line"), F.col("line")
    date = r"\d{2}[-/]\d{2}[-/]\d{2,4}"
    form = rf"^({date})(?:\s+{date})?(\S*)\s+(.+)$"
    tail_form = rf"(?i)((?:\s+{AMOUNT})+)$"
    part = lambda i: F.regexp_extract("line", form, i)
    d = _trimmed(lines).withColumn("rest", F.concat(F.lit(" "), part(3))).withColumn("tail", F.regexp_extract("rest", tail_form, 1))
    d = d.withColumn("amounts", F.expr(f"regexp_extract_all(tail, '(?i)({AMOUNT})', 1)".replace("\\", "\\\\")))
    only = rf"(?i)^{AMOUNT}$"
    d = d.withColumn("after", F.lead("line").over(Window.partitionBy("path").orderBy("seq")))
    d = d.withColumn("wrapped", F.when((F.size("amounts") == 1) & F.col("after").rlike(only), F.col("after")))
    opening = _has(low, ["opening balance", "brought forward"]) | line.startswith("B/F")
    starts = opening | (low.contains("date") & _has(low, DATED_WORDS))
    is_row = (part(1) != "") & ((F.size("amounts") >= 2) | F.col("wrapped").isNotNull()) & ~opening
    dropped = reduce(lambda a, b: a | b, [line.startswith(s) for s in NO_ROWS])
    d = d.withColumn("kind", F.when(opening, "opening").when(dropped, "none").when(is_row, "row").when(starts, "start").otherwise("none"))
    begun = F.max(F.col("kind") != "none").over(Window.partitionBy("path").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    first = F.regexp_extract("line", rf"(?i)({AMOUNT})\s*$", 1)
    d = d.withColumn("balance", F.when(F.col("kind") == "opening", first).when(F.col("kind") == "row", F.coalesce("wrapped", F.element_at("amounts", -1))))
    d = d.withColumn("begun", begun).filter("begun AND kind IN ('row', 'opening') AND balance <> ''").withColumn("now", _signed(F.col("balance")))
    d = d.withColumn("was", F.lag("now").over(Window.partitionBy("path").orderBy("seq"))).filter("kind = 'row'")
    moved = F.when(F.col("wrapped").isNotNull(), F.col("amounts")).otherwise(F.slice("amounts", 1, F.size("amounts") - 1))
    d = d.withColumn("moved", F.slice(moved, F.greatest(F.size(moved) - 1, F.lit(1)), 2))
    one, two = F.get("moved", F.lit(0)), F.get("moved", F.lit(1))
    fell = F.when(F.col("was").isNotNull(), F.col("now") < F.col("was")).otherwise(F.col("now") < 0)
    of = lambda a, mark, here: F.when(F.when(a.rlike(r"(?i)(cr|dr)\)?$"), a.rlike(rf"(?i){mark}\)?$")).otherwise(F.lit(here)), parsing.amount_value(a))
    zero = F.lit(0).cast("decimal(18,2)")
    side = lambda mark, lone, at: F.when(two.isNull(), F.when(lone, parsing.amount_value(one)).otherwise(zero)).otherwise(F.coalesce(F.greatest(of(one, mark, at == 0), of(two, mark, at == 1)), zero))
    words = F.trim(F.regexp_replace(F.regexp_replace("rest", tail_form, ""), r"(\s+[.\-])+$", ""))
    ref = F.when(part(2).rlike("^[1-9A-Za-z][0-9A-Za-z]*$"), part(2)).otherwise("")
    return _rows(d, part(1), words, ref, side("dr", fell, 0), side("cr", ~fell, 1), F.regexp_replace("balance", r"[()]", ""))


def kerala(lines: DataFrame) -> DataFrame:
    """Lines from a date on, parted by tabs or two spaces: the last cell is the balance, the one before it an amount on the side that a mark of either names, else a credit."""
    d = _trimmed(lines).filter(F.col("line").rlike(r"^\d{1,2}[-/ ]\d{1,2}[-/ ]\d{2,4}"))
    wide = F.split("line", r"\t|\s{2,}")
    d = d.withColumn("c", F.when(F.size(wide) > 1, wide).otherwise(F.split("line", r"\s+"))).withColumn("n", F.size("c"))
    money = lambda c: c.rlike(r"[\d,]+\.\d{2}")
    last, other = F.element_at("c", -1), F.when(F.col("n") >= 3, F.get("c", F.col("n") - 2))
    amount = F.when(F.col("n") == 2, last).otherwise(other)
    d = d.filter((F.col("n") >= 2) & money(last)).withColumn("amount", amount).filter(money(F.col("amount")))
    balance = F.when(F.col("n") >= 3, last).otherwise("")
    words = F.concat_ws(" ", F.slice("c", 2, F.greatest(F.col("n") - F.when(F.col("n") == 2, 2).otherwise(3), F.lit(0))))
    marked = lambda mark: F.col("amount").rlike(rf"(?i){mark}\b") | balance.rlike(rf"(?i){mark}\b")
    debit = marked("dr") & ~marked("cr")
    return _rows(d, F.get("c", F.lit(0)), words, F.lit(""), F.when(debit, F.col("amount")), F.when(~debit, F.col("amount")), balance)


def spaced(lines: DataFrame, gap: str = r"\s{2,}") -> DataFrame:
    """Cells parted by a gap below a header line of three of TABLE_WORDS and four columns. Undated lines belong to the dated line before;
    lines with over three cells more or less than the header are left out, others are cut or filled to its width."""
    d, low = _trimmed(lines).filter("length(line) >= 8"), F.lower("line")
    heads = F.size(F.filter(F.array(*[F.lit(w) for w in TABLE_WORDS]), lambda w: low.contains(w))) >= 3
    top = d.filter(heads).groupBy("path").agg(F.min_by("line", "seq").alias("top"), F.min("seq").alias("at"))
    top = top.select("path", "at", F.split("top", gap).alias("header")).filter("size(header) >= 4")
    d = d.join(top, "path").filter((F.col("seq") > F.col("at")) & ~_has(low, TABLE_SKIP))
    dated = F.col("line").rlike(r"^[0-3]?\d[-/.][0-1]?\d[-/.]\d{2,4}\b")
    d = d.withColumn("part", F.sum(dated.cast("int")).over(Window.partitionBy("path").orderBy("seq"))).filter("part > 0")
    joined = F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("seq", "line"))), lambda s: s.line))
    d = d.groupBy("path", "header", "part").agg(F.min("seq").alias("seq"), F.split(joined, gap).alias("c"))
    n = F.size("header")
    d = d.filter(F.abs(F.size("c") - n) <= 3)
    return d.select("path", "seq", "header", F.transform(F.sequence(F.lit(1), n), lambda i: F.coalesce(F.get("c", i - 1), F.lit(""))).alias("cells"))


# ---------------------------------------------------------------- words at places on a page


def _nearest(x: Column, edges: Column) -> Column:
    """Number from 1 of the edge that is nearest, the first of equals."""
    far = F.transform(edges, lambda e: F.abs(x - e))
    return F.array_position(far, F.array_min(far)).cast("int")


def word_lines(words: DataFrame, height: int) -> DataFrame:
    """path, page, seq, items (x and text from left to right) of words in steps of a height; seq counts lines over a file's pages."""
    d = words.filter("trim(text) <> '' AND x IS NOT NULL AND y IS NOT NULL")
    d = d.groupBy("path", "page", (F.bround(F.col("y") / height) * height).alias("y")).agg(F.array_sort(F.collect_list(F.struct(F.col("x").cast("double").alias("x"), F.trim("text").alias("text")))).alias("items"))
    seq = F.row_number().over(Window.partitionBy("path").orderBy("page", "y")).cast("long")
    return d.select("path", "page", seq.alias("seq"), "items", F.concat_ws(" ", "items.text").alias("line"))


def _banded(items: Column, edges: Column) -> Column:
    """The items' texts in the cell of their nearest edge."""
    return F.transform(F.sequence(F.lit(1), F.size(edges)), lambda i: F.concat_ws(" ", F.transform(F.filter(items, lambda w: _nearest(w.x, edges) == i), lambda w: w.text)))


def _edges(places: list[int]) -> Column:
    return F.array(*[F.lit(float(p)) for p in places])


def _left(form: str) -> Column:
    first = F.get("items", F.lit(0))
    return first.getField("text").rlike(form) & (first.getField("x") <= MARGIN)


def idfc(words: DataFrame) -> DataFrame:
    """Six columns below each page's line of names. Text of lines without a date leads the narration of the next row on the page."""
    d, low = word_lines(words, IDFC_HEIGHT), F.lower("line")
    names = lambda: F.size(F.array_intersect(F.transform("items", lambda w: F.lower(w.text)), F.array(F.lit("debit"), F.lit("credit"), F.lit("balance")))) == 3
    top = d.filter(names()).groupBy("path", "page").agg(F.min("seq").alias("at"))
    d = d.join(top, ["path", "page"]).filter((F.col("seq") > F.col("at")) & ~_has(low, IDFC_SKIP))
    text = F.concat_ws(" ", F.transform(F.filter("items", lambda w: (w.x > MARGIN) & ~F.lower(w.text).isin(IDFC_WORDS)), lambda w: w.text))
    d = d.withColumn("text", text).withColumn("kind", F.when(_left(IDFC_DATE), "row").otherwise("more")).filter("kind = 'row' OR text <> ''")
    d = led(d, ["path", "page"], "items").withColumn("c", _banded(F.col("items"), _edges(IDFC_BANDS)))
    return _rows(d, F.col("c")[0], F.trim(F.concat_ws(" ", "lead", F.col("c")[2])), F.lit(""), F.col("c")[3], F.col("c")[4], F.col("c")[5])


def rbl(words: DataFrame) -> DataFrame:
    """Seven columns after the file's line of names; only lines that begin with a date at the left count."""
    d = word_lines(words, IDFC_HEIGHT)
    starts = F.col("line").contains("DATE") & F.col("line").contains("WITHDRAWAL")
    d = _after(d, starts).filter(~starts & ~_has(F.upper("line"), RBL_SKIP) & _left(RBL_DATE)).withColumn("c", _banded(F.col("items"), _edges(RBL_BANDS)))
    return _rows(d, *[F.col("c")[i] for i in (0, 1, 2, 4, 5, 6)])


def placed(words: DataFrame, keywords: list[str], scanned: int = 30) -> DataFrame:
    """A table by the places of the words in its line of names, the one of the first lines that holds the most keywords (two at least).

    Places snap to 15 points; one more than 20 right of the last begins a column, of which there must be four. Rows have three cells that are
    not empty. Columns without a name of their own are numbered."""
    d, low = word_lines(words, WORD_HEIGHT), F.lower("line")
    hits = F.size(F.filter(F.array(*[F.lit(k) for k in keywords]), lambda k: low.contains(k)))
    top = d.filter(F.col("seq") <= scanned).select("path", hits.alias("hits"), "seq", "items").filter("hits >= 2")
    top = top.groupBy("path").agg(F.min_by(F.struct("seq", "items"), F.struct(-F.col("hits"), F.col("seq"))).alias("t")).select("path", F.col("t.seq").alias("at"), F.col("t.items").alias("names"))
    snapped = F.transform("names", lambda w: F.bround(w.x / 15) * 15)
    edges = F.aggregate(snapped, F.array().cast("array<double>"), lambda got, x: F.when((F.size(got) == 0) | (x - F.element_at(got, -1) > 20), F.array_append(got, x)).otherwise(got))
    top = top.withColumn("edges", edges).filter("size(edges) >= 4").withColumn("header", _banded(F.col("names"), F.col("edges")))
    named = F.transform("header", lambda h, i: F.when(h == "", F.concat(F.lit("col_"), i)).otherwise(h))
    d = d.join(top.select("path", "at", "edges", named.alias("header")), "path").filter((F.col("seq") > F.col("at")) & ~_has(low, ["account holder", "ifsc", "statement period", "page ", "generated"]))
    d = d.withColumn("cells", _banded(F.col("items"), F.col("edges")))
    return d.filter(F.size(F.filter("cells", lambda c: c != "")) >= 3).select("path", "seq", "header", "cells")


# ---------------------------------------------------------------- the parsers in order


def told(name: str, head: Column) -> Column:
    """Whether a file's first lines name the bank of a parser."""
    return _has(F.lower(head), MARKS[name])


def cascade(texts: DataFrame, words: DataFrame | None, keywords: list[str]) -> DataFrame:
    """path, first, header, rows (cells joined by tabs) of texts (path, kind, lines), each from the first parser that finds rows.

    Order: the parser of the bank that the first 25 lines name, dated lines, cells parted by two spaces, by one, words by place. In text
    files tables of two spaces come before dated lines. first is the line of the first row; for words it is after the first 25 lines.
    """
    texts = texts.withColumn("head", F.array_join(F.slice("lines", 1, 25), "\n"))
    lines = texts.select("path", "kind", "head", F.posexplode("lines").alias("n", "line")).withColumn("seq", (F.col("n") + 1).cast("long"))
    of = lambda name: lines.filter(told(name, F.col("head")))
    plain = (F.col("kind") == "txt") & F.ltrim("head").rlike(r"^\d{1,2}[-/ ]\d{1,2}[-/ ]\d{2,4}")
    found = [(1, yes_bank(of("yes_bank"))), (1, baroda(of("baroda"))), (1, kerala(lines.filter(told("kerala", F.col("head")) | plain))), (2, spaced(lines.filter("kind = 'txt'"))), (3, dated_lines(lines)), (4, spaced(lines)), (5, spaced(lines, r"\s+"))]
    if words is not None:
        heads = texts.select("path", "head")
        at = lambda name: words.join(heads.filter(told(name, F.col("head"))).select("path"), "path", "left_semi")
        found += [(1, idfc(at("idfc"))), (1, rbl(at("rbl"))), (6, placed(words, keywords))]
    tables = [t.select("path", "seq", "header", F.array_join("cells", "\t").alias("row"), F.lit(rank).alias("rank"), F.lit(by >= 7).alias("of_words")) for by, (rank, t) in enumerate(found)]
    d = reduce(DataFrame.unionByName, tables).groupBy("path", "rank", "of_words", "header").agg(F.min("seq").alias("first"), F.transform(F.array_sort(F.collect_list(F.struct("seq", "row"))), lambda r: r.row).alias("rows"))
    best = d.groupBy("path").agg(F.min_by(F.struct(F.when(F.col("of_words"), 26).otherwise(F.col("first")).cast("int").alias("first"), "header", "rows"), F.struct("rank", "of_words")).alias("b"))
    return best.select("path", "b.*")
