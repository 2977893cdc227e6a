"""Files for the models: columns under their usual names, defaults, times, money and repeats; labels; tables that were written before."""

from __future__ import annotations

from functools import reduce

import re

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import parsing

# Other names of columns.
ALIASES = {
    "counterparty_account": "counterparty_account_id", "counterparty_acc_id": "counterparty_account_id", "counterparty_acc": "counterparty_account_id", "cp_account_id": "counterparty_account_id",
    "txn_id": "transaction_id", "txnid": "transaction_id", "acc_id": "account_id", "acc_holder": "account_holder", "holder_name": "account_holder", "bank": "bank_name", "txn_date": "date", "txn_time": "time",
    "description": "narration", "remarks": "narration", "mode": "channel", "debit_amount": "debit", "credit_amount": "credit", "closing_balance": "balance", "utr": "utr_ref", "utr_number": "utr_ref", "reference_number": "utr_ref",
}
# What columns hold that a file lacks, and those that it must have.
DEFAULTS = {"account_holder": "UNKNOWN", "bank_name": "UNKNOWN", "time": "00:00:00", "narration": "", "channel": "", "counterparty_account_id": None, "counterparty_name": None, "utr_ref": None}
REQUIRED = ["account_id", "date", "debit", "credit", "balance"]
# Texts and their columns, columns that tell repeats.
TEXTS = ["narration", "channel", "counterparty_name", "bank_name"]
REPEATED = ["transaction_id", "account_id", "date", "debit_clean", "credit_clean"]


def plain_name(name: str) -> str:
    return re.sub("[^a-z0-9_]", "", name.strip().lower().replace(" ", "_"))


def usual_columns(rows: DataFrame) -> DataFrame:
    """Plain names (the first of columns with equal ones stays), usual names besides other ones, defaults. A missing required column raises."""
    places: dict[str, int] = {}
    for i, name in enumerate(rows.columns):
        places.setdefault(plain_name(name), i)
    numbered = rows.toDF(*[f"c{i}" for i in range(len(rows.columns))])
    columns = {name: F.col(f"c{i}") for name, i in places.items()}
    for other, usual in ALIASES.items():
        if other in columns:
            columns.setdefault(usual, columns[other])
    if missing := [c for c in REQUIRED if c not in columns]:
        raise ValueError(f"no column for {', '.join(missing)} among {', '.join(places)}")
    columns.setdefault("transaction_id", F.format_string("TXN%010X", F.monotonically_increasing_id()))
    for name, value in DEFAULTS.items():
        columns.setdefault(name, F.lit(value).cast("string"))
    return numbered.select(*[c.alias(name) for name, c in columns.items()])


def prepared(rows: DataFrame) -> DataFrame:
    """Adds datetime (null if the date can't be read; at midnight if only the time can't), date_parsed, debit_clean, credit_clean,
    balance_clean, amount, abs_amount, txn_type and is_duplicate to usual_columns(). Texts are in capitals, blank ones null.

    The first of rows with equal keys (nulls are equal) is no duplicate; the first is the one with the least place in the input."""
    d = rows.withColumn("its_place", F.monotonically_increasing_id())
    moment = parsing.moment(F.col("date"), F.col("time"))
    d = d.withColumn("datetime", moment).withColumn("date_parsed", F.to_date("datetime"))
    for side in ("debit", "credit", "balance"):
        d = d.withColumn(f"{side}_clean", parsing.clean_amount(F.col(side)))
    amount = F.col("credit_clean") - F.col("debit_clean")
    d = d.withColumn("amount", amount).withColumn("abs_amount", F.abs(amount))
    d = d.withColumn("txn_type", F.when(F.col("credit_clean") > 0, "credit").when(F.col("debit_clean") > 0, "debit").otherwise("unknown"))
    for name in TEXTS:
        text = F.upper(F.trim(name))
        d = d.withColumn(name, F.when(~text.isin("", "NAN"), text))
    copy = F.row_number().over(Window.partitionBy(*REPEATED).orderBy("its_place"))
    return d.withColumn("is_duplicate", copy > 1).drop("its_place")


def load(spark: SparkSession, path: str) -> DataFrame:
    """prepared() rows of the CSV files at path, in the order of accounts and times."""
    rows = spark.read.option("header", "true").option("multiLine", "true").csv(path)
    return prepared(usual_columns(rows)).orderBy("account_id", "datetime", "transaction_id")


def load_report(rows: DataFrame) -> DataFrame:
    """One row: total_rows, accounts, duplicates, date_errors of load()."""
    return rows.agg(F.count(F.lit(1)).alias("total_rows"), F.count_distinct("account_id").alias("accounts"), F.count_if("is_duplicate").alias("duplicates"), F.count_if(F.col("datetime").isNull()).alias("date_errors"))


def labels(spark: SparkSession, folder: str) -> tuple[DataFrame | None, DataFrame | None]:
    """Labels of transactions, and of rings or accounts, from the CSV files of a folder, told apart by their names; None without a file."""
    entries = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(folder).select("path").orderBy("path")
    paths = [r.path for r in entries.collect()]  # names of files alone
    name = lambda p: p.rsplit("/", 1)[-1].lower()
    of_txns = [p for p in paths if "transaction" in name(p)]
    of_rings = [p for p in paths if p not in of_txns and ("ring" in name(p) or "account" in name(p))]
    read = lambda found: reduce(lambda a, b: a.unionByName(b, True), [spark.read.option("header", "true").csv(p) for p in found]) if found else None
    return read(of_txns), read(of_rings)


def reload(spark: SparkSession, path: str, numbers: list[str], flags: list[str]) -> DataFrame:
    """A CSV table that was written before: text, but numbers as doubles (0 if unreadable) and flags as booleans (false if unreadable)."""
    rows = spark.read.option("header", "true").csv(path)
    value = {c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)) for c in numbers if c in rows.columns}
    value |= {c: F.coalesce(F.lower(F.trim(c)).isin("true", "1", "yes"), F.lit(False)) for c in flags if c in rows.columns}
    return rows.withColumns(value)
