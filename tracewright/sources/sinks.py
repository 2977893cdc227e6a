"""Writers of a run's tables: Parquet or CSV below one folder, with reports as one line of JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# Statement layouts as (bank, date format, names of date, narration, reference, debit, credit, balance).
LAYOUTS = {
    "SBI": ("dd/MM/yy", ["Txn Date", "Description", "Ref No./Cheque No.", "Debit", "Credit", "Balance"]),
    "HDFC": ("dd/MM/yyyy", ["Date", "Narration", "Chq./Ref.No.", "Withdrawal Amt.", "Deposit Amt.", "Closing Balance"]),
    "ICICI": ("dd-MMM-yyyy", ["Transaction Date", "Transaction Remarks", "Cheque Number", "Withdrawal Amount (INR)", "Deposit Amount (INR)", "Balance (INR)"]),
    "AXIS": ("yyyy-MM-dd", ["Tran Date", "Particulars", "Cheque No", "Debit", "Credit", "Balance"]),
    "CANARA": ("dd-MM-yyyy", ["Date", "Particulars", "Instrument Id", "Withdrawals", "Deposits", "Balance"]),
    "PNB": ("dd.MM.yyyy", ["Post Date", "Remarks", "Cheque No/Ref No", "Debit", "Credit", "Balance"]),
}


def save(table: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", by: list[str] | None = None) -> None:
    writer = table.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", "true")
    (writer.partitionBy(*by) if by else writer).save(path)


def clean_outputs(cleaned: DataFrame, removed: DataFrame, suspects: DataFrame, folder: str, flag: str = "clean_flags") -> None:
    """cleaned, flagged (those of cleaned with flags), removed and suspects as tables, and the counts as report."""
    save(cleaned, f"{folder}/cleaned")
    kept = cleaned.sparkSession.read.parquet(f"{folder}/cleaned")
    save(kept.filter(F.coalesce(F.col(flag), F.lit("")) != ""), f"{folder}/flagged")
    save(removed, f"{folder}/removed")
    save(suspects, f"{folder}/suspects")
    counts = kept.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.coalesce(F.col(flag), F.lit("")) != "").alias("flagged"))
    report(counts, f"{folder}/report")


def findings(tables: dict[str, DataFrame], folder: str) -> None:
    """One table per pattern, below its name."""
    for name, table in tables.items():
        save(table, f"{folder}/{name}")


def report(row: DataFrame, path: str) -> None:
    """A table of one row as a line of JSON."""
    row.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def append_new(table: DataFrame, path: str, key: list[str], fmt: str = "parquet") -> None:
    """Appends the rows whose key the table at path lacks, the first of repeated keys only. A path without a table is begun."""
    spark, fresh = table.sparkSession, table.dropDuplicates(key)
    jvm = spark._jvm.org.apache.hadoop.fs.Path(path)
    if jvm.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm):
        fresh = fresh.join(spark.read.format(fmt).load(path).select(*key), key, "left_anti")
    fresh.write.mode("append").format(fmt).save(path)


def statement(rows: DataFrame, bank: str) -> DataFrame:
    """Unified rows in a bank's layout; without a movement on a side its cell is empty."""
    pattern, names = LAYOUTS[bank]
    money = lambda c: F.when(F.col(c) > 0, F.col(c).cast("decimal(18,2)").cast("string")).otherwise("")
    parts = [F.date_format(F.to_date("date"), pattern), F.col("narration"), F.col("utr_ref"), money("debit"), money("credit"), F.col("balance").cast("decimal(18,2)").cast("string")]
    return rows.select(*[c.alias(n) for c, n in zip(parts, names)])
