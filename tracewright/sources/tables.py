"""Transaction tables from the driver's files.

Money is DECIMAL(18,2) inside, so sums are exact in any order. ``seq`` is the file order that every ordering ends in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def txn_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, account_id, node (the counterparty), ts, t (microseconds), debit, credit, amount."""
    amount = F.round(F.col("value") * 1000, 2).cast("decimal(18,2)")
    zero = F.lit(0).cast("decimal(18,2)")
    is_debit = F.col("event_type").isin("purchase", "click", "view")
    account = lambda c: F.concat(F.lit("ACC"), F.lpad(c.cast("string"), 6, "0"))
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"),
        account(F.col("user_id")).alias("account_id"),
        account(F.get_json_object("props", "$.k")).alias("node"),
        "ts",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("t"),
        F.when(is_debit, amount).otherwise(zero).alias("debit"),
        F.when(is_debit, zero).otherwise(amount).alias("credit"),
        amount.alias("amount"),
    )
