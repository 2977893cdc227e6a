"""Streams of unified transactions: arrival by files, removal of repeats, totals of windows, exact bursts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "seq long, account_id string, node string, ts timestamp, narration string, debit double, credit double"


def arrivals(spark: SparkSession, path: str, schema: str = SCHEMA, fmt: str = "parquet", files: int = 100) -> DataFrame:
    """Rows of files as they come in below path, at most `files` of them a batch."""
    reader = spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", files)
    return (reader.option("header", "true") if fmt == "csv" else reader).load(path)


def without_repeats(rows: DataFrame, late: str = "1 day") -> DataFrame:
    """The first of rows with equal account, time, narration and money; repeats later than `late` after it are not known any more."""
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark(["account_id", "ts", "narration", "debit", "credit"])


def window_totals(rows: DataFrame, width: str = "48 hours", slide: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Payments of accounts in sliding windows: count, total, number of receivers (to within 5 %)."""
    paid = rows.filter("debit > 0").withWatermark("ts", late)
    g = paid.groupBy("account_id", F.window("ts", width, slide)).agg(F.count(F.lit(1)).alias("txns"), F.sum("debit").alias("total"), F.approx_count_distinct("node").alias("peers"))
    return g.select("account_id", F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "txns", "total", "peers")


def bursts(rows: DataFrame, minutes: int = 30, least: int = 3, late: str = "1 hour") -> DataFrame:
    """seq, account_id of payments in any window of `minutes` that holds at least `least` of them, each once.

    An account's state is its payments since the watermark less the window, so rows within the allowed lateness are judged right
    in any order of arrival.
    """
    width = minutes * 60_000_000

    def judge(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = [list(x) for x in zip(*state.get)] if state.exists else []
        for batch in batches:
            held += [[int(t), int(s), False] for t, s in zip(batch["t"], batch["seq"])]
        held.sort(key=lambda x: (x[0], x[1]))
        out, end = [], 0
        for begin in range(len(held)):
            while end < len(held) and held[end][0] <= held[begin][0] + width:
                end += 1
            if end - begin >= least:
                for row in held[begin:end]:
                    if not row[2]:
                        row[2] = True
                        out.append(row[1])
        mark = state.getCurrentWatermarkMs() * 1000
        held = [x for x in held if x[0] >= mark - width]
        if held:
            state.update(tuple(list(c) for c in zip(*held)))
            state.setTimeoutTimestamp(max(held[-1][0] // 1000 + minutes * 60_000, mark // 1000 + 1))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame({"seq": out, "account_id": key[0]})

    paid = rows.filter("debit > 0").withWatermark("ts", late).withColumn("t", F.unix_micros("ts")).select("account_id", "seq", "t", "ts")
    return paid.groupBy("account_id").applyInPandasWithState(judge, "seq long, account_id string", "t array<long>, seq array<long>, done array<boolean>", "append", "EventTimeTimeout")


def load(rows: DataFrame, folder: str, checkpoint: str, fmt: str = "parquet") -> StreamingQuery:
    """Writes what has come in so far below folder and ends; a later call goes on after it. checkpoint lies in a shared folder."""
    return rows.writeStream.format(fmt).option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
