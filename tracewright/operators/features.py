"""Features of transactions: trailing velocity, time, account statistics, pairs, structuring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import HOUR


def velocity(txns: DataFrame, hours: list[int]) -> DataFrame:
    """Sum and count of the account's rows in the hours before each row; of rows at the same instant only earlier ones (by seq) count."""
    by_time = Window.partitionBy("account_id").orderBy("t")
    after = Window.partitionBy("account_id", "t").orderBy("seq").rowsBetween(0, Window.unboundedFollowing)
    out = txns.select("seq", "account_id", "t", "amount")
    for h in hours:
        back = by_time.rangeBetween(-h * HOUR, 0)
        out = out.withColumn(f"sum_{h}h", (F.sum("amount").over(back) - F.sum("amount").over(after)).cast("double")).withColumn(f"n_{h}h", F.count(F.lit(1)).over(back) - F.count(F.lit(1)).over(after))
    return out.select("seq", "account_id", *[c for h in hours for c in (f"sum_{h}h", f"n_{h}h")])


def temporal(txns: DataFrame) -> DataFrame:
    """Hour, weekday (Monday 0), weekend, night and minutes since the account's last row (99999 for its first)."""
    ts = F.timestamp_micros("t")
    gap = (F.col("t") - F.lag("t").over(Window.partitionBy("account_id").orderBy("t", "seq"))) / 60_000_000
    hour, dow = F.hour(ts), F.weekday(ts)
    return txns.select("seq", "account_id", hour.cast("long").alias("hour"), dow.cast("long").alias("dow"), (dow >= 5).alias("is_weekend"), ((hour >= 22) | (hour <= 5)).alias("is_night"), F.round(F.coalesce(gap, F.lit(99999.0)), 4).alias("gap_minutes"), F.coalesce(gap < 120, F.lit(False)).alias("is_rapid"))


def account_stats(txns: DataFrame) -> DataFrame:
    """Frozen per-account statistics; a spread over one row is replaced by the median spread, or 1."""
    g = txns.groupBy("account_id").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("amount").cast("double")).alias("mean"), F.stddev_samp(F.col("amount").cast("double")).alias("std"), F.count_if(F.col("debit") > 0).alias("debits"), F.count_distinct("node").alias("peers"), ((F.max("t") - F.min("t")) / (24 * HOUR)).alias("days"))
    middle = g.agg(F.median("std").alias("middle"))
    return g.crossJoin(F.broadcast(middle)).select("account_id", "n", F.round("mean", 4).alias("mean"), F.round(F.coalesce("std", "middle", F.lit(1.0)), 4).alias("std"), F.round(F.col("debits") / F.col("n"), 4).alias("debit_ratio"), "peers", F.round(F.col("n") / (F.greatest(F.lit(1), F.floor("days")) + 1), 4).alias("txns_per_day"))


def structuring(txns: DataFrame) -> DataFrame:
    """Round amounts, bands just under thresholds, and right-closed amount buckets."""
    a = F.col("amount")
    near = (a >= 9000) & (a < 10000) | (a >= 49000) & (a < 50000) | (a >= 99000) & (a < 100000) | (a >= 199000) & (a < 200000)
    bucket = F.when(a <= 1000, 0).when(a <= 5000, 1).when(a <= 10000, 2).when(a <= 50000, 3).when(a <= 100000, 4).when(a <= 500000, 5).otherwise(6)
    return txns.select("seq", (a % 1000 == 0).alias("is_round"), near.alias("is_near_threshold"), bucket.cast("long").alias("bucket"))


def pair_frequency(txns: DataFrame) -> DataFrame:
    return txns.groupBy("account_id", "node").agg(F.count(F.lit(1)).alias("pair_txns"), F.sum("amount").cast("double").alias("pair_total"))


def frozen(txns: DataFrame, stats: DataFrame) -> DataFrame:
    """Each row's amount against its account's frozen statistics; accounts that these lack take the mean over accounts. z is clipped to +-10."""
    mean = stats.agg(F.avg("mean").alias("mean_"), F.avg("std").alias("std_"))
    d = txns.join(stats.select("account_id", "mean", "std"), "account_id", "left").crossJoin(F.broadcast(mean))  # one row
    centre, spread = F.coalesce("mean", "mean_"), F.coalesce("std", "std_")
    z = F.when(spread > 0, (F.col("amount").cast("double") - centre) / spread).otherwise(0.0)
    return d.select("seq", "account_id", F.round(F.least(F.lit(10.0), F.greatest(F.lit(-10.0), z)), 4).alias("z"), F.col("mean").isNull().alias("is_unseen"))


def rapid_transfers(txns: DataFrame) -> DataFrame:
    """Debits under two hours after the account's row before, when that was a credit."""
    w = Window.partitionBy("account_id").orderBy("t", "seq")
    d = txns.withColumn("gap", F.col("t") - F.lag("t").over(w)).withColumn("last_credit", F.lag("credit").over(w))
    return d.filter((F.col("debit") > 0) & (F.col("last_credit") > 0) & (F.col("gap") < 2 * HOUR)).select("seq", "account_id", F.round(F.col("gap") / 60_000_000, 4).alias("gap_minutes"))


def balance_features(rows: DataFrame) -> DataFrame:
    """Change of the balance as a part of the last one (clipped to +-5) and whether it is nearly zero (below 500)."""
    last = F.lag("balance").over(Window.partitionBy("account_id").orderBy("t", "seq")).cast("double")
    now = F.col("balance").cast("double")
    drop = F.when(F.abs(last) > 0, (last - now) / F.abs(last))
    return rows.select("seq", "account_id", (F.round(F.least(F.lit(5.0), F.greatest(F.lit(-5.0), F.coalesce(drop, F.lit(0.0)))), 4) + 0.0).alias("drop_pct"), (now < 500).alias("is_near_zero"))


# channels' codes; others are 0.
CHANNEL_CODES = ["NEFT", "RTGS", "IMPS", "UPI", "ATM", "POS", "ONLINE", "CASH", "CHARGES", "CHEQUE"]


# Words that tell a narration's kind.
NARRATION_WORDS = {"is_transfer": "transfer|neft|rtgs|imps|trf", "is_cash": "cash|atm|withdraw|wdl", "is_salary": "salary|sal|payroll", "is_upi": "upi|phonepe|gpay|paytm|bhim"}


def narration_flags(narration: Column, channel: Column) -> dict[str, Column]:
    low = F.lower(F.coalesce(narration, F.lit("")))
    code = F.array_position(F.array(*[F.lit(c) for c in CHANNEL_CODES]), F.coalesce(channel, F.lit("")))
    return {"channel_code": code} | {name: low.rlike(words) for name, words in NARRATION_WORDS.items()}


def cyclical(hour: Column, dow: Column) -> dict[str, Column]:
    turn = lambda c, n: 2 * F.pi() * c / n
    return {"hour_sin": F.sin(turn(hour, 24)), "hour_cos": F.cos(turn(hour, 24)), "dow_sin": F.sin(turn(dow, 7)), "dow_cos": F.cos(turn(dow, 7))}


#: The columns of feature_matrix(), in the order in which models take them.
MATRIX = [
    "log_abs_amount", "is_credit", "is_debit", "amount_bucket",
    "hour", "day_of_week", "day_of_month", "month", "is_weekend", "is_night", "is_odd_hour", "hour_sin", "hour_cos", "dow_sin", "dow_cos", "log_mins_since_last_txn", "rapid_transfer_flag",
    "acc_avg_amount", "acc_std_amount", "acc_median_amount", "acc_max_amount", "acc_txn_count", "acc_credit_ratio", "acc_debit_ratio", "acc_txns_per_day", "amount_zscore_vs_account",
    "vel_sum_1d", "vel_count_1d", "vel_sum_7d", "vel_count_7d", "vel_sum_30d", "vel_count_30d",
    "n_unique_counterparties", "counterparty_txn_freq", "is_self_transfer",
    "channel_encoded", "narration_is_transfer", "narration_is_cash", "narration_is_salary", "narration_is_upi",
    "balance_after_zscore", "near_zero_balance", "balance_drop_pct", "balance_cv",
    "near_threshold", "is_round_1000", "is_round_5000", "is_round_10000", "acc_round_number_ratio", "acc_night_txn_ratio", "acc_rapid_transfer_ratio",
]
#: The frozen columns of account_profile() that fill in for accounts it lacks by their mean.
PROFILE = ["acc_avg_amount", "acc_std_amount", "acc_median_amount", "acc_max_amount", "acc_txn_count", "acc_credit_ratio", "acc_debit_ratio", "acc_txns_per_day", "n_unique_counterparties", "acc_round_number_ratio", "acc_night_txn_ratio", "acc_rapid_transfer_ratio", "balance_mean", "balance_std"]


def row_features(txns: DataFrame) -> DataFrame:
    """The features of each row by itself and by its account's rows before it. txns: seq, account_id, node, t, debit, credit, balance, channel, narration, holder, name.

    One shuffle by account serves all windows; amounts are summed as decimals, so order changes nothing."""
    ts, amount = F.timestamp_micros("t"), F.col("abs_amount")
    hour, dow = F.hour(ts), F.weekday(ts)
    order = Window.partitionBy("account_id").orderBy("t", "seq")
    kind = F.when(F.col("credit") > 0, "credit").when(F.col("debit") > 0, "debit").otherwise("unknown")
    d = txns.withColumn("abs_amount", F.abs(F.col("credit") - F.col("debit"))).withColumn("kind", kind)
    by_time = Window.partitionBy("account_id").orderBy("t")
    after = Window.partitionBy("account_id", "t").orderBy("seq").rowsBetween(0, Window.unboundedFollowing)
    for days in (1, 7, 30):
        back = by_time.rangeBetween(-days * 24 * HOUR, 0)
        d = d.withColumn(f"vel_sum_{days}d", (F.sum(amount).over(back) - F.sum(amount).over(after)).cast("double")).withColumn(f"vel_count_{days}d", F.count(F.lit(1)).over(back) - F.count(F.lit(1)).over(after))
    last_balance = F.lag("balance").over(order).cast("double")
    d = d.withColumn("minutes", F.coalesce((F.col("t") - F.lag("t").over(order)) / 60_000_000, F.lit(99999.0))).withColumn("last_kind", F.lag("kind").over(order))
    drop = F.coalesce((last_balance - F.col("balance").cast("double")) / (F.abs(last_balance) + 1e-9), F.lit(0.0))
    d = d.withColumn("balance_drop_pct", F.least(F.lit(5.0), F.greatest(F.lit(-5.0), drop)))
    near = (amount >= 9000) & (amount < 10000) | (amount >= 49000) & (amount < 50000) | (amount >= 99000) & (amount < 100000) | (amount >= 199000) & (amount < 200000)
    bucket = F.when(amount <= 1000, 0).when(amount <= 5000, 1).when(amount <= 10000, 2).when(amount <= 50000, 3).when(amount <= 100000, 4).when(amount <= 500000, 5).otherwise(6)
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    same = lambda c: F.upper(F.trim(F.coalesce(F.col(c), F.lit(""))))
    told = narration_flags(F.col("narration"), F.upper(F.trim("channel")))
    columns = {"log_abs_amount": F.log1p(amount.cast("double")), "is_credit": flag(F.col("kind") == "credit"), "is_debit": flag(F.col("kind") == "debit"), "amount_bucket": bucket}
    columns |= {"hour": hour, "day_of_week": dow, "day_of_month": F.dayofmonth(ts), "month": F.month(ts), "is_weekend": flag(dow >= 5), "is_night": flag((hour >= 22) | (hour <= 5)), "is_odd_hour": flag((hour >= 23) | (hour <= 4))}
    columns |= cyclical(hour, dow) | {"log_mins_since_last_txn": F.log1p("minutes"), "rapid_transfer_flag": flag((F.col("kind") == "debit") & (F.col("last_kind") == "credit") & (F.col("minutes") < 120))}
    columns |= {"is_self_transfer": flag(same("holder") == same("name")), "channel_encoded": told["channel_code"].cast("int")} | {f"narration_{k}": flag(told[k]) for k in NARRATION_WORDS}
    columns |= {"near_zero_balance": flag(F.col("balance") < 500), "near_threshold": flag(near)} | {f"is_round_{k}": flag(amount % k == 0) for k in (1000, 5000, 10000)}
    kept = ["seq", "account_id", "node", "t", "abs_amount", "balance", "balance_drop_pct", *[f"vel_{x}_{k}d" for k in (1, 7, 30) for x in ("sum", "count")]]
    return d.select(*kept, *[c.alias(k) for k, c in columns.items()])


def account_profile(rows: DataFrame) -> DataFrame:
    """The frozen statistics of each account of row_features(). A spread over one row is the median spread, or 1."""
    amount, balance = F.col("abs_amount").cast("double"), F.col("balance").cast("double")
    days = F.greatest(F.lit(1), F.floor((F.max("t") - F.min("t")) / (24 * HOUR)))
    n = F.count(F.lit(1))
    g = rows.groupBy("account_id").agg(
        F.avg(amount).alias("acc_avg_amount"), F.stddev_samp(amount).alias("acc_std_amount"), F.median(amount).alias("acc_median_amount"), F.max(amount).alias("acc_max_amount"), n.alias("acc_txn_count"),
        F.avg("is_credit").alias("acc_credit_ratio"), (1 - F.avg("is_credit")).alias("acc_debit_ratio"), (n / (days + 1)).alias("acc_txns_per_day"), F.count_distinct("node").alias("n_unique_counterparties"),
        F.avg("is_round_1000").alias("acc_round_number_ratio"), F.avg("is_night").alias("acc_night_txn_ratio"), F.avg("rapid_transfer_flag").alias("acc_rapid_transfer_ratio"), F.avg(balance).alias("balance_mean"), F.stddev_samp(balance).alias("balance_std"),
    )
    middle = g.agg(F.median("acc_std_amount").alias("m1"), F.median("balance_std").alias("m2"))
    filled = g.crossJoin(F.broadcast(middle))  # one row
    return filled.withColumn("acc_std_amount", F.coalesce("acc_std_amount", "m1", F.lit(1.0))).withColumn("balance_std", F.coalesce("balance_std", "m2", F.lit(1.0))).drop("m1", "m2")


def feature_matrix(txns: DataFrame, profile: DataFrame | None = None) -> DataFrame:
    """seq, account_id and MATRIX of every row. profile: account_profile() of earlier rows; of these rows, if none is given."""
    rows = row_features(txns)
    if profile is None:
        profile = account_profile(rows)
    mean = profile.agg(*[F.avg(c).alias(f"mean_{c}") for c in PROFILE])
    pairs = rows.groupBy("account_id", "node").agg(F.count(F.lit(1)).alias("counterparty_txn_freq"))
    d = rows.join(pairs, ["account_id", "node"], "left").join(profile.select("account_id", *PROFILE), "account_id", "left").crossJoin(F.broadcast(mean))  # one row
    d = d.select("*", *[F.coalesce(c, f"mean_{c}").alias(f"its_{c}") for c in PROFILE]).drop(*PROFILE)
    d = d.withColumnsRenamed({f"its_{c}": c for c in PROFILE})
    clip = lambda c, low, high: F.least(F.lit(high), F.greatest(F.lit(low), c))
    d = d.withColumn("amount_zscore_vs_account", clip((F.col("abs_amount").cast("double") - F.col("acc_avg_amount")) / (F.col("acc_std_amount") + 1e-9), -10.0, 10.0))
    d = d.withColumn("balance_after_zscore", clip((F.col("balance").cast("double") - F.col("balance_mean")) / (F.col("balance_std") + 1e-9), -10.0, 10.0))
    d = d.withColumn("balance_cv", clip(F.col("balance_std") / (F.abs("balance_mean") + 1e-9), 0.0, 10.0)).withColumn("counterparty_txn_freq", F.coalesce("counterparty_txn_freq", F.lit(0)))
    return d.select("seq", "account_id", *MATRIX)


def global_stats(txns: DataFrame) -> DataFrame:
    a = F.col("amount").cast("double")
    return txns.agg(F.avg(a).alias("mean"), (F.stddev_samp(a) + 1e-9).alias("std"), F.median(a).alias("median"))


def hour_stats(txns: DataFrame) -> DataFrame:
    """Mean and spread of amounts by hour; the spread of a single row is the hours' median spread."""
    a = F.col("amount").cast("double")
    g = txns.groupBy(F.hour(F.timestamp_micros("t")).alias("hour")).agg(F.avg(a).alias("mean"), F.stddev_samp(a).alias("std"))
    return g.crossJoin(F.broadcast(g.agg(F.median("std").alias("middle")))).select("hour", "mean", F.coalesce("std", "middle").alias("std"))  # one row


def robust_stats(rows: DataFrame, columns: list[str]) -> DataFrame:
    """feature, median and IQR (1 where it is 0) of each column: what a robust scaler subtracts and divides by."""
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])).alias("f")).select("f.*")
    q = long.groupBy("feature").agg(F.expr("percentile(value, array(0.25, 0.5, 0.75))").alias("q"))
    iqr = F.col("q")[2] - F.col("q")[0]
    return q.select("feature", F.col("q")[1].alias("median"), F.when(iqr == 0, 1.0).otherwise(iqr).alias("iqr"))
