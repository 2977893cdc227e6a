"""Queries behind the screens of an investigation, the feature matrix, and their SQL twins for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import parsing
from ..operators import cases, cleaning, detectors, evaluation, features, graph, trails
from ..sources import loader, reports
from ..sources.tables import read, txn_events
from . import catalog

MONEY = "decimal(18,2)"


def with_balance(spark, sf_dir) -> DataFrame:
    """Transactions with a running balance; the event type serves as narration and in capitals as channel, the account as its holder's name."""
    kind = read(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), "event_type")
    t = cleaning.running_balance(txn_events(spark, sf_dir)).join(kind, "seq")
    return t.select("*", F.upper("event_type").alias("channel"), F.col("event_type").alias("narration"), F.col("account_id").alias("holder"), F.col("node").alias("name"))


def rounded(df: DataFrame, places: int = 4) -> DataFrame:
    return df.select(*[F.round(c, places).alias(c) if kind == "double" else F.col(c).cast("long").alias(c) if kind in ("int", "bigint") else F.col(c) for c, kind in df.dtypes])


def features_51(spark, sf_dir):
    m = rounded(features.feature_matrix(with_balance(spark, sf_dir)))
    return m.withColumns({c: F.col(c).cast("long") for c in ("acc_txn_count", "n_unique_counterparties")})


def robust_scaler(spark, sf_dir):
    """Over the amounts, gaps and velocities of the matrix."""
    m = features.row_features(with_balance(spark, sf_dir))
    return rounded(features.robust_stats(m, ["log_abs_amount", "log_mins_since_last_txn", "vel_sum_7d", "vel_count_30d", "is_round_1000"]))


def flagged(spark, sf_dir) -> DataFrame:
    """Transactions with is_high_value, is_velocity and is_breach."""
    t = txn_events(spark, sf_dir)
    for name, found in (("is_high_value", cleaning.iqr_outliers(t)), ("is_velocity", detectors.bursts(t)), ("is_breach", catalog.breach(spark, sf_dir))):
        t = t.join(found.select("seq").distinct().withColumn(name, F.lit(True)), "seq", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return t


def dashboard(spark, sf_dir):
    """Documents' sources with toxic texts stand for rings, orders for cases (O is open)."""
    t = txn_events(spark, sf_dir)
    accounts = t.select("account_id").distinct().join(catalog.suspects(spark, sf_dir).select("account_id", F.lit(True).alias("s")), "account_id", "left").select(F.coalesce("s", F.lit(False)).alias("is_suspect"))
    outliers = cleaning.iqr_outliers(t).select("seq").distinct().withColumn("f", F.lit(True))
    txns = t.join(outliers, "seq", "left").withColumn("is_flagged", F.coalesce("f", F.lit(False)))
    rings = catalog._people(spark, sf_dir).filter("ring_id IS NOT NULL").select("ring_id")
    status = read(spark, sf_dir, "orders").select(F.when(F.col("o_orderstatus") == "O", "open").otherwise("closed").alias("status"))
    return cases.dashboard(accounts, txns, rings, status)


def edge_groups(spark, sf_dir):
    t = with_balance(spark, sf_dir)
    return cases.edge_groups(t.select("account_id", "node", "channel", F.date_format("ts", "yyyy-MM-dd").alias("day"), (F.col("seq") % 3).cast("string").alias("ref"), "amount", (F.col("amount") >= 100000).alias("is_flagged")))


def txn_page(spark, sf_dir):
    """The third page of fifty of the rows of 50,000 and more."""
    rows = txn_events(spark, sf_dir).filter("amount >= 50000").select("seq", "account_id", F.col("amount").cast("double").alias("amount"))
    return cases.counted_page(rows, [F.desc("amount"), F.col("seq")], 100, 50)


def history(spark, sf_dir):
    rows = txn_events(spark, sf_dir).select("seq", "account_id", "t", F.col("amount").cast("double").alias("amount"))
    return cases.newest(rows, "ACC000001", 10).drop("t")


def suspect_graph(spark, sf_dir):
    """Among the 50 accounts that were paid the most."""
    edges = graph.account_edges(txn_events(spark, sf_dir))
    paid = edges.groupBy(F.col("dst").alias("account_id")).agg(F.sum(F.col("total").cast(MONEY)).alias("score"))
    return cases.suspect_graph(edges, paid, 50)


def members(side: str, detector, low: str):
    def run(spark, sf_dir):
        t = txn_events(spark, sf_dir)
        return detectors.window_members(t.filter(low), detector(t))

    return run


def top_flagged(spark, sf_dir):
    """The 500 rows furthest from their account's mean in its spreads."""
    t = txn_events(spark, sf_dir)
    z = features.frozen(t, features.account_stats(t))
    return z.select("seq", "account_id", F.abs("z").alias("score")).orderBy(F.desc("score"), "seq").limit(500)


def provenance(spark, sf_dir):
    """Each removed line with the line that was kept in its place."""
    key, rows = catalog.lines(spark, sf_dir)
    w = Window.partitionBy(*key).orderBy("seq")
    return rows.select(*key, "seq", F.first("seq").over(w).alias("kept"), F.row_number().over(w).alias("copy")).filter("copy > 1").select(*key, "seq", "kept")


def loader_duplicates(spark, sf_dir):
    t = txn_events(spark, sf_dir).select("seq", "account_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.floor(F.col("debit") / 10000).alias("debit"), F.floor(F.col("credit") / 10000).alias("credit"))
    return cleaning.exact_duplicates(t, ["account_id", "day", "debit", "credit"], "seq").select("seq", "account_id")


def reasons(spark, sf_dir):
    """Reasons by the windows of flow, odd hours and the flags of the validation."""
    t = txn_events(spark, sf_dir)
    say = lambda df, text, *cols: df.select("account_id", F.lit(0).alias("at"), F.format_string(text, *cols).alias("reason"))
    whole = lambda c: F.round(c).cast("long")
    found = {
        "fan_in": say(detectors.fan_in(t), "Fan-in collector: %d from %d senders", whole("total"), F.col("peers")),
        "fan_out": say(detectors.fan_out(t), "Fan-out: %d to %d receivers", whole("total"), F.col("peers")),
        "smurfing": say(detectors.smurfing(t), "Smurfing: %d structured transfers, total %d", F.col("txns"), whole("total")),
        "odd_hour": say(detectors.odd_hours(t), "Odd-hour activity: %d transactions", F.col("txns")),
        "velocity": detectors.bursts(t).select("account_id", F.col("seq").alias("at"), F.lit("Velocity burst: rapid successive debits").alias("reason")),
        "high_value": cleaning.iqr_outliers(t).select("account_id", F.col("seq").alias("at"), F.lit("High-value outlier").alias("reason")),
    }
    return detectors.risk_reasons(t.select("account_id").distinct(), found)


def label_truth(spark, sf_dir):
    """How many turns' texts read as a true label."""
    return catalog.narration(spark, sf_dir).groupBy(evaluation.is_true(F.col("text")).alias("is_true")).agg(F.count(F.lit(1)).alias("n"))


def amounts(spark, sf_dir):
    """Prices written in the ways of statements and read again."""
    n, p = F.col("l_linenumber"), F.format_string("%.2f", F.col("l_extendedprice").cast("double"))
    cell = F.when(n == 1, F.concat(F.lit("$"), p)).when(n == 2, F.concat(p, F.lit("/-"))).when(n == 3, F.concat(F.lit("Rs. "), p, F.lit(" Cr"))).when(n == 4, F.concat(F.lit("("), p, F.lit(")"))).when(n == 5, F.lit("n/a")).otherwise(F.concat(F.lit("INR "), p, F.lit(" only *")))
    return read(spark, sf_dir, "lineitem").select("l_orderkey", n, parsing.amount_value(cell).cast("double").alias("amount"), parsing.amount_sign(cell).alias("sign"), parsing.has_amount(cell).alias("is_number"))


def clean_amounts(spark, sf_dir):
    """Prices written as balances are, cleaned with and without their sign."""
    n, p = F.col("l_linenumber"), F.format_string("%.2f", F.col("l_extendedprice").cast("double"))
    near = lambda a, b="": F.concat(F.lit(a), p, F.lit(b))
    cell = F.when(n == 1, near("(", ")")).when(n == 2, near("", " Dr")).when(n == 3, near("Rs. ", " Cr")).when(n == 4, near("-")).when(n == 5, "nil").when(n == 6, near("DR ")).otherwise(near("₹"))
    value = lambda signed: parsing.clean_amount(cell, signed).cast("double")
    return read(spark, sf_dir, "lineitem").select("l_orderkey", n, value(False).alias("amount"), value(True).alias("balance"), parsing.is_corrected(cell, True).alias("is_corrected"))


def model_load(spark, sf_dir):
    """Transactions under other names, every tenth twice, some with times or dates that can't be read."""
    t = txn_events(spark, sf_dir)
    t = t.unionByName(t.filter("seq % 10 = 0"))
    day = F.when(F.col("seq") % 11 == 0, "soon").otherwise(F.date_format("ts", "dd-MM-yyyy"))
    clock = F.when(F.col("seq") % 9 == 0, "noon").otherwise(F.date_format("ts", "HH:mm:ss"))
    money = lambda c: F.concat(F.lit("Rs."), F.col(c).cast("string"))
    raw = t.select(F.col("seq").cast("string").alias("Txn ID"), F.col("account_id").alias(" Acc ID"), day.alias("Txn Date"), clock.alias("Txn Time"), money("debit").alias("Debit Amount"), money("credit").alias("Credit Amount"), F.lit("-").alias("Closing Balance"))
    rows = loader.prepared(loader.usual_columns(raw))
    return rows.select("transaction_id", "account_id", F.date_format("datetime", "yyyy-MM-dd HH:mm:ss").alias("moment"), F.col("amount").cast("double").alias("amount"), "txn_type", "is_duplicate")


def labelled_txns(spark, sf_dir):
    """Accounts and transactions are labelled by rules on their ids; a third of the transactions has no label."""
    t = txn_events(spark, sf_dir).select(F.col("seq").alias("transaction_id"), "account_id")
    people = t.select("account_id").distinct().withColumn("is_fraud", F.when(F.col("account_id").endswith("7"), " Yes").otherwise("no"))
    own = t.filter("transaction_id % 3 <> 0").select("transaction_id", F.when(F.col("transaction_id") % 10 == 0, "TRUE").otherwise("0").alias("label"))
    return evaluation.labelled(t, people, own).select("transaction_id", "acc_is_fraud", "is_fraud_gt")


def _rings(spark, sf_dir) -> DataFrame:
    """Priorities of orders stand for rings, customers for members."""
    money = F.col("o_totalprice").cast(MONEY)
    return read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("ring_id"), F.col("o_custkey").alias("account_id"), F.col("o_orderstatus").alias("role"), money.alias("amount"))


def ring_members(spark, sf_dir):
    members = _rings(spark, sf_dir).groupBy("ring_id", "account_id").agg(F.min("role").alias("role"), F.sum("amount").cast("double").alias("amount"))
    people = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("account_id"), F.col("c_name").alias("holder"), F.col("c_mktsegment").alias("bank"), F.col("c_acctbal").cast("double").alias("risk"))
    return cases.ring_members(members, people, "1-URGENT")


def rings_by_amount(spark, sf_dir):
    return cases.rings_by_amount(_rings(spark, sf_dir).groupBy("ring_id").agg(F.count(F.lit(1)).alias("members"), F.sum("amount").cast("double").alias("amount")))


def flag_descriptions(spark, sf_dir):
    """Flagged transactions; those that end in 5 are near duplicates, in 9 from images."""
    rows = flagged(spark, sf_dir).withColumnsRenamed({"is_high_value": "is_high_value_flag", "is_velocity": "is_velocity_flag", "is_breach": "is_balance_breach"})
    kind = F.when(F.col("seq") % 10 == 9, "image").otherwise("csv")
    rows = rows.withColumns({"is_duplicate": F.col("seq") % 10 == 5, "is_ocr_row": cleaning.is_scanned(kind), "clean_flags": F.coalesce(cleaning.amount_flag(F.col("debit"), F.col("credit")), F.lit(""))})
    with_flags, _ = cleaning.parted(rows)
    return with_flags.select("seq", "account_id", "flag_description")


def fund_trace(spark, sf_dir):
    """Around one account, in one hop."""
    catalog._checkpoints(spark)
    return graph.fund_trace(graph.account_edges(txn_events(spark, sf_dir)), "ACC000001", 1)


def _told(spark, sf_dir) -> DataFrame:
    """Transactions with date and time as text and the counterparty's name."""
    t = with_balance(spark, sf_dir)
    return t.withColumns({"date": F.date_format("ts", "yyyy-MM-dd"), "time": F.date_format("ts", "HH:mm:ss"), "counterparty_name": F.col("node")})


def txn_search(spark, sf_dir):
    """The first page of fifty of views of 50,000 and more in ten days with counterparties whose id holds a 7."""
    found = cases.search(_told(spark, sf_dir), counterparty="7", start="2024-01-05", end="2024-01-14", channel="view", text="VIE", least=50000)
    return cases.page(found, 1, 50).select("seq", "account_id", "date", "time", F.col("amount").cast("double").alias("amount"))


def account_txns(spark, sf_dir):
    return cases.account_txns(_told(spark, sf_dir), "ACC000001", start="2024-01-03", least=1000).select("seq", "date", "time", F.col("debit").cast("double").alias("debit"), F.col("credit").cast("double").alias("credit"))


def account_search(spark, sf_dir):
    """Suspects (in debt) from the third on by risk, twenty at most, among customers of one segment whose name or id holds a 1, with the number of all."""
    people = read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("account_id"), F.col("c_name").alias("holder"), F.lit("").alias("number"), F.col("c_mktsegment").alias("bank"), (F.col("c_acctbal") < 0).alias("is_suspect"), F.col("c_acctbal").cast("double").alias("risk"))
    found = cases.find_accounts(people, bank="build", suspect=True, least=-900, text="1")
    return cases.counted_page(found, [F.desc("risk"), F.col("account_id")], 2, 20).select("account_id", "holder", "risk", "total")


def trail_manifest(spark, sf_dir):
    """Trails of the five accounts with the highest risk (a top-k report), in both directions."""
    catalog._checkpoints(spark)
    t = txn_events(spark, sf_dir)
    roots = catalog.risk(spark, sf_dir).orderBy(F.desc("score"), "account_id").limit(5).select(F.col("account_id").alias("node")).checkpoint()
    both = [trails.trails(t, roots, forward).withColumn("direction", F.lit(name)) for name, forward in (("forward", True), ("backward", False))]
    return reports.trail_manifest(roots, both[0].unionByName(both[1]))


_t = catalog._t


def queries() -> dict:
    return {
        "features_51": features_51,
        "robust_scaler": robust_scaler,
        "global_stats": lambda s, d: rounded(features.global_stats(txn_events(s, d))),
        "hour_stats": lambda s, d: rounded(features.hour_stats(txn_events(s, d))),
        "dashboard": dashboard,
        "daily_totals": catalog.daily_totals,
        "channel_summary": lambda s, d: cases.channel_summary(with_balance(s, d)),
        "flag_counts": lambda s, d: cases.flag_counts(flagged(s, d), ["is_high_value", "is_velocity", "is_breach"]),
        "edge_groups": edge_groups,
        "txn_page": txn_page,
        "txn_lookup": lambda s, d: cases.lookup(txn_events(s, d).select("seq", "account_id", F.col("amount").cast("double").alias("amount")), "seq", 77),
        "risk_history": history,
        "suspect_graph": suspect_graph,
        "round_trip_ends": lambda s, d: detectors.trip_ends(detectors.round_trips(txn_events(s, d))),
        "fan_in_members": members("credit", detectors.fan_in, "credit > 0"),
        "fan_out_members": members("debit", detectors.fan_out, "debit > 0"),
        "smurfing_members": members("debit", detectors.smurfing, "debit >= 35000 AND debit < 50000"),
        "top_flagged": top_flagged,
        "dup_provenance": provenance,
        "loader_duplicates": loader_duplicates,
        "risk_reasons": reasons,
        "label_truth": label_truth,
        "amount_parse": amounts,
        "clean_amounts": clean_amounts,
        "model_load": model_load,
        "labelled_txns": labelled_txns,
        "ring_members": ring_members,
        "rings_by_amount": rings_by_amount,
        "flag_descriptions": flag_descriptions,
        "trail_manifest": trail_manifest,
        "fund_trace": fund_trace,
        "txn_search": txn_search,
        "account_txns": account_txns,
        "account_search": account_search,
    }


def _members_sql(finding: str, side: str) -> str:
    return f"""WITH f AS ({finding}), t AS (WITH {catalog._TXN} SELECT * FROM t)
    SELECT seq, account_id FROM t JOIN f USING (account_id) WHERE {side} AND date_trunc('second', ts) >= window_start::TIMESTAMP AND date_trunc('second', ts) <= window_end::TIMESTAMP"""


def _features_sql() -> str:
    txn, order = catalog._TXN, catalog._ORDER
    codes = ", ".join(f"'{c}'" for c in features.CHANNEL_CODES)
    velocity = []
    for days in (1, 7, 30):
        back = f"OVER (PARTITION BY account_id ORDER BY ts RANGE BETWEEN INTERVAL {days * 24} HOUR PRECEDING AND CURRENT ROW)"
        after = "OVER (PARTITION BY account_id, ts ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
        velocity += [f"(sum(amount) {back} - sum(amount) {after})::DOUBLE AS vel_sum_{days}d", f"count(*) {back} - count(*) {after} AS vel_count_{days}d"]
    told = ", ".join(f"regexp_matches(lower(event_type), '{words}')::BIGINT AS narration_{k}" for k, words in features.NARRATION_WORDS.items())
    turn = lambda f, c, n: f"{f}(2 * pi() * {c} / {n})"
    whole = [c for c in features.MATRIX if c.startswith(("is_", "vel_count", "near_", "narration_")) or c in ("amount_bucket", "hour", "day_of_week", "day_of_month", "month", "rapid_transfer_flag", "acc_txn_count", "n_unique_counterparties", "counterparty_txn_freq", "channel_encoded")]
    out = ", ".join(f"{c}::BIGINT AS {c}" if c in whole else f"round({c}::DOUBLE, 4) AS {c}" for c in features.MATRIX)
    return f"""WITH {txn},
    b AS (SELECT t.*, event_type, sum(credit - debit) OVER {order} AS balance FROM t JOIN events ON event_id = seq),
    r AS (SELECT *, ln(1 + amount::DOUBLE) AS log_abs_amount, (credit > 0)::INT AS is_credit, (debit > 0 AND NOT credit > 0)::INT AS is_debit,
        CASE WHEN amount <= 1000 THEN 0 WHEN amount <= 5000 THEN 1 WHEN amount <= 10000 THEN 2 WHEN amount <= 50000 THEN 3 WHEN amount <= 100000 THEN 4 WHEN amount <= 500000 THEN 5 ELSE 6 END AS amount_bucket,
        hour(ts) AS hour, isodow(ts) - 1 AS day_of_week, day(ts) AS day_of_month, month(ts) AS month, (isodow(ts) >= 6)::INT AS is_weekend, (hour(ts) >= 22 OR hour(ts) <= 5)::INT AS is_night, (hour(ts) >= 23 OR hour(ts) <= 4)::INT AS is_odd_hour,
        {turn('sin', 'hour(ts)', 24)} AS hour_sin, {turn('cos', 'hour(ts)', 24)} AS hour_cos, {turn('sin', '(isodow(ts) - 1)', 7)} AS dow_sin, {turn('cos', '(isodow(ts) - 1)', 7)} AS dow_cos,
        coalesce((t - lag(t) OVER {order}) / 60000000.0::DOUBLE, 99999.0) AS minutes, lag(credit) OVER {order} AS last_credit, (lag(balance) OVER {order})::DOUBLE AS was, {', '.join(velocity)},
        (account_id = node)::INT AS is_self_transfer, coalesce(list_position([{codes}], upper(event_type)), 0) AS channel_encoded, {told}, (balance < 500)::INT AS near_zero_balance,
        (amount >= 9000 AND amount < 10000 OR amount >= 49000 AND amount < 50000 OR amount >= 99000 AND amount < 100000 OR amount >= 199000 AND amount < 200000)::INT AS near_threshold,
        (amount % 1000 = 0)::INT AS is_round_1000, (amount % 5000 = 0)::INT AS is_round_5000, (amount % 10000 = 0)::INT AS is_round_10000 FROM b),
    m AS (SELECT *, ln(1 + minutes) AS log_mins_since_last_txn, coalesce((is_debit = 1 AND last_credit > 0 AND minutes < 120)::INT, 0) AS rapid_transfer_flag,
        least(5.0, greatest(-5.0, coalesce((was - balance::DOUBLE) / (abs(was) + 1e-9), 0.0))) AS balance_drop_pct FROM r),
    g AS (SELECT account_id, avg(amount::DOUBLE) AS acc_avg_amount, stddev_samp(amount::DOUBLE) AS std, median(amount::DOUBLE) AS acc_median_amount, max(amount::DOUBLE) AS acc_max_amount, count(*) AS acc_txn_count, avg(is_credit) AS acc_credit_ratio,
        1 - avg(is_credit) AS acc_debit_ratio, count(*) / (greatest(1, floor((max(t) - min(t)) / 86400000000.0::DOUBLE)) + 1) AS acc_txns_per_day, count(DISTINCT node) AS n_unique_counterparties,
        avg(is_round_1000) AS acc_round_number_ratio, avg(is_night) AS acc_night_txn_ratio, avg(rapid_transfer_flag) AS acc_rapid_transfer_ratio, avg(balance::DOUBLE) AS bm, stddev_samp(balance::DOUBLE) AS bs FROM m GROUP BY 1),
    p AS (SELECT *, coalesce(std, (SELECT median(std) FROM g), 1.0) AS acc_std_amount, coalesce(bs, (SELECT median(bs) FROM g), 1.0) AS balance_std FROM g),
    f AS (SELECT account_id, node, count(*) AS counterparty_txn_freq FROM t GROUP BY ALL),
    x AS (SELECT m.*, p.* EXCLUDE (account_id), counterparty_txn_freq, least(10.0, greatest(-10.0, (amount::DOUBLE - acc_avg_amount) / (acc_std_amount + 1e-9))) AS amount_zscore_vs_account,
        least(10.0, greatest(-10.0, (balance::DOUBLE - bm) / (balance_std + 1e-9))) AS balance_after_zscore, least(10.0, greatest(0.0, balance_std / (abs(bm) + 1e-9))) AS balance_cv FROM m JOIN p USING (account_id) JOIN f USING (account_id, node))
    SELECT seq, account_id, {out} FROM x"""


def oracle_sql() -> dict[str, str]:
    c = catalog
    txn = f"WITH {c._TXN}"
    side = lambda name, one: f"SELECT '{name}' AS feature, {one}::DOUBLE AS v FROM m"
    matrix = _features_sql()
    rows = matrix[: matrix.index("\n    g AS (")].rstrip().rstrip(",")
    columns = ["log_abs_amount", "log_mins_since_last_txn", "vel_sum_7d", "vel_count_30d", "is_round_1000"]
    iqr = f"SELECT DISTINCT seq FROM ({c._IQR})"
    return {
        "features_51": matrix,
        "robust_scaler": f"{rows}, l AS ({' UNION ALL '.join(side(x, x) for x in columns)}), q AS (SELECT feature, quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.5) AS b, quantile_cont(v, 0.75) AS c FROM l GROUP BY 1) SELECT feature, round(b, 4) AS median, round(CASE WHEN c = a THEN 1.0 ELSE c - a END, 4) AS iqr FROM q",
        "global_stats": f"{txn} SELECT round(avg(amount::DOUBLE), 4) AS mean, round(stddev_samp(amount::DOUBLE) + 1e-9, 4) AS std, round(median(amount::DOUBLE), 4) AS median FROM t",
        "hour_stats": f"{txn}, g AS (SELECT hour(ts) AS hour, avg(amount::DOUBLE) AS mean, stddev_samp(amount::DOUBLE) AS std FROM t GROUP BY 1) SELECT hour, round(mean, 4) AS mean, round(coalesce(std, (SELECT median(std) FROM g)), 4) AS std FROM g",
        "dashboard": f"""WITH f AS ({iqr}), s AS ({c._SUSPECTS}), t AS (WITH {c._TXN} SELECT * FROM t), d AS (WITH {c._PEOPLE} SELECT count(DISTINCT ring_id) AS n FROM p)
            SELECT (SELECT count(DISTINCT account_id) FROM t) AS total_accounts, (SELECT count(*) FROM s) AS suspect_accounts, (SELECT count(*) FROM t) AS total_transactions, (SELECT count(*) FROM f) AS flagged_transactions,
            (SELECT coalesce(sum(debit + credit), 0)::DOUBLE FROM t WHERE seq IN (FROM f)) AS total_amount_at_risk, (SELECT n FROM d) AS fraud_rings, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS open_investigations""",
        "daily_totals": f"{txn} SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, count(DISTINCT account_id) AS accounts, sum(amount)::DOUBLE AS total, count(*) FILTER (WHERE amount >= 100000) AS large FROM t GROUP BY 1",
        "channel_summary": f"{txn} SELECT upper(event_type) AS channel, count(*) AS n, sum(debit + credit)::DOUBLE AS total FROM t JOIN events ON event_id = seq GROUP BY 1",
        "flag_counts": f"SELECT (SELECT count(*) FROM events) AS total, (SELECT count(DISTINCT seq) FROM ({c._IQR})) AS is_high_value, (SELECT count(DISTINCT seq) FROM ({c._BURST})) AS is_velocity, (SELECT count(*) FROM (WITH {c._BREACH} SELECT seq FROM c WHERE gap > 1.0)) AS is_breach",
        "edge_groups": f"{txn} SELECT account_id, node, upper(event_type) AS channel, strftime(t.ts, '%Y-%m-%d') AS day, (seq % 3)::VARCHAR AS ref, sum(amount)::DOUBLE AS total, count(*) AS txns, bool_or(amount >= 100000) AS is_flagged FROM t JOIN events ON event_id = seq GROUP BY ALL",
        "txn_page": f"{txn}, r AS (SELECT seq, account_id, amount FROM t WHERE amount >= 50000) SELECT seq, account_id, r.amount::DOUBLE AS amount, (SELECT count(*) FROM r) AS total FROM r ORDER BY r.amount DESC, seq LIMIT 50 OFFSET 100",
        "txn_lookup": f"{txn} SELECT seq, account_id, amount::DOUBLE AS amount FROM t WHERE seq = 77",
        "risk_history": f"{txn} SELECT seq, account_id, amount::DOUBLE AS amount FROM t WHERE account_id = 'ACC000001' ORDER BY t DESC, seq DESC LIMIT 10",
        "suspect_graph": f"WITH {c._EDGES}, k AS (SELECT dst FROM e GROUP BY dst ORDER BY sum(total::DECIMAL(18,2)) DESC, dst LIMIT 50) SELECT * FROM e WHERE src IN (FROM k) AND dst IN (FROM k)",
        "round_trip_ends": f"SELECT account_id FROM ({c._TRIP}) UNION SELECT node FROM ({c._TRIP})",
        "fan_in_members": _members_sql(c._FAN_IN, "credit > 0"),
        "fan_out_members": _members_sql(c._FAN_OUT, "debit > 0"),
        "smurfing_members": _members_sql(c._SMURF, "debit >= 35000 AND debit < 50000"),
        "top_flagged": f"""{txn}, g AS (SELECT account_id, avg(amount::DOUBLE) AS mean, stddev_samp(amount::DOUBLE) AS std FROM t GROUP BY 1), s AS (SELECT account_id, round(mean, 4) AS mean, round(coalesce(std, (SELECT median(std) FROM g), 1.0), 4) AS std FROM g)
            SELECT seq, account_id, abs(round(least(10.0, greatest(-10.0, CASE WHEN std > 0 THEN (amount::DOUBLE - mean) / std ELSE 0 END)), 4)) AS score FROM t JOIN s USING (account_id) ORDER BY score DESC, seq LIMIT 500""",
        "dup_provenance": f"WITH {c._LINES}, k AS (SELECT *, first_value(seq) OVER w AS kept, row_number() OVER w AS copy FROM r WINDOW w AS (PARTITION BY l_orderkey, l_linenumber ORDER BY seq)) SELECT l_orderkey, l_linenumber, seq, kept FROM k WHERE copy > 1",
        "loader_duplicates": f"{txn} SELECT seq, account_id FROM t QUALIFY row_number() OVER (PARTITION BY account_id, strftime(ts, '%Y-%m-%d'), floor(debit / 10000), floor(credit / 10000) ORDER BY seq) > 1",
        "risk_reasons": f"""WITH a AS (SELECT DISTINCT account_id FROM (WITH {c._TXN} SELECT * FROM t)),
            f1 AS (SELECT account_id, format('Fan-in collector: {{}} from {{}} senders', round(total)::BIGINT, peers) AS w1 FROM ({c._FAN_IN})), f2 AS (SELECT account_id, format('Fan-out: {{}} to {{}} receivers', round(total)::BIGINT, peers) AS w2 FROM ({c._FAN_OUT})),
            f3 AS (SELECT account_id, format('Smurfing: {{}} structured transfers, total {{}}', txns, round(total)::BIGINT) AS w3 FROM ({c._SMURF})), f4 AS (SELECT account_id, format('Odd-hour activity: {{}} transactions', txns) AS w4 FROM ({c._ODD})),
            f5 AS (SELECT DISTINCT account_id, 'Velocity burst: rapid successive debits' AS w5 FROM ({c._BURST})), f6 AS (SELECT DISTINCT account_id, 'High-value outlier' AS w6 FROM ({c._IQR})),
            r AS (SELECT account_id, concat_ws(' | ', w1, w2, w3, w4, w5, w6) AS w FROM a LEFT JOIN f1 USING (account_id) LEFT JOIN f2 USING (account_id) LEFT JOIN f3 USING (account_id) LEFT JOIN f4 USING (account_id) LEFT JOIN f5 USING (account_id) LEFT JOIN f6 USING (account_id))
            SELECT account_id, CASE WHEN w = '' THEN 'No suspicious patterns detected' ELSE w END AS reasons FROM r""",
        "label_truth": "SELECT coalesce(lower(trim(text)) IN ('true', '1', 'yes'), false) AS is_true, count(*) AS n FROM conversations GROUP BY 1",
        "amount_parse": """SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 5 THEN 0.0 ELSE round(l_extendedprice, 2) END::DOUBLE AS amount, CASE l_linenumber WHEN 3 THEN '+' WHEN 4 THEN '-' ELSE '' END AS sign, l_linenumber <> 5 AS is_number FROM lineitem""",
        "clean_amounts": """SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 5 THEN 0.0 ELSE round(l_extendedprice, 2) END::DOUBLE AS amount,
            (CASE WHEN l_linenumber = 5 THEN 0.0 WHEN l_linenumber IN (1, 2, 4, 6) THEN -round(l_extendedprice, 2) ELSE round(l_extendedprice, 2) END)::DOUBLE AS balance, l_linenumber NOT IN (4, 5) AND l_extendedprice <> 0 AS is_corrected FROM lineitem""",
        "model_load": f"""{txn}, u AS (SELECT * FROM t UNION ALL SELECT * FROM t WHERE seq % 10 = 0),
            k AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY 1) AS copy FROM u)
            SELECT seq::VARCHAR AS transaction_id, account_id, CASE WHEN seq % 11 = 0 THEN NULL ELSE strftime(CASE WHEN seq % 9 = 0 THEN date_trunc('day', ts) ELSE date_trunc('second', ts) END, '%Y-%m-%d %H:%M:%S') END AS moment,
            (credit - debit)::DOUBLE AS amount, CASE WHEN credit > 0 THEN 'credit' WHEN debit > 0 THEN 'debit' ELSE 'unknown' END AS txn_type, copy > 1 AS is_duplicate FROM k""",
        "labelled_txns": f"{txn} SELECT seq AS transaction_id, account_id LIKE '%7' AS acc_is_fraud, seq % 3 <> 0 AND seq % 10 = 0 AS is_fraud_gt FROM t",
        "ring_members": "SELECT c_custkey AS account_id, any_value(c_name) AS holder, any_value(c_mktsegment) AS bank, min(o_orderstatus) AS role, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS amount, any_value(c_acctbal)::DOUBLE AS risk FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority = '1-URGENT' GROUP BY 1",
        "rings_by_amount": "SELECT o_orderpriority AS ring_id, count(*) AS members, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS amount FROM orders GROUP BY 1 ORDER BY amount DESC, ring_id",
        "flag_descriptions": f"""{txn}, b AS (SELECT seq FROM (WITH {c._BREACH} SELECT seq FROM c WHERE gap > 1.0)), h AS ({iqr}), v AS (SELECT DISTINCT seq FROM ({c._BURST})),
            d AS (SELECT seq, account_id, concat_ws(' | ', CASE WHEN debit = 0 AND credit = 0 THEN 'ZERO_DEBIT_AND_CREDIT' END, CASE WHEN seq % 10 = 5 THEN 'NEAR_DUPLICATE: same date+amounts, different narration' END,
            CASE WHEN seq IN (FROM b) THEN 'BALANCE_BREACH: balance does not reconcile with prior row' END, CASE WHEN seq IN (FROM h) THEN 'HIGH_VALUE_OUTLIER: amount exceeds 3×IQR for this account' END,
            CASE WHEN seq IN (FROM v) THEN 'VELOCITY_BURST: rapid succession of debits in short window' END, CASE WHEN seq % 10 = 9 THEN 'OCR_SOURCE: lower data confidence (scanned image)' END) AS flag_description FROM t)
            SELECT * FROM d WHERE flag_description <> ''""",
        "fund_trace": f"WITH {c._EDGES}, n AS (SELECT 'ACC000001' AS node UNION SELECT dst FROM e WHERE src = 'ACC000001') SELECT * FROM e WHERE src IN (FROM n) AND dst IN (FROM n)",
        "txn_search": f"""{txn} SELECT seq, account_id, strftime(t.ts, '%Y-%m-%d') AS date, strftime(t.ts, '%H:%M:%S') AS time, amount::DOUBLE AS amount FROM t JOIN events ON event_id = seq
            WHERE node LIKE '%7%' AND t.ts >= '2024-01-05' AND t.ts < '2024-01-15' AND event_type = 'view' AND amount >= 50000 ORDER BY date DESC, time DESC, seq LIMIT 50""",
        "account_txns": f"{txn} SELECT seq, strftime(ts, '%Y-%m-%d') AS date, strftime(ts, '%H:%M:%S') AS time, debit::DOUBLE AS debit, credit::DOUBLE AS credit FROM t WHERE account_id = 'ACC000001' AND ts >= '2024-01-03' AND (debit >= 1000 OR credit >= 1000)",
        "account_search": """WITH r AS (SELECT c_custkey::VARCHAR AS account_id, c_name AS holder, c_acctbal::DOUBLE AS risk FROM customer WHERE c_mktsegment ILIKE '%build%' AND c_acctbal < 0 AND c_acctbal >= -900 AND (c_name ILIKE '%1%' OR c_custkey::VARCHAR ILIKE '%1%'))
            SELECT account_id, holder, risk, (SELECT count(*) FROM r) AS total FROM r ORDER BY risk DESC, account_id LIMIT 20 OFFSET 2""",
    }
