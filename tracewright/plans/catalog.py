"""The registered queries over the account tables and their SQL twins for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import parsing
from ..operators import cases, cleaning, detectors, evaluation, features, forest, graph, synthetic, trails
from ..sources.tables import read, txn_events

# ---------------------------------------------------------------- Spark


def _t(operator):
    """A query that applies an operator to the transactions."""
    return lambda spark, sf_dir: operator(txn_events(spark, sf_dir))


def _checkpoints(spark: SparkSession) -> None:
    """checkpoint() needs its folder set on the context; it is the one that the session names."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        if not folder:
            if not context.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            import tempfile

            folder = tempfile.mkdtemp(prefix="tracewright-")
        context.setCheckpointDir(folder)


def layering(spark, sf_dir):
    """All chains, counted by the account where they begin, hops and severity."""
    _checkpoints(spark)
    return detectors.layering_counts(txn_events(spark, sf_dir))


def maximal_layering(spark, sf_dir):
    """Chains that are part of no other, with hops of up to 6 hours."""
    _checkpoints(spark)
    return trails.maximal_chains(detectors.layering(txn_events(spark, sf_dir), hours=6).select("path", "seqs"))


def money_trail(forward: bool):
    """Trails of the five accounts that paid the most."""

    def run(spark, sf_dir):
        _checkpoints(spark)
        t = txn_events(spark, sf_dir)
        roots = t.groupBy("account_id").agg(F.sum("debit").alias("paid")).orderBy(F.desc("paid"), "account_id").limit(5).select(F.col("account_id").alias("node"))
        return trails.trails(t, roots, forward)

    return run


def forest_scores(spark, sf_dir):
    """Every transaction's isolation score from its temporal, structuring and velocity features."""
    t = txn_events(spark, sf_dir)
    flags = features.structuring(t).select("seq", F.col("bucket").alias("bucket"), F.col("is_round").cast("double").alias("is_round"), F.col("is_near_threshold").cast("double").alias("near"))
    rows = t.select("seq", "account_id", F.log1p(F.col("amount").cast("double")).alias("log_amount"))
    rows = rows.join(features.temporal(t).select("seq", "hour", "dow", "gap_minutes"), "seq").join(features.velocity(t, [24, 168]).drop("account_id"), "seq").join(flags, "seq")
    columns = ["log_amount", "hour", "dow", "gap_minutes", "sum_24h", "n_24h", "sum_168h", "n_168h", "bucket", "is_round", "near"]
    return forest.flag(forest.score(rows, "seq", forest.fit(rows, "seq", columns)), 0.03).select("seq", F.round("score", 6).alias("score"), "tier", "is_flagged")


def wcc(spark, sf_dir):
    _checkpoints(spark)
    return graph.weak_components(graph.account_edges(txn_events(spark, sf_dir)))


def ego(spark, sf_dir):
    _checkpoints(spark)
    return graph.ego(graph.account_edges(txn_events(spark, sf_dir)), "ACC000001", 2)


def risk(spark, sf_dir):
    """All nine flags: both ends of round trips, every account of a chain, breaches of the balances of balance_breach."""
    _checkpoints(spark)
    t = txn_events(spark, sf_dir)
    flags = {"round_trip": detectors.trip_ends(detectors.round_trips(t)), "layering": detectors.layered_accounts(t), "high_value": cleaning.iqr_outliers(t), "balance_breach": breach(spark, sf_dir), "fan_in": detectors.fan_in(t), "fan_out": detectors.fan_out(t), "smurfing": detectors.smurfing(t), "odd_hour": detectors.odd_hours(t), "velocity": detectors.bursts(t)}
    return detectors.risk_scores(t, flags, detectors.beneficiaries(t).filter("is_new_high_value"))


def lines(spark, sf_dir):
    key = ["l_orderkey", "l_linenumber"]
    rows = read(spark, sf_dir, "lineitem").select(*key, "l_partkey", "l_suppkey", F.col("l_extendedprice").alias("price"), F.concat_ws("/", "l_returnflag", "l_linestatus").alias("text"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("day"))
    return key, rows.withColumn("seq", F.concat_ws(":", "day", F.lpad(F.col("l_partkey").cast("string"), 9, "0"), F.lpad(F.col("l_suppkey").cast("string"), 9, "0"), F.format_string("%.2f", "price")))


def exact_dedup(spark, sf_dir):
    key, rows = lines(spark, sf_dir)
    return cleaning.exact_duplicates(rows, key, "seq").select(*key, "seq", F.col("copy").cast("long").alias("copy"))


def near_dedup(spark, sf_dir):
    key, rows = lines(spark, sf_dir)
    return cleaning.near_duplicates(rows, key, "text", "seq").select(*key, "seq", "text")


def balances(t: DataFrame) -> DataFrame:
    """A reported balance that drops every seventh row's movement."""
    kept = t.withColumn("credit_", F.when(F.col("seq") % 7 == 0, 0).otherwise(F.col("credit"))).withColumn("debit_", F.when(F.col("seq") % 7 == 0, 0).otherwise(F.col("debit")))
    b = cleaning.running_balance(kept.select("seq", "account_id", "t", F.col("credit_").alias("credit"), F.col("debit_").alias("debit")))
    return t.join(b.select("seq", "balance"), "seq")


def breach(spark, sf_dir):
    return cleaning.balance_breaches(balances(txn_events(spark, sf_dir))).filter("is_breach").select("seq", "account_id", F.col("gap").cast("double").alias("gap"))


def suspects(spark, sf_dir):
    return cleaning.suspects(cleaning.balance_breaches(balances(txn_events(spark, sf_dir))))


def running(spark, sf_dir):
    return cleaning.running_balance(txn_events(spark, sf_dir)).select("seq", "account_id", F.col("balance").cast("double").alias("balance"))


def edges(spark, sf_dir):
    return graph.account_edges(txn_events(spark, sf_dir))


def graph_summary(spark, sf_dir):
    return graph.vertices(graph.account_edges(txn_events(spark, sf_dir)))


def narration(spark, sf_dir):
    """Conversations serve as narrations."""
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", "text")


def channels(spark, sf_dir):
    return narration(spark, sf_dir).groupBy(parsing.channel_of(F.col("text")).alias("channel")).agg(F.count(F.lit(1)).alias("n"))


def normalised(spark, sf_dir):
    return narration(spark, sf_dir).select("conv_id", "turn", F.md5(parsing.normal_text(F.col("text"))).alias("digest"))


def scored(spark, sf_dir):
    """Documents' length as a score of their quality label."""
    d = read(spark, sf_dir, "documents").groupBy("doc_id").agg(F.max("n_chars").alias("n_chars"))
    pairs = d.join(read(spark, sf_dir, "labels"), "doc_id").filter("quality IS NOT NULL")
    return pairs.select(F.round(F.least(F.lit(1.0), F.col("n_chars") / 5000.0), 4).alias("score"), F.col("quality").cast("long").alias("label"))


def search(spark, sf_dir):
    o = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.filter((F.col("o_totalprice") >= 50000) & (F.col("o_totalprice") <= 150000) & F.col("c_mktsegment").ilike("%build%") & (F.col("o_orderstatus") == "O")).orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50).select("o_orderkey", "c_name", "o_totalprice")


def accounts(spark, sf_dir):
    return read(spark, sf_dir, "customer").filter(F.col("c_name").ilike("%00001%") & (F.col("c_acctbal") >= 0)).select("c_custkey", "c_name", "c_acctbal")


def stats(spark, sf_dir):
    t = txn_events(spark, sf_dir)
    return t.groupBy("account_id").agg(F.count(F.lit(1)).alias("n"), F.sum("debit").cast("double").alias("debits"), F.sum("credit").cast("double").alias("credits"), F.max("amount").cast("double").alias("largest"), F.min(F.date_format("ts", "yyyy-MM-dd")).alias("first_day"), F.max(F.date_format("ts", "yyyy-MM-dd")).alias("last_day"))


def daily_totals(spark, sf_dir):
    t = txn_events(spark, sf_dir)
    return t.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("account_id").alias("accounts"), F.sum("amount").cast("double").alias("total"), F.count_if(F.col("amount") >= 100000).alias("large"))


def unknown_counterparties(spark, sf_dir):
    """Counterparties of payments that never received a credit of 150,000 and more themselves."""
    t = txn_events(spark, sf_dir)
    known = t.filter("credit >= 150000").select(F.col("account_id").alias("node")).distinct()
    return t.filter("debit > 0").join(known, "node", "left_anti").select("node").distinct()


def top_amounts(spark, sf_dir):
    return txn_events(spark, sf_dir).orderBy(F.desc("amount"), "seq").limit(500).select("seq", "account_id", F.col("amount").cast("double").alias("amount"))


def date_validation(spark, sf_dir):
    """Days of events, some of them spoilt by a rule on seq, by what is wrong with them."""
    seq, day = F.col("seq"), F.date_format("ts", "yyyy-MM-dd")
    spoilt = F.when(seq % 11 == 0, "").when(seq % 13 == 0, "not a date").when(seq % 17 == 0, "1999-12-31").otherwise(day)
    flagged = txn_events(spark, sf_dir).select(F.coalesce(cleaning.date_flags(spoilt), F.lit("OK")).alias("flag"))
    return flagged.groupBy("flag").agg(F.count(F.lit(1)).alias("n"))


def delta_inference(spark, sf_dir):
    """Every fifth row's movement is blanked and found again from the balance."""
    t = cleaning.running_balance(txn_events(spark, sf_dir))
    blank = lambda c: F.when(F.col("seq") % 5 == 0, 0).otherwise(F.col(c)).cast("decimal(18,2)").alias(c)
    found = cleaning.inferred_movements(t.select("seq", "account_id", "t", blank("debit"), blank("credit"), "balance"))
    return found.filter("is_inferred").select("seq", "account_id", F.col("debit").cast("double").alias("debit"), F.col("credit").cast("double").alias("credit"))


def frozen_join(spark, sf_dir):
    """Statistics of payments, applied to all rows; accounts that paid nothing take the mean."""
    t = txn_events(spark, sf_dir)
    return features.frozen(t, features.account_stats(t.filter("debit > 0")))


def balance_features(spark, sf_dir):
    return features.balance_features(cleaning.running_balance(txn_events(spark, sf_dir)))


def edge_dedup(spark, sf_dir):
    t = txn_events(spark, sf_dir).select("seq", "account_id", "node", F.when(F.col("debit") > 0, "DR").otherwise("CR").alias("channel"), F.date_format("ts", "yyyy-MM-dd").alias("day"))
    return cases.first_of_pairs(t, ["seq"])


def counterparties_semi(spark, sf_dir):
    t = txn_events(spark, sf_dir)
    return cases.counterparties(t, t.select("account_id").distinct(), "ACC000001")


def cross_file_dedup(spark, sf_dir):
    """Lines of orders: customers are accounts, ship days dates."""
    d = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("string").alias("account_id"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("date"), F.col("l_returnflag").alias("narration"), F.floor(F.col("l_quantity")).alias("debit"), F.lit(0).alias("credit"), "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return cleaning.across_files(d, ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]).filter("copy > 1").groupBy("account_id").agg(F.count(F.lit(1)).alias("removed"))


def generic_names(spark, sf_dir):
    """Users stand for accounts, event types for files; no holder is known."""
    t = read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("account_id"), F.lit("").alias("account_holder"), F.col("event_type").alias("source_file"), F.col("event_id").alias("seq"))
    return cleaning.named_holders(t).groupBy("account_id").agg(F.min("account_holder").alias("account_holder"), F.count(F.lit(1)).alias("n"))


def _people(spark, sf_dir):
    """Documents stand for accounts: sources are rings, languages roles and personas, toxic ones fraud, long ones detected."""
    d = read(spark, sf_dir, "documents").groupBy("doc_id").agg(F.max("n_chars").alias("n"), F.max("lang").alias("lang"), F.max("source").alias("source"))
    fraud = F.col("toxic") == 1
    return d.join(read(spark, sf_dir, "labels"), "doc_id").filter("toxic IS NOT NULL").select(F.when(fraud, F.col("source")).alias("ring_id"), F.col("lang").alias("role"), F.col("lang").alias("persona"), fraud.alias("is_fraud"), (F.col("n") >= 1000).alias("detected"), F.least(F.lit(1.0), F.round(F.col("n") / 5000.0, 4)).alias("max_score"))


def account_detection(spark, sf_dir):
    t = txn_events(spark, sf_dir)
    return evaluation.accounts(t.select("account_id", F.least(F.lit(1.0), F.round(F.col("amount").cast("double") / 100000, 4)).alias("score"), (F.col("amount") >= 50000).alias("is_flagged")))


def tier_counts(spark, sf_dir):
    s = scored(spark, sf_dir)
    return evaluation.tier_counts(s.select(forest.tier(F.col("score")).alias("tier")))


def narration_features(spark, sf_dir):
    n = narration(spark, sf_dir)
    flags = features.narration_flags(F.col("text"), parsing.channel_of(F.col("text")))
    return n.select("conv_id", "turn", *[c.cast("long").alias(name) for name, c in flags.items()])


def synth_ledger(spark, sf_dir):
    """A ledger of as many synthetic accounts as there are customers, over three months."""
    people = synthetic.population(spark, read(spark, sf_dir, "customer").count())
    events = synthetic.legitimate(people, "2024-01-01", 3).unionByName(synthetic.fraudulent(people, "2024-01-01"))
    return synthetic.ledger(people, events)


def queries() -> dict:
    return {
        "date_validation": date_validation,
        "delta_inference": delta_inference,
        "frozen_join": frozen_join,
        "rapid_transfer": _t(features.rapid_transfers),
        "balance_features": balance_features,
        "edge_dedup": edge_dedup,
        "counterparties_semi": counterparties_semi,
        "cross_file_dedup": cross_file_dedup,
        "generic_names": generic_names,
        "ring_breakdown": lambda s, d: evaluation.rings(_people(s, d)),
        "persona_fp": lambda s, d: evaluation.personas(_people(s, d)),
        "account_detection": account_detection,
        "tier_counts": tier_counts,
        "best_threshold": lambda s, d: evaluation.best_threshold(scored(s, d)),
        "narration_features": narration_features,
        "synth_ledger": synth_ledger,
        "fan_in": _t(detectors.fan_in),
        "fan_out": _t(detectors.fan_out),
        "smurfing": _t(detectors.smurfing),
        "odd_hours": _t(detectors.odd_hours),
        "round_trip": _t(detectors.round_trips),
        "velocity_burst": _t(detectors.bursts),
        "layering": layering,
        "layering_maximal": maximal_layering,
        "money_trail_forward": money_trail(True),
        "money_trail_backward": money_trail(False),
        "first_edges": _t(trails.first_edges),
        "forest_scores": forest_scores,
        "beneficiary_profile": _t(detectors.beneficiaries),
        "risk_scores": risk,
        "wcc": wcc,
        "ego_graph": ego,
        "account_graph": edges,
        "graph_summary": graph_summary,
        "exact_dedup": exact_dedup,
        "near_dedup": near_dedup,
        "balance_breach": breach,
        "suspect_accounts": suspects,
        "running_balance": running,
        "iqr_outliers": _t(cleaning.iqr_outliers),
        "velocity_features": _t(lambda t: features.velocity(t, [24, 168, 720])),
        "temporal_features": _t(features.temporal),
        "account_stats": _t(features.account_stats),
        "structuring_flags": _t(features.structuring),
        "pair_freq": _t(features.pair_frequency),
        "channel_infer": channels,
        "text_normalise": normalised,
        "confusion": lambda s, d: evaluation.confusion(scored(s, d), 0.3),
        "roc_auc": lambda s, d: evaluation.areas(scored(s, d)),
        "pr_curve": lambda s, d: evaluation.curve(scored(s, d)).select("score", "tp", "fp"),
        "score_hist": lambda s, d: evaluation.histogram(scored(s, d), 20),
        "search_txns": search,
        "account_list": accounts,
        "txn_stats": stats,
        "counterparties_anti": unknown_counterparties,
        "top_amounts": top_amounts,
    }


# ---------------------------------------------------------------- DuckDB

_TXN = """t AS (
  SELECT event_id AS seq, 'ACC' || lpad(user_id::VARCHAR, 6, '0') AS account_id, 'ACC' || lpad(json_extract_string(props, '$.k'), 6, '0') AS node,
         ts, epoch_us(ts) AS t, round(value * 1000, 2)::DECIMAL(18,2) AS amount,
         (CASE WHEN event_type IN ('purchase', 'click', 'view') THEN round(value * 1000, 2) ELSE 0 END)::DECIMAL(18,2) AS debit,
         (CASE WHEN event_type IN ('purchase', 'click', 'view') THEN 0 ELSE round(value * 1000, 2) END)::DECIMAL(18,2) AS credit
  FROM events)"""


def _window(side: str, width: str, test: str, critical: int) -> str:
    over = f"(PARTITION BY account_id ORDER BY ts RANGE BETWEEN CURRENT ROW AND INTERVAL {width} FOLLOWING)"
    return f"""WITH {_TXN}, side AS ({side}),
    w AS (SELECT account_id, ts, seq, max(ts) OVER {over} AS last_ts, count(DISTINCT node) OVER {over} AS peers, count(*) OVER {over} AS txns, sum(amount) OVER {over} AS total FROM side),
    p AS (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY ts, seq) AS r FROM w WHERE {test})
    SELECT account_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS window_start, strftime(last_ts, '%Y-%m-%d %H:%M:%S') AS window_end, peers, txns, total::DOUBLE AS total,
           CASE WHEN peers >= {critical} THEN 'CRITICAL' ELSE 'HIGH' END AS severity FROM p WHERE r = 1"""


_FAN_IN = _window("SELECT account_id, ts, seq, node, credit AS amount FROM t WHERE credit > 0", "72 HOUR", "peers >= 4 AND total >= 20000", 8)
_FAN_OUT = _window("SELECT account_id, ts, seq, node, debit AS amount FROM t WHERE debit > 0", "48 HOUR", "peers >= 4 AND total >= 20000", 8)
_SMURF = _window("SELECT account_id, ts, seq, node, debit AS amount FROM t WHERE debit >= 35000 AND debit < 50000", "14 DAY", "peers >= 2 AND txns >= 3", 1 << 30)
_ODD = f"WITH {_TXN} SELECT account_id, count(*) AS txns, sum(amount)::DOUBLE AS total, count(DISTINCT hour(ts)) AS hours FROM t WHERE hour(ts) < 5 GROUP BY account_id HAVING count(*) >= 3"
_TRIP = f"""WITH {_TXN} SELECT d.account_id, d.node, d.seq AS debit_seq, c.seq AS credit_seq, round(c.credit::DOUBLE / d.debit::DOUBLE, 4) AS ratio,
  round((c.t - d.t) / 86400000000.0::DOUBLE, 4) AS gap_days, CASE WHEN c.t - d.t < 3 * 86400000000 THEN 'HIGH' ELSE 'MEDIUM' END AS severity
  FROM t d JOIN t c ON d.account_id = c.account_id AND d.node = c.node AND c.t > d.t AND c.t <= d.t + 30 * 86400000000
  WHERE d.debit > 5000 AND c.credit > 5000 AND c.credit >= d.debit * 0.70::DECIMAL(4,2)"""
_BURST = f"""WITH {_TXN}, a AS (SELECT *, count(*) OVER (PARTITION BY account_id ORDER BY ts RANGE BETWEEN CURRENT ROW AND INTERVAL 30 MINUTE FOLLOWING) AS ahead FROM t WHERE debit > 0 AND t % 86400000000 <> 0),
  b AS (SELECT *, max(ahead) OVER (PARTITION BY account_id ORDER BY ts RANGE BETWEEN INTERVAL 30 MINUTE PRECEDING AND CURRENT ROW) AS best FROM a)
  SELECT seq, account_id, best AS window_txns FROM b WHERE best >= 3"""
_BENE = f"""{_TXN}, a AS (SELECT account_id, avg(debit::DOUBLE) AS mean, CASE WHEN count(*) > 1 THEN stddev_pop(debit::DOUBLE) ELSE 1.0 END AS std, max(debit) AS top FROM t WHERE debit > 0 GROUP BY 1),
  g AS (SELECT account_id, node, sum(debit) AS total, count(*) AS txns, max(debit) AS largest, strftime(min(ts), '%Y-%m-%d') AS first_day, strftime(max(ts), '%Y-%m-%d') AS last_day FROM t WHERE debit > 0 AND trim(node) NOT IN ('', 'nan') GROUP BY ALL),
  z AS (SELECT *, CASE WHEN std > 0 THEN (largest::DOUBLE - mean) / std ELSE 0 END AS z FROM g JOIN a USING (account_id)),
  bene AS (SELECT account_id, node, total::DOUBLE AS total, txns, largest::DOUBLE AS largest, first_day, last_day, round(z, 3) AS z, z >= 2.5 AS is_high_value, txns = 1 AND largest::DOUBLE >= 0.5 * top::DOUBLE AS is_new_high_value FROM z)"""
_IQR = f"""WITH {_TXN}, k AS (SELECT account_id FROM t GROUP BY 1 HAVING count(*) >= 10),
  m AS (SELECT seq, account_id, 'DEBIT' AS side, debit AS amount FROM t WHERE debit > 0 UNION ALL SELECT seq, account_id, 'CREDIT', credit FROM t WHERE credit > 0),
  q AS (SELECT account_id, side, quantile_cont(amount::DOUBLE, 0.25) AS q1, quantile_cont(amount::DOUBLE, 0.75) AS q3 FROM m WHERE account_id IN (FROM k) GROUP BY ALL HAVING count(*) >= 4)
  SELECT seq, account_id, side, amount::DOUBLE AS amount, round(q3 + 3.0 * (q3 - q1), 4) AS fence FROM m JOIN q USING (account_id, side) WHERE q3 > q1 AND amount::DOUBLE > q3 + 3.0 * (q3 - q1)"""
_BREACH = f"""{_TXN}, b AS (SELECT *, sum(CASE WHEN seq % 7 = 0 THEN 0 ELSE credit - debit END) OVER (PARTITION BY account_id ORDER BY t, seq) AS balance FROM t),
  l AS (SELECT *, lag(balance) OVER (PARTITION BY account_id ORDER BY t, seq) AS last FROM b), c AS (SELECT *, CASE WHEN NOT coalesce(last = 0 AND balance = 0, false) THEN abs(balance - (last + credit - debit)) END AS gap FROM l)"""
_SUSPECTS = f"""WITH {_BREACH}, g AS (SELECT account_id, count(*) AS n_rows, count(*) FILTER (WHERE gap > 1.0) AS breaches FROM c GROUP BY account_id HAVING count(*) >= 2)
  SELECT account_id, n_rows, breaches, round(breaches / n_rows, 4) AS ratio, CASE WHEN breaches / n_rows > 0.5 THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM g WHERE breaches / n_rows > 0.05"""
_LAYERED = f"""WITH {_TXN}, e AS (SELECT account_id AS src, node AS dst, t FROM t WHERE debit >= 10000 AND node <> account_id),
  c AS (SELECT x.src AS a1, x.dst AS a2, y.dst AS a3, z.dst AS a4 FROM e x JOIN e y ON y.src = x.dst AND y.t >= x.t AND y.t <= x.t + 72 * 3600000000 JOIN e z ON z.src = y.dst AND z.t >= y.t AND z.t <= y.t + 72 * 3600000000
        WHERE y.dst <> x.src AND z.dst NOT IN (x.src, x.dst))
  SELECT a1 AS account_id FROM c UNION SELECT a2 FROM c UNION SELECT a3 FROM c UNION SELECT a4 FROM c"""
_FLAGS = {"ROUND_TRIP": (20, f"SELECT account_id FROM ({_TRIP}) UNION SELECT node FROM ({_TRIP})"), "LAYERING": (20, _LAYERED), "FAN_IN": (10, _FAN_IN), "FAN_OUT": (10, _FAN_OUT), "SMURFING": (15, _SMURF), "ODD_HOUR": (8, _ODD), "VELOCITY": (7, _BURST), "HIGH_VALUE": (5, _IQR), "BALANCE_BREACH": (5, f"WITH {_BREACH} SELECT account_id FROM c WHERE gap > 1.0"), "NEW_HV_BENE": (5, f"WITH {_BENE} SELECT account_id FROM bene WHERE is_new_high_value")}
_RISK = f"""WITH a AS (SELECT DISTINCT account_id FROM (WITH {_TXN} SELECT * FROM t)), {', '.join(f'{k} AS (SELECT DISTINCT account_id FROM ({q}))' for k, (_, q) in _FLAGS.items())},
  h AS (SELECT account_id, {', '.join(f'account_id IN (FROM {k}) AS h_{k}' for k in _FLAGS)} FROM a),
  s AS (SELECT *, least(100, {' + '.join(f'h_{k}::INT * {w}' for k, (w, _) in _FLAGS.items())})::DOUBLE AS score, concat_ws(' | ', {', '.join(f"CASE WHEN h_{k} THEN '{k}' END" for k in _FLAGS)}) AS p FROM h)
  SELECT account_id, score, CASE WHEN score >= 75 THEN 'CRITICAL' WHEN score >= 50 THEN 'HIGH' WHEN score >= 25 THEN 'MEDIUM' ELSE 'LOW' END AS tier, CASE WHEN p = '' THEN 'NONE' ELSE p END AS active_patterns FROM s"""
_EDGES = f"{_TXN}, e AS (SELECT account_id AS src, node AS dst, sum(debit)::DOUBLE AS total, count(*) AS txns FROM t WHERE debit > 0 AND account_id <> node GROUP BY ALL)"
_LINES = """r AS (SELECT l_orderkey, l_linenumber, l_returnflag || '/' || l_linestatus AS text,
  strftime(l_shipdate, '%Y-%m-%d') || ':' || lpad(l_partkey::VARCHAR, 9, '0') || ':' || lpad(l_suppkey::VARCHAR, 9, '0') || ':' || printf('%.2f', l_extendedprice) AS seq FROM lineitem)"""
_SCORED = """s AS (SELECT round(least(1.0::DOUBLE, n / 5000.0::DOUBLE), 4) AS score, quality::BIGINT AS label FROM (SELECT doc_id, max(n_chars) AS n FROM documents GROUP BY doc_id) JOIN labels USING (doc_id) WHERE quality IS NOT NULL)"""
_CURVE = _SCORED + """, g AS (SELECT score, sum(label) AS p, sum(1 - label) AS n FROM s GROUP BY 1),
  c AS (SELECT *, sum(p) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS fp, sum(p) OVER () AS ps, sum(n) OVER () AS ns FROM g)"""


def _channel_sql() -> str:
    cases = " ".join("WHEN " + " OR ".join(f"contains(lower(text), '{k}')" for k in keys) + f" THEN '{name}'" for name, keys in parsing.CHANNELS)
    return f"SELECT CASE {cases} ELSE 'OTHER' END AS channel, count(*) AS n FROM conversations GROUP BY 1"


def _velocity_sql(hours: list[int]) -> str:
    cols = []
    for h in hours:
        back = f"OVER (PARTITION BY account_id ORDER BY ts RANGE BETWEEN INTERVAL {h} HOUR PRECEDING AND CURRENT ROW)"
        after = "OVER (PARTITION BY account_id, ts ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
        cols += [f"(sum(amount) {back} - sum(amount) {after})::DOUBLE AS sum_{h}h", f"count(*) {back} - count(*) {after} AS n_{h}h"]
    return f"WITH {_TXN} SELECT seq, account_id, {', '.join(cols)} FROM t"


_LAYERS = f"""WITH RECURSIVE {_TXN}, e AS (SELECT account_id AS src, node AS dst, t, debit AS amount, seq FROM t WHERE debit >= 10000 AND node <> account_id),
  l AS (SELECT [src, dst] AS path, [seq] AS seqs, dst AS fin, t AS last_t, 1 AS hops FROM e
        UNION ALL SELECT list_append(path, dst), list_append(seqs, seq), dst, e.t, hops + 1 FROM l JOIN e ON e.src = l.fin AND e.t >= last_t AND e.t <= last_t + 6 * 3600000000 AND NOT list_contains(path, e.dst) WHERE hops < 8),
  c AS (SELECT path, array_to_string(path, '>') AS p, array_to_string(seqs, '>') AS s FROM l WHERE hops >= 3)"""


_PEOPLE = """d AS (SELECT doc_id, max(n_chars) AS n, max(lang) AS lang, max(source) AS source FROM documents GROUP BY doc_id),
  p AS (SELECT CASE WHEN toxic = 1 THEN source END AS ring_id, lang AS role, lang AS persona, toxic = 1 AS is_fraud, n >= 1000 AS detected, least(1.0::DOUBLE, round(n / 5000.0::DOUBLE, 4)) AS max_score
        FROM d JOIN labels USING (doc_id) WHERE toxic IS NOT NULL)"""
_ORDER = "(PARTITION BY account_id ORDER BY t, seq)"


def _more_sql() -> dict:
    codes = ", ".join(f"'{c}'" for c in features.CHANNEL_CODES)
    cases_ = " ".join("WHEN " + " OR ".join(f"contains(lower(text), '{k}')" for k in keys) + f" THEN '{name}'" for name, keys in parsing.CHANNELS)
    return {
        "date_validation": f"""WITH {_TXN}, s AS (SELECT CASE WHEN seq % 11 = 0 THEN '' WHEN seq % 13 = 0 THEN 'not a date' WHEN seq % 17 = 0 THEN '1999-12-31' ELSE strftime(ts, '%Y-%m-%d') END AS d FROM t)
            SELECT CASE WHEN d = '' THEN 'NULL_DATE' WHEN try_strptime(d, '%Y-%m-%d') IS NULL THEN 'BAD_DATE_FORMAT' WHEN year(try_strptime(d, '%Y-%m-%d')) NOT BETWEEN 2000 AND 2030 THEN 'DATE_OUT_OF_RANGE' ELSE 'OK' END AS flag, count(*) AS n FROM s GROUP BY 1""",
        "delta_inference": f"""WITH {_TXN}, b AS (SELECT *, sum(credit - debit) OVER {_ORDER} AS balance FROM t), l AS (SELECT *, balance - lag(balance) OVER {_ORDER} AS step FROM b)
            SELECT seq, account_id, greatest(-step, 0)::DOUBLE AS debit, greatest(step, 0)::DOUBLE AS credit FROM l WHERE seq % 5 = 0 AND balance <> 0 AND step IS NOT NULL AND step <> 0""",
        "frozen_join": f"""WITH {_TXN}, g AS (SELECT account_id, avg(amount::DOUBLE) AS mean, stddev_samp(amount::DOUBLE) AS std FROM t WHERE debit > 0 GROUP BY 1),
            s AS (SELECT account_id, round(mean, 4) AS mean, round(coalesce(std, (SELECT median(std) FROM g), 1.0), 4) AS std FROM g), m AS (SELECT avg(mean) AS mean_, avg(std) AS std_ FROM s)
            SELECT seq, t.account_id, round(least(10.0, greatest(-10.0, CASE WHEN coalesce(std, std_) > 0 THEN (amount::DOUBLE - coalesce(mean, mean_)) / coalesce(std, std_) ELSE 0 END)), 4) AS z, mean IS NULL AS is_unseen FROM t LEFT JOIN s USING (account_id), m""",
        "rapid_transfer": f"""WITH {_TXN}, l AS (SELECT *, t - lag(t) OVER {_ORDER} AS gap, lag(credit) OVER {_ORDER} AS last_credit FROM t)
            SELECT seq, account_id, round(gap / 60000000.0::DOUBLE, 4) AS gap_minutes FROM l WHERE debit > 0 AND last_credit > 0 AND gap < 7200000000""",
        "balance_features": f"""WITH {_TXN}, b AS (SELECT *, (sum(credit - debit) OVER {_ORDER})::DOUBLE AS now FROM t), l AS (SELECT *, lag(now) OVER {_ORDER} AS was FROM b)
            SELECT seq, account_id, round(least(5.0, greatest(-5.0, coalesce(CASE WHEN abs(was) > 0 THEN (was - now) / abs(was) END, 0))), 4)::DOUBLE + 0.0::DOUBLE AS drop_pct, now < 500 AS is_near_zero FROM l""",
        "edge_dedup": f"""WITH {_TXN}, e AS (SELECT seq, account_id, node, CASE WHEN debit > 0 THEN 'DR' ELSE 'CR' END AS channel, strftime(ts, '%Y-%m-%d') AS day FROM t)
            SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY least(account_id, node), greatest(account_id, node), channel, day ORDER BY seq) = 1""",
        "counterparties_semi": f"WITH {_TXN} SELECT DISTINCT account_id FROM t WHERE account_id IN (SELECT node FROM t WHERE account_id = 'ACC000001')",
        "cross_file_dedup": """SELECT account_id, sum(n - 1)::BIGINT AS removed FROM (SELECT l_suppkey::VARCHAR AS account_id, count(*) AS n FROM lineitem GROUP BY l_suppkey, l_shipdate::DATE, l_returnflag, floor(l_quantity))
            GROUP BY 1 HAVING sum(n - 1) > 0""",
        "generic_names": """WITH f AS (SELECT user_id::VARCHAR AS account_id, min((event_type, event_id)) AS first, count(*) AS n FROM events GROUP BY 1)
            SELECT account_id, 'Person ' || row_number() OVER (ORDER BY first) AS account_holder, n FROM f""",
        "ring_breakdown": f"""WITH {_PEOPLE} SELECT ring_id, count(*) AS accounts, count(*) FILTER (detected) AS found, round(100.0::DOUBLE * count(*) FILTER (detected) / count(*), 2) AS detection_pct, round(avg(max_score), 6) AS avg_max_score,
            coalesce(string_agg(DISTINCT role, ', ' ORDER BY role), '') AS roles FROM p WHERE ring_id IS NOT NULL GROUP BY 1""",
        "persona_fp": f"WITH {_PEOPLE} SELECT persona, count(*) AS accounts, count(*) FILTER (detected) AS false_alarms, round(100.0::DOUBLE * count(*) FILTER (detected) / count(*), 2) AS false_alarm_pct FROM p WHERE NOT is_fraud GROUP BY 1",
        "account_detection": f"""WITH {_TXN}, s AS (SELECT account_id, least(1.0::DOUBLE, round(amount::DOUBLE / 100000, 4)) AS score, amount >= 50000 AS is_flagged FROM t)
            SELECT account_id, count(*) AS txns, count(*) FILTER (is_flagged) AS flagged, bool_or(is_flagged) AS detected, round(max(score), 6) AS max_score, round(avg(score), 6) AS avg_score FROM s GROUP BY 1""",
        "tier_counts": f"""WITH {_SCORED}, k AS (SELECT CASE WHEN score <= 0.30 THEN 0 WHEN score <= 0.50 THEN 1 WHEN score <= 0.65 THEN 2 WHEN score <= 0.80 THEN 3 ELSE 4 END AS place FROM s),
            names AS (SELECT unnest([0, 1, 2, 3, 4])::BIGINT AS place, unnest(['Very Low', 'Low', 'Medium', 'High', 'Critical']) AS tier)
            SELECT names.place, tier, count(k.place) AS n FROM names LEFT JOIN k ON k.place = names.place GROUP BY 1, 2""",
        "best_threshold": f"""WITH {_CURVE}, f AS (SELECT score, 2 * tp / (tp + fp + ps)::DOUBLE AS f1 FROM c)
            SELECT score AS threshold, round(f1, 6) AS f1 FROM f ORDER BY round(f1, 9) DESC, score DESC LIMIT 1""",
        "narration_features": f"""WITH c AS (SELECT conv_id, turn, lower(coalesce(text, '')) AS low, CASE {cases_} ELSE 'OTHER' END AS channel FROM conversations)
            SELECT conv_id, turn, coalesce(list_position([{codes}], channel), 0)::BIGINT AS channel_code, {', '.join(f"regexp_matches(low, '{words}')::BIGINT AS {k}" for k, words in features.NARRATION_WORDS.items())} FROM c""",
    }


def oracle_sql() -> dict[str, str]:
    return _more_sql() | {
        "layering_maximal": f"""{_LAYERS} SELECT p AS path, s AS seqs FROM c a WHERE NOT EXISTS (SELECT 1 FROM c b WHERE list_has_all(b.path, a.path)
          AND (len(b.path) > len(a.path) OR (len(b.path) = len(a.path) AND (b.p < a.p OR (b.p = a.p AND b.s < a.s)))))""",
        "first_edges": f"""WITH {_TXN}, r AS (SELECT least(account_id, node) AS a, greatest(account_id, node) AS b, strftime(ts, '%Y-%m-%d') AS day, seq, debit::DOUBLE AS amount,
          row_number() OVER (PARTITION BY least(account_id, node), greatest(account_id, node), strftime(ts, '%Y-%m-%d') ORDER BY seq) AS k FROM t WHERE debit > 0) SELECT a, b, day, seq, amount FROM r WHERE k = 1""",
        "fan_in": _FAN_IN,
        "fan_out": _FAN_OUT,
        "smurfing": _SMURF,
        "odd_hours": _ODD,
        "round_trip": _TRIP,
        "velocity_burst": _BURST,
        "beneficiary_profile": f"WITH {_BENE} SELECT * FROM bene",
        "risk_scores": _RISK,
        "wcc": f"""WITH RECURSIVE {_TXN}, b AS (SELECT DISTINCT account_id AS x, node AS y FROM t WHERE debit > 0 AND account_id <> node),
          e AS (SELECT x, y FROM b UNION SELECT y, x FROM b), r AS (SELECT x AS node, x AS reach FROM e UNION SELECT r.node, e.y FROM r JOIN e ON e.x = r.reach)
          SELECT node, min(reach) AS component FROM r GROUP BY node""",
        "ego_graph": f"""WITH RECURSIVE {_TXN}, e AS (SELECT DISTINCT account_id AS x, node AS y FROM t WHERE debit > 0 AND account_id <> node),
          r AS (SELECT 'ACC000001' AS node, 0 AS hop UNION SELECT e.y, hop + 1 FROM r JOIN e ON e.x = r.node WHERE hop < 2) SELECT node, min(hop)::BIGINT AS hop FROM r GROUP BY node""",
        "account_graph": f"WITH {_EDGES} SELECT * FROM e",
        "graph_summary": f"""WITH {_EDGES}, u AS (SELECT src AS node, 1 AS o, 0 AS i, total AS sent, 0.0::DOUBLE AS received FROM e UNION ALL SELECT dst, 0, 1, 0.0::DOUBLE, total FROM e)
          SELECT node, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree, round(sum(sent), 2) AS sent, round(sum(received), 2) AS received FROM u GROUP BY node""",
        "exact_dedup": f"WITH {_LINES}, c AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY seq) AS copy FROM r) SELECT l_orderkey, l_linenumber, seq, copy FROM c WHERE copy > 1",
        "near_dedup": f"WITH {_LINES}, c AS (SELECT *, first_value(text) OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY seq) AS f FROM r) SELECT l_orderkey, l_linenumber, seq, text FROM c WHERE text IS DISTINCT FROM f",
        "balance_breach": f"WITH {_BREACH} SELECT seq, account_id, gap::DOUBLE AS gap FROM c WHERE gap > 1.0",
        "suspect_accounts": _SUSPECTS,
        "running_balance": f"WITH {_TXN} SELECT seq, account_id, (sum(credit - debit) OVER (PARTITION BY account_id ORDER BY t, seq))::DOUBLE AS balance FROM t",
        "iqr_outliers": _IQR,
        "velocity_features": _velocity_sql([24, 168, 720]),
        "temporal_features": f"""WITH {_TXN}, g AS (SELECT *, (t - lag(t) OVER (PARTITION BY account_id ORDER BY t, seq)) / 60000000.0::DOUBLE AS gap FROM t)
          SELECT seq, account_id, hour(ts) AS hour, isodow(ts) - 1 AS dow, isodow(ts) >= 6 AS is_weekend, hour(ts) >= 22 OR hour(ts) <= 5 AS is_night, round(coalesce(gap, 99999.0), 4) AS gap_minutes, coalesce(gap < 120, false) AS is_rapid FROM g""",
        "account_stats": f"""WITH {_TXN}, g AS (SELECT account_id, count(*) AS n, avg(amount::DOUBLE) AS mean, stddev_samp(amount::DOUBLE) AS std, count(*) FILTER (WHERE debit > 0) AS debits, count(DISTINCT node) AS peers, (max(t) - min(t)) / 86400000000.0::DOUBLE AS days FROM t GROUP BY account_id)
          SELECT account_id, n, round(mean, 4) AS mean, round(coalesce(std, (SELECT median(std) FROM g), 1.0), 4) AS std, round(debits / n, 4) AS debit_ratio, peers, round(n / (greatest(1, floor(days)) + 1), 4) AS txns_per_day FROM g""",
        "structuring_flags": f"""WITH {_TXN} SELECT seq, amount % 1000 = 0 AS is_round, (amount >= 9000 AND amount < 10000) OR (amount >= 49000 AND amount < 50000) OR (amount >= 99000 AND amount < 100000) OR (amount >= 199000 AND amount < 200000) AS is_near_threshold,
          (CASE WHEN amount <= 1000 THEN 0 WHEN amount <= 5000 THEN 1 WHEN amount <= 10000 THEN 2 WHEN amount <= 50000 THEN 3 WHEN amount <= 100000 THEN 4 WHEN amount <= 500000 THEN 5 ELSE 6 END)::BIGINT AS bucket FROM t""",
        "pair_freq": f"WITH {_TXN} SELECT account_id, node, count(*) AS pair_txns, sum(amount)::DOUBLE AS pair_total FROM t GROUP BY ALL",
        "channel_infer": _channel_sql(),
        "text_normalise": r"SELECT conv_id, turn, md5(upper(trim(regexp_replace(replace(text, 'ß', 'SS'), '[|\\<>{}\[\]~`°\s]+', ' ', 'g')))) AS digest FROM conversations",
        "confusion": f"""WITH {_SCORED}, c AS (SELECT count(*) FILTER (WHERE score >= 0.3 AND label = 1) AS tp, count(*) FILTER (WHERE score >= 0.3 AND label <> 1) AS fp, count(*) FILTER (WHERE score < 0.3 AND label <> 1) AS tn, count(*) FILTER (WHERE score < 0.3 AND label = 1) AS fn FROM s),
          m AS (SELECT *, tp / nullif(tp + fp, 0) AS p, tp / nullif(tp + fn, 0) AS r FROM c) SELECT tp, fp, tn, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / nullif(p + r, 0), 6) AS f1, round(100 * r, 4) AS caught_pct, round(100 * fp / nullif(fp + tn, 0), 4) AS false_alarm_pct FROM m""",
        "roc_auc": f"WITH {_CURVE} SELECT round(sum(n * (tp - p / 2)) / max(ps * ns), 6) AS roc_auc, round(sum(p * tp / (tp + fp)) / max(ps), 6) AS average_precision FROM c",
        "pr_curve": f"WITH {_CURVE} SELECT score, tp::BIGINT AS tp, fp::BIGINT AS fp FROM c",
        "score_hist": f"WITH {_SCORED} SELECT least(floor(score * 20), 19)::BIGINT AS bin, label, count(*) AS n FROM s GROUP BY ALL",
        "search_txns": "SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice BETWEEN 50000 AND 150000 AND c_mktsegment ILIKE '%build%' AND o_orderstatus = 'O' ORDER BY o_totalprice DESC, o_orderkey LIMIT 50",
        "account_list": "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_name ILIKE '%00001%' AND c_acctbal >= 0",
        "txn_stats": f"WITH {_TXN} SELECT account_id, count(*) AS n, sum(debit)::DOUBLE AS debits, sum(credit)::DOUBLE AS credits, max(amount)::DOUBLE AS largest, strftime(min(ts), '%Y-%m-%d') AS first_day, strftime(max(ts), '%Y-%m-%d') AS last_day FROM t GROUP BY account_id",
        "counterparties_anti": f"WITH {_TXN} SELECT DISTINCT node FROM t WHERE debit > 0 AND node NOT IN (SELECT account_id FROM t WHERE credit >= 150000)",
        "top_amounts": f"WITH {_TXN} SELECT seq, account_id, amount::DOUBLE AS amount FROM t ORDER BY t.amount DESC, seq LIMIT 500",
    }
