"""Pattern detectors as range-frame windows and interval joins over transactions (see sources.tables)."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import DAY, DEFAULT, HOUR, Thresholds

#: Transfers of paid accounts that are broadcast at most, about 100 MB with their buckets.
LAYER_ROWS = 500_000


def known_peer(node: Column) -> Column:
    """A counterparty that is named; blank ones and the text of a missing one are null."""
    return F.when(~F.trim(node).isin("", "nan"), node)


def anchored(rows: DataFrame, width: int, min_peers: int, min_txns: int, min_total: int, critical: int) -> DataFrame:
    """Per account the first row whose forward window of width microseconds passes the thresholds.

    rows: account_id, node, t, seq, amount. Distinct peers are those in the window; a blank counterparty is no peer, but its amount
    counts. An account's time is cut into buckets of the window's width, so a busy account fills many tasks: a row is in its own
    bucket, and in the one before as what that one's windows reach. No set of peers is kept: a payment at t counts for the windows that begin
    after the same peer's payment before it and not before t - width. These stretches of a peer do not overlap, so sums over
    their ends count peers.
    """
    of = lambda at: F.floor(at / width)
    t, none = F.col("t"), F.lit(None).cast("bigint")
    paid = rows.select("account_id", F.explode(F.array(of(t), of(t) - 1)).alias("bucket"), "t", "seq", "amount", F.lit(0).alias("step"))
    named = rows.withColumn("peer", known_peer(F.col("node"))).filter("peer IS NOT NULL")
    before = F.lag("t").over(Window.partitionBy("account_id", "peer").orderBy("t"))
    counted = named.select("account_id", "t", F.greatest(before + 1, t - width).alias("start")).filter("start <= t")
    parts = counted.select("account_id", "t", "start", F.explode(F.array_distinct(F.array(of(F.col("start")), of(t)))).alias("bucket"))
    ends = F.array(F.struct(F.greatest("start", F.col("bucket") * width).alias("t"), F.lit(1).alias("step")), F.struct((t + 1).alias("t"), F.lit(-1).alias("step")))
    steps = parts.select("account_id", "bucket", F.explode(ends).alias("e")).select("account_id", "bucket", "e.t", none.alias("seq"), F.lit(None).cast(rows.schema["amount"].dataType).alias("amount"), "e.step")
    w = Window.partitionBy("account_id", "bucket").orderBy("t")
    ahead, so_far = w.rangeBetween(0, width), w.rangeBetween(Window.unboundedPreceding, 0)
    d = paid.unionByName(steps).withColumns({"total": F.sum("amount").over(ahead), "txns": F.count("amount").over(ahead), "last_t": F.max(F.when(F.col("amount").isNotNull(), t)).over(ahead), "peers": F.sum("step").over(so_far)})
    passing = d.filter((of(t) == F.col("bucket")) & F.col("seq").isNotNull() & (F.col("peers") >= min_peers) & (F.col("txns") >= min_txns) & (F.col("total") >= min_total))
    first = passing.groupBy("account_id").agg(F.min_by(F.struct("t", "last_t", "peers", "txns", "total"), F.struct("t", "seq")).alias("f"))
    severity = F.when(F.col("f.peers") >= critical, "CRITICAL").otherwise("HIGH")
    return first.select("account_id", moment(F.col("f.t")).alias("window_start"), moment(F.col("f.last_t")).alias("window_end"), F.col("f.peers").cast("long").alias("peers"), F.col("f.txns").alias("txns"), F.col("f.total").cast("double").alias("total"), severity.alias("severity"))


def moment(t: Column) -> Column:
    return F.date_format(F.timestamp_micros(t), "yyyy-MM-dd HH:mm:ss")


def fan_in(txns: DataFrame, p: Thresholds = DEFAULT) -> DataFrame:
    side = txns.filter("credit > 0").select("account_id", "node", "t", "seq", F.col("credit").alias("amount"))
    return anchored(side, p.fan_in_hours * HOUR, p.fan_in_senders, 1, p.fan_in_total, p.critical_peers)


def fan_out(txns: DataFrame, p: Thresholds = DEFAULT) -> DataFrame:
    side = txns.filter("debit > 0").select("account_id", "node", "t", "seq", F.col("debit").alias("amount"))
    return anchored(side, p.fan_out_hours * HOUR, p.fan_out_receivers, 1, p.fan_out_total, p.critical_peers)


def smurfing(txns: DataFrame, p: Thresholds = DEFAULT) -> DataFrame:
    """Debits just under the reporting threshold to several destinations."""
    side = txns.filter((F.col("debit") >= p.smurf_low) & (F.col("debit") < p.smurf_high)).select("account_id", "node", "t", "seq", F.col("debit").alias("amount"))
    return anchored(side, p.smurf_days * DAY, p.smurf_destinations, p.smurf_txns, 0, 1 << 30)


def odd_hours(txns: DataFrame, p: Thresholds = DEFAULT) -> DataFrame:
    hour = F.hour(F.timestamp_micros("t"))
    odd = txns.filter((hour >= p.odd_from) & (hour < p.odd_to)).groupBy("account_id").agg(F.count(F.lit(1)).alias("txns"), F.sum("amount").cast("double").alias("total"), F.countDistinct(hour).alias("hours"))
    return odd.filter(F.col("txns") >= p.odd_txns)


def round_trips(txns: DataFrame, p: Thresholds = DEFAULT) -> DataFrame:
    """Debits that come back from the same counterparty in time. Hot pairs are split by month: a credit goes to its own and the earlier bucket."""
    width = p.round_trip_days * DAY
    big = txns.filter(F.col("amount") > p.round_trip_amount)
    bucket = F.floor(F.col("t") / width)
    d = big.filter("debit > 0").select("account_id", "node", F.col("seq").alias("debit_seq"), F.col("t").alias("dt"), F.col("debit"), bucket.alias("bucket"))
    c = big.filter("credit > 0").select("account_id", "node", F.col("seq").alias("credit_seq"), F.col("t").alias("ct"), F.col("credit"), F.explode(F.array(bucket, bucket - 1)).alias("bucket"))
    pairs = d.join(c, ["account_id", "node", "bucket"]).filter((F.col("ct") > F.col("dt")) & (F.col("ct") <= F.col("dt") + width) & (F.col("credit") >= F.col("debit") * F.lit(str(p.round_trip_ratio)).cast("decimal(4,2)")))
    gap = (F.col("ct") - F.col("dt")) / DAY
    return pairs.select("account_id", "node", "debit_seq", "credit_seq", F.round(F.col("credit").cast("double") / F.col("debit").cast("double"), 4).alias("ratio"), F.round(gap, 4).alias("gap_days"), F.when(gap < 3, "HIGH").otherwise("MEDIUM").alias("severity"))


def trip_ends(trips: DataFrame) -> DataFrame:
    """The accounts at either end of round_trips()."""
    return trips.select("account_id").union(trips.select("node")).distinct()


def bursts(txns: DataFrame, p: Thresholds = DEFAULT, minutes: int | None = None) -> DataFrame:
    """Debits that belong to some window of burst_minutes with at least burst_txns of them. Rows at 00:00:00 have no time and are not counted."""
    width = (minutes or p.burst_minutes) * 60_000_000
    w = Window.partitionBy("account_id").orderBy("t")
    n = txns.filter("debit > 0").filter(F.col("t") % DAY != 0).withColumn("ahead", F.count(F.lit(1)).over(w.rangeBetween(0, width)))
    n = n.withColumn("best", F.max("ahead").over(w.rangeBetween(-width, 0)))
    return n.filter(F.col("best") >= p.burst_txns).select("seq", "account_id", F.col("best").alias("window_txns"))


def next_steps(transfers: DataFrame, width: int, rows: int | None, *more: str) -> DataFrame:
    """Transfers (src, dst, t, amount and more) as what follows() joins: twice, under their time's bucket of the width and the one before. With few rows they are broadcast."""
    bucket = F.floor(F.col("t") / width)
    steps = transfers.select(F.col("src").alias("from"), F.col("dst").alias("to"), F.col("t").alias("to_t"), F.col("amount").alias("to_amount"), *more, F.explode(F.array(bucket, bucket - 1)).alias("to_bucket"))
    return F.broadcast(steps) if rows is not None and rows <= LAYER_ROWS else steps


def follows(width: int) -> Column:
    """Whether a transfer of next_steps() leaves end within the width after last_t."""
    return (F.col("from") == F.col("end")) & (F.floor(F.col("last_t") / width) == F.col("to_bucket")) & (F.col("to_t") >= F.col("last_t")) & (F.col("to_t") <= F.col("last_t") + width)


def layering(txns: DataFrame, p: Thresholds = DEFAULT, hours: int | None = None, min_amount: int | None = None, max_paths: int = 50_000_000) -> DataFrame:
    """Chains of transfers, each hop within hours of the last, through different accounts; path, hops, amounts.

    Levels grow by a join of their ends with the edges; a level above max_paths raises, it is never cut.
    """
    width = (hours or p.layer_hours) * HOUR
    e = txns.filter((F.col("debit") >= (min_amount or p.layer_amount)) & (F.col("node") != F.col("account_id"))).select(F.col("account_id").alias("src"), F.col("node").alias("dst"), "t", F.col("debit").alias("amount"), "seq")
    level = e.select(F.array("src", "dst").alias("path"), F.array("seq").alias("seqs"), F.col("dst").alias("end"), F.col("t").alias("last_t"), F.col("amount").alias("first_amount"), F.col("amount").alias("last_amount"))
    # Only transfers of accounts that were paid follow others.
    inner = e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
    steps = next_steps(inner.withColumnRenamed("seq", "to_seq"), width, inner.count(), "to_seq")
    found = None
    for hops in range(2, p.layer_max_hops + 1):
        level = level.join(steps, follows(width) & ~F.array_contains("path", F.col("to"))).select(F.concat("path", F.array("to")).alias("path"), F.concat("seqs", F.array("to_seq")).alias("seqs"), F.col("to").alias("end"), F.col("to_t").alias("last_t"), "first_amount", F.col("to_amount").alias("last_amount"))
        level = level.checkpoint() if level.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined() else level.persist()
        n = level.count()
        if n > max_paths:
            raise ValueError(f"{n} paths of {hops} hops; narrow the hop window or raise max_paths")
        if not n:
            break
        if hops >= p.layer_hops:
            part = level.withColumn("hops", F.lit(hops))
            found = part if found is None else found.unionAll(part)
    if found is None:
        found = level.withColumn("hops", F.lit(0)).limit(0)
    skim = 1 - F.col("last_amount").cast("double") / F.col("first_amount").cast("double")
    return found.select(F.array_join("path", ">").alias("path"), F.array_join(F.transform("seqs", lambda s: s.cast("string")), ">").alias("seqs"), F.col("hops").cast("long").alias("hops"), F.round(skim, 4).alias("skim"), F.when(F.col("hops") >= 5, "CRITICAL").otherwise("HIGH").alias("severity"))


def layering_counts(txns: DataFrame, p: Thresholds = DEFAULT, hours: int | None = None, min_amount: int | None = None) -> DataFrame:
    """account_id (where they begin), hops, severity, chains, least_skim and most_skim of all chains of layering(), without keeping a chain.

    After its first transfer a chain leaves accounts that were paid only. Chains that begin at such accounts are followed by
    joins that end in counts by first transfer, with the least and the greatest last amount. An account that nobody pays is on no
    chain twice, so its transfers take the counts of those that may come next. Up to LAYER_ROWS transfers of paid accounts are
    broadcast, and no chain is written; beyond, Spark shuffles the chains of one length at a time.
    """
    width = (hours or p.layer_hours) * HOUR
    e = txns.filter((F.col("debit") >= (min_amount or p.layer_amount)) & (F.col("node") != F.col("account_id"))).select(F.col("account_id").alias("src"), F.col("node").alias("dst"), "t", F.col("debit").alias("amount"))
    paid = e.select(F.col("dst").alias("src")).distinct()
    inner = e.join(paid, "src", "left_semi").withColumn("id", F.monotonically_increasing_id()).checkpoint()

    steps = next_steps(inner, width, inner.count())
    tasks = int(txns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    level = inner.repartition(tasks, "id").select("id", F.array("src", "dst").alias("path"), F.col("dst").alias("end"), F.col("t").alias("last_t"), F.col("amount").alias("last"))
    counted = []
    for hops in range(1, p.layer_max_hops + 1):
        if hops > 1:
            level = level.join(steps, follows(width) & ~F.array_contains("path", F.col("to"))).select("id", F.concat("path", F.array("to")).alias("path"), F.col("to").alias("end"), F.col("to_t").alias("last_t"), F.col("to_amount").alias("last"))
        if hops >= p.layer_hops - 1:
            counted.append(level.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("last").alias("low"), F.max("last").alias("high")).withColumn("hops", F.lit(hops)).checkpoint())
            if counted[-1].isEmpty():
                break
    tails = inner.join(reduce(DataFrame.unionAll, counted), "id")
    own = tails.filter(F.col("hops") >= p.layer_hops).select("src", "amount", "hops", "n", "low", "high")
    outer = e.join(paid, "src", "left_anti").select("src", F.col("dst").alias("end"), F.col("t").alias("last_t"), "amount")
    ahead = next_steps(tails.filter(F.col("hops") < p.layer_max_hops).withColumn("hops", F.col("hops") + 1), width, None, "hops", "n", "low", "high")
    found = own.unionByName(outer.join(ahead, follows(width)).select("src", "amount", "hops", "n", "low", "high"))
    skim = lambda last: F.round(1 - F.col(last).cast("double") / F.col("amount").cast("double"), 4)
    severity = F.when(F.col("hops") >= 5, "CRITICAL").otherwise("HIGH")
    return found.groupBy(F.col("src").alias("account_id"), F.col("hops").cast("long").alias("hops"), severity.alias("severity")).agg(F.sum("n").alias("chains"), F.min(skim("high")).alias("least_skim"), F.max(skim("low")).alias("most_skim"))


def layered_accounts(txns: DataFrame, p: Thresholds = DEFAULT) -> DataFrame:
    """account_id of every account in a chain of layering(). Each is on a stretch of layer_hops hops, itself a chain, so longer ones are not grown."""
    chains = layering(txns, replace(p, layer_max_hops=p.layer_hops))
    return chains.select(F.explode(F.split("path", ">")).alias("account_id")).distinct()


def beneficiaries(txns: DataFrame, p: Thresholds = DEFAULT) -> DataFrame:
    """Per account and named counterparty: total, payments, largest one, first and last day, and two tests of the largest payment.

    z is its distance from the mean of the account's debit rows in their standard deviations (of all rows; 1 for a single
    one). New high value: the only payment to that counterparty, and at least half the account's largest debit.
    """
    debits, money = txns.filter("debit > 0"), F.col("debit").cast("double")
    spread = F.when(F.count(F.lit(1)) > 1, F.stddev_pop(money)).otherwise(1.0)
    account = debits.groupBy("account_id").agg(F.avg(money).alias("mean"), spread.alias("std"), F.max("debit").alias("top"))
    g = debits.filter(known_peer(F.col("node")).isNotNull()).groupBy("account_id", "node").agg(F.sum("debit").alias("total"), F.count(F.lit(1)).alias("txns"), F.max("debit").alias("largest"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))
    z = F.when(F.col("std") > 0, (F.col("largest").cast("double") - F.col("mean")) / F.col("std")).otherwise(0.0)
    g = g.join(account, "account_id").withColumn("z", z)
    day = lambda c: F.date_format(F.timestamp_micros(c), "yyyy-MM-dd")
    is_new = (F.col("txns") == 1) & (F.col("largest").cast("double") >= p.beneficiary_new * F.col("top").cast("double"))
    return g.select("account_id", "node", F.col("total").cast("double").alias("total"), "txns", F.col("largest").cast("double").alias("largest"), day("first_t").alias("first_day"), day("last_t").alias("last_day"), F.round("z", 3).alias("z"), (F.col("z") >= p.beneficiary_z).alias("is_high_value"), is_new.alias("is_new_high_value"))


def risk_scores(accounts: DataFrame, flags: dict[str, DataFrame], new_high_value: DataFrame, p: Thresholds = DEFAULT) -> DataFrame:
    """Weighted flags of every account, 5 points for a new high-value beneficiary, and the tier. flags: a table with account_id for each weight."""
    score, names, out = F.lit(0.0), [], accounts.select("account_id").distinct()
    for name, weight in p.weights.items():
        out = out.join(flags[name].select("account_id").distinct().withColumn(f"is_{name}", F.lit(True)), "account_id", "left")
        hit = F.coalesce(f"is_{name}", F.lit(False))
        score = score + F.when(hit, 100 * weight).otherwise(0.0)
        names.append(F.when(hit, name.upper()))
    out = out.join(new_high_value.select("account_id").distinct().withColumn("is_new", F.lit(True)), "account_id", "left")
    new = F.coalesce("is_new", F.lit(False))
    score = F.least(F.lit(100.0), F.round(score + F.when(new, 5.0).otherwise(0.0), 1))
    tier = F.when(score >= 75, "CRITICAL").when(score >= 50, "HIGH").when(score >= 25, "MEDIUM").otherwise("LOW")
    return out.select("account_id", score.alias("score"), tier.alias("tier"), F.coalesce(F.nullif(F.concat_ws(" | ", *names, F.when(new, "NEW_HV_BENE")), F.lit("")), F.lit("NONE")).alias("active_patterns"))


def window_members(rows: DataFrame, findings: DataFrame) -> DataFrame:
    """seq and account_id of the rows inside their account's finding of anchored(). rows: the side that was searched; at most one finding an account."""
    f = findings.select("account_id", F.to_timestamp("window_start").alias("from_"), F.to_timestamp("window_end").alias("to_"))
    second = F.date_trunc("second", F.timestamp_micros("t"))
    return rows.join(f, "account_id").filter((second >= F.col("from_")) & (second <= F.col("to_"))).select("seq", "account_id")


def risk_reasons(scores: DataFrame, findings: dict[str, DataFrame]) -> DataFrame:
    """account_id and the reasons for its score, in the order of the flags. findings: by flag, account_id, at (their order) and reason; an account's first one is taken."""
    out, texts = scores.select("account_id"), []
    for name, found in findings.items():
        first = found.groupBy("account_id").agg(F.min_by("reason", "at").alias(f"why_{name}"))
        out, texts = out.join(first, "account_id", "left"), [*texts, f"why_{name}"]
    text = F.concat_ws(" | ", *texts)
    return out.select("account_id", F.when(text == "", "No suspicious patterns detected").otherwise(text).alias("reasons"))
