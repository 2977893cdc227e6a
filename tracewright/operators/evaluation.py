"""Metrics of scored rows (score double, label 0/1): confusion, curves, areas. Ties in score are one step of a curve."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Scores lie between 0 and 1; a curve's running sums go over so many buckets of them.
BUCKETS = 4096


def is_true(label: Column) -> Column:
    """Whether a label's text says yes."""
    return F.coalesce(F.lower(F.trim(label)).isin("true", "1", "yes"), F.lit(False))


def confusion(scored: DataFrame, threshold: float) -> DataFrame:
    hit, pos = F.col("score") >= threshold, F.col("label") == 1
    c = scored.agg(F.count_if(hit & pos).alias("tp"), F.count_if(hit & ~pos).alias("fp"), F.count_if(~hit & ~pos).alias("tn"), F.count_if(~hit & pos).alias("fn"))
    p, r = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide("tp", F.col("tp") + F.col("fn"))
    return c.select("tp", "fp", "tn", "fn", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.try_divide(2 * p * r, p + r), 6).alias("f1"), F.round(100 * r, 4).alias("caught_pct"), F.round(100 * F.try_divide("fp", F.col("fp") + F.col("tn")), 4).alias("false_alarm_pct"))


def curve(scored: DataFrame) -> DataFrame:
    """score, tp, fp at each distinct score as threshold, with totals.

    Running sums have two levels: over the steps within a bucket of scores, and over the buckets' sums, one row each.
    """
    steps = scored.groupBy(F.col("score").cast("double").alias("score")).agg(F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("n")).withColumn("bucket", F.floor(F.col("score") * BUCKETS))
    sums = steps.groupBy("bucket").agg(F.sum("p").alias("bp"), F.sum("n").alias("bn"))
    above, all_ = Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    sums = sums.select("bucket", *[F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"{c}_above") for c in ("bp", "bn")], F.sum("bp").over(all_).alias("positives"), F.sum("bn").over(all_).alias("negatives"))
    w = Window.partitionBy("bucket").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    inside = steps.select("bucket", "score", "p", "n", F.sum("p").over(w).alias("tp"), F.sum("n").over(w).alias("fp"))
    return inside.join(sums, "bucket").select("score", "p", "n", (F.col("tp") + F.col("bp_above")).alias("tp"), (F.col("fp") + F.col("bn_above")).alias("fp"), "positives", "negatives")


def areas(scored: DataFrame) -> DataFrame:
    """roc_auc by trapezoids and average precision."""
    c = curve(scored)
    roc = F.sum(F.col("n") * (F.col("tp") - F.col("p") / 2)) / F.max(F.col("positives") * F.col("negatives"))
    ap = F.sum(F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))) / F.max("positives")
    return c.agg(F.round(roc, 6).alias("roc_auc"), F.round(ap, 6).alias("average_precision"))


def histogram(scored: DataFrame, bins: int) -> DataFrame:
    b = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1))
    return scored.groupBy(b.cast("long").alias("bin"), "label").agg(F.count(F.lit(1)).alias("n"))


TIERS = ["Very Low", "Low", "Medium", "High", "Critical"]


def accounts(scored: DataFrame) -> DataFrame:
    """Per account of rows (account_id, score, is_flagged): rows, flagged rows, whether any is flagged, largest and mean score."""
    return scored.groupBy("account_id").agg(F.count(F.lit(1)).alias("txns"), F.count_if("is_flagged").alias("flagged"), F.max("is_flagged").alias("detected"), F.round(F.max("score"), 6).alias("max_score"), F.round(F.avg("score"), 6).alias("avg_score"))


def rings(labelled: DataFrame) -> DataFrame:
    """Per ring of fraudulent accounts (ring_id, role, detected, max_score): accounts, detected ones, their percentage, mean score, roles."""
    g = labelled.filter("ring_id IS NOT NULL").groupBy("ring_id").agg(F.count(F.lit(1)).alias("accounts"), F.count_if("detected").alias("found"), F.round(F.avg("max_score"), 6).alias("avg_max_score"), F.array_join(F.sort_array(F.collect_set("role")), ", ").alias("roles"))
    return g.select("ring_id", "accounts", "found", F.round(100 * F.col("found") / F.col("accounts"), 2).alias("detection_pct"), "avg_max_score", "roles")


def personas(labelled: DataFrame) -> DataFrame:
    """False alarms per persona over legitimate accounts (persona, is_fraud, detected)."""
    g = labelled.filter(~F.coalesce("is_fraud", F.lit(False))).groupBy("persona").agg(F.count(F.lit(1)).alias("accounts"), F.count_if("detected").alias("false_alarms"))
    return g.withColumn("false_alarm_pct", F.round(100 * F.col("false_alarms") / F.col("accounts"), 2))


def labelled(scored: DataFrame, accounts: DataFrame, txn_labels: DataFrame | None = None) -> DataFrame:
    """scored with its account's is_fraud as acc_is_fraud and with is_fraud_gt: the transaction's own label if there are labels of
    transactions (transaction_id, label as text; a transaction without one is legitimate, one true label of several decides), else the account's."""
    of_account = accounts.groupBy("account_id").agg(F.max(is_true(F.col("is_fraud").cast("string"))).alias("acc_is_fraud"))
    d = scored.join(of_account, "account_id", "left").withColumn("acc_is_fraud", F.coalesce("acc_is_fraud", F.lit(False)))
    if txn_labels is None:
        return d.withColumn("is_fraud_gt", F.col("acc_is_fraud"))
    own = txn_labels.groupBy("transaction_id").agg(F.max(is_true(F.col("label").cast("string"))).alias("is_fraud_gt"))
    return d.join(own, "transaction_id", "left").withColumn("is_fraud_gt", F.coalesce("is_fraud_gt", F.lit(False)))


def tier_counts(scored: DataFrame) -> DataFrame:
    """Rows per tier, 0 for tiers without any, with the tier's place."""
    all_tiers = scored.sparkSession.createDataFrame(list(enumerate(TIERS)), "place long, tier string")
    return all_tiers.join(scored.groupBy("tier").agg(F.count(F.lit(1)).alias("its_n")), "tier", "left").select("place", "tier", F.coalesce("its_n", F.lit(0)).alias("n"))


def best_threshold(scored: DataFrame) -> DataFrame:
    """The score that gives the best F1, the highest of equals."""
    f1 = 2 * F.col("tp") / (F.col("tp") + F.col("fp") + F.col("positives"))
    return curve(scored).agg(F.max_by(F.struct("score", F.round(f1, 6).alias("f1")), F.struct(F.round(f1, 9), F.col("score"))).alias("b")).select(F.col("b.score").alias("threshold"), F.col("b.f1").alias("f1"))
