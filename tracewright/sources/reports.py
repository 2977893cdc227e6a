"""What a run leaves behind: trails with their manifest, scored rows, labels that were caught or missed, and summaries for readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..operators import evaluation
from . import sinks


def trail_manifest(roots: DataFrame, trails: DataFrame) -> DataFrame:
    """account, direction, hops, trails, status for every root (node) and direction; trails: those of both directions with a column direction."""
    both = roots.select(F.col("node").alias("root")).distinct().withColumn("direction", F.explode(F.array(F.lit("forward"), F.lit("backward"))))
    found = trails.groupBy("root", "direction").agg(F.sum("hops").cast("long").alias("hops"), F.count(F.lit(1)).alias("trails"))
    hops, n = F.coalesce("hops", F.lit(0)), F.coalesce("trails", F.lit(0))
    return both.join(found, ["root", "direction"], "left").select(F.col("root").alias("account"), "direction", hops.alias("hops"), n.alias("trails"), F.when(hops > 0, "ok").otherwise("no_internal_counterparties").alias("status"))


def trail_files(roots: DataFrame, forward: DataFrame, backward: DataFrame, folder: str) -> None:
    """Trails as one table with a folder a direction, and their manifest, read from what was written."""
    both = forward.withColumn("direction", F.lit("forward")).unionByName(backward.withColumn("direction", F.lit("backward")))
    sinks.save(both, f"{folder}/trails", by=["direction"])
    sinks.save(trail_manifest(roots, both.sparkSession.read.schema(both.schema).parquet(f"{folder}/trails")), f"{folder}/manifest")


def scored_files(scored: DataFrame, metrics: DataFrame, folder: str, top: int = 500) -> None:
    """scored (score, is_flagged, seq and others), its top flagged rows by score, and the metrics (one row) as JSON."""
    sinks.save(scored, f"{folder}/scored")
    kept = scored.sparkSession.read.parquet(f"{folder}/scored")
    sinks.save(kept.filter("is_flagged").orderBy(F.desc("score"), "seq").limit(top), f"{folder}/top_flagged")
    sinks.report(metrics, f"{folder}/metrics")


def label_files(labelled: DataFrame, accounts: DataFrame, folder: str) -> None:
    """Of evaluation.labelled() rows with is_flagged: those caught and those missed; rings and personas of accounts; counts as JSON."""
    sinks.save(labelled.filter("is_fraud_gt AND is_flagged"), f"{folder}/caught")
    sinks.save(labelled.filter("is_fraud_gt AND NOT is_flagged"), f"{folder}/missed")
    sinks.save(evaluation.rings(accounts), f"{folder}/rings")
    sinks.save(evaluation.personas(accounts), f"{folder}/personas")
    of = lambda test: F.count_if(F.expr(test))
    sinks.report(labelled.agg(of("is_fraud_gt AND is_flagged").alias("tp"), of("NOT is_fraud_gt AND is_flagged").alias("fp"), of("NOT is_fraud_gt AND NOT is_flagged").alias("tn"), of("is_fraud_gt AND NOT is_flagged").alias("fn")), f"{folder}/report")


# Sections of the summaries with their labels, by column of the report.
CLEANING = {
    "OVERVIEW": {"rows_input": "Rows loaded", "rows_output": "Rows in cleaned output", "rows_removed": "Rows removed", "rows_flagged": "Rows flagged (kept)", "rows_fully_clean": "Rows fully clean"},
    "PASS 1 — DEDUPLICATION": {"exact_duplicates": "Exact duplicates removed", "near_duplicates": "Near duplicates flagged"},
    "PASS 2 — DATE VALIDATION": {"null_dates": "Null dates", "bad_dates": "Bad format", "dates_out_of_range": "Out of range"},
    "PASS 3 — AMOUNT CLEANING": {"amount_corrections": "Corrections made", "zero_rows": "Zero debit+credit rows"},
    "PASS 4 — BALANCE CONTINUITY": {"accounts_checked": "Accounts checked", "accounts_with_breaches": "Accounts with breaches", "breach_rows": "Breach rows total"},
}
ANALYTICS = {
    "OVERVIEW": {"rows_input": "Rows analysed", "accounts": "Accounts analysed", "rows_flagged": "Rows with analytics flag"},
    "GRAPH STATISTICS": {"nodes": "Graph nodes", "edges": "Graph edges (transfers)", "components": "Connected components"},
    "PATTERN DETECTION RESULTS": {"round_trips": "Round-trips", "layering": "Layering chains", "fan_in": "Fan-in collectors", "fan_out": "Fan-out distributors", "smurfing": "Smurfing / structuring", "odd_hours": "Odd-hour accounts"},
    "RISK SCORE DISTRIBUTION": {"critical": "CRITICAL (≥75)", "high": "HIGH     (≥50)", "medium": "MEDIUM   (≥25)", "low": "LOW      (<25)"},
}


def summary(report: DataFrame, title: str, sections: dict[str, dict[str, str]]) -> DataFrame:
    """value: the lines of a summary, in order, of a report of one row. Columns that the report lacks, and sections without any, are left out."""

    def line(name: str, label: str) -> Column:
        return F.format_string(f"  {label:<24}: %,d", F.coalesce(F.col(name).cast("long"), F.lit(0)))

    parts: list[Column] = [F.lit("=" * 70), F.lit(title), F.lit("=" * 70)]
    for head, labels in sections.items():
        known = [line(name, label) for name, label in labels.items() if name in report.columns]
        parts += [F.lit(""), F.lit(head), F.lit("-" * 40), *known] if known else []
    return report.select(F.posexplode(F.array(*parts)).alias("n", "value")).orderBy("n").select("value")


def top_accounts(scores: DataFrame, reasons: DataFrame, n: int = 10) -> DataFrame:
    """value: two lines for each of the n accounts with the highest scores (a top-k report), with patterns and reasons."""
    top = scores.join(reasons, "account_id", "left").orderBy(F.desc("score"), "account_id").limit(n)
    first = F.format_string("  [%-8s] %-12s Score:%5.1f", "tier", "account_id", F.col("score"))
    lines = F.array(first, F.concat(F.lit("             Patterns : "), "active_patterns"), F.concat(F.lit("             Reasoning: "), F.substring(F.coalesce("reasons", F.lit("")), 1, 100)))
    return top.select("score", "account_id", F.posexplode(lines).alias("k", "value")).orderBy(F.desc("score"), "account_id", "k").select("value")


def save_summary(lines: DataFrame, path: str) -> None:
    """Lines as one file of text: a summary has some dozens of them."""
    lines.coalesce(1).write.mode("overwrite").text(path)
