"""Money trails: where a root account's largest payment went (forward) or came from (backward).

All roots advance together, one hop a round: the open paths are joined with the edges at their last account, so a round is
one shuffle join whatever the number of roots. Rounds are checkpointed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..config import DEFAULT, HOUR, Thresholds

# Exit channels in the order in which a narration is searched.
EXITS = ["ATM", "CASH WITHDRAWAL", "CRYPTO", "INTERNATIONAL", "REMITTANCE", "WIRE", "FOREX"]

FOUND = ["root", "path", "seqs", "hops", "seed_amount", "last_amount", "loss", "terminal"]


def transfers(txns: DataFrame) -> DataFrame:
    """src, dst, t, amount, seq, text and internal (dst has an account here) of every debit with a counterparty."""
    known = txns.select(F.col("account_id").alias("dst")).distinct().withColumn("internal", F.lit(True))
    text = F.col("text") if "text" in txns.columns else F.lit("")
    out = txns.filter("debit > 0 AND trim(node) <> ''").select(F.col("account_id").alias("src"), F.col("node").alias("dst"), "t", F.col("debit").alias("amount"), "seq", F.upper(F.coalesce(text, F.lit(""))).alias("text"))
    return out.join(known, "dst", "left").withColumn("internal", F.coalesce("internal", F.lit(False))).select("src", "dst", "t", "amount", "seq", "text", "internal")


def terminals(edges: DataFrame) -> DataFrame:
    """node and exit: the first exit channel (by edge, then in the list's order) in the narrations that leave a node; null if none."""
    first = F.lit(None).cast("string")
    for word in reversed(EXITS):
        first = F.when(F.col("text").contains(word), word.replace(" ", "_")).otherwise(first)
    marked = edges.select(F.col("src").alias("node"), "seq", first.alias("word"))
    return marked.groupBy("node").agg(F.min_by("word", F.when(F.col("word").isNotNull(), F.col("seq"))).alias("exit"))


def seeds(edges: DataFrame, roots: DataFrame, forward: bool) -> DataFrame:
    """Of each root (column node) the largest payment out, or in for backward; the earliest row on ties."""
    end = "src" if forward else "dst"
    mine = edges.join(roots.select(F.col("node").alias(end)).distinct(), end)
    best = F.max_by(F.struct("amount", "t"), F.struct(F.col("amount"), -F.col("seq")))
    return mine.groupBy(F.col(end).alias("root")).agg(best.alias("seed")).select("root", F.col("seed.amount").alias("seed_amount"), F.col("seed.t").alias("t"))


def trails(txns: DataFrame, roots: DataFrame, forward: bool = True, p: Thresholds = DEFAULT, hours: int = 72) -> DataFrame:
    """root, path, seqs, hops, seed_amount, last_amount, loss and terminal of every finished trail.

    A hop takes, for each account not yet on the path, the payment nearest in amount (the earlier row on ties) among those
    not before the last one and at most so many hours after it (backward: not after it), if it keeps trail_ratio of the
    amount. A trail ends at a node without further edges or with no hop that fits (dead_end), at an exit channel (forward),
    at a counterparty without an account, or after trail_hops hops.

    Defined results: roots without payments and payments without counterparty give nothing; equal payments are
    separate rows known by seq; no rows give no rows.
    """
    edges = transfers(txns).select("src", "dst", "t", "amount", "seq", "text", "internal")
    known = txns.select(F.col("account_id").alias("far")).distinct()
    near, far = ("src", "dst") if forward else ("dst", "src")
    steps = edges.select(F.col(near).alias("node"), F.col(far).alias("far"), F.col("t").alias("e_t"), F.col("amount").alias("e_amount"), F.col("seq").alias("e_seq"))
    steps = steps.join(known.withColumn("inside", F.lit(True)), "far", "left").withColumn("inside", F.coalesce("inside", F.lit(False))).checkpoint()
    ends = steps.select("node").distinct().withColumn("onward", F.lit(True)).join(terminals(edges) if forward else steps.select("node", F.lit(None).cast("string").alias("exit")).distinct(), "node", "left").checkpoint()
    start = seeds(edges, roots, forward)
    none = F.array().cast("array<bigint>")
    open_ = start.select("root", "seed_amount", F.col("root").alias("node"), F.col("seed_amount").alias("amount"), "t", F.array("root").alias("path"), none.alias("seqs"), F.lit(0).alias("hops"))
    found = []

    def finish(rows: DataFrame, terminal) -> DataFrame:
        loss = F.round(1 - F.col("amount").cast("double") / F.col("seed_amount").cast("double"), 4)
        return rows.select("root", F.array_join("path", ">").alias("path"), F.array_join(F.transform("seqs", lambda s: s.cast("string")), ">").alias("seqs"), "hops", F.col("seed_amount").cast("double").alias("seed_amount"), F.col("amount").cast("double").alias("last_amount"), loss.alias("loss"), terminal.alias("terminal"))

    for level in range(p.trail_hops + 1):
        open_ = open_.checkpoint()
        if open_.isEmpty():
            break
        if level == p.trail_hops:
            found.append(finish(open_, F.lit("max_hops_reached")))
            break
        reach = open_.join(steps, "node").filter(~F.array_contains("path", F.col("far")))
        if level:
            out = reach.filter(~F.col("inside")).select(*open_.columns, "far").distinct()
            found.append(finish(out.withColumn("path", F.concat("path", F.array("far"))), F.lit("EXTERNAL_COUNTERPARTY")))
        timely = (F.col("e_t") >= F.col("t")) & (F.col("e_t") <= F.col("t") + hours * HOUR) if forward else F.col("e_t") <= F.col("t")
        inside = reach.filter(F.col("inside") & timely)
        best = inside.groupBy(*open_.columns, "far").agg(F.min(F.struct(F.abs(F.col("e_amount") - F.col("amount")).alias("off"), F.col("e_seq"), F.col("e_t"), F.col("e_amount"))).alias("e"))
        kept = best.filter(F.col("e.e_amount") >= F.col("amount") * F.lit(p.trail_ratio).cast("decimal(4,2)")).checkpoint()
        if level:
            stuck = open_.join(kept.select("root", "path", "seqs").distinct(), ["root", "path", "seqs"], "left_anti")
            found.append(finish(stuck, F.lit("dead_end")))
        moved = kept.select("root", "seed_amount", F.col("far").alias("node"), F.col("e.e_amount").alias("amount"), F.col("e.e_t").alias("t"), F.concat("path", F.array("far")).alias("path"), F.concat("seqs", F.array(F.col("e.e_seq"))).alias("seqs"), (F.col("hops") + 1).alias("hops"))
        moved = moved.join(ends, "node", "left").withColumn("terminal", F.when(F.col("onward").isNull(), "dead_end").otherwise(F.col("exit"))).checkpoint()
        found.append(finish(moved.filter("terminal IS NOT NULL"), F.col("terminal")))
        open_ = moved.filter("terminal IS NULL").select(*open_.columns)
    out = finish(open_.limit(0), F.lit("dead_end"))
    for rows in found:
        out = out.unionByName(rows)
    return out.select(*FOUND)


def maximal_chains(chains: DataFrame) -> DataFrame:
    """Layering chains (path joined by '>', seqs) whose accounts are not all in another chain.

    Of equal sets of accounts the least path, then the least seqs stays. Every set then gives its subsets that are as large as the
    smallest set (of 9 accounts at most 2^9), and those go, so no two chains are ever compared for an account that they share.
    """
    sets = chains.withColumn("accounts", F.array_sort(F.array_distinct(F.split("path", ">")))).groupBy("accounts").agg(F.min(F.struct("path", "seqs")).alias("k")).withColumn("n", F.size("accounts"))
    least = sets.agg(F.min("n")).first()[0] or 0
    within = f"filter(sequence(1L, shiftleft(1L, n) - 2), m -> bit_count(m) >= {least})"
    below = sets.filter(F.col("n") > least).select(F.explode(F.expr(f"transform({within}, m -> filter(accounts, (x, i) -> shiftright(m, i) % 2 = 1))")).alias("accounts")).distinct()
    kept = sets.join(below, "accounts", "left_anti").select("k.path", "k.seqs")
    return chains.join(kept, ["path", "seqs"], "left_semi")


def first_edges(txns: DataFrame) -> DataFrame:
    """The first transfer (by seq) of every unordered pair and day."""
    pair = txns.filter("debit > 0").select(F.least("account_id", "node").alias("a"), F.greatest("account_id", "node").alias("b"), F.date_format("ts", "yyyy-MM-dd").alias("day"), "seq", "debit")
    w = Window.partitionBy("a", "b", "day").orderBy("seq")
    return pair.withColumn("r", F.row_number().over(w)).filter("r = 1").select("a", "b", "day", "seq", F.col("debit").cast("double").alias("amount"))
