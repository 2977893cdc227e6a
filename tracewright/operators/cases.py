"""Case files and the views that an investigator asks for: search, pages, latest versions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Transactions of accounts with a risk from here on are suspect.
SUSPECT = 0.7


def latest(log: DataFrame, key: str = "case_id") -> DataFrame:
    """The current rows of an append-only log (key, version, is_deleted and others): each key's last version, unless it deletes."""
    last = log.withColumn("its_place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("version"))))
    return last.filter("its_place = 1 AND NOT coalesce(is_deleted, false)").drop("its_place")


def change(log: DataFrame, changes: DataFrame, key: str = "case_id") -> DataFrame:
    """The rows to append for changes: columns that these lack or leave null keep their current value; the version rises by one."""
    now = latest(log, key).alias("now")
    c = changes.alias("c")
    joined = c.join(now, F.col(f"c.{key}") == F.col(f"now.{key}"))
    kept = [F.coalesce(F.col(f"c.{n}"), F.col(f"now.{n}")).alias(n) if n in changes.columns and n not in (key, "version") else (F.col(f"now.{n}") + 1).alias(n) if n == "version" else F.col(f"now.{n}").alias(n) for n in log.columns]
    return joined.select(*kept)


def where(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def search(txns: DataFrame, account: str | None = None, counterparty: str | None = None, start: str | None = None, end: str | None = None, channel: str | None = None, text: str | None = None, least: float | None = None, most: float | None = None, flagged: bool = False, suspect: bool = False) -> DataFrame:
    """Transactions that meet every given condition, the latest first. Amounts meet theirs by debit or by credit."""
    c = []
    if account is not None:
        c.append(F.col("account_id") == account)
    if counterparty is not None:
        c.append(F.col("counterparty_name").ilike(f"%{counterparty}%"))
    if start is not None:
        c.append(F.col("date") >= start)
    if end is not None:
        c.append(F.col("date") <= end)
    if channel is not None:
        c.append(F.col("channel") == channel.upper())
    if text is not None:
        c.append(F.col("narration").ilike(f"%{text}%"))
    if least is not None:
        c.append((F.col("debit") >= least) | (F.col("credit") >= least))
    if most is not None:
        c.append(((F.col("debit") > 0) & (F.col("debit") <= most)) | ((F.col("credit") > 0) & (F.col("credit") <= most)))
    if flagged:
        c.append(F.col("is_high_value_flag") | F.col("is_balance_breach") | F.col("is_duplicate"))
    if suspect:
        c.append(F.col("final_risk") >= SUSPECT)
    return txns.filter(where(c)).orderBy(F.desc("date"), F.desc("time"), "seq")


def find_accounts(accounts: DataFrame, bank: str | None = None, suspect: bool | None = None, least: float | None = None, text: str | None = None) -> DataFrame:
    """Accounts (account_id, holder, number, bank, is_suspect, risk) that meet every given condition; text is looked for in holder, id and number."""
    c = []
    if bank is not None:
        c.append(F.col("bank").ilike(f"%{bank}%"))
    if suspect is not None:
        c.append(F.col("is_suspect") == suspect)
    if least is not None:
        c.append(F.col("risk") >= least)
    if text is not None:
        c.append(reduce(lambda a, b: a | b, [F.col(name).ilike(f"%{text}%") for name in ("holder", "account_id", "number")]))
    return accounts.filter(where(c))


def account_txns(txns: DataFrame, account: str, start: str | None = None, end: str | None = None, channel: str | None = None, least: float | None = None, flagged: bool = False) -> DataFrame:
    """An account's transactions that meet every given condition, the earliest first."""
    return search(txns, account, start=start, end=end, channel=channel, least=least, flagged=flagged).orderBy("date", "time", "seq")


def page(rows: DataFrame, number: int, size: int) -> DataFrame:
    """Page number (from 1) of ordered rows."""
    return rows.offset((number - 1) * size).limit(size)


def counterparties(txns: DataFrame, accounts: DataFrame, account_id: str) -> DataFrame:
    """The accounts that one account paid or was paid by."""
    met = txns.filter(F.col("account_id") == account_id).select(F.col("node").alias("account_id")).distinct()
    return accounts.join(met, "account_id", "left_semi")


def ring_graph(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges (src, dst) with both ends among members (account_id)."""
    m = members.select("account_id").distinct()
    out = edges.join(m.withColumnRenamed("account_id", "src"), "src", "left_semi")
    return out.join(m.withColumnRenamed("account_id", "dst"), "dst", "left_semi")


def first_of_pairs(edges: DataFrame, order: list[str]) -> DataFrame:
    """One edge per unordered pair of ends, channel and day: the first in order."""
    pair = Window.partitionBy(F.least("account_id", "node"), F.greatest("account_id", "node"), "channel", "day").orderBy(*order)
    return edges.withColumn("its_place", F.row_number().over(pair)).filter("its_place = 1").drop("its_place")


def dashboard(accounts: DataFrame, txns: DataFrame, rings: DataFrame, cases: DataFrame) -> DataFrame:
    """One row: counts of accounts and suspect ones, rows and flagged ones, rings and open cases, and the money of flagged rows.

    accounts: is_suspect; txns: debit, credit, is_flagged; rings: ring_id; cases: status."""
    a = accounts.agg(F.count(F.lit(1)).alias("total_accounts"), F.count_if("is_suspect").alias("suspect_accounts"))
    risk = F.coalesce(F.sum(F.when(F.col("is_flagged"), F.col("debit") + F.col("credit"))), F.lit(0)).cast("double")
    t = txns.agg(F.count(F.lit(1)).alias("total_transactions"), F.count_if("is_flagged").alias("flagged_transactions"), risk.alias("total_amount_at_risk"))
    r = rings.agg(F.count_distinct("ring_id").alias("fraud_rings"))
    return a.crossJoin(t).crossJoin(r).crossJoin(cases.agg(F.count_if(F.col("status") == "open").alias("open_investigations")))  # one row each


def channel_summary(txns: DataFrame) -> DataFrame:
    return txns.groupBy("channel").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("debit") + F.col("credit")).cast("double").alias("total")).orderBy(F.desc("n"), "channel")


def flag_counts(rows: DataFrame, flags: list[str]) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col(f)).alias(f) for f in flags])


def edge_groups(rows: DataFrame) -> DataFrame:
    """Edges by account, counterparty, channel, day and reference: money, rows, and whether one is flagged."""
    return rows.groupBy("account_id", "node", "channel", "day", "ref").agg(F.sum("amount").cast("double").alias("total"), F.count(F.lit(1)).alias("txns"), F.max("is_flagged").alias("is_flagged"))


def counted_page(rows: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """A page of rows in an order, each with the number of all rows."""
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return rows.orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(total))  # one row


def newest(history: DataFrame, account: str, n: int = 100) -> DataFrame:
    return history.filter(F.col("account_id") == account).orderBy(F.desc("t"), F.desc("seq")).limit(min(n, 100))


def suspect_graph(edges: DataFrame, scores: DataFrame, n: int) -> DataFrame:
    """Edges whose two ends are among the n accounts of the highest scores (10 to 500)."""
    top = F.broadcast(scores.orderBy(F.desc("score"), "account_id").limit(max(10, min(500, n))).select("account_id"))
    return edges.join(top.select(F.col("account_id").alias("src")), "src", "left_semi").join(top.select(F.col("account_id").alias("dst")), "dst", "left_semi")


def lookup(rows: DataFrame, key: str, value) -> DataFrame:
    return rows.filter(F.col(key) == value).orderBy("seq").limit(1)


def ring_members(members: DataFrame, accounts: DataFrame, ring: str) -> DataFrame:
    """Members of a ring (ring_id, account_id, role, amount) with their account's holder, bank and risk; members without an account are left out."""
    return members.filter(F.col("ring_id") == ring).join(accounts.select("account_id", "holder", "bank", "risk"), "account_id").select("account_id", "holder", "bank", "role", "amount", "risk")


def rings_by_amount(rings: DataFrame) -> DataFrame:
    """Rings with the largest amount first, then by id."""
    return rings.orderBy(F.desc("amount"), "ring_id")
