"""A synthetic population of accounts with recurring events, fraud rings and a balanced ledger.

Every draw is a hash of seed, row and purpose, so a lost task that runs again draws the same. Nothing is planned on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

# Personas with their share, opening balance and monthly income; ring kinds with their share; banks with IFSC prefix.
PERSONAS = [("salaried", 0.38, 15000, 250000, 22000, 180000), ("student", 0.18, 500, 15000, 3000, 15000), ("business", 0.10, 50000, 800000, 40000, 400000), ("shopkeeper", 0.12, 10000, 150000, 20000, 120000), ("family", 0.22, 20000, 300000, 28000, 220000)]
KINDS = [("layering_chain", 0.30), ("fan_out_mule_network", 0.30), ("fan_in_collector", 0.20), ("smurfing_structuring", 0.20)]
BANKS = [("State Bank of India", "SBIN"), ("HDFC Bank", "HDFC"), ("ICICI Bank", "ICIC"), ("Axis Bank", "UTIB"), ("Canara Bank", "CNRB"), ("Punjab National Bank", "PUNB")]
FRAUD_SHARE, RING_SIZE = 0.07, 8
EVENT = "account_id string, ts timestamp_ntz, narration string, channel string, debit decimal(18,2), credit decimal(18,2), node string, utr_ref string, ring_id string"


def uniform(seed: int, purpose: str, *keys: Column) -> Column:
    """A number in [0, 1) that only seed, purpose and keys decide."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(purpose), *keys), F.lit(1 << 40)) / float(1 << 40)


def pick(u: Column, choices: list[tuple[str, float]]) -> Column:
    out, upto = F.lit(choices[-1][0]), 1.0
    for name, share in reversed(choices[:-1]):
        upto = sum(s for _, s in choices[: [n for n, _ in choices].index(name) + 1])
        out = F.when(u < upto, name).otherwise(out)
    return out


def log_uniform(u: Column, low: Column, high: Column) -> Column:
    return F.round(F.exp(F.log(low) + (F.log(high) - F.log(low)) * u), 2).cast("decimal(18,2)")


def population(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """n accounts; the last FRAUD_SHARE of them, in rings of RING_SIZE, are fraudulent. A ring's kind is the kinds' turn first, then a draw."""
    i, fraud = F.col("id"), int(n * FRAUD_SHARE)
    persona = pick(uniform(seed, "persona", i), [(p[0], p[1]) for p in PERSONAS])
    ranges = F.create_map(*[x for p in PERSONAS for x in (F.lit(p[0]), F.array(*[F.lit(float(v)) for v in p[2:]]))])
    bank = F.get(F.array(*[F.struct(F.lit(b).alias("name"), F.lit(c).alias("code")) for b, c in BANKS]), F.floor(uniform(seed, "bank", i) * len(BANKS)).cast("int"))
    d = spark.range(n).withColumn("is_fraud", i >= n - fraud).withColumn("place", i - (n - fraud))
    d = d.withColumn("ring", F.when(F.col("is_fraud"), F.floor(F.col("place") / RING_SIZE)))
    d = d.withColumn("typology", F.when(F.col("ring") < len(KINDS), F.get(F.array(*[F.lit(k) for k, _ in KINDS]), F.col("ring").cast("int"))).when(F.col("is_fraud"), pick(uniform(seed, "kind", F.col("ring")), KINDS)))
    d = d.withColumn("persona", F.when(F.col("is_fraud"), "mule").otherwise(persona)).withColumn("range", F.coalesce(F.try_element_at(ranges, F.col("persona")), F.array(*[F.lit(v) for v in (200.0, 3000.0, 0.0, 0.0)])))
    d = d.withColumn("bank", bank)
    role = F.when(F.col("is_fraud"), F.when(F.pmod("place", F.lit(RING_SIZE)) == 0, "origin").otherwise("mule"))
    income = F.when(F.col("is_fraud"), F.lit(0).cast("decimal(18,2)")).otherwise(log_uniform(uniform(seed, "income", i), F.greatest(F.col("range")[2], F.lit(1.0)), F.greatest(F.col("range")[3], F.lit(1.0))))
    return d.select(
        F.format_string("ACC%06d", i).alias("account_id"), F.format_string("Holder %d", i).alias("holder_name"), "persona", F.col("bank.name").alias("bank_name"),
        F.format_string("%s0%06d", F.col("bank.code"), F.pmod(i, F.lit(1000000))).alias("ifsc"), log_uniform(uniform(seed, "opening", i), F.col("range")[0], F.col("range")[1]).alias("opening_balance"),
        income.alias("monthly_income"), "is_fraud", role.alias("fraud_role"), F.when(F.col("is_fraud"), F.format_string("RING%03d", F.col("ring"))).alias("fraud_ring_id"), "typology", F.pmod("place", F.lit(RING_SIZE)).alias("place"),
    )


def poisson(u: Column, rate: float, most: int = 12) -> Column:
    """The Poisson count whose cumulative probability first passes u, at most `most`."""
    import math

    out, upto = F.lit(most), [sum(math.exp(-rate) * rate**k / math.factorial(k) for k in range(m + 1)) for m in range(most)]
    for k in reversed(range(most)):
        out = F.when(u < upto[k], k).otherwise(out)
    return out


def _at(day: Column, u: Column, first: int = 0, last: int = 24) -> Column:
    seconds = F.floor((first + (last - first) * u) * 3600).cast("long")
    return F.timestamp_micros(F.unix_micros(day.cast("timestamp")) + seconds * 1000000).cast("timestamp_ntz")


def _event(d: DataFrame, ts: Column, narration: Column, channel: str, debit: Column, credit: Column, node: Column | None = None, utr: Column | None = None, ring: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("string")
    money = lambda c: c.cast("decimal(18,2)")
    return d.select("account_id", ts.alias("ts"), narration.alias("narration"), F.lit(channel).alias("channel"), money(debit).alias("debit"), money(credit).alias("credit"), (none if node is None else node).alias("node"), (none if utr is None else utr).alias("utr_ref"), (none if ring is None else ring).alias("ring_id"))


def legitimate(accounts: DataFrame, start: str, months: int, seed: int = 42) -> DataFrame:
    """Monthly income on the first days, rent after it, and daily spending in Poisson numbers."""
    zero, honest = F.lit(0), accounts.filter("NOT is_fraud")
    a = F.col("account_id")
    monthly = honest.withColumn("month", F.explode(F.expr(f"sequence(date'{start}', add_months(date'{start}', {months - 1}), interval 1 month)")))
    payday = F.date_add("month", F.floor(uniform(seed, "payday", a, F.col("month")) * 5).cast("int"))
    income = _event(monthly, _at(payday, uniform(seed, "payhour", a, F.col("month")), 0, 6), F.lit("SALARY CREDIT"), "NEFT", zero, F.col("monthly_income"))
    rent = _event(monthly, _at(F.date_add("month", 6), uniform(seed, "renthour", a, F.col("month")), 8, 20), F.lit("RENT PAYMENT"), "NEFT", F.round(F.col("monthly_income") * (0.18 + 0.12 * uniform(seed, "rent", a)), 2), zero)
    daily = honest.withColumn("day", F.explode(F.expr(f"sequence(date'{start}', date_sub(add_months(date'{start}', {months}), 1))")))
    daily = daily.withColumn("k", F.explode(F.expr("sequence(1, 12)"))).filter(F.col("k") <= poisson(uniform(seed, "spend", a, F.col("day")), 0.8))
    spent = F.round(F.col("monthly_income").cast("double") * 0.002 * (1 + 9 * uniform(seed, "amount", a, F.col("day"), F.col("k"))), 2)
    spending = _event(daily, _at(F.col("day"), uniform(seed, "hour", a, F.col("day"), F.col("k")), 8, 23), F.lit("UPI/PURCHASE"), "UPI", spent, zero)
    return income.unionByName(rent).unionByName(spending)


def fraudulent(accounts: DataFrame, start: str, seed: int = 42) -> DataFrame:
    """Each ring's transfers by its kind, both sides with one reference: chains with a skim, one to many, many to one, amounts under 50,000.

    Origins (collectors' payers too) are first seeded with cash, so balances stay above zero.
    """
    ring, place, a = F.col("fraud_ring_id"), F.col("place"), F.col("account_id")
    members = accounts.filter("is_fraud")
    sums = F.round(60000 + 60000 * uniform(seed, "sum", ring), 2)
    day = F.date_add(F.lit(start).cast("date"), (5 + F.floor(uniform(seed, "day", ring) * 20)).cast("int"))
    m = members.withColumn("total", sums).withColumn("day", day)
    last = F.max("place").over(Window.partitionBy("fraud_ring_id"))
    m = m.withColumn("last", last)
    chain, out, into = F.col("typology") == "layering_chain", F.col("typology").isin("fan_out_mule_network", "smurfing_structuring"), F.col("typology") == "fan_in_collector"
    amount = F.when(chain, F.round(F.col("total") * F.pow(F.lit(0.97), place), 2)).when(F.col("typology") == "smurfing_structuring", F.round(36000 + 13000 * uniform(seed, "smurf", a), 2)).otherwise(F.round(6000 + 9000 * uniform(seed, "part", a), 2))
    pays = m.withColumn("other", F.when(chain & (place < F.col("last")), place + 1).when(out & (place > 0), place).when(into & (place > 0), F.lit(0))).filter("other IS NOT NULL").withColumn("sent", amount)
    pays = pays.withColumn("payer", F.when(out, F.lit(0)).otherwise(place))
    minutes = F.when(chain, 60 * place).otherwise(20 * F.greatest(place, F.lit(1)))
    when = F.timestamp_micros(F.unix_micros(F.col("day").cast("timestamp")) + (60 + minutes) * 60000000).cast("timestamp_ntz")
    links = pays.select(ring.alias("ring"), "payer", F.col("other").alias("payee"), F.col("sent"), when.alias("ts"), F.format_string("UTR%012d", F.pmod(F.xxhash64(F.lit(seed), ring, place), F.lit(10**12))).alias("utr"))
    ids = members.select(ring.alias("ring"), "place", "account_id")
    links = links.join(ids.select("ring", F.col("place").alias("payer"), F.col("account_id").alias("src")), ["ring", "payer"]).join(ids.select("ring", F.col("place").alias("payee"), F.col("account_id").alias("dst")), ["ring", "payee"])
    zero = F.lit(0)
    debits = _event(links.withColumn("account_id", F.col("src")), F.col("ts"), F.concat(F.lit("IMPS/P2A/"), F.col("dst")), "IMPS", F.col("sent"), zero, F.col("dst"), F.col("utr"), F.col("ring"))
    credits = _event(links.withColumn("account_id", F.col("dst")), F.col("ts"), F.concat(F.lit("IMPS/P2A/"), F.col("src")), "IMPS", zero, F.col("sent"), F.col("src"), F.col("utr"), F.col("ring"))
    funded = links.groupBy("ring", "src").agg(F.sum("sent").alias("sent"), F.min("ts").alias("ts")).withColumn("account_id", F.col("src"))
    seeds = _event(funded, F.expr("ts - interval 1 hour"), F.lit("CASH DEPOSIT"), "CASH", zero, F.col("sent"), ring=F.col("ring"))
    return debits.unionByName(credits).unionByName(seeds)


def floored(accounts: DataFrame, events: DataFrame, floor: int = 100) -> DataFrame:
    """Events in order with their balance; discretionary debits (UPI) that would take it below the floor are left out.

    Whether one is left out depends on all before it, so an account's events (bounded by its months) are folded in one row.
    """
    own = events.groupBy("account_id").agg(F.sort_array(F.collect_list(F.struct("ts", "utr_ref", "narration", "channel", "debit", "credit", "node", "ring_id"))).alias("es"))
    d = own.join(accounts.select("account_id", "opening_balance"), "account_id")
    step = """aggregate(es, named_struct('b', cast(opening_balance AS decimal(24,2)), 'bs', cast(array() AS array<decimal(24,2)>)),
      (s, e) -> CASE WHEN e.channel = 'UPI' AND s.b - e.debit < {0} THEN named_struct('b', s.b, 'bs', concat(s.bs, array(cast(NULL AS decimal(24,2)))))
                     ELSE named_struct('b', cast(s.b + e.credit - e.debit AS decimal(24,2)), 'bs', concat(s.bs, array(cast(s.b + e.credit - e.debit AS decimal(24,2))))) END)""".format(int(floor))
    d = d.withColumn("bs", F.expr(step)["bs"]).select("account_id", F.posexplode(F.arrays_zip("es", "bs")).alias("n", "x"))
    return d.filter("x.bs IS NOT NULL").select("account_id", F.col("n").cast("long").alias("n"), "x.es.*", F.col("x.bs").cast("decimal(18,2)").alias("balance"))


def ledger(accounts: DataFrame, events: DataFrame, floor: int = 100) -> DataFrame:
    """The events that remain with running balance, holder and a transaction id of account and place, so no numbering over all rows is needed."""
    d = floored(accounts, events, floor).join(accounts.select("account_id", F.col("holder_name").alias("account_holder"), "bank_name"), "account_id")
    return d.select(F.format_string("TXN%s%06d", F.substring("account_id", 4, 20), F.col("n")).alias("transaction_id"), "account_id", "account_holder", "bank_name", F.date_format("ts", "yyyy-MM-dd").alias("date"), F.date_format("ts", "HH:mm:ss").alias("time"), "narration", "channel", "debit", "credit", "balance", F.col("node").alias("counterparty_account_id"), F.coalesce("utr_ref", F.format_string("TXN%012d", F.pmod(F.xxhash64("account_id", "n"), F.lit(10**12)))).alias("utr_ref"), F.col("ring_id").isNotNull().alias("is_fraud"), F.col("ring_id").alias("fraud_ring_id"))


def labels(accounts: DataFrame) -> DataFrame:
    return accounts.select("account_id", "holder_name", "persona", "is_fraud", "fraud_role", "fraud_ring_id", F.col("typology").alias("fraud_typology"))


def ring_summary(accounts: DataFrame) -> DataFrame:
    return accounts.filter("is_fraud").groupBy(F.col("fraud_ring_id").alias("ring_id"), "typology").agg(F.array_join(F.sort_array(F.collect_list("account_id")), ",").alias("accounts"))
