"""The cleaning passes: duplicates, dates, balances, outliers; each adds columns or returns its findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import DEFAULT, Thresholds

FIRST_YEAR, LAST_YEAR = 2000, 2030


def exact_duplicates(rows: DataFrame, key: list[str], seq: str) -> DataFrame:
    """Rows after the first (by seq) of equal keys."""
    return rows.withColumn("copy", F.row_number().over(Window.partitionBy(*key).orderBy(seq))).filter("copy > 1")


def near_duplicates(rows: DataFrame, key: list[str], text: str, seq: str) -> DataFrame:
    """Rows with the key of an earlier one but another text."""
    first = F.first(text).over(Window.partitionBy(*key).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("first_text", first).filter(~F.col(text).eqNullSafe(F.col("first_text"))).drop("first_text")


def balance_breaches(rows: DataFrame, p: Thresholds = DEFAULT) -> DataFrame:
    """Rows whose balance is not the last one plus credit minus debit, within the tolerance; where both balances are 0 none is known. rows: account_id, t, seq, debit, credit, balance."""
    w = Window.partitionBy("account_id").orderBy("t", "seq")
    last = F.lag("balance").over(w)
    gap = F.abs(F.col("balance") - (last + F.col("credit") - F.col("debit")))
    return rows.withColumn("gap", F.when(~((last == 0) & (F.col("balance") == 0)), gap)).withColumn("is_breach", F.coalesce(F.col("gap") > p.balance_tolerance, F.lit(False)))


def suspects(checked: DataFrame) -> DataFrame:
    """Accounts of balance_breaches() with over 5 % of rows in breach; HIGH over 50 %."""
    g = checked.groupBy("account_id").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("is_breach").alias("breaches")).filter("n_rows >= 2")
    ratio = F.col("breaches") / F.col("n_rows")
    return g.filter(ratio > 0.05).select("account_id", "n_rows", "breaches", F.round(ratio, 4).alias("ratio"), F.when(ratio > 0.5, "HIGH").otherwise("MEDIUM").alias("severity"))


def running_balance(rows: DataFrame) -> DataFrame:
    w = Window.partitionBy("account_id").orderBy("t", "seq").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("balance", F.sum(F.col("credit") - F.col("debit")).over(w))


def iqr_outliers(rows: DataFrame, p: Thresholds = DEFAULT) -> DataFrame:
    """Debits and credits above Q3 + factor * IQR of their account's non-zero ones, for accounts with enough rows and sides with enough values that differ (IQR above 0)."""
    side = lambda name: F.struct(F.lit(name.upper()).alias("side"), F.col(name).alias("amount"))
    sizes = rows.groupBy("account_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= p.iqr_rows).select("account_id")
    moved = rows.select("seq", "account_id", F.explode(F.array(side("debit"), side("credit"))).alias("m")).select("seq", "account_id", "m.*").filter("amount > 0")
    s = moved.groupBy("account_id", "side").agg(F.count(F.lit(1)).alias("k"), F.expr("percentile(cast(amount AS double), array(0.25, 0.75))").alias("q"))
    s = s.filter((F.col("k") >= p.iqr_values) & (F.col("q")[1] > F.col("q")[0])).select("account_id", "side", (F.col("q")[1] + p.iqr_factor * (F.col("q")[1] - F.col("q")[0])).alias("fence"))
    found = moved.join(s.join(sizes, "account_id"), ["account_id", "side"]).filter(F.col("amount").cast("double") > F.col("fence"))
    return found.select("seq", "account_id", "side", F.col("amount").cast("double").alias("amount"), F.round("fence", 4).alias("fence"))


def date_flags(date: Column) -> Column:
    """What is wrong with a yyyy-MM-dd string: NULL_DATE, BAD_DATE_FORMAT, DATE_OUT_OF_RANGE, else null."""
    year = F.year(F.try_to_timestamp(date, F.lit("yyyy-MM-dd")))
    blank = date.isNull() | (F.trim(date) == "")
    return F.when(blank, "NULL_DATE").when(year.isNull(), "BAD_DATE_FORMAT").when(~year.between(FIRST_YEAR, LAST_YEAR), "DATE_OUT_OF_RANGE")


def flag_text(flags: dict[str, Column]) -> Column:
    """The names of the true flags, in the given order, parted by ' | '."""
    return F.concat_ws(" | ", *[F.when(test, name) for name, test in flags.items()])


# What flags of a row mean to a reader, in order.
FLAG_REASONS = {
    "is_duplicate": "NEAR_DUPLICATE: same date+amounts, different narration",
    "is_balance_breach": "BALANCE_BREACH: balance does not reconcile with prior row",
    "is_high_value_flag": "HIGH_VALUE_OUTLIER: amount exceeds 3×IQR for this account",
    "is_velocity_flag": "VELOCITY_BURST: rapid succession of debits in short window",
    "is_ocr_row": "OCR_SOURCE: lower data confidence (scanned image)",
}


def amount_flag(debit: Column, credit: Column) -> Column:
    """ZERO_DEBIT_AND_CREDIT for a row that moves nothing, else null; a missing amount is 0."""
    zero = F.lit(0)
    return F.when((F.coalesce(debit, zero) == 0) & (F.coalesce(credit, zero) == 0), "ZERO_DEBIT_AND_CREDIT")


def is_scanned(source_format: Column) -> Column:
    """Whether a row was read from an image."""
    return F.coalesce(F.lower(source_format) == "image", F.lit(False)) | F.coalesce(F.lower(source_format).isin("png", "jpg", "jpeg", "tiff", "tif"), F.lit(False))


def described(rows: DataFrame) -> DataFrame:
    """Adds flag_description: clean_flags and what the true flags mean, parted by ' | ', empty for clean rows. Flags that a table lacks are false."""
    own = [F.nullif(F.trim("clean_flags"), F.lit(""))] if "clean_flags" in rows.columns else []
    told = [F.when(F.col(c), F.lit(text)) for c, text in FLAG_REASONS.items() if c in rows.columns]
    return rows.withColumn("flag_description", F.concat_ws(" | ", *own, *told))


def parted(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with some flag, and rows without any."""
    d = rows if "flag_description" in rows.columns else described(rows)
    return d.filter("flag_description <> ''"), d.filter("flag_description = ''")


def inferred_movements(rows: DataFrame) -> DataFrame:
    """Rows without debit and credit take theirs from the change of the balance against the account's row before."""
    w = Window.partitionBy("account_id").orderBy("t", "seq")
    step = F.when((F.col("debit") == 0) & (F.col("credit") == 0) & (F.col("balance") != 0), F.col("balance") - F.lag("balance").over(w))
    out = rows.withColumn("step", step)
    credit, debit = F.when(F.col("step") > 0, F.col("step")).otherwise(F.col("credit")), F.when(F.col("step") < 0, -F.col("step")).otherwise(F.col("debit"))
    return out.withColumn("credit", credit).withColumn("debit", debit).withColumn("is_inferred", F.coalesce(F.col("step") != 0, F.lit(False))).drop("step")


def across_files(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds copy, 1 for the first of rows with equal account, date, narration and money to the cent (nulls as '' and 0); higher ones are removed by callers."""
    key = [F.coalesce(c, F.lit("")) for c in ("account_id", "date", "narration")] + [F.coalesce(F.col(c).cast("decimal(18,2)"), F.lit(0)) for c in ("debit", "credit")]
    return rows.withColumn("copy", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))


def named_holders(rows: DataFrame) -> DataFrame:
    """Blank holders become 'Person N', one per account (per file without one), in the order of files and lines.

    Accounts are numbered within their first file, and files' counts are summed over a window of one row per file.
    """
    key = F.coalesce(F.nullif(F.trim("account_id"), F.lit("")), F.trim("source_file"))
    blank = F.trim(F.lower(F.coalesce("account_holder", F.lit("")))).isin("", "nan")
    first = rows.filter(blank).groupBy(key.alias("its_key")).agg(F.min(F.struct("source_file", "seq")).alias("first"))
    first = first.withColumn("nth", F.row_number().over(Window.partitionBy("first.source_file").orderBy("first.seq", "its_key")))
    per_file = first.groupBy(F.col("first.source_file").alias("its_file")).agg(F.count(F.lit(1)).alias("n"))
    before = per_file.select("its_file", (F.sum("n").over(Window.orderBy("its_file")) - F.col("n")).alias("before"))
    labels = first.join(before, F.col("first.source_file") == F.col("its_file")).select("its_key", F.format_string("Person %d", F.col("before") + F.col("nth")).alias("label"))
    return rows.withColumn("its_key", key).join(labels, "its_key", "left").withColumn("account_holder", F.when(blank, F.col("label")).otherwise(F.col("account_holder"))).drop("its_key", "label")
