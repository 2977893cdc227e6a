"""Scalar expressions of ingestion and cleaning: amounts, dates, channels, counterparties, text. Unparsable input gives null or a default, never an error."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Channel keywords in the order in which they are tried.
CHANNELS = [
    ("UPI", ["upi", "gpay", "phonepe", "paytm", "bhim", "googlepay", "@okhdfcbank", "@oksbi", "@ybl", "@axl", "@okaxis", "@ibl", "@kotak", "@okicici"]),
    ("NEFT", ["neft", "nft/", "inft"]),
    ("IMPS", ["imps"]),
    ("RTGS", ["rtgs", "blkrtgs"]),
    ("ATM", ["atm", "cash withdrawal", "atm wdl", "cwdl", "nfs cash"]),
    ("ECS", ["ecs", "nach", "si-", "standing instruction", "auto debit"]),
    ("CHEQUE", ["clg", "clearing", "chq", "cheque", "chq dep", "bb/chq", "cheque deposit"]),
    ("BILLPAY", ["billdesk", "billpay", "bbps", "electricity", "utility", "broadband", "recharge"]),
    ("CASH", ["cash dep", "cash deposit", "counter deposit", "cash credit", "by cash", "branch cash"]),
    ("WIRE", ["swift", "wire transfer", "foreign", "remittance", "international", "nostro"]),
    ("LOAN", ["loan disbursement", "emi", "loan emi", "housing loan", "vehicle loan", "personal loan"]),
    ("INTEREST", ["interest credit", "int credit", "sbint", "interest", "int on", "tds on int"]),
    ("CHARGES", ["charges", "service charge", "gst", "maintenance", "fee", "penalty", "fine"]),
    ("REVERSAL", ["reversal", "reverse", "refund", "cashback", "chargeback"]),
]
# Channel names that stand for others.
CHANNEL_NAMES = {"UPI/IMPS": "UPI", "UPI-IMPS": "UPI", "IMPS/UPI": "IMPS", "NEFT/RTGS": "NEFT", "ATM WDL": "ATM", "ATM-WDL": "ATM", "NACH": "ECS", "SI": "ECS", "CHQ": "CHEQUE", "CLG": "CHEQUE"}
# Date formats in the order in which they are tried.
DATE_FORMATS = ["dd/MM/yyyy", "dd/MM/yy", "dd-MM-yyyy", "dd-MM-yy", "dd-MMM-yyyy", "dd-MMM-yy", "dd MMM yyyy", "dd MMM yy", "dd MMMM yyyy", "dd-MMMM-yyyy", "dd.MM.yyyy", "dd.MM.yy", "yyyy-MM-dd", "MM/dd/yyyy", "yyyy/MM/dd", "ddMMyyyy"]


def amount_value(raw: Column) -> Column:
    """The unsigned amount in a cell such as '5,195.00Cr', '$100', '75.50/-' or '(1,234.50)': its digits and points alone; 0 if these are no number."""
    bare = F.regexp_replace(raw, r"(?i)rs\.", "")
    digits = F.regexp_replace(bare, r"[^\d.]", "")
    return F.coalesce(F.when(digits.rlike(r"^\d*\.?\d+$|^\d+\.$"), digits.try_cast("decimal(18,2)")), F.lit(0).cast("decimal(18,2)"))


def has_amount(raw: Column) -> Column:
    """Whether a cell holds a number at all, which tells text that can't be read from an amount of 0."""
    return F.coalesce(F.regexp_replace(raw, r"(?i)rs\.", "").rlike(r"\d"), F.lit(False))


def amount_sign(raw: Column) -> Column:
    """'+' for Cr, '-' for Dr, brackets or a minus sign, else empty."""
    return F.when(raw.rlike(r"(?i)cr\s*$|^\s*cr"), "+").when(raw.rlike(r"(?i)dr\s*$|^\s*dr|^\s*\(.*\)\s*$|^\s*-"), "-").otherwise("")


# Texts that stand for no amount.
NO_AMOUNT = ["", "-", "--", "nil", "n/a", "nan", "none"]


def clean_amount(raw: Column, signed: bool = False) -> Column:
    """The amount in a cell, 0 if there is none. Brackets, Dr or D at either end, or a minus sign make it negative where signs are kept."""
    low = F.coalesce(F.lower(F.trim(raw.cast("string"))), F.lit(""))
    bare = F.trim(F.regexp_replace(F.regexp_replace(low, r"^\((.*)\)$", "$1"), r"[₹$£€]|inr|rs\.?", ""))
    digits = F.regexp_replace(bare, r"[^\d.]", "")
    whole, rest = F.substring_index(digits, ".", 1), F.regexp_extract(digits, r"\.(.*)$", 1)
    value = F.concat(whole, F.lit("."), F.replace(rest, F.lit("."), F.lit("")))
    number = F.when(~low.isin(NO_AMOUNT) & (digits.rlike(r"\d")), F.concat(F.lit("0"), value).try_cast("decimal(18,2)"))
    out = F.coalesce(number, F.lit(0).cast("decimal(18,2)"))
    return F.when(low.rlike(r"^\(.*\)$") | bare.rlike(r"^-|(dr|d)\s*$|^(dr|d)\b"), -out).otherwise(out) if signed else out


def is_corrected(raw: Column, signed: bool = False) -> Column:
    """Whether clean_amount() reads a cell otherwise than as a plain number; texts for no amount are none."""
    plain = F.coalesce(raw.cast("string").try_cast("double"), F.lit(0.0))
    return F.abs(clean_amount(raw, signed).cast("double") - plain) > 1e-6


def moment(date: Column, time: Column) -> Column:
    """The timestamp of a date in any of DATE_FORMATS and a time of day, midnight if the time can't be read, null if the date can't."""
    clock = F.upper(F.trim(F.coalesce(time, F.lit(""))))
    part = lambda i: F.regexp_extract(clock, r"^(\d{1,2}):(\d{2})(?::(\d{2}))?(?:\.\d+)?\s*(AM|PM)?$", i)
    hour = part(1).try_cast("int") % F.when(part(4) == "", 24).otherwise(12) + F.when(part(4) == "PM", 12).otherwise(0)
    told = F.format_string("%02d:%s:%s", hour, part(2), F.when(part(3) == "", "00").otherwise(part(3)))
    # One element, so that the long expression of the date is written once.
    whole = lambda day: F.coalesce(F.try_to_timestamp(F.concat(day, F.lit(" "), F.when(part(1).try_cast("int") < 24, told)), F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp(day, F.lit("yyyy-MM-dd")))
    return F.get(F.transform(F.array(F.nullif(parse_date(date), F.lit(""))), whole), F.lit(0))


def parse_date(raw: Column) -> Column:
    """yyyy-MM-dd by the first format that fits, else of the first date within the text, or an empty string. A time after the date is dropped, O next to digits is 0."""
    x = F.regexp_replace(F.trim(raw), r"\s+\d{1,2}:\d{2}.*$", "")
    x = F.regexp_replace(F.regexp_replace(x, r"(?<=\d)[Oo]|[Oo](?=\d)", "0"), r"\s*([-/.])\s*", "$1")
    x = F.regexp_replace(x, r"^(\d{1,2}[- ])([A-Za-z])([A-Za-z]+)", "$1$2$3")
    day = lambda text, form: F.date_format(F.try_to_timestamp(text, F.lit(form)), "yyyy-MM-dd")
    inside = F.regexp_replace(F.regexp_extract(x, r"(?<!\d)(\d{1,2}[/\-.]\d{1,2}[/\-.](?:\d{4}|\d{2}))(?!\d)", 1), "[-.]", "/")
    named = F.initcap(F.regexp_replace(F.regexp_extract(x, r"(?<!\d)(\d{1,2}[- /][A-Za-z]{3}[- /]\d{4})(?!\d)", 1), "[ /]", "-"))
    within = [day(inside, f) for f in ("d/M/yyyy", "d/M/yy", "M/d/yyyy")] + [day(named, "d-MMM-yyyy")]
    return F.coalesce(*[day(F.initcap(x), f) for f in DATE_FORMATS], *within, F.lit(""))


def channel_of(narration: Column) -> Column:
    low = F.lower(F.coalesce(narration, F.lit("")))
    out = F.lit("OTHER")
    for name, keys in reversed(CHANNELS):
        hit = F.lit(False)
        for k in keys:
            hit = hit | low.contains(k)
        out = F.when(hit, name).otherwise(out)
    return out


def normal_text(raw: Column) -> Column:
    """Upper case; marks that scanners leave, and runs of white space, as one space."""
    return F.upper(F.trim(F.regexp_replace(raw, r"[|\\<>{}\[\]~`°\s]+", " ")))


def normal_channel(raw: Column) -> Column:
    """The usual name of a channel; others stay, in upper case without spaces around."""
    name = F.upper(F.trim(raw))
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in CHANNEL_NAMES.items() for x in pair]), name), name)


# Names after UPI and bank transfer marks, payment addresses.
UPI_NAME = r"(?i)UPI/\d+/(?:CR|DR)/([A-Za-z\s]{2,25})/"
TRANSFER_NAME = r"(?i)(?:IMPS|NEFT|RTGS)[/\-](?:P2A|P2M)?[/\-]?\d+[/\-]([A-Za-z][A-Za-z\s]{2,30})"
PAYMENT_ADDRESS = r"([A-Za-z0-9._\-]+@[A-Za-z0-9]+)"


def counterparty_of(narration: Column) -> Column:
    """The other party in a narration: UPI name, name after a transfer mark, payment address, else the first of the second to fourth parts
    between slashes, dashes and bars that is no code of eight capitals and digits, no number and longer than two; empty if none."""
    text = F.trim(F.coalesce(narration, F.lit("")))
    upi, named = F.trim(F.regexp_extract(text, UPI_NAME, 1)), F.trim(F.regexp_extract(text, TRANSFER_NAME, 1))
    part = F.get(F.filter(F.transform(F.slice(F.split(text, r"[-/|]"), 2, 3), lambda c: F.trim(c)), lambda c: (F.length(c) > 2) & ~c.rlike(r"^[A-Z0-9]{8,}$|^\d+$")), F.lit(0))
    told = F.when((F.length(upi) > 1) & ~upi.rlike("^[A-Z0-9]{8,}$"), F.initcap(upi)).when(F.length(named) > 2, F.initcap(named))
    return F.coalesce(told, F.nullif(F.regexp_extract(text, PAYMENT_ADDRESS, 1), F.lit("")), F.initcap(part), F.lit(""))


def counterparty_account_of(narration: Column) -> Column:
    """A payment address in small letters, else the first part between slashes, dashes and bars of 10 to 18 digits; empty if none."""
    text = F.coalesce(narration, F.lit(""))
    number = F.get(F.filter(F.transform(F.split(text, r"[-/|]"), lambda c: F.trim(c)), lambda c: c.rlike(r"^\d{10,18}$")), F.lit(0))
    return F.coalesce(F.nullif(F.lower(F.regexp_extract(text, PAYMENT_ADDRESS, 1)), F.lit("")), number, F.lit(""))
