"""Column expressions on texts: numbers, dates and identifiers as filings write them. What can't be read is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strict_number(x: Column, negative: bool = False, integer: bool = False) -> Column:
    """A complete number with optional `$`, `,`, `%` and accounting parentheses."""
    raw = F.trim(x)
    bare = F.trim(F.regexp_replace(F.regexp_replace(raw, r"^\((.*)\)$", "$1"), "[$,%]", ""))
    number = F.when(bare.rlike(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)$"), bare.try_cast("double"))
    number = F.when(raw.rlike(r"^\(.*\)$"), -number).otherwise(number)
    number = number if negative else F.when(number >= 0, number)
    return F.when(number == F.floor(number), number) if integer else number


def lenient_number(x: Column) -> Column:
    return F.regexp_replace(x, "[$,%\\s]", "").try_cast("double")


def us_date(x: Column) -> Column:
    return F.when(F.trim(x).rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.try_to_date(F.trim(x), "M/d/yyyy"))


def sec_date(x: Column) -> Column:
    return F.when(x.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(x, "yyyy-MM-dd")).when(x.rlike(r"^\d{2}-\d{2}-\d{4}$"), F.try_to_date(x, "MM-dd-yyyy"))


def turkish_number(x: Column) -> Column:
    return F.replace(F.replace(F.trim(x), F.lit("."), F.lit("")), F.lit(","), F.lit(".")).try_cast("double")


def kap_date(x: Column) -> Column:
    return F.try_to_date(F.substring(x, 1, 10), "dd/MM/yyyy")


def archive_time(x: Column) -> Column:
    return F.when(x.rlike(r"^\d{14}$"), F.try_to_timestamp(x, F.lit("yyyyMMddHHmmss")))


def issuer_key(name: Column) -> Column:
    """The first two words of a name in capitals without punctuation."""
    words = F.filter(F.split(F.regexp_replace(F.upper(name), "[^A-Z0-9]+", " "), " "), lambda w: w != "")
    return F.array_join(F.slice(words, 1, 2), " ")


def valid_cusip(x: Column) -> Column:
    cusip = F.upper(F.trim(x))
    return F.when(cusip.rlike("^[0-9A-Z]{9}$") & (cusip != "000000000"), cusip)


def padded_cusip(x: Column) -> Column:
    """Six to nine letters and digits, whatever white space is among them, with the zeros that they lost; null for anything else."""
    plain = F.upper(F.regexp_replace(x, r"\s+", ""))
    return F.when(plain.rlike("^[0-9A-Z]{6,9}$"), F.lpad(plain, 9, "0"))


def cik(x: Column) -> Column:
    return F.when(F.trim(x).rlike(r"^\d{1,10}$"), F.lpad(F.trim(x), 10, "0"))


def security_key(cusip: Column, title: Column, put_call: Column) -> Column:
    return F.concat_ws("|", cusip, F.upper(F.trim(title)), F.coalesce(put_call, F.lit("")))


#: What a symbol's end, the whole symbol or its start tells of its listing; the first that fits counts.
VENUES = (
    (r"0P[0-9A-Z]+\.ST", "Stockholm fund NAV"), (r".*\.L", "London-listed"), (r".*\.DE", "Xetra-listed"), (r".*\.ST", "Stockholm-listed"), (r".*-USD", "crypto"), (r"\^VIX|\^VXN", "US-listed"),
    (r"\^STOXX", "STOXX Europe index"), (r"\^OMXSBGI", "Stockholm-listed"), (r"\^.*", "index"), (r".*", "US-listed"),
)


def venue(symbol: Column) -> Column:
    """The listing venue that a symbol's form tells, looked up in VENUES."""
    return F.coalesce(*(F.when(symbol.rlike(f"(?s)^({form})$"), F.lit(name)) for form, name in VENUES))
