"""Checksums of identifiers as Column functions of their digits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Length of an IBAN by country (public registry).
IBAN_LENGTHS = {
    "AD": 24, "AT": 20, "BA": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DZ": 26, "EE": 20, "ES": 24, "FI": 18,
    "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MA": 28, "MC": 27,
    "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TN": 24, "TR": 26,
}


def national_number_ok(d: Column) -> Column:
    """Belgian national number: 97 less the first nine digits (2 before them from 2000 on) mod 97."""
    base, check = F.substring(d, 1, 9).cast("long"), F.substring(d, 10, 2).cast("long")
    return (check == 97 - base % 97) | (check == 97 - (base + 2_000_000_000) % 97)


def national_number_score(d: Column, dotted: Column) -> Column:
    """1.0 if the key holds, 0.75 in the usual dotted form, 0.3 else; null if it has no such date."""
    month, day = F.substring(d, 3, 2).cast("int"), F.substring(d, 5, 2).cast("int")
    dated = (day <= 31) & ((month <= 12) | month.between(20, 32) | month.between(40, 52))
    return F.when(dated, F.when(national_number_ok(d), 1.0).when(dotted, 0.75).otherwise(0.3))


def nir_ok(x: Column) -> Column:
    """French social security number, Corsican departments as 19 and 18."""
    body = F.replace(F.replace(F.upper(F.substring(x, 1, 13)), F.lit("2A"), F.lit("19")), F.lit("2B"), F.lit("18"))
    return 97 - body.cast("long") % 97 == F.substring(x, 14, 2).cast("long")


def enterprise_ok(d: Column) -> Column:
    """Belgian enterprise number of ten digits."""
    return (F.length(d) == 10) & (97 - F.substring(d, 1, 8).cast("long") % 97 == F.substring(d, 9, 2).cast("long"))


def account_ok(d: Column) -> Column:
    """Twelve digits whose last two are the first ten mod 97, 97 for 0."""
    rest = F.substring(d, 1, 10).cast("long") % 97
    return (F.length(d) == 12) & (F.when(rest == 0, 97).otherwise(rest) == F.substring(d, 11, 2).cast("long"))


def mod97(x: Column) -> Column:
    """A string of digits and letters (A for 10 and so on) mod 97, folded character by character."""
    one = lambda r, c: F.when(c.rlike("[0-9]"), (r * 10 + c.cast("int")) % 97).otherwise((r * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.split(x, ""), F.lit(0), lambda r, c: F.when(c == "", r).otherwise(one(r, c)).cast("int"))


def iban_ok(x: Column) -> Column:
    return mod97(F.concat(F.substring(x, 5, 40), F.substring(x, 1, 4))) == 1


def iban_score(x: Column) -> Column:
    """1.0 with a good key, 0.65 with a bad one, 0.9 with a good one of an unlisted country; null if it is no IBAN."""
    lengths = F.create_map(*[F.lit(v) for pair in IBAN_LENGTHS.items() for v in pair])
    size = F.try_element_at(lengths, F.substring(x, 1, 2))
    known = F.when(F.length(x) >= size, F.when(iban_ok(F.substring(x, F.lit(1), size)), 1.0).otherwise(0.65))
    return F.when(size.isNotNull(), known).when(F.length(x).between(15, 34) & iban_ok(x), 0.9)


def luhn_ok(d: Column) -> Column:
    return F.call_function("luhn_check", d)


def boosted(score: Column, before: Column, context: str, boost: float) -> Column:
    """A score raised where the text before a match holds its context."""
    return F.when((score < 1) & before.rlike(context), F.least(F.lit(1.0), score + boost)).otherwise(score)
