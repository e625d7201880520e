"""Checks of identifiers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilwork.catalog.rules import ZIP_PREFIXES


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(c: Column) -> Column:
    d = digits(c)
    return (F.length(d) >= 10) & F.call_function("luhn_check", d)


def card(c: Column) -> Column:
    d = digits(c)
    return F.length(d).between(13, 19) & F.call_function("luhn_check", d)


def ssn(c: Column) -> Column:
    d = digits(c)
    area = F.substring(d, 1, 3)
    return (F.length(d) == 9) & ~area.isin("000", "666") & (area < "900") & (F.substring(d, 4, 2) != "00") & (F.substring(d, 6, 4) != "0000")


def dea(c: Column) -> Column:
    code = F.regexp_extract(F.regexp_replace(F.upper(c), "[^A-Z0-9]", ""), "[A-Z]{2}([0-9]{7})", 1)
    n = [F.substring(code, i, 1).try_cast("int") for i in range(1, 8)]
    return F.coalesce((code != "") & ((n[0] + n[2] + n[4] + 2 * (n[1] + n[3] + n[5])) % 10 == n[6]), F.lit(False))


def npi(c: Column) -> Column:
    d = digits(c)
    return (F.length(d) == 10) & F.substring(d, 1, 1).isin("1", "2") & F.call_function("luhn_check", F.concat(F.lit("80840"), d))


def npi_strict(c: Column) -> Column:
    """Ten digits and nothing else."""
    return c.rlike(r"^[0-9]{10}\z") & npi(c)


def sin(c: Column) -> Column:
    d = digits(c)
    return (F.length(d) == 9) & F.call_function("luhn_check", d)


def iban(c: Column) -> Column:
    code = F.upper(F.regexp_replace(c, r"\s", ""))
    turned = F.concat(F.substring(code, 5, 40), F.substring(code, 1, 4))
    step = lambda acc, x: F.when(x.rlike("[0-9]"), (acc * 10 + x.try_cast("int")) % 97).otherwise((acc * 100 + F.ascii(x) - 55) % 97)
    rest = F.aggregate(F.split(turned, ""), F.lit(0), step)
    return F.length(code).between(15, 34) & code.rlike("^[A-Z0-9]+$") & F.coalesce(rest == 1, F.lit(False))


def zip_code(c: Column) -> Column:
    d = digits(c)
    return F.length(d).isin(5, 9) & F.substring(d, 1, 3).isin(ZIP_PREFIXES)


def luhn_digit(c: Column) -> Column:
    """The digit that makes ``c`` pass Luhn's test."""
    total = F.aggregate(
        F.transform(F.reverse(F.split(c, "")), lambda x, i: F.when(i % 2 == 0, F.when(x.cast("int") > 4, x.cast("int") * 2 - 9).otherwise(x.cast("int") * 2)).otherwise(x.cast("int"))),
        F.lit(0),
        lambda a, b: a + b,
    )
    return ((10 - total % 10) % 10).cast("string")


def entropy(c: Column) -> Column:
    """Shannon entropy over characters, in bits; 0 for the empty string."""
    chars = F.split(c, "")
    n = F.length(c)
    return F.when(n == 0, F.lit(0.0)).otherwise(
        F.aggregate(
            F.array_distinct(chars),
            F.lit(0.0),
            lambda acc, x: acc - (F.size(F.filter(chars, lambda y: y == x)) / n) * F.log2(F.size(F.filter(chars, lambda y: y == x)) / n),
        )
    )


CHECKS = {"luhn": luhn, "card": card, "ssn": ssn, "dea": dea, "npi": npi, "sin": sin, "iban": iban, "zip": zip_code}
