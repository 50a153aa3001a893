"""Licence text: section, canonical form, class, filler numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hostelry.functions.text import let

# Licence classes.
DWELLING = "dwelling"
HOTEL = "hotel"
HOSTEL = "hostel"
APARTMENTS = "apartments"
EXEMPT = "exempt"
SEASONAL = "seasonal"
NONE = "none"
# Number prefix by class, in the order they are tried on the regional number.
REGIONAL_PREFIXES = [
    (DWELLING, ["HUTB", "HUT"]), (HOTEL, ["HB", "HCC"]), (HOSTEL, ["AJ"]), (APARTMENTS, ["ATB", "ATCC"]),
]
# Markers inside the national number.
NATIONAL_MARKS = [(DWELLING, ["ESFCTU", "ESHFTU"]), (SEASONAL, ["ESFCNT", "ESHFNT"])]


def regional_section(text: Column, region: str) -> Column:
    """The regional number, apart from the national one that embeds it; null when absent."""
    pattern = rf"(?i){region}\s*-\s*Regional registration number\s*(?:<br\s*/?>)*\s*([^<]*)"
    return F.trim(F.get(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), 0))


def canonical(text: Column) -> Column:
    """``hutb-5204`` → ``HUTB-005204``; longer numbers keep every digit."""
    pattern = r"^([A-Za-z]+)[-\s]*0*(\d+)$"

    def form(found: Column) -> Column:
        digits = F.regexp_extract(found, pattern, 2)
        padded = F.lpad(digits, F.greatest(F.length(digits), F.lit(6)), F.lit("0"))
        return F.concat(F.upper(F.regexp_extract(found, pattern, 1)), F.lit("-"), padded)

    whole = F.regexp_extract_all(F.trim(text), F.lit(pattern), F.lit(0))
    return F.get(F.transform(whole, form), 0)


def prefix(code: Column) -> Column:
    return F.nullif(F.regexp_extract(code, r"^([A-Z]+)-", 1), F.lit(""))


def number(code: Column) -> Column:
    """Number as decimal text without leading zeros: it may be longer than a long."""
    return F.regexp_replace(F.regexp_extract(code, r"-(\d+)$", 1), "^0+(?=\\d)", "")


def classify(text: Column, regional: Column) -> Column:
    """Regional number first; the national one only when the regional says nothing."""

    def choose(both: Column) -> Column:
        chosen = F.when(F.lit(False), F.lit(""))
        for label, starts in REGIONAL_PREFIXES:
            for start in starts:
                chosen = chosen.when(both["up"].startswith(start), F.lit(label))
        chosen = chosen.when(both["up"].contains("EXEMPT"), F.lit(EXEMPT))
        for label, marks in NATIONAL_MARKS:
            for mark in marks:
                chosen = chosen.when(both["whole"].contains(mark), F.lit(label))
        return chosen.otherwise(F.lit(NONE))

    up = F.upper(F.coalesce(regional, F.lit("")))
    whole = F.upper(F.coalesce(text, F.lit("")))
    return let(F.struct(up.alias("up"), whole.alias("whole")), choose)


def is_filler(digits: Column) -> Column:
    """One digit repeated, or digits in a row up or down."""
    return (
        digits.rlike(r"^(\d)\1*$")
        | (F.instr(F.lit("0123456789"), digits) > 0)
        | (F.instr(F.lit("9876543210"), digits) > 0)
    )
