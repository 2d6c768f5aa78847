"""Canonical forms of values, as Column expressions; null where a value has none."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Value classes: person, telephone, e-mail, birth date, address, document, client number.
CLASSES = ("P", "T", "E", "D", "A", "I", "C")

_SPACE = r"(?U)\s+"


def digits(value: Column) -> Column:
    return F.regexp_replace(F.coalesce(value, F.lit("")), "[^0-9]", "")


def collapsed(value: Column) -> Column:
    """White space runs (also non-breaking) as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.coalesce(value, F.lit("")), _SPACE, " "))


def phone(value: Column) -> Column:
    d = digits(value)
    d = F.when(F.length(d) == 10, F.concat(F.lit("7"), d)).otherwise(d)
    d = F.when((F.length(d) == 11) & d.startswith("8"), F.concat(F.lit("7"), F.substring(d, 2, 10))).otherwise(d)
    return F.when((F.length(d) == 11) & d.startswith("7"), d)


def _plain(value: Column, least: int) -> Column:
    s = F.lower(collapsed(F.translate(F.coalesce(value, F.lit("")), ".,", "  ")))
    return F.when(F.length(s) >= least, s)


def name(value: Column) -> Column:
    return _plain(value, 2)


def address(value: Column) -> Column:
    return _plain(value, 3)


def email(value: Column) -> Column:
    s = F.lower(F.regexp_replace(F.coalesce(value, F.lit("")), r"(?U)^\s+|\s+$", ""))
    return F.when(s.rlike(r"(?U)^[^@\s]+@[^@\s]+\.[A-Za-z]{2,}$"), s)


def document(value: Column) -> Column:
    d = digits(value)
    return F.when(F.length(d) >= 5, d)


def client_id(value: Column) -> Column:
    d = digits(value)
    bare = F.regexp_replace(d, "^0+", "")
    return F.when(F.length(d) > 0, F.when(bare == "", F.lit("0")).otherwise(bare))


def normalize(cls: Column, value: Column) -> Column:
    """Canonical form by class; birth dates have none here (see ``split_birth_date``)."""
    out = F.lit(None).cast("string")
    for letter, form in (("P", name), ("T", phone), ("E", email), ("A", address), ("I", document), ("C", client_id)):
        out = F.when(cls == letter, form(value)).otherwise(out)
    return out


def split_birth_date(value: Column) -> Column:
    """struct(day_month 'DD.MM', year); null if it isn't a date. Two-digit years above 30 are of the 1900s."""
    s = F.regexp_replace(F.coalesce(value, F.lit("")), r"(?U)^\s+|\s+$", "")
    iso, dotted = r"^([0-9]{4})-([0-9]{2})-([0-9]{2})$", r"^([0-9]{1,2})[.\-/]([0-9]{1,2})[.\-/]([0-9]{2,4})$"
    is_iso = s.rlike(iso)
    part = lambda i, d: F.when(is_iso, F.regexp_extract(s, iso, i)).otherwise(F.regexp_extract(s, dotted, d))
    day, month, year = part(3, 1), part(2, 2), part(1, 3)
    full = F.when(F.length(year) == 2, F.concat(F.when(F.try_to_number(year, F.lit("99")) > 30, F.lit("19")).otherwise(F.lit("20")), year)).otherwise(year)
    whole = lambda x: F.when(x != "", x).cast("int")
    good = (is_iso | s.rlike(dotted)) & whole(day).between(1, 31) & whole(month).between(1, 12)
    return F.when(good, F.struct(F.concat(F.lpad(day, 2, "0"), F.lit("."), F.lpad(month, 2, "0")).alias("day_month"), full.alias("year")))


def identity_key(value: Column) -> Column:
    """The key names are compared by: yo folded to ye, edges freed of quotes, brackets and points, lower case.

    Not the same as ``name``, which keeps yo and turns points into spaces.
    """
    s = F.translate(F.coalesce(value, F.lit("")), "ёЁ ", "еЕ ")
    s = collapsed(F.regexp_replace(s, r"^[\s\"'«»()\[\].,;:!?]+|[\s\"'«»()\[\].,;:!?]+$", ""))
    return F.lower(s)
