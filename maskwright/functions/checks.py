"""Check digits of Russian identifiers, as Column expressions over strings of any separators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .normalize import digits

# Weights of the check digits, and ranges of Unix times that identifiers are not taken for.
SNILS_WEIGHTS = (9, 8, 7, 6, 5, 4, 3, 2, 1)
INN10_WEIGHTS = (2, 4, 10, 3, 5, 9, 4, 6, 8)
INN12_WEIGHTS = ((7, 2, 4, 10, 3, 5, 9, 4, 6, 8), (3, 7, 2, 4, 10, 3, 5, 9, 4, 6, 8))
EPOCH_SECONDS = (1_000_000_000, 2_300_000_000)
EPOCH_MILLIS = (1_000_000_000_000, 2_300_000_000_000)


def _digit(d: Column, i: int) -> Column:
    """The i-th digit (from 0) as a number: arithmetic on the code point stays in generated code."""
    return F.ascii(F.substring(d, i + 1, 1)) - 48


def _weighted(d: Column, weights: tuple[int, ...]) -> Column:
    return sum((_digit(d, i) * w for i, w in enumerate(weights)), F.lit(0))


def snils_ok(value: Column) -> Column:
    d = digits(value)
    rest = _weighted(d, SNILS_WEIGHTS) % 101
    return (F.length(d) == 11) & (F.when(rest == 100, 0).otherwise(rest) == _digit(d, 9) * 10 + _digit(d, 10))


def inn10_ok(value: Column) -> Column:
    d = digits(value)
    return (F.length(d) == 10) & (_weighted(d, INN10_WEIGHTS) % 11 % 10 == _digit(d, 9))


def inn12_ok(value: Column) -> Column:
    d = digits(value)
    a, b = INN12_WEIGHTS
    return (F.length(d) == 12) & (_weighted(d, a) % 11 % 10 == _digit(d, 10)) & (_weighted(d, b) % 11 % 10 == _digit(d, 11))


def inn_ok(value: Column) -> Column:
    return inn10_ok(value) | inn12_ok(value)


def _prefix_ok(value: Column, length: int, mod: int) -> Column:
    d = digits(value)
    head = F.when(F.length(d) == length, F.substring(d, 1, length - 1)).cast("long")
    return F.coalesce((F.length(d) == length) & (head % mod % 10 == _digit(d, length - 1)), F.lit(False))


def ogrn_ok(value: Column) -> Column:
    return _prefix_ok(value, 13, 11)


def ogrnip_ok(value: Column) -> Column:
    return _prefix_ok(value, 15, 13)


def is_epoch(value: Column) -> Column:
    """Whether the digits are a time in seconds (10 digits) or, of 12 digits, in the range of milliseconds."""
    d = digits(value)
    n = F.when(F.length(d).between(1, 18), d).cast("long")
    return F.coalesce((F.length(d) == 10) & n.between(*EPOCH_SECONDS) | (F.length(d) == 12) & n.between(*EPOCH_MILLIS), F.lit(False))
