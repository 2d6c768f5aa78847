"""Detectors as functions of a text column, giving arrays of spans.

E-mails are found by expressions alone. The other detectors look around each match, reserve places and check digits: they
are the functions of ``scan``, run in Arrow batches, one pass a text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskwright.functions import arrow, normalize, scan
from maskwright.functions import spans as S

EMAIL = scan.EMAIL


def emails(text: Column) -> Column:
    return S.find(text, EMAIL, "E", 1, normalize.email, hint="@")


phones = arrow.of_text(scan.phones)
#: SNILS, 12-digit INN and passport numbers by shape and plausibility.
documents = arrow.of_text(scan.documents)
addresses = arrow.of_text(scan.addresses)
#: Day and month of dates beside a birth word; the year stays open and out of the span.
birth_dates = arrow.of_text(scan.birth_dates)
client_ids = arrow.of_text(scan.client_ids)
#: Ten kinds of Russian identifiers in their order of priority; ``suffix`` names the kind.
ru_ids = arrow.of_text(scan.ru_ids)
#: All rule detectors, merged.
rules = arrow.of_text(scan.rules)
#: Values of pasted tables under known headings.
tabular = arrow.of_text(scan.tabular)
#: Standalone runs of 7 to 12 digits: candidates for numbers known to the dictionary.
number_runs = arrow.of_text(scan.number_runs)
#: Codes in all surfaces, damaged copies of compact ones too; canonical form in norm.
code_spans = arrow.of_text(scan.code_spans)


def rules_but(words: scan.Vocabulary):
    """All rule detectors but for a deployment's own addresses and telephones."""
    return arrow.of_text(lambda text: scan.merge(s for s in scan.every_rule(text) if not words.constant(s)))


def in_client_context(text: Column, start: Column, end: Column, radius: int = 40) -> Column:
    left = F.greatest(F.lit(0), start - radius)
    return F.substring(text, left + 1, end + radius - left).rlike("(?iu)" + scan.CLIENT_CONTEXT.pattern)


def boundary_ok(text: Column, start: Column, end: Column) -> Column:
    """No letter touches the span."""
    before = F.when(start > 0, F.substring(text, start, F.lit(1))).otherwise(F.lit(""))
    return ~before.rlike(r"\p{L}") & ~F.substring(text, end + 1, F.lit(1)).rlike(r"\p{L}")
