"""Keyed codes and digests as Column expressions: HMAC-SHA256 by two nested hashes, base32 by bit slices."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

# Surfaces of a code.
PREFIX, LENGTH, CLASS_LETTERS, SALTS, FRAMED_LENGTH = "z", 8, "PTEDAIC", 64, 12
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
COMPACT = r"(?i)z([PTEDAIC])([A-Z2-7]{8})"
FRAMED = r"(?:⟦|\\u27e6)([PTEDAIC])-([A-Z2-7]{12})(?:⟧|\\u27e7)|\[\[([PTEDAIC])-([A-Z2-7]{12})\]\]"
BARE = r"(?<![A-Za-z0-9-])([PTEDAIC])-([A-Z2-7]{12})(?![A-Za-z0-9-])"
COMPACT_IN_TEXT = r"(?i)(?<![A-Za-z0-9А-Яа-яЁё])z[PTEDAIC][A-Z2-7]{8}(?![A-Za-z0-9А-Яа-яЁё])"
TRUNCATED = r"(?:\[\[|⟦)[A-Z]-[A-Z0-9]{0,32}$"


def _pads(key: bytes) -> tuple[bytes, bytes]:
    if not key:
        raise ValueError("the key is empty")
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)


def hmac_hex(message: Column, key: bytes) -> Column:
    """HMAC-SHA256 of the UTF-8 message, in lower-case hex; stays in generated code."""
    inner, outer = _pads(key)
    within = F.unhex(F.sha2(F.concat(F.lit(bytearray(inner)), F.encode(message, "UTF-8")), 256))
    return F.sha2(F.concat(F.lit(bytearray(outer)), within), 256)


def base32_head(hex_: Column, length: int = LENGTH) -> Column:
    """The first ``length`` (at most 8) base32 letters of a hash in hex."""
    bits = F.conv(F.substring(hex_, 1, 10), 16, 10).cast("long")
    letter = lambda b, k: F.substring(F.lit(ALPHABET), F.shiftright(b, 35 - 5 * k).bitwiseAND(31).cast("int") + 1, F.lit(1))
    # bound to a variable, as the hash would be worked out for each letter where the whole stands within a lambda
    return F.get(F.transform(F.array(bits), lambda b: F.concat(*(letter(b, k) for k in range(length)))), F.lit(0))


def code(cls: Column, identity: Column, key: bytes, salt: int | Column = 0, length: int = LENGTH) -> Column:
    """The code of a class and identity; salt 0 is the first choice, others resolve collisions."""
    message = F.concat(cls, F.lit(":"), identity)
    if isinstance(salt, Column):
        message = F.when(salt == 0, message).otherwise(F.concat(message, F.lit("#"), salt.cast("string")))
    elif salt:
        message = F.concat(message, F.lit(f"#{salt}"))
    return F.concat(F.lit(PREFIX), cls, base32_head(hmac_hex(message, key), length))


def candidates(cls: Column, identity: Column, key: bytes, salts: int = SALTS) -> Column:
    """All codes that an identity may get, first choice first."""
    return F.transform(F.sequence(F.lit(0), F.lit(salts - 1)), lambda s: code(cls, identity, key, s))


def value_digest(cls: Column, value: Column, key: bytes) -> Column:
    """The 16 hex digits that stand for a value in a dictionary."""
    return F.substring(hmac_hex(F.concat(cls, F.lit(":"), value), key), 1, 16)


def combo_digest(parts: Column, key: bytes) -> Column:
    """Digest of two or three name parts whatever their order; null if they are fewer, more, or all alike."""
    sorted_parts = F.array_sort(parts)
    good = F.size(parts).between(2, 3) & (F.size(F.array_distinct(parts)) > 1)
    return F.when(good, value_digest(F.lit("P"), F.array_join(sorted_parts, "|"), key))


def is_code(text: Column) -> Column:
    """Whether the text is one code and nothing else, in any surface."""
    s = F.trim(F.coalesce(text, F.lit("")))
    return s.rlike(f"^(?:{COMPACT})$") | s.rlike(f"^(?:{FRAMED})$") | s.rlike(f"^(?:{BARE})$")


def canonical(text: Column) -> Column:
    """The surface under which a code is registered; null if the text is no code."""
    s = F.trim(F.coalesce(text, F.lit("")))
    compact, framed, bare = f"^(?:{COMPACT})$", f"^(?:{FRAMED})$", f"^(?:{BARE})$"
    part = lambda a, b: F.when(F.regexp_extract(s, framed, a) != "", F.regexp_extract(s, framed, a)).otherwise(F.regexp_extract(s, framed, b))
    frame = lambda c, d: F.concat(F.lit("[["), c, F.lit("-"), d, F.lit("]]"))
    return (
        F.when(s.rlike(compact), F.concat(F.lit(PREFIX), F.upper(F.substring(s, 2, 9))))
        .when(s.rlike(framed), frame(part(1, 3), part(2, 4)))
        .when(s.rlike(bare), frame(F.regexp_extract(s, bare, 1), F.regexp_extract(s, bare, 2)))
    )


def cut_truncated(text: Column) -> Column:
    """The text with a code broken off at its end replaced by an ellipsis."""
    return F.regexp_replace(text, TRUNCATED, "…")
