"""Canonical forms and check digits of single values in plain Python, for functions that work a text at a time.

Each equals the Column expression of its name in ``normalize``, ``checks`` or ``codes`` (tests compare them).
"""

from __future__ import annotations

import base64
import hashlib
import hmac
import re

from . import checks, codes

_NOT_DIGIT = re.compile("[^0-9]")
_POINTS = str.maketrans(".,", "  ")
_FOLD = str.maketrans("ёЁ\u00a0", "еЕ ")
_EDGES = "\"'«»()[].,;:!?"
_EMAIL = re.compile(r"[^@\s]+@[^@\s]+\.[A-Za-z]{2,}")
_ISO, _DOTTED = re.compile(r"([0-9]{4})-([0-9]{2})-([0-9]{2})"), re.compile(r"([0-9]{1,2})[.\-/]([0-9]{1,2})[.\-/]([0-9]{2,4})")


def digits(value: str) -> str:
    return _NOT_DIGIT.sub("", value)


def phone(value: str) -> str | None:
    d = digits(value)
    d = "7" + d if len(d) == 10 else "7" + d[1:] if len(d) == 11 and d[0] == "8" else d
    return d if len(d) == 11 and d[0] == "7" else None


def _plain(value: str, least: int) -> str | None:
    s = " ".join(value.translate(_POINTS).split()).lower()
    return s if len(s) >= least else None


def name(value: str) -> str | None:
    return _plain(value, 2)


def address(value: str) -> str | None:
    return _plain(value, 3)


def email(value: str) -> str | None:
    s = value.strip().lower()
    return s if _EMAIL.fullmatch(s) else None


def document(value: str) -> str | None:
    d = digits(value)
    return d if len(d) >= 5 else None


def client_id(value: str) -> str | None:
    d = digits(value)
    return (d.lstrip("0") or "0") if d else None


OF_CLASS = {"P": name, "T": phone, "E": email, "A": address, "I": document, "C": client_id}


def normalize(cls: str, value: str) -> str | None:
    form = OF_CLASS.get(cls)
    return form(value) if form else None


def split_birth_date(value: str) -> tuple[str, str] | None:
    s = value.strip()
    m = _ISO.fullmatch(s)
    day, month, year = (m[3], m[2], m[1]) if m else (None, None, None)
    if not m:
        m = _DOTTED.fullmatch(s)
        if not m:
            return None
        day, month, year = m.groups()
    if not (1 <= int(day) <= 31 and 1 <= int(month) <= 12):
        return None
    year = ("19" if int(year) > 30 else "20") + year if len(year) == 2 else year
    return f"{day:0>2}.{month:0>2}", year


def identity_key(value: str) -> str:
    return " ".join(value.translate(_FOLD).strip(_EDGES + " \t\r\n\f\v").split()).lower()


def _weighted(d: str, weights: tuple[int, ...]) -> int:
    return sum(int(c) * w for c, w in zip(d, weights, strict=False))


def snils_ok(value: str) -> bool:
    d = digits(value)
    return len(d) == 11 and _weighted(d, checks.SNILS_WEIGHTS) % 101 % 100 == int(d[9:])


def inn_ok(value: str) -> bool:
    d = digits(value)
    if len(d) == 10:
        return _weighted(d, checks.INN10_WEIGHTS) % 11 % 10 == int(d[9])
    return inn12_ok(d)


def inn12_ok(value: str) -> bool:
    d = digits(value)
    return len(d) == 12 and all(_weighted(d, w) % 11 % 10 == int(d[10 + i]) for i, w in enumerate(checks.INN12_WEIGHTS))


def ogrn_ok(value: str) -> bool:
    d = digits(value)
    return len(d) == 13 and int(d[:12]) % 11 % 10 == int(d[12])


def ogrnip_ok(value: str) -> bool:
    d = digits(value)
    return len(d) == 15 and int(d[:14]) % 13 % 10 == int(d[14])


def is_epoch(value: str) -> bool:
    d = digits(value)
    low, high = checks.EPOCH_SECONDS if len(d) == 10 else checks.EPOCH_MILLIS
    return len(d) in (10, 12) and low <= int(d) <= high


def code(cls: str, identity: str, key: bytes, salt: int = 0) -> str:
    message = f"{cls}:{identity}#{salt}" if salt else f"{cls}:{identity}"
    return codes.PREFIX + cls + base64.b32encode(hmac.digest(key, message.encode(), "sha256")).decode()[: codes.LENGTH]


def value_digest(cls: str, value: str, key: bytes) -> str:
    return hmac.new(key, f"{cls}:{value}".encode(), hashlib.sha256).hexdigest()[:16]


def combo_digest(parts: list[str], key: bytes) -> str | None:
    return value_digest("P", "|".join(sorted(parts)), key) if 2 <= len(parts) <= 3 and len(set(parts)) > 1 else None
