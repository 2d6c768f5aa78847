"""Settings of a deployment, checked before anything runs: what is wrong stops it."""

from __future__ import annotations

import json
import os
import re
import stat
from collections.abc import Mapping
from dataclasses import dataclass

from maskwright.operators.policy import BLOCKED


class SettingsError(ValueError):
    """A setting that must not be run with."""


@dataclass(frozen=True)
class TrustedClient:
    channel: str
    header_value: str | None = None
    key_sha256: str | None = None
    patterns: tuple[str, ...] = ()


def trusted_clients(raw: object) -> list[TrustedClient]:
    """Clients from JSON, records, or ``channel=method:value`` pieces between semicolons (methods header, key, ua).

    A channel that is never restored can't be trusted, and one key can't name two channels.
    """
    if raw is None or isinstance(raw, str) and not raw.strip():
        return []
    if isinstance(raw, str) and raw.strip()[0] in "[{":
        try:
            raw = json.loads(raw)
        except ValueError as e:
            raise SettingsError(f"trusted clients don't parse: {e}") from e
    if isinstance(raw, str):
        out = []
        for piece in filter(None, map(str.strip, raw.split(";"))):
            m = re.fullmatch(r"([^=]+)=\s*(header|key|ua)\s*:(.+)", piece)
            if not m:
                raise SettingsError(f"{piece!r} should be channel=method:value")
            out.append({"channel": m[1].strip(), {"header": "header_value", "key": "key_fingerprint", "ua": "user_agent_patterns"}[m[2]]: m[3].strip()})
        raw = out
    records = []
    for r in [raw] if isinstance(raw, Mapping) else raw:
        channel = str(r.get("channel") or "").strip().lower()
        patterns = r.get("user_agent_patterns") or ()
        key = str(r.get("key_fingerprint") or "").strip().lower() or None
        if not channel or channel in BLOCKED:
            raise SettingsError(f"channel {channel!r} can't be trusted")
        if key and not re.fullmatch(r"(sha256:)?[0-9a-f]{32,}", key):
            raise SettingsError("a key is given by its fingerprint, at least 32 hex digits")
        c = TrustedClient(channel, str(r["header_value"]).strip().lower() if r.get("header_value") else None, key and "sha256:" + key.removeprefix("sha256:"), (patterns,) if isinstance(patterns, str) else tuple(patterns))
        if any(key and o.key_sha256 == c.key_sha256 and o.channel != channel for o in records):
            raise SettingsError("one key names two channels")
        if c not in records:
            records.append(c)
    return records


def key_file(path: str, least: int = 32) -> bytes:
    """A key of at least ``least`` bytes from a file that only its owner reads."""
    if stat.S_IMODE(os.stat(path).st_mode) & 0o077:
        raise SettingsError(f"{path} is readable by others")
    with open(path, "rb") as f:
        key = f.read().strip()
    if len(key) < least:
        raise SettingsError(f"{path} is shorter than {least} bytes")
    return key


@dataclass(frozen=True)
class Settings:
    token_key: bytes
    dictionary_key: bytes
    encryption_key: bytes
    allowed_channels: tuple[str, ...] = ()
    unknown_client: str = "keep_codes"
    guard: str = "audit"
    k: int = 5
    ttl_days: int = 90

    def __post_init__(self):
        if len({self.token_key, self.dictionary_key, self.encryption_key}) < 3:
            raise SettingsError("the three keys must differ")
        if min(map(len, (self.token_key, self.dictionary_key, self.encryption_key))) < 32:
            raise SettingsError("keys have at least 32 bytes")
        if self.unknown_client not in ("keep_codes", "restore") or self.guard not in ("off", "audit", "enforce"):
            raise SettingsError("unknown mode")
        if set(map(str.lower, self.allowed_channels)) & set(BLOCKED):
            raise SettingsError("a channel that is never restored is allowed")


def flag(text: str) -> bool:
    """A boolean of a settings file, with a comment after it or not."""
    word = text.split("#")[0].strip().lower()
    if word in ("1", "true", "yes", "on"):
        return True
    if word in ("0", "false", "no", "off", ""):
        return False
    raise SettingsError(f"{text!r} is no yes or no")
