"""Restoring codes in streamed answers: frames put together, tails held until no code can grow from them."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from maskwright.functions import forms, scan

_SEP = re.escape(scan.SEPARATORS)
# Beginnings of codes in their surfaces and in damaged copies, and the longest of them.
_STARTS = tuple(re.compile(p, f) for p, f in (
    (r"z(?:[PTEDAIC][A-Z2-7]{0,8})?", re.I), (r"\[(?:\[(?:[PTEDAIC]-?[A-Z2-7]{0,12})?\]{0,2})?", 0), ("⟦(?:[PTEDAIC]-?[A-Z2-7]{0,12})?⟧?", 0),
    (r"\\[\\A-Za-z0-9-]{0,25}", 0), (r"[PTEDAIC]-?[A-Z2-7]{0,12}", 0), (rf"z(?:[{_SEP}]*{scan._SIGN}){{0,8}}[{_SEP}]*", re.I),
))
LONGEST, HOLD = 26, 128
_FRAME_END = re.compile(rb"\r\n\r\n|\n\n")


def frames(pending: bytes, chunk: bytes) -> tuple[list[bytes], bytes]:
    """Whole frames of the bytes so far, with their blank lines, and what is left over."""
    data, out, at = pending + chunk, [], 0
    for m in _FRAME_END.finditer(data):
        out.append(data[at : m.end()])
        at = m.end()
    return out, data[at:]


def growing(text: str) -> int:
    """Length of the longest tail that a continuation could turn into a code."""
    for n in range(min(len(text), LONGEST), 0, -1):
        if any(p.fullmatch(text[-n:]) for p in _STARTS):
            return n
    return 0


def settled(text: str) -> int:
    """How much of the text no continuation can change."""
    return len(text) - min(growing(text), HOLD)


class Guard:
    """Confirms that neighbouring names are of one client. mode: off, audit (told, but restored) or enforce (codes stay)."""

    def __init__(self, mode: str = "off", combos: frozenset[str] = frozenset(), key: bytes = b""):
        self.mode, self.combos, self.key = mode, combos, key

    def confirmed(self, parts: list[str]) -> bool:
        return forms.combo_digest([forms.identity_key(p) for p in parts], self.key) in self.combos

    def refused(self, text: str, found: list[tuple[scan.Span, str]]) -> set[int]:
        """Places in ``found`` (code span, stored value) of names whose pair, or whose run of three, no client has."""
        out: set[int] = set()
        run: list[int] = []
        for i in range(len(found) + 1):
            here = found[i][0] if i < len(found) else None
            if here is None or here[2] != "P" or not run or not beside(text, found[run[-1]][0][1], here[0]):
                for a, b in zip(run, run[1:], strict=False):
                    if not self.confirmed([found[a][1], found[b][1]]):
                        out |= {a, b}
                if len(run) == 3 and not self.confirmed([found[k][1] for k in run]):
                    out |= set(run)
                run = []
            if here is not None and here[2] == "P":
                run.append(i)
        return out


GAP = 2


def beside(text: str, end: int, start: int) -> bool:
    """At most GAP white-space characters part two codes."""
    return start - end <= GAP and not text[end:start].strip()


class Restorer:
    """Restores one answer fed in pieces; the pieces' restored texts add up to the whole's.

    State is the held tail, the character before it (so that a code glued to a letter stays
    as it is in a whole text) and how often each code has come. A piece is cut where no continuation can change what
    stands before: not within a code, nor behind one that may be glued to what follows, nor, under a guard, behind a name
    whose neighbour may still come.
    """

    def __init__(self, form: Callable[[str, int], str | None], held: str = "", left: str = "", seen: dict[str, int] | None = None, guard: Guard | None = None, value: Callable[[str], str] | None = None):
        self.form, self.held, self.left, self.seen = form, held, left, dict(seen or {})
        self.guard, self.value, self.incidents = guard or Guard(), value or (lambda code: form(code, 0) or ""), 0

    def feed(self, piece: str, last: bool = False) -> str:
        text = self.held + piece
        whole, before = self.left + text, len(self.left)
        codes = [s for s in scan.code_spans(whole) if s[0] >= before]
        cut = len(text) if last else self._cut(whole, settled(text) + before, codes) - before
        out, self.held = text[:cut], text[cut:]
        if not out:
            return ""
        self.left = out[-1]
        return self._restored(whole, before, before + cut, [s for s in codes if s[1] <= before + cut])

    def _cut(self, whole: str, cut: int, codes: list[scan.Span]) -> int:
        for s in reversed(codes):
            if s[0] < cut and (s[1] > cut or s[1] == len(whole)):
                cut = s[0]
        if self.guard.mode == "off":
            return cut
        for s in reversed([s for s in codes if s[1] <= cut]):
            if s[2] != "P" or whole[s[1] : cut].strip():
                break
            cut = s[0]
        return cut

    def _restored(self, whole: str, start: int, end: int, codes: list[scan.Span]) -> str:
        met = []
        for s in codes:
            n = self.seen.get(s[4], 0)
            self.seen[s[4]] = n + 1
            new = self.form(s[4], n)
            if new is not None:
                met.append((s, new))
        kept: set[int] = set()
        if self.guard.mode != "off":
            refused = self.guard.refused(whole, [(s, self.value(s[4])) for s, _ in met])
            self.incidents += len(refused)
            kept = refused if self.guard.mode == "enforce" else kept
        put = [(s, new) for i, (s, new) in enumerate(met) if i not in kept]
        return scan.splice(whole[start:end], [(s[0] - start, s[1] - start) for s, _ in put], [new for _, new in put])


def restored_whole(text: str, form: Callable[[str, int], str | None], guard: Guard | None = None, value: Callable[[str], str] | None = None) -> str:
    return Restorer(form, guard=guard, value=value).feed(text, last=True)


#: Digests of combinations that may be sent to every task of a stream.
COMBOS_SENT = 2_000_000


def sent_guard(mode: str, combos: DataFrame | None, key: bytes) -> Guard:
    """A guard for a stream's tasks. The index goes with them, so its size is checked."""
    if mode == "off" or combos is None:
        return Guard()
    rows = combos.select("digest").distinct().limit(COMBOS_SENT + 1).toArrow()["digest"].to_pylist()
    if len(rows) > COMBOS_SENT:
        raise ValueError(f"more than {COMBOS_SENT} combinations: restore in batches")
    return Guard(mode, frozenset(rows), key)


SESSION = "map<string,struct<forms:array<string>,value:string>>"


def with_allowed(stream: DataFrame, allowed: DataFrame) -> DataFrame:
    """``stream`` with codes: what each session's allowed codes may become, by a stream-static join on session_id.

    ``allowed`` (session_id, token, forms, value) is fixed before the stream starts; a code listed for one session says nothing to another.
    """
    each = allowed.groupBy("session_id", "token").agg(F.struct(F.first("forms").alias("forms"), F.first("value").alias("value")).alias("x"))
    per = each.groupBy("session_id").agg(F.map_from_entries(F.collect_list(F.struct("token", "x"))).alias("codes"))
    return stream.join(per, "session_id", "left")


class Codes:
    """The codes of one session."""

    def __init__(self, codes: dict | list | None):
        self.codes = dict(codes) if isinstance(codes, dict | list) else {}

    def form(self, code: str, n: int) -> str | None:
        have = self.codes.get(code)
        forms_ = () if have is None or have["forms"] is None else have["forms"]
        return forms_[min(n, len(forms_) - 1)] if len(forms_) else None

    def value(self, code: str) -> str:
        have = self.codes.get(code)
        return "" if have is None else have["value"] or ""


class RelayProcessor(StatefulProcessor):
    """Per session: pieces in order of seq in, restored pieces out; done flushes what is held and forgets the session."""

    def __init__(self, guard: Guard):
        self.guard = guard

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("tail", "held string, left string, seen map<string,int>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pieces = pd.concat(list(rows)).sort_values("seq")
        old = self.state.get() if self.state.exists() else None
        codes = Codes(pieces["codes"].iloc[0])
        r = Restorer(codes.form, *(old if old else ("", "", {})), guard=self.guard, value=codes.value)
        out = []
        for x in pieces.itertuples():
            before = r.incidents
            text = r.feed(x.delta or "", bool(x.done))
            out.append((key[0], int(x.seq), text, "done" if x.done else "open", r.incidents - before))
        if bool(pieces["done"].iloc[-1]):
            self.state.clear()
        else:
            self.state.update((r.held, r.left, r.seen))
        yield pd.DataFrame(out, columns=["session_id", "seq", "restored", "status", "incidents"])

    def close(self) -> None:
        pass


def relay(pieces: DataFrame, allowed: DataFrame, guard: str = "off", combos: DataFrame | None = None, key: bytes = b"") -> DataFrame:
    """(session_id, seq, restored, status, incidents) of a stream (session_id, seq, delta, done).

    ``allowed`` (session_id, token, forms, value) are the codes that each session may see; ``combos`` (digest) is the guard's index. Needs the RocksDB state store.
    """
    told = with_allowed(pieces, allowed).select("session_id", "seq", "delta", "done", "codes")
    return told.groupBy("session_id").transformWithStateInPandas(
        statefulProcessor=RelayProcessor(sent_guard(guard, combos, key)), outputStructType="session_id string, seq int, restored string, status string, incidents int", outputMode="Append", timeMode="None"
    )
