"""Whole streamed answers: bytes in, frames out, with texts restored, tool arguments gathered, and every end told."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .relay import Codes, Guard, Restorer, frames, restored_whole, sent_guard, with_allowed

DONE = b"data: [DONE]\n\n"
BROKEN = b'data: {"error":{"code":"stream_broken"}}\n\n'


def frame(event: dict) -> bytes:
    return b"data: " + json.dumps(event, ensure_ascii=False).encode() + b"\n\n"


class Answer:
    """One streamed answer. Contents and reasoning share a buffer; arguments of tools are held back
    by index and sent whole, restored, before a finishing frame, the end mark, or the end of the stream."""

    def __init__(self, form: Callable[[str, int], str | None], state: dict | None = None, guard: Guard | None = None, value: Callable[[str], str] | None = None):
        s = state or {}
        self.form, self.pending, self.ended = form, bytes.fromhex(s.get("pending", "")), s.get("ended", False)
        self.text = Restorer(form, s.get("held", ""), s.get("left", ""), s.get("seen"), guard, value)
        self.args: dict[int, str] = {int(k): v for k, v in s.get("args", {}).items()}
        self.names: dict[int, str] = {int(k): v for k, v in s.get("names", {}).items()}

    def state(self) -> dict:
        return {"pending": self.pending.hex(), "held": self.text.held, "left": self.text.left, "seen": self.text.seen, "args": self.args, "names": self.names, "ended": self.ended}

    def feed(self, chunk: bytes, last: bool = False) -> list[bytes]:
        found, self.pending = frames(self.pending, chunk)
        if last and self.pending:
            found, self.pending = [*found, self.pending], b""
        out: list[bytes] = []
        for f in found:
            if self.ended:
                break
            try:
                out += self._frame(f)
            except ValueError:
                out += [BROKEN, DONE]
                self.ended = True
        if last and not self.ended:
            out += self._close()
        return out

    def _frame(self, raw: bytes) -> list[bytes]:
        text = raw.decode("utf-8", "replace").strip()
        if not text.startswith("data:"):
            return [raw]
        body = text[5:].strip()
        if body == "[DONE]":
            self.ended = True
            return [*self._close(), DONE]
        event = json.loads(body)
        if not isinstance(event, dict):
            raise ValueError("an event is an object")
        finishing = False
        for choice in event.get("choices") or []:
            delta = choice.get("delta") or choice.get("message") or {}
            for part in ("content", "reasoning_content"):
                if isinstance(delta.get(part), str) and delta[part]:
                    delta[part] = self.text.feed(delta[part])
            for call in delta.get("tool_calls") or []:
                function, i = call.get("function") or {}, call.get("index")
                i = i if isinstance(i, int) else 0
                if function.get("name"):
                    self.names[i] = function["name"]
                if isinstance(function.get("arguments"), str):
                    self.args[i] = self.args.get(i, "") + function["arguments"]
                    function["arguments"] = ""
            finishing |= bool(choice.get("finish_reason"))
        return [*(self._tools() if finishing else []), frame(event)]

    def _tools(self) -> list[bytes]:
        out = []
        for i in sorted(k for k, v in self.args.items() if v):
            call = {"index": i, "type": "function", "function": {"name": self.names.get(i, ""), "arguments": restored_whole(self.args[i], self.form)}}
            out.append(frame({"choices": [{"index": 0, "delta": {"tool_calls": [call]}}]}))
        self.args.clear()
        self.names.clear()
        return out

    def _close(self) -> list[bytes]:
        tail = self.text.feed("", last=True)
        return [*self._tools(), *([frame({"choices": [{"index": 0, "delta": {"role": "assistant", "content": tail}}]})] if tail else [])]


class AnswerProcessor(StatefulProcessor):
    """Per session: chunks in order of seq in, frames out; the last chunk forgets the session."""

    def __init__(self, guard: Guard):
        self.guard = guard

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("answer", "state string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        chunks = pd.concat(list(rows)).sort_values("seq")
        codes = Codes(chunks["codes"].iloc[0])
        a = Answer(codes.form, json.loads(self.kept.get()[0]) if self.kept.exists() else None, self.guard, codes.value)
        out = [(key[0], int(x.seq), i, f) for x in chunks.itertuples() for i, f in enumerate(a.feed(bytes(x.chunk or b""), bool(x.last)))]
        if bool(chunks["last"].iloc[-1]):
            self.kept.clear()
        else:
            self.kept.update((json.dumps(a.state()),))
        yield pd.DataFrame(out, columns=["session_id", "seq", "ord", "frame"])

    def close(self) -> None:
        pass


def relay(chunks: DataFrame, allowed: DataFrame, guard: str = "off", combos: DataFrame | None = None, key: bytes = b"") -> DataFrame:
    """(session_id, seq, ord, frame) of a stream of chunks (session_id, seq, chunk: binary, last), each session with its own
    ``allowed`` codes (session_id, token, forms, value). Needs the RocksDB state store."""
    told = with_allowed(chunks, allowed).select("session_id", "seq", "chunk", "last", "codes")
    return told.groupBy("session_id").transformWithStateInPandas(
        statefulProcessor=AnswerProcessor(sent_guard(guard, combos, key)), outputStructType="session_id string, seq int, ord int, frame binary", outputMode="Append", timeMode="None"
    )


def weekly(events: DataFrame, late: str = "7 days", by: tuple[str, ...] = ("class", "action")) -> DataFrame:
    """Incident counts by ISO week (windows start on Mondays) of a stream with a column ts: a week is closed
    once no event later than ``late`` can still come, so state is bounded by the weeks that are open."""
    week: Column = F.window("ts", "7 days", "7 days", "4 days")
    return events.withWatermark("ts", late).groupBy(week.alias("week"), *by).agg(F.count(F.lit(1)).alias("events"), F.sum("findings").alias("findings"))
