"""The functions of ``scan`` as columns: Arrow batches in, Arrow arrays out. Null texts count as empty."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import scan
from .spans import SPAN

_FIELDS = (("start", pa.int32()), ("end", pa.int32()), ("cls", pa.string()), ("raw", pa.string()), ("norm", pa.string()), ("suffix", pa.string()), ("src", pa.int32()), ("ord", pa.int32()))


def _texts(column: pa.Array):
    """The texts of an array, one at a time."""
    return (t or "" for t in column.to_pylist())


def span_array(found: list[list[scan.Span]]) -> pa.Array:
    flat = [s for f in found for s in f]
    columns = list(zip(*flat, strict=True)) or [()] * len(_FIELDS)
    offsets = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
    values = pa.StructArray.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, _FIELDS, strict=True)], [n for n, _ in _FIELDS])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def of_text(find: Callable[[str], list[scan.Span]]) -> Callable[[Column], Column]:
    """A detector over a text as a function of a column, giving an array of spans."""

    def run(text: pa.Array) -> pa.Array:
        return span_array([find(t) for t in _texts(text)])

    run.__annotations__ = {"text": pa.Array, "return": pa.Array}
    return lambda text: F.arrow_udf(run, f"array<{SPAN}>")(text)


def merged(*groups: Column) -> Column:
    """Arrays of spans as one, merged."""

    def run(spans: pa.Array) -> pa.Array:
        return span_array([scan.merge(tuple(s[n] for n, _ in _FIELDS) for s in x.as_py() or ()) for x in spans])

    run.__annotations__ = {"spans": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, f"array<{SPAN}>")(F.concat(*groups))


def spliced(text: Column, spans: Column, put: Column) -> Column:
    """The text with each span (struct with start and end) replaced by the entry of ``put`` in its place."""

    def run(text: pa.Array, spans: pa.Array, put: pa.Array) -> pa.Array:
        rows = zip(text, spans, put, strict=True)
        return pa.array([None if t.as_py() is None else scan.splice(t.as_py(), [(x["start"], x["end"]) for x in s.as_py() or ()], p.as_py() or []) for t, s, p in rows], pa.string())

    run.__annotations__ = {"text": pa.Array, "spans": pa.Array, "put": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "string")(text, spans, put)


def replaced_left(text: Column, values: Column, put: Column) -> Column:
    """What is left of the values in the text, in any case and spacing, replaced by the entries of ``put``; longest values first."""

    def run(text: pa.Array, values: pa.Array, put: pa.Array) -> pa.Array:
        rows = zip(text, values, put, strict=True)
        return pa.array([None if t.as_py() is None else scan.replace_left(t.as_py(), v.as_py() or [], p.as_py() or []) for t, v, p in rows], pa.string())

    run.__annotations__ = {"text": pa.Array, "values": pa.Array, "put": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "string")(text, values, put)


def free(spans: Column, taken: Column) -> Column:
    """The spans that touch none of ``taken``, nor hold a code's frame."""

    def run(spans: pa.Array, taken: pa.Array) -> pa.Array:
        out = []
        for s, t in zip(spans, taken, strict=True):
            known = [(x["start"], x["end"]) for x in t.as_py() or ()]
            found = [x for x in s.as_py() or () if not any(x["start"] < b and a < x["end"] for a, b in known) and not any(f in x["raw"] for f in ("⟦", "⟧", "[["))]
            out.append([tuple(x[n] for n, _ in _FIELDS) for x in found])
        return span_array(out)

    run.__annotations__ = {"spans": pa.Array, "taken": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, f"array<{SPAN}>")(spans, taken)


def survivors(original: Column, spans: Column, outgoing: Column) -> Column:
    """Places (from 0) of the spans that can still be read in the outgoing text, but for those inside links."""

    def run(original: pa.Array, spans: pa.Array, outgoing: pa.Array) -> pa.Array:
        rows = zip(_texts(original), spans, _texts(outgoing), strict=True)
        return pa.array([scan.survivors(o, [(s["start"], s["end"], s["raw"]) for s in x.as_py() or ()], t) for o, x, t in rows], pa.list_(pa.int32()))

    run.__annotations__ = {"original": pa.Array, "spans": pa.Array, "outgoing": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "array<int>")(original, spans, outgoing)


_FINISHED = pa.struct([("text", pa.string()), ("left", pa.list_(pa.int32()))])


def _finish(original: str, spans: list[dict], put: list[str], text: str, passes: int) -> tuple[str, list[int]]:
    """Replace what the gate finds of the spans, up to ``passes`` times; the text, and the places of spans still read in it."""
    asked = [(s["start"], s["end"], s["raw"]) for s in spans]
    left = scan.survivors(original, asked, text)
    for _ in range(passes):
        if not left:
            break
        text = scan.replace_left(text, [asked[i][2] for i in left], [put[i] for i in left])
        left = scan.survivors(original, asked, text)
    return text, left


def finished(original: Column, spans: Column, put: Column, outgoing: Column | None = None, passes: int = 3) -> Column:
    """struct(text, left): ``outgoing`` with what the gate still finds of the spans replaced by ``put``, and the places (from 0) of
    spans that resist. Without ``outgoing`` the spans of the original are replaced first, and then what is left of their values elsewhere."""

    def run(original: pa.Array, spans: pa.Array, put: pa.Array, outgoing: pa.Array) -> pa.Array:
        out = []
        for o, s, p, t in zip(original, spans, put, outgoing, strict=True):
            text, found, new = o.as_py(), s.as_py() or [], p.as_py() or []
            if text is None:
                out.append({"text": None, "left": []})
                continue
            done = t.as_py()
            if done is None:
                done = scan.replace_left(scan.splice(text, [(x["start"], x["end"]) for x in found], new), [x["raw"] for x in found], new)
            done, left = _finish(text, found, new, done, passes)
            out.append({"text": done, "left": left})
        return pa.array(out, _FINISHED)

    run.__annotations__ = {"original": pa.Array, "spans": pa.Array, "put": pa.Array, "outgoing": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "struct<text:string,left:array<int>>")(original, spans, put, F.lit(None).cast("string") if outgoing is None else outgoing)


def spellings(latin: Column) -> Column:
    """Cyrillic spellings that a Latin name may have."""

    def run(latin: pa.Array) -> pa.Array:
        return pa.array([scan.spellings(t) for t in _texts(latin)], pa.list_(pa.string()))

    run.__annotations__ = {"latin": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "array<string>")(latin)


_ASK = "array<struct<start:int,end:int,kind:string,raw:string,norm:string,key:string,single:boolean,capital:boolean,context:boolean,latin:boolean,src:int,ord:int>>"
_ASK_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("raw", pa.string()), ("norm", pa.string()), ("key", pa.string()), ("single", pa.bool_()), ("capital", pa.bool_()), ("context", pa.bool_()), ("latin", pa.bool_()), ("src", pa.int32()), ("ord", pa.int32())]))


def scanned(text: Column, words: scan.Vocabulary = scan.NO_WORDS) -> Column:
    """struct(found, asks): what the text alone tells, and what tables must be asked of.

    found: rules and table cells. asks: numbers, persons of table cells, name candidates, names by shape and capitals, with what decides
    on them in their text. Candidates that no table could admit are left out here: a word of the trade, one that a letter touches,
    one behind an address marker, and a word in lower case outside a client's context.
    """
    from .forms import identity_key

    def one(t: str) -> tuple[list[scan.Span], list[dict]]:
        shapes = [s for s in scan.name_shapes(t, words) if not scan.in_address(t, s[0])]
        table = scan.tabular(t)
        found = [s for s in [*(s for s in table if s[2] != "P"), *scan.every_rule(t)] if not words.constant(s)]
        asks = []
        for kind, spans in (("cell", [s for s in table if s[2] == "P"]), ("number", scan.number_runs(t)), ("name", scan.name_candidates(t)), ("shape", shapes), ("caps", scan.capital_shapes(t, words))):
            for a, b, _, raw, norm, _, src, i in spans:
                capital, context = raw[:1].isupper(), kind == "name" and scan.in_client_context(t, a, b)
                if kind == "name" and (words.owns(raw) or not (capital or context) or not scan.boundary_ok(t, a, b)) or kind in ("name", "caps") and scan.in_address(t, a):
                    continue
                key = identity_key(raw) if kind != "number" else raw
                asks.append({"start": a, "end": b, "kind": kind, "raw": raw, "norm": norm, "key": key, "single": len(raw.split()) == 1, "capital": capital, "context": context, "latin": raw.isascii(), "src": src, "ord": i})
        return found, asks

    def run(text: pa.Array) -> pa.Array:
        rows = [one(t) for t in _texts(text)]
        return pa.StructArray.from_arrays([span_array([r[0] for r in rows]), pa.array([r[1] for r in rows], _ASK_TYPE)], ["found", "asks"])

    run.__annotations__ = {"text": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, f"struct<found:array<{SPAN}>,asks:{_ASK}>")(text)
