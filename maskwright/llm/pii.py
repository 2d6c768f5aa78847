"""Personal data by weak supervision: labelers vote, EM weighs them, a span classifier decides.

Four fixed patterns give the base spans, which always stand. Looser patterns propose
further candidates. Regex, gazetteer, context, checksum and neighbourhood labelers
vote on every candidate (base spans too); expectation-maximisation on the counts of
vote patterns over the whole corpus estimates each labeler's reliability without any
label. A logistic span classifier is then trained on the resulting posteriors: it sees
not only the votes but the span itself (length, digits, separators, its shape) and the
words around it, hashed, so it tells apart what the labelers can't. It adds those
proposals that it is sure of.
"""

from __future__ import annotations

import hashlib
import re
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

# Kinds in order, patterns, and the lists of the gazetteer and context labelers.
KINDS = ("email", "ip", "card", "phone", "name")
BASE = KINDS[:4]
_MAIL_REST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_ANY_DIGIT = re.compile(r"[0-9]")
_HIDDEN_MAIL = re.compile(r"[A-Za-z0-9._%+-]{1,64}\x20?(?:\[at\]|\(at\))\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:\[dot\]|\(dot\)|\.)\x20?[A-Za-z0-9-]{1,63}){1,4}")
_NUMBER = re.compile(r"(?<![\w+.,-])\(?[0-9](?:[\x20./()-]{0,2}[0-9]){6,18}(?![\w])")
_TITLE = re.compile(r"(?:\b(?:Mr|Mrs|Ms|Dr|Prof)\.\x20|\b[Mm]y name is\x20|\bDear\x20)((?:[A-Z][\w'-]+)(?:\x20[A-Z][\w'-]+){0,2})")
_TITLE_PARTS = ("Mr. ", "Mrs. ", "Ms. ", "Dr. ", "Prof. ", "y name is ", "Dear ")
_PHONE_SHAPE = re.compile(r"\(?[0-9]{3}\)?[\x20.-]{1,2}[0-9]{3}[\x20.-][0-9]{4}|0[0-9]{1,4}[\x20/-][0-9]{5,8}|00[0-9]{2}[\x20-][0-9\x20-]{7,}")
_CARD_SHAPE = re.compile(r"[0-9]{4}([\x20-]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}")
_DATE_SHAPE = re.compile(r"[0-9]{4}[-./][0-9]{1,2}[-./][0-9]{1,2}|[0-9]{1,2}[-./][0-9]{1,2}[-./][0-9]{2,4}")
_PHONE_WORDS = re.compile(r"\b(?:phone|tel|telephone|telefon|téléphone|teléfono|mobile|mobil|móvil|cell|fax|call|handy)\b[^\n]{0,12}$", re.I)
_CARD_WORDS = re.compile(r"\b(?:card|visa|mastercard|amex|credit|debit|karte|carte|tarjeta)\b[^\n]{0,16}$", re.I)
_MAIL_WORDS = re.compile(r"\b(?:e-?mail|mail|contact|write)\b[^\n]{0,16}$", re.I)
_OTHER_WORDS = re.compile(r"\b(?:isbn|issn|order|invoice|version|ref|id|no|nr|token|key|serial|build|rfc|page)\b[^\n]{0,8}$", re.I)
_ISSUERS = ("34", "37", "4", "51", "52", "53", "54", "55", "6011", "65")
_DOMAINS = frozenset("com org net edu gov info io de fr es it uk eu at ch nl be ca us".split())
_GIVEN = frozenset("Anna Anne Maria Marie Julia Laura Sophie Emma Clara Lucia Carmen Elena Sarah Emily Jane Mary Linda Susan John James Robert Michael William David Thomas Peter Paul Mark Daniel Martin Hans Klaus Jürgen Karl Pierre Jean Louis Michel Carlos José Juan Luis Miguel Pedro".split())

#: Votes of a candidate, in this order; each is 1 (personal), -1 (not) or 0 (no opinion).
LABELERS = ("regex", "gazetteer", "context", "checksum", "neighbours")
#: The classifier adds a candidate from this probability on.
SURE = 0.9


def mails(text: str) -> list[tuple[int, int]]:
    """Leftmost, non-overlapping e-mail addresses, found from each @ outwards so that long runs cost linear time."""
    out, end = [], 0
    if "@" not in text:
        return out
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _MAIL_REST.match(text, at) if start < at else None
        if m:
            out.append((start, m.end()))
            end = m.end()
        at = text.find("@", max(end, at + 1))
    return out


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the four base kinds, in order."""
    out = [(a, 0, b) for a, b in mails(text)]
    if _ANY_DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            d = _digits(m.group())
            if 12 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_digits(m.group())) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def proposals(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Further candidates, none of which touches a base span or another candidate."""
    out = []
    if "[at]" in text or "(at)" in text:
        out += [(m.start(), 0, m.end()) for m in _HIDDEN_MAIL.finditer(text)]
    if _ANY_DIGIT.search(text):
        for m in _NUMBER.finditer(text):
            out.append((m.start(), 2 if len(_digits(m.group())) >= 13 else 3, m.end()))
    if any(p in text for p in _TITLE_PARTS):
        out += [(m.start(1), 4, m.end(1)) for m in _TITLE.finditer(text)]
    taken, free = sorted((a, b) for a, _, b in base), []
    i, last = 0, 0
    for a, k, b in sorted(out):
        while i < len(taken) and taken[i][1] <= a:
            i += 1
        if a >= last and not (i < len(taken) and taken[i][0] < b):
            free.append((a, k, b))
            last = b
    return free


def votes(text: str, start: int, kind: int, end: int, given: frozenset[str] = _GIVEN, domains: frozenset[str] = _DOMAINS) -> tuple[int, ...]:
    """What each labeler says of one candidate; ``given`` and ``domains`` are the gazetteers."""
    s, before, after = text[start:end], text[max(0, start - 40) : start], text[end : end + 1]
    d = _digits(s)
    context = -1 if _OTHER_WORDS.search(before) else 0
    if kind == 0:
        shape, known, check = 1, 1 if re.split(r"[^A-Za-z0-9]+", s.lower().rstrip(")]"))[-1] in domains else -1, 0
        context = 1 if _MAIL_WORDS.search(before) else context
    elif kind == 1:
        shape, known, check = 1, 0, 1
    elif kind == 2:
        shape, known, check = 1 if _CARD_SHAPE.fullmatch(s) else -1, 1 if d.startswith(_ISSUERS) else -1, 1 if luhn(d) else -1
        context = 1 if _CARD_WORDS.search(before) else context
    elif kind == 3:
        shape = 1 if s[0] == "+" or _PHONE_SHAPE.fullmatch(s) else -1
        known = 1 if s[0] == "+" or d.startswith("00") else 0
        check = 1 if 9 <= len(d) <= 13 and not _DATE_SHAPE.match(s) else -1
        context = 1 if _PHONE_WORDS.search(before) else context
    else:
        parts = s.split()
        shape, known, check = 1 if len(parts) >= 2 else -1, 1 if parts[0] in given else -1, 0
        context = 1
    near = -1 if after.isalnum() or before[-1:].isalnum() or after in ('"', "_", "=") and after else 1
    return shape, known, context, check, near


def aggregate(patterns: dict[tuple, int], steps: int = 60) -> tuple[dict[tuple, float], np.ndarray, np.ndarray]:
    """EM on counts of (kind, votes...): posterior of each pattern, and each labeler's reliability.

    The two classes start at the majority vote. Given the class, labelers are independent;
    a labeler is right at least slightly more often than wrong, which tells the classes apart.
    """
    keys = sorted(patterns)
    if not keys:
        return {}, np.full(len(LABELERS), 0.7), np.full(len(LABELERS), 0.7)
    v = np.array([k[1:] for k in keys])
    n = np.array([patterns[k] for k in keys], float)
    never = np.array([k[0] == 2 and k[1 + LABELERS.index("checksum")] == -1 for k in keys])  # no card fails its checksum
    p = np.where(never, 0, 1 / (1 + np.exp(-1.5 * v.sum(1))))
    yes = no = np.full(v.shape[1], 0.7)
    for _ in range(steps):
        right, wrong = (n * p) @ (v == 1) + 7, (n * p) @ (v == -1) + 3
        yes = np.clip(right / (right + wrong), 0.55, 0.995)
        right, wrong = (n * (1 - p)) @ (v == -1) + 7, (n * (1 - p)) @ (v == 1) + 3
        no = np.clip(right / (right + wrong), 0.55, 0.995)
        prior = np.clip((n @ p + 1) / (n.sum() + 2), 0.05, 0.95)
        z = np.log(prior / (1 - prior)) + ((v == 1) * np.log(yes / (1 - no)) + (v == -1) * np.log((1 - yes) / no)).sum(1)
        p = np.where(never, 0, 1 / (1 + np.exp(-z)))
    return dict(zip(keys, p.tolist(), strict=True)), yes, no


#: Buckets of the word before a candidate, of the word after it, and of its shape, in the classifier's inputs.
BEFORE, AFTER, SHAPES = 64, 32, 32
_DENSE = 1 + len(KINDS) + 2 * len(LABELERS) + 6
WIDTH = _DENSE + BEFORE + AFTER + SHAPES
_WORD_BEFORE = re.compile(r"([^\W\d_]+)[^\w]{0,6}$")
_WORD_AFTER = re.compile(r"[^\w]{0,6}([^\W\d_]+)")
_SHAPE = str.maketrans({**{chr(c): "9" for c in range(48, 58)}, **{chr(c): "a" for c in range(97, 123)}, **{chr(c): "A" for c in range(65, 91)}})
_RUNS = re.compile(r"(.)\1+")


def inputs(text: str, start: int, kind: int, end: int, vote: tuple[int, ...]) -> tuple[list[float], list[int]]:
    """What the classifier sees of a candidate: dense values (votes, kind, measures of the span) and the
    places of three that are one: the word before it, the word after it, and its shape with runs shortened."""
    s = text[start:end]
    digits = sum("0" <= c <= "9" for c in s)
    parts = len(re.split(r"[\x20./()@-]+", s))
    before, after = _WORD_BEFORE.search(text[max(0, start - 24) : start]), _WORD_AFTER.match(text[end : end + 24])
    dense = [
        1.0, *(float(kind == k) for k in range(len(KINDS))), *(float(x == 1) for x in vote), *(float(x == -1) for x in vote),
        min(len(s), 64) / 32, digits / max(1, len(s)), min(digits, 20) / 10, min(parts, 8) / 4, len(set(s)) / max(1, len(s)), float(s[:1] in "0+("),
    ]
    bucket = lambda m, n: 0 if m is None else 1 + crc32(m[1].lower().encode("utf-8", "replace")) % (n - 1)
    shape = crc32(_RUNS.sub(r"\1", s.translate(_SHAPE)).encode("utf-8", "replace")) % SHAPES
    return dense, [_DENSE + bucket(before, BEFORE), _DENSE + BEFORE + bucket(after, AFTER), _DENSE + BEFORE + AFTER + shape]


def matrix(dense: list[list[float]], ones: list[list[int]]) -> np.ndarray:
    x = np.zeros((len(dense), WIDTH))
    if len(dense):
        x[:, :_DENSE] = dense
        x[np.arange(len(dense))[:, None], np.array(ones)] = 1.0
    return x


def newton_sums(w: np.ndarray, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Weighted logistic loss against soft labels, with its gradient and Hessian: each a sum over candidates."""
    z = np.clip(x @ w, -30, 30)
    p = 1 / (1 + np.exp(-z))
    loss = weight @ (np.logaddexp(0, z) - y * z)
    return float(loss), x.T @ (weight * (p - y)), (x * (weight * p * (1 - p))[:, None]).T @ x


#: Newton steps of the span classifier, and its ridge, in candidates' weight.
STEPS, RIDGE = 8, 0.05


def _step(w: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """One Newton step from summed loss, gradient and Hessian."""
    grad, hess = sums[1 : 1 + WIDTH] + RIDGE * w, sums[1 + WIDTH :].reshape(WIDTH, WIDTH) + RIDGE * np.eye(WIDTH)
    return np.clip(np.linalg.solve(hess, grad), -3, 3)


def candidates(docs: DataFrame) -> DataFrame:
    """(pattern, dense, ones): the votes and classifier inputs of every candidate of all whole texts, base spans too."""

    def run(batches):
        for b in batches:
            pattern, dense, ones = [], [], []
            for i in range(len(b)):
                text = b.column("text")[i].as_py() or ""
                base = base_spans(text)
                for a, k, e in base + proposals(text, base):
                    v = votes(text, a, k, e)
                    pattern.append(",".join(map(str, (k, *v))))
                    x, at = inputs(text, a, k, e, v)
                    dense.append(x)
                    ones.append(at)
            yield pa.RecordBatch.from_arrays([pa.array(pattern, pa.string()), pa.array(dense, pa.list_(pa.float32())), pa.array(ones, pa.list_(pa.int32()))], ["pattern", "dense", "ones"])

    return docs.select("text").mapInArrow(run, "pattern string, dense array<float>, ones array<int>")


def learn(docs: DataFrame, steps: int = STEPS) -> np.ndarray:
    """Weights of the span classifier of a corpus.

    All candidates are written once. Their vote patterns are counted (at most 5 kinds x 3 ** 5 votes reach
    the driver) and weighed by EM. The classifier is fitted to the posteriors by Newton steps, whose
    gradient and Hessian are summed over all candidates where they lie; a candidate counts the less the
    commoner its pattern is (by the root of its count), so that a pattern seen everywhere doesn't drown the others.
    """
    rows = common.staged(candidates(docs), "candidates")
    counts = {tuple(map(int, r.pattern.split(","))): r["count"] for r in rows.groupBy("pattern").count().collect()}
    w = np.zeros(WIDTH)
    if not counts:
        return w
    posterior = aggregate(counts)[0]
    total = sum(n**0.5 for n in counts.values())
    known = {",".join(map(str, k)): (p, 100 * counts[k] ** -0.5 / total * len(counts)) for k, p in posterior.items()}
    for _ in range(steps):
        sums = _summed(rows, w, known)
        step = _step(w, sums)
        w = w - step
        if np.abs(step).max() < 1e-5:
            break
    return w


def _summed(rows: DataFrame, w: np.ndarray, known: dict[str, tuple[float, float]]) -> np.ndarray:
    """Loss, gradient and Hessian over all candidates: one vector a task, added up slot by slot."""

    def run(batches):
        total = np.zeros(1 + WIDTH + WIDTH * WIDTH)
        for b in batches:
            if not len(b):
                continue
            y, weight = np.array([known[p] for p in b.column("pattern").to_pylist()]).T
            loss, grad, hess = newton_sums(w, matrix(b.column("dense").to_pylist(), b.column("ones").to_pylist()), y, weight)
            total += np.concatenate([[loss], grad, hess.ravel()])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["slot", "x"])

    out = np.zeros(1 + WIDTH + WIDTH * WIDTH)
    for r in rows.mapInArrow(run, "slot int, x double").groupBy("slot").agg(F.sum("x").alias("x")).collect():
        out[r.slot] = r.x
    return out


def sure(text: str, candidate: tuple[int, int, int], w: np.ndarray) -> bool:
    """Whether the classifier gives a candidate (start, kind, end) at least the probability SURE."""
    v = votes(text, *candidate)
    if candidate[1] == 2 and v[LABELERS.index("checksum")] == -1:  # no card fails its checksum
        return False
    dense, ones = inputs(text, *candidate, v)
    return float(1 / (1 + np.exp(-(np.dot(w[:_DENSE], dense) + w[ones].sum())))) >= SURE


def spans(text: str, w: np.ndarray) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans) of a text, in order."""
    base = base_spans(text)
    more = [c for c in proposals(text, base) if sure(text, c, w)]
    return base, sorted(base + more)


def _written(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


def find(docs: DataFrame, w: np.ndarray) -> DataFrame:
    """Per row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, and n_spans, the number of these.
    Null texts are empty; repeated rows each come back."""

    def run(batches):
        for b in batches:
            counts, sha, written, n_spans = [[] for _ in BASE], [], [], []
            for i in range(len(b)):
                base, every = spans(b.column("text")[i].as_py() or "", w)
                for k in range(len(BASE)):
                    counts[k].append(sum(s[1] == k for s in base))
                sha.append(hashlib.sha256(_written(base).encode()).hexdigest())
                written.append(_written(every))
                n_spans.append(len(every))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(sha, pa.string()), pa.array(written, pa.string()), pa.array(n_spans, pa.int64())], ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans", "n_spans"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long")


def masked_text(text: str, found: list[tuple[int, int, int]]) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans go as one, named by the first."""
    out, end = [], 0
    for a, k, b in found:
        if a >= end:
            out += [text[end:a], f"[{KINDS[k].upper()}]"]
        end = max(end, b)
    return "".join([*out, text[end:]])


def mask(docs: DataFrame, w: np.ndarray) -> DataFrame:
    """``docs`` with personal data masked in ``text``, and ``n_chars``, if there, as long as the new text; other columns stay.
    Null texts stay null. Two columns of one name both stay; ``text`` must be one."""
    names, at = docs.columns, docs.columns.index("text")

    def run(batches):
        for b in batches:
            new = [None if (t := x.as_py()) is None else masked_text(t, spans(t, w)[1]) for x in b.column(at)]
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if i == at else c for i, c in enumerate(b.columns)], [f"_{i}" for i in range(len(names))])

    kinds = [f.dataType.simpleString() for f in docs.schema.fields]
    out = docs.toDF(*(f"_{i}" for i in range(len(names)))).mapInArrow(run, ", ".join(f"_{i} {k}" for i, k in enumerate(kinds)))
    size = [F.coalesce(F.length(f"_{at}"), F.lit(0)).cast(kinds[i]).alias(f"_{i}") if c == "n_chars" else F.col(f"_{i}") for i, c in enumerate(names)]
    return out.select(*size).toDF(*names)
