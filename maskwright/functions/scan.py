"""Detectors over one text: plain functions, run in Arrow batches by ``arrow``.

A text is read once by each detector whose cheap sign it holds, in linear time, and positions come from the
matches themselves. As column expressions the same rules take seconds to plan and more to run (each lambda
is interpreted, and appending to an array costs its length), so the text level is Arrow and the rest of the engine expressions and joins.

A span is (start, end, cls, raw, norm, suffix, src, ord); positions count code points from 0.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from . import codes, forms

Span = tuple[int, int, str, str, str, str, int, int]

# Patterns, context words and windows of the rules.
PHONE = re.compile(r"(?<![0-9+])(?:(?:\+7|8|7)(?:[\s\-()]*[0-9]){10}|9[0-9]{9})(?![0-9])")
EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
SNILS = re.compile(r"(?<![0-9])[0-9]{3}-[0-9]{3}-[0-9]{3}\s?[0-9]{2}(?![0-9])")
INN12 = re.compile(r"(?<![0-9])[0-9]{12}(?![0-9])")
PASSPORT = re.compile(r"(?<![0-9])[0-9]{2}\s?[0-9]{2}\s?№?\s?[0-9]{6}(?![0-9])")
STREET = r"(?:ул\.|улица|пр-т|проспект|б-р|бульвар|шоссе|ш\.|пер\.|переулок)"
ADDRESS = re.compile(STREET + r"\s+[А-ЯЁA-Z][^,;|\n]{2,40}(?:[,;]?\s*(?:д\.|дом|кв\.|квартира|корп\.?)\s*[\w\-/]{1,10})*")
BIRTH_DATE = re.compile(r"(?<![0-9])[0-9]{1,2}[.\-/][0-9]{1,2}[.\-/][0-9]{4}(?![0-9])")
ISO_BIRTH_DATE = re.compile(r"[0-9]{4}-([0-9]{2})-([0-9]{2})(?![0-9])")
CLIENT_ID = (
    r"(?:client_id|client\s?id|ид\s?клиента|№\s?договора|договор\s?№|№\s?карты|карта\s?№|анкета\s?№|№\s?анкеты|номер\s?карты)"
    r"(?:\\?[\"'])?\s*[:№=]?\s*(?:\\?[\"'])?([0-9]{3,})")  # fmt: skip
KNOWN_NUMBER = re.compile(r"(?<![0-9])[0-9]{7,12}(?![0-9])")
DATE_WORDS = ("г.р", "г р", "рождения", "родился", "родилась", "дата рождения", "др клиента")
DOCUMENT_WORDS = ("паспорт", "инн", "снилс", "документ", "серия и номер", "выдан")
NEAR = 32
RU_WORDS = (
    "паспорт", "паспорта", "паспорту", "серия", "серии", "выдан", "выдано", "выдана", "снилс", "страховой", "страхового",
    "инн", "огрн", "огрнип", "кпп", "бик", "счёт", "счет", "счёта", "счета", "расчётный", "расчетный", "полис", "омс",
    "удостоверение", "водительское", "кем", "отделом", "уфмс", "мвд",
)
RU_NEAR = 48
CLIENT_CONTEXT = re.compile(r"фио|телефон|клиент|таблиц|выгрузк|анкет|[0-9]{5}|;|\|", re.I)
#: Russian identifiers in their order: name, pattern, whether a context word is needed, check, lengths if it is digits alone.
RU_RULES = (
    ("снилс", re.compile(r"[0-9]{3}[-\s]?[0-9]{3}[-\s]?[0-9]{3}[-\s]?[0-9]{2}"), False, forms.snils_ok, ()),
    ("инн", re.compile(r"[0-9]{12}|[0-9]{10}"), False, lambda v: forms.inn_ok(v) and not forms.is_epoch(v), (10, 12)),
    ("огрнип", re.compile(r"[0-9]{15}"), False, forms.ogrnip_ok, (15,)),
    ("огрн", re.compile(r"[0-9]{13}"), False, forms.ogrn_ok, (13,)),
    ("паспорт", re.compile(r"[0-9]{2}\s?[0-9]{2}\s?№?\s?[0-9]{6}"), True, None, ()),
    ("кпп", re.compile(r"[0-9]{4}[0-9A-ZА-Я]{2}[0-9]{3}"), True, None, ()),
    ("бик", re.compile(r"04[0-9]{7}"), True, None, (9,)),
    ("расчётный счёт", re.compile(r"[0-9]{20}"), True, None, (20,)),
    ("полис ОМС", re.compile(r"[0-9]{16}"), True, None, (16,)),
    ("водительское", re.compile(r"[0-9]{2}\s?[А-Я]{2}\s?[0-9]{6}"), True, None, ()),
)
# Header cells and the class of their columns.
HEADERS = {
    "фио": "P", "ф.и.о": "P", "имя": "P", "фамилия": "P", "клиент": "P", "телефон": "T", "тел": "T", "тел.": "T", "phone": "T", "мобильный": "T",
    "e-mail": "E", "email": "E", "почта": "E", "адрес": "A", "дата рождения": "D", "дата рожд": "D", "др": "D",
    "client_id": "C", "id клиента": "C", "номер договора": "C", "номер карты": "C", "№ договора": "C", "№ карты": "C",
}
DELIMITERS, HEADER_CELL = (",", ";", "\t", "|"), 60
# Shapes of names.
SURNAME = (
    r"[А-ЯЁ][а-яё]{1,}(?:ский|ская|ского|скому|ским|ской|цкий|цкая|цкого|цкому|цкой|овым|иным|евой|иной|ову|еву|ину|ова|ева|ёва|ина|ына"
    r"|ого|ому|ыми|ими|ых|их|ым|ой|ая|яя|ий|ый|ов|ев|ёв|ин|ын)"
)
FULL_NAME = re.compile(r"(?<![А-Яа-яЁё])" + SURNAME + r"\s+[А-ЯЁ][а-яё]{2,}(?:\s+[А-ЯЁ][а-яё]{2,})?(?![А-Яа-яЁё])")
INITIALS = re.compile(r"(?<![А-Яа-яЁё])" + SURNAME + r"\s+(?:[А-ЯЁ]\.\s?){1,2}(?![А-ЯЁ]\.)")
UPPERCASE = re.compile(r"(?<![А-ЯЁ])[А-ЯЁ]{3,}\s+[А-ЯЁ]{2,}(?:\s+[А-ЯЁ]{3,})?(?![А-ЯЁ])")
ADDRESS_TAIL = re.compile(r"(?:ул\.|улица|пр-т|проспект|б-р|бульвар|шоссе|пер\.|переулок)\s+(?:[А-ЯЁ][а-яё]*\s+){0,2}$", re.I)
NAME_RUN = re.compile("[А-ЯЁA-Z][А-Яа-яЁёA-Za-z\\-]+(?:[ \u00a0][А-ЯЁA-Z][А-Яа-яЁёA-Za-z\\-]+){0,2}")
LOW_WORD = re.compile(r"(?<![\w\-])[а-яё]{4,25}(?![\w\-])")

_ANY_DIGIT = re.compile("[0-9]")
_LONG_NUMBER = re.compile(r"(?:[0-9][\s\-()№]*){10}")
_EMAIL = re.compile(EMAIL)
_CYRILLIC = re.compile("[А-Яа-яЁё]")
_THREE_DIGITS, _LONG_RUN = re.compile("[0-9]{3}"), re.compile("[0-9]{6,}")
# client ids in a text of small letters; in any case where a letter's small form is no letter of the pattern, though they are alike
_CLIENT_ID_LOW, _CLIENT_ID_ANY, _ODD_CASE = re.compile(CLIENT_ID), re.compile(CLIENT_ID, re.I), re.compile("[ı\u1c80-\u1c88]")


@dataclass(frozen=True)
class Vocabulary:
    """A deployment's own words, which no person is: terms (any word of a value), whole values, and phrases within
    values; and its own addresses, telephones and service objects, which are no client's."""

    terms: frozenset[str] = frozenset()
    values: frozenset[str] = frozenset()
    phrases: frozenset[str] = frozenset()
    addresses: frozenset[str] = frozenset()
    phones: frozenset[str] = frozenset()
    service_objects: frozenset[str] = frozenset()

    @classmethod
    def of(cls, **lists: Iterable[str] | str | None) -> Vocabulary:
        """From lists, or texts of one entry a line or between semicolons; empty ones and comments (#) are skipped."""
        read = lambda x: re.split(r"[;\n]", x) if isinstance(x, str) else x or ()
        out = {}
        for kind, raw in lists.items():
            entries = {" ".join(e.split("#")[0].split()).lower() for e in read(raw)} - {""}
            out[kind] = frozenset(_folded(e) for e in entries) if kind == "phones" else frozenset(entries)
        return cls(**out)

    def merged(self, other: Vocabulary) -> Vocabulary:
        return Vocabulary(*(a | b for a, b in zip(_lists(self), _lists(other), strict=True)))

    def owns(self, value: str) -> bool:
        """Whether a would-be name is a word, value or phrase of the trade."""
        low = " ".join(value.split()).lower()
        return low in self.values or low in self.service_objects or not self.terms.isdisjoint(low.split()) or any(p in low for p in self.phrases)

    def constant(self, span: Span) -> bool:
        """Whether a finding is an address or telephone of the deployment itself."""
        return span[2] == "T" and _folded(span[3]) in self.phones or span[2] == "A" and (span[4] or "") in {forms.address(a) for a in self.addresses}


def _lists(v: Vocabulary) -> tuple[frozenset[str], ...]:
    return v.terms, v.values, v.phrases, v.addresses, v.phones, v.service_objects


def _folded(phone: str) -> str:
    d = forms.digits(phone)
    return "7" + d[1:] if len(d) == 11 and d[0] == "8" else d


NO_WORDS = Vocabulary()


def _spans(text: str, pattern: re.Pattern, cls: str, src: int, norm: Callable[[str], str | None], keep: Callable[[int, str], bool] | None = None) -> list[Span]:
    out = []
    for i, m in enumerate(pattern.finditer(text)):
        form = norm(m[0])
        if form is not None and (keep is None or keep(m.start(), m[0])):
            out.append((m.start(), m.end(), cls, m[0], form, "", src, i))
    return out


def around(text: str, start: int, before: int, after: int) -> str:
    return text[max(0, start - before) : start + after].lower()


def _has(text: str, words: tuple[str, ...]) -> bool:
    return any(w in text for w in words)


def phones(text: str) -> list[Span]:
    return _spans(text, PHONE, "T", 0, forms.phone) if _LONG_NUMBER.search(text) else []


def emails(text: str) -> list[Span]:
    return _spans(text, _EMAIL, "E", 1, forms.email) if "@" in text else []


def _run_lengths(text: str) -> set[int]:
    """The lengths of the text's runs of six digits or more: a pattern of digits alone matches whole runs of its length, and no other."""
    return set(map(len, _LONG_RUN.findall(text)))


def document_looks_real(text: str, start: int, raw: str) -> bool:
    """A document word near by settles it; else 12 digits need their check digits, 10 must not be a
    time, and all but the 12 need a space or dash within."""
    if _has(around(text, start, NEAR, NEAR), DOCUMENT_WORDS):
        return True
    d = forms.digits(raw)
    if len(d) == 12:
        return forms.inn12_ok(d) and not forms.is_epoch(d)
    return not forms.is_epoch(d) and len(raw.split()) + raw.count("-") > 1


def documents(text: str) -> list[Span]:
    """SNILS, 12-digit INN and passport numbers by shape and plausibility."""
    if not _LONG_NUMBER.search(text):
        return []
    real = lambda start, raw: document_looks_real(text, start, raw)
    lengths = _run_lengths(text)
    asked = ((2, SNILS, True), (3, INN12, 12 in lengths), (4, PASSPORT, bool(lengths)))
    return [s for src, p, can in asked if can for s in _spans(text, p, "I", src, forms.document, real)]


def addresses(text: str) -> list[Span]:
    return _spans(text, ADDRESS, "A", 5, forms.address) if _CYRILLIC.search(text) else []


def birth_dates(text: str) -> list[Span]:
    """Day and month of dates beside a birth word; the year stays open and out of the span."""
    if not _ANY_DIGIT.search(text) or not _has(text.lower(), DATE_WORDS):
        return []
    near = lambda start: _has(around(text, start, NEAR, NEAR), DATE_WORDS)
    out = []
    for i, m in enumerate(BIRTH_DATE.finditer(text)):
        date = forms.split_birth_date(m[0])
        if date and near(m.start()):
            raw = m[0][:-5]
            out.append((m.start(), m.start() + len(raw), "D", raw, date[0], "." + date[1], 6, i))
    for i, m in enumerate(ISO_BIRTH_DATE.finditer(text)):
        if 1 <= int(m[2]) <= 31 and 1 <= int(m[1]) <= 12 and near(m.start(1)):
            out.append((m.start(1), m.end(), "D", m[0][5:], f"{m[2]}.{m[1]}", "", 7, i))
    return out


def client_ids(text: str) -> list[Span]:
    if not _THREE_DIGITS.search(text):
        return []
    low = text.lower()
    found = _CLIENT_ID_ANY.finditer(text) if len(low) != len(text) or _ODD_CASE.search(low) else _CLIENT_ID_LOW.finditer(low)
    return [(m.start(1), m.end(1), "C", m[1], forms.client_id(m[1]), "", 8, i) for i, m in enumerate(found)]


def ru_ids(text: str) -> list[Span]:
    """Russian identifiers. Rules reserve their spans in order; ``suffix`` names the rule.

    A number is never part of a longer one; check digits decide where there are any, else a context word.
    """
    if not _THREE_DIGITS.search(text):
        return []
    out: list[Span] = []
    lengths, told = _run_lengths(text), _has(text.lower(), RU_WORDS)
    taken = bytearray(len(text))
    for name, pattern, need, check, whole in RU_RULES:
        if need and not told or whole and lengths.isdisjoint(whole):
            continue
        for i, m in enumerate(pattern.finditer(text)):
            a, b = m.span()
            if text[b : b + 1] in tuple("0123456789") or a and text[a - 1] in "0123456789" or any(taken[a:b]):
                continue
            if need and not (_has(around(text, a, RU_NEAR, 0), RU_WORDS) or _has(text[b : b + RU_NEAR].lower(), RU_WORDS)) or check and not check(m[0]):
                continue
            taken[a:b] = b"\1" * (b - a)
            if (norm := forms.document(m[0])) is not None:
                out.append((a, b, "I", m[0], norm, name, 9, i))
    return out


def merge(spans: Iterable[Span]) -> list[Span]:
    """Spans without overlap: earliest first, of equal starts the longest, then by class and detector."""
    out: list[Span] = []
    for s in sorted((s for s in spans if s[1] > s[0]), key=lambda s: (s[0], -s[1], s[2], s[6], s[7])):
        if not out or s[0] >= out[-1][1]:
            out.append(s)
    return out


def every_rule(text: str) -> list[Span]:
    unnamed = [(*s[:5], "", *s[6:]) for s in ru_ids(text)]
    return [*phones(text), *emails(text), *documents(text), *addresses(text), *birth_dates(text), *client_ids(text), *unnamed]


def rules(text: str) -> list[Span]:
    """All rule detectors, merged."""
    return merge(every_rule(text))


def tabular(text: str) -> list[Span]:
    """Values of pasted tables: columns under known headings of the first header line.

    The delimiter is the most frequent of four. A span covers its whole cell with padding and
    quotes; a birth date only its day and month, from the start of the cell.
    """
    if "\n" not in text:
        return []
    delimiter = max(DELIMITERS, key=text.count)
    if delimiter not in text:
        delimiter = ","
    clean = lambda c: c.strip().strip('"')
    out: list[Span] = []
    columns: list[str | None] = []
    start = 0
    for i, line in enumerate(text.split("\n")):
        cells = line.split(delimiter)
        if not columns:
            kinds = [HEADERS.get(clean(c).lower()) for c in cells]
            if len(cells) >= 2 and any(kinds) and all(len(clean(c)) <= HEADER_CELL for c in cells):
                columns = kinds
        elif line.strip(" "):
            at = start
            for k, (cell, cls) in enumerate(zip(cells, columns, strict=False)):
                raw = clean(cell)
                if cls and any(c.isalnum() for c in raw) and not raw.startswith("⟦") and not is_code(raw):
                    found = _date_cell(raw, at) if cls == "D" else (at + len(cell), raw, forms.normalize(cls, raw), "")
                    if found and found[2] is not None:
                        out.append((at, found[0], cls, found[1], found[2], found[3], 10, i * 1000 + k))
                at += len(cell) + 1
        start += len(line) + 1
    return merge(out)


def _date_cell(raw: str, at: int) -> tuple[int, str, str, str] | None:
    """End, text, day and month, and year of a birth date's cell. A year of two digits keeps its first, and a year in front leaves nothing."""
    date = forms.split_birth_date(raw)
    if not date:
        return None
    if re.search(r"[.\-/][0-9]{4}$", raw):
        part = re.sub(r"[.\-/ ]+[0-9]{4}$", "", raw)
    elif re.search(r"[.\-/][0-9]{2,3}$", raw) and not re.match("[0-9]{4}-", raw):
        part = re.sub(r"[.\-/ ]+$", "", raw[:-1])
    else:
        return None
    return at + len(part), part, date[0], "." + date[1]


def number_runs(text: str) -> list[Span]:
    """Standalone runs of 7 to 12 digits: candidates for numbers known to the dictionary."""
    return _spans(text, KNOWN_NUMBER, "?", 11, lambda raw: raw)


def in_client_context(text: str, start: int, end: int, radius: int = 40) -> bool:
    return CLIENT_CONTEXT.search(text[max(0, start - radius) : end + radius]) is not None


def boundary_ok(text: str, start: int, end: int) -> bool:
    """No letter touches the span."""
    return not (start and text[start - 1].isalpha() or text[end : end + 1].isalpha())


def in_address(text: str, start: int) -> bool:
    """An address marker and at most two capitalised words stand right before the place."""
    return ADDRESS_TAIL.search(text[max(0, start - 48) : start]) is not None


def inside_link(text: str, start: int, end: int) -> bool:
    """The span is glued to a URL, path or identifier."""
    before, after = text[start - 1 : start] if start else "", text[end : end + 1]
    return bool(before) and before in "/\\.-=&?:@" or bool(after) and after in "/\\?&=:@" or "://" in text[max(0, start - 3) : start] or "://" in text[end : end + 4]


def name_candidates(text: str) -> list[Span]:
    """Up to three neighbouring capitalised words in every contiguous choice, and single lower-case words of 4 to 25 letters."""
    found = []
    for m in NAME_RUN.finditer(text):
        words = [(m.start() + w.start(), m.start() + w.end()) for w in re.finditer("[^ \u00a0]+", m[0])]
        found += [(a, b) for i, (a, _) in enumerate(words) for _, b in words[i : i + 3]]
    found += [m.span() for m in LOW_WORD.finditer(text)]
    return [(a, b, "P", text[a:b], norm, "", 12, i) for i, (a, b) in enumerate(found) if (norm := forms.name(text[a:b])) is not None]


def name_shapes(text: str, words: Vocabulary = NO_WORDS) -> list[Span]:
    """Names told by their shape alone: surname with given name or initials, but for words of the trade."""
    if not _CYRILLIC.search(text):
        return []
    found = [*_spans(text, FULL_NAME, "P", 13, forms.name), *_spans(text, INITIALS, "P", 14, forms.name)]
    return [s for s in found if not words.owns(s[3])]


def capital_shapes(text: str, words: Vocabulary = NO_WORDS) -> list[Span]:
    """Two or three words in capitals: names only on further evidence."""
    return [s for s in _spans(text, UPPERCASE, "P", 15, forms.name) if not words.owns(s[3])] if _CYRILLIC.search(text) else []


# Letters and digits that stand for base32 letters in damaged copies, what may stand between the signs of a code, and its longest copy.
LOOKALIKES = {
    "0": "O", "1": "I", "8": "B", "9": "G",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Г": "G", "К": "K", "М": "M", "Н": "H",
    "О": "O", "Р": "P", "Т": "T", "Х": "X", "У": "Y", "І": "I",
    "а": "A", "в": "B", "с": "C", "е": "E", "г": "G", "к": "K", "м": "M", "н": "H",
    "о": "O", "р": "P", "т": "T", "х": "X", "у": "Y", "і": "I",
}
SEPARATORS = " \t\r\n\u00a0\u200b\u200c\u200d\u2060-_*`·•.,'’\"«»|/"
LONGEST_COPY = 20
_FRAMED, _BARE, _COMPACT = re.compile(codes.FRAMED), re.compile(codes.BARE), re.compile(codes.COMPACT_IN_TEXT)
_WHOLE = re.compile(f"(?:{codes.COMPACT.removeprefix('(?i)')})", re.I), _FRAMED, _BARE
# a damaged copy: z after no letter or digit, then nine letters or digits with separators before each; copies may start within one another
_SIGN = r"[A-Za-z0-9" + "".join(c for c in LOOKALIKES if not c.isascii()) + "]"
_COPY = re.compile(rf"(?<![A-Za-z0-9А-Яа-яЁё])(?=([zZ](?:[{re.escape(SEPARATORS)}]*{_SIGN}){{{codes.LENGTH + 1}}}))")
_TO_BASE32 = str.maketrans({**LOOKALIKES, **{c: None for c in SEPARATORS}})
_BASE32 = re.compile(f"[{codes.CLASS_LETTERS}][A-Z2-7]{{{codes.LENGTH}}}")


def canonical(code: str) -> str:
    """The surface under which a code that was found is registered."""
    if code[0] in "zZ":
        return codes.PREFIX + code[1:].upper()
    m = re.search(f"([{codes.CLASS_LETTERS}])-([A-Z2-7]{{{codes.FRAMED_LENGTH}}})", code)
    return f"[[{m[1]}-{m[2]}]]"


def is_code(text: str) -> bool:
    s = text.strip(" ")
    return any(p.fullmatch(s) for p in _WHOLE)


def code_spans(text: str) -> list[Span]:
    """Codes: framed, bare, compact, and damaged copies of compact ones; canonical form in norm. What one surface took, the next leaves."""
    out: list[Span] = []
    surfaces = [(0, ((m.span(), m[0]) for m in _FRAMED.finditer(text))), (1, ((m.span(), m[0]) for m in _BARE.finditer(text))), (2, ((m.span(), m[0]) for m in _COMPACT.finditer(text))), (3, _copies(text))]
    taken = bytearray(len(text))
    for src, found in surfaces:
        for i, ((a, b), raw) in enumerate(found):
            if not any(taken[a:b]):
                taken[a:b] = b"\1" * (b - a)
                norm = raw if src == 3 else canonical(text[a:b])
                cls = norm[1] if norm[0] == codes.PREFIX else norm[2]
                out.append((a, b, cls, text[a:b], norm, "", src, i))
    return sorted(out)


def _copies(text: str) -> Iterable[tuple[tuple[int, int], str]]:
    for m in _COPY.finditer(text):
        run = m[1]
        if len(run) <= LONGEST_COPY and any(c.isupper() or c.isdigit() for c in run):
            body = run[1:].translate(_TO_BASE32).upper()
            if _BASE32.fullmatch(body):
                yield m.span(1), codes.PREFIX + body


def bounded(value: str) -> re.Pattern:
    """Matches the value in any case and spacing where no letter touches it."""
    return re.compile(r"(?<![^\W\d_])" + r"\s+".join(map(re.escape, value.split())) + r"(?![^\W\d_])", re.I)


def splice(text: str, spans: list[tuple[int, int]], put: list[str]) -> str:
    """The text with each span (in order, none overlapping) replaced."""
    out, at = [], 0
    for (a, b), new in zip(spans, put, strict=True):
        out += [text[at:a], new]
        at = b
    return "".join([*out, text[at:]])


def replace_left(text: str, values: list[str], put: list[str]) -> str:
    """Replace what is left of the values, in any case and spacing; longest values first."""
    flat = None
    for value, new in sorted(set(zip(values, put, strict=True)), key=lambda x: (-len(x[0]), x)):
        parts = value.lower().split()
        flat = text.lower() if flat is None else flat
        if parts and all(p in flat for p in parts):
            done = bounded(value).sub(lambda _, new=new: new, text)
            if done != text:
                text, flat = done, None
    return text


def survivors(original: str, spans: list[tuple[int, int, str]], outgoing: str) -> list[int]:
    """Places in ``spans`` (start, end, raw) of findings that can still be read in the outgoing text, but for those inside links."""
    low = outgoing.lower()
    out = []
    for i, (a, b, raw) in enumerate(spans):
        parts = raw.lower().split()
        if parts and all(p in low for p in parts) and not inside_link(original, a, b) and bounded(raw).search(outgoing):
            out.append(i)
    return out


# Spellings of Russian names in Latin letters, the first choice of each sequence, and endings.
LATIN = (
    ("shch", "щ"), ("sch", "щ"), ("zh", "ж"), ("kh", "х"), ("ch", "ч"), ("sh", "ш"), ("ts", "ц"), ("yo", "ё"), ("ju", "ю"), ("yu", "ю"),
    ("ja", "я"), ("ya", "я"), ("je", "е"), ("ye", "е"), ("yi", "ый"), ("iy", "ий"), ("ey", "ей"), ("ay", "ай"), ("oy", "ой"), ("uy", "уй"),
    ("y", "ы"), ("a", "а"), ("b", "б"), ("c", "к"), ("d", "д"), ("e", "е"), ("f", "ф"), ("g", "г"), ("h", "х"), ("i", "и"), ("j", "й"),
    ("k", "к"), ("l", "л"), ("m", "м"), ("n", "н"), ("o", "о"), ("p", "п"), ("q", "к"), ("r", "р"), ("s", "с"), ("t", "т"), ("u", "у"),
    ("v", "в"), ("w", "в"), ("x", "кс"), ("z", "з"), ("'", "ь"),
)
LATIN_ENDINGS = (
    ("tskaya", ("цкая",)), ("enko", ("енко",)), ("skiy", ("ский",)), ("vich", ("вич",)), ("ova", ("ова",)), ("eva", ("ева", "ёва")), ("ina", ("ина",)),
    ("aya", ("ая",)), ("sky", ("ский",)), ("ov", ("ов",)), ("ev", ("ев", "ёв")), ("in", ("ин",)), ("iy", ("ий",)), ("ko", ("ко",)), ("uk", ("ук",)),
)
LATIN_SWAPS = (("е", "э"), ("и", "й"), ("о", "а"), ("в", "ф"))
MOST_SPELLINGS = 96
_CHUNK = re.compile("|".join(re.escape(a) for a, _ in LATIN))
_FIRST = dict(LATIN)


def spellings(latin: str) -> list[str]:
    """Cyrillic spellings that a Latin name may have, likeliest first: by its ending, letter by letter, and with one letter of each kind swapped."""
    word = latin.strip().lower().replace("-", "")
    if not word:
        return []
    spell = lambda s: _CHUNK.sub(lambda m: _FIRST[m[0]], s)
    out = [spell(word)]
    for ending, given in LATIN_ENDINGS:
        if word.endswith(ending) and len(word) > len(ending) + 1:
            out += [spell(word[: -len(ending)]) + g for g in given]
            break
    for old, new in LATIN_SWAPS:
        out += [s.replace(old, new, 1) for s in out if old in s]
    return list(dict.fromkeys(out))[:MOST_SPELLINGS]
