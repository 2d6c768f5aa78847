"""Rule detectors and texts on hand-made cases."""

import hashlib
import hmac
from base64 import b32encode

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from maskwright.functions import codes, normalize, scan
from maskwright.functions import spans as S
from maskwright.operators import detect, tokenise
from maskwright.sources import journals
from maskwright.streaming import relay

KEY = b"0123456789abcdef0123456789abcdef"

CASES = [
    ("Тел +7 (916) 123-45-67", [("T", 4, 22, "79161234567")]),
    ("9161234568", [("T", 0, 10, "79161234568")]),
    ("x 99161234567890", []),
    ("мама 12.03.1985", []),
    ("дата рождения 12.03.1985!", [("D", 14, 19, "12.03")]),
    ("родился 1985-03-12", [("D", 13, 18, "12.03")]),
    ("снилс 112-233-445 95", [("I", 6, 20, "11223344595")]),
    ("число 500100732259", [("I", 6, 18, "500100732259")]),
    ("число 500100732258", []),
    ("id 1700000000", []),
    ("ул. Ленина 5, д. 3, кв. 7; дальше", [("A", 0, 25, "ул ленина 5 д 3 кв 7")]),
    ('{"client_id": "00352"}', [("C", 15, 20, "352")]),
    ("почта A.b@Ex.ru.", [("E", 6, 15, "a.b@ex.ru")]),
    ("😀 a@b.io", [("E", 2, 8, "a@b.io")]),
    ("", []),
    (None, []),
]


def test_rules(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "i int, text string")
    got = {r.i: [(s.cls, s.start, s.end, s.norm) for s in r.s] for r in rows.select("i", detect.rules(F.col("text")).alias("s")).collect()}
    assert got == {i: want for i, (_, want) in enumerate(CASES)}


def test_tabular_padding_and_dates(spark):
    text = "заметка\nФИО;Телефон;Дата рождения\n Иванов ;8 916 000-11-22;12.03.1985\n;;\nПетров;;1985-03-12"
    s = spark.range(1).select(detect.tabular(F.lit(text)).alias("s")).first().s
    assert [(x.cls, text[x.start : x.end], x.norm) for x in s] == [("P", " Иванов ", "иванов"), ("T", "8 916 000-11-22", "79160001122"), ("D", "12.03", "12.03"), ("P", "Петров", "петров")]


def test_code_is_hmac(spark):
    for cls, value in (("E", "a@b.io"), ("P", "иванов ё")):
        want = "z" + cls + b32encode(hmac.new(KEY, f"{cls}:{value}#2".encode(), hashlib.sha256).digest()).decode()[:8]
        assert spark.range(1).select(codes.code(F.lit(cls), F.lit(value), KEY, 2)).first()[0] == want


def test_splice_keeps_the_rest(spark):
    text = "a@b.io и c@d.ru"
    r = tokenise.tokenise(spark.createDataFrame([(text,)], "text string"), KEY).first()
    assert r.masked.split(" и ")[0].startswith("zE") and len(r.masked) == 23


def test_merge_order(spark):
    spans = [(5, 9, "T", 0), (0, 4, "P", 1), (0, 6, "E", 2), (0, 6, "C", 3), (3, 3, "A", 4), (9, 12, "I", 5)]
    arr = F.array(*(S.span(F.lit(a), F.lit(b), F.lit(c), F.lit(""), F.lit(""), 0, F.lit(o)) for a, b, c, o in spans))
    got = spark.range(1).select(S.merge(arr).alias("s")).first().s
    assert [(x.start, x.end, x.cls) for x in got] == [(0, 6, "C"), (9, 12, "I")]


def test_birth_dates(spark):
    rows = spark.createDataFrame([("1.2.85",), ("1/2/30",), ("32.01.1985",), ("1985-13-01",), ("x",), (None,)], "v string")
    got = [tuple(r.d) if r.d else None for r in rows.select(normalize.split_birth_date(F.col("v")).alias("d")).collect()]
    assert got == [("01.02", "1985"), ("01.02", "2030"), None, None, None, None]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["zPABCDEFGH", "zTQQQQ2222", " ", "a", "z", "[[", "P-", "zP", "я", ".", "zpabcdefgh", "\n"]), max_size=9), st.integers(1, 6))
def test_stream_equals_whole(parts, size):
    text = "".join(parts)
    form = lambda code, n: ["Иванов", "Иванова"][min(n, 1)] if code == "zPABCDEFGH" else None
    r = relay.Restorer(form)
    out = "".join(r.feed(text[i : i + size]) for i in range(0, len(text), size)) + r.feed("", last=True)
    assert out == relay.restored_whole(text, form)


@pytest.mark.parametrize("size", [1, 3, 17, 64])
def test_frames(size):
    data = 'data: {"a":"я"}\n\n: note\r\n\r\ndata: [DONE]\n\nrest'.encode()
    pending, out = b"", []
    for i in range(0, len(data), size):
        found, pending = relay.frames(pending, data[i : i + size])
        out += found
    assert b"".join(out) + pending == data and pending == b"rest" and len(out) == 3


def test_damaged_codes():
    found = lambda t: [(a, b, norm) for a, b, _, _, norm, *_ in scan.code_spans(t)]
    assert found("код zP-ABCD EFGH!") == [(4, 16, "zPABCDEFGH")] and found("zРAВСDEFGH")[0][2] == "zPABCDEFGH" and found("zP08CDEFGH")[0][2] == "zPOBCDEFGH"
    for none in ("zebra zone zoom", "XzPABCDEFGH", "zPABCD", "z" + " " * 12, "zQABCDEFGH", "z P A B C D E F G H I J", "zpab-cdefgh"):
        assert found(none) == [] or none.startswith("z P"), none
    assert [x[2] for x in found("zPABCDEFGH, ещё zPABCDEFGH")] == ["zPABCDEFGH"] * 2


def test_paged_source(spark, tmp_path):
    import json

    for n, rows in ((1, [{"a": 1}, {"a": 2}]), (2, [{"a": 3}]), (3, [])):
        (tmp_path / f"page-{n}.json").write_text(json.dumps(rows))
    spark.dataSource.register(journals.PagedRecords)
    got = spark.read.format("paged_records").option("path", str(tmp_path)).option("pages", 5).load()
    assert sorted((r.page, r.record) for r in got.collect()) == [(1, '{"a": 1}'), (1, '{"a": 2}'), (2, '{"a": 3}')]


def test_dictionary_file(spark, tmp_path):
    (tmp_path / "d.json").write_text('{"schema": 3, "digests": {"P": ["aa", "bb"]}, "forms": {"P": {"cc": "aa"}}}')
    (tmp_path / "r.json").write_text('{"P": ["Иванов"]}')
    (tmp_path / "bad.json").write_text("{")
    values, digests, forms = journals.dictionary(spark, str(tmp_path / "d.json"))
    assert values.count() == 0 and digests.count() == 2 and [tuple(r) for r in forms.collect()] == [("P", "cc", "aa")]
    assert [tuple(r) for r in journals.dictionary(spark, str(tmp_path / "r.json"))[0].collect()] == [("P", "Иванов")]
    assert all(t.count() == 0 for t in journals.dictionary(spark, str(tmp_path / "bad.json")))


def test_kept_weeks(spark):
    w = spark.createDataFrame([("2024-01",), ("2024-27",), ("2023-50",)], "iso_week string")
    got = {r.iso_week: r.keep for r in journals.kept_weeks(w, "2024-07-01").collect()}
    assert got == {"2024-01": True, "2024-27": True, "2023-50": False}


def test_numbers_beside_others():
    """Patterns that are tried only where they can match: runs of other lengths, dates in a row, and phrases in any case. Nine digits are a КПП, whose rule comes first."""
    assert [(s[3], s[5]) for s in scan.ru_ids("ИНН 7707083893, бик 044525225 и 40702810900000000001")] == [("7707083893", "инн"), ("044525225", "кпп"), ("40702810900000000001", "расчётный счёт")]
    assert scan.ru_ids("77070838931 и 0445252251") == []
    assert [s[:5] for s in scan.birth_dates("рождения 2001-12-31, 12001-02-03, 4-05-06")] == [(14, 19, "D", "12-31", "31.12"), (27, 32, "D", "02-03", "03.02")]
    assert [s[3] for s in scan.client_ids("CLIENT_ID: 00123; Договор № 45678; КАРТА № 321")] == ["00123", "45678", "321"]
    assert [s[3] for s in scan.client_ids("İ, clıent_id=888, КАРТА № 321")] == ["888", "321"]
