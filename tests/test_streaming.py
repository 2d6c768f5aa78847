"""Streamed answers cut anywhere equal the whole; streams of Spark with state and watermarks."""

import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from maskwright.functions import forms

from maskwright.settings import Settings, SettingsError, flag, trusted_clients
from maskwright.streaming import answers, relay

FORMS = {"zPABCDEFGH": ["Иванов", "Иванова"], "zTQQQQ2222": ["79"]}


def form(code, n):
    have = FORMS.get(code)
    return have and have[min(n, len(have) - 1)]


def events():
    text = ["Клиент zPAB", "CDEFGH и zP", "ABCDEFGH, тел zTQQQQ", "2222"]
    out = [answers.frame({"choices": [{"index": 0, "delta": {"content": t}}]}) for t in text]
    out.insert(1, b": ping\r\n\r\n")
    for piece in ('{"to": "zTQQ', 'QQ2222"}'):
        out.append(answers.frame({"choices": [{"index": 0, "delta": {"tool_calls": [{"index": 0, "function": {"name": "call", "arguments": piece}}]}}]}))
    out.append(answers.frame({"choices": [{"index": 0, "delta": {}, "finish_reason": "stop"}]}))
    return b"".join(out) + answers.DONE


def read(frames):
    text, args = "", ""
    for f in b"".join(frames).replace(b"\r\n", b"\n").split(b"\n\n"):
        if f.startswith(b"data: {"):
            for c in json.loads(f[6:])["choices"]:
                text += c["delta"].get("content") or ""
                args += "".join(x["function"]["arguments"] for x in c["delta"].get("tool_calls", []))
    return text, args


@pytest.mark.parametrize("size", [1, 3, 17, 64, 10_000])
def test_answer(size):
    data, out, state = events(), [], None
    for i in range(0, len(data), size):
        a = answers.Answer(form, state and json.loads(state))
        out += a.feed(data[i : i + size])
        state = json.dumps(a.state())
    out += answers.Answer(form, json.loads(state)).feed(b"", last=True)
    assert read(out) == ("Клиент Иванов и Иванова, тел 79", '{"to": "79"}')
    assert out[-1] == answers.DONE and b": ping\r\n\r\n" in out


def test_broken_answer():
    out = answers.Answer(form).feed(b"data: {nonsense\n\ndata: [DONE]\n\n", last=True)
    assert out == [answers.BROKEN, answers.DONE]


def run(spark, stream, path, mode="append"):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    q = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{path}/out")


def test_answers_as_a_stream(spark, tmp_path):
    data, r, rows = events(), random.Random(1), []
    for s in range(3):
        at, seq = 0, 0
        while at < len(data):
            n = r.randrange(1, 40)
            rows.append((f"s{s}", seq, bytearray(data[at : at + n]), at + n >= len(data)))
            at, seq = at + n, seq + 1
    schema = "session_id string, seq int, chunk binary, last boolean"
    half = len(rows) // 2
    rows.sort(key=lambda x: x[1])
    for part in (rows[:half], rows[half:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    allowed = [(f"s{s}", t, f, f[0]) for s in (0, 1) for t, f in FORMS.items() if s == 0 or t[1] == "T"]
    allowed = spark.createDataFrame(allowed, "session_id string, token string, forms array<string>, value string")
    got = run(spark, answers.relay(stream, allowed), tmp_path).orderBy("session_id", "seq", "ord").collect()
    p, t = "zPABCDEFGH", "zTQQQQ2222"
    want = [("Клиент Иванов и Иванова, тел 79", '{"to": "79"}'), (f"Клиент {p} и {p}, тел 79", '{"to": "79"}'), (f"Клиент {p} и {p}, тел {t}", f'{{"to": "{t}"}}')]
    for s in range(3):  # each session sees its own codes only
        assert read([bytes(x.frame) for x in got if x.session_id == f"s{s}"]) == want[s]


def test_weekly_with_watermark(spark, tmp_path):
    rows = [("2024-01-01 10:00:00", "P", "x", 1), ("2024-01-07 23:00:00", "P", "x", 2), ("2024-01-08 00:00:00", "P", "x", 4), ("2024-02-20 00:00:00", "T", "y", 8)]
    df = spark.createDataFrame(rows, "t string, class string, action string, findings int").select(F.to_timestamp("t").alias("ts"), "class", "action", "findings")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    spark.createDataFrame([], df.schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    got = {(str(r.week.start.date()), r["class"]): (r.events, r.findings) for r in run(spark, answers.weekly(stream), tmp_path).collect()}
    assert got[("2024-01-01", "P")] == (2, 3) and got[("2024-01-08", "P")] == (1, 4)


def test_settings():
    assert trusted_clients("cursor=header:Cursor; cli=ua:*cli*")[1].patterns == ("*cli*",)
    assert trusted_clients('[{"channel": "crm", "key_fingerprint": "' + "a" * 64 + '"}]')[0].key_sha256 == "sha256:" + "a" * 64
    for bad in ("x", "telegram=header:t", f"a=key:{'a' * 40};b=key:{'a' * 40}", "{"):
        with pytest.raises(SettingsError):
            trusted_clients(bad)
    keys = [bytes([i]) * 32 for i in range(3)]
    Settings(*keys, allowed_channels=("web",))
    for wrong in ({"allowed_channels": ("sms",)}, {"unknown_client": "?"}):
        with pytest.raises(SettingsError):
            Settings(*keys, **wrong)
    with pytest.raises(SettingsError):
        Settings(keys[0], keys[0], keys[1])
    assert flag("yes # on") and not flag("0")


def test_prefix_lengths():
    assert relay.growing("abc z") == 1 and relay.growing("abc zP") == 2 and relay.growing("[[P-AB") == 6 and relay.growing("hello!") == 0


PERSONS = {"zPAAAAAAAA": "Иванов", "zPBBBBBBBB": "Пётр", "zPCCCCCCCC": "Олегович", "zPDDDDDDDD": "Анна"}
KEY = b"k" * 32


def known(*combos):
    return frozenset(forms.combo_digest([forms.identity_key(x) for x in c], KEY) for c in combos)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([*PERSONS, " ", "  ", "\n", " и ", ".", "[[T-ABCDEFGH2345]]", "zPAAAA-AAAA"]), max_size=9), st.integers(1, 9), st.sampled_from(["off", "audit", "enforce"]))
def test_guarded_stream_equals_whole(parts, size, mode):
    text = "".join(parts)
    guard = relay.Guard(mode, known(("Иванов", "Пётр"), ("Пётр", "Олегович"), ("Иванов", "Пётр", "Олегович")), KEY)
    form = lambda code, n: PERSONS.get(code)
    r = relay.Restorer(form, guard=guard)
    out = "".join(r.feed(text[i : i + size]) for i in range(0, len(text), size)) + r.feed("", last=True)
    whole = relay.Restorer(form, guard=guard)
    assert out == whole.feed(text, last=True) and r.incidents == whole.incidents


def test_guard_modes():
    guard = lambda mode: relay.Guard(mode, known(("Иванов", "Пётр"), ("Пётр", "Олегович")), KEY)
    show = lambda text, mode: relay.restored_whole(text, lambda code, n: PERSONS.get(code), guard(mode))
    a, b, c, d = PERSONS
    assert show(f"{a} {b}!", "enforce") == "Иванов Пётр!" and show(f"{b} {a}", "enforce") == "Пётр Иванов"
    assert show(f"{a} {d}", "enforce") == f"{a} {d}" and show(f"{a} {d}", "audit") == "Иванов Анна" and show(f"{a}, {d}", "enforce") == "Иванов, Анна"
    assert show(f"{a} {b} {c}", "enforce") == f"{a} {b} {c}"  # the pairs are known, the three together are not


def test_all_surfaces_in_pieces():
    have = {"[[P-ABCDEFGH2345]]": "Анна", "zTQQQQ2222": "79"}
    text = "⟦P-ABCDEFGH2345⟧ и P-ABCDEFGH2345, [[P-ABCDEFGH2345]]; zT QQQQ-2222!"
    for size in (1, 2, 5, 13):
        r = relay.Restorer(lambda code, n: have.get(code))
        assert "".join(r.feed(text[i : i + size]) for i in range(0, len(text), size)) + r.feed("", last=True) == "Анна и Анна, Анна; 79!"
