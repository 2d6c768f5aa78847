"""Queries on policy, history and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from maskwright.functions import codes, normalize
from maskwright.operators import analytics, detect, dictionary, policy, tokenise
from maskwright.session import table
from maskwright.sources import journals, sse
from maskwright.streaming.relay import relay

from .cards import CARD_TEXT, CARDS, KEY, cards, code_sql, digest_sql


def channel_policy(spark, sf):
    """Decisions for four channels under two policies."""
    c = cards(spark, sf)
    channel = F.element_at(F.array(F.lit(" Web "), F.lit("telegram"), F.lit(""), F.lit("crm")), (F.col("id") % 4 + 1).cast("int"))
    return c.select("id", policy.decide(channel, ["web"]).alias("listed"), policy.decide(channel, ["*"]).alias("any"), policy.decide(channel, ["*"], restore_unknown=True).alias("unknown"))


CHANNEL_SQL = """
select c_custkey as id, case c_custkey % 4 when 0 then 'detokenize' else 'keep' end as listed, case c_custkey % 4 when 0 then 'detokenize' when 3 then 'detokenize' else 'keep' end as "any",
    case c_custkey % 4 when 1 then 'keep' else 'detokenize' end as unknown from customer
"""


def client_identity(spark, sf):
    """Clients by header, key and user agent; a presented key that is not known ends the search."""
    clients = spark.createDataFrame(
        [(0, "cursor", "cursor-ide", None, ["*Cursor/*"]), (1, "cli", None, None, ["claude-cli/?.*", "*codex*"]), (2, "crm", None, "x", [])],
        "ord int, channel string, header_value string, key_sha256 string, patterns array<string>",
    ).withColumn("key_sha256", F.when(F.col("channel") == "crm", policy.fingerprint(F.lit("secret"))))
    pick = lambda *v: F.element_at(F.array(*(F.lit(x) for x in v)), (F.col("id") % 6 + 1).cast("int"))
    r = cards(spark, sf).select(F.col("id").alias("req_id"), pick("Cursor-IDE", "", "", "", "other", "").alias("header"), pick("", "secret", "wrong", "", "", "").alias("client_key"), pick("", "", "cursor/1", "app CURSOR/1.0", "", "curl").alias("user_agent"))
    return policy.identify(r, clients).select("req_id", "channel", "source")


IDENTITY_SQL = """
select c_custkey as req_id, case c_custkey % 6 when 0 then 'cursor' when 1 then 'crm' when 3 then 'cursor' when 4 then 'other' end as channel,
    case c_custkey % 6 when 0 then 'header' when 1 then 'key' when 3 then 'user_agent' when 4 then 'header' else 'none' end as source from customer
"""


def rarity_guard(spark, sf):
    """Questions for totals about fewer than five persons."""
    c = cards(spark, sf)
    req = (F.col("id") % F.greatest(F.lit(40), F.floor(F.col("id") / 4))).alias("req_id")
    found = c.select(req, F.lit("P").alias("cls"), F.concat("surname", "given").alias("token"))
    texts = c.select(req, F.when(F.col("id") % 3 == 0, F.lit("Сколько клиентов?")).otherwise(F.lit("привет")).alias("text"))
    return policy.rarity(found, texts)


RARITY_SQL = f"""
with c as (select id % greatest(40, floor(id / 4)::bigint) as req_id, * from ({CARDS}) x)
select req_id, count(distinct surname || given) as persons, bool_or(id % 3 = 0) and count(distinct surname || given) between 1 and 4 as rare from c group by req_id
"""


def combination_guard(spark, sf):
    """Neighbouring person codes whose combination no client has are refused; half the clients are known."""
    c = cards(spark, sf)
    parts = c.select(F.col("id").alias("doc_id"), F.posexplode(F.array("surname", "given")).alias("k", "part"))
    found = parts.select("doc_id", (F.col("k") * 11).alias("start"), (F.col("k") * 11 + 10).alias("end"), F.lit("P").alias("cls"), F.concat(F.lit("z"), F.col("k").cast("string")).alias("token"), F.when(F.col("doc_id") % 5 == 4, F.lit(",")).otherwise(F.lit(" ")).alias("between"), "part")
    known = dictionary.combos(c.where("surname < 'П'").select(F.array("surname", "given").alias("parts")), KEY)
    return policy.refused(policy.name_runs(found), known, KEY)


GUARD_SQL = f"select id as doc_id, unnest([0, 11]) as start from ({CARDS}) c where surname >= 'П' and id % 5 <> 4 and (surname, given) not in (select (surname, given) from ({CARDS}) d where surname < 'П')"


def sse_frames(spark, sf):
    """Frames of streamed answers put together from chunks of bytes, and their text."""
    c = cards(spark, sf).select(F.col("id").alias("session_id"), "surname", "given")
    chunks = sse.chunked(c, F.array("surname", F.lit(" "), "given"), 17)
    return sse.texts(sse.frames(chunks)).select("session_id", "text", "frames")


SSE_SQL = f"select id as session_id, surname || ' ' || given as text, 4 as frames from ({CARDS}) c"


def sse_single_frame(spark, sf):
    """Answers that were not streamed, sent as one frame."""
    c = cards(spark, sf)
    return c.select("id", sse.single_frame(F.col("email")).alias("frame"))


SINGLE_SQL = f"""select id, 'data: {{"choices":[{{"index":0,"delta":{{"role":"assistant","content":"' || email || '"}}}}]}}' || chr(10) || chr(10) || 'data: [DONE]' || chr(10) || chr(10) as frame from ({CARDS}) c"""


def stream_restore(spark, sf):
    """All cards' answers in pieces cut through their codes, restored by a stateful stream, each session by its own codes; a pair of
    names that no client has stays coded. Joined, the pieces equal the whole restored at once."""
    c = cards(spark, sf)
    p = lambda column: codes.code(F.lit("P"), normalize.identity_key(F.col(column)), KEY)
    t = codes.code(F.lit("T"), F.col("phone"), KEY)
    text = F.concat(F.lit("Клиент "), p("surname"), F.lit(" "), p("given"), F.lit(" звонит, "), t, F.lit("я."))
    size = 1 + F.col("id") % 7
    cut = F.transform(F.sequence(F.lit(0), F.ceil(F.length("text") / size) - 1), lambda i: F.substring("text", (i * size + 1).cast("int"), size.cast("int")))
    session = F.col("id").cast("string").alias("session_id")
    pieces = c.withColumn("text", text).select(session, F.posexplode(F.concat(cut, F.array(F.lit("")))).alias("seq", "delta"), (F.ceil(F.length("text") / size)).alias("n")).withColumn("done", F.col("seq") == F.col("n")).drop("n")
    one = lambda token, form: c.select(session, token.alias("token"), F.array(form).alias("forms"), F.col(form).alias("value"), "id")
    allowed = one(p("surname"), "surname").unionByName(one(p("given"), "given")).unionByName(one(t, "phone").where("id % 2 = 0")).drop("id")
    combos = dictionary.combos(c.where("surname < 'П'").select(F.array("surname", "given").alias("parts")), KEY)
    folder = journals.scratch(spark, "relay")
    pieces.write.parquet(f"{folder}/in")
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(pieces.schema).parquet(f"{folder}/in")
        q = relay(stream, allowed, "enforce", combos, KEY).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        if old is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    out = spark.read.schema("session_id string, seq int, restored string, status string, incidents int").parquet(f"{folder}/out")
    ordered = F.array_sort(F.collect_list(F.struct("seq", "restored")))
    return out.groupBy("session_id").agg(F.array_join(ordered["restored"], "").alias("text"), F.count_if(F.col("status") == "done").alias("ends"), F.sum("incidents").alias("incidents"))


_FOLDED = "replace(lower(given), 'ё', 'е')"
STREAM_SQL = f"""
select cast(id as varchar) as session_id, 'Клиент ' || case when surname < 'П' then surname || ' ' || given else {code_sql('P', 'lower(surname)')} || ' ' || {code_sql('P', _FOLDED)} end || ' звонит, '
    || case when id % 2 = 0 then phone else {code_sql('T', 'phone')} end || 'я.' as text, 1 as ends, case when surname < 'П' then 0 else 2 end as incidents
from ({CARDS}) c
"""


def incident_rollup(spark, sf):
    """Counts of events by type, by value's tens, and in all, in one pass."""
    e = table(spark, sf, "events").select("event_type", (F.col("user_id") % 3).alias("channel"), F.lit(1).alias("findings"))
    return analytics.rollup(e, ["event_type", "channel"])


ROLLUP_SQL = "select event_type, channel, count(*) as events, sum(findings)::bigint as findings from (select event_type, user_id % 3 as channel, 1 as findings from events) q group by grouping sets ((event_type), (channel), ())"


def week_keys(spark, sf):
    e = table(spark, sf, "events")
    return e.groupBy(analytics.week_key(F.col("ts")).alias("week")).agg(F.count(F.lit(1)).alias("events"), F.count_distinct("user_id").alias("sessions"))


WEEK_SQL = "select strftime(ts, '%G-%V') as week, count(*) as events, count(distinct user_id) as sessions from events group by 1"


def sessions_between(spark, sf):
    e = table(spark, sf, "events").select("ts", F.col("user_id").alias("session_id"))
    lo, hi = F.to_timestamp(F.lit("2024-01-05")), F.to_timestamp(F.lit("2024-01-20"))
    return analytics.sessions_between(e, lo, hi)


def valid_events(spark, sf):
    """Journal rows that keep to the closed fields; a value in a field keeps a row out."""
    e = table(spark, sf, "events").select("event_id", F.col("event_type").alias("action"), F.when(F.col("event_id") % 5 == 0, F.lit("Иванов")).otherwise(F.lit("web")).alias("channel"), F.substring(F.lit("PTX-"), (F.col("event_id") % 4 + 1).cast("int"), F.lit(1)).alias("cls"))
    return analytics.valid_events(e).select("event_id")


def journal_weeks(spark, sf):
    """Events written to a journal by ISO week and one week read back."""
    e = table(spark, sf, "events").select("event_id", "ts", F.col("event_type").alias("action"))
    path = journals.scratch(spark, "journal")
    journals.append(e, path)
    last = e.agg(F.max(analytics.week_key(F.col("ts")))).first()[0]
    return journals.read_week(spark, path, e.schema, last).select("event_id", "action")


JOURNAL_SQL = "select event_id, event_type as action from events where strftime(ts, '%G-%V') = (select max(strftime(ts, '%G-%V')) from events)"


def top_sessions(spark, sf):
    """The last five events of the users that were seen last."""
    e = table(spark, sf, "events").select(F.col("user_id").alias("session_id"), F.struct("ts", "event_id").alias("ts"), "event_id")
    return analytics.top_sessions(e, 7, 5).select("session_id", "event_id")


TOP_SQL = """
with l as (select user_id, max((ts, event_id)) as last from events group by user_id order by last desc, user_id limit 7)
select e.user_id as session_id, event_id from events e join l using (user_id) qualify row_number() over (partition by e.user_id order by ts desc, event_id desc) <= 5
"""


def trailing_window(spark, sf):
    """Every second user turn with the window of four messages up to it."""
    m = table(spark, sf, "conversations").dropDuplicates(["conv_id", "turn"])
    return analytics.trailing(m.select("conv_id", "turn", "role"), 4, 2).select("conv_id", "turn", F.size("window").alias("messages"), F.get("window", F.lit(0))["turn"].alias("first"))


TRAILING_SQL = """
with m as (select distinct conv_id, turn, role from conversations),
w as (select *, count(*) over (partition by conv_id order by turn rows between 3 preceding and current row) as messages, first_value(turn) over (partition by conv_id order by turn rows between 3 preceding and current row) as first,
    sum(case when role = 'user' then 1 else 0 end) over (partition by conv_id order by turn) as u from m)
select conv_id, turn, messages::int as messages, first from w where role = 'user' and (u - 1) % 2 = 0
"""


def prefix_stability(spark, sf):
    """Requests of growing conversations, coded anew each time: whether each starts with all that the one before it held. In every
    seventh conversation the third message is coded under another key from its fifth request on."""
    m = table(spark, sf, "conversations").groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    asked = m.select("conv_id", F.col("turn").alias("at")).join(m, "conv_id").where("turn <= at")
    text = F.concat(F.col("text"), F.lit(" client"), F.col("conv_id").cast("string"), F.lit("@example.ru"))
    read = asked.select("conv_id", F.col("at").alias("turn"), F.col("turn").alias("ord"), text.alias("text"))
    coded = lambda df, key: tokenise.tokenise(df, key, detector=detect.emails)
    other = (F.col("conv_id") % 7 == 0) & (F.col("ord") == 3) & (F.col("turn") >= 5)
    return analytics.prefix_stability(coded(read.where(~other), KEY).unionByName(coded(read.where(other), KEY[::-1])))


PREFIX_SQL = """
with m as (select distinct conv_id, turn from conversations), r as (select a.conv_id, a.turn, b.turn as ord from m a join m b on a.conv_id = b.conv_id and b.turn <= a.turn),
p as (select *, lag(turn) over (partition by conv_id, ord order by turn) as before from r),
x as (select *, before is not null and conv_id % 7 = 0 and ord = 3 and turn >= 5 and before < 5 as moved from p)
select conv_id, turn, count(*) as messages, (case when bool_or(moved) then min(ord) filter (moved) - min(ord) else count(before) end)::bigint as same, not bool_or(moved) as stable from x group by 1, 2
"""


def fixed_point(spark, sf):
    """Coded texts coded again stay as they are."""
    c = cards(spark, sf, f"id, {CARD_TEXT} as text")
    once = tokenise.tokenise(c, KEY).select("id", F.col("masked").alias("text"))
    return tokenise.tokenise(once, KEY).select("id", (F.col("masked") == F.col("text")).alias("same"), F.size("spans").alias("found"))


def identity_report(spark, sf):
    """Who each request was taken for, and why its answer is restored or not."""
    clients = spark.createDataFrame([(0, "cursor", "cursor-ide", None, ["*Cursor/*"]), (1, "crm", None, "x", [])], "ord int, channel string, header_value string, key_sha256 string, patterns array<string>")
    clients = clients.withColumn("key_sha256", F.when(F.col("channel") == "crm", policy.fingerprint(F.lit("secret"))))
    pick = lambda *v: F.element_at(F.array(*(F.lit(x) for x in v)), (F.col("id") % 5 + 1).cast("int"))
    r = cards(spark, sf).select(F.col("id").alias("req_id"), pick("Cursor-IDE", "", "", "", "telegram").alias("header"), pick("", "secret", "wrong", "", "").alias("client_key"), pick("", "", "cursor/1", "curl", "").alias("user_agent"))
    return policy.identity_report(r, clients, ["cursor"]).select("req_id", "channel", "decision", "reason")


REPORT_SQL = """
select c_custkey as req_id, case c_custkey % 5 when 0 then 'cursor' when 1 then 'crm' when 4 then 'telegram' end as channel, case when c_custkey % 5 = 0 then 'detokenize' else 'keep' end as decision,
    case c_custkey % 5 when 0 then 'allowed_by_header' when 1 then 'channel_not_allowed' when 2 then 'key_not_configured' when 3 then 'client_unknown' else 'channel_never_restored' end as reason from customer
"""


def audit_snapshot(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("action"), F.when(F.col("event_id") % 3 == 0, "P").otherwise("T").alias("cls"), (F.col("event_id") % 5).alias("count"))
    return analytics.snapshot(e)


SNAPSHOT_SQL = """
with e as (select event_type as action, case when event_id % 3 = 0 then 'P' else 'T' end as cls, event_id % 5 as n from events)
select 'action' as kind, action as name, count(*) as events, sum(n)::bigint as counted from e group by 2 union all select 'class', cls, count(*), sum(n)::bigint from e group by 2
"""


def journal_check(spark, sf):
    """Fields of a journal: how many are filled, and the longest run of digits in each."""
    return analytics.journal_check(table(spark, sf, "events"), ["event_type", "user_id", "props"])


CHECK_SQL = """
select 'event_type' as field, count(event_type) as filled, max(coalesce(list_max(list_transform(regexp_extract_all(event_type, '[0-9]+'), lambda x: length(x))), 0))::int as longest_digits from events
union all select 'user_id', count(user_id), max(length(cast(user_id as varchar)))::int from events
union all select 'props', count(props), max(coalesce(list_max(list_transform(regexp_extract_all(props, '[0-9]+'), lambda x: length(x))), 0))::int from events
"""


def combo_files(spark, sf):
    """A combination index written as a file and read back; other files are refused."""
    c = cards(spark, sf).select(F.array("surname", "given").alias("parts"))
    path = journals.scratch(spark, "combos")
    file = dictionary.combos(c, KEY).agg(F.lit(1).alias("schema"), F.lit(True).alias("keyed"), F.array_sort(F.collect_list("digest")).alias("combos"))
    file.coalesce(1).write.json(path)
    return journals.combo_index(spark, path)


COMBO_FILE_SQL = f"select distinct {digest_sql('P', "least(lower(surname), " + _FOLDED + ") || '|' || greatest(lower(surname), " + _FOLDED + ")")} as digest from ({CARDS}) c"


def evidence_report(spark, sf):
    """Policy, journal and attacks in one report."""
    c = cards(spark, sf)
    channels = spark.createDataFrame([("web",), ("telegram",)], "name string").withColumn("value", policy.decide(F.col("name"), ["*"]))
    attacks = c.agg(F.lit("direct").alias("attack"), F.count(F.lit(1)).alias("attempts"), F.count_if(F.col("id") < 0).alias("successes"))
    broken = c.agg(F.lit("linkage").alias("attack"), F.count(F.lit(1)).alias("attempts"), F.count_if(F.col("id") % 2 == 0).alias("successes"))
    single = analytics.groups(c, ["segment", "nation"]).agg(F.count(F.lit(1)).alias("attempts"))
    return analytics.evidence_report(channels, analytics.journal_check(table(spark, sf, "events"), ["event_type"]), analytics.reidentification([attacks, broken], single))


EVIDENCE_SQL = """
select * from (values ('policy', 'web', 'detokenize'), ('policy', 'telegram', 'keep'), ('reidentification', 'direct', 'held'), ('reidentification', 'linkage', 'broken'), ('reidentification', 'singling_out', 'held')) t(section, item, value)
union all select 'journal', 'event_type', cast(max(coalesce(list_max(list_transform(regexp_extract_all(event_type, '[0-9]+'), lambda x: length(x))), 0)) as varchar) from events
"""


QUERIES = [
    ("channel_policy", channel_policy, CHANNEL_SQL),
    ("client_identity", client_identity, IDENTITY_SQL),
    ("rarity_guard", rarity_guard, RARITY_SQL),
    ("combination_guard", combination_guard, GUARD_SQL),
    ("sse_frames", sse_frames, SSE_SQL),
    ("sse_single_frame", sse_single_frame, SINGLE_SQL),
    ("stream_restore", stream_restore, STREAM_SQL),
    ("incident_rollup", incident_rollup, ROLLUP_SQL),
    ("week_keys", week_keys, WEEK_SQL),
    ("sessions_between", sessions_between, "select count(distinct user_id) as sessions from events where ts >= '2024-01-05' and ts < '2024-01-20'"),
    ("valid_events", valid_events, "select event_id from events where event_id % 5 <> 0 and event_id % 4 <> 2"),
    ("journal_weeks", journal_weeks, JOURNAL_SQL),
    ("top_sessions", top_sessions, TOP_SQL),
    ("trailing_window", trailing_window, TRAILING_SQL),
    ("prefix_stability", prefix_stability, PREFIX_SQL),
    ("fixed_point", fixed_point, f"select id, true as same, 0 as found from ({CARDS}) c"),
    ("identity_report", identity_report, REPORT_SQL),
    ("audit_snapshot", audit_snapshot, SNAPSHOT_SQL),
    ("journal_check", journal_check, CHECK_SQL),
    ("combo_files", combo_files, COMBO_FILE_SQL),
    ("evidence_report", evidence_report, EVIDENCE_SQL),
]
