"""Requests and answers as tables: channels named in them, aligned leaves, images, answers restored, blocks and alerts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.functions import spans as S

from maskwright.session import settled

from . import detect, gate, payload, policy, registry

# Where a request names its channel.
MARKER = r"\[\[delivery:([a-zA-Z0-9_-]{1,32})\]\]"
ORIGIN = r'(?s)Gateway message origin.{0,160}?"platform"\s*:\s*"([a-zA-Z0-9_-]{1,32})"'
BLOCKING = ("request_blocked", "channel_blocked", "stream_error")


def payload_channel(messages: DataFrame, allowed: list[str]) -> DataFrame:
    """(req_id, channel) of messages (req_id, ord, role, text): the first marker in a system text or the last
    origin in any, and of two the stricter: the origin unless it is allowed, then the marker."""
    declared = F.when(F.col("role") == "system", F.nullif(F.regexp_extract("text", MARKER, 1), F.lit("")))
    origin = F.nullif(F.regexp_extract("text", ORIGIN, 1), F.lit(""))
    per = messages.groupBy("req_id").agg(
        F.lower(F.min_by(declared, F.when(declared.isNotNull(), F.col("ord")))).alias("declared"), F.lower(F.max_by(origin, F.when(origin.isNotNull(), F.col("ord")))).alias("origin")
    )
    ok = F.col("origin").isin(*[a.strip().lower() for a in allowed]) if allowed else F.lit(False)
    return per.select("req_id", F.when(F.col("declared").isNull(), F.col("origin")).when(F.col("origin").isNotNull() & ~ok, F.col("origin")).otherwise(F.col("declared")).alias("channel"))


def aligned(original: DataFrame, outgoing: DataFrame) -> DataFrame:
    """Text leaves of two versions of a body side by side, by their order; what one has beyond the other is left out."""
    a = original.select("req_id", "ord", F.col("text").alias("original"))
    return a.join(outgoing.select("req_id", "ord", F.col("text").alias("outgoing")), ["req_id", "ord"])


def body_verdicts(original: DataFrame, outgoing: DataFrame, detector: Callable[[Column], Column] = detect.rules) -> DataFrame:
    """The gate's verdict for each request: equal pairs of leaves are judged once."""
    pairs = aligned(original, outgoing)
    distinct = pairs.select("original", "outgoing").distinct().withColumn("spans", detector(F.col("original")))
    judged = distinct.withColumn("survivors", gate.survivors(F.col("original"), F.col("spans"), F.col("outgoing"))).drop("spans")
    met = pairs.join(judged, ["original", "outgoing"])
    return gate.verdict(met.select("req_id", "original", "survivors"), ["req_id"])


def image_policy(messages: DataFrame, block: bool) -> DataFrame:
    """Per request: images in its messages' parts, and what becomes of it."""
    n = F.sum(F.size(F.filter("parts", lambda p: p["type"].isin(*payload.IMAGE_TYPES))))
    return messages.groupBy("req_id").agg(n.alias("images")).withColumn("action", F.when(F.col("images") == 0, "pass").otherwise("block" if block else "remind"))


def _restored_leaves(found: DataFrame, table: DataFrame, allowed: DataFrame) -> DataFrame:
    """(req_id, path, text, number) of leaves (req_id, path, text, typed) whose codes were restored. Where ``typed``, a leaf
    that is one code of a telephone or client and becomes digits is a number."""
    found = found.withColumn("doc_id", F.concat_ws("#", "req_id", "path")).withColumn("spans", detect.code_spans(F.col("text")))
    spans = settled(found.select("doc_id", "req_id", "path", "text", "spans", "typed").where(F.size("spans") > 0))
    may = spans.select("doc_id", "req_id").join(allowed, "req_id").select("doc_id", "token")
    done = registry.restore(spans.select("doc_id", "text", "spans"), table, may).where("replaced > 0").join(spans.select("doc_id", "req_id", "path", "text", "spans", "typed"), "doc_id")
    one = F.get("spans", F.lit(0))
    alone = (F.size("spans") == 1) & (F.length(F.trim("text")) == one["end"] - one["start"]) & one["cls"].isin("T", "C")
    return done.select("req_id", "path", F.col("restored").alias("text"), (F.col("typed") & alone & F.col("restored").rlike("^[0-9]{1,18}$")).alias("number"))


def restored_arguments(calls: DataFrame, table: DataFrame, allowed: DataFrame) -> DataFrame:
    """calls (req_id, body) of tool calls with the codes in their leaves restored: a leaf that is one code becomes the
    value itself, digits of telephones and clients as numbers; codes within longer texts are restored in place."""
    found = payload.leaves(calls).where("text is not null").withColumn("typed", F.lit(True))
    return payload.put_back(calls, _restored_leaves(found, table, allowed))


# Where an answer holds texts and the arguments of its tool calls.
CONTENT = r'^\$\."choices"\[\d+\]\."message"\."(?:content|reasoning_content)"'
ARGUMENTS = r'^\$\."choices"\[\d+\]\."message"\."tool_calls"\[\d+\]\."function"\."arguments"'


def restored_response(responses: DataFrame, table: DataFrame, allowed: DataFrame) -> DataFrame:
    """responses (req_id, body, decision) with codes restored: the arguments of tool calls always, the contents of messages (a
    text, or parts with texts) only where the channel's ``decision`` is to restore. Other leaves stay."""
    found = payload.leaves(responses.drop("decision")).where("text is not null").join(responses.select("req_id", "decision"), "req_id")
    tool = F.col("path").rlike(ARGUMENTS)
    text = F.col("path").rlike(CONTENT) & (F.col("decision") == policy.RESTORE) & ~F.col("path").endswith('."type"')
    chosen = found.where(tool | text).withColumn("typed", tool)
    return payload.put_back(responses, _restored_leaves(chosen, table, allowed))


def alerts(audit: DataFrame) -> DataFrame:
    """Audit events that someone should hear of."""
    return audit.where(F.col("action").isin(*BLOCKING)).select("ts", "session_id", "action", "channel", "reason")


Annotator = Callable[[list[str]], list[list[tuple[int, int, str]]]]


def annotated(texts: DataFrame, annotator: Callable[[], Annotator], cls: str = "P") -> DataFrame:
    """(doc_id, spans, failed) by a model: ``annotator`` is made once a task and given batches of texts.

    A model that fails on a batch finds nothing there, as the other detectors still stand; ``failed`` says so
    of each of its texts, so that a dead model doesn't look like clean texts.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find = annotator()
        for b in batches:
            whole = [t or "" for t in b["text"]]
            failed = False
            try:
                found = find(whole)
            except Exception:  # whatever a model raises
                found, failed = [[] for _ in whole], True
            spans = [[{"start": a, "end": e, "cls": cls, "raw": t[a:e], "norm": t[a:e].lower(), "suffix": label, "src": 20, "ord": i} for i, (a, e, label) in enumerate(f)] for t, f in zip(whole, found, strict=True)]
            yield pd.DataFrame({"doc_id": b["doc_id"], "spans": spans, "failed": failed})

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, spans array<{S.SPAN}>, failed boolean")


def label_counts(found: DataFrame) -> DataFrame:
    """How often each label and value was annotated."""
    each = found.select(F.explode_outer("spans").alias("s")).where("s is not null")
    return each.groupBy(F.col("s.suffix").alias("label"), F.col("s.norm").alias("value")).agg(F.count(F.lit(1)).alias("n"))


def register_sql(spark: SparkSession, key: bytes) -> None:
    """The expressions as SQL functions, which the analyzer inlines: norm_phone, norm_email, norm_name, digits_of, is_code_text, cut_code."""
    import maskwright.functions.codes as c
    import maskwright.functions.normalize as n

    for name, f in {"norm_phone": n.phone, "norm_email": n.email, "norm_name": n.name, "digits_of": n.digits, "is_code_text": c.is_code, "cut_code": c.cut_truncated}.items():
        sql = _sql_of(spark, f)
        spark.sql(f"create or replace temporary function {name}(x string) return {sql}")


def _sql_of(spark: SparkSession, f: Callable[[Column], Column]) -> str:
    """An expression over x as SQL text."""
    plan = spark.sql("select cast(null as string) as x").select(f(F.col("x")).alias("r"))._jdf.queryExecution().analyzed()
    e = plan.expressions().head().children().head()
    return e.sql().replace("__auto_generated_subquery_name.", "")


def request_log(spark: SparkSession, path: str, routes: tuple[str, ...]) -> DataFrame:
    """(req_id, route, path, headers, body, status) of request logs, one JSON object a line: 404 for an unknown route, 400 where the body is no JSON object."""
    raw = spark.read.schema("req_id string, route string, path string, headers map<string,string>, body string").json(path)
    is_object = F.coalesce(F.schema_of_variant(F.try_parse_json("body")).startswith("OBJECT"), F.lit(False))
    return raw.withColumn("status", F.when(~F.col("route").isin(*routes), 404).when(~is_object, 400).otherwise(200))


def exchanged(outgoing: DataFrame, answers: DataFrame) -> DataFrame:
    """outgoing (req_id, body) with what the provider said (req_id, status, answer): answer, and error by kind where there is none."""
    met = outgoing.join(answers, "req_id", "left")
    is_object = F.coalesce(F.schema_of_variant(F.try_parse_json("answer")).startswith("OBJECT"), F.lit(False))
    error = F.when(F.col("status").isNull(), "timeout").when(F.col("status").isin(401, 403), "not_authorised").when(F.col("status") >= 500, "provider_failed").when(F.col("status") >= 400, "refused").when(~is_object, "no_json")
    return met.withColumn("error", error).withColumn("answer", F.when(error.isNull(), F.col("answer")))
