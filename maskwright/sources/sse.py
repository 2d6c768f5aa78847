"""Server-sent events as tables: chunks of bytes to frames to text, and answers to frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DONE = "data: [DONE]\n\n"


def delta_frame(text: Column) -> Column:
    body = F.to_json(F.struct(F.array(F.struct(F.lit(0).alias("index"), F.struct(text.alias("content")).alias("delta"))).alias("choices")))
    return F.concat(F.lit("data: "), body, F.lit("\n\n"))


def single_frame(text: Column) -> Column:
    """A whole answer as one frame and the end mark."""
    delta = F.struct(F.lit("assistant").alias("role"), text.alias("content"))
    body = F.to_json(F.struct(F.array(F.struct(F.lit(0).alias("index"), delta.alias("delta"))).alias("choices")))
    return F.concat(F.lit("data: "), body, F.lit("\n\n" + DONE))


def chunked(rows: DataFrame, texts: Column, size: int) -> DataFrame:
    """(session_id, seq, chunk): the frames of ``texts`` as bytes, cut every ``size`` bytes wherever that falls."""
    whole = F.encode(F.concat(F.array_join(F.transform(texts, delta_frame), ""), F.lit(DONE)), "UTF-8")
    cut = F.transform(F.sequence(F.lit(0), F.ceil(F.octet_length("b") / size).cast("int") - 1), lambda i: F.substring("b", i * size + 1, F.lit(size)))
    return rows.select("session_id", whole.alias("b")).select("session_id", F.posexplode(cut).alias("seq", "chunk"))


def frames(chunks: DataFrame) -> DataFrame:
    """(session_id, ord, frame) of chunks of bytes: a session's bytes are joined before they are read as text, so
    letters cut in two come out whole; frames end at a blank line, LF or CRLF, and the rest is the last frame."""
    joined = chunks.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("seq", "chunk"))).alias("c"))
    text = F.decode(F.unhex(F.array_join(F.transform("c", lambda x: F.hex(x["chunk"])), "")), "UTF-8")
    parts = F.filter(F.split(text, r"\r\n\r\n|\n\n", -1), lambda f: f != "")
    return joined.select("session_id", F.posexplode(parts).alias("ord", "frame"))


def texts(found: DataFrame) -> DataFrame:
    """(session_id, text, frames) of frames: the contents of their deltas in order; other frames count but say nothing."""
    body = F.regexp_extract("frame", r"(?s)^data:\s*(\{.*)$", 1)
    content = F.get_json_object(body, "$.choices[0].delta.content")
    w = F.array_sort(F.collect_list(F.struct("ord", F.coalesce(content, F.lit("")).alias("t"))))
    return found.groupBy("session_id").agg(F.array_join(w["t"], "").alias("text"), F.count(F.lit(1)).alias("frames"))
