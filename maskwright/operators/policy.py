"""Who may see values: channel decisions, client identification, rarity, and the guard on joined name codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwright.functions import codes, normalize

# Channels that never see values, the name for all others, and words that ask for totals.
BLOCKED = ("telegram", "whatsapp", "viber", "sms", "email")
ALL = "*"
RESTORE, KEEP = "detokenize", "keep"
AGGREGATE_WORDS = r"(?iu)сколько|средн|статистик|распределен|итог|отчёт|отчет|сводк"


def channel_name(channel: Column) -> Column:
    return F.lower(F.trim(F.coalesce(channel, F.lit(""))))


def decide(channel: Column, allowed: list[str], restore_unknown: bool = False) -> Column:
    """Whether a channel's texts are restored: never blocked ones, ``*`` stands for all others; an unnamed
    client only where the mode says so and the policy allows all."""
    given = {a.strip().lower() for a in allowed if a}
    if given & set(BLOCKED):
        raise ValueError(f"channels that are never restored: {sorted(given & set(BLOCKED))}")
    name = channel_name(channel)
    known = F.lit(True) if ALL in given else name.isin(*sorted(given)) if given else F.lit(False)
    yes = ~name.isin(*BLOCKED) & known & ((name != "") | F.lit(restore_unknown and ALL in given))
    return F.when(yes, F.lit(RESTORE)).otherwise(F.lit(KEEP))


def fingerprint(presented: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(presented, 256))


def glob_pattern(glob: Column) -> Column:
    """A whole-string pattern for a glob of * and ?, in lower case."""
    quoted = F.regexp_replace(F.lower(glob), r"([^\p{L}\p{N}\s*?])", r"\\$1")
    return F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(quoted, r"\*", ".*"), r"\?", "."), F.lit("$"))


#: Clients that a table of settings may name, so that it is surely small enough to be sent to every task.
CLIENTS = 10_000


def identify(requests: DataFrame, clients: DataFrame) -> DataFrame:
    """requests (req_id, header, client_key, user_agent) with channel, source and detail.

    ``clients`` (ord, channel, header_value, key_sha256, patterns) is a table of settings, at most CLIENTS rows. A
    header names the channel; else a presented key must be known, and an unknown one ends
    the search; else the first client whose pattern fits the user agent. Only the agents'
    distinct values meet the patterns.
    """
    if clients.limit(CLIENTS + 1).count() > CLIENTS:
        raise ValueError(f"more than {CLIENTS} clients")
    clients = F.broadcast(clients)
    by_header = clients.select(F.lower(F.trim("header_value")).alias("named"), F.col("channel").alias("header_channel")).where("named is not null")
    by_key = clients.select(F.col("key_sha256").alias("fp"), F.col("channel").alias("key_channel")).where("fp is not null")
    globs = clients.select("ord", "channel", F.posexplode("patterns").alias("k", "glob")).withColumn("p", glob_pattern(F.col("glob")))
    agents = requests.select("user_agent").where(F.trim("user_agent") != "").distinct()
    fits = agents.join(globs, F.regexp_like(F.lower("user_agent"), F.col("p"))).groupBy("user_agent").agg(F.min_by("channel", F.struct("ord", "k")).alias("agent_channel"))
    r = requests.withColumn("named", channel_name(F.col("header"))).withColumn("fp", F.when(F.trim("client_key") != "", fingerprint(F.col("client_key"))))
    r = r.join(F.broadcast(by_header.dropDuplicates(["named"])), "named", "left").join(F.broadcast(by_key.dropDuplicates(["fp"])), "fp", "left").join(fits, "user_agent", "left")
    has_name, has_key = F.col("named") != "", F.col("fp").isNotNull()
    return r.select(
        "req_id",
        F.when(has_name, F.coalesce("header_channel", "named")).when(has_key, F.col("key_channel")).otherwise(F.col("agent_channel")).alias("channel"),
        F.when(has_name, "header").when(has_key & F.col("key_channel").isNotNull(), "key").when(~has_key & F.col("agent_channel").isNotNull(), "user_agent").otherwise("none").alias("source"),
        F.when(has_name, F.col("named")).when(has_key, F.when(F.col("key_channel").isNotNull(), F.col("fp")).otherwise("key_not_configured")).otherwise(F.coalesce("agent_channel", F.lit(""))).alias("detail"),
    )


def rarity(codes_of: DataFrame, texts: DataFrame, k: int = 5) -> DataFrame:
    """Per request: distinct person codes, and whether a question for totals is about fewer than k of them."""
    persons = codes_of.where("cls = 'P'").groupBy("req_id").agg(F.count_distinct("token").alias("persons"))
    asks = texts.groupBy("req_id").agg(F.bool_or(F.col("text").rlike(AGGREGATE_WORDS)).alias("asks"))
    n = F.coalesce("persons", F.lit(0))
    return asks.join(persons, "req_id", "left").select("req_id", n.alias("persons"), (F.col("asks") & n.between(1, k - 1)).alias("rare"))


def with_gaps(found: DataFrame) -> DataFrame:
    """found (doc_id, text, start, end, ...) with between: the text since the code before, empty at the first."""
    last = F.lag("end").over(Window.partitionBy("doc_id").orderBy("start"))
    return found.withColumn("between", F.when(last.isNull(), F.lit("")).otherwise(F.substring("text", last + 1, F.col("start") - last))).drop("text")


def name_runs(found: DataFrame, gap: int = 2) -> DataFrame:
    """found (doc_id, start, end, cls, token, between: text since the previous code) of person codes with
    run and place: codes stand in one run while at most ``gap`` white-space characters part them."""
    w = Window.partitionBy("doc_id").orderBy("start")
    near = (F.lag("cls").over(w) == "P") & (F.col("cls") == "P") & (F.col("start") - F.lag("end").over(w)).between(0, gap) & (F.trim(F.regexp_replace("between", r"(?U)\s", "")) == "")
    runs = found.withColumn("new", F.when(near, 0).otherwise(1)).withColumn("run", F.sum("new").over(w)).where("cls = 'P'")
    return runs.drop("new").withColumn("place", F.row_number().over(Window.partitionBy("doc_id", "run").orderBy("start")))


def refused(runs: DataFrame, combos: DataFrame, key: bytes) -> DataFrame:
    """(doc_id, start) of codes whose neighbouring pair, or whose run of three, no client has: they stay codes.

    ``runs`` has part, the stored value; ``combos`` (digest) is the index of known combinations.
    """
    w = Window.partitionBy("doc_id", "run").orderBy("place")
    size = F.count(F.lit(1)).over(Window.partitionBy("doc_id", "run"))
    name = normalize.identity_key(F.col("part"))
    seen = runs.withColumn("name", name).withColumn("n", size).withColumn("next", F.lead("name").over(w)).withColumn("third", F.lead("name", 2).over(w))
    pair = seen.where("next is not null").select("doc_id", "run", "place", F.lit(2).alias("width"), codes.combo_digest(F.array("name", "next"), key).alias("digest"))
    triple = seen.where("n = 3 and place = 1").select("doc_id", "run", "place", F.lit(3).alias("width"), codes.combo_digest(F.array("name", "next", "third"), key).alias("digest"))
    bad = pair.unionByName(triple).join(combos.select("digest").distinct(), "digest", "left_anti")
    places = bad.select("doc_id", "run", F.explode(F.sequence("place", F.col("place") + F.col("width") - 1)).alias("place")).distinct()
    return runs.join(places, ["doc_id", "run", "place"]).select("doc_id", "start")


def identity_report(requests: DataFrame, clients: DataFrame, allowed: list[str], restore_unknown: bool = False) -> DataFrame:
    """(req_id, channel, source, detail, decision, reason) of each request: who it was taken for, and why its answer is restored or not."""
    told = identify(requests, clients)
    decision = decide(F.col("channel"), allowed, restore_unknown)
    name = channel_name(F.col("channel"))
    reason = (
        F.when(name.isin(*BLOCKED), "channel_never_restored")
        .when((name == "") & (F.col("detail") == "key_not_configured"), "key_not_configured")
        .when((name == "") & (decision == RESTORE), "unknown_client_mode")
        .when(name == "", "client_unknown")
        .when(decision == RESTORE, F.concat(F.lit("allowed_by_"), F.col("source")))
        .otherwise("channel_not_allowed")
    )
    return told.withColumn("decision", decision).withColumn("reason", reason)
