"""Measures of the engine and of what it lets out: k-anonymity, attacks, quality, journals, history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwright.functions import normalize


def groups(records: DataFrame, quasi: list[str]) -> DataFrame:
    """Sizes of the groups that agree in all quasi-identifiers; missing values count as one."""
    return records.groupBy(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in quasi)).agg(F.count(F.lit(1)).alias("n"))


def k_anonymity(records: DataFrame, quasi: list[str], k: int = 5) -> DataFrame:
    """One row: groups, groups below k, single records, and the share of groups below k."""
    return groups(records, quasi).agg(
        F.count(F.lit(1)).alias("groups"), F.count_if(F.col("n") < k).alias("below_k"), F.count_if(F.col("n") == 1).alias("singled_out"),
        (F.count_if(F.col("n") < k) / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("k_share"),
    )


def present(value: Column, text: Column) -> Column:
    """The value stands in the text with no letter or digit touching it; values under three characters don't count."""
    quoted = F.regexp_replace(value, r"([^\p{L}\p{N}])", r"\\$1")
    edge = r"[А-Яа-яЁёA-Za-z0-9]"
    return (F.length(F.trim(value)) >= 3) & F.regexp_like(text, F.concat(F.lit(f"(?<!{edge})"), quoted, F.lit(f"(?!{edge})")))


def direct_lookup(records: DataFrame, fields: dict[str, str], outgoing: str = "outgoing") -> DataFrame:
    """Per field: attempts to find each record's own values (or their canonical form) in its outgoing text, and successes."""
    each = F.array(*(F.struct(F.lit(f).alias("field"), F.lit(c).alias("cls"), F.col(f).cast("string").alias("value")) for f, c in fields.items()))
    rows = records.select(F.explode(each).alias("x"), F.col(outgoing).alias("text")).select("x.*", "text").where("value is not null and value != ''")
    norm = normalize.normalize(F.col("cls"), F.col("value"))
    hit = present(F.col("value"), F.col("text")) | F.coalesce(present(norm, F.lower("text")), F.lit(False))
    return rows.withColumn("hit", hit).groupBy("field").agg(F.count(F.lit(1)).alias("attempts"), F.count_if("hit").alias("successes"))


def linkage(values: DataFrame, dictionary: DataFrame) -> DataFrame:
    """One row: values (value) of at least three characters whose text or plain SHA-256 the dictionary (entry) holds."""
    asked = values.where(F.length(F.trim("value")) >= 3).where(~F.contains("value", F.lit("_"))).withColumn("sha", F.sha2(F.trim("value"), 256)).withColumn("v", F.trim("value"))
    entries = dictionary.select(F.col("entry").alias("v")).distinct().withColumn("plain", F.lit(1))
    hashes = dictionary.select(F.col("entry").alias("sha")).distinct().withColumn("hashed", F.lit(1))
    met = asked.join(entries, "v", "left").join(hashes, "sha", "left")
    return met.agg(F.count(F.lit(1)).alias("attempts"), F.count_if(F.col("plain").isNotNull() | F.col("hashed").isNotNull()).alias("successes"))


def recall(sample: DataFrame) -> DataFrame:
    """sample (kind, value, outgoing): share of values no longer present."""
    return sample.agg(F.count(F.lit(1)).alias("values"), F.avg((~present(F.col("value"), F.col("outgoing"))).cast("int")).alias("recall"))


def consistency(observed: DataFrame) -> DataFrame:
    """observed (value, code): values, and the share with exactly one distinct code; none is inconsistent."""
    per = observed.groupBy("value").agg(F.count_distinct("code").alias("n"))
    return per.agg(F.count(F.lit(1)).alias("values"), F.avg((F.col("n") == 1).cast("int")).alias("ph_consistency"))


def verdicts(metrics: DataFrame) -> DataFrame:
    """metrics (name, value, bar) with passed: a bar of 0 is a ceiling, any other a floor."""
    return metrics.withColumn("passed", F.when(F.col("bar").isNull(), True).when(F.col("bar") == 0, F.col("value") <= 0).otherwise(F.col("value") >= F.col("bar")))


def sufficiency(n: Column, length: int, alphabet: int = 32, target: float = 0.001) -> Column:
    """struct(space, collision, accidental, capacity): birthday bound of n values among the codes of a length."""
    space = float(alphabet) ** length
    import math

    return F.struct(
        F.lit(space).alias("space"), (1 - F.exp(-n * n / (2 * space))).alias("collision"), (n / space).alias("accidental"),
        F.lit(float(int(math.sqrt(-2 * space * math.log(1 - target))))).alias("capacity"),
    )


def week_key(ts: Column) -> Column:
    """ISO week as YYYY-WW."""
    return F.concat(F.extract(F.lit("yearofweek"), ts).cast("string"), F.lit("-"), F.lpad(F.weekofyear(ts).cast("string"), 2, "0"))


def rollup(events: DataFrame, by: list[str]) -> DataFrame:
    """Counts and sums of incidents by each of ``by`` and in all, in one pass."""
    sets = [[c] for c in by] + [[]]
    return events.groupingSets(sets, *by).agg(F.count(F.lit(1)).alias("events"), F.sum("findings").alias("findings")).select(*by, "events", "findings")


def sessions_between(events: DataFrame, since: Column, until: Column) -> DataFrame:
    return events.where((F.col("ts") >= since) & (F.col("ts") < until)).agg(F.count_distinct("session_id").alias("sessions"))


def is_valid(event: dict[str, Column]) -> Column:
    """Whether an event's fields are of the closed kind, so that no free text can carry a value into the journal."""
    word = r"^[a-z0-9_\-]{0,32}$"
    return F.coalesce(event["action"].rlike(word) & event["channel"].rlike(word) & event["cls"].rlike(r"^[PTEDAIC\-]$"), F.lit(False))


def valid_events(events: DataFrame) -> DataFrame:
    """Events that may be written."""
    return events.where(is_valid({c: F.col(c) for c in ("action", "channel", "cls")}))


def refused_events(events: DataFrame) -> DataFrame:
    """One row: events, and how many of them must not be written. A writer of an audit stops where there are any."""
    return events.agg(F.count(F.lit(1)).alias("events"), F.count_if(~is_valid({c: F.col(c) for c in ("action", "channel", "cls")})).alias("refused"))


def journal_check(events: DataFrame, fields: list[str]) -> DataFrame:
    """(field, filled, longest_digits): how many events fill each field, and the longest run of digits in any, which shows a value that slipped in."""
    runs = lambda c: F.coalesce(F.array_max(F.transform(F.regexp_extract_all(F.col(c).cast("string"), F.lit("[0-9]+"), F.lit(0)), lambda x: F.length(x))), F.lit(0))
    each = F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).isNotNull().alias("filled"), F.coalesce(runs(c), F.lit(0)).alias("digits")) for c in fields))
    return events.select(F.explode(each).alias("x")).groupBy("x.field").agg(F.count_if("x.filled").alias("filled"), F.max("x.digits").alias("longest_digits"))


def snapshot(events: DataFrame) -> DataFrame:
    """(kind, name, events, counted) of an audit by action and by class, in one pass."""
    sets = events.groupingSets([["action"], ["cls"]], "action", "cls").agg(F.grouping("action").alias("by_cls"), F.count(F.lit(1)).alias("events"), F.sum("count").alias("counted"))
    return sets.select(F.when(F.col("by_cls") == 1, "class").otherwise("action").alias("kind"), F.coalesce("action", "cls").alias("name"), "events", "counted")


def false_blocks(verdicts: DataFrame) -> DataFrame:
    """One row: clean texts (doc_id, clean) that the gate was asked about, and how many it would have blocked."""
    return verdicts.agg(F.count(F.lit(1)).alias("texts"), F.count_if(~F.col("clean")).alias("blocked"))


def reversibility(forms: DataFrame, corpus: DataFrame) -> DataFrame:
    """One row: forms (doc_id, form) of the values that went into each text, and how many can be read in what went out (doc_id, outgoing)."""
    met = forms.join(corpus, "doc_id")
    return met.agg(F.count(F.lit(1)).alias("forms"), F.count_if(present(F.col("form"), F.col("outgoing"))).alias("readable"))


def glue(persons: DataFrame) -> DataFrame:
    """One row from persons (code, person) as answers showed them: codes, codes shown as more than one person (glued), and persons with several codes (split)."""
    by_code = persons.groupBy("code").agg(F.count_distinct("person").alias("n")).agg(F.count(F.lit(1)).alias("codes"), F.count_if(F.col("n") > 1).alias("glued"))
    by_person = persons.groupBy("person").agg(F.count_distinct("code").alias("n")).agg(F.count_if(F.col("n") > 1).alias("split"))
    return by_code.join(by_person, F.lit(True))


def rep_rate(forms: DataFrame) -> DataFrame:
    """One row from forms (ord: 0 is the base, masked: boolean): forms, the share of them that is replaced, and misses of bases and of declined forms."""
    miss = ~F.col("masked")
    return forms.agg(
        F.count(F.lit(1)).alias("forms"), F.avg(F.col("masked").cast("int")).alias("rep_rate"), F.count_if(miss & (F.col("ord") == 0)).alias("base_missed"), F.count_if(miss & (F.col("ord") > 0)).alias("declined_missed")
    )


def scored_answers(truth: DataFrame, answers: DataFrame) -> DataFrame:
    """(name, n, said, right): counts (name, n) against the last number in what was answered (name, answer)."""
    said = F.element_at(F.regexp_extract_all("answer", F.lit("[0-9]+"), F.lit(0)), -1)
    return truth.join(answers.select("name", F.when(F.size(F.regexp_extract_all("answer", F.lit("[0-9]+"), F.lit(0))) > 0, said).cast("long").alias("said")), "name", "left").withColumn("right", F.coalesce(F.col("said") == F.col("n"), F.lit(False)))


def replay_report(runs: DataFrame) -> DataFrame:
    """(run, cls, findings, residual, clean): what a replay of requests (run, cls, findings, residual) found and left, by class and in all (cls null)."""
    out = runs.groupingSets([["run", "cls"], ["run"]], "run", "cls").agg(F.sum("findings").alias("findings"), F.sum("residual").alias("residual"))
    return out.select("run", "cls", "findings", "residual", (F.col("residual") == 0).alias("clean"))


def reidentification(attacks: list[DataFrame], single: DataFrame) -> DataFrame:
    """(attack, attempts, successes, verdict): attacks (attack, attempts, successes) together; singling out is reported, but never counts as a success."""
    every = attacks[0]
    for a in attacks[1:]:
        every = every.unionByName(a)
    told = single.select(F.lit("singling_out").alias("attack"), "attempts", F.lit(0).cast("long").alias("successes"))
    return every.unionByName(told).withColumn("verdict", F.when(F.col("successes") == 0, "held").otherwise("broken"))


def evidence_report(policy: DataFrame, journal: DataFrame, reid: DataFrame) -> DataFrame:
    """(section, item, value) of one report: the channels' decisions (name, value), the journal's check (field, longest_digits), and the attacks (attack, verdict)."""
    rows = policy.select(F.lit("policy").alias("section"), F.col("name").alias("item"), F.col("value").cast("string").alias("value"))
    rows = rows.unionByName(journal.select(F.lit("journal").alias("section"), F.col("field").alias("item"), F.col("longest_digits").cast("string").alias("value")))
    return rows.unionByName(reid.select(F.lit("reidentification").alias("section"), F.col("attack").alias("item"), F.col("verdict").alias("value")))


FORMATS = ("raw", "compact", "framed", "brackets", "bare")


def code_price(values: DataFrame, compact: Column, raw: Column, cost=F.length) -> DataFrame:
    """(format, cost, ratio) of each surface that a code may have against the value itself; ``cost`` counts what a text costs (characters, or a model's tokens)."""
    body = F.concat(F.substring(compact, 2, 1), F.lit("-"), F.substring(compact, 3, 8), F.lit("AAAA"))
    surface = {"raw": raw, "compact": compact, "framed": F.concat(F.lit("[["), body, F.lit("]]")), "brackets": F.concat(F.lit("⟦"), body, F.lit("⟧")), "bare": body}
    sums = values.agg(*(F.sum(cost(surface[f])).alias(f) for f in FORMATS))
    each = sums.select(F.explode(F.array(*(F.struct(F.lit(f).alias("format"), F.col(f).alias("cost"), F.round(F.col(f) / F.col("raw"), 6).alias("ratio")) for f in FORMATS))).alias("x"))
    return each.select("x.*")


def top_sessions(messages: DataFrame, sessions: int, per_session: int) -> DataFrame:
    """The last messages of the sessions that spoke last."""
    last = messages.groupBy("session_id").agg(F.max("ts").alias("last")).orderBy(F.desc("last"), "session_id").limit(sessions)
    w = Window.partitionBy("session_id").orderBy(F.desc("ts"))
    return messages.join(F.broadcast(last), "session_id").withColumn("r", F.row_number().over(w)).where(F.col("r") <= per_session)


def trailing(messages: DataFrame, window: int, step: int) -> DataFrame:
    """Every step-th user turn of a conversation with the window of messages up to it."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    upto = messages.withColumn("window", F.collect_list(F.struct("turn", "role")).over(w.rowsBetween(-(window - 1), 0)))
    asked = upto.withColumn("user_turn", F.when(F.col("role") == "user", F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(w)))
    return asked.where(F.col("user_turn").isNotNull() & (F.pmod(F.col("user_turn") - 1, F.lit(step)) == 0))


def prefix_stability(requests: DataFrame, text: str = "masked") -> DataFrame:
    """(conv_id, turn, messages, same, stable) of requests (conv_id, turn, ord, text): each turn sends the history so far.

    A message is compared with itself in the request before, so no history is built. same: messages from the start
    that did not change; stable: all that the request before had, which a provider's cache then serves.
    """
    before = F.lag(F.sha2(F.coalesce(text, F.lit("")), 256)).over(Window.partitionBy("conv_id", "ord").orderBy("turn"))
    each = requests.withColumn("before", before).withColumn("moved", F.col("before").isNotNull() & (F.col("before") != F.sha2(F.coalesce(text, F.lit("")), 256)))
    per = each.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("messages"), F.count("before").alias("had"), F.min(F.when(F.col("moved"), F.col("ord"))).alias("first_moved"), F.min("ord").alias("first"))
    same = F.when(F.col("first_moved").isNull(), F.col("had")).otherwise(F.col("first_moved") - F.col("first"))
    return per.select("conv_id", "turn", "messages", same.cast("long").alias("same"), F.col("first_moved").isNull().alias("stable"))


def cache_rate(usage: DataFrame) -> DataFrame:
    """One row of hits, misses and their rate; null where nothing was counted."""
    hit, miss = F.sum(F.coalesce("hit", F.lit(0))), F.sum(F.coalesce("miss", F.lit(0)))
    return usage.agg(hit.alias("hits"), miss.alias("misses"), (hit / F.nullif(hit + miss, F.lit(0))).alias("rate"))


def pii_share(requests: DataFrame) -> DataFrame:
    """requests (session_id, volume, findings): clean and dirty requests, their volume, and sessions that have both."""
    dirty = F.col("findings") > 0
    per = requests.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(dirty).alias("dirty"), F.sum("volume").alias("volume"), F.sum(F.when(dirty, F.col("volume")).otherwise(0)).alias("dirty_volume")
    )
    return per.agg(F.sum("n").alias("requests"), F.sum("dirty").alias("dirty"), F.sum("volume").alias("volume"), F.sum("dirty_volume").alias("dirty_volume"), F.count_if((F.col("dirty") > 0) & (F.col("dirty") < F.col("n"))).alias("mixed_sessions"))


def merged_pieces(pieces: DataFrame) -> DataFrame:
    """pieces (doc_id, start, end, label): touching ones joined, the first's label stays."""
    w = Window.partitionBy("doc_id").orderBy("start", "end")
    marked = pieces.withColumn("new", F.when(F.lag("end").over(w) == F.col("start"), 0).otherwise(1)).withColumn("run", F.sum("new").over(w))
    return marked.groupBy("doc_id", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("label", F.col("start")).alias("label")).drop("run")
