"""The engine end to end: detect by all means, name identities, give codes, replace, check, and restore.

``detect`` asks rules, tables, the dictionary, names and a model, and merges what they find. ``protect`` gives each identity
a code that the registry holds for it alone, replaces every finding, then what is left of the values elsewhere in the text,
and passes the result through the gate. ``answer`` restores. Only spans and distinct spellings are joined; a text waits on its own
side until they come back, and is read twice: once to find, once to replace.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.functions import arrow, codes, normalize
from maskwright.functions import spans as S
from maskwright.functions.scan import NO_WORDS, Vocabulary
from maskwright.session import large, settled

from . import detect as detectors
from . import gate, names, payload, policy, registry

_SPAN_FIELDS = ("start", "end", "cls", "raw", "norm", "suffix", "src", "ord")


def _asked(asks: DataFrame, k: names.Knowledge) -> DataFrame:
    """(doc_id, span) of the asks that the tables admit: known numbers, and persons with their identity for norm."""
    people = names.decide(asks, k)
    found = people.select("doc_id", S.span(F.col("start"), F.col("end"), F.lit("P"), F.col("raw"), F.col("identity"), 12, F.col("ord")).withField("src", F.col("src")).alias("span"))
    if k.digests is None:
        return found
    runs = asks.where("kind = 'number'").withColumn("as_cls", F.explode(F.array(F.lit("C"), F.lit("I"))))
    runs = runs.withColumn("form", normalize.normalize(F.col("as_cls"), F.col("raw"))).withColumn("digest", codes.value_digest(F.col("as_cls"), F.col("form"), k.key))
    known = runs.join(k.digests.select(F.col("cls").alias("as_cls"), "digest").distinct(), ["as_cls", "digest"], "left_semi")
    first = known.groupBy("doc_id", "start", "end", "raw", "ord").agg(F.min_by(F.struct("as_cls", "form"), "as_cls").alias("x"))
    return found.unionByName(first.select("doc_id", S.span(F.col("start"), F.col("end"), F.col("x.as_cls"), F.col("raw"), F.col("x.form"), 11, F.col("ord")).alias("span")))


def detect(texts: DataFrame, k: names.Knowledge = names.Knowledge(), words: Vocabulary = NO_WORDS, annotated: DataFrame | None = None) -> DataFrame:
    """``texts`` (doc_id, text: one row an id) with spans: the merged findings of all detectors.

    norm holds the identity: canonical form, or what stands for a person. ``annotated`` (doc_id, spans) are a model's findings. Without ``Knowledge``
    rules, table cells and names by shape remain. Texts that are null or empty have no spans.
    """
    read = settled(texts.select("doc_id", arrow.scanned(F.col("text"), words).alias("s")))
    asks = read.select("doc_id", F.explode("s.asks").alias("a")).select("doc_id", "a.*")
    own = _asked(asks, k)
    if annotated is not None:
        own = own.unionByName(annotated.select("doc_id", F.explode("spans").alias("span")).select("doc_id", F.struct(*(F.col(f"span.{c}") for c in _SPAN_FIELDS)).alias("span")))
    per = own.groupBy("doc_id").agg(F.collect_list("span").alias("more"))
    spans = arrow.merged(F.col("s.found"), F.coalesce("more", S.none()))
    return large(texts).join(read.join(per, "doc_id", "left").select("doc_id", spans.alias("spans")), "doc_id")


@dataclass(frozen=True)
class Protected:
    """texts (doc_id, text, masked, spans, tokens, survivors), and the rows that the registry gains or moves on."""

    texts: DataFrame
    registry: DataFrame

    def counts(self) -> DataFrame:
        """(cls, findings, values, moved): replacements and distinct values by class, and codes that are not the first choice."""
        each = self.texts.select(F.explode(F.arrays_zip("spans", "tokens")).alias("x")).select(F.col("x.spans.cls").alias("cls"), F.col("x.tokens").alias("token"))
        rows = each.groupBy("cls").agg(F.count(F.lit(1)).alias("findings"), F.count_distinct("token").alias("values"))
        moved = self.registry.groupBy("cls").agg(F.count_if(F.col("salt") > 0).alias("moved"))
        return rows.join(moved, "cls", "left").select("cls", "findings", "values", F.coalesce("moved", F.lit(0)).alias("moved"))


def protect(texts: DataFrame, key: bytes, k: names.Knowledge = names.Knowledge(), words: Vocabulary = NO_WORDS, known: DataFrame | None = None, annotated: DataFrame | None = None, at: Column | None = None) -> Protected:
    """All findings of ``texts`` (doc_id, text) replaced by codes that ``known``, the registry so far, holds for them or is free to.

    The first to name an identity, by doc_id and place, decides its stored value; the first eight spellings are kept as forms.
    survivors are findings that can still be read after three repairs: a caller must not send such a text out.
    """
    found = settled(detect(texts, k, words, annotated).select("doc_id", "spans"))
    each = found.select("doc_id", F.posexplode("spans").alias("i", "s"))
    seen = F.struct("doc_id", F.col("s.start").alias("start"))
    values = each.select(F.col("s.cls").alias("cls"), F.col("s.norm").alias("identity"), F.trim("s.raw").alias("raw"), seen.alias("first_seen"))
    given = settled(registry.assign(values, key, known).select("cls", "identity", "token", "salt"))
    told = each.select("doc_id", "i", F.col("s.cls").alias("cls"), F.col("s.norm").alias("identity")).join(given, ["cls", "identity"])
    per = told.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "token"))), lambda x: x["token"]).alias("tokens"))
    rows = large(texts).join(found.join(per, "doc_id", "left").withColumn("tokens", F.coalesce("tokens", F.array().cast("array<string>"))), "doc_id")
    done = rows.withColumn("_done", arrow.finished(F.col("text"), F.col("spans"), F.col("tokens")))
    out = done.select("doc_id", "text", F.col("_done.text").alias("masked"), "spans", "tokens", F.transform("_done.left", lambda i: F.get("spans", i)).alias("survivors"))
    spelled = values.groupBy("cls", "identity", "raw").agg(F.min("first_seen").alias("first"))
    forms = F.transform(F.slice(F.array_sort(F.collect_list(F.struct("first", "raw"))), 1, registry.FORMS), lambda x: x["raw"])
    now = F.current_timestamp() if at is None else at
    delta = spelled.groupBy("cls", "identity").agg(F.min_by("raw", "first").alias("value"), forms.alias("forms")).join(given, ["cls", "identity"])
    delta = delta.select("token", "cls", "value", "identity", "forms", now.alias("created_at"), now.alias("last_used_at"), F.lit(None).cast("string").alias("source"), "salt")
    return Protected(out, delta)


def protect_bodies(bodies: DataFrame, key: bytes, k: names.Knowledge = names.Knowledge(), words: Vocabulary = NO_WORDS, known: DataFrame | None = None) -> tuple[DataFrame, Protected]:
    """(bodies (req_id, body) as they may go out, what was replaced): a dry run of a request, which nothing is sent by.

    Leaves whose key forces a class are replaced whole; the texts of all others are searched. JSON within strings is entered.
    """
    leaves = settled(payload.leaves(bodies).where("text is not null"))
    cls = payload.forced_class(F.col("name"), F.col("text"), F.col("tool"), F.col("contact"))
    leaves = leaves.withColumn("doc_id", F.concat_ws("\x1f", F.col("req_id").cast("string"), "path")).withColumn("cls", cls)
    form = F.when(F.col("cls") == "P", normalize.identity_key(F.col("text"))).otherwise(F.coalesce(normalize.normalize(F.col("cls"), F.col("text")), payload.fallback(F.col("cls"), F.col("text"))))
    forced = leaves.where("cls is not null and cls != 'D'").select("doc_id", F.array(S.span(F.lit(0), F.length("text"), F.col("cls"), F.col("text"), form, 0, F.lit(0))).alias("spans"))
    done = protect(leaves.select("doc_id", "text"), key, k, words, known, forced)
    changed = done.texts.where("masked != text").select("doc_id", F.col("masked").alias("new")).join(leaves.select("doc_id", "req_id", "path"), "doc_id")
    return payload.put_back(bodies, changed.select("req_id", "path", F.col("new").alias("text"))), done


GUARDS = ("off", "audit", "enforce")


@dataclass(frozen=True)
class Answered:
    """texts (doc_id, restored, replaced), and incidents (doc_id, start, token): codes whose combination no client has."""

    texts: DataFrame
    incidents: DataFrame


def answer(texts: DataFrame, known: DataFrame, allowed: DataFrame, guard: str = "off", combos: DataFrame | None = None, key: bytes = b"") -> Answered:
    """Codes of ``texts`` (doc_id, text) restored, as far as ``allowed`` (doc_id, token) and the guard let them.

    Neighbouring names whose pair, or whose run of three, ``combos`` (digest) lacks would make up a person: in mode audit they
    are told as incidents, in mode enforce they stay codes too. Without an index nothing is checked.
    """
    if guard not in GUARDS:
        raise ValueError(f"the guard is one of {GUARDS}")
    spotted = settled(texts.select("doc_id", "text", detectors.code_spans(F.col("text")).alias("spans")))
    none = spotted.sparkSession.createDataFrame([], "start int, token string").join(spotted.select("doc_id").limit(0))
    if guard == "off" or combos is None:
        return Answered(registry.restore(spotted, known, allowed), none.select("doc_id", "start", "token"))
    met = settled(registry.matched(spotted, known, allowed))
    each = spotted.select("doc_id", "text", F.explode("spans").alias("s")).select("doc_id", "text", F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.col("s.cls").alias("cls"))
    each = each.join(met.select("doc_id", "start", "token", "value"), ["doc_id", "start"])
    runs = policy.name_runs(policy.with_gaps(each)).withColumn("part", F.col("value"))
    bad = settled(policy.refused(runs, combos, key).join(met.select("doc_id", "start", "token"), ["doc_id", "start"]))
    return Answered(registry.restore(spotted, known, allowed, refused=bad if guard == "enforce" else None), bad)


def residual(masked: DataFrame, k: names.Knowledge = names.Knowledge(), words: Vocabulary = NO_WORDS) -> DataFrame:
    """(cls, findings): what all detectors still find in texts (doc_id, text) that went out, codes aside."""
    found = detect(masked, k, words)
    free = found.select(arrow.free(F.col("spans"), detectors.code_spans(F.col("text"))).alias("spans"))
    each = free.select(F.explode_outer("spans.cls").alias("cls")).where("cls is not null")
    return each.groupBy("cls").agg(F.count(F.lit(1)).alias("findings"))


def verdict(done: Protected) -> DataFrame:
    """Per text: clean, and for each class of survivors its count and up to three masked samples."""
    return gate.verdict(done.texts.select("doc_id", F.col("text").alias("original"), "survivors"), ["doc_id"])
