"""Person names: candidates, case forms by rule tables, identities, transliteration, and the decision cascade.

What is known of names comes as tables (``Knowledge``), any of which may be missing. Morphology is a table (word, is_name, is_common);
without it every word may be a name and none is known to be common.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.functions import arrow, codes, normalize, scan
from maskwright.functions.scan import NO_WORDS, Vocabulary

#: Spans of capitalised words in every choice of up to three neighbours, and of single lower-case words.
candidates = arrow.of_text(scan.name_candidates)
DIGEST = "pd:"
#: Kinds of names that declension rules know.
KINDS = ("lastname", "firstname", "middlename")
LEAST_ANCHOR = 4


def shapes(text: Column, words: Vocabulary = NO_WORDS) -> Column:
    """Names told by their shape alone: surname with given name or initials, but for words of the trade."""
    return arrow.of_text(lambda t: scan.name_shapes(t, words))(text)


def is_own_word(value: Column, words: Vocabulary) -> Column:
    """A word, value or phrase of the trade, which no name is."""
    low = F.lower(normalize.collapsed(value))
    out = low.isin(*sorted(words.values | words.service_objects)) | F.exists(F.split(low, " "), lambda w: w.isin(*sorted(words.terms)))
    for phrase in sorted(words.phrases):
        out = out | F.contains(low, F.lit(phrase))
    return out


def forms(names: DataFrame, rules: DataFrame, cases: int = 5) -> DataFrame:
    """(value, form, ord) of names (value, kind): the value, then its case forms.

    ``rules`` (kind, section, ord, gender, test, mods) is a small table of declension rules:
    exceptions match whole words, suffixes endings, the first in order counts; a modification
    drops as many letters as it has dashes and adds the rest, '.' keeps the word. Words between hyphens or
    blanks are declined each for itself and put together again. Only distinct words are declined, in one pass
    for each gender and one for none.
    """
    whole = names.select("value", "kind").distinct().withColumn("parts", F.split("value", r"(?<=[- ])|(?=[- ])"))
    each = whole.select("value", "kind", F.posexplode("parts").alias("at", "word"))
    words = each.select("word", "kind").distinct().withColumn("low", F.translate(F.lower("word"), "ё", "е"))
    passes = words.withColumn("pass", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).withColumn("case", F.explode(F.sequence(F.lit(0), F.lit(cases - 1))))
    gender = F.element_at(F.array(F.lit(""), F.lit("male"), F.lit("female")), F.col("pass") + 1)
    rule = F.broadcast(rules.select(F.col("kind").alias("r_kind"), "section", F.col("ord").alias("r_ord"), F.coalesce("gender", F.lit("")).alias("r_gender"), F.explode("test").alias("test"), "mods"))
    mod = F.coalesce(F.get("mods", F.col("case")), F.lit("."))
    fits = F.when(F.col("section") == "exceptions", F.col("low") == F.lower("test")).otherwise(F.col("low").endswith(F.lower("test")) & (mod != "."))
    applies = (gender == "") | F.col("r_gender").isin("", "androgynous") | (F.col("r_gender") == gender)
    met = passes.join(rule, (F.col("kind") == F.col("r_kind")) & fits & applies, "left")
    first = met.groupBy("word", "kind", "pass", "case").agg(F.min_by(mod, F.struct(F.when(F.col("section") == "exceptions", 0).otherwise(1), "r_ord")).alias("mod"))
    cut = F.length("mod") - F.length(F.replace("mod", F.lit("-"), F.lit("")))
    declined = F.when(F.coalesce("mod", F.lit(".")) == ".", F.col("word")).otherwise(F.concat(F.substring("word", F.lit(1), F.length("word") - cut), F.replace("mod", F.lit("-"), F.lit(""))))
    met = each.join(first.select("word", "kind", "pass", "case", declined.alias("part")), ["word", "kind"])
    found = met.groupBy("value", "kind", "pass", "case").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "part"))), lambda x: x["part"]), "").alias("form"))
    found = found.select("value", "form", (1 + F.col("pass") * cases + F.col("case")).alias("ord")).unionByName(whole.select("value", F.col("value").alias("form"), F.lit(0).alias("ord")))
    return found.groupBy("value", "form").agg(F.min("ord").alias("ord"))


def layer_bases(form_table: DataFrame) -> DataFrame:
    """(form, base) for forms (value, form) that one value of the layer has: declining the layer once makes the search an equi-join."""
    pairs = form_table.select(normalize.identity_key(F.col("form")).alias("form"), normalize.identity_key(F.col("value")).alias("base"))
    return pairs.groupBy("form").agg(F.min("base").alias("base"), F.count_distinct("base").alias("n")).where("n = 1").drop("n")


def transliterated(words: DataFrame, known: DataFrame) -> DataFrame:
    """Latin words (value) some Cyrillic spelling of which is known (value); only distinct words are spelled."""
    each = words.select("value").distinct().withColumn("k", F.explode(arrow.spellings(F.col("value"))))
    each = each.withColumn("k", normalize.identity_key(F.col("k")))
    return each.join(known.select(normalize.identity_key(F.col("value")).alias("k")).distinct(), "k", "left_semi").select("value").distinct()


ENDING = r"^.*(?:ов|ев|ин|ын|ий|ый|ая|ова|ева|ина|ович|евич|овна|евна)$"


def evidence(words: DataFrame, known: DataFrame, morphology: DataFrame | None = None) -> DataFrame:
    """Values in capitals (value) with admitted: known (of several words one that is no common word), or two of three signs:
    all words capital, one tagged as a name, one of four letters or more with a surname's ending."""
    each = words.select("value", F.explode(F.split("value", r"(?U)\s+")).alias("w")).withColumn("k", normalize.identity_key(F.col("w")))
    met = each.join(known.select(normalize.identity_key(F.col("value")).alias("k"), F.lit(True).alias("hit")).distinct(), "k", "left")
    met = _with_morphology(met, morphology)
    ending = (F.length("k") >= 4) & F.col("k").rlike(ENDING)
    sure = F.coalesce("hit", F.lit(False))
    signs = F.bool_and(F.col("w").rlike(r"^\p{Lu}")).cast("int") + F.bool_or("is_name").cast("int") + F.bool_or(ending).cast("int")
    confirmed = F.when(F.count(F.lit(1)) == 1, F.bool_or(sure)).otherwise(F.bool_or(sure & ~F.col("is_common")))
    return met.groupBy("value").agg(confirmed.alias("confirmed"), signs.alias("signs")).select("value", (F.col("confirmed") | (F.col("signs") >= 2)).alias("admitted"))


def _with_morphology(words: DataFrame, morphology: DataFrame | None) -> DataFrame:
    """``words`` (k) with is_name and is_common; a word that the table lacks may be a name and is not common."""
    if morphology is None:
        return words.withColumn("is_name", F.lit(True)).withColumn("is_common", F.lit(False))
    told = morphology.select(F.col("word").alias("k"), "is_name", "is_common").dropDuplicates(["k"])
    return words.join(told, "k", "left").withColumn("is_name", F.coalesce("is_name", F.lit(True))).withColumn("is_common", F.coalesce("is_common", F.lit(False)))


@dataclass(frozen=True)
class Knowledge:
    """Tables that say who is a client and what a name is; each may be missing.

    exact (value) and forms (form, base): readable names of clients and their case forms. digests (cls, digest) and
    form_digests (cls, form, base): the same, keyed. layer (value): names that anyone may have; layer_forms (form, base): their case
    forms. rules: declension rules. morphology (word, is_name, is_common). key: of the digests.
    """

    exact: DataFrame | None = None
    forms: DataFrame | None = None
    digests: DataFrame | None = None
    form_digests: DataFrame | None = None
    layer: DataFrame | None = None
    layer_forms: DataFrame | None = None
    rules: DataFrame | None = None
    morphology: DataFrame | None = None
    key: bytes = b""

    def digest_of(self, value: Column) -> Column:
        return codes.value_digest(F.lit("P"), value, self.key)


def _looked_up(rows: DataFrame, table: DataFrame | None, on: str, find: str, give: Column | str, name: str) -> DataFrame:
    """``rows`` with ``name``: what ``table`` gives for the row's ``on`` in its ``find``; null where there is no table or no entry."""
    if table is None:
        return rows.withColumn(name, F.lit(None).cast("string" if isinstance(give, str) else "boolean"))
    side = table.select(F.col(find).alias(on), (F.col(give) if isinstance(give, str) else give).alias(name)).dropDuplicates([on])
    return rows.join(side, on, "left")


def _digest_identity(words: DataFrame, k: Knowledge, on: str, name: str) -> DataFrame:
    """``words`` with ``name``: the keyed identity of the spelling in column ``on``: that of a known form first, else its own digest if known."""
    if k.digests is None:
        return words.withColumn(name, F.lit(None).cast("string")).withColumn(name + "_exact", F.lit(None).cast("boolean"))
    digest = f"_{name}"
    rows = words.withColumn(digest, k.digest_of(F.col(on)))
    people = k.digests.where("cls = 'P'")
    rows = _looked_up(rows, people, digest, "digest", F.lit(True), name + "_exact")
    rows = _looked_up(rows, None if k.form_digests is None else k.form_digests.where("cls = 'P'"), digest, "form", "base", f"_{name}_base")
    own = F.when(F.col(name + "_exact"), F.col(digest))
    return rows.withColumn(name, F.concat(F.lit(DIGEST), F.coalesce(f"_{name}_base", own))).drop(digest, f"_{name}_base")


def anchored(words: DataFrame, k: Knowledge) -> DataFrame:
    """(k, anchor): the one client that the dictionary knows under a readable spelling k, itself or any of its case forms.

    Forms that lead to several clients anchor none. Only Cyrillic words of four letters or more are declined.
    """
    if k.digests is None:
        return words.select("k").distinct().withColumn("anchor", F.lit(None).cast("string"))
    own = _digest_identity(words.select("k").distinct(), k, "k", "anchor").drop("anchor_exact")
    if k.rules is None:
        return own
    asked = own.where(F.col("anchor").isNull() & F.col("k").rlike(f"^[а-я]{{{LEAST_ANCHOR},}}$")).select(F.col("k").alias("value"))
    spelled = forms(asked.withColumn("kind", F.explode(F.array(*(F.lit(x) for x in KINDS)))), k.rules).where("form != value")
    met = _digest_identity(spelled.select("value", normalize.identity_key(F.col("form")).alias("f")), k, "f", "found").where("found is not null")
    one = met.groupBy("value").agg(F.min("found").alias("through"), F.count_distinct("found").alias("n")).where("n = 1")
    return own.join(one.select(F.col("value").alias("k"), "through"), "k", "left").select("k", F.coalesce("anchor", "through").alias("anchor"))


def identities(words: DataFrame, k: Knowledge) -> DataFrame:
    """``words`` (k, norm, single, ...) with identity and source, in this order: a client's name as it stands (exact), a case
    form of one (form), the keyed dictionary (digest), the base that the open layer gives (layer_base), the spelling itself (surface).
    The last two go by the dictionary's name for them where it has one. digest_exact tells a keyed value from a keyed form."""
    exact = None if k.exact is None else k.exact.select(normalize.identity_key(F.col("value")).alias("value"))
    rows = _looked_up(words, exact, "k", "value", F.lit(True), "is_exact")
    rows = _looked_up(rows, k.forms, "k", "form", "base", "form_base")
    rows = _digest_identity(rows, k, "norm", "digest")
    rows = _looked_up(rows, k.layer_forms, "k", "form", "base", "layer_base")
    layer = None if k.layer is None else k.layer.select(normalize.identity_key(F.col("value")).alias("value"))
    rows = _looked_up(rows, layer, "k", "value", F.lit(True), "in_layer")
    readable = F.coalesce("layer_base", F.when(F.col("single"), F.col("k")))
    rows = rows.withColumn("readable", readable)
    if k.digests is not None:
        asked = rows.where("is_exact is null and form_base is null and digest is null and readable is not null").select(F.col("readable").alias("k"))
        rows = rows.join(anchored(asked, k).withColumnRenamed("k", "readable"), "readable", "left")
    else:
        rows = rows.withColumn("anchor", F.lit(None).cast("string"))
    source = F.when(F.col("is_exact"), "exact").when(F.col("form_base").isNotNull(), "form").when(F.col("digest").isNotNull(), "digest").when(F.col("layer_base").isNotNull(), "layer_base").otherwise("surface")
    identity = F.when(F.col("is_exact"), F.col("k")).otherwise(F.coalesce("form_base", "digest", "anchor", "layer_base", "k"))
    return rows.withColumn("source", source).withColumn("identity", identity).drop("readable", "anchor")


def decide(asks: DataFrame, k: Knowledge) -> DataFrame:
    """Asks (kind, raw, norm, key, single, capital, context, latin, and any others) that are persons, with identity and source.

    Of candidates: a client's name or a form of one, in lower case only beside client words; a capitalised single word that the open layer
    has, or whose base it has, beside client words; a keyed form beside client words; a Latin spelling of a known name. A
    common word that the dictionary alone knows is vetoed, and what only the dictionary knows must look like a name. Names by
    shape and persons of table cells stand. Values in capitals need evidence. Only distinct spellings meet the tables.
    """
    people = asks.where("kind != 'number'")
    words = people.select(F.col("key").alias("k"), "norm", "single", "latin").distinct()
    rows = _with_morphology(identities(words, k), k.morphology)
    known_names = [t.select("value") for t in (k.exact, k.layer) if t is not None]
    known = known_names[0].unionByName(known_names[1]) if len(known_names) == 2 else known_names[0] if known_names else None
    if known is None:
        rows = rows.withColumn("spelled", F.lit(False))
    else:
        latin = transliterated(rows.where("latin and single").select(F.col("k").alias("value")), known)
        rows = rows.join(latin.select(F.col("value").alias("k"), F.lit(True).alias("spelled")), "k", "left")
    told = rows.select(F.col("k").alias("key"), "norm", "single", "latin", "identity", "source", "is_exact", "digest_exact", "layer_base", "in_layer", "is_name", "is_common", "spelled")
    met = people.join(told, ["key", "norm", "single", "latin"])
    yes = lambda x: F.coalesce(x, F.lit(False))
    client = yes(F.col("is_exact")) | yes(F.col("digest_exact")) | (F.col("source") == "form")
    known_here = client & (F.col("capital") | F.col("context"))
    by_layer = ~known_here & F.col("single") & F.col("capital") & F.col("context") & (yes(F.col("in_layer")) | F.col("layer_base").isNotNull())
    by_digest = ~known_here & ~by_layer & (F.col("source") == "digest") & F.col("context")
    by_spelling = F.col("capital") & F.col("latin") & yes(F.col("spelled"))
    common = F.col("single") & F.col("source").isin("exact", "form", "digest") & ~by_layer & F.col("is_common") & ~yes(F.col("in_layer"))
    looks = ~F.col("single") | F.col("latin") & F.col("capital") | F.when(F.lit(k.morphology is not None), F.col("is_name")).otherwise(F.lit(True)) & F.col("key").rlike("^[а-я-]{4,25}$")
    is_name = (known_here | by_layer | by_digest | by_spelling) & ~common & (by_layer | looks)
    capitals = people.where("kind = 'caps'").select(F.col("raw").alias("value")).distinct()
    admitted = evidence(capitals, capitals.limit(0) if known is None else known, k.morphology)
    met = met.join(admitted.withColumnRenamed("value", "raw"), "raw", "left")
    good = F.when(F.col("kind").isin("shape", "cell"), F.lit(True)).when(F.col("kind") == "caps", yes(F.col("admitted"))).otherwise(is_name)
    return met.where(good).select(*asks.columns, "identity", "source")
