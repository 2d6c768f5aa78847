"""The dictionary's weekly life: export from records, candidates from incidents, staged versions behind a check, provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.functions import codes, normalize
from maskwright.functions.scan import NO_WORDS, Vocabulary

from maskwright.session import settled

from . import dictionary, names

CARD = "struct<id:string,surname:string,name:string,patronymic:string,phone:string,email:string,birth_date:string,address:string,contacts:array<struct<contact_type:string,contact:string>>>"


def exported(cards: DataFrame, words: Vocabulary = NO_WORDS) -> DataFrame:
    """(cls, value, reason) of client records: names, telephones, mails, day and month of birth, addresses, numbers, and
    contacts by their type. Fields that hold nothing usable come with a reason and no class; values are distinct."""
    one = lambda cls, c: F.struct(F.lit(cls).alias("want"), F.col(c).alias("value"))
    named = F.struct(F.lit("P").alias("want"), F.concat_ws(" ", "surname", "name", "patronymic").alias("value"))
    birth = F.struct(F.lit("D").alias("want"), normalize.split_birth_date(F.col("birth_date"))["day_month"].alias("value"))
    kind = F.lower(F.trim("x.contact_type"))
    fields = F.array(one("P", "surname"), one("P", "name"), one("P", "patronymic"), named, one("T", "phone"), one("E", "email"), birth, one("A", "address"), one("C", "id"))
    rows = cards.select(F.explode(fields).alias("f")).select("f.*")
    contacts = cards.select(F.explode("contacts").alias("x")).select(F.when(kind.isin("email", "e-mail", "mail"), "E").when(kind.isin("phone", "mobile", "mobile_phone", "whatsapp", "telegram", "viber"), "T").alias("want"), F.col("x.contact").alias("value"))
    every = rows.unionByName(contacts.where("want is not null"))
    f = dictionary.classify_field(F.col("value"))
    by_form = F.when(F.col("want") == "D", F.col("value")).otherwise(normalize.normalize(F.col("want"), F.col("value")))
    reason = F.when(f["reason"].isin("empty", "placeholder"), f["reason"]).when(by_form.isNull(), F.lit("unusable")).when((F.col("want") == "P") & names.is_own_word(F.col("value"), words), F.lit("own_word")).otherwise(F.lit("kept"))
    return every.select(F.when(reason == "kept", F.col("want")).alias("cls"), F.col("want").alias("field"), F.when(reason == "kept", normalize.collapsed(F.col("value"))).alias("value"), reason.alias("reason")).distinct()


def judged(incidents: DataFrame, digests: DataFrame, key: bytes, confirmed: DataFrame, limit: int = 50, words: Vocabulary = NO_WORDS) -> DataFrame:
    """Incident values (cls, value, ord) with a verdict: accepted, or why not.

    In this order: only persons are learned; words of the trade and values already known are not;
    ``confirmed`` (value) must list the value, as morphology and the annotator both say; of the
    rest the first ``limit`` are accepted.
    """
    norm = normalize.normalize(F.col("cls"), F.col("value"))
    rows = dictionary.first_values(incidents).withColumn("digest", codes.value_digest(F.col("cls"), norm, key))
    rows = rows.join(digests.select("cls", "digest", F.lit(True).alias("known")), ["cls", "digest"], "left")
    rows = rows.join(confirmed.select(F.col("value"), F.lit(True).alias("sure")).distinct(), "value", "left")
    why = (
        F.when(F.col("cls") != "P", "class_not_trained")
        .when(names.is_own_word(F.col("value"), words), "service_lexicon")
        .when(F.coalesce("known", F.lit(False)), "already_known")
        .when(~F.coalesce("sure", F.lit(False)), "unconfirmed")
    )
    rows = rows.withColumn("why", why)
    first = rows.where("why is null").orderBy("ord", "value").limit(limit).select("cls", "value", F.lit("accepted").alias("got"))
    return rows.join(F.broadcast(first), ["cls", "value"], "left").select("cls", "value", "ord", F.coalesce("why", "got", F.lit("over_limit")).alias("verdict"))


def apply_staged(spark: SparkSession, live: str, fresh: DataFrame, metrics: DataFrame, stamp: str) -> bool:
    """Put a new version of a table in force if all ``metrics`` (passed) allow it.

    The version is written whole to a folder of its own first, and a pointer table, replaced last,
    names it: readers see the old version or the new one, and the old stays as a backup.
    """
    if not metrics.agg(F.coalesce(F.bool_and("passed"), F.lit(False))).first()[0]:
        return False
    path = f"{live}/version={stamp}"
    fresh.write.mode("errorifexists").parquet(path)
    spark.createDataFrame([(stamp,)], "version string").coalesce(1).write.mode("append").json(f"{live}/_current")
    return True


def reloaded(spark: SparkSession, path: str, read, before: tuple[DataFrame, str] | None, keep: bool = False) -> tuple[DataFrame | None, str]:
    """(table, signature) of a file or folder that others replace: read again only where modification times and sizes changed.

    A path that is gone gives no table (a dictionary that was taken away must not live on); with ``keep`` the table before
    stays where the new one is gone, unreadable or empty (an open layer is better old than absent).
    """
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    old = before or (None, "")
    if not fs.exists(p):
        return (old if keep else (None, ""))
    files = fs.listStatus(p)
    signature = ";".join(sorted(f"{f.getPath().getName()}:{f.getModificationTime()}:{f.getLen()}" for f in files))
    if before is not None and signature == old[1]:
        return old
    try:
        fresh = read(spark, path)
        if keep and fresh.isEmpty():
            return old
    except Exception:
        if keep and before is not None:
            return old
        raise
    return fresh, signature


def current(spark: SparkSession, live: str) -> DataFrame:
    """The version in force: the latest that the pointer table names."""
    stamp = spark.read.schema("version string").json(f"{live}/_current").agg(F.max("version")).first()[0]
    return spark.read.parquet(f"{live}/version={stamp}")


def salt_positions(registry: DataFrame, key: bytes, salts: int = 16) -> DataFrame:
    """How far each stored code stands in its identity's candidates: (salt, codes); -1 is none of them."""
    at = F.array_position(codes.candidates(F.col("cls"), F.col("identity"), key, salts), F.col("token")).cast("int") - 1
    return registry.groupBy(at.alias("salt")).agg(F.count(F.lit(1)).alias("codes"))


def stems(value: Column, endings: list[str], limit: int = 6, least: int = 3) -> Column:
    """The value and what is left of it without a known ending, longest endings first, at least ``least`` letters, at most ``limit``."""
    low = F.translate(F.lower(value), "ё", "е")
    cut = [F.when(low.endswith(e) & (F.length(low) - len(e) >= least), F.substring(value, F.lit(1), F.length(value) - len(e))) for e in sorted(endings, key=lambda e: (-len(e), e))]
    return F.slice(F.array_distinct(F.array_compact(F.array(value, *cut))), 1, limit)


def by_source(registry: DataFrame, source: str, limit: int, since: Column | None = None, until: Column | None = None) -> DataFrame:
    """The oldest rows of a source, of those made from ``since`` on and before ``until``: the limit is the feature."""
    rows = registry.where(F.col("source") == source)
    rows = rows if since is None else rows.where(F.col("created_at") >= since)
    rows = rows if until is None else rows.where(F.col("created_at") < until)
    return rows.orderBy("created_at", "token").limit(limit)


def spellings(values: DataFrame, rules: DataFrame) -> DataFrame:
    """(value, spelling) of names (value): the generated case forms of all kinds, each also with yo folded, but not the value itself."""
    kinds = F.array(*(F.lit(x) for x in names.KINDS))
    each = names.forms(values.select("value").distinct().withColumn("kind", F.explode(kinds)), rules)
    both = each.select("value", F.explode(F.array(normalize.name(F.col("form")), normalize.identity_key(F.col("form")))).alias("spelling"))
    return both.where(F.col("spelling").rlike(r"^[а-яё]+(?:[- ][а-яё]+)*$") & (F.col("spelling") != F.col("value"))).distinct()


def dictionary_of(cards: DataFrame, rules: DataFrame, key: bytes, words: Vocabulary = NO_WORDS) -> tuple[DataFrame, DataFrame]:
    """(digests, form_digests) of client records: export, then keyed values, then keyed case forms that lead to the root of their family.

    A value that is a form of another one joins its family, whose root may be no value itself only if the forms say so. A spelling that two
    families have is left out. A value's spelling with yo folded leads to it.
    """
    kept = exported(cards, words).where("reason = 'kept'")
    values = kept.select("cls", "value").where("cls != 'D'")
    digests = dictionary.keyed(values, key).unionByName(kept.where("cls = 'D'").select("cls", codes.value_digest(F.lit("D"), F.col("value"), key).alias("digest")).distinct())
    people = settled(values.where("cls = 'P'").select(normalize.name(F.col("value")).alias("value")).where("value is not null").distinct())
    spelled = settled(spellings(people, rules))
    edges = spelled.select(F.col("spelling").alias("form"), F.col("value").alias("base")).join(people.select(F.col("value").alias("form")), "form", "left_semi")
    family = people.join(dictionary.roots(edges).select(F.col("form").alias("value"), "root"), "value", "left").select("value", F.coalesce("root", "value").alias("root"))
    led = spelled.join(family, "value").select("spelling", "root").unionByName(family.select(F.col("value").alias("spelling"), "root"))
    led = led.unionByName(people.select(normalize.identity_key(F.col("value")).alias("spelling"), F.col("value").alias("root")))
    led = dictionary.unambiguous(led.where("spelling != root").distinct(), "spelling", "root")
    digest = lambda c: codes.value_digest(F.lit("P"), F.col(c), key)
    return digests, led.select(F.lit("P").alias("cls"), digest("spelling").alias("form"), digest("root").alias("base"))
