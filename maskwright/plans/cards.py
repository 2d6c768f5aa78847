"""Deterministic Russian-shaped records made from ``customer``: one SQL text that Spark and other engines read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.operators import registry
from maskwright.session import large, spread, table

#: The demonstration key; deployments pass their own.
KEY = b"maskwright-demonstration-key-0001"

CARDS = """
select id, surname, given, phone, email, birth, segment, nation, balance,
    '+7 (' || substr(phone, 2, 3) || ') ' || substr(phone, 5, 3) || '-' || substr(phone, 8, 2) || '-' || substr(phone, 10, 2) as phone_a,
    '8 ' || substr(phone, 2, 3) || ' ' || substr(phone, 5, 3) || '-' || substr(phone, 8, 2) || '-' || substr(phone, 10, 2) as phone_b
from (
    select c_custkey as id, c_mktsegment as segment, c_nationkey as nation, cast(floor(c_acctbal / 1000) as bigint) as balance,
        split_part('Иванов,Петров,Сидоров,Кузнецов,Смирнов,Попов,Лебедев', ',', cast(c_custkey % 7 as int) + 1) as surname,
        split_part('Анна,Пётр,Мария,Олег,Юлия', ',', cast(c_custkey % 5 as int) + 1) as given,
        '79' || lpad(cast(c_custkey as string), 9, '0') as phone,
        'client' || cast(c_custkey as string) || '@example.ru' as email,
        lpad(cast(1 + c_custkey % 28 as string), 2, '0') || '.' || lpad(cast(1 + c_custkey % 12 as string), 2, '0') || '.' || cast(1970 + c_custkey % 35 as string) as birth
    from customer
) q
"""
PHONE_FORM = "case when id % 2 = 0 then phone_a else phone_b end"
#: A client's number of five digits or more.
NUMBER = "lpad(cast(id as string), cast(greatest(5, length(cast(id as string))) as int), '0')"
CARD_TEXT = f"'Анкета: ' || surname || ' ' || given || ', телефон ' || {PHONE_FORM} || ', почта ' || email || ', дата рождения ' || birth || '. client_id=' || {NUMBER}"
#: The same with numbers cut to five digits: what ``pii_share``'s SQL measures.
CUT_TEXT = CARD_TEXT.replace(NUMBER, "lpad(cast(id as string), 5, '0')")


def cards(spark: SparkSession, sf_dir: str, columns: str = "*") -> DataFrame:
    """The records, with ``columns`` in SQL."""
    return spark.sql(f"select {columns} from ({CARDS.replace('from customer', 'from {customer}')}) c", customer=table(spark, sf_dir, "customer"))


def card_texts(spark: SparkSession, sf_dir: str, columns: str) -> DataFrame:
    """Texts made from the records, to be searched by detectors."""
    return spread(cards(spark, sf_dir, columns), table(spark, sf_dir, "customer"))


def coded(rows: DataFrame, cls: str, identity: str, name: str, known: DataFrame | None = None) -> DataFrame:
    """``rows`` (id, ...) with ``name``: the code that the registry gives the identity in that column, one that no other has, first come first served by id."""
    given = registry.assign(rows.select(F.lit(cls).alias("cls"), F.col(identity).alias("identity"), F.col("id").alias("first_seen")), KEY, known)
    return large(rows).join(given.select(F.col("identity").alias(identity), F.col("token").alias(name)), identity)


def hmac_sql(message: str, key: bytes = KEY) -> str:
    """HMAC-SHA256 in hex as SQL of the oracle's engine."""
    key = key.ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in key).hex(), bytes(b ^ 0x5C for b in key).hex()
    return f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({message}))))"


def base32_sql(hex_: str, length: int = 8) -> str:
    bits = f"cast('0x' || substr({hex_}, 1, 10) as bigint)"
    return " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast(({bits} >> {35 - 5 * k}) & 31 as int) + 1, 1)" for k in range(length))


def code_sql(cls: str, identity: str, salt: str = "", length: int = 8) -> str:
    return f"('z' || '{cls}' || {base32_sql(hmac_sql(f"'{cls}:' || {identity}{salt}"), length)})"


def digest_sql(cls: str, value: str) -> str:
    return f"substr({hmac_sql(f"'{cls}:' || {value}")}, 1, 16)"


#: A small rule table for the demonstration; deployments load a full one.
RULES = [
    ("lastname", "suffixes", 0, "male", ["ов", "ев", "ин"], ["а", "у", "а", "ым", "е"]),
    ("lastname", "suffixes", 1, "female", ["ова", "ева", "ина"], ["-ой", "-ой", "-у", "-ой", "-ой"]),
    ("lastname", "exceptions", 2, "androgynous", ["лебедев"], ["а", "у", "а", "ым", "е"]),
]


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, "kind string, section string, ord int, gender string, test array<string>, mods array<string>")
