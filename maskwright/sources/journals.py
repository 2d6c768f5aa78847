"""Append-only journals by ISO week, and files of settings and dictionaries."""

from __future__ import annotations

import csv
import io
import json
import os
import re
import uuid
import warnings
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from maskwright.operators.analytics import refused_events, week_key
from maskwright.session import shared_dir

AUDIT = "session_id string, action string, direction string, cls string, count int, channel string, reason string, ts timestamp"
INCIDENT = "ts timestamp, channel string, class string, action string, code string, findings int, replacements int, rule string"


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under the one that all executors share."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def append(events: DataFrame, path: str, ts: str = "ts") -> None:
    """Events added under their ISO week; past weeks are never rewritten."""
    events.withColumn("iso_week", week_key(F.col(ts))).write.mode("append").partitionBy("iso_week").json(path)


class JournalError(ValueError):
    """An event that a journal must not hold, or a file that isn't what it should be."""


def append_audit(events: DataFrame, path: str) -> None:
    """Audit events added; where one has a field that could carry a value, nothing is written and the caller is told."""
    bad = refused_events(events).first()
    if bad.refused:
        raise JournalError(f"{bad.refused} of {bad.events} events have a field outside the closed lists")
    append(events, path)


def append_incidents(events: DataFrame, path: str) -> int:
    """Incidents added; how many were lost where the journal can't be written. A request never fails for its journal."""
    try:
        append(events, path)
        return 0
    except Exception:  # whatever the file system says
        return events.count()


def read_audit(spark: SparkSession, path: str, since: str, until: str) -> DataFrame:
    """Audit events from ``since`` on and before ``until`` (times as text), for a regulator: only the weeks in between are read."""
    rows = spark.read.schema(AUDIT + ", iso_week string").json(path)
    lo, hi = F.lit(since).cast("timestamp"), F.lit(until).cast("timestamp")
    return rows.where((F.col("ts") >= lo) & (F.col("ts") < hi) & F.col("iso_week").between(week_key(lo), week_key(hi))).drop("iso_week")


def read_week(spark: SparkSession, path: str, schema: StructType | str, week: str) -> DataFrame:
    """One week: only its folder is read; lines that don't parse are skipped."""
    rows = spark.read.schema(schema if isinstance(schema, str) else StructType(schema.fields)).option("mode", "DROPMALFORMED").json(f"{path}/iso_week={week}")
    return rows


def kept_weeks(weeks: DataFrame, now: str, days: int = 180) -> DataFrame:
    """(iso_week, keep): weeks that ended more than ``days`` days before ``now`` go, the current one never."""
    monday = F.date_add(F.trunc(F.make_date(F.substring("iso_week", 1, 4).cast("int"), F.lit(1), F.lit(4)), "week"), (F.substring("iso_week", 6, 2).cast("int") - 1) * 7)
    current = F.lit(now).cast("date")
    return weeks.withColumn("keep", (F.date_add(monday, 6) >= F.date_sub(current, days)) | (monday == F.trunc(current, "week")))


def dictionary(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(values, digests, forms) of a dictionary file of schema 1 (readable) or 2 and 3 (keyed).

    A file that can't be read gives empty tables, and a warning: no dictionary is better than a wrong one. A keyed file of another schema does too.
    """
    known = spark.read.option("wholetext", True).text(path).select(F.get_json_object("value", "$.schema").alias("schema"), F.from_json("value", "map<string,string>").alias("root")).collect()
    for r in known:
        if r.root is None or r.schema is not None and r.schema not in ("2", "3"):
            warnings.warn(f"{path} is no dictionary that can be read", stacklevel=2)
    raw = spark.read.option("wholetext", True).text(path).select(F.from_json("value", "schema int, digests map<string,array<string>>, forms map<string,map<string,string>>").alias("d"), F.from_json("value", "map<string,array<string>>").alias("plain"), F.get_json_object("value", "$.schema").alias("keyed"))
    raw = raw.where("keyed is null or keyed in ('2', '3')")
    values = raw.where("keyed is null").select(F.explode("plain").alias("cls", "v")).select("cls", F.explode("v").alias("value"))
    digests = raw.where("keyed is not null").select(F.explode("d.digests").alias("cls", "v")).select("cls", F.explode("v").alias("digest"))
    forms = raw.where("keyed is not null").select(F.explode("d.forms").alias("cls", "m")).select("cls", F.explode("m").alias("form", "base"))
    return values, digests, forms


def name_words(spark: SparkSession, path: str) -> DataFrame:
    """(value) of a word list: one a line, comments after #."""
    return spark.read.text(path).select(F.trim(F.regexp_replace("value", "#.*$", "")).alias("value")).where("value != ''")


def name_csv(spark: SparkSession, path: str, columns: tuple[str, ...] = ("first_name", "last_name", "middle_name")) -> DataFrame:
    """(value) of the name columns of a CSV with a header."""
    rows = spark.read.option("header", True).csv(path)
    return rows.select(F.explode(F.array(*(F.trim(c) for c in columns))).alias("value")).where("value != ''")


def name_zip(spark: SparkSession, path: str, columns: tuple[str, ...] = ("first_name", "last_name", "middle_name")) -> DataFrame:
    """(value) of the name columns of the CSV files in zip archives, unpacked where the archives are read."""

    def unpack(batches):
        for b in batches:
            for raw in b.column("content").to_pylist():
                with zipfile.ZipFile(io.BytesIO(raw)) as z:
                    for entry in z.namelist():
                        with z.open(entry) as f:
                            for record in csv.DictReader(io.TextIOWrapper(f, "utf-8")):
                                yield pa.RecordBatch.from_pydict({"value": [v for c in columns if (v := (record.get(c) or "").strip())]}, schema=pa.schema([("value", pa.string())]))

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(unpack, "value string")


def name_layer(spark: SparkSession, path: str) -> DataFrame:
    """(cls, value) of an open layer: JSON, packed or not, of classes and their values. An empty one is an error, so that a reader keeps the layer it has."""
    raw = spark.read.option("wholetext", True).text(path).select(F.from_json("value", "struct<values:map<string,array<string>>>").alias("d"))
    rows = raw.select(F.explode("d.values").alias("cls", "v")).select("cls", F.explode("v").alias("value")).where("trim(value) != ''")
    if rows.isEmpty():
        raise JournalError(f"{path} holds no layer")
    return rows


def combo_index(spark: SparkSession, path: str, schema: int = 1) -> DataFrame:
    """(digest) of a combination index. It must be keyed and of this schema: a guard that reads another file would confirm nothing, or anything."""
    raw = spark.read.option("wholetext", True).text(path).select(F.from_json("value", "struct<schema:int,keyed:boolean,combos:array<string>>").alias("d"))
    head = raw.select("d.schema", "d.keyed").collect()
    if not head or any(r.schema != schema or not r.keyed for r in head):
        raise JournalError(f"{path} is no keyed combination index of schema {schema}")
    rows = raw.select(F.explode("d.combos").alias("digest"))
    if not rows.where("not rlike(digest, '^[0-9a-f]{16}$')").isEmpty():
        raise JournalError(f"{path} holds entries that are no digests")
    return rows.distinct()


def name_cards(records: DataFrame, limit: int | None = None) -> DataFrame:
    """(parts) of paged records (page, record: JSON): surname, name and patronymic, as many as there are; ``limit`` is a cap that a caller asks for."""
    fields = ("surname", "name", "patronymic")
    parts = F.filter(F.array(*(F.trim(F.get_json_object("record", f"$.{c}")) for c in fields)), lambda x: x.isNotNull() & (x != ""))
    rows = records.select("page", parts.alias("parts")).where(F.size("parts") > 0)
    return (rows if limit is None else rows.orderBy("page").limit(limit)).select("parts")


def overlay(text: str) -> dict[str, object]:
    """Settings from JSON, or from lines ``key: value`` with lists of ``- item`` below a key (the part of YAML that settings need)."""
    if text.lstrip().startswith("{"):
        return json.loads(text)
    out: dict[str, object] = {}
    key = None
    for line in text.splitlines():
        line = re.sub(r"(^|\s)#.*$", "", line).rstrip()
        if m := re.fullmatch(r"\s+-\s+(.*)", line):
            if key is None or not isinstance(out.setdefault(key, []), list):
                raise JournalError(f"{line!r} stands below no key")
            out[key].append(scalar(m[1]))
        elif m := re.fullmatch(r"([A-Za-z_][\w.-]*):\s*(.*)", line):
            key = m[1]
            if m[2]:
                out[key] = scalar(m[2])
        elif line.strip():
            raise JournalError(f"{line!r} is no setting")
    return out


def scalar(text: str) -> object:
    """A setting's value: a whole number, yes or no, or text without its quotes."""
    text = text.strip()
    if re.fullmatch(r"-?[0-9]+", text):
        return int(text)
    return {"true": True, "yes": True, "on": True, "false": False, "no": False, "off": False}.get(text.lower(), text.strip("\"'"))


def env_file(text: str) -> dict[str, str]:
    """KEY=VALUE lines; comments and blank lines are skipped, quotes around values go."""
    out = {}
    for line in text.splitlines():
        m = re.match(r"\s*(?:export\s+)?([A-Za-z_][A-Za-z0-9_]*)\s*=\s*(.*?)\s*$", line)
        if m and not line.lstrip().startswith("#"):
            out[m[1]] = m[2].strip("\"'")
    return out


def header_lines(lines: DataFrame) -> DataFrame:
    """(name, value) of text lines ``Name: value``; comments and blank lines are skipped."""
    found = lines.select(F.trim("value").alias("line")).where("line != '' and not startswith(line, '#') and contains(line, ':')")
    return found.select(F.trim(F.split("line", ":", 2)[0]).alias("name"), F.trim(F.split("line", ":", 2)[1]).alias("value"))


class PagedRecords(DataSource):
    """Records of a paged interface, a range of pages a partition: spark.read.format("paged_records").

    Options: path (a folder of page-N.json files that the driver and all executors see, each a list of records) and pages.
    A page that is missing or empty ends the scan: it is looked for once, before the ranges are dealt out.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_records"

    def schema(self) -> str:
        return "page int, record string"

    def reader(self, schema: StructType) -> PagedReader:
        return PagedReader(self.options)


class PagedReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.pages, self.span = options["path"], int(options.get("pages", "600")), int(options.get("span", "50"))

    def partitions(self) -> list[InputPartition]:
        there = {int(m[1]) for f in os.listdir(self.path) if (m := re.fullmatch(r"page-(\d+)\.json", f)) and os.path.getsize(os.path.join(self.path, f)) > 2}
        last = next((n - 1 for n in range(1, self.pages + 1) if n not in there), self.pages)
        return [InputPartition((a, min(a + self.span, last + 1))) for a in range(1, last + 1, self.span)] or [InputPartition((1, 1))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        first, last = partition.value
        for page in range(first, last):
            with open(f"{self.path}/page-{page}.json", encoding="utf-8") as f:
                records = json.load(f)
            for r in records:
                yield page, json.dumps(r, ensure_ascii=False)
