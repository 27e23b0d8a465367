"""Several tables that change together: data in folders of their own, one small manifest as the commit.

A release folder holds ``_data`` with the folders that writes have left and ``_manifest`` with
numbered JSON documents.  A manifest names for each table its format and its parts
(one folder each; a table by month has one per month) and carries facts about the release.
Readers follow the highest number.  A write leaves new folders, then one manifest, which appears
by a rename; until then readers see the old release, and a crash leaves nothing but
folders that no manifest names (:func:`vacuum`).  Nothing is overwritten, so a job may
read what it replaces, and a part that is in no manifest any more is gone.

Two writers at once: the manifest's number is the one after what the writer has
read, and only one can take it; the other raises.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Readers' options per format.
OPTIONS = {"csv": {"header": True, "encoding": "UTF-8"}, "parquet": {}, "json": {}}


@dataclass(frozen=True)
class Table:
    """``parts`` maps a part's name to its folder under the release; ``schema`` is the readers' schema as JSON."""

    format: str
    schema: str
    parts: dict[str, str]


@dataclass(frozen=True)
class Release:
    number: int = 0
    tables: dict[str, Table] = field(default_factory=dict)
    facts: dict = field(default_factory=dict)


def _files(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _numbers(spark: SparkSession, root: str) -> list[int]:
    fs, folder = _files(spark, f"{root}/_manifest")
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and not n.startswith("."))


def _load(spark: SparkSession, root: str, number: int) -> Release:
    text = spark.read.text(f"{root}/_manifest/{number:012d}.json", wholetext=True).first()[0]
    doc = json.loads(text)
    return Release(number, {n: Table(**t) for n, t in doc["tables"].items()}, doc["facts"])


def current(spark: SparkSession, root: str) -> Release:
    """The newest release; number 0 without tables if there is none."""
    numbers = _numbers(spark, root)
    return _load(spark, root, numbers[-1]) if numbers else Release()


def stage(df: DataFrame, root: str, name: str, kind: str = "parquet", by: str | None = None) -> Table:
    """Write a table into a new folder.  With ``by`` every value of that column is a part, and the column is not stored."""
    spark = df.sparkSession
    folder = f"_data/{name}-{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists").format(kind).options(**OPTIONS[kind])
    (writer.partitionBy(by) if by else writer).save(f"{root}/{folder}")
    if not by:
        return Table(kind, df.schema.json(), {"": folder})
    fs, place = _files(spark, f"{root}/{folder}")
    parts = [s.getPath().getName() for s in fs.listStatus(place) if s.isDirectory() and s.getPath().getName().startswith(f"{by}=")]
    return Table(kind, df.drop(by).schema.json(), {p.split("=", 1)[1]: f"{folder}/{p}" for p in sorted(parts)})


def commit(spark: SparkSession, root: str, before: Release, tables: dict[str, Table], facts: dict) -> Release:
    """Make ``tables`` the release after ``before``, all at once."""
    number = before.number + 1
    text = json.dumps({"tables": {n: vars(t) for n, t in tables.items()}, "facts": facts}, default=str, ensure_ascii=False, sort_keys=True)
    fs, temporary = _files(spark, f"{root}/_manifest/.{uuid.uuid4().hex}")
    _, final = _files(spark, f"{root}/_manifest/{number:012d}.json")
    stream = fs.create(temporary, False)
    stream.write(bytearray(text.encode("utf-8")))
    stream.close()
    if fs.exists(final) or not fs.rename(temporary, final):
        fs.delete(temporary, False)
        raise RuntimeError(f"another writer has made release {number} of {root}")
    return Release(number, tables, facts)


def read(spark: SparkSession, root: str, name: str, parts: list[str] | None = None, release: Release | None = None) -> DataFrame:
    """A table of the newest (or given) release, or some of its parts; folders that others write meanwhile are not seen."""
    table = (release or current(spark, root)).tables[name]
    folders = [f"{root}/{f}" for p, f in table.parts.items() if parts is None or p in parts]
    schema = StructType.fromJson(json.loads(table.schema))
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.format(table.format).options(**OPTIONS[table.format]).schema(schema).load(folders)


def vacuum(spark: SparkSession, root: str, keep: int = 2) -> int:
    """Delete data folders that none of the last ``keep`` releases names; returns their number.  Not while another write is open."""
    numbers = _numbers(spark, root)
    kept = {f.split("/")[1] for n in numbers[-keep:] for t in _load(spark, root, n).tables.values() for f in t.parts.values()}
    fs, data = _files(spark, f"{root}/_data")
    gone = [s.getPath() for s in fs.listStatus(data) if s.getPath().getName() not in kept] if fs.exists(data) else []
    for place in gone:
        fs.delete(place, True)
    for n in numbers[:-keep]:
        fs.delete(_files(spark, f"{root}/_manifest/{n:012d}.json")[1], False)
    return len(gone)
