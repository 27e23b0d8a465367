"""Bars from exported text files in mixed encodings and layouts.

A data line is recognised by itself: its first field is a date.  Titles,
headers, footers and blank lines are simply lines that are not data, so no
per-file state is needed and lines can be parsed anywhere.

Every file, whatever its size, is split by Spark into blocks of raw lines.  A line's
place is the start of its block and its number in it.  One pass over all lines
says, per file, which encodings read every line; the first of them decodes the file.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom.functions.scalars import exchange_symbol, parse_date_day_first, to_number
from tickerloom.operators.cleaning import clean_bars, date_range, keep_last

# Encodings tried in order.
ENCODINGS = ("utf-8-sig", "utf-8", "gb18030", "gbk", "gb2312", "utf-16", "utf-16-le", "utf-16-be", "big5")
LAST_RESORT = "gb18030"
FIELDS = ["date", "open", "high", "low", "close", "volume", "amount"]
# The three date layouts of a data line.
DATE_FIELD = r"^(\d{4}[-/]\d{1,2}[-/]\d{1,2}|\d{1,2}/\d{1,2}/\d{4}|\d{8})$"
SOURCE_MARK = "数据来源"

# Worker code travels with the job, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def decode_line(raw: bytes, encoding: str, errors: str = "strict") -> str:
    """Text of one raw line.  In two-byte encodings half of the line break stays with a neighbour."""
    if encoding.startswith("utf-16"):
        if raw[:2] in (b"\xff\xfe", b"\xfe\xff"):
            raw = raw[2:]
        little = encoding != "utf-16-be"
        raw = raw.removeprefix(b"\x00") if little and len(raw) % 2 else raw
        raw = raw.removesuffix(b"\x00") if not little and len(raw) % 2 else raw
        return raw.decode("utf-16-le" if little else "utf-16-be", errors).rstrip("\r\n").lstrip("\ufeff")
    text = raw.decode(encoding, errors)
    if "\x00" in text:
        # A two-byte text also passes as single bytes; zero bytes give it away.
        raise UnicodeError("zero bytes")
    return text.rstrip("\r").lstrip("\ufeff")


def _reads(raw: bytes, encoding: str) -> bool:
    try:
        decode_line(raw, encoding)
    except UnicodeError:
        return False
    return True


def _files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """Paths of the files, without their content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.select("path")


def raw_lines(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(file, part, line_no, raw): every line with its block's start and its number in the block, from 0."""
    reader = spark.read.option("recursiveFileLookup", True).option("lineSep", "\n")
    text = (reader.option("pathGlobFilter", pattern) if pattern else reader).text(path)
    source = text.select(
        # Metadata paths are URL-encoded ("#" as %23), unlike those of file listings.
        F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))).alias("file"),
        F.col("_metadata.file_block_start").alias("part"), F.col("value").cast("binary").alias("raw"),
    )

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, count = None, 0
        for batch in batches:
            numbers = []
            for key in zip(batch["file"], batch["part"]):
                count = count + 1 if key == last else 0
                last = key
                numbers.append(count)
            yield batch.assign(line_no=numbers)[["file", "part", "line_no", "raw"]]

    return source.mapInPandas(number, "file string, part long, line_no long, raw binary")


def file_encodings(lines: DataFrame, encodings: Sequence[str] = ENCODINGS) -> DataFrame:
    """(file, encoding): the first encoding that reads every line of a file, else the last resort."""
    names = tuple(encodings)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, part in batch.groupby("file"):
                raws = [bytes(v) for v in part["raw"]]
                plain = all(v.isascii() and b"\x00" not in v for v in raws)
                fits = [plain or all(_reads(v, name) for v in raws) for name in names]
                yield pd.DataFrame({"file": [file], "fits": [fits], "zeros": [any(b"\x00" in v for v in raws)],
                                    "big": [any(v[:2] == b"\xfe\xff" or v[:1] == b"\x00" for v, n, at in zip(raws, part["line_no"], part["part"]) if n == at == 0)]})

    seen = lines.mapInPandas(judge, "file string, fits array<boolean>, zeros boolean, big boolean")
    fit = [F.bool_and(F.col("fits")[i]).alias(f"f{i}") for i in range(len(names))]
    two_bytes = F.when(F.col("big"), "utf-16-be").otherwise("utf-16-le")
    first = F.coalesce(*[F.when(F.col(f"f{i}"), F.lit(n)) for i, n in enumerate(names) if not n.startswith("utf-16")], F.lit(f"{LAST_RESORT}_ignore"))
    per_file = seen.groupBy("file").agg(*fit, F.bool_or("zeros").alias("zeros"), F.bool_or("big").alias("big"))
    return per_file.select("file", F.when(F.col("zeros"), two_bytes).otherwise(first).alias("encoding"))


def decoded(lines: DataFrame, encodings: DataFrame) -> DataFrame:
    """(file, part, line_no, line, encoding) from raw lines and their files' encodings."""

    def to_text(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            text = [decode_line(bytes(v), e.removesuffix("_ignore"), "strict" if e == "utf-8" else "ignore") if b"\x00" not in bytes(v) or e.startswith("utf-16")
                    else bytes(v).replace(b"\x00", b"").decode(LAST_RESORT, "ignore") for v, e in zip(batch["raw"], batch["encoding"])]
            yield batch.assign(line=text)[["file", "part", "line_no", "line", "encoding"]]

    joined = lines.join(encodings, "file").select("file", "part", "line_no", "raw", "encoding")
    return joined.mapInPandas(to_text, "file string, part long, line_no long, line string, encoding string")


def read_lines(spark: SparkSession, path: str, pattern: str | None = "*.{txt,TXT}", encodings: Sequence[str] = ENCODINGS) -> DataFrame:
    """(file, part, line_no, line, encoding) of every line; (part, line_no) orders a file's lines."""
    lines = raw_lines(spark, path, pattern)
    return decoded(lines, file_encodings(lines, encodings))


def data_fields(line: Column) -> Column:
    """A line as seven text fields, or NULL when it is not a data line."""
    text = F.trim(F.regexp_replace(line, "[﻿\r\t]", " "))
    parts = F.when(text.contains(","), F.transform(F.split(text, ","), lambda p: F.trim(p))).otherwise(F.split(text, r"\s+"))
    padded = F.slice(F.concat(parts, F.array(F.lit(""))), 1, 7)
    is_data = (F.size(parts) >= 6) & parts[0].rlike(DATE_FIELD) & ~text.contains(SOURCE_MARK)
    return F.when(is_data, padded)


def parse_lines(lines: DataFrame) -> DataFrame:
    """Typed bar candidates: one row per data line, still with duplicates and bad values."""
    df = lines.withColumn("_f", data_fields(F.col("line"))).filter("_f IS NOT NULL")
    base = F.element_at(F.split("file", "/"), -1)
    return df.select(
        exchange_symbol("file").alias("symbol"),
        base.alias("file"),
        parse_date_day_first(F.col("_f")[0]).alias("date"),
        *[to_number(F.col("_f")[i]).alias(c) for i, c in enumerate(FIELDS) if 1 <= i <= 4],
        F.coalesce(to_number(F.col("_f")[5]), F.lit(0.0)).cast("long").alias("volume"),
        to_number(F.col("_f")[6]).alias("amount"),
        F.col("file").alias("_path"), F.col("part").alias("_part"), F.col("line_no").alias("_line"),
    )


def import_bars(spark: SparkSession, path: str, start_date=None, end_date=None, **options) -> DataFrame:
    """Clean bars of all text files below ``path``; the last line of a date wins."""
    bars = parse_lines(read_lines(spark, path, **options)).filter("symbol IS NOT NULL")
    bars = clean_bars(bars, "cache", order=["_path", "_part", "_line"])
    return date_range(bars.withColumn("volume", F.col("volume").cast("long")), start_date, end_date)


def import_report(spark: SparkSession, path: str, start_date=None, end_date=None, **options) -> DataFrame:
    """File counts of an import: total, imported, skipped, failed (no encoding reads them and no row came), without data lines, without usable rows."""
    lines = read_lines(spark, path, **options)
    pattern = options.get("pattern", "*.{txt,TXT}")
    files = _files(spark, path, pattern).select(F.col("path").alias("file"))
    raw = raw_lines(spark, path, pattern)
    unread = file_encodings(raw, options.get("encodings", ENCODINGS)).filter(F.col("encoding").endswith("_ignore")).select("file", F.lit(True).alias("unread"))
    parsed = parse_lines(lines)
    usable = F.col("date").isNotNull() & (F.col("close") > 0)
    for c in ("open", "high", "low"):
        usable = usable & F.col(c).isNotNull()
    if start_date is not None:
        usable = usable & (F.col("date") >= F.lit(start_date).cast("date"))
    if end_date is not None:
        usable = usable & (F.col("date") <= F.lit(end_date).cast("date"))
    per_file = parsed.groupBy(F.col("_path").alias("file")).agg(
        F.count(F.lit(1)).alias("lines"), F.count_if(usable).alias("rows"))
    df = files.join(per_file, "file", "left").join(unread, "file", "left").fillna(0, ["lines", "rows"]).fillna(False, ["unread"])
    named = exchange_symbol("file").isNotNull()
    ok = named & (F.col("rows") > 0)
    return df.agg(
        F.count(F.lit(1)).alias("total_txt_files"),
        F.count_if(ok).alias("imported_files"),
        F.count_if(~ok).alias("skipped_files"),
        F.count_if(named & F.col("unread") & (F.col("rows") == 0)).alias("failed_files"),
        F.count_if(named & (F.col("lines") == 0)).alias("empty_raw_files"),
        F.count_if(named & (F.col("lines") > 0) & (F.col("rows") == 0)).alias("empty_normalized_files"),
    )


def rejected_lines(lines: DataFrame) -> DataFrame:
    """Data lines that give no valid bar, with their file, for inspection."""
    bad = parse_lines(lines).filter(
        "symbol IS NULL OR date IS NULL OR open IS NULL OR high IS NULL OR low IS NULL OR close IS NULL OR close <= 0"
    ).select(F.col("_path").alias("file"), F.col("_part").alias("part"), F.col("_line").alias("line_no"))
    return lines.join(bad, ["file", "part", "line_no"], "left_semi")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Index series of a folder: the 999999 text file if there is one, else the first file.

    One file of one row per day, so it is bounded by the calendar.
    """
    from tickerloom.sources.tables import index_series

    listed = [r["path"] for r in _files(spark, path, "*.{txt,csv,TXT,CSV}").select("path").orderBy("path").toLocalIterator()]
    if not listed:
        raise FileNotFoundError(f"no index file in {path}")
    preferred = [p for p in listed if "999999" in p and p.lower().endswith(".txt")] or [p for p in listed if "999999" in p]
    chosen = (preferred or [p for p in listed if p.lower().endswith(".txt")] or listed)[0]
    rows = parse_lines(read_lines(spark, chosen, pattern=None))
    rows = rows.withColumnsRenamed({"file": "source_file"}).drop("symbol")
    return index_series(rows.drop("_path"), order=["_part", "_line"])


__all__ = ["decode_line", "file_encodings", "import_bars", "import_report", "keep_last", "parse_lines", "raw_lines", "read_index", "read_lines", "rejected_lines"]
