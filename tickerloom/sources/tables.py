"""Table readers and table-shaped exports."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom.functions.scalars import change_pct, extend, normalize_code, normalize_symbol, parse_date, parse_number
from tickerloom.operators.cleaning import clean_bars, date_range, keep_last
from tickerloom.operators.pool import DateSpan

BAR_FIELDS = ["date", "open", "high", "low", "close", "volume", "amount"]

# Accepted names of each bar column, in order of preference.
ALIASES = {
    "date": ("date", "trade_date", "datetime", "日期", "交易日期", "时间"),
    "open": ("open", "open_price", "开盘", "开盘价"),
    "high": ("high", "high_price", "最高", "最高价"),
    "low": ("low", "low_price", "最低", "最低价"),
    "close": ("close", "close_price", "收盘", "收盘价"),
    "volume": ("volume", "vol", "成交量"),
    "amount": ("amount", "成交额", "成交金额", "turnover", "money"),
    "symbol": ("symbol", "code", "stock_code", "ts_code", "ticker", "股票代码"),
    "file": ("file", "filename", "source_file"),
}
# Text encodings tried for csv tables, in order.
CSV_ENCODINGS = ("utf-8-sig", "utf-8", "gb18030", "gbk")


def find_column(columns: Iterable[str], candidates: Sequence[str]) -> str | None:
    """First candidate present, ignoring case and surrounding blanks."""
    by_name = {c.strip().lower(): c for c in columns}
    return next((by_name[k.strip().lower()] for k in candidates if k.strip().lower() in by_name), None)


def resolve_columns(
    df: DataFrame, required: Sequence[str] = BAR_FIELDS, positional: bool = False
) -> DataFrame:
    """Rename aliased columns to the standard names.

    With ``positional`` a table that lacks names takes its first seven columns in
    bar order.
    """
    found = {target: find_column(df.columns, names) for target, names in ALIASES.items()}
    missing = [t for t in required if found[t] is None]
    if missing and positional and len(df.columns) >= len(BAR_FIELDS):
        found = dict(zip(BAR_FIELDS, df.columns))
        missing = []
    if missing:
        raise ValueError(f"Missing required source columns {missing}; available: {df.columns}")
    renames = {src: target for target, src in found.items() if src and src != target and target not in df.columns}
    return df.withColumnsRenamed(renames)


def existing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The wanted columns that exist; the scan reads nothing else."""
    return df.select(*[c for c in dict.fromkeys(columns) if c in df.columns])


def read_bars(spark: SparkSession, path: str, rule: str = "cache") -> DataFrame:
    """A folder of per-symbol parquet files (or one table) as clean bars.

    One scan covers all files.  Without a symbol column the file name supplies it.
    """
    df = resolve_columns(spark.read.option("recursiveFileLookup", True).parquet(path), ["date", "open", "high", "low", "close"])
    name = F.col("_metadata.file_name")
    # The row index inside a file says which duplicate came last.
    df = df.select("*", name.alias("_file"), F.col("_metadata.row_index").alias("_row"))
    df = df.withColumn("symbol", normalize_symbol("symbol" if "symbol" in df.columns else "_file", keep_text=True))
    if "file" not in df.columns:
        df = df.withColumn("file", F.col("_file"))
    return clean_bars(df, rule, order=["_file", "_row"])


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Parquet, or csv/txt files with a header, each in the first encoding that reads all of its lines.

    Files in UTF-8 go to Spark's own csv reader.  Lines of others are decoded
    first and give text columns; a file's header is its first line, by place.
    """
    low = path.lower().rstrip("/")
    if low.endswith((".csv", ".txt")):
        from tickerloom.sources.bar_text import decoded, file_encodings, raw_lines

        lines = raw_lines(spark, path)
        encodings = file_encodings(lines, CSV_ENCODINGS)
        others = encodings.filter(~F.col("encoding").startswith("utf-8")).limit(1).count()
        if not others:
            return spark.read.option("header", True).option("encoding", "UTF-8").option("inferSchema", True).csv(path)
        text = decoded(lines, encodings)
        first = (F.col("part") == 0) & (F.col("line_no") == 0)
        header = text.filter(first).orderBy("file").select("line").first()["line"]
        names = [h.strip().strip('"') for h in header.split(",")]
        schema = ", ".join(f"`{n}` STRING" for n in names)
        rows = text.filter(~first & (F.trim("line") != ""))
        return rows.select(F.from_csv("line", schema).alias("r")).select("r.*")
    if low.endswith(".parquet") or "." not in low.rsplit("/", 1)[-1]:
        return spark.read.parquet(path)
    raise ValueError(f"Unsupported table type: {path}")


def read_indicator_subset(spark: SparkSession, path: str) -> DataFrame:
    """The columns of an indicator cache the alpha probe can use, unique per (date, symbol)."""
    wanted = [
        "date", "symbol", "code", "name", "stock_name", "daily_return_pct", "close_to_short_trend",
        "brick_reversal_ratio", "short_pos_3", "long_pos_21", "short_pos", "long_pos",
    ]
    raw = spark.read.parquet(path)
    code = next((c for c in ("symbol", "code") if c in raw.columns), None)
    if "date" not in raw.columns or code is None:
        raise ValueError("the indicator cache needs a date and a symbol or code column")
    df = existing(raw, wanted).select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    df = df.withColumns({"date": F.col("date").cast("date"), "symbol": normalize_symbol(code)})
    df = df.filter("date IS NOT NULL AND symbol != ''")
    return keep_last(df, ["date", "symbol"], ["_file", "_row"]).drop("_file", "_row")


def full_market(bars: DataFrame, start_date=None, end_date=None, keep_symbol: bool = False) -> DataFrame:
    """All bars of all symbols with parsed dates and numbers."""
    kinds = dict(bars.dtypes)
    df = resolve_columns(bars)
    parsed = {"date": parse_date("date") if kinds.get("date") == "string" else F.col("date").cast("date")}
    for c in BAR_FIELDS[1:]:
        parsed[c] = parse_number(c) if dict(df.dtypes)[c] == "string" else F.col(c).cast("double")
    df = df.withColumns(parsed).filter("date IS NOT NULL")
    names = [*(["symbol"] if keep_symbol else []), *BAR_FIELDS]
    return date_range(df.select(*names), start_date, end_date)


def index_series(df: DataFrame, order: Sequence[str] | None = None) -> DataFrame:
    """An index: unique dates with a close, and its return over the previous date.

    One row per calendar day, so the single ordered window is bounded.
    """
    df = df.filter("date IS NOT NULL AND close IS NOT NULL")
    if order:
        df = keep_last(df, ["date"], order).drop(*order)
    return extend(df, {"index_return_pct": change_pct("close", "lag(close, 1) OVER (ORDER BY date)")})


def code_list(df: DataFrame, column: str = "code", *, order: str) -> DataFrame:
    """Distinct normalized codes with their position of first appearance in ``order``."""
    absent = [c for c in (column, order) if c not in df.columns]
    if absent:
        raise ValueError(f"the code table has no {absent}, only {df.columns}")
    seen = F.col(order)
    from tickerloom.operators.ranking import positions

    codes = df.select(normalize_code(column).alias("code"), seen.alias("_seen")).filter("code != ''")
    firsts = codes.groupBy("code").agg(F.min("_seen").alias("_seen"))
    return positions(firsts.withColumn("_all", F.lit(1)), ["_all"], ["_seen", "code"]).select("code", F.col("_dense").alias("pos"))


@contextmanager
def _settings(spark: SparkSession, **values):
    """Session settings for one statement."""
    names = {k: "spark.sql." + k.replace("__", ".") for k in values}
    before = {k: spark.conf.get(n, None) for k, n in names.items()}
    try:
        for k, n in names.items():
            spark.conf.set(n, values[k])
        yield
    finally:
        for k, n in names.items():
            spark.conf.unset(n) if before[k] is None else spark.conf.set(n, before[k])


def date_span(spark: SparkSession, *paths: str) -> DateSpan:
    """The span of parquet tables of one schema with a ``date`` column, from the files' footers; no row is read."""
    with _settings(spark, parquet__aggregatePushdown="true", sources__useV1SourceList=""):
        row = span_query(spark, *paths).first()
    return DateSpan(row["first"], row["last"], row["rows"])


def span_query(spark: SparkSession, *paths: str) -> DataFrame:
    """The aggregate of :func:`date_span`; the scan answers it itself under the settings used there."""
    return spark.read.parquet(*paths).agg(F.min("date").alias("first"), F.max("date").alias("last"), F.count("date").alias("rows"))
