"""Bar cleaning, de-duplication and row filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerloom.functions.scalars import extend, first_code, to_number
from tickerloom.scratch import materialize

PRICES = ["open", "high", "low", "close"]
NUMBERS = [*PRICES, "volume", "amount"]

# What each consumer of bars insists on (besides a date).
CLEANING_RULES = {
    "cache": {"required": PRICES, "positive_close": True},
    "confirm": {"required": [*PRICES, "volume"], "positive_close": True},
    "alpha": {"required": PRICES, "positive_close": False},
    "label": {"required": ["open", "close"], "positive_close": False},
    "full_market": {"required": [], "positive_close": False},
}


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """One row per key: the one with the greatest ``order``.

    A max_by aggregate, so duplicates collapse before the shuffle and a key
    with very many copies costs no more than any other.
    """
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*[F.col(c) if isinstance(c, str) else c for c in order])
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("_row"))
    return best.select(*[F.col(c) if c in keys else F.col("_row")[c].alias(c) for c in df.columns])


def clean_bars(df: DataFrame, rule: str = "cache", order: Sequence[str] | None = None) -> DataFrame:
    """Typed, valid bars, unique per (symbol, date).

    ``order`` names the columns that say which duplicate came last.  They are
    dropped from the result.  Without them the input must already be unique.
    """
    spec = CLEANING_RULES[rule]
    for name in NUMBERS:
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast("double"))
    df = df.withColumns({"date": F.col("date").cast("date"), **{c: to_number(c) for c in NUMBERS}})
    keep = F.col("date").isNotNull()
    for name in spec["required"]:
        keep = keep & F.col(name).isNotNull()
    if spec["positive_close"]:
        keep = keep & (F.col("close") > 0)
    if rule == "alpha":
        df = df.withColumn("symbol", first_code("symbol"))
        keep = keep & (F.col("symbol") != "")
    df = df.filter(keep)
    if order:
        df = keep_last(df, ["symbol", "date"], order).drop(*order)
    return df


def date_range(df: DataFrame, start=None, end=None, column: str = "date") -> DataFrame:
    """Inclusive at both ends; a plain predicate, so it reaches the scan."""
    if start is not None:
        df = df.filter(F.col(column) >= F.lit(start).cast("date"))
    if end is not None:
        df = df.filter(F.col(column) <= F.lit(end).cast("date"))
    return df


def selected_rows(df: DataFrame, positive: bool = False) -> DataFrame:
    """Rows marked selected, or every row when there is no such column.

    Numbers must equal 1 (or, with ``positive``, exceed 0).  A column in which
    no value is a number is read by truth: any non-empty text counts.
    """
    if "selected" not in df.columns:
        return df
    kind = dict(df.dtypes)["selected"]
    if kind == "boolean":
        return df.filter(F.coalesce(F.col("selected"), F.lit(False)))
    number = to_number("selected")
    if positive:
        return df.filter(number > 0)
    if kind == "string":
        # Read twice, and a whole pool build may stand behind it.
        df = materialize(df, "marked")
        any_number = df.agg((F.count(number) > 0).alias("any")).scalar()
        keep = F.when(any_number, number.cast("int") == 1).otherwise(F.length("selected") > 0)
        return df.filter(F.coalesce(keep, F.lit(False)))
    return df.filter(number.cast("int") == 1)


def enough_history(df: DataFrame, horizons: Sequence[int], least: int = 80) -> DataFrame:
    """Drop symbols with fewer than max(80, longest horizon + 30) bars."""
    need = max(least, max(horizons) + 30)
    counted = extend(df, {"_bars": "count(1) OVER (PARTITION BY symbol)"})
    return counted.filter(F.col("_bars") >= need).drop("_bars")


def universe(
    df: DataFrame,
    *,
    start_date=None,
    end_date=None,
    min_price: float = 3.0,
    max_price: float = 80.0,
    min_history_days: int = 80,
    only_main_board: bool = True,
    exclude_st: bool = True,
) -> DataFrame:
    """Tradable rows of a scored market panel."""
    df = date_range(df, start_date, end_date)
    if only_main_board:
        df = df.filter(F.substring("symbol", 1, 2).isin("00", "60"))
    df = df.filter(F.col("close").between(min_price, max_price) & (F.col("trade_index") >= min_history_days))
    if exclude_st:
        name = next((c for c in ("name", "name_ind", "stock_name", "stock_name_ind") if c in df.columns), None)
        if name:
            df = df.filter(~F.coalesce(F.upper(F.col(name).cast("string")).contains("ST"), F.lit(False)))
    return df.filter(F.col("alpha_score").isNotNull())


def view(
    df: DataFrame,
    *,
    date=None,
    symbol_contains: str = "",
    label: tuple[str, str] | None = None,
    sort_by: str | None = None,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Filtered, optionally sorted slice of a pool."""
    if date is not None:
        df = df.filter(F.col("date") == F.lit(date).cast("date"))
    if symbol_contains:
        hit = F.lit(False)
        for name in ("symbol", "code"):
            if name in df.columns:
                text = F.upper(F.col(name).cast("string"))
                hit = hit | F.coalesce(text.contains(symbol_contains.upper()), F.lit(False))
        df = df.filter(hit)
    if label is not None and label[1] != "ALL":
        df = df.filter(F.col(label[0]).cast("string") == label[1])
    if sort_by and sort_by in df.columns:
        ties = [c for c in ("date", "symbol") if c in df.columns and c != sort_by]
        df = df.orderBy(F.desc_nulls_last(sort_by), *ties)
    if columns:
        df = df.select(*columns)
    return df
