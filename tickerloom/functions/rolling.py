"""Rolling windows over one symbol's bars.

Bars are unique per (symbol, calendar day), so a symbol partition holds at most
366 rows per year of history however large the table is: the partition is
bounded by the calendar, and these windows stay on one hash-partitioning by
symbol with no further exchange.

Operators list the windows they need; ``attach`` adds the missing ones in a
single projection.  All of them share one window specification, so a pipeline
that attaches its needs up front pays for one sort and one window operator, and
no window is computed twice.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame

from tickerloom.functions.scalars import project

BY_SYMBOL_SQL = "PARTITION BY symbol ORDER BY date"

PREFIX = "_w_"
BAR = f"{PREFIX}bar"
# Columns that cleaning guarantees to be present; others are gated by a count.
ALWAYS_PRESENT = {"open", "high", "low", "close"}


class Need(NamedTuple):
    """``agg`` of ``column`` over ``size`` rows ending ``shift`` rows ago."""

    agg: str
    column: str
    size: int
    shift: int = 0

    @property
    def name(self) -> str:
        return f"{PREFIX}{self.agg}_{self.column}_{self.size}_{self.shift}"

    @property
    def sql(self) -> str:
        if self.agg in ("lag", "lead"):
            return f"{self.agg}({self.column}, {self.size}) OVER ({BY_SYMBOL_SQL})"
        first, last = self.size + self.shift - 1, self.shift
        end = "CURRENT ROW" if last == 0 else f"{last} PRECEDING"
        rows = f"ROWS BETWEEN {first} PRECEDING AND {end}" if first > last else f"ROWS BETWEEN {end} AND {end}"
        return f"{self.agg}({self.column}) OVER ({BY_SYMBOL_SQL} {rows})"


def needs(agg: str, column: str, *sizes: int, shift: int = 0) -> list[Need]:
    return [Need(agg, column, int(s), shift) for s in sizes if int(s) > 0]


def attach(df: DataFrame, wanted: list[Need]) -> DataFrame:
    """Add the windows in ``wanted`` that ``df`` does not have yet."""
    have = set(df.columns)
    wanted = list(wanted) + [
        Need("count", n.column, n.size, n.shift)
        for n in wanted
        if n.column not in ALWAYS_PRESENT and n.agg not in ("lag", "lead", "count", "collect_list")
    ]
    new = {n.name: n.sql for n in wanted if n.name not in have}
    if BAR not in have:
        new[BAR] = f"row_number() OVER ({BY_SYMBOL_SQL})"
    return df.select("*", *project(new)) if new else df


def by_symbol(df: DataFrame) -> DataFrame:
    """Hash-partition bars by symbol for a long chain of symbol windows.

    This is the exchange the windows need anyway, with a fixed partition count:
    a chain widens rows tenfold, and partitions coalesced by input size would
    leave too few tasks for it.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "symbol")


def detach(df: DataFrame, like: DataFrame | None = None) -> DataFrame:
    """Drop window columns, except those already in ``like``."""
    keep = set(like.columns) if like is not None else set()
    return df.drop(*[c for c in df.columns if c.startswith(PREFIX) and c not in keep])


def _gated(agg: str, x: str, size: int, at_least: int | None, shift: int = 0) -> str:
    value = Need(agg, x, int(size), shift).name
    least = int(size) if at_least is None else int(at_least)
    if x not in ALWAYS_PRESENT:
        seen = Need("count", x, int(size), shift).name
        return f"(CASE WHEN {seen} >= {max(least, 1)} THEN {value} END)"
    return value if least + shift <= 1 else f"(CASE WHEN {BAR} >= {least + shift} THEN {value} END)"


def loose(size: int) -> int:
    """Default warm-up of the indicator cache: a third of the window."""
    return max(1, int(size) // 3)


def previous(x: str, k: int = 1) -> str:
    return Need("lag", x, k).name


def mean(x: str, size: int, at_least: int | None = None) -> str:
    return _gated("avg", x, size, at_least)


def highest(x: str, size: int, at_least: int | None = None, shift: int = 0) -> str:
    return _gated("max", x, size, at_least, shift)


def lowest(x: str, size: int, at_least: int | None = None, shift: int = 0) -> str:
    return _gated("min", x, size, at_least, shift)


def total(x: str, size: int, at_least: int | None = None) -> str:
    return _gated("sum", x, size, at_least)


def deviation(x: str, size: int, at_least: int | None = None) -> str:
    return _gated("stddev_samp", x, size, at_least)
