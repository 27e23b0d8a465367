"""Bars derived from the order-line table: one bar per (supplier, week).

The board prefix cycles through four values by supplier key, so half of the
symbols are main-board codes.  Prices divide by a prime, which keeps averages
off exact decimal ties.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PRICE_SQL = {
    "wide": "l_extendedprice / 997.0",
    "narrow": "50.0 + l_extendedprice / 9973.0",
}
SYMBOL_SQL = (
    "CASE l_suppkey % 4 WHEN 0 THEN '00' WHEN 1 THEN '60' WHEN 2 THEN '30' ELSE '68' END"
    " || lpad(CAST(l_suppkey % 10000 AS {text}), 4, '0')"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trades(spark: SparkSession, sf_dir: str, price: str = "wide") -> DataFrame:
    """Single trades with the key ``k`` that orders them within a week."""
    return table(spark, sf_dir, "lineitem").select(
        F.expr(SYMBOL_SQL.format(text="STRING")).alias("symbol"),
        F.date_trunc("week", "l_shipdate").cast("date").alias("date"),
        F.expr(PRICE_SQL[price]).cast("double").alias("px"),
        F.col("l_quantity").alias("q"),
        F.col("l_extendedprice").alias("a"),
        F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice").alias("k"),
    )


#: A week's day number takes the lower 32 bits of a bar's key; bit 32 says that there is none, the bits above hold the supplier.
_NO_DAY, _NO_SUPPLIER = 1 << 32, 10000


def bars(spark: SparkSession, sf_dir: str, price: str = "wide") -> DataFrame:
    """Weekly bars; first and last trade are decided by the full row key.

    Supplier and week travel as one number, which Spark sorts by radix.  Prices rise with ``l_extendedprice``, so they are
    worked out once per bar, and the least and greatest row keys already hold what open and close need.
    """
    week = "unix_date(CAST(date_trunc('week', l_shipdate) AS DATE))"
    rows = table(spark, sf_dir, "lineitem").select(
        F.expr(f"shiftleft(CAST(coalesce(l_suppkey % 10000, {_NO_SUPPLIER}) AS BIGINT), 33) + coalesce({week} + 2147483648L, {_NO_DAY}L)").alias("bar"),
        "l_quantity",
        F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice").alias("k"),
    )
    found = rows.groupBy("bar").agg(
        F.min("k").alias("first"),
        F.max("k").alias("last"),
        F.max("k.l_extendedprice").alias("high"),
        F.min("k.l_extendedprice").alias("low"),
        F.sum("l_quantity").alias("volume"),
        F.sum("k.l_extendedprice").alias("amount"),
    ).withColumn("l_suppkey", F.expr(f"nullif(shiftright(bar, 33), {_NO_SUPPLIER})"))
    return found.select(
        F.expr(SYMBOL_SQL.format(text="STRING")).alias("symbol"),
        F.expr(f"date_from_unix_date(CAST(nullif(bar & {2 * _NO_DAY - 1}L, {_NO_DAY}L) - 2147483648L AS INT))").alias("date"),
        *[F.expr(PRICE_SQL[price].replace("l_extendedprice", x)).cast("double").alias(name)
          for name, x in (("open", "first.l_extendedprice"), ("high", "high"), ("low", "low"), ("close", "last.l_extendedprice"))],
        "volume",
        "amount",
    ).withColumn("file", F.concat("symbol", F.lit(".txt")))


def index_bars(bars: DataFrame) -> DataFrame:
    """A market index: equal-weighted mean of all bars per week."""
    return (
        bars
        .groupBy("date")
        .agg(*[F.avg(c).alias(c) for c in ("open", "high", "low", "close", "volume", "amount")])
    )


def round4(x: Column) -> Column:
    """Half-up rounding with the same floating steps as the SQL side uses."""
    return F.floor(x * 10000.0 + 0.5).cast("double") / 10000.0


def tidy(df: DataFrame) -> DataFrame:
    """Doubles rounded to four places, integers widened to BIGINT."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(name)
        if kind == "double":
            c = round4(c)
        elif kind in ("int", "smallint", "tinyint"):
            c = c.cast("bigint")
        out.append(c.alias(name))
    return df.select(*out)
