"""The daily refresh chain as a stream: new bar files in, refreshed pool out.

Each micro-batch of landed bars is merged into the bar table, which is stored by
month, and the window of the pool that those bars can reach is rebuilt.  A batch
first stores the merged rows of the months it touches under its own number, then
overwrites only these months.  A batch that is replayed after a crash finds its
stored rows and writes the same months again, so nothing is lost in between.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom.operators.cleaning import keep_last
from tickerloom.operators.pool import BuildWindow, build_pool, resolve_window
from tickerloom.sources.sinks import refresh_pool

LABEL_BARS = 20
BAR_SCHEMA = (
    "symbol string, file string, date date, open double, high double, low double, close double, volume double, amount double"
)


def merge_bars(stored: DataFrame | None, landed: DataFrame) -> DataFrame:
    """Stored bars overlaid by landed ones, unique per (symbol, date)."""
    fresh = landed.withColumn("_age", F.lit(1))
    both = fresh if stored is None else stored.withColumn("_age", F.lit(0)).unionByName(fresh, allowMissingColumns=True)
    return keep_last(both, ["symbol", "date"], ["_age", "file", "close"]).drop("_age")


def first_affected_day(bars: DataFrame, changed: DataFrame):
    """The earliest date with a changed bar among itself and its next ``LABEL_BARS`` bars.

    Only symbols with changed bars are looked at, in windows bounded by the calendar.
    """
    keys = changed.select("symbol", "date").distinct().withColumn("_new", F.lit(1))
    mine = bars.select("symbol", "date").join(keys.select("symbol").distinct(), "symbol", "left_semi").join(keys, ["symbol", "date"], "left")
    reach = f"max(_new) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN CURRENT ROW AND {LABEL_BARS} FOLLOWING)"
    return mine.select("date", F.expr(reach).alias("hit")).filter("hit = 1").agg(F.min("date").alias("d")).first()["d"]


def refresh_batch(bars: DataFrame, pool_path: str, strategy_name: str, first_day) -> BuildWindow:
    """Rebuild the pool from ``first_day`` to the newest bar."""
    window = resolve_window(bars, start_date=first_day, incremental=True)
    new = build_pool(bars, strategy_name, start_date=window.start, end_date=window.end, validate=False)
    refresh_pool(new, pool_path, strategy_name, window)
    return window


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def merge_months(spark: SparkSession, fresh: DataFrame, bars_path: str, staged: str) -> DataFrame:
    """Merge ``fresh`` into the bars by month; ``staged`` keeps the merged months until the batch is over."""
    month = F.date_format("date", "yyyy-MM")
    if not _exists(spark, f"{staged}/_SUCCESS"):
        fresh = fresh.withColumn("month", month)
        stored = None
        if _exists(spark, bars_path):
            stored = spark.read.parquet(bars_path)
            stored = (stored if "month" in stored.columns else stored.withColumn("month", month)).join(
                F.broadcast(fresh.select("month").distinct()), "month", "left_semi")  # one row per month
        merge_bars(stored, fresh).write.mode("overwrite").parquet(staged)
    merged = spark.read.parquet(staged)
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(bars_path)
    return merged.drop("month")


def start_daily_refresh(
    spark: SparkSession,
    landing: str,
    bars_path: str,
    pool_path: str,
    strategy_name: str,
    checkpoint: str,
):
    """Start the stream.  ``bars_path`` is a table by month, written by this stream or by :func:`merge_months`."""
    landed = spark.readStream.schema(BAR_SCHEMA).parquet(landing)

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        fresh = batch.filter("date IS NOT NULL AND symbol IS NOT NULL").persist()
        try:
            if fresh.isEmpty():
                return
            merge_months(spark, fresh, bars_path, f"{checkpoint}/merged/{batch_id}")
            bars = spark.read.parquet(bars_path).drop("month")
            refresh_batch(bars, pool_path, strategy_name, first_affected_day(bars, fresh))
        finally:
            fresh.unpersist()

    return (
        landed.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
