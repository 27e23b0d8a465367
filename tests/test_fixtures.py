import datetime as dt

from pyspark.sql import functions as F

from tickerloom.plans import fixtures as X


def test_bars_of_odd_trades_equal_those_of_single_trades(spark, tmp_path):
    """Ties in all but the last fields of the row key, missing suppliers, days and prices, suppliers beyond 10,000 and below zero; one number is the key."""
    day = dt.datetime(1995, 3, 1)
    rows = [(o, p, s, n, q, a, day + dt.timedelta(days=d, hours=h))
            for s in (3, 10003, -7, 9999) for o, p, n, q, a, d, h in
            ((5, 1, 1, 2.0, 100.0, 0, 0), (5, 2, 1, 3.0, 90.0, 0, 0), (5, 2, 1, 4.0, 95.5, 0, 0), (5, 1, 1, 1.0, 300.0, 4, 3), (4, 9, 7, 1.0, 20.0, 4, 3), (1, 1, 1, 1.0, 50.0, 40, 0))]
    rows += [(1, 1, None, 1, 1.0, 10.0, day), (2, 1, None, 1, None, 11.0, None), (3, 1, 3, 1, 1.0, 12.0, None), (0, 1, 9999, 1, 1.0, None, day), (1, 1, 8, 1, 1.0, None, dt.datetime(1960, 1, 6))]
    lines = spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_shipdate timestamp")
    lines.repartition(3).write.parquet(f"{tmp_path}/lineitem.parquet")
    for price in X.PRICE_SQL:
        plain = X.trades(spark, str(tmp_path), price).groupBy("symbol", "date").agg(
            F.min_by("px", "k").alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", "k").alias("close"),
            F.sum("q").alias("volume"), F.sum("a").alias("amount")).withColumn("file", F.concat("symbol", F.lit(".txt")))
        bars = X.bars(spark, str(tmp_path), price)
        assert bars.schema == plain.schema
        assert sorted(map(str, bars.collect())) == sorted(map(str, plain.collect()))
    assert "hashpartitioning(bar#" in bars._jdf.queryExecution().executedPlan().toString()
