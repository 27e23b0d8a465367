"""Writers for bars, indicators, pools and reports.

Everything that belongs together is one release (:mod:`releases`): its tables and its
description change in one step, or not at all.  Rows are checked by aggregates of the job
that writes them, before the step.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom.operators.alpha import TOP_COLUMNS
from tickerloom.operators.audit import value_metrics, value_problems
from tickerloom.operators.contract import SCHEMA_VERSION, pool_checks
from tickerloom.operators.labels import HORIZON_MAX
from tickerloom.operators.pool import BuildWindow, merge_window
from tickerloom.scratch import materialize, observed
from tickerloom.sources import releases

#: Files per bar table and bucket; symbols of one bucket share files.
BUCKETS = 64


# --------------------------------------------------------------------------
# bars and indicators by symbol
# --------------------------------------------------------------------------

def write_bars(bars: DataFrame, path: str) -> None:
    """Market cache: files clustered by symbol so that symbol filters prune row groups."""
    bars.repartition("symbol").sortWithinPartitions("symbol", "date").write.mode("overwrite").parquet(path)


def save_by_symbol(table: DataFrame, name: str, buckets: int = BUCKETS) -> DataFrame:
    """Store ``table`` in the catalog in buckets of symbols, sorted by symbol and date; returns its scan.

    Steps that group or join by symbol read such a table without an exchange, as often as they like.
    """
    spark = table.sparkSession
    rows = table.repartition(buckets, "symbol")
    rows.write.mode("overwrite").format("parquet").bucketBy(buckets, "symbol").sortBy("symbol", "date").saveAsTable(name)
    return spark.table(name)


def _described(rows: DataFrame) -> dict:
    """Size, symbols and dates of a stored table; reads two columns."""
    row = rows.agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("symbol").alias("symbols"),
        F.min("date").cast("string").alias("date_min"), F.max("date").cast("string").alias("date_max"),
    ).first()
    return row.asDict() | {"columns": rows.columns}


def write_indicators(table: DataFrame, path: str, added: Sequence[str] = (), **params) -> releases.Release:
    """Indicator table and its description, clustered by symbol.

    Values of the ``added`` user columns are audited by the job that writes them; a breach leaves the old release.
    """
    spark = table.sparkSession
    before = releases.current(spark, path)
    rows, seen = observed(table.repartition("symbol").sortWithinPartitions("symbol", "date"), value_metrics(added))
    staged = {"indicators": releases.stage(rows, path, "indicators")}
    errors, warnings = value_problems(added, seen.get)
    if errors:
        raise ValueError("user indicators failed their audit:\n" + "\n".join(f"- {e}" for e in errors))
    params = params | {"audit_warnings": warnings} if added else params
    facts = _described(releases.read(spark, path, "indicators", release=releases.Release(0, staged)))
    return releases.commit(spark, path, before, staged, facts | params)


# --------------------------------------------------------------------------
# pools
# --------------------------------------------------------------------------

def _by_month(pool: DataFrame) -> DataFrame:
    return pool.withColumn("month", F.date_format("date", "yyyy-MM"))


def read_pool(spark: SparkSession, path: str, months: list[str] | None = None) -> DataFrame:
    """The stored pool, or some of its months."""
    return releases.read(spark, path, "pool", months)


def _pool_facts(spark: SparkSession, path: str, tables: dict, strategy_name: str, report, **facts) -> dict:
    stored = releases.read(spark, path, "pool", release=releases.Release(0, tables))
    return _described(stored) | {
        "strategy_name": strategy_name, "schema_version": SCHEMA_VERSION, "forward_buy_price": "t1_open",
        "forward_return_definition": f"t{{h}}_close / t1_open - 1 for h = 1..{HORIZON_MAX}",
        "factor_columns": report.factor_columns, "schema_warnings": report.warnings,
    } | facts


def write_pool(pool: DataFrame, path: str, strategy_name: str, csv: bool = False, **facts) -> releases.Release:
    """Pool by month, optional csv, and its description.

    The contract is checked by the job that writes the rows; a pool that breaks it never becomes a release.
    """
    spark = pool.sparkSession
    before = releases.current(spark, path)
    checks = pool_checks(pool, strategy_name)
    rows, seen = observed(pool, checks.metrics)
    tables = {"pool": releases.stage(_by_month(rows), path, "pool", by="month")}
    report = checks.judge(seen.get)
    if csv:
        tables["csv"] = releases.stage(releases.read(spark, path, "pool", release=releases.Release(0, tables)), path, "csv", "csv")
    return releases.commit(spark, path, before, tables, _pool_facts(spark, path, tables, strategy_name, report, **facts))


def refresh_pool(new: DataFrame, path: str, strategy_name: str, window: BuildWindow) -> DataFrame:
    """Replace the window's rows in a stored pool.

    Only months that the window touches are read and written; the others stay where they are.  A
    month that has no rows any more is in the new release no more.  A csv copy is written anew if the
    pool has one.  Returns the counts of the merge.
    """
    spark = new.sparkSession
    before = releases.current(spark, path)
    stored = before.tables["pool"]
    first, last = str(window.start)[:7], str(window.end)[:7]
    touched = [m for m in stored.parts if first <= m <= last]
    old = releases.read(spark, path, "pool", touched, before)
    fresh = materialize(new, "refresh-new")
    merged = merge_window(old, fresh, window.start, window.end)
    checks = pool_checks(merged, strategy_name, whole=False)
    rows, seen = observed(merged, checks.metrics)
    written = releases.stage(_by_month(rows), path, "pool", by="month")
    report = checks.judge(seen.get)
    outside = {m: f for m, f in stored.parts.items() if m not in touched}
    tables = {"pool": releases.Table("parquet", written.schema, outside | written.parts)}
    if "csv" in before.tables:
        tables["csv"] = releases.stage(releases.read(spark, path, "pool", release=releases.Release(0, tables)), path, "csv", "csv")
    kept = {k: v for k, v in before.facts.items() if k not in ("rows", "symbols", "date_min", "date_max", "columns", "factor_columns", "schema_warnings")}
    releases.commit(spark, path, before, tables, kept | _pool_facts(spark, path, tables, strategy_name, report))
    final = releases.read(spark, path, "pool", list(written.parts), releases.Release(0, tables))
    inside = F.col("date").between(F.lit(window.start), F.lit(window.end))
    return (
        old.select(F.lit("old").alias("src"), inside.alias("hit"))
        .unionByName(fresh.select(F.lit("new").alias("src"), inside.alias("hit")))
        .unionByName(final.select(F.lit("final").alias("src"), inside.alias("hit")))
        .groupBy("src").agg(F.count(F.lit(1)).alias("rows"), F.count_if("hit").alias("rows_in_window"))
    )


# --------------------------------------------------------------------------
# reports
# --------------------------------------------------------------------------

def write_codes(codes: DataFrame, path: str) -> None:
    """Distinct codes, one per line, in order of first appearance."""
    codes.orderBy("pos").select("code").write.mode("overwrite").text(path)


def write_set(tables: dict[str, DataFrame], path: str, kind: str = "csv", by: dict[str, str] | None = None, **facts) -> releases.Release:
    """Several tables as one release that replaces the one before; ``by`` names a column whose values are parts."""
    spark = next(iter(tables.values())).sparkSession
    before = releases.current(spark, path)
    staged = {name: releases.stage(df, path, name, kind, (by or {}).get(name)) for name, df in tables.items()}
    return releases.commit(spark, path, before, staged, facts)


def write_direction(summary: DataFrame, detail: DataFrame, path: str, members: DataFrame | None = None) -> releases.Release:
    """Summary, bucket detail, optional member detail, and the factors of each action hint as a part of their own."""
    tables = {"indicator_summary": summary, "indicator_bucket_detail": detail, "indicator_factors": summary}
    if members is not None:
        tables["indicator_bucket_member_detail"] = members
    return write_set(tables, path, by={"indicator_factors": "action_hint"})


def write_alpha(path: str, *, top, daily, monthly, summary, rank_ic, feature_ic, horizons=(1, 2, 3)) -> releases.Release:
    """The six alpha tables, replaced together."""
    labels = [c for h in horizons for c in (f"ret_T{h}_pct", f"up_T{h}")]
    keep = [c for c in [*TOP_COLUMNS, *labels] if c in top.columns]
    tables = {
        "top": top.select(*keep), "daily": daily, "monthly": monthly, "summary": summary,
        "rank_ic": rank_ic, "feature_ic": feature_ic,
    }
    return write_set({f"individual_alpha_{n}": df for n, df in tables.items()}, path)
