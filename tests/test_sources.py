import datetime as dt

import pytest
from pyspark.sql import functions as F

from tickerloom.functions import scalars as S
from tickerloom.operators import cleaning as C
from tickerloom.operators import pool as P
from tickerloom.sources import bar_text as B
from tickerloom.sources import sinks
from tickerloom.sources import tables as TB

HEAD = "600000 浦发银行 日线 前复权\n日期\t    开盘\t    最高\t    最低\t    收盘\t    成交量\t    成交额\n"
BODY = "02/08/2021,2.17,2.22,2.10,2.21,100,500.5\n03/08/2021,2.2,2.3,2.1,2.25,,1\n03/08/2021,2.2,2.3,2.1,2.26,7,1\n04/08/2021,x,1,1,1,1,1\n#数据来源:通达信\n"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("txt")
    (root / "SH#600000.txt").write_bytes((HEAD + BODY).encode("gb18030"))
    (root / "000002.txt").write_bytes((HEAD + BODY.replace(",", "\t")).encode("utf-8-sig"))
    (root / "sub").mkdir()
    (root / "sub" / "300003.TXT").write_bytes((HEAD + BODY).encode("utf-16"))
    (root / "SZ#000004.txt").write_bytes(HEAD.encode("gbk"))
    (root / "notes.txt").write_bytes(b"20210802,1,2,1,2,1,1\n")
    return str(root)


@pytest.mark.parametrize("block", ["128m", "64b"])
def test_mixed_encodings_and_layouts(spark, folder, block):
    """Files read as one block, and split into many in the middle of lines."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    try:
        got = B.import_bars(spark, folder).orderBy("symbol", "date").collect()
        titles = {r["file"][-13:]: r["line"] for r in B.read_lines(spark, folder).filter("part = 0 AND line_no = 0").collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sum("浦发银行" in t for t in titles.values()) == 4
    symbols = {r["symbol"] for r in got}
    assert symbols == {"SH#600000", "SZ#000002", "SZ#300003"}
    for s in ("SH#600000", "SZ#300003"):
        rows = [r for r in got if r["symbol"] == s]
        assert [r["date"] for r in rows] == [dt.date(2021, 8, 2), dt.date(2021, 8, 3)]
        assert rows[1]["close"] == 2.26 and rows[0]["volume"] == 100


def test_import_report_and_rejects(spark, folder):
    r = B.import_report(spark, folder).first().asDict()
    assert r == {"total_txt_files": 5, "imported_files": 3, "skipped_files": 2, "failed_files": 0, "empty_raw_files": 1, "empty_normalized_files": 0}
    assert B.rejected_lines(B.read_lines(spark, folder)).filter("line LIKE '%x%1%'").count() == 3


def test_symbols_dates_numbers(spark):
    df = spark.createDataFrame([("SH#600000.txt", "2021-08-02", "1,234.5", "Yes"), ("12", "02/08/2021", "abc", "0.0"), ("a.b", "20210802", "inf", "maybe")], "s string, d string, n string, b string")
    rows = df.select(
        S.normalize_symbol("s").alias("p1"), S.normalize_symbol("s", True).alias("p1t"), S.first_code("s").alias("p2"), S.code_in_parts("s").alias("p3"),
        S.exchange_symbol("s").alias("p4"), S.normalize_code(F.concat("s", F.lit(".0"))).alias("p5"), S.parse_date_day_first("d").alias("d1"), S.parse_date("d").alias("d2"),
        S.parse_number("n").alias("n"), S.parse_boolean("b").alias("b")).collect()
    assert [r["p1"] for r in rows] == ["600000", "000012", ""] and rows[2]["p1t"] == "A.B"
    assert [r["p4"] for r in rows] == ["SH#600000", None, None] and rows[1]["p5"] == "000012"
    assert rows[0]["p3"] == "600000" and rows[2]["p3"] == "A.B" and rows[0]["p2"] == "600000"
    assert {r["d1"] for r in rows} == {dt.date(2021, 8, 2)} and rows[1]["d2"] is None
    assert [r["n"] for r in rows] == [1234.5, None, None] and [r["b"] for r in rows] == [True, False, None]


def test_last_duplicate_wins_and_bad_bars_go(spark):
    rows = [("s", "2024-01-01", 1.0, 1.0, 1.0, c, i) for i, c in enumerate((5.0, 7.0, 6.0, -1.0))]
    df = spark.createDataFrame(rows, "symbol string, date string, open double, high double, low double, close double, pos int")
    assert [r["close"] for r in C.clean_bars(df, order=["pos"]).collect()] == [6.0]
    assert C.clean_bars(df.withColumn("symbol", F.lit("600001")), "alpha", order=["pos"]).first()["close"] == -1.0


def test_selected_rows(spark):
    df = spark.createDataFrame([(1, "a"), (0, ""), (2, "b")], "selected int, t string")
    assert C.selected_rows(df).count() == 1 and C.selected_rows(df, positive=True).count() == 2
    assert C.selected_rows(df.select(F.col("t").alias("selected"))).count() == 2
    assert C.selected_rows(df.select("t")).count() == 3


def test_parquet_bars_aliases_and_file_symbols(spark, tmp_path):
    df = spark.createDataFrame([("2024-01-02", 1.0, 2.0, 1.0, 2.0, 5.0, 9.0)], "`日期` string, `开盘` double, `最高` double, `最低` double, `收盘` double, vol double, `成交额` double")
    df.coalesce(1).write.parquet(str(tmp_path / "m"))
    row = TB.read_bars(spark, str(tmp_path / "m")).first()
    assert row["date"] == dt.date(2024, 1, 2) and row["volume"] == 5.0 and row["symbol"]
    with pytest.raises(ValueError, match="Missing required source"):
        TB.resolve_columns(df.drop("最高"))


def test_csv_encoding_index_and_codes(spark, tmp_path):
    (tmp_path / "t.csv").write_bytes("symbol,名称\n600000,浦发\n".encode("gb18030"))
    assert TB.read_table(spark, str(tmp_path / "t.csv")).first()["名称"] == "浦发"
    (tmp_path / "SH#999999.txt").write_text("title\n02/01/2024,1,1,1,100,1,1\n03/01/2024,1,1,1,110,1,1\n03/01/2024,1,1,1,120,1,1\n", encoding="utf-8")
    ix = B.read_index(spark, str(tmp_path)).orderBy("date").collect()
    assert [r["close"] for r in ix] == [100.0, 120.0] and ix[1]["index_return_pct"] == pytest.approx(20.0)
    codes = spark.createDataFrame([("600000.0", 0), ("nan", 1), ("12", 2), ("600000", 3), ("", 4)], "code string, i int")
    out = TB.code_list(codes, order="i")
    sinks.write_codes(out, str(tmp_path / "codes"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "codes")).collect()] == ["600000", "000012"]


def test_late_bytes_decide_the_encoding_of_each_file(spark, tmp_path):
    """A file of ASCII lines with one Chinese line at its very end, next to files in other encodings."""
    folder = tmp_path / "many.csv"
    folder.mkdir()
    plain = "code,name\n" + "".join(f"{i},plain{i}\n" for i in range(90_000))
    (folder / "a.csv").write_bytes((plain + "7,浦发银行\ncode,name\n").encode("gb18030"))
    (folder / "b.csv").write_bytes("code,name\n8,万科\n".encode("utf-8-sig"))
    (folder / "c.csv").write_bytes("code,name\n9,平安\n".encode("utf-16"))
    got = {r["code"]: r["name"] for r in TB.read_table(spark, str(folder)).filter("name NOT LIKE 'plain%'").collect()}
    assert got == {"7": "浦发银行", "8": "万科", "9": "平安", "code": "name"}


def test_indicator_subset_keeps_the_last_row_and_known_columns(spark, tmp_path):
    rows = [("2024-01-02", "SH#600000", 1.0, 5), ("2024-01-02", "600000", 2.0, 6), (None, "600001", 1.0, 7), ("2024-01-03", "", 1.0, 8)]
    spark.createDataFrame(rows, "date string, symbol string, daily_return_pct double, other int").coalesce(1).write.parquet(str(tmp_path / "i"))
    got = [tuple(r) for r in TB.read_indicator_subset(spark, str(tmp_path / "i")).collect()]
    assert got == [(dt.date(2024, 1, 2), "600000", 2.0)]


def test_span_of_a_stored_table_comes_from_footers(spark, bars, tmp_path):
    path = str(tmp_path / "bars")
    sinks.write_bars(bars, path)
    span = TB.date_span(spark, path)
    row = bars.agg(F.min("date"), F.max("date"), F.count("date")).first()
    assert (span.first, span.last, span.rows) == tuple(row)
    with TB._settings(spark, parquet__aggregatePushdown="true", sources__useV1SourceList=""):
        plan = TB.span_query(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [MIN(date), MAX(date), COUNT(date)]" in plan
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false"
    empty = str(tmp_path / "none")
    bars.where("false").write.parquet(empty)
    with pytest.raises(RuntimeError, match="no trading day"):
        P.resolve_window(spark.read.parquet(empty), market=TB.date_span(spark, empty))
    with pytest.raises(RuntimeError, match="no trading day between"):
        P.resolve_window(bars.where("date < DATE '2022-03-01'"), start_date="2022-05-01", market=span)
