import hashlib
import random

import duckdb
import pytest

from tickerloom.llm import line_dedup

BLANKS = " \t\n\x0b\f\r"
UPPER = {c: c + 32 for c in range(65, 91)}


def brute_force(rows, least_docs=2):
    rows = [(d, (t or "").split("\n")) for d, t in rows if d is not None]
    held = {}
    for d, lines in rows:
        for line in lines:
            held.setdefault(line.strip(BLANKS).translate(UPPER), set()).add(d)
    out = []
    for d, lines in rows:
        keep = [x for x in lines if not (len(k := x.strip(BLANKS).translate(UPPER)) >= 10 and len(held[k]) >= least_docs and d > min(held[k]))]
        out.append((d, len(lines), len(lines) - len(keep), hashlib.sha256("\n".join(keep).encode()).hexdigest()))
    return sorted(out)


def documents():
    r = random.Random(2)
    pool = [f"line number {i} of the pool" for i in range(40)] + ["short", "123456789", "1234567890", "ÄÖÜ äöü ß日本", "ÄÖÜ ÄÖÜ ß日本", "", "   ", " padded line ", "𝒳" * 9, "𝒳" * 10]
    rows = [(i, "\n".join(r.choice(["", " ", "\t", "\x0b"]) + (x.upper() if r.random() < 0.2 else x) + r.choice(["", "\r", " "]) for x in r.choices(pool, k=r.randint(1, 12)))) for i in range(3, 80)]
    rows += [(i, f"a line that everyone holds\nown line {i} here") for i in range(200, 400)]
    rows += [(500, None), (501, ""), (502, "\n"), (503, "\n\n"), (None, "a line that everyone holds"), (-4, "A LINE that everyone holds"), (600, "again and again\n" * 3000)]
    rows += [(700, "one id, two texts\nfirst"), (700, "one id, two texts\nsecond"), (701, "one id, two texts"), rows[0], (601, rows[-1][1])]
    return rows


def digests(frame):
    return sorted(tuple(r) for r in line_dedup.line_digest(frame).collect())


@pytest.fixture(scope="module")
def table(spark):
    rows = [(d, t, 1, 2, "x", "y", [0]) for d, t in documents()]
    return spark.createDataFrame(rows, "doc_id long, text string, d long, h long, x string, lines string, gone array<int>").repartition(4).cache()


@pytest.mark.parametrize("hot", [1, 50, 10**9])
def test_lines_equal_brute_force(table, monkeypatch, hot):
    monkeypatch.setattr(line_dedup, "HOT", hot)
    assert digests(table) == brute_force(documents())


def test_thresholds_above_two(table):
    got = line_dedup.without_repeated_lines(table, least_docs=9).collect()
    assert sorted((r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256(r.text.encode()).hexdigest()) for r in got) == brute_force(documents(), 9)


def test_sql_says_the_same(table):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", documents())
    assert sorted(con.execute(line_dedup.LINES_SQL).fetchall()) == brute_force(documents())


def test_empty_table(spark):
    assert digests(spark.createDataFrame([], "doc_id long, text string")) == []


def test_main_path_has_no_python(table):
    plan = line_dedup.line_digest(table)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InArrow" not in plan and "InPandas" not in plan
