import re
import textwrap

import duckdb

from tickerloom.llm.licences import ANCHORS, RULES, SENTENCES, licences, licences_sql

APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at
"""
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""
ROWS = [
    (1, f"Prose before. More\n{MIT}\nafter it."),
    (2, "x\nLicensed under the Apache License, Version 2.0.\nReleased under the MIT License.\nReleased under the MIT License."),
    (3, APACHE), (4, None), (5, ""), (6, "no notice here, licence or not"), (7, "LICENSED UNDER CC BY-NC 4.0!\n" * 3), (8, "Released under the MIT\nlicense."),
    (9, "word " * 5000 + "\nReleased under the MIT License.\n" + "word " * 5000), (10, "Released under the MIT Licenses."), (2, "Licensed under CC BY 4.0."), (None, MIT),
]


def test_rules_take_longest_sequences(spark):
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in ROWS], "doc_id long, text string, licence string, n int")
    got = sorted((r["doc_id"], r["licence"], r["occurrences"]) for r in licences(df).collect())
    assert got == [(1, "MIT", 1), (2, "Apache-2.0", 1), (2, "CC-BY-4.0", 1), (2, "MIT", 2), (3, "Apache-2.0", 1), (7, "CC-BY-NC-4.0", 3), (8, "MIT", 1), (9, "MIT", 1)]
    assert licences(df.limit(0)).count() == 0


def test_sql_restatement_agrees(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    documents = df.toPandas()  # noqa: F841
    rows = duckdb.sql(licences_sql()).fetchall()
    assert sorted(rows) == sorted(tuple(r[c] for c in ("doc_id", "licence", "occurrences", "n_sentences")) for r in licences(df).collect())


def test_tables_are_consistent():
    for name, sentence in SENTENCES.items():
        assert re.fullmatch(r"[a-z0-9]+( [a-z0-9]+)*", sentence), name
        assert any(a in sentence for a in ANCHORS), name
    for i, (_, rule) in enumerate(RULES):
        assert all(x in SENTENCES for x in rule)
        for _, later in RULES[:i]:
            assert "/".join(later) not in "/".join(rule) or len(later) >= len(rule)


BASIS = """Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, \
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."""
SEE = "See the License for the specific language governing permissions and limitations under the License."


def test_every_width_and_comments(spark):
    grant, notice = (" ".join(p.split()) for p in MIT.split("\n\n"))
    apache = " ".join(APACHE.split()) + " http://www.apache.org/licenses/LICENSE-2.0"
    first, copy = apache.split(" You may obtain")
    apache = [first, "You may obtain" + copy.split(" http")[0], "http" + copy.split(" http")[1], f"{BASIS} {SEE}"]
    rows, due = [], set()
    for width in range(40, 81):
        for k, (mark, end) in enumerate((("", ""), (" * ", " */"), ("# ", ""), ("// ", ""))):
            for j, (name, parts) in enumerate((("MIT", [grant, notice]), ("Apache-2.0", apache))):
                lines = "\n\n".join(textwrap.fill(p, width, break_long_words=False, break_on_hyphens=False) for p in parts).split("\n")
                d = 100 * width + 10 * k + j
                rows.append((d, ("/*\n" if end else "") + "\n".join((mark + x).rstrip() for x in lines) + "\n" + end))
                due.add((d, name, 1, 5 if j else 2))
    got = {tuple(r) for r in licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == due
