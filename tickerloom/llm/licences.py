"""Licence recognition by sentence rules, in DataFrame and SQL functions only.

A text loses the comment marks of its lines, is unwrapped and normalised to lower-case
letters and digits with single blanks and two marks: ends of sentences and of
paragraphs, and other line breaks, which can end a sentence or stand inside one.
Known sentences become their numbers, longest first, the rest vanishes, which leaves a number sequence per text.  Ordered rules are sequences
of numbers: the first rule takes all its occurrences, later rules see what is left, so a
full licence text is not reported again by its parts.

Only texts that hold one of ``ANCHORS`` are cut; every known sentence holds one.

Defined cases: null and empty texts and rows without id give no row; rows that
share an id are searched each on its own; repeated licences are counted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Sentences of public licence notices, as normalised.
SENTENCES = {
    "apache-name": "licensed under the apache license version 2 0",
    "apache-grant": "licensed under the apache license version 2 0 the license",
    "apache-use": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at",
    "apache-basis": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache-see": "see the license for the specific language governing permissions and limitations under the license",
    "mit-name": "released under the mit license",
    "mit-this": "this project is licensed under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "as-is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-name": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "gpl3-work": "this work is licensed under the gnu general public license version 3",
    "gpl-free": "this program is free software",
    "gpl-terms": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty",
    "cc-by-nc": "licensed under cc by nc 4 0",
    "cc-by": "licensed under cc by 4 0",
    "cc-by-sa": "licensed under cc by sa 4 0",
    "cc-by-long": "this work is licensed under a creative commons attribution 4 0 international license",
    "mpl2": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "all-rights": "all rights reserved no licence is granted",
}
# Single words, as line breaks can stand between two.
ANCHORS = ("licen", "warrant", "redistribut", "copyright", "software", "hereby")
#: Ordered: longer sequences before their parts.
RULES = (
    ("Apache-2.0", ("apache-grant", "apache-use", "apache-copy", "apache-basis", "apache-see")),
    ("Apache-2.0", ("apache-grant", "apache-use")),
    ("MIT", ("mit-grant", "mit-notice", "as-is")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-name")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-terms", "gpl-hope")),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-terms")),
    ("ISC", ("isc-grant",)),
    ("Apache-2.0", ("apache-name",)),
    ("MIT", ("mit-name",)),
    ("MIT", ("mit-this",)),
    ("GPL-3.0-only", ("gpl3-work",)),
    ("CC-BY-NC-4.0", ("cc-by-nc",)),
    ("CC-BY-SA-4.0", ("cc-by-sa",)),
    ("CC-BY-4.0", ("cc-by",)),
    ("CC-BY-4.0", ("cc-by-long",)),
    ("MPL-2.0", ("mpl2",)),
    ("no-licence", ("all-rights",)),
)
_NAMES = list(SENTENCES)
UNWRAP = r"([^.!?:;\s])[ \t\r]*\n[ \t]*([a-z(])"
BREAK = r"([.!?:;])\s"
COMMENT = r"(?m)^[ \t]*(?:(?:/\*+|\*+/?|//+|#+|;+|--+|%+|>+|<!--)[ \t]*)+"


def _sequence(rule: tuple[str, ...]) -> str:
    """A rule as the text that its numbers have in a sequence."""
    return "".join(f"<{_NAMES.index(name) + 1}>" for name in rule)


def licences(docs: DataFrame) -> DataFrame:
    """(doc_id, licence, occurrences, n_sentences): per document and licence the matches, and its known sentences."""
    source = docs.selectExpr("CAST(doc_id AS long) AS d", "CAST(text AS string) AS t").where("d IS NOT NULL AND t IS NOT NULL")
    source = source.where(" OR ".join(f"contains(lower(t), '{a}')" for a in ANCHORS))
    # \x01 ends a sentence or paragraph, \x02 is a line break that may.
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace("t", COMMENT, ""), UNWRAP, "$1 $2"), r"[.!?:;]\s+|\n[ \t\r]*\n\s*", "\x01")
    text = F.regexp_replace(F.lower(F.regexp_replace(text, "\n", "\x02")), "[^a-z0-9\x01\x02]+", " ")
    text = F.regexp_replace(F.trim(text), " ?([\x01\x02]) ?", "$1")
    for number, sentence in sorted(enumerate(SENTENCES.values(), 1), key=lambda x: -len(x[1])):
        text = F.regexp_replace(text, f"(?<=^|[\x01\x02]){sentence.replace(' ', '[ \x02]')}(?=$|[\x01\x02])", f"<{number}>")
    numbers = F.regexp_extract_all(text, F.lit("<([0-9]+)>"), 1)
    rows = source.select("d", numbers.alias("i")).where("size(i) > 0")
    rows = rows.select("d", F.size("i").alias("n"), F.concat(F.lit("<"), F.array_join("i", "><"), F.lit(">")).alias("s0"))
    found = []
    for k, (name, rule) in enumerate(RULES):
        sequence = _sequence(rule)
        rows = rows.withColumn(f"s{k + 1}", F.expr(f"replace(s{k}, '{sequence}', '#')"))
        # Each match is one '#', so the length falls by the sequence's length less one.
        count = f"(length(s{k}) - length(s{k + 1})) div {len(sequence) - 1}"
        found.append(f"named_struct('licence', '{name}', 'c', {count})")
    long = rows.selectExpr("d", "n", f"inline(array({', '.join(found)}))").where("c > 0")
    return long.groupBy("d", "licence").agg(F.sum("c").cast("long").alias("occurrences"), F.max("n").cast("long").alias("n_sentences")).selectExpr(
        "d AS doc_id", "licence", "occurrences", "n_sentences")


def licences_sql() -> str:
    """The same for DuckDB over a view ``documents``."""
    known = ", ".join(f"'{s}'" for s in SENTENCES.values())
    steps, found = [], []
    for k, (name, rule) in enumerate(RULES):
        sequence = _sequence(rule)
        steps.append(f"r{k + 1} AS (SELECT *, replace(s{k}, '{sequence}', '#') AS s{k + 1} FROM r{k})")
        found.append(f"SELECT d, n, '{name}' AS licence, (length(s{k}) - length(s{k + 1})) // {len(sequence) - 1} AS c FROM r{len(RULES)}")
    return f"""
WITH cut AS (
  SELECT doc_id AS d, [k FOR k IN [list_position([{known}], trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g')))
    FOR s IN string_split(regexp_replace(regexp_replace(text, '{UNWRAP}', '\\1 \\2', 'g'), '{BREAK}', '\\1' || chr(10), 'g'), chr(10))] IF k > 0] AS i
  FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
r0 AS (SELECT d, len(i) AS n, '<' || array_to_string(i, '><') || '>' AS s0 FROM cut WHERE len(i) > 0),
{', '.join(steps)},
hits AS ({' UNION ALL '.join(found)})
SELECT d AS doc_id, licence, CAST(sum(c) AS BIGINT) AS occurrences, CAST(max(n) AS BIGINT) AS n_sentences FROM hits WHERE c > 0 GROUP BY d, licence
"""
