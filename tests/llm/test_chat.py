import random

import duckdb

from tickerloom.llm import chat


def brute_force(rows):
    talks = {}
    for c, turn, role, text in set(rows):
        if c is not None and turn is not None:
            talks.setdefault(c, set()).add((turn, role or "", text or ""))
    talks = {c: [(r, t) for _, r, t in sorted(x)] for c, x in talks.items()}
    return {c for c, x in talks.items() if not any(
        y[: len(x)] == x and (len(y) > len(x) or d < c) for d, y in talks.items() if d != c)}, talks


def conversations():
    r, rows = random.Random(5), []
    for c in range(60):
        base, n = r.randrange(6), r.randint(1, 9)
        for t in range(n):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", f"talk {base} turn {t}" + (" odd" if c % 13 == 12 and t == 2 else "")))
    rows += [(70, t, "user", f"long {t}") for t in range(3000)] + [(71, t, "user", f"long {t}") for t in range(2500)] + [(72, 5 * t, "user", f"long {t}") for t in range(100)]
    rows += rows[:7] + [(None, 0, "user", "x"), (80, None, "user", "x"), (81, 0, None, None), (82, 0, None, None), (83, 1, "user", "b"), (83, 1, "user", "a")]
    return rows


def test_maximal_conversations_equal_brute_force(spark):
    rows = conversations()
    df = spark.createDataFrame([(*x, 1, "z") for x in rows], "conv_id long, turn int, role string, text string, n int, x string").repartition(5)
    kept, talks = brute_force(rows)
    got = {}
    for r in chat.chat_segments(df).collect():
        got.setdefault(r["conv_id"], {})[r["place"]] = (r["role"], r["segment"], r["n_turns"])
    assert set(got) == kept and 71 not in kept and 72 not in kept
    for c, turns in got.items():
        assert [turns[i][0] for i in range(1, len(turns) + 1)] == [r for r, _ in talks[c]] and all(t[2] == len(turns) for t in turns.values())
        text = "".join(turns[i][1] for i in range(1, len(turns) + 1))
        assert text == "<|chat|>\n" + "".join(f"<|{r}|>\n{t}<|end|>\n" for r, t in talks[c]) + "<|done|>\n"


def test_sql_restatement_agrees(spark):
    rows = [x for x in conversations() if x[0] is None or x[0] < 70 or x[0] > 72]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    conversations_table = df.toPandas().astype({"conv_id": "Int64", "turn": "Int64"})  # noqa: F841
    sql = duckdb.sql(chat.CHAT_SQL.replace("FROM conversations ", "FROM conversations_table ")).fetchall()
    assert sorted(sql) == sorted(tuple(r) for r in chat.chat_segments(df).collect())
    assert chat.chat_segments(df.limit(0)).count() == 0
