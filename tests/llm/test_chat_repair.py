import hashlib
import random
import re
import zlib

import pytest

from tickerloom.llm import chat_repair
from tickerloom.llm.queries import op11_conversation_repair

GOOD = re.compile(r"(s?(ua)+)?")


def cheapest(rows):
    """(cost, audit, repaired) by dynamic programming over whole edit strings; rows are (fault, role, text)."""
    after = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
    best = {"": (0, "", ())}

    def inserted(best):
        for _ in range(3):
            for state, (cost, audit, out) in list(best.items()):
                for role in ("user", "assistant"):
                    to = after.get((state, role[0]))
                    new = (cost + 3, audit + "I", (*out, f"{role}:"))
                    if to and (to not in best or new[:2] < best[to][:2]):
                        best[to] = new
        return best

    for fault, role, text in rows:
        new = {}

        def offer(to, one, new=new):
            if to is not None and (to not in new or one[:2] < new[to][:2]):
                new[to] = one

        for state, (cost, audit, out) in inserted(best).items():
            offer(state, (cost + 4, audit + "D", out))
            if fault not in ("blank", "duplicate"):
                extra = 3 * (fault == "truncated")
                if role:
                    offer(after.get((state, role[0])), (cost + extra, audit + "K", (*out, f"{role}:{text}")))
                for to in ("user", "assistant"):
                    offer(after.get((state, to[0])), (cost + extra + 3, audit + "R", (*out, f"{to}:{text}")))
        best = new
    return min(x for s, x in inserted(best).items() if s in ("", "a"))


def brute_force(table):
    """Digest per conversation straight from the contract."""
    talks = {}
    for c, turn, role, text in table:
        rows = talks.setdefault(c, [])
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        rows += [(turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    out = {}
    for c, rows in talks.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, judged = set(), []
        for _, role, text in rows:
            solid = re.findall(r"[^\x20\x09-\x0d]", text)
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else "" if solid[-1] in ".!?" else "truncated"
            seen.add((role, text))
            judged.append((fault, role, text))
        cost, audit, lines = cheapest(judged)
        turns = [t for t, _, _ in rows if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(judged[:-1], judged[1:], strict=True)) if judged else 0
        counts = [sum(f == x for f, _, _ in judged) for x in ("blank", "duplicate", "truncated")]
        out[c] = (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def digest(spark, rows, tmp_path=None):
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat_repair.repair_digest(chat_repair.damaged(frame.repartition(3))).collect()
    assert len(got) == len({r.conv_id for r in got})
    return {r.conv_id: tuple(r)[1:] for r in got}


def talk(r, c, n, roles="uas"):
    names = {"u": "user", "a": "assistant", "s": "system", "t": "tool", "-": ""}
    return [(c, t, names[r.choice(roles) if r.random() < 0.4 else "ua"[t % 2]], f"text {r.randrange(n)} of it" + r.choice(["", ".", "!", "?", ". \n"])) for t in range(n)]


def test_conversations_equal_brute_force(spark):
    r = random.Random(3)
    rows = []
    for c in range(300):
        rows += talk(r, c, r.randint(1, 14), r.choice(["uas", "uast-", "u"]))
    rows += [(None, None, None, None), (None, 3, None, "x."), (500, None, "user", "a."), (500, None, "user", "a."), (500, None, "assistant", "b"), (500, 1, "user", "a."),
             (501, 4, "user", ""), (502, 1, "assistant", " \t\n\x0b"), (503, 9, "system", "only."), (504, 1, "user", "twice."), (504, 1, "user", "twice."), (504, 1, "user", "another."), (504, -5, "user", "ünder 日本")]
    rows += [x for x in rows if x[0] == 7]  # repeated rows
    assert digest(spark, rows) == brute_force(rows)


def test_long_conversations_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(chat_repair, "BLOCK", 7)
    r = random.Random(4)
    rows = [x for c in range(40) for x in talk(r, c, r.randint(1, 60))] + talk(r, 99, 900) + [(77, 5, "user", "same text")] * 40 + [(78, t, "user", "same text.") for t in range(50)]
    want = brute_force(rows)
    assert digest(spark, rows) == want


def test_steps_equal_dynamic_programming():
    r = random.Random(5)
    for _ in range(500):
        kinds = "".join(r.choice("suaoSUAOd") for _ in range(r.randint(0, 30)))
        names = {"s": "system", "u": "user", "a": "assistant", "o": "tool", "d": "user"}
        rows = [("blank" if k == "d" else "truncated" if k.isupper() else "", names[k.lower()], "") for k in kinds]
        assert "".join(chat_repair.steps(kinds)) == cheapest(rows)[1]


def test_repaired_turns_follow_the_grammar(spark):
    r = random.Random(6)
    rows = [x for c in range(60) for x in talk(r, c, r.randint(1, 20), "uast")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    left = chat_repair.repaired_turns(chat_repair.repair_blocks(chat_repair.damaged(frame))).collect()
    talks = {}
    for x in sorted(left, key=lambda x: (x.conv_id, x.slice, x.block, x.place)):
        talks[x.conv_id] = talks.get(x.conv_id, "") + x.role[0]
        assert (x.edit == "I") == (x.text == "")
    assert talks and all(GOOD.fullmatch(t) for t in talks.values())


def test_empty_table_lost_conversation_and_clashing_columns(spark):
    assert digest(spark, []) == {}
    c = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = [(c, 0, "user", "gone.")]
    assert digest(spark, rows)[c] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    wide = spark.createDataFrame([(1, 1, "user", "a.", "x", "y", 2, 3, "z")], "conv_id long, turn long, role string, text string, c string, x string, m long, block long, fault string")
    assert [x.audit for x in chat_repair.repair_digest(chat_repair.damaged(wide)).collect()] == [brute_force([(1, 1, "user", "a.")])[1][6]]


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.01"])
def test_registered_query_equals_brute_force(spark, folder):
    table = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: tuple(r)[1:] for r in op11_conversation_repair(spark, folder).collect()}
    assert got == brute_force(table)
