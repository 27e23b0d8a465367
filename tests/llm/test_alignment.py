import collections
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest

from tickerloom.llm import alignment
from tickerloom.llm.queries import PIECES, RANKS, op13_token_alignment


def tokens(text):
    """(id, start, end) of both vocabularies by the files the contract names, or none."""
    import sentencepiece
    from tokenizers import Tokenizer

    if not hasattr(tokens, "a"):
        tokens.a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        tokens.a.encode_special_tokens = True
        tokens.b = sentencepiece.SentencePieceProcessor(model_file=PIECES)
        # The byte-level alphabet: printable bytes stand for themselves, the others for 256 and up.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        tokens.byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in plain)}
    out = []
    for ids, spell in (
        (tokens.a.encode(" " + text, add_special_tokens=False).ids, lambda i: bytes(tokens.byte[c] for c in tokens.a.id_to_token(i))),
        (tokens.b.encode(text), lambda i: bytes([int(tokens.b.id_to_piece(i)[3:5], 16)]) if tokens.b.is_byte(i) else tokens.b.id_to_piece(i).replace("▁", " ").encode()),
    ):
        at, placed, joined = 0, [], b""
        for i in ids:
            piece = spell(i)
            placed.append((i, at, at + len(piece)))
            at, joined = at + len(piece), joined + piece
        if joined != b" " + text.encode():
            return [], []
        out.append(placed)
    return out


def brute_force(rows):
    aligned, count = [], collections.Counter()
    for d, text in rows:
        if d is None:
            continue
        a, b = tokens(text) if text else ([], [])
        links, j = [], 0
        for i, s, e in a:
            while j and b[j - 1][2] > s:
                j -= 1
            while j < len(b) and b[j][1] < e:
                if b[j][2] > s:
                    links.append((i, b[j][0]))
                j += 1
        cuts = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups = []
        for x, y in zip([0, *cuts], cuts):
            groups.append("|".join(",".join(str(i) for i, s, e in side if s >= x and e <= y) for side in (a, b)))
        count.update(links)
        aligned.append((d, a, b, groups, links))
    best = collections.defaultdict(int)
    for (_, y), n in count.items():
        best[y] = max(best[y], n)
    return sorted((d, len(a), len(b), len(groups), len(links), sum(count[p] == best[p[1]] for p in links), sum(count[p] for p in links),
                   hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "") for d, a, b, groups, links in aligned)


def rows_of(frame):
    return sorted(tuple(r) for r in alignment.aligned_documents(frame, RANKS, PIECES).collect())


TEXTS = [
    None, "", " ", "\n", "plain words", "<|endoftext|> is text, so are <s> and </s>", "日本語のテキスト 🤦🏼‍♂️ mixed", "under▁score", "tab\tand\x00nul", "é combining",
    "a" * 3000, "  two  blanks  ", "naïve café — “quotes”", "1234567890" * 20, "x\r\ny", "ﬁ ligature",
]


@pytest.mark.parametrize("block", [1, 300, 1 << 20])
def test_alignment_equals_brute_force(spark, sentence, monkeypatch, block):
    monkeypatch.setattr(alignment, "BLOCK_BYTES", block)
    r = random.Random(1)
    texts = TEXTS + [sentence(i, r.randint(1, 60)) for i in range(20)] + ["the same text, many times"] * 40
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "no id"), (3, "an id again"), (4, texts[4])]
    frame = spark.createDataFrame([(*x, 5, "b", [1]) for x in rows], "doc_id long, text string, n_a int, block string, pairs array<int>").repartition(3)
    assert rows_of(frame) == brute_force(rows)


def test_very_long_text_and_empty_table(spark, sentence):
    rows = [(1, sentence(1, 30000)), (2, "w" * 20000 + " " + "\n" * 5000)]
    assert rows_of(spark.createDataFrame(rows, "doc_id long, text string")) == rows_of(spark.createDataFrame(rows[::-1], "doc_id long, text string"))
    assert rows_of(spark.createDataFrame([], "doc_id long, text string")) == []


def test_pointers_reach_the_end_of_long_chains():
    chain = np.minimum(np.arange(100_000) + 1, 99_999)
    assert (alignment.jump(chain) == 99_999).all()


def test_registered_query_equals_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(tuple(r) for r in op13_token_alignment(spark, folder).collect()) == brute_force(rows)
