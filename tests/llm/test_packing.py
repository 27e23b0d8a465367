import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tickerloom.llm.packing import best_fit, pack, packed_documents, token_ids
from tickerloom.scratch import materialize

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
FULL = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_ids_equal_the_vocabulary_file(sentence):
    texts = ["", " ", "a<|endoftext|>b", "Straße 12\t\n\n  x's", " 　ß", "日本語 テスト", "🙂🙂 ok", "a" * 3000, sentence(3, 500)]
    for text in texts:
        assert token_ids(text, RANKS).tolist() == FULL.encode(text, add_special_tokens=False).ids


def test_documents_come_back_whole_and_gapless(corpus):
    texts = {r["doc_id"]: r["text"] or "" for r in corpus.collect()}
    rows = packed_documents(corpus, RANKS).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(texts)
    for doc, pieces in by_doc.items():
        ids = np.array([*FULL.encode(texts[doc], add_special_tokens=False).ids, 2], dtype="<u4")
        pieces.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in pieces] == list(range(len(pieces))) and sum(r["length"] for r in pieces) == len(ids)
        assert all(r["length"] == 1024 for r in pieces[1:])
        for r in pieces:
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"]:r["start"] + r["length"]].tobytes())
    for pieces in by_sequence.values():
        end = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == end
            end += r["length"]
        assert end <= 1024


def sequential_best_fit(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - n)
        else:
            gaps.append(capacity - n)
    return len(gaps)


def test_as_few_sequences_as_sequential_best_fit():
    for seed in range(60):
        r = random.Random(seed)
        lengths = [r.randint(1, r.choice((20, 64, 100))) for _ in range(r.randint(0, 300))]
        counts = {n: lengths.count(n) for n in set(lengths)}
        places = best_fit(counts, 100)
        assert sum(p[2] for p in places) == len(lengths)
        filled = {}
        for length, _, number, first, offset in places:
            for s in range(first, first + number):
                filled.setdefault(s, []).append((offset, length))
        for runs in filled.values():
            end = 0
            for offset, length in sorted(runs):
                assert offset == end
                end += length
            assert end <= 100
        assert len(filled) == sequential_best_fit(lengths, 100)


def test_odd_rows(spark):
    schema = "doc_id long, text string"
    assert packed_documents(spark.createDataFrame([], schema), RANKS).count() == 0
    rows = packed_documents(spark.createDataFrame([(None, "x"), (1, None), (2, ""), (2, "")], schema), RANKS).collect()
    assert sorted((r["doc_id"], r["length"]) for r in rows) == [(1, 1), (2, 1), (2, 1)]
    assert sorted((r["sequence_id"], r["offset"]) for r in rows) == [(0, 0), (0, 1), (0, 2)]


def test_equal_pieces_spread_over_salts(spark):
    pieces = spark.range(3000).selectExpr("id AS doc_id", "0 AS piece", "0L AS start", "300L AS length", "7L AS ids_crc32", "id AS h")
    rows = pack(materialize(pieces, "pieces")).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == 3000 and len({r["sequence_id"] for r in rows}) == 1000
