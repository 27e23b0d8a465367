"""Token groups and links between two tokenizers over whole texts.

Both vocabularies cut the same bytes (a blank and the text) into tokens.  Tokens of
different vocabularies whose byte ranges overlap are linked; texts fall into groups, the
smallest stretches that both cut at their ends.

Groups come from pointer jumping over all tokens of a chunk of texts at once.  Every
token points to its farthest-right overlapping token: the token of the other
vocabulary that covers its last byte, unless both end there, in which case the group
ends and the first vocabulary's token is its terminal.  Successors are doubled,
p = p[p], until nothing changes; the token reached labels the group.

Corpus statistics of id pairs: texts are worked on in blocks of bounded size.  A block
keeps its distinct pairs once, with their numbers of links, and its documents refer to
them by place.  Counts are sums over blocks (map-side combined) and reach the blocks again by
a join on the pair, in which a frequent pair has one row per block, not one per link.  A
block meets the counts of its pairs in one cogroup, bounded by the block.

Defined cases: rows without an id are left out; every other row gives a row; texts that
are null, empty, or whose tokens do not spell a blank and the text (say, characters that a
vocabulary changes) have no tokens: zeros and an empty digest; special tokens' strings are plain
text; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.llm.text import bounded_batches, chunks
from tickerloom.scratch import materialize

#: Bytes of text in a block; a longer text is a block of its own.
BLOCK_BYTES = 2 << 20
#: A pair of ids in one number.
_SHIFT = 20


class Vocabulary:
    """The bytes of each id, their lengths, and an encoder of many texts."""

    def __init__(self, tokens: list[bytes], encode):
        self.tokens, self.encode = tokens, encode
        self.length = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))


@functools.cache
def byte_level(ranks_path: str) -> Vocabulary:
    """A byte-level vocabulary from its rank file; no string in a text is special."""
    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    encoding = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return Vocabulary(tokens, lambda texts: [encoding.encode_ordinary(" " + t) for t in texts])


@functools.cache
def pieces(model_path: str) -> Vocabulary:
    """A piece vocabulary, which puts a blank before each text itself."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    tokens = [bytes([int(x[3:5], 16)]) if model.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(names)]
    return Vocabulary(tokens, lambda texts: model.encode(texts, num_threads=1))


def jump(pointers: np.ndarray) -> np.ndarray:
    """The end of each chain of ``pointers``, by doubling."""
    while True:
        further = pointers[pointers]
        if np.array_equal(further, pointers):
            return pointers
        pointers = further


class Aligned:
    """Tokens of both vocabularies over some texts, in order; ends are byte offsets over all texts.

    ``a``/``b`` are ids, ``a_text``/``b_text`` the number of each token's text,
    ``a_group``/``b_group`` the group numbers (rising over all texts), and
    ``pair``/``pair_text`` the id pairs of the links and their texts.
    """

    def __init__(self, texts: list[bytes], first: Vocabulary, second: Vocabulary):
        ids_a, ids_b = self._encoded(texts, first, second)
        self.a, self.a_text, a_end = self._laid(ids_a, first)
        self.b, self.b_text, b_end = self._laid(ids_b, second)
        n = len(self.a)
        # The token of the other vocabulary over a token's last byte is the first that ends there or later.
        over_a, over_b = np.searchsorted(b_end, a_end), np.searchsorted(a_end, b_end)
        own = np.arange(n)
        pointers = np.concatenate((
            np.where(b_end[over_a] > a_end, over_a + n, own) if n else own,
            over_b,
        ))
        terminal = jump(pointers)
        # Terminals are tokens of the first vocabulary; their order is that of the groups.
        ends_group = np.zeros(n, dtype=np.int64)
        ends_group[terminal] = 1
        number = np.cumsum(ends_group) - 1
        group = number[terminal] if n else terminal
        self.a_group, self.b_group = group[:n], group[n:]
        # Between two neighbouring ends of either vocabulary lies exactly one overlapping pair.
        stretch = np.union1d(a_end, b_end)
        in_a, in_b = np.searchsorted(a_end, stretch), np.searchsorted(b_end, stretch)
        self.pair = (self.a[in_a] << _SHIFT) | self.b[in_b] if n else np.zeros(0, dtype=np.int64)
        self.pair_text = self.a_text[in_a] if n else np.zeros(0, dtype=np.int64)

    @staticmethod
    def _encoded(texts: list[bytes], first: Vocabulary, second: Vocabulary) -> tuple[list[list[int]], list[list[int]]]:
        """Ids per text, none where either vocabulary does not spell a blank and the text."""
        strings = [t.decode("utf-8", "replace") for t in texts]
        out_a, out_b = first.encode(strings), second.encode(strings)
        for i, text in enumerate(texts):
            spelt = b" " + text
            if not text or b"".join(map(first.tokens.__getitem__, out_a[i])) != spelt or b"".join(map(second.tokens.__getitem__, out_b[i])) != spelt:
                out_a[i], out_b[i] = [], []
        return out_a, out_b

    @staticmethod
    def _laid(ids: list[list[int]], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        flat = np.fromiter((x for one in ids for x in one), dtype=np.int64, count=int(sizes.sum()))
        return flat, np.repeat(np.arange(len(ids)), sizes), np.cumsum(vocabulary.length[flat])

    def rendered(self, count: int) -> list[str]:
        """Per text its groups as ``a1,a2|b1;a3|b2,b3``."""
        side = np.concatenate((np.zeros(len(self.a), dtype=np.int64), np.ones(len(self.b), dtype=np.int64)))
        part = np.concatenate((self.a_group, self.b_group)) * 2 + side
        order = np.argsort(part, kind="stable")
        part, ids = part[order], np.concatenate((self.a, self.b))[order]
        # What follows a token: nothing new (","), the other side ("|"), or the next group (";").
        step = np.append(part[1:], -1) - part
        mark = np.where(step == 0, 0, np.where(part % 2 == 0, 1, 2))
        names = _names(int(ids.max()) + 1) if len(ids) else []
        words = [names[code] for code in (ids * 3 + mark).tolist()]
        text = np.concatenate((self.a_text, self.b_text))[order]
        cut = np.searchsorted(text, np.arange(count + 1)).tolist()
        return ["".join(words[x:y])[:-1] for x, y in zip(cut[:-1], cut[1:], strict=True)]


@functools.lru_cache(maxsize=4)
def _names(size: int) -> list[str]:
    return [f"{i}{mark}" for i in range(size) for mark in ",|;"]


_DOCUMENT = "d long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, at array<int>, links array<int>"
_SCHEMA = f"block long, {_DOCUMENT}, pairs array<long>, totals array<long>"


def _blocks(docs: DataFrame, ranks_path: str, model_path: str) -> DataFrame:
    """A row per document (``pairs`` null) and one per block (``d`` null).

    A document's ``at`` are places in its block's ``pairs``, ``links`` its numbers of links of those.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = byte_level(ranks_path), pieces(model_path)
        block = TaskContext.get().partitionId() << 33
        for batch in batches:
            ids, texts = batch.column(0), [x or b"" for x in batch.column(1).cast(pa.binary()).to_pylist()]
            for x, y in chunks(texts, BLOCK_BYTES):
                n = y - x
                aligned = Aligned(texts[x:y], first, second)
                n_a, n_b = np.bincount(aligned.a_text, minlength=n), np.bincount(aligned.b_text, minlength=n)
                n_links = np.bincount(aligned.pair_text, minlength=n)
                pairs, place, totals = np.unique(aligned.pair, return_inverse=True, return_counts=True)
                own, links = np.unique(aligned.pair_text * max(len(pairs), 1) + place, return_counts=True)
                cut = np.searchsorted(own, np.arange(n + 1) * max(len(pairs), 1)).astype(np.int32)
                digests = [hashlib.sha256(s.encode()).hexdigest() if s else "" for s in aligned.rendered(n)]
                none = pa.nulls(n, pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(n, block)), ids.slice(x, n), pa.array(n_a), pa.array(n_b), pa.array(n_a + n_b - n_links), pa.array(n_links), pa.array(digests, pa.string()),
                    pa.ListArray.from_arrays(cut, pa.array((own % max(len(pairs), 1)).astype(np.int32))), pa.ListArray.from_arrays(cut, pa.array(links.astype(np.int32))), none, none], names=_FIELDS)
                whole = np.array([0, len(pairs)], dtype=np.int32)
                yield pa.RecordBatch.from_arrays([
                    pa.array([block]), *(pa.nulls(1, k) for k in (*[pa.int64()] * 5, pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()))),
                    pa.ListArray.from_arrays(whole, pa.array(pairs)), pa.ListArray.from_arrays(whole, pa.array(totals))], names=_FIELDS)
                block += 1

    source = bounded_batches(docs).select(F.col("doc_id").cast("long").alias("d"), F.col("text").cast("string").alias("t"))
    return source.where("d IS NOT NULL").mapInArrow(run, _SCHEMA)


_FIELDS = [x.split()[0] for x in _SCHEMA.split(", ")]
_RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _summed(documents: pa.Table, counts: pa.Table) -> pa.Table:
    """Result rows of a block's documents, from the counts of its pairs (at, n, best)."""
    documents, counts = documents.combine_chunks(), counts.combine_chunks()
    size = max(counts.num_rows, 1)
    n, best = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)
    at = counts.column("at").to_numpy()
    n[at], best[at] = counts.column("n").to_numpy(), counts.column("best").to_numpy()
    at, links = (documents.column(c).combine_chunks() for c in ("at", "links"))
    length = at.value_lengths().to_numpy()
    owner = np.repeat(np.arange(documents.num_rows), length)
    at, links = at.flatten().to_numpy(), links.flatten().to_numpy().astype(np.int64)
    sums = []
    for weight in (best, n):
        total = np.zeros(documents.num_rows, dtype=np.int64)
        np.add.at(total, owner, links * weight[at])
        sums.append(pa.array(total))
    columns = [documents.column(c) for c in ("d", "n_a", "n_b", "n_groups", "n_links")]
    return pa.Table.from_arrays([*columns, *sums, documents.column("groups_sha256")], names=[x.split()[0] for x in _RESULT.split(", ")])


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(pair, a, b, n, best) of stored :func:`_blocks`: links of each id pair in the corpus, and whether its b id has none with more."""
    totals = blocks.where("pairs IS NOT NULL").selectExpr("inline(arrays_zip(pairs, totals))").groupBy("pairs").agg(F.sum("totals").alias("n"))
    counted = totals.selectExpr("pairs AS pair", f"shiftright(pairs, {_SHIFT}) AS a", f"pairs & {(1 << _SHIFT) - 1} AS b", "n")
    counted = materialize(counted, "pairs")
    most = counted.groupBy("b").agg(F.max("n").alias("most"))
    return counted.join(most, "b").selectExpr("pair", "a", "b", "n", "CAST(n = most AS int) AS best")


def aligned_documents(docs: DataFrame, ranks_path: str, model_path: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) per row."""
    blocks = materialize(_blocks(docs, ranks_path, model_path), "blocks")
    counts = materialize(pair_counts(blocks), "pair_counts").select("pair", "n", "best")
    places = blocks.where("pairs IS NOT NULL").selectExpr("block", "posexplode(pairs) AS (at, pair)")
    known = places.join(counts, "pair").selectExpr("block AS place", "at", "n", "best")
    documents = blocks.where("pairs IS NULL").drop("pairs", "totals")
    return documents.groupBy("block").cogroup(known.groupBy("place")).applyInArrow(lambda left, right: _summed(left, right), _RESULT)
