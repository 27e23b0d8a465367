"""Best-fit packing of tokenised documents into sequences of bounded length.

A document is its token ids and an end id.  Only documents longer than a
sequence are cut, from the end into full sequences, so the first piece may be
shorter.  Pieces are packed in bulk-synchronous rounds of best fit:

* pieces are range-sorted by length and open sequences by their gap.  Lengths
  and gaps are whole numbers up to the sequence length, so the sort is an
  exact count per length; a run of equal pieces or of sequences with the same
  history is one entry with a first rank and a count;
* in a sweep from the longest piece down, every piece takes the smallest gap
  that holds it (its successor).  If several pieces want the same gaps, ranks
  decide: the first rank of one goes to the first rank of the other, as many as
  there are gaps, the rest look for the next gap and open new sequences last;
* gaps are updated and the sweep goes on until no piece is left.

The rounds therefore run over at most ``capacity`` counts, whatever the number
of documents.  Rows are only touched in parallel: tokenising, counting, ranking
within (length, salt) and looking up the place of a rank.

Defined cases: null or empty text is the end id alone; rows without an id are
left out; rows that share an id are packed each on its own, in the order of
their texts' hashes; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import base64
import functools
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.llm.text import bounded_batches
from tickerloom.scratch import materialize

CAPACITY = 1024
END_ID = 2
#: Equal lengths are ranked in so many independent slices.
SALTS = 128


@functools.cache
def _encoder(ranks_path: str):
    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": 50256})


def token_ids(text: str, ranks_path: str) -> np.ndarray:
    """Ids of ``text``: those of the vocabulary file ``byte_bpe_50k.json`` without added special tokens.

    The same merges are read from their rank file because that encoder is five
    times faster; tests compare both.  A special token's own string is that token,
    as the vocabulary file has it.
    """
    return _encoder(ranks_path).encode_to_numpy(text, allowed_special="all")


def pieces_of(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, h): one row per piece; h is a hash of the text."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, h long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc, h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                ids = np.append(token_ids(text.as_py() or "", ranks_path), np.uint32(END_ID)).astype("<u4")
                start = 0
                for piece, end in enumerate(range(len(ids) % capacity or capacity, len(ids) + 1, capacity)):
                    rows.append((doc, piece, start, end - start, zlib.crc32(ids[start:end].tobytes()), h))
                    start = end
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "h"]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    source = bounded_batches(docs).select(F.col(id_col).cast("long").alias("d"), F.xxhash64(F.col(text_col).cast("string")).alias("h"), F.col(text_col).cast("string").alias("t"))
    return source.where("d IS NOT NULL").mapInArrow(run, schema)


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Places for ``counts[length]`` pieces: (length, first rank, count, first sequence, offset) runs."""
    places: list[tuple[int, int, int, int, int]] = []
    gaps: list[tuple[int, int, int]] = []  # (gap, first sequence, count), sorted
    opened = 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            updated: list[tuple[int, int, int]] = []
            at = bisect_left(gaps, (length, -1, -1))
            if at == len(gaps):
                # No gap holds it: open sequences and fill each with equal pieces, layer by layer.
                layers = capacity // length
                full, rest = divmod(left, layers)
                if full:
                    places += [(length, rank + layer * full, full, opened, layer * length) for layer in range(layers)]
                    updated.append((capacity - layers * length, opened, full))
                if rest:
                    places += [(length, rank + layers * full + layer, 1, opened + full, layer * length) for layer in range(rest)]
                    updated.append((capacity - rest * length, opened + full, 1))
                opened += full + (rest > 0)
                left = 0
            else:
                gap, first, number = gaps.pop(at)
                take = min(number, left)
                places.append((length, rank, take, first, capacity - gap))
                rank, left = rank + take, left - take
                updated.append((gap - length, first, take))
                if take < number:
                    updated.append((gap, first + take, number - take))
            for entry in updated:
                if entry[0] and entry[2]:
                    insort(gaps, entry)
    return places


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to stored ``pieces``."""
    spark = pieces.sparkSession
    salt = F.pmod(F.xxhash64("doc_id", "piece", "h"), F.lit(SALTS)).cast("int")
    salted = pieces.withColumn("_salt", salt)
    # At most capacity x SALTS rows of counts, whatever the number of pieces.
    numbers = np.zeros((capacity + 1, SALTS + 1), dtype=np.int64)
    for row in salted.groupBy("length", "_salt").count().toLocalIterator():
        numbers[row["length"], row["_salt"] + 1] = row["count"]
    before = np.cumsum(numbers, axis=1)
    places = best_fit({int(n): int(before[n, -1]) for n in np.flatnonzero(before[:, -1])}, capacity)
    table = np.array(sorted(places), dtype=np.int64).reshape(-1, 5)
    shared = spark.sparkContext.broadcast((before, table))

    inside = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "h")
    ranked = salted.withColumn("_rank", F.row_number().over(inside).cast("long"))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, table = shared.value
        wide = 1 << 42
        starts = table[:, 0] * wide + table[:, 1]
        for batch in batches:
            length, salt, rank = (batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in ("length", "_salt", "_rank"))
            rank = rank - 1 + before[length, salt]
            run_of = table[np.searchsorted(starts, length * wide + rank, side="right") - 1]
            found = [batch.column(batch.schema.get_field_index(n)) for n in columns]
            yield pa.RecordBatch.from_arrays(
                [*found, pa.array(run_of[:, 3] + rank - run_of[:, 1]), pa.array(run_of[:, 4])], names=[*columns, "sequence_id", "offset"])

    return ranked.select(*columns, "_salt", "_rank").mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def packed_documents(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    return pack(materialize(pieces_of(docs, ranks_path, id_col, text_col, capacity), "pieces"), capacity)
