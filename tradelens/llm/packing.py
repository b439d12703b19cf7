"""Best-fit packing of documents into fixed-length token sequences, planned on the length histogram.

Documents are tokenized once, where they lie, and cut into pieces of at most the sequence length; what
travels further is one narrow row a piece. The plan is made on counts of lengths (at most 2048 of them,
whatever the corpus), best fit with the longest first, and consists of runs: ``n`` pieces of one length
take consecutive places in consecutive sequences. Pieces then take their places by joining their rank
within their length with the runs. Ranks come from hash blocks of each length, so a length that a third of
the corpus shares is numbered in many tasks.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tradelens.llm.common import blocks_for, cut, sums_before

ROWS_PER_BLOCK = 2_000
PIECES = "piece int, start long, length long, ids_crc32 long"


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """A file of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def load_encoder(path: str):
    """The ids of a text by the byte-level BPE of a ``tokenizers`` file.

    Ids come from the file's own vocabulary and merges through ``tiktoken``, which is four times as fast;
    as in ``tokenizers`` the strings of added tokens in a text become their ids.
    """
    import json

    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as lines:
        file = json.load(lines)
    # the printable stand-ins of bytes in such files: printable Latin-1 stands for itself, the rest follows from 256 on
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    byte_of = {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in own)}
    added = {x["content"]: x["id"] for x in file["added_tokens"]}
    ranks = {bytes(byte_of[c] for c in token): k for token, k in file["model"]["vocab"].items() if token not in added}
    encoding = tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)
    return partial(encoding.encode, allowed_special="all")


def tokenized_pieces(
    docs: DataFrame, capacity: int = 2048, end_id: int = 0, path: str | None = None,
    doc_id: str = "doc_id", text: str = "text", keep_ids: bool = False,
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): the token pieces of every row.

    A document is its ids and ``end_id``; null and empty texts are ``end_id`` alone. Longer ones than
    ``capacity`` are cut from their end into full pieces, so that only the first may be shorter.
    """
    path = path or vocabulary_path()
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, {PIECES}" + (", ids array<int>" if keep_ids else "")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = load_encoder(path)
        for batch in batches:
            at, piece, start, length, crc, ids = [], [], [], [], [], []
            for k, body in enumerate(batch.column(1)):
                tokens = encode(body.as_py() or "")
                tokens.append(end_id)
                packed = np.array(tokens, "<u4")
                begin, end = 0, len(tokens) % capacity or min(capacity, len(tokens))
                while begin < len(tokens):
                    at.append(k)
                    piece.append(len(piece) and at[-2:-1] == [k] and piece[-1] + 1 or 0)
                    start.append(begin)
                    length.append(end - begin)
                    crc.append(zlib.crc32(packed[begin:end].tobytes()))
                    if keep_ids:
                        ids.append(packed[begin:end].astype(np.int32))
                    begin, end = end, end + capacity
            columns = [batch.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32())]
            columns += [pa.array(x, pa.int64()) for x in (start, length, crc)]
            if keep_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in schema.split(", ")])

    return rows.mapInArrow(pieces, schema)


def best_fit_plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first rank, end rank, first sequence, pieces a sequence, offset) for ``counts`` of lengths.

    Best fit, longest first: each piece goes where least room is left. Sequences with the same room are
    handled as one range, so the work depends on the number of lengths and not on that of pieces.
    """
    runs: list[tuple[int, int, int, int, int, int]] = []
    open_: dict[int, list[tuple[int, int]]] = {}  # room -> ranges (first sequence, how many)
    rooms: list[int] = []
    made = 0

    def put(room: int, first: int, many: int) -> None:
        if many and room:
            if room not in open_:
                open_[room] = []
                insort(rooms, room)
            open_[room].append((first, many))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            k = bisect_left(rooms, length)
            if k < len(rooms):
                room = rooms[k]
                first, many = open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    rooms.pop(k)
            else:
                room, first = capacity, made
                many = -(-left // (capacity // length))
                made += many
            each = room // length
            full, more = min(many, left // each), 0
            if full < many:
                more = min(left - full * each, each)
            if full:
                runs.append((length, rank, rank + full * each, first, each, capacity - room))
                rank, left = rank + full * each, left - full * each
                put(room - each * length, first, full)
            if more:
                runs.append((length, rank, rank + more, first + full, more, capacity - room))
                rank, left = rank + more, left - more
                put(room - more * length, first + full, 1)
            put(room, first + full + bool(more), many - full - bool(more))
    return runs


def pack(
    docs: DataFrame, capacity: int = 2048, end_id: int = 0, path: str | None = None,
    doc_id: str = "doc_id", text: str = "text", keep_ids: bool = False,
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset) for every row of ``docs``.

    Null and empty texts are packed as one end token; rows that repeat a doc_id, or have none, are packed
    one by one; texts are tokenized whole. Extra columns are ignored and an empty table packs to no rows.
    """
    spark = docs.sparkSession
    pieces = tokenized_pieces(docs, capacity, end_id, path, doc_id, text, keep_ids)
    pieces = cut(pieces.withColumn("place", F.monotonically_increasing_id()))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs = best_fit_plan(histogram, capacity)
    names = ["length", "rank_from", "rank_end", "first_sequence", "each", "base"]
    plan = spark.createDataFrame(runs or [(0, 0, 0, 0, 1, 0)], ", ".join(f"{n} long" for n in names))
    blocks = blocks_for(max(histogram.values(), default=0), ROWS_PER_BLOCK)
    # pieces of one length are interchangeable: blocks come from the stored place, so that equal rows spread too
    spread = pieces.withColumn("block", F.pmod(F.xxhash64("place"), F.lit(blocks)).cast("int"))
    sums = spread.groupBy("length", "block").agg(F.count("*").alias("n"))
    bases = sums_before(sums, ["length"], "block", "n", "rank_base")
    inside = F.row_number().over(Window.partitionBy("length", "block").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = spread.withColumn("inside", inside).join(bases, ["length", "block"])
    ranked = ranked.withColumn("rank", F.col("rank_base") + F.col("inside"))
    placed = ranked.join(plan, "length").where("rank >= rank_from and rank < rank_end")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids,
        F.expr("first_sequence + (rank - rank_from) div each").alias("sequence_id"),
        F.expr("base + (rank - rank_from) % each * length").alias("offset"),
    )
