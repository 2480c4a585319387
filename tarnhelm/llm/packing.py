"""Best-fit packing planned over a histogram of lengths.

Texts become token ids once. Only the counts per length are planned: best fit in descending
length fills whole groups of equal sequences at a time, so the plan's size depends on the
sequence length and not on the number of documents. Documents then take the planned places by
their rank among the pieces of equal length.

A null or empty text is the end mark alone. A document above ``size`` tokens is cut into pieces
of ``size`` tokens, of which the first may be shorter. Repeated rows are packed once each. An
empty table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnhelm.llm.common import keep, small, table

SIZE = 1024
END = 2
#: Pieces that one window group ranks; larger lengths are split into such groups.
RANK_ROWS = 1000

PIECES = (
    "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
)


def tokenizer(path: str, pattern: str):
    """An encoder of ordinary text over a file of byte-level BPE ranks."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(
        "ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def vocabulary() -> tuple[str, str]:
    """Path and pattern of the public byte-level BPE; its ids equal those of its JSON form."""
    import public_tokenizers as P

    return P.path("byte_bpe_50k.tiktoken"), P.PATTERN


def pieces(docs: DataFrame, path: str, pattern: str, size: int = SIZE, end: int = END):
    """(doc_id, piece, start, length, ids_crc32) of every document's token ids."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path, pattern).encode_ordinary
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py() or "")
                ids.append(end)
                ids = np.array(ids, "<u4")
                n = len(ids)
                at, upto, piece = 0, (n - 1) % size + 1, 0
                while at < n:
                    part = ids[at:upto]
                    for column, value in zip(
                        rows, (doc, piece, at, upto - at, zlib.crc32(part.tobytes())), strict=True
                    ):
                        column.append(value)
                    at, upto, piece = upto, upto + size, piece + 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(r, k) for r, k in zip(rows, kinds, strict=True)],
                ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(cut, PIECES)


def best_fit(counts: dict[int, int], size: int = SIZE) -> list[tuple[int, int, int, int, int]]:
    """Places for ``counts[length]`` pieces of each length.

    Returns runs (length, first_rank, n, first_sequence, offset): the pieces of that length with
    ranks first_rank .. first_rank + n - 1 go to consecutive sequences at that offset. Pieces go
    in descending length to the fullest sequence that has room. Sequences of equal content are
    one group, so each step places as many pieces as a group takes.
    """
    runs: list[tuple[int, int, int, int, int]] = []
    groups: dict[int, list[tuple[int, int]]] = {}  # room left -> (first sequence, how many)
    opened = 0
    for length in sorted((x for x in counts if counts[x]), reverse=True):
        left, rank = counts[length], 0
        while left:
            room = next((r for r in range(length, size + 1) if groups.get(r)), None)
            if room is None:
                each = size // length
                n = -(-left // each)
                groups.setdefault(size, []).append((opened, n))
                opened, room = opened + n, size
            first, n = groups[room].pop()
            each = room // length
            full = min(n, left // each)
            parts = [(full, each)] if full else []
            if full < n and left - full * each:
                parts.append((1, left - full * each))
            for many, items in parts:
                for i in range(items):
                    runs.append((length, rank, many, first, size - room + i * length))
                    rank += many
                left -= many * items
                rest = room - items * length
                if rest:
                    groups.setdefault(rest, []).append((first, many))
                first, n = first + many, n - many
            if n:
                groups[room].append((first, n))
    return runs


def pack(cut: DataFrame, size: int = SIZE) -> DataFrame:
    """Add sequence_id and offset to kept pieces (doc_id, piece, length, ...)."""
    spark = cut.sparkSession
    counts = {r["length"]: r["n"] for r in  # one row per length, ``size`` at most
              cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs = spark.createDataFrame(
        best_fit(counts, size), "length bigint, first_rank bigint, n bigint, seq bigint, at bigint")
    parts = F.array(*[F.lit(-(-counts.get(x, 0) // RANK_ROWS) or 1) for x in range(size + 1)])
    rows = cut.withColumn("_part", F.pmod(
        F.xxhash64("doc_id", "piece"), F.get(parts, F.col("length").cast("int"))))
    before = (
        rows.groupBy("length", "_part").agg(F.count("*").alias("_n"))
        .withColumn("_before", F.sum("_n").over(
            W.partitionBy("length").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)))
        .select("length", "_part", F.coalesce("_before", F.lit(0)).alias("_before"))
    )
    inside = W.partitionBy("length", "_part").orderBy("doc_id", "piece", "ids_crc32")
    ranked = rows.withColumn("_rank", F.row_number().over(inside) - 1)
    ranked = ranked.join(small(keep(before)), ["length", "_part"])
    ranked = ranked.withColumn("_rank", F.col("_rank") + F.col("_before"))
    # At most a few runs per length: the plan does not grow with the documents.
    placed = ranked.join(
        F.broadcast(runs),
        (ranked["length"] == runs["length"]) & (F.col("_rank") >= F.col("first_rank"))
        & (F.col("_rank") < F.col("first_rank") + F.col("n")),
    ).drop(runs["length"])
    return placed.select(
        *cut.columns, (F.col("seq") + F.col("_rank") - F.col("first_rank")).alias("sequence_id"),
        F.col("at").alias("offset"))


def pack_documents(docs: DataFrame, size: int = SIZE, vocab: tuple[str, str] | None = None):
    path, pattern = vocab or vocabulary()
    return pack(keep(pieces(docs, path, pattern, size)), size)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
