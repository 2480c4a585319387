"""Alignment of two tokenizers' tokens over the same bytes, by galloping intersection.

Each text is encoded by A, a byte-level BPE, as blank + text, and by B, a piece model that adds
the blank itself. The byte offsets at which tokens end are two ascending lists. The shorter one
drives an exponential and then binary search into the longer (``gallop``). Offsets in both lists
cut the tokens into groups, and differences of ranks give the range of tokens that each token
overlaps: these pairs of tokens are the links. Pairs of ids are counted over the whole corpus,
and every document learns how its links stand among them.

Long texts are encoded and aligned in parts, cut at a blank between two other characters: both
tokenizers begin a token there, whatever stands around it. Control strings inside texts are
plain text. A text that is null or empty, or whose tokens do not spell blank + text, has no
tokens: zeros and an empty digest. Repeated rows are reported and counted once each. An empty
table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnhelm.llm import packing
from tarnhelm.llm.common import keep, table

#: Characters after which a text is cut at the next safe place.
PART = 100_000
SAFE = re.compile(r"(?<=[^\s]) (?=[^\s])")
#: Characters of texts that are aligned at once.
CHUNK = 300_000
#: Links that a task holds before it sums them by pair of ids.
HELD_LINKS = 2_000_000
#: Pairs of ids that a task sums before it hands them on.
HELD_PAIRS = 2_000_000
#: Pairs of ids that are looked up at once; with more, the lookup runs once per block of pairs.
BLOCK_PAIRS = 3_000_000
#: A pair of ids as one number: A's id times this and B's id.
STEP = 1 << 16

ALIGNED = (
    "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, "
    "groups_sha256 string, pairs binary, times binary, pair bigint, n bigint"
)


def gallop(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """For each value of ``short``, how many values of ``long`` are below it; both ascend.

    Every search starts at the known place of a value to the left: first for the values in the
    middle, then in the middle of each half, and so on; all searches of a round go in step.
    """
    n, m = len(long), len(short)
    at = np.zeros(m + 1, np.int64)  # at[j] belongs to short[j - 1]; at[0] is the list's start
    stride = 1 << max(m - 1, 0).bit_length()
    while stride:
        j = np.arange(stride, m + 1, 2 * stride)
        if len(j):
            value, left = short[j - 1], at[j - stride]
            width = np.ones(len(j), np.int64)
            open_ = np.arange(len(j))
            while len(open_):  # widen until the value is passed
                probe = left[open_] + width[open_] - 1
                inside = probe < n
                open_, probe = open_[inside], probe[inside]
                open_ = open_[long[probe] < value[open_]]
                width[open_] *= 2
            low, high = left + width // 2, np.minimum(left + width - 1, n)
            open_ = np.flatnonzero(low < high)
            while len(open_):  # halve what is left
                middle = (low[open_] + high[open_]) // 2
                below = long[middle] < value[open_]
                low[open_[below]] = middle[below] + 1
                high[open_[~below]] = middle[~below]
                open_ = open_[low[open_] < high[open_]]
            at[j] = low
        stride //= 2
    return at[1:]


class Aligner:
    """Groups and links of texts under two tokenizers, many texts at once.

    A token's code is its id in A, or its id in B after all of A's.
    """

    def __init__(self, a_path: str, a_pattern: str, b_path: str):
        import sentencepiece

        a = packing.tokenizer(a_path, a_pattern)
        b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.encode_a = a.encode_ordinary
        self.encode_b = lambda text: b.encode(text, num_threads=1)
        self.a_bytes = [a.decode_single_token_bytes(i) for i in range(a.n_vocab)]
        pieces = [b.id_to_piece(i) for i in range(b.get_piece_size())]
        self.b_bytes = [
            bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in enumerate(pieces)]
        # No piece runs over a blank, so a text may be cut before one.
        self.cuts = not any("▁" in p.lstrip("▁") for p in pieces)
        self.shift = len(self.a_bytes)
        self.sizes = np.array([len(x) for x in self.a_bytes + self.b_bytes])
        ids = [*range(len(self.a_bytes)), *range(len(pieces))]
        self.names = np.array(
            [b"%d," % i for i in ids]
            + [b"%d%s" % (x, b"|" if i < self.shift else b";") for i, x in enumerate(ids)], object)

    def parts(self, text: str, size: int) -> Iterator[str]:
        at = 0
        while self.cuts and len(text) - at > size:
            m = SAFE.search(text, at + size)
            if m is None:
                break
            yield text[at:m.start()]
            at = m.end()
        yield text[at:] if at else text

    def encoded(self, part: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Codes under A and B, if both spell blank + part."""
        try:
            spelled = (" " + part).encode()
        except UnicodeEncodeError:
            return None
        a, b = self.encode_a(" " + part), self.encode_b(part)
        if (b"".join([self.a_bytes[i] for i in a]) != spelled
                or b"".join([self.b_bytes[i] for i in b]) != spelled):
            return None
        return np.array(a, np.int64), np.array(b, np.int64) + self.shift

    def aligned(self, parts: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple]:
        """(n_a, n_b, n_groups, links, groups as text) of each part (codes under A, under B).

        The parts stand one after the other on one line of bytes, so their shorter lists together
        drive one search into their longer lists.
        """
        a_short = np.array([len(a) <= len(b) for a, b in parts])
        short = [a if is_a else b for (a, b), is_a in zip(parts, a_short, strict=True)]
        long = [b if is_a else a for (a, b), is_a in zip(parts, a_short, strict=True)]
        short_at = np.cumsum([0, *map(len, short)])
        long_at = np.cumsum([0, *map(len, long)])
        short, long = np.concatenate(short), np.concatenate(long)
        ends, long_ends = np.cumsum(self.sizes[short]), np.cumsum(self.sizes[long])
        at = gallop(ends, long_ends)
        same = long_ends[at] == ends
        # A token overlaps those of the other list from the one after its start to the one that
        # reaches its end.
        first = np.concatenate([[0], (at + same)[:-1]])
        n = at - first + 1
        links_at = np.concatenate([[0], np.cumsum(n)])
        one = np.repeat(short, n)
        other = long[np.arange(len(one)) - np.repeat(links_at[:-1] - first, n)]
        links = np.minimum(one, other) * STEP + np.maximum(one, other) - self.shift
        # Groups: the last token of each in both lists.
        cut, long_cut = np.flatnonzero(same), at[same]
        groups_at = np.searchsorted(cut, short_at)
        size, long_size = np.diff(cut, prepend=-1), np.diff(long_cut, prepend=-1)
        leads = np.repeat(a_short, np.diff(groups_at))  # A's tokens of a group are written first
        names = np.empty(len(short) + len(long), object)
        end = np.zeros(len(short), np.int64)
        end[cut] = len(self.sizes)
        names[np.arange(len(short)) + np.repeat(
            long_cut + 1 - np.where(leads, long_size, 0), size)] = self.names[short + end]
        end = np.zeros(len(long), np.int64)
        end[long_cut] = len(self.sizes)
        names[np.arange(len(long)) + np.repeat(
            cut + 1 - np.where(leads, 0, size), long_size)] = self.names[long + end]
        names = names.tolist()
        for k, (a, b) in enumerate(parts):
            yield (len(a), len(b), groups_at[k + 1] - groups_at[k],
                   links[links_at[short_at[k]]:links_at[short_at[k + 1]]],
                   b"".join(names[short_at[k] + long_at[k]:short_at[k + 1] + long_at[k + 1]])[:-1])

    def __call__(self, texts: list[str | None], size: int = PART) -> Iterator[tuple]:
        """(n_a, n_b, n_groups, n_links, digest, pairs, their numbers) of each text."""
        nothing = np.zeros(0, np.int64)
        cut = [list(self.parts(t, size)) if t else [] for t in texts]
        codes = [[self.encoded(p) for p in parts] for parts in cut]
        codes = [[] if any(c is None for c in parts) else parts for parts in codes]
        flat = [c for parts in codes for c in parts]
        found = self.aligned(flat) if flat else iter(())
        for parts in codes:
            if not parts:
                yield 0, 0, 0, 0, "", nothing, nothing
                continue
            sums, links, digest = np.zeros(3, np.int64), [], hashlib.sha256()
            for k in range(len(parts)):
                *numbers, link, written = next(found)
                sums += numbers
                links.append(link)
                digest.update((b";" if k else b"") + written)
            links = np.concatenate(links)
            pairs, times = np.unique(links, return_counts=True)
            yield (*sums.tolist(), len(links), digest.hexdigest(), pairs, times)


def chunks(column: pa.Array, chars: int = CHUNK) -> Iterator[tuple[int, list[str | None]]]:
    """(place of the first, texts) of runs of texts with about ``chars`` characters."""
    first, texts, n = 0, [], 0
    for i, text in enumerate(column, 1):
        texts.append(text.as_py())
        n += len(texts[-1] or "")
        if n > chars or i == len(column):
            yield first, texts
            first, texts, n = i, [], 0


class Sums:
    """Counts by key, summed as they come."""

    def __init__(self):
        self.keys, self.n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.new: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, keys: np.ndarray, n: np.ndarray) -> None:
        self.new.append((keys, n))
        self.held += len(keys)
        if self.held > HELD_LINKS:
            self.settle()

    def settle(self) -> None:
        keys = np.concatenate([self.keys, *[k for k, _ in self.new]])
        n = np.concatenate([self.n, *[x for _, x in self.new]])
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        self.keys, self.n = keys[first], np.add.reduceat(n, first) if len(first) else n
        self.new, self.held = [], 0


def aligned(docs: DataFrame, a_path: str, a_pattern: str, b_path: str,
            part: int = PART) -> DataFrame:
    """Kept rows of two kinds: one per document with its own pairs of ids and their numbers, and
    sums by pair of ids (``pair`` is not null)."""
    names = [x.split()[0] for x in ALIGNED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, sums = Aligner(a_path, a_pattern, b_path), Sums()

        def of_pairs() -> pa.RecordBatch:
            sums.settle()
            n = len(sums.keys)
            nulls = [pa.nulls(n, t) for t in (*[pa.int64()] * 5, pa.string(), *[pa.binary()] * 2)]
            out = pa.RecordBatch.from_arrays(
                [*nulls, pa.array(sums.keys), pa.array(sums.n)], names)
            sums.keys, sums.n = sums.keys[:0], sums.n[:0]
            return out

        for batch in batches:
            for first, texts in chunks(batch.column(1)):
                rows: list[list] = [[] for _ in range(7)]
                for *values, own, n in aligner(texts, part):
                    sums.add(own, n)
                    for column, value in zip(rows, (
                            *values, own.astype("<u4").tobytes(), n.astype("<u4").tobytes()),
                            strict=True):
                        column.append(value)
                kinds = (*[pa.int64()] * 4, pa.string(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(texts)),
                     *[pa.array(r, k) for r, k in zip(rows, kinds, strict=True)],
                     *[pa.nulls(len(texts), pa.int64())] * 2], names)
            if len(sums.keys) > HELD_PAIRS:
                yield of_pairs()
        yield of_pairs()

    return keep(docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, ALIGNED))


def pair_counts(found: DataFrame) -> DataFrame:
    """(pair, n, best): links of each pair of ids in all documents; is n the highest of its B?"""
    pairs = keep(
        found.where(F.col("pair").isNotNull()).groupBy("pair").agg(F.sum("n").alias("n")))
    b = F.pmod("pair", F.lit(STEP))
    top = pairs.groupBy(b.alias("_b")).agg(F.max("n").alias("_top"))  # a row per id of B at most
    return pairs.join(F.broadcast(top), b == F.col("_b")).select(
        "pair", "n", (F.col("n") == F.col("_top")).alias("best"))


def standing(found: DataFrame, block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """Documents with n_best and count_sum.

    The table of pairs is sent to the tasks in blocks of about ``block_pairs`` rows. With one
    block each document is done at once; else blocks run one by one and are summed by row.
    """
    spark = found.sparkSession
    counts = keep(pair_counts(found))
    blocks = max(1, -(-counts.count() // block_pairs))
    plain = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    docs = found.where(F.col("pair").isNull()).select(*plain, "pairs", "times")
    if blocks > 1:
        docs = keep(docs.withColumn("_row", F.monotonically_increasing_id()))

    def looked_up(block: int, key: str) -> DataFrame:
        rows = counts.where(F.pmod(F.xxhash64("pair"), F.lit(blocks)) == block).toArrow()
        keys = rows["pair"].to_numpy()
        order = np.argsort(keys)
        sent = spark.sparkContext.broadcast((
            keys[order].astype(np.uint32), rows["n"].to_numpy()[order],
            rows["best"].to_numpy()[order]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keys, counts, best = sent.value
            for batch in batches:
                n_best, count_sum = [], []
                for own, times in zip(batch.column("pairs"), batch.column("times"), strict=True):
                    own = np.frombuffer(own.as_py(), "<u4")
                    times = np.frombuffer(times.as_py(), "<u4").astype(np.int64)
                    at = np.minimum(np.searchsorted(keys, own), max(len(keys) - 1, 0))
                    if len(keys):
                        there = keys[at] == own
                        at, times = at[there], times[there]
                    n_best.append(int(times[best[at]].sum()) if len(keys) else 0)
                    # Whole numbers of Python: nothing can overflow before the end.
                    count_sum.append(int(times @ counts[at]) if len(keys) else 0)
                out = [batch.column(c) for c in names]
                yield pa.RecordBatch.from_arrays(
                    [*out, pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64())],
                    [*names, "n_best", "count_sum"])

        names = plain if key == "doc_id" else ["_row"]
        schema = ", ".join(f"{c} {t}" for c, t in docs.select(*names).dtypes)
        return docs.select(*names, "pairs", "times").mapInArrow(
            run, f"{schema}, n_best bigint, count_sum bigint")

    if blocks == 1:
        return looked_up(0, "doc_id")
    # Each block's part is written before the next is sent, so one block is held at a time.
    parts = [keep(looked_up(k, "_row")) for k in range(blocks)]
    sums = reduce(DataFrame.unionByName, parts).groupBy("_row").agg(
        F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return docs.select(*plain, "_row").join(sums, "_row").drop("_row")


def vocabularies() -> tuple[str, str, str]:
    """A's ranks and pattern (its ids equal those of its JSON form) and B's model."""
    import public_tokenizers as P

    return (*packing.vocabulary(), P.path("piece_bpe_32k.model"))


def alignment(docs: DataFrame, paths: tuple[str, str, str] | None = None, part: int = PART,
              block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    return standing(aligned(docs, *(paths or vocabularies()), part), block_pairs)


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
