"""Edit-aware token counts by segment trees over pre-tokens.

A text is cut into leaves at places where pre-tokens certainly end: before a blank between two
other characters. Each leaf has its token count and a tree over the leaves has their sums. An
edit re-encodes the leaves it touches, and the one before them where it reaches the characters
that their cut depends on; sums are updated from these leaves to the root. The count always
equals that of encoding the edited text anew.

An edit is (at, cut, put): at code point ``at`` of the current text, ``cut`` code points are
replaced by ``put``. Edits of a document are applied in order. Places beyond the end mean the
end, negative ones the start; null fields mean 0 or nothing. Null texts count as empty. Repeated
rows are counted each. An empty table gives no rows. Other columns than those named are dropped.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnhelm.llm.common import table
from tarnhelm.llm.packing import tokenizer, vocabulary

#: Characters after which the next safe place ends a leaf.
LEAF = 512
SAFE = re.compile(r"(?<=[^\s]) (?=[^\s])")


class Counted:
    """A text with its token counts, kept up to date through edits."""

    def __init__(self, text: str, count: Callable[[str], int], leaf: int = LEAF):
        self.count, self.leaf, self.encoded = count, leaf, 0
        self.leaves = self.cut(text)
        self.width = 1 << max(0, len(self.leaves) - 1).bit_length()
        self.tokens = np.zeros(2 * self.width, np.int64)
        self.chars = np.zeros(2 * self.width, np.int64)
        for i, part in enumerate(self.leaves):
            self.tokens[self.width + i] = self.measure(part)
            self.chars[self.width + i] = len(part)
        for i in range(self.width - 1, 0, -1):
            for sums in (self.tokens, self.chars):
                sums[i] = sums[2 * i] + sums[2 * i + 1]
        self.encoded = 0

    @property
    def total(self) -> int:
        return int(self.tokens[1])

    @property
    def text(self) -> str:
        return "".join(self.leaves)

    def cut(self, text: str) -> list[str]:
        out, at = [], 0
        while at < len(text):
            m = SAFE.search(text, at + self.leaf)
            end = m.start() if m else len(text)
            out.append(text[at:end])
            at = end
        return out or [""]

    def measure(self, part: str) -> int:
        self.encoded += len(part)
        return self.count(part)

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds code point ``at``, and the place inside it."""
        node = 1
        while node < self.width:
            node *= 2
            if at >= self.chars[node]:
                if node + 1 - self.width >= len(self.leaves) or not self.chars[node + 1]:
                    continue
                at -= int(self.chars[node])
                node += 1
        return node - self.width, at

    def put(self, i: int, part: str) -> None:
        self.leaves[i] = part
        node = self.width + i
        self.tokens[node], self.chars[node] = self.measure(part) if part else 0, len(part)
        while node > 1:
            node //= 2
            for sums in (self.tokens, self.chars):
                sums[node] = sums[2 * node] + sums[2 * node + 1]

    def beside(self, i: int, step: int) -> int | None:
        i += step
        while 0 <= i < len(self.leaves):
            if self.leaves[i]:
                return i
            i += step
        return None

    def edit(self, at: int, cut: int, put: str) -> None:
        size = int(self.chars[1])
        at = min(max(at, 0), size)
        cut = min(max(cut, 0), size - at)
        first, a = self.find(at)
        last, _ = self.find(at + cut)
        # A cut holds while the character before it and the two after it stay. Only the first
        # leaf's own cut can be touched: the last leaf keeps its last character.
        if a < 2 and (before := self.beside(first, -1)) is not None:
            a += len(self.leaves[before])
            first = before
        whole = "".join(self.leaves[first:last + 1])
        whole = whole[:a] + put + whole[a + cut:]
        parts = self.cut(whole) if whole else []
        room = last - first + 1
        if len(parts) > room:  # no new nodes: what is too much stays with the last leaf
            parts[room - 1:] = ["".join(parts[room - 1:])]
        for i in range(room):
            self.put(first + i, parts[i] if i < len(parts) else "")


def recount(docs: DataFrame, path: str, pattern: str, leaf: int = LEAF) -> DataFrame:
    """Token counts of (doc_id, text, edits) before and after the edits.

    Returns doc_id, n_tokens, edited_tokens, edited_chars and reencoded_chars, the code points
    that the edits made it encode again.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path, pattern).encode_ordinary
        for batch in batches:
            rows = []
            for text, edits in zip(batch.column(1), batch.column(2), strict=True):
                doc = Counted(text.as_py() or "", lambda t: len(encode(t)), leaf)
                n = doc.total
                for e in edits.as_py() or []:
                    if e is not None:
                        doc.edit(e["at"] or 0, e["cut"] or 0, e["put"] or "")
                rows.append((n, doc.total, int(doc.chars[1]), doc.encoded))
            columns = [pa.array([r[i] for r in rows], pa.int64()) for i in range(4)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *columns],
                ["doc_id", "n_tokens", "edited_tokens", "edited_chars", "reencoded_chars"])

    edits = F.col("edits").cast("array<struct<at:bigint,cut:bigint,put:string>>")
    return docs.select(F.col("doc_id").cast("bigint"), "text", edits.alias("edits")).mapInArrow(
        run, "doc_id bigint, n_tokens bigint, edited_tokens bigint, edited_chars bigint, "
             "reencoded_chars bigint")


def revisions(docs: DataFrame) -> DataFrame:
    """(doc_id, text, edits): a passage moved forward, one removed, one typed over."""
    n = F.length(F.coalesce("text", F.lit(""))).cast("bigint")
    edit = lambda at, cut, put: F.struct(
        at.alias("at"), F.lit(cut).cast("bigint").alias("cut"), put.alias("put"))
    third, half = F.floor(n / 3), F.floor(n / 2)
    return docs.select("doc_id", "text", F.array(
        edit(third, 0, F.substring("text", 1, 40)),
        edit(half, 25, F.lit("")),
        edit(n - 30, 12, F.upper(F.substring("text", 5, 20)))).alias("edits"))


def op2_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return recount(revisions(docs), *vocabulary())
