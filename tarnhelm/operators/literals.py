"""Many literals looked up in many texts: an inverted index of grams, joined and then confirmed.

A text can only hold a literal if it holds each of the literal's grams, so a literal is kept under
one gram, the one that fewest literals share. Grams are runs of whole words, of those that have
blanks on both sides within the literal. Literals without enough such words have pieces instead: a
run of digits or letters with the characters beside it, or the characters from a place on where such a
run begins or ends. What is left has runs of any characters. If only a few literals lack words, these
are tried on every text, which costs less than hashing all characters. Texts look up their own grams;
what they find is confirmed by an exact search. Everything stays in the JVM and no literal is collected.
An index of up to a counted size is sent to the texts, which are not shuffled. A larger one meets the
texts' grams in a join; texts are read a second time and shuffled once to the entries found.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnhelm.functions.text import bind
from tarnhelm.sources.stored import keep

#: Words in a gram, longest first, and characters; a literal shorter than all is tried on every text.
RUNS = (4, 2)
GRAMS = (6, 3)
#: Kinds of pieces, and how they stand in a literal or text; all of a piece lies within its literal.
PIECES = {
    101: r"(?s)(?=([^0-9][0-9]+[^0-9]|[^A-Za-z][A-Za-z]+[^A-Za-z]))",
    102: r"(?s)(?=((?:[0-9](?![0-9])|[A-Za-z](?![A-Za-z])|[^0-9A-Za-z](?=[0-9A-Za-z])).{5}))",
    103: r"(?s)(?=((?:[0-9](?![0-9])|[A-Za-z](?![A-Za-z])|[^0-9A-Za-z](?=[0-9A-Za-z])).{2}))",
}
#: Shapes of the index's pieces up to which texts are searched for these alone.
SHAPES = 64
#: Literals without a run of words that are tried on every text, if there are no more of them.
TRIED = 64
#: Pairs of a text's hash and an entry that are sent to the tasks at once.
LED = 1_000_000
BLANKS = r"[\x20\x09-\x0D]+"
#: Entries of the index that are sent to the tasks at once.
ENTRIES = 200_000


def grams(text: Column, sizes: Sequence[int]) -> Column:
    """Hashes of the distinct runs of the given numbers of characters."""
    def of_size(c, n):
        places = F.when(F.size(c) >= n, F.sequence(F.lit(0), F.size(c) - n)).otherwise(
            F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.xxhash64(
            *[F.get(c, i + j if j else i) for j in range(n)]))

    def of(c):
        return F.array_distinct(F.concat(
            F.array().cast("array<bigint>"), *[of_size(c, n) for n in sizes]))

    return bind(F.split(F.coalesce(text, F.lit("")), ""), of)


def runs(n: int) -> Callable[[Column], Column]:
    """Hashes of the distinct runs of ``n`` words of an array of words."""
    def of(words: Column) -> Column:
        places = F.when(F.size(words) >= n, F.sequence(F.lit(0), F.size(words) - n)).otherwise(
            F.array().cast("array<int>"))
        return F.array_distinct(F.transform(places, lambda i: F.xxhash64(
            *[F.get(words, i + j if j else i) for j in range(n)])))

    return of


def inner_words(literal: Column) -> Column:
    """The words of a literal that have blanks on both sides."""
    return bind(F.split(literal, BLANKS, -1), lambda w: F.slice(
        w, F.lit(2), F.greatest(F.size(w) - 2, F.lit(0))))


def pieces(text: Column, pattern: str) -> Column:
    """The distinct pieces of a kind."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)))


def shape(piece: Column) -> Column:
    """A piece with all digits, and all letters, alike."""
    return F.regexp_replace(F.regexp_replace(piece, "[0-9]", "0"), "[A-Za-z]", "a")


def shaped(shapes: Sequence[str]) -> str:
    """A pattern for pieces of a kind that have one of these shapes; no place begins two."""
    signs = {"0": "[0-9]", "a": "[A-Za-z]"}
    return "(?=(" + "|".join("".join(
        signs.get(c, f"\\x{{{ord(c):x}}}") for c in x) for x in sorted(shapes)) + "))"


class LiteralIndex:
    """Entries with a ``literal`` and any other columns, to be found in texts."""

    def __init__(self, entries: DataFrame, block: int = ENTRIES):
        inner = F.size(inner_words(F.col("literal")))
        size = F.coalesce(
            *[F.when(inner >= n, -n) for n in RUNS],
            *[F.when(F.size(pieces(F.col("literal"), p)) > 0, k) for k, p in PIECES.items()],
            *[F.when(F.length("literal") >= n, n) for n in GRAMS], F.lit(0))
        rows = keep(entries.where(F.col("literal").isNotNull()).withColumns(
            {"_size": size, "_entry": F.monotonically_increasing_id()}))
        if rows.where("_size > 0").count() <= TRIED:
            rows = rows.withColumn("_size", F.least("_size", F.lit(0)))
        hashed = lambda x: F.struct(
            x.alias("_gram"), F.lit(None).cast("string").alias("_shape"))
        own = F.coalesce(
            *[F.when(F.col("_size") == -n, F.transform(bind(
                inner_words(F.col("literal")), runs(n)), hashed)) for n in RUNS],
            *[F.when(F.col("_size") == k, F.transform(pieces(F.col("literal"), p), lambda x: F.struct(
                F.xxhash64(x).alias("_gram"), shape(x).alias("_shape")))) for k, p in PIECES.items()],
            *[F.when(F.col("_size") == n, F.transform(
                grams(F.col("literal"), [n]), hashed)) for n in GRAMS])
        each = rows.select("_entry", F.inline(own))
        shared = each.groupBy("_gram").agg(F.count("*").alias("_n"))
        best = each.join(shared, "_gram").groupBy("_entry").agg(
            F.min(F.struct("_n", "_gram", "_shape")).alias("_b")).select(
            "_entry", "_b._gram", "_b._shape")
        self.rows = keep(rows.join(best, "_entry", "left"))
        found = self.rows.where("_shape IS NOT NULL").select("_size", "_shape").distinct().limit(
            SHAPES + 1).collect()
        self.patterns = PIECES if len(found) > SHAPES else {
            k: shaped([r["_shape"] for r in found if r["_size"] == k]) for k in PIECES}
        facts = self.rows.agg(
            F.count("*").alias("n"), F.collect_set("_size").alias("sizes")).first()
        self.sizes = [n for n in facts["sizes"] if n]
        self.short = 0 in facts["sizes"]
        self.blocks = -(-facts["n"] // block)

    def _own(self, values: Column) -> Column:
        """The grams of some texts, of the sizes in the index."""
        chars = [n for n in self.sizes if n in GRAMS]

        def of(v):
            found = [bind(F.split(F.coalesce(v, F.lit("")), BLANKS, -1), lambda w: F.flatten(F.array(
                *[runs(-n)(w) for n in self.sizes if n < 0])))] if min(self.sizes) < 0 else []
            found += [F.transform(pieces(F.coalesce(v, F.lit("")), p), lambda x: F.xxhash64(x))
                      for k, p in self.patterns.items() if k in self.sizes]
            return F.concat(*found, *([grams(v, chars)] if chars else []))

        return F.array_distinct(F.flatten(F.transform(values, lambda v: of(v))))

    def lookup(self, source: DataFrame, values: Column, use: Callable[[DataFrame], DataFrame],
               few: bool = False, led: int = LED) -> DataFrame | None:
        """``use(pairs)`` over all blocks: rows of ``source`` with each entry whose literal is in
        one of ``values`` (an array of strings), once per row and entry. None without entries.

        With ``few``, texts are not repeated for their grams: hashes of texts meet the index, and
        texts are read again to meet the entries that their hash leads to, ``led`` at a time. It
        pays where few texts hold a literal. Columns of ``source`` must not have names of the
        index.
        """
        held = F.exists(values, lambda v: F.contains(v, F.col("literal")))
        out = []
        joined = self.blocks > 1 and not few
        if joined and self.sizes:
            out.append(use(self._joined(source, values).where(held)))
        for i in range(self.blocks):
            part = self.rows.where(F.pmod(F.xxhash64("_entry"), F.lit(self.blocks)) == i)
            part = part.withColumnRenamed("_gram", "_g")
            if self.short:
                out.append(use(source.join(F.broadcast(part.where("_g IS NULL")), held)))
            if joined or not self.sizes:
                continue
            part = part.where("_g IS NOT NULL")
            if few:
                out += [use(p.where(held)) for p in self._led(source, values, part, led)]
                continue
            looked = source.select("*", F.explode_outer(self._own(values)).alias("_gram"))
            pairs = looked.join(F.broadcast(part), F.col("_gram") == F.col("_g"))
            out.append(use(pairs.where(held)))
        return reduce(DataFrame.unionByName, out) if out else None

    def _joined(self, source: DataFrame, values: Column) -> DataFrame:
        """Rows of ``source`` with the entries that their grams lead to, however many there are.

        Hashes of texts are joined with the index by gram, and rows with what their hash has found.
        """
        key = F.xxhash64(values)  # texts of equal hashes share what they are led to
        cols = [c for c in self.rows.columns if c not in ("_gram", "_shape")]
        index = self.rows.where("_gram IS NOT NULL").select("_gram", F.struct(*cols).alias("_led"))
        looked = source.select(key.alias("_key"), F.explode(self._own(values)).alias("_gram"))
        found = looked.join(index, "_gram").groupBy("_key").agg(F.collect_set("_led").alias("_all"))
        rows = source.withColumn("_key", key).join(found, "_key")
        return rows.select(*source.columns, F.explode("_all").alias("_led")).select(
            *source.columns, *[F.col(f"_led.{c}").alias(c) for c in cols])

    def _led(self, source: DataFrame, values: Column, part: DataFrame, led: int) -> list[DataFrame]:
        """Rows of ``source`` with the entries that their grams lead to, in parts of some ``led``."""
        key = F.xxhash64(values)  # texts of equal hashes share what they are led to
        looked = source.select(key.alias("_key"), F.explode_outer(self._own(values)).alias("_gram"))
        found = keep(looked.join(
            F.broadcast(part.select("_g", "_entry")), F.col("_gram") == F.col("_g")
        ).select("_key", "_entry").distinct())
        times = -(-found.count() // led)
        out = []
        for t in range(times):
            ids = found.where(F.pmod(F.xxhash64("_key"), F.lit(times)) == t).groupBy("_key").agg(
                F.collect_list("_entry").alias("_entries"))
            rows = source.withColumn("_key", key).join(F.broadcast(ids), "_key").drop("_key")
            out.append(rows.select(*source.columns, F.explode("_entries").alias("_entry")).join(
                F.broadcast(part), "_entry"))
        return out
