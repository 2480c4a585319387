"""Phrase collocations from depth-truncated suffix trees, partitioned vertically.

Texts are cut into pieces at punctuation and line ends, pieces into words; A to Z are lower-cased.
A phrase is a run of words inside a piece. Per language, phrases of 2 to DEPTH words that occur
LEAST times or more are scored by their weakest cut, phrases that only ever occur inside a longer
one are dropped, and the best are reported.

1. Words are counted; then pairs of words that are both frequent. No phrase with a rarer word or
   pair can be frequent, so suffixes end there, or after DEPTH words. The two sets reach the tasks
   as bitmaps of bounded size; what they let through by mistake only costs work.
2. The suffixes of all texts are the leaves of one tree. Word prefixes split it vertically: a
   prefix with more leaves than the budget is lengthened by a word, again and again, and prefixes
   within the budget are put together in groups of about the budget.
3. Each group's subtree is built on its own from its sorted leaves, one path at a time, and every
   node's count is the total of its leaves.

A null text counts as empty, a null language is ``und``. Repeated rows count each; whole texts are
read, long ones in slices. An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnhelm.llm.common import keep, small, table

DEPTH = 5
LEAST = 100
BEST = 2000
UNKNOWN_LANG = "und"
#: Words that are counted or turned into suffixes at once, per language.
BLOCK = 1_000_000
#: Distinct words that a task numbers before it starts anew.
NUMBERED = 400_000
#: Bytes of a long text that are split into words at once.
SLICE = 1 << 20
#: Leaves of a group of prefixes.
BUDGET = 100_000
#: Places by which words and pairs are told apart, a power of two; what shares one is taken for
#: frequent together.
PLACES = 1 << 40
#: Bits of a set of places: so many for each member, but no more than the last number.
BITS_EACH, MOST_BITS = 16, 1 << 30
#: Bits in a page when a set is put together.
PAGE = 1 << 15
#: Parts in which the best phrases of a language are found first.
PARTS = 16

_UPPER, _ENDS = bytes(range(65, 91)), b".,;:!?\n\x0b\x0c\r"
BYTES = bytes.maketrans(
    _UPPER + _ENDS + b"\t", _UPPER.lower() + b"\n" * len(_ENDS) + b" ")
END = 0  # the number of a piece's end

COUNTS = "lang string, phrase string, n bigint"
FIRST, SECOND = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def places(lang: int, first: np.ndarray, second: np.ndarray | None, bits: int) -> np.ndarray:
    """Places of words or pairs in a set of ``bits`` bits, a power of two."""
    h = (first.astype(np.uint64) + np.uint64(lang)) * FIRST
    if second is not None:
        h = ((h >> np.uint64(29)) ^ h) * SECOND + second.astype(np.uint64) * FIRST
    h = ((h >> np.uint64(32)) ^ h) * SECOND
    return (h >> np.uint64(64 - bits.bit_length() + 1)).astype(np.int64)


def in_set(pages: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (pages[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def bit_set(found: DataFrame) -> np.ndarray:
    """The set of kept places (``at``, of PLACES) as a bitmap without misses."""
    bits = min(MOST_BITS, max(PAGE, 1 << (BITS_EACH * found.count()).bit_length()))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for own in batch.column(1):
                marks = np.zeros(PAGE, np.uint8)
                marks[own.values.to_numpy()] = 1
                out.append(np.packbits(marks, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], ["page", "data"])

    bit = F.shiftright("at", PLACES.bit_length() - bits.bit_length())
    pages = found.select(F.floor(bit / PAGE).alias("page"), (bit % PAGE).alias("bit"))
    rows = pages.groupBy("page").agg(F.collect_set("bit").alias("bits")).mapInArrow(
        fill, "page bigint, data binary").toArrow()  # bits / 8 bytes in all at most
    out = np.zeros(bits // 8, np.uint8)
    for page, data in zip(rows["page"].to_pylist(), rows["data"].to_pylist(), strict=True):
        out[page * PAGE // 8:(page + 1) * PAGE // 8] = np.frombuffer(data, np.uint8)
    return out


def word_places(words: DataFrame) -> DataFrame:
    """The places (at) of words (lang, phrase)."""
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [places(crc32(lang.encode()), np.array([crc32(w.encode())], np.uint64), None,
                         PLACES)[0]
                  for lang, w in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64())], ["at"])

    return words.select("lang", "phrase").mapInArrow(place, "at bigint")


class Words:
    """Numbers the words of texts and hands them over in blocks, one stream per language.

    ``use(lang, ids, n)`` gets the first n places of a block; the DEPTH - 1 ids that may follow
    them come along, and pieces end in END. Afterwards the words' names are ``names``.
    """

    def __init__(self, use: Callable[[str, np.ndarray, int], None], leave: Callable[[], None]):
        self.use, self.leave = use, leave
        self.streams: dict[str, list] = {}
        self.held: dict[str, int] = {}
        self.start()

    def start(self) -> None:
        self.names: list[bytes] = [b"\n"]
        self.ids: dict[bytes, int] = {b"\n": END, b"": -1}

    def add(self, lang: str, text: bytes) -> None:
        data, at = text.translate(BYTES), 0
        while at < len(data):
            upto = data.find(b" ", at + SLICE) if len(data) - at > SLICE else -1
            part = data[at:] if upto < 0 else data[at:upto]
            at = len(data) if upto < 0 else upto
            ids, names, out = self.ids, self.names, []
            for w in part.replace(b"\n", b" \n ").split(b" "):
                i = ids.get(w)
                if i is None:
                    i = ids[w] = len(names)
                    names.append(w)
                out.append(i)
            row = np.array(out, np.int64)
            row = row[row >= 0]
            self.streams.setdefault(lang, []).append(row)
            self.held[lang] = self.held.get(lang, 0) + len(row)
            if self.held[lang] > BLOCK:
                self.flush(lang)
            if len(self.names) > NUMBERED:
                self.renew()
        self.streams.setdefault(lang, []).append(np.zeros(1, np.int64))

    def flush(self, lang: str, last: bool = False) -> None:
        ids = np.concatenate(self.streams[lang])
        n = len(ids) if last else max(0, len(ids) - DEPTH + 1)
        self.use(lang, np.concatenate([ids, np.zeros(DEPTH, np.int64)]), n)
        self.streams[lang], self.held[lang] = [ids[n:]], len(ids) - n

    def renew(self) -> None:
        """Hand over all streams and number words anew; the ids that must stay are translated."""
        for lang in self.streams:
            self.flush(lang)
        self.leave()
        old = self.names
        self.start()
        for lang, (rest,) in self.streams.items():
            words = [old[i] for i in rest.tolist()]
            for w in words:
                if w not in self.ids:
                    self.ids[w] = len(self.names)
                    self.names.append(w)
            self.streams[lang] = [np.array([self.ids[w] for w in words], np.int64)]

    def close(self) -> None:
        for lang in self.streams:
            self.flush(lang, last=True)
        self.leave()


def batch_of(lang: str, phrases: list[bytes], n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([lang]).take(pa.array(np.zeros(len(phrases), np.int64))),
         pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(n.astype(np.int64))],
        ["lang", "phrase", "n"])


def counted(docs: DataFrame, count: Callable, schema: str = COUNTS) -> DataFrame:
    """Counts over (lang, text) by tasks: ``count(words, out)`` gives use and leave."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[pa.RecordBatch] = []
        words = Words(lambda *a: use(*a), lambda: leave())
        use, leave = count(words, out)
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for lang, text in zip(langs, batch.column(1).cast(pa.binary()), strict=True):
                words.add(lang, text.as_py())
                yield from out
                out.clear()
        words.close()
        yield from out

    return docs.select(
        F.coalesce("lang", F.lit(UNKNOWN_LANG)).alias("lang"),
        F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, schema)


def word_counts(docs: DataFrame) -> DataFrame:
    def count(words: Words, out: list):
        sums: dict[str, np.ndarray] = {}

        def use(lang: str, ids: np.ndarray, n: int) -> None:
            got = np.bincount(ids[:n], minlength=len(words.names))
            old = sums.get(lang, np.zeros(0, np.int64))
            got[:len(old)] += old
            sums[lang] = got

        def leave() -> None:
            for lang, got in sums.items():
                got[END] = 0
                at = np.flatnonzero(got)
                out.append(batch_of(lang, [words.names[i] for i in at.tolist()], got[at]))
            sums.clear()
        return use, leave

    return counted(docs, count).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


class Marks:
    """Which of a task's words are in a set of words, and the words' hashes."""

    def __init__(self, words: Words, pages: np.ndarray):
        self.words, self.pages = words, pages
        self.names: list | None = None

    def __call__(self, lang: str) -> tuple[np.ndarray, np.ndarray]:
        """(in the set, hash) by the words' numbers."""
        names = self.words.names
        if names is not self.names:
            self.names, self.marks = names, {}
            self.hashes = np.zeros(0, np.uint64)
        if len(self.hashes) < len(names):
            new = [crc32(w) for w in names[len(self.hashes):]]
            self.hashes = np.concatenate([self.hashes, np.array(new, np.uint64)])
        old = self.marks.get(lang, np.zeros(0, bool))
        if len(old) < len(names):
            at = places(crc32(lang.encode()), self.hashes[len(old):], None, len(self.pages) * 8)
            old = self.marks[lang] = np.concatenate([old, in_set(self.pages, at)])
            old[END] = False
        return old, self.hashes


def pair_counts(docs: DataFrame, frequent: np.ndarray) -> DataFrame:
    """(at, n): counts of pairs of frequent words by their place among PLACES. Words themselves
    are not needed here, and a place is a fraction of their size."""
    sent = docs.sparkSession.sparkContext.broadcast(frequent)

    def count(words: Words, out: list):
        marked = Marks(words, sent.value)

        def use(lang: str, ids: np.ndarray, n: int) -> None:
            on, hashes = marked(lang)
            on = on[ids]
            at = np.flatnonzero(on[:n] & on[1:n + 1])
            pairs, sums = np.unique(places(
                crc32(lang.encode()), hashes[ids[at]], hashes[ids[at + 1]], PLACES),
                return_counts=True)
            out.append(pa.RecordBatch.from_arrays(
                [pa.array(pairs), pa.array(sums.astype(np.int64))], ["at", "n"]))
        return use, lambda: None

    return counted(docs, count, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n"))


def suffixes(docs: DataFrame, frequent: np.ndarray, pairs: np.ndarray) -> DataFrame:
    """Counts of suffixes of two words or more, each cut after DEPTH words or before a pair that
    is not frequent."""
    sent = docs.sparkSession.sparkContext.broadcast((frequent, pairs))

    def count(words: Words, out: list):
        marked = Marks(words, sent.value[0])

        def use(lang: str, ids: np.ndarray, n: int) -> None:
            on, hashes = marked(lang)
            on, m = on[ids], n + DEPTH - 2  # pairs begin at m places
            goes = np.zeros(m + 1, bool)
            at = np.flatnonzero(on[:m] & on[1:m + 1])
            goes[at] = in_set(sent.value[1], places(
                crc32(lang.encode()), hashes[ids[at]], hashes[ids[at + 1]],
                len(sent.value[1]) * 8))
            at = np.flatnonzero(goes[:n])
            if not len(at):
                return
            # Numbers of whole suffixes, a word at a time; words beyond the end are END.
            rows, going = [ids[at]], np.ones(len(at), bool)
            number = rows[0]
            for k in range(1, DEPTH):
                going &= goes[at + k - 1]
                rows.append(np.where(going, ids[at + k], END))
                number = np.unique(number << 32 | rows[-1], return_inverse=True)[1]
            _, first, sums = np.unique(number, return_index=True, return_counts=True)
            names = words.names
            out.append(batch_of(lang, [
                b" ".join([names[i] for i in row if i != END])
                for row in zip(*(r[first].tolist() for r in rows), strict=True)], sums))
        return use, lambda: None

    return counted(docs, count).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def partitioned(leaves: DataFrame, budget: int = BUDGET) -> tuple[DataFrame, int]:
    """Kept leaves (lang, phrase, n) with their words, the ``depth`` of their group's prefix and
    the ``group``; and the number of groups."""
    n = leaves.count()
    groups = max(1, -(-n // budget))
    rows = leaves.select("lang", F.split("phrase", " ").alias("words"), "n", F.lit(2).alias("depth"))
    prefix = lambda d: F.slice("words", 1, d)
    for d in range(2, DEPTH):
        # At most n / budget prefixes are too large.
        large = keep(
            rows.where(F.col("depth") == d).groupBy("lang", prefix(d).alias("_prefix"))
            .agg(F.count("*").alias("_n")).where(F.col("_n") > budget)
            .select("lang", "_prefix", F.lit(True).alias("_large")))
        if large.isEmpty():
            break
        rows = rows.withColumn("_prefix", prefix(d)).join(
            small(large), ["lang", "_prefix"], "left").select(
            "lang", "words", "n", (F.col("depth") + F.when(
                F.coalesce("_large", F.lit(False)), 1).otherwise(0)).alias("depth"))
    return rows.withColumn("group", F.pmod(
        F.xxhash64("lang", prefix(F.col("depth"))), F.lit(groups))), groups


def tree_counts(leaves: DataFrame, least: int = LEAST, budget: int = BUDGET) -> DataFrame:
    """(lang, phrase, n) of the tree's nodes of two words or more that count ``least`` or more."""
    rows, groups = partitioned(leaves, budget)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path: list[str] = []  # the words from the root to the latest leaf
        totals: list[int] = []
        key, depth, found = None, 2, []

        def close(to: int) -> None:
            while len(path) > to:
                total = totals.pop()
                # Nodes above the group's prefix may go on in other groups.
                if len(path) >= 2 and (total >= least or len(path) < depth):
                    found.append((key[1], " ".join(path), total))
                path.pop()
                if totals:
                    totals[-1] += total

        def out() -> pa.RecordBatch:
            lang, phrase, n = zip(*found, strict=True) if found else ((), (), ())
            found.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(lang, pa.string()), pa.array(phrase, pa.string()),
                 pa.array(n, pa.int64())], ["lang", "phrase", "n"])

        for batch in batches:
            for group, lang, words, n, deep in zip(
                    *(c.to_pylist() for c in batch.columns), strict=True):
                same = 0
                if (group, lang, deep) == key:
                    for a, b in zip(path, words):
                        if a != b:
                            break
                        same += 1
                close(same)
                key, depth = (group, lang, deep), deep
                path.extend(words[same:])
                totals.extend([0] * (len(words) - same))
                totals[-1] += n
            yield out()
        close(0)
        yield out()

    nodes = (
        rows.select("group", "lang", "words", "n", "depth")
        .repartition(groups, "group").sortWithinPartitions("group", "lang", "depth", "words")
        .select("group", "lang", "words", "n", "depth").mapInArrow(build, COUNTS)
    )
    return nodes.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def frequent_phrases(docs: DataFrame, least: int = LEAST, budget: int = BUDGET):
    """Kept tables: (lang, phrase, n) of 1 to DEPTH words counting ``least`` or more, and
    (lang, n) with the number of all words."""
    words = keep(word_counts(docs))
    totals = keep(words.groupBy("lang").agg(F.sum("n").alias("total")))
    words = keep(words.where(F.col("n") >= least))
    marks = bit_set(keep(word_places(words)))
    pairs = bit_set(keep(pair_counts(docs, marks).where(F.col("n") >= least).select("at")))
    leaves = keep(suffixes(docs, marks, pairs))
    return keep(words.unionByName(tree_counts(leaves, least, budget))), totals


def scored(phrases: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of the phrases of two words or more, by the cut of the
    lowest score. All whole numbers, products as decimals of 38 digits."""
    many = phrases.select(
        "lang", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("_w"))
    cuts = many.where(F.size("_w") > 1).select(
        "lang", "phrase", "a", "_w", F.explode(
            F.sequence(F.lit(1), F.size("_w") - 1)).alias("_k"))

    def joined(start: Column, size: Column) -> Column:
        return F.array_join(F.slice("_w", start, size), " ")

    part = lambda name: small(phrases).select(
        "lang", F.col("phrase").alias(f"_{name}"), F.col("n").alias(name))
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    cuts = cuts.select(
        "lang", "phrase", "a", "_k", joined(F.lit(1), F.col("_k")).alias("_l"),
        joined(F.col("_k") + 1, F.size("_w") - F.col("_k")).alias("_r"))
    cuts = cuts.join(part("l"), ["lang", "_l"]).join(part("r"), ["lang", "_r"]).join(
        small(totals).withColumnRenamed("total", "n"), "lang")
    cuts = cuts.withColumns({"_up": wide("a") * wide("n") * 1000, "_down": wide("l") * wide("r")})
    cuts = cuts.withColumn("score", F.expr("_up div _down"))
    weakest = F.min(F.struct("score", "_k", "l", "r")).alias("_cut")
    return cuts.groupBy("lang", "phrase", "a", "n").agg(weakest).select(
        "lang", "phrase", "a", "_cut.l", "_cut.r", "n", "_cut.score")


def closed(phrases: DataFrame, found: DataFrame) -> DataFrame:
    """``found`` without phrases that lie in a longer one as frequent as they are.

    Such a phrase lies in one that is a word longer and just as frequent: it is enough to look at
    phrases without their first or last word.
    """
    longer = phrases.withColumn("_w", F.split("phrase", " ")).where(F.size("_w") > 2)
    inner = longer.select("lang", F.col("n").alias("a"), F.explode(F.array(
        F.array_join(F.slice("_w", F.lit(1), F.size("_w") - 1), " "),
        F.array_join(F.slice("_w", F.lit(2), F.size("_w") - 1), " "))).alias("phrase")).distinct()
    return found.join(inner, ["lang", "phrase", "a"], "left_anti")


def collocations(docs: DataFrame, least: int = LEAST, best: int = BEST,
                 budget: int = BUDGET) -> DataFrame:
    phrases, totals = frequent_phrases(docs, least, budget)
    rows = closed(phrases, scored(phrases, totals))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    rows = rows.withColumn("_part", part).withColumn("rank", F.row_number().over(
        W.partitionBy("lang", "_part").orderBy(*order))).where(F.col("rank") <= best)
    rows = rows.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)))
    return rows.where(F.col("rank") <= best).select(
        "lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents").select("lang", "text"))


ORACLE = r"""
with pieces as (
  select coalesce(lang, 'und') as lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\x0A-\x0D]')) as piece
  from documents
),
words as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces),
grams as (
  select lang, k, array_to_string(w[i:i + k - 1], ' ') as phrase, count(*) as f
  from (select lang, w, k, unnest(range(1, len(w) - k + 2)) as i
        from words, (select unnest([1, 2, 3, 4, 5]) as k) where len(w) >= k)
  group by all
),
totals as (select lang, sum(f) as n from grams where k = 1 group by lang),
candidates as (select lang, k as size, phrase, f as a, string_split(phrase, ' ') as w
               from grams where k > 1 and f >= 100),
cuts as (
  select c.lang, c.phrase, c.a, p.f as l, q.f as r, t.n, cut,
         (1000::hugeint * c.a * t.n) // (p.f::hugeint * q.f) as score
  from (select *, unnest(range(1, size)) as cut from candidates) c
  join grams p on p.lang = c.lang and p.k = cut
              and p.phrase = array_to_string(c.w[1:cut], ' ')
  join grams q on q.lang = c.lang and q.k = c.size - cut
              and q.phrase = array_to_string(c.w[cut + 1:], ' ')
  join totals t on t.lang = c.lang
),
scored as (
  select * from cuts
  qualify row_number() over (partition by lang, phrase order by score, cut) = 1
),
kept as (
  select * from scored s where not exists (
    select 1 from candidates x where x.lang = s.lang and 100 * x.a >= 100 * s.a
      and length(x.phrase) > length(s.phrase)
      and contains(' ' || x.phrase || ' ', ' ' || s.phrase || ' '))
)
select lang, row_number() over (
         partition by lang order by score desc, a desc, phrase) as rank,
       phrase, a::bigint as a, l::bigint as l, r::bigint as r, n::bigint as n,
       score::bigint as score
from kept
qualify rank <= 2000
"""
