"""Exact n-gram Jaccard join by set relations.

A document is its set of five-word shingles (fewer words: the whole sequence; none: empty and
linked with nothing). Two documents link when 100 * |A and B| >= PERCENT * |A or B|.

1. Equal sets are one class: its members take the answers of the class's least document.
2. An inverted index holds each set's prefix in one global order, rarest shingles first: sets
   that link share SHARED shingles there. Index lists are skipped by size and position: sets only
   meet where their sizes and the shingles after the first shared one still allow a link.
3. Answers are derived incrementally. Neighbours in each list are compared first, and each set
   with the set of its list that has the fewest shingles of its own, which joins most similar
   sets to components. A set that is in a component already has the answers of its
   members; only sets of a list outside the list's largest component meet the rest of the list,
   and only across components. Every pair that may link two components is compared, so no link
   between components is lost, while large groups of similar sets never form all their pairs.
4. Compared pairs are decided on the whole sets.

Shingles are 64-bit hashes. Null texts count as empty. Rows that share a doc_id are one document
if their sets are equal; else each row is reported with the component of its id. An empty table
gives an empty result. Extra columns are not read; in ``keep_one`` they are passed on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnhelm.llm.common import components, give_back, keep, small, table

WIDTH = 5
PERCENT = 75
#: Bytes of text that are hashed at once.
CHUNK = 1 << 20
#: Shingles that a task holds before it counts them.
HELD = 1_000_000
#: Shingles ordered by their counts; all others count as rare and are ordered by hash. This
#: decides which shingles of a set are indexed, never what is found.
FREQUENT = 200_000
FREQUENT_FROM = 8

#: Indexed shingles that two linked sets share at least, where they have that many. More index
#: more and compare fewer sets that have little in common.
SHARED = 4

#: Sets of a list that are put in one order when neighbours are compared.
PART_ROWS = 256

BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
MIX = np.uint64(0xBF58476D1CE4E5B9)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * MIX
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Shingler:
    """Distinct shingle hashes of many texts at once, from their UTF-8 bytes."""

    def __init__(self, width: int = WIDTH):
        self.width = width
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[65:91] += 32
        self.powers = np.ones(1, np.uint64)
        self.inverses = np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        if n > len(self.powers):
            one = np.ones(1, np.uint64)
            for name, base in (("powers", BASE), ("inverses", BASE_INVERSE)):
                steps = np.concatenate([one, np.full(n, base)])
                setattr(self, name, np.multiply.accumulate(steps))

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """``data``: bytes; text i lies from offsets[i] to offsets[i + 1]. Sorted sets."""
        n = len(data)
        self.grow(n + 1)
        b = self.lower[data]
        part = ~((b == 32) | ((b >= 9) & (b <= 13)))
        fresh = np.zeros(n + 1, bool)  # a new text begins here
        fresh[offsets] = True
        before = np.concatenate([[False], part[:-1]]) if n else part
        start = np.flatnonzero(part & (~before | fresh[:n]))
        after = np.concatenate([part[1:], [False]]) if n else part
        end = np.flatnonzero(part & (~after | fresh[1:])) + 1
        sums = np.concatenate([
            np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * self.powers[:n])])
        word = _mixed((sums[end] - sums[start]) * self.inverses[start])
        word = _mixed(word + (end - start).astype(np.uint64) * BASE)
        at = np.searchsorted(start, offsets)
        w = self.width
        m = max(len(word) - w + 1, 0)
        run = np.zeros(m, np.uint64)
        for k in range(w):
            run = _mixed(run * BASE + word[k:k + m])
        out = []
        for a, z in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if z - a >= w:
                out.append(np.unique(run[a:z - w + 1]))
            elif z > a:
                h = np.full(1, z - a, np.uint64)
                for k in range(a, z):
                    h = _mixed(h * BASE + word[k:k + 1])
                out.append(h)
            else:
                out.append(np.zeros(0, np.uint64))
        return out

    def sets(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The sets of an array of texts, in order, in chunks of bounded size."""
        texts = texts.cast(pa.large_string()).fill_null("")
        if not len(texts):
            return
        _, offsets, data = texts.buffers()
        offsets = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
        data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        a = 0
        while a < len(texts):
            z = max(a + 1, int(np.searchsorted(offsets, offsets[a] + CHUNK, "right")) - 1)
            yield from self(data[offsets[a]:offsets[z]], offsets[a:z + 1] - offsets[a])
            a = z


def must_share(n: int, percent: int) -> int:
    """How many indexed shingles a set of ``n`` shares with any set that it links with."""
    return min(SHARED, -(-percent * n // 100))


def prefix_size(n: int, percent: int) -> int:
    """Shingles of a set of ``n`` that must be indexed.

    Of n shingles at least ceil(percent * n / 100) are in a linked set, so the first n less that,
    plus s, hold s of them; and so do the first of the other set.
    """
    return n - -(-percent * n // 100) + must_share(n, percent)


def frequent(docs: DataFrame, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles of all documents and their counts, sorted by shingle.

    Shingles that repeat within a chunk of a task are counted and summed over all tasks.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        held, n = [], 0

        def out() -> pa.RecordBatch:
            u, c = np.unique(np.concatenate(held), return_counts=True)
            many = c > 1
            return pa.RecordBatch.from_arrays(
                [pa.array(u[many].view(np.int64)), pa.array(c[many])], ["token", "n"])

        for batch in batches:
            for s in shingler.sets(batch.column(0)):
                held.append(s)
                n += len(s)
                if n > HELD:
                    yield out()
                    held, n = [], 0
        if held:
            yield out()
        give_back()

    rows = (
        docs.select("text").mapInArrow(count, "token bigint, n bigint")
        .groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT_FROM)
        .orderBy(F.desc("n"), "token").limit(FREQUENT).toPandas()
    )
    tokens = rows["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], rows["n"].to_numpy(np.int64)[order]


def prefixes(docs: DataFrame, percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """(doc_id, n, key, prefix, common): set size, a 128-bit name of the set, indexed shingles in
    order, and how many at the end of these are known to be frequent."""
    tokens, counts = frequent(docs, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        for batch in batches:
            sizes, keys, parts, common = [], [], [], []
            for s in shingler.sets(batch.column(1)):
                n = len(s)
                sizes.append(n)
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                if n and len(tokens):
                    at = np.searchsorted(tokens, s)
                    at[at == len(tokens)] = 0
                    seen = np.where(tokens[at] == s, counts[at], 0)
                    if seen.any():
                        order = np.argsort(seen, kind="stable")
                        s, seen = s[order], seen[order]
                else:
                    seen = np.zeros(n, np.int64)
                size = prefix_size(n, percent) if n else 0
                parts.append(s[:size])
                common.append(int((seen[:size] > 0).sum()))
            ends = np.cumsum([0, *map(len, parts)])
            flat = np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()),
                 pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)),
                 pa.array(common, pa.int32())],
                ["doc_id", "n", "key", "prefix", "common"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(
        run, "doc_id bigint, n bigint, key binary, prefix array<bigint>, common int")


def set_reader(docs: DataFrame, width: int):
    """Reads the sets of the documents that a kept table of pairs names."""
    def read(pairs: DataFrame) -> DataFrame:
        ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
        return keep(sets_of(docs, small(keep(ids)), width).groupBy("doc_id").agg(
            F.max("tokens").alias("tokens")))
    return read


def sets_of(docs: DataFrame, ids: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, tokens) of the named documents; other documents are not hashed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        for batch in batches:
            parts = list(shingler.sets(batch.column(1)))
            ends = np.cumsum([0, *map(len, parts)])
            flat = np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0),
                 pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))],
                ["doc_id", "tokens"])

    wanted = docs.select(F.col("doc_id").cast("bigint"), "text").join(ids, "doc_id", "left_semi")
    return wanted.mapInArrow(run, "doc_id bigint, tokens array<bigint>")


def may_link(percent: int) -> Column:
    """Whether sizes, less the indexed shingles that no other set has, leave room for a link."""
    n, m = F.col("n"), F.col("_n")
    rest = F.least(n - F.col("own"), m - F.col("_own"))
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (
        rest * (100 + percent) >= percent * (n + m))


def pairs_of(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of rows (a, n, pos, _a, _n, _pos, ...), one per shingle that two sets share
    in the index, that share enough of them and whose first positions leave room for a link."""
    n, m = F.col("n"), F.col("_n")
    rows = rows.where(may_link(percent))
    rest = F.least(n - F.col("pos"), m - F.col("_pos"))
    need = F.least(F.lit(SHARED), F.ceil(F.least(n, m) * percent / 100))
    return (
        rows.groupBy(F.least("a", "_a").alias("a"), F.greatest("a", "_a").alias("b"))
        .agg(F.count("*").alias("shared"), F.max(need).alias("need"),
             F.max(rest * (100 + percent) - percent * (n + m)).alias("room"))
        .where("shared >= need AND room >= 0").select("a", "b")
    )


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets link."""
    side = lambda x: sets.select(
        F.col("doc_id").alias(x), F.col("tokens").alias(f"_{x}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a")
    inter = F.size(F.array_intersect("_a", "_b"))
    total = F.size("_a") + F.size("_b")
    return both.where(inter * (100 + percent) >= percent * total).select("a", "b")


def join_components(docs: DataFrame, percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document."""
    rows = keep(prefixes(docs, percent, width))
    full = rows.where("n > 0")
    classes = full.groupBy("key").agg(
        F.min("doc_id").alias("doc_id"), F.first("n").alias("n"),
        F.first("prefix").alias("prefix"), F.first("common").alias("common"))
    index = classes.select(
        F.col("doc_id").alias("a"), "n", F.size("prefix").alias("size"),
        (F.size("prefix") - F.col("common")).alias("rare"),
        F.posexplode("prefix").alias("pos", "token"))
    # Frequent shingles are in several sets; of the others, whose lists are short, those in one
    # set only are left out.
    by_token = W.partitionBy("token")
    rare = index.where("pos < rare").withColumn("_lo", F.min("a").over(by_token)).withColumn(
        "_hi", F.max("a").over(by_token)).where("_lo <> _hi")
    row = ["token", "a", "n", "pos", "size"]
    lists = keep(rare.select(row).union(index.where("pos >= rare").select(row)))
    # Sets with too few shared shingles link with nothing; ``own``: those that no other set has.
    strong = lists.groupBy("a").agg(
        F.count("*").alias("k"), F.first("n").alias("n"), F.first("size").alias("size")
    ).where(F.col("k") >= F.least(F.lit(SHARED), F.ceil(F.col("n") * percent / 100)))
    strong = strong.select("a", (F.col("size") - F.col("k")).alias("own"))
    lists = keep(lists.drop("size").join(strong, "a"))

    # Long lists are compared in parts; other parts are drawn with another seed.
    sizes = lists.groupBy("token").agg(F.count("*").alias("m")).where(F.col("m") > PART_ROWS)
    sizes = sizes.select("token", F.pow(2, F.ceil(F.log2(F.col("m") / PART_ROWS))).alias("parts"))
    split = lists.join(small(keep(sizes)), "token", "left")

    cells = ("a", "n", "pos", "own")

    def parted(seed: int) -> DataFrame:
        place = F.xxhash64("a", F.lit(seed))
        part = F.pmod(place, F.coalesce("parts", F.lit(1)).cast("bigint"))
        return split.withColumns({"part": part, "place": place})

    def next_to(seed: int, *first: str) -> DataFrame:
        w = W.partitionBy("token", "part").orderBy(*first, "place")
        return parted(seed).withColumns({f"_{c}": F.lag(c).over(w) for c in cells}).where(
            "_a IS NOT NULL")

    def next_to_leader(seed: int) -> DataFrame:
        """Each set with the set of its part that has the fewest shingles of its own."""
        w = W.partitionBy("token", "part").orderBy("own", "a")
        return parted(seed).withColumns({f"_{c}": F.first(c).over(w) for c in cells}).where(
            "a <> _a")

    near = pairs_of(next_to(0, "n"), percent)
    for rows_of in (next_to(1), next_to_leader(2), next_to_leader(3)):
        near = near.union(pairs_of(rows_of, percent))
    near = keep(near.distinct())
    read = set_reader(docs, width)
    first = keep(linked(near, read(near), percent))
    known = keep(components(first))

    # Sets outside their list's largest component meet the sets of other components.
    part = lists.join(known.withColumnRenamed("node", "a"), "a", "left").withColumn(
        "c", F.coalesce("component", "a")).drop("component")
    part = keep(part)
    largest = part.groupBy("token", "c").agg(F.count("*").alias("m")).groupBy("token").agg(
        F.max_by("c", F.struct("m", "c")).alias("top"), F.count("*").alias("parts"))
    largest = keep(largest.where("parts > 1").select("token", "top"))
    open_lists = keep(part.join(largest, "token"))
    few = open_lists.where("c <> top").select(
        "token", *[F.col(x).alias(f"_{x}") for x in (*cells, "c")])
    across = open_lists.join(few, "token").where((F.col("c") != F.col("_c")) & (
        (F.col("c") == F.col("top")) | (F.col("a") < F.col("_a"))) & may_link(percent))
    # The first shingle that two linked sets share stands where the rest of both can still do it.
    rest = F.least(F.col("n") - F.col("pos"), F.col("_n") - F.col("_pos"))
    across = across.where(rest * (100 + percent) >= percent * (F.col("n") + F.col("_n")))
    across = keep(across.select(
        F.least("a", "_a").alias("a"), F.greatest("a", "_a").alias("b")).distinct())
    more = linked(across, read(across), percent)
    final = components(first.union(more))

    to_class = classes.select("key", F.col("doc_id").alias("node"))
    to_class = to_class.join(final, "node", "left").select(
        "key", F.coalesce("component", "node").alias("component_id"))
    return rows.select("doc_id", "n", "key").join(to_class, "key", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
        .alias("component_id"))


def keep_one(docs: DataFrame, percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """``docs`` without the documents that are in the component of one with a lesser id.

    Of rows that repeat both an id and its text one stays; rows that share only their id all do.
    """
    gone = keep(join_components(docs.select("doc_id", "text"), percent, width)
                .where("doc_id <> component_id").select(F.col("doc_id").alias("_id")).distinct())
    names = [f"_d_{i}" for i in range(len(docs.columns))]  # no name of docs can clash
    rows = docs.toDF(*names)
    doc_id, text = (F.col(names[docs.columns.index(c)]) for c in ("doc_id", "text"))
    left = rows.join(small(gone), doc_id == F.col("_id"), "left_anti")
    again = keep(left.groupBy(doc_id.alias("_id")).agg(F.count("*").alias("_n"))
                 .where("_n > 1 and _id is not null").select("_id", F.lit(True).alias("_again")))
    if again.isEmpty():
        return left.toDF(*docs.columns)
    marked = left.join(small(again), doc_id == F.col("_id"), "left").select(*names, "_again")
    once = marked.where("_again").withColumns({"_id": doc_id, "_text": text}).dropDuplicates(
        ["_id", "_text"])
    return marked.where("_again is null").select(names).unionByName(once.select(names)).toDF(
        *docs.columns)


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE = r"""
with recursive w as (
  select doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') as w from documents),
s as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 3),
      lambda i: array_to_string(w[i:i + 4], ' '))) end as s from w),
k as (select s, min(doc_id) as a, len(s) as n from (
  select doc_id, list_sort(s) as s from s) where len(s) > 0 group by s),
t as (select a, n, unnest(s) as t from k),
p as (
  select x.a, y.a as b from t x join t y on x.t = y.t and x.a < y.a
  group by x.a, y.a, x.n, y.n having 100 * count(*) >= 75 * (x.n + y.n - count(*))),
e as (select a, b from p union select b, a from p),
r as (select a as v, a as c from k union select e.b, r.c from r join e on r.v = e.a),
c as (select v, min(c) as c from r group by v)
select s.doc_id, len(s.s)::bigint as n_shingles, coalesce(c.c, s.doc_id) as component_id
from s left join k on list_sort(s.s) = k.s left join c on c.v = k.a
"""
