"""Benchmark decontamination by winnowing, in DataFrame functions only.

Words are runs of letters, digits and other non-ASCII characters; A to Z are lower-cased. A window
is SPAN consecutive words of an item; an item with fewer words is one window. Document words
inside an occurrence of a window are hit.

1. Fingerprints: of each run of SPAN words the least hash of its runs of GRAM words is kept.
   Equal runs keep equal hashes, so a document that holds a window shares a fingerprint with it.
   Windows of fewer words have fingerprints for their own length (short ones: the whole window).
2. Documents and items meet in a join of fingerprints.
3. Every hit is extended to the windows around it, and these meet the distinct windows of the
   items as text: each meets one at most, however many items share it.

Documents are told apart by 128 bits of their text's hash until the end, so copies are one.
Null texts have no words. Repeated rows are reported each; items with the same id are one item, and
the windows of items without an id hit but are not named. Empty tables: no rows, or nothing hit.
Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnhelm.llm.common import bind, keep, lower_ascii, small, table

SPAN = 10
GRAM = 5
BREAKS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
KEY = ["_k1", "_k2"]


def words(text: Column) -> Column:
    """The words of a text; an empty array for a text without any or a null text."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), BREAKS), "")


def key() -> list[Column]:
    """128 bits of the hash of ``text``."""
    return [F.xxhash64("text").alias("_k1"), F.xxhash64(F.lit("key"), "text").alias("_k2")]


def runs(first: Column, n: Column) -> Column:
    """first, first + 1, ..., n - 1; empty if there are none."""
    return F.when(n > first, F.sequence(first, n - 1)).otherwise(F.array().cast("array<int>"))


def gram(span: int) -> int:
    return min(span, GRAM)


def grams(w: Column, size: int) -> Column:
    """A hash of each run of ``size`` words."""
    return bind(F.transform(w, lambda x: F.xxhash64(x)), lambda h: F.transform(
        runs(F.lit(0), F.size(h) - (size - 1)),
        lambda i: F.xxhash64(*[F.get(h, i + j if j else i) for j in range(size)])))


def winnowed(g: Column, span: int) -> Column:
    """(at, fp) of the grams that are the least of some run of ``span`` words."""
    n = span - gram(span) + 1

    def of(h: Column) -> Column:
        if n == 1:
            return runs(F.lit(0), F.size(h))
        least = F.transform(runs(F.lit(0), F.size(h) - (n - 1)), lambda i: F.least(
            *[F.get(h, i + j if j else i) for j in range(n)]))
        return bind(least, lambda m: F.filter(runs(F.lit(0), F.size(h)), lambda p: F.get(
            h, p) == F.greatest(*[F.get(m, p - j if j else p) for j in range(n)])))

    return bind(g, lambda h: F.transform(
        of(h), lambda p: F.struct(p.alias("at"), F.get(h, p).alias("fp"))))


def windows(items: DataFrame, span: int = SPAN) -> DataFrame:
    """(window, size, wid, item_id) of items (item_id, text), one row per window of an item."""
    w = words(F.col("text"))
    rows = items.select("item_id", w.alias("_w")).where(F.size("_w") > 0)
    size = F.least(F.size("_w"), F.lit(span))
    rows = rows.select("item_id", "_w", size.alias("size"), F.explode(
        F.sequence(F.lit(1), F.size("_w") - size + 1)).alias("_i"))
    rows = rows.select("item_id", F.array_join(
        F.slice("_w", F.col("_i"), F.col("size")), " ").alias("window"), "size").distinct()
    return rows.withColumn("wid", F.md5("window"))


def fingerprint_table(distinct: DataFrame, sizes: list[int]) -> DataFrame:
    """(size, fp) of distinct windows: one fingerprint each."""
    w = F.split("window", " ")
    fp = F.coalesce(*[F.when(F.col("size") == s, F.array_min(
        grams(w, gram(s)))) for s in sizes])
    return distinct.select("size", fp.alias("fp")).distinct()


def hits(docs: DataFrame, prints: DataFrame, sizes: list[int]) -> DataFrame:
    """(key, size, at): where fingerprints of documents are those of items."""
    used = sorted({gram(s) for s in sizes})
    rows = docs.select(*key(), bind(words(F.col("text")), lambda w: F.struct(
        *[grams(w, k).alias(f"g{k}") for k in used])).alias("_g"))
    rows = rows.select(*KEY, F.explode(F.array(*[
        F.struct(F.lit(s).alias("size"), winnowed(F.col(f"_g.g{gram(s)}"), s).alias("fps"))
        for s in sizes])).alias("_s"))
    rows = rows.select(*KEY, F.col("_s.size").alias("size"), F.explode("_s.fps").alias("_f"))
    return rows.select(*KEY, "size", "_f.at", "_f.fp").join(
        small(prints), ["size", "fp"], "left_semi").select(*KEY, "size", "at")


def occurrences(docs: DataFrame, found: DataFrame, distinct: DataFrame) -> DataFrame:
    """(key, start, size, wid), each once: the windows around the hits that are an item's."""
    places = keep(found.groupBy(*KEY, "size").agg(F.collect_set("at").alias("_at")))
    rows = docs.select(*key(), "text").join(small(places), KEY)
    rows = rows.select(*KEY, "size", "_at", words(F.col("text")).alias("_w"))
    reach = F.col("size") - F.least("size", F.lit(GRAM))
    starts = F.array_distinct(F.flatten(F.transform("_at", lambda p: runs(
        F.greatest(F.lit(0), p - reach),
        F.least(p, F.size("_w") - F.col("size")) + 1))))
    rows = rows.select(*KEY, "size", "_w", F.explode(starts).alias("start"))
    rows = rows.select(*KEY, "size", "start", F.array_join(
        F.slice("_w", F.col("start") + 1, F.col("size")), " ").alias("window"))
    return rows.join(small(distinct), ["size", "window"]).select(
        *KEY, "start", "size", "wid").distinct()


def covered(found: DataFrame) -> DataFrame:
    """(key, n_hit): words inside the occurrences."""
    end = F.col("start") + F.col("size")
    spans = found.groupBy(*KEY, "start").agg(F.max(end).alias("_end"))
    before = F.max("_end").over(
        W.partitionBy(*KEY).orderBy("start").rowsBetween(W.unboundedPreceding, -1))
    new = F.greatest(F.lit(0), F.col("_end") - F.greatest("start", F.coalesce(before, F.lit(0))))
    return spans.withColumn("_new", new).groupBy(*KEY).agg(
        F.sum("_new").cast("bigint").alias("n_hit"))


def named(found: DataFrame, of_items: DataFrame) -> DataFrame:
    """(key, n_items, items_sha256). Documents with the same windows share one list of items."""
    sets = keep(found.groupBy(*KEY).agg(F.sort_array(F.collect_set("wid")).alias("_wids")))
    sets = sets.select(*KEY, F.sha2(F.array_join("_wids", ","), 256).alias("_set"), "_wids")
    each = sets.groupBy("_set").agg(F.first("_wids").alias("_wids")).select(
        "_set", F.explode("_wids").alias("wid"))
    ids = of_items.where(F.col("item_id").isNotNull()).select(
        "wid", F.col("item_id").cast("string").alias("item_id")).distinct()
    lists = each.join(small(keep(ids)), "wid").groupBy("_set").agg(
        F.sort_array(F.collect_set("item_id")).alias("_ids"))
    lists = lists.select("_set", F.size("_ids").cast("bigint").alias("n_items"),
                         F.sha2(F.array_join("_ids", ","), 256).alias("items_sha256"))
    return sets.drop("_wids").join(small(keep(lists)), "_set", "left").drop("_set")


def decontaminate(docs: DataFrame, items: DataFrame, span: int = SPAN) -> DataFrame:
    """Per document of (doc_id, text): what it shares with the items (item_id, text)."""
    docs = docs.select("doc_id", "text")
    of_items = keep(windows(items.select("item_id", "text"), span))
    distinct = keep(of_items.select("window", "size", "wid").distinct())
    sizes = sorted(r["size"] for r in distinct.select("size").distinct().collect())  # <= span
    plain = docs.select(
        "doc_id", *key(), F.size(words(F.col("text"))).cast("bigint").alias("n_words"))
    if sizes:
        prints = keep(fingerprint_table(distinct, sizes))
        found = keep(occurrences(docs, hits(docs, prints, sizes), distinct))
        hit = keep(covered(found).join(named(found, of_items), KEY))
        plain = plain.join(small(hit), KEY, "left")
    else:
        plain = plain.withColumns({
            "n_hit": F.lit(0), "n_items": F.lit(0), "items_sha256": F.lit(None)})
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return plain.select(
        "doc_id", "n_words", zero("n_hit"), zero("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
with words as (
  select row_number() over () as row, doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents
),
items as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark
),
windows as (
  select distinct item_id, n, array_to_string(w[i:i + n - 1], ' ') as words_of
  from (select item_id, w, least(10, len(w)) as n,
               unnest(range(1, len(w) - least(10, len(w)) + 2)) as i
        from items where len(w) > 0)
),
spans as (
  select row, i, n, array_to_string(w[i:i + n - 1], ' ') as words_of
  from (select row, w, n, unnest(range(1, len(w) - n + 2)) as i
        from words, (select distinct n from windows) where len(w) >= n)
),
found as (select row, i, n, item_id from spans join windows using (n, words_of)),
hit as (
  select row, count(distinct place) as n_hit
  from (select row, unnest(range(i, i + n)) as place from found) group by row
),
named as (
  select row, count(*) as n_items, sha256(string_agg(id, ',' order by id)) as items_sha256
  from (select distinct row, item_id::varchar as id from found where item_id is not null)
  group by row
)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit,
       coalesce(n_items, 0)::bigint as n_items,
       coalesce(items_sha256, sha256('')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from words left join hit using (row) left join named using (row)
"""
