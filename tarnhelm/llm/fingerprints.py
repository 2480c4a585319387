"""Document fingerprints: bottom-k sketches of word-shingle hashes, in DataFrame functions only.

A sketch is the ascending array of the k least distinct 64-bit hashes of a text's five-word
shingles, in lower case (fewer words: the whole sequence; no words: empty). Sketches
of parts merge into the sketch of the whole. Two sketches estimate resemblance and containment,
one estimates the number of distinct shingles; below k distinct shingles all are exact.

Null texts count as empty. Two empty sketches resemble each other by 1, an empty and another
by 0. Equal texts have equal sketches. Repeated rows are ordered by their text's hash. Extra
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnhelm.llm.common import bind, keep, small, table, words

K = 128
WIDTH = 5
#: Documents per block when each row is paired with its neighbour.
BLOCK_ROWS = 4096


def shingle_hashes(text: Column, width: int = WIDTH) -> Column:
    """A hash for each run of ``width`` words; one for all words if there are fewer."""
    def of(h: Column) -> Column:
        parts = lambda i: [F.get(h, i + j if j else i) for j in range(width)]
        return (
            F.when(F.size(h) == 0, F.array().cast("array<bigint>"))
            .when(F.size(h) < width, F.array(F.xxhash64(h)))
            .otherwise(F.transform(
                F.sequence(F.lit(0), F.greatest(F.size(h) - width, F.lit(0))),
                lambda i: F.xxhash64(*parts(i))))
        )
    return bind(F.transform(words(F.lower(text)), lambda w: F.xxhash64(w)), of)


def sketch(text: Column, k: int = K) -> Column:
    """The bottom-k sketch of a text."""
    return F.slice(F.sort_array(F.array_distinct(shingle_hashes(text))), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of both texts' shingles together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_parts(parts: DataFrame, keys: list[str], sketch_col: str = "sketch", k: int = K):
    """Sketches of parts -> one sketch per key: the k least hashes over all parts.

    Parts are cut to k within salts of a key first, so a key with very many parts is spread.
    """
    one = parts.select(
        *keys, F.pmod(F.hash(sketch_col), F.lit(64)).alias("_salt"),
        F.explode_outer(sketch_col).alias("_h")).distinct()
    for group in ([*keys, "_salt"], keys):
        by = W.partitionBy(*group).orderBy(F.col("_h").asc_nulls_last())
        one = one.select(*keys, "_salt", "_h").dropDuplicates([*group, "_h"])
        one = one.withColumn("_r", F.row_number().over(by)).where(F.col("_r") <= k)
    return one.groupBy(*keys).agg(F.sort_array(F.collect_list("_h")).alias(sketch_col))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Share of the k least hashes of both that are in both: estimates |A and B| / |A or B|."""
    both = F.size(F.array_intersect(merge(a, b, k), F.array_intersect(a, b)))
    n = F.size(merge(a, b, k))
    return F.when(n == 0, 1.0).otherwise(both / F.greatest(n, F.lit(1))).cast("double")


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    spread = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / spread)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of A's shingles that are in B."""
    r = resemblance(a, b, k)
    common = r * (distinct_shingles(a, k) + distinct_shingles(b, k)) / (r + 1)
    return F.when(F.size(a) == 0, 1.0).otherwise(
        F.least(F.lit(1.0), common / distinct_shingles(a, k)))


def as_string(a: Column) -> Column:
    """A sketch as text: 16 hexadecimal digits a hash."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def with_next(docs: DataFrame, add: dict) -> DataFrame:
    """Add ``next``: the row that follows in descending doc_id, and the first row after the last.

    ``add`` (name -> Column) is computed for each row once and travels with it. Rows are cut
    into blocks of the id range of about BLOCK_ROWS rows; a window pairs neighbours inside a
    block, and one row per block hands its highest document over to the next block.
    """
    span = docs.agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"),
                    F.count("*").alias("n")).first()
    lo = span["lo"] or 0
    width = max(1, ((span["hi"] or 0) - lo + 1) * BLOCK_ROWS // max(1, span["n"]))
    key = F.coalesce("doc_id", F.lit(lo - 1))  # null ids come last
    block = F.floor((key - F.lit(lo)) / F.lit(width)).cast("bigint")
    heads = docs.select(key.alias("_k"), block.alias("_block"))
    tops = keep(heads.groupBy("_block").agg(F.max("_k").alias("_k")))
    chain = tops.select("_k", F.coalesce(
        F.lead("_block").over(W.orderBy("_block")),
        F.min("_block").over(W.partitionBy())).alias("_block"))
    handed = (
        docs.withColumn("_k", key).join(small(chain), "_k")
        .groupBy("_block").agg(F.max("text").alias("text"))
    )
    # The row handed over stands before the block's own rows, so one shuffle serves all.
    rows = docs.select("*", block.alias("_block"), F.lit(True).alias("_own")).unionByName(
        handed.select("_block", "text", F.lit(False).alias("_own")), allowMissingColumns=True)
    inside = W.partitionBy("_block").orderBy("_own", F.col("doc_id").asc_nulls_first(), "text")
    rows = rows.withColumns(add).withColumn("next", F.lag(F.struct("text", *add)).over(inside))
    return rows.where("_own").drop("_block", "_own")


def edited(text: Column, following: Column) -> Column:
    """The text with its last third replaced by as many first characters of another."""
    n = F.length(text)
    third = F.floor(n / 3).cast("int")
    return F.concat(text.substr(F.lit(1), n - third), following.substr(F.lit(1), third))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(docs, {"sketch": sketch(F.col("text"))}).select(
        "doc_id", F.length("text").cast("bigint").alias("n_chars"), "sketch",
        F.col("next.sketch").alias("following"),
        edited(F.col("text"), F.col("next.text")).alias("edit"))
    rows = rows.select(
        "doc_id", "n_chars", F.sha2("edit", 256).alias("edited_sha256"), "sketch",
        resemblance(F.col("sketch"), F.col("following")).alias("near_next"),
        bind(sketch(F.col("edit")), lambda e: F.struct(
            as_string(e).alias("text"),
            resemblance(F.col("sketch"), e).alias("near"))).alias("e"))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", as_string(F.col("sketch")).alias("fingerprint"),
        F.col("e.text").alias("edited_fingerprint"), F.col("e.near").alias("near_edited"),
        "near_next", distinct_shingles(F.col("sketch")).alias("distinct_shingles"))
