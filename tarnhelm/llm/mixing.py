"""Mixing sources to target weights by hash thresholds.

Every document has a hash that depends on its id alone. Sizes are summed by source and hash
bucket; the bucket in which a source's budget ends is cut into finer buckets until single hash
values remain, so one hash threshold per source is found without sorting documents. A larger
budget has a larger threshold, so smaller mixes are subsets of larger ones.

Null or empty texts have size 0 and are taken with 0 words. Null sources are one source, last
in order. Rows that share a doc_id share a hash and are taken together. An empty table gives an
empty mix. Other columns of the input do not matter; columns named ``_m_...`` are reserved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnhelm.llm.common import BLANK_CHARS, BLANKS, BROADCAST_ROWS, keep, small, table

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
#: Bits of the hash that one histogram level resolves; three levels resolve 36 bits.
LEVEL_BITS = 12
LEVELS = 3


def n_words(text: Column) -> Column:
    """Number of maximal runs of other characters than blanks."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANK_CHARS))
    return F.when(F.length(bare) == 0, 0).otherwise(F.size(F.split(bare, BLANKS))).cast("bigint")


def place(doc_id: Column) -> Column:
    """A document's fixed place in 0 .. 2**36 - 1, from the first digits of its id's MD5."""
    digits = F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 9)
    return F.conv(digits, 16, 10).cast("bigint")


def targets(sizes: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST) -> DataFrame:
    """Targets per source from (source, source_size).

    Sources share ``share`` of all sizes by weight; a target stops at ``most`` times its source's
    size and what is above goes to the others by weight. Sources reach their cap in the order of
    cap / weight, so sums along that order give the level at which the rest shares.
    """
    one = W.partitionBy()  # one row per source
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    at = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (at + 1).cast("int"))
    df = sizes.withColumn("weight", w).withColumn("cap", F.col("source_size") * F.lit(most))
    df = df.withColumn("_total", F.sum("source_size").over(one) * F.lit(share))
    order = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    rest = order.rowsBetween(0, W.unboundedFollowing)
    df = df.withColumn("_used", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    df = df.withColumn("_weights", F.sum("weight").over(rest))
    df = df.withColumn("_level", (F.col("_total") - F.col("_used")) / F.col("_weights"))
    # The first source that its level leaves below its cap sets the level of all after it.
    free = F.when(F.col("_level") * F.col("weight") < F.col("cap"), F.col("_level"))
    level = F.first(free, ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0))
    return df.withColumn("_at", level).select(
        "source", "source_size",
        F.when(F.col("_at").isNull(), F.col("cap"))
        .otherwise(F.least(F.col("cap"), F.col("_at") * F.col("weight"))).alias("target"),
    )


def thresholds(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """(source, source_size, target, rounds, cut): take a document ``rounds`` times, and once
    more if its place is below ``cut``."""
    plan = plan.withColumn(
        "rounds",
        F.when(F.col("source_size") == 0, 0)
        .otherwise(F.floor(F.col("target") / F.col("source_size"))).cast("bigint"),
    )
    state = plan.withColumn("need", F.col("target") - F.col("rounds") * F.col("source_size"))
    state = keep(state.withColumn("low", F.lit(0).cast("bigint")))
    few = state.count() <= BROADCAST_ROWS
    for level in range(1, LEVELS + 1):
        per_source = F.broadcast(state) if few else state
        shift = LEVEL_BITS * (LEVELS - level)
        # Only documents of a source's boundary bucket are counted again.
        inside = rows.join(
            per_source.select(F.col("source").alias("_m_s"), "low"),
            F.col("source").eqNullSafe(F.col("_m_s"))
            & (F.shiftright("place", shift + LEVEL_BITS) == F.shiftright("low", shift + LEVEL_BITS)),
        )
        bucket = F.shiftright("place", shift).alias("bucket")
        sums = inside.groupBy("source", bucket).agg(F.sum("size").alias("n"))
        upto = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)
        sums = sums.withColumn("upto", F.sum("n").over(upto))
        found = (
            sums.withColumnRenamed("source", "_m_s")
            .join(per_source, F.col("source").eqNullSafe(F.col("_m_s")))
            .where(F.col("upto") > F.col("need"))
            .groupBy(F.col("source").alias("_m_s"))
            .agg(F.min(F.struct("bucket", (F.col("upto") - F.col("n")).alias("got"))).alias("at"))
            .select("_m_s", "at.bucket", "at.got")
        )
        state = keep(
            state.join(found, F.col("source").eqNullSafe(F.col("_m_s")), "left").select(
                "source", "source_size", "target", "rounds",
                (F.col("need") - F.coalesce("got", F.lit(0))).alias("need"),
                F.coalesce(F.shiftleft("bucket", shift), F.col("low")).alias("low"),
            )
        )
    whole = F.col("target") <= F.col("rounds") * F.col("source_size")
    return state.select("source", "source_size", "target", "rounds",
                        F.when(whole, 0).otherwise(F.col("low")).alias("cut"))


def plan_for(docs: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST) -> DataFrame:
    """Per source (``_m_s``): source_size, target, rounds and cut."""
    rows = keep(docs.select(
        "source", place(F.col("doc_id")).alias("place"), n_words(F.col("text")).alias("size")))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = thresholds(rows, targets(sizes, weights, share, most))
    return small(plan.withColumnRenamed("source", "_m_s"))


def times() -> Column:
    """How often the mix takes a document that is joined with its source's plan."""
    return F.col("rounds") + (place(F.col("doc_id")) < F.col("cut")).cast("bigint")


def mix(docs: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST) -> DataFrame:
    """(doc_id, size, source_size, target, times): ``times`` is how often the mix takes it."""
    plan = plan_for(docs, weights, share, most)
    rows = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"))
    rows = rows.join(plan, F.col("source").eqNullSafe(F.col("_m_s")), "left")
    return rows.select("doc_id", "size", "source_size", "target", times().alias("times"))


def take(docs: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST) -> DataFrame:
    """The mixed table: every row of ``docs`` as often as the mix takes it."""
    plan = plan_for(docs, weights, share, most)
    names = {c: f"_d_{i}" for i, c in enumerate(docs.columns)}
    renamed = docs.select(
        "doc_id", "source", *[F.col(c).alias(n) for c, n in names.items()])
    rows = renamed.join(plan, F.col("source").eqNullSafe(F.col("_m_s")), "left")
    rows = rows.withColumn("_m_t", F.explode(F.array_repeat(F.lit(1), times().cast("int"))))
    return rows.select(*[F.col(n).alias(c) for c, n in names.items()])


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


ORACLE = r"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
    cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 9) as bigint) as place
  from documents),
s as (
  select source, sum(size)::bigint as source_size,
    [5.0::double, 2.0::double, 1.0::double][((row_number() over (order by source nulls last) - 1) % 3)::int + 1] as weight
  from d group by source),
c as (
  select *, source_size * 2.0::double as cap, sum(source_size) over () * 1.5::double as total from s),
l as (
  select *, (total - coalesce(sum(cap) over (order by cap / weight, source nulls last
      rows between unbounded preceding and 1 preceding), 0))
    / sum(weight) over (order by cap / weight, source nulls last
      rows between current row and unbounded following) as level from c),
t as (
  select source, source_size, weight, cap,
    first_value(case when level * weight < cap then level end ignore nulls) over (
      order by cap / weight, source nulls last) as lev from l),
p as (
  select source, source_size,
    case when lev is null then cap else least(cap, lev * weight) end as target from t),
r as (
  select d.doc_id, d.size, p.source_size, p.target,
    case when p.source_size = 0 then 0 else floor(p.target / p.source_size) end as rounds,
    sum(d.size) over (partition by d.source order by d.place
      range between unbounded preceding and current row) as upto
  from d join p on d.source is not distinct from p.source)
select doc_id, size::bigint as size, source_size, target,
  (size * (rounds + case when upto <= target - rounds * source_size
    then 1 else 0 end))::bigint as taken
from r
"""
