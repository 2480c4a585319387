"""What the operators of this folder share: tables, stored intermediates, words, components."""

from __future__ import annotations

import contextlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnhelm.sources.stored import keep, shared_folder

__all__ = [
    "BLANKS", "BLANK_CHARS", "BROADCAST_ROWS", "bind", "components", "give_back", "keep", "lower_ascii",
    "shared_folder", "small", "small_batches", "table", "words",
]

#: Characters between words: blank, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = "[\\x20\\x09-\\x0D]+"
BLANK_CHARS = " \t\n\x0b\f\r"
#: Rows up to which a table of ids and numbers may be broadcast (some 30 MB).
BROADCAST_ROWS = 1_000_000
#: Bytes of texts that go to Python at once where several stages share the workers.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast of a kept table if it is counted to be small; else leave it to Spark."""
    return F.broadcast(df) if df.count() <= rows else df


def lower_ascii(text: Column) -> Column:
    """Lower-case A to Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: Column) -> Column:
    """The words of a text; an empty array for a text without any or a null text."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANK_CHARS))
    return bind(
        bare, lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(
            F.split(t, BLANKS))
    )


def bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once however often ``use`` names it."""
    return F.transform(F.array(value), lambda v: use(v))[0]


def give_back() -> None:
    """Return what a task no longer uses to the system: Python workers live on for later tasks."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def small_batches(spark: SparkSession) -> None:
    """Let texts go to Python in batches of BATCH_BYTES, unless the session asks for less."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(
            spark.conf.get(name)) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): one row (node, component) per node with an edge.

    ``component`` is the least node that can be reached. Every round lets each node follow its
    least neighbour, shortens these paths, and contracts the edges to their ends, so the number
    of rounds grows with the logarithm of the graph. Nothing is gathered in one task.
    """
    def ordered(e: DataFrame) -> DataFrame:
        return (
            e.where("a <> b")
            .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        )

    first = left = keep(ordered(edges.select("a", "b")))
    levels: list[DataFrame] = []
    while not left.isEmpty():
        up = keep(left.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("p")))
        while True:
            nxt = up.select(F.col("v").alias("p"), F.col("p").alias("pp"))
            up = keep(up.join(nxt, "p", "left").select(
                "v", F.coalesce("pp", "p").alias("p"), F.col("pp").isNotNull().alias("moved")))
            if up.where("moved").isEmpty():
                break
            up = up.drop("moved")
        up = up.drop("moved")
        levels.append(up)
        ends = left
        for side in ("a", "b"):
            ends = (
                ends.join(up.select(F.col("v").alias(side), F.col("p").alias("_p")), side, "left")
                .withColumn(side, F.coalesce("_p", side)).drop("_p")
            )
        left = keep(ordered(ends))
    nodes = first.select(F.col("a").alias("node")).union(first.select("b")).distinct()
    out = nodes.withColumn("component", F.col("node"))
    for up in levels:
        hop = up.select(F.col("v").alias("component"), F.col("p").alias("_p"))
        out = out.join(hop, "component", "left").select(
            "node", F.coalesce("_p", "component").alias("component"))
    return out
