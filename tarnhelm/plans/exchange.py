"""Registered queries over sources, sinks and user extensions: tables written and read back.

Files go to the folder that driver and executors share; every query writes what it derives from
the given tables and reads it with the public reader.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnhelm.operators import evaluate as E
from tarnhelm.operators import ledger as L
from tarnhelm.operators import spans as P
from tarnhelm.plans import evaluation, evidence
from tarnhelm.plans.plants import read
from tarnhelm.sources import readers as RD
from tarnhelm.sources import sinks as SK
from tarnhelm.sources.stored import shared_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        ORACLES[name] = sql
        return fn

    return add


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


@query(
    "read_payloads",
    "select conv_id, conv_id % 3 = 0 as malformed from conversations group by 1",
)
def read_payloads(spark, sf):
    """Bodies as lines of text files; every third is cut short and does not parse."""
    path = _folder(spark)
    rows = read(spark, sf, "conversations").groupBy("conv_id").agg(
        F.sort_array(F.collect_list("turn")).alias("turns"))
    body = F.to_json(F.struct("conv_id", "turns"))
    cut = F.substring(body, F.lit(1), F.length(body) - 1)
    rows.select(F.when(F.col("conv_id") % 3 == 0, cut).otherwise(body).alias("value")).write.text(
        path)
    return RD.read_payloads(spark, path).select(
        F.regexp_extract("body", r'"conv_id":(\d+)', 1).cast("bigint").alias("conv_id"),
        "malformed")


@query(
    "read_corpus",
    "select source, sum(length(text) + 1)::bigint as chars from documents group by 1",
)
def read_corpus(spark, sf):
    """Documents as files in a folder per source, read back whole."""
    path = _folder(spark)
    read(spark, sf, "documents").select(F.col("text").alias("value"), "source").write.partitionBy(
        "source").text(path)
    files = RD.read_corpus(spark, path)
    source = F.regexp_extract("doc_id", "source=([^/]+)/", 1)
    return files.groupBy(source.alias("source")).agg(F.sum(F.length("text")).alias("chars"))


@query("ledger_round_trip", evidence.ORACLES["append_chain"])
def ledger_round_trip(spark, sf):
    """The ledger appended to files per chain, and read back."""
    path = _folder(spark)
    SK.append_ledger(L.append_chain(evidence._records(spark, sf)), path)
    return RD.read_ledger(spark, path).select(
        "id", "tenant_id", "chain", "event_type", "record_hash")


@query(
    "report_round_trip",
    """select 'lang' as section, lang as name, count(*) as n from documents group by 2
       union all select 'source', source, count(*) from documents group by 2""",
)
def report_round_trip(spark, sf):
    """Report sections written as one folder each, and read back."""
    path = _folder(spark)
    docs = read(spark, sf, "documents")
    parts = ("lang", "source")
    SK.write_report({
        p: docs.groupBy(F.col(p).alias("name")).agg(F.count("*").alias("n")) for p in parts}, path)
    out = [
        spark.read.schema("name string, n bigint").json(f"{path}/{p}")
        .select(F.lit(p).alias("section"), "name", "n") for p in parts
    ]
    return out[0].union(out[1])


@query(
    "findings_round_trip",
    """select case when event_id % 2 = 0 then 'pii' else 'secret' end as family, count(*) as n
       from events group by 1""",
)
def findings_round_trip(spark, sf):
    """Findings written by family; a reader of one family prunes the rest."""
    path = _folder(spark)
    k = F.col("event_id")
    SK.write_findings(read(spark, sf, "events").select(
        k.alias("request_id"), F.when(k % 2 == 0, "pii").otherwise("secret").alias("family")), path)
    return spark.read.parquet(path).groupBy("family").agg(F.count("*").alias("n"))


@query(
    "read_events",
    """select cast(user_id as varchar) as session_id, event_type as tool, count(*) as n,
         max(event_id) as last_seq from events group by 1, 2""",
)
def read_events(spark, sf):
    """Session events written in the event schema and read back as a batch."""
    path = _folder(spark)
    read(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("session_id"), F.col("ts").cast("timestamp"),
        F.col("event_id").alias("seq"), F.col("event_type").alias("tool"),
        F.to_variant_object(F.create_map(F.lit("k"), F.col("event_type"))).alias("args"),
        F.col("event_type").alias("text"),
    ).write.parquet(path)
    return RD.read_events(spark, path, streaming=False).groupBy("session_id", "tool").agg(
        F.count("*").alias("n"), F.max("seq").alias("last_seq"))


@query(
    "flatten_table_function",
    f"select conv_id, span_path, md5(text) as digest, parent_path from {evidence._SPANS} s",
)
def flatten_table_function(spark, sf):
    """Payload spans through the SQL table function."""
    P.register_flatten(spark)
    evidence._payloads(spark, sf).createOrReplaceTempView("exchange_payloads")
    return spark.sql(
        f"""select p.conv_id, s.span_path, md5(s.text) as digest, s.parent_path
           from exchange_payloads p, lateral flatten_json(p.body) s
           where s.span_path not in ({evidence._HOLDERS})""")


@query(
    "adjudicate",
    f"""select case when length > 12 then 'sensitive' else 'unknown' end as proposal, count(*) as n
        from (select cast(length(token) as int) as length from {evaluation._FEATURES} f
          union all select cast(length(text) as int) from {evaluation._DOUBTFUL} d) t group by 1""",
)
def adjudicate(spark, sf):
    """A user's proposal per feature row: long identifiers are sensitive."""
    @F.pandas_udf("string")
    def proposer(rows: pd.DataFrame) -> pd.Series:
        return pd.Series(["sensitive" if n > 12 else "unknown" for n in rows["length"]])

    return E.adjudicate(evaluation.escalation_features(spark, sf).select("length"), proposer).groupBy(
        "proposal").agg(F.count("*").alias("n"))
