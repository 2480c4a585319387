"""Chat formatting from an event log.

A log row is an event of a message: ``open``, ``delta`` (text appended), ``edit`` (the text so
far replaced) or ``regenerate`` (the text so far discarded). Events are grouped by message, put
into sequence and folded into the final text, so a very long conversation is spread over many
tasks. Messages are rendered one by one; only reading back a whole conversation goes through it
in order, as a stream with constant memory.

A rendered turn is ``<s>[role]``, a line feed, the text, ``</s>`` and a line feed. Inside role and
text a backslash precedes every backslash, ``<``, ``[`` and ``]``, so no control string of this or a
similar template can occur there and the change can be undone.

Null roles and texts count as empty; events with a null payload add nothing. Rows of equal conv_id
and turn follow in the order of role and text; null turns come first; null conv_ids are one
conversation. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnhelm.llm.common import table

TRAINED = "assistant"
PIECE = 200
HEAD = re.compile(r"<s>\[((?:\\.|[^\\\]])*)\]\n", re.S)
UNESCAPE = re.compile(r"\\(.)", re.S)
MESSAGE = ["conv_id", "turn", "part"]


def event_log(turns: DataFrame) -> DataFrame:
    """The log of a stored conversation table: each text arrives in pieces; an assistant's text
    follows a discarded draft, and another's first version is edited into the final one."""
    tied = W.partitionBy("conv_id", "turn").orderBy("role", "text")
    rows = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("part", F.row_number().over(tied))
    text = F.col("text")
    event = lambda kind, payload: F.struct(
        F.lit(kind).alias("kind"), payload.cast("string").alias("payload"))
    pieces = F.transform(
        F.sequence(F.lit(0), F.floor(F.length(text) / PIECE).cast("int")),
        lambda i: event("delta", text.substr(i * PIECE + 1, F.lit(PIECE))))
    draft = F.array(event("open", F.col("role")), event("delta", F.reverse(text.substr(1, PIECE))))
    own = F.when(
        F.col("role") == TRAINED,
        F.concat(draft, F.array(event("regenerate", F.lit(None))), pieces),
    ).otherwise(F.concat(draft, F.array(event("edit", text.substr(1, PIECE))), F.slice(
        pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0)))))
    return rows.select(*MESSAGE, F.posexplode(own).alias("step", "e")).select(
        *MESSAGE, "step", "e.kind", "e.payload")


def fold(log: DataFrame) -> DataFrame:
    """Events (conv_id, turn, part, step, kind, payload) -> messages with role and final text."""
    reset = F.col("kind").isin("edit", "regenerate")
    grouped = log.groupBy(*MESSAGE).agg(
        F.max(F.when(F.col("kind") == "open", F.col("payload"))).alias("role"),
        F.coalesce(F.max(F.when(reset, F.col("step"))), F.lit(-1)).alias("from"),
        F.sort_array(F.collect_list(F.struct("step", "kind", "payload"))).alias("events"))
    live = F.filter("events", lambda e: (e["step"] >= F.col("from")) & e["kind"].isin(
        "delta", "edit"))
    text = F.array_join(F.transform(live, lambda e: F.coalesce(e["payload"], F.lit(""))), "")
    return grouped.select(*MESSAGE, F.coalesce("role", F.lit("")).alias("role"), text.alias("text"))


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\<\[\]])", r"\\$1")


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, part, formatted, loss_from, loss_to): code points of each turn's loss."""
    head = F.concat(F.lit("<s>["), escape(F.col("role")), F.lit("]\n"))
    body = escape(F.col("text"))
    out = messages.select(
        *MESSAGE, "role", head.alias("_head"), body.alias("_body"))
    start = F.length("_head").cast("bigint")
    trained = F.col("role") == TRAINED
    return out.select(
        *MESSAGE, F.concat("_head", "_body", F.lit("</s>\n")).alias("formatted"),
        F.when(trained, start).alias("loss_from"),
        F.when(trained, start + F.length("_body")).alias("loss_to"))


def read_back(rendered: DataFrame) -> DataFrame:
    """Per conversation, from the rendered text alone: digests of its turns and of its loss."""
    ordered = rendered.repartition("conv_id").sortWithinPartitions(
        F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "part")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, done = None, None, []

        def close() -> None:
            if state:
                done.append((conv, state[0], state[1].hexdigest(), state[2],
                             state[3].hexdigest(), state[4]))

        def out() -> pa.RecordBatch:
            rows = [pa.array([r[i] for r in done], k) for i, k in enumerate(
                (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()))]
            done.clear()
            return pa.RecordBatch.from_arrays(rows, [
                "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256",
                "formatted_chars"])

        for batch in batches:
            for c, text, a, z in zip(
                *[batch.column(i).to_pylist() for i in range(4)], strict=True
            ):
                if state is None or c != conv:
                    close()
                    conv, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                head = HEAD.match(text)
                role, body = head[1], text[head.end():].removesuffix("</s>\n")
                plain = f"{UNESCAPE.sub(r'\1', role)}\n{UNESCAPE.sub(r'\1', body)}\n"
                state[0] += 1
                state[1].update(plain.encode())
                if a is not None:
                    loss = UNESCAPE.sub(r"\1", text[a:z])
                    state[2] += len(loss)
                    state[3].update(loss.encode())
                state[4] += len(text)
            if done:
                yield out()
        close()
        if done:
            yield out()

    return ordered.select("conv_id", "formatted", "loss_from", "loss_to").mapInArrow(
        digest, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, "
                "loss_sha256 string, formatted_chars bigint")


def format_chats(turns: DataFrame) -> DataFrame:
    """Stored conversations (conv_id, turn, role, text) -> rendered turns, through their log."""
    return render(fold(event_log(turns)))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise(TRAINED).alias("role"), F.lit(said).alias("text"))
    return read_back(format_chats(stored.union(extra)))


ORACLE = r"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]')
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text))
    as turns_sha256,
  sum(case when role = 'assistant' then length(text) else 0 end)::bigint as loss_chars,
  sha256(string_agg(case when role = 'assistant' then text else '' end, ''
    order by turn nulls first, role, text)) as loss_sha256,
  sum(11 + length(regexp_replace(role || text, '([\\<\[\]])', '\\\1', 'g')))::bigint
    as formatted_chars
from c group by conv_id
"""
