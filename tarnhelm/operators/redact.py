"""Redaction: plan edits, apply them to spans, verify the result."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnhelm.functions.crypto import LONGEST_TOKEN, SHAPE_PRESERVING, derive_token
from tarnhelm.functions.text import mask_text
from tarnhelm.operators.verdict import REDACTABLE_ORIGINS
from tarnhelm.schema import never_tokenize

BLOCK_NOTICE = "[blocked by policy]"

EDIT_TYPE = "array<struct<start:int,end:int,replacement:string,confidence:double>>"


def _grouped(findings: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Findings of each span as one array; a span is one text, so the array is bounded
    by what fits into that text."""
    return findings.groupBy(*keys).agg(
        F.collect_list(
            F.struct("start", "end", "entity_class", "confidence", "advisory_only")
        ).alias("_f")
    )


def plan_edits(
    spans: DataFrame, findings: DataFrame, actions: DataFrame, span_keys: Sequence[str],
    request_keys: Sequence[str], key: bytes, scope: str, text: str = "text",
    origin: str = "origin",
) -> DataFrame:
    """Spans with their edits. ``actions`` holds the request's action.

    Masking writes the class name, tokenising a derived token. A class that must never be
    tokenised is masked instead of being tokenised. Nothing is planned for allow, warn
    and block, for advisory findings or for read-only origins, which are counted.
    """
    # The actions are brought to the keys of the spans, so that a text is shuffled once.
    acts = spans.select(*span_keys).join(
        actions.select(*request_keys, F.col("action").alias("_action")), list(request_keys)
    ).groupBy(*span_keys).agg(F.max("_action").alias("_action"))
    joined = spans.join(_grouped(findings, span_keys), list(span_keys), "left").join(
        acts, list(span_keys), "left"
    )
    found = F.coalesce("_f", F.array().cast(
        "array<struct<start:int,end:int,entity_class:string,confidence:double,"
        "advisory_only:boolean>>"
    ))
    writable = F.col(origin).isin(*REDACTABLE_ORIGINS)

    def edit(f):
        original = F.substring(F.col(text), f["start"] + 1, f["end"] - f["start"])
        label = F.concat(F.lit("⟨"), f["entity_class"], F.lit("⟩"))
        token = derive_token(
            key, F.col(scope), f["entity_class"], original, never_tokenize(f["entity_class"])
        )
        return F.struct(
            f["start"].alias("start"), f["end"].alias("end"),
            F.when(F.col("_action") == "mask", label).otherwise(F.coalesce(token, label))
            .alias("replacement"),
            f["confidence"].alias("confidence"),
        )

    active = writable & F.col("_action").isin("mask", "tokenize")
    chosen = F.when(active, F.filter(found, lambda f: ~f["advisory_only"])).otherwise(
        F.filter(found, lambda f: F.lit(False))
    )
    return joined.select(
        *spans.columns,
        F.coalesce("_action", F.lit("allow")).alias("action"),
        F.transform(chosen, edit).cast(EDIT_TYPE).alias("edits"),
        F.when(writable, 0).otherwise(F.size(found)).alias("read_only_findings"),
        F.when(
            F.col("_action") == "tokenize",
            F.sort_array(
                F.array_distinct(
                    F.transform(
                        F.filter(chosen, lambda f: f["entity_class"].isin(*SHAPE_PRESERVING)),
                        lambda f: f["entity_class"],
                    )
                )
            ),
        ).alias("degraded_formats"),
    )


def _sorted(edits: Column) -> Column:
    """Edits by start, end and replacement, so that no order is left to chance."""
    return F.array_sort(
        edits,
        lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"])
        .when(a["end"] != b["end"], a["end"] - b["end"])
        .when(a["replacement"] < b["replacement"], -1)
        .when(a["replacement"] > b["replacement"], 1).otherwise(0).cast("int"),
    )


def has_overlap(edits: Column) -> Column:
    """True when two edits of a span share a character."""
    s = _sorted(edits)
    return F.coalesce(
        F.exists(
            F.transform(s, lambda e, i: F.when(i > 0, F.get(s, i - 1)["end"] > e["start"])),
            lambda x: x,
        ),
        F.lit(False),
    )


def merge_overlaps(edits: Column) -> Column:
    """Overlapping edits become one that covers them all, with the most confident
    finding's replacement; of equally confident ones the first by start, end and replacement."""

    def step(acc, e):
        last = F.element_at(acc, -1)
        both = F.struct(
            last["start"].alias("start"), F.greatest(last["end"], e["end"]).alias("end"),
            F.when(e["confidence"] > last["confidence"], e["replacement"])
            .otherwise(last["replacement"]).alias("replacement"),
            F.greatest(last["confidence"], e["confidence"]).alias("confidence"),
        )
        return F.when(
            (F.size(acc) > 0) & (e["start"] < last["end"]),
            F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(both)),
        ).otherwise(F.concat(acc, F.array(e))).cast(EDIT_TYPE)

    def guarded(acc, e):
        # element_at on an empty array is an error, so the first edit is taken as it is.
        return F.when(F.size(acc) == 0, F.array(e).cast(EDIT_TYPE)).otherwise(step(acc, e))

    return F.aggregate(_sorted(edits), F.array().cast(EDIT_TYPE), guarded)


def edited_text(text: Column, edits: Column) -> Column:
    """Text with its edits applied, built left to right from the untouched gaps."""
    start = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))

    def step(acc, e):
        gap = F.substring(text, acc["pos"] + 1, e["start"] - acc["pos"])
        return F.struct(
            e["end"].alias("pos"), F.concat(acc["out"], gap, e["replacement"]).alias("out")
        )

    return F.aggregate(
        _sorted(edits), start, step,
        lambda acc: F.concat(
            acc["out"], F.substring(text, acc["pos"] + 1, F.greatest(F.length(text), F.lit(1)))
        ),
    )


def apply_edits(planned: DataFrame, text: str = "text", overlaps: str = "status") -> DataFrame:
    """Adds ``redacted`` and ``status`` (clean, redacted, overlap).

    With ``overlaps="merge"`` overlapping edits are merged; otherwise such a span is not
    rewritten and its status says so.
    """
    edits = F.col("edits")
    if overlaps == "merge":
        planned = planned.withColumn("edits", merge_overlaps(edits))
        clash = F.lit(False)
    else:
        clash = has_overlap(edits)
    planned = planned.withColumn("_clash", clash)
    return planned.withColumns(
        {
            "redacted": F.when(F.col("_clash"), F.lit(None).cast("string")).otherwise(
                edited_text(F.col(text), edits)
            ),
            "status": F.when(F.col("_clash"), "overlap").when(F.size(edits) > 0, "redacted")
            .otherwise("clean"),
        }
    ).drop("_clash")


def verify_redaction(applied: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``verified``: every replacement is there and no original is left."""
    ok = F.forall(
        F.col("edits"),
        lambda e: F.contains(F.col("redacted"), e["replacement"])
        & ~F.contains(
            F.col("redacted"), F.substring(F.col(text), e["start"] + 1, e["end"] - e["start"])
        ),
    )
    return applied.withColumn(
        "verified", F.when(F.col("status") == "overlap", False).otherwise(ok)
    )


def find_overlaps(findings: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Findings that start before an earlier finding of the same span ends."""
    w = W.partitionBy(*keys).orderBy("start", "end", "entity_class")
    before = w.rowsBetween(W.unboundedPreceding, -1)
    return (
        findings.withColumn("previous_end", F.max("end").over(before))
        .filter(F.col("previous_end") > F.col("start"))
    )


def redact_nodes(decisions: DataFrame, text: str = "text") -> DataFrame:
    """Whole-value redaction: a notice for block, block characters for mask."""
    action = F.col("action")
    return decisions.withColumn(
        "redacted",
        F.when(action == "block", BLOCK_NOTICE)
        .when(action.isin("mask", "tokenize"), mask_text(F.col(text)))
        .otherwise(F.col(text)),
    )


def lift_nested(edits: DataFrame, spans: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Edits of nested spans translated to the span that holds the nested text."""
    s = spans.select(
        *keys, "span_path", "parent_path", "parent_char_offset"
    ).filter("parent_path is not null")
    return edits.join(s, [*keys, "span_path"], "left").select(
        *keys,
        F.coalesce("parent_path", "span_path").alias("span_path"),
        (F.col("start") + F.coalesce("parent_char_offset", F.lit(0))).alias("start"),
        (F.col("end") + F.coalesce("parent_char_offset", F.lit(0))).alias("end"),
        *[c for c in edits.columns if c not in (*keys, "span_path", "start", "end")],
    )


def widen_collisions(
    tokens: DataFrame, key: bytes, scope: str, entity_class: str, value: str,
    max_width: int = 12,
) -> DataFrame:
    """Tokens that two values share grow until they differ.

    Values that still share a prefix of ``max_width`` characters get all of LONGEST_TOKEN;
    ``status`` is ``widened`` for them, ``unique`` for others. Every distinct value gets its mac once. For each width the number of values behind a
    prefix is an aggregation keyed by that prefix, never a comparison of pairs.
    """
    from tarnhelm.functions.crypto import base32_prefix, hmac_hex, normalise

    norm = normalise(F.col(entity_class), F.col(value))
    keyed = tokens.withColumn("_norm", norm).withColumn(
        "_mac", hmac_hex(key, F.concat_ws("|", F.col(scope), F.col(entity_class), F.col("_norm")))
    )
    distinct = keyed.select(scope, entity_class, "_mac").distinct()
    widths = distinct.select(
        scope, entity_class, "_mac", F.explode(F.sequence(F.lit(3), F.lit(max_width))).alias("w")
    ).withColumn("_prefix", base32_prefix(F.col("_mac"), F.col("w")))
    alone = (
        widths.groupBy(scope, entity_class, "w", "_prefix")
        .agg(F.count("*").alias("_n"), F.min("_mac").alias("_mac"))
        .filter("_n = 1")
        .groupBy(scope, entity_class, "_mac")
        .agg(F.min("w").alias("width"))
    )
    out = keyed.join(alone, [scope, entity_class, "_mac"], "left").withColumn(
        "status", F.when(F.col("width").isNull(), "widened").otherwise("unique")
    ).withColumn("width", F.coalesce("width", F.lit(LONGEST_TOKEN)))
    return out.withColumn(
        "token",
        derive_token(
            key, F.col(scope), F.col(entity_class), F.col(value),
            never_tokenize(F.col(entity_class)), F.col("width"),
        ),
    ).drop("_norm", "_mac")
