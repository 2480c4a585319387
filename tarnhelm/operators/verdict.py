"""From findings to a verdict per request, and the filters in between."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnhelm.functions.lattice import action_of
from tarnhelm.schema import FAMILIES

# Bands of the verdict, the side-car threshold and origin groups.
AMBER_LOW = 0.35
AMBER_HIGH = 0.75
ENFORCE_AT = 0.75
REDACTABLE_ORIGINS = ("user", "assistant", "tool_call", "tool_result")
MAX_REQUEST_CHARS = 2_000_000

FAMILY_ACTION = {
    "CREDENTIAL": 4, "INDIA_ID": 2, "FINANCIAL": 2, "CONTACT": 2, "PERSON_DATA": 2,
    "SENSITIVE_CATEGORY": 3, "LOW_CONFIDENCE": 1, "COMPOSITE": 2, "RESERVED": 0,
}
INBOUND_CLEARANCE = {
    "SECURITY_FINDING": ("security", "eng_platform"),
    "INCIDENT_REPORT": ("security", "eng_platform"),
    "INFRA_SECRET": ("security", "eng_platform"),
    "SOURCE_CODE_RESTRICTED": ("eng_core",),
    "CUSTOMER_DATA": ("support", "security"),
    "HR_RECORD": ("hr",),
    "LEGAL_PRIVILEGED": ("legal",),
    "FINANCIAL_RECORD": ("finance",),
}


def enforceable(findings: DataFrame) -> DataFrame:
    return findings.filter(~F.col("advisory_only"))


def withheld(findings: DataFrame) -> DataFrame:
    return findings.filter("advisory_only")


def split_advisory(findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(findings that may enforce, findings that are only reported)."""
    return enforceable(findings), withheld(findings)


def may_enforce(origin: Column, family: Column) -> Column:
    return (
        F.when(origin.isin("metadata", "tool_definition"), False)
        .when(origin == "system", family == "CREDENTIAL")
        .otherwise(True)
    )


def redactable(findings: DataFrame, origin: str = "origin") -> DataFrame:
    """Findings marked with ``read_only`` where their origin must not be rewritten."""
    return findings.withColumn("read_only", ~F.col(origin).isin(*REDACTABLE_ORIGINS))


def min_confidence(findings: DataFrame, floor: float) -> DataFrame:
    return findings.filter(F.col("confidence") >= floor)


def verdicts(
    findings: DataFrame, keys: Sequence[str], requests: DataFrame | None = None,
    lo: float = AMBER_LOW, hi: float = AMBER_HIGH,
) -> DataFrame:
    """Verdict per request. With ``requests`` given, those without findings are green."""
    top = F.max(F.when(~F.col("advisory_only"), F.col("confidence")))
    agg = findings.groupBy(*keys).agg(
        top.alias("top"), F.count("*").alias("findings"),
        F.count_if("advisory_only").alias("advisory"),
    )
    if requests is not None:
        agg = requests.select(*keys).distinct().join(agg, list(keys), "left")
    t = F.col("top")
    verdict = (
        F.when(t.isNull(), "green").when(t >= hi, "red").when(t >= lo, "amber")
        .otherwise("green")
    )
    return agg.select(
        *keys,
        verdict.alias("verdict"),
        F.coalesce(t, F.lit(1.0)).alias("confidence"),
        F.coalesce("findings", F.lit(0)).alias("findings"),
        F.coalesce("advisory", F.lit(0)).alias("advisory"),
        F.when(verdict == "amber", "amber_no_tier3").alias("degraded"),
    )


def flag_oversize(
    spans: DataFrame, keys: Sequence[str], text: str = "text",
    limit: int = MAX_REQUEST_CHARS, parent: str | None = "parent_path",
) -> DataFrame:
    """Characters per request over top-level spans and whether they exceed the limit."""
    if parent is not None and parent in spans.columns:
        spans = spans.filter(F.col(parent).isNull())
    return spans.groupBy(*keys).agg(
        F.sum(F.length(text)).alias("total_chars")
    ).withColumn("oversize", F.col("total_chars") > limit)


def degraded_verdicts(requests: DataFrame, fail: str = "closed") -> DataFrame:
    """Verdict of requests too large to scan: red when failing closed, else green."""
    return requests.filter("oversize").withColumns(
        {
            "verdict": F.lit("red" if fail == "closed" else "green"),
            "confidence": F.lit(0.0),
            "degraded": F.lit("payload_too_large"),
        }
    )


def blocking_findings(
    findings: DataFrame, verdict_rows: DataFrame, keys: Sequence[str],
    at: float = ENFORCE_AT,
) -> DataFrame:
    """Findings that deny a prompt: red verdict, not advisory, confident enough."""
    red = verdict_rows.filter("verdict = 'red'").select(*keys)
    return findings.filter(
        ~F.col("advisory_only") & (F.col("confidence") >= at)
        & may_enforce(F.lit("user"), F.col("family"))
    ).join(red, list(keys), "left_semi")


def credential_floor(docs: DataFrame, findings: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Documents that hold a credential; no role clears those."""
    creds = findings.filter(F.col("entity_class").isin(*FAMILIES["CREDENTIAL"]))
    return docs.join(creds.select(*keys), list(keys), "left_semi")


def family_policy(findings: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Built-in action per request from family defaults.

    Needs columns origin, leg, channel, groups and ord (order of findings). The first
    finding that reaches the strongest action is the one that fired.
    """
    cls, fam = F.col("entity_class"), F.col("family")
    default = F.lit(0)
    for name, rank in FAMILY_ACTION.items():
        default = F.when(fam == name, rank).otherwise(default)
    cleared = F.lit(False)
    for name, groups in INBOUND_CLEARANCE.items():
        cleared = cleared | (
            (cls == name) & F.arrays_overlap("groups", F.array(*[F.lit(g) for g in groups]))
        )
    counts = (
        ~F.col("advisory_only")
        & may_enforce(F.col("origin"), fam)
        & ~((F.col("leg") == "inbound") & cleared)
    )
    rank = F.when(
        (default == 2) & ((fam == "CREDENTIAL") | F.col("channel").isin("cli", "mcp")), 4
    ).otherwise(default)
    ranked = findings.withColumn("_rank", F.when(counts, rank).otherwise(0))
    first = F.min_by(
        "ord", F.struct(-F.col("_rank"), F.col("ord"))
    )
    return ranked.groupBy(*keys).agg(
        F.max("_rank").alias("_top"), first.alias("_ord")
    ).select(
        *keys, action_of(F.col("_top")).alias("action"),
        F.when(F.col("_top") > 0, F.col("_ord")).alias("fired"),
    )
