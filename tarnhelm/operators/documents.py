"""Record-type classification of whole documents."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnhelm.functions.text import bind
from tarnhelm.operators.detect import COMPOSITE, CREDENTIALS, SHAPE, detect
from tarnhelm.schema import family_of


@dataclass(frozen=True)
class RecordType:
    entity_class: str
    strong: tuple[str, ...]
    weak: tuple[str, ...]
    quorum: int = 2
    confidence: float = 0.6


# Strong and weak signals of each record type.
RECORD_TYPES = (
    RecordType(
        "HR_RECORD",
        ("employee[_ ]?id", "payslip", "date[_ ]of[_ ]joining", "pf[_ ]number",
         "reporting manager"),
        ("salary", "ctc", "appraisal", "designation"),
    ),
    RecordType(
        "FINANCIAL_RECORD",
        ("invoice[_ ]?(no|number|id)", "gst[_ ]?amount", "account[_ ]balance",
         "tax[_ ]invoice"),
        ("ledger", "debit", "credit", "fiscal year"),
    ),
    RecordType(
        "CUSTOMER_DATA",
        ("customer[_ ]?(id|name|record)", "case[_ ]?(id|file)", "ticket[_ ]?id",
         "citizen[_ ]?id"),
        ("beneficiary", "applicant", "grievance"),
    ),
    RecordType(
        "INFRA_SECRET",
        ("api[_ ]?key", "secret[_ ]?key", "private[_ ]key", "connection[_ ]string",
         r"\.env", "vault path"),
        ("password", "credential"),
    ),
    RecordType(
        "SECURITY_FINDING",
        (r"cve-\d{4}", "cvss", "penetration test"),
        ("vulnerability", "severity", "exploit", "remediation"),
    ),
    RecordType(
        "LEGAL_PRIVILEGED",
        ("without prejudice", "legal opinion", "attorney"),
        ("privileged", "counsel", "litigation"),
    ),
    RecordType(
        "INCIDENT_REPORT",
        ("incident[_ ]?(id|report)", "time[_ ]to[_ ]detect", "blast radius"),
        ("root cause", "postmortem", "impacted users"),
    ),
)


def _present(lowered: Column, signal: str) -> Column:
    """A literal signal is a substring test; only real patterns pay for a regex."""
    if signal.isascii() and all(c.isalnum() or c == " " for c in signal):
        return F.contains(lowered, F.lit(signal))
    return lowered.rlike(signal)


def document_hits(
    text: Column, types: Sequence[RecordType] = RECORD_TYPES, limit: int | None = None
) -> Column:
    """Record types of a document: array of (class, confidence, matched signals)."""
    sample = text if limit is None else F.substring(text, 1, limit)

    def names(low: Column, signals: Sequence[str]) -> Column:
        return F.filter(
            F.array(*[F.when(_present(low, s), F.lit(s)) for s in signals]),
            lambda s: s.isNotNull(),
        )

    def judge(t: RecordType, strong: Column, weak: Column) -> Column:
        total = F.size(strong) + F.size(weak)
        bonus = F.least(F.lit(0.2), F.lit(0.05) * (total - t.quorum))
        return F.when(
            total >= t.quorum,
            F.struct(
                F.lit(t.entity_class).alias("entity_class"),
                F.round(F.lit(t.confidence) + bonus, 2).alias("confidence"),
                F.concat(strong, weak).alias("matched"),
            ),
        )

    def one_type(low: Column, t: RecordType) -> Column:
        # A record type needs a strong signal, so only then are the weak ones tested.
        def with_strong(strong):
            return F.when(
                F.size(strong) > 0, bind(names(low, t.weak), lambda weak: judge(t, strong, weak))
            )

        return bind(names(low, t.strong), with_strong)

    def all_types(low):
        return F.filter(F.array(*[one_type(low, t) for t in types]), lambda h: h.isNotNull())

    return bind(F.lower(sample), all_types)


def classify_documents(
    docs: DataFrame,
    text: str = "text",
    types: Sequence[RecordType] = RECORD_TYPES,
    limit: int | None = None,
) -> DataFrame:
    """One row per (document, record type). ``limit`` reads only a leading sample."""
    keep = [c for c in docs.columns if c != text]
    strong = "|".join(s for t in types for s in t.strong)
    return (
        docs.filter(F.lower(F.col(text)).rlike(strong))
        .select(*keep, F.explode_outer(document_hits(F.col(text), types, limit)).alias("_h"))
        .filter("_h is not null")
        .select(*keep, "_h.entity_class", "_h.confidence", "_h.matched")
    )


def classify_all(
    docs: DataFrame, keys: Sequence[str], text: str = "text", enforce_at: float = 0.75
) -> DataFrame:
    """Record types plus the classes of confirmed values (0.9 unless already named).

    Both sides are small next to the text, so the result is one aggregation keyed by
    document and class; the record type wins where both exist.
    """
    by_record = classify_documents(docs, text).select(
        *keys, "entity_class", "confidence", F.lit(True).alias("by_record")
    )
    values = detect(docs, (CREDENTIALS, SHAPE, COMPOSITE), text, keys=list(keys))
    by_value = values.filter(~F.col("advisory_only") & (F.col("confidence") >= enforce_at)).select(
        *keys, "entity_class", F.lit(0.9).alias("confidence"), F.lit(False).alias("by_record")
    )
    return (
        by_record.unionByName(by_value)
        .groupBy(*keys, "entity_class")
        .agg(F.max_by("confidence", F.col("by_record").cast("int")).alias("confidence"))
        .withColumn("family", family_of(F.col("entity_class")))
    )
