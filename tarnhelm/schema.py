"""Class vocabulary and the schemas shared by all operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The closed class vocabulary, by family.
FAMILIES = {
    "CREDENTIAL": (
        "ANTHROPIC_KEY", "OPENAI_KEY", "GITHUB_TOKEN", "AWS_ACCESS_KEY", "AWS_SECRET_KEY",
        "GOOGLE_API_KEY", "SLACK_TOKEN", "STRIPE_KEY", "RAZORPAY_KEY", "JWT", "PRIVATE_KEY",
        "SSH_PRIVATE_KEY", "DB_URI", "GENERIC_SECRET",
    ),
    "INDIA_ID": ("PAN", "AADHAAR", "GSTIN", "IFSC", "UPI_VPA", "VOTER_ID", "DL_NUMBER"),
    "FINANCIAL": ("CREDIT_CARD", "IBAN", "BANK_ACCOUNT"),
    "CONTACT": ("EMAIL", "PHONE", "ADDRESS", "PINCODE"),
    "PERSON_DATA": ("PERSON", "ORG", "GPE", "DATE_OF_BIRTH", "AGE_BAND", "GENDER"),
    "SENSITIVE_CATEGORY": (
        "SECURITY_FINDING", "INCIDENT_REPORT", "INFRA_SECRET", "SOURCE_CODE_RESTRICTED",
        "CUSTOMER_DATA", "HR_RECORD", "LEGAL_PRIVILEGED", "FINANCIAL_RECORD",
    ),
    "LOW_CONFIDENCE": ("HIGH_ENTROPY_STRING",),
    "COMPOSITE": ("QUASI_IDENTIFIER_SET",),
    "RESERVED": ("UNKNOWN",),
}
NEVER_ENFORCE_ALONE = ("HIGH_ENTROPY_STRING",)
NOT_IN_SKELETON = ("PERSON", "ORG", "GPE", "ADDRESS", "QUASI_IDENTIFIER_SET")

FAMILY_OF = {c: f for f, classes in FAMILIES.items() for c in classes}

#: What a detector returns for one text.
HIT_TYPE = (
    "struct<start:int,end:int,entity_class:string,confidence:double,"
    "detector:string,stage:string,tier:int,advisory_only:boolean>"
)
HITS_TYPE = f"array<{HIT_TYPE}>"

#: Row schema of a findings table after its key columns. There is no value column.
FINDING_COLUMNS = (
    "start", "end", "entity_class", "family", "confidence", "detector", "stage", "tier",
    "advisory_only",
)

#: One policy rule as a nested value.
CLEARANCE_TYPE = "struct<actor_role:array<string>,actor_group:array<string>,destination:array<string>>"
RULE_TYPE = (
    "struct<direction:string,class:array<string>,destination:array<string>,action:string,"
    "format_preserving:boolean,escalate:boolean,reason:string,"
    f"unless:array<{CLEARANCE_TYPE}>,except:array<{CLEARANCE_TYPE}>>"
)


def family_of(entity_class: Column) -> Column:
    """Family of a class; an unknown class is an error, never a silent null."""
    out = None
    for family, classes in FAMILIES.items():
        cond = entity_class.isin(*classes)
        out = F.when(cond, family) if out is None else out.when(cond, family)
    return out.otherwise(
        F.raise_error(F.concat(entity_class, F.lit(" is not in the class vocabulary")))
    )


def never_tokenize(entity_class: Column) -> Column:
    return entity_class.isin(*FAMILIES["CREDENTIAL"])


def never_enforce_alone(entity_class: Column) -> Column:
    return entity_class.isin(*NEVER_ENFORCE_ALONE)


def entity_classes(spark: SparkSession) -> DataFrame:
    """The vocabulary as a dimension table (45 rows)."""
    rows = [
        (c, f, f == "CREDENTIAL", c in NEVER_ENFORCE_ALONE, c in NOT_IN_SKELETON)
        for c, f in FAMILY_OF.items()
    ]
    return spark.createDataFrame(
        rows,
        "class string, family string, never_tokenize boolean, "
        "never_enforce_alone boolean, not_in_skeleton boolean",
    )


def hit(
    start: Column,
    end: Column,
    entity_class: str | Column,
    confidence: float | Column,
    detector: str | Column,
    stage: str = "S0",
    tier: int = 1,
    advisory: bool | Column = False,
) -> Column:
    def col(x):
        return x if isinstance(x, Column) else F.lit(x)

    return F.struct(
        start.cast("int").alias("start"),
        end.cast("int").alias("end"),
        col(entity_class).cast("string").alias("entity_class"),
        col(confidence).cast("double").alias("confidence"),
        col(detector).cast("string").alias("detector"),
        F.lit(stage).alias("stage"),
        F.lit(tier).cast("int").alias("tier"),
        col(advisory).cast("boolean").alias("advisory_only"),
    )


def no_hits() -> Column:
    return F.array().cast(HITS_TYPE)
