"""Who may see which document, and whether a prompt may be sent."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnhelm.functions.lattice import action_of, rank
from tarnhelm.operators.policy import compile_policies, decide_compiled
from tarnhelm.schema import FAMILIES, FAMILY_OF
from tarnhelm.sources.stored import keep


PROFILE = ("tenant_id", "role", "groups", "registered")


def with_profile(actors: DataFrame) -> DataFrame:
    """Adds ``profile``: actors that policy cannot tell apart share it."""
    named = actors.withColumn("groups", F.array_sort("groups"))
    return named.withColumn("profile", F.sha2(F.to_json(F.struct(*PROFILE)), 256))


def profile_matrix(actors: DataFrame, resolved: DataFrame, leg: str = "inbound") -> DataFrame:
    """Decision per (profile, class). A decision depends on nothing else about an actor
    or a document, so this stays small however many of either there are."""
    grid = (
        with_profile(actors).select("profile", *PROFILE).dropDuplicates(["profile"])
        .withColumn("entity_class", F.explode(F.array(*[F.lit(c) for c in FAMILY_OF])))
        .withColumns({"leg": F.lit(leg), "destination": F.lit(None).cast("string")})
    )
    # The rules that speak are worked out first: no row of the grid carries a policy.
    return keep(decide_compiled(grid, compile_policies(resolved)).select(
        "profile", "entity_class", "action", "rule_index", "rule_scope", "policy_default"
    ))


def clearance_matrix(actors: DataFrame, resolved: DataFrame, leg: str = "inbound") -> DataFrame:
    """Decision per (actor, class): 45 rows per actor."""
    matrix = profile_matrix(actors, resolved, leg)
    return with_profile(actors).select("actor_id", "profile").join(matrix, "profile").drop(
        "profile"
    )


def judge_documents(
    requests: DataFrame, doc_classes: DataFrame, actors: DataFrame, resolved: DataFrame,
    doc: str = "doc_id",
) -> DataFrame:
    """Verdict per (actor, document) that was asked for.

    ``requests`` lists the reads, ``doc_classes`` one row per (document, class). The reads
    meet actors, classes and the profile matrix in equi-joins and are aggregated per
    read; a document without classes is allowed.
    """
    c = F.col
    r = rank(c("action"))
    matrix = profile_matrix(actors, resolved)
    who = with_profile(actors).select("actor_id", "profile")
    reads = requests.select("actor_id", doc)
    # A left join keeps reads without any class, so one aggregation gives every verdict.
    judged = (
        reads.join(doc_classes.select(doc, "entity_class"), doc, "left")
        .join(who, "actor_id", "left")
        .join(matrix, ["profile", "entity_class"], "left")
        .groupBy("actor_id", doc)
        .agg(
            F.max(r).alias("_top"),
            F.min_by(
                F.struct("rule_index", "rule_scope"),
                F.when(r.isNotNull(), F.struct(-r, c("entity_class"))),
            ).alias("_first"),
            F.sort_array(
                F.collect_set(F.when(r.isNotNull(), c("entity_class")))
            ).alias("classes"),
        )
    )
    return judged.select(
        "actor_id", doc,
        F.coalesce(action_of(c("_top")), F.lit("allow")).alias("action"),
        c("_first.rule_index").alias("rule_index"),
        F.coalesce("_first.rule_scope", F.lit("default")).alias("rule_scope"),
        "classes",
    )


def retrieval_guard(judged: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Adds ``visible`` and, for a withheld document, a line that explains it."""
    applied = F.when(F.col("action") == "tokenize", "mask").otherwise(F.col("action"))
    out = judged.withColumn("action", applied)
    visible = F.col("action").isin("allow", "warn")
    line = F.concat(
        F.col(doc).cast("string"), F.lit(": "),
        F.when(F.size("classes") > 0, F.array_join("classes", ", ")).otherwise("restricted"),
        F.lit(" ("), F.col("action"), F.lit(", rule "),
        F.coalesce(F.col("rule_index").cast("string"), F.lit("none")),
        F.lit(" of the "), F.col("rule_scope"), F.lit(" policy)"),
    )
    return out.withColumns({"visible": visible, "explanation": F.when(~visible, line)})


def explain_withheld(guarded: DataFrame) -> DataFrame:
    """Number of withheld documents and their classes per actor."""
    hidden = guarded.filter(~F.col("visible"))
    return hidden.groupBy("actor_id").agg(F.count("*").alias("withheld")).withColumn(
        "summary",
        F.concat(F.col("withheld"), F.lit(" document(s) were withheld by policy, not omitted")),
    )


def read_guard(judged: DataFrame, doc: str = "doc_id") -> DataFrame:
    """A credential withholds the document from everyone; then clearance decides.

    A file cannot be masked in place, so a mask is applied as a block.
    """
    guarded = retrieval_guard(judged, doc)
    secret = F.arrays_overlap(
        "classes", F.array(*[F.lit(c) for c in FAMILIES["CREDENTIAL"]])
    )
    masked = F.col("action") == "mask"
    return guarded.withColumns(
        {
            "degraded_reason": F.when(~secret & masked, "mask_needs_proxy"),
            "rule_scope": F.when(secret, "credential").otherwise(F.col("rule_scope")),
            "rule_index": F.when(~secret, F.col("rule_index")),
            "action": F.when(secret | masked, "block").otherwise(F.col("action")),
            "visible": ~secret & F.col("visible"),
        }
    ).drop("explanation")


def admit(
    prompts: DataFrame, verdict_rows: DataFrame, classes: DataFrame,
    role_decisions: DataFrame | None, keys: Sequence[str],
) -> DataFrame:
    """Prompt admission. A credential always denies; a role decision replaces the
    checker's verdict where there is one; otherwise red denies.

    ``classes``: blocking classes per prompt; ``role_decisions``: prompt keys and
    ``role_allows``.
    """
    creds = classes.groupBy(*keys).agg(
        F.bool_or(F.col("entity_class").isin(*FAMILIES["CREDENTIAL"])).alias("_cred")
    )
    df = prompts.select(*keys).join(
        verdict_rows.select(*keys, "verdict"), list(keys), "left"
    ).join(creds, list(keys), "left")
    if role_decisions is not None:
        df = df.join(role_decisions.select(*keys, "role_allows"), list(keys), "left")
    else:
        df = df.withColumn("role_allows", F.lit(None).cast("boolean"))
    denied = F.coalesce(F.col("verdict") == "red", F.lit(False))
    reason = (
        F.when(denied & F.coalesce("_cred", F.lit(False)), "credential")
        .when(F.col("role_allows") == F.lit(False), "policy")
        .when(denied & F.col("role_allows").isNull(), "checker")
    )
    return df.select(*keys, reason.isNull().alias("admitted"), reason.alias("denied_by"))


def actors_frame(spark: SparkSession, rows: Sequence[tuple]) -> DataFrame:
    """Actors from configuration rows."""
    return spark.createDataFrame(
        list(rows),
        "actor_id string, tenant_id string, role string, groups array<string>, "
        "registered boolean",
    )
