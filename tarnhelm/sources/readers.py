"""Sources: transcripts, payloads, documents, files, events, policies, rules, ledgers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnhelm.operators.detect import BASELINE_KEY_RULES, KeyRule
from tarnhelm.operators.ledger import LEDGER_SCHEMA, policy_hash
from tarnhelm.operators.spans import BINARY_SUFFIXES
from tarnhelm.schema import FAMILY_OF, RULE_TYPE


#: Input up to which ``spread`` may shuffle; larger files split by their row groups.
SPREAD_BYTES = 256 * 1024 * 1024


#: Parquet bytes per task where rows are short keys and the work on them is not.
KEY_BYTES = 2 * 1024 * 1024


def spread(
    df: DataFrame, waves: int = 4, most_bytes: int = SPREAD_BYTES, task_bytes: int | None = None
) -> DataFrame:
    """Even out a scan of a small input with fewer tasks than the session has cores.

    A file with one row group is one task however many cores there are, and detection is
    bound by CPU. Inputs above ``most_bytes`` are returned as they are, so no large text is
    ever shuffled for this. With ``task_bytes`` the rows are keys that cost little to shuffle:
    inputs of any size then get tasks of about that many bytes.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    cores = df.sparkSession.sparkContext.defaultParallelism
    if task_bytes is not None:
        tasks = max(cores * waves, -(-size // task_bytes))
        return df if df.rdd.getNumPartitions() >= tasks else df.repartition(tasks)
    if size > most_bytes or df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores * waves)


def user_text(message: Column) -> Column:
    """Text of a transcript message: a string, or its text and tool-result blocks."""
    content = F.try_variant_get(message, "$.content", "variant")
    as_text = F.try_variant_get(message, "$.content", "string")
    is_list = F.schema_of_variant(content).startswith("ARRAY")
    blocks = F.try_variant_get(message, "$.content", "array<variant>")

    def block_text(b):
        kind = F.try_variant_get(b, "$.type", "string")
        inner = F.try_variant_get(b, "$.content", "array<variant>")
        joined = F.array_join(
            F.filter(
                F.transform(inner, lambda x: F.try_variant_get(x, "$.text", "string")),
                lambda x: x.isNotNull() & (x != ""),
            ),
            "\n",
        )
        return F.when(kind == "text", F.try_variant_get(b, "$.text", "string")).when(
            kind == "tool_result",
            F.coalesce(joined, F.try_variant_get(b, "$.content", "string")),
        )

    parts = F.filter(
        F.transform(blocks, block_text), lambda x: x.isNotNull() & (x != "")
    )
    return F.when(is_list, F.array_join(parts, "\n")).otherwise(as_text)


def parse_transcripts(lines: DataFrame, value: str = "value") -> DataFrame:
    """User turns of transcript lines; lines that do not parse and short texts drop out."""
    doc = F.try_parse_json(F.col(value))
    keep = [c for c in lines.columns if c != value]
    return (
        lines.withColumn("_doc", doc)
        .filter(F.try_variant_get("_doc", "$.type", "string") == "user")
        .select(*keep, user_text(F.try_variant_get("_doc", "$.message", "variant")).alias("text"))
        .filter(F.length(F.trim("text")) > 3)
    )


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Transcript JSONL below a folder; the parent folder of a file is its project."""
    lines = spark.read.option("recursiveFileLookup", "true").text(path).withColumn(
        "project", F.element_at(F.split(F.input_file_name(), "/"), -2)
    )
    return parse_transcripts(lines)


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """One JSON body per line, kept as text, with whether it parses."""
    return spark.read.text(path).select(
        F.col("value").alias("body"), F.input_file_name().alias("source"),
        F.try_parse_json("value").isNull().alias("malformed"),
    )


def read_documents(df: DataFrame, index: str | None = None) -> DataFrame:
    """Retrieved documents with one id and one text, whatever their fields are called."""

    def pick(*names: str) -> list[Column]:
        return [F.nullif(F.col(n).cast("string"), F.lit("")) for n in names if n in df.columns]

    fallback = (
        [F.concat(F.lit("doc["), F.col(index).cast("string"), F.lit("]"))] if index else []
    )
    return df.select(
        F.coalesce(*pick("id", "source"), *fallback, F.lit(None).cast("string")).alias("doc_id"),
        F.coalesce(*pick("text", "content", "page_content"), F.lit("")).alias("text"),
    )


def read_corpus(spark: SparkSession, path: str, sample_bytes: int | None = None) -> DataFrame:
    """Files as documents, binary suffixes left out. ``sample_bytes`` reads a leading
    sample only; by default the whole file is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    content = F.col("content")
    if sample_bytes is not None:
        content = F.substring(content, 1, sample_bytes)
    return files.filter(~suffix.isin(*BINARY_SUFFIXES)).select(
        F.col("path").alias("doc_id"), F.make_valid_utf8(content.cast("string")).alias("text")
    )


POLICY_KEYS = {
    "version", "org", "business_unit", "mode", "default", "unregistered_workload", "promotion",
    "fail", "rules", "escalation",
}
RULE_KEYS = {
    "match", "action", "format_preserving", "escalate", "notify", "except", "unless", "reason",
}
MATCH_KEYS = {"direction", "class", "source", "destination", "composite_risk_gte"}
CLEARANCE_KEYS = {"actor_role", "actor_group", "destination"}
ACTIONS = {"allow", "warn", "tokenize", "mask", "block"}


class PolicyError(ValueError):
    """A policy file with an unknown key or a value outside its set."""


def _only(found: dict, allowed: set, where: str) -> None:
    extra = sorted(set(found) - allowed)
    if extra:
        raise PolicyError(f"{where}: unknown key {extra[0]!r}")


def _as_list(v) -> list:
    return [] if v is None else [v] if isinstance(v, (str, dict)) else list(v)


def _clearances(blocks, where: str) -> list[dict]:
    out = []
    for b in _as_list(blocks):
        _only(b, CLEARANCE_KEYS, where)
        out.append({k: _as_list(b.get(k)) for k in sorted(CLEARANCE_KEYS)})
    return out


def policy_row(text: str, tenant_id: str, active: bool = True) -> dict:
    """One policy file as a row; anything outside the schema is an error."""
    try:
        import yaml
    except ImportError as exc:  # pragma: no cover
        raise PolicyError("reading policy files needs PyYAML") from exc
    doc = yaml.safe_load(text)
    if not isinstance(doc, dict):
        raise PolicyError("a policy is a mapping at the top level")
    _only(doc, POLICY_KEYS, "policy")
    rules = []
    for i, r in enumerate(doc.get("rules") or []):
        where = f"rules[{i}]"
        _only(r, RULE_KEYS, where)
        match = r.get("match") or {}
        _only(match, MATCH_KEYS, f"{where}.match")
        if r.get("action") not in ACTIONS:
            raise PolicyError(f"{where}: action {r.get('action')!r} is not on the lattice")
        if match.get("direction") not in (None, "inbound", "outbound"):
            raise PolicyError(f"{where}: direction {match.get('direction')!r}")
        unknown = [c for c in _as_list(match.get("class")) if c not in FAMILY_OF]
        if unknown:
            raise PolicyError(f"{where}: unknown class {unknown[0]!r}")
        rules.append(
            {
                "direction": match.get("direction"), "class": _as_list(match.get("class")),
                "destination": _as_list(match.get("destination")), "action": r["action"],
                "format_preserving": bool(r.get("format_preserving", False)),
                "escalate": bool(r.get("escalate", False)), "reason": r.get("reason"),
                "unless": _clearances(r.get("unless"), f"{where}.unless"),
                "except": _clearances(r.get("except"), f"{where}.except"),
            }
        )
    for field, allowed in (
        ("default", ACTIONS), ("unregistered_workload", ACTIONS), ("mode", {"shadow", "enforce"})
    ):
        if field in doc and doc[field] not in allowed:
            raise PolicyError(f"{field}: {doc[field]!r}")
    return {
        "tenant_id": tenant_id, "version": int(doc.get("version", 1)), "active": active,
        "org": doc.get("org"), "business_unit": doc.get("business_unit"),
        "mode": doc.get("mode", "shadow"), "default": doc.get("default", "allow"),
        "unregistered_workload": doc.get("unregistered_workload", "mask"),
        "rules": rules, "yaml": text,
    }


POLICY_SCHEMA = (
    "tenant_id string, version int, active boolean, org string, business_unit string, "
    "mode string, default string, unregistered_workload string, "
    f"rules array<{RULE_TYPE}>, yaml string"
)


def policies_frame(spark: SparkSession, rows: Sequence[dict]) -> DataFrame:
    """Policy rows with their content hash."""
    df = spark.createDataFrame(list(rows), POLICY_SCHEMA)
    return df.withColumn(
        "content_hash",
        policy_hash(F.col("tenant_id"), F.col("version").cast("bigint"), F.col("yaml")),
    )


def load_policies(spark: SparkSession, files: dict[str, str]) -> DataFrame:
    """Policy files (tenant id -> path). They are configuration: read on the driver."""
    rows = []
    for tenant, path in files.items():
        text = "\n".join(r[0] for r in spark.read.option("wholetext", True).text(path).collect())
        rows.append(policy_row(text, tenant))
    return policies_frame(spark, rows)


def merge_context_rules(config: Sequence[KeyRule]) -> tuple[list[KeyRule], list[tuple[str, str]]]:
    """(effective rules, violations). Configuration may add rules or raise confidence."""
    base = {r.name: r for r in BASELINE_KEY_RULES}
    given = {r.name: r for r in config}
    problems = []
    for name, b in base.items():
        r = given.get(name)
        if r is None:
            if config:
                problems.append((name, "baseline rule absent"))
        elif r.confidence < b.confidence:
            problems.append((name, "confidence below baseline"))
        elif r.pattern != b.pattern:
            problems.append((name, "pattern differs from baseline"))
    weakened = {n for n, _ in problems}
    merged = [
        given[n] if n in given and n not in weakened else b for n, b in base.items()
    ]
    return merged + [r for r in config if r.name not in base], problems


def rules_frame(spark: SparkSession, rules: Sequence[KeyRule]) -> DataFrame:
    return spark.createDataFrame(
        [(r.name, r.entity_class, r.pattern, r.confidence) for r in rules],
        "name string, entity_class string, pattern string, confidence double",
    )


def context_rule_violations(baseline: DataFrame, config: DataFrame) -> DataFrame:
    """Config rows that weaken a baseline rule, and baseline rules that are missing."""
    c = config.select(
        "name", F.col("pattern").alias("_p"), F.col("confidence").alias("_c"),
        F.lit(True).alias("_there"),
    )
    problem = (
        F.when(F.col("_there").isNull(), "baseline rule absent")
        .when(F.col("_c") < F.col("confidence"), "confidence below baseline")
        .when(F.col("_p") != F.col("pattern"), "pattern differs from baseline")
    )
    return baseline.join(c, "name", "left").select("name", problem.alias("problem")).filter(
        "problem is not null"
    )


def missing_baseline(baseline: DataFrame, config: DataFrame) -> DataFrame:
    return baseline.select("name").exceptAll(config.select("name"))


def load_context_rules(spark: SparkSession, path: str) -> list[KeyRule]:
    """Key rules of a YAML file merged over the baseline; a weakening is an error."""
    import yaml

    text = "\n".join(r[0] for r in spark.read.option("wholetext", True).text(path).collect())
    doc = yaml.safe_load(text) or {}
    rows = [
        KeyRule(r["name"], r["entity_class"], r["pattern"], float(r["confidence"]))
        for r in doc.get("key_names", [])
        if r.get("entity_class") in FAMILY_OF
    ]
    merged, problems = merge_context_rules(rows)
    if problems:
        raise PolicyError(f"{problems[0][0]}: {problems[0][1]}")
    return merged


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LEDGER_SCHEMA).json(path)


EVENT_SCHEMA = (
    "session_id string, ts timestamp, seq bigint, tool string, args variant, "
    "text string"
)


def read_events(spark: SparkSession, path: str, fmt: str = "parquet", streaming: bool = True
                ) -> DataFrame:
    """Tool-call events of sessions as a stream (or a batch)."""
    reader = spark.readStream if streaming else spark.read
    return reader.schema(EVENT_SCHEMA).format(fmt).load(path)
