"""Measuring detection: quality, evasion, coverage, distributions, traffic."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnhelm.functions.text import (
    charset_class,
    entropy,
    identifier_tokens,
    is_identifier_shaped,
    key_name,
    shape_of,
)
from tarnhelm.operators.spans import safe_path

# Scenarios in which any enforceable finding is a false positive.
QUIET_SCENARIOS = (
    "clean_code", "clean_prose", "clean_agent_trace", "decoy_placeholder",
    "decoy_high_entropy", "decoy_near_miss_id", "composite_weak",
)


def _ratio(a: Column, b: Column, digits: int = 6) -> Column:
    return F.when(b > 0, F.round(a / b, digits))


def coverage(requests: DataFrame) -> DataFrame:
    """Counters per (harness, route, provider, channel)."""
    o = F.col("outcome")
    return requests.groupBy("harness", "route", "provider", "channel").agg(
        F.count("*").alias("requests"),
        F.count_if(~o.isin("blocked", "failed")).alias("allowed"),
        F.count_if(o == "blocked").alias("blocked"),
        F.count_if(o == "failed").alias("failed"),
        F.max("ts").alias("last_seen"),
    )


def coverage_totals(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.sum("requests").alias("total_requests"),
        F.coalesce(F.sum(F.when(F.col("harness") == "unknown", F.col("requests"))), F.lit(0))
        .alias("unclassified_requests"),
    )


def _found_classes(findings: DataFrame) -> DataFrame:
    """One row per (record, class) with whether an enforceable finding exists."""
    return findings.groupBy("record_id", "entity_class").agg(
        F.bool_or(~F.col("advisory_only")).alias("enforceable")
    )


def detector_quality(
    records: DataFrame, findings: DataFrame, quiet: Sequence[str] = QUIET_SCENARIOS
) -> DataFrame:
    """Per class: expected, found, missed, recall, false positives on quiet records,
    precision against them and F1.

    Records carry ``record_id``, ``scenario`` and ``expect`` (array of classes). Expected
    and found meet on (record, class), the quiet side is a second aggregation.
    """
    c = F.col
    found = _found_classes(findings)
    hit = (
        records.select("record_id", F.explode("expect").alias("entity_class"))
        .join(found.select("record_id", "entity_class", F.lit(1).alias("_hit")),
              ["record_id", "entity_class"], "left")
        .groupBy("entity_class")
        .agg(F.count("*").alias("expected"), F.count("_hit").alias("found"))
    )
    fp = (
        records.filter(c("scenario").isin(*quiet)).select("record_id")
        .join(found.filter("enforceable"), "record_id")
        .groupBy("entity_class").agg(F.count("*").alias("false_positives"))
    )
    q = hit.join(fp, "entity_class", "left").withColumns(
        {
            "false_positives": F.coalesce("false_positives", F.lit(0)),
            "missed": c("expected") - c("found"),
        }
    )
    q = q.withColumns(
        {
            "recall": _ratio(c("found"), c("expected")),
            "precision": _ratio(c("found"), c("found") + c("false_positives")),
        }
    )
    f1 = F.when(
        (c("recall") > 0) & (c("precision") > 0),
        F.round(2 * c("recall") * c("precision") / (c("recall") + c("precision")), 6),
    )
    return q.select("entity_class", "expected", "found", "missed", "recall",
                    "false_positives", "precision", f1.alias("f1"))


def false_positive_rate(
    records: DataFrame, findings: DataFrame, quiet: Sequence[str] = QUIET_SCENARIOS
) -> DataFrame:
    """Share of quiet records with an enforceable finding."""
    flagged = findings.filter(~F.col("advisory_only")).select("record_id").distinct()
    return (
        records.filter(F.col("scenario").isin(*quiet))
        .join(flagged.withColumn("_fp", F.lit(1)), "record_id", "left")
        .agg(F.count("*").alias("quiet_records"), F.count("_fp").alias("flagged_records"))
        .withColumn("false_positive_rate",
                    _ratio(F.col("flagged_records"), F.col("quiet_records"), 8))
    )


def integrity(records: DataFrame, decisions: DataFrame) -> DataFrame:
    """Credential block rate and enforcement on read-only text (should be zero)."""
    c = F.col
    blocked = c("action") == "block"
    must = c("expect_action") == "block"
    return records.join(decisions.select("record_id", "action"), "record_id", "left").agg(
        F.count_if(must).alias("credential_records"),
        F.count_if(must & ~F.coalesce(blocked, F.lit(False))).alias("credential_not_blocked"),
        F.count_if((F.size("expect_readonly") > 0) & blocked).alias("tool_definition_enforced"),
    ).withColumn(
        "credential_block_rate",
        F.round(1 - c("credential_not_blocked") / F.greatest(c("credential_records"), F.lit(1)), 6),
    )


def evasion_matrix(records: DataFrame, findings: DataFrame, decisions: DataFrame) -> DataFrame:
    """Detection and block rate per (scenario, variant)."""
    c = F.col
    found = findings.groupBy("record_id").agg(F.collect_set("entity_class").alias("_classes"))
    return (
        records.filter("variant is not null")
        .join(found, "record_id", "left")
        .join(decisions.select("record_id", "action"), "record_id", "left")
        .groupBy("scenario", "variant")
        .agg(
            F.count("*").alias("records"),
            F.count_if(F.coalesce(F.arrays_overlap("expect", "_classes"), F.lit(False)))
            .alias("detected"),
            F.count_if(c("action") == "block").alias("blocked"),
        )
        .withColumns(
            {
                "detection_rate": _ratio(c("detected"), c("records")),
                "block_rate": _ratio(c("blocked"), c("records")),
            }
        )
    )


def scenario_enforcement(records: DataFrame, status: DataFrame) -> DataFrame:
    return (
        records.join(status.select("record_id", "status"), "record_id", "left")
        .groupBy("scenario")
        .agg(
            F.count("*").alias("records"),
            F.count_if(F.col("status").isin("blocked", "redacted")).alias("enforced"),
        )
        .withColumn("rate", _ratio(F.col("enforced"), F.col("records")))
    )


def offset_collisions(findings: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sets of enforceable classes that share identical offsets, and how often."""
    return (
        findings.filter(~F.col("advisory_only"))
        .groupBy(*keys, "start", "end")
        .agg(F.sort_array(F.collect_set("entity_class")).alias("_c"))
        .filter(F.size("_c") > 1)
        .groupBy(F.array_join("_c", "+").alias("pair"))
        .agg(F.count("*").alias("n"))
    )


def distributions(
    findings: DataFrame,
    dims: Sequence[str] = ("entity_class", "family", "stage", "detector", "origin",
                           "confidence", "span_path"),
    path_chars: int | None = None,
) -> DataFrame:
    """Counts and shares along every dimension from one pass with grouping sets."""
    src = findings
    if "confidence" in dims:
        src = src.withColumn("confidence", F.format_number(F.round("confidence", 1), 1))
    if "span_path" in dims:
        path = F.substring_index("span_path", "$", 1)
        src = src.withColumn(
            "span_path", path if path_chars is None else F.substring(path, 1, path_chars)
        )
    dims = [d for d in dims if d in src.columns]
    shares = (
        src.select(*[F.col(d).cast("string").alias(d) for d in dims])
        .groupingSets([[d] for d in dims], *dims)
        .agg(F.count("*").alias("n"), F.grouping_id().alias("_g"))
    )
    label, value = None, None
    for i, d in enumerate(dims):
        mine = F.col("_g") == F.lit((1 << len(dims)) - 1 - (1 << (len(dims) - 1 - i)))
        label = F.when(mine, d) if label is None else label.when(mine, d)
        value = F.when(mine, F.col(d)) if value is None else value.when(mine, F.col(d))
    rows = shares.select(label.alias("dimension"), value.alias("value"), "n")
    total = F.sum("n").over(W.partitionBy("dimension"))
    return rows.withColumn("share", F.round(F.col("n") / total, 6))


LATENCY_MARKS = (0.5, 0.9, 0.95, 0.99, 0.999)


def latency_quantiles(requests: DataFrame, col: str = "latency", exact: bool = False
                      ) -> DataFrame:
    """p50, p90, p95, p99, p99.9, mean and maximum."""
    marks = list(LATENCY_MARKS)
    q = (
        F.percentile(col, F.array(*[F.lit(m) for m in marks])) if exact
        else F.approx_percentile(col, marks, 10_000)
    )
    return requests.agg(q.alias("_q"), F.avg(col).alias("mean"), F.max(col).alias("max")).select(
        *[F.col("_q")[i].alias(n) for i, n in enumerate(("p50", "p90", "p95", "p99", "p999"))],
        F.round("mean", 2).alias("mean"), "max",
    )


#: Size of a quantile sketch; more is more exact. At this size a quantile is off by far less than
#: RANK_ERROR of all values.
SKETCH_SIZE = 4096
RANK_ERROR = 0.002


def hourly_sketches(
    requests: DataFrame, keys: Sequence[str] = (), col: str = "latency", ts: str = "ts"
) -> DataFrame:
    """One mergeable quantile sketch of ``col`` per hour and ``keys``, to be stored.

    A sketch has some ten thousand numbers at most whatever the hour holds; null values are left
    out. Hours without values have no row.
    """
    value = F.col(col).cast("double")
    return requests.where(value.isNotNull() & ~F.isnan(value)).groupBy(
        *keys, F.date_trunc("hour", F.col(ts)).alias("hour")).agg(
        F.count("*").alias("n"), F.sum(value).alias("total"), F.max(value).alias("max"),
        F.kll_sketch_agg_double(value, SKETCH_SIZE).alias("sketch"))


def merged_quantiles(
    sketches: DataFrame, keys: Sequence[str] = (), marks: Sequence[float] = LATENCY_MARKS
) -> DataFrame:
    """Quantiles over any choice of stored hours: (keys, quantile, value, n, mean, max).

    Only sketches are read and merged, never the values again.
    """
    merged = sketches.groupBy(*keys).agg(
        F.sum("n").alias("n"), (F.sum("total") / F.sum("n")).alias("mean"),
        F.max("max").alias("max"), F.kll_merge_agg_double("sketch").alias("_s"))
    places = F.array(*[F.lit(float(m)) for m in marks])
    both = F.arrays_zip(places.alias("quantile"),
                        F.kll_sketch_get_quantile_double("_s", places).alias("value"))
    return merged.where(F.col("n") > 0).select(
        *keys, F.explode(both).alias("_q"), "n", "mean", "max").select(
        *keys, "_q.quantile", "_q.value", "n", "mean", "max")


def hourly(requests: DataFrame) -> DataFrame:
    """Requests, blocks and redactions per hour of the day, and the share of the peak."""
    c = F.col
    rows = requests.groupBy(F.hour("ts").alias("hour")).agg(
        F.count("*").alias("total"),
        F.count_if(c("status") == "blocked").alias("blocked"),
        F.count_if(c("status") == "redacted").alias("redacted"),
    )
    peak = F.max("total").over(W.partitionBy())
    return rows.withColumns(
        {
            "clean": c("total") - c("blocked") - c("redacted"),
            "share": F.round(c("total") / peak, 4),
        }
    )


def environments(requests: DataFrame) -> DataFrame:
    """Actions per environment with the intervention rate."""
    c = F.col
    a = c("action")
    return requests.groupBy("env").agg(
        F.count("*").alias("records"),
        *[F.count_if(a == x).alias(x) for x in ("allow", "warn", "tokenize", "mask", "block")],
    ).select(
        "env", "records", "allow", "warn", "tokenize", "mask", "block",
        F.round((c("block") + c("tokenize") + c("mask")) / c("records"), 6)
        .alias("intervention_rate"),
        F.when(c("env") == "production", "enforce").otherwise("shadow").alias("mode"),
    )


def by_role(requests: DataFrame, dims: Sequence[str] = ("role",)) -> DataFrame:
    return requests.groupBy(*dims, "action").agg(F.count("*").alias("n"))


def traffic_report(turns: DataFrame, verdict_rows: DataFrame, own: str) -> DataFrame:
    """Blocked share, own versus external projects, and turn sizes."""
    c = F.col
    red = c("verdict") == "red"
    mine = F.contains(c("project"), F.lit(own))
    return turns.join(verdict_rows.select("turn_id", "verdict"), "turn_id", "left").agg(
        F.count("*").alias("turns"),
        F.countDistinct("project").alias("projects"),
        F.sum("chars").alias("total_chars"),
        F.percentile("chars", F.lit(0.5)).alias("median_chars"),
        F.max("chars").alias("max_chars"),
        F.count_if(red).alias("blocked"),
        F.count_if(red & mine).alias("blocked_own"),
        F.count_if(red & ~mine).alias("blocked_external"),
        F.count_if(~mine).alias("external_turns"),
    ).withColumn("blocked_share", _ratio(c("blocked"), c("turns")))


def systematic_sample(df: DataFrame, index: str, k: int, n: int) -> DataFrame:
    """Every k-th row by index, the first n of them."""
    return df.filter(F.pmod(index, F.lit(k)) == 0).orderBy(index).limit(n)


def stratified_sample(
    turns: DataFrame, n: int, seed: int = 7, stratum: str = "project", order: Column | None = None
) -> DataFrame:
    """Round robin over strata: n rows, at most n candidates kept per stratum.

    The shuffle of a stratum is a hash of the row and the seed, so a rerun after a lost
    executor picks the same rows. A hot stratum is ranked in salted parts first: the n
    best of all parts contain the n best of the stratum.
    """
    pick = order if order is not None else F.xxhash64(F.lit(seed), *[F.col(c) for c in turns.columns])
    rows = turns.withColumn("_pick", pick).withColumn("_salt", F.pmod(F.xxhash64("_pick"), F.lit(64)))
    part = W.partitionBy(stratum, "_salt").orderBy("_pick")
    rows = rows.withColumn("_r", F.row_number().over(part)).filter(F.col("_r") <= n)
    whole = W.partitionBy(stratum).orderBy("_pick")
    rows = rows.withColumn("_r", F.row_number().over(whole)).filter(F.col("_r") <= n)
    return rows.orderBy("_r", stratum).limit(n).drop("_pick", "_salt").withColumnRenamed(
        "_r", "round"
    )


def cap_escalations(
    features: DataFrame, keys: Sequence[str], order: str, per: int = 8, cap: int = 10_000
) -> tuple[DataFrame, DataFrame]:
    """(kept rows, one row of counts). At most ``per`` rows per request, then at most
    ``cap`` in the queue with band entries first; what is dropped is counted.

    The queue cut is a global top-k, which Spark evaluates per partition first.
    """
    w = W.partitionBy(*keys).orderBy(order)
    ranked = features.withColumn("_r", F.row_number().over(w))
    within = ranked.filter(F.col("_r") <= per).drop("_r")
    first = [F.desc("in_band")] if "in_band" in features.columns else []
    kept = within.orderBy(*first, *keys, order).limit(cap)
    # Counting needs no order: sizes per request come from a partial aggregation.
    n = F.col("_n")
    sums = features.groupBy(*keys).agg(F.count("*").alias("_n")).agg(
        F.coalesce(F.sum(n), F.lit(0)).alias("offered"),
        F.coalesce(F.sum(F.greatest(n - per, F.lit(0))), F.lit(0)).alias("over_request_cap"),
    )
    left = F.col("offered") - F.col("over_request_cap")
    return kept, sums.withColumn("dropped", F.greatest(left - cap, F.lit(0)))


def top_k(df: DataFrame, key: str, k: int, ties: Sequence[str] = ()) -> DataFrame:
    return df.orderBy(F.desc(key), *ties).limit(k)


def weakest_first(quality: DataFrame) -> DataFrame:
    return quality.orderBy(F.asc_nulls_last("recall"), "entity_class")


# States a request ends in.
FINAL_STATES = ("outbound_decided", "completed", "upstream_failed")


def request_status(events: DataFrame) -> DataFrame:
    """Last state of every request and its time from the first event to the last."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return events.filter(F.col("status").isin(*FINAL_STATES)).groupBy("request_id").agg(
        F.max_by("status", F.struct("ts", "seq")).alias("status"),
        F.round((F.max(micros) - F.min(micros)) / 1000.0, 3).alias("latency_ms"),
    )


# ------------------------------------------------------------------ escalation


def unclaimed(spans: DataFrame, findings: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Spans without any finding."""
    return spans.join(findings.select(*keys).distinct(), list(keys), "left_anti")


def neighbour_classes(findings: DataFrame, request: Sequence[str], span: str = "span_path"
                      ) -> DataFrame:
    """Classes found elsewhere in the same request, per span.

    A class is elsewhere when some other span has it: it is counted per request once, so
    nothing is compared pairwise.
    """
    per_span = findings.groupBy(*request, span).agg(
        F.collect_set("entity_class").alias("_own")
    )
    spread = (
        findings.select(*request, span, "entity_class").distinct()
        .groupBy(*request, "entity_class").agg(F.count("*").alias("_n"))
        .groupBy(*request)
        .agg(
            F.map_from_entries(F.collect_list(F.struct("entity_class", "_n"))).alias("_all")
        )
    )
    others = F.map_keys(
        F.map_filter(
            "_all",
            lambda k, n: n > F.when(F.array_contains("_own", k), 1).otherwise(0),
        )
    )
    return per_span.join(spread, list(request)).select(
        *request, span, F.sort_array(others).alias("neighbours")
    )


def escalation_features(
    spans: DataFrame, findings: DataFrame, request: Sequence[str], key: bytes,
    text: str = "text", lo: float = 0.35, hi: float = 0.75,
) -> DataFrame:
    """Feature rows of doubtful spans; never their text.

    A span with a finding inside the band escalates as a whole; a span without findings
    escalates when it is identifier shaped, otherwise its identifier-shaped tokens do.
    """
    keys = [*request, "span_path"]
    c = F.col
    fired = findings.groupBy(*keys).agg(
        F.sort_array(
            F.collect_list(
                F.struct(
                    c("detector").alias("name"), c("entity_class").alias("class"), "confidence"
                )
            )
        ).alias("detectors_fired"),
        F.bool_or((c("confidence") >= lo) & (c("confidence") < hi)).alias("_band"),
    )
    joined = spans.join(fired, keys, "left")
    value = F.when(c("detectors_fired").isNotNull(), F.when(c("_band"), F.array(c(text)))).when(
        is_identifier_shaped(c(text)), F.array(c(text))
    ).otherwise(identifier_tokens(c(text)))
    rows = joined.select(
        *keys, "origin", "leg", "detectors_fired",
        F.coalesce("_band", F.lit(False)).alias("in_band"),
        F.posexplode(value).alias("part", "_v"),
    )
    v = c("_v")
    return rows.select(
        *keys, "part", safe_path(c("span_path"), key).alias("span_path_safe"),
        key_name(c("span_path")).alias("key_name"),
        shape_of(v).alias("shape"), F.length(v).alias("length"),
        charset_class(v).alias("charset"), F.round(entropy(v), 3).alias("entropy"),
        "origin", "leg", "detectors_fired", "in_band",
    )


def adjudicate(features: DataFrame, proposer) -> DataFrame:
    """Attach a user's proposal: ``proposer`` is a pandas UDF over the feature struct."""
    return features.withColumn("proposal", proposer(F.struct(*features.columns)))
