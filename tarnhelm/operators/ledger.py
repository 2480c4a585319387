"""Hash-chained evidence: build, anchor and verify."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnhelm.functions.crypto import genesis, link_hash
from tarnhelm.functions.text import bind
from tarnhelm.operators.literals import ENTRIES, LiteralIndex
from tarnhelm.operators.ordered import BLOCK_ROWS, with_history
from tarnhelm.operators.policy import root_tenant

# Event routing and field names that could hold a raw value. The genesis
# suffix is this package's own; pass another one to check a foreign chain.
GENESIS_SUFFIX = "tarnhelm-genesis"
CHAINS = ("ctl", "dp")
CHAIN_OF = {"policy.updated": "ctl", "request.decided": "dp", "request.failed": "dp"}
ANCHOR = "chain.cross_anchor"
FORBIDDEN = (
    "text", "value", "content", "span_text", "raw", "original", "sample", "secret",
    "plaintext", "body",
)

LEDGER_SCHEMA = (
    "id bigint, tenant_id string, chain string, event_type string, payload string, "
    "ts string, prev_hash string, record_hash string"
)


def canonical_json(**fields: Column) -> Column:
    """Compact JSON object with sorted keys; nulls are written out."""
    return F.to_json(
        F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"}
    )


def _quoted(col: Column) -> Column:
    wrapped = F.to_json(F.array(col))
    return F.substring(wrapped, F.lit(2), F.length(wrapped) - 2)


def record_json(tenant: Column, event: Column, payload: Column, ts: Column) -> Column:
    """Canonical bytes of a record; ``payload`` is canonical JSON already."""
    return F.concat(
        F.lit('{"event_type":'), _quoted(event), F.lit(',"payload":'), payload,
        F.lit(',"tenant_id":'), _quoted(tenant), F.lit(',"ts":'), _quoted(ts), F.lit("}"),
    )


def route_chain(event: Column) -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, chain in CHAIN_OF.items():
        out = out.when(event == name, chain)
    return out


def policy_hash(tenant: Column, version: Column, yaml: Column) -> Column:
    return F.sha2(canonical_json(tenant_id=tenant, version=version, yaml=yaml), 256)


def decided_records(requests: DataFrame) -> DataFrame:
    """``request.decided`` events: classes, paths and versions, never a value."""
    c = F.col
    payload = canonical_json(
        request_id=c("request_id"), actor_id=c("actor_id"), actor_registered=c("registered"),
        leg=c("leg"), decision_action=c("action"), applied_action=c("applied_action"),
        mode=c("mode"), rule_index=c("rule_index"), rule_scope=c("rule_scope"),
        org_policy_version=c("org_policy_version"), org_policy_content_hash=c("org_hash"),
        bu_policy_version=c("bu_policy_version"), bu_policy_content_hash=c("bu_hash"),
        exception_applied=c("exception_applied"), finding_classes=c("finding_classes"),
        finding_paths=c("finding_paths"), upstream_model=c("model"),
        degraded_reasons=F.sort_array(F.array_distinct(c("degraded_reasons"))),
        truncated=F.lit(False),
    )
    return requests.select(
        "tenant_id", F.lit("request.decided").alias("event_type"), payload.alias("payload"),
        c("ts").cast("string").alias("ts"), c("ord").cast("bigint").alias("ord"),
    )


# Fields of the remaining events.
EVENT_FIELDS = {
    "policy.updated": (
        "version", "previous_version", "published_by", "rule_count", "content_hash",
        "diff_summary",
    ),
    "request.failed": (
        "request_id", "stage", "code", "upstream_model", "org_policy_version",
        "bu_policy_version",
    ),
    "prompt_checked": ("actor", "allowed", "verdict", "classes", "findings", "latency_ms",
                       "degraded"),
    "dispatch_verification_failed": ("request_id", "reason", "planned"),
}


def event_records(kind: str, df: DataFrame) -> DataFrame:
    """Records of another event kind from columns of the same names."""
    payload = canonical_json(**{f: F.col(f) for f in EVENT_FIELDS[kind]})
    return df.select(
        "tenant_id", F.lit(kind).alias("event_type"), payload.alias("payload"),
        F.col("ts").cast("string").alias("ts"), F.col("ord").cast("bigint").alias("ord"),
    )


def guard_records(records: DataFrame, max_entry: int = 200) -> DataFrame:
    """Adds ``refused``: a forbidden field name or an entry long enough to be a value."""
    keys = F.regexp_extract_all("payload", F.lit(r'"((?:[^"\\]|\\.)*)"\s*:'), F.lit(1))
    bad_key = F.exists(keys, lambda k: F.lower(k).isin(*FORBIDDEN))
    entries = F.concat(
        *[
            F.coalesce(
                F.from_json(F.get_json_object("payload", f"$.{f}"), "array<string>"),
                F.array().cast("array<string>"),
            )
            for f in ("finding_classes", "finding_paths")
        ]
    )
    reason = F.when(bad_key, "forbidden field").when(
        F.exists(entries, lambda e: F.length(e) > max_entry), "entry too long"
    )
    return records.withColumn("refused", reason)


def heads(ledger: DataFrame) -> DataFrame:
    """Last row per tenant and chain."""
    return ledger.groupBy("tenant_id", "chain").agg(
        F.max("id").alias("head_id"),
        F.max_by("record_hash", "id").alias("head_hash"),
        F.count("*").alias("rows"),
    )


def tail(ledger: DataFrame, n: int) -> DataFrame:
    return ledger.orderBy(F.desc("id"), "tenant_id", "chain").limit(n)


def _chain_partition(suffix: str, anchors: bool):
    """Link records in order. State is two heads per tenant, whatever the batch holds."""

    def link(prev: str, rec: str) -> str:
        return hashlib.sha256(bytes.fromhex(prev) + rec.encode()).hexdigest()

    def quote(s: str) -> str:
        return json.dumps(s, ensure_ascii=False)

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        tenant, next_id, state = None, 1, {}
        for pdf in batches:
            out = []

            def emit(chain: str, event: str, payload: str, ts: str) -> None:
                nonlocal next_id
                rec = (
                    f'{{"event_type":{quote(event)},"payload":{payload},'
                    f'"tenant_id":{quote(tenant)},"ts":{quote(ts)}}}'
                )
                head = state[chain]
                prev = head[1]
                digest = link(prev, rec)
                out.append((next_id, tenant, chain, event, payload, ts, prev, digest))
                state[chain] = (next_id, digest, head[2] + 1)
                next_id += 1

            for row in pdf.itertuples(index=False):
                if row.tenant_id != tenant:
                    tenant = row.tenant_id
                    start = hashlib.sha256((tenant + suffix).encode()).hexdigest()
                    next_id = int(row.last_id) + 1
                    state = {
                        "ctl": (row.ctl_id, row.ctl_hash or start, int(row.ctl_rows)),
                        "dp": (row.dp_id, row.dp_hash or start, int(row.dp_rows)),
                    }
                emit(row.chain, row.event_type, row.payload, row.ts)
                if anchors:
                    other = "dp" if row.chain == "ctl" else "ctl"
                    head_id, head_hash, count = state[other]
                    known = count > 0
                    payload = json.dumps(
                        {
                            "chain": row.chain, "other_chain": other,
                            "other_chain_count": count,
                            "other_chain_head_hash": head_hash if known else None,
                            "other_chain_head_id": int(head_id) if known else None,
                        },
                        sort_keys=True, separators=(",", ":"),
                    )
                    emit(row.chain, ANCHOR, payload, row.ts)
            yield pd.DataFrame(
                out,
                columns=["id", "tenant_id", "chain", "event_type", "payload", "ts",
                         "prev_hash", "record_hash"],
            )

    return run


def append_chain(
    records: DataFrame, ledger: DataFrame | None = None, anchors: bool = True,
    suffix: str = GENESIS_SUFFIX,
) -> DataFrame:
    """New ledger rows for a batch of records (tenant_id, event_type, payload, ts, ord).

    A hash chain is sequential within a tenant and independent across tenants. Records
    are hash-partitioned by tenant, sorted on disk and streamed through with constant
    state, so a large tenant costs time but never memory.
    """
    recs = records
    if "chain" not in recs.columns:
        recs = recs.withColumn("chain", route_chain(F.col("event_type")))
    if ledger is not None:
        h = heads(ledger).groupBy("tenant_id").agg(
            F.max("head_id").alias("last_id"),
            *[
                F.max(F.when(F.col("chain") == ch, F.col(src))).alias(f"{ch}_{dst}")
                for ch in CHAINS
                for src, dst in (("head_id", "id"), ("head_hash", "hash"), ("rows", "rows"))
            ],
        )
        recs = recs.join(h, "tenant_id", "left")
    else:
        for name, kind in (("last_id", "bigint"), ("ctl_id", "bigint"), ("ctl_hash", "string"),
                           ("ctl_rows", "bigint"), ("dp_id", "bigint"), ("dp_hash", "string"),
                           ("dp_rows", "bigint")):
            recs = recs.withColumn(name, F.lit(None).cast(kind))
    recs = recs.select(
        "tenant_id", "chain", "event_type", "payload", "ts", "ord",
        *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
          for c in ("last_id", "ctl_id", "ctl_rows", "dp_id", "dp_rows")],
        *[F.coalesce(c, F.lit("")).alias(c) for c in ("ctl_hash", "dp_hash")],
    )
    return (
        recs.repartition("tenant_id")
        .sortWithinPartitions("tenant_id", "ord")
        .mapInPandas(_chain_partition(suffix, anchors), LEDGER_SCHEMA)
    )


def _block(rows: int) -> Column:
    return F.floor((F.col("id") - 1) / rows)


def check_links(
    ledger: DataFrame, suffix: str = GENESIS_SUFFIX, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Adds ``link_ok`` and ``content_ok``; every row recomputes from its own columns."""
    c = F.col
    hist = with_history(
        ledger, ["tenant_id", "chain"], ["id"], _block(block_rows),
        lags={"_prev": "record_hash"},
    )
    expected = F.coalesce("_prev", genesis(c("tenant_id"), suffix))
    rec = record_json(c("tenant_id"), c("event_type"), c("payload"), c("ts"))
    return hist.withColumns(
        {
            "link_ok": c("prev_hash") == expected,
            "content_ok": link_hash(c("prev_hash"), rec) == c("record_hash"),
        }
    ).drop("_prev")


def check_sequence(ledger: DataFrame, keys: Sequence[str] = ("tenant_id",),
                   block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows whose id is not their position: a gap or a reordering."""
    hist = with_history(
        ledger, list(keys), ["id"], _block(block_rows), counts={"_before": F.lit(1)}
    )
    return hist.withColumn("expected_id", F.col("_before") + 1).drop("_before").filter(
        F.col("id") != F.col("expected_id")
    )


def _with_heads(ledger: DataFrame, block_rows: int) -> DataFrame:
    """Every row with the last row and the number of rows of each chain before it: one ordered
    pass over a tenant, one summary per block carried forward."""
    c = F.col
    # Rows that name no known chain follow one another like a third.
    of = {ch: c("chain") == ch for ch in CHAINS} | {"x": ~c("chain").isin(*CHAINS)}
    return with_history(
        ledger, ["tenant_id"], ["id"], _block(block_rows),
        counts={f"_n_{ch}": is_it for ch, is_it in of.items()},
        lasts={f"_{ch}": F.when(is_it, F.struct(c("id"), c("record_hash")))
               for ch, is_it in of.items()})


def _anchor_problem() -> Column:
    """What is wrong with an anchor's claim about the other chain; for rows with heads."""
    c = F.col
    p = F.from_json(
        "payload",
        "chain string, other_chain string, other_chain_count bigint, "
        "other_chain_head_hash string, other_chain_head_id bigint",
    )
    is_ctl = c("chain") == "ctl"
    head = F.when(is_ctl, c("_dp")).otherwise(c("_ctl"))
    count = F.when(is_ctl, c("_n_dp")).otherwise(c("_n_ctl"))
    return F.when(c("event_type") == ANCHOR, bind(p, lambda p: (
        F.when(
            ~F.coalesce(p["other_chain"].isin(*CHAINS), F.lit(False))
            | (p["other_chain"] == c("chain")), "invalid other chain",
        )
        .when(~p["chain"].eqNullSafe(c("chain")), "claims another chain")
        .when(~p["other_chain_count"].eqNullSafe(count), "wrong count")
        .when(~p["other_chain_head_id"].eqNullSafe(head["id"]), "wrong head id")
        .when(~p["other_chain_head_hash"].eqNullSafe(head["record_hash"]), "wrong head hash"))))


def check_cross_anchors(ledger: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Anchor rows whose claim about the other chain is wrong.

    Head and count of both chains before a row come from one ordered pass over the
    tenant; no as-of join is needed.
    """
    rows = _with_heads(ledger, block_rows).where(F.col("event_type") == ANCHOR)
    return rows.select("tenant_id", "chain", "id", _anchor_problem().alias("detail")).filter(
        "detail is not null"
    )


def check_policy_bindings(
    ledger: DataFrame, policies: DataFrame, tenants: DataFrame
) -> DataFrame:
    """Rows that name a policy version which is missing or was edited afterwards."""
    c = F.col
    rows = ledger.filter(c("event_type").isin("policy.updated", "request.decided"))
    fields = F.from_json(
        "payload",
        "content_hash string, version bigint, org_policy_content_hash string, "
        "org_policy_version bigint, bu_policy_content_hash string, bu_policy_version bigint",
    )
    rows = rows.withColumn("_p", fields).join(
        root_tenant(tenants), "tenant_id", "left"
    )

    def claim(kind: str, owner: Column, version: str, digest: str) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"), owner.alias("owner"),
            c(f"_p.{version}").alias("version"), c(f"_p.{digest}").alias("digest"),
        )

    decided = c("event_type") == "request.decided"
    claims = F.array(
        claim("policy", F.when(~decided, c("tenant_id")), "version", "content_hash"),
        claim("org policy", F.when(decided, c("root_id")), "org_policy_version",
              "org_policy_content_hash"),
        claim("bu policy", F.when(decided, c("tenant_id")), "bu_policy_version",
              "bu_policy_content_hash"),
    )
    asked = rows.select(
        "tenant_id", "chain", "id", "status", decided.alias("_decided"),
        F.explode(F.filter(claims, lambda x: x["digest"].isNotNull())).alias("_c"),
    ).select("tenant_id", "chain", "id", "status", "_decided", "_c.*")
    known = policies.select(
        c("tenant_id").alias("owner"), c("version").cast("bigint").alias("version"),
        policy_hash(c("tenant_id"), c("version").cast("bigint"), c("yaml")).alias("_now"),
    )
    problem = (
        F.when(
            c("_decided") & (c("kind") == "org policy") & (F.coalesce("status", F.lit("ok")) == "cycle"),
            "tenant hierarchy is cyclic",
        )
        .when(c("_now").isNull(), F.concat(c("kind"), F.lit(" row is missing")))
        .when(c("_now") != c("digest"), F.concat(c("kind"), F.lit(" was edited")))
    )
    return (
        asked.join(known, ["owner", "version"], "left")
        .withColumn("detail", problem).filter("detail is not null")
        .groupBy("tenant_id", "chain", "id")
        .agg(F.max("detail").alias("detail"))
    )


def first_divergence(failures: DataFrame) -> DataFrame:
    """Earliest failing row per tenant."""
    return failures.groupBy("tenant_id").agg(
        F.min("id").alias("broken_at"), F.min_by("detail", "id").alias("detail"),
        F.min_by("chain", "id").alias("chain"),
    )


def verify_ledger(
    ledger: DataFrame, policies: DataFrame | None = None, tenants: DataFrame | None = None,
    suffix: str = GENESIS_SUFFIX, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """One row per tenant: rows checked, ok, and where and why a chain breaks first.

    Within a chain a broken link or an edited record hides what its anchors and policy
    references say; those count only in a chain that is otherwise intact.
    """
    c = F.col
    own = F.when(c("chain") == "ctl", c("_ctl")).when(c("chain") == "dp", c("_dp")).otherwise(
        c("_x"))
    expected = F.coalesce(own["record_hash"], genesis(c("tenant_id"), suffix))
    rec = record_json(c("tenant_id"), c("event_type"), c("payload"), c("ts"))
    hard = F.when(
        ~F.coalesce(c("prev_hash") == expected, F.lit(False)),
        "prev_hash does not match the record before it",
    ).when(
        ~F.coalesce(link_hash(c("prev_hash"), rec) == c("record_hash"), F.lit(False)),
        "record was edited after it was written")
    # Links, records and anchors are judged in the one pass that brings the heads.
    rows = _with_heads(ledger, block_rows).select(
        "tenant_id", "chain", "id", hard.alias("_hard"), _anchor_problem().alias("_anchor"))
    first = F.min(F.when(c("_hard").isNotNull(), F.struct(
        F.lit(0).alias("soft"), c("id"), c("_hard").alias("detail"))).when(
        c("_anchor").isNotNull(), F.struct(
            F.lit(1).alias("soft"), c("id"), c("_anchor").alias("detail"))))
    chains = rows.groupBy("tenant_id", "chain").agg(
        first.alias("_f"), F.count("*").alias("_rows"))
    if policies is not None and tenants is not None:
        bound = check_policy_bindings(ledger, policies, tenants).groupBy("tenant_id", "chain").agg(
            F.min(F.struct(F.lit(1).alias("soft"), c("id"), c("detail"))).alias("_f"))
        chains = chains.unionByName(bound.withColumn("_rows", F.lit(0).cast("bigint"))).groupBy(
            "tenant_id", "chain").agg(F.min("_f").alias("_f"), F.sum("_rows").alias("_rows"))
    found = F.struct(c("_f.id").alias("id"), c("_f.detail").alias("detail"), c("chain"))
    return chains.groupBy("tenant_id").agg(
        F.sum("_rows").alias("checked"),
        F.min(F.when(c("_f").isNotNull(), found)).alias("_first"),
    ).select(
        "tenant_id", "checked", c("_first.id").alias("broken_at"),
        c("_first.detail").alias("detail"), c("_first.chain").alias("chain"),
        c("_first").isNull().alias("ok"))


def leak_sweep(
    tables: dict[str, DataFrame], literals: DataFrame, at_once: int = ENTRIES
) -> DataFrame:
    """Planted literals of any length found in any column of any table: rows that hold each.

    Values are searched, not their spelling in JSON: names of columns and punctuation are no
    hits. Values of lists, maps and structs are searched as text without the names of fields. An
    index of the literals' grams finds the few that a row may hold, an exact search decides, and
    nothing but counts is shuffled. ``at_once`` literals are looked for in one pass.
    """
    index = LiteralIndex(
        literals.select("literal").where(F.length("literal") > 0).distinct(), at_once)
    found = []
    for name, df in tables.items():
        values = df.select(F.array(*[
            F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns
        ]).alias("_values"))
        rows = index.lookup(values, F.col("_values"), lambda p: p.select("literal"), few=True)
        if rows is not None:
            found.append(rows.groupBy("literal").agg(F.count("*").alias("rows")).select(
                F.lit(name).alias("table"), "literal", "rows"))
    if not found:
        return literals.sparkSession.createDataFrame(
            [], "table string, literal string, rows bigint")
    return reduce(DataFrame.unionByName, found)
