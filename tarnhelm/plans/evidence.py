"""Registered ledger, span and session queries with their reference SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnhelm.operators import ledger as L
from tarnhelm.operators import session as S
from tarnhelm.operators import spans as P
from tarnhelm.plans import sqlkit as Q
from tarnhelm.plans.plants import plant, plant_sql, read
from tarnhelm.sources import readers as RD
from tarnhelm.sources.readers import KEY_BYTES, spread
from tarnhelm.sources.stored import keep, shared_folder

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
KEY = b"tenant-key"


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


# ------------------------------------------------------------------------ ledger

_EVENT = "case when o_orderkey % 5 = 0 then 'policy.updated' else 'request.decided' end"
_RECORDS_SQL = f"""(select concat('c', cast(o_custkey as varchar)) as tenant, o_orderkey as ord, {_EVENT} as event,
    case when o_orderkey % 5 = 0 then 'ctl' else 'dp' end as chain, concat('{{"n":', cast(o_orderkey as varchar), '}}') as payload,
    cast(o_orderdate as varchar) as ts, row_number() over (partition by o_custkey order by o_orderkey) as k from orders)"""


def _records(spark, sf):
    k = F.col("o_orderkey")
    return read(spark, sf, "orders").select(
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("tenant_id"),
        F.when(k % 5 == 0, "policy.updated").otherwise("request.decided").alias("event_type"),
        L.canonical_json(n=k).alias("payload"),
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("ts"), k.alias("ord"),
    )


def _json(event: str, payload: str) -> str:
    return (
        f"concat('{{\"event_type\":\"', {event}, '\",\"payload\":', {payload}, "
        f"',\"tenant_id\":\"', tenant, '\",\"ts\":\"', ts, '\"}}')"
    )


_CHAIN_SQL = f"""
  with recursive r as (select * from {_RECORDS_SQL} r0),
  step as (
    select distinct tenant, cast(0 as bigint) as k, '' as chain, '' as event, '' as h, '' as ah,
      cast(0 as bigint) as ctl_id, sha256(concat(tenant, '{L.GENESIS_SUFFIX}')) as ctl_h, cast(0 as bigint) as ctl_n,
      cast(0 as bigint) as dp_id, sha256(concat(tenant, '{L.GENESIS_SUFFIX}')) as dp_h, cast(0 as bigint) as dp_n from r
    union all
    select tenant, k, chain, event, h, ah,
      case when chain = 'ctl' then 2 * k else ctl_id end, case when chain = 'ctl' then ah else ctl_h end, case when chain = 'ctl' then ctl_n + 2 else ctl_n end,
      case when chain = 'dp' then 2 * k else dp_id end, case when chain = 'dp' then ah else dp_h end, case when chain = 'dp' then dp_n + 2 else dp_n end
    from (select *, sha256(unhex(h) || encode({_json("'chain.cross_anchor'", 'apay')})) as ah from (
      select *, sha256(unhex(case when chain = 'ctl' then ctl_h else dp_h end) || encode({_json('event', 'payload')})) as h,
        concat('{{"chain":"', chain, '","other_chain":"', case when chain = 'ctl' then 'dp' else 'ctl' end, '","other_chain_count":', cast(on_ as varchar),
          ',"other_chain_head_hash":', case when on_ = 0 then 'null' else concat('"', oh, '"') end,
          ',"other_chain_head_id":', case when on_ = 0 then 'null' else cast(oid as varchar) end, '}}') as apay
      from (select r.tenant, r.k, r.chain, r.event, r.payload, r.ts, s.ctl_id, s.ctl_h, s.ctl_n, s.dp_id, s.dp_h, s.dp_n,
          case when r.chain = 'ctl' then s.dp_n else s.ctl_n end as on_, case when r.chain = 'ctl' then s.dp_h else s.ctl_h end as oh,
          case when r.chain = 'ctl' then s.dp_id else s.ctl_id end as oid
        from step s join r on r.tenant = s.tenant and r.k = s.k + 1) a) b) c)
  select 2 * k - 1 as id, tenant as tenant_id, chain, event as event_type, h as record_hash from step where k > 0
  union all select 2 * k, tenant, chain, 'chain.cross_anchor', ah from step where k > 0"""


@query("append_chain", _CHAIN_SQL)
def append_chain(spark, sf):
    """Two anchored chains per tenant over all orders."""
    return L.append_chain(_records(spark, sf)).select(
        "id", "tenant_id", "chain", "event_type", "record_hash"
    )


@query(
    "append_chain_incremental",
    _CHAIN_SQL,
)
def append_chain_incremental(spark, sf):
    """The same ledger written in two batches; the second starts from the heads."""
    recs = _records(spark, sf)
    half = (recs.agg(F.max("ord")).first()[0] or 0) // 2
    old = keep(L.append_chain(recs.filter(F.col("ord") < half)))
    new = L.append_chain(recs.filter(F.col("ord") >= half), old)
    return old.unionByName(new).select("id", "tenant_id", "chain", "event_type", "record_hash")


#: Rows of the ledger without hashes, and what is done to them.
_ROWS_SQL = f"""(select tenant, chain, 2 * k - 1 + a as id, a = 1 as anchor, (2 * k - 1 + a) % 41 = 7 as gone,
    a = 0 and (2 * k - 1 + a) % 37 = 5 as edited from {_RECORDS_SQL} r, (select unnest([0, 1]) as a) t)"""
_STATE_SQL = f"""(select *, coalesce(lag(gone) over (partition by tenant, chain order by id), false) as link_broken,
    anchor and coalesce(sum(case when chain = 'ctl' and gone then 1 else 0 end) over (partition by tenant order by id rows between unbounded preceding and 1 preceding), 0) > 0 as ctl_lost,
    anchor and coalesce(sum(case when chain = 'dp' and gone then 1 else 0 end) over (partition by tenant order by id rows between unbounded preceding and 1 preceding), 0) > 0 as dp_lost
    from {_ROWS_SQL} r)"""
_FAIL_SQL = f"""(select tenant, chain, id, gone, edited, link_broken, case when chain = 'ctl' then dp_lost else ctl_lost end as anchor_wrong from {_STATE_SQL} s where not gone)"""


def _tampered(spark, sf):
    """The ledger with edited and removed rows."""
    rows = keep(L.append_chain(_records(spark, sf)))
    edit = (F.col("event_type") != L.ANCHOR) & (F.col("id") % 37 == 5)
    return rows.withColumn(
        "payload", F.when(edit, F.lit('{"n":-1}')).otherwise(F.col("payload"))
    ).filter(F.col("id") % 41 != 7)


@query(
    "ledger_intact",
    f"select tenant as tenant_id, count(*) as checked, true as ok from {_ROWS_SQL} r group by 1",
)
def ledger_intact(spark, sf):
    return L.verify_ledger(keep(L.append_chain(_records(spark, sf))), block_rows=16).select(
        "tenant_id", "checked", "ok"
    )


@query(
    "ledger_check_links",
    f"select tenant as tenant_id, id, not link_broken as link_ok, not edited as content_ok from {_FAIL_SQL} f",
)
def ledger_check_links(spark, sf):
    return L.check_links(_tampered(spark, sf), block_rows=8).select(
        "tenant_id", "id", "link_ok", "content_ok"
    )


@query(
    "ledger_check_sequence",
    f"""select tenant as tenant_id, id, pos as expected_id from (select tenant, id, row_number() over (partition by tenant order by id) as pos from {_FAIL_SQL} f) t where id <> pos""",
)
def ledger_check_sequence(spark, sf):
    return L.check_sequence(_tampered(spark, sf), block_rows=8).select(
        "tenant_id", "id", "expected_id"
    )


@query(
    "ledger_cross_anchors",
    f"select tenant as tenant_id, chain, id from {_FAIL_SQL} f where anchor_wrong",
)
def ledger_cross_anchors(spark, sf):
    return L.check_cross_anchors(_tampered(spark, sf), block_rows=8).select(
        "tenant_id", "chain", "id"
    )


@query(
    "verify_ledger",
    f"""with c as (select tenant, chain, coalesce(min(case when link_broken or edited then id end), min(case when anchor_wrong then id end)) as broken from {_FAIL_SQL} f group by 1, 2)
        select f.tenant as tenant_id, count(*) as checked, (select min(broken) from c where c.tenant = f.tenant) as broken_at from {_FAIL_SQL} f group by 1""",
)
def verify_ledger(spark, sf):
    """First divergence per tenant of a tampered ledger."""
    return L.verify_ledger(_tampered(spark, sf), block_rows=64).select(
        "tenant_id", "checked", "broken_at"
    )


@query(
    "ledger_heads",
    f"select tenant as tenant_id, chain, max(id) as head_id, count(*) as rows from {_ROWS_SQL} r group by 1, 2",
)
def ledger_heads(spark, sf):
    return L.heads(L.append_chain(_records(spark, sf))).drop("head_hash")


@query(
    "ledger_tail",
    f"select id, tenant as tenant_id, chain from {_ROWS_SQL} r order by id desc, tenant_id, chain limit 50",
)
def ledger_tail(spark, sf):
    return L.tail(L.append_chain(_records(spark, sf)), 50).select("id", "tenant_id", "chain")


_PHASH = "sha256(concat('{{\"tenant_id\":\"', {t}, '\",\"version\":', {v}, ',\"yaml\":\"', {y}, '\"}}'))"


@query(
    "policy_hash",
    "select id as tenant_id, " + _PHASH.format(t="id", v="'1'", y="concat('rules of ', id)")
    + f" as hash from {plant_sql('tenants')} t",
)
def policy_hash(spark, sf):
    t = plant(spark, sf, "tenants")
    return t.select(
        F.col("id").alias("tenant_id"),
        L.policy_hash(
            F.col("id"), F.lit(1).cast("bigint"), F.concat(F.lit("rules of "), F.col("id"))
        ).alias("hash"),
    )


@query(
    "policy_bindings",
    f"""select tenant_id, request_id as id, case when request_id % 50 = 3 then 'org policy was edited' when request_id % 50 = 4 then 'org policy row is missing' else 'bu policy was edited' end as detail
        from {plant_sql('requests')} q join {plant_sql('tenants')} t on t.id = q.tenant_id where request_id % 50 in (3, 4) or (request_id % 50 = 5 and t.parent_id is not null)""",
)
def policy_bindings(spark, sf):
    """Requests that name a policy row which is missing or was edited."""
    tenants = plant(spark, sf, "tenants")
    yaml = F.concat(F.lit("rules of "), F.col("id"))
    policies = tenants.select(
        F.col("id").alias("tenant_id"), F.lit(1).alias("version"), yaml.alias("yaml")
    )

    def digest(t):
        return L.policy_hash(t, F.lit(1).cast("bigint"), F.concat(F.lit("rules of "), t))

    q = plant(spark, sf, "requests").join(
        tenants.withColumnRenamed("id", "tenant_id"), "tenant_id"
    )
    k = F.col("request_id") % 50
    root = F.coalesce("parent_id", "tenant_id")
    payload = L.canonical_json(
        org_policy_content_hash=F.when(k == 3, F.sha2(F.lit("x"), 256)).otherwise(digest(root)),
        org_policy_version=F.when(k == 4, 9).otherwise(1),
        bu_policy_content_hash=F.when(
            F.col("parent_id").isNotNull(),
            F.when(k == 5, F.sha2(F.lit("y"), 256)).otherwise(digest(F.col("tenant_id"))),
        ),
        bu_policy_version=F.when(F.col("parent_id").isNotNull(), 1),
    )
    rows = q.select(
        F.col("request_id").alias("id"), "tenant_id", F.lit("dp").alias("chain"),
        F.lit("request.decided").alias("event_type"), payload.alias("payload"),
    )
    return L.check_policy_bindings(rows, policies, tenants).select("tenant_id", "id", "detail")


@query(
    "decided_records",
    f"""select request_id as ord, concat('{{"actor_id":"', actor_id, '","actor_registered":true,"applied_action":"', case when action = 'tokenize' then 'mask' else action end,
          '","bu_policy_content_hash":null,"bu_policy_version":null,"decision_action":"', action, '","degraded_reasons":[],"exception_applied":false,"finding_classes":["PAN"],"finding_paths":["messages[0].content"],"leg":"', leg,
          '","mode":"enforce","org_policy_content_hash":"', sha256(tenant_id), '","org_policy_version":1,"request_id":"', request_id, '","rule_index":', request_id % 7, ',"rule_scope":"org","truncated":false,"upstream_model":"', provider, '"}}') as payload
        from {plant_sql('requests')} q""",
)
def decided_records(spark, sf):
    q = plant(spark, sf, "requests")
    c = F.col
    rows = q.select(
        "tenant_id", c("request_id").cast("string").alias("request_id"),
        c("actor_id").cast("string").alias("actor_id"), F.lit(True).alias("registered"), "leg",
        "action",
        F.when(c("action") == "tokenize", "mask").otherwise(c("action")).alias("applied_action"),
        F.lit("enforce").alias("mode"), (c("request_id") % 7).alias("rule_index"),
        F.lit("org").alias("rule_scope"), F.lit(1).alias("org_policy_version"),
        F.sha2("tenant_id", 256).alias("org_hash"),
        F.lit(None).cast("int").alias("bu_policy_version"),
        F.lit(None).cast("string").alias("bu_hash"), F.lit(False).alias("exception_applied"),
        F.array(F.lit("PAN")).alias("finding_classes"),
        F.array(F.lit("messages[0].content")).alias("finding_paths"),
        c("provider").alias("model"), F.array().cast("array<string>").alias("degraded_reasons"),
        "ts", c("request_id").alias("ord"),
    )
    return L.decided_records(rows).select("ord", "payload")


@query(
    "event_records",
    f"""select request_id as ord, concat('{{"bu_policy_version":null,"code":"timeout","org_policy_version":1,"request_id":"', request_id, '","stage":"upstream","upstream_model":"', provider, '"}}') as payload
        from {plant_sql('requests')} q where outcome = 'failed'""",
)
def event_records(spark, sf):
    q = plant(spark, sf, "requests").filter("outcome = 'failed'")
    rows = q.select(
        "tenant_id", F.col("request_id").cast("string").alias("request_id"),
        F.lit("upstream").alias("stage"), F.lit("timeout").alias("code"),
        F.col("provider").alias("upstream_model"), F.lit(1).alias("org_policy_version"),
        F.lit(None).cast("int").alias("bu_policy_version"), "ts",
        F.col("request_id").alias("ord"),
    )
    return L.event_records("request.failed", rows).select("ord", "payload")


@query(
    "guard_records",
    """select o_orderkey, case when o_orderkey % 9 = 0 then 'forbidden field' when o_orderkey % 9 = 1 then 'entry too long' end as refused from orders""",
)
def guard_records(spark, sf):
    k = F.col("o_orderkey")
    rows = read(spark, sf, "orders").select(
        "o_orderkey",
        F.when(k % 9 == 0, F.lit('{"n":1,"nested":{"Secret":"x"}}'))
        .when(k % 9 == 1, F.concat(F.lit('{"finding_paths":["'), F.repeat(F.lit("a"), F.lit(201)), F.lit('"]}')))
        .otherwise(F.lit('{"finding_paths":["a","text"],"note":"value"}')).alias("payload"),
    )
    return L.guard_records(rows).select("o_orderkey", "refused")


@query(
    "leak_sweep",
    """with l as (select distinct text as literal from benchmark where text <> ''
         union select 'conv_id' union select 'text'),
       d as (select doc_id, text from documents), c as (select conv_id, text from conversations)
       select 'documents' as "table", literal, count(*) as rows from l join d on contains(d.text, l.literal) group by 2
       union all select 'conversations', literal, count(*) from l join c on contains(c.text, l.literal) group by 2""",
)
def leak_sweep(spark, sf):
    """Whole benchmark passages, and names of columns, searched in documents and conversations."""
    tables = {
        "documents": read(spark, sf, "documents").select("doc_id", "text"),
        "conversations": read(spark, sf, "conversations").select("conv_id", "text"),
    }
    literals = read(spark, sf, "benchmark").select(F.explode(F.array(
        "text", F.lit("conv_id"), F.lit("text"))).alias("literal"))
    return L.leak_sweep(tables, literals)


# ------------------------------------------------------------------------- spans


def _payloads(spark, sf):
    """One request body per conversation, the first turn also in nested documents."""
    held = lambda name, value: F.to_json(F.struct(value.alias(name)))
    c = read(spark, sf, "conversations")
    turns = F.transform(
        F.array_sort(F.collect_list(F.struct("turn", "role", "text"))),
        lambda t: F.struct(
            F.when(t["role"] == "system", "developer").otherwise(t["role"]).alias("role"),
            t["text"].alias("content"),
        ),
    )
    return c.groupBy("conv_id").agg(turns.alias("messages")).select(
        "conv_id",
        F.to_json(
            F.struct(
                F.lit("m-1").alias("model"),
                F.array(F.struct(F.lit("lookup").alias("name"))).alias("tools"),
                F.to_json(F.struct(F.col("messages")[0].alias("first"))).alias("arguments"),
                held("b", held("c", held("content", F.col("messages")[0]["content"]))).alias(
                    "deep"),
                "messages", F.lit(3).alias("n"),
            )
        ).alias("body"),
    )


_TURNS = "(select conv_id, turn, role, text, row_number() over (partition by conv_id order by turn) - 1 as i from conversations)"
_SPANS = f"""(select conv_id, concat('messages[', cast(i as varchar), '].content') as span_path, text,
      case role when 'system' then 'system' when 'assistant' then 'assistant' else 'user' end as origin, cast(null as varchar) as parent_path from {_TURNS} t
    union all select conv_id, concat('messages[', cast(i as varchar), '].role'), case role when 'system' then 'developer' else role end, 'metadata', null from {_TURNS} t
    union all select distinct conv_id, 'model', 'm-1', 'metadata', null from conversations
    union all select distinct conv_id, 'tools[0].name', 'lookup', 'tool_definition', null from conversations
    union all select conv_id, 'arguments$json.first.content', text, 'tool_call', 'arguments' from {_TURNS} t where i = 0
    union all select conv_id, 'deep$json.b$json.c$json.content', text, 'user', 'deep$json.b$json.c' from {_TURNS} t where i = 0
    union all select conv_id, 'arguments$json.first.role', case role when 'system' then 'developer' else role end, 'metadata', 'arguments' from {_TURNS} t where i = 0)"""


#: Strings that hold a document.
_HOLDERS = "'arguments', 'deep', 'deep$json.b', 'deep$json.b$json.c'"


@query(
    "flatten_spans",
    f"select conv_id, span_path, md5(text) as digest, origin, parent_path from {_SPANS} s",
)
def flatten_spans(spark, sf):
    """Conversations as request bodies and back to spans, documents nested three deep included."""
    s = P.flatten_spans(_payloads(spark, sf), ["conv_id"])
    # The strings that hold documents depend on JSON spelling.
    return s.filter(f"span_path not in ({_HOLDERS})").select(
        "conv_id", "span_path", F.md5("text").alias("digest"), "origin", "parent_path"
    )


@query(
    "malformed_payloads",
    "select conv_id, conv_id % 3 = 0 as malformed from conversations group by 1",
)
def malformed_payloads(spark, sf):
    p = _payloads(spark, sf).withColumn(
        "body",
        F.when(F.col("conv_id") % 3 == 0, F.expr("substring(body, 1, length(body) - 1)"))
        .otherwise(F.col("body")),
    )
    s = P.flatten_spans(p, ["conv_id"])
    return s.groupBy("conv_id").agg(F.bool_or(F.col("status") == "malformed_payload").alias("malformed"))


@query(
    "path_get",
    f"""select conv_id, i, md5(text) as digest, true as there, false as beyond from {_TURNS} t""",
)
def path_get(spark, sf):
    n = F.size(F.from_json("body", "messages array<struct<role string>>")["messages"])
    p = _payloads(spark, sf).withColumn("i", F.explode(F.sequence(F.lit(0), n - 1)))
    path = F.concat(F.lit("messages["), F.col("i"), F.lit("].content"))
    beyond = F.concat(F.lit("messages["), F.col("i"), F.lit("].missing"))
    return p.select(
        "conv_id", F.col("i").cast("bigint").alias("i"), F.md5(P.path_get(F.col("body"), path)).alias("digest"),
        P.path_exists(F.col("body"), path).alias("there"),
        P.path_exists(F.col("body"), beyond).alias("beyond"),
    )


@query(
    "safe_paths",
    "select user_id, count(*) as n, concat('messages[', cast(user_id % 4 as varchar), '].⟨seg_', "
    + Q.base32(Q.hmac(KEY, "concat('field', cast(user_id as varchar))")) + ", '⟩.text') as safe from events group by 1, 3",
)
def safe_paths(spark, sf):
    e = read(spark, sf, "events")
    path = F.concat(
        F.lit("messages["), F.col("user_id") % 4, F.lit("].field"), F.col("user_id"), F.lit(".text")
    )
    return e.select("user_id", P.safe_path(path, KEY).alias("safe")).groupBy("user_id", "safe").agg(
        F.count("*").alias("n")
    )


@query(
    "span_text_features",
    """select conv_id, turn, case when length(text) > 24 then concat(regexp_replace(regexp_replace(regexp_replace(regexp_replace(substr(text, 1, 24), '\\p{Ll}', 'a', 'g'), '\\p{Lu}', 'A', 'g'), '\\p{Nd}', '9', 'g'), '\\s', ' ', 'g'), '…') else
         regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\\p{Ll}', 'a', 'g'), '\\p{Lu}', 'A', 'g'), '\\p{Nd}', '9', 'g'), '\\s', ' ', 'g') end as shape,
         case when text = '' then 'empty' when regexp_full_match(text, '[0-9a-fA-F]+') then 'hex' when regexp_full_match(text, '[A-Za-z0-9+/=_-]+') then 'base64ish'
           when regexp_matches(text, '[ऀ-ॿ]') then 'devanagari' when regexp_full_match(text, '[\\x00-\\x7f]+') then 'ascii' else 'mixed' end as charset,
         round("""
    + Q.entropy("text") + """, 3) as entropy,
         round(length(regexp_replace(text, '[^\\x20-\\x7e\\t\\n\\r]', '', 'g')) / length(text), 6) as printable from conversations""",
)
def span_text_features(spark, sf):
    from tarnhelm.functions import text as T

    c = F.col("text")
    return read(spark, sf, "conversations").select(
        "conv_id", "turn", T.shape_of(c, 24).alias("shape"), T.charset_class(c).alias("charset"),
        F.round(F.round(T.entropy(c), 9), 3).alias("entropy"),
        F.round(T.printable_ratio(c), 6).alias("printable"),
    )


def _args():
    pairs = []
    for name, col in (("command", "command"), ("file_path", "file_path"), ("content", "content"),
                      ("path", "path_arg"), ("url", "url")):
        pairs += [F.lit(name), F.col(col)]
    return F.to_variant_object(F.map_filter(F.create_map(*pairs), lambda k, v: v != ""))


def _calls(spark, sf):
    t = plant(spark, sf, "tool_calls").withColumn("args", _args())
    tool, args = F.col("tool"), F.col("args")
    return t.withColumns(
        {
            "text": P.harvest(tool, args), "sink": P.sink_of(tool, args),
            "payload": P.payload_of(tool, args),
        }
    )


_CALLS = f"""(select session_id, ts, seq, tool, piece,
    case tool when 'Bash' then command when 'Write' then concat(content, chr(10), file_path) when 'mcp__files__read_file' then path_arg when 'WebFetch' then url else '' end as text,
    case when seq % 6 = 0 then concat('/tmp/out', cast(session_id % 3 as varchar)) when seq % 6 = 3 then '/tmp/log' when seq % 6 = 1 then file_path else '' end as sink,
    case when seq % 6 = 0 then piece when seq % 6 = 1 then content else '' end as payload from {plant_sql('tool_calls')} t)"""


@query(
    "tool_call_fields",
    f"select seq, text, sink, payload from {_CALLS} c",
)
def tool_call_fields(spark, sf):
    """Harvested text, destination and payload of every tool call."""
    return _calls(spark, sf).select("seq", "text", "sink", "payload")


@query(
    "nested_arguments",
    f"""select seq, concat('four ', piece, chr(10), tool, chr(10), 'x', piece, chr(10), cast(seq as varchar)) as text
        from {plant_sql('tool_calls')} t""",
)
def nested_arguments(spark, sf):
    """Strings in the lists and objects of a call's arguments, four levels down and no further."""
    piece, tool = F.col("piece"), F.col("tool")
    four = F.struct(F.concat(F.lit("four "), piece).alias("b"),
                    F.struct(F.lit("five").alias("lost")).alias("c"))
    args = F.to_json(F.struct(
        F.struct(F.struct(four.alias("a")).alias("deep"),
                 F.array(tool, F.concat(F.lit("x"), piece)).alias("tags")).alias("opts"),
        F.lit(3).alias("n"), F.lit(True).alias("on"), F.col("seq").cast("string").alias("path")))
    return plant(spark, sf, "tool_calls").select(
        "seq", P.harvest(F.lit("mcp__files__put"), F.try_parse_json(args)).alias("text"))


@query(
    "read_targets",
    f"""select seq, case when seq % 6 = 3 then concat('data', cast(seq % 9 as varchar), '.csv,notes', cast(session_id as varchar), '.txt,x')
          when seq % 6 = 2 then path_arg when seq % 6 = 4 then '/etc/app.conf' else '' end as targets from {plant_sql('tool_calls')} t""",
)
def read_targets(spark, sf):
    t = plant(spark, sf, "tool_calls").withColumn("args", _args())
    return t.select(
        "seq",
        F.array_join(F.array_sort(P.read_targets(F.col("tool"), F.col("args"))), ",").alias("targets"),
    )


@query(
    "harness_labels",
    """select case when event_id % 5 = 0 then 'my-harness' when event_id % 3 = 0 then 'codex' when event_id % 7 = 0 then 'claude'
         when event_id % 4 = 0 then 'openai-responses-compatible' when event_id % 4 = 1 then 'anthropic-compatible' else 'unknown' end as harness, count(*) as n from events group by 1""",
)
def harness_labels(spark, sf):
    k = F.col("event_id")
    e = read(spark, sf, "events").select(
        P.harness_of(
            F.when(k % 5 == 0, " My-Harness "),
            F.when(k % 3 == 0, "Codex/1 (claude)").when(k % 7 == 0, "Claude-Client"),
            F.when(k % 4 == 0, "/v1/responses").when(k % 4 == 1, "/v1/messages").otherwise("/x"),
        ).alias("harness")
    )
    return e.groupBy("harness").agg(F.count("*").alias("n"))


@query(
    "transcript_turns",
    "select conv_id, turn, md5(text) as digest from conversations where role = 'user' and length(trim(text)) > 3",
)
def transcript_turns(spark, sf):
    """Conversations as transcript lines, and the user turns read back."""
    c = read(spark, sf, "conversations")
    block = F.to_json(
        F.struct(
            F.col("role").alias("type"),
            F.struct(
                F.array(
                    F.struct(F.lit("text").alias("type"), F.col("text").alias("text"))
                ).alias("content")
            ).alias("message"),
        )
    )
    plain = F.to_json(
        F.struct(F.col("role").alias("type"), F.struct(F.col("text").alias("content")).alias("message"))
    )
    lines = c.select(
        "conv_id", "turn", F.when(F.col("turn") % 2 == 0, block).otherwise(plain).alias("value")
    )
    broken = c.select("conv_id", "turn", F.lit("{not json").alias("value"))
    return RD.parse_transcripts(lines.unionByName(broken)).select(
        "conv_id", "turn", F.md5("text").alias("digest")
    )


@query(
    "document_shapes",
    "select case when doc_id % 4 = 3 then concat('doc[', cast(doc_id as varchar), ']') when doc_id % 2 = 0 then cast(doc_id as varchar) else source end as doc_id, md5(text) as digest from documents",
)
def document_shapes(spark, sf):
    k = F.col("doc_id")
    d = read(spark, sf, "documents").select(
        F.when(k % 2 == 0, k.cast("string")).alias("id"),
        F.when(k % 4 == 1, F.col("source")).alias("source"), k.alias("n"),
        F.when(k % 3 == 0, F.col("text")).otherwise("").alias("text"),
        F.when(k % 3 == 1, F.col("text")).alias("content"),
        F.when(k % 3 == 2, F.col("text")).alias("page_content"),
    )
    return RD.read_documents(d, "n").select("doc_id", F.md5("text").alias("digest"))


def _has_fragment(text: str, window: int = 64) -> str:
    """Number of runs that look like a piece of a secret."""
    run = S.RUN.strip("()")
    return (
        f"len(list_filter(regexp_extract_all({text}, {Q.lit(run)}), "
        f"lambda r: regexp_matches(right(r, {window}), {Q.lit(S.PARTIAL_ANCHOR)})))"
    )


_GRADES = """round(v, 3) as risk, case when v >= 0.75 then 'high' when v >= 0.35 then 'medium' else 'low' end as band,
        cast(case when v >= 0.75 then 10 when v >= 0.35 then 6 else 3 end as int) as fragments, v >= 0.75 as escalate"""


def _wide_risk_sql(blocked: str, calls: str) -> str:
    """Session risk without limits: decayed sums over the pairs of two days in a session.

    What is older has faded by 2 ** -144.
    """
    return f"""(
      with e as (select session_id, seq, ts, epoch(ts) as tsec, cast({_has_fragment('text', 4096)} > 0 as int) as frag,
          cast(regexp_matches(text, '[A-Za-z0-9+/=_-]{{16}}') as int) as ent, cast({blocked} as int) as blk,
          regexp_extract_all(text, '>>\s*(\S+)', 1)[1] as tgt, lag(epoch(ts)) over (partition by session_id order by ts, seq) as p from {calls} c),
      g as (select *, sum(case when p is null or tsec - p > 7200 then 1 else 0 end) over (partition by session_id order by ts, seq) as seg from e),
      o as (select *, cast(tgt is not null and row_number() over (partition by session_id, seg, tgt order by ts, seq) > 1 as int) as rep from g),
      d as (select a.session_id, a.seq, sum(b.frag * w) as f, sum(b.rep * w) as r, sum(b.ent * w) as n, sum(b.blk * w) as k from o a
        join (select * from o) b on b.session_id = a.session_id and b.seg = a.seg and (b.ts < a.ts or (b.ts = a.ts and b.seq <= a.seq)) and a.tsec - b.tsec < 172800,
        lateral (select power(0.5, (a.tsec - b.tsec) / 1200.0) as w) x group by 1, 2)
      select session_id, seq, {_GRADES}
      from (select *, least(1.0, 0.30 * least(round(f, 12), 4) + 0.18 * least(round(r, 12), 4) + 0.05 * least(round(n, 12), 4) + 0.25 * least(round(k, 12), 2)) as v from d) z)"""


def _risk_sql(blocked: str, calls: str | None = None) -> str:
    """Session risk after every call, one recursion step per event of a session."""
    return f"""(
      with recursive e as (select session_id, seq, epoch(ts) as tsec, cast({_has_fragment('text')} > 0 as int) as frag,
          cast(regexp_matches(text, '[A-Za-z0-9+/=_-]{{16}}') as int) as ent, cast({blocked} as int) as blk,
          regexp_extract_all(text, '>>\\s*(\\S+)', 1)[1] as tgt, row_number() over (partition by session_id order by ts, seq) as k from {calls or _CALLS} c),
      st as (
        select distinct session_id, cast(0 as bigint) as k, cast(-1 as bigint) as seq, cast(null as double) as tsec,
          0.0::double as f, 0.0::double as r, 0.0::double as n, 0.0::double as b, []::varchar[] as targets from e
        union all
        select session_id, k, seq, tsec, f0 * w + frag, r0 * w + (case when tgt is not null and list_contains(t0, tgt) then 1 else 0 end), n0 * w + ent, b0 * w + blk,
          case when tgt is null or list_contains(t0, tgt) then t0 else list_append(t0, tgt)[-8:] end
        from (select e.*, case when s.tsec is null or e.tsec - s.tsec > 7200 then 1.0 else power(0.5, greatest(e.tsec - s.tsec, 0) / 1200.0) end as w,
            case when s.tsec is null or e.tsec - s.tsec > 7200 then 0 else s.f end as f0, case when s.tsec is null or e.tsec - s.tsec > 7200 then 0 else s.r end as r0,
            case when s.tsec is null or e.tsec - s.tsec > 7200 then 0 else s.n end as n0, case when s.tsec is null or e.tsec - s.tsec > 7200 then 0 else s.b end as b0,
            case when s.tsec is null or e.tsec - s.tsec > 7200 then [] else s.targets end as t0
          from st s join e on e.session_id = s.session_id and e.k = s.k + 1) x)
      select session_id, seq, {_GRADES}
      from (select *, greatest(0.0, least(1.0, 0.30 * least(f, 4) + 0.18 * least(r, 4) + 0.05 * least(n, 4) + 0.25 * least(b, 2))) as v from st where k > 0) z)"""


# ---------------------------------------------------------------------- sessions


@query("session_risk", f"select * from {_risk_sql('seq % 40 = 0')} r")
def session_risk(spark, sf):
    calls = _calls(spark, sf).withColumn("blocked", F.col("seq") % 40 == 0)
    return S.session_risk(calls, limits=S.UPSTREAM)


_BUSY = """(select user_id % 10 as session_id, ts, event_id as seq,
    case when event_id % 3 = 0 then concat('echo sk-an >> /tmp/f', cast(event_id % 40 as varchar)) when event_id % 7 = 0 then 'run abcdefgh12345678XYZ' else event_type end as text from events)"""


@query("session_risk_wide", f"select * from {_wide_risk_sql('seq % 40 = 0', _BUSY)} r")
def session_risk_wide(spark, sf):
    """Ten busy sessions that write to forty destinations, all of which are remembered."""
    k = F.col("event_id")
    busy = read(spark, sf, "events").select(
        (F.col("user_id") % 10).alias("session_id"), "ts", k.alias("seq"),
        F.when(k % 3 == 0, F.concat(F.lit("echo sk-an >> /tmp/f"), k % 40))
        .when(k % 7 == 0, "run abcdefgh12345678XYZ").otherwise(F.col("event_type")).alias("text"),
        (k % 40 == 0).alias("blocked"),
    )
    return S.session_risk(busy)


@query(
    "risk_signals",
    f"""select seq, regexp_matches(text, '[A-Za-z0-9+/=_-]{{16}}') as had_entropy,
          len(regexp_extract_all(text, '>>\\s*(\\S+)', 1)) as appends from {_CALLS} c""",
)
def risk_signals(spark, sf):
    return S.risk_inputs(_calls(spark, sf), limits=S.UPSTREAM).select(
        "seq", "had_entropy", F.size("targets").cast("bigint").alias("appends")
    )


def _sink_rows(window: int) -> str:
    return f"""(select *, sum(case when prev is null or epoch(ts) - epoch(prev) > 3600 then 1 else 0 end) over (partition by session_id, sink order by ts, seq) as seg
    from (select *, lag(ts) over (partition by session_id, sink order by ts, seq) as prev, {_has_fragment('payload', window)} > 0 as starts
      from {_CALLS} c where sink <> '' and trim(payload) <> '') p)"""


_SINK_ROWS = _sink_rows(64)


def _assembled_sql(pieces: int | None, window: int) -> str:
    """Pieces of this input stay below the limit of characters, so their number decides alone."""
    frame = "unbounded" if pieces is None else str(pieces - 1)
    return f"""(select session_id, sink, seq, pieces, assembled from (
    select session_id, sink, seq, cast(count(*) over w as int) as pieces, string_agg(payload, '') over w as assembled from (
      select *, bool_or(starts) over (partition by session_id, sink, seg order by ts, seq) as started from {_sink_rows(window)} s0) s1 where started
    window w as (partition by session_id, sink, seg order by ts, seq rows between {frame} preceding and current row)) s2 where pieces >= 2)"""


_ASSEMBLED = _assembled_sql(12, 64)


@query(
    "sink_assembly",
    f"select session_id, sink, seq, pieces, md5(assembled) as digest from {_ASSEMBLED} a",
)
def sink_assembly(spark, sf):
    """Assembled writes per destination, by length and digest."""
    return S.sink_assembly(_calls(spark, sf), S.UPSTREAM).select(
        "session_id", "sink", "seq", "pieces", F.md5("assembled").alias("digest")
    )


@query(
    "sink_assembly_wide",
    """select c_custkey as session_id, 16 as pieces, md5(concat('sk-ant-api03-', h, substr(upper(h), 1, 19))) as digest,
         'ANTHROPIC_KEY' as classes from (select c_custkey, md5(cast(c_custkey as varchar)) as h from customer) c""",
)
def sink_assembly_wide(spark, sf):
    """A key of 64 characters written in 16 pieces: more than the upstream puts together."""
    h = F.md5(F.col("c_custkey").cast("string"))
    key = F.concat(F.lit("sk-ant-api03-"), h, F.left(F.upper(h), F.lit(19)))
    who = spread(read(spark, sf, "customer").select("c_custkey"), task_bytes=KEY_BYTES)
    calls = who.select(
        F.col("c_custkey").alias("session_id"), key.alias("key"),
        F.explode(F.sequence(F.lit(0), F.lit(15))).alias("seq"),
    ).select(
        "session_id", "seq", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("seq") * 60).alias("ts"),
        F.lit("/tmp/parts").alias("sink"),
        F.substring("key", F.col("seq") * 4 + 1, F.lit(4)).alias("payload"))
    whole = S.sink_assembly(calls).where(F.col("seq") == 15)
    named = S.assembled_secrets(whole.withColumn("digest", F.md5("assembled")))
    return named.select("session_id", "pieces", "digest", F.array_join("classes", ",").alias("classes"))


@query(
    "sink_segments",
    f"select session_id, sink, count(*) as writes, max(seg)::bigint as segments from {_SINK_ROWS} s group by 1, 2",
)
def sink_segments(spark, sf):
    """Writes per destination and the runs that a pause of an hour separates."""
    c = _calls(spark, sf).filter("sink <> '' and trim(payload) <> ''").select(
        "session_id", "sink", "seq", S.seconds(F.col("ts")).alias("at")
    )
    cut = S.split_on_gap(c, ["session_id", "sink"], ["at", "seq"], "at", S.BRIDGE_TTL)
    return cut.groupBy("session_id", "sink").agg(
        F.count("*").alias("writes"), F.countDistinct("_segment").alias("segments")
    )


def _prompts(spark, sf):
    """Turns of conversations as prompts; a key is split over some neighbours."""
    c = read(spark, sf, "conversations")
    key = F.concat(F.lit("sk-ant-api03-"), F.md5(F.col("conv_id").cast("string")))
    hot = F.col("conv_id") % 5 == 0
    text = (
        F.when(hot & (F.col("turn") == 1), F.concat(F.lit("my key starts "), F.substring(key, 1, 20)))
        .when(hot & (F.col("turn") == 2), F.substring(key, 21, 40))
        .otherwise(F.col("text"))
    )
    return c.select(
        F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("turn") * 60).alias("ts"),
        text.alias("text"),
    )


@query(
    "prompt_bridge_hits",
    """select conv_id as session_id, turn as seq, 'ANTHROPIC_KEY' as classes from conversations c where conv_id % 5 = 0 and turn = 2
       and exists (select 1 from conversations p where p.conv_id = c.conv_id and p.turn = 1)""",
)
def prompt_bridge_hits(spark, sf):
    """Secrets split over two prompts."""
    return S.prompt_bridge(_prompts(spark, sf), limits=S.UPSTREAM).filter("split").select(
        "session_id", "seq", "classes"
    )


def _whispered(prompts):
    """Sixteen prompts per customer with four characters of a key each."""
    h = F.md5(F.col("c_custkey").cast("string"))
    key = F.concat(F.lit("sk-ant-api03-"), h, F.left(F.upper(h), F.lit(19)))
    return prompts.select(
        F.col("c_custkey").alias("session_id"), key.alias("key"),
        F.explode(F.sequence(F.lit(0), F.lit(15))).alias("seq"),
    ).select(
        "session_id", "seq", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("seq") * 60).alias("ts"),
        F.substring("key", F.col("seq") * 4 + 1, F.lit(4)).alias("text"))


#: The seventh prompt completes the twenty characters that a key needs.
_WHISPERED = "select c_custkey as session_id, 6 as seq, 'ANTHROPIC_KEY' as classes from customer"


@query("prompt_bridge_wide", _WHISPERED)
def prompt_bridge_wide(spark, sf):
    """A key spread over more prompts than the upstream carries a tail over."""
    who = spread(read(spark, sf, "customer").select("c_custkey"), task_bytes=KEY_BYTES)
    return S.prompt_bridge(_whispered(who)).filter("split").select(
        "session_id", "seq", "classes")


_RUNS = S.RUN.strip("()")


@query(
    "fragment_bridge",
    f"""select session_id, seq, cast(least(lag_frags, 3) * runs as int) as joins from (
          select session_id, seq, least(len(regexp_extract_all(text, {Q.lit(_RUNS)})), 24) as runs, epoch(ts) as tsec,
            lag({_has_fragment('text')}) over (partition by session_id order by ts, seq) as lag_frags,
            lag(epoch(ts)) over (partition by session_id order by ts, seq) as before from {_CALLS} c) t
        where lag_frags > 0 and tsec - before <= 3600""",
)
def fragment_bridge(spark, sf):
    return S.fragment_bridge(_calls(spark, sf), limits=S.UPSTREAM).select(
        "session_id", "seq", F.size("joins").alias("joins")
    )


@query(
    "fragment_bridge_wide",
    f"""select session_id, seq, cast(lag_frags * runs as int) as joins from (
          select session_id, seq, len(regexp_extract_all(text, {Q.lit(_RUNS)})) as runs, epoch(ts) as tsec,
            lag({_has_fragment('text', 4096)}) over (partition by session_id order by ts, seq) as lag_frags,
            lag(epoch(ts)) over (partition by session_id order by ts, seq) as before from {_CALLS} c) t
        where lag_frags > 0 and tsec - before <= 3600""",
)
def fragment_bridge_wide(spark, sf):
    return S.fragment_bridge(_calls(spark, sf)).select(
        "session_id", "seq", F.size("joins").alias("joins"))


@query(
    "call_trace_wide",
    f"""select c.tool, false as own_block, coalesce(a.hit, false) as split, not coalesce(a.hit, false) as allow, r.band, count(*) as calls
        from {_CALLS} c join {_wide_risk_sql('false', _CALLS)} r on r.session_id = c.session_id and r.seq = c.seq
        left join (select session_id, seq, regexp_matches(assembled, 'sk-ant-[A-Za-z0-9_-]{{20,}}') as hit from {_assembled_sql(None, 4096)} a0) a
          on a.session_id = c.session_id and a.seq = c.seq group by all""",
)
def call_trace_wide(spark, sf):
    """Verdicts per call when every piece of a write and every destination is carried."""
    return S.call_trace(_calls(spark, sf)).groupBy("tool", "own_block", "split", "allow", "band").agg(
        F.count("*").alias("calls"))


@query(
    "call_trace",
    f"""select c.tool, false as own_block, coalesce(a.hit, false) as split, not coalesce(a.hit, false) as allow, r.band, count(*) as calls
        from {_CALLS} c join {_risk_sql('false')} r on r.session_id = c.session_id and r.seq = c.seq
        left join (select session_id, seq, regexp_matches(assembled, 'sk-ant-[A-Za-z0-9_-]{{20,}}') as hit from {_ASSEMBLED} a0) a
          on a.session_id = c.session_id and a.seq = c.seq group by all""",
)
def call_trace(spark, sf):
    return S.call_trace(_calls(spark, sf), limits=S.UPSTREAM).groupBy("tool", "own_block", "split", "allow", "band").agg(
        F.count("*").alias("calls")
    )


_SHAPE = "list_filter(regexp_extract_all(c.text, " + Q.lit(_RUNS) + "), lambda r: regexp_matches(right(r, 64), " + Q.lit(S.PARTIAL_ANCHOR) + "))[1:3]"


@query(
    "risk_records",
    f"""select substr(cast(c.session_id as varchar), 1, 8) as session, c.seq, c.tool, r.risk, r.band,
          array_to_string(list_transform({_SHAPE}, lambda x: regexp_replace(regexp_replace(regexp_replace(x, '[a-z]', 'a', 'g'), '[A-Z]', 'A', 'g'), '[0-9]', '9', 'g')), ',') as shapes
        from {_CALLS} c join {_risk_sql('true')} r on r.session_id = c.session_id and r.seq = c.seq where r.escalate""",
)
def risk_records(spark, sf):
    calls = _calls(spark, sf).withColumn("blocked", F.lit(True))
    out = S.risk_records(calls, S.session_risk(calls, limits=S.UPSTREAM), limits=S.UPSTREAM)
    return out.withColumn("shapes", F.array_join("shapes", ","))


def _scratch(spark) -> str:
    """A folder that all executors share, below the one the cluster names."""
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def _stream_table(spark, stream, name: str):
    """Run a bounded stream to its end into files and read them back."""
    path = _scratch(spark)
    q = (
        stream.writeStream.format("parquet").outputMode("append")
        .option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True)
        .start(f"{path}/{name}")
    )
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/{name}")


def _dealt(stream, key: str):
    """A file is read by few tasks; rows are dealt to all cores before their texts are built."""
    return stream.repartition(stream.sparkSession.sparkContext.defaultParallelism * 4, key)


def _event_stream(spark, sf):
    schema = read(spark, sf, "events").schema
    s = spark.readStream.schema(schema).parquet(f"{sf}/events*.parquet")
    return _dealt(s.select("event_id", "ts", "user_id", "event_type"), "event_id")


@query(
    "coverage_stream",
    """select time_bucket(interval '5 minutes', ts) as window_start, event_type as harness, count(*) as requests,
         count(*) filter (event_id % 4 = 0) as blocked, max(ts) as last_seen from events group by 1, 2""",
)
def coverage_stream(spark, sf):
    """Coverage counters of every window, the open ones too, from a stream over the events."""
    from tarnhelm.streaming.sessions import CoverageTable

    k = F.col("event_id")
    s = _event_stream(spark, sf).select(
        "ts", F.col("event_type").alias("harness"), F.lit("/v1").alias("route"),
        F.lit("p").alias("provider"), F.lit("http").alias("channel"),
        F.when(k % 4 == 0, "blocked").otherwise("allowed").alias("outcome"),
    )
    path = _scratch(spark)
    table = CoverageTable(f"{path}/coverage")
    q = s.writeStream.foreachBatch(table.write).option(
        "checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return table.windows(spark).select(
        F.col("window.start").alias("window_start"), "harness", "requests", "blocked",
        F.col("last_seen").cast("timestamp_ntz").alias("last_seen"))


_STREAM_CALLS = """(select user_id as session_id, ts, event_id as seq,
    case when event_id % 6 = 0 then concat('echo sk-an >> /tmp/f', cast(user_id % 3 as varchar)) else event_type end as text from events)"""


@query("session_risk_stream", f"select * from {_risk_sql('false', _STREAM_CALLS)} r")
def session_risk_stream(spark, sf):
    """Session risk computed by a stream over the event file."""
    from tarnhelm.streaming.sessions import risk_stream

    k = F.col("event_id")
    s = _event_stream(spark, sf).select(
        F.col("user_id").alias("session_id"), "ts", k.alias("seq"),
        F.when(k % 6 == 0, F.concat(F.lit("echo sk-an >> /tmp/f"), F.col("user_id") % 3))
        .otherwise(F.col("event_type")).alias("text"),
    )
    return _stream_table(spark, risk_stream(s, limits=S.UPSTREAM), "risk")


@query(
    "sink_stream",
    "select user_id as session_id, event_id as seq, cast(k as int) as pieces, md5(concat('sk-ant-', repeat('x', k - 1))) as digest from "
    "(select *, row_number() over (partition by user_id order by event_id) as k from events) e where k between 2 and 40",
)
def sink_stream(spark, sf):
    """Assemblies of a stream: an anchor, then a character a minute, up to forty writes a user.

    The event file is read as a stream; every user's first forty events make one file grow.
    """
    from tarnhelm.streaming import sessions as ST

    nth = read(spark, sf, "events").select(
        "user_id", "event_id",
        F.row_number().over(W.partitionBy("user_id").orderBy("event_id")).alias("k"))
    s = _event_stream(spark, sf).join(nth.where("k <= 40"), ["user_id", "event_id"]).select(
        F.col("user_id").alias("session_id"), F.col("event_id").alias("seq"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("k") * 60).alias("ts"),
        F.lit("/tmp/parts").alias("sink"),
        F.when(F.col("k") == 1, "sk-ant-").otherwise("x").alias("payload"))
    return _stream_table(spark, ST.sink_stream(s), "sinks").select(
        "session_id", "seq", "pieces", F.md5("assembled").alias("digest"))


@query("bridge_stream", _WHISPERED)
def bridge_stream(spark, sf):
    """Keys spread over many prompts, found by a stream over the customers' prompts."""
    from tarnhelm.streaming import sessions as ST

    schema = read(spark, sf, "customer").schema
    who = spark.readStream.schema(schema).parquet(f"{sf}/customer*.parquet").select("c_custkey")
    s = _whispered(_dealt(who, "c_custkey"))
    return _stream_table(spark, ST.bridge_stream(s), "joins").where("split").select(
        "session_id", "seq", "classes")
