"""Registered evaluation, learning and report queries with their reference SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnhelm.operators import detect as D
from tarnhelm.operators import evaluate as E
from tarnhelm.operators import learned as LR
from tarnhelm.plans import sqlkit as Q
from tarnhelm.plans.governance import rules_df
from tarnhelm.plans.plants import plant, plant_sql, read
from tarnhelm.operators.detect import BASELINE_KEY_RULES
from tarnhelm.sources import readers as RD
from tarnhelm.sources.stored import keep

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


_REQ = plant_sql("requests")
_REC = plant_sql("records")
_F = f"(select request_id as record_id, * from {plant_sql('line_findings')} f0)"
_QUIET = "(" + ", ".join(f"'{s}'" for s in E.QUIET_SCENARIOS) + ")"


def _csv(col):
    return F.filter(F.split(col, ","), lambda x: x != "")


def _records(spark, sf):
    return plant(spark, sf, "records").select(
        "record_id", "scenario", _csv("expect_csv").alias("expect"),
        _csv("readonly_csv").alias("expect_readonly"), "expect_action", "variant",
    )


def _findings(spark, sf):
    return plant(spark, sf, "line_findings").withColumnRenamed("request_id", "record_id")


def _decisions(spark, sf):
    return plant(spark, sf, "requests").select(
        F.col("request_id").alias("record_id"), "action", "status"
    )


@query(
    "coverage",
    f"""select harness, route, provider, channel, count(*) as requests, count(*) filter (outcome not in ('blocked', 'failed')) as allowed,
          count(*) filter (outcome = 'blocked') as blocked, count(*) filter (outcome = 'failed') as failed, max(ts) as last_seen from {_REQ} q group by 1, 2, 3, 4""",
)
def coverage(spark, sf):
    return E.coverage(plant(spark, sf, "requests"))


@query(
    "coverage_totals",
    f"select count(*) as total_requests, count(*) filter (harness = 'unknown') as unclassified_requests from {_REQ} q",
)
def coverage_totals(spark, sf):
    return E.coverage_totals(E.coverage(plant(spark, sf, "requests")))


@query(
    "detector_quality",
    f"""with x as (select record_id, scenario, unnest(string_split(expect_csv, ',')) as entity_class from {_REC} r where expect_csv <> ''),
        f as (select record_id, entity_class, bool_or(not advisory_only) as enf from {_F} f group by 1, 2),
        h as (select x.entity_class, count(*) as expected, count(f.record_id) as found from x left join f on f.record_id = x.record_id and f.entity_class = x.entity_class group by 1),
        p as (select f.entity_class, count(*) as fp from f join {_REC} r on r.record_id = f.record_id where f.enf and r.scenario in {_QUIET} group by 1),
        q as (select h.*, expected - found as missed, coalesce(fp, 0) as false_positives, round(found / expected, 6) as recall,
            case when found + coalesce(fp, 0) > 0 then round(found / (found + coalesce(fp, 0)), 6) end as "precision" from h left join p on p.entity_class = h.entity_class)
        select entity_class, expected, found, missed, recall, false_positives, "precision",
          case when recall > 0 and "precision" > 0 then round(2 * recall * "precision" / (recall + "precision"), 6) end as f1 from q""",
)
def detector_quality(spark, sf):
    return E.weakest_first(E.detector_quality(_records(spark, sf), _findings(spark, sf)))


@query(
    "false_positive_rate",
    f"""with q as (select r.record_id, exists (select 1 from {_F} f where f.record_id = r.record_id and not f.advisory_only) as fp from {_REC} r where scenario in {_QUIET})
        select count(*) as quiet_records, count(*) filter (fp) as flagged_records, round(count(*) filter (fp) / count(*), 8) as false_positive_rate from q""",
)
def false_positive_rate(spark, sf):
    return E.false_positive_rate(_records(spark, sf), _findings(spark, sf))


@query(
    "integrity",
    f"""select count(*) filter (expect_action = 'block') as credential_records, count(*) filter (expect_action = 'block' and q.action <> 'block') as credential_not_blocked,
          count(*) filter (readonly_csv <> '' and q.action = 'block') as tool_definition_enforced,
          round(1 - count(*) filter (expect_action = 'block' and q.action <> 'block') / greatest(count(*) filter (expect_action = 'block'), 1), 6) as credential_block_rate
        from {_REC} r join {_REQ} q on q.request_id = r.record_id""",
)
def integrity(spark, sf):
    return E.integrity(_records(spark, sf), _decisions(spark, sf))


@query(
    "evasion_matrix",
    f"""with d as (select distinct r.record_id from {_REC} r join {_F} f on f.record_id = r.record_id where list_contains(string_split(r.expect_csv, ','), f.entity_class))
        select scenario, variant, count(*) as records, count(d.record_id) as detected, count(*) filter (q.action = 'block') as blocked,
          round(count(d.record_id) / count(*), 6) as detection_rate, round(count(*) filter (q.action = 'block') / count(*), 6) as block_rate
        from {_REC} r left join d on d.record_id = r.record_id join {_REQ} q on q.request_id = r.record_id where variant is not null group by 1, 2""",
)
def evasion_matrix(spark, sf):
    return E.evasion_matrix(_records(spark, sf), _findings(spark, sf), _decisions(spark, sf))


@query(
    "scenario_enforcement",
    f"""select scenario, count(*) as records, count(*) filter (q.status in ('blocked', 'redacted')) as enforced, round(count(*) filter (q.status in ('blocked', 'redacted')) / count(*), 6) as rate
        from {_REC} r join {_REQ} q on q.request_id = r.record_id group by 1""",
)
def scenario_enforcement(spark, sf):
    return E.scenario_enforcement(_records(spark, sf), _decisions(spark, sf))


_PAIRS = f"""(select pair, count(*) as n from (select array_to_string(list_sort(list_distinct(list(entity_class))), '+') as pair, count(distinct entity_class) as k
    from {_F} f where not advisory_only group by record_id, span_path, start, "end") t where k > 1 group by 1)"""


@query("offset_collisions", f"select pair, n from {_PAIRS} p")
def offset_collisions(spark, sf):
    return E.offset_collisions(_findings(spark, sf), ["record_id", "span_path"])


@query("top_collisions", f"select pair, n from {_PAIRS} p order by n desc, pair limit 20")
def top_collisions(spark, sf):
    c = E.offset_collisions(_findings(spark, sf), ["record_id", "span_path"])
    return E.top_k(c, "n", 20, ["pair"])


def _dist_sql() -> str:
    parts = []
    for d, expr in (
        ("entity_class", "entity_class"), ("family", "family"), ("stage", "stage"),
        ("detector", "detector"), ("origin", "origin"),
        ("confidence", "printf('%.1f', round(confidence, 1))"),
        ("span_path", "span_path"),
    ):
        parts.append(
            f"select '{d}' as dimension, {expr} as value, count(*) as n, round(count(*) / sum(count(*)) over (), 6) as share from {_F} f group by 2"
        )
    return " union all ".join(parts)


@query("finding_distributions", _dist_sql())
def finding_distributions(spark, sf):
    return E.distributions(_findings(spark, sf))


@query(
    "latency_quantiles",
    f"""select quantile_cont(latency, 0.5) as p50, quantile_cont(latency, 0.9) as p90, quantile_cont(latency, 0.95) as p95, quantile_cont(latency, 0.99) as p99,
          quantile_cont(latency, 0.999) as p999, round(avg(latency), 2) as mean, max(latency) as max from {_REQ} q""",
)
def latency_quantiles(spark, sf):
    return E.latency_quantiles(plant(spark, sf, "requests"), exact=True)


@query(
    "latency_sketches",
    f"""select env, quantile, count(*) as n, max(latency) as max, true as within
        from {_REQ} q, (select unnest([0.5, 0.9, 0.95, 0.99, 0.999])::double as quantile) m
        where extract(year from ts) between 1993 and 1996 group by 1, 2""",
)
def latency_sketches(spark, sf):
    """Stored sketches of each hour merged over four years; each quantile against all values: is
    its place among them within the stated rank error?"""
    requests = plant(spark, sf, "requests").withColumn("ts", F.col("ts").cast("timestamp"))
    year = lambda c: F.year(c).between(1993, 1996)
    stored = keep(E.hourly_sketches(requests, ["env"]))
    found = E.merged_quantiles(stored.where(year("hour")), ["env"])
    below = requests.where(year("ts")).join(F.broadcast(found), "env").groupBy(
        "env", "quantile", "n", "max").agg(
        F.avg((F.col("latency") < F.col("value")).cast("double")).alias("low"),
        F.avg((F.col("latency") <= F.col("value")).cast("double")).alias("high"))
    q = F.col("quantile")
    return below.select("env", "quantile", "n", "max", (
        (F.col("low") <= q + E.RANK_ERROR) & (F.col("high") >= q - E.RANK_ERROR)).alias("within"))


@query(
    "hourly_traffic",
    """with h as (select cast(hour(ts) as int) as hour, count(*) as total, count(*) filter (event_type = 'error') as blocked, count(*) filter (event_type = 'click') as redacted from events group by 1)
       select hour, total, blocked, redacted, total - blocked - redacted as clean, round(total / max(total) over (), 4) as share from h""",
)
def hourly_traffic(spark, sf):
    e = F.col("event_type")
    return E.hourly(
        read(spark, sf, "events").withColumn(
            "status", F.when(e == "error", "blocked").when(e == "click", "redacted").otherwise("clean")
        )
    )


@query(
    "environments",
    f"""select env, count(*) as records, count(*) filter (action = 'allow') as allow, count(*) filter (action = 'warn') as warn, count(*) filter (action = 'tokenize') as tokenize,
          count(*) filter (action = 'mask') as mask, count(*) filter (action = 'block') as block, round(count(*) filter (action in ('block', 'tokenize', 'mask')) / count(*), 6) as intervention_rate,
          case when env = 'production' then 'enforce' else 'shadow' end as mode from {_REQ} q group by env""",
)
def environments(spark, sf):
    return E.environments(plant(spark, sf, "requests"))


@query("actions_by_role", f"select role, action, count(*) as n from {_REQ} q group by 1, 2")
def actions_by_role(spark, sf):
    return E.by_role(plant(spark, sf, "requests"))


@query(
    "key_name_frequency",
    """with k as (select concat('n', cast(c_nationkey % 5 as varchar)) as tenant_id, lower(concat('Field', cast(o_orderkey % 97 as varchar))) as key_name from orders join customer on o_custkey = c_custkey
         where o_orderkey % 11 <> 0), c as (select tenant_id, key_name, count(*) as n from k group by 1, 2)
       select * from (select *, cast(row_number() over (partition by tenant_id order by n desc, key_name) as int) as rank from c) t where rank <= 40""",
)
def key_name_frequency(spark, sf):
    o = read(spark, sf, "orders").join(
        read(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")
    )
    f = o.select(
        F.concat(F.lit("n"), (F.col("c_nationkey") % 5).cast("string")).alias("tenant_id"),
        F.when(F.col("o_orderkey") % 11 == 0, "«opaque»").otherwise(
            F.concat(F.lit(" Field"), (F.col("o_orderkey") % 97).cast("string"))
        ).alias("key_name"),
    )
    return LR.key_names(f)


@query(
    "deployment_profile",
    f"select distinct tenant_id, entity_class from (select tenant_id, unnest(string_split(class_csv, ',')) as entity_class from {plant_sql('rules')} r) t where entity_class <> ''",
)
def deployment_profile(spark, sf):
    return LR.deployment_profile(rules_df(spark, sf))


def _proposals(spark, sf):
    none = F.array().cast("array<string>")
    k = F.col("o_orderkey")
    return read(spark, sf, "orders").select(
        F.when(k % 5 == 0, "NOPE").when(k % 3 == 0, "PAN").otherwise("EMAIL").alias("entity_class"),
        F.lit("r").alias("rationale"), none.alias("anchors"),
        F.concat(F.lit("key"), (F.col("o_custkey") % 300).cast("string"), F.lit("=[0-9]+")).alias("pattern"),
        F.lit(8).alias("min_len"), F.lit(64).alias("max_len"), F.lit(None).cast("string").alias("charset"),
        none.alias("context"), F.lit(None).cast("string").alias("checksum"), F.lit(0.9).alias("confidence"),
    )


def _known_rules(spark, sf):
    """Rules learned before: one per part key, without support from proposals yet."""
    none = F.array().cast("array<string>")
    k = F.col("p_partkey")
    return read(spark, sf, "part").select(
        F.lit("EMAIL").alias("entity_class"), F.lit("r").alias("rationale"), none.alias("anchors"),
        F.concat(F.lit("key"), (k % 300).cast("string"), F.lit("=[0-9]+")).alias("pattern"),
        F.lit(8).alias("min_len"), F.lit(64).alias("max_len"), F.lit(None).cast("string").alias("charset"),
        none.alias("context"), F.lit(None).cast("string").alias("checksum"),
        F.lit(0.5).alias("confidence"), F.lit(1).cast("bigint").alias("support"),
    ).dropDuplicates(["pattern"])


_ACCRUED = """(select entity_class, pattern, sum(support)::bigint as support, min(case when old then 0.5 else 0.65 end)::double as confidence from (
    select case when o_orderkey % 3 = 0 then 'PAN' else 'EMAIL' end as entity_class, concat('key', cast(o_custkey % 300 as varchar), '=[0-9]+') as pattern, 1 as support, false as old
      from orders where o_orderkey % 5 <> 0
    union all select distinct 'EMAIL', concat('key', cast(p_partkey % 300 as varchar), '=[0-9]+'), 1, true from part) t group by 1, 2)"""


@query(
    "accrue_support",
    f"select concat(entity_class, ':', pattern, ':') as rule_key, confidence, support from {_ACCRUED} a where entity_class = 'EMAIL'",
)
def accrue_support(spark, sf):
    """Support per rule; proposals outside the deployment's classes are dropped."""
    profile = rules_df(spark, sf).select(F.explode("class").alias("entity_class")).filter(
        "entity_class = 'EMAIL'"
    )
    return LR.accrue_support(_known_rules(spark, sf), _proposals(spark, sf), profile).select(
        "rule_key", "confidence", "support"
    )


@query(
    "save_learned",
    f"select concat(entity_class, ':', pattern, ':') as rule_key, support from {_ACCRUED} a where support >= 2 order by support desc, rule_key",
)
def save_learned(spark, sf):
    rules = LR.accrue_support(_known_rules(spark, sf), _proposals(spark, sf))
    return LR.save_learned(rules).select("rule_key", "support")


@query(
    "traffic_report",
    """with t as (select doc_id, source, length(text) as chars, contains(text, 'token = ') as red from documents)
       select count(*) as turns, count(distinct source) as projects, sum(chars)::bigint as total_chars, median(chars) as median_chars, max(chars)::int as max_chars, count(*) filter (red) as blocked,
         count(*) filter (red and contains(source, 'src1')) as blocked_own, count(*) filter (red and not contains(source, 'src1')) as blocked_external,
         count(*) filter (not contains(source, 'src1')) as external_turns, round(count(*) filter (red) / count(*), 6) as blocked_share from t""",
)
def traffic_report(spark, sf):
    d = read(spark, sf, "documents")
    turns = d.select(
        F.col("doc_id").alias("turn_id"), F.col("source").alias("project"),
        F.length("text").alias("chars"),
    )
    v = d.select(
        F.col("doc_id").alias("turn_id"),
        F.when(F.contains("text", F.lit("token = ")), "red").otherwise("green").alias("verdict"),
    )
    return E.traffic_report(turns, v, "src1")


@query(
    "systematic_sample",
    "select event_id, event_type from events where event_id % 7 = 0 order by event_id limit 600",
)
def systematic_sample(spark, sf):
    return E.systematic_sample(
        read(spark, sf, "events").select("event_id", "event_type"), "event_id", 7, 600
    )


@query(
    "stratified_sample",
    """select doc_id, source, cast(rn as int) as round from (select doc_id, source, row_number() over (partition by source order by md5(cast(doc_id as varchar))) as rn from documents) t
       order by rn, source limit 150""",
)
def stratified_sample(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", "source")
    return E.stratified_sample(
        d, 150, stratum="source", order=F.md5(F.col("doc_id").cast("string"))
    )


@query(
    "cap_escalations",
    f"""with r as (select request_id, ord, confidence >= 0.35 and confidence < 0.75 as in_band, row_number() over (partition by request_id order by ord) as rn from {plant_sql('line_findings')} f)
        select request_id, ord from r where rn <= 3 order by in_band desc, request_id, ord limit 10000""",
)
def cap_escalations(spark, sf):
    f = plant(spark, sf, "line_findings").withColumn(
        "in_band", (F.col("confidence") >= 0.35) & (F.col("confidence") < 0.75)
    )
    kept, _ = E.cap_escalations(f, ["request_id"], "ord", per=3)
    return kept.select("request_id", "ord")


@query(
    "escalation_drops",
    f"""with r as (select row_number() over (partition by request_id order by ord) as rn from {plant_sql('line_findings')} f)
        select count(*) as offered, count(*) filter (rn > 3) as over_request_cap, greatest(count(*) filter (rn <= 3) - 10000, 0) as dropped from r""",
)
def escalation_drops(spark, sf):
    _, counts = E.cap_escalations(
        plant(spark, sf, "line_findings"), ["request_id"], "ord", per=3
    )
    return counts


@query(
    "top_span_paths",
    f"select span_path, count(*) as n from {plant_sql('line_findings')} f group by 1 order by n desc, span_path limit 24",
)
def top_span_paths(spark, sf):
    n = plant(spark, sf, "line_findings").groupBy("span_path").agg(F.count("*").alias("n"))
    return E.top_k(n, "n", 24, ["span_path"])


@query(
    "request_status",
    """with s as (select user_id as request_id, ts, event_id, case event_type when 'click' then 'outbound_decided' when 'view' then 'completed' when 'error' then 'upstream_failed' end as status from events)
       select request_id, arg_max(status, struct_pack(a := ts, b := event_id)) as status, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000.0, 3) as latency_ms from s where status is not null group by 1""",
)
def request_status(spark, sf):
    e = F.col("event_type")
    s = read(spark, sf, "events").select(
        F.col("user_id").alias("request_id"), "ts", F.col("event_id").alias("seq"),
        F.when(e == "click", "outbound_decided").when(e == "view", "completed")
        .when(e == "error", "upstream_failed").alias("status"),
    )
    return E.request_status(s)


@query(
    "neighbour_classes",
    f"""with f as (select distinct request_id, span_path, entity_class from {plant_sql('line_findings')} f),
        s as (select distinct request_id, span_path from f)
        select s.request_id, s.span_path, coalesce((select array_to_string(list_sort(list_distinct(list(o.entity_class))), ',') from f o where o.request_id = s.request_id and o.span_path <> s.span_path), '') as neighbours from s""",
)
def neighbour_classes(spark, sf):
    f = plant(spark, sf, "line_findings")
    return E.neighbour_classes(f, ["request_id"]).withColumn(
        "neighbours", F.array_join("neighbours", ",")
    )


@query(
    "unclaimed_requests",
    f"select request_id from {_REQ} q where request_id not in (select request_id from {plant_sql('line_findings')} f where not advisory_only)",
)
def unclaimed_requests(spark, sf):
    f = plant(spark, sf, "line_findings").filter("not advisory_only")
    return E.unclaimed(plant(spark, sf, "requests"), f, ["request_id"]).select("request_id")


_UNSURE = " Zq7Lw2Rk9Tn4Vx8By3HmDf6Gj1Ks5Pc"
_TOKENS = """(select o_orderkey as request_id, concat('Ref ', case when o_orderkey % 2 = 0 then upper(substr(md5(cast(o_orderkey as varchar)), 1, 9)) else 'none' end, ', see ID-', cast(o_custkey as varchar), ' (ok).') as text from orders where o_orderkey % 3 <> 0)"""


def _spans(spark, sf):
    """References of orders. Of every six, one holds a key that the detectors claim and one a
    long token of which they are unsure."""
    k = F.col("o_orderkey")
    return read(spark, sf, "orders").select(
        k.alias("request_id"), F.lit("messages[0].ref_no").alias("span_path"),
        F.concat(
            F.lit("Ref "),
            F.when(k % 2 == 0, F.upper(F.substring(F.md5(k.cast("string")), 1, 9))).otherwise("none"),
            F.lit(", see ID-"), F.col("o_custkey"), F.lit(" (ok)."),
            F.when(k % 6 == 3, F.concat(
                F.lit(" AKIA"), F.upper(F.substring(F.md5(k.cast("string")), 1, 16))))
            .when(k % 6 == 0, F.lit(_UNSURE)).otherwise(""),
        ).alias("text"),
        F.lit("user").alias("origin"), F.lit("outbound").alias("leg"),
    )


_FEATURES = f"""(select request_id, token, row_number() over (partition by request_id order by i) - 1 as part from (
    select request_id, regexp_replace(raw[i], '^[.:!?_/-]+|[.:!?_/-]+$', '', 'g') as token, i from (
      select request_id, string_split_regex(text, '[\\s,;()\\[\\]{{}}<>"''`]+') as raw from {_TOKENS} t) s, lateral (select unnest(range(1, len(s.raw) + 1)) as i) u) v
    where length(token) between 6 and 128 and regexp_matches(token, '[0-9]'))"""


#: Spans with a finding inside the band: they escalate whole.
_DOUBTFUL = f"""(select o_orderkey as request_id, concat('Ref ', case when o_orderkey % 2 = 0 then upper(substr(md5(cast(o_orderkey as varchar)), 1, 9)) else 'none' end, ', see ID-', cast(o_custkey as varchar), ' (ok).', '{_UNSURE}') as text from orders where o_orderkey % 6 = 0)"""
_SHAPE = "regexp_replace(regexp_replace(regexp_replace(text, '[a-z]', 'a', 'g'), '[A-Z]', 'A', 'g'), '[0-9]', '9', 'g')"


@query(
    "escalation_features",
    f"""select request_id, cast(part as int) as part, regexp_replace(regexp_replace(regexp_replace(token, '[a-z]', 'a', 'g'), '[A-Z]', 'A', 'g'), '[0-9]', '9', 'g') as shape,
          cast(length(token) as int) as length, case when regexp_full_match(token, '[0-9a-fA-F]+') then 'hex' else 'base64ish' end as charset, round({Q.entropy('token')}, 3) as entropy, 'ref_no' as key_name
        from {_FEATURES} f
        union all select request_id, 0, concat(left({_SHAPE}, 64), case when length(text) > 64 then '…' else '' end), cast(length(text) as int), 'ascii', round({Q.entropy('text')}, 3), 'ref_no'
        from {_DOUBTFUL} d""",
)
def escalation_features(spark, sf):
    """Feature rows of unclaimed identifiers: shapes, never text."""
    spans = _spans(spark, sf)
    found = D.detect_all(spans, ["request_id", "span_path"])
    f = E.escalation_features(spans, found, ["request_id"], KEY)
    return f.select("request_id", "part", "shape", "length", "charset",
                    F.round("entropy", 3).alias("entropy"), "key_name")


@query(
    "propose_checks",
    f"""select case when contains(token, '-') and not regexp_full_match(token, '[0-9a-fA-F]+') then 'sensitive' else 'unknown' end as verdict_hint, count(*) as n from (
          select token from {_FEATURES} f union all select text from {_DOUBTFUL} d) t group by 1""",
)
def propose_checks(spark, sf):
    spans = _spans(spark, sf)
    found = D.detect_all(spans, ["request_id", "span_path"])
    f = E.escalation_features(spans, found, ["request_id"], KEY)
    return LR.propose_checks(f).groupBy("verdict_hint").agg(F.count("*").alias("n"))


@query(
    "context_rule_violations",
    """with c as (select name, arg_max(problem, ord) as problem from (select case s_suppkey % 5 when 0 then 'password_key' when 1 then 'secret_key' when 2 then 'api_key_key' else 'own_rule' end as name, s_suppkey as ord,
         case s_suppkey % 5 when 0 then 'confidence below baseline' when 1 then 'pattern differs from baseline' end as problem from supplier) t group by 1)
       select name, problem from c where problem is not null union all select unnest(['credential_key', 'bare_token_key']), 'baseline rule absent'""",
)
def context_rule_violations(spark, sf):
    """Rules a supplier table proposes, checked against the baseline."""
    base = RD.rules_frame(spark, BASELINE_KEY_RULES)
    k = F.col("s_suppkey")
    name = F.when(k % 5 == 0, "password_key").when(k % 5 == 1, "secret_key").when(
        k % 5 == 2, "api_key_key").otherwise("own_rule")
    config = (
        read(spark, sf, "supplier").select(name.alias("name"), k.alias("s_suppkey"))
        .groupBy("name").agg(F.max("s_suppkey").alias("s_suppkey"))
        .join(base, "name", "left").select(
            "name",
            F.when(F.col("name") == "secret_key", "x").otherwise(F.coalesce("pattern", F.lit("y"))).alias("pattern"),
            F.when(F.col("name") == "password_key", 0.1).otherwise(F.coalesce("confidence", F.lit(0.5))).alias("confidence"),
        )
    )
    return RD.context_rule_violations(base, config)


@query(
    "missing_baseline",
    """select name from (select unnest(['password_key', 'secret_key', 'api_key_key', 'credential_key', 'bare_token_key']) as name) b
       except select case s_suppkey % 5 when 0 then 'password_key' when 1 then 'secret_key' when 2 then 'api_key_key' else 'own_rule' end from supplier""",
)
def missing_baseline(spark, sf):
    base = RD.rules_frame(spark, BASELINE_KEY_RULES)
    k = F.col("s_suppkey")
    config = read(spark, sf, "supplier").select(
        F.when(k % 5 == 0, "password_key").when(k % 5 == 1, "secret_key")
        .when(k % 5 == 2, "api_key_key").otherwise("own_rule").alias("name")
    )
    return RD.missing_baseline(base, config)


