"""Registered policy, identity, guard and redaction queries with their reference SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnhelm.functions import lattice
from tarnhelm.functions.crypto import derive_token
from tarnhelm.operators import guard as G
from tarnhelm.operators import identity as I
from tarnhelm.operators import policy as P
from tarnhelm.operators import redact as R
from tarnhelm.operators import verdict as V
from tarnhelm.plans import sqlkit as Q
from tarnhelm.plans.plants import plant, plant_sql, read
from tarnhelm.sources.readers import spread
from tarnhelm.schema import FAMILIES, RULE_TYPE, entity_classes, family_of, never_tokenize

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


def _csv(col: str):
    return F.filter(F.split(col, ","), lambda x: x != "")


def rules_df(spark, sf):
    """Rule rows with arrays and clearance blocks."""
    none = F.array().cast("array<string>")

    def block(groups, roles=None):
        g = _csv(groups)
        r = _csv(roles) if roles else none
        b = F.struct(
            r.alias("actor_role"), g.alias("actor_group"), none.alias("destination")
        )
        kind = "array<struct<actor_role:array<string>,actor_group:array<string>,destination:array<string>>>"
        return F.when((F.size(g) > 0) | (F.size(r) > 0), F.array(b)).otherwise(
            F.array().cast(kind)
        )

    return plant(spark, sf, "rules").select(
        "tenant_id", F.lit(1).alias("version"), "rule_index", "direction",
        _csv("class_csv").alias("class"), _csv("destination_csv").alias("destination"),
        "action", F.lit(False).alias("format_preserving"), "escalate",
        F.concat(F.lit("rule "), F.col("rule_index")).alias("reason"),
        block("unless_groups", "unless_roles").alias("unless"),
        block("except_groups").alias("except"),
    )


def policies_df(spark, sf):
    """One active policy per tenant that has rules."""
    fields = [c.split(":")[0] for c in (
        "direction", "class", "destination", "action", "format_preserving", "escalate", "reason",
        "unless", "except")]
    nested = F.transform(
        F.array_sort(F.collect_list(F.struct("rule_index", *fields))),
        lambda r: F.struct(*[r[f].alias(f) for f in fields]),
    ).cast(f"array<{RULE_TYPE}>")
    key = F.substring("tenant_id", 2, 9).cast("int")
    return rules_df(spark, sf).groupBy("tenant_id").agg(nested.alias("rules")).select(
        "tenant_id", F.lit(1).alias("version"), F.lit(True).alias("active"),
        F.when(key % 10 == 5, "shadow").otherwise("enforce").alias("mode"),
        F.when(key % 4 == 0, "warn").otherwise("allow").alias("default"),
        F.lit("mask").alias("unregistered_workload"), "rules",
        F.lit(None).cast("string").alias("content_hash"),
    )


_POLICIES_SQL = f"""(select distinct tenant_id, case when cast(substr(tenant_id, 2) as int) % 10 = 5 then 'shadow' else 'enforce' end as mode,
    case when cast(substr(tenant_id, 2) as int) % 4 = 0 then 'warn' else 'allow' end as dflt from {plant_sql('rules')} r0)"""

_FINDINGS_SQL = f"""(select f.*, r.tenant_id, r.actor_id, a.role, a.groups_csv, a.registered
    from {plant_sql('line_findings')} f join {plant_sql('requests')} r on f.request_id = r.request_id
    join {plant_sql('actors')} a on a.actor_id = r.actor_id)"""


def findings_df(spark, sf, by: str | None = None):
    """Findings with the tenant of their request and its actor.

    With ``by`` lines are shuffled by that key before findings are made of them."""
    f = plant(spark, sf, "line_findings", by) if by else spread(plant(spark, sf, "line_findings"))
    r = plant(spark, sf, "requests").select("request_id", "tenant_id", "actor_id")
    a = plant(spark, sf, "actors").select(
        "actor_id", "role", _csv("groups_csv").alias("groups"), "registered"
    )
    return f.join(r.join(a, "actor_id"), "request_id")


def _rule_match(f: str, r: str) -> str:
    return (
        f"({r}.direction is null or {r}.direction = {f}.leg) "
        f"and ({r}.class_csv = '' or list_contains(string_split({r}.class_csv, ','), {f}.entity_class)) "
        f"and ({r}.destination_csv = '' or {r}.destination_csv = {f}.destination)"
    )


def _cleared_sql(f: str, r: str) -> str:
    def overlap(x, y):
        return (
            f"len(list_intersect(list_filter(string_split({x}, ','), lambda s: s <> ''), "
            f"list_filter(string_split({y}, ','), lambda s: s <> ''))) > 0"
        )

    return (
        f"(case when {f}.leg = 'inbound' then ({overlap(f + '.groups_csv', r + '.unless_groups')} "
        f"or ({r}.unless_roles <> '' and {r}.unless_roles = {f}.role)) "
        f"else {overlap(f + '.groups_csv', r + '.except_groups')} end)"
    )


def _folded_matches(spark, sf, *columns: str):
    """Findings with the rules that apply to them and the columns of these a query shows."""
    rules = rules_df(spark, sf).select(
        "tenant_id", "rule_index", "direction", "class", "destination", *columns)
    # What a finding is comes without its request: no finding is shuffled for it.
    kinds = plant(spark, sf, "line_findings").select(
        "entity_class", "leg", "destination").distinct()
    seen = kinds.crossJoin(plant(spark, sf, "rules").select("tenant_id").distinct())
    return P.folded_matches(findings_df(spark, sf, by="l_orderkey"), rules, seen=seen)


@query(
    "match_rules",
    f"""select f.request_id, f.ord, r.rule_index, r.action from {_FINDINGS_SQL} f
        join {plant_sql('rules')} r on r.tenant_id = f.tenant_id and {_rule_match('f', 'r')}""",
)
def match_rules(spark, sf):
    m = _folded_matches(spark, sf, "action")
    return m.select("request_id", "ord", F.explode("rule_indexes").alias("rule_index"), "action")


@query(
    "cleared_matches",
    f"""select f.request_id, f.ord, r.rule_index, {_cleared_sql('f', 'r')} as cleared from {_FINDINGS_SQL} f
        join {plant_sql('rules')} r on r.tenant_id = f.tenant_id and {_rule_match('f', 'r')}""",
)
def cleared_matches(spark, sf):
    """Rules that clear the same actors are judged once per finding."""
    m = P.cleared(_folded_matches(spark, sf, "unless", "except"))
    return m.select("request_id", "ord", F.explode("rule_indexes").alias("rule_index"), "cleared")


@query(
    "last_matching_rule",
    f"""select request_id, ord, rule_index, action from (
          select f.request_id, f.ord, r.rule_index, r.action,
            row_number() over (partition by f.request_id, f.ord order by r.rule_index desc) as rn
          from {_FINDINGS_SQL} f join {plant_sql('rules')} r on r.tenant_id = f.tenant_id and {_rule_match('f', 'r')}) t
        where rn = 1""",
)
def last_matching_rule(spark, sf):
    found = P.last_matching_rule(
        findings_df(spark, sf), rules_df(spark, sf), ["request_id", "ord"]
    )
    return found.select("request_id", "ord", "rule_index", "action")


@query(
    "resolve_policies",
    f"""select t.id as tenant_id, coalesce(t.parent_id, t.id) as org_tenant_id, o.mode as org_mode, o.dflt as org_default,
          b.mode as bu_mode from {plant_sql('tenants')} t
        left join {_POLICIES_SQL} o on o.tenant_id = coalesce(t.parent_id, t.id)
        left join {_POLICIES_SQL} b on b.tenant_id = t.id and t.parent_id is not null""",
)
def resolve_policies(spark, sf):
    return P.resolve_policies(plant(spark, sf, "tenants"), policies_df(spark, sf)).select(
        "tenant_id", "org_tenant_id", F.col("org.mode").alias("org_mode"),
        F.col("org.default").alias("org_default"), F.col("bu.mode").alias("bu_mode"),
    )


def _last_sql(owner: str, cond: str) -> str:
    return f"""(select request_id, ord, rule_index, action, escalate, cleared from (
        select f.request_id, f.ord, r.rule_index, r.action, r.escalate, {_cleared_sql('f', 'r')} as cleared,
          row_number() over (partition by f.request_id, f.ord order by r.rule_index desc) as rn
        from {_FINDINGS_SQL} f join {plant_sql('tenants')} t on t.id = f.tenant_id
        join {plant_sql('rules')} r on r.tenant_id = {owner} and {cond} and {_rule_match('f', 'r')}) q where rn = 1)"""


_EXCEPTED = "(f.actor_id % 17 = 3 and f.entity_class = 'PAN')"


def _decide_sql() -> str:
    org = _last_sql("coalesce(t.parent_id, t.id)", "true")
    bu = _last_sql("t.id", "t.parent_id is not null")
    return f"""
      select request_id, ord, span_path, entity_class, mode,
        {Q.action("case when excepted then base else greatest(oa, coalesce(ba, oa)) end")} as action,
        case when by_bu then bi else oi end as rule_index,
        case when excepted then 'exception' when by_bu then 'bu' when oi is not null then 'org' else 'default' end as rule_scope,
        (oc or bc or excepted) as exception_applied,
        coalesce((oi is not null and not oc and oe) or (by_bu and not bc and be), false) as escalate
      from (select *, (bi is not null and ba >= oa and (ba > oa or oi is null)) as by_bu from (
        select f.request_id, f.ord, f.span_path, f.entity_class, p.mode, {_EXCEPTED} as excepted,
          {Q.rank("case when f.registered then p.dflt else 'mask' end")} as base,
          o.rule_index as oi, b.rule_index as bi, coalesce(o.cleared, false) as oc, coalesce(b.cleared, false) as bc,
          o.escalate as oe, b.escalate as be,
          case when o.rule_index is null or o.cleared then {Q.rank("case when f.registered then p.dflt else 'mask' end")} else {Q.rank('o.action')} end as oa,
          case when b.rule_index is null then null when b.cleared then {Q.rank("case when f.registered then p.dflt else 'mask' end")} else {Q.rank('b.action')} end as ba
        from {_FINDINGS_SQL} f join {plant_sql('tenants')} t on t.id = f.tenant_id
        join {_POLICIES_SQL} p on p.tenant_id = coalesce(t.parent_id, t.id)
        left join {org} o on o.request_id = f.request_id and o.ord = f.ord
        left join {bu} b on b.request_id = f.request_id and b.ord = f.ord) x) y"""


def decisions_df(spark, sf):
    f = findings_df(spark, sf).withColumn(
        "exceptions",
        F.when(F.col("actor_id") % 17 == 3, F.array(F.lit("PAN"))).otherwise(
            F.array().cast("array<string>")
        ),
    )
    return P.decide_findings(f, _resolved(spark, sf))


@query(
    "policy_decide_rows",
    f"""select request_id, ord, action, rule_index, rule_scope from ({_decide_sql()}) d""",
)
def policy_decide_rows(spark, sf):
    """The same decision with the whole policies on a row, as ``decide`` takes them."""
    f = findings_df(spark, sf).withColumn(
        "exceptions",
        F.when(F.col("actor_id") % 17 == 3, F.array(F.lit("PAN"))).otherwise(
            F.array().cast("array<string>")
        ),
    )
    return P.decide_rows(f, _resolved(spark, sf), ["request_id", "ord"]).select(
        "request_id", "ord", "action", "rule_index", "rule_scope"
    )


@query(
    "policy_decide",
    f"""select request_id, ord, action, rule_index, rule_scope, exception_applied, escalate
        from ({_decide_sql()}) d""",
)
def policy_decide(spark, sf):
    """Decision for every finding: two policies, clearance, clamp, exceptions."""
    return decisions_df(spark, sf).select(
        "request_id", "ord", "action", "rule_index", "rule_scope", "exception_applied", "escalate"
    )


@query(
    "request_actions",
    f"""with d as ({_decide_sql()}), r as (select *, {Q.rank('action')} as rk from d),
        w as (select *, row_number() over (partition by request_id order by rk desc, ord) as rn from r)
        select request_id, max(case when rn = 1 then action end) as action, max(case when rn = 1 then rule_index end) as rule_index,
          max(case when rn = 1 then rule_scope end) as rule_scope, bool_or(exception_applied) as exception_applied, bool_or(escalate) as escalate,
          array_to_string(list_sort(list_distinct(list(entity_class))), ',') as classes,
          array_to_string(list_sort(list_distinct(list(span_path))), ',') as paths
        from w group by request_id""",
)
def request_actions(spark, sf):
    """Strongest action per request, the rule that caused it, classes and paths."""
    out = P.overall(decisions_df(spark, sf), ["request_id"])
    return out.select(
        "request_id", "action", "rule_index", "rule_scope", "exception_applied", "escalate",
        F.array_join("finding_classes", ",").alias("classes"),
        F.array_join("finding_paths", ",").alias("paths"),
    )


@query(
    "overall_action",
    f"""with d as ({_decide_sql()}), m as (select request_id, max({Q.rank('action')}) as top from d group by 1)
        select r.request_id, coalesce({Q.action('m.top')}, 'allow') as action
        from {plant_sql('requests')} r left join m on m.request_id = r.request_id""",
)
def overall_action(spark, sf):
    return P.overall_action(
        decisions_df(spark, sf), plant(spark, sf, "requests"), ["request_id"]
    )


@query(
    "applied_action",
    f"""select request_id, ord, case when mode = 'shadow' then 'allow' when action = 'tokenize' then 'mask' else action end as control,
          case when mode = 'shadow' and action in ('tokenize', 'mask', 'block') then 'allow' when action = 'tokenize' then 'mask' else action end as gateway,
          case when action = 'tokenize' then 'tokenize_needs_vault' end as degraded_reason
        from ({_decide_sql()}) d""",
)
def applied_action(spark, sf):
    d = decisions_df(spark, sf)
    a = P.applied_action(d).withColumnRenamed("applied_action", "control")
    g = P.applied_action(a, "gateway").withColumnRenamed("applied_action", "gateway")
    return g.select("request_id", "ord", "control", "gateway", "degraded_reason")


@query(
    "combine_legs",
    f"""select o_custkey, {Q.action('max(' + Q.rank('action') + ')')} as action from (
          select o_custkey, case o_orderkey % 5 when 0 then 'allow' when 1 then 'warn' when 2 then 'tokenize' when 3 then 'mask' else 'block' end as action
          from orders where o_orderkey % 2 = 0
          union all select o_custkey, case o_orderkey % 3 when 0 then 'allow' when 1 then 'warn' else 'mask' end from orders where o_orderkey % 2 = 1) t
        group by 1""",
)
def combine_legs(spark, sf):
    o = read(spark, sf, "orders")
    k = F.col("o_orderkey")
    acts = [F.lit(a) for a in lattice.LATTICE]
    out = o.filter(k % 2 == 0).select(
        "o_custkey", F.element_at(F.array(*acts), (k % 5).cast("int") + 1).alias("action")
    )
    inb = o.filter(k % 2 == 1).select(
        "o_custkey", F.when(k % 3 == 0, "allow").when(k % 3 == 1, "warn").otherwise("mask").alias("action")
    )
    return P.combine_legs(out, inb, ["o_custkey"])


@query(
    "action_lattice",
    f"""select o_orderkey, {Q.rank('a')} as rank_a, {Q.action('greatest(' + Q.rank('a') + ', ' + Q.rank('b') + ')')} as strongest,
          {Q.rank('b')} < {Q.rank('a')} as weaker from (
          select o_orderkey, case o_orderkey % 5 when 0 then 'allow' when 1 then 'warn' when 2 then 'tokenize' when 3 then 'mask' else 'block' end as a,
            case o_custkey % 5 when 0 then 'allow' when 1 then 'warn' when 2 then 'tokenize' when 3 then 'mask' else 'block' end as b from orders) t""",
)
def action_lattice(spark, sf):
    acts = F.array(*[F.lit(a) for a in lattice.LATTICE])
    o = read(spark, sf, "orders").select(
        "o_orderkey",
        F.element_at(acts, (F.col("o_orderkey") % 5).cast("int") + 1).alias("a"),
        F.element_at(acts, (F.col("o_custkey") % 5).cast("int") + 1).alias("b"),
    )
    a, b = F.col("a"), F.col("b")
    return o.select(
        "o_orderkey", lattice.rank(a).alias("rank_a"), lattice.strongest(a, b).alias("strongest"),
        lattice.is_weaker(b, a).alias("weaker"),
    )


_EXC_SQL = """(select concat('n', cast(c_nationkey as varchar)) as tenant_id, case when c_custkey % 3 = 0 then null else c_custkey end as actor_id,
    case c_custkey % 4 when 0 then 'PAN' when 1 then 'EMAIL' when 2 then 'JWT' else 'HR_RECORD' end as entity_class,
    case when c_custkey % 5 = 0 then null else 'boss' end as approved_by,
    timestamp '1995-01-01' + to_days(cast(c_custkey % 1500 as int)) as expires_at from customer where c_custkey % 7 = 0)"""


@query(
    "active_exceptions",
    f"""select request_id, array_to_string(list_sort(list_distinct(list(entity_class))), ',') as exceptions from (
          select r.request_id, e.entity_class from {plant_sql('requests')} r join (select distinct tenant_id, actor_id, entity_class, expires_at from {_EXC_SQL} e0
            where approved_by is not null) e
          on e.tenant_id = r.tenant_id and (e.actor_id is null or e.actor_id = r.actor_id) and e.expires_at > r.ts) t group by 1""",
)
def active_exceptions(spark, sf):
    k = F.col("c_custkey")
    exc = read(spark, sf, "customer").filter(k % 7 == 0).select(
        F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("tenant_id"),
        F.when(k % 3 != 0, k).alias("actor_id"),
        F.when(k % 4 == 0, "PAN").when(k % 4 == 1, "EMAIL").when(k % 4 == 2, "JWT")
        .otherwise("HR_RECORD").alias("entity_class"),
        F.lit("someone").alias("requested_by"),
        F.when(k % 5 != 0, "boss").alias("approved_by"),
        F.date_add(F.lit("1995-01-01").cast("date"), (k % 1500).cast("int")).cast("timestamp").alias("expires_at"),
    )
    # Many exceptions of a tenant name the same class; the latest expiry decides.
    exc = exc.groupBy("tenant_id", "actor_id", "entity_class", "requested_by", "approved_by").agg(
        F.max("expires_at").alias("expires_at")
    )
    req = plant(spark, sf, "requests").withColumnRenamed("ts", "decided_at")
    return P.active_exceptions(exc, req).select(
        "request_id", F.array_join("exceptions", ",").alias("exceptions")
    )


_TREE_SQL = """(select concat('s', cast(s_suppkey as varchar)) as id,
    case when s_suppkey % 16 = 0 then null when s_suppkey % 16 = 15 then concat('s', cast(s_suppkey as varchar))
      when s_suppkey % 16 = 14 then 'nowhere' else concat('s', cast(s_suppkey - 1 as varchar)) end as parent_id from supplier)"""


def _tree(spark, sf):
    k = F.col("s_suppkey")

    def name(x):
        return F.concat(F.lit("s"), x.cast("string"))

    return read(spark, sf, "supplier").select(
        name(k).alias("id"),
        F.when(k % 16 == 15, name(k)).when(k % 16 == 14, "nowhere")
        .when(k % 16 != 0, name(k - 1)).alias("parent_id"),
    )


@query(
    "root_tenant",
    """select concat('s', cast(s_suppkey as varchar)) as tenant_id,
         case when s_suppkey % 16 >= 14 then null else concat('s', cast(s_suppkey - s_suppkey % 16 as varchar)) end as root_id,
         case when s_suppkey % 16 = 15 then 'cycle' when s_suppkey % 16 = 14 then 'missing' else 'ok' end as status from supplier""",
)
def root_tenant(spark, sf):
    """Chains of tenants up to 13 levels deep, with cycles and missing parents."""
    return P.root_tenant(_tree(spark, sf))


@query(
    "bu_may_only_raise",
    f"""select b.tenant_id, b.rule_index as bu_rule_index, o.rule_index as org_rule_index, b.action as bu_action, o.action as org_action
        from {plant_sql('rules')} b join {plant_sql('tenants')} t on t.id = b.tenant_id and t.parent_id is not null
        join {plant_sql('rules')} o on o.tenant_id = t.parent_id
        where b.unless_groups = '' and b.unless_roles = '' and b.except_groups = ''
          and (o.direction is null or b.direction is null or o.direction = b.direction)
          and (o.class_csv = '' or b.class_csv = '' or len(list_intersect(string_split(o.class_csv, ','), string_split(b.class_csv, ','))) > 0)
          and (o.destination_csv = '' or b.destination_csv = '' or o.destination_csv = b.destination_csv)
          and {Q.rank('b.action')} < {Q.rank('o.action')}""",
)
def bu_may_only_raise(spark, sf):
    rules = rules_df(spark, sf)
    tree = plant(spark, sf, "tenants").filter("parent_id is not null").select(
        F.col("id").alias("tenant_id"), F.col("parent_id").alias("org_tenant_id")
    )
    return P.bu_may_only_raise(rules, rules.join(tree, "tenant_id")).drop("version")


def _policy_versions(spark, sf):
    """Three versions per tenant; the last is active."""
    base = policies_df(spark, sf).withColumn("version", F.explode(F.array(*map(F.lit, (1, 2, 3)))))
    key = F.substring("tenant_id", 2, 9).cast("int")
    return base.withColumns(
        {
            "active": F.col("version") == 3,
            "default": F.when((F.col("version") == 2) & (key % 2 == 0), "mask").otherwise(F.col("default")),
            "rules": F.when(
                (F.col("version") == 2) & (key % 3 == 0),
                F.slice("rules", F.lit(1), F.size("rules") - 1),
            ).otherwise(F.col("rules")),
        }
    )


@query(
    "policy_versions",
    """select distinct concat('n', cast(s_nationkey as varchar)) as tenant_id, v as version, v = 3 as active, 4 as next_version, true as one_active
       from supplier, (select unnest([1, 2, 3]) as v) t""",
)
def policy_versions(spark, sf):
    return P.versions(_policy_versions(spark, sf))


@query(
    "policy_diff",
    f"""with p as (select p.tenant_id, dflt, mode, cast(substr(p.tenant_id, 2) as int) as k, (select count(*) from {plant_sql('rules')} r where r.tenant_id = p.tenant_id) as n from {_POLICIES_SQL} p),
        v as (select *, case when k % 2 = 0 then 'mask' else dflt end as dflt2, case when k % 3 = 0 then n - 1 else n end as n2 from p)
        select tenant_id, case when notes = '' then 'no material change' else notes end as notes from (select tenant_id,
          case k % 5
          when 1 then concat('default ', dflt, ' -> none; mode ', mode, ' -> none; unregistered_workload mask -> none; rules ', n, ' -> 0')
          when 3 then concat('default none -> ', dflt2, '; mode none -> ', mode, '; unregistered_workload none -> mask', case when n2 > 0 then concat('; rules 0 -> ', n2) else '' end)
          else array_to_string(list_filter([case when k % 2 = 0 then concat('default ', dflt, ' -> mask') end,
            case when k % 3 = 0 then concat('rules ', n, ' -> ', n - 1) end], lambda x: x is not null), '; ') end as notes from v) q""",
)
def policy_diff(spark, sf):
    """Two versions of each tenant's policy; some tenants have only the old or the new one."""
    key = F.substring("tenant_id", 2, 9).cast("int")
    rows = _policy_versions(spark, sf).where(
        ~((key % 5 == 1) & (F.col("version") == 2)) & ~((key % 5 == 3) & (F.col("version") == 1)))
    return P.policy_diff(rows, 1, 2).select(
        "tenant_id", F.array_join("notes", "; ").alias("notes")
    )


@query(
    "publish_policies",
    f"""with v as (select distinct b.tenant_id from {plant_sql('rules')} b join {plant_sql('tenants')} t on t.id = b.tenant_id and t.parent_id is not null
          join {plant_sql('rules')} o on o.tenant_id = t.parent_id
          where b.unless_groups = '' and b.unless_roles = '' and b.except_groups = ''
          and (o.direction is null or b.direction is null or o.direction = b.direction)
          and (o.class_csv = '' or b.class_csv = '' or len(list_intersect(string_split(o.class_csv, ','), string_split(b.class_csv, ','))) > 0)
          and (o.destination_csv = '' or b.destination_csv = '' or o.destination_csv = b.destination_csv)
          and {Q.rank('b.action')} < {Q.rank('o.action')}),
        d as (select p.tenant_id, t.parent_id, cast(substr(p.tenant_id, 2) as int) as k from {_POLICIES_SQL} p join {plant_sql('tenants')} t on t.id = p.tenant_id)
        select d.tenant_id, case when k % 7 = 6 then (case when parent_id is null then 'org policy must set mode' else 'business unit must omit mode and fail' end)
            when k % 11 = 10 then 'version conflict' when v.tenant_id is not null then 'business unit weakens an org rule' end as reason
        from d left join v on v.tenant_id = d.tenant_id""",
)
def publish_policies(spark, sf):
    tenants = plant(spark, sf, "tenants")
    policies = policies_df(spark, sf)
    key = F.substring("tenant_id", 2, 9).cast("int")
    odd = key % 7 == 6
    drafts = policies.join(
        tenants.select(F.col("id").alias("tenant_id"), "parent_id"), "tenant_id"
    ).select(
        "tenant_id", F.coalesce("parent_id", "tenant_id").alias("org"),
        F.when(F.col("parent_id").isNotNull(), F.col("tenant_id")).alias("business_unit"),
        F.when(F.col("parent_id").isNull(), F.when(~odd, "enforce")).otherwise(
            F.when(odd, "enforce")
        ).alias("mode"),
        F.lit(None).cast("string").alias("fail"),
        F.when(key % 11 == 10, 9).otherwise(1).alias("expected_version"), "rules",
        "default", "unregistered_workload",
    )
    return P.publish(drafts, policies, tenants).select("tenant_id", "reason")


@query(
    "rollback_policies",
    f"""with n as (select tenant_id, count(*) as n from {plant_sql('rules')} r group by 1),
        v as (select distinct b.tenant_id from {plant_sql('rules')} b join {plant_sql('tenants')} t on t.id = b.tenant_id and t.parent_id is not null
          join n on n.tenant_id = b.tenant_id join {plant_sql('rules')} o on o.tenant_id = t.parent_id
          where b.unless_groups = '' and b.unless_roles = '' and b.except_groups = ''
          and not (cast(substr(b.tenant_id, 2) as int) % 3 = 0 and b.rule_index = n.n - 1)
          and (o.direction is null or b.direction is null or o.direction = b.direction)
          and (o.class_csv = '' or b.class_csv = '' or len(list_intersect(string_split(o.class_csv, ','), string_split(b.class_csv, ','))) > 0)
          and (o.destination_csv = '' or b.destination_csv = '' or o.destination_csv = b.destination_csv)
          and {Q.rank('b.action')} < {Q.rank('o.action')})
        select p.tenant_id, 2 as to_version, case when v.tenant_id is null then 4 end as version, 3 as previous_version, v.tenant_id is null as accepted, true as one_active
        from (select distinct tenant_id from {_POLICIES_SQL} q) p left join v on v.tenant_id = p.tenant_id""",
)
def rollback_policies(spark, sf):
    policies = _policy_versions(spark, sf)
    targets = policies.select("tenant_id").distinct().withColumn("to_version", F.lit(2))
    rolled = P.rollback(policies, targets, plant(spark, sf, "tenants"))
    after = P.with_rollback(policies, rolled).groupBy("tenant_id").agg(
        (F.count_if("active") == 1).alias("one_active"))
    return rolled.join(after, "tenant_id").select(
        "tenant_id", "to_version", "version", "previous_version", "accepted", "one_active"
    )


# --------------------------------------------------------------------- identity

_REQ_SQL = """(select o_orderkey as request_id, concat('n', cast(c_nationkey as varchar)) as tenant_id, o_custkey,
    case when o_orderkey % 5 = 0 then concat('spiffe://', cast(o_custkey as varchar)) end as spiffe,
    case when o_orderkey % 3 = 0 then concat('Bearer dev:u', cast(o_custkey as varchar)) when o_orderkey % 3 = 1 then 'Basic abc' end as auth,
    case when o_orderkey % 4 = 0 then concat('dev:u', cast(o_custkey + (case when o_orderkey % 8 = 0 then 1 else 0 end) as varchar)) end as cookie,
    case when o_orderkey % 7 = 0 then concat('u', cast(o_custkey as varchar)) when o_orderkey % 7 = 1 then concat('spiffe://', cast(o_custkey as varchar)) end as claimed
    from orders join customer on o_custkey = c_custkey)"""


def _identity_inputs(spark, sf):
    c = read(spark, sf, "customer")
    k = F.col("c_custkey")
    actors = c.select(
        F.concat(F.lit("act"), k.cast("string")).alias("id"),
        F.when(k % 6 == 0, F.concat(F.lit("n"), (F.col("c_nationkey") - F.col("c_nationkey") % 5).cast("string")))
        .otherwise(F.concat(F.lit("n"), F.col("c_nationkey").cast("string"))).alias("tenant_id"),
        F.when(k % 6 == 0, "organisation").otherwise("tenant").alias("scope"),
        F.when(k % 10 == 1, "security_admin").otherwise("officer").alias("role"),
        F.array(F.lit("g")).alias("groups"),
        F.when(k % 9 != 8, F.concat(F.lit("u"), k.cast("string"))).alias("idp_subject"),
        F.when(k % 4 == 0, F.concat(F.lit("spiffe://"), k.cast("string"))).alias("workload_id"),
        (k % 9 != 8).alias("registered"),
    )
    o = read(spark, sf, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
    n, u = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    requests = o.select(
        n.alias("request_id"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("tenant_id"),
        F.when(n % 5 == 0, F.concat(F.lit("spiffe://"), u)).alias("spiffe"),
        F.when(n % 3 == 0, F.concat(F.lit("Bearer dev:u"), u)).when(n % 3 == 1, "Basic abc").alias("authorization"),
        F.when(
            n % 4 == 0,
            F.concat(F.lit("dev:u"), (F.col("o_custkey") + F.when(n % 8 == 0, 1).otherwise(0)).cast("string")),
        ).alias("cookie"),
        F.when(n % 7 == 0, F.concat(F.lit("u"), u)).when(n % 7 == 1, F.concat(F.lit("spiffe://"), u)).alias("claimed"),
        F.lit("agent/1").alias("user_agent"),
    )
    return requests, actors


@query(
    "resolve_actors",
    f"""with q as (select r.*, (r.auth like 'Bearer dev:%') as has_bearer, r.cookie is not null as has_cookie,
            case when r.auth like 'Bearer dev:%' then substr(r.auth, 13) when r.cookie is not null then substr(r.cookie, 6) end as subj,
            (coalesce(r.auth like 'Bearer dev:%', false) and r.cookie is not null and substr(r.auth, 12) <> substr(r.cookie, 5)) as conflict
          from {_REQ_SQL} r),
        s as (select q.*, case when q.auth like 'Bearer dev:%' then substr(q.auth, 12) else substr(q.cookie, 5) end as subject from q),
        a as (select concat('act', cast(c_custkey as varchar)) as id,
            case when c_custkey % 6 = 0 then concat('n', cast(c_nationkey - c_nationkey % 5 as varchar)) else concat('n', cast(c_nationkey as varchar)) end as tenant_id,
            case when c_custkey % 6 = 0 then 'organisation' else 'tenant' end as scope,
            case when c_custkey % 9 <> 8 then concat('u', cast(c_custkey as varchar)) end as sub,
            case when c_custkey % 4 = 0 then concat('spiffe://', cast(c_custkey as varchar)) end as wl from customer),
        h as (select s.request_id, case when a.wl = s.spiffe then (case a.scope when 'tenant' then 1 else 2 end)
              when not conflict and a.sub = s.subject then (case a.scope when 'tenant' then 3 else 4 end)
              when a.sub = s.claimed then (case a.scope when 'tenant' then 5 else 7 end)
              else (case a.scope when 'tenant' then 6 else 8 end) end as rung, a.id
          from s join {plant_sql('tenants')} t on t.id = s.tenant_id join a on
            ((a.scope = 'tenant' and a.tenant_id = s.tenant_id) or (a.scope = 'organisation' and a.tenant_id = coalesce(t.parent_id, t.id)))
            and (a.wl = s.spiffe or (not conflict and a.sub = s.subject) or a.sub = s.claimed or a.wl = s.claimed)),
        b as (select request_id, min(rung) as rung, arg_min(id, rung) as id from h group by 1)
        select s.request_id, case when s.conflict and coalesce(b.rung, 9) > 2 then 'conflict' else 'ok' end as status,
          case when s.conflict and coalesce(b.rung, 9) > 2 then null when b.id is not null then b.id
            else concat('act_unreg_', substr(sha256(concat(s.tenant_id, '|', coalesce(s.claimed, 'agent/1'))), 1, 16)) end as actor_id,
          case when s.conflict and coalesce(b.rung, 9) > 2 then null when b.rung <= 2 then 'mtls' when b.rung <= 4 then 'session'
            when b.rung <= 8 then 'interception_header' else 'unregistered' end as source
        from s left join b on b.request_id = s.request_id""",
)
def resolve_actors(spark, sf):
    requests, actors = _identity_inputs(spark, sf)
    return I.resolve_actors(requests, actors, plant(spark, sf, "tenants")).select(
        "request_id", "status", "actor_id", "source"
    )


@query(
    "admin_scope",
    f"""with a as (select concat('act', cast(c_custkey as varchar)) as id, c_custkey % 6 = 0 as wide,
            case when c_custkey % 6 = 0 then concat('n', cast(c_nationkey - c_nationkey % 5 as varchar)) else concat('n', cast(c_nationkey as varchar)) end as tenant_id
            from customer where c_custkey % 10 = 1 and c_custkey % 9 <> 8)
        select a.id as actor_id, t.id as target_id from a join {plant_sql('tenants')} t
          on (a.wide and coalesce(t.parent_id, t.id) = a.tenant_id) or (not a.wide and t.id = a.tenant_id)""",
)
def admin_scope(spark, sf):
    _, actors = _identity_inputs(spark, sf)
    return I.admin_scope(actors, plant(spark, sf, "tenants"))


@query(
    "check_sessions",
    """with s as (select c_custkey as id, c_nationkey as tenant, c_custkey % 50 as actor from customer where c_custkey % 5 <> 4),
       r as (select o_orderkey as request_id, case when o_orderkey % 6 = 5 then null else o_custkey end as session_id, c_nationkey as tenant,
         case when o_orderkey % 4 = 0 then o_custkey % 49 else o_custkey % 50 end as actor from orders join customer on o_custkey = c_custkey)
       select r.request_id, case when r.session_id is null then 'new' when s.id is null then 'unknown' when s.tenant <> r.tenant or s.actor <> r.actor then 'mismatch' else 'ok' end as session_status
       from r left join s on s.id = r.session_id""",
)
def check_sessions(spark, sf):
    c = read(spark, sf, "customer")
    o = read(spark, sf, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
    sessions = c.filter(F.col("c_custkey") % 5 != 4).select(
        F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("tenant_id"),
        (F.col("c_custkey") % 50).alias("actor_id"),
    )
    n, u = F.col("o_orderkey"), F.col("o_custkey")
    requests = o.select(
        n.alias("request_id"), F.when(n % 6 != 5, u).alias("session_id"),
        F.col("c_nationkey").alias("tenant_id"),
        F.when(n % 4 == 0, u % 49).otherwise(u % 50).alias("actor_id"),
    )
    return I.check_sessions(requests, sessions).select("request_id", "session_status")


@query(
    "onboarding_actors",
    f"select actor_id as id, tenant_id from {plant_sql('actors')} a where not registered",
)
def onboarding_actors(spark, sf):
    actors = plant(spark, sf, "actors").withColumnRenamed("actor_id", "id").withColumn(
        "role", F.when(F.col("registered"), F.col("role")).otherwise("unregistered")
    )
    return I.onboarding(actors).select("id", "tenant_id")


@query(
    "groups_by_tenant",
    f"""select distinct tenant_id, name from (select tenant_id, unnest(string_split(groups_csv, ',')) as name from {plant_sql('actors')} a) t where name <> ''""",
)
def groups_by_tenant(spark, sf):
    groups = plant(spark, sf, "actors").select(
        "tenant_id", F.explode(_csv("groups_csv")).alias("name")
    ).distinct()
    return I.groups_by_tenant(groups)


# ------------------------------------------------------------ filters, verdicts


_F = plant_sql("line_findings")
_MAY = """(case when origin in ('metadata', 'tool_definition') then false when origin = 'system' then family = 'CREDENTIAL' else true end)"""
_VERDICT_SQL = f"""(select request_id, max(case when not advisory_only then confidence end) as top, count(*) as findings,
    count(*) filter (advisory_only) as advisory from {_F} f group by 1)"""


@query(
    "split_advisory",
    f"select case when advisory_only then 'withheld' else 'enforceable' end as part, entity_class, count(*) as n from {_F} f group by 1, 2",
)
def split_advisory(spark, sf):
    keep, held = V.split_advisory(plant(spark, sf, "line_findings"))
    both = keep.withColumn("part", F.lit("enforceable")).unionByName(
        held.withColumn("part", F.lit("withheld"))
    )
    return both.groupBy("part", "entity_class").agg(F.count("*").alias("n"))


@query(
    "may_enforce",
    f"select origin, family, {_MAY} as may, count(*) as n from {_F} f group by 1, 2, 3",
)
def may_enforce(spark, sf):
    f = plant(spark, sf, "line_findings").withColumn("family", family_of(F.col("entity_class")))
    return f.groupBy(
        "origin", "family", V.may_enforce(F.col("origin"), F.col("family")).alias("may")
    ).agg(F.count("*").alias("n"))


@query(
    "redactable_findings",
    f"select request_id, ord, origin not in ('user', 'assistant', 'tool_call', 'tool_result') as read_only from {_F} f where confidence >= 0.5",
)
def redactable_findings(spark, sf):
    f = V.min_confidence(plant(spark, sf, "line_findings"), 0.5)
    return V.redactable(f).select("request_id", "ord", "read_only")


@query(
    "request_verdicts",
    f"""select r.request_id, case when top is null then 'green' when top >= 0.75 then 'red' when top >= 0.35 then 'amber' else 'green' end as verdict,
          coalesce(top, 1.0) as confidence, coalesce(findings, 0) as findings, coalesce(advisory, 0) as advisory,
          case when top >= 0.35 and top < 0.75 then 'amber_no_tier3' end as degraded
        from {plant_sql('requests')} r left join {_VERDICT_SQL} v on v.request_id = r.request_id""",
)
def request_verdicts(spark, sf):
    return V.verdicts(
        plant(spark, sf, "line_findings"), ["request_id"], plant(spark, sf, "requests")
    )


@query(
    "blocking_findings",
    f"""select f.request_id, f.ord from {_F} f join {_VERDICT_SQL} v on v.request_id = f.request_id
        where v.top >= 0.75 and not f.advisory_only and f.confidence >= 0.75""",
)
def blocking_findings(spark, sf):
    f = plant(spark, sf, "line_findings")
    v = V.verdicts(f, ["request_id"])
    return V.blocking_findings(f, v, ["request_id"]).select("request_id", "ord")


@query(
    "credential_floor",
    f"select o_orderkey as request_id from orders where o_orderkey in (select request_id from {_F} f where family = 'CREDENTIAL')",
)
def credential_floor(spark, sf):
    docs = read(spark, sf, "orders").select(F.col("o_orderkey").alias("request_id"))
    return V.credential_floor(docs, plant(spark, sf, "line_findings"), ["request_id"])


_FAMILY_RANK = "(case family " + " ".join(
    f"when '{k}' then {v}" for k, v in V.FAMILY_ACTION.items()
) + " end)"


@query(
    "family_policy",
    f"""with f as (select f.*, a.groups_csv, q.channel from {_F} f join {plant_sql('requests')} q on q.request_id = f.request_id
            join {plant_sql('actors')} a on a.actor_id = q.actor_id),
        r as (select request_id, ord, case when not advisory_only and {_MAY}
              then (case when {_FAMILY_RANK} = 2 and channel in ('cli', 'mcp') then 4 else {_FAMILY_RANK} end) else 0 end as rk from f),
        w as (select *, row_number() over (partition by request_id order by rk desc, ord) as rn from r)
        select request_id, {Q.action('rk')} as action, case when rk > 0 then ord end as fired from w where rn = 1""",
)
def family_policy(spark, sf):
    q = plant(spark, sf, "requests").select("request_id", "actor_id", "channel")
    a = plant(spark, sf, "actors").select("actor_id", _csv("groups_csv").alias("groups"))
    f = plant(spark, sf, "line_findings").join(q, "request_id").join(a, "actor_id")
    return V.family_policy(f, ["request_id"])


@query(
    "flag_oversize",
    "select conv_id, sum(length(text))::bigint as total_chars, sum(length(text)) > 3000 as oversize from conversations group by 1",
)
def flag_oversize(spark, sf):
    return V.flag_oversize(read(spark, sf, "conversations"), ["conv_id"], limit=3000)


@query(
    "degraded_verdicts",
    """select conv_id, 'red' as closed, 'green' as open, 'payload_too_large' as degraded
       from conversations group by 1 having sum(length(text)) > 3000""",
)
def degraded_verdicts(spark, sf):
    flags = V.flag_oversize(read(spark, sf, "conversations"), ["conv_id"], limit=3000)
    closed = V.degraded_verdicts(flags, "closed").withColumnRenamed("verdict", "closed")
    return V.degraded_verdicts(closed, "open").select(
        "conv_id", "closed", F.col("verdict").alias("open"), "degraded"
    )


@query(
    "entity_class_usage",
    """select f.entity_class, f.family, f.family = 'CREDENTIAL' as never_tokenize, f.entity_class = 'HIGH_ENTROPY_STRING' as never_enforce_alone, count(*) as n """
    + f"from {_F} f group by all",
)
def entity_class_usage(spark, sf):
    """Findings against the class vocabulary (45 rows, a fixed table)."""
    dim = entity_classes(spark)
    f = plant(spark, sf, "line_findings").groupBy("entity_class").agg(F.count("*").alias("n"))
    return f.join(F.broadcast(dim), F.col("entity_class") == F.col("class")).select(
        "entity_class", "family", "never_tokenize", "never_enforce_alone", "n"
    )


# -------------------------------------------------------------------- guards

_DOC_CLASSES = """(select doc_id, unnest(case doc_id % 6 when 0 then ['PAN', 'HR_RECORD'] when 1 then ['INFRA_SECRET'] when 2 then ['JWT', 'GSTIN']
    when 3 then ['EMAIL'] when 4 then ['AADHAAR', 'EMAIL', 'CREDIT_CARD'] else []::varchar[] end) as entity_class from documents)"""


def _doc_classes(spark, sf):
    k = F.col("doc_id") % 6

    def some(*xs):
        return F.array(*[F.lit(x) for x in xs])

    return read(spark, sf, "documents").select(
        "doc_id",
        F.explode(
            F.when(k == 0, some("PAN", "HR_RECORD")).when(k == 1, some("INFRA_SECRET"))
            .when(k == 2, some("JWT", "GSTIN")).when(k == 3, some("EMAIL"))
            .when(k == 4, some("AADHAAR", "EMAIL", "CREDIT_CARD"))
            .otherwise(F.array().cast("array<string>"))
        ).alias("entity_class"),
    )


#: Each document is read by eight actors spread over the tenants.
_READS_SQL = "(select distinct doc_id, (doc_id * 37 + i * 101) % (select count(*) from customer) as actor_id from documents, (select unnest(range(0, 8)) as i) t)"


def _reads(spark, sf):
    n = read(spark, sf, "customer").agg(F.count("*").alias("_n"))
    total = n.first()[0]
    return read(spark, sf, "documents").select(
        "doc_id", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("i")
    ).select("doc_id", ((F.col("doc_id") * 37 + F.col("i") * 101) % total).alias("actor_id")).distinct()


def _actors_full(spark, sf):
    return plant(spark, sf, "actors").select(
        "actor_id", "tenant_id", "role", _csv("groups_csv").alias("groups"), "registered"
    )


def _resolved(spark, sf):
    return P.resolve_policies(plant(spark, sf, "tenants"), policies_df(spark, sf)).filter(
        "org is not null"
    )


_CLASS_LIST = "(select unnest([" + ", ".join(
    f"'{c}'" for fam in FAMILIES.values() for c in fam
) + "]) as entity_class)"


def _matrix_sql() -> str:
    cell = f"""(select a.*, k.entity_class, 'inbound' as leg, cast(null as varchar) as destination from {plant_sql('actors')} a, {_CLASS_LIST} k)"""

    def last(owner, cond):
        return f"""(select actor_id, entity_class, rule_index, action, cleared from (
          select f.actor_id, f.entity_class, r.rule_index, r.action, {_cleared_sql('f', 'r')} as cleared,
            row_number() over (partition by f.actor_id, f.entity_class order by r.rule_index desc) as rn
          from {cell} f join {plant_sql('tenants')} t on t.id = f.tenant_id
          join {plant_sql('rules')} r on r.tenant_id = {owner} and {cond} and (r.direction is null or r.direction = f.leg)
            and (r.class_csv = '' or list_contains(string_split(r.class_csv, ','), f.entity_class)) and r.destination_csv = '') q where rn = 1)"""

    base = Q.rank("case when f.registered then p.dflt else 'mask' end")
    return f"""select actor_id, entity_class, {Q.action('greatest(oa, coalesce(ba, oa))')} as action,
        case when by_bu then bi else oi end as rule_index, case when by_bu then 'bu' when oi is not null then 'org' else 'default' end as rule_scope
      from (select *, (bi is not null and ba >= oa and (ba > oa or oi is null)) as by_bu from (
        select f.actor_id, f.entity_class, o.rule_index as oi, b.rule_index as bi,
          case when o.rule_index is null or o.cleared then {base} else {Q.rank('o.action')} end as oa,
          case when b.rule_index is null then null when b.cleared then {base} else {Q.rank('b.action')} end as ba
        from {cell} f join {plant_sql('tenants')} t on t.id = f.tenant_id
        join {_POLICIES_SQL} p on p.tenant_id = coalesce(t.parent_id, t.id)
        left join {last('coalesce(t.parent_id, t.id)', 'true')} o on o.actor_id = f.actor_id and o.entity_class = f.entity_class
        left join {last('t.id', 't.parent_id is not null')} b on b.actor_id = f.actor_id and b.entity_class = f.entity_class) x) y"""


@query(
    "clearance_matrix",
    f"select actor_id, entity_class, action, rule_index, rule_scope from ({_matrix_sql()}) m",
)
def clearance_matrix(spark, sf):
    return G.clearance_matrix(_actors_full(spark, sf), _resolved(spark, sf)).drop("policy_default")


_JUDGED_SQL = f"""(select q.actor_id, q.doc_id, coalesce({Q.action('j.top')}, 'allow') as action, coalesce(j.classes, '') as classes, j.rule_index, coalesce(j.rule_scope, 'default') as rule_scope
    from {_READS_SQL} q left join (
      select actor_id, doc_id, max(rk) as top, array_to_string(list_sort(list(entity_class)), ',') as classes,
        max(case when rn = 1 then rule_index end) as rule_index, max(case when rn = 1 then rule_scope end) as rule_scope
      from (select *, row_number() over (partition by actor_id, doc_id order by rk desc, entity_class) as rn from (
        select q.actor_id, q.doc_id, c.entity_class, {Q.rank('m.action')} as rk, m.rule_index, m.rule_scope
        from {_READS_SQL} q join {_DOC_CLASSES} c on c.doc_id = q.doc_id
        join ({_matrix_sql()}) m on m.actor_id = q.actor_id and m.entity_class = c.entity_class) a) b group by 1, 2) j
    on j.actor_id = q.actor_id and j.doc_id = q.doc_id)"""


def _judged(spark, sf):
    return G.judge_documents(
        _reads(spark, sf), _doc_classes(spark, sf), _actors_full(spark, sf), _resolved(spark, sf)
    )


@query(
    "judge_documents",
    f"select actor_id, doc_id, action, classes, rule_index, rule_scope from {_JUDGED_SQL} j",
)
def judge_documents(spark, sf):
    return _judged(spark, sf).withColumn("classes", F.array_join("classes", ","))


@query(
    "retrieval_guard",
    f"""select actor_id, doc_id, case when action = 'tokenize' then 'mask' else action end as action, action in ('allow', 'warn') as visible,
          case when action not in ('allow', 'warn') then concat(doc_id, ': ', replace(classes, ',', ', '), ' (', case when action = 'tokenize' then 'mask' else action end,
            ', rule ', coalesce(cast(rule_index as varchar), 'none'), ' of the ', rule_scope, ' policy)') end as explanation
        from {_JUDGED_SQL} j""",
)
def retrieval_guard(spark, sf):
    return G.retrieval_guard(_judged(spark, sf)).select(
        "actor_id", "doc_id", "action", "visible", "explanation"
    )


@query(
    "read_guard",
    f"""select actor_id, doc_id, case when contains(classes, 'JWT') or action in ('mask', 'tokenize') then 'block' else action end as action,
          not contains(classes, 'JWT') and action in ('allow', 'warn') as visible,
          case when not contains(classes, 'JWT') and action in ('mask', 'tokenize') then 'mask_needs_proxy' end as degraded_reason,
          case when contains(classes, 'JWT') then 'credential' else rule_scope end as rule_scope
        from {_JUDGED_SQL} j""",
)
def read_guard(spark, sf):
    return G.read_guard(_judged(spark, sf)).select(
        "actor_id", "doc_id", "action", "visible", "degraded_reason", "rule_scope"
    )


@query(
    "withheld_per_actor",
    f"select actor_id, count(*) as withheld from {_JUDGED_SQL} j where action not in ('allow', 'warn') group by 1",
)
def withheld_per_actor(spark, sf):
    return G.explain_withheld(G.retrieval_guard(_judged(spark, sf))).drop("summary")


@query(
    "admit_prompts",
    f"""with v as (select request_id, top >= 0.75 as red from {_VERDICT_SQL} v),
        c as (select request_id, bool_or(family = 'CREDENTIAL') as cred from {_F} f where not advisory_only and confidence >= 0.75 group by 1),
        r as (select o_orderkey as request_id, o_orderkey % 3 <> 0 as role_allows from orders where o_orderkey % 4 <> 0)
        select q.request_id, case when coalesce(v.red, false) and coalesce(c.cred, false) then 'credential' when r.role_allows = false then 'policy'
          when coalesce(v.red, false) and r.role_allows is null then 'checker' end as denied_by
        from {plant_sql('requests')} q left join v on v.request_id = q.request_id left join c on c.request_id = q.request_id left join r on r.request_id = q.request_id""",
)
def admit_prompts(spark, sf):
    f = plant(spark, sf, "line_findings")
    v = V.verdicts(f, ["request_id"])
    blocking = f.filter("not advisory_only and confidence >= 0.75")
    n = F.col("o_orderkey")
    roles = read(spark, sf, "orders").filter(n % 4 != 0).select(
        n.alias("request_id"), (n % 3 != 0).alias("role_allows")
    )
    out = G.admit(plant(spark, sf, "requests"), v, blocking, roles, ["request_id"])
    return out.select("request_id", "denied_by")


# ------------------------------------------------------------------- redaction

_SPAN_SQL = f"""(select o_orderkey as request_id, concat('messages[', cast(n as varchar), '].content') as span_path,
    concat('text of order ', cast(o_orderkey as varchar), ' part ', cast(n as varchar), ' ', md5(cast(o_orderkey as varchar)), md5(cast(o_custkey as varchar))) as text,
    case when n = 2 then 'system' else 'user' end as origin, cast(o_custkey as varchar) as scope,
    case o_orderkey % 4 when 0 then 'mask' when 1 then 'tokenize' when 2 then 'block' else 'allow' end as action
    from orders, (select unnest([0, 1, 2]) as n) t)"""


def _spans(spark, sf):
    o = read(spark, sf, "orders").withColumn("n", F.explode(F.array(*map(F.lit, (0, 1, 2)))))
    k = F.col("o_orderkey")
    return o.select(
        k.alias("request_id"),
        F.concat(F.lit("messages["), F.col("n"), F.lit("].content")).alias("span_path"),
        F.concat(
            F.lit("text of order "), k, F.lit(" part "), F.col("n"), F.lit(" "),
            F.md5(k.cast("string")), F.md5(F.col("o_custkey").cast("string")),
        ).alias("text"),
        F.when(F.col("n") == 2, "system").otherwise("user").alias("origin"),
        F.col("o_custkey").cast("string").alias("scope"),
    )


def _actions(spark, sf):
    k = F.col("o_orderkey")
    return read(spark, sf, "orders").select(
        k.alias("request_id"),
        F.when(k % 4 == 0, "mask").when(k % 4 == 1, "tokenize").when(k % 4 == 2, "block")
        .otherwise("allow").alias("action"),
    )


def _planned(spark, sf):
    f = plant(spark, sf, "line_findings").drop("origin")
    return R.plan_edits(
        _spans(spark, sf), f, _actions(spark, sf), ["request_id", "span_path"], ["request_id"],
        KEY, "scope",
    )


_VALUE = 'substr(s.text, cast(f.start + 1 as bigint), cast(f."end" - f.start as bigint))'
_NORM = (
    "(case when f.entity_class = 'EMAIL' then lower(trim(V)) when f.entity_class in ('PAN', 'GSTIN') "
    "then replace(replace(upper(trim(V)), ' ', ''), '-', '') when f.entity_class in ('AADHAAR', 'CREDIT_CARD') "
    "then regexp_replace(trim(V), '[^0-9]', '', 'g') else trim(V) end)"
).replace("V", _VALUE)
_TOKEN = (
    "(case when f.family = 'CREDENTIAL' then concat('⟨', f.entity_class, '⟩') when f.entity_class = 'EMAIL' "
    f"then concat('⟨EMAIL_', {Q.base32('mac')}, '⟩@example.invalid') else concat('⟨', f.entity_class, '_', {Q.base32('mac')}, '⟩') end)"
)
_EDIT_SQL = f"""(select f.request_id, f.span_path, f.start, f."end", f.confidence, f.text, f.action,
    case when f.action = 'mask' then concat('⟨', f.entity_class, '⟩') else {_TOKEN} end as replacement
    from (select f.*, s.text, s.action, {Q.hmac(KEY, "concat(s.scope, '|', f.entity_class, '|', " + _NORM + ")")} as mac
      from {_F} f join {_SPAN_SQL} s on s.request_id = f.request_id and s.span_path = f.span_path
      where not f.advisory_only and s.origin = 'user' and s.action in ('mask', 'tokenize')) f)"""


@query(
    "plan_redaction",
    f"select request_id, span_path, start, \"end\", replacement from {_EDIT_SQL} e",
)
def plan_redaction(spark, sf):
    return _planned(spark, sf).select(
        "request_id", "span_path", F.explode("edits").alias("e")
    ).select("request_id", "span_path", "e.start", "e.end", "e.replacement")


_OVERLAP_SQL = f"""(select request_id, span_path, count(*) as n, bool_or(prev > start) as clash from (
    select *, max("end") over (partition by request_id, span_path order by start, "end" rows between unbounded preceding and 1 preceding) as prev from {_EDIT_SQL} e0) o group by 1, 2)"""


# Rebuilt texts of edits that do not overlap, given as SQL.
def _rebuilt(edits: str) -> str:
    return f"""(select e.request_id, e.span_path, string_agg(substr(text, cast(coalesce(prev, 0) + 1 as bigint), cast(start - coalesce(prev, 0) as bigint)) || replacement, '' order by start) as head, max("end") as last
          from (select *, lag("end") over (partition by request_id, span_path order by start, "end") as prev from {edits} e1) e group by 1, 2)"""


def _verified(applied: str, edits: str) -> str:
    """Per span: no edit whose replacement is missing or whose original is left."""
    return f"""select r.request_id, r.span_path, r.status, case when r.status = 'overlap' then false else coalesce(k.ok, true) end as verified
        from {applied} r left join (select e.request_id, e.span_path, bool_and(contains(r2.redacted, e.replacement) and not contains(r2.redacted, substr(e.text, cast(e.start + 1 as bigint), cast(e."end" - e.start as bigint)))) as ok
          from {edits} e join {applied} r2 on r2.request_id = e.request_id and r2.span_path = e.span_path group by 1, 2) k
        on k.request_id = r.request_id and k.span_path = r.span_path"""


_APPLIED_SQL = f"""(select s.request_id, s.span_path, case when coalesce(o.clash, false) then 'overlap' when o.n > 0 then 'redacted' else 'clean' end as status,
          case when coalesce(o.clash, false) then null when o.n > 0 then g.head || substr(s.text, cast(g.last + 1 as bigint)) else s.text end as redacted
        from {_SPAN_SQL} s left join {_OVERLAP_SQL} o on o.request_id = s.request_id and o.span_path = s.span_path
        left join {_rebuilt(_EDIT_SQL)} g on g.request_id = s.request_id and g.span_path = s.span_path)"""
# Runs of overlapping edits: the widest span with the replacement of the most confident one,
# the first of these by start, end and replacement.
_MERGED_SQL = f"""(select request_id, span_path, min(start) as start, max("end") as "end", any_value(text) as text, first(replacement order by confidence desc, rn) as replacement
        from (select *, sum(fresh) over (partition by request_id, span_path order by rn) as run from (
          select *, case when prev is null or start >= prev then 1 else 0 end as fresh from (
            select *, row_number() over (partition by request_id, span_path order by start, "end", replacement) as rn,
              max("end") over (partition by request_id, span_path order by start, "end", replacement rows between unbounded preceding and 1 preceding) as prev from {_EDIT_SQL} e0) a) b) c
        group by request_id, span_path, run)"""
_MERGE_APPLIED_SQL = f"""(select s.request_id, s.span_path, case when g.head is null then 'clean' else 'redacted' end as status,
          case when g.head is null then s.text else g.head || substr(s.text, cast(g.last + 1 as bigint)) end as redacted
        from {_SPAN_SQL} s left join {_rebuilt(_MERGED_SQL)} g on g.request_id = s.request_id and g.span_path = s.span_path)"""


@query("apply_edits", f"select * from {_APPLIED_SQL} a")
def apply_edits(spark, sf):
    """Redacted text of every span; overlapping edits are a status."""
    return R.apply_edits(_planned(spark, sf)).select(
        "request_id", "span_path", "status", "redacted"
    )


@query("verify_redaction", _verified(_APPLIED_SQL, _EDIT_SQL))
def verify_redaction(spark, sf):
    """Every span with its status and whether its redaction verifies."""
    return R.verify_redaction(R.apply_edits(_planned(spark, sf))).select(
        "request_id", "span_path", "status", "verified"
    )


@query("verify_merged_redaction", _verified(_MERGE_APPLIED_SQL, _MERGED_SQL))
def verify_merged_redaction(spark, sf):
    """With overlaps merged every span is rewritten; whether it verifies."""
    return R.verify_redaction(R.apply_edits(_planned(spark, sf), overlaps="merge")).select(
        "request_id", "span_path", "status", "verified"
    )


@query(
    "find_overlaps",
    f"""select request_id, span_path, start, "end", entity_class from (
          select *, max("end") over (partition by request_id, span_path order by start, "end", entity_class rows between unbounded preceding and 1 preceding) as prev from {_F} f) t
        where prev > start""",
)
def find_overlaps(spark, sf):
    return R.find_overlaps(plant(spark, sf, "line_findings"), ["request_id", "span_path"]).select(
        "request_id", "span_path", "start", "end", "entity_class"
    )


@query(
    "redact_nodes",
    f"""select conv_id, turn, case when turn % 4 = 0 then '[blocked by policy]' when turn % 4 in (1, 2) then repeat('█', cast(least(greatest(length(text), 1), 32) as int)) else text end as redacted from conversations""",
)
def redact_nodes(spark, sf):
    k = F.col("turn") % 4
    d = read(spark, sf, "conversations").withColumn(
        "action",
        F.when(k == 0, "block").when(k == 1, "mask").when(k == 2, "tokenize").otherwise("allow"),
    )
    return R.redact_nodes(d).select("conv_id", "turn", "redacted")


@query(
    "lift_nested",
    """select conv_id, case when turn % 2 = 1 then concat('m[', cast(turn - 1 as varchar), ']') else concat('m[', cast(turn as varchar), ']') end as span_path,
         cast(case when turn % 2 = 1 then 3 + 10 else 3 end as int) as start, cast(case when turn % 2 = 1 then 9 + 10 else 9 end as int) as "end" from conversations""",
)
def lift_nested(spark, sf):
    c = read(spark, sf, "conversations")
    path = F.concat(F.lit("m["), F.col("turn"), F.lit("]"))
    spans = c.select(
        "conv_id", path.alias("span_path"),
        F.when(F.col("turn") % 2 == 1, F.concat(F.lit("m["), F.col("turn") - 1, F.lit("]"))).alias("parent_path"),
        F.when(F.col("turn") % 2 == 1, 10).alias("parent_char_offset"),
    )
    edits = c.select("conv_id", path.alias("span_path"), F.lit(3).alias("start"), F.lit(9).alias("end"))
    return R.lift_nested(edits, spans, ["conv_id"])


# ---------------------------------------------------------------------- tokens

_MAIL = "concat('User', cast(c_custkey as varchar), '@Mail.example')"


@query(
    "derive_tokens",
    f"""select c_custkey, concat('⟨EMAIL_', {Q.base32('m1')}, '⟩@example.invalid') as mail, concat('⟨PHONE_', {Q.base32('m2')}, '⟩') as phone, cast(null as varchar) as secret
        from (select c_custkey, {Q.hmac(KEY, f"concat('s', cast(c_nationkey as varchar), '|EMAIL|', lower({_MAIL}))")} as m1,
          {Q.hmac(KEY, "concat('s', cast(c_nationkey as varchar), '|PHONE|', '98', lpad(cast(c_custkey as varchar), 8, '0'))")} as m2 from customer) t""",
)
def derive_tokens(spark, sf):
    k = F.col("c_custkey")
    scope = F.concat(F.lit("s"), F.col("c_nationkey").cast("string"))
    mail = F.concat(F.lit("User"), k.cast("string"), F.lit("@Mail.example "))
    phone = F.concat(F.lit("98-"), F.lpad(k.cast("string"), 8, "0"))

    def token(cls, v):
        return derive_token(KEY, scope, F.lit(cls), v, never_tokenize(F.lit(cls)))

    return read(spark, sf, "customer").select(
        "c_custkey", token("EMAIL", mail).alias("mail"), token("PHONE", phone).alias("phone"),
        token("JWT", phone).alias("secret"),
    )


#: All 48 characters of a token, twelve from each 15 digits.
_LONGEST = " || ".join(Q.base32(f"substr(m.mac, {1 + 15 * k})", 12) for k in range(4))


@query(
    "widen_collisions",
    f"""with m as (select c_custkey, {Q.hmac(KEY, f"concat('s|EMAIL|', lower({_MAIL}))")} as mac from customer),
        d as (select distinct mac from m),
        w as (select mac, w, substr({Q.base32('mac', 12)}, 1, cast(w as bigint)) as p from d, (select unnest(range(3, 13)) as w) t),
        a as (select *, count(*) over (partition by w, p) as n from w),
        u as (select mac, min(w) as w from a where n = 1 group by mac)
        select c_custkey, cast(coalesce(w, 48) as int) as width,
          concat('⟨EMAIL_', substr({_LONGEST}, 1, coalesce(w, 48)), '⟩@example.invalid') as token from m left join u on u.mac = m.mac""",
)
def widen_collisions(spark, sf):
    """Tokens of all customers in one scope, widened until no two share one."""
    t = read(spark, sf, "customer").select(
        "c_custkey", F.lit("s").alias("scope"), F.lit("EMAIL").alias("entity_class"),
        F.concat(F.lit("User"), F.col("c_custkey").cast("string"), F.lit("@Mail.example")).alias("v"),
    )
    return R.widen_collisions(t, KEY, "scope", "entity_class", "v").select(
        "c_custkey", "width", "token"
    )
