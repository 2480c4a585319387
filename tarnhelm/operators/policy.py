"""Policy tables and the decision per finding, as one plan over joined rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnhelm.functions.lattice import action_of, rank
from tarnhelm.schema import FAMILY_OF
from tarnhelm.sources.stored import keep


def _list(col: Column) -> Column:
    return F.coalesce(col, F.array().cast("array<string>"))


def root_tenant(tenants: DataFrame) -> DataFrame:
    """Root of every tenant by pointer doubling, until no pointer moves.

    A chain of n tenants needs log2(n) rounds; only pointers in a cycle still move after that.
    Columns: tenant_id, root_id, status (ok, cycle, missing).
    """
    step = keep(tenants.select(
        F.col("id").alias("tenant_id"),
        F.coalesce("parent_id", "id").alias("ptr"),
    ))
    for _ in range(step.count().bit_length()):
        up = step.select(F.col("tenant_id").alias("ptr"), F.col("ptr").alias("_next"))
        moved = keep(step.join(up, "ptr", "left").select(
            "tenant_id", F.coalesce("_next", "ptr").alias("ptr"),
            (F.col("_next") != F.col("ptr")).alias("_moved"),
        ))
        step = moved.drop("_moved")
        if moved.where("_moved").isEmpty():
            break
    tops = tenants.select(
        F.col("id").alias("ptr"), F.col("parent_id").isNull().alias("_is_root"),
        F.lit(True).alias("_known"),
    )
    out = step.join(tops, "ptr", "left")
    status = (
        F.when(F.col("_known").isNull(), "missing").when(F.col("_is_root"), "ok")
        .otherwise("cycle")
    )
    return out.select(
        "tenant_id", F.when(status == "ok", F.col("ptr")).alias("root_id"),
        status.alias("status"),
    )


def rules_table(policies: DataFrame) -> DataFrame:
    """One row per rule in file order."""
    return policies.select(
        "tenant_id", "version", F.posexplode("rules").alias("rule_index", "rule")
    ).select("tenant_id", "version", "rule_index", "rule.*")


def resolve_policies(tenants: DataFrame, policies: DataFrame) -> DataFrame:
    """Active organisation and business-unit policy of every tenant.

    A tenant with a parent takes the parent's policy as ``org`` and its own, if any, as
    ``bu``; a root has no ``bu``.
    """
    active = policies.filter("active").select(
        F.col("tenant_id").alias("_owner"),
        F.struct(
            "version", "mode", "default", "unregistered_workload", "rules", "content_hash"
        ).alias("_policy"),
    )
    org = active.select(F.col("_owner").alias("_org_id"), F.col("_policy").alias("org"))
    bu = active.select(F.col("_owner").alias("_bu_id"), F.col("_policy").alias("bu"))
    t = tenants.select(
        F.col("id").alias("tenant_id"),
        F.coalesce("parent_id", "id").alias("_org_id"),
        F.when(F.col("parent_id").isNotNull(), F.col("id")).alias("_bu_id"),
    )
    return t.join(org, "_org_id", "left").join(bu, "_bu_id", "left").select(
        "tenant_id", F.col("_org_id").alias("org_tenant_id"), "org", "bu"
    )


def _matches(rule: Column, cls: Column, leg: Column, destination: Column) -> Column:
    dests = _list(rule["destination"])
    return (
        (rule["direction"].isNull() | (rule["direction"] == leg))
        & ((F.size(_list(rule["class"])) == 0) | F.array_contains(rule["class"], cls))
        & (
            (F.size(dests) == 0)
            | F.coalesce(F.array_contains(dests, destination), F.lit(False))
        )
    )


def _last_index(rules: Column, cls: Column, leg: Column, destination: Column) -> Column:
    """Index of the last matching rule, or null."""
    return F.array_max(
        F.transform(rules, lambda r, i: F.when(_matches(r, cls, leg, destination), i))
    )


def _covers(block: Column, role: Column, groups: Column, destination: Column) -> Column:
    return (
        F.arrays_overlap(_list(block["actor_group"]), groups)
        | F.array_contains(_list(block["actor_role"]), role)
        | F.coalesce(F.array_contains(_list(block["destination"]), destination), F.lit(False))
    )


def _is_cleared(
    rule: Column, leg: Column, role: Column, groups: Column, destination: Column
) -> Column:
    """Inbound reads the ``unless`` blocks, outbound the ``except`` blocks."""
    blocks = F.when(leg == "inbound", rule["unless"]).otherwise(rule["except"])
    return F.coalesce(
        F.exists(blocks, lambda b: _covers(b, role, groups, destination)), F.lit(False)
    )


def match_rules(findings: DataFrame, rules: DataFrame, on: str = "tenant_id") -> DataFrame:
    """Findings joined to every rule of their tenant that applies to them."""
    f, r = findings.alias("f"), rules.alias("r")
    cond = (
        (F.col(f"f.{on}") == F.col(f"r.{on}"))
        & (F.col("r.direction").isNull() | (F.col("r.direction") == F.col("f.leg")))
        & (
            (F.size(_list(F.col("r.class"))) == 0)
            | F.array_contains("r.class", F.col("f.entity_class"))
        )
        & (
            (F.size(_list(F.col("r.destination"))) == 0)
            | F.coalesce(
                F.array_contains("r.destination", F.col("f.destination")), F.lit(False)
            )
        )
    )
    keep = [F.col(f"r.{c}") for c in rules.columns if c not in (on, "direction", "destination")]
    return f.join(r, cond).select("f.*", *keep)


#: Indices of rules that are sent to all tasks at once.
SENT_INDEXES = 2_000_000


def folded_matches(
    findings: DataFrame, rules: DataFrame, on: str = "tenant_id", most: int = 10_000,
    seen: DataFrame | None = None,
) -> DataFrame:
    """``match_rules`` with rules that differ in their index alone on one row.

    ``rule_indexes`` has their indices, at most ``most`` of them in a row. Which rules apply
    depends on tenant, class, leg and destination alone, so rules meet the combinations that
    occur; a finding meets what is left of the rules' other columns. Exploding ``rule_indexes``
    gives a row per finding and rule without a shuffle. ``seen`` holds the different
    combinations, or more than occur, where they come cheaper than from the findings. Up to
    ``SENT_INDEXES`` indices go to the findings, however little Spark broadcasts by itself.
    """
    where = [on, "entity_class", "leg", "destination"]
    conditions = ("direction", "class", "destination")
    rest = [c for c in rules.columns if c not in (on, "rule_index", *conditions)]
    seen = findings.select(*where).distinct() if seen is None else seen
    pairs = match_rules(seen, rules, on).select(*where, "rule_index", *rest)
    spoken = keep(pairs.groupBy(*where, *rest, F.floor(F.col("rule_index") / most)).agg(
        F.sort_array(F.collect_list("rule_index")).alias("rule_indexes")
    ).select(*where, *rest, "rule_indexes"))
    indexes = spoken.agg(F.sum(F.size("rule_indexes"))).first()[0] or 0
    spoken = F.broadcast(spoken) if indexes <= SENT_INDEXES else spoken
    same = reduce(and_, [F.col(f"f.{c}").eqNullSafe(F.col(f"s.{c}")) for c in where])
    return findings.alias("f").join(spoken.alias("s"), same).select(
        "f.*", *[F.col(f"s.{c}") for c in (*rest, "rule_indexes")])


def cleared(matches: DataFrame) -> DataFrame:
    """Matches marked with whether the actor is cleared for the rule."""
    rule = F.struct("unless", "except")
    return matches.withColumn("_rule", rule).withColumn(
        "cleared",
        _is_cleared(
            F.col("_rule"), F.col("leg"), F.col("role"), F.col("groups"), F.col("destination")
        ),
    ).drop("_rule")


def last_match(matches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The last rule in file order per finding; partial aggregation, no window."""
    rest = [c for c in matches.columns if c not in keys]
    return matches.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), "rule_index").alias("_m")
    ).select(*keys, "_m.*")


def _conditions(rules: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rules folded by what they apply to: of equal conditions only the last can speak."""
    def tidy(name):
        return F.array_sort(F.array_distinct(_list(F.col(name))))

    return rules.select(
        *keys, "rule_index", "direction",
        tidy("class").alias("class"), tidy("destination").alias("destination"),
    ).groupBy(*keys, "direction", "class", "destination").agg(
        F.max("rule_index").alias("rule_index")
    )


def last_matching_rule(
    findings: DataFrame, rules: DataFrame, keys: Sequence[str], on: str = "tenant_id"
) -> DataFrame:
    """Last rule in file order per finding (``keys``) with the rule's other columns.

    Which rule that is depends on tenant, class, leg and destination alone, so it is worked
    out once per combination that occurs; a finding meets one row, never all its rules.
    A finding belongs to one tenant.
    """
    where = [on, "entity_class", "leg", "destination"]
    seen = findings.select(*where).distinct()
    speaks = keep(match_rules(seen, _conditions(rules, [on]), on).groupBy(*where).agg(
        F.max("rule_index").alias("rule_index")
    ))
    same = reduce(and_, [F.col(f"f.{c}").eqNullSafe(F.col(f"s.{c}")) for c in where])
    hits = findings.select(*dict.fromkeys([*keys, *where])).alias("f").join(
        speaks.alias("s"), same
    ).select("f.*", "s.rule_index")
    last = hits.groupBy(*dict.fromkeys([*keys, on])).agg(F.max("rule_index").alias("rule_index"))
    return last.join(rules, [on, "rule_index"])


def compile_policies(resolved: DataFrame, classes: Sequence[str] | None = None) -> DataFrame:
    """The rule that speaks for every (tenant, class, leg, destination).

    Rules are ordered lists; which one is the last to match depends on nothing but these
    four, so it is worked out once per combination instead of once per finding. A null
    destination stands for every destination that no rule of the tenant names. Only the
    different conditions of a policy meet the combinations; the rule is fetched by its index.
    """
    c = F.col
    classes = list(FAMILY_OF) if classes is None else list(classes)
    header = ("version", "mode", "default", "unregistered_workload")
    grid = resolved.select(
        "tenant_id",
        F.struct(*[c(f"org.{f}").alias(f) for f in header]).alias("org"),
        F.when(c("bu").isNotNull(), F.struct(c("bu.version").alias("version"))).alias("bu"),
    )
    spoken = {}
    for scope in ("org", "bu"):
        rules = resolved.select(
            "tenant_id", F.posexplode(f"{scope}.rules").alias("rule_index", "rule")
        )
        spoken[scope] = rules.select(
            "tenant_id", c("rule_index").alias(f"_{scope[0]}i"), c("rule").alias(f"_{scope[0]}r")
        )
        folded = _conditions(rules.select("tenant_id", "rule_index", "rule.*"), ["tenant_id"])
        grid = grid.join(
            folded.groupBy("tenant_id").agg(
                F.collect_list(F.struct("direction", "class", "destination", "rule_index"))
                .alias(f"_{scope}")
            ),
            "tenant_id", "left",
        )

    def named(scope):
        places = F.flatten(F.transform(c(scope), lambda r: r["destination"]))
        return F.coalesce(places, F.array().cast("array<string>"))

    places = F.array_distinct(
        F.concat(F.array(F.lit(None).cast("string")), named("_org"), named("_bu"))
    )
    legs = F.array(F.lit("inbound"), F.lit("outbound"))
    grid = (
        grid.withColumn("destination", F.explode(places))
        .withColumn("entity_class", F.explode(F.array(*[F.lit(x) for x in classes])))
        .withColumn("leg", F.explode(legs))
    )
    where = (c("entity_class"), c("leg"), c("destination"))

    def last(scope):
        return F.array_max(
            F.transform(c(scope), lambda r: F.when(_matches(r, *where), r["rule_index"]))
        )

    grid = grid.withColumns({"_oi": last("_org"), "_bi": last("_bu")})
    return (
        grid.join(spoken["org"], ["tenant_id", "_oi"], "left")
        .join(spoken["bu"], ["tenant_id", "_bi"], "left")
        .select(
            "tenant_id", "entity_class", "leg", "destination", "_oi", "_or", "_bi", "_br",
            "org", "bu",
        )
    )


def decide_findings(findings: DataFrame, resolved: DataFrame) -> DataFrame:
    """``decide`` for a whole findings table joined to the compiled policies.

    The findings carry tenant_id and the actor columns of ``decide``. Only the one rule
    per policy that speaks travels with a finding, not the policy. Tenants without an
    organisation policy have no decision and drop out, as they do upstream with an error.
    """
    compiled = keep(compile_policies(resolved.filter("org is not null")))
    return decide_compiled(findings, compiled)


def decide_compiled(findings: DataFrame, compiled: DataFrame) -> DataFrame:
    """``decide`` for findings whose policies ``compile_policies`` has compiled."""
    c = F.col
    extra = ["_oi", "_or", "_bi", "_br", "org", "bu"]
    keys = ["tenant_id", "entity_class", "leg"]
    # One row per place; a finding takes its own destination if a rule names it.
    named = compiled.filter("destination is not null").select(
        *keys, "destination", F.struct(*extra).alias("_named")
    )
    other = compiled.filter("destination is null").select(
        *keys, F.struct(*extra).alias("_other")
    )
    joined = (
        findings.join(other, keys)
        .join(named, [*keys, "destination"], "left")
        .withColumn("_rule", F.coalesce("_named", "_other"))
    )
    rows = joined.select(*findings.columns, *[c(f"_rule.{x}").alias(x) for x in extra])
    return _decide(rows, [x for x in findings.columns if x != "exceptions"])


#: What a decision depends on besides the policies of the tenant.
SITUATION = ("entity_class", "leg", "destination", "registered", "role", "groups", "exceptions")


def decide_rows(findings: DataFrame, resolved: DataFrame, carry: Sequence[str]) -> DataFrame:
    """``decide`` with the whole policies on a row, once per situation instead of per finding.

    Findings of one tenant that agree in ``SITUATION`` get the same decision. Each situation
    that occurs meets its policies once and the findings take its decision; ``carry`` names
    the columns of the findings to return.
    """
    where = ["tenant_id", *[x for x in SITUATION if x in findings.columns]]
    seen = findings.select(*where).distinct()
    decided = decide(
        seen.select("*", *[F.col(x).alias(f"_s_{x}") for x in where]).join(resolved, "tenant_id")
    )
    same = reduce(and_, [F.col(f"f.{x}").eqNullSafe(F.col(f"d._s_{x}")) for x in where])
    made = [x for x in decided.columns if x not in where and not x.startswith("_s_")]
    return findings.alias("f").join(keep(decided).alias("d"), same).select(
        *[F.col(f"f.{x}") for x in carry], *[F.col(f"d.{x}") for x in made]
    )


def decide(findings: DataFrame) -> DataFrame:
    """Decision per finding whose row carries its policies.

    Needs entity_class, leg, destination, registered, role, groups, org, bu (see
    ``resolve_policies``) and, optionally, ``exceptions`` (approved classes). Everything
    is a column expression on the row: no shuffle, no window.
    """
    c = F.col
    where = (c("entity_class"), c("leg"), c("destination"))
    df = findings.withColumns(
        {
            "_oi": _last_index(c("org.rules"), *where),
            "_bi": _last_index(c("bu.rules"), *where),
        }
    )
    df = df.withColumns({"_or": F.get("org.rules", c("_oi")), "_br": F.get("bu.rules", c("_bi"))})
    return _decide(df, [x for x in findings.columns if x not in ("org", "bu", "exceptions")])


def _decide(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Decision from the speaking rule of each policy (``_or``, ``_br``)."""
    c = F.col
    exceptions = (
        _list(c("exceptions")) if "exceptions" in df.columns
        else F.array().cast("array<string>")
    )
    base = F.when(c("registered"), c("org.default")).otherwise(c("org.unregistered_workload"))
    who = (c("leg"), c("role"), c("groups"), c("destination"))
    df = df.withColumns(
        {
            "_base": rank(base),
            "_oc": c("_oi").isNotNull() & _is_cleared(c("_or"), *who),
            "_bc": c("_bi").isNotNull() & _is_cleared(c("_br"), *who),
        }
    )
    df = df.withColumns(
        {
            "_oa": F.when(c("_oi").isNull() | c("_oc"), c("_base")).otherwise(
                rank(c("_or.action"))
            ),
            "_ba": F.when(c("_bi").isNull(), F.lit(None).cast("int")).when(
                c("_bc"), c("_base")
            ).otherwise(rank(c("_br.action"))),
        }
    )
    # A business unit names the decision only when it raises it, or when no
    # organisation rule spoke; a weaker one is clamped.
    df = df.withColumn(
        "_by_bu",
        c("_bi").isNotNull() & (c("_ba") >= c("_oa"))
        & ((c("_ba") > c("_oa")) | c("_oi").isNull()),
    )
    excepted = F.array_contains(exceptions, c("entity_class"))
    final = F.when(excepted, c("_base")).otherwise(
        F.greatest(c("_oa"), F.coalesce("_ba", "_oa"))
    )
    escalate = F.coalesce(
        (c("_oi").isNotNull() & ~c("_oc") & c("_or.escalate"))
        | (c("_by_bu") & ~c("_bc") & c("_br.escalate")),
        F.lit(False),
    )
    trace = F.filter(
        F.array(
            F.when(c("registered"), F.concat(F.lit("1. start at default="), action_of(c("_base"))))
            .otherwise(F.concat(F.lit("1. unregistered actor, start at "), action_of(c("_base")))),
            F.when(
                c("_oi").isNotNull(),
                F.concat(F.lit("2. org rule "), c("_oi"), F.lit(" -> "), c("_or.action")),
            ).otherwise("2. no org rule matches"),
            F.when(
                c("_bi").isNotNull(),
                F.concat(F.lit("3. bu rule "), c("_bi"), F.lit(" -> "), c("_br.action")),
            ).when(c("bu").isNotNull(), "3. no bu rule matches"),
            F.when(c("_ba") < c("_oa"), F.concat(F.lit("3. bu clamped to "), action_of(c("_oa")))),
            F.when(c("_oc"), F.concat(F.lit("4. org rule cleared -> "), action_of(c("_base")))),
            F.when(c("_bc"), F.concat(F.lit("4. bu rule cleared -> "), action_of(c("_base")))),
            F.when(
                excepted, F.concat(F.lit("5. approved exception -> "), action_of(c("_base")))
            ).otherwise("5. no approved exception"),
            F.concat(F.lit("6. escalate="), escalate.cast("string")),
        ),
        lambda t: t.isNotNull(),
    )
    return df.select(
        *keep,
        action_of(final).alias("action"),
        F.when(c("_by_bu"), c("_bi")).otherwise(c("_oi")).alias("rule_index"),
        F.when(excepted, "exception").when(c("_by_bu"), "bu").when(c("_oi").isNotNull(), "org")
        .otherwise("default").alias("rule_scope"),
        (c("_oc") | c("_bc") | excepted).alias("exception_applied"),
        escalate.alias("escalate"),
        F.when(c("_by_bu"), c("_br.reason")).otherwise(c("_or.reason")).alias("reason"),
        c("org.version").alias("org_policy_version"),
        c("bu.version").alias("bu_policy_version"),
        c("org.default").alias("policy_default"),
        c("org.mode").alias("mode"),
        trace.alias("trace"),
    )


def active_exceptions(exceptions: DataFrame, requests: DataFrame) -> DataFrame:
    """Approved, unexpired exception classes per request as a sorted array.

    Exceptions are folded first: per tenant, and per tenant and actor, the latest expiry
    of each class. A request then meets at most one row of either and is not multiplied.
    """
    live = exceptions.filter("approved_by is not null")

    def folded(df, keys, name):
        latest = df.groupBy(*keys, "entity_class").agg(F.max("expires_at").alias("expires_at"))
        return latest.groupBy(*keys).agg(
            F.collect_list(F.struct("entity_class", "expires_at")).alias(name)
        )

    wide = folded(live.filter("actor_id is null"), ["tenant_id"], "_wide")
    own = folded(live.filter("actor_id is not null"), ["tenant_id", "actor_id"], "_own")
    empty = F.array().cast(wide.schema["_wide"].dataType)
    both = F.concat(F.coalesce("_wide", empty), F.coalesce("_own", empty))
    classes = F.transform(
        F.filter(both, lambda e: e["expires_at"] > F.col("decided_at")),
        lambda e: e["entity_class"],
    )
    return (
        requests.select("request_id", "tenant_id", "actor_id", "decided_at")
        .join(wide, "tenant_id", "left").join(own, ["tenant_id", "actor_id"], "left")
        .select("request_id", F.sort_array(F.array_distinct(classes)).alias("exceptions"))
        .filter(F.size("exceptions") > 0)
    )


def overall(decisions: DataFrame, keys: Sequence[str], order: str = "ord") -> DataFrame:
    """Strongest action per request with its attribution and summaries.

    One partial aggregation: the strongest action, the rule of the first finding that
    reached it, and the sorted classes and paths.
    """
    r = rank(F.col("action"))
    first = F.min_by(
        F.struct("rule_index", "rule_scope"), F.struct(-r, F.col(order))
    )
    agg = [
        F.max(r).alias("_top"),
        first.alias("_first"),
        F.bool_or("exception_applied").alias("exception_applied"),
        F.bool_or("escalate").alias("escalate"),
        F.sort_array(F.collect_set("entity_class")).alias("finding_classes"),
        F.first("mode").alias("mode"),
    ]
    if "span_path" in decisions.columns:
        agg.append(F.sort_array(F.collect_set("span_path")).alias("finding_paths"))
    out = decisions.groupBy(*keys).agg(*agg)
    paths = ["finding_paths"] if "span_path" in decisions.columns else []
    return out.select(
        *keys, action_of(F.col("_top")).alias("action"), F.col("_first.rule_index"),
        F.col("_first.rule_scope"), "exception_applied", "escalate", "finding_classes",
        *paths, "mode",
    )


def overall_action(
    decisions: DataFrame, requests: DataFrame, keys: Sequence[str], default: str = "allow"
) -> DataFrame:
    """Strongest action per request; the default where nothing was found."""
    top = decisions.groupBy(*keys).agg(F.max(rank(F.col("action"))).alias("_top"))
    return requests.select(*keys).join(top, list(keys), "left").select(
        *keys, F.coalesce(action_of(F.col("_top")), F.lit(default)).alias("action")
    )


def applied_action(decisions: DataFrame, mode_semantics: str = "control") -> DataFrame:
    """What is really done. Tokenising needs a vault, so it is applied as a mask.

    ``control``: shadow mode applies nothing. ``gateway``: shadow mode lowers only mask
    and block, a warning stays a warning.
    """
    action = F.col("action")
    degraded = F.when(action == "tokenize", "mask").otherwise(action)
    shadow = F.col("mode") == "shadow"
    if mode_semantics == "control":
        applied = F.when(shadow, "allow").otherwise(degraded)
    else:
        applied = F.when(shadow & degraded.isin("block", "mask"), "allow").otherwise(degraded)
    return decisions.withColumns(
        {
            "applied_action": applied,
            "degraded_reason": F.when(action == "tokenize", "tokenize_needs_vault"),
        }
    )


def combine_legs(outbound: DataFrame, inbound: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Strongest action of both legs of a request."""
    both = outbound.select(*keys, "action").unionByName(inbound.select(*keys, "action"))
    return both.groupBy(*keys).agg(
        action_of(F.max(rank(F.col("action")))).alias("action")
    )


def bu_may_only_raise(org_rules: DataFrame, bu_rules: DataFrame) -> DataFrame:
    """Pairs where a business-unit rule is weaker than an overlapping organisation rule.

    ``bu_rules`` carries ``org_tenant_id``; rules meet on that tenant, so the join is an
    equi-join over configuration rows.
    """
    o, b = org_rules.alias("o"), bu_rules.alias("b")

    def meets(field: str) -> Column:
        x, y = _list(F.col(f"o.{field}")), _list(F.col(f"b.{field}"))
        return (F.size(x) == 0) | (F.size(y) == 0) | F.arrays_overlap(x, y)

    no_clearance = (F.size(F.coalesce("b.unless", F.array())) == 0) & (
        F.size(F.coalesce("b.except", F.array())) == 0
    )
    cond = (
        (F.col("o.tenant_id") == F.col("b.org_tenant_id"))
        & (
            F.col("o.direction").isNull() | F.col("b.direction").isNull()
            | (F.col("o.direction") == F.col("b.direction"))
        )
        & meets("class") & meets("destination")
    )
    return o.join(b, cond).filter(
        no_clearance & (rank(F.col("b.action")) < rank(F.col("o.action")))
    ).select(
        F.col("b.tenant_id").alias("tenant_id"), F.col("b.version").alias("version"),
        F.col("b.rule_index").alias("bu_rule_index"),
        F.col("o.rule_index").alias("org_rule_index"),
        F.col("b.action").alias("bu_action"), F.col("o.action").alias("org_action"),
    )


def versions(policies: DataFrame) -> DataFrame:
    """Versions newest first with the next free number and an activity check."""
    per = W.partitionBy("tenant_id")
    return policies.select(
        "tenant_id", "version", "active",
        (F.max("version").over(per) + 1).alias("next_version"),
        (F.count_if("active").over(per) <= 1).alias("one_active"),
    ).orderBy("tenant_id", F.desc("version"))


def policy_diff(policies: DataFrame, old: int, new: int) -> DataFrame:
    """What changed between two versions, one list of notes per tenant that has either."""
    a = policies.filter(F.col("version") == old).alias("a")
    b = policies.filter(F.col("version") == new).alias("b")
    both = a.join(b, F.col("a.tenant_id") == F.col("b.tenant_id"), "full_outer")

    def note(label: str, field: str) -> Column:
        x, y = F.col(f"a.{field}"), F.col(f"b.{field}")
        return F.when(
            ~x.eqNullSafe(y),
            F.concat(F.lit(f"{label} "), F.coalesce(x, F.lit("none")), F.lit(" -> "),
                     F.coalesce(y, F.lit("none"))),
        )

    none = F.array().cast(policies.schema["rules"].dataType)
    rules = [F.coalesce(F.col(f"{x}.rules"), none) for x in "ab"]
    sizes = tuple(F.size(r) for r in rules)
    pairs = F.zip_with(
        *rules,
        lambda x, y: F.struct(x["action"].alias("x"), y["action"].alias("y")),
    )
    per_rule = F.transform(
        pairs,
        lambda p, i: F.when(
            p["x"] != p["y"],
            F.concat(F.lit("rule "), i, F.lit(" action "), p["x"], F.lit(" -> "), p["y"]),
        ),
    )
    notes = F.filter(
        F.concat(
            F.array(
                note("default", "default"), note("mode", "mode"),
                note("unregistered_workload", "unregistered_workload"),
                F.when(
                    sizes[0] != sizes[1],
                    F.concat(F.lit("rules "), sizes[0], F.lit(" -> "), sizes[1]),
                ),
            ),
            per_rule,
        ),
        lambda n: n.isNotNull(),
    )
    return both.select(
        F.coalesce("a.tenant_id", "b.tenant_id").alias("tenant_id"),
        F.when(F.size(notes) == 0, F.array(F.lit("no material change"))).otherwise(notes)
        .alias("notes"),
    )


def publish(drafts: DataFrame, policies: DataFrame, tenants: DataFrame) -> DataFrame:
    """Accepted or refused per draft, with the version an accepted one would get.

    A draft carries tenant_id, org, business_unit, mode, fail, expected_version, rules,
    ``default`` and ``unregistered_workload``; mode and fail are null where the file
    does not name them. Of several drafts of a tenant that would pass, one does: the next
    version is then taken.
    """
    content = F.to_json(F.struct(*drafts.columns), {"ignoreNullFields": "false"})
    drafts = drafts.withColumn("_draft", F.sha2(content, 256))
    current = policies.filter("active").select(
        "tenant_id", F.col("version").alias("_active")
    )
    tree = tenants.select(
        F.col("id").alias("tenant_id"), "parent_id", F.lit(True).alias("_known")
    )
    latest = policies.groupBy("tenant_id").agg(F.max("version").alias("_latest"))
    d = drafts.join(tree, "tenant_id", "left").join(current, "tenant_id", "left").join(
        latest, "tenant_id", "left")
    next_version = F.coalesce(F.col("_latest"), F.lit(0)) + 1
    org = rules_table(policies.filter("active"))
    # A draft stands for its tenant here, so that each is judged by its own rules.
    bu = d.filter("parent_id is not null").select(
        F.col("_draft").alias("tenant_id"), next_version.alias("version"),
        F.col("parent_id").alias("org_tenant_id"),
        F.posexplode("rules").alias("rule_index", "_r"),
    ).select("tenant_id", "version", "org_tenant_id", "rule_index", "_r.*")
    weak = bu_may_only_raise(org, bu).groupBy(F.col("tenant_id").alias("_draft")).agg(
        F.min("bu_rule_index").alias("_weak_rule")
    )
    root = F.col("parent_id").isNull()
    reason = (
        F.when(F.col("_known").isNull(), "tenant not registered")
        .when(root & ~F.col("org").eqNullSafe(F.col("tenant_id")), "org does not name the tenant")
        .when(root & F.col("business_unit").isNotNull(), "org policy names a business unit")
        .when(root & F.col("mode").isNull(), "org policy must set mode")
        .when(root & (F.coalesce("fail", F.lit("closed")) != "closed"), "fail must be closed")
        .when(~root & ~F.col("org").eqNullSafe(F.col("parent_id")), "org does not name the parent")
        .when(
            ~root & ~F.col("business_unit").eqNullSafe(F.col("tenant_id")),
            "business_unit does not name the tenant",
        )
        .when(
            ~root & (F.col("mode").isNotNull() | F.col("fail").isNotNull()),
            "business unit must omit mode and fail",
        )
        .when(~F.col("expected_version").eqNullSafe(F.col("_active")), "version conflict")
        .when(F.col("_weak_rule").isNotNull(), "business unit weakens an org rule")
    )
    judged = d.join(weak, "_draft", "left").select(
        "tenant_id", "_draft", reason.alias("_reason"), next_version.alias("_next"))
    first = F.row_number().over(
        W.partitionBy("tenant_id", F.col("_reason").isNull()).orderBy("_draft"))
    judged = judged.withColumn("reason", F.coalesce(
        "_reason", F.when(first > 1, "version conflict")))
    return judged.select(
        "tenant_id", F.col("reason").isNull().alias("accepted"), "reason",
        F.when(F.col("reason").isNull(), F.col("_next")).alias("version"),
    )


def rollback(policies: DataFrame, targets: DataFrame, tenants: DataFrame) -> DataFrame:
    """Old versions published again as the next one; ``targets``: tenant_id, to_version.

    The old rules go through the same check as a draft: those of a business unit may only raise
    what its organisation's active policy says today, else the row is refused. ``retired`` is
    the version that stops being active; ``with_rollback`` applies the result.
    """
    top = policies.groupBy("tenant_id").agg(
        F.max("version").alias("_latest"),
        F.max(F.when(F.col("active"), F.col("version"))).alias("_active"))
    old = targets.join(
        policies.withColumnRenamed("version", "to_version").drop("active"),
        ["tenant_id", "to_version"],
    ).join(top, "tenant_id").join(
        tenants.select(F.col("id").alias("tenant_id"), "parent_id"), "tenant_id", "left")
    bu = old.filter("parent_id is not null").select(
        "tenant_id", (F.col("_latest") + 1).alias("version"),
        F.col("parent_id").alias("org_tenant_id"),
        F.posexplode("rules").alias("rule_index", "_r"),
    ).select("tenant_id", "version", "org_tenant_id", "rule_index", "_r.*")
    weak = bu_may_only_raise(rules_table(policies.filter("active")), bu).groupBy(
        "tenant_id").agg(F.min("bu_rule_index").alias("_weak_rule"))
    reason = F.when(F.col("_weak_rule").isNotNull(), "business unit weakens an org rule")
    return old.join(weak, "tenant_id", "left").withColumns({
        "accepted": reason.isNull(),
        "reason": reason,
        "version": F.when(reason.isNull(), F.col("_latest") + 1),
        "previous_version": F.col("_active"),
        "retired": F.when(reason.isNull(), F.col("_active")),
        "active": reason.isNull(),
    }).drop("_latest", "_active", "_weak_rule", "parent_id")


def with_rollback(policies: DataFrame, rolled: DataFrame) -> DataFrame:
    """The policy table after a rollback: one active version per tenant."""
    done = rolled.filter("accepted")
    gone = done.select("tenant_id", F.col("retired").alias("_retired"))
    kept = policies.join(gone, "tenant_id", "left").withColumn(
        "active", F.col("active") & ~F.col("version").eqNullSafe(F.col("_retired")))
    return kept.select(policies.columns).unionByName(done.select(policies.columns))
