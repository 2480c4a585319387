"""Lattice, clearance, clamp, exceptions, identity."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tarnhelm.functions.lattice import LATTICE, action_of
from tarnhelm.operators import guard as G
from tarnhelm.operators import policy as P
from tarnhelm.sources import readers as RD

ORG = """
version: 1
org: agency
mode: enforce
default: allow
unregistered_workload: mask
rules:
  - match: {direction: inbound, class: [AADHAAR, CUSTOMER_DATA]}
    action: mask
    unless: [{actor_group: [citizen]}, {actor_role: director}]
  - match: {direction: inbound, class: [INFRA_SECRET, JWT]}
    action: block
    unless: {actor_group: infosec}
    escalate: true
  - match: {direction: outbound, class: [AADHAAR], destination: [vendor]}
    action: tokenize
    except: [{actor_group: [citizen]}]
"""
BU = """
version: 3
org: agency
business_unit: unit
rules:
  - match: {direction: inbound, class: [AADHAAR]}
    action: block
    unless: [{actor_role: [director]}]
  - match: {direction: inbound, class: [JWT]}
    action: warn
"""


def brute(org, bu, who, cls, leg, dest, exceptions):
    """Plain reading of the rules, one finding at a time."""
    rank = LATTICE.index

    def last(policy):
        hit = None
        for i, r in enumerate(policy["rules"]):
            if r["direction"] not in (None, leg) or (r["class"] and cls not in r["class"]):
                continue
            if r["destination"] and dest not in r["destination"]:
                continue
            hit = (i, r)
        return hit

    def clear(r):
        return any(
            set(b["actor_group"]) & set(who["groups"]) or who["role"] in b["actor_role"]
            or dest in b["destination"]
            for b in (r["unless"] if leg == "inbound" else r["except"])
        )

    base = org["default"] if who["registered"] else org["unregistered_workload"]
    action, index, scope, applied = base, None, "default", False
    hit = last(org)
    if hit:
        index, scope = hit[0], "org"
        action = hit[1]["action"]
        if clear(hit[1]):
            action, applied = base, True
    hit = last(bu) if bu else None
    if hit:
        b = hit[1]["action"]
        if clear(hit[1]):
            b, applied = base, True
        if rank(b) >= rank(action):
            if rank(b) > rank(action) or index is None:
                index, scope = hit[0], "bu"
            action = b
    if cls in exceptions:
        action, scope, applied = base, "exception", True
    return action, index, scope, applied


def test_decide_matches_plain_reading(spark):
    rows = [RD.policy_row(ORG, "agency"), RD.policy_row(BU, "unit")]
    policies = RD.policies_frame(spark, rows)
    tenants = spark.createDataFrame([("agency", None), ("unit", "agency"), ("lone", "agency")], "id string, parent_id string")
    resolved = P.resolve_policies(tenants, policies)
    people = [("officer", ["citizen"], True), ("director", [], True), ("officer", ["infosec"], True), ("contractor", [], True), ("unregistered", [], False)]
    cases = []
    for i, (t, (role, groups, reg), cls, leg, dest, exc) in enumerate(itertools.product(
        ("agency", "unit", "lone"), people, ("AADHAAR", "JWT", "EMAIL"), ("inbound", "outbound"),
        ("vendor", "own", None), ([], ["AADHAAR"]),
    )):
        cases.append((i, t, role, groups, reg, cls, leg, dest, exc))
    f = spark.createDataFrame(cases, "id int, tenant_id string, role string, groups array<string>, registered boolean, entity_class string, leg string, destination string, exceptions array<string>")
    cols = ["id", "action", "rule_index", "rule_scope", "exception_applied"]
    by_row = {r["id"]: tuple(r)[1:] for r in P.decide(f.join(resolved, "tenant_id")).select(*cols).collect()}
    compiled = {r["id"]: tuple(r)[1:] for r in P.decide_findings(f, resolved).select(*cols).collect()}
    assert by_row == compiled
    for i, t, role, groups, reg, cls, leg, dest, exc in cases:
        bu = rows[1] if t == "unit" else None
        want = brute(rows[0], bu, {"role": role, "groups": groups, "registered": reg}, cls, leg, dest, exc)
        assert by_row[i] == want, cases[i]


def test_action_of_null_is_null(spark):
    df = spark.createDataFrame([(None,), (4,)], "r int")
    assert [r[0] for r in df.select(action_of(F.col("r"))).collect()] == [None, "block"]


def test_policy_files_are_strict():
    import pytest

    for text in ("org: a\nrulez: []", "rules: [{match: {klass: [PAN]}, action: mask}]",
                 "rules: [{match: {class: [NOPE]}, action: mask}]", "rules: [{match: {}, action: drop}]",
                 "default: maybe"):
        with pytest.raises(RD.PolicyError):
            RD.policy_row(text, "t")


def test_who_sees_which_document(spark):
    policies = RD.policies_frame(spark, [RD.policy_row(ORG, "agency")])
    tenants = spark.createDataFrame([("agency", None)], "id string, parent_id string")
    resolved = P.resolve_policies(tenants, policies)
    actors = G.actors_frame(spark, [("c", "agency", "officer", ["citizen"], True), ("d", "agency", "director", [], True), ("x", "agency", "unregistered", [], False)])
    docs = spark.createDataFrame([(1, "AADHAAR"), (2, "JWT"), (2, "EMAIL")], "doc_id int, entity_class string")
    reads = spark.createDataFrame([(a, d) for a in "cdx" for d in (1, 2, 3)], "actor_id string, doc_id int")
    judged = G.judge_documents(reads, docs, actors, resolved)
    seen = {(r["actor_id"], r["doc_id"]): r["visible"] for r in G.retrieval_guard(judged).collect()}
    assert seen == {("c", 1): True, ("c", 2): False, ("c", 3): True, ("d", 1): True, ("d", 2): False,
                    ("d", 3): True, ("x", 1): False, ("x", 2): False, ("x", 3): True}
    read = {(r["actor_id"], r["doc_id"]): r["action"] for r in G.read_guard(judged).collect()}
    assert read[("c", 2)] == "block" and read[("c", 1)] == "allow"


def test_root_tenant_random_forest(spark):
    rng = random.Random(3)
    parent = {f"t{i}": (f"t{rng.randrange(max(0, i - 3), i)}" if i % 9 else None) for i in range(60)}
    df = spark.createDataFrame(list(parent.items()), "id string, parent_id string")

    def root(t):
        while parent[t]:
            t = parent[t]
        return t

    got = {r["tenant_id"]: r["root_id"] for r in P.root_tenant(df).collect()}
    assert got == {t: root(t) for t in parent}


def test_root_tenant_of_deep_chains(spark):
    rows = [(f"t{i}", f"t{i - 1}" if i else None) for i in range(200)]
    rows += [(f"c{i}", f"c{(i + 1) % 5}") for i in range(5)] + [("m", "gone"), ("n", "m")]
    df = spark.createDataFrame(rows, "id string, parent_id string")
    got = {r["tenant_id"]: (r["root_id"], r["status"]) for r in P.root_tenant(df).collect()}
    assert all(got[f"t{i}"] == ("t0", "ok") for i in range(200))
    assert all(got[f"c{i}"] == (None, "cycle") for i in range(5))
    assert got["m"] == got["n"] == (None, "missing")


def test_one_sided_versions_are_differences(spark):
    from tarnhelm.schema import RULE_TYPE

    rule = "named_struct('direction', null, 'class', array('PAN'), 'destination', array(), 'action', 'mask', 'format_preserving', false, 'escalate', false, 'reason', '', 'unless', array(), 'except', array())"
    df = spark.sql(f"""select * from values ('a', 1), ('b', 2), ('c', 1), ('c', 2) t(tenant_id, version)""").selectExpr(
        "*", "'enforce' as mode", "'allow' as default", "'mask' as unregistered_workload",
        f"cast(if(tenant_id = 'b', array({rule}, {rule}), array({rule})) as array<{RULE_TYPE}>) as rules")
    got = {r["tenant_id"]: r["notes"] for r in P.policy_diff(df, 1, 2).collect()}
    assert got["a"] == ["default allow -> none", "mode enforce -> none",
                        "unregistered_workload mask -> none", "rules 1 -> 0"]
    assert got["b"][-1] == "rules 0 -> 2" and got["b"][0] == "default none -> allow"
    assert got["c"] == ["no material change"]


def test_second_draft_of_a_tenant_is_refused(spark):
    from tarnhelm.schema import RULE_TYPE

    rule = lambda a: f"named_struct('direction', null, 'class', array('PAN'), 'destination', array(), 'action', '{a}', 'format_preserving', false, 'escalate', false, 'reason', '', 'unless', array(), 'except', array())"
    policies = spark.sql(f"select 'o' tenant_id, 1 version, true active, 'enforce' mode, 'allow' default, 'mask' unregistered_workload, cast(array({rule('mask')}) as array<{RULE_TYPE}>) rules")
    tenants = spark.createDataFrame([("o", None), ("u", "o")], "id string, parent_id string")
    draft = lambda t, m, e, a: f"select '{t}' tenant_id, 'o' org, if('{t}' = 'o', null, '{t}') business_unit, {m} mode, cast(null as string) fail, {e} expected_version, cast(array({rule(a)}) as array<{RULE_TYPE}>) rules, 'allow' default, 'mask' unregistered_workload"
    drafts = spark.sql(" union all ".join([
        draft("o", "'enforce'", 1, "mask"), draft("o", "'shadow'", 1, "block"),
        draft("u", "cast(null as string)", "cast(null as int)", "warn"),
        draft("u", "cast(null as string)", "cast(null as int)", "block")]))
    got = [tuple(r) for r in P.publish(drafts, policies, tenants).orderBy("tenant_id", "accepted").collect()]
    assert got == [("o", False, "version conflict", None), ("o", True, None, 2),
                   ("u", False, "business unit weakens an org rule", None), ("u", True, None, 1)]


def many_rules(spark, n=120):
    """A tenant whose rules all speak of the same few conditions, and one of another tenant."""
    return spark.range(n).selectExpr(
        "'t' as tenant_id", "1 as version", "cast(id as int) as rule_index",
        "if(id % 3 = 0, null, if(id % 3 = 1, 'inbound', 'outbound')) as direction",
        "case id % 4 when 0 then array('PAN', 'JWT') when 1 then array('JWT', 'PAN') when 2 then array('EMAIL') else array() end as class",
        "if(id % 5 = 0, array('vendor'), array()) as destination", "if(id % 2 = 0, 'mask', 'warn') as action")


def test_last_rule_is_found_once_per_combination(spark, monkeypatch):
    rules = many_rules(spark)
    found = spark.range(400).selectExpr(
        "id as request_id", "0 as ord", "if(id % 50 = 49, 'other', 't') as tenant_id",
        "element_at(array('PAN', 'EMAIL', 'JWT', 'GSTIN', null), cast(id % 5 + 1 as int)) as entity_class",
        "if(id % 7 < 4, 'inbound', 'outbound') as leg", "element_at(array('vendor', 'own', null), cast(id % 3 + 1 as int)) as destination")
    keys = ["request_id", "ord"]
    want = P.last_match(P.match_rules(found, rules).select(*keys, "rule_index", "action"), keys)
    met = []
    pairs = P.match_rules
    monkeypatch.setattr(P, "match_rules", lambda f, r, on: met.append((f.count(), r.count())) or pairs(f, r, on))
    got = P.last_matching_rule(found, rules, keys).select(*keys, "rule_index", "action")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert met[0][0] <= 2 * 5 * 2 * 3 and met[0][1] <= 3 * 3 * 2  # neither findings nor rules


def test_rules_meet_combinations_and_findings_meet_folded_rules(spark, monkeypatch):
    rules = many_rules(spark)
    found = spark.range(400).selectExpr(
        "id as request_id", "0 as ord", "if(id % 50 = 49, 'other', 't') as tenant_id",
        "element_at(array('PAN', 'EMAIL', 'JWT', 'GSTIN', null), cast(id % 5 + 1 as int)) as entity_class",
        "if(id % 7 < 4, 'inbound', 'outbound') as leg", "element_at(array('vendor', 'own', null), cast(id % 3 + 1 as int)) as destination")
    cols = ["request_id", "ord", "rule_index", "action"]
    want = sorted(map(tuple, P.match_rules(found, rules).select(*cols).collect()))
    met = []
    pairs = P.match_rules
    monkeypatch.setattr(P, "match_rules", lambda f, r, on: met.append(f.count()) or pairs(f, r, on))
    for most in (7, 10_000):
        m = P.folded_matches(found, rules, most=most)
        got = m.select("request_id", "ord", F.explode("rule_indexes").alias("rule_index"), "action")
        assert sorted(map(tuple, got.collect())) == want
        assert m.selectExpr("max(size(rule_indexes))").first()[0] <= most
    assert m.count() <= 400 * 2 * 1  # a row per action
    assert max(met) <= 2 * 5 * 2 * 3  # no findings


@pytest.mark.parametrize("name", ["match_rules", "cleared_matches"])
def test_shuffles_of_rule_matches_carry_keys_of_lines(spark, name):
    import re

    from tarnhelm.plans import governance as Q

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = Q.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().explainString(
            spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    shuffles = re.findall(r"\(\d+\) Exchange\n((?:.+\n)+)", plan)
    assert any("l_orderkey" in x for x in shuffles)
    assert not any(re.search("entity_class|destination|rule_indexes", x) for x in shuffles)
    assert any("rule_indexes" in x for x in re.findall(r"\(\d+\) BroadcastExchange\n((?:.+\n)+)", plan))


def test_situations_are_decided_once(spark, monkeypatch):
    rows = [RD.policy_row(ORG, "agency"), RD.policy_row(BU, "unit")]
    tenants = spark.createDataFrame([("agency", None), ("unit", "agency")], "id string, parent_id string")
    resolved = P.resolve_policies(tenants, RD.policies_frame(spark, rows))
    f = spark.range(600).selectExpr(
        "id", "if(id % 2 = 0, 'agency', 'unit') as tenant_id", "if(id % 3 = 0, 'director', null) as role",
        "array('citizen') as groups", "id % 5 <> 0 as registered", "'AADHAAR' as entity_class", "'inbound' as leg",
        "cast(null as string) as destination", "if(id % 4 = 0, array('AADHAAR'), array()) as exceptions")
    cols = ["id", "action", "rule_index", "rule_scope", "exception_applied", "escalate"]
    want = P.decide(f.join(resolved, "tenant_id")).select(*cols).collect()
    met = []
    plain = P.decide
    monkeypatch.setattr(P, "decide", lambda x: met.append(x.count()) or plain(x))
    got = P.decide_rows(f, resolved, ["id"]).select(*cols).collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and met[0] <= 2 * 2 * 2 * 2


def test_profiles_meet_rules_that_speak_and_no_policy(spark, monkeypatch):
    rows = [RD.policy_row(ORG, "agency"), RD.policy_row(BU, "unit"), RD.policy_row(BU, "stray")]
    tenants = spark.createDataFrame([("agency", None), ("unit", "agency"), ("stray", "gone")], "id string, parent_id string")
    resolved = P.resolve_policies(tenants, RD.policies_frame(spark, rows))
    actors = G.actors_frame(spark, [(t + r, t, r, ["citizen"] if r == "officer" else [], r != "x")
                                    for t in ("agency", "unit", "stray") for r in ("officer", "director", "x")])
    classes = ["AADHAAR", "JWT", "EMAIL"]
    f = actors.withColumns({"entity_class": F.explode(F.array(*map(F.lit, classes))), "leg": F.lit("inbound"),
                            "destination": F.lit(None).cast("string")})
    cols = ["actor_id", "entity_class", "action", "rule_index", "rule_scope"]
    want = P.decide(f.join(resolved, "tenant_id")).select(*cols).collect()
    seen = []
    compiled = G.decide_compiled
    monkeypatch.setattr(G, "decide_compiled", lambda g, c: seen.append(g.columns + c.columns) or compiled(g, c))
    got = G.clearance_matrix(actors, resolved).where(F.col("entity_class").isin(*classes)).select(*cols).collect()
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert "rules" not in str(seen)
