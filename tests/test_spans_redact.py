"""Flattening, sources, redaction, evaluation pieces."""

import json

from pyspark.sql import functions as F

from tarnhelm.operators import evaluate as E
from tarnhelm.operators import redact as R
from tarnhelm.operators import spans as P
from tarnhelm.sources import readers as RD
from tarnhelm.sources.sinks import write_findings, write_report


def test_flatten_origins_nesting_and_failures(spark):
    body = {"model": "m", "system": [{"type": "text", "text": "be nice"}], "tools": [{"description": "d"}],
            "messages": [{"role": "user", "content": "hi"}, {"role": "tool", "content": [{"text": "out"}]},
                         {"role": "assistant", "content": [{"arguments": '{"a": "b", "l": ["q", {"z": "é"}]}'}]}],
            "n": [1, 2.5, None, True, []], "e": {}}
    bad = ["{\"a\": ", "[1,2", "{\"a\" 1}", "{\"a\":1} x", "", None]
    df = spark.createDataFrame([(0, json.dumps(body))] + [(i + 1, b) for i, b in enumerate(bad)], "id int, body string")
    rows = P.flatten_spans(df, ["id"]).collect()
    got = {r["span_path"]: (r["text"], r["origin"], r["parent_path"]) for r in rows if r["id"] == 0}
    assert got["system[0].text"] == ("be nice", "system", None)
    assert got["tools[0].description"][1] == "tool_definition"
    assert got["messages[0].content"][:2] == ("hi", "user")
    assert got["messages[1].content[0].text"][:2] == ("out", "tool_result")
    arg = "messages[2].content[0].arguments"
    assert got[arg + "$json.a"] == ("b", "tool_call", arg)
    assert got[arg + "$json.l[1].z"][0] == "é"
    offsets = {r["span_path"]: r["parent_char_offset"] for r in rows if r["id"] == 0}
    text = got[arg][0]
    assert text[offsets[arg + "$json.l[0]"]:].startswith("q")
    assert sorted(r["id"] for r in rows if r["status"] == "malformed_payload") == [1, 2, 3, 4, 5, 6]


def _deep(n, leaf):
    for i in range(n):
        leaf = json.dumps({"k": leaf}) if i % 3 == 2 else ({"d": [leaf]} if i % 3 else [leaf, 1])
    return json.dumps(leaf)


def test_flatten_opens_everything_and_agrees_with_the_table_function(spark):
    inner = json.dumps({"a": "one", "é\ue000": ["two", {"": "three"}], "n": None}, ensure_ascii=False)
    third = json.dumps({"z": "  " + json.dumps([inner]), "s": 'q "x" \\ \n\u0001'})
    bodies = [
        '"just text"', "[]", "{}", "7", '["a", "b"]', '{"a": "x", "a": "y", "role": "z"}',
        json.dumps({"input": [{"role": "Assistant", "content": third, "note": "[not json"}]}),
        '{"messages": [{"role": "user", "content": "p", "content": "q"}]}',
        _deep(14, "bottom"), _deep(30, "far down"), '{"t": "{\\"a\\": \\"b\\", \\"a\\": \\"c\\"}"}',
        '{"a": "b"}] x', '{"a": "b"} {"c": "d"}', '"a", "b"', '{"a": "b",}', "nope", "  ", None,
    ]
    df = spark.createDataFrame(list(enumerate(bodies)), "id int, body string").withColumns(
        {"path": F.lit("p"), "_body": F.lit("b"), "role": F.lit(1)})
    P.register_flatten(spark)
    native = {(r["id"], r["span_path"], r["text"], r["parent_path"], r["parent_char_offset"])
              for r in P.flatten_spans(df, ["id", "path", "_body"]).collect()}
    table = spark.sql("select p.id, f.* from {t} p, lateral flatten_json(body) f", t=df)
    assert native == {tuple(r)[:5] for r in table.collect()}
    found = {(i, p): (t, parent, at) for i, p, t, parent, at in native}
    assert found[0, ""][0] == "just text" and found[4, "[1]"][0] == "b"
    assert {t for i, _, t, _, _ in native if i == 5} == {"x", "y", "z"}
    at = "input[0].content"
    deep = at + "$json.z$json.[0]$json"
    assert found[6, deep + ".é\ue000[1]."][0] == "three" and found[6, deep + ".a"][0] == "one"
    for path in (at + "$json.s", at + "$json.z", deep + ".é\ue000[0]", deep + ".a"):
        text, parent, place = found[6, path]
        assert found[6, parent][0][place:].startswith(json.dumps(text, ensure_ascii=False)[1:4])
    assert {t for i, _, t, _, _ in native if i in (8, 9)} >= {"bottom", "far down"}
    assert {t for i, p, t, _, _ in native if i == 10 and "$json" in p} == {"b", "c"}
    assert {i for i, p, *_ in native if p is None} == set(range(11, 18))
    origins = {(r["id"], r["span_path"]): r["origin"] for r in P.flatten_spans(df, ["id"]).collect()}
    assert origins[6, "input[0].note"] == "assistant" and origins[6, deep + ".a"] == "assistant"
    assert origins[7, "messages[0].content"] == "user"
    plan = P.flatten_spans(df, ["id"])._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_flatten_udtf_in_sql(spark):
    P.register_flatten(spark)
    df = spark.createDataFrame([(1, '{"a": ["x", {"b": "y"}]}')], "id int, body string")
    rows = spark.sql("select f.span_path, f.text from {t}, lateral flatten_json(body) f", t=df).collect()
    assert {tuple(r) for r in rows} == {("a[0]", "x"), ("a[1].b", "y")}


def test_redaction_merge_and_verify(spark):
    spans = spark.createDataFrame([(1, "p", "mail bob@x.io card 4111 end", "user", "s"), (2, "p", "key in a prompt", "system", "s")],
                                  "request_id int, span_path string, text string, origin string, scope string")
    f = spark.createDataFrame([(1, "p", 5, 13, "EMAIL", 0.9, False), (1, "p", 9, 18, "PERSON", 0.5, False), (1, "p", 19, 23, "CREDIT_CARD", 0.8, False), (2, "p", 0, 3, "JWT", 0.9, False)],
                              "request_id int, span_path string, start int, end int, entity_class string, confidence double, advisory_only boolean")
    a = spark.createDataFrame([(1, "mask"), (2, "mask")], "request_id int, action string")
    plan = R.plan_edits(spans, f, a, ["request_id", "span_path"], ["request_id"], b"k", "scope")
    plain = {r["request_id"]: r for r in R.verify_redaction(R.apply_edits(plan)).collect()}
    assert plain[1]["status"] == "overlap" and not plain[1]["verified"]
    assert plain[2]["read_only_findings"] == 1 and plain[2]["redacted"] == "key in a prompt"
    merged = {r["request_id"]: r for r in R.verify_redaction(R.apply_edits(plan, overlaps="merge")).collect()}
    assert merged[1]["redacted"] == "mail ⟨EMAIL⟩ ⟨CREDIT_CARD⟩ end" and merged[1]["verified"]


def test_sources(spark, tmp_path):
    (tmp_path / "proj").mkdir()
    lines = [{"type": "user", "message": {"content": "hello there"}}, {"type": "assistant", "message": {"content": "no"}},
             {"type": "user", "message": {"content": [{"type": "text", "text": "one"}, {"type": "tool_result", "content": [{"text": "two"}]}, {"type": "tool_result", "content": "three"}]}},
             {"type": "user", "message": {"content": "x"}}]
    (tmp_path / "proj" / "t.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\n{broken")
    rows = RD.read_transcripts(spark, str(tmp_path / "proj")).collect()
    assert {(r["project"], r["text"]) for r in rows} == {("proj", "hello there"), ("proj", "one\ntwo\nthree")}
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "a.txt").write_text("text é")
    (tmp_path / "c" / "b.png").write_bytes(b"\x89PNG")
    assert [r["text"] for r in RD.read_corpus(spark, str(tmp_path / "c")).collect()] == ["text é"]
    p = RD.read_payloads(spark, str(tmp_path / "proj" / "t.jsonl"))
    assert p.filter("malformed").count() == 1
    (tmp_path / "pol.yaml").write_text("version: 2\norg: t\nmode: enforce\nrules:\n  - match: {class: [PAN]}\n    action: mask\n")
    row = RD.load_policies(spark, {"t": str(tmp_path / "pol.yaml")}).first()
    assert row["version"] == 2 and row["rules"][0]["class"] == ["PAN"] and len(row["content_hash"]) == 64
    (tmp_path / "r.yaml").write_text("key_names:\n" + "\n".join(
        f"  - {{name: {r.name}, entity_class: {r.entity_class}, pattern: '{r.pattern}', confidence: {min(1.0, r.confidence + 0.05)}}}" for r in RD.BASELINE_KEY_RULES))
    assert {r.name: r.confidence for r in RD.load_context_rules(spark, str(tmp_path / "r.yaml"))}["password_key"] > 0.9
    write_report({"x": spark.range(3)}, str(tmp_path / "rep"))
    write_findings(spark.createDataFrame([("A", 1)], "family string, start int"), str(tmp_path / "f"))
    assert spark.read.json(str(tmp_path / "rep" / "x")).count() == 3


def test_event_source_is_a_stream(spark, tmp_path):
    spark.createDataFrame([], RD.EVENT_SCHEMA).write.parquet(str(tmp_path / "e"))
    assert RD.read_events(spark, str(tmp_path / "e")).isStreaming


def test_adjudicator_hook(spark):
    import pandas as pd

    @F.pandas_udf("string")
    def propose(f: pd.DataFrame) -> pd.Series:
        return f["shape"].str.upper()

    df = spark.createDataFrame([("aa-99", "k")], "shape string, key_name string")
    assert E.adjudicate(df, propose).first()["proposal"] == "AA-99"


def test_escalation_sink_is_idempotent(spark, tmp_path):
    from tarnhelm.streaming.sessions import escalation_sink

    write = escalation_sink(str(tmp_path / "esc"))
    for _ in range(2):
        write(spark.range(4), 0)
    write(spark.range(2), 1)
    assert spark.read.parquet(str(tmp_path / "esc")).count() == 6


def test_a_text_is_shuffled_once_for_its_edits(spark):
    from tarnhelm.operators import redact as R

    spans = spark.range(50).selectExpr("id % 20 as request_id", "cast(id as string) as span_path", "repeat(cast(id as string), 40) as text", "if(id < 99, 'user', 'system') as origin", "'s' as scope")
    found = spark.range(50).selectExpr("id % 20 as request_id", "cast(id as string) as span_path", "1 as start", "9 as `end`", "'PAN' as entity_class", "0.9d as confidence", "false as advisory_only")
    acts = spark.range(20).selectExpr("id as request_id", "'mask' as action")
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        planned = R.plan_edits(spans, found, acts, ["request_id", "span_path"], ["request_id"], b"k", "scope")
        plan = planned._jdf.queryExecution().executedPlan().toString()
        sent = [x.split("Project [", 1)[1].split("]")[0] for x in plan.split("Exchange hashpartitioning")[1:] if "Project [" in x]
        assert sum("origin#" in x for x in sent) == 1 and plan.count("Exchange hashpartitioning") == 5
        assert {r["edits"][0]["replacement"] for r in planned.collect()} == {"⟨PAN⟩"}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_equal_places_merge_to_the_same_edit_in_any_order(spark):
    from tarnhelm.operators import redact as R

    edits = [(0, 4, "⟨B⟩", 0.5), (0, 4, "⟨A⟩", 0.5), (2, 6, "⟨0⟩", 0.5), (8, 9, "⟨D⟩", 0.4), (8, 9, "⟨C⟩", 0.6)]
    df = spark.createDataFrame([("0123456789", edits), ("0123456789", edits[::-1])], f"text string, edits {R.EDIT_TYPE}")
    got = [r["redacted"] for r in R.apply_edits(df, overlaps="merge").collect()]
    assert got == ["⟨A⟩67⟨C⟩9"] * 2


def test_values_that_collide_at_every_width_get_the_longest_token():
    import re

    import duckdb

    from tarnhelm.plans import governance as G

    con = duckdb.connect()
    con.sql("create table customer as select 7 as c_custkey union all select 8")
    sql = G.ORACLES["widen_collisions"]
    assert [r[1] for r in con.sql(sql).fetchall()] == [3, 3]
    # Both get macs that differ in their last digit only.
    same = re.sub(r"as mac from customer\)", "as mac0, repeat('a', 59) || cast(c_custkey as varchar) || 'aaaa' as mac from customer)", sql, count=1)
    rows = con.sql(same).fetchall()
    assert len(rows) == 2 and {r[1] for r in rows} == {48} and len({r[2] for r in rows}) == 2
