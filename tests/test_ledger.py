"""Chains, tampering, history blocks."""

import hashlib
import json

from pyspark.sql import functions as F

from tarnhelm.operators import ledger as L
from tarnhelm.operators.ordered import with_history


def records(spark, n=30):
    rows = [("big" if i % 3 else f"t{i % 5}", "policy.updated" if i % 4 == 0 else "request.decided",
             json.dumps({"n": i}, separators=(",", ":")), f"2024-01-01 00:00:{i:02d}", i) for i in range(n)]
    return spark.createDataFrame(rows, "tenant_id string, event_type string, payload string, ts string, ord bigint")


def test_chain_hashes_and_anchors(spark):
    rows = L.append_chain(records(spark)).collect()
    for tenant in {r["tenant_id"] for r in rows}:
        heads = {}
        for r in sorted((r for r in rows if r["tenant_id"] == tenant), key=lambda r: r["id"]):
            prev = heads.get(r["chain"], hashlib.sha256((tenant + L.GENESIS_SUFFIX).encode()).hexdigest())
            body = '{"event_type":"%s","payload":%s,"tenant_id":"%s","ts":"%s"}' % (r["event_type"], r["payload"], tenant, r["ts"])
            assert r["prev_hash"] == prev
            assert r["record_hash"] == hashlib.sha256(bytes.fromhex(prev) + body.encode()).hexdigest()
            heads[r["chain"]] = r["record_hash"]


def verdict(spark, df):
    return {r["tenant_id"]: (r["ok"], r["broken_at"]) for r in L.verify_ledger(df, block_rows=4).collect()}


def test_tampering_is_found(spark):
    led = L.append_chain(records(spark)).cache()
    assert all(ok for ok, _ in verdict(spark, led).values())
    edited = led.withColumn("payload", F.when((F.col("tenant_id") == "big") & (F.col("id") == 9), '{"n":0}').otherwise(F.col("payload")))
    assert verdict(spark, edited)["big"] == (False, 9)
    removed = led.filter("not (tenant_id = 'big' and id = 5)")
    assert verdict(spark, removed)["big"][0] is False
    swapped = led.withColumn("id", F.when((F.col("tenant_id") == "big") & (F.col("id") == 5), 7).when((F.col("tenant_id") == "big") & (F.col("id") == 7), 5).otherwise(F.col("id")))
    assert verdict(spark, swapped)["big"][0] is False
    gone = L.check_sequence(led.filter("not (tenant_id = 'big' and id = 5)"), block_rows=4).agg(F.min("id")).first()[0]
    assert gone == 6


def test_ledger_files_round_trip(spark, tmp_path):
    from tarnhelm.sources.readers import read_ledger
    from tarnhelm.sources.sinks import append_ledger

    recs = records(spark)
    first = L.append_chain(recs.filter("ord < 15"))
    append_ledger(first, str(tmp_path / "l"))
    on_disk = read_ledger(spark, str(tmp_path / "l"))
    append_ledger(L.append_chain(recs.filter("ord >= 15"), on_disk), str(tmp_path / "l"))
    whole = read_ledger(spark, str(tmp_path / "l"))
    assert whole.count() == 60 and all(ok for ok, _ in verdict(spark, whole).values())
    cols = ["id", "tenant_id", "record_hash"]
    assert set(map(tuple, whole.select(*cols).collect())) == set(map(tuple, L.append_chain(recs).select(*cols).collect()))


def test_history_in_blocks_equals_one_window(spark):
    rows = [("k" if i % 4 else "j", i, i * 7 % 11, i % 3 == 0) for i in range(200)]
    df = spark.createDataFrame(rows, "key string, at int, v int, flag boolean")
    for width in (1, 7, 1000):
        got = with_history(
            df, ["key"], ["at"], F.floor(F.col("at") / width), lags={"prev": "v"},
            counts={"n": F.col("flag")}, lasts={"last": F.when(F.col("flag"), F.col("v"))},
        )
        got = {(r["key"], r["at"]): (r["prev"], r["n"], r["last"]) for r in got.collect()}
        for key in "kj":
            prev, n, last = None, 0, None
            for k, at, v, flag in rows:
                if k != key:
                    continue
                assert got[(k, at)] == (prev, n, last)
                prev, n, last = v, n + flag, v if flag else last


def test_leak_sweep_of_any_length(spark):
    long = "x" * 5000 + "y"
    df = spark.createDataFrame(
        [(1, 'a "quoted secret" here'), (2, "nothing"), (3, "SECRET-VALUE-1 x"), (4, "secret7"),
         (5, long + long), (6, None)], "id int, t string")
    lits = spark.createDataFrame(
        [('"quoted secret"',), ("SECRET-VALUE-1",), ("absent-literal",), ("secret7",), (long,), ("7",),
         ("",), (None,)], "literal string")
    want = {('"quoted secret"', 1), ("SECRET-VALUE-1", 1), ("secret7", 1), (long, 1), ("7", 1)}
    for at_once in (2, 100):
        got = L.leak_sweep({"t": df}, lits, at_once).collect()
        assert {(r["literal"], r["rows"]) for r in got} == want


def test_leak_sweep_searches_values_only(spark):
    df = spark.createDataFrame(
        [(1, "x", ["secret1", None], ("in a struct", 7), b"raw bytes"), (2, "x x", [], None, None)],
        "account_id int, literal string, _gram array<string>, s struct<inside:string,n:int>, b binary")
    lits = spark.createDataFrame(
        [(x,) for x in ("account_id", "inside", "literal", "secret1", "in a struct", "raw bytes",
                        "x", '"', "2", "é")], "literal string")
    got = {(r["literal"], r["rows"]) for r in L.leak_sweep({"t": df}, lits).collect()}
    assert got == {("secret1", 1), ("in a struct", 1), ("raw bytes", 1), ("x", 2), ("2", 1)}
    assert L.leak_sweep({"t": df}, lits.limit(0)).count() == 0


def test_leak_sweep_by_runs_of_words(spark, monkeypatch):
    import random

    from tarnhelm.operators import literals as I

    r = random.Random(5)
    blanks = [" ", "  ", "\n", "\t ", "\u00a0"]
    def prose(n):
        return "".join(r.choice("abé") + r.choice("cd") + r.choice(blanks) for _ in range(n))
    texts = [prose(r.randrange(60)) for _ in range(60)] + ["", None]
    texts += texts[:5]
    lits = sorted({t[i:i + r.randrange(1, 40)] for t in texts if t for i in (0, r.randrange(len(t)))}
                  | {prose(6) for _ in range(20)} - {""})
    want = {(x, n) for x in lits if (n := sum(x in (t or "") for t in texts))}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    table = spark.createDataFrame([(x,) for x in lits], "literal string")
    index = I.LiteralIndex(table)
    # Words are hashed and not every character; the few literals without words are tried.
    assert set(index.sizes) == {-4, -2} and index.short
    for tried, led, at_once in ((64, I.LED, I.ENTRIES), (0, I.LED, 50), (0, 30, I.ENTRIES)):
        monkeypatch.setattr(I, "TRIED", tried)
        monkeypatch.setattr(I.LiteralIndex.lookup, "__defaults__", (False, led))
        got = [tuple(x) for x in L.leak_sweep({"t": df}, table, at_once).select("literal", "rows").collect()]
        assert len(got) == len(set(got)) and set(got) == want
    every = I.LiteralIndex(table).lookup(
        df, F.array(F.coalesce("t", F.lit(""))), lambda pairs: pairs.select("t", "literal"))
    assert every.count() == sum(n for _, n in want)


def test_files_of_a_ledger_do_not_follow_its_tenants(spark, tmp_path):
    import os

    from tarnhelm.sources.readers import read_ledger
    from tarnhelm.sources.sinks import append_ledger

    recs = spark.range(600).selectExpr(
        "concat('t', id % 300) as tenant_id", "if(id % 5 = 0, 'policy.updated', 'request.decided') as event_type",
        "'{}' as payload", "'2024' as ts", "id as ord")
    rows = L.append_chain(recs)
    append_ledger(rows, str(tmp_path / "l"))
    files = [f for _, _, fs in os.walk(tmp_path / "l") for f in fs if f.startswith("part-")]
    assert len(files) <= 2 * 4  # chains by shuffle partitions
    back = read_ledger(spark, str(tmp_path / "l")).select(rows.columns)
    assert sorted(map(str, back.collect())) == sorted(map(str, rows.collect()))
