"""Benchmark decontamination against plain Python."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tarnhelm.llm import decontamination as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
NONE = hashlib.sha256(b"").hexdigest()


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, span=10):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(span, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[i:i + n]), set()).add(item)
    sizes = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        w, hit, named, any_ = words(text), set(), set(), False
        for n in sizes:
            for i in range(len(w) - n + 1):
                found = windows.get(tuple(w[i:i + n]))
                if found:
                    hit.update(range(i, i + n))
                    named |= found
        ids = sorted(str(x) for x in named if x is not None)
        out.append((doc, len(w), len(hit), len(ids),
                    hashlib.sha256(",".join(ids).encode()).hexdigest(), len(hit) > 0))
    return sorted(out, key=str)


def got(spark, docs, items, span=10):
    docs = spark.createDataFrame(docs, "doc_id bigint, text string").withColumns(
        {c: F.lit(1) for c in ("size", "window", "at", "_k1", "fp")}).repartition(3)
    items = spark.createDataFrame(items, "item_id bigint, text string").withColumns(
        {c: F.lit(1) for c in ("doc_id", "wid", "size")})
    return sorted((tuple(r) for r in D.decontaminate(docs, items, span).select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()), key=str)


def planted(seed=3):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(40)] + ["É", "日本", "x9", "A-B"]
    items = [(i, " ".join(r.choices(vocab, k=r.choice([1, 2, 4, 5, 7, 9, 10, 11, 30]))))
             for i in range(25)]
    items += [(100, None), (101, ""), (102, "!!"), (None, "no name " * 6), (3, items[4][1]),
              (104, "a " * 40)]
    docs = []
    for i in range(60):
        parts = r.choices(vocab, k=r.randint(0, 60))
        if i % 3:
            w = (r.choice(items)[1] or "").split()
            a = r.randint(0, max(0, len(w) - 11))
            parts[r.randint(0, len(parts)):0] = w[a:a + r.choice([9, 10, 11, 40])]
        docs.append((i, r.choice([" ", ", ", "\n"]).join(parts).upper() if i % 2 else
                     " ".join(parts)))
    docs += [(None, "no name " * 9), (7, docs[1][1]), (7, docs[1][1]), (200, None), (201, ""),
             (202, "a " * 3000), (203, "...")]
    return docs, items


@pytest.mark.parametrize("span", [10, 6])
def test_equals_brute_force(spark, span):
    docs, items = planted()
    assert got(spark, docs, items, span) == brute(docs, items, span)


def test_large_tables_are_joined_without_hints(spark, monkeypatch):
    monkeypatch.setattr(D, "small", lambda df: df)
    docs, items = planted(5)
    assert got(spark, docs, items) == brute(docs, items)


def test_every_shared_span_is_found_at_any_place(spark):
    item = " ".join(f"q{i}" for i in range(40))
    w = item.split()
    docs = [(i, " ".join(["z"] * (i % 7) + w[i:i + 10] + ["y"] * 3)) for i in range(31)]
    docs += [(100 + i, " ".join(w[i:i + 9] + ["z"] + w[i + 10:i + 19])) for i in range(20)]
    found = got(spark, docs, [(1, item)])
    assert [r[2] for r in found if r[0] < 100] == [10] * 31
    assert not any(r[5] for r in found if r[0] >= 100)


def test_empty_tables(spark):
    assert got(spark, [], [(1, "a b c")]) == []
    assert got(spark, [(1, "a b")], []) == [(1, 2, 0, 0, NONE, False)]


def test_no_python_on_the_path(spark):
    docs = spark.createDataFrame([(1, "a b c d")], "doc_id bigint, text string")
    plan = D.hits(docs, spark.createDataFrame([(4, 1)], "size int, fp bigint"), [4])
    assert "Python" not in plan._jdf.queryExecution().toString()
