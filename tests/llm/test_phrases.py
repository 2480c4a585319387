"""Phrase collocations against plain Python."""

import random
import re
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnhelm.llm import phrases as P


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute(docs, least, best):
    f = defaultdict(Counter)
    for text, lang in docs:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, 6):
                for i in range(len(w) - k + 1):
                    f[lang or "und"][tuple(w[i:i + k])] += 1
    out = []
    for lang, counts in f.items():
        n = sum(c for p, c in counts.items() if len(p) == 1)
        found = {p: c for p, c in counts.items() if len(p) > 1 and c >= least}
        rows = []
        for p, a in found.items():
            if any(len(q) > len(p) and 100 * c >= 100 * a and any(
                    q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))
                    for q, c in found.items()):
                continue
            score, k = min((1000 * a * n // (counts[p[:k]] * counts[p[k:]]), k)
                           for k in range(1, len(p)))
            rows.append((" ".join(p), a, counts[p[:k]], counts[p[k:]], n, score))
        rows.sort(key=lambda r: (-r[5], -r[1], r[0].encode()))
        out += [(lang, i, *r) for i, r in enumerate(rows[:best], 1)]
    return sorted(out)


def made(n=120, seed=4):
    r = random.Random(seed)
    vocab = ["the", "of", "The", "a", "b\x01", "b", "É", "日本", "x" * 90, "\x00", "c"]
    out = []
    for i in range(n):
        w = r.choices(vocab, [8, 6, 2, 5, 3, 3, 1, 1, 1, 1, 2], k=r.randint(0, 60))
        out.append(("".join(x + r.choice([" ", " ", " ", "\t", "  ", ", ", ".", "\n"]) for x in w),
                    r.choice(["en", "en", "de", None])))
    return out + [(None, "en"), ("", "en"), (" . ", None), ("of " * 300, "en"), *[out[0]] * 4]


def got(spark, docs, **how):
    df = spark.createDataFrame(docs, "text string, lang string").withColumns(
        {c: F.lit(1) for c in ("phrase", "n", "group", "depth", "total")}).repartition(3)
    return sorted(tuple(r) for r in P.collocations(df, **how).select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize("budget", [P.BUDGET, 20, 1])
def test_equals_brute_force(spark, budget):
    docs = made()
    assert got(spark, docs, least=5, best=2000, budget=budget) == brute(docs, 5, 2000)


def test_best_of_each_language(spark):
    docs = made(seed=9)
    assert got(spark, docs, least=3, best=7) == brute(docs, 3, 7)


def test_small_blocks_and_new_numbers(spark):
    docs = made(20)
    texts = [("en", (t or "").encode()) for t, _ in docs] + [("en", b"of the a " * 200)]

    def run():
        sums = Counter()

        def use(lang, ids, n):
            for i in range(n):
                row = []
                for x in ids[i:i + P.DEPTH].tolist():
                    if x == P.END:
                        break
                    row.append(words.names[x])
                sums[tuple(row)] += bool(row)

        words = P.Words(use, lambda: None)
        for t in texts:
            words.add(*t)
        words.close()
        return +sums

    whole = run()
    old = P.BLOCK, P.NUMBERED, P.SLICE
    try:
        P.BLOCK, P.NUMBERED, P.SLICE = 13, 4, 10
        assert run() == whole
    finally:
        P.BLOCK, P.NUMBERED, P.SLICE = old


def test_sets_have_no_misses(spark):
    words = [("en", f"w{i}") for i in range(300)] + [("de", f"u{i}") for i in range(300)]
    at = P.word_places(spark.createDataFrame(words, "lang string, phrase string"))
    for bits in (P.MOST_BITS, P.PAGE):
        old, P.MOST_BITS = P.MOST_BITS, bits
        try:
            pages = P.bit_set(at)
        finally:
            P.MOST_BITS = old
        h = [crc32(w.encode()) for _, w in words]
        found = [P.in_set(pages, P.places(crc32(lang.encode()), np.array([x], np.uint64), None,
                                          len(pages) * 8))[0]
                 for (lang, _), x in zip(words, h, strict=True)]
        assert all(found)


def test_scores_are_exact_beyond_64_bits(spark):
    a, n, left, right = 3 * 10**12 + 1, 7 * 10**15 + 3, 3 * 10**12 + 5, 4 * 10**13 + 7
    phrases = spark.createDataFrame(
        [("en", "x y", a), ("en", "x", left), ("en", "y", right)], "lang string, phrase string, n bigint")
    totals = spark.createDataFrame([("en", n)], "lang string, total bigint")
    assert P.scored(phrases, totals).first()["score"] == 1000 * a * n // (left * right)


def test_empty_table(spark):
    assert got(spark, []) == []
    assert got(spark, [(None, None), ("", "en")]) == []
