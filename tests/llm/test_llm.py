"""The training-data operators against plain Python on small tables."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter, defaultdict
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tarnhelm.llm import (
    chat,
    common,
    fingerprints,
    html,
    jaccard,
    language,
    licenses,
    mixing,
    neighbours,
    packing,
    tokens,
)

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = "lorem ipsum dolor " * 4000
TEXTS = [
    None, "", " \t\n", "one", "One two  three\tfour", "a b c d e", "A b c d e", LONG,
    "the quick brown fox jumps over the lazy dog " * 3, "éèê ñ ß " * 30, "12 34 !! 56",
]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size int, cut int"


def table(spark, texts, sources=("a", "b", None)):
    rows = [(i, t, None, sources[i % len(sources)], len(t or ""), 1, 2)
            for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def varied(n=60, seed=1):
    """Texts with copies, near copies and shared passages."""
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    passage = " ".join(r.choices(vocab, k=40))
    out = []
    for i in range(n):
        kind = i % 5
        if kind == 0 or not out:
            out.append(" ".join(r.choices(vocab, k=r.randint(1, 120))))
        elif kind == 1:
            out.append(r.choice(out))
        elif kind == 2:
            w = r.choice(out).split() or ["x"]
            for _ in range(max(1, len(w) // 40)):
                w[r.randrange(len(w))] = r.choice(vocab)
            out.append(" ".join(w))
        elif kind == 3:
            out.append(passage + " " + " ".join(r.choices(vocab, k=r.randint(0, 60))))
        else:
            out.append(r.choice(out).upper())
    return out


def shingles(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4)))


def brute_components(ids, linked):
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in ids:
        for j in ids:
            if i < j and linked(i, j):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {i: root(i) for i in ids}


# --- shared parts

def test_components_of_chain_star_and_pairs(spark):
    edges = [(i, i + 1) for i in range(50, 90)] + [(200, x) for x in range(201, 240)]
    edges += [(7, 9), (9, 7), (3, 3), (1000, 1)]
    random.Random(0).shuffle(edges)
    got = {r["node"]: r["component"] for r in common.components(
        spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert all(got[x] == 50 for x in range(50, 91)) and all(got[x] == 200 for x in range(200, 240))
    assert (got[7], got[9], got[1], got[1000]) == (7, 7, 1, 1) and 3 not in got


def test_components_of_nothing(spark):
    assert common.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_no_local_folder_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "local-cluster[1,1,1024]"
        getCheckpointDir = staticmethod(lambda: None)  # noqa: N815

    class Session:
        sparkContext = Context  # noqa: N815
        class conf:
            get = staticmethod(lambda *a: None)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_folder(Session)


# --- 1 extraction

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body>
<header><h2>Site</h2></header><nav><ul><li>Menu</ul></nav><!-- no <p>x</p> -->
<div class="ad-box">Buy</div><article><h1>Head &amp; more</h1><p>One
 two&nbsp;three<p><b>Four<br>five<script>var a = "</p>"</script><div class="comments"><p>Hi</p></div>
<p title="a > b">Six &lt; 7</p></article><aside>Side</aside><form><p>Mail</p></form>
<section class="comments"><article class="comment"><p>Reader</p></article></section>
<footer>&copy; x</footer></body></html>"""


def test_html_blocks_of_a_marked_page():
    assert html.blocks_of(PAGE) == (
        ["Head & more", "One two three", "Four", "five", "Six < 7"], True)


@pytest.mark.parametrize("page", ["", "<", "<p", "a < b", "<!--", "</p></p>", "<div class='x",
                                  "<article>", "<p a=\"b>c</p>", "<script>x"])
def test_html_broken_pages(page):
    assert isinstance(html.blocks_of(page)[0], list)


def test_html_long_page_is_linear():
    assert len(html.blocks_of("<p>word word</p>" * 50_000)[0]) == 50_000
    assert html.blocks_of("<p a='" * 3000)[1] is False


def test_lcs_against_table():
    r = random.Random(3)
    for _ in range(200):
        a = [r.randrange(6) for _ in range(r.randrange(12))]
        b = [r.randrange(6) for _ in range(r.randrange(12))]
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(
                    best[i][j + 1], best[i + 1][j])
        got = [a[i] for i in sorted(html.shared_lines(a, b))]
        assert len(got) == best[-1][-1]
        it = iter(b)
        assert all(x in it for x in got)


def test_html_differencing_of_unmarked_pages(spark):
    def page(*own):
        return "<body><p>Home</p><p>News</p>" + "".join(f"<p>{x}</p>" for x in own) + "<p>End</p>"
    rows = [
        (1, "http://h.x/a/1", page("alpha"), 0), (2, "http://h.x/a/2?q", page("beta", "gamma"), 0),
        (3, "http://h.x/a/2.html", page("beta", "gamma"), 0), (4, "http://other.x/a/1", page("z"), 0),
        (5, None, None, 0), (6, "http://h.x/a/3", "", 0), (7, "http://h.x/b/1", PAGE, 0),
        (1, "http://h.x/a/1", page("alpha"), 0),
    ]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, host int")
    got = sorted((r["page_id"], r["text"], r["n_chars"]) for r in html.main_text(df).collect())
    assert got[:2] == [(1, "alpha", 5), (1, "alpha", 5)]
    assert [t for i, t, _ in got if i in (2, 3)] == ["beta\ngamma"] * 2
    assert [t for i, t, _ in got if i == 4] == ["Home\nNews\nz\nEnd"]
    assert [t for i, t, _ in got if i in (5, 6)] == ["", ""]
    assert html.main_text(df.limit(0)).count() == 0


@pytest.mark.parametrize("coalesce", ["true", "false"])  # one range of paths, and several
def test_html_nearest_path_of_the_host(spark, coalesce):
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, coalesce)
    try:
        check_nearest_paths(spark)
    finally:
        spark.conf.set(name, before)


def check_nearest_paths(spark):
    r = random.Random(7)
    paths = sorted({f"/{r.choice('ab')}{r.randrange(40)}/{r.randrange(9)}/x" for _ in range(300)})
    marked = "<body><p>Home</p><article><p>Own {}</p></article><p>End</p>"
    bare = "<body><p>Home</p><p>Own {}</p><p>End</p>"
    rows = [(i, f"http://h{len(p) % 2}.x{p}", (marked if i % 3 == 0 else bare).format(i))
            for i, p in enumerate(paths)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")

    def common(a, b):
        return next((n for n, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))

    for x in html.main_text(df).collect():
        i = x["page_id"]
        assert x["text"] == f"Own {i}"
        if i % 3:
            host = [p for p in paths if len(p) % 2 == len(paths[i]) % 2 and p != paths[i]]
            assert common(paths[i], x["peer_path"]) == max(common(paths[i], p) for p in host)


def test_html_differencing_decides_unsure_blocks(spark):
    def page(*own, cls="post comments-open"):
        return (f"<body><div class='layout with-sidebar'><div>x</div><article class='{cls}'><p>Copied</p>"
                + "".join(f"<p>{x}</p>" for x in own) + "<div class='has-ads'><div>Buy now</div><p>"
                f"Deal {own[0]}</div><p title='hidden gems'>Kept <a href='/q?id=search'>link</a>"
                "</article></div>")
    rows = [(1, "http://h.x/1", page("alpha")), (2, "http://h.x/2", page("beta")),
            (3, "http://alone.x/", page("gamma")), (4, "http://h.x/3", page("delta", cls="comments"))]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r["page_id"]: r for r in html.main_text(df).collect()}
    assert got[1]["text"] == "Copied\nalpha\nDeal alpha\nKept link"
    assert got[2]["text"] == "Copied\nbeta\nDeal beta\nKept link"
    assert got[3]["text"] == "Copied\ngamma\nBuy now\nDeal gamma\nKept link"
    assert got[4]["text"] == ""  # all that is left, x, stands on its neighbour too
    assert [got[i]["n_shared"] for i in (1, 2, 3, 4)] == [4, 4, 0, 1]
    assert got[1]["peer_path"] == "/2"


def test_html_state_ends_with_its_element():
    kinds = lambda page: list(html.kinds_of(html.all_blocks(page)))
    page = ("<article><p>a<section class='no-ads'><article><p>b</article>c<div>d</div></section>"
            "<p class='no-ads'>e<p>f</article>g")
    assert kinds(page) == [html.SURE, html.SURE, html.ASKED, html.ASKED, html.ASKED, html.SURE, html.OTHER]
    assert kinds("<div itemprop=articleBody><section class='ad-free'><div>a</div>b</section>c</div>d") == [
        html.ASKED, html.ASKED, html.SURE, html.OTHER]


# --- 2 token counts

def test_counts_follow_edits():
    encode = packing.tokenizer(*packing.vocabulary()).encode_ordinary
    r = random.Random(5)
    alphabet = "ab  \n\t.,'sé1 <|endoftext|> "
    for leaf in (1, 3, 20):
        for _ in range(40):
            text = "".join(r.choices(alphabet, k=r.randrange(120)))
            doc = tokens.Counted(text, lambda t: len(encode(t)), leaf)
            for _ in range(6):
                at, cut = r.randint(-2, len(text) + 2), r.randint(0, 9)
                put = "".join(r.choices(alphabet, k=r.randrange(9)))
                a = min(max(at, 0), len(text))
                text = text[:a] + put + text[a + min(cut, len(text) - a):]
                doc.edit(at, cut, put)
                assert doc.text == text
                assert doc.total == len(encode(text)), (text, at, cut, put)


def test_token_query_rows(spark):
    encode = packing.tokenizer(*packing.vocabulary()).encode_ordinary
    docs = table(spark, TEXTS)
    out = {r["doc_id"]: r for r in tokens.recount(
        tokens.revisions(docs), *packing.vocabulary()).collect()}
    for i, t in enumerate(TEXTS):
        assert out[i]["n_tokens"] == len(encode(t or ""))
    assert out[7]["reencoded_chars"] < len(LONG) / 10
    assert tokens.recount(tokens.revisions(docs.limit(0)), *packing.vocabulary()).count() == 0


# --- 3 fingerprints

def test_fingerprints_are_exact_below_k(spark):
    texts = [*TEXTS, *varied(20)]
    docs = table(spark, [*texts, texts[8]])
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    out = fingerprints.with_next(rows, {"s": fingerprints.sketch(F.col("text"))}).select(
        "doc_id", "text", "s", F.col("next.text").alias("nt"), F.col("next.s").alias("ns"),
        fingerprints.resemblance(F.col("s"), F.col("next.s")).alias("near"),
        fingerprints.containment(F.col("s"), F.col("next.s")).alias("inside"),
        fingerprints.distinct_shingles(F.col("s")).alias("n")).orderBy("doc_id").collect()
    same = defaultdict(set)
    for i, r in enumerate(out):
        assert r["nt"] == out[i - 1]["text"]
        a, b = shingles(r["text"].lower()), shingles(r["nt"].lower())
        same[r["text"]].add(tuple(r["s"]))
        if max(len(a), len(b)) < fingerprints.K // 2:
            assert r["near"] == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)
            assert r["inside"] == pytest.approx(len(a & b) / len(a) if a else 1.0)
            assert r["n"] == len(a)
    assert all(len(v) == 1 for v in same.values())


def test_fingerprint_parts_merge(spark):
    text = " ".join(f"w{i}" for i in range(900))
    words = text.split()
    parts = spark.createDataFrame(
        [(1, " ".join(words[i:i + 104])) for i in range(0, 900, 100)], "k int, text string")
    whole = spark.createDataFrame([(text,)], "text string").select(
        fingerprints.sketch(F.col("text")).alias("s")).first()["s"]
    merged = fingerprints.merge_parts(
        parts.select("k", fingerprints.sketch(F.col("text")).alias("sketch")), ["k"]).first()
    assert merged["sketch"] == whole
    assert abs(spark.createDataFrame([(whole,)], "s array<bigint>").select(
        fingerprints.distinct_shingles(F.col("s"))).first()[0] - 896) < 300


def test_edited_text(spark):
    row = spark.createDataFrame([("abcdefgh", "XYZ")], "a string, b string").select(
        fingerprints.edited(F.col("a"), F.col("b"))).first()
    assert row[0] == "abcdefXY"


# --- 4 packing

def test_best_fit_places_all():
    r = random.Random(2)
    for _ in range(30):
        size = r.choice([10, 64, 1024])
        counts = {r.randint(1, size): r.randint(1, 50) for _ in range(r.randint(1, 20))}
        used, ranks = defaultdict(list), defaultdict(set)
        for length, first, n, seq, at in packing.best_fit(counts, size):
            for k in range(n):
                used[seq + k].append((at, at + length))
                ranks[length].add(first + k)
        assert {x: len(v) for x, v in ranks.items()} == counts
        for spans in used.values():
            spans.sort()
            assert spans[0][0] == 0 and spans[-1][1] <= size
            assert all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
        rooms = []  # best fit one by one
        for length in sorted((k for k, v in counts.items() for _ in range(v)), reverse=True):
            fits = [x for x in rooms if x >= length]
            if fits:
                rooms.remove(min(fits))
            rooms.append((min(fits) if fits else size) - length)
        assert len(used) == len(rooms)


def test_packing_rows(spark):
    from tokenizers import Tokenizer
    import public_tokenizers as P

    model = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = [*TEXTS, *varied(40), TEXTS[8]]
    out = packing.pack_documents(table(spark, texts), size=128).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in out:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append((r["offset"], r["offset"] + r["length"]))
    for i, t in enumerate(texts):
        ids = model.encode(t or "", add_special_tokens=False).ids + [2]
        parts = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [r["piece"] for r in parts] == list(range(len(parts)))
        assert all(r["length"] == 128 for r in parts[1:]) and len(parts) == -(-len(ids) // 128)
        for r in parts:
            own = ids[r["start"]:r["start"] + r["length"]]
            assert r["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(own)}I", *own))
        assert sum(r["length"] for r in parts) == len(ids)
    for spans in by_seq.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
        assert spans[-1][1] <= 128
    assert packing.pack_documents(table(spark, TEXTS).limit(0)).count() == 0


# --- 5 chat

def test_chat_round_trip(spark):
    rows = [
        (1, 0, "user", "</s>[INST] \\ <s>[x]\n"), (1, 1, "assistant", "a" * 450 + "é\\"),
        (1, 2, None, None), (1, 2, "assistant", ""), (None, None, "user", "q"),
        (2, 0, "assistant", LONG), (2, 0, "assistant", LONG), (3, 5, "to]\nol", "\n]"),
    ]
    df = spark.createDataFrame(
        [(*r, 9) for r in rows], "conv_id bigint, turn bigint, role string, text string, kind int")
    out = {r["conv_id"]: r for r in chat.read_back(chat.format_chats(df)).collect()}
    assert set(out) == {1, 2, 3, None}
    for c, r in out.items():
        own = sorted(((-1 if t is None else t, a or "", b or "") for k, t, a, b in rows if k == c))
        assert r["n_turns"] == len(own)
        assert r["turns_sha256"] == hashlib.sha256(
            "".join(f"{a}\n{b}\n" for _, a, b in own).encode()).hexdigest()
        loss = "".join(b for _, a, b in own if a == "assistant")
        assert (r["loss_chars"], r["loss_sha256"]) == (
            len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.read_back(chat.format_chats(df.limit(0))).count() == 0


def test_chat_fold_of_events(spark):
    log = [(0, "open", "user"), (1, "delta", "x"), (2, "regenerate", None), (3, "delta", "a"),
           (4, "delta", None), (5, "delta", "b"), (6, "edit", "C"), (7, "delta", "d")]
    df = spark.createDataFrame(
        [(1, 0, 1, *e) for e in reversed(log)],
        "conv_id bigint, turn bigint, part int, step int, kind string, payload string")
    assert [tuple(r) for r in chat.fold(df).select("role", "text").collect()] == [("user", "Cd")]


# --- 6 Jaccard join

def test_jaccard_components(spark):
    texts = [*TEXTS, *varied(120, 4)]
    docs = table(spark, [*texts, texts[4], None])
    texts = [*texts, texts[4], None]
    sets = [shingles(t) for t in texts]
    want = brute_components(range(len(texts)), lambda i, j: bool(sets[i]) and bool(sets[j]) and (
        100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"])
           for r in jaccard.join_components(docs).collect()}
    assert got == {i: (len(sets[i]), want[i]) for i in want}
    assert len(set(want.values())) < len(want) - 20
    left = [r["doc_id"] for r in jaccard.keep_one(docs).collect()]
    assert sorted(left) == sorted(i for i in want if want[i] == i)
    assert jaccard.keep_one(docs).columns == docs.columns


def test_jaccard_empty_and_repeated(spark):
    docs = table(spark, ["a b c d e f", "x"])
    assert jaccard.join_components(docs.limit(0)).count() == 0
    again = docs.union(docs)
    assert sorted(r["component_id"] for r in jaccard.join_components(again).collect()) == [
        0, 0, 1, 1]


# --- 7 mixing

def test_mixing_meets_targets(spark):
    r = random.Random(7)
    texts = [" ".join("w" for _ in range(r.randrange(50))) for _ in range(400)]
    docs = table(spark, [None, *texts], ("s1", "s2", "s0", None, "s1", "s1"))
    out = mixing.mix(docs).collect()
    sizes, taken, target = Counter(), Counter(), {}
    source = {x["doc_id"]: x["source"] for x in docs.collect()}
    for x in out:
        assert x["times"] <= 2
        s = source[x["doc_id"]]
        sizes[s] += x["size"]
        taken[s] += x["size"] * x["times"]
        target[s] = x["target"]
    names = ["s0", "s1", "s2", None]
    free, left = dict(zip(names, (5, 2, 1, 5))), 1.5 * sum(sizes.values())
    want = {}
    while free:
        level = left / sum(free.values())
        full = [s for s in free if level * free[s] > 2 * sizes[s]]
        for s in full or list(free):
            want[s] = 2 * sizes[s] if full else level * free[s]
            left -= want[s]
            del free[s]
    for s in names:
        assert target[s] == pytest.approx(want[s])
        assert want[s] - 50 <= taken[s] <= want[s] + 1e-6
    again = {x["doc_id"]: x["times"] for x in mixing.mix(docs.repartition(7)).collect()}
    assert again == {x["doc_id"]: x["times"] for x in out}
    rows = mixing.take(docs)
    assert rows.columns == docs.columns and rows.count() == sum(x["times"] for x in out)
    assert mixing.mix(docs.limit(0)).count() == 0


# --- 8 licences

def test_license_blocks(spark):
    texts = [
        None, "", "no notice here", "Some text.\nLicensed under the Apache License, Version 2.0.",
        "This work is licensed under the GNU General Public License, version 3.",
        "This work is licensed under the GNU General Public License, version 2.",
        "Released under the terms of the MIT License.", "driving license number 12345 was lost",
        LONG + "\nLicensed under CC BY-NC 4.0.",
    ]
    got = {r["doc_id"]: (r["line"], r["license"], r["exact"])
           for r in licenses.scan(table(spark, texts)).collect()}
    assert got == {3: (1, "Apache-2.0", True), 4: (0, "GPL-3.0", True), 5: (0, "GPL-2.0", True),
                   6: (0, "MIT", False), 8: (1, "CC-BY-NC-4.0", True)}
    assert licenses.scan(table(spark, texts).limit(0)).count() == 0


def test_license_words_that_decide(spark):
    texts = [
        "This project is not released under the MIT License.",
        "Licensed under the Apache License, Version 1.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 "
        "International License.",
        "This work is licensed under the GNU Lesser General Public License, version 2.",
        "There is no doubt. Released under the MIT License.",
        "It is made available under the terms of the MIT license, as ever",
        "# SPDX-License-Identifier: Apache-2.0\nimport x", "SPDX-License-Identifier: Apache-1.0",
        "Licensed under the Apache License, Version 2.0.\nLicensed under the Apache License, "
        "Version 2.0.", "Licensed under the Apache License.",
    ]
    rows = [(i, t, "MIT", "x", 1, 2, 3) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows + rows[4:5], SCHEMA.replace("lang", "license").replace(
        "source", "missing"))
    got = sorted((r["doc_id"], r["line"], r["license"], r["exact"])
                 for r in licenses.scan(df).collect())
    assert got == [
        (4, 0, "MIT", True), (4, 0, "MIT", True), (5, 0, "MIT", True), (6, 0, "Apache-2.0", True),
        (8, 0, "Apache-2.0", True), (8, 1, "Apache-2.0", True)]  # 9 lacks too much


def test_license_of_nearest_template_as_by_brute_force(spark):
    r = random.Random(8)
    filler = "this file was made by hand and is kept for later use by all".split()
    finder = licenses.Finder(licenses.TEMPLATES, licenses.GATE, licenses.SAVED, licenses.MISSING)
    texts, want = [], []
    for i in range(80):
        name, template = r.choice(licenses.TEMPLATES)
        before = " ".join(r.choices(filler, k=r.randint(0, 12)))
        text = f"{before}. {template.rstrip('.')}, {' '.join(r.choices(filler, k=5))}"
        texts.append((i, r.choice([text, text.replace(" under ", "\nunder ")])))
        # All templates against the whole text: the one that saves most and is worded exactly.
        best = max((finder.saving(template, under, own) * own, n) for n, t, _, _, under, own in
                   finder.templates if t == template)
        want.append((i, best[1]))
    got = licenses.scan(spark.createDataFrame(texts, "doc_id bigint, text string"))
    assert sorted((x["doc_id"], x["license"]) for x in got.where("exact").collect()) == want


def test_license_inside_sentences_and_over_lines(spark):
    full = dict(licenses.FULL_TEXTS)
    texts = [
        "word " * 40 + "Released under the MIT License. " + "more words " * 60,
        "This work is licensed under a Creative Commons\nAttribution 4.0 International License.",
        "x\n# Released under\n# the MIT License. Licensed under CC BY-NC 4.0. And so on.",
        "Copyright (c) 2020 Somebody\n\n" + full["MIT"], "a\n" + full["GPL-3.0"] + "\nend",
        full["BSD-2-Clause"], "the license of the driver was under review " * 30,
    ]
    got = [(r["doc_id"], r["line"], r["license"], r["exact"])
           for r in licenses.scan(table(spark, texts)).collect()]
    assert sorted(got) == [
        (0, 0, "MIT", True), (1, 0, "CC-BY-4.0", True), (2, 1, "MIT", True),
        (2, 2, "CC-BY-NC-4.0", True), (3, 2, "MIT", True), (4, 1, "GPL-3.0", True),
        (5, 0, "BSD-2-Clause", True)]


# --- 9 language

def brute_word(word, pieces, p):
    alpha = [Decimal(1)] + [Decimal(0)] * len(word)
    for i in range(len(word)):
        for n in range(1, len(word) - i + 1):
            k = pieces.get(word[i:i + n])
            if k is not None:
                alpha[i + n] += alpha[i] * Decimal(float(p[k]))
            elif n == 1:
                alpha[i + 1] += alpha[i] * Decimal(language.UNKNOWN)
    return float(alpha[-1].ln())


def test_forward_sums_all_segmentations():
    r = random.Random(1)
    pieces = sorted({"".join(r.choices("abc", k=r.randint(1, 4))) for _ in range(40)})
    probs = np.array([[r.random() for _ in range(2)] for _ in pieces])
    probs /= probs.sum(axis=0)
    known = {x: i for i, x in enumerate(pieces)}
    words = ["".join(r.choices("abcd", k=n)) for n in (1, 2, 5, 9, 48, 49, 120) for _ in range(4)]
    words += ["d" * 47, "ad" * 20]
    got = language.Forward(["", *pieces], np.vstack([np.zeros(2), probs]))(words)
    for w, row in zip(words, got):
        for j in range(2):
            assert row[j] == pytest.approx(brute_word(w, known, probs[:, j]), rel=1e-9)


def test_language_on_held_out(spark):
    docs = common.table(spark, SF, "documents")
    odd = docs.selectExpr("doc_id + 100000 as doc_id", "cast(null as string) text", "lang",
                          "source", "n_chars").limit(1)
    odd = odd.union(docs.selectExpr("doc_id + 200000", "'12 !!'", "lang", "source", "n_chars")
                    .limit(1))
    out = language.identify(docs.union(odd).withColumn("score", F.lit("x"))).collect()
    held = [r for r in out if r["doc_id"] < 100000 and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held)
    assert {(r["lang_pred"], r["score"]) for r in out if r["doc_id"] >= 100000} == {("und", 0.0)}
    none = language.identify(docs.limit(3).withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in none.collect()} == {"und"}
    assert language.identify(docs.limit(0)).count() == 0


# --- 10 neighbours


def test_float_vectors_are_kept_as_floats(spark, monkeypatch):
    df = spark.range(400).selectExpr(
        "id as vec_id", "id % 2 as label",
        "transform(sequence(1, 8), i -> cast(sin(id * i / 40) + 0.01 * (id % 3) as float)) as embedding")
    want = sorted(map(tuple, neighbours.near_duplicates(
        df.withColumn("embedding", F.col("embedding").cast("array<double>"))).collect()))
    lengths, kept = [], neighbours.keep

    def keep(table):
        out = kept(table)
        if "emb" in out.columns:
            lengths.append(out.selectExpr("max(length(emb))").first()[0])
        return out

    monkeypatch.setattr(neighbours, "keep", keep)
    for few in (neighbours.FEW, 100):  # all pairs, and by cells
        monkeypatch.setattr(neighbours, "FEW", few)
        got = sorted(map(tuple, neighbours.near_duplicates(df, recall=1.0).collect()))
        assert got == want and any(r[1] for r in got)
    assert lengths and set(lengths) == {4 * 8}


def test_neighbours_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(30, 16))
    rows = []
    for i in range(600):
        x = base[i % 30] + rng.normal(size=16) * rng.choice([0.05, 0.25, 1.0])
        rows.append((i, [float(v) for v in x], int(rng.integers(0, 3))))
    rows += [(600, rows[0][1], rows[0][2]), (601, rows[0][1], None), (602, None, 1), (603, [], 1),
             (604, [0.0] * 16, 1), (605, [float("nan")] + [1.0] * 15, 1),
             (606, [None] + [1.0] * 15, 1), (607, [1.0, 2.0], 1), (608, [float("inf")] * 16, 1)]
    df = spark.createDataFrame(
        [(*r, 1, 2) for r in rows],
        "vec_id bigint, embedding array<float>, label int, cell int, n int")
    out = {r["vec_id"]: r for r in neighbours.near_duplicates(df, recall=1.0).collect()}
    x = np.array([r[1] for r in rows[:601]], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = (x @ x.T >= 0.93) & (
        np.array([r[2] for r in rows[:601]])[:, None] == np.array([r[2] for r in rows[:601]]))
    links = sum(out[i]["n_links"] for i in range(601)), near.sum() - 601
    assert len(out) == len(rows) and 0.99 * links[1] <= links[0] <= links[1] and links[1] > 1000
    want = brute_components(range(601), lambda i, j: near[i, j])
    wrong = sum(out[i]["component_id"] != want[i] for i in range(601))
    assert wrong <= 6
    for i in range(601, 609):
        assert (out[i]["n_links"], out[i]["component_id"], out[i]["kept"]) == (0, i, True)
    assert neighbours.near_duplicates(df.limit(0)).count() == 0


def test_neighbours_of_any_length_and_magnitude(spark):
    rng = np.random.default_rng(6)
    rows = [(0, [1e200, 1e200], 1), (1, [1.0, 1.0], 1), (2, [1e-200, 1e-200], 1),
            (3, [1e308, -1e308], 1), (4, [1e-310, -1e-310], 1), (5, [7.0], 1), (6, [0.5], 1),
            (7, [-3.0], 1), (8, [1.0, 1.0, 1.0], 1), (9, [2.0, 2.0, 2.1], 1),
            (10, [1.0, 1.0, 1.0], 2), (11, [1.0, 1.0], 1), (11, [1.0, 1.0], 1),
            (None, [1.0, 1.0], 1)]
    base = rng.normal(size=(9, 5))
    for i in range(300):
        v = base[i % 9] + rng.normal(size=5) * 0.2
        rows.append((100 + i, [float(x) for x in v * 10.0 ** rng.integers(-180, 180)], i % 2))
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    unit = {i: np.array(v) / np.abs(v).max() for i, (_, v, _) in enumerate(rows)}
    unit = {i: v / np.linalg.norm(v) for i, v in unit.items()}
    links = {i: [j for j in unit if i != j and rows[i][2] == rows[j][2]
                 and None not in (rows[i][0], rows[j][0]) and len(unit[i]) == len(unit[j])
                 and unit[i] @ unit[j] >= 0.93] for i in unit}
    want = brute_components(list(unit), lambda i, j: j in links[i])
    low = {}
    for i, c in want.items():
        low[c] = min(low.get(c, 10**9), rows[i][0] if rows[i][0] is not None else 10**9)
    expected = sorted((str(rows[i][0]), len(links[i]), str(low[want[i]]) if rows[i][0] is not None
                       else "None") for i in unit)
    for few in (neighbours.FEW, 100):
        old, neighbours.FEW = neighbours.FEW, few
        try:
            out = neighbours.near_duplicates(df, recall=1.0).collect()
        finally:
            neighbours.FEW = old
        got = sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"])) for r in out)
        assert sum(a == b for a, b in zip(got, expected, strict=True)) >= 0.98 * len(got)
        if few == neighbours.FEW:
            assert got == expected


def test_neighbours_finds_rare_copies(spark):
    rng = np.random.default_rng(4)
    x = neighbours.unit(rng.normal(size=(2000, 32)))
    u = rng.normal(size=(150, 32))
    u = neighbours.unit(u - (u * x[:150]).sum(axis=1, keepdims=True) * x[:150])
    x = np.vstack([x, 0.94 * x[:150] + (1 - 0.94**2) ** 0.5 * u])
    df = spark.createDataFrame(
        [(i, v, 1) for i, v in enumerate(x.tolist())],
        "vec_id bigint, embedding array<double>, label int")
    # So few vectors are compared with all rows that hardly one of them has a link.
    got = {r["vec_id"]: r for r in neighbours.near_duplicates(df, queries=4).collect()}
    found = sum(got[2000 + i]["component_id"] == got[i]["component_id"] for i in range(150))
    assert found >= 149


def test_visits_are_the_nearest_cells():
    rng = np.random.default_rng(0)
    x = neighbours.unit(rng.normal(size=(50, 8)))
    books = neighbours.fit_codebooks(x, 6)
    d1, d2 = neighbours.halves(x, books)
    full = (d1[:, :, None] + d2[:, None, :]).reshape(50, -1)
    for n in (1, 5, 36):
        got = neighbours.visit(x, books, n)
        assert np.allclose(np.sort(np.take_along_axis(full, got.astype(int), 1), axis=1),
                           np.sort(full, axis=1)[:, :n])


# --- pipeline

def test_pipeline_stages(spark):
    docs = common.table(spark, SF, "documents")
    rows = docs.collect()
    at = docs
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        before = at
        at = common.keep(stage(spark, at, SF))
        seen.append(name)
        if name != "pack":
            assert at.columns == docs.columns
            assert at.join(before, docs.columns, "left_anti").count() == 0
        if name == "language":
            assert at.count() == sum(bool(language.LETTER.search(r["text"] or "")) for r in rows)
        if name == "near_duplicates":
            texts = {r["doc_id"]: shingles(r["text"]) for r in before.collect()}
            want = brute_components(sorted(texts), lambda i, j: bool(texts[i] and texts[j]) and (
                100 * len(texts[i] & texts[j]) >= 75 * len(texts[i] | texts[j])))
            assert {r["doc_id"] for r in at.collect()} == {i for i in want if want[i] == i}
    assert seen == ["language", "near_duplicates", "mix", "pack"]
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(at.columns)
    assert corpus_pipeline.run(spark, SF).count() == at.count()


def test_pipeline_stages_on_odd_rows(spark):
    more = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(
        f"{c} string" for c in ("lang_pred", "score", "component_id", "n", "_again", "_n", "piece",
                                "_repeated", "_judged", "_m", "size", "place", "key"))
    texts = [None, "", " \n", "12 !!", LONG, "one", "the quick brown fox jumps over the lazy dog",
             "the quick brown fox jumps over the lazy dog", "éèê ñ ß", "x" * 5000]
    rows = [(i, t, ["en", "fr", None][i % 3], ["a", None][i % 2], 1, *"abcdefghijklm")
            for i, t in enumerate(texts)]
    rows += [rows[6], rows[6], (None, "no id at all", "en", "a", 1, *"abcdefghijklm"),
             (None, "no id at all", "en", "a", 1, *"abcdefghijklm")]
    docs = spark.createDataFrame(rows, more)
    kept, groups, mix, pack = (stage for _, stage in corpus_pipeline.STAGES)
    known = common.keep(kept(spark, docs, SF))
    assert known.columns == docs.columns
    letters = sorted(r[1] for r in rows if r[1] and language.LETTER.search(r[1]))
    assert sorted(r["text"] for r in known.collect()) == letters
    single = common.keep(groups(spark, docs, SF))
    ids = [r["doc_id"] for r in single.collect()]
    assert sorted(i for i in ids if i is not None) == [0, 1, 2, 3, 4, 5, 6, 8, 9]
    assert single.columns == docs.columns and ids.count(None) == 2
    mixed = common.keep(mix(spark, docs, SF))
    assert mixed.columns == docs.columns
    assert {tuple(r) for r in mixed.collect()} <= {tuple(r) for r in docs.collect()}
    packed = pack(spark, docs, SF).groupBy("sequence_id").agg(
        F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end")).collect()
    assert all(r["n"] == r["end"] <= packing.SIZE for r in packed)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_language_ties_and_repeated_rows(spark):
    docs = spark.createDataFrame(
        [(i, "abc abd", lang, "s", 7) for i, lang in enumerate(["b", "a"] * 20)] +
        [(3, "abc", None, "s", 3)] * 2, "doc_id bigint, text string, lang string, source string, n bigint")
    out = language.identify(docs).collect()
    assert len(out) == 42
    assert len({(r["lang_pred"], r["score"]) for r in out if r["doc_id"] == 3 and r["lang"] is None}) == 1


def test_scorer_forgets_and_scores_alike():
    pieces = ["", "▁a", "b", "c", "▁", "a"]
    probs = np.array([[0, 0], [0.3, 0.1], [0.2, 0.3], [0.2, 0.2], [0.2, 0.1], [0.1, 0.3]])
    texts = [None, "ab", "a c", "", "a b c ab", "123", "ba " * 9]
    scorer = language.Scorer(["x", "y"], language.Forward(pieces, probs))
    whole = scorer(texts)
    old, language.KNOWN_WORDS = language.KNOWN_WORDS, 1
    try:
        assert [scorer([t])[0] for t in texts] == whole
    finally:
        language.KNOWN_WORDS = old
