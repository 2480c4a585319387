"""Cross-tokenizer alignment against plain Python."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnhelm.llm import alignment

SF = "/root/testdata/sf0.001"
TEXTS = [
    None, "", " ", "▁x", "a  b", "\n\n x", "日本語 テキスト", "<s> x <0x0A> </s>", "é" * 50,
    "<|endoftext|>", "the quick brown fox", "the quick brown fox", "\x00 y\r\n\tz", "ﬁ ½ n",
]


@pytest.fixture(scope="module")
def aligner():
    return alignment.Aligner(*alignment.vocabularies())


def brute(aligner, text):
    none = 0, 0, 0, 0, "", Counter()
    if not text:
        return none
    a, b = aligner.encode_a(" " + text), aligner.encode_b(text)
    whole = (" " + text).encode()
    if (b"".join(aligner.a_bytes[i] for i in a) != whole
            or b"".join(aligner.b_bytes[i] for i in b) != whole):
        return none

    def spans(ids, table):
        at, out = 0, []
        for i in ids:
            out.append((at, at + len(table[i])))
            at = out[-1][1]
        return out

    sa, sb = spans(a, aligner.a_bytes), spans(b, aligner.b_bytes)
    groups, i, j = [], 0, 0
    for cut in sorted({e for _, e in sa} & {e for _, e in sb}):
        ga, gb = [], []
        while i < len(sa) and sa[i][1] <= cut:
            ga.append(str(a[i]))
            i += 1
        while j < len(sb) and sb[j][1] <= cut:
            gb.append(str(b[j]))
            j += 1
        groups.append(",".join(ga) + "|" + ",".join(gb))
    links = Counter(
        (a[x], b[y]) for x, (s, e) in enumerate(sa) for y, (t, f) in enumerate(sb)
        if s < f and t < e)
    digest = hashlib.sha256(";".join(groups).encode()).hexdigest()
    return len(a), len(b), len(groups), sum(links.values()), digest, links


def brute_table(aligner, texts):
    found = [brute(aligner, t) for t in texts]
    total = sum((f[5] for f in found), Counter())
    top = {}
    for (_, b), n in total.items():
        top[b] = max(top.get(b, 0), n)
    return [
        (i, *f[:4], sum(n for (a, b), n in f[5].items() if total[a, b] == top[b]),
         sum(n * total[p] for p, n in f[5].items()), f[4])
        for i, f in enumerate(found)]


def test_gallop_finds_ranks():
    r = random.Random(1)
    for _ in range(500):
        a, b = (np.array(sorted(r.sample(range(200), r.randint(1, 120)))) for _ in range(2))
        assert (alignment.gallop(a, b) == np.searchsorted(b, a)).all()


@pytest.mark.parametrize("size", [20, alignment.PART])
def test_aligner_equals_brute_force(aligner, size):
    r = random.Random(2)
    texts = TEXTS + ["".join(r.choices("ab é\n <日.", k=r.randint(1, 200))) for _ in range(60)]
    for text, got in zip(texts, aligner(texts, size), strict=True):
        pairs = dict(zip(map(lambda p: divmod(p, alignment.STEP), got[5].tolist()),
                         got[6].tolist(), strict=True))
        assert (*got[:5], pairs) == brute(aligner, text)


def rows(df):
    return sorted((tuple(r) for r in df.select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    ).collect()), key=str)


@pytest.mark.parametrize("block", [7, 1_000_000])
def test_alignment_of_a_table(spark, aligner, block):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")
    docs = docs.withColumns({"pair": F.lit(1), "n": F.lit(2), "_row": F.lit(3)}).repartition(3)
    got = rows(alignment.alignment(docs, block_pairs=block))
    assert got == sorted(brute_table(aligner, TEXTS), key=str)


def test_alignment_null_ids_and_repeated_rows(spark):
    docs = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b")], "doc_id int, text string")
    got = rows(alignment.alignment(docs))
    assert len(got) == 3 and got[0][1:] == got[1][1:] == got[2][1:]


def test_alignment_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert alignment.alignment(docs).count() == 0


def test_op13_alignment_equals_brute_force(spark, aligner):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    short = [r for r in docs if len(r["text"] or "") < 1500]
    got = {r["doc_id"]: r for r in alignment.op13_alignment(spark, SF).collect()}
    assert len(got) == len(docs)
    for r in short:
        assert tuple(got[r["doc_id"]][c] for c in (
            "n_a", "n_b", "n_groups", "n_links", "groups_sha256")) == brute(aligner, r["text"])[:5]
