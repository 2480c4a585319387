"""Embedding near-duplicates by an inverted multi-index.

Vectors are cut into halves and each half has a codebook of its own; the product of both
codebooks is a fine grid of cells. Each vector visits cells in the order of its distance to them
(multi-sequence order), as many as are needed to reach the target recall, and what it meets
there is verified by cosine in double precision.

Codebooks are fitted on a bounded sample; every vector is indexed. How many cells are visited is
measured twice, and the larger number is taken. ``PROBES`` pairs of each of two kinds are made at
the threshold itself, so the number never rests on the links that a table happens to have; and
``QUERIES`` vectors are compared with all rows. Each time the number is the least that finds
``RECALL`` of the links. Vectors are drawn by other hashes than the sample. Cells and visitors are cut into blocks, so no group grows with the
data, and a block gives counts and a spanning forest of its links, never the links themselves.

Only vectors of equal, non-null label and of one length are compared. Lengths with up to ``FEW``
different vectors need no index: there all pairs of a label are compared. Vectors that are null,
zero, or hold null or non-finite components link with nothing, nor do those without a vec_id.
Vectors of any magnitude count by their direction. Equal vectors of a label are indexed once with
their number. Rows that share a vec_id are separate vectors. An empty table gives an empty
result. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnhelm.llm.common import components, keep, small, table

COSINE = 0.93
#: Vectors that the codebooks are fitted on, at most about.
SAMPLE = 20_000
#: Vectors whose links are found by brute force to set the number of visited cells.
QUERIES = 256
#: Pairs of each kind that are made at the threshold to set the number of visited cells.
PROBES = 8192
RECALL = 0.999
#: Rows of a cell, or visitors of a cell, that one group compares.
BLOCK = 1024
#: Vectors of one length, different from each other, up to which all pairs of a label are compared.
FEW = 2048


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled first, so that squares neither overflow nor vanish."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """Vectors in double precision, of components that are stored in four or eight bytes."""
    parts = column.to_pylist()
    return numbers(b"".join(parts), len(parts) * dim).reshape(len(parts), dim)


def numbers(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, "<f4" if len(data) == 4 * n else "<f8").astype("<f8", copy=False)


def fit_codebooks(x: np.ndarray, k: int, rounds: int = 12) -> list[np.ndarray]:
    """``k`` centroids for each half of the unit vectors ``x``."""
    books = []
    for half in np.array_split(x, 2, axis=1):
        rng = np.random.default_rng(0)
        c = half[rng.choice(len(half), size=min(k, len(half)), replace=False)]
        for _ in range(rounds):
            near = distances(half, c).argmin(axis=1)
            sums = np.zeros_like(c)
            np.add.at(sums, near, half)
            n = np.bincount(near, minlength=len(c))[:, None]
            c = np.where(n > 0, sums / np.maximum(n, 1), c)
        books.append(c)
    return books


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)[:, None] - 2 * x @ c.T + (c * c).sum(axis=1)[None, :]


def halves(x: np.ndarray, books: list[np.ndarray]) -> list[np.ndarray]:
    return [distances(h, c) for h, c in zip(np.array_split(x, 2, axis=1), books, strict=True)]


def visit(x: np.ndarray, books: list[np.ndarray], n: int) -> np.ndarray:
    """The ``n`` nearest cells of each vector, nearest first.

    In multi-sequence order the cell of the i-th and j-th nearest centroids comes after the
    (i + 1) * (j + 1) - 1 cells that are no farther in both, so only pairs with
    (i + 1) * (j + 1) <= n can be among the first n.
    """
    d1, d2 = halves(x, books)
    o1, o2 = d1.argsort(axis=1, kind="stable"), d2.argsort(axis=1, kind="stable")
    pairs = [(i, j) for i in range(min(n, d1.shape[1]))
             for j in range(min(n // (i + 1), d2.shape[1]))]
    i, j = map(np.array, zip(*pairs, strict=True))
    rows = np.arange(len(x))[:, None]
    a, b = o1[:, i], o2[:, j]
    cost = d1[rows, a] + d2[rows, b]
    order = cost.argsort(axis=1, kind="stable")[:, :n]
    return (a * d2.shape[1] + b)[rows, order].astype(np.int32)


def nearer(d1: np.ndarray, d2: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many cells are nearer to each row than its cell (a, b)."""
    out = np.zeros(len(d1), np.int64)
    step = max(1, (1 << 22) // (d1.shape[1] * d2.shape[1]))
    for s in range(0, len(d1), step):
        e1, e2 = d1[s:s + step], d2[s:s + step]
        rows = np.arange(len(e1))
        there = e1[rows, a[s:s + step]] + e2[rows, b[s:s + step]] - 1e-12
        out[s:s + step] = (e1[:, :, None] + e2[:, None, :] < there[:, None, None]).sum(axis=(1, 2))
    return out


def sooner(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Rank of the visit at which pairs meet: by either vector, whichever finds the other sooner.

    ``x`` and ``y`` are the distances of both sides to the codebooks, a row for each pair.
    """
    own = [[d.argmin(axis=1) for d in side] for side in (x, y)]
    return np.minimum(nearer(*x, *own[1]), nearer(*y, *own[0]))


def least_cells(ranks: np.ndarray, recall: float) -> int:
    """The least number of visits by which ``recall`` of the pairs meet; ``ranks`` has counts."""
    return int(np.searchsorted(np.cumsum(ranks), recall * ranks.sum())) + 1


def cells_at_threshold(
    x: np.ndarray, books, cosine: float, recall: float, pairs: int = PROBES
) -> int:
    """The least number of visited cells that finds ``recall`` of pairs made at the threshold.

    The partner of a vector lies in a direction drawn at random, or in that of another vector;
    either kind alone has to reach the recall.
    """
    cells = len(books[0]) * len(books[1])
    rng = np.random.default_rng(1)
    needed = 1
    for kind in ("random", "towards"):
        ranks = np.zeros(cells + 1, np.int64)
        for s in range(0, pairs, 1024):
            at = x[np.arange(s, min(s + 1024, pairs)) % len(x)]
            u = rng.normal(size=at.shape)
            if kind == "towards" and len(x) > 1:
                u = x[rng.integers(0, len(x), len(at))] + 1e-6 * u
            u = unit(u - (u * at).sum(axis=1, keepdims=True) * at)
            other = cosine * at + max(0.0, 1 - cosine * cosine) ** 0.5 * u
            ranks += np.bincount(sooner(halves(at, books), halves(other, books)),
                                 minlength=cells + 1)
        needed = max(needed, least_cells(ranks, recall))
    return needed


def cells_needed(
    rows: DataFrame, queries: np.ndarray, labels: list, books, cosine: float, recall: float
) -> int:
    """The least number of visited cells that finds ``recall`` of the queries' links, if any."""
    cells = len(books[0]) * len(books[1])
    dim = queries.shape[1]
    known = np.array(labels, dtype=object)
    d1, d2 = halves(queries, books)

    def ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells + 1, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            y = unit(matrix(batch.column(1), dim))
            y_labels = np.array(batch.column(0).to_pylist(), dtype=object)
            same = known[:, None] == y_labels[None, :]
            near = same & (queries @ y.T >= cosine)
            # A query meets itself on its first visit, which is no link.
            near &= ~(queries[:, None, 0] == y[None, :, 0]) | (queries @ y.T < 1 - 1e-12)
            q, v = np.nonzero(near)
            e1, e2 = halves(y, books)
            for s in range(0, len(q), 4096):
                qs, vs = q[s:s + 4096], v[s:s + 4096]
                total += np.bincount(
                    sooner([d1[qs], d2[qs]], [e1[vs], e2[vs]]), minlength=cells + 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["rank", "n"])

    found = (
        rows.select("label", "emb").mapInArrow(ranks, "rank bigint, n bigint")
        .groupBy("rank").agg(F.sum("n").alias("n")).collect()  # cells at most
    )
    total = np.zeros(cells + 1, np.int64)
    for r in found:
        total[r["rank"]] = r["n"]
    return least_cells(total, recall)


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least node that each of ``n`` nodes reaches by the pairs (a, b)."""
    least = np.arange(n)
    while True:
        la, lb = least[a], least[b]
        low = np.minimum(la, lb)
        new = least.copy()
        np.minimum.at(new, la, low)
        np.minimum.at(new, lb, low)
        new = new[new]
        if (new == least).all():
            return least
        least = new


def compare(group: pa.Table, dim: int, cosine: float) -> pa.Table:
    """One block of a cell against one block of its visitors: link counts and a forest."""
    here = np.array(group.column("visitor"))
    ids, w = np.array(group.column("vec_id")), np.array(group.column("n"))
    cell = np.array(group.column("own_cell"))
    x = unit(matrix(group.column("emb"), dim))
    members, visitors = np.flatnonzero(~here), np.flatnonzero(here)
    seen = group.column("cells").to_pylist()
    out_a, out_b = [], []
    t = max((len(c) for c in seen if c is not None), default=1)
    probes = np.full((len(ids), t), -1, np.int64)
    for i in members.tolist():
        probes[i, :len(seen[i])] = seen[i]
    for s in range(0, len(visitors), 256):
        u = visitors[s:s + 256]
        p, q = np.nonzero(x[u] @ x[members].T >= cosine)
        p, q = u[p], members[q]
        # A pair that meets twice counts where the lesser id visits.
        keep_pair = ids[p] < ids[q]
        back = np.flatnonzero(ids[p] > ids[q])
        twice = (probes[q[back]] == cell[p[back], None]).any(axis=1)
        keep_pair[back] = ~twice
        out_a.append(p[keep_pair])
        out_b.append(q[keep_pair])
    a = np.concatenate(out_a) if out_a else np.zeros(0, np.int64)
    b = np.concatenate(out_b) if out_b else np.zeros(0, np.int64)
    uniq, inverse = np.unique(ids, return_inverse=True)
    counts = np.zeros(len(uniq), np.int64)
    np.add.at(counts, inverse[a], w[b])
    np.add.at(counts, inverse[b], w[a])
    least = forest(inverse[a], inverse[b], len(uniq))
    at = np.flatnonzero(counts)
    return pa.table({"vec_id": uniq[at], "low": uniq[least[at]], "n": counts[at]})


def near_duplicates(
    vectors: DataFrame, cosine: float = COSINE, recall: float = RECALL,
    sample: int = SAMPLE, queries: int = QUERIES,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of (vec_id, embedding, label)."""
    # Floats stay floats wherever vectors are stored or shuffled: as doubles they say no more.
    single = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    kept, width = ("<f4", 4) if single else ("<f8", 8)
    rows = vectors.select(
        F.col("vec_id").cast("bigint"), "label",
        F.col("embedding").cast("array<float>" if single else "array<double>").alias("e"))
    fine = F.coalesce(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("e") > 0)
        & F.forall("e", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
        & F.exists("e", lambda c: c != 0), F.lit(False))
    # Of numbers alone only the sign matters.
    e = F.when(F.size("e") == 1, F.transform("e", lambda c: F.signum(c)).cast(
        rows.schema["e"].dataType)).otherwise(F.col("e"))
    kind = rows.schema["label"].dataType.simpleString()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(2)
            flat = np.asarray(lists.flatten(), kept)
            ends = np.cumsum([0, *np.asarray(lists.value_lengths())])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1),
                 pa.array([flat[i:j].tobytes() for i, j in zip(ends, ends[1:], strict=False)],
                          pa.binary())], ["vec_id", "label", "emb"])

    valid = keep(rows.where(fine).select("vec_id", "label", e.alias("e")).mapInArrow(
        packed, f"vec_id bigint, label {kind}, emb binary"))
    classes = keep(valid.groupBy("label", "emb").agg(
        F.min("vec_id").alias("vec_id"), F.count("*").alias("n")))
    size = F.floor(F.length("emb") / width)
    # Vectors of different lengths link with nothing: each frequent length is a search of its own.
    large = [r["dim"] for r in classes.groupBy(size.alias("dim")).count().where(
        F.col("count") > FEW).orderBy("dim").collect()]
    found = classes.where(~size.isin(large) if large else F.lit(True)).groupBy(
        "label", size.alias("dim")).applyInArrow(
        lambda t: compare_all(t, cosine, width), "vec_id bigint, low bigint, n bigint")
    for dim in large:
        found = found.union(search(
            keep(classes.where(size == dim)), dim, cosine, recall, sample, queries))
    found = keep(found)
    links = found.groupBy("vec_id").agg(F.sum("n").alias("others"))
    parts = components(found.where("vec_id <> low").select(
        F.col("vec_id").alias("a"), F.col("low").alias("b")))
    answers = (
        classes.withColumnRenamed("n", "own").join(links, "vec_id", "left")
        .join(parts.withColumnRenamed("node", "vec_id"), "vec_id", "left")
        .select("label", "emb",
                (F.coalesce("others", F.lit(0)) + F.col("own") - 1).alias("n_links"),
                F.coalesce("component", "vec_id").alias("component_id"))
    )
    linked = valid.join(answers, ["label", "emb"]).select("vec_id", "n_links", "component_id")
    apart = rows.where(~fine).select(
        "vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(apart).withColumn(
        "kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def compare_all(t: pa.Table, cosine: float, width: int = 8) -> pa.Table:
    """As ``compare`` for all pairs of a small group of vectors of one length."""
    ids, w = t["vec_id"].to_numpy(), t["n"].to_numpy()
    x = unit(matrix(t["emb"], len(t["emb"][0].as_py()) // width))
    pairs = [np.zeros((2, 0), np.int64)]
    for i in range(0, len(x), BLOCK):
        a, b = np.nonzero(x[i:i + BLOCK] @ x.T >= cosine)
        pairs.append(np.vstack([a + i, b])[:, b > a + i])
    a, b = np.concatenate(pairs, axis=1)
    counts = np.zeros(len(ids), np.int64)
    np.add.at(counts, a, w[b])
    np.add.at(counts, b, w[a])
    order = np.argsort(ids)  # the least row of a component is then its least id
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    least = order[forest(place[a], place[b], len(ids))[place]]
    at = np.flatnonzero(counts)
    return pa.table({"vec_id": ids[at], "low": ids[least[at]], "n": counts[at]})


def search(classes: DataFrame, dim: int, cosine: float, recall: float, sample: int,
           queries: int) -> DataFrame:
    """(vec_id, low, n) of kept, different vectors of one length: what each is linked with."""
    distinct = classes.count()
    kind = classes.schema["label"].dataType.simpleString()

    def drawn(n: int, name: str):
        place = F.pmod(F.xxhash64("vec_id", F.lit(name)), F.lit(1 << 30))
        part = classes.where(place < int((1 << 30) * min(1.0, n / distinct))).limit(2 * n)
        return part.collect() or [classes.first()]

    def units(drawn_rows: list) -> np.ndarray:
        return unit(numbers(
            b"".join(r["emb"] for r in drawn_rows), len(drawn_rows) * dim).reshape(-1, dim))

    x = units(drawn(sample, "sample"))
    k = int(np.clip(round((distinct / 200) ** 0.5), 4, max(4, sample // 8)))
    books = fit_codebooks(x, k)
    asked = drawn(queries, "queries")
    n_cells = max(
        2, cells_at_threshold(units(drawn(PROBES, "probes")), books, cosine, recall),
        cells_needed(classes, units(asked), [r["label"] for r in asked], books, cosine, recall))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 512):
                part = b.slice(s, 512)
                cells = visit(unit(matrix(part.column(1), dim)), books, n_cells)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(cells[:, 0]),
                     pa.array(list(cells), pa.list_(pa.int32()))],
                    [*part.schema.names, "own_cell", "cells"])

    placed = keep(classes.mapInArrow(
        assign, f"label {kind}, emb binary, vec_id bigint, n bigint, own_cell int, cells array<int>"))
    member = placed.withColumns({"cell": F.col("own_cell"), "visitor": F.lit(False)})
    visitor = placed.withColumn("cell", F.explode("cells")).withColumns({
        "visitor": F.lit(True), "cells": F.lit(None).cast("array<int>")})
    sizes = (
        member.select("label", "cell", "visitor").union(visitor.select("label", "cell", "visitor"))
        .groupBy("label", "cell").agg(
            F.sum(F.when(F.col("visitor"), 0).otherwise(1)).alias("m"),
            F.sum(F.when(F.col("visitor"), 1).otherwise(0)).alias("v"))
        .where("m > 0")
        .select("label", "cell", F.ceil(F.col("m") / BLOCK).cast("int").alias("m"),
                F.ceil(F.col("v") / BLOCK).cast("int").alias("v"))
    )
    sizes = small(keep(sizes))
    cols = ["label", "cell", "i", "j", "visitor", "vec_id", "n", "own_cell", "cells", "emb"]
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    block = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")
    both = (
        member.join(sizes, ["label", "cell"]).withColumns({"i": block("m")})
        .withColumn("j", spread("v")).select(cols)
        .union(visitor.join(sizes, ["label", "cell"]).withColumns({"j": block("v")})
               .withColumn("i", spread("m")).select(cols))
    )
    return both.groupBy("label", "cell", "i", "j").applyInArrow(
        lambda t: compare(t, dim, cosine), "vec_id bigint, low bigint, n bigint")


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
