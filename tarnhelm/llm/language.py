"""Language identification by unigram piece models with all segmentations summed.

Each language has a probability for every piece of a fixed public vocabulary, estimated from
labelled documents. The probability of a word is the sum over all its segmentations into pieces,
computed by the forward algorithm; characters outside the vocabulary have a small probability of
their own. A text's score is the sum over its words, and the answer is the language with the
highest posterior under a uniform prior.

The models are fitted on a sample of about ``TRAIN_DOCS`` documents per language, chosen by the
hash of the id, from labelled documents that are not held out. A null text, or one without any
letter, is ``und`` with score 0. Ties go to the least language name. With no labelled documents
every text is ``und``. Repeated rows get equal answers; whole texts are read; other columns are
passed on by ``predict``, and ones named lang_pred or score are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnhelm.llm.common import give_back, table

#: Documents per language that the models are fitted on, about.
TRAIN_DOCS = 1500
#: Added to each piece's count.
SMOOTHING = 0.1
#: Probability of a character that no piece covers.
UNKNOWN = 1e-9
#: Longest word whose probabilities are kept unscaled.
LONG = 48
#: Log probability below which a word is computed again with rescaled sums.
FAINT = -600.0
#: Characters of text scored at once.
CHUNK = 250_000
#: Words whose probabilities a task remembers before it starts anew.
KNOWN_WORDS = 150_000
UNDETERMINED = "und"
LETTER = re.compile(r"[^\W\d_]")
MARK = "▁"
STEP = np.uint64(0x9E3779B97F4A7C15)


def vocabulary() -> str:
    import public_tokenizers as P

    return P.path("piece_bpe_32k.model")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, path: str, per_lang: int = TRAIN_DOCS) -> tuple[list[str], np.ndarray]:
    """Languages and their log-free piece probabilities (pieces x languages).

    ``docs`` has doc_id, text and lang. The result has one row per piece of the vocabulary.
    """
    labelled = docs.where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.col("lang") != UNDETERMINED))
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(
        F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return [], np.zeros((0, 0))
    share = F.create_map(*[F.lit(x) for g in langs for x in (g, min(1.0, per_lang / sizes[g]))])
    place = F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1_000_000)) / 1_000_000
    sample = labelled.where(place < share[F.col("lang")]).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        for batch in batches:
            found: dict[str, np.ndarray] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = model.encode(" ".join(text.as_py().lower().split()), num_threads=1)
                sums = found.setdefault(lang, np.zeros(model.get_piece_size(), np.int64))
                np.add.at(sums, np.array(ids, np.int64), 1)
            for lang, sums in found.items():
                at = np.flatnonzero(sums)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(at)), pa.array(at), pa.array(sums[at])],
                    ["lang", "piece", "n"])

    rows = sample.mapInArrow(count, "lang string, piece bigint, n bigint").groupBy(
        "lang", "piece").agg(F.sum("n").alias("n")).collect()  # pieces x languages at most
    pieces = plain_pieces(path)
    probs = np.zeros((len(pieces), len(langs)))
    at = {g: i for i, g in enumerate(langs)}
    for r in rows:
        if pieces[r["piece"]]:
            probs[r["piece"], at[r["lang"]]] = r["n"]
    known = np.array([bool(p) for p in pieces])
    probs[known] += SMOOTHING
    return langs, probs / probs.sum(axis=0)


def plain_pieces(path: str) -> list[str]:
    """The vocabulary's pieces in the order of their ids; '' for marks and bytes."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    return [
        "" if m.is_control(i) or m.is_unknown(i) or m.is_byte(i) else m.id_to_piece(i)
        for i in range(m.get_piece_size())
    ]


class Forward:
    """Log probabilities of words under each language, all segmentations summed."""

    def __init__(self, pieces: list[str], probs: np.ndarray):
        self.probs = probs
        self.longest = max((len(p) for p in pieces), default=1)
        keys = np.zeros(len(pieces), np.uint64)
        for i, p in enumerate(pieces):
            h = 0
            for c in p:
                h = (h * int(STEP) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
            keys[i] = h
        self.lengths = np.array([len(p) for p in pieces])
        order = np.argsort(keys, kind="stable")
        order = order[self.lengths[order] > 0]
        self.keys, self.ids = keys[order], order
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[(self.keys >> np.uint64(42)).astype(np.int64)] = True

    def __call__(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), self.probs.shape[1]))
        sizes = np.array([len(w) for w in words])
        short = np.flatnonzero(sizes <= LONG)
        if len(short):
            out[short] = self.short([words[i] for i in short], sizes[short])
        # Long or very unlikely words would fall below what a double can hold.
        for i in np.flatnonzero((sizes > LONG) | (out.min(axis=1) < FAINT)):
            out[i] = self.long(words[i])
        return out

    def matches(self, text: str, left: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per piece length: positions at which a piece starts, and its id. ``left``: the
        characters from each position to the end of its word."""
        c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        c += np.uint64(1)
        found, h = [], np.zeros(len(c), np.uint64)
        at = np.arange(len(c))
        for n in range(1, self.longest + 1):
            fits = left[at] >= n
            at, h = at[fits], h[fits]
            h = h * STEP + c[at + n - 1]
            hit = np.flatnonzero(self.maybe[(h >> np.uint64(42)).astype(np.int64)])
            k = np.searchsorted(self.keys, h[hit])
            k[k == len(self.keys)] = 0
            same = (self.keys[k] == h[hit]) & (self.lengths[self.ids[k]] == n)
            found.append((at[hit[same]], self.ids[k[same]]))
        return found

    def short(self, words: list[str], sizes: np.ndarray) -> np.ndarray:
        first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        inner = np.arange(sizes.sum()) - np.repeat(first, sizes)
        left = np.repeat(sizes, sizes) - inner
        word = np.repeat(np.arange(len(words)), sizes)
        starts, ids, lens = [], [], []
        for n, (at, piece) in enumerate(self.matches("".join(words), left), 1):
            starts.append(at)
            ids.append(piece)
            lens.append(np.full(len(at), n))
        single = np.zeros(len(inner), bool)
        single[starts[0]] = True
        bare = np.flatnonzero(~single)  # characters that are no piece
        starts, ids, lens = map(np.concatenate, (
            [*starts, bare], [*ids, np.full(len(bare), -1)], [*lens, np.ones(len(bare), int)]))
        ends = inner[starts] + lens
        # A word has one match at most for each end and length: no two rows of a step collide.
        order = np.lexsort((lens, ends))
        starts, ids, lens, ends = starts[order], ids[order], lens[order], ends[order]
        p = np.vstack([self.probs, np.full((1, self.probs.shape[1]), UNKNOWN)])
        alpha = np.zeros((len(inner) + len(words), p.shape[1]))
        base = first + np.arange(len(words))  # each word has a cell before its characters
        alpha[base] = 1.0
        cell = starts + word[starts]
        step = ends * (self.longest + 1) + lens
        edges = np.flatnonzero(np.diff(step, prepend=-1))
        for a, b in zip(edges, [*edges[1:], len(step)], strict=True):
            alpha[cell[a:b] + lens[a]] += alpha[cell[a:b]] * p[ids[a:b]]
        return np.log(np.maximum(alpha[base + sizes], 1e-300))

    def long(self, word: str) -> np.ndarray:
        """As ``short`` for one long word, with the sums rescaled as they go."""
        n = len(word)
        at: dict[int, list[tuple[int, int]]] = {}
        for length, (starts, ids) in enumerate(
            self.matches(word, n - np.arange(n)), 1
        ):
            for s, i in zip(starts.tolist(), ids.tolist(), strict=True):
                at.setdefault(s + length, []).append((length, i))
        w, langs = self.longest, self.probs.shape[1]
        window = np.zeros((w, langs))  # the last w sums, the latest first
        window[0] = 1.0
        total = np.zeros(langs)
        for end in range(1, n + 1):
            hits = at.get(end, [])
            new = sum((window[k - 1] * self.probs[i] for k, i in hits), np.zeros(langs))
            if not any(k == 1 for k, _ in hits):
                new = new + window[0] * UNKNOWN
            window[1:] = window[:-1].copy()
            window[0] = new
            top = window.max(axis=0)
            window /= top
            total += np.log(top)
        return total + np.log(np.maximum(window[0], 1e-300))


class Scorer:
    """(language, posterior) of texts; words that were met before keep their probabilities."""

    def __init__(self, langs: list[str], forward: Forward):
        self.langs, self.forward = langs, forward
        self.forget()

    def forget(self) -> None:
        self.ids: dict[str, int] = {}
        self.known = np.zeros((1024, len(self.langs)))

    def __call__(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = [(UNDETERMINED, 0.0)] * len(texts)
        if not self.langs:
            return out
        if len(self.ids) > KNOWN_WORDS:
            self.forget()
        ids, first = self.ids, len(self.ids)
        sizes, flat = [], []
        for t in texts:
            if t is None or not LETTER.search(t):
                sizes.append(0)
                continue
            own = [ids.setdefault(w, len(ids)) for w in t.lower().split()]
            sizes.append(len(own))
            flat.append(np.array(own, np.int64))
        if not flat:
            return out
        n = len(ids)
        if n > first:
            if n > len(self.known):
                more = np.zeros((2 * n, len(self.langs)))
                more[:first] = self.known[:first]
                self.known = more
            new = list(islice(reversed(ids), n - first))[::-1]
            self.known[first:n] = self.forward([MARK + w for w in new])
        at = np.flatnonzero(sizes)
        edges = np.concatenate([[0], np.cumsum(np.array(sizes)[at])[:-1]])
        sums = np.add.reduceat(self.known[np.concatenate(flat)], edges, axis=0)
        best = sums.argmax(axis=1)
        rest = np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1)
        for i, b, r in zip(at.tolist(), best.tolist(), rest.tolist(), strict=True):
            out[i] = (self.langs[b], 1.0 / r)
        return out


def predict(docs: DataFrame, langs: list[str], probs: np.ndarray, path: str) -> DataFrame:
    """``docs`` with lang_pred and score, from ``text`` alone; one pass, no shuffle.

    Python gets the texts only, all other columns stay where they are.
    """
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(langs, Forward(plain_pieces(path), probs) if langs else None)
        for column in columns:
            found, texts, chars = [], [], 0
            for text in column:
                texts.append(text.as_py())
                chars += len(texts[-1] or "")
                if chars > CHUNK:
                    found += scorer(texts)
                    texts, chars = [], 0
            found += scorer(texts)
            yield pa.StructArray.from_arrays(
                [pa.array([x[0] for x in found], pa.string()),
                 pa.array([x[1] for x in found], pa.float64())], ["lang_pred", "score"])
        give_back()

    # Called non-deterministic, so that a filter on its answers does not run it twice.
    judge = F.arrow_udf(run, "lang_pred string, score double").asNondeterministic()
    docs = docs.select([c for c in docs.columns if c not in ("lang_pred", "score")])
    judged = docs.select("*", judge(F.col("text")).alias("_judged"))
    return judged.select(*docs.columns, "_judged.lang_pred", "_judged.score")


def identify(docs: DataFrame, path: str | None = None, per_lang: int = TRAIN_DOCS) -> DataFrame:
    """Fit on the labelled documents that are not held out; predict all."""
    path = path or vocabulary()
    langs, probs = fit(docs.where(~held_out(F.col("doc_id"))), path, per_lang)
    return predict(docs, langs, probs, path)


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    path = vocabulary()
    langs, probs = fit(docs.where(~held_out(F.col("doc_id"))), path)
    return predict(docs.select("doc_id", "text"), langs, probs, path).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
