"""License notices by conditional compression.

A candidate is the stretch of words, across line ends, that comes nearest to a template near a word
that speaks of a licence (on its line, or within about two template lengths). It is compressed
alone and with the template as a raw zstandard dictionary; the bytes saved, as a share of the
template's own compressed size, must reach ``SAVED``. Where candidates overlap, the one that saves
most bytes comes first. Its exact wording confirms or refuses it, and then the next one's turn
comes: few words of the template may be missing, a word that decides between licences (another
version, NonCommercial, Lesser ...) must be neither added nor missing, and no negation may stand
before it. The words of the template that are missing and those that are added are listed.

Templates are rows (license, text); ``TEMPLATES`` has short notices and ``FULL_TEXTS`` whole
licences. Documents without a candidate give no rows. Null and empty texts have none. Ties go to
the least license name. Repeated rows are scanned each. Whole texts are read. Other columns than
those named are dropped.
"""

from __future__ import annotations

import difflib
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator, Sequence
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnhelm.llm.common import table

#: Short notices by which works are put under well-known licences.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without "
                     "modification, are permitted provided that the following conditions are met."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 "
                  "International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 "
                     "International License."),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright and "
                "related rights to this work to the public domain worldwide."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Made available under the terms of the MIT License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, "
                "v. 2.0."),
)
#: Short names that may stand for a licence in a source file.
TEMPLATES += tuple((name, f"SPDX-License-Identifier: {name}") for name in sorted(
    {name for name, _ in TEMPLATES}))
#: Whole licences, a file each.
FULL_TEXTS = tuple(
    (p.stem, p.read_text()) for p in sorted((Path(__file__).parent / "texts").glob("*.txt")))
#: Words of which a block must have one to be compressed.
GATE = "(?i)licen[sc]e|licen[sc]ed|copyright|redistribution|all rights reserved|creative commons"
#: Least bytes that a template must save, as a share of its own compressed size.
SAVED = 0.3
#: Share of a template's words that may be missing or changed.
MISSING = 0.2
#: What a lacking word costs in added ones where a notice is laid against a text.
LACKING = 8
#: Words, or parts of words with hyphens, that make another licence of one.
DECIDING = frozenset((
    "affero", "except", "lesser", "nc", "nd", "never", "no", "noncommercial", "noderivatives",
    "noderivs", "not", "sa", "sharealike"))
NEGATIONS = frozenset(("cannot", "neither", "never", "no", "not"))
#: A version; years are none.
VERSION = re.compile(r"v?\d+(?:\.\d+)+|v?\d")
#: Words before a notice among which a negation of the same sentence refuses it.
BEFORE = 3
#: Words after a notice that may be the version that it lacks.
AFTER = 2
ENDS = re.compile(r"[.!?;:](?=\s)|\n\s*\n")
WORD = re.compile(r"\w[\w.\-]*\w|\w")


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def differences(template: str, block: str) -> tuple[list[str], list[str]]:
    """Words of the template that the block lacks, and words inside the notice that it adds."""
    a, b = words(template), words(block)
    missing, added = [], []
    steps = difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes()
    inner = [i for i, s in enumerate(steps) if s[0] == "equal"]
    for i, (kind, i1, i2, j1, j2) in enumerate(steps):
        if kind in ("delete", "replace"):
            missing += a[i1:i2]
        if kind in ("insert", "replace") and inner and inner[0] < i < inner[-1]:
            added += b[j1:j2]
    return missing, added


def another(lacks: list[str], adds: list[str], following: list[str]) -> bool:
    """Whether these differences make another licence of a notice; ``following`` are the next
    words of its sentence."""
    parts = [p for w in [*lacks, *adds] for p in w.split("-")]
    versions = [w for w in adds if VERSION.fullmatch(w)]
    if any(VERSION.fullmatch(w) for w in lacks):
        versions += [w for w in following if VERSION.fullmatch(w)]
    return bool(versions) or not DECIDING.isdisjoint(parts)


def stretches(a: np.ndarray, b: np.ndarray, most: float, lacking: int = LACKING) -> list[tuple[int, int]]:
    """Stretches of ``b`` near ``a``, nearest first: ends where the distance is least nearby.

    At most ``most`` words of ``a`` are lacking in them. A word of ``a`` that is lacking costs ``lacking``, one that ``b`` adds costs 1. The cost is kept
    in the upper bits of an integer and the place where the stretch starts, negated, in the lower.
    """
    one = 1 << 24
    ramp = np.arange(len(b) + 1, dtype=np.int64)
    row = len(b) - ramp
    for x in a.tolist():
        new = row + lacking * one
        new[1:] = np.where(b == x, np.minimum(new[1:], row[:-1]), new[1:])
        row = np.minimum.accumulate(new - ramp * one) + ramp * one
    cost, start = row // one, len(b) - row % one
    lacks = (cost + len(a) - (ramp - start)) // (lacking + 1)
    least = np.flatnonzero((cost[1:] < cost[:-1]) & (lacks[1:] <= most)) + 1
    return [(int(start[j]), int(j)) for j in least[cost[least].argsort(kind="stable")]
            if start[j] < j]


class Finder:
    """Finds notices of the templates in a text."""

    def __init__(self, templates, gate: str, saved: float, missing: float, level: int = 3):
        import zstandard as z

        self.gate, self.saved, self.missing = re.compile(gate), saved, missing
        plain = dict(write_content_size=False, write_checksum=False, write_dict_id=False)
        self.alone = z.ZstdCompressor(level=level, **plain)
        self.ids: dict[str, int] = {}
        self.templates = []
        for name, text in sorted(templates):
            known = words(text)
            if known:
                a = np.array([self.ids.setdefault(w, len(self.ids)) for w in known])
                under = z.ZstdCompressor(level=level, dict_data=z.ZstdCompressionDict(
                    text.encode().ljust(8, b"\n"), dict_type=z.DICT_TYPE_RAWCONTENT), **plain)
                own = len(self.alone.compress(text.encode()))
                self.templates.append((name, text, a, Counter(a.tolist()), under, own))

    def saving(self, block: str, under, own: int) -> float:
        data = block.encode("utf-8", "surrogatepass")
        return (len(self.alone.compress(data)) - len(under.compress(data))) / own

    def notices(self, text: str) -> list[tuple]:
        """(line, license, saving, missing, added, exact), in the order of the text."""
        spans = [(m.start(), m.end(), m.group().lower()) for m in WORD.finditer(text)]
        if not spans:
            return []
        starts = [x[0] for x in spans]
        at = np.array([self.ids.get(x[2], -1) for x in spans])
        counts = Counter(at.tolist())
        gates = []
        for m in self.gate.finditer(text):
            line = text.rfind("\n", 0, m.start()) + 1, text.find("\n", m.start())
            last = len(text) if line[1] < 0 else line[1]
            gates.append((max(0, bisect_right(starts, m.start()) - 1),
                          bisect_right(starts, line[0] - 1), bisect_right(starts, last)))
        spoken = [g[0] for g in gates]
        found = []
        for name, template, a, has, under, own in self.templates:
            lack = self.missing * len(a)
            if sum(min(n, counts[x]) for x, n in has.items()) < len(a) - lack:
                continue
            reach, regions = 2 * len(a) + 8, []
            for i, lo, hi in gates:
                lo, hi = min(lo, max(0, i - reach)), max(hi, min(len(at), i + reach))
                if regions and lo <= regions[-1][1]:
                    regions[-1][1] = max(hi, regions[-1][1])
                else:
                    regions.append([lo, hi])
            for lo, hi in regions:
                taken = np.zeros(hi, bool)
                for i, j in stretches(a, at[lo:hi], lack):
                    i, j = lo + i, lo + j
                    if taken[i:j].any() or bisect_left(spoken, i) == bisect_left(spoken, j):
                        continue
                    end = spans[j - 1][1]
                    while end < len(text) and not text[end].isspace():
                        end += 1
                    block = text[spans[i][0]:end]
                    lacks, adds = differences(template, text[spans[i][0]:spans[j - 1][1]])
                    following = [s[2] for s in spans[j:j + AFTER] if not ENDS.search(
                        text, spans[j - 1][1], s[0])]
                    if len(lacks) > lack or another(lacks, adds, following):
                        continue
                    if any(spans[k][2] in NEGATIONS and not ENDS.search(
                            text, spans[k][1], spans[i][0]) for k in range(max(0, i - BEFORE), i)):
                        continue
                    share = self.saving(block, under, own)
                    if share < self.saved:
                        continue
                    taken[i:j] = True
                    found.append((-share * own, len(lacks) + len(adds), name, i, j, share,
                                  lacks, adds))
        out: list[tuple] = []
        used = np.zeros(len(at), bool)
        for _, _, name, i, j, share, lacks, adds in sorted(found, key=lambda x: x[:5]):
            if not used[i:j].any():
                used[i:j] = True
                out.append((text.count("\n", 0, spans[i][0]), name, share, " ".join(lacks),
                            " ".join(adds), not lacks and not adds, i))
        return [x[:-1] for x in sorted(out, key=lambda x: x[-1])]


def scan(
    docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES + FULL_TEXTS,
    gate: str = GATE, saved: float = SAVED, missing: float = MISSING,
) -> DataFrame:
    """Notices found in (doc_id, text): one row per notice that a template is confirmed in.

    ``line`` is where the notice starts and counts from 0; ``saving`` is the share saved;
    ``missing`` and ``added`` are words.
    """
    wrapped = gate.replace(" ", r"\s+")
    gated = docs.select(F.col("doc_id").cast("bigint"), "text").where(F.col("text").rlike(wrapped))

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(templates, wrapped, saved, missing)
        for batch in batches:
            rows = [(doc, *x) for doc, text in zip(
                *(c.to_pylist() for c in batch.columns), strict=True) for x in finder.notices(text)]
            kinds = (pa.int64(), pa.int32(), pa.string(), pa.float64(), pa.string(), pa.string(),
                     pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)],
                ["doc_id", "line", "license", "saving", "missing", "added", "exact"])

    return gated.mapInArrow(
        confirm, "doc_id bigint, line int, license string, saving double, missing string, "
                 "added string, exact boolean")


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
