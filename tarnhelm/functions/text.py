"""Column functions over text: offsets, entropy, shapes. All run inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Word-boundary guards that treat every Unicode letter and digit as a word character.
NOT_AFTER_WORD = r"(?<![\p{L}\p{N}_])"
NOT_BEFORE_WORD = r"(?![\p{L}\p{N}_])"

#: Unicode white space as one character class body.
WHITESPACE = r"\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"

MATCH_TYPE = "array<struct<start:int,end:int,value:string,before:string,after:string>>"

# Private-use marks put around matches; a text that holds them gets a third one instead,
# which keeps every offset.
_OPEN, _CLOSE, _SPARE = "\ue000", "\ue001", "\ue002"


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times.

    Inside a lambda Spark does not share common subexpressions, so a value that is used
    twice there is computed twice. A one-element transform names it.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Elements that running sums add one by one; whole blocks of them are added at once.
_BLOCK = 64


def running_sums(numbers: Column) -> Column:
    """The sum of each element of an array and all before it.

    Sums are taken inside blocks, and over the blocks before: two short levels instead of one
    long one for each element.
    """
    zero = F.lit(0)

    def total(part: Column) -> Column:
        return F.aggregate(part, zero, lambda acc, x: acc + x)

    def walk(xs):
        block = lambda i: F.floor(i / _BLOCK).cast("int")
        sums = F.transform(
            F.sequence(zero, block(F.greatest(F.size(xs) - 1, zero))),
            lambda b: total(F.slice(xs, b * _BLOCK + 1, F.lit(_BLOCK))))
        bases = bind(sums, lambda all_: F.transform(
            all_, lambda x, b: total(F.slice(all_, F.lit(1), b))))
        return bind(bases, lambda base: F.transform(xs, lambda x, i: F.get(
            base, block(i)) + total(F.slice(xs, block(i) * _BLOCK + 1, i % _BLOCK + 1))))

    return bind(numbers, walk)


def find_all(
    text: Column, pattern: str, before: int = 1, after: int = 1, shortest: int = 1,
    words: bool = False,
) -> Column:
    """Every non-overlapping match with code-point offsets and bounded context.

    One regex pass puts marks around the matches. Splitting at a mark is a plain character
    split, and running sums of the pieces' lengths, less the marks in them, are the offsets.
    ``before`` and ``after`` are how many neighbouring characters to carry along, which lets
    the caller drop the text; they come from the neighbouring pieces, so the work is in
    proportion to the text however many matches it has. ``shortest`` is the least length of a
    match and bounds how many pieces a context can span. ``words`` says that no match holds a blank
    and that the pattern looks at nothing beside a match: it is then tried only on the pieces
    between blanks that have ``shortest`` characters, which spares prose the regex pass.
    """
    def mark(part):
        return F.regexp_replace(part, pattern, f"{_OPEN}$0{_CLOSE}")

    def mark_words(part):
        return F.array_join(F.transform(F.split(part, " ", -1), lambda w: F.when(
            F.length(w) >= shortest, mark(w)).otherwise(w)), " ")

    clean = F.when(
        F.contains(text, F.lit(_OPEN)) | F.contains(text, F.lit(_CLOSE)),
        F.translate(text, _OPEN + _CLOSE, _SPARE + _SPARE),
    ).otherwise(text)
    none = F.array().cast(MATCH_TYPE)

    def plain(p):
        return F.replace(p, F.lit(_CLOSE), F.lit(""))

    def described(pieces, marks, left, right):
        """Arrays with one element per match, read side by side."""
        def match(z, i):
            piece = z["piece"]
            value = F.substring_index(piece, _CLOSE, 1)
            lo = z["mark"] - i
            rest = F.substring(piece, F.length(value) + 2, F.lit(after))
            return F.struct(
                lo.alias("start"),
                (lo + F.length(value)).alias("end"),
                value.alias("value"),
                z["left"].alias("before"),
                F.when(F.length(rest) == after, rest).otherwise(
                    F.left(F.concat(rest, F.coalesce(z["right"], F.lit(""))), F.lit(after))
                ).alias("after"),
            )

        return F.transform(
            F.arrays_zip(pieces.alias("piece"), marks.alias("mark"), left.alias("left"),
                         right.alias("right")), match)

    def walk(parts):
        rest = F.greatest(F.size(parts) - 1, F.lit(0))
        marks = running_sums(F.transform(F.slice(parts, F.lit(1), rest), lambda p: F.length(p)))
        tails = F.transform(parts, lambda p: F.right(plain(p), F.lit(before)))
        heads = F.transform(parts, lambda p: F.left(plain(p), F.lit(after)))
        own = F.slice(parts, F.lit(2), rest)
        if before <= shortest and after <= shortest:
            found = described(
                own, marks, F.slice(tails, F.lit(1), rest),
                F.slice(heads, F.lit(3), F.greatest(rest - 1, F.lit(0))))
        else:
            found = bind(F.struct(tails.alias("t"), heads.alias("h")), lambda k: described(
                own, marks,
                F.transform(F.sequence(F.lit(1), rest), lambda i: joined_before(k["t"], i)),
                F.transform(F.sequence(F.lit(1), rest), lambda i: joined_after(k["h"], i))))
        return F.when(F.size(parts) > 1, found).otherwise(none)

    def joined_before(tails, i):
        most = F.lit(-(-before // shortest))
        return F.right(F.array_join(F.slice(
            tails, F.greatest(i - most, F.lit(0)) + 1, F.least(i, most)), ""), F.lit(before))

    def joined_after(heads, i):
        most = F.lit(-(-after // shortest))
        return F.left(F.array_join(F.slice(heads, i + 2, most), ""), F.lit(after))

    return bind(F.split(mark_words(clean) if words else mark(clean), _OPEN, -1), walk)


def not_touching(hit: Column) -> Column:
    """True when neither neighbour of a match is a letter, a digit or an underscore."""
    word = r"[\p{L}\p{N}_]"
    return ~F.substring(hit["before"], -1, 1).rlike(word) & ~F.substring(
        hit["after"], 1, 1
    ).rlike(word)


def chars(col: Column) -> Column:
    return F.split(col, "")


def entropy(col: Column) -> Column:
    """Shannon entropy in bits per character; 0 below two characters."""

    def measure(v):
        def term(acc, ch):
            p = (F.length(v) - F.length(F.replace(v, ch, F.lit("")))) / F.length(v)
            return acc - p * F.log2(p)

        total = F.aggregate(F.array_distinct(chars(v)), F.lit(0.0).cast("double"), term)
        return F.when(F.length(v) < 2, F.lit(0.0)).otherwise(total)

    return bind(col, measure)


def entropy_at_least(col: Column, floor: float | Column) -> Column:
    """Entropy test that does not depend on the last bits of the logarithm."""
    return F.round(entropy(col), 9) >= (floor if isinstance(floor, Column) else F.lit(floor))


def strip_space(col: Column) -> Column:
    return F.regexp_replace(col, f"^[{WHITESPACE}]+|[{WHITESPACE}]+$", "")


def rstrip_space(col: Column) -> Column:
    return F.regexp_replace(col, f"[{WHITESPACE}]+$", "")


def shape_of(col: Column, cap: int = 64) -> Column:
    """Character-class skeleton: A, a, 9, blank; everything else stays as it is."""
    out = F.substring(col, 1, cap)
    for pattern, mark in (
        (r"\p{IsLowercase}", "a"),
        (r"\p{IsUppercase}", "A"),
        (r"[\p{Nd}\x{b2}\x{b3}\x{b9}]", "9"),
        (f"[{WHITESPACE}]", " "),
    ):
        out = F.regexp_replace(out, pattern, mark)
    return F.when(F.length(col) > cap, F.concat(out, F.lit("…"))).otherwise(out)


def charset_class(col: Column) -> Column:
    return (
        F.when(col == "", "empty")
        .when(col.rlike(r"\A[0-9a-fA-F]+\z"), "hex")
        .when(col.rlike(r"\A[\p{Nd}]+\z"), "digits")
        .when(col.rlike(r"\A[A-Za-z0-9+/=_-]+\z"), "base64ish")
        .when(col.rlike(r"[\x{900}-\x{97f}]"), "devanagari")
        .when(col.rlike(r"\A[\x00-\x7f]+\z"), "ascii")
        .otherwise("mixed")
    )


def printable_ratio(col: Column) -> Column:
    """Share of characters that are printable ASCII, tab or a line break."""
    kept = F.length(F.regexp_replace(col, r"[^\x20-\x7e\t\n\r]", ""))
    return F.when(F.length(col) == 0, F.lit(0.0)).otherwise(kept / F.length(col))


def mask_text(col: Column) -> Column:
    """One block character per masked character, at least 1 and at most 32."""
    return F.repeat(F.lit("█"), F.least(F.greatest(F.length(col), F.lit(1)), F.lit(32)))


def key_name(path: Column) -> Column:
    """Last named path segment, or a fixed mark when it is not an identifier."""
    last = F.regexp_extract(F.element_at(F.split(path, r"\."), -1), r"^([^\[]*)", 1)
    return F.when(last.rlike(r"\A[\p{L}_][\p{L}\p{N}_]*\z"), last).otherwise("«opaque»")


def is_identifier_shaped(col: Column) -> Column:
    """6-128 characters, no white space, a plain character set and at least one digit."""
    v = strip_space(col)
    return (
        F.length(v).between(6, 128)
        & ~v.rlike(f"[{WHITESPACE}]")
        & charset_class(v).isin("digits", "hex", "base64ish", "ascii")
        & v.rlike(r"\p{Nd}")
    )


def identifier_tokens(col: Column) -> Column:
    """Identifier-shaped tokens of running prose, punctuation trimmed, in order."""
    raw = F.split(col, r"""[\s,;()\[\]{}<>"'`]+""", -1)
    trimmed = F.transform(
        raw, lambda t: F.regexp_replace(t, r"^[.:!?\-_/]+|[.:!?\-_/]+$", "")
    )
    return F.filter(trimmed, lambda t: (t != "") & is_identifier_shaped(t))
