"""Check-digit predicates as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _dihedral(a: int, b: int) -> int:
    """Product in the dihedral group of order ten (0-4 rotations, 5-9 reflections)."""
    if a < 5:
        return (a + b) % 5 if b < 5 else 5 + (a + b) % 5
    return 5 + (a - b) % 5 if b < 5 else (a - b) % 5


def _permutations() -> list[list[int]]:
    rows = [list(range(10))]
    base = [1, 5, 7, 6, 2, 8, 3, 0, 9, 4]  # fixed value: the Verhoeff permutation
    for _ in range(7):
        rows.append([base[i] for i in rows[-1]])
    return rows


MULTIPLY = "".join(str(_dihedral(a, b)) for a in range(10) for b in range(10))
PERMUTE = "".join(str(d) for row in _permutations() for d in row)
BASE36 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _digit_at(table: str, index: Column) -> Column:
    return F.substring(F.lit(table), index + 1, F.lit(1)).cast("int")


def _each(col: Column) -> Column:
    """(index, character) pairs of a string."""
    return F.transform(F.split(col, ""), lambda c, i: F.struct(i.alias("i"), c.alias("c")))


def digits_only(col: Column) -> Column:
    return F.regexp_replace(col, r"[^0-9]", "")


def verhoeff_ok(col: Column) -> Column:
    """Verhoeff check over a string of digits."""
    check = F.aggregate(
        _each(F.reverse(col)),
        F.lit(0),
        lambda acc, p: _digit_at(
            MULTIPLY, acc * 10 + _digit_at(PERMUTE, (p["i"] % 8) * 10 + p["c"].cast("int"))
        ),
    )
    return col.rlike(r"\A[0-9]+\z") & (check == 0)


def gstin_ok(col: Column) -> Column:
    """Mod-36 check character of a 15-character GSTIN."""
    body = F.substring(col, 1, 14)

    def add(acc, p):
        product = (F.instr(F.lit(BASE36), p["c"]) - 1) * (
            p["i"] % 2 + 1
        )
        return acc + F.floor(product / 36).cast("int") + product % 36

    total = F.aggregate(_each(body), F.lit(0), add)
    expected = F.substring(F.lit(BASE36), (36 - total % 36) % 36 + 1, F.lit(1))
    return col.rlike(r"\A[0-9A-Z]{15}\z") & (expected == F.substring(col, 15, 1))


def luhn_ok(col: Column) -> Column:
    """Luhn over the digits of a value; at least twelve digits."""
    digits = digits_only(col)

    def add(acc, p):
        d = p["c"].cast("int") * (p["i"] % 2 + 1)
        return acc + F.when(d > 9, d - 9).otherwise(d)

    total = F.aggregate(_each(F.reverse(digits)), F.lit(0), add)
    return (F.length(digits) >= 12) & (total % 10 == 0)


def mod97_ok(col: Column) -> Column:
    """IBAN check: rotate four characters, letters to numbers, remainder 1 of 97."""
    compact = F.upper(F.regexp_replace(col, r"\s+", ""))
    turned = F.concat(F.substring(compact, 5, 64), F.substring(compact, 1, 4))

    def fold(acc, c):
        v = F.instr(F.lit(BASE36), c) - 1
        return F.when(v >= 10, acc * 100 + v).otherwise(acc * 10 + v) % 97

    rest = F.aggregate(F.split(turned, ""), F.lit(0), fold)
    return compact.rlike(r"\A[A-Z]{2}[0-9A-Z]{13,32}\z") & (rest == 1)


#: Names a learned rule may use for its checksum.
CHECKSUMS = {
    "verhoeff": verhoeff_ok,
    "gstin": gstin_ok,
    "luhn": luhn_ok,
    "mod97": mod97_ok,
}
