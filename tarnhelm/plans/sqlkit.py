"""Building blocks of the reference SQL."""

from __future__ import annotations

from tarnhelm.functions.checks import BASE36, MULTIPLY, PERMUTE


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def matches(src: str, pattern: str, before: int = 1, after: int = 1, text: str = "text",
            where: str = "true") -> str:
    """Subquery with all matches: value, s, e (offsets), before, after, and src columns."""
    p = lit(pattern)
    return f"""(
      select *, substr({text}, cast(greatest(s - {before}, 0) + 1 as bigint), cast(s - greatest(s - {before}, 0) as bigint)) as before,
             substr({text}, cast(e + 1 as bigint), {after}) as after
      from (select q.*, m[i] as value, s0 as s, s0 + length(m[i]) as e
        from (select w.*, u.i,
                coalesce(list_sum(list_transform(g[1:u.i], lambda x: length(x))), 0)
                + coalesce(list_sum(list_transform(m[1:u.i - 1], lambda x: length(x))), 0) as s0
              from (select *, regexp_extract_all({text}, {p}) as m, string_split_regex({text}, {p}) as g
                    from {src} src0 where regexp_matches({text}, {p}) and {where}) w,
                   lateral (select unnest(range(1, len(w.m) + 1)) as i) u) q) z)"""


def entropy(v: str) -> str:
    """Shannon entropy of a string, rounded like the Spark predicate."""
    return (
        f"(case when length({v}) < 2 then 0.0 else round(list_sum(list_transform("
        f"list_distinct(string_split({v}, '')), lambda ch: "
        f"-((length({v}) - length(replace({v}, ch, ''))) / length({v})) * "
        f"log2((length({v}) - length(replace({v}, ch, ''))) / length({v})))), 9) end)"
    )


FREE = (
    "(not regexp_matches(right(before, 1), '[\\p{L}\\p{N}_]') "
    "and not regexp_matches(left(after, 1), '[\\p{L}\\p{N}_]'))"
)


def verhoeff(v: str) -> str:
    """Twelve-digit Verhoeff check, unrolled from the last digit."""
    check = "0"
    for i in range(12):
        digit = f"cast(substr({v}, {12 - i}, 1) as int)"
        perm = f"cast(substr('{PERMUTE}', {10 * (i % 8) + 1} + {digit}, 1) as int)"
        check = f"cast(substr('{MULTIPLY}', ({check}) * 10 + {perm} + 1, 1) as int)"
    return f"(({check}) = 0)"


def gstin(v: str) -> str:
    terms = []
    for i in range(14):
        w = 2 if i % 2 else 1
        p = f"((instr('{BASE36}', substr({v}, {i + 1}, 1)) - 1) * {w})"
        terms.append(f"({p} // 36 + {p} % 36)")
    total = " + ".join(terms)
    return (
        f"(substr('{BASE36}', cast((36 - ({total}) % 36) % 36 + 1 as int), 1) = substr({v}, 15, 1))"
    )


def luhn(v: str) -> str:
    d = f"regexp_replace({v}, '[^0-9]', '', 'g')"
    return (
        f"(length({d}) >= 12 and list_sum(list_transform(range(0, length({d})), lambda k: "
        f"case when k % 2 = 1 then (case when cast(substr({d}, length({d}) - k, 1) as int) * 2 > 9 "
        f"then cast(substr({d}, length({d}) - k, 1) as int) * 2 - 9 "
        f"else cast(substr({d}, length({d}) - k, 1) as int) * 2 end) "
        f"else cast(substr({d}, length({d}) - k, 1) as int) end)) % 10 = 0)"
    )


def hmac(key: bytes, message: str) -> str:
    """HMAC-SHA256 as hex from nested hashes of byte strings."""
    block = key.ljust(64, b"\0")
    inner = bytes(b ^ 0x36 for b in block).hex()
    outer = bytes(b ^ 0x5C for b in block).hex()
    return f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({message}))))"


def base32(hex_expr: str, width: int = 3) -> str:
    """Leading base32 characters of a hex digest."""
    bits = f"cast(('0x' || substr({hex_expr}, 1, 15)) as bigint)"
    out = [
        f"substr('abcdefghijklmnopqrstuvwxyz234567', cast((({bits} >> {55 - 5 * i}) & 31) + 1 as int), 1)"
        for i in range(width)
    ]
    return "(" + " || ".join(out) + ")"


RANK = "(case {0} when 'allow' then 0 when 'warn' then 1 when 'tokenize' then 2 when 'mask' then 3 when 'block' then 4 end)"
ACTION = "(case {0} when 0 then 'allow' when 1 then 'warn' when 2 then 'tokenize' when 3 then 'mask' when 4 then 'block' end)"


def rank(expr: str) -> str:
    return RANK.format(expr)


def action(expr: str) -> str:
    return ACTION.format(expr)
