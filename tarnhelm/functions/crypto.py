"""Keyed hashes, tokens and chain hashes composed from built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarnhelm.functions.text import bind, strip_space

_BLOCK = 64
_ALPHABET = "abcdefghijklmnopqrstuvwxyz234567"

# Classes whose token has the shape of the original upstream.
SHAPE_PRESERVING = (
    "PAN", "AADHAAR", "CREDIT_CARD", "PHONE", "DATE_OF_BIRTH", "IFSC", "GSTIN", "IBAN",
)


def _pads(key: bytes) -> tuple[bytes, bytes]:
    import hashlib

    if len(key) > _BLOCK:
        key = hashlib.sha256(key).digest()
    key = key.ljust(_BLOCK, b"\0")
    return bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)


def hmac_hex(key: bytes, message: Column) -> Column:
    """HMAC-SHA256 as lower-case hex: two nested hashes with the padded key in front."""
    inner_pad, outer_pad = _pads(key)
    body = F.encode(message, "UTF-8")
    inner = F.sha2(F.concat(F.lit(bytearray(inner_pad)), body), 256)
    return F.sha2(F.concat(F.lit(bytearray(outer_pad)), F.unhex(inner)), 256)


#: Base32 characters of a digest that a token can have.
LONGEST_TOKEN = 48


def base32_prefix(mac_hex: Column, width: Column | int) -> Column:
    """First ``width`` (1 to LONGEST_TOKEN) base32 characters of a hex digest, lower case."""
    longest = width if isinstance(width, int) else LONGEST_TOKEN

    def spell(bits: Column, n: int) -> Column:
        return F.concat(
            *[
                F.substring(
                    F.lit(_ALPHABET),
                    (F.shiftright(bits, 55 - 5 * i).bitwiseAND(F.lit(31)) + 1).cast("int"),
                    F.lit(1),
                )
                for i in range(n)
            ]
        )

    def block(k: int) -> Column:
        # Twelve characters are 60 bits, that is 15 hexadecimal digits.
        digits = F.conv(F.substring(mac_hex, 1 + 15 * k, 15), 16, 10).cast("bigint")
        return bind(digits, lambda bits: spell(bits, min(12, longest - 12 * k)))

    full = F.concat(*[block(k) for k in range(-(-longest // 12))])
    return full if isinstance(width, int) else F.substring(full, F.lit(1), width)


def text_key(key: bytes, tenant: Column, pack_version: Column | int, text: Column) -> Column:
    """Content address of a text for one tenant and one detector pack version."""
    version = F.lit(pack_version) if isinstance(pack_version, int) else pack_version
    return hmac_hex(key, F.concat_ws("|", version.cast("string"), tenant, text))


def normalise(entity_class: Column, value: Column) -> Column:
    """Spelling that two mentions of one value share, per class."""
    v = strip_space(value)
    return (
        F.when(entity_class.isin("EMAIL", "UPI_VPA"), F.lower(v))
        .when(
            entity_class.isin("PAN", "IFSC", "GSTIN", "IBAN"),
            F.regexp_replace(F.upper(v), "[ -]", ""),
        )
        .when(
            entity_class.isin("AADHAAR", "CREDIT_CARD", "PHONE"),
            F.regexp_replace(v, r"[^\p{Nd}]", ""),
        )
        .when(
            entity_class.isin("PERSON", "ORG", "GPE"),
            F.regexp_replace(F.lower(v), r"\s+", " "),
        )
        .otherwise(v)
    )


def derive_token(
    key: bytes,
    scope: Column,
    entity_class: Column,
    value: Column,
    never_tokenize: Column,
    width: Column | int = 3,
) -> Column:
    """Stable replacement token; null for classes that must never be tokenised."""
    message = F.concat_ws("|", scope, entity_class, normalise(entity_class, value))
    suffix = base32_prefix(hmac_hex(key, message), width)
    token = F.when(
        entity_class == "EMAIL", F.concat(F.lit("⟨EMAIL_"), suffix, F.lit("⟩@example.invalid"))
    ).otherwise(F.concat(F.lit("⟨"), entity_class, F.lit("_"), suffix, F.lit("⟩")))
    return F.when(~never_tokenize, token)


def genesis(tenant: Column, suffix: str) -> Column:
    """Hash that precedes the first record of a tenant's chain, as hex."""
    return F.sha2(F.concat(tenant, F.lit(suffix)), 256)


def link_hash(prev_hex: Column, record: Column) -> Column:
    """sha256(previous hash bytes followed by the canonical record), as hex."""
    return F.sha2(F.concat(F.unhex(prev_hex), F.encode(record, "UTF-8")), 256)
