"""Deterministic sha-256 arithmetic as column expressions.

The digest is read as one big integer. Because 2^64 = 1 modulo 2^64 - 1 (and
likewise for 32 bits) the remainder is the remainder of the sum of its limbs,
which fits in a decimal.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_64 = 2**64 - 1
MAX_32 = 2**32 - 1


def _limb_sum(digest: Column, digits: int) -> Column:
    total = None
    for start in range(1, 65, digits):
        limb = F.conv(F.substring(digest, start, digits), 16, 10).cast("decimal(20,0)")
        total = limb if total is None else total + limb
    return total


def fingerprint64(c: Column) -> Column:
    """sha-256 of the text modulo 2^64 - 1, as decimal(20,0)."""
    total = _limb_sum(F.sha2(c, 256), 16).cast("decimal(22,0)")
    return (total % F.lit(str(MAX_64)).cast("decimal(22,0)")).cast("decimal(20,0)")


def fingerprint32(c: Column) -> Column:
    """sha-256 of the text modulo 2^32 - 1, as bigint."""
    digest = F.sha2(c, 256)
    total = None
    for start in range(1, 65, 8):
        limb = F.conv(F.substring(digest, start, 8), 16, 10).cast("bigint")
        total = limb if total is None else total + limb
    return total % F.lit(MAX_32)


def hash_bucket(c: Column, dimension: int = 2048) -> Column:
    """sha-256 of the text modulo a power of two up to 2^28, as int."""
    if dimension & (dimension - 1) or dimension > 1 << 28:
        raise ValueError("dimension must be a power of two of at most 2^28")
    low = F.conv(F.substring(F.sha2(c, 256), 58, 7), 16, 10).cast("int")
    return low.bitwiseAND(dimension - 1)


def fingerprint_hex(c: Column) -> Column:
    """fingerprint64 as unpadded upper-case hexadecimal text."""
    return F.upper(F.conv(fingerprint64(c).cast("string"), 10, 16))


def hash_uniform(c: Column) -> Column:
    """A number in [0, 1) that depends on the text only."""
    return fingerprint64(c).cast("double") / F.lit(float(MAX_64))


def draw(seed: str | int, *parts: Column) -> Column:
    """A cheap seeded uniform number in [0, 1) for sampling, from xxhash64."""
    h = F.xxhash64(F.lit(str(seed)), *parts)
    return F.pmod(h, F.lit(1 << 53)).cast("double") / F.lit(float(1 << 53))


def seeded(seed: str | int, *parts: Column) -> Column:
    """The seed and the parts as one text, to be hashed where a draw must be repeatable outside Spark."""
    return F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts])
