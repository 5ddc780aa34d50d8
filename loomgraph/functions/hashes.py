"""A keyed digest and a small string hash, by built-in functions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLOCK = 64


def pads(key: bytes) -> dict[str, str]:
    """The key's inner and outer pad in hex, as HMAC over blocks of 64 bytes has them."""
    k = (hashlib.sha256(key).digest() if len(key) > _BLOCK else key).ljust(_BLOCK, b"\0")
    return {"inner": bytes(b ^ 0x36 for b in k).hex(), "outer": bytes(b ^ 0x5C for b in k).hex()}


def hmac_sha256(text: Column, key: bytes) -> Column:
    """Lower-case hex of the HMAC-SHA256 of a text's bytes; null for null."""
    p = pads(key)
    inner = F.sha2(F.concat(F.unhex(F.lit(p["inner"])), F.encode(text, "UTF-8")), 256)
    return F.sha2(F.concat(F.unhex(F.lit(p["outer"])), F.unhex(inner)), 256)


def hash31(text: Column) -> Column:
    """h = 31 h + code over the characters, modulo 2**32, from 0."""
    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0).cast("bigint"), lambda h, c: F.pmod(h * 31 + F.ascii(c), F.lit(1 << 32)))
