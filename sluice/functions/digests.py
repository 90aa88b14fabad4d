"""SHA-256 references and HMAC seals as plain column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 64


def pads(key: bytes) -> tuple[str, str]:
    """Hex of the inner and outer HMAC pads of a key of at most one block."""
    padded = key.ljust(BLOCK, b"\0")
    return bytes(b ^ 0x36 for b in padded).hex(), bytes(b ^ 0x5C for b in padded).hex()


def hmac_sha256(message: Column, key: bytes) -> Column:
    inner, outer = pads(key)
    first = F.sha2(F.concat(F.unhex(F.lit(inner)), F.encode(message, "utf-8")), 256)
    return F.sha2(F.concat(F.unhex(F.lit(outer)), F.unhex(first)), 256)


def sequence_number(seed: str, digits: int, *parts: Column) -> Column:
    """First 8 digest bytes of ``seed|part|...`` as an unsigned number of ``digits`` digits."""
    text = F.concat_ws("|", F.lit(seed), *parts)
    number = F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("decimal(20,0)")
    return F.lpad((number % F.lit(10**digits).cast("decimal(20,0)")).cast("decimal(20,0)").cast("string"), digits, "0")
