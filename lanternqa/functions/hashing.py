"""Text keys, and integer key mixing that any SQL engine can repeat."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the mix: a 32-bit xor-shift-multiply hash.
MASK = 0xFFFFFFFF
MULTIPLIER = 0x45D9F3B


def text_key(column: str) -> Column:
    """A 16-byte key for a text; null for null."""
    return F.unhex(F.md5(column))


def mix(key: Column, seed: int = 0) -> Column:
    """Spread an integer key evenly over 0 .. 2^32-1, alike on every run."""
    x = key.cast("long").bitwiseXOR(F.lit(seed).cast("long"))
    x = x.bitwiseXOR(F.shiftrightunsigned(x, 32)).bitwiseAND(F.lit(MASK))
    for _ in range(2):
        x = (x.bitwiseXOR(F.shiftright(x, 16)) * F.lit(MULTIPLIER)).bitwiseAND(F.lit(MASK))
    return x.bitwiseXOR(F.shiftright(x, 16))


def mix_sql(key: str, seed: int = 0) -> str:
    """The same mix as SQL text, for keys from 0 to 2^32-1."""
    x = f"xor(CAST({key} AS BIGINT), {seed})"
    for _ in range(2):
        x = f"((xor({x}, ({x}) >> 16) * {MULTIPLIER}) & {MASK})"
    return f"xor({x}, ({x}) >> 16)"
