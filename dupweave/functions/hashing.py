"""A 32-bit token hash in Spark's own expressions (products stay below 2^63), for cross-checks with SQL engines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MASK = 0xFFFFFFFF
# Offset and prime of FNV-1a, multipliers of the 32-bit murmur finalizer.
OFFSET, PRIME = 0x811C9DC5, 0x01000193
MULTIPLIERS = (0x85EBCA6B, 0xC2B2AE35)


def times(a: Column, b: int) -> Column:
    """a * b modulo 2^32."""
    low, high = a * F.lit(b & 0xFFFF), (a * F.lit(b >> 16)).bitwiseAND(0xFFFF)
    return (low + high * 65536).bitwiseAND(MASK)


def finalized(h: Column) -> Column:
    h = h.bitwiseXOR(F.shiftrightunsigned(h, 16))
    h = times(h, MULTIPLIERS[0])
    h = h.bitwiseXOR(F.shiftrightunsigned(h, 13))
    h = times(h, MULTIPLIERS[1])
    return h.bitwiseXOR(F.shiftrightunsigned(h, 16))


def token_hash(kind: Column, text: Column) -> Column:
    """FNV-1a over the kind, a mark and the text's characters, finalized; 0 becomes 1."""
    codes = F.concat(F.transform(F.split(kind, ""), lambda c: F.ascii(c)), F.array(F.lit(255)), F.transform(F.split(text, ""), lambda c: F.ascii(c)))
    h = F.aggregate(codes, F.lit(OFFSET).cast("long"), lambda h, c: times(h.bitwiseXOR(c.cast("long")), PRIME))
    h = F.transform(F.array(h), finalized)[0]
    return F.when(h == 0, F.lit(1).cast("long")).otherwise(h)
