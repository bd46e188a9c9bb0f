"""Seeded uniform draws by integer arithmetic, the same on any SQL engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the draw (FIXTURES.md): prime modulus 2147483647; multipliers 48271 and 40014 for the key's
# low and high part, 69621 and 7919 for the seed and the start; rounds: xor with itself shifted right by 15, 13, 16,
# and between them multiplication by 1664525 and 22695477 modulo the prime.
_P = 2147483647


def mixed(key: Column, seed: int = 0) -> Column:
    """A 31-bit hash of (key >= 0, seed): multiply, fold the high bits down, three times."""
    low, high = F.pmod(key, F.lit(_P)), F.floor(key / F.lit(_P)).cast("long")
    x = F.pmod(low * 48271 + F.pmod(high, F.lit(_P)) * 40014 + F.lit((seed % _P) * 69621 + 7919), F.lit(_P))
    x = x.bitwiseXOR(F.shiftright(x, 15))
    x = F.pmod(x * 1664525, F.lit(_P))
    x = x.bitwiseXOR(F.shiftright(x, 13))
    x = F.pmod(x * 22695477, F.lit(_P))
    return x.bitwiseXOR(F.shiftright(x, 16))


def uniform_int(key: Column, n: int | Column, seed: int = 0) -> Column:
    """A draw from 0 .. n-1 by the hash's high bits."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.shiftright(mixed(key.cast("long"), seed) * n.cast("long"), 31).cast("int")
