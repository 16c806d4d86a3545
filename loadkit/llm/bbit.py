"""Likeness of packed low-bit signatures by bit counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def agreement(x: str, y: str, values: int, bits: int) -> Column:
    """Similarity estimated from two columns of packed signatures (array<long>).

    Each holds ``values`` groups of ``bits`` bits.  The share of equal groups
    is corrected for groups equal by chance, 2**-bits; it can fall below 0.
    """
    low = F.lit(int("1".rjust(bits, "0") * (64 // bits), 2))
    differ = F.lit(0)
    for j in range(values * bits // 64):
        z = F.col(x)[j].bitwiseXOR(F.col(y)[j])
        folded = z
        for shift in range(1, bits):
            folded = folded.bitwiseOR(F.shiftrightunsigned(z, shift))
        differ = differ + F.bit_count(folded.bitwiseAND(low))
    chance = 2.0 ** -bits
    return (1 - differ / F.lit(float(values)) - chance) / (1 - chance)
