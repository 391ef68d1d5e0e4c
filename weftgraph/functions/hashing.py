"""Integer mixing with 32- and 64-bit wrap-around, for seeds that must agree between runs and engines.

Spark has no unsigned arithmetic, so the functions are Arrow-batched numpy.  The mixers are
the well-known six-round integer mix, its 64-bit form, and a multiply-and-shift generator step.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

#: (constant, how it joins the value, how the shifted value joins, shift: left positive, right negative)
ROUNDS32 = [(0x7ED55D16, "+", "+", 12), (0xC761C23C, "^", "^", -19), (0x165667B1, "+", "+", 5), (0xD3A2646C, "+", "^", 9), (0xFD7046C5, "+", "+", 3), (0xB55A4F09, "^", "^", -16)]
ROUNDS64 = [(0x7ED55D166BEF7A1D, "+", "+", 12), (0xC761C23C510FA2DD, "^", "^", -9), (0x165667B183A9C0E1, "+", "+", 59), (0xD3A2646CAB3487E3, "+", "^", 49), (0xFD7046C5EF9AB54C, "+", "+", 3), (0xB55A4F090DD4A67B, "^", "^", -32)]


def _rounds(x: np.ndarray, table: list, kind) -> np.ndarray:
    join = {"+": np.add, "^": np.bitwise_xor}
    for constant, first, second, shift in table:
        moved = x << kind(shift) if shift > 0 else x >> kind(-shift)
        x = join[second](join[first](x, kind(constant)), moved)
    return x


def mix32(x) -> np.ndarray:
    return _rounds(np.atleast_1d(np.asarray(x)).astype(np.uint32), ROUNDS32, np.uint32)


def mix64(x) -> np.ndarray:
    return _rounds(np.atleast_1d(np.asarray(x)).astype(np.uint64), ROUNDS64, np.uint64)


def step64(x) -> np.ndarray:
    """One step of a combined multiply, add and shift generator."""
    u = np.uint64
    v = np.atleast_1d(np.asarray(x)).astype(u) * u(3935559000370003845) + u(2691343689449507681)
    for shift in (-21, 37, -4, None, 20, -41, 5):
        v = v * u(4768777513237032717) if shift is None else v ^ (v << u(shift) if shift > 0 else v >> u(-shift))
    return v


@F.pandas_udf(LongType())
def hash32(x: pd.Series) -> pd.Series:
    """The 32-bit mix of the low 32 bits, as a non-negative long."""
    return pd.Series(mix32(x.to_numpy()).astype(np.int64))


@F.pandas_udf(LongType())
def hash64(x: pd.Series) -> pd.Series:
    """The 64-bit mix, as the signed long of the same bits."""
    return pd.Series(mix64(x.to_numpy()).astype(np.int64))


@F.pandas_udf(LongType())
def next64(x: pd.Series) -> pd.Series:
    return pd.Series(step64(x.to_numpy()).astype(np.int64))


def hash32_mod(column, modulus: int):
    """The 32-bit mix modulo a number."""
    return F.pmod(hash32(column), F.lit(modulus))


def hash64_mod(column, modulus: int):
    """The unsigned 64-bit mix modulo a number."""

    @F.pandas_udf(LongType())
    def of(x: pd.Series) -> pd.Series:
        return pd.Series((mix64(x.to_numpy()) % np.uint64(modulus)).astype(np.int64))

    return of(column)
