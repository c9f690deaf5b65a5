"""The 32-bit generator behind all seeded operators; its numbers must match other implementations bit for bit."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values of the generator: its increment and odd multipliers
INCREMENT, MASK = 0x6D2B79F5, 0xFFFFFFFF


def number(state: int) -> float:
    """The number in [0, 1) that belongs to a state."""
    a = ((state ^ state >> 15) * (state | 1)) & MASK
    b = ((a ^ a >> 7) * (a | 61)) & MASK
    c = (a + b & MASK) ^ a
    return (c ^ c >> 14) / 2**32


def numbers(seed: int) -> Callable[[], float]:
    """A source of numbers: the k-th belongs to the state seed + k * INCREMENT."""
    state = seed & MASK

    def draw() -> float:
        nonlocal state
        state = state + INCREMENT & MASK
        return number(state)

    return draw


def _times(a: Column, b: Column) -> Column:
    """The low 32 bits of a product of two 32-bit numbers, without leaving 64 bits."""
    high = F.shiftright(a, 16) * b
    return (F.shiftleft(high.bitwiseAND(F.lit(0xFFFF)), 16) + a.bitwiseAND(F.lit(0xFFFF)) * b).bitwiseAND(F.lit(MASK))


def nth_number(seed: int, k: Column) -> Column:
    """The k-th number (from 1) as a column expression: draws are independent, so rows need no order."""
    state = (F.lit(seed & MASK) + _times(k.cast("long").bitwiseAND(F.lit(MASK)), F.lit(INCREMENT))).bitwiseAND(F.lit(MASK))
    a = _times(state.bitwiseXOR(F.shiftright(state, 15)), state.bitwiseOR(F.lit(1)))
    b = _times(a.bitwiseXOR(F.shiftright(a, 7)), a.bitwiseOR(F.lit(61)))
    c = (a + b).bitwiseAND(F.lit(MASK)).bitwiseXOR(a)
    return c.bitwiseXOR(F.shiftright(c, 14)) / F.lit(2.0**32)
