"""Sets of whole numbers as 64-bit masks: word n holds the numbers from 64 n on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def word(number: Column) -> Column:
    return F.shiftright(number, 6)


def bit(number: Column) -> Column:
    """The mask of one number within its word."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), number.bitwiseAND(F.lit(63)).cast("int"))


def members(word: Column, mask: Column) -> Column:
    """The numbers of a mask, ascending."""
    on = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda b: F.getbit(mask, b) == 1)
    return F.transform(on, lambda b: word * 64 + b)
