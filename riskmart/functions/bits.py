"""Exact sets of whole-number keys as words of bits, which merge by ``bit_or``.

Sixty-four neighbouring keys share one word, so surrogate keys, which are dense, shuffle as
a sixty-fourth of their distinct number; keys far apart cost a word each, as much as they
would one by one. (Bitmaps of a fixed 4 kB would cost that much for each of those.)
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def key_word(key: Column) -> Column:
    """The number of the word a key belongs to; NULL for no key."""
    return F.shiftright(key.cast("long"), 6)


def key_bits(key: Column) -> Column:
    """Aggregate: the bits of the keys of one word; NULL if there is none."""
    return F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), key.cast("long").bitwiseAND(F.lit(63)).cast("int")))
