"""Column functions with the null, white-space and rounding rules the operators need."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: All characters that Unicode or Python calls white space.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: A run of them, as a pattern.
SPACES = f"[{WHITE}]+"


def strip(text: Column) -> Column:
    """Without white space at either end (any Unicode white space)."""
    return F.btrim(text, F.lit(WHITE))


def falsy(text: Column) -> Column:
    """True for null and empty strings."""
    return F.coalesce(text, F.lit("")) == ""


def first_chars(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def shown(value: Column) -> Column:
    """A value as it reads in a sentence: null is ``None``."""
    return F.coalesce(value.cast("string"), F.lit("None"))
