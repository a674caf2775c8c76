"""Column expressions for text: trimming, word lists and number parsing.

All of them are built-in Spark expressions, so they stay inside whole-stage
code generation or, for array functions, at least inside the JVM.
"""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 29 Unicode white-space characters a Python `str.strip` removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# All decimal digits of Unicode, and the ASCII digit of each.
_DIGITS = [chr(i) for i in range(sys.maxunicode + 1) if unicodedata.decimal(chr(i), -1) >= 0]
_ASCII = "".join(str(unicodedata.decimal(digit)) for digit in _DIGITS)

# What a Python `float()` accepts after trimming, with ASCII digits and without the underscores
# between them. Possessive, so that a long run of digits is read once and never given back.
FLOAT_PATTERN = (
    r"(?i)\A[+-]?+(?:(?:[0-9]++(?:\.[0-9]*+)?+|\.[0-9]++)(?:e[+-]?+[0-9]++)?+|inf(?:inity)?+|nan)\z"
)


def strip(text: Column) -> Column:
    """Remove Unicode white space at both ends."""
    return F.btrim(text, F.lit(WHITESPACE))


def words(text: Column) -> Column:
    """Split on runs of Unicode white space; the empty string has no words.

    Mapping every white-space character to a blank first lets `split` take its
    single-character path instead of running a regular expression.
    """
    spaced = F.translate(text, WHITESPACE, " " * len(WHITESPACE))
    return F.array_remove(F.split(spaced, " "), "")


def items(text: Column, delimiter: str) -> Column:
    """Distinct, trimmed, non-empty parts of `text` between literal delimiters."""
    if not delimiter:
        raise ValueError("delimiter must not be empty")
    # `split` takes a regular expression; a plain single character is its fast path.
    plain = len(delimiter) == 1 and (delimiter.isspace() or delimiter in ",;:/-_")
    pattern = delimiter if plain else r"\Q" + delimiter.replace(r"\E", r"\E\\E\Q") + r"\E"
    parts = F.transform(F.split(text, pattern), strip)
    return F.array_distinct(F.array_remove(parts, ""))


def to_number(stripped: Column) -> Column:
    """Double for trimmed text a Python `float()` would accept, else NULL.

    A signed `nan` is NULL, too; like NaN it equals nothing.
    """
    # Digits beyond ASCII, and underscores, are looked for where there are any: a long text
    # that is no number is read once.
    ascii_only = F.octet_length(stripped) == F.char_length(stripped)
    digits = F.when(ascii_only, stripped).otherwise(F.translate(stripped, "".join(_DIGITS), _ASCII))
    joined = F.regexp_replace(digits, "(?<=[0-9])_(?=[0-9])", "")
    plain = F.when(F.contains(digits, F.lit("_")), joined).otherwise(digits)
    return F.when(plain.rlike(FLOAT_PATTERN), plain.try_cast("double"))
