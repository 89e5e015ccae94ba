"""Column-level text helpers (all JVM-side built-ins, no Python UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.split() treats as whitespace,
# written as a regex class both Java and RE2 accept.
WHITESPACE_CLASS = (
    r"[\t\n\x{0b}\f\r \x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
)


def chunk_starts(text: Column, size: int, overlap: int) -> Column:
    """0-based start offsets of overlapping character windows (empty text -> empty array).

    Windows start every ``size - overlap`` characters while the start is inside
    the text, so the tail is always emitted, even when it lies wholly inside
    the previous window's overlap.
    """
    if size <= 0:
        raise ValueError("chunk size must be positive")
    if overlap < 0 or overlap >= size:
        raise ValueError("overlap must be in [0, size)")
    step = size - overlap
    n = F.length(text)
    return F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))


def occurrences(text: Column, literal: str) -> Column:
    """Non-overlapping occurrences of a literal substring (like ``str.count``)."""
    if not literal:
        raise ValueError("empty literal")
    return ((F.length(text) - F.length(F.replace(text, F.lit(literal), F.lit("")))) / len(literal)).cast("int")


# The same whitespace set split in two: characters Java's \s does not cover are
# first mapped to a space with translate (a per-character table), which is
# several times faster than a regex class holding them.
_EXTRA_WHITESPACE = "".join(
    chr(c) for c in [*range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
)


def words(text: Column) -> Column:
    """Distinct lower-cased whitespace-separated words (no empty tokens), with
    the whitespace set of Python's ``str.split()``."""
    lo = F.lower(text)
    # texts of ASCII characters without the four separators among them need no table
    ascii_only = F.octet_length(lo) == F.char_length(lo)
    for c in _EXTRA_WHITESPACE[:4]:
        ascii_only = ascii_only & ~lo.contains(c)
    plain = F.when(ascii_only, lo).otherwise(F.translate(lo, _EXTRA_WHITESPACE, " " * len(_EXTRA_WHITESPACE)))
    toks = F.split(plain, r"\s+")
    return F.array_distinct(F.filter(toks, lambda t: t != ""))


def slug(text: Column, width: int = 40) -> Column:
    """Lower-case, spaces and slashes to dashes, cut to ``width`` characters."""
    return F.substring(F.regexp_replace(F.lower(text), "[ /]", "-"), 1, width)
