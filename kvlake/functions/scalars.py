"""Byte-string and bit functions as columns. Text counts as its bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = 1 << 32


def codes(text: Column) -> Column:
    """The byte values of a string or byte string, as an array of longs."""
    raw = F.hex(text)
    at = F.when(F.length(raw) > 0, F.sequence(F.lit(1), F.length(raw), F.lit(2))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.conv(F.substring(raw, i, F.lit(2)), 16, 10).cast("long"))


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1 by unsigned bytes, the shorter first."""
    return F.when(a < b, -1).when(a > b, 1).otherwise(0)


def _byte(raw: Column, at: Column) -> Column:
    """The byte at a place (from 0) of a byte string in hexadecimal, as two digits."""
    return F.substring(raw, at * 2 + 1, F.lit(2))


def _first(count: Column, test) -> Column:
    """The first place below count that passes the test, or null."""
    places = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    return F.try_element_at(F.filter(places, test), F.lit(1))


def _raised(raw: Column, at: Column) -> Column:
    """The byte string up to a place, whose byte is raised by one."""
    return F.unhex(F.concat(F.substring(raw, F.lit(1), at * 2), F.lpad(F.hex(F.conv(_byte(raw, at), 16, 10).cast("long") + 1), 2, "0")))


def shortest_separator(start: Column, limit: Column) -> Column:
    """A short byte string from start on and before limit: the byte where they part is raised if that leaves it below limit's."""
    a, b = F.hex(start), F.hex(limit)
    size = F.least(F.length(a), F.length(b)) / 2
    p = _first(size.cast("int"), lambda i: _byte(a, i) != _byte(b, i))
    mine, theirs = F.conv(_byte(a, p), 16, 10).cast("int"), F.conv(_byte(b, p), 16, 10).cast("int")
    return F.when(p.isNotNull() & (mine < 255) & (mine + 1 < theirs), _raised(a, p)).otherwise(start.cast("binary"))


def short_successor(key: Column) -> Column:
    """A short byte string after the key: its first byte below 0xFF raised, the rest cut; a run of 0xFF stays."""
    raw = F.hex(key)
    p = _first((F.length(raw) / 2).cast("int"), lambda i: _byte(raw, i) != "FF")
    return F.when(p.isNotNull(), _raised(raw, p)).otherwise(key.cast("binary"))


def tag(version: Column, flag: Column) -> Column:
    return F.shiftleft(version.cast("long"), 8).bitwiseOR(flag.cast("long"))


def tag_version(packed: Column) -> Column:
    return F.shiftrightunsigned(packed, 8)


def tag_flag(packed: Column) -> Column:
    return packed.bitwiseAND(255)


def varint_size(n: Column) -> Column:
    """Bytes of a varint of seven bits a byte."""
    return F.greatest(F.lit(1), F.ceil(F.length(F.bin(n)) / 7)).cast("int")


def varint_encode(n: Column) -> Column:
    """A number from 0 on as bytes of seven bits, the highest first; all but the last have the top bit set."""
    groups = F.sequence(varint_size(n) - 1, F.lit(0), F.lit(-1))
    digit = lambda i: F.call_function("shiftrightunsigned", n.cast("long"), i * 7).bitwiseAND(127).bitwiseOR(F.when(i > 0, 128).otherwise(0))
    return F.unhex(F.array_join(F.transform(groups, lambda i: F.lpad(F.hex(digit(i)), 2, "0")), ""))


def varint_decode(raw: Column) -> Column:
    """The number that the bytes of a varint say."""
    return F.aggregate(codes(raw), F.lit(0).cast("long"), lambda n, b: n * 128 + b.bitwiseAND(127))


def popcount(n: Column) -> Column:
    return F.bit_count(n)


def leading_zeros(n: Column, width: int = 32) -> Column:
    return F.when(n == 0, width).otherwise(width - F.length(F.bin(n)))


def trailing_zeros(n: Column, width: int = 32) -> Column:
    return F.when(n == 0, width).otherwise(F.bit_count(n.bitwiseAND(-n) - 1))


def first_zero(n: Column, width: int = 32) -> Column:
    return trailing_zeros(F.lit((1 << width) - 1).cast("long") - n, width)


def align_up(n: Column, bound: int) -> Column:
    return F.ceil(n / bound) * bound
