"""The classic string hashes RS, JS, PJW, ELF, BKDR, DJB and AP, as folds over bytes, 31 bits each.

Products are taken in wide decimals and cut to 32 bits at each step, as integer
overflow is an error in Spark.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kvlake.functions.scalars import WORD, codes

POSITIVE = 0x7FFFFFFF


def _fold(text: Column, start: int, step) -> Column:
    return F.aggregate(codes(text), F.lit(start).cast("long"), step).bitwiseAND(POSITIVE)


def _times(a: Column, b: Column) -> Column:
    wide = a.cast("decimal(19,0)") * b.cast("decimal(19,0)")
    return (wide % F.lit(WORD).cast("decimal(19,0)")).cast("long")


def bkdr(text: Column) -> Column:
    return _fold(text, 0, lambda h, c: (h * 131 + c) % WORD)


def djb(text: Column) -> Column:
    return _fold(text, 5381, lambda h, c: (h * 33 + c) % WORD)


def js(text: Column) -> Column:
    return _fold(text, 1315423911, lambda h, c: h.bitwiseXOR((h * 32 + c + F.shiftright(h, 2)) % WORD))


def rs(text: Column) -> Column:
    start = F.struct(F.lit(0).cast("long").alias("h"), F.lit(63689).cast("long").alias("a"))
    step = lambda s, c: F.struct(((_times(s["h"], s["a"]) + c) % WORD).alias("h"), _times(s["a"], F.lit(378551)).alias("a"))
    return F.aggregate(codes(text), start, step)["h"].bitwiseAND(POSITIVE)


def _elf_step(h: Column, c: Column) -> Column:
    t = (h * 16 + c) % WORD
    high = t.bitwiseAND(0xF0000000)
    return t.bitwiseXOR(F.shiftright(high, 24)).bitwiseAND((WORD - 1) - high)


def elf(text: Column) -> Column:
    return _fold(text, 0, _elf_step)


def pjw(text: Column) -> Column:
    """The same fold as ELF: for 32-bit words the two differ in writing only."""
    return _fold(text, 0, _elf_step)


def ap(text: Column) -> Column:
    start = F.struct(F.lit(0).cast("long").alias("h"), F.lit(0).cast("long").alias("i"))

    def step(s, c):
        h = s["h"]
        even = ((h * 128) % WORD).bitwiseXOR(c).bitwiseXOR(F.shiftright(h, 3))
        odd = F.lit(WORD - 1).cast("long") - ((h * 2048) % WORD).bitwiseXOR(c).bitwiseXOR(F.shiftright(h, 5))
        return F.struct(h.bitwiseXOR(F.when(s["i"] % 2 == 0, even).otherwise(odd)).alias("h"), (s["i"] + 1).alias("i"))

    return F.aggregate(codes(text), start, step)["h"].bitwiseAND(POSITIVE)


HASHES = {"js": js, "bkdr": bkdr, "elf": elf, "ap": ap, "rs": rs}
