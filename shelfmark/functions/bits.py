"""Bitmaps of whole numbers, 32,768 to a bucket, as Spark's bitmap functions build them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_set(bitmap: Column, position: Column) -> Column:
    """Whether the bit at ``position`` of a bucket's bitmap is set; false for no bitmap."""
    byte = F.substr(bitmap, (F.floor(position / 8) + 1).cast("int"), F.lit(1))
    bit = F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), (position % 8).cast("int"))
    return bitmap.isNotNull() & (bit == 1)


def bit_words(bitmap: Column) -> Column:
    """A bucket's bitmap as an array of whole numbers of 32 bits, for :func:`is_set_in`.

    Made once per bitmap, where many positions are looked up: a row of an array
    is read in place, while reading a byte of a binary copies the whole of it.
    """
    # A bitmap may end within a word; what is missing are zeros.
    found = F.regexp_extract_all(F.hex(bitmap), F.lit("(.{1,8})"), F.lit(1))
    return F.transform(found, lambda word: F.conv(F.rpad(word, 8, "0"), 16, 10).cast("bigint"))


def is_set_in(words: Column, position: Column) -> Column:
    """:func:`is_set` of a bitmap given by its :func:`bit_words`."""
    at = F.floor(position / 8)
    bit = F.getbit(F.get(words, F.floor(at / 4).cast("int")), (8 * (3 - at % 4) + position % 8).cast("int"))
    return F.coalesce(bit == 1, F.lit(False))
