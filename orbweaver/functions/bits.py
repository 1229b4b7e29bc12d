"""Places of vertices in sparse bit vectors: elements of WIDTH targets, in words of 32 bits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Targets of an element, bits of a word.
WIDTH, WORD = 192, 32


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def base_of(vertex: Column | str) -> Column:
    """Number of the element that holds the vertex."""
    return F.floor(_column(vertex) / WIDTH).cast("long")


def unit_of(vertex: Column | str) -> Column:
    """Number of the word within the element."""
    return F.floor(_column(vertex) % WIDTH / WORD).cast("int")


def bit_of(vertex: Column | str) -> Column:
    """Number of the bit within the word."""
    return (_column(vertex) % WORD).cast("int")


def vertex_of(base: Column | str, unit: Column | str, bit: Column | str) -> Column:
    """The vertex of an element, word and bit."""
    return (_column(base) * WIDTH + _column(unit) * WORD + _column(bit)).cast("long")


def bits_set(word: Column | str) -> Column:
    """How many bits of a word are 1."""
    return F.bit_count(_column(word))


def first_bit(word: Column | str) -> Column:
    """Number of the lowest bit that is 1, from 1; 0 if none is."""
    low = _column(word).bitwiseAND(-_column(word))
    return F.when(_column(word) == 0, 0).otherwise(F.length(F.bin(low))).cast("int")


def round_up(value: Column | str, multiple: int) -> Column:
    """The next multiple that is not smaller."""
    return (F.ceil(_column(value) / multiple) * multiple).cast("long")
