"""QR-like matrices and barcodes as Column expressions, in the plain form that has no error correction.

They are not scannable: the matrix holds finder and timing patterns and raw bits only, and Code 128 has own patterns for
three characters. decode() therefore gives null with an error, as engines of this kind do.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let

#: The bars of Code 128.
START, STOP = "110100100010", "1100011101011"
PATTERNS = {"0": "11011001100", "1": "11001101100", "A": "10100110010"}
OTHER = "10101001100"


def qr_size(text: Column) -> Column:
    n = F.length(F.encode(text, "UTF-8"))
    return (21 + (F.greatest(F.lit(1), F.least(F.lit(40), F.floor(n / 10))) - 1) * 4).cast("int")


def qr_matrix(text: Column) -> Column:
    """The modules row by row, 1 dark: bits fill columns in pairs from column 8 on, over finder and timing patterns."""
    bits = F.transform(F.split(F.hex(F.encode(text, "UTF-8")), ""), lambda h: F.lpad(F.conv(h, 16, 2), 4, "0"))
    known = F.struct(qr_size(text).alias("size"), F.array_join(bits, "").alias("bits"))
    return let(known, lambda k: _modules(k["size"], k["bits"]))


def _modules(size: Column, bits: Column) -> Column:
    def finder(x: Column, y: Column) -> Column:
        inside = (x >= 0) & (x <= 6) & (y >= 0) & (y <= 6)
        dark = (x == 0) | (x == 6) | (y == 0) | (y == 6) | ((x >= 2) & (x <= 4) & (y >= 2) & (y <= 4))
        return F.when(inside, dark.cast("int"))

    def module(i: Column) -> Column:
        x, y = i % size, F.floor(i / size).cast("int")
        rows = size - 16
        column = F.floor((x - 8) / 2).cast("int")
        pairs = F.floor((size - 2 - 8) / 2).cast("int") + 1
        place = column * 2 * rows + (y - 8) * 2 + (x - 8) % 2
        data = F.when((x >= 8) & (y >= 8) & (y < size - 8) & (column < pairs), F.nullif(F.substr(bits, place + 1, F.lit(1)), F.lit("")).cast("int"))
        timing = F.when((x == 6) & (y >= 8) & (y < size - 8), (y % 2 == 0).cast("int")).when((y == 6) & (x >= 8) & (x < size - 8), (x % 2 == 0).cast("int"))
        return F.coalesce(data, timing, finder(x, y), finder(x - size + 7, y), finder(x, y - size + 7), F.lit(0))

    return F.transform(F.sequence(F.lit(0), size * size - 1), module)


def code128(text: Column) -> Column:
    """The bars as a string of 0 and 1."""
    table = F.create_map(*(F.lit(v) for pair in PATTERNS.items() for v in pair))
    chars = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.coalesce(table[c], F.lit(OTHER)))
    return F.concat(F.lit(START), F.array_join(chars, ""), F.lit(STOP))


def decode(content: Column) -> Column:
    return F.struct(F.lit(None).cast("string").alias("text"), F.lit("not_found").alias("error"))
