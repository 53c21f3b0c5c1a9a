"""Extents: pages packed into one value.

Layout, little-endian: 64 bytes of header, one bit for each page slot (the lowest bit first), then the
pages that are there, in order. Parts of an extent are read by expressions; a check of all its bytes is an Arrow function.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from treelake.functions.scalars import fnv1a64, fnv1a64_of

# Fixed values of the format: magic number, version, length of the header, flag of compressed pages.
MAGIC, VERSION, HEADER, COMPRESSED = 0x31545845, 1, 64, 1


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once; a checksum in it stays outside of the lambda functions of f."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _turned(hexa: Column) -> Column:
    """Hexadecimal text with its bytes the other way round."""
    return F.array_join(F.reverse(F.regexp_extract_all(hexa, F.lit("(..)"))), "")


def _little(value: Column, width: int) -> Column:
    return _turned(F.lpad(F.hex(value.cast("long")), 2 * width, "0"))


def _number(extent: Column, at: int, width: int) -> Column:
    return F.conv(_turned(F.hex(F.substring(extent, at + 1, width))), 16, 10).cast("long")


def bitmap(slots: Column) -> Column:
    """Hexadecimal bitmap of ascending slot numbers."""
    byte = lambda s, k: F.aggregate(F.filter(s, lambda x: F.floor(x / 8) == k), F.lit(0), lambda a, x: a + F.call_function("shiftleft", F.lit(1), (x % 8).cast("int")))
    every = lambda s: F.sequence(F.lit(0), F.floor(F.array_max(s) / 8).cast("int"))
    return F.when(F.size(slots) == 0, "").otherwise(_let(slots, lambda s: F.array_join(F.transform(every(s), lambda k: F.lpad(F.hex(byte(s, k)), 2, "0")), "")))


def build(pages: Column, page_size: int, compressed: bool = False) -> Column:
    """pages: array of (slot, data), each slot once and each page whole. An extent, an empty one of no pages; null of null."""
    slots = F.transform(F.array_sort(pages), lambda p: p["slot"])
    data = F.aggregate(F.transform(F.array_sort(pages), lambda p: p["data"]), F.lit(b""), lambda a, x: F.concat(a, x))
    count = F.coalesce(F.array_max(slots) + 1, F.lit(0))
    # The checksum of no pages is 0, not that of no bytes.
    checksum = F.when(F.size(pages) == 0, "0" * 16).otherwise(_turned(fnv1a64(data)))
    head = F.concat(_little(F.lit(MAGIC), 4), _little(F.lit(VERSION), 2), _little(F.lit(COMPRESSED if compressed else 0), 2), _little(F.lit(page_size), 4), _little(count, 4), _little(F.size(pages) * page_size, 4), checksum)
    return F.concat(F.unhex(F.rpad(head, 2 * HEADER, "0")), F.unhex(bitmap(slots)), data)


def header(extent: Column) -> Column:
    """(version, flags, page_size, page_count, extent_size, checksum), null where it isn't an extent."""
    return _let(extent, _header)


def _header(x: Column) -> Column:
    fields = F.struct(
        _number(x, 4, 2).alias("version"), _number(x, 6, 2).alias("flags"), _number(x, 8, 4).alias("page_size"), _number(x, 12, 4).alias("page_count"), _number(x, 16, 4).alias("extent_size"), F.lower(_turned(F.hex(F.substring(x, 21, 8)))).alias("checksum")
    )
    return F.when((F.octet_length(x) >= HEADER) & (_number(x, 0, 4) == MAGIC) & (_number(x, 4, 2) == VERSION), fields)


def _start(h: Column) -> Column:
    """Where the first page is, from 0."""
    return F.lit(HEADER) + F.ceil(h["page_count"] / 8).cast("int")


def _has(x: Column, h: Column, slot: Column) -> Column:
    byte = F.conv(F.hex(F.substring(x, F.floor(slot / 8).cast("int") + HEADER + 1, F.lit(1))), 16, 10).cast("int")
    inside = (slot >= 0) & (slot < h["page_count"])
    return F.coalesce(inside & (F.call_function("getbit", byte, (slot % 8).cast("int")) == 1), F.lit(False))


def _slots(x: Column, h: Column) -> Column:
    n = h["page_count"].cast("int")
    return F.when(n > 0, F.filter(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda s: _has(x, h, s))).when(n == 0, F.array().cast("array<int>"))


def has_page(extent: Column, slot: Column) -> Column:
    """Whether a slot has a page; false outside the extent."""
    return _let(extent, lambda x: _let(_header(x), lambda h: _has(x, h, slot)))


def present(extent: Column) -> Column:
    """Slots that have pages, null where it isn't an extent."""
    return _let(extent, lambda x: _let(_header(x), lambda h: _slots(x, h)))


def page(extent: Column, slot: Column) -> Column:
    """A page's bytes, or null."""

    def read(x: Column, h: Column) -> Column:
        width = h["page_size"].cast("int")
        before = F.size(F.filter(_slots(x, h), lambda s: s < slot))
        return F.when(_has(x, h, slot), F.substring(x, _start(h) + before * width + 1, width))

    return _let(extent, lambda x: _let(_header(x), lambda h: read(x, h)))


def validate(rows: DataFrame, extent: str = "data") -> DataFrame:
    """rows with valid: whether header, length and checksum agree; false of null."""

    def payload(x: object) -> tuple[bytes, str] | None:
        """The pages' bytes and the checksum they should have, or null where the header or the length is wrong."""
        if x is None or len(x) < HEADER:
            return None
        magic, version, _, _, count, size, checksum = struct.unpack_from("<IHHIIIQ", x)
        start = HEADER + (count + 7) // 8
        return (bytes(x[start : start + size]), f"{checksum:016x}") if magic == MAGIC and version == VERSION and len(x) >= start + size else None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [payload(x) for x in frame[extent]]
            now = fnv1a64_of(pd.Series([f[0] if f else None for f in found], dtype=object))
            yield frame.assign(valid=[bool(f) and f[1] == (n if f[0] else "0" * 16) for f, n in zip(found, now)])

    return rows.mapInPandas(run, StructType([*rows.schema.fields, StructField("valid", BooleanType())]))
