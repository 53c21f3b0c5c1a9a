"""Sizes, times, modes, hashes, codecs and other scalar functions."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BinaryType, StringType

#: 1 below it is seconds, from it on milliseconds.
SECONDS_BELOW = 1_000_000_000_000
MINUTE, HOUR, DAY = 60_000, 3_600_000, 86_400_000


def parse_size(text: str) -> tuple[str, int]:
    """``+10K`` -> ('>', 10240): a comparison and a count of bytes."""
    m = re.fullmatch(r"([+-]?)(\d+(?:\.\d+)?)([BKMG]?)", text.strip(), re.I)
    if not m:
        raise ValueError(f"bad size: {text}")
    return {"+": ">", "-": "<", "": "="}[m[1]], int(float(m[2]) * 1024 ** "BKMG".index(m[3].upper() or "B"))


def parse_age(text: str) -> tuple[str, int]:
    """``-7d`` -> ('newer', ms). Units m, h, d, w and M (30 days); days without unit; others are refused."""
    m = re.fullmatch(r"([+-]?)(\d+(?:\.\d+)?)([mhdwM]?)", text.strip())
    if not m:
        raise ValueError(f"bad time: {text}")
    unit = {"m": MINUTE, "h": HOUR, "d": DAY, "w": 7 * DAY, "M": 30 * DAY, "": DAY}[m[3]]
    return {"+": "older", "-": "newer", "": "about"}[m[1]], int(float(m[2]) * unit)


def size_test(size: Column, text: str) -> Column:
    op, n = parse_size(text)
    return {">": size > n, "<": size < n, "=": size == n}[op]


def age_test(at: Column, text: str, now_ms: int) -> Column:
    """``about`` is within a day of the time; now is always an argument."""
    op, ms = parse_age(text)
    then = now_ms - ms
    return {"older": at < then, "newer": at > then, "about": F.abs(at - then) <= DAY}[op]


def utimes(value: Column) -> Column:
    """Milliseconds of a number that may be seconds; 0 stays 0."""
    value = value.cast("long")
    return F.when((value == 0) | (value >= SECONDS_BELOW), value).otherwise(value * 1000)


def human_size(size: Column) -> Column:
    whole = lambda unit: F.floor(size / unit + 0.5).cast("string")
    return (
        F.when(size < 1024, F.concat(size.cast("string"), F.lit("B")))
        .when(size < 1024**2, F.concat(whole(1024), F.lit("K")))
        .when(size < 1024**3, F.concat(whole(1024**2), F.lit("M")))
        .otherwise(F.concat(whole(1024**3), F.lit("G")))
    )


def blocks(size: Column) -> Column:
    return F.ceil(size / 512).cast("long")


TYPE_BITS = {"file": 0o100000, "directory": 0o040000, "symlink": 0o120000, "block": 0o060000, "character": 0o020000, "fifo": 0o010000, "socket": 0o140000}


def full_mode(mode: Column, kind: Column) -> Column:
    bits = F.lit(0)
    for name, b in TYPE_BITS.items():
        bits = F.when(kind == name, F.lit(b)).otherwise(bits)
    return mode.bitwiseAND(F.lit(0o7777)).bitwiseOR(bits)


def kind_of_mode(mode: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, b in TYPE_BITS.items():
        out = F.when(mode.bitwiseAND(F.lit(0o170000)) == b, F.lit(name)).otherwise(out)
    return out


def mode_text(mode: Column) -> Column:
    """``rwxr-x---``."""
    out = []
    for shift in (6, 3, 0):
        for bit, c in ((4, "r"), (2, "w"), (1, "x")):
            out.append(F.when(mode.bitwiseAND(F.lit(bit << shift)) != 0, F.lit(c)).otherwise(F.lit("-")))
    return F.concat(*out)


def access(mode: Column, uid: Column, gid: Column, want: int, as_uid: int, as_gids: list[int], root_bypass: bool = False) -> Column:
    """The owner's class decides for the owner, then the group's, then the others'."""
    shift = F.when(uid == as_uid, 6).when(gid.isin(as_gids), 3).otherwise(0)
    granted = F.when(shift == 6, F.shiftright(mode, 6)).when(shift == 3, F.shiftright(mode, 3)).otherwise(mode).bitwiseAND(F.lit(7))
    allowed = granted.bitwiseAND(F.lit(want)) == want
    return (F.lit(as_uid == 0) | allowed) if root_bypass else allowed


def chmod(spec: str | int, mode: Column, kind: Column) -> Column:
    """Numeric, or clauses ``[ugoa]*([+-=][rwxXst]*)+`` by comma."""
    if isinstance(spec, int) or re.fullmatch(r"[0-7]+", spec):
        return F.lit(spec if isinstance(spec, int) else int(spec, 8)).cast("int")
    out = mode
    for clause in spec.split(","):
        m = re.fullmatch(r"([ugoa]*)((?:[+\-=][rwxXst]*)+)", clause)
        if not m:
            raise ValueError(f"bad mode: {spec}")
        who = "ugo" if not m[1] or "a" in m[1] else m[1]
        for op, perms in re.findall(r"([+\-=])([rwxXst]*)", m[2]):
            bits, execute = 0, 0
            for w, shift in (("u", 6), ("g", 3), ("o", 0)):
                if w in who:
                    bits |= sum({"r": 4, "w": 2, "x": 1}.get(p, 0) for p in set(perms)) << shift
                    execute |= 1 << shift if "X" in perms else 0
            if "s" in perms:
                bits |= (0o4000 if "u" in who else 0) | (0o2000 if "g" in who else 0)
            if "t" in perms:
                bits |= 0o1000
            base = out
            some = (base.bitwiseAND(F.lit(0o111)) != 0) | (kind == "directory")
            value = F.when(some, F.lit(bits | execute)).otherwise(F.lit(bits)) if execute else F.lit(bits)
            if op == "+":
                out = base.bitwiseOR(value)
            elif op == "-":
                out = base.bitwiseAND(F.bitwise_not(value))
            else:
                clear = sum(7 << s for w, s in (("u", 6), ("g", 3), ("o", 0)) if w in who)
                out = base.bitwiseAND(F.lit(~clear & 0o7777)).bitwiseOR(value)
    return out.cast("int")


def inode(text: Column) -> Column:
    """The number a text spells, or else a 31-times rolling hash within 32 bits, made positive."""
    code = lambda c: F.ascii(c).cast("long")
    wrap = lambda h: F.when(h.bitwiseAND(F.lit(0xFFFFFFFF)) >= 1 << 31, h.bitwiseAND(F.lit(0xFFFFFFFF)) - (1 << 32)).otherwise(h.bitwiseAND(F.lit(0xFFFFFFFF)))
    rolled = F.aggregate(F.split(text, ""), F.lit(0).cast("long"), lambda h, c: wrap(h * 31 + code(c)))
    return F.when(text.rlike(r"^\d+$"), text.cast("long")).otherwise(F.abs(rolled))


def hash_algorithm(text: Column) -> Column:
    hexa = text.rlike("^[0-9a-fA-F]+$")
    return F.when(hexa & (F.length(text) == 40), "sha1").when(hexa & (F.length(text) == 64), "sha256").when(hexa & (F.length(text) == 96), "sha384").when(hexa & (F.length(text) == 128), "sha512")


def object_path(hash_: Column) -> Column:
    """``objects/ab/cdef...``."""
    return F.concat(F.lit("objects/"), F.substring(hash_, 1, 2), F.lit("/"), F.substring(hash_, F.lit(3), F.length(hash_)))


def hash_of_object_path(path: Column) -> Column:
    return F.concat(F.regexp_extract(path, "([0-9a-f]{2})/([0-9a-f]+)$", 1), F.regexp_extract(path, "([0-9a-f]{2})/([0-9a-f]+)$", 2))


def framed(kind: str, content: Column) -> Column:
    """``<type> <length>\\0`` and the content, as bytes."""
    head = F.concat(F.lit(kind + " "), F.octet_length(content).cast("string"))
    return F.concat(F.encode(head, "UTF-8"), F.unhex(F.lit("00")), content.cast("binary"))


def object_hash(kind: str, content: Column) -> Column:
    return F.sha1(framed(kind, content))


def codec(content: Column) -> Column:
    """Compression by the first bytes."""
    head = F.hex(F.substring(content, 1, 4))
    return F.when(head.startswith("1F8B"), "gzip").when(head == "04224D18", "lz4").when(head == "28B52FFD", "zstd").when(head.rlike("^78(01|5E|9C|DA)"), "zlib").otherwise("none")


def snake_case(name: str) -> str:
    return re.sub(r"([A-Z])", lambda m: "_" + m[1].lower(), name).lstrip("_")


def snake_case_col(name: Column) -> Column:
    """snake_case of a column."""
    return F.regexp_replace(F.lower(F.regexp_replace(name, "([A-Z])", "_$1")), "^_+", "")


def sanitize(name: str) -> str:
    """An SQL identifier, or an error."""
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name):
        raise ValueError(f"bad identifier: {name}")
    return name


def fnv1a64_of(content: pd.Series) -> pd.Series:
    """64-bit FNV-1a of bytes, in hexadecimal: a byte of all rows at a time, while many rows are that long."""
    basis, prime = 0xCBF29CE484222325, 0x100000001B3
    rows = sorted((k for k, x in enumerate(content) if x is not None), key=lambda k: -len(content.iloc[k]))
    data = [bytes(content.iloc[k]) for k in rows]
    lengths = np.array([len(x) for x in data], dtype=np.int64)
    hashes = np.full(len(rows), basis, dtype=np.uint64)
    # Where fewer than ``few`` rows go on, numpy's call costs more than their bytes.
    few, at, start = 16, 0, np.concatenate([[0], np.cumsum(lengths)])
    flat = np.frombuffer(b"".join(data), dtype=np.uint8)
    alive = len(rows)
    while (alive := int(np.searchsorted(-lengths[:alive], -at))) >= few:
        hashes[:alive] = (hashes[:alive] ^ flat[start[:alive] + at]) * np.uint64(prime)
        at += 1
    out: list[str | None] = [None] * len(content)
    for j, k in enumerate(rows):
        h = int(hashes[j])
        for b in data[j][at:]:
            h = (h ^ b) * prime & 0xFFFFFFFFFFFFFFFF
        out[k] = f"{h:016x}"
    return pd.Series(out, dtype=object)


fnv1a64 = pandas_udf(fnv1a64_of, StringType())


@pandas_udf(BinaryType())
def deflate(content: pd.Series) -> pd.Series:
    import zlib

    return content.map(lambda x: None if x is None else zlib.compress(bytes(x)))


@pandas_udf(BinaryType())
def inflate(content: pd.Series) -> pd.Series:
    import zlib

    return content.map(lambda x: None if x is None else zlib.decompress(bytes(x)))
