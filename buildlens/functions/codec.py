"""Column expressions for the build history's binary encodings.

Integers are little-endian and of fixed width. Unsigned 64-bit numbers keep their bit
pattern in BIGINT; `unsigned` shows them as DECIMAL(20,0). All of this stays in the
JVM, inside code generation or higher-order functions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the stored format: the leading byte of a key, by kind.
KEY_KINDS = {"C": "command", "D": "directory contents", "d": "filtered directory contents", "N": "node", "I": "custom task", "S": "directory tree signature", "s": "directory tree structure signature", "T": "target", "X": "stat"}
#: Kinds whose key carries a length-prefixed name and then a payload.
KEYS_WITH_DATA = ("d", "I", "S", "s")


def byte_at(data: Column, at: Column | int) -> Column:
    """The byte at a position counted from 0, as BIGINT."""
    return F.conv(F.hex(F.substring(data, (at if isinstance(at, Column) else F.lit(at)) + 1, F.lit(1))), 16, 10).cast("long")


def little_endian(data: Column, at: Column | int = 0, width: int = 8) -> Column:
    """The integer of `width` bytes at a position; 8 bytes give the bit pattern."""
    start = at if isinstance(at, Column) else F.lit(at)
    whole = F.lit(0).cast("long")
    for i in range(width):
        whole = whole.bitwiseOR(F.shiftleft(byte_at(data, start + i), 8 * i))
    return whole


def to_little_endian(value: Column, width: int = 8) -> Column:
    """The `width` bytes of an integer."""
    parts = [F.lpad(F.hex(F.shiftrightunsigned(value.cast("long"), 8 * i).bitwiseAND(F.lit(255))), 2, "0") for i in range(width)]
    return F.unhex(F.concat(*parts))


def _turned(digits: Column) -> Column:
    """The 16 hex digits of 8 bytes, the last byte first."""
    return F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(8))])


def _word(digits: Column) -> Column:
    """The bit pattern of 16 hex digits, in halves, as conv() counts without sign."""
    half = lambda at: F.conv(F.substring(digits, at, 8), 16, 10).cast("long")
    return F.shiftleft(half(1), 32).bitwiseOR(half(9))


def unsigned(value: Column) -> Column:
    """A bit pattern as the unsigned number that it stands for."""
    wide = value.cast("decimal(20,0)")
    return F.when(value < 0, wide + F.lit(str(1 << 64)).cast("decimal(20,0)")).otherwise(wide).cast("decimal(20,0)")


def decode_dependencies(blob: Column) -> Column:
    """ARRAY<STRUCT<key_id, order_only, single_use>> of 8-byte words; null where the
    length is not a multiple of 8."""
    digits = F.transform(F.sequence(F.lit(0), (F.octet_length(blob) / 8).cast("int") - 1), lambda i: F.hex(F.substring(blob, i * 8 + 1, F.lit(8))))
    words = F.transform(F.transform(digits, _turned), _word)
    words = F.when(F.octet_length(blob) == 0, F.array().cast("array<bigint>")).otherwise(words)
    entries = F.transform(
        words,
        lambda w: F.struct(
            F.shiftrightunsigned(w, 2).alias("key_id"),
            (w.bitwiseAND(F.lit(1)) == 1).alias("order_only"),
            (w.bitwiseAND(F.lit(2)) == 2).alias("single_use"),
        ),
    )
    return F.when(F.octet_length(blob) % 8 == 0, entries)


def encode_dependencies(entries: Column) -> Column:
    """The inverse of decode_dependencies."""
    word = lambda e: F.shiftleft(e["key_id"], 2).bitwiseOR(e["single_use"].cast("long") * 2).bitwiseOR(e["order_only"].cast("long"))
    digits = F.transform(entries, lambda e: F.lpad(F.hex(word(e)), 16, "0"))
    return F.unhex(F.array_join(F.transform(digits, _turned), ""))


def decode_key(key: Column) -> Column:
    """STRUCT<kind, name, data>: what a stored key names, and its payload if it has one."""
    tag = F.decode(F.substring(key, 1, 1), "ISO-8859-1")
    kinds = F.create_map(*[F.lit(x) for pair in KEY_KINDS.items() for x in pair])
    has_data = tag.isin(*KEYS_WITH_DATA)
    length = little_endian(key, 1, 4).cast("int")
    name = F.when(has_data, F.substring(key, F.lit(6), length)).otherwise(F.substring(key, F.lit(2), F.octet_length(key)))
    data = F.when(has_data, F.substring(key, length + 6, F.octet_length(key)))
    return F.struct(F.element_at(kinds, tag).alias("kind"), name.alias("name"), data.alias("data"))


def encode_key(tag: str, name: Column, data: Column | None = None) -> Column:
    name = name.cast("binary")
    head = F.lit(tag).cast("binary")
    if data is None:
        return F.concat(head, name)
    return F.concat(head, to_little_endian(F.octet_length(name), 4), name, data.cast("binary"))


FILE_INFO_BYTES = 80


def decode_file_info(data: Column, at: Column | int = 0) -> Column:
    """STRUCT of four numbers, the time in seconds and nanoseconds, and the checksum."""
    start = at if isinstance(at, Column) else F.lit(at)
    field = lambda i: little_endian(data, start + 8 * i)
    return F.struct(
        unsigned(field(0)).alias("device"),
        unsigned(field(1)).alias("inode"),
        field(2).alias("mode"),
        field(3).alias("size"),
        field(4).alias("mtime_s"),
        field(5).cast("int").alias("mtime_ns"),
        F.substring(data, start + 49, F.lit(32)).alias("checksum"),
    )


def decode_file_infos(data: Column, at: Column | int = 0) -> Column:
    """A 4-byte count and then so many file infos."""
    start = at if isinstance(at, Column) else F.lit(at)
    n = little_endian(data, start, 4).cast("int")
    infos = F.transform(F.sequence(F.lit(0), n - 1), lambda i: decode_file_info(data, start + 4 + i * FILE_INFO_BYTES))
    return F.when(n > 0, infos).otherwise(F.filter(F.array(decode_file_info(data, start)), lambda _: F.lit(False)))


def decode_strings(data: Column) -> Column:
    """The list of strings, each ended by a NUL, behind an 8-byte length."""
    text = F.decode(F.substring(data, F.lit(9), little_endian(data).cast("int")), "UTF-8")
    return F.when(F.length(text) > 0, F.slice(F.split(text, "\\x00", -1), 1, F.size(F.split(text, "\\x00", -1)) - 1)).otherwise(F.array().cast("array<string>"))


def encode_strings(values: Column) -> Column:
    body = F.concat_ws("", F.transform(values, lambda v: F.concat(v, F.lit("\0")))).cast("binary")
    return F.concat(to_little_endian(F.octet_length(body)), body)
