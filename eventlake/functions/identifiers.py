"""Identifiers and times as Column expressions: UUIDs, shard numbers, chunk keys, offsets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import base64_line

#: 100 ns steps are counted from 1582-10-15; so many milliseconds lie before 1970.
GREGORIAN_MS = 12_219_292_800_000


def dashed(hex32: Column) -> Column:
    """32 hex digits as a UUID."""
    return F.lower(F.concat_ws("-", *(F.substring(hex32, i, n) for i, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))))


def uuid_v5(namespace: str, name: Column) -> Column:
    """The RFC 4122 version 5 UUID of a name within a namespace UUID; null for a null name."""
    space = F.unhex(F.lit(namespace.replace("-", "")))
    h = F.sha1(F.concat(space, F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return dashed(F.concat(F.substring(h, 1, 12), F.lit("5"), F.substring(h, 14, 3), variant, F.substring(h, 18, 15)))


def uuid_start_of(ms: Column) -> Column:
    """The smallest version 1 UUID of a millisecond since 1970 (for range scans by time)."""
    ticks = (ms.cast("bigint") + GREGORIAN_MS) * 10_000
    digits = F.lpad(F.hex(ticks), 16, "0")
    low, mid, high = F.substring(digits, 9, 8), F.substring(digits, 5, 4), F.substring(digits, 2, 3)
    return dashed(F.concat(low, mid, F.lit("1"), high, F.lit("8080808080808080")))


def uuid_timestamp(uuid: Column) -> Column:
    """Milliseconds since 1970 of a version 1 UUID; an error for other versions."""
    flat = F.replace(uuid, F.lit("-"), F.lit(""))
    ticks = F.conv(F.concat(F.substring(flat, 14, 3), F.substring(flat, 9, 4), F.substring(flat, 1, 8)), 16, 10).cast("bigint")
    wrong = F.raise_error(F.concat(F.lit("not a time-based UUID: "), uuid)).cast("bigint")
    return F.when(uuid.isNull(), None).when(F.substring(flat, 13, 1) == "1", F.floor(ticks / 10_000).cast("bigint") - GREGORIAN_MS).otherwise(wrong)


def uuid_set(text: Column) -> Column:
    """A comma-separated list of UUIDs as a sorted array without repeats; empty for a blank text."""
    parts = F.transform(F.split(text, ","), lambda u: F.lower(F.trim(u)))
    return F.array_sort(F.array_distinct(F.filter(parts, lambda u: u != "")))


def uuid_longs(uuid: Column) -> tuple[Column, Column]:
    """The two signed 64-bit numbers (most, least significant) of a UUID."""
    flat = F.replace(uuid, F.lit("-"), F.lit(""))
    half = lambda start: F.conv(F.substring(flat, start, 16), 16, -10).cast("bigint")
    return half(1), half(17)


def uuid_of_longs(most: Column, least: Column) -> Column:
    """The UUID of two signed 64-bit numbers; null if either is."""
    return F.when(most.isNotNull() & least.isNotNull(), dashed(F.concat(F.lpad(F.hex(most), 16, "0"), F.lpad(F.hex(least), 16, "0"))))


def time_offset(ms: Column) -> Column:
    """A position in a log by time: the smallest UUID of a millisecond; 0 and null are no position."""
    return F.when(ms != 0, uuid_start_of(ms))


def offset_epoch(offset: Column) -> Column:
    """Milliseconds since 1970 of a position in a log; 0 for none."""
    return F.coalesce(uuid_timestamp(offset), F.lit(0).cast("bigint"))


def throttle_entity(key: Column) -> Column:
    """A name for what a key throttles that is fit for any identifier: its UTF-8 bytes as base64."""
    return base64_line(F.encode(key, "UTF-8"))


def java_hash(text: Column) -> Column:
    """The 32-bit string hash of the JVM, over UTF-16 units."""
    two32, two31 = F.lit(1 << 32).cast("bigint"), F.lit(1 << 31).cast("bigint")

    def add(h: Column, c: Column) -> Column:
        code = F.ascii(c).cast("bigint")
        pair = F.pmod((h * 31 + 0xD7C0 + F.floor(code / 1024)) * 31 + 0xDC00 + code % 1024, two32)
        return F.when(code < 65_536, F.pmod(h * 31 + code, two32)).otherwise(pair).cast("bigint")

    chars = F.filter(F.split(text, ""), lambda c: c != "")
    total = F.aggregate(chars, F.lit(0).cast("bigint"), add)
    return F.when(total >= two31, total - two32).otherwise(total).cast("int")


def java_shard(text: Column, shards: int = 256) -> Column:
    """Remainder of the JVM hash, negative where the hash is; partition by pmod of it instead."""
    return java_hash(text) % shards


def chunk_key(tag: Column, ms: Column) -> Column:
    """Name of a backup chunk: its tag and the UTC time of its first event."""
    return F.concat(tag, F.lit("-from-"), F.date_format(F.timestamp_millis(ms), "yyyy_MM_dd_HH_mm_ss_SSS"))


def chunk_start(key: Column) -> Column:
    """Milliseconds since 1970 in a chunk's name; an error if it holds none."""
    digits = F.regexp_extract(key, r"-from-(\d{4}_\d\d_\d\d_\d\d_\d\d_\d\d_\d{3})$", 1)
    at = F.unix_millis(F.try_to_timestamp(F.when(digits != "", digits), F.lit("yyyy_MM_dd_HH_mm_ss_SSS")))
    return F.coalesce(at, F.raise_error(F.concat(F.lit("no start time in "), key)).cast("bigint"))


def to_millis(since: Column) -> Column:
    """A point in time given as milliseconds or as ISO 8601 text; an error for anything else."""
    number = F.when(since.rlike(r"^-?\d+$"), since.try_cast("bigint"))
    iso = F.unix_millis(since.try_cast("timestamp"))
    return F.when(since.isNotNull(), F.coalesce(number, iso, F.raise_error(F.concat(F.lit("not a time: "), since)).cast("bigint")))


def event_tag(kind: Column, names: dict[str, str]) -> Column:
    """A configured tag of an event type, else the last part of its dotted name."""
    plain = F.substring_index(F.substring_index(kind, ".", -1), "$", -1)
    if not names:
        return plain
    table = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    return F.coalesce(F.try_element_at(table, kind), plain)
