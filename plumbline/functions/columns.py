"""Column expressions: ids, hashes, rounding, formats. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The DNS namespace of RFC 4122, and the prefix of chunk names.
DNS_NAMESPACE = "6ba7b8109dad11d180b400c04fd430c8"
CHUNK_PREFIX = "tolink-eval:eval-"


def content_hash(text: Column) -> Column:
    """SHA-256 of the UTF-8 text, lowercase hex."""
    return F.sha2(text.cast("binary"), 256)


def chunk_key(dataset_id: Column, doc_id: Column, ordinal: Column) -> Column:
    return F.concat(F.lit(CHUNK_PREFIX), F.concat_ws("-", dataset_id.cast("string"), doc_id.cast("string"), ordinal.cast("string")))


def uuid5(name: Column, namespace: str = DNS_NAMESPACE) -> Column:
    """Version 5 UUID: the first 16 bytes of SHA-1 over namespace and name, with version and variant set."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), name.cast("binary")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("long").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws(
        "-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)),
        F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12),
    )


def chunk_id(dataset_id: Column, doc_id: Column, ordinal: Column) -> Column:
    return uuid5(chunk_key(dataset_id, doc_id, ordinal))


def round4(value: Column) -> Column:
    """Half-even rounding to four places, as the metrics are reported."""
    return F.bround(value, 4)


def exact4(value: Column) -> Column:
    """Four places, rounded by the number's exact binary value, half to even: as one rounds outside of decimal columns.

    The number is split so that both parts times 10,000 are exact; not for numbers over 10**8.
    """
    high = value * F.lit(134217729.0) - (value * F.lit(134217729.0) - value)
    whole = F.floor(high * 10000.0)
    over = (high * 10000.0 - whole - 0.5) + (value - high) * 10000.0
    up = (over > 0) | ((over == 0) & (F.pmod(whole, F.lit(2)) == 1))
    return (whole + up.cast("long")) / F.lit(10000.0)


def bucket(user_id: Column, buckets: int = 16) -> Column:
    """The vector bucket that a user's points are kept in."""
    return F.pmod(F.crc32(user_id.cast("string").cast("binary")), F.lit(buckets))


def signed_delta(delta: Column, places: int = 3) -> Column:
    """A change with its sign; one that rounds to nothing is shown as ±0."""
    flat = F.abs(delta) < 0.5 * 10.0**-places
    return F.when(flat, F.lit("±" + f"{0:.{places}f}")).otherwise(F.format_string(f"%+.{places}f", delta))


def fixed(value: Column, places: int = 3) -> Column:
    return F.when(value.isNull(), F.lit("-")).otherwise(F.format_string(f"%.{places}f", value))


def finite(value: Column) -> Column:
    return ~F.isnan(value) & (F.abs(value) != float("inf"))
