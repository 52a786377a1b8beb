"""Hashes and byte framing as column expressions (no UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The FNV-1a 64-bit offset basis, and its prime 2**40 + 435.
FNV_BASIS = 0xCBF29CE484222325
FNV_PRIME = 0x100000001B3
MASK32 = 0xFFFFFFFF


def fnv1a64_py(data: bytes) -> int:
    """The hash of one key on the driver, for small configuration such as ring tokens."""
    h = FNV_BASIS
    for b in data:
        h = ((h ^ b) * FNV_PRIME) % 2**64
    return h


def fnv1a64_halves(key: Column) -> Column:
    """struct(h, l): high and low 32 bits of FNV-1a 64 of a binary column.

    64-bit products would overflow, so the state is folded in two halves: of
    (x * (2**40 + 435)) mod 2**64 the low half is x.l * 435, the high half gets
    x.h * 435, the carry of the low one and x.l shifted by 40.
    """
    hexed = F.hex(key)
    places = F.when(F.length(key) > 0, F.sequence(F.lit(0), F.length(key) - 1)).otherwise(F.array().cast("array<int>"))
    octets = F.transform(places, lambda i: F.conv(F.substring(hexed, 2 * i + 1, F.lit(2)), 16, 10).cast("long"))

    def fold(state: Column, octet: Column) -> Column:
        x = state["l"].bitwiseXOR(octet)
        low = x * 435
        high = state["h"] * 435 + F.shiftleft(x.bitwiseAND(0xFFFFFF), 8) + F.shiftrightunsigned(low, 32)
        return F.struct(high.bitwiseAND(F.lit(MASK32)).alias("h"), low.bitwiseAND(F.lit(MASK32)).alias("l"))

    start = F.struct(F.lit(FNV_BASIS >> 32).cast("long").alias("h"), F.lit(FNV_BASIS & MASK32).cast("long").alias("l"))
    return F.aggregate(octets, start, fold)


def fnv1a64(key: Column) -> Column:
    """FNV-1a 64 as DECIMAL(20,0), which orders it as the unsigned number that it is."""
    halves = fnv1a64_halves(key)
    return F.aggregate(
        F.array(halves), F.lit(None).cast("decimal(20,0)"), lambda _, s: (s["h"].cast("decimal(10,0)") * F.lit(2**32).cast("decimal(10,0)") + s["l"].cast("decimal(10,0)")).cast("decimal(20,0)")
    )


def little_endian(x: Column, size: int) -> Column:
    """The low ``size`` bytes of a long, least significant first."""
    digits = F.lpad(F.hex(x.cast("long")), 16, "0")
    return F.unhex(F.concat(*[F.substring(digits, 15 - 2 * i, 2) for i in range(size)]))


def wal_payload(key: Column, value: Column, ts: Column, tombstone: Column) -> Column:
    """The bytes a log frame's checksum covers: time, mark, lengths, key, value."""
    key, value = F.coalesce(key, F.lit(b"")), F.coalesce(value, F.lit(b""))
    mark = F.when(tombstone, F.lit(b"\x01")).otherwise(F.lit(b"\x00"))
    return F.concat(little_endian(ts, 8), mark, little_endian(F.length(key), 4), little_endian(F.length(value), 4), key, value)


def wal_frame(key: Column, value: Column, ts: Column, tombstone: Column) -> Column:
    """A whole frame: CRC-32 of the payload, then the payload; 21 bytes and key and value."""
    payload = wal_payload(key, value, ts, tombstone)
    return F.concat(little_endian(F.crc32(payload), 4), payload)


def bloom_shape(n: int, p: float) -> tuple[int, int]:
    """Bits and hash functions of a Bloom filter for n elements and false positive rate p."""
    import math

    m = math.ceil(n * math.log(p) / math.log(1 / 2 ** math.log(2)))
    k = math.floor(m / n * math.log(2) + 0.5)
    return m, max(1, k)


def bloom_indexes(key: Column, m: int, k: int) -> Column:
    """The bit numbers of a key: (h1 + i * h2 mod 2**32) mod m for i < k, from the hash's halves."""
    return F.flatten(
        F.transform(
            F.array(fnv1a64_halves(key)),
            lambda s: F.transform(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long")), lambda i: (s["h"] + i * s["l"]).bitwiseAND(F.lit(MASK32)) % F.lit(m)),
        )
    )
