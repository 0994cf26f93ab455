"""Distances, projections and tile arithmetic as column expressions."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_METRES = 6371008.8
#: Fixed values of the public hash FNV-1a: its start, and its prime 2^40 + 435.
FNV_START, FNV_SHIFT, FNV_LOW = 14695981039346656037, 40, 435


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle metres."""
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), 2)
    return F.lit(2 * EARTH_METRES) * F.asin(F.sqrt(half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)))


def tile_x(lon: Column, zoom: int) -> Column:
    return F.floor((lon + 180) / 360 * (1 << zoom))


def tile_y(lat: Column, zoom: int) -> Column:
    """The Web-Mercator row of a latitude."""
    sine = F.sin(F.radians(lat))
    return F.floor((0.5 - F.log((1 + sine) / (1 - sine)) / (4 * pi)) * (1 << zoom))


def terrarium_metres(red: Column, green: Column, blue: Column) -> Column:
    return red * 256 + green + blue / 256 - 32768


def natural_log(x: Column) -> Column:
    """The logarithm of ``x`` as a double; minus infinity for 0, where Spark's own is null and would leave the row out of a mean."""
    return F.when(x == 0, F.lit(float("-inf"))).otherwise(F.log(x))


def logit(p: Column, guard: float = 1e-6) -> Column:
    q = F.greatest(F.lit(guard), F.least(F.lit(1 - guard), p))
    return F.log(q / (1 - q))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def hilbert_tile(x: Column, y: Column, zoom: int) -> Column:
    """The number of a tile along the Hilbert curve of its zoom, after all tiles of lower zooms."""

    def step(held: Column, bit: Column) -> Column:
        side = F.lit(1 << zoom).cast("long")
        rx, ry = (F.when(held[c].bitwiseAND(bit) != 0, 1).otherwise(0).cast("long") for c in "xy")
        flip = (ry == 0) & (rx == 1)
        u, v = (F.when(flip, side - 1 - held[c]).otherwise(held[c]) for c in "xy")
        turned = ry == 0
        return F.struct(F.when(turned, v).otherwise(u).alias("x"), F.when(turned, u).otherwise(v).alias("y"), (held["d"] + bit * bit * (3 * rx).bitwiseXOR(ry)).alias("d"))

    start = F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), F.lit(((1 << 2 * zoom) - 1) // 3).cast("long").alias("d"))
    bits = F.array(*[F.lit(1 << k).cast("long") for k in reversed(range(zoom))]).cast("array<bigint>")
    return F.aggregate(bits, start, step, lambda h: h["d"])


def fnv64(text: Column) -> Column:
    """FNV-1a of a text's bytes in 64 bits, as 16 hexadecimal digits; products are taken in halves, which never overflow."""
    low = lambda n: n.bitwiseAND(F.lit(0xFFFFFFFF))
    hexed = F.hex(F.encode(text, "UTF-8"))
    count = F.length(hexed) / 2
    octets = F.when(count > 0, F.transform(F.sequence(F.lit(1), count.cast("int")), lambda k: F.conv(F.substring(hexed, 2 * k - 1, F.lit(2)), 16, 10).cast("long"))).otherwise(F.array().cast("array<bigint>"))

    def step(held: Column, octet: Column) -> Column:
        right = held["low"].bitwiseXOR(octet)
        product = right * FNV_LOW
        high = held["high"] * FNV_LOW + F.shiftright(product, 32) + F.shiftleft(right, FNV_SHIFT - 32)
        return F.struct(low(high).alias("high"), low(product).alias("low"))

    start = F.struct(F.lit(FNV_START >> 32).cast("long").alias("high"), F.lit(FNV_START & 0xFFFFFFFF).cast("long").alias("low"))
    half = lambda n: F.lower(F.lpad(F.hex(n), 8, "0"))
    return F.when(text.isNotNull(), F.aggregate(octets, start, step, lambda h: F.concat(half(h["high"]), half(h["low"]))))
