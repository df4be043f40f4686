"""Column functions: byte ranges, numbers as text, globs, hash slots, distances, tokens, similarities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The earth's radius in metres, and metres in a mile and a foot.
EARTH_M, MILE_M, FOOT_M = 6372797.560856, 1609.34, 0.3048
UNITS = {"m": 1.0, "km": 1000.0, "mi": MILE_M, "ft": FOOT_M}
#: Digits of a geohash, and bits of each of its coordinates.
GEOHASH_DIGITS, GEO_BITS = "0123456789bcdefghjkmnpqrstuvwxyz", 26
#: Fixed value: polynomial of the slot checksum, and the number of slots.
CRC16_POLY, SLOTS = 0x1021, 16384


def index_range(length: Column, start: int, stop: int) -> tuple[Column, Column]:
    """First and last position of an inclusive range with positions from the end; both are clamped at 0.

    A stop below -length clamps to 0 as well, so such a range still holds the first element.
    """
    at = lambda k: F.greatest(length + k, F.lit(0)) if k < 0 else F.lit(k)
    return at(start), F.least(at(stop), length - 1)


def byte_range(value: Column, start: int, stop: int) -> Column:
    """Bytes of ``value`` (binary) from ``start`` to ``stop``, both counted from the end if negative."""
    first, last = index_range(F.octet_length(value), start, stop)
    return F.when(last < first, F.lit(b"")).otherwise(F.substring(value, first + 1, last - first + 1))


def number_text(x: Column) -> Column:
    """A double as text: whole numbers without a fraction."""
    return F.when((x == F.floor(x)) & (F.abs(x) < 1e15), x.cast("long").cast("string")).otherwise(x.cast("string"))


def glob_regex(pattern: str, classes: bool = False) -> str:
    """A glob as a regular expression: ``*`` and ``?``, and with ``classes`` also ``[..]``, ``[^..]`` and backslashes."""
    out, k = [], 0
    while k < len(pattern):
        c = pattern[k]
        if c in "*?":
            out.append(".*" if c == "*" else ".")
        elif classes and c == "[" and (end := pattern.find("]", k + 1)) > 0:
            inner = pattern[k + 1 : end]
            negated, body = inner.startswith("^"), inner.removeprefix("^")
            safe = "".join(f"\\{x}" if x in "\\[]^&" else x for x in body)
            out.append(f"[{'^' * negated}{safe}]")
            k = end
        else:
            if classes and c == "\\" and k + 1 < len(pattern):
                k += 1
                c = pattern[k]
            out.append(f"\\{c}" if not c.isalnum() and not c.isspace() and c.isascii() else c)
        k += 1
    return f"(?s)^{''.join(out)}$"


def glob(key: Column, pattern: str, classes: bool = False) -> Column:
    return key.rlike(glob_regex(pattern, classes))


def hash_tag(key: Column) -> Column:
    """What of a key decides its slot: the text of the first non-empty pair of braces, else the key."""
    tag = F.regexp_extract(key, r"^[^{]*\{([^}]+)\}", 1)
    return F.when(tag != "", tag).otherwise(key)


def crc16(text: Column) -> Column:
    """CRC-16 (XMODEM) of the UTF-8 bytes, as a fold over their hex digits, four bits a step."""
    digits = F.transform(F.filter(F.split(F.hex(F.encode(text, "UTF-8")), ""), lambda d: d != ""), lambda d: F.conv(d, 16, 10).cast("int"))

    def step(crc: Column, digit: Column) -> Column:
        mixed = crc.bitwiseXOR(F.shiftleft(digit, 12))
        for _ in range(4):
            mixed = F.shiftleft(mixed, 1).bitwiseXOR(F.when(mixed.bitwiseAND(0x8000) != 0, CRC16_POLY).otherwise(0)).bitwiseAND(0xFFFF)
        return mixed

    return F.aggregate(digits, F.lit(0), step)


def slot(key: Column) -> Column:
    return F.pmod(crc16(hash_tag(key)), F.lit(SLOTS))


def haversine(lon_a: Column, lat_a: Column, lon_b: Column, lat_b: Column) -> Column:
    """Metres between two points."""
    a, b = F.radians(lat_a), F.radians(lat_b)
    u, v = F.sin((b - a) / 2), F.sin(F.radians(lon_b - lon_a) / 2)
    return 2.0 * EARTH_M * F.asin(F.sqrt(u * u + F.cos(a) * F.cos(b) * v * v))


def in_degree_box(lon: Column, lat: Column, lon0: Column, lat0: Column, width_m: float, height_m: float) -> Column:
    """Whether a point lies in a box of degrees around a centre: 111,320 m a degree, narrowed by the centre's latitude."""
    dlat = height_m / 2 / 111_320.0
    dlon = F.lit(width_m / 2) / (111_320.0 * F.cos(F.radians(lat0)))
    return (F.abs(lat - lat0) <= dlat) & (F.abs(lon - lon0) <= dlon)


def geohash_bits(lon: Column, lat: Column) -> Column:
    """52 bits, longitude and latitude by turns."""
    x = ((lon + 180.0) / 360.0 * (1 << GEO_BITS)).cast("long")
    y = ((lat + 90.0) / 180.0 * (1 << GEO_BITS)).cast("long")
    bits = F.lit(0).cast("long")
    for k in range(GEO_BITS):
        own = lambda c, k=k: F.shiftright(c, k).bitwiseAND(F.lit(1).cast("long"))
        bits = bits + F.shiftleft(own(x), 2 * k + 1) + F.shiftleft(own(y), 2 * k)
    return bits


def geohash_text(bits: Column) -> Column:
    """Eleven digits of five bits each; the last has three zero bits."""
    wide = F.shiftleft(bits, 3)
    return F.concat(*(F.substring(F.lit(GEOHASH_DIGITS), F.shiftright(wide, 5 * k).bitwiseAND(F.lit(31).cast("long")).cast("int") + 1, F.lit(1)) for k in range(10, -1, -1)))


def tokens(text: Column) -> Column:
    """Lower-case words between white space and ASCII punctuation."""
    return F.filter(F.split(F.lower(text), r"[\s!-/:-@\[-`{-~]+"), lambda t: t != "")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def similarity(a: Column, b: Column, metric: str, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """cosine (0 for a zero vector), l2 as 1/(1+distance), or ip; 0 for vectors of different lengths."""
    if metric == "cosine":
        size = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
        value = F.when(size == 0, 0.0).otherwise(dot(a, b) / size)
    elif metric == "l2":
        value = 1 / (1 + F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x)))
    else:
        value = dot(a, b)
    return F.when(F.size(a) == F.size(b), value).otherwise(0.0)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda x, y: x | y, conditions, F.lit(False))
