"""Sizes and orientation of images from their headers, without a decoder: PNG, BMP, JPEG, TIFF and WebP.

Files are walked as columns: a fold follows length-prefixed segments, a filter goes through a directory of tags. Only the
bytes that a step names are looked at; places count from 1.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewright.functions.let import let

#: Segments or chunks that are followed at most: a file with more before its size has no size.
STEPS = 2000
#: Tags of a directory.
WIDTH, HEIGHT, ORIENTATION = "0100", "0101", "0112"
_STATE = "struct<at: bigint, found: bigint, exif: bigint>"


def _hex(content: Column, at: Column | int, size: int) -> Column:
    return F.hex(F.substring(content, F.lit(at) if isinstance(at, int) else at.cast("int"), F.lit(size)))


def _turned(digits: Column, size: int) -> Column:
    """Pairs of hexadecimal digits in reverse order."""
    return F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(size))])


def number(content: Column, at: Column | int, size: int, little: Column | bool = False) -> Column:
    """A whole number of some bytes; null beyond the end of the file."""
    digits = _hex(content, at, size)
    whole = F.when(F.length(digits) == 2 * size, digits)
    if not isinstance(little, bool):
        whole = F.when(little, _turned(whole, size)).otherwise(whole)
    elif little:
        whole = _turned(whole, size)
    return F.conv(whole, 16, 10).cast("long")


def _walk(content: Column, start: int, step) -> Column:
    """at, found, exif after following segments until `at` is null or STEPS are done."""
    state = F.struct(F.lit(start).cast("long").alias("at"), F.lit(None).cast("long").alias("found"), F.lit(None).cast("long").alias("exif")).cast(_STATE)
    most = F.least(F.lit(STEPS), (F.octet_length(content) / 2).cast("int"))
    return F.aggregate(F.sequence(F.lit(0), most), state, lambda s, _: F.when(s["at"].isNull() | (s["at"] > F.octet_length(content)), s).otherwise(step(s)).cast(_STATE))


def _jpeg(content: Column) -> Column:
    """found: the frame header; exif: the directory within the first Exif segment."""

    def step(s: Column) -> Column:
        at, mark = s["at"], _hex(content, s["at"], 2)
        frame = mark.rlike("^FFC[0-35-79-BD-F]$")
        exif = (mark == "FFE1") & (_hex(content, at + 4, 6) == "457869660000") & s["exif"].isNull()
        following = (
            F.when(~mark.startswith("FF") | frame | mark.isin("FFD9", "FFDA"), F.lit(None).cast("long")).when(mark == "FFFF", at + 1).when(mark.rlike("^FF(D[0-7]|01)$"), at + 2)
        ).otherwise(at + 2 + F.greatest(number(content, at + 2, 2), F.lit(2)))
        return F.struct(following.alias("at"), F.when(frame, at).alias("found"), F.when(exif, at + 10).otherwise(s["exif"]).alias("exif"))

    return _walk(content, 3, step)


def _chunk(content: Column, start: int, want: str, length_first: bool) -> Column:
    """exif: where the data of the first wanted chunk starts. PNG gives length, name, data and a checksum; WebP name, length
    and data that is filled up to an even size."""

    def step(s: Column) -> Column:
        at = s["at"]
        name, size = _hex(content, at + 4 if length_first else at, 4), number(content, at if length_first else at + 4, 4, not length_first)
        met = name == want
        following = F.when(~met, at + 8 + size + (F.lit(4) if length_first else size % 2))
        return F.struct(following.alias("at"), F.lit(None).cast("long").alias("found"), F.when(met, at + 8).alias("exif"))

    return _walk(content, start, step)["exif"]


def _tag(content: Column, base: Column, tag: str) -> Column:
    """The value of a tag in the first directory of a TIFF structure that starts at `base`; null without it."""

    def within(d: Column) -> Column:
        little, at, n = d["little"], d["at"], F.least(number(content, d["at"], 2, d["little"]), F.lit(65535))
        places = F.transform(F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)), lambda i: at + 2 + i * 12)
        name = F.when(little, tag[2:] + tag[:2]).otherwise(F.lit(tag))
        met = F.filter(places, lambda p: _hex(content, p, 2) == name)
        value = lambda p: F.when(number(content, p + 2, 2, little) == 3, number(content, p + 8, 2, little)).otherwise(number(content, p + 8, 4, little))
        return F.get(F.transform(met, value), F.lit(0))

    def directory(b: Column) -> Column:
        little = _hex(content, b, 2) == "4949"
        known = _hex(content, b, 4).isin("49492A00", "4D4D002A")
        return let(F.when(known, F.struct(little.alias("little"), (b + number(content, b + 4, 4, little)).alias("at"))), within)

    return let(base.cast("long"), directory)


def _size(width: Column, height: Column) -> Column:
    return F.struct(width.cast("long").alias("width"), height.cast("long").alias("height"))


def _webp_size(content: Column) -> Column:
    name, low = _hex(content, 13, 4), 16383
    plain = _size(number(content, 27, 2, True).bitwiseAND(low), number(content, 29, 2, True).bitwiseAND(low))
    lossless = let(number(content, 22, 4, True), lambda bits: _size(bits.bitwiseAND(low) + 1, F.shiftright(bits, 14).bitwiseAND(low) + 1))
    extended = _size(number(content, 25, 3, True) + 1, number(content, 28, 3, True) + 1)
    return F.when((name == "56503820") & (_hex(content, 24, 3) == "9D012A"), plain).when((name == "5650384C") & (_hex(content, 21, 1) == "2F"), lossless).when(name == "56503858", extended)


def header_size(content: Column, kind: Column) -> Column:
    """struct of width and height as stored, by format; null if the header does not tell."""
    found = (
        F.when(kind == "png", _size(number(content, 17, 4), number(content, 21, 4)))
        .when(kind == "bmp", _size(_signed(number(content, 19, 4, True)), _signed(number(content, 23, 4, True))))
        .when(kind == "jpeg", let(_jpeg(content)["found"], lambda at: _size(number(content, at + 7, 2), number(content, at + 5, 2))))
        .when(kind == "tiff", _size(_tag(content, F.lit(1), WIDTH), _tag(content, F.lit(1), HEIGHT)))
        .when(kind == "webp", _webp_size(content))
    )
    return let(found, lambda f: F.when(f["width"].isNotNull() & f["height"].isNotNull(), f))


def _signed(value: Column) -> Column:
    """Size of a number of 32 bits with a sign: rows from the top down have a negative height."""
    return F.abs(F.when(value >= 2**31, value - 2**32).otherwise(value))


def orientation(content: Column, kind: Column) -> Column:
    """1 to 8 by the Exif tag; 1 if there is none or another value."""
    at = (
        F.when(kind == "jpeg", _jpeg(content)["exif"])
        .when(kind == "tiff", F.lit(1).cast("long"))
        .when(kind == "webp", _chunk(content, 13, "45584946", False))
        .when(kind == "png", _chunk(content, 9, "65584966", True))
    )
    # an Exif chunk may repeat the six bytes that a JPEG segment starts with
    base = let(at, lambda a: F.when(_hex(content, a, 6) == "457869660000", a + 6).otherwise(a))
    value = _tag(content, base, ORIENTATION)
    return let(value, lambda v: F.when(v.between(1, 8), v).otherwise(F.lit(1))).cast("int")


def turned_size(size: Column, turn: Column) -> Column:
    """Width and height after the orientation is applied."""
    return let(size, lambda s: F.when(turn >= 5, _size(s["height"], s["width"])).otherwise(s))
