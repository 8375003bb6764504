"""Image files and bytes: sizes, formats, checksums, and model files' dictionaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions.let import let
from pagewright.functions.text import file_stem
from pagewright.sources.headers import header_size, orientation, turned_size

MAX_BYTES = 256 * 1024 * 1024
MAX_PIXELS = 50_000_000
#: Limits of the browser's engine.
MAX_BROWSER_BYTES = 50 * 1024 * 1024
#: Fixed first bytes (hex) of each format.
MAGIC = {"png": "89504E470D0A1A0A", "jpeg": "FFD8FF", "bmp": "424D", "tiff": "49492A00"}


def read_images(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """image_id, file_name, path, length, content of the files that are neither empty nor too large."""
    files = spark.read.format("binaryFile").load(path).filter((F.col("length") > 0) & (F.col("length") <= max_bytes))
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    return files.select(file_stem(F.col("path")).alias("image_id"), name.alias("file_name"), "path", "length", "content")


def image_format(content: Column) -> Column:
    """Format by first bytes, whatever the name says; null if unknown."""
    head = F.hex(F.substring(content, 1, 12))
    out = F.when(head.startswith("52494646") & F.substring(head, 17, 8).eqNullSafe("57454250"), "webp").when(head.startswith("4D4D002A"), "tiff")
    for name, magic in MAGIC.items():
        out = out.when(head.startswith(magic), name)
    return out


def image_size(content: Column) -> Column:
    """width, height as stored, from the header; null if it does not tell."""
    return header_size(content, image_format(content))


def image_orientation(content: Column) -> Column:
    """1 to 8 by the image's Exif data, 1 without."""
    return orientation(content, image_format(content))


def image_header(content: Column) -> Column:
    """format, width, height as stored, orientation, and the size that is shown once the orientation is applied."""
    kind = image_format(content)
    read = F.struct(kind.alias("format"), header_size(content, kind).alias("size"), orientation(content, kind).alias("orientation"))
    return let(
        read,
        lambda r: F.struct(r["format"].alias("format"), r["size"].alias("size"), r["orientation"].alias("orientation"), turned_size(r["size"], r["orientation"]).alias("shown")),
    )


def image_errors(content: Column, max_bytes: int = MAX_BYTES, max_pixels: int = MAX_PIXELS) -> Column:
    """Why an image is refused before it is decoded; null if it is not. Limits must be over 0."""
    if max_bytes <= 0 or max_pixels <= 0:
        raise ValueError("image limits must be over 0")
    pixels = let(image_size(content), lambda s: s["width"] * s["height"])
    return (
        F.when(content.isNull() | (F.octet_length(content) == 0), "image is empty")
        .when(F.octet_length(content) > max_bytes, "image has too many bytes")
        .when(image_format(content).isNull(), "image format is not supported")
        .when(pixels == 0, "image has no pixels")
        .when(pixels > max_pixels, "image has too many pixels")
    )


def sha256_hex(content: Column) -> Column:
    return F.sha2(content, 256)


def verify_files(files: DataFrame, expected: DataFrame) -> DataFrame:
    """name, status of each expected file: ok, missing, size or checksum.

    files: name, content. expected: name, bytes, sha256.
    """
    have = files.select("name", F.octet_length("content").cast("long").alias("_n"), sha256_hex(F.col("content")).alias("_sha"))
    status = F.when(F.col("_n").isNull(), "missing").when(F.col("_n") != F.col("bytes"), "size").when(F.col("_sha") != F.col("sha256"), "checksum")
    return expected.join(have, "name", "left").select("name", status.otherwise("ok").alias("status"))


def read_dictionary(files: DataFrame, key: str = "model", text: str = "text", heading: str = "  character_dict:") -> DataFrame:
    """key, position (1-based), entry of the list that follows the heading line in a settings file.

    Items are `  - value`, bare, in single quotes ('' stands for one) or in double quotes (as JSON). The list ends at
    the first line of another form. An item that is empty or spans lines has a null entry.
    """
    lines = files.select(key, F.split(text, "\r?\n").alias("l"))
    start = F.array_position("l", heading)
    after = F.when(start > 0, F.slice("l", (start + 1).cast("int"), F.size("l"))).otherwise(F.array().cast("array<string>"))
    stop = F.array_position(F.transform(after, lambda s: s.startswith("  - ")), False)
    items = F.when(stop > 0, F.slice(after, F.lit(1), (stop - 1).cast("int"))).otherwise(after)
    rows = lines.select(key, F.posexplode(items).alias("n", "raw"))
    raw = F.substring(F.col("raw"), 5, 2**31 - 1)
    single = F.replace(F.regexp_extract(raw, r"^'(.*)'$", 1), F.lit("''"), F.lit("'"))
    double = F.get(F.from_json(F.concat(F.lit("["), raw, F.lit("]")), "array<string>"), F.lit(0))
    value = F.when(raw.rlike("^'.*'$"), single).when(raw.startswith('"'), double).otherwise(raw)
    usable = (value != "") & ~value.contains("\n")
    return rows.select(key, (F.col("n") + 1).alias("position"), F.when(usable, value).alias("entry"))


def dictionary_status(entries: DataFrame, expected: DataFrame, key: str = "model") -> DataFrame:
    """key, status of each expected dictionary: ok, missing (no list), entry (one is empty or spans lines) or count.

    entries: as from read_dictionary. expected: key, entries (how many there must be).
    """
    have = entries.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col("entry").isNull()).alias("_bad"))
    status = F.when(F.col("_n").isNull(), "missing").when(F.col("_bad") > 0, "entry").when(F.col("_n") != F.col("entries"), "count")
    return expected.join(have, key, "left").select(key, status.otherwise("ok").alias("status"))
