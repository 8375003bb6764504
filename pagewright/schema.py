"""Spark schema of a page's annotation and its fixed domains."""

from __future__ import annotations

from pyspark.sql import types as T

#: Fixed values of the format.
SCHEMA_VERSION = "annotation.v1"  # a producer with a longer name passes its own as a parameter
COORDINATE_SYSTEMS = ["pixel_top_left"]
STATUSES = ["draft", "reviewed", "verified"]
DIRECTIONS = ["auto", "left_to_right", "right_to_left", "vertical"]
LEGIBILITIES = ["clear", "ambiguous", "unreadable"]
SOURCES = ["manual", "model", "imported"]

POINT = T.StructType([T.StructField("x", T.FloatType()), T.StructField("y", T.FloatType())])
QUAD = T.StructType([T.StructField("points", T.ArrayType(POINT))])


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


TEXT, LONG, REAL, FLAG = T.StringType(), T.LongType(), T.FloatType(), T.BooleanType()
WORD = _struct(("id", TEXT), ("quad", QUAD), ("text", TEXT), ("confidence", REAL))
ALTERNATIVE = _struct(("text", TEXT), ("confidence", REAL))
LINE = _struct(
    ("id", TEXT), ("order", LONG), ("quad", QUAD), ("text", TEXT), ("corrected_text", TEXT), ("alternatives", T.ArrayType(ALTERNATIVE)),
    ("confidence", REAL), ("language", TEXT), ("script", TEXT), ("direction", TEXT), ("legibility", TEXT), ("flags", T.ArrayType(TEXT)),
    ("evaluation", _struct(("detection", FLAG), ("recognition", FLAG))), ("source", TEXT), ("words", T.ArrayType(WORD)), ("ignored", FLAG),
)
IMAGE = _struct(("id", TEXT), ("file_name", TEXT), ("width", LONG), ("height", LONG), ("sha256", TEXT))
ENGINE = _struct(("name", TEXT), ("version", TEXT), ("backend", TEXT), ("model", TEXT), ("languages", T.ArrayType(TEXT)), ("elapsed_ms", LONG))
METADATA = _struct(
    ("status", TEXT), ("annotator", TEXT), ("created_at", TEXT), ("updated_at", TEXT), ("engine", ENGINE), ("notes", TEXT),
    ("sensitive", FLAG), ("tags", T.ArrayType(TEXT)), ("group_id", TEXT),
)
ANNOTATION = _struct(
    ("schema_version", TEXT), ("coordinate_system", TEXT), ("image", IMAGE), ("text", TEXT), ("corrected_text", TEXT),
    ("lines", T.ArrayType(LINE)), ("language_hints", T.ArrayType(TEXT)), ("metadata", METADATA),
)

#: Members that an object must have; the others may be missing.
REQUIRED = {
    "": ["schema_version", "coordinate_system", "image", "text", "lines", "language_hints", "metadata"],
    "image": ["id", "file_name", "width", "height"],
    "metadata": ["status"],
    "metadata.engine": ["name", "version", "backend", "languages", "elapsed_ms"],
    "lines": ["id", "order", "quad", "text", "direction", "legibility", "evaluation", "source", "words", "ignored"],
    "lines.evaluation": ["detection", "recognition"],
    "lines.quad": ["points"],
    "lines.words": ["id", "quad", "text"],
    "lines.alternatives": ["text", "confidence"],
}

#: Members with a closed set of values, and whole numbers with bounds.
ENUMS = {
    "coordinate_system": COORDINATE_SYSTEMS, "metadata.status": STATUSES, "lines.direction": DIRECTIONS, "lines.legibility": LEGIBILITIES,
    "lines.source": SOURCES,
}
BOUNDS = {"image.width": 2**32 - 1, "image.height": 2**32 - 1, "lines.order": 2**32 - 1, "metadata.engine.elapsed_ms": 2**63 - 1}
#: Members that may be missing but not null.
NOT_NULL = ["lines.alternatives", "lines.flags", "metadata.tags", "metadata.sensitive"]
