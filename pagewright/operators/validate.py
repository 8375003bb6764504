"""Rules of an annotation document as one array of errors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewright.functions.geometry import signed_area
from pagewright.functions.text import utrim
from pagewright.schema import COORDINATE_SYSTEMS, SCHEMA_VERSION

MIN_AREA = 0.5
FINAL = ["reviewed", "verified"]
#: The wording of the most common errors, which users of the format search for.
EMPTY, TWICE, RANGE = "must not be empty", "is duplicated", "must be between 0 and 1"
_NONE = "array<string>"


def _none() -> Column:
    return F.array().cast(_NONE)


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _check(bad: Column, message: Column | str) -> Column:
    """array of the message, or empty."""
    return F.when(F.coalesce(bad, F.lit(False)), F.array(F.lit(message) if isinstance(message, str) else message)).otherwise(_none())


def _blank(value: Column) -> Column:
    return utrim(value) == ""


def _missing(value: Column) -> Column:
    return value.isNull() | _blank(value)


def _again(values: Column, blanks: bool = True) -> Column:
    """array of (i, v): the entries that stand before already, by place i; blanks: whether blank texts count.

    Equal entries lie together after a sort, so that the work grows with n log n. Nothing in a lambda but its own
    arguments: an expression over the whole array there would be computed anew for each entry.
    """
    keyed = F.transform(values, lambda v, i: F.struct(v.alias("v"), i.alias("i")))
    ordered = F.array_sort(keyed if blanks else F.filter(keyed, lambda e: ~_missing(e["v"])))
    shifted = F.transform(F.array(ordered), lambda o: F.zip_with(o, F.concat(F.array(F.get(o, F.lit(0))), o), lambda b, a: F.when((a["v"] == b["v"]) & (a["i"] < b["i"]), F.struct(b["i"].alias("i"), b["v"].alias("v")))))
    return F.array_sort(F.array_compact(F.get(shifted, F.lit(0))))


def unique_texts(values: Column, path: Column | str) -> Column:
    """Blank entries and repeats, by index."""
    values = F.coalesce(values, _none())
    said = lambda i, message: F.struct(i.alias("i"), _text(path, "[", i, message).alias("m"))
    blank = F.array_compact(F.transform(values, lambda v, i: F.when(_missing(v), said(i, f"] {EMPTY}"))))
    again = F.transform(_again(values, blanks=False), lambda e: said(e["i"], f"] {TWICE}"))
    return F.transform(F.array_sort(F.concat(blank, again)), lambda e: e["m"])


def confidence_errors(value: Column, path: Column) -> Column:
    return _check(value.isNotNull() & (F.isnan(value) | (value < 0) | (value > 1)), _text(path, ".confidence " + RANGE))


def quad_errors(quad: Column, width: Column, height: Column, path: Column) -> Column:
    """Four finite points within the image around an area."""
    points = quad["points"]
    number = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    outside = lambda p: number(p["x"]) | number(p["y"]) | (p["x"] < 0) | (p["y"] < 0) | (p["x"] > width) | (p["y"] > height)
    exact = F.transform(points, lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y")))
    wrong = F.exists(points, outside)
    return F.concat(
        _check(F.coalesce(F.size(points), F.lit(0)) != 4, _text(path, " must have four points")),
        _check(wrong, _text(path, " must lie within the image")),
        _check((F.size(points) == 4) & ~wrong & (F.abs(signed_area(exact)) < MIN_AREA), _text(path, " must enclose an area")),
    )


def _repeats(ids: Column, what: str) -> Column:
    """Ids that stand before, each at its place; blank ones are left to another rule."""
    return F.transform(_again(ids, blanks=False), lambda e: _text(what, e["v"], f" {TWICE}"))


def line_errors(line: Column, at: Column, width: Column, height: Column, final: Column) -> Column:
    path = _text("lines[", at, "]")
    words = F.coalesce(line["words"], F.slice(line["words"], 1, 0))
    in_word = lambda w, i: F.concat(
        _check(_missing(w["id"]), _text(path, ".words[", i, "].id " + EMPTY)),
        quad_errors(w["quad"], width, height, _text(path, ".words[", i, "].quad")),
        confidence_errors(w["confidence"], _text(path, ".words[", i, "]")),
    )
    options = F.transform(
        line["alternatives"],
        lambda a, i: F.concat(
            _check(_missing(a["text"]), _text(path, ".alternatives[", i, "].text " + EMPTY)),
            confidence_errors(a["confidence"], _text(path, ".alternatives[", i, "]")),
        ),
    )
    unread = final & ~F.coalesce(line["ignored"], F.lit(False)) & F.coalesce(line["evaluation"]["recognition"], F.lit(True))
    return F.concat(
        _check(_missing(line["id"]), _text(path, ".id " + EMPTY)),
        quad_errors(line["quad"], width, height, _text(path, ".quad")),
        confidence_errors(line["confidence"], path),
        _check(_blank(line["language"]), _text(path, ".language " + EMPTY)),
        _check(_blank(line["script"]), _text(path, ".script " + EMPTY)),
        unique_texts(line["flags"], _text(path, ".flags")),
        F.coalesce(F.flatten(options), _none()),
        _check(unread & _missing(F.coalesce(line["corrected_text"], line["text"])), _text(path, ".text " + EMPTY)),
        F.coalesce(F.flatten(F.transform(words, in_word)), _none()),
    )


def visible_text(lines: Column, field: str = "text") -> Column:
    """Trimmed text of the lines that are neither ignored nor blank, by order, joined by newlines."""
    shown = lambda n: utrim(F.coalesce(n["corrected_text"], n["text"])) if field == "corrected" else utrim(n["text"])
    kept = F.filter(lines, lambda n: ~F.coalesce(n["ignored"], F.lit(False)) & (shown(n) != ""))
    keyed = F.transform(kept, lambda n, i: F.struct(n["order"].alias("o"), i.alias("i"), shown(n).alias("t")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda e: e["t"]), "\n")


def document_errors(doc: Column, version: str = SCHEMA_VERSION) -> Column:
    """All errors of an annotation struct, in the order of its members; empty if it is valid. version: compared whole."""
    image, lines, meta = doc["image"], doc["lines"], doc["metadata"]
    width, height = image["width"], image["height"]
    final = F.coalesce(meta["status"].isin(FINAL), F.lit(False))
    orders = F.transform(lines, lambda n: n["order"])
    repeated = F.transform(_again(orders), lambda e: _text("lines[", e["i"], "].order ", e["v"], f" {TWICE}"))
    ids = F.flatten(F.transform(lines, lambda n: F.concat(F.array(n["id"]), F.coalesce(F.transform(n["words"], lambda w: w["id"]), _none()))))
    each = F.transform(lines, lambda n, i: line_errors(n, i, width, height, final))
    return F.concat(
        _check(~F.coalesce(doc["schema_version"] == version, F.lit(False)), f"schema_version is not {version}"),
        _check(~F.coalesce(doc["coordinate_system"].isin(COORDINATE_SYSTEMS), F.lit(False)), "coordinate_system is not supported"),
        _check(_missing(image["id"]), "image.id " + EMPTY),
        _check(_missing(image["file_name"]), f"image.file_name {EMPTY}"),
        _check(F.coalesce((width <= 0) | (height <= 0), F.lit(True)), "image width and height must be positive"),
        _check(~image["sha256"].rlike("^[0-9a-f]{64}$"), "image.sha256 is no SHA-256 in small hexadecimal digits"),
        unique_texts(doc["language_hints"], "language_hints"),
        unique_texts(meta["tags"], "metadata.tags"),
        _check(_blank(meta["group_id"]), f"metadata.group_id {EMPTY}"),
        F.coalesce(_repeats(ids, "id "), _none()),
        F.coalesce(repeated, _none()),
        F.coalesce(F.flatten(each), _none()),
        _check(final & (doc["text"] != visible_text(lines)), "text differs from the visible lines in order"),
    )
