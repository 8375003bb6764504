"""Text columns: Unicode trimming, tokens, scripts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed code point ranges, as Java regular expressions.
RANGES = {
    "Cyrillic": r"Ѐ-ԯ",
    "Latin": r"A-Za-zÀ-ɏḀ-ỿ",
    "Korean": r"ᄀ-ᇿ㄰-㆏가-힯",
    "Kana": r"぀-ヿ",
    "Han": r"㐀-鿿",
}


def utrim(text: Column) -> Column:
    """Without white space, in the Unicode sense, at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def is_blank(text: Column) -> Column:
    return utrim(text) == ""


def tokens(text: Column) -> Column:
    """Words between Unicode white space."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def contains_script(text: Column, script: str) -> Column:
    return text.rlike(f"[{RANGES[script]}]")


def has_letter(text: Column) -> Column:
    return text.rlike(r"\p{IsAlphabetic}")


def script_tag(text: Column) -> Column:
    """ISO 15924 tag of the first script in a fixed order that the text holds; null without a letter."""
    return (
        F.when(contains_script(text, "Cyrillic"), "Cyrl")
        .when(contains_script(text, "Korean"), "Kore")
        .when(contains_script(text, "Kana"), "Jpan")
        .when(contains_script(text, "Han"), "Hani")
        .when(has_letter(text), "Latn")
    )


def script_fraction(text: Column, script: str) -> Column:
    """Share of the letters that belong to the script; 0 without letters."""
    letters = F.regexp_count(text, F.lit(r"\p{IsAlphabetic}"))
    own = F.regexp_count(text, F.lit(rf"[{RANGES[script]}&&\p{{IsAlphabetic}}]"))
    return F.when(letters == 0, F.lit(0.0)).otherwise(own / letters)


def file_stem(path: Column) -> Column:
    """File name without folder and last extension; `image` if nothing is left."""
    name = F.regexp_extract(path, r"([^/\\]*)$", 1)
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    return F.when(stem == "", "image").otherwise(stem)


def line_id(number: Column) -> Column:
    return F.format_string("line-%04d", number)


def word_id(line: Column, number: Column) -> Column:
    return F.format_string("%s-word-%04d", line, number)
