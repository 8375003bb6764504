"""Language columns: spellings, requests, plans of recognisers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewright import dims
from pagewright.functions.text import script_tag, utrim


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def _member(code: Column, codes: list[str]) -> Column:
    return code.isin(codes)


def normalize_language(raw: Column) -> Column:
    """Two-letter code: trimmed, small letters, `_` as `-`; a known spelling, else the part before the first `-`."""
    s = F.replace(F.lower(utrim(raw)), F.lit("_"), F.lit("-"))
    return F.coalesce(_lookup(dims.ALIAS, s), F.split_part(s, F.lit("-"), F.lit(1)))


def normalize_language3(raw: Column) -> Column:
    """Three-letter code: whole spellings of Chinese, else the part before `-` or `_`, else the text itself."""
    s = F.lower(utrim(raw))
    head = F.regexp_extract(s, "^[^-_]*", 0)
    return F.coalesce(_lookup(dims.WHOLE3, s), _lookup(dims.ALIAS3, head), s)


def is_auto(request: Column) -> Column:
    """An empty request, or the single word auto."""
    return (F.size(request) == 0) | (F.size(request) == 1) & (F.lower(utrim(F.get(request, F.lit(0)))) == "auto")


def resolve_languages(request: Column) -> Column:
    """Codes of a request without repeats, in order; empty for automatic."""
    codes = F.array_distinct(F.transform(request, normalize_language))
    return F.when(is_auto(request), F.array().cast("array<string>")).otherwise(codes)


def unsupported_languages(request: Column) -> Column:
    """Entries, as spelled, that no pack covers; empty for automatic."""
    bad = F.filter(request, lambda r: ~_member(normalize_language(r), dims.SUPPORTED))
    return F.when(is_auto(request), F.array().cast("array<string>")).otherwise(bad)


def resolve_languages3(request: Column, installed: Column) -> Column:
    """Codes for the external program: without a request English, or else the first installed one but `osd`."""
    first = F.get(F.filter(installed, lambda c: c != "osd"), F.lit(0))
    default = F.when(F.array_contains(installed, "eng"), F.lit("eng")).otherwise(first)
    codes = F.array_distinct(F.transform(request, normalize_language3))
    return F.when(F.size(request) == 0, F.array_compact(F.array(default))).otherwise(codes)


def split_languages(text: Column) -> Column:
    """Codes of a comma, semicolon or space separated list; here auto is no special word."""
    parts = F.filter(F.split(text, r"[\s,;]+"), lambda p: p != "")
    return F.array_distinct(F.transform(parts, normalize_language))


def profile_allows(quality: Column, codes: Column) -> Column:
    """The fast profile cannot read Japanese."""
    return ~((quality == "fast") & F.array_contains(codes, "ja"))


def recognizer_plan(codes: Column) -> Column:
    """Which recognisers a request needs: struct of primary, latin, cyrillic, korean."""
    any_of = lambda pack: F.exists(codes, lambda c: _member(c, pack))
    auto = F.size(codes) == 0
    latin_group, cyrillic, cjk, korean = any_of(dims.LATIN), any_of(dims.CYRILLIC), any_of(dims.CJK), any_of(dims.KOREAN)
    latin = F.exists(codes, lambda c: _member(c, dims.LATIN) & (c != "en"))
    groups = sum((g.cast("int") for g in (latin_group, cyrillic, cjk, korean)), F.lit(0))
    primary = cjk | (groups > 1) | (latin_group & ~latin)
    return F.struct(
        (auto | primary).alias("primary"), (auto | latin).alias("latin"), (auto | cyrillic).alias("cyrillic"), (auto | korean).alias("korean")
    )


def _among(codes: Column, pack: list[str]) -> Column:
    return F.filter(codes, lambda c: _member(c, pack))


def line_language(text: Column, hints: Column) -> Column:
    """The one hinted language that fits the line's script. Without hints only scripts of one language decide."""
    tag = script_tag(text)
    by_tag = {"Cyrl": dims.CYRILLIC, "Kore": dims.KOREAN, "Jpan": ["ja"], "Hani": dims.CJK, "Latn": dims.LATIN}
    fit = F.array().cast("array<string>")
    for t, pack in by_tag.items():
        fit = F.when(tag == t, _among(hints, pack)).otherwise(fit)
    single = F.when(F.size(fit) == 1, F.get(fit, F.lit(0)))
    alone = F.when(tag == "Kore", F.lit("ko")).when(tag == "Jpan", F.lit("ja"))
    return F.when(F.size(hints) == 0, alone).otherwise(single)


