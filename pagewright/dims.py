"""Language sets, spellings, quality profiles and the model catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CYRILLIC = "be ru uk".split()
CJK = "ja zh".split()
KOREAN = ["ko"]
LATIN = (
    "af az bs ca cs cy da de en es et eu fi fr ga gl hr hu id is it jv ku la lb lt lv mi ms mt nl no oc pi pl pt qu rm ro sk sl sq "
    "sr-latn sv sw tl tr uz vi"
).split()
SUPPORTED = [*LATIN, *CYRILLIC, *CJK, *KOREAN]

#: Spellings and the two-letter codes that they stand for.
ALIAS = {
    "bel": "be", "cat": "ca", "ces": "cs", "cze": "cs", "dan": "da", "deu": "de", "ger": "de", "german": "de",
    "eng": "en", "spa": "es", "est": "et", "baq": "eu", "eus": "eu", "fin": "fi", "fra": "fr", "fre": "fr",
    "french": "fr", "glg": "gl", "hrv": "hr", "hun": "hu", "ind": "id", "ice": "is", "isl": "is", "ita": "it",
    "jpn": "ja", "kor": "ko", "korean": "ko", "lit": "lt", "lav": "lv", "dut": "nl", "nld": "nl", "nno": "no",
    "nob": "no", "nor": "no", "pol": "pl", "por": "pt", "ron": "ro", "rum": "ro", "rus": "ru", "slk": "sk", "slo": "sk",
    "slv": "sl", "rs-latin": "sr-latn", "sr-latn": "sr-latn", "swe": "sv", "tur": "tr", "ukr": "uk", "vie": "vi",
    "chi-sim": "zh", "chi-sim-vert": "zh", "zho": "zh",
}

#: Spellings and the three-letter codes that they stand for.
ALIAS3 = {
    "ar": "ara", "ara": "ara", "ben": "ben", "bn": "ben", "bg": "bul", "bul": "bul", "ces": "ces", "cs": "ces",
    "cze": "ces", "da": "dan", "dan": "dan", "de": "deu", "deu": "deu", "ger": "deu", "el": "ell", "ell": "ell",
    "gre": "ell", "en": "eng", "eng": "eng", "est": "est", "et": "est", "fa": "fas", "fas": "fas", "per": "fas",
    "fi": "fin", "fin": "fin", "fr": "fra", "fra": "fra", "fre": "fra", "he": "heb", "heb": "heb", "hi": "hin",
    "hin": "hin", "hr": "hrv", "hrv": "hrv", "hu": "hun", "hun": "hun", "id": "ind", "ind": "ind", "it": "ita",
    "ita": "ita", "ja": "jpn", "jpn": "jpn", "ko": "kor", "kor": "kor", "lav": "lav", "lv": "lav", "lit": "lit",
    "lt": "lit", "may": "msa", "ms": "msa", "msa": "msa", "dut": "nld", "nl": "nld", "nld": "nld", "no": "nor",
    "nor": "nor", "pl": "pol", "pol": "pol", "por": "por", "pt": "por", "ro": "ron", "ron": "ron", "rum": "ron",
    "ru": "rus", "rus": "rus", "sk": "slk", "slk": "slk", "slo": "slk", "sl": "slv", "slv": "slv", "es": "spa",
    "spa": "spa", "sr": "srp", "srp": "srp", "sv": "swe", "swe": "swe", "ta": "tam", "tam": "tam", "te": "tel",
    "tel": "tel", "th": "tha", "tha": "tha", "tr": "tur", "tur": "tur", "uk": "ukr", "ukr": "ukr", "vi": "vie",
    "vie": "vie",
}
WHOLE3 = {"zh-hans": "chi_sim", "zh_cn": "chi_sim", "zh-cn": "chi_sim", "zh-hant": "chi_tra", "zh_tw": "chi_tra", "zh-tw": "chi_tra"}

#: quality, detector, recogniser, detection threshold, box threshold, unclip ratio, batch, longest side, width budget.
PROFILE_COLUMNS = "quality string, detector string, recognizer string, det_threshold double, box_threshold double, unclip double, batch int, max_side int, width_budget int"
PROFILES = [
    ("fast", "v6-tiny-det", "v6-tiny-rec", 0.2, 0.4, 1.4, 16, 960, 12288),
    ("balanced", "v6-small-det", "v6-small-rec", 0.2, 0.45, 1.4, 8, 1280, 8192),
    ("accurate", "v6-small-det", "v6-small-rec", 0.2, 0.45, 1.4, 8, 1600, 8192),
    ("maximum", "v6-medium-det", "v6-medium-rec", 0.2, 0.45, 1.4, 8, 2048, 8192),
]
#: directory, bytes, dictionary entries.
MODELS = [
    ("v6-tiny-det", 1780590, None), ("v5-mobile-det", 4826518, None), ("v6-small-det", 9880512, None),
    ("v6-medium-det", 62032837, None), ("v6-tiny-rec", 4462639, 6904), ("v6-small-rec", 21159378, 18708),
    ("v6-medium-rec", 76554979, 18708), ("v5-eslav-rec", 7887627, 517), ("v5-latin-rec", 8042023, 836),
    ("v5-korean-rec", 13418787, 11945),
]
SPECIALISTS = {"latin": "v5-latin-rec", "cyrillic": "v5-eslav-rec", "korean": "v5-korean-rec"}
PAGE_SEGMENTATION = {"auto": 3, "single_block": 6, "single_line": 7, "sparse_text": 11}


def profiles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PROFILES, PROFILE_COLUMNS)


def models(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MODELS, "model string, bytes long, entries int")


def languages(spark: SparkSession) -> DataFrame:
    """language, pack (latin, cyrillic, cjk or korean)."""
    packs = {"latin": LATIN, "cyrillic": CYRILLIC, "cjk": CJK, "korean": KOREAN}
    return spark.createDataFrame([(c, p) for p, codes in packs.items() for c in codes], "language string, pack string")
