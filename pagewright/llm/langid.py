"""Language identification in two steps: family first, then one-versus-one classifiers within the family.

Features are hashed counts of byte triples of the whole text; both steps are linear support vector machines
(squared hinge), fitted on the driver on a bounded sample of labelled rows and applied in the executors.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagewright.llm.common import crc_mod

BITS = 12
#: Families of common languages. Any other language is a family of its own.
FAMILIES = {
    "af": "germanic", "da": "germanic", "de": "germanic", "en": "germanic", "is": "germanic", "nl": "germanic",
    "no": "germanic", "sv": "germanic", "ca": "romance", "es": "romance", "fr": "romance", "gl": "romance",
    "it": "romance", "la": "romance", "oc": "romance", "pt": "romance", "ro": "romance", "be": "slavic",
    "bg": "slavic", "cs": "slavic", "hr": "slavic", "pl": "slavic", "ru": "slavic", "sk": "slavic", "sl": "slavic",
    "sr": "slavic", "uk": "slavic", "et": "uralic", "fi": "uralic", "hu": "uralic", "lt": "baltic", "lv": "baltic",
}
#: Bytes that are not part of a word become a space; capitals become small.
_CLEAN = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def features(text: bytes) -> np.ndarray:
    """Counts of hashed byte triples, damped and of length 1."""
    a = np.frombuffer(b" " + text.translate(_CLEAN) + b" ", dtype=np.uint8).astype(np.uint32)
    triples = (a[:-2] << 16) + (a[1:-1] << 8) + a[2:]
    counts = np.bincount((triples * np.uint32(2654435761)) >> np.uint32(32 - BITS), minlength=1 << BITS)
    x = np.sqrt(counts.astype(np.float32))
    return x / max(1e-9, float(np.sqrt((x * x).sum())))


def fit_svm(x: np.ndarray, y: np.ndarray, rounds: int = 80, ridge: float = 1e-4) -> np.ndarray:
    """Weights (bias last) of a linear machine with squared hinge loss, by accelerated gradient steps. y: -1 or 1."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    y = y.astype(np.float32)  # single precision throughout, else each product copies x
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w = v = np.zeros(x.shape[1], np.float32)
    for k in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ v)) * share * y
        new = v + 1.0 * (x.T @ slack - ridge * v)
        v = new + (k / (k + 3)) * (new - w)
        w = new
    return w


def fit(x: np.ndarray, langs: list[str]) -> dict:
    """The machines: one against the rest for each family, and one for each pair of languages of a family."""
    names = sorted(set(langs))
    family = {n: FAMILIES.get(n, n) for n in names}
    label = np.array([family[n] for n in langs])
    one = np.array(langs)
    families = sorted(set(family.values()))
    model = {"families": families, "members": {f: [n for n in names if family[n] == f] for f in families}, "pairs": {}}
    model["weights"] = [fit_svm(x, np.where(label == f, 1, -1)) for f in families] if len(families) > 1 else []
    for f in families:
        for a, b in combinations(model["members"][f], 2):
            rows = (one == a) | (one == b)
            model["pairs"][a, b] = fit_svm(x[rows], np.where(one[rows] == a, 1, -1))
    return model


def predict(model: dict, text: str | None) -> tuple[str, float]:
    """The language and a score from 0 to 1; `und` and 0 without a letter or without a model."""
    if not text or not model["families"] or not any(map(str.isalpha, text)):
        return "und", 0.0
    x = features(text.encode())
    at, score = 0, 1.0
    if model["weights"]:
        margins = [float(w[:-1] @ x + w[-1]) for w in model["weights"]]
        at = int(np.argmax(margins))
        rest = max(m for i, m in enumerate(margins) if i != at)
        score = 1 / (1 + np.exp(-3 * (margins[at] - rest)))
    members = model["members"][model["families"][at]]
    votes = dict.fromkeys(members, 0.0)
    for a, b in combinations(members, 2):
        w = model["pairs"][a, b]
        p = 1 / (1 + np.exp(-6 * float(w[:-1] @ x + w[-1])))
        votes[a] += p
        votes[b] += 1 - p
    best = max(members, key=lambda n: (votes[n], n))
    share = votes[best] / (len(members) - 1) if len(members) > 1 else 1.0
    return best, float(score * share)


def sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_lang: int, languages: int, rows: int) -> DataFrame:
    """lang, text: training rows of the `languages` most frequent labels, of each the per_lang (or rows / number of
    labels, if that is less) distinct rows with the least hash of id and text. Only counts reach the driver."""
    named = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (crc_mod(F.col(id_col), 4) != 2))
    named = named.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("h"))
    counts = {r[0]: r[1] for r in named.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).collect()}
    if not counts:
        return named.limit(0).select("lang", "text")
    each = max(1, min(per_lang, rows // len(counts)))
    # twice the rows wanted, so that ranks sort few rows; equal rows count once, however many there are
    share = F.create_map(*[F.lit(v) for k, n in counts.items() for v in (k, min(1.0, 2 * each / n))])
    drawn = named.filter(F.pmod("h", F.lit(1_000_000)) / 1_000_000 < F.element_at(share, F.col("lang")))
    drawn = drawn.groupBy("lang", "h").agg(F.min("text").alias("text"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    return drawn.withColumn("place", place).filter(F.col("place") <= each).select("lang", "text")


def train(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    per_lang: int = 300,
    languages: int = 100,
    rows: int = 4000,
) -> dict:
    """A model from rows whose crc32(id) mod 4 is not 2. The bounds of the sample are per_lang rows of a language, the
    `languages` most frequent labels, and `rows` in all, so that the fit holds about 2 * rows * 16 KB.

    Each sampled text counts twice: as a whole, and as a piece of 80 bytes from its middle, as short texts are. Without
    a labelled row the model predicts `und` throughout.
    """
    bits = BITS

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for lang, text in zip(b["lang"], b["text"]):
                if any(map(str.isalpha, text)):
                    raw = text.encode()
                    middle = max(0, len(raw) // 2 - 40)
                    for part in (raw, raw[middle : middle + 80]):
                        out.append((lang, features(part).astype("<f4").tobytes()))
            if out:
                yield pd.DataFrame(out, columns=["lang", "x"])

    chosen = sample(docs, id_col, text_col, lang_col, per_lang, languages, rows)
    found = chosen.mapInPandas(run, "lang string, x binary").toPandas().sort_values(["lang", "x"])
    if not len(found):
        return {"families": [], "members": {}, "pairs": {}, "weights": []}
    x = np.frombuffer(b"".join(map(bytes, found["x"])), dtype="<f4").reshape(len(found), 1 << bits)
    return fit(x, found["lang"].tolist())


def _guessed(docs: DataFrame, model: dict, text_col: str) -> DataFrame:
    """_row (all columns of docs, so that no name clashes) and _guess (lang, score)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def guess(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([predict(shared.value, t) for t in texts], columns=["lang", "score"])

    return docs.select(F.struct("*").alias("_row"), guess(F.col(text_col).cast("string")).alias("_guess"))


def identify(docs: DataFrame, model: dict, text_col: str = "text", out: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with the predicted language and its score, which replace columns of these names. Only the text is looked at."""
    kept = [F.col("_row")[c].alias(c) for c in docs.columns if c not in (out, score)]
    return _guessed(docs, model, text_col).select(*kept, F.col("_guess.lang").alias(out), F.col("_guess.score").alias(score))


def language_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row; see train() and predict().

    Null texts and texts without a letter are `und` with score 0. Of equal votes the greater language name wins, of equal
    families the first. Repeated rows have a row each; an empty table gives an empty result; other columns are ignored.
    """
    model = train(docs, id_col, text_col, lang_col, **options)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return identify(rows, model).select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """The rows with a language, as they were; a missing language is filled in. Rows that are `und` go."""
    model = train(docs, id_col, text_col, lang_col, **options)
    kept = _guessed(docs, model, text_col).filter(F.col("_guess.lang") != "und")
    lang = F.coalesce(F.col("_row")[lang_col], F.col("_guess.lang"))
    return kept.select(F.col("_row").withField(lang_col, lang).alias("_row")).select("_row.*")
