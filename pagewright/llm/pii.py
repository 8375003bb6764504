"""Personal data: high-recall generators, boosted trees and calibrated thresholds.

Base patterns (email, ip, card, phone) are reported always. Further generators propose spans of looser forms, such
as phone numbers without a country code, number groups of identity cards and accounts, or written-out addresses;
they overlap the base spans and one another. Boosted trees score each proposal by its form and its surroundings.
They learn from two sources: synthetic sentences with planted values and look-alikes (dates, versions, prices,
part numbers), and a bounded sample of the corpus in which base matches that pass their check are positive and
those that fail it are negative. A threshold for each loose generator, set on held-out proposals of that generator
alone, selects the redactions, so that the number of base matches in a corpus does not move it.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.boosting import BoostedTrees, threshold_for
from pagewright.llm.common import map_rows
from pagewright.session import stored

#: Fixed base patterns, in the order in which kinds are listed.
BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    # the look-behind only spares the search the rest of a long run of digits: a match always starts a run
    "ip": re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)"),
    "card": re.compile(r"[0-9](?:[\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
#: Looser forms that the trees judge.
LOOSE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]| at ) ?[A-Za-z0-9-]{1,64} ?(?:\(dot\)|\[dot\]| dot ) ?[A-Za-z]{2,12}"),
    "phone": re.compile(r"(?<![\w+.-])\(?0?[0-9]{3}\)?[ ./-][0-9]{3}[ ./-][0-9]{3,4}(?![\w-])"),
    "card": re.compile(r"(?<![\w.-])[0-9]{4}[./][0-9]{4}[./][0-9]{4}[./][0-9]{4}(?![\w-])"),
    "id": re.compile(r"(?<![\w+.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])"),
    "iban": re.compile(r"(?<![\w])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\w])"),
}
KINDS = ["email", "ip", "card", "phone", "id", "iban"]
CUES = re.compile(r"(?i)\b(?:tel|phone|call|fax|mobile|e-?mail|mail|contact|write|card|visa|account|iban|ssn|social|security|id|passport|bank)\b")
NEAR = 24


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        d = d * 2 if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def passes(kind: str, s: str) -> bool:
    """Whether a base match is kept."""
    if kind == "email":
        return True
    if kind == "ip":
        return all(len(p := part.lstrip("0")) < 4 and int(p or 0) <= 255 for part in s.split("."))
    digits = re.sub("[^0-9]", "", s)
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return 10 <= len(digits) <= 15


_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """The matches of the email pattern, found from each @ to both sides, in time linear in the text."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            yield start, end
        at = text.find("@", max(end, at + 1))


def base_matches(text: str) -> list[tuple[int, int, int, bool]]:
    """(start, number of the kind, end, passes) of all base matches, leftmost and non-overlapping for each kind."""
    out = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        if kind == "email":
            out += [(a, k, b, True) for a, b in emails(text)]
            continue
        if kind == "phone" and "+" not in text or kind == "ip" and "." not in text:
            continue
        out += [(m.start(), k, m.end(), passes(kind, m[0])) for m in pattern.finditer(text)]
    return out


def loose_matches(text: str) -> list[tuple[int, int, int]]:
    out = []
    for kind, pattern in LOOSE.items():
        if kind == "email" and " at " not in text and "at)" not in text and "at]" not in text:
            continue
        if kind in ("phone", "card", "id", "iban") and not _DIGIT.search(text):
            continue
        out += [(m.start(), KINDS.index(kind), m.end()) for m in pattern.finditer(text)]
    return out


_DIGIT = re.compile("[0-9]{2}")


def describe(text: str, start: int, kind: int, end: int, loose: bool) -> list[float]:
    """Form of the span and of its surroundings; the last number tells loose generators from base patterns."""
    s = text[start:end]
    digits = re.sub("[^0-9]", "", s)
    before, after = text[max(0, start - NEAR) : start], text[end : end + NEAR]
    parts = [p for p in re.split("[^0-9]+", s) if p]
    return [
        kind, len(s), len(digits), len(set(digits)), len(parts), max(map(len, parts), default=0),
        float(bool(digits) and luhn(digits)), s.count("."), s.count("-") + s.count(" "), s.count("/"), float("(" in s),
        float(s[:1] == "0"), float(bool(CUES.search(before))), float(bool(CUES.search(after))),
        sum(c.isdigit() for c in before), sum(c.isdigit() for c in after), float(before[-1:] in ("$", "€", "£", "#", "v")),
        float(before[-2:-1] == ":"), sum(c.isalpha() for c in s), float(loose),
    ]


def synthetic(n: int = 1500, seed: int = 7) -> list[tuple[str, int, int, int, int]]:
    """(text, start, kind, end, label): planted values and look-alikes of the loose forms in word salad."""
    rng = random.Random(seed)
    d = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    w = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9)))
    salad = lambda: " ".join(w() for _ in range(rng.randint(1, 6)))
    cues = {3: ["call", "tel", "phone", "mobile", "fax"], 0: ["write", "contact", "mail"], 2: ["card", "visa"], 4: ["ssn", "social security", "id"], 5: ["iban", "account", "bank"]}
    out = []
    while len(out) < n:
        kind = rng.choice([0, 2, 3, 4, 5])
        real = rng.random() < 0.5
        if kind == 3:
            s = rng.choice([f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"0{d(3)} {d(3)} {d(4)}"]) if real else rng.choice([f"{d(3)}/{d(3)}/{d(3)}", f"{d(3)}.{d(3)}.{d(3)}", f"{d(3)} {d(3)} {d(3)}"])
        elif kind == 0:
            s = f"{w()}{rng.choice([' at ', '(at)', ' [at] '])}{w()}{rng.choice([' dot ', '(dot)', ' [dot] '])}{rng.choice(['com', 'org', 'net', 'de'])}" if real else f"{w()} at {w()} dot {w()}"
        elif kind == 2:
            s = f"{d(4)}.{d(4)}.{d(4)}.{d(4)}"
            real = luhn(re.sub("[^0-9]", "", s))
        elif kind == 4:
            s = f"{d(3)}-{d(2)}-{d(4)}"
        else:
            s = rng.choice(["DE", "FR", "ES", "GB"]) + d(2) + "".join(f" {d(4)}" for _ in range(rng.randint(4, 5))) if real else "".join(rng.choice("ABCDEFGHXYZ0123456789") for _ in range(2)).upper() + d(2) + "".join(rng.choice("ABCDEF0123456789") for _ in range(16))
        # look-alikes stand after words such as part numbers have; real values mostly after a cue
        lead = rng.choice(cues[kind]) + rng.choice([" ", ": "]) if real and rng.random() < 0.8 else rng.choice(["part ", "no. ", "version ", "#", ""])
        text = f"{salad()} {lead}{s} {salad()}"
        found = [x for x in loose_matches(text) if x[1] == kind]
        out += [(text, a, k, b, int(real)) for a, k, b in found[:1]]
    return out


def fit(samples: list[tuple[list[float], int]], precision: float = 0.97) -> dict:
    """Trees and a threshold for each kind's loose generator from (features, label); every fourth sample only calibrates."""
    x = np.array([s[0] for s in samples], dtype=float)
    y = np.array([s[1] for s in samples], dtype=float)
    held = np.arange(len(y)) % 4 == 3
    trees = BoostedTrees().fit(x[~held], y[~held])
    held &= x[:, -1] == 1
    kinds, labels, scores = x[held][:, 0], y[held], trees.score(x[held])
    cuts = [threshold_for(scores[kinds == k], labels[kinds == k], precision) for k in range(len(KINDS))]
    return {"trees": trees, "cuts": np.array(cuts)}


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", corpus_rows: int = 5000) -> dict:
    """A model from synthetic sentences and the base matches of about corpus_rows documents (the sample's bound,
    drawn by a hash of id and text). Of each base kind, about 5 * corpus_rows matches of these documents at most count,
    drawn by a hash of id, text and place."""
    limit = corpus_rows

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for key, text in zip(b["key"], b["text"]):
                for a, k, e, ok in base_matches(text):
                    if e - a < 200 and (k != 2 or e - a > 8):
                        out.append((key, k, a, describe(text, a, k, e, False), int(ok)))
            if out:
                yield pd.DataFrame(out, columns=["key", "kind", "start", "x", "y"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).filter("text is not null")
    share = int(1_000_000 * min(1.0, limit / max(1, docs.count())))
    chosen = rows.withColumn("key", F.xxhash64("doc_id", "text")).filter(F.pmod("key", F.lit(1_000_000)) < share)
    found = stored(chosen.select("key", "text").mapInPandas(run, "key long, kind int, start long, x array<double>, y int"))
    drawn = F.pmod(F.xxhash64("key", "kind", "start"), F.lit(1_000_000))
    wanted = F.lit(False)
    for kind, n in found.groupBy("kind").count().collect():
        wanted |= (F.col("kind") == kind) & (drawn < int(1_000_000 * min(1.0, 5 * limit / n)))
    samples = sorted((list(r["x"]), r["y"]) for r in found.filter(wanted).select("x", "y").collect())
    random.Random(1).shuffle(samples)
    samples = samples + [(describe(t, a, k, e, True), y) for t, a, k, e, y in synthetic()]
    random.Random(2).shuffle(samples)
    return fit(samples)


def find(texts: list[str | None], model: dict) -> list[tuple[list, list]]:
    """For each text the base spans and all spans, as sorted (start, kind, end). A loose span that meets another
    kept span is left out."""
    base = [sorted((a, k, e) for a, k, e, ok in base_matches(t or "") if ok) for t in texts]
    loose = [(i, a, k, e) for i, t in enumerate(texts) for a, k, e in loose_matches(t or "")]
    x = np.array([describe(texts[i], a, k, e, True) for i, a, k, e in loose], dtype=float)
    scores = model["trees"].score(x) if loose else []
    added: dict[int, list] = {}
    for (i, a, k, e), s in zip(loose, scores):
        if s >= model["cuts"][k]:
            added.setdefault(i, []).append((-s, a, k, e))
    out = []
    for i, spans in enumerate(base):
        every = list(spans)
        for _, a, k, e in sorted(added.get(i, [])):
            if not any(a < y and x < e for x, _, y in every):
                every.append((a, k, e))
        out.append((spans, sorted(every)))
    return out


def line(spans: list[tuple[int, int, int]]) -> str:
    """kind:start:end of sorted spans, comma-joined."""
    return ",".join(f"{KINDS[k]}:{a}:{e}" for a, k, e in spans)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, base and spans (arrays of start, end, kind; code points, end exclusive) of every row.

    Null texts are empty, a null id stays null, repeated rows have a row each, an empty table gives an empty result, and
    other columns are ignored. Texts are read whole. Of loose spans that overlap, the higher score wins, then the place.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, id_col, text_col, **options))
    shape = "array<struct<start: int, end: int, kind: string>>"
    named = lambda spans: [{"start": a, "end": e, "kind": KINDS[k]} for a, k, e in spans]

    def start():
        def work(texts: list) -> dict:
            found = find(texts, shared.value)
            return {"base": [named(x) for x, _ in found], "spans": [named(y) for _, y in found]}

        return work

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_rows(rows, ["text"], {"base": shape, "spans": shape}, start)


def pii_report(docs: DataFrame, **options) -> DataFrame:
    """One row per document: counts of each base kind, digest of the base spans, and all spans."""
    found = find_pii(docs, **options)
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(text("base"), 256).alias("base_sha256"), text("spans").alias("spans"))


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span replaced by the name of its kind."""
    out, at = [], 0
    for a, k, e in sorted(spans):
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, e)
    return "".join(out) + text[at:]
