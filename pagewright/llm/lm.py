"""Language-model scores from a causal self-attention model.

A word is known by the ids of its first and last subword: the longest prefix and suffix that a public vocabulary
has. Every subword has a vector and a class of its own use: over all training texts it is counted after which
frequent subwords (up to LAGS words back) it stands, and the counts' leading directions give the vectors, their
clusters the classes. The attention model reads the vectors of the words before a place and predicts the class of
the next word's first subword; within the class the subword, and within the subword the word, have the shares that
corpus-wide counts give them (c: the word's count, M: the sum of c + 1 over the words of the class):

    p(word | context) = p(class | context) * (c + 1) / (M + 1)

An unknown word counts as one event of its class with c = 0, so that probabilities sum to one in every context.

The weights are trained in numpy in synchronous rounds. A hash deals the training texts over ROUNDS; in each round
the tasks sum the gradients over all windows of the round's texts, and one step is made from the sum. Every training
token is a target once, copies as often as they occur, and the result does not depend on how rows are partitioned.
Texts are scored in overlapping windows with one masked attention for a batch of windows; every token counts once,
with at least WINDOW - STRIDE tokens of context where the text has them.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import crc_mod, map_rows
from pagewright.llm.spm import MARK, MODEL_PATH, read_pieces
from pagewright.session import stored

CLASSES, DIM, BINS, LAGS = 32, 16, 32, 4
WINDOW, STRIDE = 32, 24
ROUNDS, RATE = 16, 0.1
END = CLASSES - 1
#: Most frequent words that every task holds; the counts of all others are joined.
HELD_WORDS = 200_000
#: Distinct words of a counting task before it passes them on; words that an encoding task keeps.
FLUSH_WORDS, CACHE_WORDS = 500_000, 400_000
#: Tokens of texts, and windows, that are worked on at once: bounds of memory, not of results.
CHUNK_TOKENS, BATCH = 300_000, 64
SHAPES = {"pos": (WINDOW, DIM), "qkv": (DIM, 3 * DIM), "out": (DIM, CLASSES)}


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def count_words(docs: DataFrame) -> DataFrame:
    """word, c over all tokens of docs (text); the empty word is the end of a text."""

    def flushed(counts: Counter) -> pa.RecordBatch:
        words = pa.array(list(counts), pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([words, pa.array(list(counts.values()), pa.int64())], names=["word", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for b in batches:
            for t in b.column("text").to_pylist():
                counts.update(tokens(t))
                counts[b""] += 1
                if len(counts) > FLUSH_WORDS:
                    yield flushed(counts)
                    counts = Counter()
        if counts:
            yield flushed(counts)

    return docs.select("text").mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


_SHORT = (3, 2, 1)


class Vocabulary:
    """First and last subword and count of words; a word new to a task is looked up once."""

    def __init__(self, pieces: dict[str, int], held: dict[bytes, int]):
        self.pieces, self.held = pieces, held
        # lengths to try for a prefix or suffix by its four outer characters, longest first
        self.heads, self.tails = {}, {}
        for ends, part in ((self.heads, slice(4)), (self.tails, slice(-4, None))):
            found: dict[str, set[int]] = {}
            for p in pieces:
                if len(p) > 3:
                    found.setdefault(p[part], {1, 2, 3}).add(len(p))
            ends.update((k, tuple(sorted(v, reverse=True))) for k, v in found.items())
        self.clear()

    def clear(self) -> None:
        self.row: dict[bytes, int] = {}
        self.words: list[bytes] = []
        self.table = np.empty((0, 3), np.int64)

    def ends(self, word: str) -> tuple[int, int]:
        """Ids of the longest prefix and suffix of the marked word that are subwords, or 0."""
        marked, get = MARK + word, self.pieces.get
        first = last = None
        for k in self.heads.get(marked[:4], _SHORT):
            if (first := get(marked[:k])) is not None:
                break
        for k in self.tails.get(marked[-4:], _SHORT):
            if (last := get(marked[-k:])) is not None:
                break
        return first or 0, last or 0

    def rows(self, words: list[bytes]) -> np.ndarray:
        """Row of each word in the table of (first id, last id, count or -1)."""
        at = np.fromiter(map(self.row.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(at < 0)
        if not len(missing):
            return at
        new = {words[i] for i in missing.tolist()}
        if len(self.row) + len(new) > CACHE_WORDS:
            self.clear()
            new, missing = set(words), np.arange(len(words))
        new = list(new)
        self.row.update(zip(new, range(len(self.words), len(self.words) + len(new))))
        self.words += new
        fresh = np.empty((len(new), 3), np.int64)
        fresh[:, :2] = [self.ends(w.decode()) for w in new]
        fresh[:, 2] = np.fromiter(map(self.held.get, new, repeat(-1)), np.int64, len(new))
        self.table = np.concatenate([self.table, fresh])
        again = [words[i] for i in missing.tolist()]
        at[missing] = np.fromiter(map(self.row.__getitem__, again), np.int64, len(again))
        return at


def prepare(counts: DataFrame, model_path: str = MODEL_PATH) -> dict:
    """Subwords, the mass (sum of c + 1 over the words) of each first subword, and the counts of the most frequent words.

    Only sums by subword (as many as the vocabulary has), sums by magnitude and HELD_WORDS words reach the driver.
    """
    model = read_pieces(model_path)
    total = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v"), F.sum(F.when(F.col("word") == "", F.col("c"))).alias("ends")).first()
    setup = {"pieces": model["ids"], "size": model["size"], "held": {}, "n": total["n"] or 0, "v": total["v"] or 0, "ends": total["ends"] or 0}
    lookup = Vocabulary(setup["pieces"], {})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(piece=[lookup.ends(w)[0] for w in b.pop("word")])

    by_piece = counts.filter("word <> ''").mapInPandas(run, "c long, piece int").groupBy("piece").agg(F.sum(F.col("c") + 1).alias("m")).toPandas()
    setup["mass"] = np.zeros(model["size"])
    setup["mass"][by_piece["piece"].to_numpy(np.int64)] = by_piece["m"].to_numpy(np.float64)
    size = _magnitude()
    sizes = sorted(((r[0], r[1]) for r in counts.groupBy(size.alias("size")).count().collect()), reverse=True)
    least, words = None, 0
    for s, n in sizes:
        if words + n > HELD_WORDS:
            break
        least, words = s, words + n
    setup["least"] = 2**31 - 1 if least is None else least
    if least is not None:
        held = counts.filter(size >= least).toPandas()
        setup["held"] = dict(zip((w.encode() for w in held["word"]), held["c"].tolist()))
    return setup


def _magnitude():
    return F.floor(F.log2("c") * 16).cast("int")


def encode(rows: DataFrame, shared) -> DataFrame:
    """rows with text replaced by what the later steps read, written to the shared folder.

    n_tokens (with the end), n_known and base over the held words and the end, first and last (the words' subword
    ids, two bytes each), rare and times (distinct words that are not held, and how often they occur).
    """
    setup = {k: shared.value[k] for k in ("n", "v", "ends")}
    log_base = np.log10(setup["n"] + setup["v"] + 1)

    def start():
        vocab = Vocabulary(shared.value["pieces"], shared.value["held"])

        def work(texts: list) -> dict:
            split = [tokens(t) for t in texts]
            at = vocab.rows([w for t in split for w in t])
            first, last, c = vocab.table[at].T if len(at) else np.empty((3, 0), np.int64)
            lengths = np.array([len(t) for t in split])
            of = np.repeat(np.arange(len(split)), lengths)
            held = c >= 0
            base = np.bincount(of[held], np.log10(c[held] + 1.0) - log_base, len(split)) + np.log10(setup["ends"] + 1) - log_base
            known = np.bincount(of[held], minlength=len(split)) + (setup["ends"] > 0)
            cuts = np.cumsum(lengths)
            pairs, times = np.unique(of[~held] * 2**32 + at[~held], return_counts=True)
            spans = np.searchsorted(pairs, np.arange(len(split) + 1) * 2**32).tolist()
            words = [vocab.words[i].decode() for i in (pairs & (2**32 - 1)).tolist()]
            times = times.tolist()
            ids = [[x[e - n : e].tobytes() for e, n in zip(cuts, lengths)] for x in (first.astype("<u2"), last.astype("<u2"))]
            return {
                "n_tokens": lengths + 1, "n_known": known, "base": base, "first": ids[0], "last": ids[1],
                "rare": [words[a:b] for a, b in zip(spans, spans[1:])], "times": [times[a:b] for a, b in zip(spans, spans[1:])],
            }

        return work

    new = {"n_tokens": "long", "n_known": "long", "base": "double", "first": "binary", "last": "binary", "rare": "array<string>", "times": "array<int>"}
    made = map_rows(rows, ["text"], new, start).sortWithinPartitions("round")
    # row groups are small and sorted by round, so that a round reads about its own rows
    return stored(made, {"parquet.block.size": str(2 << 20)})


def _batches(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[list[list]]:
    """The named columns as lists, for texts with about CHUNK_TOKENS tokens at a time. The first holds ids."""
    for b in batches:
        columns = [b.column(c).to_pylist() for c in names]
        start = size = 0
        for i, x in enumerate(columns[0]):
            size += len(x) // 2 + 1
            if size > CHUNK_TOKENS:
                yield [c[start : i + 1] for c in columns]
                start, size = i + 1, 0
        if start < len(columns[0]):
            yield [c[start:] for c in columns]


def cooccurrences(encoded: DataFrame, bins: np.ndarray, size: int) -> np.ndarray:
    """How often each subword, as a word's first or last, follows a word that begins with each of the bins' subwords
    within LAGS words. Tasks pass on one row of sums a subword."""
    bin_of = np.full(2**16, -1, np.int64)
    bin_of[bins] = np.arange(len(bins))
    none = 2**16 - 1
    gap = np.full(LAGS, none, "<u2").tobytes()
    names = ["piece", *[f"b{i}" for i in range(BINS)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(size * BINS, np.int64)
        for ids in _batches(batches, "first", "last"):
            first, last = (np.frombuffer(gap.join(x), "<u2").astype(np.int64) for x in ids)
            near = bin_of[first]
            for lag in range(1, LAGS + 1):
                use = (near[:-lag] >= 0) & (first[lag:] != none)
                for x in (first, last):
                    sums += np.bincount(x[lag:][use] * BINS + near[:-lag][use], minlength=size * BINS)
        table = sums.reshape(size, BINS)
        some = np.flatnonzero(table.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some), *[pa.array(table[some, i]) for i in range(BINS)]], names=names)

    shape = "piece long, " + ", ".join(f"b{i} long" for i in range(BINS))
    found = encoded.select("first", "last").mapInArrow(run, shape).groupBy("piece").agg(*[F.sum(c).alias(c) for c in names[1:]]).toPandas()
    out = np.zeros((size, BINS))
    out[found["piece"].to_numpy(np.int64)] = found[names[1:]].to_numpy(np.float64)
    return out


def clusters(x: np.ndarray, mass: np.ndarray, k: int, rounds: int = 30) -> np.ndarray:
    """k-means by mass: the cluster of each row. It starts from the heaviest row and then the ones farthest off by mass."""
    chosen = [int(np.argmax(mass))]
    far = ((x - x[chosen[0]]) ** 2).sum(axis=1)
    for _ in range(k - 1):
        chosen.append(int(np.argmax(far * mass)))
        far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    centres = x[chosen]
    for _ in range(rounds):
        of = np.argmin((centres**2).sum(axis=1) - 2 * x @ centres.T, axis=1)
        weight = np.bincount(of, mass, k)
        sums = np.stack([np.bincount(of, x[:, j] * mass, k) for j in range(x.shape[1])], axis=1)
        centres = np.where(weight[:, None] > 0, sums / np.maximum(weight, 1e-300)[:, None], centres)
    return of


def subword_model(cooc: np.ndarray, setup: dict) -> dict:
    """Vector and class of each subword, and the base log probability of each class.

    Rows of vec and classes behind the subwords: `size` stands for the start of a text (input), size + 1 for its end (target).
    """
    mass, size = setup["mass"], setup["size"]
    total = cooc.sum(axis=1, keepdims=True)
    mean = cooc.sum(axis=0) / max(1.0, cooc.sum())
    x = np.sqrt((cooc + 20 * mean) / (total + 20)) - np.sqrt(mean)
    # directions with a fixed sign, so that equal counts give equal vectors
    _, _, axes = np.linalg.svd((x * mass[:, None]).T @ x)
    axes = axes[:DIM] * np.sign(axes[:DIM][np.arange(DIM), np.abs(axes[:DIM]).argmax(axis=1)])[:, None]
    vec = x @ axes.T
    vec /= np.sqrt(max(1e-12, ((vec**2).sum(axis=1) * mass).sum() / max(1.0, mass.sum())))
    of = clusters(x, mass, CLASSES - 1)
    by_class = np.append(np.bincount(of, mass, CLASSES - 1) + 1, setup["ends"] + 1)
    centres = np.zeros((CLASSES, DIM))
    for j in range(DIM):
        centres[:-1, j] = np.bincount(of, vec[:, j] * mass, CLASSES - 1) / by_class[:-1]
    return {
        "vec": np.concatenate([vec, np.zeros((2, DIM))]).astype(np.float32),
        "class_of": np.append(of, [END, END]).astype(np.uint8),
        "log_class": np.log(by_class / (setup["n"] + setup["v"] + 1)),
        "centres": centres,
        "size": size,
    }


def start_weights(centres: np.ndarray, seed: int = 5) -> dict[str, np.ndarray]:
    """Attention that reads all places nearly alike, and classes that look for their own centre."""
    rng = np.random.default_rng(seed)
    qkv = rng.standard_normal(SHAPES["qkv"]) * 0.1
    qkv[:, 2 * DIM :] += np.eye(DIM)
    return {"pos": np.zeros(SHAPES["pos"]), "qkv": qkv, "out": 0.3 * centres.T}


def single(w: dict) -> dict:
    return {k: v.astype(np.float32) for k, v in w.items()}


_LOWER = np.tri(WINDOW, dtype=np.float32)


def _sums(a: np.ndarray) -> np.ndarray:
    """Sums over the last axis, which stays; a product with ones is faster than sum() for short rows."""
    return (a.reshape(-1, a.shape[-1]) @ np.ones(a.shape[-1], a.dtype)).reshape(*a.shape[:-1], 1)


def attend(w: dict, x: np.ndarray) -> tuple:
    """The state at each place of each window, and what it is made of: masked attention over the places up to it."""
    x = x + w["pos"]
    m, t, d = x.shape
    qkv = (x.reshape(-1, d) @ w["qkv"]).reshape(m, t, 3 * d)
    q, k, v = qkv[..., :d], qkv[..., d : 2 * d], qkv[..., 2 * d :]
    a = np.matmul(q * x.dtype.type(1 / np.sqrt(d)), k.transpose(0, 2, 1))
    np.clip(a, -30, 30, out=a)
    np.exp(a, out=a)
    a *= _LOWER
    a /= _sums(a)
    h = np.matmul(a, v)
    h += x
    return h, (x, q, k, v, a)


def probabilities(w: dict, h: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Of the classes, for rows of states."""
    z = h @ w["out"]
    z += bias
    np.clip(z, -60, 60, out=z)
    np.exp(z, out=z)
    z /= _sums(z)
    return z


def gradients(w: dict, x: np.ndarray, target: np.ndarray, use: np.ndarray, bias: np.ndarray) -> dict:
    """Gradients of the sum of negative log probabilities (natural) of the target classes at the used places."""
    h, (x, q, k, v, a) = attend(w, x)
    m, t, d = x.shape
    flat = probabilities(w, h.reshape(-1, d), bias)
    flat[np.arange(len(flat)), target.reshape(-1)] -= 1
    flat *= use.reshape(-1, 1)
    dh = (flat @ w["out"].T).reshape(m, t, d)
    da = np.matmul(dh, v.transpose(0, 2, 1))
    dv = np.matmul(a.transpose(0, 2, 1), dh)
    da -= _sums(da * a)
    ds = np.multiply(da, a, out=da)
    ds *= x.dtype.type(1 / np.sqrt(d))
    dqkv = np.concatenate([np.matmul(ds, k), np.matmul(ds.transpose(0, 2, 1), q), dv], axis=2).reshape(-1, 3 * d)
    dx = dh + (dqkv @ w["qkv"].T).reshape(m, t, d)
    return {"pos": dx.sum(axis=0), "qkv": x.reshape(-1, d).T @ dqkv, "out": h.reshape(-1, d).T @ flat}


def windows(lengths: np.ndarray, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows over texts of the given lengths that stand one after another: place of each window's tokens (rows of
    WINDOW), which of them count, and the text of each window."""
    n = np.where(lengths <= WINDOW, 1, 1 + -(-(lengths - WINDOW) // stride))
    text = np.repeat(np.arange(len(lengths)), n)
    k = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    local = k[:, None] * stride + np.arange(WINDOW)
    counts = (local < lengths[text][:, None]) & ((k == 0)[:, None] | (np.arange(WINDOW) >= WINDOW - stride))
    starts = np.cumsum(lengths) - lengths
    return starts[text][:, None] + np.minimum(local, lengths[text][:, None] - 1), counts, text


def arrange(model: dict, firsts: list[bytes], lasts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lengths, input ids and target classes of texts with a start before and an end after their words."""
    start, end = (np.array([model["size"] + i], "<u2").tobytes() for i in (0, 1))
    lengths = np.array([len(f) // 2 + 1 for f in firsts])
    i1, i2 = (np.frombuffer(b"".join(start + x for x in ids), "<u2") for ids in (firsts, lasts))
    target = model["class_of"][np.frombuffer(b"".join(x + end for x in firsts), "<u2")]
    return lengths, i1, i2, target


def train(encoded: DataFrame, model: dict) -> dict[str, np.ndarray]:
    """Weights after ROUNDS steps. encoded: training rows (round, first, last). Sums of gradients reach the driver."""
    bias = (model["log_class"] - np.log(np.exp(model["log_class"]).sum())).astype(np.float32)
    shared = encoded.sparkSession.sparkContext.broadcast(model)
    w = start_weights(model["centres"])
    moment = {k: (np.zeros(s), np.zeros(s)) for k, s in SHAPES.items()}
    for step in range(1, ROUNDS + 1):
        total = _summed(encoded.filter(F.col("round") == step - 1), shared, single(w), bias)
        if not total["n"]:
            continue
        for k, g in total["g"].items():
            m, v = moment[k]
            g = g / total["n"]
            m += 0.2 * (g - m)
            v += 0.05 * (g * g - v)
            w[k] = w[k] - RATE * (1 - (step - 1) / ROUNDS) * (m / (1 - 0.8**step)) / (np.sqrt(v / (1 - 0.95**step)) + 1e-6)
    return w


def _summed(rows: DataFrame, shared, w: dict, bias: np.ndarray) -> dict:
    """Number of targets and summed gradients over all windows of the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        sums, n = {k: np.zeros(s) for k, s in SHAPES.items()}, 0
        for ids in _batches(batches, "first", "last"):
            lengths, i1, i2, target = arrange(model, *ids)
            place, counts, _ = windows(lengths, WINDOW)
            for s in range(0, len(place), BATCH):
                p, use = place[s : s + BATCH], counts[s : s + BATCH]
                x = model["vec"][i1[p]]
                x += model["vec"][i2[p]]
                for k, g in gradients(w, x, target[p], use.astype(np.float32), bias).items():
                    sums[k] += g
                n += int(use.sum())
        if n:
            flat = np.concatenate([[n], *[sums[k].reshape(-1) for k in SHAPES]])
            yield pa.RecordBatch.from_arrays([pa.array([flat], pa.list_(pa.float64()))], names=["g"])

    each = rows.select("first", "last").mapInArrow(run, "g array<double>").select(F.posexplode("g").alias("i", "x"))
    flat = each.groupBy("i").agg(F.sum("x").alias("x")).toPandas().sort_values("i")["x"].to_numpy(np.float64)
    out, at = {"n": flat[0] if len(flat) else 0, "g": {}}, 1
    for k, s in SHAPES.items() if len(flat) else ():
        out["g"][k] = flat[at : at + np.prod(s)].reshape(s)
        at += np.prod(s)
    return out


def gains(model: dict, w: dict, firsts: list[bytes], lasts: list[bytes]) -> np.ndarray:
    """For each text the log10 of the model's probability over the base's."""
    lengths, i1, i2, target = arrange(model, firsts, lasts)
    log_class = model["log_class"]
    bias = (log_class - np.log(np.exp(log_class).sum())).astype(np.float32)
    place, counts, _ = windows(lengths)
    gain = np.zeros(len(i1))
    for s in range(0, len(place), BATCH):
        p, use = place[s : s + BATCH], counts[s : s + BATCH]
        x = model["vec"][i1[p]]
        x += model["vec"][i2[p]]
        at = p[use]
        picked = probabilities(w, attend(w, x)[0][use], bias)[np.arange(len(at)), target[at]]
        gain[at] = np.log(np.maximum(picked, 1e-30)) - log_class[target[at]]
    return np.add.reduceat(gain, np.cumsum(lengths) - lengths) / np.log(10)


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str = MODEL_PATH) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    Null texts are empty: one token, the end. Rows with a null id are training rows. Repeated rows are trained on and
    scored one by one. Without a training row the score is the base's. An empty table gives an empty result; other
    columns are ignored. Rarer words than the held ones are joined with their counts, each text's distinct words once.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    training = crc_mod(F.col("doc_id"), 7) != 2
    counts = stored(count_words(rows.filter(training)))
    setup = prepare(counts, model_path)
    shared = docs.sparkSession.sparkContext.broadcast(setup)
    # the round that a training text belongs to; none for others
    dealt = F.when(training, F.pmod(F.xxhash64("doc_id", "text"), F.lit(ROUNDS)).cast("int")).alias("round")
    encoded = encode(rows.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text", dealt), shared)
    learned = {}
    if setup["n"]:
        used = encoded.filter("round is not null")
        bins = np.argsort(-setup["mass"], kind="stable")[:BINS]
        model = subword_model(cooccurrences(used, bins, setup["size"]), setup)
        learned = {"model": model, "w": single(train(used, model))}
    learned = docs.sparkSession.sparkContext.broadcast(learned)

    def start():
        known = learned.value
        if not known:
            return lambda firsts, lasts: {"gain": np.zeros(len(firsts))}
        return lambda firsts, lasts: {"gain": gains(known["model"], known["w"], firsts, lasts)}

    kept = encoded.select("rid", "doc_id", "n_tokens", "n_known", "base", "first", "last")
    scored = map_rows(kept, ["first", "last"], {"gain": "double"}, start)
    rare = counts.filter(_magnitude() < setup["least"]).filter("word <> ''")
    words = encoded.select("rid", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("rid", F.col("r.rare").alias("word"), F.col("r.times").alias("times"))
    log_base = float(np.log10(setup["n"] + setup["v"] + 1))
    joined = words.join(rare, "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    others = joined.groupBy("rid").agg(
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("also_known"),
        F.sum(F.col("times") * (F.log10(F.col("c") + 1) - log_base)).alias("also_base"),
    )
    base = F.col("base") + F.coalesce("also_base", F.lit(0.0))
    return scored.join(others, "rid", "left").select(
        "doc_id",
        (crc_mod(F.col("doc_id"), 7) == 2).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("also_known", F.lit(0))).alias("n_known"),
        F.lit(setup["n"]).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        (base + F.col("gain")).alias("score"),
    )
