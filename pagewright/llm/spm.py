"""SentencePiece encoding and decoding with a forward pass shared between words with a common prefix.

Pieces never cross a word mark, so the distinct marked words of a chunk are encoded once. Sorted, they form a trie
that is walked depth-first; each node keeps the forward score of its prefix - the greatest sum of piece scores over
the segmentations allowed - and the last piece that reaches it, and words below it start from there.

For a model whose scores are log probabilities every segmentation is allowed. In a merge-ranked model a piece t may
follow a piece s only if the tokenizer's own merges give exactly (s, t) for their concatenation: a sequence in which
each neighbour pair may follow one another is the tokenizer's result, so one segmentation of a prefix is left and the
ids equal the public library's.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator
from heapq import heappop, heappush

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import map_rows

MARK = "▁"
MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
#: Words and pairs that a task keeps between chunks: bounds of memory, not of results.
CACHE_WORDS = 400_000
CACHE_PAIRS = 300_000


def merge(text: str, scores: dict[str, float]) -> tuple[list[str], tuple[str, str] | None]:
    """The tokenizer's merges of a text, best score first and leftmost among equals, and the two parts of the last one.

    Neighbour pairs wait in a heap; a pair whose parts have changed since is passed over. Time n log n.
    """
    parts: list[str | None] = list(text)
    before, after = list(range(-1, len(parts) - 1)), list(range(1, len(parts) + 1))
    waiting: list[tuple[float, int, str]] = []
    final = None

    def offer(i: int) -> None:
        if i >= 0 and after[i] < len(parts):
            pair = parts[i] + parts[after[i]]
            score = scores.get(pair)
            if score is not None:
                heappush(waiting, (-score, i, pair))

    for i in range(len(parts) - 1):
        offer(i)
    while waiting:
        _, i, pair = heappop(waiting)
        j = after[i]
        if parts[i] is None or j >= len(parts) or parts[i] + parts[j] != pair:
            continue
        final = parts[i], parts[j]
        parts[i], parts[j] = pair, None
        after[i] = after[j]
        if after[j] < len(parts):
            before[after[j]] = i
        offer(before[i])
        offer(i)
    return [p for p in parts if p is not None], final


def read_pieces(path: str = MODEL_PATH) -> dict:
    """Pieces, scores and byte pieces of a model file."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    scores = {sp.id_to_piece(i): sp.get_score(i) for i in plain}
    return {
        "ids": {sp.id_to_piece(i): i for i in plain},
        "scores": scores,
        "halves": {p: merge(p, scores)[1] for p in scores if len(p) > 1},
        "bytes": {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)},
        "unknown": sp.unk_id(),
        "size": n,
        # merge ranks are whole numbers; log probabilities are not
        "ranked": all(sp.get_score(i) == int(sp.get_score(i)) for i in plain),
    }


class Encoder:
    """Encodes and decodes texts."""

    def __init__(self, model: dict):
        self.ids, self.scores, self.byte_ids = model["ids"], model["scores"], model["bytes"]
        self.unknown, self.ranked = model["unknown"], model["ranked"]
        self.halves = model["halves"]
        #: finds all pieces that end at each place of a word
        self.finder = ahocorasick.Automaton()
        for piece in self.ids:
            self.finder.add_word(piece, piece)
        self.finder.make_automaton()
        known = {c for c in self.ids if len(c) == 1 and c != MARK}
        each = "".join(sorted(map(re.escape, known)))
        self.words = re.compile(f"{MARK}+[{each}]*|[{each}]+|(?s:.)" if known else f"{MARK}+|(?s:.)")
        self.known = known | {MARK}
        self.follows: dict[tuple[str, str], bool] = {}
        self.cache: dict[str, bytes] = {}
        self.out = [b""] * model["size"]
        for piece, i in self.ids.items():
            self.out[i] = piece.replace(MARK, " ").encode()
        for byte, i in self.byte_ids.items():
            self.out[i] = bytes([byte])
        self.out[self.unknown] = " ⁇ ".encode()

    def _stands(self, piece: str) -> bool:
        """Whether the merges of a piece's text give the piece."""
        halves = self.halves.get(piece) if len(piece) > 1 else (piece,)
        return halves is not None and "".join(halves) == piece

    def may_follow(self, s: str, t: str) -> bool:
        """Whether the merges of s + t give these two pieces. s is empty at the start of a word.

        Merges are undone from the last one back. The pieces stay apart unless the parts that meet at their border
        at some time are a pair that merges before the part that was undone; of equal scores the left one comes first.
        """
        if len(self.follows) > CACHE_PAIRS:
            self.follows.clear()
        scores, halves = self.scores, self.halves
        ok = self._stands(t) and (not s or self._stands(s))
        left, right, least, ties = s, t, float("-inf"), False  # a pair merges earlier if its score is above `least`, or equal in `ties`
        while ok and s:
            score = scores.get(left + right)
            if score is not None and (score > least or ties and score == least):
                ok = False
            elif len(left) > 1 and (len(right) == 1 or scores[left] < scores[right]):
                least, ties, left = scores[left], False, halves[left][1]
            elif len(right) > 1:
                least, ties, right = scores[right], True, halves[right][0]
            else:
                break
        self.follows[s, t] = ok
        return ok

    def _pack(self, pieces: Iterable[str]) -> bytes:
        return array("I", map(self.ids.__getitem__, pieces)).tobytes()

    def _single(self, c: str) -> bytes:
        """A character that is no piece: its bytes, or the unknown id."""
        raw = c.encode("utf-8", "surrogatepass")
        if all(b in self.byte_ids for b in raw):
            return np.array([self.byte_ids[b] for b in raw], dtype="<u4").tobytes()
        return np.array([self.unknown], dtype="<u4").tobytes()

    def _extend(self, word: str, score: list[float], last: list[str]) -> None:
        """Forward scores and last pieces of the prefixes of word that are longer than those in score and last."""
        scores, follows, ranked = self.scores, self.follows, self.ranked
        done = len(score)
        score += [float("-inf")] * (len(word) + 1 - done)
        last += [""] * (len(word) + 1 - done)
        for end, piece in self.finder.iter(word):
            end += 1
            if end < done:
                continue
            start = end - len(piece)
            if not ranked:
                if score[start] + scores[piece] > score[end]:
                    score[end], last[end] = score[start] + scores[piece], piece
            elif not last[end]:
                pair = last[start], piece
                ok = follows.get(pair)
                if self.may_follow(*pair) if ok is None else ok:
                    score[end], last[end] = score[start] + scores[piece], piece  # the only segmentation that is allowed

    def add_words(self, words: Iterable[str]) -> None:
        """Encodes the words into the cache, depth-first over their trie."""
        prefix = ""  # the path from the root, with the forward score and the last piece of each of its prefixes
        score, last = [0.0], [""]
        for word in sorted(words):
            if word[0] not in self.known:
                self.cache[word] = self._single(word)
                continue
            if self.ranked and word.startswith(MARK * 2):  # equal scores in a run of marks go by place: merged directly
                self.cache[word] = self._pack(merge(word, self.scores)[0])
                continue
            shared, most = 0, min(len(prefix), len(word))
            while shared < most and prefix[shared] == word[shared]:
                shared += 1
            del score[shared + 1 :], last[shared + 1 :]
            self._extend(word, score, last)
            prefix = word
            pieces, at = [], len(word)
            while at:
                pieces.append(last[at])
                at -= len(last[at])
            pieces.reverse()
            self.cache[word] = self._pack(pieces)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text; none for a null or empty text."""
        one: dict[str, str] = {}  # a word is kept once, however often it occurs
        split = []
        for t in texts:
            words = self.words.findall(MARK + t.replace(" ", MARK)) if t else []
            split.append(list(map(one.setdefault, words, words)))
        new = one.keys() - self.cache.keys()
        if len(self.cache) + len(new) > CACHE_WORDS:
            self.cache.clear()
            new = one
        self.add_words(new)
        of = self.cache.__getitem__
        return [np.frombuffer(b"".join(map(of, words)), dtype="<u4") for words in split]

    def decode(self, ids: np.ndarray) -> str:
        """The text of the ids, without the space that encoding puts in front."""
        raw = b"".join(map(self.out.__getitem__, ids.tolist()))
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


def encode_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str = MODEL_PATH) -> DataFrame:
    """doc_id, ids (array of int), n_tokens, n_bytes, ids_sha256 (of the ids as 4 little-endian bytes each) and
    round_trip (decoding gives the text back).

    Null and empty texts have no ids; a null id stays null; repeated rows have a row each; an empty table gives an
    empty result; other columns are ignored. A literal word mark in a text decodes to a space, as in the public
    library; round_trip compares after that. No shuffle: every batch is encoded where it is read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_pieces(model_path))

    def start():
        encoder = Encoder(shared.value)

        def work(texts: list[str | None]) -> dict:
            ids = encoder.encode(texts)
            return {
                "ids": [x.view("<i4") for x in ids],
                "n_tokens": [len(x) for x in ids],
                "n_bytes": [len((t or "").encode()) for t in texts],
                "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids],
                "round_trip": [encoder.decode(x) == (t or "").replace(MARK, " ") for x, t in zip(ids, texts)],
            }

        return work

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    new = {"ids": "array<int>", "n_tokens": "long", "n_bytes": "long", "ids_sha256": "string", "round_trip": "boolean"}
    return map_rows(rows, ["text"], new, start)


def decode_ids(rows: DataFrame, ids_col: str = "ids", out: str = "decoded", model_path: str = MODEL_PATH) -> DataFrame:
    """rows with the text of their ids; null for null ids."""
    shared = rows.sparkSession.sparkContext.broadcast(read_pieces(model_path))

    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = Encoder(shared.value)
        for b in batches:
            yield pd.Series([None if x is None else encoder.decode(np.asarray(x, dtype=np.int64)) for x in b], dtype=object)

    return rows.withColumn(out, decode(F.col(ids_col)))


def spm_report(docs: DataFrame, **options) -> DataFrame:
    """The digest columns of encode_texts, without the ids."""
    return encode_texts(docs, **options).drop("ids")
