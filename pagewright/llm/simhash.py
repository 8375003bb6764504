"""SimHash near-duplicates by covering locality-sensitive hashing.

A 64-bit fingerprint gets one key per mask. Bit i carries the vector phi(i) of radius+1 bits; the mask of a
nonzero vector v keeps the bits with odd <phi(i), v>. The phi of at most `radius` differing bits span less than the
whole space, so some v is orthogonal to all of them: in that table the two fingerprints have the same key. Every
pair within the radius therefore shares a bucket, and buckets compare distances exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import hot_values, map_rows, row_key, spread_join
from pagewright.llm.components import connected_components
from pagewright.llm.keysets import KeyFilter, without_keys
from pagewright.session import cut

RADIUS = 4
SHINGLE = 4
SEED = 42
#: Buckets with more fingerprints are divided by a second family of masks before they are compared.
WIDE = 4096


def covering_masks(radius: int = RADIUS, stride: int = 1) -> list[int]:
    """2**(radius+1)-1 masks. phi(i) runs through all nonzero vectors, so that masks keep about half of the bits."""
    vectors = 2 ** (radius + 1) - 1
    phi = [1 + i * stride % vectors for i in range(64)]
    return [sum(1 << i for i in range(64) if (phi[i] & v).bit_count() % 2) for v in range(1, vectors + 1)]


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """The majority bits of the shingles' XXH64; 0 without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = (ends - [len(w) + 1 for w in words]).tolist()
    ends = (ends - 1).tolist()
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        hashes = np.array([digest(joined, SEED)], dtype="<u8")
    else:
        hashes = np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts, ends[size - 1 :])), "<u8", len(words) - size + 1)
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 8192):
        part = hashes[i : i + 8192]
        ones += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def add_fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """doc_id, k1, k2 and fp (64 bits as a signed long) of every row. Null texts have no words."""

    def start():
        return lambda texts: {"fp": np.array([_signed(fingerprint(t, size)) for t in texts], dtype=np.int64)}

    kept = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        *row_key(F.col(id_col), F.col(text_col)),
        F.col(text_col).cast("string").alias("text"),
    )
    return map_rows(kept, ["text"], {"fp": "long"}, start)


def _connect(fps: np.ndarray, radius: int, out: list[np.ndarray]) -> None:
    """Links that connect exactly what pairs within the radius connect, without listing all pairs.

    A breadth-first search: a fingerprint is compared with those not yet reached, and what it reaches leaves
    them. A dense group of n costs about n steps, not n squared.
    """
    left = fps
    while len(left) > 1:
        stack, left = [left[0]], left[1:]
        while stack and len(left):
            x = stack.pop()
            near = np.bitwise_count(left ^ x) <= radius
            if near.any():
                new = left[near]
                out.append(np.stack([np.full(len(new), x), new]))
                stack.extend(new)
                left = left[~near]


def _connect_wide(fps: np.ndarray, radius: int, out: list[np.ndarray]) -> None:
    if len(fps) <= WIDE:
        return _connect(fps, radius, out)
    for mask in covering_masks(radius, stride=7):
        keys = fps & np.uint64(mask)
        order = np.argsort(keys, kind="stable")
        cuts = np.flatnonzero(np.diff(keys[order])) + 1
        for part in np.split(fps[order], cuts):
            _connect(part, radius, out)


def link_fingerprints(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) between distinct values of fp whose components are those of all pairs within the radius."""
    masks = covering_masks(radius)
    keys = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(masks)])
    dealt = fps.select("fp", F.explode(keys).alias("k")).select("k.t", "k.key", "fp")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_key, open_fps = None, []

        def close(out: list[np.ndarray]) -> None:
            if len(open_fps) > 1 or open_fps and len(open_fps[0]) > 1:
                _connect_wide(np.concatenate(open_fps), radius, out)

        def frame(out: list[np.ndarray]) -> pd.DataFrame:
            pairs = np.concatenate([p.astype(np.uint64) for p in out], axis=1).view(np.int64) if out else np.empty((2, 0), np.int64)
            return pd.DataFrame({"a": pairs[0], "b": pairs[1]})

        for b in batches:
            if not len(b):
                continue
            t, key, fp = b["t"].to_numpy(), b["key"].to_numpy(), b["fp"].to_numpy().view(np.uint64)
            starts = np.flatnonzero(np.concatenate([[True], (np.diff(key) != 0) | (np.diff(t) != 0)]))
            ends = np.append(starts[1:], len(b))
            out: list[np.ndarray] = []
            if open_key != (t[0], key[0]):
                close(out)
                open_fps = []
            open_fps.append(fp[: ends[0]])
            if len(starts) > 1:
                close(out)
                for s, e in zip(starts[1:-1], ends[1:-1]):
                    if e - s > 1:
                        _connect_wide(fp[s:e], radius, out)
                open_fps = [fp[starts[-1] :]]
            open_key = (t[-1], key[-1])
            yield frame(out)
        out = []
        close(out)
        yield frame(out)

    return dealt.repartition("t", "key").sortWithinPartitions("t", "key").mapInPandas(run, "a long, b long")


def near_duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """doc_id, k1, k2, fp, root (a fingerprint that names the component), component_id, for every row.

    Rows with equal fingerprints are one node, so thousands of copies cost one row in the search. A null id never
    is the component's id unless all its ids are null. An empty table gives an empty result.
    """
    prints = cut(add_fingerprint(docs, id_col, text_col))
    nodes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")))
    comps = connected_components(link_fingerprints(nodes, radius), "a", "b")
    roots = cut(nodes.join(comps, F.col("fp") == F.col("node"), "left").select("fp", "first", "component"))
    linked = roots.filter("component is not null").withColumnRenamed("component", "root")
    ids = cut(linked.groupBy("root").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("n")))
    alone = roots.filter("component is null").select("fp", F.col("fp").alias("root"), F.col("first").alias("component_id"))
    named = spread_join(linked.select("fp", "root"), ids, "root", ["fp"], hot=hot_values(ids, "root"))
    labels = cut(named.select("fp", "root", "component_id").unionByName(alone))
    # thousands of copies, and all texts without words, have one fingerprint
    return spread_join(prints, labels, "fp", ["k1", "k2"], hot=hot_values(nodes, "fp")).select("doc_id", "k1", "k2", "fp", "root", "component_id")


def simhash_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row.

    Null, empty and blank texts have fingerprint zero and link with one another; a null id stays null; repeated rows have a
    row each; an empty table gives an empty result; other columns are ignored.
    """
    groups = near_duplicate_groups(docs, id_col, text_col, radius)
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """The row with the least id of each component, as it was; null ids come last, then the text's hash decides, and of
    repeated rows one stays. All columns stay, whatever their names; an empty table gives an empty result. Texts are not
    shuffled but for rows whose key hits two bit filters (see keysets)."""
    groups = cut(near_duplicate_groups(docs, id_col, text_col, radius))
    first = groups.groupBy("root").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("k1"), F.col("k2"))).alias("keep"),
        F.count(F.lit(1)).alias("rows"),
    )
    first = first.filter(F.col("rows") > 1).select("root", "rows", F.col("keep.k1").alias("b1"), F.col("keep.k2").alias("b2"))
    first = cut(first)
    others = spread_join(groups, first, "root", ["k1", "k2"], hot=hot_values(first, "root", "rows"))
    repeated = (
        others.filter((F.col("k1") == F.col("b1")) & (F.col("k2") == F.col("b2")))
        .groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1).select("k1", "k2")
    )
    repeated = cut(repeated)
    lost = others.filter((F.col("k1") != F.col("b1")) | (F.col("k2") != F.col("b2"))).select("k1", "k2").distinct()
    lost = cut(lost.union(repeated))
    k1, k2 = row_key(F.col(id_col), F.col(text_col))
    keyed = docs.select(F.struct("*").alias("_row"), k1, k2)
    kept = without_keys(keyed, lost, groups)
    if not repeated.isEmpty():
        again = KeyFilter(repeated).mark(keyed, "k2", "_again").filter("_again").drop("_again")
        again = again.join(repeated, ["k1", "k2"], "left_semi")
        kept = kept.unionByName(again.dropDuplicates(["k1", "k2"]).select(*keyed.columns))
    return kept.select("_row.*")
