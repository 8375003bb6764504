"""Near-duplicate vectors by Euclidean p-stable hashing.

Vectors of length 1 with cosine c lie sqrt(2 - 2c) apart. A table's bucket is made of `bits` quantised Gaussian
projections floor((a.x + b) / width); near vectors share it with a chance that grows as they get closer, and TABLES
tables leave a pair at the threshold a chance of about 8e-4 to meet in none of them, and one with cosine 0.97 a
chance under 1e-6. Vectors that meet are compared exactly, by cosine in double precision, if their labels are
equal. No pair is listed: each vector carries its bucket in every table, and a pair counts in the first table in
which it meets, so that buckets return one count a vector and links that only connect.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.llm.components import connected_components
from pagewright.session import cut

COSINE = 0.93
TABLES, BITS, WIDTH = 32, 10, 2.0
#: Rows of a bucket that are compared at once; larger buckets are compared block by block, in tasks of their own.
BLOCK = 2048


def projections(dim: int, seed: int = 20) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.standard_normal((dim, TABLES * BITS)), rng.uniform(0, WIDTH, TABLES * BITS)


def buckets(x: np.ndarray, seed: int = 20) -> np.ndarray:
    """The bucket (32 bits) of each vector in each table. x: rows of length 1."""
    a, b = projections(x.shape[1], seed)
    cells = np.floor((x @ a + b) / WIDTH).astype(np.int64).reshape(len(x), TABLES, BITS)
    out = np.zeros((len(x), TABLES), dtype=np.uint64)
    for j in range(BITS):
        out = (out ^ cells[:, :, j].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return (out >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _usable(v) -> np.ndarray | None:
    """The vector scaled to length 1 in double precision, or None if it links with nothing."""
    if v is None or not len(v):
        return None
    x = np.asarray(v, dtype=np.float64)
    if not np.isfinite(x).all():
        return None
    scale = np.abs(x).max()
    if scale == 0:
        return None
    x = x / scale
    return x / np.sqrt(x @ x)


def _units(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x


def distinct_vectors(rows: DataFrame) -> DataFrame:
    """node (the least vec_id of equal vectors), label, vector, weight. Equal vectors are one node."""
    equal = rows.filter(F.col("label").isNotNull() & F.col("vector").isNotNull() & F.col("vec_id").isNotNull())
    return equal.groupBy("label", "vector").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("weight"))


def hashed(nodes: DataFrame) -> DataFrame:
    """node, label, dim, weight, the vector (packed as it is, in 4 or 8 bytes a number), and its bucket in each table
    (packed and as an array)."""
    width = "<f4" if nodes.schema["vector"].dataType.elementType == T.FloatType() else "<f8"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            unit = [_usable(v) for v in b["vector"]]
            by_dim: dict[int, list[int]] = {}
            for i, x in enumerate(unit):
                if x is not None:
                    by_dim.setdefault(len(x), []).append(i)
            for dim, at in by_dim.items():
                x = np.stack([unit[i] for i in at])
                keys = buckets(x)
                rows = b.iloc[at]
                yield pd.DataFrame(
                    {
                        "node": rows["node"], "label": rows["label"], "dim": dim, "weight": rows["weight"],
                        "raw": [np.asarray(v, width).tobytes() for v in rows["vector"]], "keys": [k.tobytes() for k in keys],
                        "by_table": [k.tolist() for k in keys],
                    }
                )

    shape = "node long, label string, dim int, weight long, raw binary, keys binary, by_table array<int>"
    return nodes.select("node", F.col("label").cast("string").alias("label"), "vector", "weight").mapInPandas(run, shape)


def _compare(a: dict, b: dict | None, table: int, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links that the rows of a, and those of b, have in this table first, and links with the same components."""
    other = a if b is None else b
    linked = a["unit"] @ other["unit"].T >= cosine
    if b is None:
        linked &= ~np.tri(len(linked), dtype=bool)
    pairs = np.count_nonzero(linked)
    if table and pairs > 4 * sum(linked.shape):  # dense: table by table over the whole matrix
        for t in range(table):
            linked &= a["keys"][:, t, None] != other["keys"][None, :, t]
    elif table and pairs:
        rows, cols = np.nonzero(linked)
        met = (a["keys"][rows, :table] == other["keys"][cols, :table]).any(axis=1)
        linked[rows[met], cols[met]] = False
    na = (linked @ other["weight"].astype(np.float64)).astype(np.int64)
    nb = (a["weight"].astype(np.float64) @ linked).astype(np.int64)
    if b is None:
        linked |= linked.T
    rows, cols = _forest(linked, b is None)
    return na, nb, np.stack([a["node"][rows], other["node"][cols]])


def _forest(linked: np.ndarray, own: bool) -> tuple[np.ndarray, np.ndarray]:
    """Links (row, column) with the same components, at most one a row and column. own: rows and columns are the same nodes.

    A breadth-first search by rows of the matrix: each node is left once, whatever its number of links.
    """
    rows_left = linked.any(axis=1)
    cols_left = rows_left if own else linked.any(axis=0)
    out = []
    for first in np.flatnonzero(rows_left):
        if not rows_left[first]:
            continue
        rows_left[first] = False
        todo = [(True, first)]
        while todo:
            is_row, i = todo.pop()
            new = np.flatnonzero(linked[i] & cols_left) if is_row else np.flatnonzero(linked[:, i] & rows_left)
            (cols_left if is_row else rows_left)[new] = False
            if len(new):
                ends = np.full(len(new), i), new
                out.append(ends if is_row else ends[::-1])
                todo += [(own or not is_row, j) for j in new]
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64),) * 2


def bucket_links(rows: DataFrame, cosine: float = COSINE) -> DataFrame:
    """a, b, n: n links of node a from one bucket (n > 0), or a link (a, b) that connects (n = 0).

    Buckets are found on narrow rows; vectors join them by node once buckets of one are gone. A bucket's rows are
    dealt into blocks of BLOCK, and every pair of blocks is a group of its own. rows: as from hashed().
    """

    keys = ["label", "dim", "table", "bucket"]
    places = rows.select("node", "label", "dim", F.posexplode("by_table").alias("table", "bucket"))
    sizes = places.groupBy(*keys).agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > 1)
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    sized = places.join(sizes.withColumn("blocks", blocks), keys)
    own = sized.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    partner = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    paired = own.withColumn("other", partner).select(
        *keys, "node", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi")
    )
    paired = paired.join(rows.select("node", "weight", "raw", "keys"), "node")
    group = [*keys, "lo", "hi"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ("node", "weight", "raw", "keys", "block")
        open_key, parts = None, []

        def close(out: list) -> None:
            size = sum(len(p[0]) for p in parts)
            if size < 2:
                return
            node, weight, raw, keys_, block = (np.concatenate(c) for c in zip(*parts)) if len(parts) > 1 else parts[0]
            _, dim, table, _, lo, hi = open_key
            x = _units(np.frombuffer(b"".join(raw), "<f4" if len(raw[0]) == 4 * dim else "<f8").reshape(size, -1))
            if lo == hi and size <= 64 and np.count_nonzero(x @ x.T >= cosine) <= size:
                return
            k = np.frombuffer(b"".join(keys_), dtype=np.int32).reshape(size, -1)
            sides = []
            for want in (lo, hi) if lo != hi else (lo,):
                at = block == want
                sides.append({"node": node[at], "weight": weight[at], "unit": x[at], "keys": k[at]})
            na, nb, links = _compare(sides[0], sides[1] if lo != hi else None, table, cosine)
            for side, n in ((sides[0], na), (sides[-1], nb)):
                some = n > 0
                out.append((side["node"][some], np.zeros(some.sum(), np.int64), n[some]))
            out.append((links[0], links[1], np.zeros(links.shape[1], np.int64)))

        def frame(out: list) -> pd.DataFrame:
            a, b, n = (np.concatenate(c) for c in zip(*out)) if out else np.empty((3, 0), np.int64)
            return pd.DataFrame({"a": a, "b": b, "n": n})

        for batch in batches:
            if not len(batch):
                continue
            cols = [batch[c].to_numpy() for c in names]
            marks = list(zip(*[batch[c].tolist() for c in ("label", "dim", "table", "bucket", "lo", "hi")]))
            out: list = []
            start = 0
            for i in range(1, len(marks) + 1):
                if i < len(marks) and marks[i] == marks[start]:
                    continue
                if parts and marks[start] != open_key:
                    close(out)
                    parts = []
                open_key = marks[start]
                parts.append([c[start:i] for c in cols])
                start = i
            yield frame(out)
        if parts:
            out = []
            close(out)
            yield frame(out)

    dealt = paired.repartition(*group).sortWithinPartitions(*group)
    return dealt.mapInPandas(run, "a long, b long, n long")


def dedup_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row.

    Null labels, and vectors that are null, empty, zero or not finite throughout, link with nothing; neither do
    vectors of different lengths. A row with a null id has no links and a null component. Repeated ids count as
    rows of their own.
    """
    shape = "array<float>" if getattr(vectors.schema[vector_col].dataType, "elementType", None) == T.FloatType() else "array<double>"
    rows = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast(shape).alias("vector")
    )
    nodes = cut(distinct_vectors(rows))
    found = cut(bucket_links(cut(hashed(nodes)), cosine))
    counts = found.filter("n > 0").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("links"))
    comps = connected_components(found.filter("n = 0"), "a", "b")
    bad = F.exists("vector", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) | ~F.exists("vector", lambda v: v != 0)
    state = cut(
        nodes.withColumn("own", F.when(F.coalesce(bad, F.lit(True)), 0).otherwise(F.col("weight") - 1))
        .join(counts, "node", "left")
        .join(comps, "node", "left")
        .select("label", "vector", (F.col("own") + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    )
    joined = rows.join(state, ["label", "vector"], "left")
    linked = (F.col("n_links") > 0) & F.col("vec_id").isNotNull()
    component = F.when(linked, F.col("component_id")).otherwise(F.col("vec_id"))
    return joined.select(
        "vec_id", F.when(linked, F.col("n_links")).otherwise(0).cast("long").alias("n_links"), component.alias("component_id")
    ).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
