"""Prefix trie of conversations: which turns they share, how often, and what storing shared turns once would save.

Method: the distinct conversations are sorted; the lengths of the prefixes that neighbours share (the LCP array) are the
heights of a Cartesian tree, whose intervals come from all nearest smaller values, found block by block: inside a block
with a stack, beyond it through the minima of the blocks and one look into the block that holds the answer. Intervals of
equal height and place are one node, depths between a node and its parent are filled in, and sums over subtrees are
differences of running sums.

Shape at scale: texts are read once and become keys of 22 characters. Nothing is gathered by conversation, by copy or by
node: turns are placed by ranges that may cut a conversation, long conversations are compared in chunks of CHUNK turns
that are renamed in pairs until one name is left, and a block holds about the square root of the number of distinct
conversations, so that the minima that reach the driver are as few.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagewright.session import cut, stored

#: Turns that are compared as one array.
CHUNK = 128
#: Depths of one node that are filled in together.
SPAN = 1024
#: Conversations of a block at least.
BLOCK = 64
#: The largest h of the contract's rebuilding.
HEAD = 8
#: Ids of a digest that travel as one text.
PIECE = 4096
_BIG = 2**63 - 1
_MASK = 2**33 - 1


def _div(a: Column | str, b: int) -> Column:
    return F.call_function("div", F.col(a) if isinstance(a, str) else a, F.lit(b).cast("long"))


def ordered_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns of every conversation with their place, and the parts in which a conversation's turns lie.

    turns: c, part, pos (from 0), key, bytes (UTF-8, of the text), cum (bytes up to this turn). parts: c, part, n.
    Order is by turn, null first; turns with one number by key, the start of a SHA-256 of role and text. A null role or
    text is empty. Rows without conv_id belong to no conversation. Repeated rows are turns of their own.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("c"), "turn", F.substring(F.base64(F.unhex(F.substring(digest, 1, 32))), 1, 22).alias("key"),
        F.octet_length(text).cast("long").alias("bytes"), F.monotonically_increasing_id().alias("row"),
    )
    placed = stored(rows.repartitionByRange("c", "turn", "key", "row").withColumn("part", F.spark_partition_id()))
    inside = Window.partitionBy("c", "part").orderBy("turn", "key", "row").rowsBetween(Window.unboundedPreceding, 0)
    near = placed.select("c", "part", "key", "bytes", F.count(F.lit(1)).over(inside).alias("nth"), F.sum("bytes").over(inside).alias("sum"))
    before = Window.partitionBy("c").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy("c", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("b"))
    parts = parts.withColumns({"n0": F.coalesce(F.sum("n").over(before), F.lit(0)), "b0": F.coalesce(F.sum("b").over(before), F.lit(0))})
    turns = near.join(parts.select("c", "part", "n0", "b0"), ["c", "part"])
    turns = turns.select("c", "part", (F.col("nth") + F.col("n0") - 1).alias("pos"), "key", "bytes", (F.col("sum") + F.col("b0")).alias("cum"))
    return cut(turns), parts.select("c", "part", "n")


def whole_conversations(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """convs (c, len) and turns (c, depth from 1, key, bytes, cum), as they are."""
    own, parts = ordered_turns(conversations)
    convs = parts.groupBy("c").agg(F.sum("n").alias("len"))
    return convs, own.select("c", (F.col("pos") + 1).alias("depth"), "key", "bytes", "cum")


def rebuilt_conversations(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """convs and turns after every conversation c takes the first h turns of c - c % 5 in place of its own first h.

    h is crc32 of the decimal id, modulo 9. Only the first turns of a conversation, eight at most, are gathered.
    """
    own, parts = ordered_turns(conversations)
    first = F.array_sort(F.collect_list(F.struct("pos", "key", "bytes", "cum")))
    heads = own.filter(F.col("pos") < HEAD).groupBy("c").agg(first.alias("head"))
    sizes = parts.groupBy("c").agg(F.sum("n").alias("n")).join(heads, "c")
    based = sizes.withColumn("base", F.col("c") - F.col("c") % 5).join(heads.select(F.col("c").alias("base"), F.col("head").alias("lent")), "base", "left")
    based = based.withColumn("h", (F.crc32(F.col("c").cast("string").cast("binary")) % (HEAD + 1)).cast("int"))
    based = based.withColumns({"taken": F.least("h", F.coalesce(F.size("lent"), F.lit(0))), "left_out": F.least("h", "n").cast("int")})
    upto = lambda turns, k: F.when(F.col(k) > 0, F.element_at(turns, F.col(k))["cum"]).otherwise(F.lit(0))
    convs = cut(
        based.select(
            "c", "h", (F.col("taken") - F.col("h")).alias("shift"), (upto("lent", "taken") - upto("head", "left_out")).alias("add"),
            (F.col("taken") + F.col("n") - F.col("left_out")).alias("len"), F.when(F.col("taken") > 0, F.slice("lent", F.lit(1), F.col("taken"))).alias("lent"),
        )
    )
    front = convs.select("c", F.explode("lent").alias("t")).select("c", (F.col("t.pos") + 1).alias("depth"), "t.key", "t.bytes", "t.cum")
    moves = parts.select("c", "part").join(convs.select("c", "h", "shift", "add"), "c")
    rest = own.join(moves, ["c", "part"]).filter(F.col("pos") >= F.col("h"))
    rest = rest.select("c", (F.col("pos") + F.col("shift") + 1).alias("depth"), "key", "bytes", (F.col("cum") + F.col("add")).alias("cum"))
    return convs.select("c", "len"), cut(front.unionByName(rest))


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted rows of len, x, y, c: ids of a class that follow each other, joined to texts of PIECE ids at most."""
    held, ids, out = None, [], []
    for batch in batches:
        for row in zip(*(batch[k].tolist() for k in ("len", "x", "y", "c"))):
            if held is not None and (row[:3] != held or len(ids) == PIECE):
                out.append((*held, ids[0], ",".join(map(str, ids))))
                ids = []
            held = row[:3]
            ids.append(row[3])
        if out:
            yield pd.DataFrame(out, columns=["len", "x", "y", "c", "ids"])
            out = []
    if ids:
        yield pd.DataFrame([(*held, ids[0], ",".join(map(str, ids)))], columns=["len", "x", "y", "c", "ids"])


def _hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted pieces: the SHA-256 of each class's pieces, fed one after another."""
    held, digest, out = None, None, []
    for batch in batches:
        for row in zip(*(batch[k].tolist() for k in ("len", "x", "y", "ids"))):
            if row[:3] == held:
                digest.update(b",")
            else:
                if held is not None:
                    out.append((*held, digest.hexdigest()))
                held, digest = row[:3], hashlib.sha256()
            digest.update(row[3].encode())
        if out:
            yield pd.DataFrame(out, columns=["len", "x", "y", "ends"])
            out = []
    if held is not None:
        yield pd.DataFrame([(*held, digest.hexdigest())], columns=["len", "x", "y", "ends"])


def _classes(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """rep (least id), len, members, ends: one row for each distinct sequence of turns.

    Sequences are told apart by length and two 64-bit sums over their turns. The ids of a class are put in order by
    ranges that may cut the class, so that only joined pieces of them meet in one task.
    """
    x = [F.bit_xor(F.xxhash64(F.lit(seed), "depth", "key")).alias(n) for seed, n in ((7, "x"), (11, "y"))]
    keyed = convs.join(turns.groupBy("c").agg(*x), "c", "left").fillna(0, ["x", "y"]).select("len", "x", "y", "c")
    keyed = cut(keyed)
    name = ["len", "x", "y"]
    pieces = keyed.repartitionByRange(*name, "c").sortWithinPartitions(*name, "c").mapInPandas(_pieces, "len long, x long, y long, c long, ids string")
    ends = pieces.repartition(*name).sortWithinPartitions(*name, "c").mapInPandas(_hashes, "len long, x long, y long, ends string")
    counted = keyed.groupBy(*name).agg(F.min("c").alias("rep"), F.count(F.lit(1)).alias("members"))
    return cut(counted.join(ends, name).select("rep", "len", "members", "ends"))


def _chunk_numbers(length: Column) -> Column:
    """Numbers of the chunks of a sequence; none for an empty one."""
    return F.when(length > 0, F.sequence(F.lit(0).cast("long"), _div(length - 1, CHUNK)))


def _sorted_classes(classes: DataFrame, chunks: DataFrame) -> DataFrame:
    """rep, place: the distinct sequences in an order in which a prefix comes first and what shares one lies together.

    Chunks (rep, j, s) are arrays of keys, ordered as arrays. While a sequence has several, chunks get names in that order and
    neighbours become one chunk of two names.
    """
    level, n = chunks, -(-(classes.agg(F.max("len")).first()[0] or 0) // CHUNK)
    while n > 1:
        names = stored(level.select("s").distinct().orderBy("s").withColumn("name", F.monotonically_increasing_id()))
        named = level.join(names, "s").select("rep", _div("j", 2).alias("to"), (F.col("j") % 2).alias("side"), F.lpad(F.hex("name"), 16, "0").alias("name"))
        side = lambda k: F.max(F.when(F.col("side") == k, F.col("name")))
        level = cut(named.groupBy("rep", "to").agg(F.array_compact(F.array(side(0), side(1))).alias("s")).withColumnRenamed("to", "j"))
        n = -(-n // 2)
    empty = classes.filter("len = 0").select("rep", F.array().cast("array<string>").alias("s"))
    ranked = stored(level.select("rep", "s").unionByName(empty).orderBy("s").select("rep", F.monotonically_increasing_id().alias("at")))
    part = F.shiftrightunsigned("at", 33)
    per = ranked.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    start = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = per.select("part", start.alias("start"))  # a row for each partition of the sort
    return ranked.withColumn("part", part).join(F.broadcast(starts), "part").select("rep", (F.col("start") + F.col("at").bitwiseAND(_MASK)).alias("place"))


def _with_neighbours(classes: DataFrame, chunks: DataFrame) -> DataFrame:
    """place, rep, len, members, ends, lcp (turns shared with the class before, -1 for the first), after (with the next, -1 for the last)."""
    ranked = cut(_sorted_classes(classes, chunks).join(classes, "rep"))
    last = ranked.select((F.col("place") + 1).alias("place"), F.col("rep").alias("rep0"), F.col("len").alias("len0"))
    pairs = ranked.select("place", "rep", "len").join(last, "place")
    both = pairs.withColumn("j", F.explode(_chunk_numbers(F.least("len", "len0"))))
    both = both.join(chunks, ["rep", "j"]).join(chunks.select(F.col("rep").alias("rep0"), "j", F.col("s").alias("s0")), ["rep0", "j"])
    differs = F.array_position(F.zip_with("s", "s0", lambda a, b: F.coalesce(a == b, F.lit(False))), False)
    found = both.select("place", F.when(differs > 0, F.col("j") * CHUNK + differs - 1).alias("at")).groupBy("place").agg(F.min("at").alias("at"))
    lcp = cut(pairs.join(found, "place", "left").select("place", F.coalesce("at", F.least("len", "len0")).alias("lcp")))
    after = lcp.select((F.col("place") - 1).alias("place"), F.col("lcp").alias("after"))
    return cut(ranked.join(lcp, "place", "left").join(after, "place", "left").fillna(-1, ["lcp", "after"]))


_PART = "place long, part long, v long, k long, l long, cl long, fl long, vl long, nl long, r long, cr long, fr long, vr long, lb long, rb long, low long"


def _parts_of(b: int, rows: pd.DataFrame, blocks: dict[str, np.ndarray]) -> pd.DataFrame:
    """Nearest smaller values within block b, merged where equal values have no smaller one between them.

    l: place of the last smaller value before, r: of the first after; cl, fl and cr, fr: members and leaves before them; vl,
    vr: the values there; nl: the length at l; low: least id from l to before r. Where l or r is beyond the block, lb
    or rb is the block that holds it (-1: within this one; -2: there is none, which only happens at the end).
    """
    rows = rows.sort_values("place")
    place, lcp, rep, size = (rows[c].tolist() for c in ("place", "lcp", "rep", "len"))
    members, leaf = rows["members"].to_numpy(np.int64), (rows["len"] > rows["after"]).to_numpy(np.int64)
    cs, fs = (blocks["members"][b] + np.cumsum(members) - members).tolist(), (blocks["leaves"][b] + np.cumsum(leaf) - leaf).tolist()
    part, last, left, right, low, many = [], {}, {}, {}, {}, {}
    stack: list[int] = []
    for i, v in enumerate(lcp):
        inner = _BIG
        while stack and lcp[stack[-1]] > v:
            e = stack.pop()
            right[e] = i
            low[e] = inner = min(low[e], inner)
        least = min(rep[i], inner)  # of i and of all that it ends
        if stack and lcp[stack[-1]] == v:
            e = stack[-1]
            many[e] += 1
            low[e] = min(low[e], least)
        else:
            e, many[i], left[i] = i, 1, last[stack[-1]] if stack else -1
            low[i] = min(least, rep[left[i]]) if stack else least
            stack.append(i)
        last[e] = i
        part.append(e)
    for e, below in zip(reversed(stack), list(reversed(stack))[1:]):
        low[below] = min(low[below], low[e])
    least, value = blocks["rep"], blocks["lcp"]
    total = int(blocks["members"][-1]), int(blocks["leaves"][-1])
    out = []
    for i, e in enumerate(part):
        v, x, y = lcp[i], left[e], right.get(e, -1)
        row = [place[i], place[e], v, many[e] if i == e else 0]
        lb = rb = -1
        lows = [low[e]]
        if x >= 0:
            row += [place[x], cs[x], fs[x], lcp[x], size[x]]
        else:
            before = np.flatnonzero(value[:b] < v) if v >= 0 else np.array([], int)
            lb = int(before[-1]) if len(before) else -2
            row += [-1] * 5
            if lb >= 0:
                lows += least[lb + 1 : b].tolist()
        if y >= 0:
            row += [place[y], cs[y], fs[y], lcp[y]]
        else:
            beyond = np.flatnonzero(value[b + 1 :] < v)
            rb = b + 1 + int(beyond[0]) if len(beyond) else -2
            row += [int(blocks["total"][0]), *total, -1] if rb == -2 else [-1] * 4
            lows += least[b + 1 : rb if rb >= 0 else len(least)].tolist()
        out.append((*row, lb, rb, min(lows)))
    return pd.DataFrame(out, columns=[c.split()[0] for c in _PART.split(", ")])


_FOUND = "block long, side int, v long, at long, c long, f long, value long, size long, lows long"


def _answers_of(b: int, rows: pd.DataFrame, asked: pd.DataFrame, blocks: dict[str, np.ndarray]) -> pd.DataFrame:
    """For each value asked from other blocks the last (side 0) or first (side 1) smaller one of block b."""
    rows = rows.sort_values("place")
    lcp, rep = rows["lcp"].to_numpy(), rows["rep"].to_numpy()
    members, leaf = rows["members"].to_numpy(np.int64), (rows["len"] > rows["after"]).to_numpy(np.int64)
    cs, fs = blocks["members"][b] + np.cumsum(members) - members, blocks["leaves"][b] + np.cumsum(leaf) - leaf
    place, size, out = rows["place"].to_numpy(), rows["len"].to_numpy(), []
    for side, v in zip(asked["side"].tolist(), asked["v"].tolist()):
        i = np.flatnonzero(lcp < v)[-1 if side == 0 else 0]
        part = rep[i:] if side == 0 else rep[:i]
        out.append((b, side, v, place[i], cs[i], fs[i], lcp[i], size[i], part.min() if len(part) else _BIG))
    return pd.DataFrame(out, columns=[c.split()[0] for c in _FOUND.split(", ")])


def _tree(sorted_: DataFrame, block: int) -> DataFrame:
    """Nodes with a branch or an end: start, v (depth), p (depth of the parent, -1 for none), r (first place beyond), n, leaves,
    children, low (least id), parent_low."""
    rows = sorted_.withColumn("block", _div("place", block))
    leaf = F.col("len") > F.col("after")
    totals = rows.groupBy("block").agg(
        F.min("lcp").alias("lcp"), F.min("rep").alias("rep"), F.sum("members").alias("members"), F.count_if(leaf).alias("leaves"), F.count(F.lit(1)).alias("total")
    )
    minima = totals.orderBy("block").collect()  # about the square root of the number of rows
    blocks = {c: np.array([r[c] for r in minima], np.int64) for c in ("lcp", "rep")}
    blocks |= {c: np.cumsum([0] + [r[c] for r in minima]) for c in ("members", "leaves")}
    blocks["total"] = np.array([sum(r["total"] for r in minima)])
    shared = rows.sparkSession.sparkContext.broadcast(blocks)
    narrow = rows.select("block", "place", "lcp", "rep", "len", "members", "after")

    def parts_of(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        return _parts_of(int(key[0]), part, shared.value)

    def answers_of(key: tuple, part: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        return _answers_of(int(key[0]), part, asked, shared.value)

    found = cut(narrow.groupBy("block").applyInPandas(parts_of, _PART))
    parts = found.filter((F.col("place") == F.col("part")) & (F.col("v") >= 0))
    ask = lambda b, side: parts.filter(F.col(b) >= 0).select(F.col(b).alias("block"), F.lit(side).alias("side"), "v")
    asked = ask("lb", 0).unionByName(ask("rb", 1)).distinct()
    answers = cut(narrow.groupBy("block").cogroup(asked.groupBy("block")).applyInPandas(answers_of, _FOUND))
    one = lambda side, b, tag: answers.filter(F.col("side") == side).select(F.col("block").alias(b), "v", *[F.col(c).alias(tag + c) for c in ("at", "c", "f", "value", "size", "lows")])
    parts = parts.join(one(0, "lb", "a_"), ["lb", "v"], "left").join(one(1, "rb", "b_"), ["rb", "v"], "left")
    pick = lambda far, near: F.coalesce(far, near).alias(near)
    parts = cut(
        parts.select(
            "part", "v", "k", pick("a_at", "l"), pick("a_c", "cl"), pick("a_f", "fl"), pick("a_value", "vl"), pick("a_size", "nl"),
            pick("b_at", "r"), pick("b_c", "cr"), pick("b_f", "fr"), pick("b_value", "vr"), F.least("low", "a_lows", "b_lows").alias("low"),
        )
    )
    lows = found.select("place", "part").join(parts.select("part", "low"), "part").select(F.col("place").alias("x"), F.col("low").alias("parent_low"))
    same = [F.max(c).alias(c) for c in ("cl", "fl", "vl", "nl", "r", "cr", "fr", "vr")]
    inner = parts.groupBy(F.col("l").alias("start"), "v").agg(F.sum("k").alias("k"), F.min("low").alias("low"), *same)
    inner = inner.select(
        "start", "v", F.greatest("vl", "vr").alias("p"), "r", (F.col("cr") - F.col("cl")).alias("n"), (F.col("fr") - F.col("fl")).alias("leaves"),
        (F.col("k") + F.when(F.col("nl") == F.col("v"), 0).otherwise(1)).alias("children"), "low", F.when(F.col("vr") > F.col("vl"), F.col("r")).otherwise(F.col("start")).alias("x"),
    )
    one_ = F.lit(1).cast("long")
    tails = rows.filter(leaf).select(
        F.col("place").alias("start"), F.col("len").alias("v"), F.greatest("lcp", "after").alias("p"), (F.col("place") + 1).alias("r"), F.col("members").alias("n"),
        one_.alias("leaves"), (one_ * 0).alias("children"), F.col("rep").alias("low"), F.when(F.col("after") > F.col("lcp"), F.col("place") + 1).otherwise(F.col("place")).alias("x"),
    )
    return inner.unionByName(tails).join(lows, "x", "left").drop("x")


def _running(sums: DataFrame, block: int) -> DataFrame:
    """place, upto: running sum of w over places, by blocks."""
    rows = sums.withColumn("block", _div("place", block))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block
    starts = rows.groupBy("block").agg(F.sum("w").alias("b")).select("block", F.coalesce(F.sum("b").over(before), F.lit(0)).alias("b"))
    inside = Window.partitionBy("block").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("w", F.sum("w").over(inside)).join(F.broadcast(starts), "block").select("place", (F.col("w") + F.col("b")).alias("upto"))


def prefix_trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """Every node of the trie of conversations (convs: c, len; turns: c, depth, key, bytes, cum), the textless root among them.

    conv_id: least member; depth; parent_conv_id (null for the root); n_convs; n_children; n_leaves; saved_tokens:
    bytes that storing the node's and its descendants' last turns once would save; ends_sha256 of the ids of the members that end here.
    Without conversations there is no node.
    """
    classes = _classes(convs, turns)
    wanted = classes.select(F.col("rep").alias("c"), F.explode(_chunk_numbers(F.col("len"))).alias("j"))
    placed = turns.withColumn("j", _div(F.col("depth") - 1, CHUNK)).join(wanted, ["c", "j"])
    keys = F.transform(F.array_sort(F.collect_list(F.struct("depth", "key"))), lambda t: t["key"])
    chunks = cut(placed.groupBy(F.col("c").alias("rep"), "j").agg(keys.alias("s")))
    sorted_ = _with_neighbours(classes, chunks)
    block = max(BLOCK, math.isqrt(sorted_.count()))
    nodes = cut(_tree(sorted_, block).join(sorted_.select(F.col("place").alias("start"), "rep", "ends", F.col("len").alias("own")), "start"))
    spans = lambda of: of.withColumn("d0", F.explode(F.sequence(F.col("p") + 1, F.col("v"), F.lit(SPAN).cast("long"))))
    filled = spans(nodes.select("start", "v", "p", "rep")).repartition("start", "v", "d0")
    filled = filled.withColumn("depth", F.explode(F.sequence("d0", F.least(F.col("d0") + SPAN - 1, F.col("v")))))
    texts = turns.select(F.col("c").alias("rep"), "depth", "bytes", "cum")
    filled = cut(filled.join(texts, ["rep", "depth"], "left").fillna(0, ["bytes", "cum"]).select("start", "v", "d0", "depth", "bytes", "cum"))
    sizes = filled.groupBy("start", "v").agg(F.sum("bytes").alias("own_bytes"), F.max("cum").alias("top"))
    nodes = cut(nodes.join(sizes, ["start", "v"]).withColumn("w", (F.col("n") - 1) * F.col("own_bytes")))
    upto = cut(_running(nodes.groupBy(F.col("start").alias("place")).agg(F.sum("w").alias("w")), block))
    deeper = F.coalesce(F.sum("w").over(Window.partitionBy("start").orderBy("v").rowsBetween(1, Window.unboundedFollowing)), F.lit(0))
    nodes = nodes.withColumn("deeper", deeper).join(upto.select(F.col("place").alias("start"), F.col("upto").alias("here")), "start")
    nodes = nodes.withColumn("end", F.col("r") - 1).join(upto.select(F.col("place").alias("end"), F.col("upto").alias("there")), "end")
    whole = spans(nodes.select("start", "v", "p", "n", "leaves", "children", "low", "parent_low", "own", "ends", "top", (F.col("deeper") + F.col("there") - F.col("here")).alias("below")))
    depth, none = F.col("depth"), hashlib.sha256().hexdigest()
    return filled.join(whole, ["start", "v", "d0"]).select(
        F.col("low").alias("conv_id"), "depth",
        F.when(depth == 0, F.lit(None)).when(depth > F.col("p") + 1, F.col("low")).otherwise(F.col("parent_low")).cast("long").alias("parent_conv_id"),
        F.col("n").alias("n_convs"), F.when(depth < F.col("v"), F.lit(1)).otherwise(F.col("children")).cast("long").alias("n_children"), F.col("leaves").alias("n_leaves"),
        ((F.col("n") - 1) * (F.col("top") - F.col("cum") + F.col("bytes")) + F.col("below")).alias("saved_tokens"),
        F.when(depth == F.col("own"), F.col("ends")).otherwise(F.lit(none)).alias("ends_sha256"),
    )


def conversation_trie(conversations: DataFrame, rebuilt: bool = True) -> DataFrame:
    """The trie of conversations (conv_id, turn, role, text; other columns are not read).

    rebuilt: each conversation first takes the opening of another one (see rebuilt_conversations); else as they are.
    Nulls, ties and repeated rows: see ordered_turns. Copies share all nodes. A long text counts by its bytes only.
    """
    return prefix_trie(*(rebuilt_conversations if rebuilt else whole_conversations)(conversations))
