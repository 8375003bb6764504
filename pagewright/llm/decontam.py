"""Benchmark decontamination by winnowing, in DataFrame functions only.

Fingerprints of a word sequence are the least hash of each run of `span - gram + 1` successive word `gram`s. Two
texts that share `span` words share all grams of that stretch and so its least hash: joining fingerprints finds
every shared span. A second pass reads the texts with a common fingerprint again and extends each hit word by
word to both sides; stretches of at least `span` words are contamination. Items shorter than a span have one
window, looked up whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import ascii_lower, row_key, spread_join
from pagewright.llm.keysets import KeyFilter, without_keys
from pagewright.session import cut, stored

SPAN = 13
GRAM = 6
#: Fingerprints of the items that every task may hold; of more of them every task holds a bit filter, and what hits it is joined.
HELD_PRINTS = 20_000
#: Fixed separator: every ASCII character that is neither a letter nor a digit.
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SEPARATOR_CASED = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    text = F.coalesce(text.cast("string"), F.lit(""))
    return F.array_remove(F.split(ascii_lower(text), SEPARATOR), "")


def count_words(text: Column) -> Column:
    text = F.coalesce(text.cast("string"), F.lit(""))
    return F.size(F.array_remove(F.split(text, SEPARATOR_CASED), "")).cast("long")


def _gram_hashes(words: str, gram: int) -> Column:
    """Hash of the words at i..i+gram-1, for each i. words: a column's name, so that it is computed once."""
    w = F.col(words)
    last = F.size(w) - gram
    return F.transform(
        F.slice(w, F.lit(1), F.greatest(last + 1, F.lit(0))),
        lambda x, i: F.xxhash64(x, *[F.get(w, i + j) for j in range(1, gram)]),
    )


def _minima(grams: str, window: int) -> Column:
    """The least hash of each run of `window` grams."""
    g = F.col(grams)
    last = F.size(g) - window
    return F.transform(
        F.slice(g, F.lit(1), F.greatest(last + 1, F.lit(0))),
        lambda x, i: F.least(x, *[F.get(g, i + j) for j in range(1, window)]) if window > 1 else x,
    )


def _run_hashes(words: str, m: int) -> Column:
    """Hash of each run of m words, tagged by m."""
    w = F.col(words)
    return F.transform(
        F.slice(w, F.lit(1), F.greatest(F.size(w) - m + 1, F.lit(0))),
        lambda x, i: F.xxhash64(F.lit(m), x, *[F.get(w, i + j) for j in range(1, m)]),
    )


def _short_hashes(words: str, lengths: list[int]) -> Column:
    """Hashes of all runs of the lengths that short items have."""
    return F.concat(*[_run_hashes(words, m) for m in lengths])


def _sites(hashes: Column, m: int) -> Column:
    return F.transform(hashes, lambda x, i: F.struct(x.alias("x"), i.alias("i"), F.lit(m).alias("m")))


def contamination_hits(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    span: int = SPAN,
    gram: int = GRAM,
) -> DataFrame:
    """k1, k2 (see row_key), hits (distinct word ranges [start, end) of the document), items (distinct item ids).

    Only documents with a hit have a row. Null texts have no words; repeated documents share one row; items with
    equal texts are told apart by id. A null item id is the empty string in `items`.
    """
    run = span - gram + 1
    its = items.select(
        F.coalesce(F.col(item_id_col).cast("string"), F.lit("")).alias("item"), words_of(F.col(item_text_col)).alias("w")
    ).filter(F.size("w") > 0)
    its = cut(its)
    lengths = sorted(r[0] for r in its.select(F.size("w").alias("m")).filter(F.col("m") < span).distinct().collect())

    long_items = its.filter(F.size("w") >= span).withColumn("g", _gram_hashes("w", gram))
    long_items = long_items.withColumn("least", F.array_distinct(_minima("g", run)))
    side = span - gram
    w = F.col("w")
    at = F.transform(F.col("g"), lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    chosen = F.filter(at, lambda s: F.array_contains(F.col("least"), s["x"]))
    postings = long_items.select("item", "w", F.explode(chosen).alias("s")).select(
        "item",
        F.col("s.x").alias("x"),
        F.reverse(F.slice(w, F.greatest(F.col("s.i") - side, F.lit(0)) + 1, F.least(F.col("s.i"), F.lit(side)))).alias("il"),
        F.slice(w, F.col("s.i") + 1, F.lit(gram)).alias("im"),
        F.slice(w, F.col("s.i") + gram + 1, F.lit(side)).alias("ir"),
        F.lit(span).alias("need"),
    )
    if lengths:
        short = its.filter(F.size("w") < span).select(
            "item",
            F.explode(_short_hashes("w", lengths)).alias("x"),
            F.array().cast("array<string>").alias("il"),
            F.col("w").alias("im"),
            F.array().cast("array<string>").alias("ir"),
            F.size("w").alias("need"),
        )
        # of an item's own hashes only the one over all its words counts
        short = short.filter(F.col("x") == _whole_hash(lengths))
        postings = postings.unionByName(short)
    keys = ["x", "il", "im", "ir", "need"]
    postings = cut(postings.groupBy(*keys).agg(F.collect_set("item").alias("items")))
    wanted = postings.select("x").distinct()
    few = [r[0] for r in wanted.limit(HELD_PRINTS + 1).collect()]

    keyed = docs.select(*row_key(F.col(id_col), F.col(text_col)), F.col(text_col).alias("text"))
    prints = F.array_distinct(_minima("g", run))
    if lengths:
        prints = F.array_distinct(F.concat(prints, _short_hashes("w", lengths)))

    def grams(rows: DataFrame, *more: str) -> DataFrame:
        rows = rows.select("k1", "k2", *more, words_of(F.col("text")).alias("w"))
        return rows.select("k1", "k2", *more, "w", _gram_hashes("w", gram).alias("g"))

    if len(few) <= HELD_PRINTS:
        # every task looks the items' fingerprints up where it reads a text; no text moves
        known = lambda x: x.isin(few)
        again, some = grams(keyed), F.exists(prints, known)
    else:
        # a bit filter of the items' fingerprints: of the documents' fingerprints only those that hit it are shuffled
        spread = grams(keyed).select("k1", "k2", F.explode(prints).alias("x"))
        spread = KeyFilter(wanted.select(F.col("x").alias("k2"))).mark(spread, "x", "hit").filter("hit").drop("hit")
        shared = spread_join(spread, wanted, "x", ["k1", "k2"]).groupBy("k1", "k2").agg(F.collect_set("x").alias("xs"))
        has = F.map_from_arrays("xs", F.transform("xs", lambda x: F.lit(True)))
        shared = stored(shared.select("k1", "k2", has.alias("has")))
        known = lambda x: F.coalesce(F.col("has")[x], F.lit(False))
        again, some = grams(keyed.join(shared, ["k1", "k2"]), "has"), F.lit(True)

    sites = F.concat(_sites(F.col("g"), gram), *[_sites(_run_hashes("w", m), m) for m in lengths])
    # not a filter of rows: pushed down, it would compute the hashes anew for each place
    sites = F.filter(F.when(some, sites), lambda s: known(s["x"]))
    around = F.transform(
        sites,
        lambda s: F.struct(
            s["x"].alias("x"),
            s["i"].alias("i"),
            F.reverse(F.slice(w, F.greatest(s["i"] - side, F.lit(0)) + 1, F.least(s["i"], F.lit(side)))).alias("dl"),
            F.slice(w, s["i"] + 1, s["m"]).alias("dm"),
            F.slice(w, s["i"] + s["m"] + 1, F.lit(side)).alias("dr"),
        ),
    )
    # equal sites of a text, and equal postings of the items, meet once
    hits = again.select("k1", "k2", F.explode(around).alias("d")).select("k1", "k2", "d.*")
    hits = hits.groupBy("k1", "k2", "x", "dl", "dm", "dr").agg(F.collect_set("i").alias("at"))
    # a passage that many documents hold is one x: its sites are dealt over several tasks
    met = spread_join(hits, postings, "x", ["k1", "k2"]).filter(F.col("dm") == F.col("im"))
    met = met.withColumn("l", _agree("dl", "il")).withColumn("r", _agree("dr", "ir"))
    met = met.filter(F.col("l") + F.size("im") + F.col("r") >= F.col("need"))
    met = met.groupBy("k1", "k2", "at", "l", (F.size("im") + F.col("r")).alias("after")).agg(F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    ranges = met.select("k1", "k2", "items", F.transform("at", lambda i: F.struct((i - F.col("l")).alias("start"), (i + F.col("after")).alias("end"))).alias("hits"))
    return ranges.groupBy("k1", "k2").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("hits")))).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )


def _whole_hash(lengths: list[int]) -> Column:
    at = lambda i: F.get(F.col("im"), F.lit(i))
    whole = F.lit(None).cast("long")
    for m in lengths:
        whole = F.when(F.col("need") == m, F.xxhash64(F.lit(m), *[at(i) for i in range(m)])).otherwise(whole)
    return whole


def _agree(a: str, b: str) -> Column:
    """How many words the two contexts share from the hit outwards."""
    n = F.least(F.size(a), F.size(b))
    same = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x == y)
    first = F.array_position(same, False)
    return F.when(first > 0, first.cast("int") - 1).otherwise(n)


def _covered(hits: Column) -> Column:
    """Words in the union of the sorted ranges."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("to"))
    return F.aggregate(
        hits,
        zero,
        lambda acc, h: F.struct(
            (acc["n"] + F.greatest(h["end"] - F.greatest(h["start"], acc["to"]), F.lit(0))).alias("n"),
            F.greatest(acc["to"], h["end"]).alias("to"),
        ),
    )["n"]


def contamination_report(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options
) -> DataFrame:
    """One row per document with its share of benchmark words; the rule is n_hit > 0 and 20 * n_hit >= n_words.

    Documents without words have zeros, and without items all have; a null id stays null; a null item id counts as the empty
    text; an empty table gives an empty result; other columns are ignored. The join back is by row_key, whose hits have one row for each distinct
    (id, text), so repeated rows stay as many as they were.
    """
    hits = cut(contamination_hits(docs, items, id_col, text_col, **options))
    rows = docs.select(
        *row_key(F.col(id_col), F.col(text_col)), F.col(id_col).alias("doc_id"), count_words(F.col(text_col)).alias("n_words")
    )
    joined = rows.join(hits, ["k1", "k2"], "left")
    n_hit = F.coalesce(_covered(F.col("hits")), F.lit(0)).cast("long")
    ids = F.coalesce(F.col("items"), F.array().cast("array<string>"))
    return joined.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
    ).withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words")))


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that are not contaminated, as they were: null and empty texts stay, repeated rows stay or go together,
    all columns stay, whatever their names, and without items all documents stay. Texts are not shuffled but for rows whose
    key hits two bit filters (see keysets)."""
    hits = contamination_hits(docs, items, id_col, text_col, **options)
    hits = cut(hits.select("k1", "k2", _covered(F.col("hits")).alias("n")).filter("n > 0"))
    k1, k2 = row_key(F.col(id_col), F.col(text_col))
    keys = KeyFilter(hits).mark(docs.select(k1, k2, F.col(text_col).alias("text")), "k2", "hit")
    keys = cut(keys.select("k1", "k2", F.when(F.col("hit"), count_words(F.col("text"))).alias("n_words")))
    bad = keys.filter("n_words is not null").join(hits, ["k1", "k2"]).filter("20 * n >= n_words").select("k1", "k2").distinct()
    keyed = docs.select(F.struct("*").alias("_row"), k1, k2)
    return without_keys(keyed, cut(bad), keys).select("_row.*")
