"""Error rates of recognised texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions.let import let
from pagewright.functions.text import tokens
from pagewright.operators.places import numbered


def error_rate(edits: Column, units: Column) -> Column:
    """struct of edits, reference_units, rate. An empty reference has rate 0 if nothing was read, else 1."""
    rate = F.when(units > 0, edits / units).when(edits > 0, F.lit(1.0)).otherwise(F.lit(0.0))
    return F.struct(edits.cast("long").alias("edits"), units.cast("long").alias("reference_units"), rate.alias("rate"))


def character_error_rate(reference: Column, prediction: Column) -> Column:
    """Edits by code points, without any normalisation."""
    return error_rate(F.levenshtein(reference, prediction), F.char_length(reference))


def _as_letters(words: Column, among: Column) -> Column:
    """One code point for each word, by its place among the distinct words (surrogates are skipped)."""
    code = lambda w: F.array_position(among, w) + 255
    place = lambda w: F.when(code(w) < 0xD800, code(w)).otherwise(code(w) + 0x800)
    hexes = F.array_join(F.transform(words, lambda w: F.lpad(F.hex(place(w)), 8, "0")), "")
    return F.when(F.size(words) == 0, "").otherwise(F.decode(F.unhex(hexes), "UTF-32"))


def word_error_rate(reference: Column, prediction: Column) -> Column:
    """Edits by words between Unicode white space. Words become letters, whose edit distance is the words'."""
    pair = F.struct(tokens(reference).alias("r"), tokens(prediction).alias("p"))
    spelled = lambda s, among: F.levenshtein(_as_letters(s["r"], among), _as_letters(s["p"], among))
    edits = let(pair, lambda s: let(F.array_union(s["r"], s["p"]), lambda among: spelled(s, among)))
    return error_rate(edits, F.size(tokens(reference)))


def evaluate(reference: Column, prediction: Column) -> Column:
    """struct of character_error, word_error and exact_match."""
    return F.struct(
        character_error_rate(reference, prediction).alias("character_error"),
        word_error_rate(reference, prediction).alias("word_error"),
        (reference == prediction).alias("exact_match"),
    )


def h_mean(precision: Column, recall: Column) -> Column:
    return F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(F.lit(0.0))


def evaluate_documents(reference: DataFrame, prediction: DataFrame, key: str = "image_id") -> DataFrame:
    """key, character_error, word_error, exact_match for every key that both tables hold. Only `doc.text` is compared:
    neither corrections nor the documents' own rules count. A null text is empty."""
    text = lambda name: F.coalesce(F.col("doc.text"), F.lit("")).alias(name)
    both = reference.select(key, text("reference")).join(prediction.select(key, text("prediction")), key)
    return both.select(key, evaluate(F.col("reference"), F.col("prediction")).alias("e")).select(key, "e.*")


def percentiles(rows: DataFrame, group: str, value: str, shares: tuple[float, ...] = (0.5, 0.95), error: float = 0.001) -> DataFrame:
    """group, n, p50, p95, ... from a sketch of each group that merges across tasks.

    The rank of a result is off by `error` times n, and one, at most. Null and NaN values count nothing.
    """
    known = rows.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    found = F.percentile_approx(value, list(shares), round(1 / error))
    made = known.groupBy(group).agg(F.count(F.lit(1)).alias("n"), found.alias("_p"))
    return made.select(group, "n", *[F.get("_p", F.lit(i)).alias(_percentile_name(s)) for i, s in enumerate(shares)])


def exact_percentiles(rows: DataFrame, group: str, value: str, shares: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """The same, exactly, with straight lines between neighbours. Values get their place in order by ranges, so that a large group is
    neither sorted in one task nor held in memory."""
    known = rows.select(F.col(group).alias("_g"), F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
    placed = numbered(known, "_g", ["_v"])
    sizes = placed.groupBy("_g").agg(F.count(F.lit(1)).alias("n"))
    wanted = sizes.withColumn("k", F.explode(F.array(*[F.lit(i) for i in range(len(shares))])))
    rank = F.element_at(F.array(*[F.lit(float(s)) for s in shares]), F.col("k") + 1) * (F.col("n") - 1)
    wanted = wanted.withColumn("at", rank).withColumn("_nth", F.explode(F.array_distinct(F.array(F.floor("at"), F.ceil("at")))))
    met = placed.alias("p").join(wanted.alias("w"), F.expr("p._g <=> w._g and p._nth = w._nth"))
    share = F.when(F.floor("w.at") == F.ceil("w.at"), 1.0).otherwise(1 - F.abs(F.col("p._nth") - F.col("w.at")))
    one = lambda i: F.sum(F.when(F.col("w.k") == i, F.col("p._v") * share)).alias(_percentile_name(shares[i]))
    found = met.groupBy(F.col("w._g").alias(group)).agg(F.first("w.n").alias("n"), *[one(i) for i in range(len(shares))])
    return found


def _percentile_name(share: float) -> str:
    return f"p{share * 100:g}".replace(".", "_")
