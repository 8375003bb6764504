"""Which crops each recogniser sees, and which candidate wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagewright import dims
from pagewright.functions.text import contains_script, script_fraction

AUTO_CONFIDENCE, SELECTIVE_CONFIDENCE = 0.99, 0.82
SCRIPT_BONUS, MISSING_SCRIPT_PENALTY = 0.004, 0.08
SPECIALISTS = {"latin": "Latin", "cyrillic": "Cyrillic", "korean": "Korean"}


def auto_specialist(text: Column, confidence: Column, script: str) -> Column:
    """Automatic requests: a specialist sees a crop that was not read, read with doubt, or holds its script."""
    return F.coalesce(confidence.isNull() | (confidence < AUTO_CONFIDENCE) | contains_script(text, script), F.lit(True))


def selective_specialist(text: Column, confidence: Column, script: str = "Cyrillic") -> Column:
    """Explicit requests: as above, with more trust in the first reading."""
    return F.coalesce(confidence.isNull() | (confidence < SELECTIVE_CONFIDENCE) | contains_script(text, script), F.lit(True))


def route_crops(boxes: DataFrame, primary: DataFrame, plans: DataFrame, keys: tuple[str, str] = ("image_id", "box_idx")) -> DataFrame:
    """keys, specialist: the crops that each specialist reads.

    boxes: keys. primary: keys, text, confidence (of the primary recogniser; a crop may be missing). plans: one row
    an image with auto, primary, latin, cyrillic, korean. Without a primary recogniser a specialist sees every crop.
    """
    seen = boxes.join(primary.select(*keys, "text", "confidence"), list(keys), "left").join(plans, keys[0])
    text, confidence = F.col("text"), F.col("confidence")
    wanted = [
        F.when(
            F.col(name)
            & F.when(F.col("auto"), auto_specialist(text, confidence, script))
            .when(~F.col("primary"), F.lit(True))
            .when(F.lit(name == "cyrillic"), selective_specialist(text, confidence))
            .otherwise(F.lit(True)),
            F.lit(name),
        )
        for name, script in SPECIALISTS.items()
    ]
    return seen.select(*keys, F.explode(F.array_compact(F.array(*wanted))).alias("specialist"))


def candidate_rank(recognizer: Column, text: Column, confidence: Column) -> Column:
    """Confidence, with a bonus for a specialist's own script or a penalty for its absence."""
    rank = confidence
    for name, script in SPECIALISTS.items():
        share = script_fraction(text, script)
        own = F.when(share > 0, confidence + SCRIPT_BONUS * share * share).otherwise(confidence - MISSING_SCRIPT_PENALTY)
        rank = F.when(recognizer == name, own).otherwise(rank)
    return rank


def candidate_priority(recognizer: Column) -> Column:
    return F.when(recognizer == "latin", 1).when(recognizer == "cyrillic", 2).when(recognizer == "korean", 3).otherwise(0)


def rank_candidates(candidates: DataFrame, min_confidence: float = 0.8, keys: tuple[str, ...] = ("image_id", "box_idx")) -> DataFrame:
    """Eligible candidates with `place` (1 is best): by rank, confidence, priority, text."""
    sure = (F.col("confidence") >= min_confidence) & ~F.isnan("confidence")
    ranked = candidates.filter(sure)
    ranked = ranked.withColumn("rank", candidate_rank(F.col("recognizer"), F.col("text"), F.col("confidence")))
    ranked = ranked.withColumn("priority", candidate_priority(F.col("recognizer")))
    order = Window.partitionBy(*keys).orderBy(F.desc("rank"), F.desc("confidence"), "priority", "text")
    return ranked.withColumn("place", F.row_number().over(order))


def select_candidates(candidates: DataFrame, min_confidence: float = 0.8, keys: tuple[str, ...] = ("image_id", "box_idx")) -> DataFrame:
    """The winner of each box with its alternatives; boxes without an eligible candidate have no row.

    Alternatives are the other texts in rank order, each once, with the confidence clamped to 0..1.
    """
    ranked = rank_candidates(candidates, min_confidence, keys)
    boxes = ranked.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("place", "recognizer", "text", "confidence"))).alias("all"))
    best = F.get("all", F.lit(0))
    others = F.filter(
        F.col("all"),
        lambda c: (c["text"] != best["text"])
        & ~F.exists(F.col("all"), lambda d: (d["place"] < c["place"]) & (d["text"] == c["text"])),
    )
    shown = F.transform(others, lambda c: F.struct(c["text"].alias("text"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), c["confidence"])).alias("confidence")))
    return boxes.select(
        *keys, best["recognizer"].alias("recognizer"), best["text"].alias("text"), best["confidence"].alias("confidence"), shown.alias("alternatives")
    )


def required_models(requests: DataFrame) -> DataFrame:
    """request_id, model, bytes of every model that a request (request_id, quality, plan) needs."""
    spark = requests.sparkSession
    wide = requests.join(F.broadcast(dims.profiles(spark)), "quality")  # four profiles
    first = F.when(F.col("plan.primary"), F.col("recognizer"))
    packs = [F.when(F.col(f"plan.{k}"), F.lit(m)) for k, m in dims.SPECIALISTS.items()]
    needed = F.array_distinct(F.array_compact(F.array(F.col("detector"), first, *packs)))
    rows = wide.select("request_id", F.explode(needed).alias("model"))
    return rows.join(F.broadcast(dims.models(spark).select("model", "bytes")), "model").select("request_id", "model", "bytes")
