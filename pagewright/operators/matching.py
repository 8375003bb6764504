"""One-to-one matching of reference and predicted regions, in rounds, and detection and end-to-end scores.

The rule is sequential (references in order, each takes its best free prediction), but a reference is decided as soon as no
earlier one wants the prediction that it would take. Each round decides all such references at once, by aggregates over
the candidate pairs; no page is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions.evaluation import h_mean
from pagewright.functions.geometry import bounds
from pagewright.functions.polygons import intersection_area, own_area, polygon_iou
from pagewright.operators.grid import levels_of, overlapping, usable, with_level
from pagewright.session import cut

#: The text of a region that nobody can read, and the share of a prediction within one that excuses it.
UNREADABLE, EXCUSED = "###", 0.5
#: Shares of polygons that differ by no more are equal: corners of a turned region are rounded, and all that follows from them.
ALIKE, DIGITS = 1e-9, 11


def assign_in_order(candidates: DataFrame, page: str = "image_id") -> DataFrame:
    """page, ref_idx, pred_idx, iou: the matches among candidate pairs of these columns.

    References go by ref_idx; each takes the free prediction with the largest iou, of equal ones that with the least
    pred_idx. Rounds grow with the longest chain of references that wait for each other; each is written to the shared
    checkpoint folder.
    """
    edges, found = cut(candidates.select(page, "ref_idx", "pred_idx", "iou")), []
    same = lambda a, b, *cs: _same(page, a, b, *[(c, c) for c in cs])
    while not edges.isEmpty():
        best = edges.groupBy(page, "ref_idx").agg(F.max(F.struct("iou", (-F.col("pred_idx")).alias("minus"))).alias("b"))
        best = best.select(page, "ref_idx", (-F.col("b.minus")).alias("pred_idx"), "b.iou")
        first = edges.groupBy(page, "pred_idx").agg(F.min("ref_idx").alias("ref_idx"))
        matched = cut(best.alias("x").join(first.alias("y"), same("x", "y", "ref_idx", "pred_idx")).select("x.*"))
        found.append(matched)
        left = edges.alias("x").join(matched.alias("y"), same("x", "y", "ref_idx"), "left_anti")
        edges = cut(left.alias("x").join(matched.alias("y"), same("x", "y", "pred_idx"), "left_anti"))
    if not found:
        return edges
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _placed(rows: DataFrame) -> DataFrame:
    """Rows with their bounding box and level; those that have no extent can overlap nothing.

    They are written before they are paired: a plan that carries how each number came about takes the optimizer long.
    """
    return cut(with_level(rows.filter(usable())))


def _shared_box() -> Column:
    """Shared area of the boxes of a pair."""
    side = lambda at, size: F.least(F.col(f"l.{at}") + F.col(f"l.{size}"), F.col(f"r.{at}") + F.col(f"r.{size}")) - F.greatest(f"l.{at}", f"r.{at}")
    return F.greatest(side("x", "width"), F.lit(0.0)) * F.greatest(side("y", "height"), F.lit(0.0))


def greedy_matches(references: DataFrame, predictions: DataFrame, page: str = "image_id", iou: float = 0.5) -> DataFrame:
    """page, ref_idx, pred_idx: one-to-one matches in input order of axis-aligned boxes (page, idx, x, y, width, height).

    References are taken in order of idx; each takes the first free prediction with the largest overlap, `iou` (over 0) at
    least. Boxes without finite numbers or extent match nothing.
    """
    refs, preds = (_placed(t.select(page, "idx", "x", "y", "width", "height")) for t in (references, predictions))
    pairs = overlapping(refs, preds, levels_of(refs, preds), page)
    shared = _shared_box()
    union = F.col("l.width") * F.col("l.height") + F.col("r.width") * F.col("r.height") - shared
    scored = pairs.select(F.col(f"l.{page}").alias(page), F.col("l.idx").alias("ref_idx"), F.col("r.idx").alias("pred_idx"), F.try_divide(shared, union).alias("iou"))
    return assign_in_order(scored.filter(F.col("iou") >= iou), page).select(page, "ref_idx", "pred_idx")


def _boxed(regions: DataFrame, page: str) -> DataFrame:
    """Regions (page, idx, points) with their area and the box around their points, without their texts."""
    known = regions.select(page, "idx", "points", own_area(F.col("points")).alias("area"), bounds(F.col("points")).alias("_b"))
    return _placed(known.select(page, "idx", "points", "area", "_b.x", "_b.y", "_b.width", "_b.height"))


def _same(page: str, a: str, b: str, *columns: tuple[str, str]) -> Column:
    """Join condition: one page (a null page is a page) and equal columns."""
    on = F.col(f"{a}.{page}").eqNullSafe(F.col(f"{b}.{page}"))
    for x, y in columns:
        on = on & (F.col(f"{a}.{x}") == F.col(f"{b}.{y}"))
    return on


def readable(references: DataFrame) -> DataFrame:
    """References that count: all but those marked unreadable."""
    return references.filter(~F.coalesce(F.col("text") == UNREADABLE, F.lit(False)))


def _excused(masks: DataFrame, preds: DataFrame, page: str) -> DataFrame:
    """page, idx of the boxed predictions of which a boxed mask covers more than half; half to ALIKE is not more."""
    pairs = overlapping(preds, masks, levels_of(masks, preds), page)
    may = pairs.filter(F.least(_shared_box(), "r.area") > F.col("l.area") * EXCUSED)
    covered = may.filter(intersection_area(F.col("l.points"), F.col("r.points")) > F.col("l.area") * (EXCUSED + ALIKE))
    return cut(covered.select(F.col(f"l.{page}").alias(page), F.col("l.idx").alias("idx")).distinct())


def counted_predictions(references: DataFrame, predictions: DataFrame, page: str = "image_id") -> DataFrame:
    """Predictions of which no unreadable region covers more than half."""
    excused = _excused(_boxed(references.filter(F.col("text") == UNREADABLE), page), _boxed(predictions, page), page)
    return predictions.alias("p").join(excused.alias("e"), _same(page, "p", "e", ("idx", "idx")), "left_anti")


def folded_text(text: Column) -> Column:
    """Text for comparison: without ASCII punctuation at both ends, letters of any case alike."""
    return F.replace(F.lower(F.regexp_replace(text, r"^\p{Punct}+|\p{Punct}+\z", "")), F.lit("ß"), F.lit("ss"))


def _with_ties(candidates: DataFrame, page: str) -> DataFrame:
    """Candidates with the ious of a reference that follow each other within ALIKE all set to the largest of them."""
    by = Window.partitionBy(page, "ref_idx").orderBy(F.desc("iou")).rowsBetween(Window.unboundedPreceding, 0)
    before = F.lag("iou").over(Window.partitionBy(page, "ref_idx").orderBy(F.desc("iou")))
    first = candidates.withColumn("_first", F.when(F.coalesce(before - F.col("iou") > ALIKE, F.lit(True)), F.col("iou")))
    return first.withColumn("iou", F.last("_first", ignorenulls=True).over(by)).drop("_first")


def polygon_matches(references: DataFrame, predictions: DataFrame, page: str = "image_id", iou: float = 0.5) -> DataFrame:
    """page, ref_idx, pred_idx, iou, same_text: one-to-one matches of polygons (page, idx, points, text).

    As greedy_matches, by the areas of the polygons themselves, to ALIKE: a pair at `iou` matches and equal overlaps are equal
    whatever way a page is turned. iou has DIGITS digits. Unreadable references match nothing, and predictions that
    lie in them by more than half are left out before. same_text compares folded texts; a null text is like no other.
    """
    return _polygon_matches(references, predictions, page, iou)[0]


def _polygon_matches(references: DataFrame, predictions: DataFrame, page: str, iou: float) -> tuple[DataFrame, DataFrame]:
    """The matches, and page, idx of the predictions that are excused."""
    refs, preds = _boxed(readable(references), page), _boxed(predictions, page)
    excused = _excused(_boxed(references.filter(F.col("text") == UNREADABLE), page), preds, page)
    preds = preds.alias("p").join(excused.alias("e"), _same(page, "p", "e", ("idx", "idx")), "left_anti")
    pairs = overlapping(refs, preds, levels_of(refs, preds), page)
    most = F.least(_shared_box(), "l.area", "r.area")  # polygons share no more than their boxes do
    least = iou - ALIKE
    may = pairs.filter(most >= least * (F.col("l.area") + F.col("r.area") - most))
    met = cut(may.withColumn("shared", intersection_area(F.col("l.points"), F.col("r.points"))))
    scored = met.withColumn("iou", F.round(polygon_iou(F.col("l.points"), F.col("r.points"), F.col("shared")), DIGITS)).filter(F.col("iou") >= least)
    candidates = scored.select(F.col(f"l.{page}").alias(page), F.col("l.idx").alias("ref_idx"), F.col("r.idx").alias("pred_idx"), "iou")
    found = assign_in_order(_with_ties(candidates, page), page)
    said = found.alias("m").join(references.alias("r"), _same(page, "m", "r", ("ref_idx", "idx"))).select("m.*", F.col("r.text").alias("_said"))
    both = said.alias("m").join(predictions.alias("p"), _same(page, "m", "p", ("pred_idx", "idx")))
    equal = F.coalesce(folded_text(F.col("m._said")) == folded_text(F.col("p.text")), F.lit(False))
    return both.select(f"m.{page}", "m.ref_idx", "m.pred_idx", "m.iou", equal.alias("same_text")), excused


def end_to_end_scores(references: DataFrame, predictions: DataFrame, page: str = "image_id", iou: float = 0.5) -> DataFrame:
    """page, refs, preds, hits, text_hits, precision, recall, h_mean and the same of hits with equal text (e2e_...).

    Every page of either table has a row; a share of nothing is null.
    """
    count = lambda t, n: t.groupBy(page).agg(F.count(F.lit(1)).alias(n))
    matches, excused = _polygon_matches(references, predictions, page, iou)
    hits = matches.groupBy(page).agg(F.count(F.lit(1)).alias("hits"), F.count_if("same_text").alias("text_hits"))
    rows = references.select(page).union(predictions.select(page)).distinct()
    for t in (count(readable(references), "refs"), count(predictions, "preds"), count(excused, "_excused"), hits):
        rows = rows.alias("a").join(t.alias("b"), _same(page, "a", "b"), "left").select("a.*", *[f"b.{c}" for c in t.columns if c != page])
    rows = rows.withColumn("preds", F.col("preds") - F.coalesce("_excused", F.lit(0))).drop("_excused")
    rows = rows.fillna(0, ["refs", "preds", "hits", "text_hits"])
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    for tag, n in (("", "hits"), ("e2e_", "text_hits")):
        p, r = share(n, "preds"), share(n, "refs")
        rows = rows.withColumns({f"{tag}precision": p, f"{tag}recall": r, f"{tag}h_mean": h_mean(p, r)})
    return rows
