"""The registered queries of the document engine: name to (spark, folder) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagewright import dims
from pagewright.functions import evaluation, geometry, language, text
from pagewright.operators import boxes, ctc, matching, ordering, overlaps, packing, raster, recognition, routing, validate
from pagewright.plans import inputs
from pagewright.sources import documents, images, tsv
from pagewright.streaming import correlate, progress, worker

Session = SparkSession

REQUESTS = [
    (0, []), (1, ["auto"]), (2, ["en"]), (3, ["de"]), (4, ["de", "en"]), (5, ["ru"]), (6, ["en", "ru"]), (7, ["ko"]), (8, ["ja"]),
    (9, ["de", "zh"]), (10, ["ru", "ko"]), (11, ["DEU", "ger", "deu"]), (12, ["chi_sim"]), (13, [" ru-RU "]), (14, ["sr-Latn"]), (15, ["xx", "en"]), (16, ["dan"]), (17, ["AUTO"]), (18, ["swe", "ukr", "vie"]),
]
SPELLINGS = ["ru-RU", "jpn", "chi_sim", "ko-KR", "kor", "deu", "sr-Latn", "rs_latin", " German ", "zh-Hant", "zh_TW", "chi_tra", "cze", "xx-YY", "en", "nob", "dan", "swe", "zh-Hans", "gre", "may"]


def _rows(spark: Session, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reading_order(spark: Session, sf_dir: str) -> DataFrame:
    ordered = ordering.reading_order(inputs.lines(spark, sf_dir))
    return ordered.select("image_id", "line_id", F.col("row").cast("long"), F.col("order").cast("long").alias("line_order"))


def rebuild_text(spark: Session, sf_dir: str) -> DataFrame:
    return ordering.rebuild_text(ordering.reading_order(inputs.lines(spark, sf_dir)))


def _quads(spark: Session, sf_dir: str) -> DataFrame:
    """Boxes with the lower edge moved to the right, so that they are no rectangles."""
    quad = F.array(
        geometry.point(F.col("x"), F.col("y")), geometry.point(F.col("x") + F.col("width"), F.col("y") + 3),
        geometry.point(F.col("x") + F.col("width") + 5, F.col("y") + F.col("height") + 3), geometry.point(F.col("x") + 5, F.col("y") + F.col("height")),
    )
    return inputs.lines(spark, sf_dir).withColumn("quad", quad)


def line_bounds(spark: Session, sf_dir: str) -> DataFrame:
    rows = _quads(spark, sf_dir).withColumn("b", geometry.bounds(F.col("quad")))
    return rows.select("line_id", "b.x", "b.y", "b.width", "b.height", F.round(geometry.area(F.col("quad")), 6).alias("area"))


def crop_geometry(spark: Session, sf_dir: str) -> DataFrame:
    rows = _quads(spark, sf_dir).withColumn("g", geometry.crop_geometry(F.col("quad")))
    return rows.select(
        "line_id", *[F.round(f"g.{c}", 6).alias(c) for c in ("width", "height", "cx", "cy", "angle")],
        F.round(geometry.unclip_delta(F.col("g.width"), F.col("g.height"), F.lit(1.4)), 6).alias("delta"),
        geometry.recognition_width(F.col("width").cast("int"), F.col("height").cast("int")).cast("long").alias("rec_width"),
    )


def overlap_dedup(spark: Session, sf_dir: str) -> DataFrame:
    return overlaps.drop_overlaps(inputs.lines(spark, sf_dir)).select("image_id", "position")


def tile_offsets(spark: Session, sf_dir: str) -> DataFrame:
    sides = F.element_at(F.array(*[F.lit(p[7]) for p in dims.PROFILES]), (F.col("p_partkey") % 4 + 1).cast("int"))
    parts = _rows(spark, sf_dir, "part").select("p_partkey", ((F.col("p_partkey") * 37) % 6000 + 100).alias("length"), sides.alias("tile"))
    rows = parts.select("p_partkey", F.posexplode(boxes.tile_offsets(F.col("length"), F.col("tile"))).alias("tile_no", "tile_start"))
    return rows.select("p_partkey", F.col("tile_no").cast("long"), "tile_start")


def tiled_images(spark: Session, sf_dir: str) -> DataFrame:
    parts = _rows(spark, sf_dir, "part").select("p_partkey", ((F.col("p_partkey") * 37) % 4000 + 100).alias("w"), ((F.col("p_partkey") * 91) % 4000 + 100).alias("h"))
    return parts.select("p_partkey", boxes.should_tile(F.col("w"), F.col("h"), F.lit(1280)).alias("tiled"))


def crop_batches(spark: Session, sf_dir: str) -> DataFrame:
    crops = inputs.lines(spark, sf_dir).select("image_id", F.col("line_id").alias("box_idx"), "width", "height")
    rows = boxes.ratio_batches(crops, F.lit(8))
    return rows.select("image_id", "box_idx", F.col("batch").cast("long"), F.round("batch_max_ratio", 6).alias("batch_max_ratio"))


def width_batches(spark: Session, sf_dir: str) -> DataFrame:
    crops = inputs.lines(spark, sf_dir).select("image_id", F.col("line_id").alias("box_idx"), F.ceil(F.col("width") * 48 / F.col("height")).alias("width"))
    return packing.width_batches(crops, 8, 8192).select("image_id", "box_idx", "width", F.col("batch").cast("long"))


def script_tags(spark: Session, sf_dir: str) -> DataFrame:
    texts = _rows(spark, sf_dir, "documents").select("text").unionByName(spark.sql(inputs.WORDS).select(F.col("word").alias("text")))
    return texts.groupBy(text.script_tag(F.col("text")).alias("tag")).agg(F.count(F.lit(1)).alias("n"))


def _worded(spark: Session, sf_dir: str) -> DataFrame:
    """doc_id and the document's text after a word of some script, by its id."""
    words = F.broadcast(spark.sql(inputs.WORDS).withColumnRenamed("n", "k"))  # twelve rows
    docs = _rows(spark, sf_dir, "documents").withColumn("k", F.col("doc_id") % len(inputs.TEXTS))
    return docs.join(words, "k").select("doc_id", "word", F.concat_ws(" ", "word", "text").alias("text"))


def script_fractions(spark: Session, sf_dir: str) -> DataFrame:
    words = _worded(spark, sf_dir).withColumn("word", F.col("text"))
    return words.select("doc_id", *[F.round(text.script_fraction(F.col("word"), s), 6).alias(s.lower()) for s in ("Latin", "Cyrillic", "Korean")])


def language_codes(spark: Session, sf_dir: str) -> DataFrame:
    given = _rows(spark, sf_dir, "documents").filter("lang is not null").select(F.col("lang").alias("raw")).distinct()
    rows = given.unionByName(spark.createDataFrame([(s,) for s in SPELLINGS], "raw string")).distinct()
    code = language.normalize_language(F.col("raw"))
    return rows.select("raw", code.alias("code"), code.isin(dims.SUPPORTED).alias("supported"), language.normalize_language3(F.col("raw")).alias("code3"))


def _requests(spark: Session, sf_dir: str) -> DataFrame:
    """A request for each document, one of the spellings by its id."""
    kinds = spark.createDataFrame(REQUESTS, "kind long, request array<string>")
    docs = _rows(spark, sf_dir, "documents").select(F.col("doc_id").alias("request_id"), (F.col("doc_id") % len(REQUESTS)).alias("kind"))
    return docs.join(F.broadcast(kinds), "kind").select("request_id", "request")  # nineteen rows


def recognizer_plans(spark: Session, sf_dir: str) -> DataFrame:
    plan = language.recognizer_plan(language.resolve_languages(F.col("request")))
    bad = F.array_join(language.unsupported_languages(F.col("request")), ",")
    return _requests(spark, sf_dir).select("request_id", plan.alias("p"), bad.alias("unsupported")).select("request_id", "p.*", "unsupported")


def required_models(spark: Session, sf_dir: str) -> DataFrame:
    plan = language.recognizer_plan(language.resolve_languages(F.col("request")))
    rows = _requests(spark, sf_dir).filter(F.size(language.unsupported_languages(F.col("request"))) == 0).select("request_id", plan.alias("plan"), F.lit("balanced").alias("quality"))
    return routing.required_models(rows).groupBy("request_id").agg(F.count(F.lit(1)).alias("models"), F.sum("bytes").alias("bytes"))


def line_languages(spark: Session, sf_dir: str) -> DataFrame:
    words = _worded(spark, sf_dir)
    hints = F.array(F.lit("ru"), F.lit("de"), F.lit("zh"))
    none = F.array().cast("array<string>")
    return words.select("doc_id", language.line_language(F.col("word"), none).alias("free"), language.line_language(F.col("word"), hints).alias("hinted"))


def select_candidate(spark: Session, sf_dir: str) -> DataFrame:
    best = routing.select_candidates(inputs.candidates(spark, sf_dir))
    return best.select("image_id", "box_idx", "recognizer", "text", F.round("confidence", 6).alias("confidence"))


def candidate_alternatives(spark: Session, sf_dir: str) -> DataFrame:
    best = routing.select_candidates(inputs.candidates(spark, sf_dir))
    return best.select("image_id", "box_idx", F.array_join(F.transform("alternatives", lambda a: a["text"]), "|").alias("others"))


def route_crops(spark: Session, sf_dir: str) -> DataFrame:
    seen = inputs.candidates(spark, sf_dir)
    primary = seen.filter("recognizer = 'primary'").select("image_id", "box_idx", "text", "confidence")
    found = seen.select("image_id", "box_idx").distinct()
    on = lambda k, n: (F.col("image_id") % n != k)
    plans = found.select("image_id").distinct().withColumns({"auto": on(0, 2), "primary": on(1, 3), "latin": on(2, 3), "cyrillic": on(2, 5), "korean": on(3, 5)})
    return routing.route_crops(found, primary, plans)


def tsv_words(spark: Session, sf_dir: str) -> DataFrame:
    words = tsv.tsv_words(tsv.read_tsv_lines(inputs.tsv_documents(spark, sf_dir)), 0.5)
    return words.select("image_id", F.col("position").cast("long"), "text", F.round("confidence", 6).alias("confidence"))


def tsv_lines(spark: Session, sf_dir: str) -> DataFrame:
    lines = tsv.tsv_text_lines(tsv.tsv_words(tsv.read_tsv_lines(inputs.tsv_documents(spark, sf_dir)), 0.5))
    return lines.select("image_id", "line_id", "x", "y", "width", "height", "text", F.round("confidence", 9).alias("confidence"), F.size("words").cast("long").alias("n_words"))


def tsv_pages(spark: Session, sf_dir: str) -> DataFrame:
    return tsv.tsv_pages(tsv.read_tsv_lines(inputs.tsv_documents(spark, sf_dir)))


def _posteriors(spark: Session, sf_dir: str) -> DataFrame:
    """Sixteen steps of four tokens from the numbers of each vector."""
    rows = _rows(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item"), F.posexplode("embedding").alias("at", "score"))
    return rows.select("item", F.call_function("div", F.col("at"), F.lit(4)).cast("int").alias("step"), (F.col("at") % 4).alias("token"), F.col("score").cast("double"))


def ctc_decode(spark: Session, sf_dir: str) -> DataFrame:
    entries = spark.createDataFrame([(1, "a"), (2, "b"), (3, " ")], "token int, entry string")
    items = _rows(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item"))
    decoded = ctc.ctc_decode(ctc.best_tokens(_posteriors(spark, sf_dir)), entries, items)
    return decoded.select("item", "text", F.round("confidence", 6).alias("confidence"), F.size("columns").cast("long").alias("n"))


def word_boxes(spark: Session, sf_dir: str) -> DataFrame:
    """Words of every benchmark text, with as many columns as characters."""
    rows = _rows(spark, sf_dir, "benchmark").withColumn("n", F.char_length("text"))
    columns = F.sequence(F.lit(0), F.col("n") - 1)
    centres = ctc.character_centres(F.col("text"), columns, F.col("n") + 2, F.lit(4.0), F.lit(4.0), F.array().cast("array<double>"))
    quad = geometry.quad_from_rect(F.lit(10.0), F.lit(20.0), F.col("n") * 8.0, F.lit(16.0))
    rows = rows.withColumn("centres", centres).withColumn("quad", quad)
    rows = rows.select("item_id", F.posexplode(ctc.word_boxes(F.col("quad"), F.col("text"), F.col("centres"))).alias("word_no", "q"))
    return rows.select("item_id", F.col("word_no").cast("long"), F.round(F.get("q", F.lit(0))["x"], 6).alias("x0"), F.round(F.get("q", F.lit(2))["x"], 6).alias("x1"))


def _turns(spark: Session, sf_dir: str) -> DataFrame:
    """Each turn of a conversation with the next one."""
    rows = _rows(spark, sf_dir, "conversations")
    pairs = rows.withColumn("next", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn", "text")))
    return pairs.filter("next is not null and text is not null").select("conv_id", "turn", "text", "next")


def character_errors(spark: Session, sf_dir: str) -> DataFrame:
    rows = _turns(spark, sf_dir).withColumn("e", evaluation.character_error_rate(F.col("text"), F.col("next")))
    return rows.select("conv_id", "turn", "e.edits", "e.reference_units", F.round("e.rate", 6).alias("rate"), (F.col("text") == F.col("next")).alias("exact_match"))


def word_errors(spark: Session, sf_dir: str) -> DataFrame:
    rows = _turns(spark, sf_dir).withColumn("e", evaluation.word_error_rate(F.col("text"), F.col("next")))
    return rows.select("conv_id", "turn", "e.edits", "e.reference_units", F.round("e.rate", 6).alias("rate"))


def _annotations(spark: Session, sf_dir: str) -> DataFrame:
    """One annotation a page, with planted faults: repeated orders, boxes outside, wrong confidences, blank languages."""
    rows = ordering.reading_order(inputs.lines(spark, sf_dir))
    real = lambda c: c.cast("float")
    point = lambda x, y: F.struct(real(x).alias("x"), real(y).alias("y"))
    x, y, right, low = F.col("x"), F.col("y"), F.col("x") + F.col("width"), F.col("y") + F.col("height")
    line = F.struct(
        F.concat(F.lit("line-"), F.col("line_id")).alias("id"),
        F.when(F.col("line_id") % 17 == 0, 0).otherwise(F.col("order")).cast("long").alias("order"),
        F.struct(F.array(point(x, y), point(right, y), point(right, low), point(x, low)).alias("points")).alias("quad"),
        F.col("text"), F.col("corrected_text"), F.array().cast("array<struct<text: string, confidence: float>>").alias("alternatives"),
        real(F.when(F.col("line_id") % 13 == 0, 1.5).otherwise(F.col("confidence"))).alias("confidence"),
        F.when(F.col("line_id") % 19 == 0, " ").alias("language"), F.lit(None).cast("string").alias("script"), F.lit("auto").alias("direction"),
        F.lit("clear").alias("legibility"), F.array().cast("array<string>").alias("flags"),
        F.struct(F.lit(True).alias("detection"), F.lit(True).alias("recognition")).alias("evaluation"), F.lit("model").alias("source"),
        F.array().cast("array<struct<id: string, quad: struct<points: array<struct<x: float, y: float>>>, text: string, confidence: float>>").alias("words"),
        F.col("ignored"),
    )
    pages = rows.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("position", line.alias("line")))).alias("l"))
    pages = pages.select("image_id", F.transform("l", lambda e: e["line"]).alias("lines"))
    image = F.struct(
        F.col("image_id").cast("string").alias("id"), F.concat("image_id", F.lit(".png")).alias("file_name"), F.lit(1000).cast("long").alias("width"),
        F.lit(600).cast("long").alias("height"), F.when(F.col("image_id") % 3 == 0, "ABC").alias("sha256"),
    )
    engine = F.lit(None).cast("struct<name: string, version: string, backend: string, model: string, languages: array<string>, elapsed_ms: bigint>")
    none = F.lit(None).cast("string")
    meta = F.struct(
        F.lit("draft").alias("status"), none.alias("annotator"), none.alias("created_at"), none.alias("updated_at"), engine.alias("engine"),
        none.alias("notes"), F.lit(False).alias("sensitive"), F.array(F.lit("a"), F.lit("a")).alias("tags"), none.alias("group_id"),
    )
    doc = F.struct(
        F.lit("annotation.v1").alias("schema_version"), F.lit("pixel_top_left").alias("coordinate_system"), image.alias("image"),
        validate.visible_text(F.col("lines")).alias("text"), none.alias("corrected_text"), F.col("lines"), F.array(F.lit("en")).alias("language_hints"), meta.alias("metadata"),
    )
    return pages.select("image_id", doc.alias("doc"))


def validate_documents(spark: Session, sf_dir: str) -> DataFrame:
    rows = _annotations(spark, sf_dir).withColumn("errors", validate.document_errors(F.col("doc")))
    count = lambda pattern: F.size(F.filter("errors", lambda e: e.rlike(pattern))).cast("long")
    return rows.select(
        "image_id", F.size("errors").cast("long").alias("n_errors"), count("order .* is duplicated").alias("n_order"), count("within the image").alias("n_outside"),
        count("confidence must").alias("n_confidence"), count("language must").alias("n_language"), count("sha256").alias("n_sha"), count("^metadata.tags").alias("n_tags"),
    )


def document_json(spark: Session, sf_dir: str) -> DataFrame:
    """Every page written as JSON and read back strictly."""
    rows = _annotations(spark, sf_dir).select("image_id", documents.document_json(F.col("doc")).alias("json"), F.col("doc.text").alias("was"), F.size("doc.lines").alias("had"))
    back = documents.parse_documents(rows, validate=False)
    return back.select(
        "image_id", (F.col("doc.text") == F.col("was")).alias("same_text"), F.size("doc.lines").cast("long").alias("n_lines"), F.size("errors").cast("long").alias("n_errors")
    )


def strict_documents(spark: Session, sf_dir: str) -> DataFrame:
    """One small JSON document for each row, with planted faults of type, value, range, version, members and grammar."""
    fault = lambda n, bad, good: F.when(F.col("doc_id") % n == 0, bad).otherwise(good)
    parts = [
        fault(31, '{"schema_version": "annotation.v1"}', ""), '{', fault(37, '"text": "", ', ""), fault(43, "'language_hints'", '"language_hints"'), ': ["en"], "schema_version": "', fault(19, "x.annotation.v1", "annotation.v1"), '", "coordinate_system": "pixel_top_left", "image": {"id": "i", "file_name": "f", "width": ',
        fault(5, "1.5", "20"), ', "height": 10}, "text": ', fault(17, "5", '""'), ', "lines": [{"id": "l", "order": ', fault(11, "-1", "0"),
        ', "quad": {"points": [{"x": 0, "y": 0}, {"x": 5, "y": 0}, {"x": 5, "y": 5}, {"x": 0, ', fault(41, '"y": 5, ', ""), '"y": 5}]}, "text": "", "direction": "',
        fault(23, "up", "auto"), '", "legibility": "clear", "evaluation": {"detection": true, "recognition": true}, "source": "manual", "words": [], "ignored": ',
        fault(13, '"yes"', "false"), '}], "metadata": {"status": "', fault(7, "bogus", "draft"), '"', fault(3, ', "extra": 1', ""), "}}", fault(29, " and more", ""),
    ]
    rows = _rows(spark, sf_dir, "documents").select("doc_id", F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]).alias("json"))
    found = documents.parse_documents(rows)
    count = lambda text: F.size(F.filter("errors", lambda e: e.contains(text))).cast("long")
    return found.select(
        "doc_id", count("schema_version is not").alias("n_version"), count("image.width must be").alias("n_width"), count("text must be text").alias("n_text"),
        count("lines.order is out").alias("n_order"), count("direction is none").alias("n_direction"), count("ignored must be").alias("n_ignored"),
        count("status is none").alias("n_status"), count("unknown member").alias("n_unknown"), count("text after").alias("n_after"), count("is repeated").alias("n_repeated"),
        count("not a JSON").alias("n_no_json"),
    )


def evaluate_documents(spark: Session, sf_dir: str) -> DataFrame:
    """Each benchmark text against itself without its first word, as two tables of documents."""
    rows = _rows(spark, sf_dir, "benchmark").filter("item_id is not null and text is not null")
    doc = lambda t: F.struct(t.alias("text"), F.lit("x").alias("corrected_text")).alias("doc")
    reference = rows.select(F.col("item_id").alias("image_id"), doc(F.col("text")))
    prediction = rows.filter("item_id % 5 <> 0").select(F.col("item_id").alias("image_id"), doc(F.regexp_replace("text", r"^[^ ]+ ", "")))
    found = evaluation.evaluate_documents(reference, prediction)
    return found.select("image_id", F.col("character_error.edits").alias("char_edits"), F.col("word_error.edits").alias("word_edits"), F.round("word_error.rate", 6).alias("word_rate"), "exact_match")


def readable_lines(spark: Session, sf_dir: str) -> DataFrame:
    """The first seven boxes of each page, of which those that are read well enough stay."""
    few = boxes.first_boxes(inputs.lines(spark, sf_dir), 7)
    return ordering.readable_lines(few, 0.5).select("image_id", "line_id", "text")


def sha256_verify(spark: Session, sf_dir: str) -> DataFrame:
    docs = _rows(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("name"), "doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    wrong = F.when(F.col("doc_id") % 10 == 3, F.lit("00")).otherwise(images.sha256_hex(F.col("content")))
    size = F.octet_length("content").cast("long") + F.when(F.col("doc_id") % 10 == 4, 1).otherwise(0)
    expected = docs.select("name", size.alias("bytes"), wrong.alias("sha256"))
    return images.verify_files(docs.filter("doc_id % 10 <> 5").select("name", "content"), expected)


def profile_costs(spark: Session, sf_dir: str) -> DataFrame:
    """Documents that ask for each profile, by their id, and the bytes of its detector and recogniser."""
    cost = dims.models(spark).select("model", "bytes")
    named = lambda c: F.broadcast(cost.withColumnsRenamed({"model": c, "bytes": f"{c}_bytes"}))  # noqa: E731  ten rows
    asked = F.element_at(F.array(*[F.lit(p[0]) for p in dims.PROFILES]), (F.col("doc_id") % 4 + 1).cast("int"))
    counts = _rows(spark, sf_dir, "documents").groupBy(asked.alias("quality")).agg(F.count(F.lit(1)).alias("documents"))
    rows = counts.join(F.broadcast(dims.profiles(spark)), "quality").join(named("detector"), "detector").join(named("recognizer"), "recognizer")
    return rows.select("quality", F.col("max_side").cast("long"), (F.col("detector_bytes") + F.col("recognizer_bytes")).alias("bytes"), "documents")


def _heatmaps(spark: Session, sf_dir: str) -> DataFrame:
    """A bright block of 24 x 10 pixels for each part, at a place that depends on its key; keys are dealt out before images are made."""
    keys = _rows(spark, sf_dir, "part").select("p_partkey").repartition(4 * spark.sparkContext.defaultParallelism, "p_partkey")
    x = F.call_function("div", F.col("p_partkey") * 7 % 20, F.lit(1))
    run = lambda value, n: F.array_repeat(F.lit(value).cast("float"), n)
    row = F.concat(run(0.0, F.greatest(x, F.lit(0)).cast("int")), run(0.93, F.least(F.lit(24), 24 + x).cast("int")), run(0.0, (40 - x).cast("int")))
    block = F.concat(run(0.0, 8 * 64), F.flatten(F.array_repeat(row, 10)), run(0.0, 14 * 64))
    data = F.coalesce(block, run(0.0, 32 * 64))
    size = {"heat_width": F.lit(64), "heat_height": F.lit(32), "source_width": F.lit(640), "source_height": F.lit(320)}
    return keys.select(F.col("p_partkey").alias("image_id"), data.alias("data"), x.alias("x0")).withColumns(size)


def heatmap_regions(spark: Session, sf_dir: str) -> DataFrame:
    found = raster.heatmap_regions(_heatmaps(spark, sf_dir))
    return found.select("image_id", F.col("position").cast("long"), "x", "y", "width", "height", F.round("score", 4).alias("score"))


def detection_matches(spark: Session, sf_dir: str) -> DataFrame:
    """Boxes of the pages against the same boxes moved by a few pixels."""
    rows = inputs.lines(spark, sf_dir).select("image_id", F.col("line_id").alias("idx"), "x", "y", "width", "height")
    moved = rows.withColumn("x", F.col("x") + F.col("idx") % 29).filter("idx % 9 <> 0")
    return matching.greedy_matches(rows, moved).select("image_id", "ref_idx", "pred_idx")


def detection_scores(spark: Session, sf_dir: str) -> DataFrame:
    rows = inputs.lines(spark, sf_dir).groupBy("image_id").agg(F.count(F.lit(1)).alias("refs"), F.count_if(F.col("line_id") % 9 != 0).alias("preds"))
    hits = detection_matches(spark, sf_dir).groupBy("image_id").agg(F.count(F.lit(1)).alias("hits"))
    both = rows.join(hits, "image_id", "left").fillna(0, ["hits"])
    p, r = F.col("hits") / F.col("preds"), F.col("hits") / F.col("refs")
    return both.select("image_id", "hits", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(evaluation.h_mean(p, r), 6).alias("h_mean"))


def _turned_regions(spark: Session, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Regions of pages that are turned by a page's angle, some unreadable, and predictions a few pixels along the lines."""
    rows = inputs.lines(spark, sf_dir)
    turn = lambda k: F.element_at(F.array(*[F.lit(v) for v in k]), (F.col("image_id") % 3 + 1).cast("int"))
    c, s = turn([1.0, 0.6, 0.8]), turn([0.0, 0.8, -0.6])
    at = lambda x, y: geometry.point(x * c - y * s, x * s + y * c)

    def region(x: Column, words: Column) -> list[Column]:
        y, right, low = F.col("y"), x + F.col("width"), F.col("y") + F.col("height")
        return [F.col("image_id"), F.col("line_id").alias("idx"), F.array(at(x, y), at(right, y), at(right, low), at(x, low)).alias("points"), words.alias("text")]

    n = F.col("line_id")
    said = F.when(n % 4 == 0, F.concat(F.lit('"'), F.upper("text"), F.lit("!)"))).when(n % 5 == 0, F.concat("text", F.lit(" x"))).otherwise(F.col("text"))
    references = rows.select(*region(F.col("x"), F.when(n % 10 == 4, matching.UNREADABLE).otherwise(F.col("text"))))
    return references, rows.filter("line_id % 9 <> 0").select(*region(F.col("x") + n % 29, said))


def polygon_matches(spark: Session, sf_dir: str) -> DataFrame:
    """iou is rounded as SQL rounds a double: 323 / 640 times a million lies below a half."""
    found = matching.polygon_matches(*_turned_regions(spark, sf_dir))
    return found.select("image_id", "ref_idx", "pred_idx", (F.floor(F.col("iou") * 1e6 + 0.5) / 1e6).alias("iou"), "same_text")


def end_to_end_scores(spark: Session, sf_dir: str) -> DataFrame:
    found = matching.end_to_end_scores(*_turned_regions(spark, sf_dir))
    shares = [F.round(c, 6).alias(c) for c in ("precision", "recall", "h_mean", "e2e_precision", "e2e_recall", "e2e_h_mean")]
    return found.select("image_id", "refs", "preds", "hits", "text_hits", *shares)


def recognized_lines(spark: Session, sf_dir: str) -> DataFrame:
    """Every line of the recognised documents, with the right end of its first word."""
    found = recognition.recognize_documents(*inputs.recognition(spark, sf_dir)).select("image_id", F.explode("doc.lines").alias("l"))
    first = F.get(F.get("l.words", F.lit(0))["quad"]["points"], F.lit(1))["x"]
    return found.select(
        "image_id", F.col("l.id").alias("line_id"), F.col("l.order").alias("line_order"), F.col("l.text").alias("text"), F.round(F.col("l.confidence").cast("double"), 4).alias("confidence"),
        F.col("l.language").alias("language"), F.col("l.script").alias("script"), F.size("l.words").cast("long").alias("n_words"), F.size("l.alternatives").cast("long").alias("n_alternatives"),
        F.round(first.cast("double"), 3).alias("first_word_x"), F.get("l.quad.points", F.lit(2))["y"].cast("double").alias("low"),
    )


def recognized_documents(spark: Session, sf_dir: str) -> DataFrame:
    found = recognition.recognize_documents(*inputs.recognition(spark, sf_dir))
    return found.select(
        "image_id", F.col("doc.text").alias("text"), F.coalesce(F.size("doc.lines"), F.lit(0)).cast("long").alias("n_lines"),
        F.array_join("doc.language_hints", ",").alias("hints"), F.col("doc.metadata.engine.model").alias("model"), F.array_join("errors", "|").alias("errors"),
    )


def request_outcomes(spark: Session, sf_dir: str) -> DataFrame:
    """Every third event is a request; the two after it answer it, some from another worker, some too late."""
    rows = _rows(spark, sf_dir, "events").withColumn("id", F.col("event_id") - F.col("event_id") % 3).withColumn("worker", F.floor(F.col("id") / 3) % 4)
    other = F.when(F.col("user_id") % 10 == 0, F.col("worker") + 1).otherwise(F.col("worker"))
    answers = rows.filter("event_id % 3 <> 0").select(other.alias("worker"), "id", "ts", (F.col("event_type") != "error").alias("ok"), F.lit(None).cast("string").alias("error"))
    found = correlate.correlate(rows.filter("event_id % 3 = 0"), answers, "5 minutes")
    return found.select(F.col("worker").cast("long"), "id", "status", "error", F.expr("timestampdiff(MICROSECOND, sent, answered)").alias("waited_us"))


ARTIFACTS = [("view", 200000), ("signup", 300000), ("click", 400000), ("purchase", 250000)]


def download_progress(spark: Session, sf_dir: str) -> DataFrame:
    """Events as reports of bytes loaded, a session for each user; one event type is no artifact."""
    events = _rows(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.col("event_type").alias("artifact"), (F.col("value") * 1000).alias("loaded"))
    found = progress.download_progress(events, spark.createDataFrame(ARTIFACTS, "artifact string, bytes long"))
    return found.select("session", F.round("loaded", 3).alias("loaded"), "total", F.round("progress", 6).alias("progress"))


def boot_progress(spark: Session, sf_dir: str) -> DataFrame:
    """The last event of each user and type as the state of a model."""
    last = _rows(spark, sf_dir, "events").groupBy(F.col("user_id").alias("session"), F.col("event_type").alias("model")).agg(F.max_by(F.struct("event_id", "value"), "event_id").alias("e"))
    status = F.element_at(F.array(F.lit("ready"), F.lit("cached"), F.lit("loading"), F.lit("loading")), (F.col("e.event_id") % 4 + 1).cast("int"))
    states = last.select("session", "model", status.alias("status"), (F.col("e.value") / 150).alias("progress"))
    return progress.boot_progress(states, spark.createDataFrame(ARTIFACTS, "model string, bytes long")).select("session", F.round("progress", 6).alias("progress"))


def latency_percentiles(spark: Session, sf_dir: str) -> DataFrame:
    """Exact percentiles of values by event type, and whether the sketch's ranks are within its bound."""
    rows, error = _rows(spark, sf_dir, "events"), 0.001
    exact = evaluation.exact_percentiles(rows, "event_type", "value")
    sketch = evaluation.percentiles(rows, "event_type", "value", error=error).select("event_type", F.col("p50").alias("s50"), F.col("p95").alias("s95"))
    v = F.col("value")
    ranks = rows.join(F.broadcast(sketch), "event_type").groupBy("event_type").agg(  # a row for each type
        *[F.count_if(v < F.col(f"s{p}")).alias(f"below{p}") for p in (50, 95)], *[F.count_if(v <= F.col(f"s{p}")).alias(f"upto{p}") for p in (50, 95)], F.count("value").alias("of")
    )
    off = error * F.col("of") + 1
    close = lambda p: (F.col(f"below{p}") - off <= F.col("of") * p / 100) & (F.col(f"upto{p}") + off >= F.col("of") * p / 100)
    return exact.join(ranks, "event_type").select("event_type", "n", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"), (close(50) & close(95)).alias("sketch_within_bound"))


def image_orientations(spark: Session, sf_dir: str) -> DataFrame:
    """The head of an image file for each document, in five formats, with sizes and orientation by its id."""
    n = F.col("doc_id")
    w, h, turn, kind = n * 37 % 5000 + 1, n * 91 % 4000 + 1, n % 10, n % 5
    big = lambda v, size: F.lpad(F.hex(v), 2 * size, "0")
    little = lambda v, size: F.concat(*[F.substring(big(v, size), 2 * i + 1, 2) for i in reversed(range(size))])
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    exif = text("4D4D002A000000080001", "0112000300000001", big(turn, 2), "000000000000")
    jpeg = text("FFD8FFE000104A46494600010100000100010000", "FFE10022457869660000", exif, "FFFFC0001108", big(h, 2), big(w, 2), "03", "0" * 24)
    png = text("89504E470D0A1A0A0000000D49484452", big(w, 4), big(h, 4), "080200000000000000", "0000001A65584966", exif, "00000000")
    bmp = text("424D", "0" * 16, "36000000", "28000000", little(w, 4), little(F.when(n % 2 == 0, 2**32 - h).otherwise(h), 4), "01001800")
    entry = lambda tag, kind, v: text(tag, kind, "01000000", v)
    tiff = text("49492A0008000000", "0300", entry("0001", "0400", little(w, 4)), entry("0101", "0300", text(little(h, 2), "0000")), entry("1201", "0300", text(little(turn, 2), "0000")), "00000000")
    webp = text("5249464600000000", "57454250", "565038580A000000", "08000000", little(w - 1, 3), little(h - 1, 3), "4943435003000000", "01020300", "45584946", "1A000000", exif)
    head = F.when(kind == 0, png).when(kind == 1, jpeg).when(kind == 2, bmp).when(kind == 3, tiff).otherwise(webp)
    rows = _rows(spark, sf_dir, "documents").filter("doc_id is not null").select("doc_id", F.unhex(head).alias("content"))
    found = rows.select("doc_id", images.image_header(F.col("content")).alias("h"), images.image_errors(F.col("content"), max_pixels=10_000_000).alias("error"))
    return found.select(
        "doc_id", F.col("h.format").alias("format"), "h.size.width", "h.size.height", F.col("h.orientation").cast("long").alias("orientation"),
        F.col("h.shown.width").alias("shown_width"), F.col("h.shown.height").alias("shown_height"), "error",
    )


def dictionary_entries(spark: Session, sf_dir: str) -> DataFrame:
    """The words of each benchmark text as the list in a settings file: bare, in single quotes and in double quotes."""

    def item(w: Column, i: Column) -> Column:
        single = F.concat(F.lit("'"), F.replace(w, F.lit("'"), F.lit("''")), F.lit("'"))
        double = F.regexp_extract(F.to_json(F.array(w)), r"^\[(.*)\]$", 1)
        return F.concat(F.lit("  - "), F.when(i % 3 == 0, double).when(i % 3 == 1, single).otherwise(w))

    words = F.filter(F.split("text", r"[^\p{L}0-9'.,]+"), lambda w: (w != "") & ~w.startswith("'"))
    lines = F.concat(F.array(F.lit("a: 1"), F.lit("  character_dict:")), F.transform(words, item), F.array(F.lit("next: 2"), F.lit("  - y")))
    files = _rows(spark, sf_dir, "benchmark").filter("text is not null").select(F.col("item_id").alias("model"), F.array_join(lines, "\n").alias("text"))
    return images.read_dictionary(files).select(F.col("model").cast("string"), F.col("position").cast("long"), "entry")


def worker_responses(spark: Session, sf_dir: str) -> DataFrame:
    """A request line for each document, some of them broken in one of seven ways, and its answer."""
    n = F.col("doc_id")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    good = text('{"id": ', n, ', "method": "recognize", "image": "', n, '.png", "languages": ["', F.coalesce("lang", F.lit("en")), '", "deu"]}')
    kinds = [
        text('{"id": ', n, ', "method": "info"}'), good, text('{"id": ', n, ', "method": "recognize"}'), text('{"id": ', n, ', "method": "recognize", "image": "a", "min_confidence": 1.5}'),
        text('{"id": ', n, ', "method": "x"}'), text("not json ", n), text('{"id": ', n, ', "method": "info", "extra": 1}'), text('{"id": ', n, ', "method": "recognize", "image": "a", "languages": ["xx"]}'),
    ]
    lines = _rows(spark, sf_dir, "documents").filter("doc_id is not null").select("doc_id", F.element_at(F.array(*kinds), (n % 8 + 1).cast("int")).alias("value"))
    return worker.respond(worker.parse_requests(lines), worker.plan_result()).withColumnRenamed("value", "response")


HEADERS = ["89504E470D0A1A0A0000000D49484452000002800000014008020000", "424D460000000000000036000000280000000200000003000000010018000000", "FFD8FFE0", "474946", ""]


def image_headers(spark: Session, sf_dir: str) -> DataFrame:
    """The first bytes of five files, one for each document by its id, before the document's text."""
    n = F.col("doc_id")
    head = F.element_at(F.array(*[F.lit(h) for h in HEADERS]), (n % 5 + 1).cast("int"))
    body = F.when(n % 5 == 4, F.lit("")).otherwise(F.coalesce("text", F.lit(""))).cast("binary")
    rows = _rows(spark, sf_dir, "documents").filter("doc_id is not null").select("doc_id", F.concat(F.unhex(head), body).alias("content"))
    size = images.image_size(F.col("content"))
    return rows.select("doc_id", images.image_format(F.col("content")).alias("format"), size["width"].alias("width"), size["height"].alias("height"), images.image_errors(F.col("content")).alias("error"))


QUERIES = {
    f.__name__: f
    for f in (
        reading_order, rebuild_text, line_bounds, crop_geometry, overlap_dedup, tile_offsets, tiled_images, crop_batches, width_batches,
        script_tags, script_fractions, language_codes, recognizer_plans, required_models, line_languages, select_candidate,
        candidate_alternatives, route_crops, tsv_words, tsv_lines, tsv_pages, ctc_decode, word_boxes, character_errors, word_errors,
        validate_documents, document_json, strict_documents, evaluate_documents, readable_lines, sha256_verify, profile_costs, heatmap_regions, detection_matches, detection_scores, polygon_matches, end_to_end_scores, recognized_lines, recognized_documents, request_outcomes,
        download_progress, boot_progress, latency_percentiles, image_orientations,
        dictionary_entries, worker_responses, image_headers,
    )
}
