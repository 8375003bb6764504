"""Requests of a worker, one JSON object a line, as a stateless query: batch or stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions.language import resolve_languages, unsupported_languages

MAX_REQUEST_BYTES = 1024 * 1024
MEMBERS = ["id", "method", "image", "languages", "segmentation", "min_confidence"]
METHODS = ["recognize", "info", "warmup"]
SEGMENTATIONS = ["auto", "single_block", "single_line", "sparse_text"]
_REQUEST = "id long, method string, image string, languages array<string>, segmentation string, min_confidence double"


def check_options(min_confidence: float = 0.8, threads: int = 1, timeout_ms: int = 30_000, max_file_bytes: int = 1, max_image_pixels: int = 1) -> None:
    """Refuse options out of range: confidence 0 to 1, threads 1 to 64, timeout 1 to 300,000 ms, limits over 0."""
    if not 0 <= min_confidence <= 1:  # not a number is neither
        raise ValueError("min_confidence must be between 0 and 1")
    if not 1 <= threads <= 64:
        raise ValueError("threads must be between 1 and 64")
    if not 1 <= timeout_ms <= 300_000:
        raise ValueError("timeout_ms must be between 1 and 300000")
    if max_file_bytes <= 0 or max_image_pixels <= 0:
        raise ValueError("image limits must be over 0")


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """A stream of lines of new files in a folder."""
    return spark.readStream.format("text").load(path)


def parse_requests(lines: DataFrame, value: str = "value") -> DataFrame:
    """request (struct) and error. A line that is too long, no object or has unknown members has no id."""
    keys = F.json_object_keys(value)
    unknown = F.array_except(keys, F.array(*[F.lit(m) for m in MEMBERS]))
    request = F.from_json(value, _REQUEST)
    r = F.col("request")
    parsed = lines.withColumn("request", F.when(keys.isNotNull() & (F.size(unknown) == 0), request))
    error = (
        F.when(F.octet_length(value) > MAX_REQUEST_BYTES, "request is too long")
        .when(keys.isNull(), "request is not a JSON object")
        .when(F.size(unknown) > 0, F.concat(F.lit("unknown member "), F.get(unknown, F.lit(0))))
        .when(r["id"].isNull(), "id is missing")
        .when(~F.coalesce(r["method"].isin(METHODS), F.lit(False)), "unknown method")
        .when((r["method"] == "recognize") & r["image"].isNull(), "image is missing")
        .when(~r["segmentation"].isin(SEGMENTATIONS), "unknown segmentation")
        .when(F.isnan(r["min_confidence"]) | (r["min_confidence"] < 0) | (r["min_confidence"] > 1), "min_confidence must be between 0 and 1")
    )
    bad = unsupported_languages(F.coalesce(r["languages"], F.array().cast("array<string>")))
    error = error.when(F.size(bad) > 0, F.concat(F.lit("unsupported languages "), F.array_join(bad, ", ")))
    return parsed.withColumn("error", error)


def respond(requests: DataFrame, result: Column) -> DataFrame:
    """One response line a request: {id, ok, result} or {id, ok, error}."""
    failed = F.to_json(F.struct(F.col("request.id").alias("id"), F.lit(False).alias("ok"), F.col("error").alias("error")))
    done = F.to_json(F.struct(F.col("request.id").alias("id"), F.lit(True).alias("ok"), result.alias("result")))
    return requests.select(F.when(F.col("error").isNull(), done).otherwise(failed).alias("value"))


def plan_result() -> Column:
    """What can be answered without a model: the resolved languages of a request."""
    languages = resolve_languages(F.coalesce(F.col("request.languages"), F.array().cast("array<string>")))
    return F.struct(F.col("request.method").alias("method"), languages.alias("languages"))


def serve(spark: SparkSession, source: str, sink: str, checkpoint: str):
    """Answers the request files of a folder with response files; lines already answered are not read again."""
    answers = respond(parse_requests(read_requests(spark, source)), plan_result())
    return answers.writeStream.format("text").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
