"""Responses of workers matched to their requests, as a stream or a batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _outcome(timeout: str, answered: Column) -> list[Column]:
    ok = F.col("s.ok")
    status = F.when(F.col("s.id").isNull(), "timed out").when(F.coalesce(ok, F.lit(False)), "ok").otherwise("failed")
    error = F.when(F.col("s.id").isNull(), f"no response within {timeout}").when(~F.coalesce(ok, F.lit(False)), F.coalesce("s.error", F.lit("request failed")))
    return [F.col("r.worker"), F.col("r.id"), F.col("r.ts").alias("sent"), answered.alias("answered"), status.alias("status"), error.alias("error")]


def correlate(requests: DataFrame, responses: DataFrame, timeout: str = "30 seconds", delay: str = "10 seconds") -> DataFrame:
    """worker, id, sent, answered, status (ok, failed, timed out), error: one row for each request.

    requests: worker, id, ts; a request is named by worker and id. responses: worker, id, ts, ok, error. A response counts
    if it comes from the request's worker, not before the request and within the timeout; of several the first.
    Others answer nothing. A null worker or id matches nothing.

    Of streams, rows may be late by `delay`; a request without response appears as timed out once the watermark has passed
    its timeout, and state is kept no longer. The first response is the first that arrives; of a batch the earliest.
    """
    within = (F.col("s.ts") >= F.col("r.ts")) & (F.col("s.ts") <= F.col("r.ts") + F.expr(f"interval {timeout}"))
    on = (F.col("r.worker") == F.col("s.worker")) & (F.col("r.id") == F.col("s.id")) & within
    requests, responses = requests.select("worker", "id", "ts"), responses.select("worker", "id", "ts", "ok", "error")
    if requests.isStreaming or responses.isStreaming:
        r, s = requests.withWatermark("ts", delay).alias("r"), responses.withWatermark("ts", delay).alias("s")
        plain = F.timestamp_micros(F.unix_micros("s.ts"))  # one event time a stream
        return r.join(s, on, "leftOuter").select(*_outcome(timeout, plain)).dropDuplicatesWithinWatermark(["worker", "id"])
    first = F.min_by(F.struct("s.*"), F.struct("s.ts", "s.ok", "s.error"))
    r = requests.groupBy("worker", "id").agg(F.min("ts").alias("ts")).alias("r")
    met = r.join(responses.alias("s"), on).groupBy(F.col("r.worker").alias("worker"), F.col("r.id").alias("id")).agg(first.alias("s"))
    both = r.join(met.alias("m"), (F.col("r.worker") == F.col("m.worker")) & (F.col("r.id") == F.col("m.id")), "left")
    return both.select(F.struct("r.*").alias("r"), F.col("m.s").alias("s")).select(*_outcome(timeout, F.col("s.ts")))
