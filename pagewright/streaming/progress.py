"""Progress of downloads: the most of each artifact that was seen, against all bytes of a session's artifacts."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the share that downloads make of a start.
SHARE = 0.9


def overall(loaded: Column, total: Column) -> Column:
    """Bytes loaded as a share of all, times the share of downloads and no more than that; all of it without bytes."""
    return F.when(total > 0, F.least(F.lit(SHARE), loaded / total * SHARE)).otherwise(F.lit(SHARE))


def download_progress(events: DataFrame, artifacts: DataFrame) -> DataFrame:
    """session, loaded, total, progress: where each session's downloads stand after all events.

    events: session, artifact, loaded (bytes so far; may fall back, the most counts; null and unknown artifacts count
    nothing). artifacts: artifact, bytes: what every session loads.
    """
    most = events.join(F.broadcast(artifacts.select("artifact")), "artifact").groupBy("session", "artifact").agg(F.max(F.greatest("loaded", F.lit(0.0))).alias("loaded"))
    total = artifacts.agg(F.coalesce(F.sum("bytes"), F.lit(0)).cast("double").alias("total"))  # one row
    sums = events.select("session").distinct().alias("e").join(most.groupBy("session").agg(F.sum("loaded").alias("loaded")).alias("m"), F.expr("e.session <=> m.session"), "left")
    rows = sums.select("e.session", F.coalesce("m.loaded", F.lit(0.0)).alias("loaded")).join(F.broadcast(total))
    return rows.select("session", "loaded", "total", overall(F.col("loaded"), F.col("total")).alias("progress"))


def progress_stream(events: DataFrame, artifacts: dict[str, int]) -> DataFrame:
    """The same as a stream: a row for each session that a batch touches, in update mode. State holds one number an artifact."""
    total = float(sum(artifacts.values()))

    def update(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        most = json.loads(state.get[0]) if state.exists else {}
        for part in parts:
            for name, loaded in part.groupby("artifact")["loaded"].max().items():
                if name in artifacts and loaded == loaded:
                    most[name] = max(most.get(name, 0.0), float(loaded))
        state.update((json.dumps(most),))
        loaded = sum(most.values())
        yield pd.DataFrame([(key[0], loaded, total, min(SHARE, loaded / total * SHARE) if total > 0 else SHARE)], columns=["session", "loaded", "total", "progress"])

    kind = events.schema["session"].dataType.simpleString()
    rows = events.select("session", "artifact", F.col("loaded").cast("double").alias("loaded"))
    return rows.groupBy("session").applyInPandasWithState(update, f"session {kind}, loaded double, total double, progress double", "most string", "update", "NoTimeout")


def boot_progress(states: DataFrame, models: DataFrame) -> DataFrame:
    """session, progress: the mean of the models' shares by their bytes; 0 without bytes.

    states: session, model, status, progress (the last state of each). ready and cached models count whole, others by progress,
    0 to 1; a model without state counts as 0. models: model, bytes.
    """
    share = F.when(F.col("status").isin("ready", "cached"), 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("progress", F.lit(0.0)))))
    done = states.join(F.broadcast(models.select("model", "bytes")), "model").groupBy("session").agg(F.sum(share * F.col("bytes")).alias("done"))
    total = models.agg(F.coalesce(F.sum("bytes"), F.lit(0)).cast("double").alias("total"))  # one row
    rows = states.select("session").distinct().alias("e").join(done.alias("d"), F.expr("e.session <=> d.session"), "left").select("e.session", "d.done").join(F.broadcast(total))
    return rows.select("session", F.when(F.col("total") > 0, F.coalesce("done", F.lit(0.0)) / F.col("total")).otherwise(F.lit(0.0)).alias("progress"))


def provider_label(names: Column) -> Column:
    """Distinct names in their order, joined by a plus; `not loaded` for none."""
    known = F.array_distinct(F.array_compact(names))
    return F.when(F.size(known) > 0, F.array_join(known, " + ")).otherwise(F.lit("not loaded"))
