"""Contingencies and metrics of streams of labelled predictions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import contingency as C
from ..operators import metrics as M


def running_contingency(stream: DataFrame, keys: Sequence[str] = (), label: str = "label", pred: str = "pred") -> DataFrame:
    """Counts so far by (keys, label, pred): the batch operator works on streams as it is."""
    return C.contingency(stream, keys, label, pred)


def windowed_counts(stream: DataFrame, time: str, width: str, late: str, label: str = "label", pred: str = "pred") -> DataFrame:
    """Binary counts per tumbling window; windows close when the watermark passes."""
    w = stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"))
    counts = w.agg(*C._cells(label, pred, F.lit(1)))
    return counts.select(F.col("w.start").alias("start"), "n00", "n01", "n10", "n11", "invalid")


def windowed_scores(counts: DataFrame) -> DataFrame:
    """Metrics of windows with a valid pixel."""
    return M.scores(C.with_valid(counts), ["start"])


def run(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update") -> StreamingQuery:
    """Starts a query that takes what is there and stops; sink gets each micro-batch (once per epoch id)."""
    return df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()


def by_epoch(path: str) -> Callable[[DataFrame, int], None]:
    """A sink that keeps every epoch in a folder of its own and replaces it when the epoch is run again, so that a retried epoch is stored once."""

    def sink(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return sink


def score_stream(stream: DataFrame, model, parameters: dict[str, tuple[float, float]], kind: str = "standard") -> DataFrame:
    """Stored channel parameters, then a model, on a stream: a fitted or saved one, or class scores as expressions."""
    from ..operators.classify import ScoreModel
    from ..operators.estimators import predict
    from ..operators.params import apply

    ready = apply(stream, parameters, kind)
    return model.predict(ready) if isinstance(model, ScoreModel) else predict(model, ready)
