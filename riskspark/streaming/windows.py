"""Alert counts of arriving scores per event-time window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import q
from ..operators.cohort import LEVELS


def _counts(pred: str) -> list[Column]:
    return [F.expr("count(1) as n"), *[F.expr(f"count_if({q(pred)} = {k}) as n_{name}") for k, name in enumerate(LEVELS)]]


def sliding_alerts(scored: DataFrame, ts_col: str, delay: str, size: str, slide: str, by: tuple[str, ...] = (), pred: str = "pred") -> DataFrame:
    """Records and records per class in windows of ``size`` that start every ``slide``.

    On a stream a window is given out once, when the watermark (``delay`` behind the latest time) has passed its end;
    records that come later than that are dropped and counted by the stream. Counts are combined in each task
    before rows of a window meet, so a busy window costs a row per task.
    """
    rows = scored.withWatermark(ts_col, delay).groupBy(F.window(ts_col, size, slide), *by).agg(*_counts(pred))
    return rows.selectExpr("window.start as window_start", "window.end as window_end", *[q(c) for c in by], "n", *[f"n_{k}" for k in LEVELS])


def session_alerts(scored: DataFrame, id_col: str, ts_col: str, delay: str, gap: str, pred: str = "pred") -> DataFrame:
    """Records and records per class in each entity's sessions, which end ``gap`` after their last record.

    A record at the very end of a session still joins it.
    """
    rows = scored.withWatermark(ts_col, delay).groupBy(F.session_window(ts_col, gap).alias("window"), id_col).agg(*_counts(pred))
    return rows.selectExpr(q(id_col), "window.start as window_start", "window.end as window_end", "n", *[f"n_{k}" for k in LEVELS])


def write_windows(windows: DataFrame, sink: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Write closed windows to a parquet sink, each once."""
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    writer = windows.writeStream.format("parquet").outputMode("append").option("path", sink)
    return writer.option("checkpointLocation", checkpoint).trigger(**trigger).start()


def late_rows(query: StreamingQuery) -> int:
    """Rows that came after their window was closed, over the batches that the query still remembers.

    Rows are counted after the partial counts of a task, so late records of one window and task may count once.
    """
    return sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])
