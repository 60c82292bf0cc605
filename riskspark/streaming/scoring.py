"""Scoring of arriving records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..config import RiskConfig
from ..operators.score import Scorer, score_partial


def score_stream(
    arriving: DataFrame,
    scorer: Scorer,
    cfg: RiskConfig,
    sink: str,
    checkpoint: str,
    features: Sequence[str] | None = None,
    keep: Sequence[str] | None = None,
    interval: str | None = None,
) -> StreamingQuery:
    """Score a streaming frame into a parquet sink, append mode.

    Scoring is stateless, so there is no watermark or state store. Without ``interval`` everything available
    is processed once; offsets in ``checkpoint`` make a restart continue where it stopped.
    """
    scored = score_partial(arriving, scorer, cfg, features)
    out = scored.select(*keep) if keep else scored
    writer = (
        out.writeStream.format("parquet")
        .outputMode("append")
        .option("path", sink)
        .option("checkpointLocation", checkpoint)
    )
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return writer.trigger(**trigger).start()
