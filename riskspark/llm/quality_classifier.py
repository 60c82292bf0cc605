"""Quality scores from compressed sizes under two dictionaries.

One zstandard dictionary is built from text labelled good and one from text labelled bad. A text is compressed in pieces
with either, so that the dictionary and not the text's own history is what helps; the difference of the two sizes over
the size of the text, and what the text's own repetition saves, become a probability by logistic calibration.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import logistic
from .tables import col, labelled_sample


@dataclass(frozen=True)
class QualityConfig:
    """Fitted on at most ``per_class`` labelled texts of each class, ``sample_chars`` of each; scores read whole texts."""

    per_class: int = 1500
    sample_chars: int = 6000
    dictionary_bytes: int = 65_536
    piece: int = 2048
    level: int = 3
    cut: float = 0.7


@dataclass(frozen=True)
class QualityModel:
    good: bytes
    bad: bytes
    weights: np.ndarray


def _dictionary(texts: list[str], cfg: QualityConfig) -> bytes:
    """Whole pieces of many texts, a bit of each first, so that no long text fills the dictionary."""
    pieces = [t.encode()[: cfg.piece] for t in texts]
    try:
        return zstandard.train_dictionary(cfg.dictionary_bytes, [p for p in pieces if p], level=cfg.level).as_bytes()
    except zstandard.ZstdError:  # too little text for training: the text itself serves
        return b"".join(pieces)[-cfg.dictionary_bytes :]


class _Sizes:
    """Compressed sizes of a text under each dictionary and under none."""

    def __init__(self, good: bytes, bad: bytes, cfg: QualityConfig):
        def with_dictionary(raw: bytes) -> zstandard.ZstdCompressor:
            if not raw:
                return zstandard.ZstdCompressor(level=cfg.level, write_content_size=False)
            content = zstandard.ZstdCompressionDict(raw)
            content.precompute_compress(level=cfg.level)
            return zstandard.ZstdCompressor(dict_data=content, write_content_size=False, write_dict_id=False)

        self.piece = cfg.piece
        self.good, self.bad, self.plain = with_dictionary(good), with_dictionary(bad), with_dictionary(b"")

    def features(self, text: str | None) -> tuple[float, float, float]:
        """(bad less good, plain) over the bytes of the text, and the logarithm of its bytes; zeros for no text."""
        raw = memoryview((text or "").encode("utf-8", "replace"))
        if not raw:
            return 0.0, 0.0, 0.0
        good = bad = plain = 0
        for at in range(0, len(raw), self.piece):
            part = raw[at : at + self.piece]
            good += len(self.good.compress(part))
            bad += len(self.bad.compress(part))
            plain += len(self.plain.compress(part))
        return (bad - good) / len(raw), plain / len(raw), float(np.log1p(len(raw)))


def _design(f: np.ndarray) -> np.ndarray:
    """The difference, its course with the text's length and own repetition, all of the order of one."""
    d, plain, size = 10 * f[:, 0], f[:, 1], f[:, 2] / 8
    return np.column_stack([d, d * d, plain, plain * plain, size, d * plain, plain * size, d * size])


def fit(docs: DataFrame, labels: DataFrame, cfg: QualityConfig = QualityConfig()) -> QualityModel | None:
    """Dictionaries from one half of the sample, calibration on the other. None without both classes."""
    sample, counts = labelled_sample(docs, labels, "quality", cfg.per_class, cfg.sample_chars)
    halves = [[(t, y) for i, (t, y) in enumerate(sample) if i % 2 == k] for k in (0, 1)]
    if any({y for _, y in half} != {0, 1} for half in halves):
        return None
    good, bad = (_dictionary([t for t, y in halves[0] if y == k], cfg) for k in (1, 0))
    sizes = _Sizes(good, bad, cfg)
    x = np.array([sizes.features(t) for t, _ in halves[1]])
    y = np.array([y for _, y in halves[1]])
    drawn = np.bincount(y, minlength=2)
    weight = np.array([counts[k] / drawn[k] for k in (0, 1)])[y]
    return QualityModel(good, bad, logistic.fit(_design(x), y, weight, ridge=0.1))


def quality(text: Column, model: QualityModel | None, cfg: QualityConfig = QualityConfig()) -> Column:
    """Probability that a text is labelled good; one half for all texts without a model."""

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        sizes = model and _Sizes(model.good, model.bad, cfg)
        for texts in batches:
            if sizes is None or not len(texts):
                yield pa.array(np.full(len(texts), 0.5))
            else:
                x = np.array([sizes.features(t.as_py()) for t in texts])
                yield pa.array(logistic.predict(model.weights, _design(x)))

    return score(text)


def scores(docs: DataFrame, model: QualityModel | None, id_col: str = "doc_id", text_col: str = "text", cfg: QualityConfig = QualityConfig()) -> DataFrame:
    """``doc_id``, ``score``, ``predicted`` (score of ``cut`` or more) of every row.

    Null and empty texts share the score of a text of size 0. Repeated rows are scored alike. Other columns are ignored.
    An empty table gives no rows.
    """
    rows = docs.select(col(docs, id_col).alias("doc_id"), quality(col(docs, text_col), model, cfg).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= cfg.cut).cast("int"))
