"""Quality rules: fixed base rules, then robust multivariate outliers per language and source.

Counts of every text become a vector of statistics. Per group of language and source, the minimum covariance
determinant gives location and scatter that outliers cannot pull: from medians and absolute deviations on, each
concentration step keeps the share of rows with the smallest distances and takes their mean and covariance. A row is
rejected if its squared Mahalanobis distance exceeds the cutoff. Steps are aggregates over all rows of a group; no
group is gathered, and only a row of sums per group is inverted.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import stage
from .tables import col, small
from .text import Words, mix, slices, split_words

STATS = ("log_words", "log_word_length", "symbols", "dup_lines", "repeats")
# The least scatter of each statistic, so that one that hardly varies in a group cannot reject a row for a
# small deviation; and the median of the squared distance of five normal variables.
LEAST_SCATTER = (0.3, 0.05, 0.02, 0.2, 0.2)
CHI2_MEDIAN = 4.351

MOST_GROUPS = 50_000
"""Tables with a row for each group are sent to every executor up to this many groups, about 10 MB."""


@dataclass(frozen=True)
class QualityRulesConfig:
    """Groups under ``least_rows`` are pooled by language, then all together; a pool still smaller rejects nothing.

    ``cutoff`` is on the squared distance, scaled so that its median is that of normal data.
    """

    share: float = 0.75
    steps: int = 3
    least_rows: int = 100
    least_words: int = 50
    cutoff: float = 60.0
    accuracy: int = 1000


_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _repeated(row: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Flags of the elements whose (row, hash) occurs twice or more."""
    order = np.lexsort((h, row))
    same = (row[order][1:] == row[order][:-1]) & (h[order][1:] == h[order][:-1])
    flags = np.zeros(len(h), bool)
    flags[order[1:][same]] = flags[order[:-1][same]] = True
    return flags


def count_rules(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The base counts of each row of a slice of texts."""
    words = split_words(data, offsets)
    n = len(offsets) - 1
    first_byte = (data & 0xC0) != 0x80
    inside = np.zeros(len(data) + 1, np.int64)
    np.add.at(inside, words.start, 1)
    np.add.at(inside, words.end, -1)
    in_word = np.cumsum(inside)[:-1] > 0

    newline = np.flatnonzero(data == 0x0A)
    start = np.unique(np.concatenate([offsets[:-1], newline + 1]))
    start = start[start < len(data)]
    end = np.minimum(*[np.append(x, len(data))[np.searchsorted(x, start, side)] for x, side in ((newline, "left"), (offsets[1:], "right"))])
    solid = np.concatenate([[0], np.cumsum(in_word)])
    lines = np.flatnonzero(solid[end] > solid[start])
    lines = Words(data, offsets, start[lines], end[lines], np.searchsorted(offsets, start[lines], "right") - 1)
    pairs = np.stack([lines.row.astype(np.uint64), lines.hashes()], axis=1)
    once = np.unique(pairs, axis=0)[:, 0].astype(np.int64) if len(pairs) else np.zeros(0, np.int64)

    h = words.hashes()
    full = np.flatnonzero(words.row[:-2] == words.row[2:]) if len(h) > 2 else np.zeros(0, np.int64)
    k = np.uint64(0xC2B2AE3D27D4EB4F)
    triple = mix(mix(mix(h[full]) * k + h[full + 1]) * k + h[full + 2])
    twice = full[_repeated(words.row[full], triple)]
    covered = np.zeros(len(h), bool)
    for j in range(3):
        covered[twice + j] = True
    return {
        "n_words": words.counts(),
        "word_chars": _per_row(first_byte & in_word, offsets),
        "n_symbols": _per_row(_SYMBOL[data], offsets),
        "n_dup_lines": lines.counts() - np.bincount(once, minlength=n),
        "n_repeat_words": np.bincount(words.row[covered], minlength=n),
        "n_lines": lines.counts(),
    }


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offsets in slices(batch.column(3)):
            found = count_rules(data, offsets)
            kept = [batch.column(i).slice(lo, hi - lo) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(found[c], pa.int64()) for c in COUNTS)], names=["doc_id", "lang", "source", *COUNTS])


def _groups(rows: DataFrame, cfg: QualityRulesConfig) -> DataFrame:
    """(lang, source, grp): the group that judges a pair of language and source; null where all are too small."""
    sizes = rows.groupBy("lang", "source").agg(F.count("*").alias("n"))
    few = F.col("n") < cfg.least_rows
    by_lang = sizes.where(few).groupBy("lang").agg(F.sum("n").alias("lang_n"))
    rest = by_lang.where(F.col("lang_n") < cfg.least_rows).agg(F.sum("lang_n").alias("rest_n"))
    sizes = sizes.join(by_lang, "lang", "left").crossJoin(F.broadcast(rest))  # one row
    return sizes.select(
        "lang",
        "source",
        F.when(~few, F.concat_ws("\x1f", F.lit("own"), "lang", "source"))
        .when(F.col("lang_n") >= cfg.least_rows, F.concat_ws("\x1f", F.lit("lang"), "lang"))
        .when(F.col("rest_n") >= cfg.least_rows, F.lit("all"))
        .alias("grp"),
    )


def _distance() -> str:
    """SQL of the squared distance from the columns m_i (location) and p_i_j (precision)."""
    p = range(len(STATS))
    return " + ".join(f"{'' if i == j else '2 * '}p_{i}_{j} * (x_{i} - m_{i}) * (x_{j} - m_{j})" for i in p for j in p if i <= j)


def _inverted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sums of each group to location and precision."""
    p = range(len(STATS))
    for sums in batches:
        out = {"grp": sums["grp"]}
        n = sums["n"].to_numpy(float)
        mean = np.stack([sums[f"s_{i}"] / n for i in p], axis=1)
        cov = np.empty((len(sums), len(STATS), len(STATS)))
        for i in p:
            for j in p:
                cov[:, i, j] = sums[f"q_{min(i, j)}_{max(i, j)}"] / n - mean[:, i] * mean[:, j]
        cov += np.diag(np.square(LEAST_SCATTER))
        precision = np.linalg.inv(cov)
        out |= {f"m_{i}": mean[:, i] for i in p}
        out |= {f"p_{i}_{j}": precision[:, i, j] for i in p for j in p if i <= j}
        yield pd.DataFrame(out)


def estimates(rows: DataFrame, cfg: QualityRulesConfig) -> DataFrame:
    """(grp, m_i, p_i_j, unit): robust location and precision of every group, and the scale of its distances."""
    p = range(len(STATS))
    middle = stage(rows.groupBy("grp").agg(*(F.percentile_approx(f"x_{i}", 0.5, cfg.accuracy).alias(f"m_{i}") for i in p)), "medians")
    spread = rows.join(small(middle, MOST_GROUPS), "grp").groupBy("grp", *(f"m_{i}" for i in p))
    spread = spread.agg(*(F.percentile_approx(F.abs(F.expr(f"x_{i} - m_{i}")), 0.5, cfg.accuracy).alias(f"d_{i}") for i in p))
    first = [f"1 / (pow(1.4826 * d_{i}, 2) + {LEAST_SCATTER[i] ** 2!r}D) as p_{i}_{i}" for i in p]
    found = stage(spread.selectExpr("grp", *(f"m_{i}" for i in p), *first, *(f"0D as p_{i}_{j}" for i in p for j in p if i < j)), "start")
    for _ in range(cfg.steps):
        far = rows.join(small(found, MOST_GROUPS), "grp").withColumn("d2", F.expr(_distance()))
        near = stage(far.groupBy("grp").agg(F.percentile_approx("d2", cfg.share, cfg.accuracy).alias("most")), "most")
        kept = far.join(small(near, MOST_GROUPS), "grp").where("d2 <= most").groupBy("grp")
        sums = kept.agg(
            F.count("*").alias("n"),
            *(F.sum(f"x_{i}").alias(f"s_{i}") for i in p),
            *(F.sum(F.expr(f"x_{i} * x_{j}")).alias(f"q_{i}_{j}") for i in p for j in p if i <= j),
        )
        found = stage(sums.mapInPandas(_inverted, found.schema), "step")
    unit = rows.join(small(found, MOST_GROUPS), "grp").groupBy("grp").agg((F.percentile_approx(F.expr(_distance()), 0.5, cfg.accuracy) / CHI2_MEDIAN).alias("unit"))
    return stage(found.join(unit.withColumn("unit", F.greatest("unit", F.lit(0.05))), "grp"), "estimates")


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", cfg: QualityRulesConfig = QualityRulesConfig()) -> DataFrame:
    """``doc_id``, the base counts, ``base_failed``, ``kept`` and ``distance`` (null where no group judges the row).

    Null and empty texts have no words and fail the base rules. A null language or source is a value of its own.
    Repeated rows are judged alike. Other columns are ignored. An empty table gives no rows.
    """
    texts = docs.select(
        col(docs, id_col).cast("long").alias("doc_id"),
        F.coalesce(col(docs, lang_col).cast("string"), F.lit("")).alias("lang"),
        F.coalesce(col(docs, source_col).cast("string"), F.lit("")).alias("source"),
        col(docs, text_col).alias("text"),
    )
    rows = texts.mapInArrow(_counts, f"doc_id long, lang string, source string, {', '.join(f'{c} long' for c in COUNTS)}")
    rows = rows.withColumn("base_failed", F.expr(f"n_words < {cfg.least_words} or 100 * n_repeat_words > 50 * n_words"))
    words = "greatest(n_words, 1)"
    vector = (
        "ln(1 + n_words)",
        f"ln(1 + word_chars / {words})",
        "sqrt(n_symbols / greatest(word_chars, 1))",
        "sqrt(n_dup_lines / greatest(n_lines, 1))",
        f"sqrt(n_repeat_words / {words})",
    )
    rows = stage(rows.selectExpr("*", *(f"cast({v} as double) as x_{i}" for i, v in enumerate(vector))), "statistics")
    groups = stage(_groups(rows, cfg), "groups")
    rows = rows.join(small(groups, MOST_GROUPS), ["lang", "source"], "left")
    judged = rows.where("not base_failed and grp is not null")
    judged = judged.select("grp", *(f"x_{i}" for i in range(len(STATS))))
    found = rows.join(small(estimates(judged, cfg), MOST_GROUPS), "grp", "left").withColumn("distance", F.expr(f"({_distance()}) / unit"))
    kept = f"not base_failed and coalesce(distance <= {cfg.cutoff}, true)"
    return found.selectExpr("doc_id", *COUNTS[:5], "base_failed", f"{kept} as kept", "distance")
