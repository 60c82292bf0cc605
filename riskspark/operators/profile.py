"""Table profiling: sizes, missing cells, duplicates, domains, descriptive statistics, dictionary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import RiskConfig
from ..functions import clean, display_name, q, stack, text
from ..functions.expressions import literal
from .ordered import exact_quantiles


def _missing(df: DataFrame, name: str) -> str:
    kind = df.schema[name].dataType.typeName()
    test = f"{q(name)} is null"
    return f"{test} or isnan({q(name)})" if kind in ("double", "float") else test


def _missing_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: ``_rows`` and ``_m<i>`` missing cells per column, from one scan."""
    return df.selectExpr(
        "count(1) as _rows", *[f"count_if({_missing(df, c)}) as _m{i}" for i, c in enumerate(columns)]
    )


def table_profile(df: DataFrame) -> DataFrame:
    """Row, column and missing-cell counts, in one scan."""
    total = " + ".join(f"count_if({_missing(df, c)})" for c in df.columns)
    return df.selectExpr(
        "count(1) as n_rows", f"cast({len(df.columns)} as bigint) as n_columns", f"{total} as n_nulls"
    )


def null_audit(df: DataFrame) -> DataFrame:
    """Missing cells and their share per column, in one scan."""
    rows = [(text(c), f"_m{i}") for i, c in enumerate(df.columns)]
    return _missing_counts(df, df.columns).selectExpr(
        "_rows", stack(rows, ("column_name", "n_null"))
    ).selectExpr("column_name", "n_null", "round(n_null / nullif(_rows, 0), 6) as null_rate")


def duplicate_count(df: DataFrame) -> DataFrame:
    """Rows equal to an earlier row on every column; missing values compare equal.

    Copies collapse in the map-side aggregate, so a row that occurs very often costs one shuffled row per
    task.
    """
    groups = df.groupBy(*df.columns).agg(F.expr("count(1) as _n"))
    return groups.selectExpr("cast(coalesce(sum(_n - 1), 0) as bigint) as n_duplicates")


def filter_domains(df: DataFrame, cfg: RiskConfig) -> DataFrame:
    """Selectable values per category, and the numeric range of the age column (as text)."""
    pairs = stack([(text(c), q(c)) for c in cfg.filter_cols], ("column_name", "value"))
    values = (
        df.selectExpr(pairs)
        .filter("value is not null")
        .groupBy("column_name", "value")
        .agg(F.expr("count(1) as n"))
    )
    if cfg.age_col is None:
        return values
    age = f"cast({q(cfg.age_col)} as bigint)"
    bounds = df.selectExpr(f"min({age}) as lo", f"max({age}) as hi", f"count({age}) as n").selectExpr(stack(
        [(text(f"{cfg.age_col}.{end}"), f"cast({c} as string)", "n") for end, c in (("min", "lo"), ("max", "hi"))],
        ("column_name", "value", "n"),
    ))
    return values.unionByName(bounds)


def describe_table(
    df: DataFrame, columns: Sequence[str], cfg: RiskConfig | None = None, decimals: int = 2
) -> DataFrame:
    """count, mean, sample std, min, quartiles and max; one row per column. Quartiles are exact."""
    cols = list(columns)
    parts = {"n": "count", "mean": "avg", "std": "stddev_samp", "min": "min", "max": "max"}
    moments = df.selectExpr(*[
        f"{fn}({clean(c)}) as _{name}{i}" for i, c in enumerate(cols) for name, fn in parts.items()
    ]).selectExpr(stack(
        [(text(c), *[f"_{name}{i}" for name in parts]) for i, c in enumerate(cols)], ("column_name", *parts)
    ))
    quartiles = exact_quantiles(df, cols, (0.25, 0.5, 0.75)).withColumnRenamed("feature", "column_name")
    # quartiles: one row per described column.
    out = moments.join(F.broadcast(quartiles), "column_name", "left")
    name = display_name("column_name", cfg) if cfg else F.col("column_name")
    numbers = ("mean", "std", "min", "p25", "p50", "p75", "max")
    return out.select(name.alias("column_name"), "n", *[F.expr(f"round({c}, {decimals}) as {c}") for c in numbers])


def data_dictionary(df: DataFrame, cfg: RiskConfig) -> DataFrame:
    """Configured variable catalogue checked against the table: presence, type and missing cells."""
    entries = [e for e in cfg.dictionary]
    stored = {c: df.schema[c].dataType.simpleString() for c in df.columns}
    known = [e[0] for e in entries if e[0] in stored]
    rows = [
        (
            *[text(v) for v in entry],
            literal("leakage" in entry[4].lower()),
            f"cast({literal(stored.get(entry[0]))} as string)",
            f"_m{known.index(entry[0])}" if entry[0] in stored else "cast(null as bigint)",
            "_rows",
        )
        for entry in entries
    ]
    names = (
        "variable", "kind", "description", "category", "model_use", "is_leakage", "stored_type", "n_null", "n_rows"
    )
    return _missing_counts(df, known).selectExpr(stack(rows, names))


def preview(df: DataFrame, order: str | None = None, n: int = 10) -> DataFrame:
    """First rows, by key when one is given (a distributed table has no input order)."""
    return df.orderBy(F.asc_nulls_last(order)).limit(n) if order else df.limit(n)
