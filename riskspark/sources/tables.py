"""CSV in and out."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import RiskConfig

# Text tokens read as missing.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
    "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def _present(c: str) -> Column:
    return F.when(~F.col(c).isin(*NA_TOKENS), F.col(c))


def infer_types(text: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    """bigint, double or string per column, from one aggregate over all values."""
    checks = []
    for i, c in enumerate(columns):
        value = F.trim(_present(c))
        checks += [
            F.count_if(value.isNotNull() & value.try_cast("bigint").isNull()).alias(f"_l{i}"),
            F.count_if(value.isNotNull() & value.try_cast("double").isNull()).alias(f"_d{i}"),
            F.count(value).alias(f"_n{i}"),
        ]
    row = text.agg(*checks).first()
    kinds = {}
    for i, c in enumerate(columns):
        if row[f"_n{i}"] == 0:
            kinds[c] = "double"
        elif row[f"_l{i}"] == 0:
            kinds[c] = "bigint"
        else:
            kinds[c] = "double" if row[f"_d{i}"] == 0 else "string"
    return kinds


def csv_ingest(
    spark: SparkSession,
    path: str,
    types: Mapping[str, str] | None = None,
    keep_corrupt: bool = False,
    multiline: bool = False,
) -> DataFrame:
    """Read CSV with a header: missing-value tokens become null and numbers are cast leniently.

    Columns named in ``types`` get that type; if ``types`` is None they are inferred, otherwise unnamed
    columns stay text. Everything is read as text first, so a token such as ``NA`` cannot turn a number
    column into text. ``multiline`` allows line breaks inside quotes but makes a file unsplittable.
    """
    options = {"header": True, "quote": '"', "escape": '"', "multiLine": multiline}
    names = spark.read.options(**options).csv(path).columns
    corrupt = "_corrupt_record"
    fields = [T.StructField(n, T.StringType()) for n in names]
    text = (
        spark.read.options(**options, mode="PERMISSIVE", columnNameOfCorruptRecord=corrupt)
        .schema(T.StructType([*fields, T.StructField(corrupt, T.StringType())] if keep_corrupt else fields))
        .csv(path)
    )
    kinds = infer_types(text, names) if types is None else types

    def typed(c: str) -> Column:
        kind = kinds.get(c, "string")
        value = _present(c)
        if kind == "string":
            return value.alias(c)
        number = F.trim(value).try_cast(kind)
        if kind in ("int", "bigint"):  # "7.0" is a whole number too
            number = F.coalesce(number, F.trim(value).try_cast("double").try_cast(kind))
        return (F.nanvl(number, F.lit(None).cast("double")) if kind == "double" else number).alias(c)

    extra = [F.col(corrupt)] if keep_corrupt else []
    return text.select(*[typed(c) for c in names], *extra)


def export_name(cfg: RiskConfig, model: str) -> str:
    return f"{cfg.export_prefix}{model.replace(' ', '_').lower()}"


def csv_export(view: DataFrame, directory: str, cfg: RiskConfig, model: str, single_file: bool = False) -> str:
    """Write a table as UTF-8 CSV with header into a folder named after the model; return its path.

    ``single_file`` is for top-k views of a fixed size; a full table is written in parallel.
    """
    path = f"{directory.rstrip('/')}/{export_name(cfg, model)}.csv"
    out = view.coalesce(1) if single_file else view
    out.write.mode("overwrite").options(header=True, encoding="UTF-8", escape='"', emptyValue="").csv(path)
    return path
