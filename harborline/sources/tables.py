"""Input tables in, result tables out."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from ..functions.dates import parse_dates
from .schemas import CSV_NAMES, INPUT_TABLES

# Order stamps that a source may lack as a whole; the analysis then derives them.
OPTIONAL = {"orders": ("order_approved_at", "order_delivered_timestamp", "order_estimated_delivery_date")}


def conform(df: DataFrame, schema: T.StructType, optional: Sequence[str] = ()) -> DataFrame:
    """The declared columns in order: missing ones NULL, existing ones cast, unparsable values NULL.

    Stamps given as text are read with the one date format that fits the column best, other values of it as ISO stamps.
    A missing column named in `optional` stays missing. The alias `freight_value` is taken for shipping_charges.
    """
    present = {c.lower(): c for c in df.columns}
    if "freight_value" in present and "shipping_charges" not in present:
        present["shipping_charges"] = present["freight_value"]
    kinds = dict(df.dtypes)
    fields = []
    for field in schema.fields:
        source = present.get(field.name)
        stamped = isinstance(field.dataType, (T.TimestampNTZType, T.TimestampType))
        if source and stamped and kinds[source] == "string":
            df = parse_dates(df, source, f"__{source}")
            found = F.coalesce(F.col(f"__{source}").cast(field.dataType), F.col(source).try_cast(field.dataType))
            fields.append(found.alias(field.name))
        elif source:
            fields.append(F.col(present[field.name]).try_cast(field.dataType).alias(field.name))
        elif field.name not in optional:
            fields.append(F.lit(None).cast(field.dataType).alias(field.name))
    return df.select(*fields)


def empty_table(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def read_table(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "csv", optional: Sequence[str] = ()) -> DataFrame:
    """Scan a table with its declared schema; a missing source gives an empty frame of that schema.

    Only an absent path counts as missing: other read errors surface. CSV columns are taken by header name.
    """
    try:
        if fmt == "csv":
            raw = spark.read.option("header", True).csv(path)
        else:
            raw = spark.read.format(fmt).load(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return empty_table(spark, schema)
        raise
    return conform(raw, schema, optional)


def load_tables(spark: SparkSession, folder: str, fmt: str = "csv") -> dict[str, DataFrame]:
    """The four input tables below one folder."""
    names = CSV_NAMES if fmt == "csv" else {t: f"{t}.{fmt}" for t in INPUT_TABLES}
    return {t: read_table(spark, f"{folder}/{names[t]}", schema, fmt, OPTIONAL.get(t, ()))
            for t, schema in INPUT_TABLES.items()}


def write_result(df: DataFrame, folder: str, name: str, fmt: str = "parquet") -> str:
    """One result table, overwritten, written by the executors. CSV gets a header."""
    path = f"{folder}/{name}"
    df.write.mode("overwrite").options(**({"header": "true"} if fmt == "csv" else {})).format(fmt).save(path)
    return path


def write_results(results: Mapping[str, DataFrame], folder: str, fmt: str = "parquet") -> dict[str, str]:
    return {name: write_result(df, folder, name, fmt) for name, df in results.items()}
