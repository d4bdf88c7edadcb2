"""File sources and sinks: CSV in (S1, S2), CSV / Parquet out.

CSV is read with every column as STRING (no inference pass over the data,
and no silent coercion); typing happens in one projection with pandas'
NA tokens and a strict number grammar, then NaN becomes NULL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from ..functions.numeric import is_na_token, parse_binary, parse_number
from ..session import importable
from .csv_ranges import RANGE_BYTES, records

#: Column of a raw frame that holds the text of a line with too many or too few fields.
BAD_LINE = "_bad_line"


def read_csv_raw(spark: SparkSession, path: str, columns: list[str] | None = None,
                 range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Header row, all columns STRING, empty fields NULL; columns go by the file's own header names.

    Quotes are doubled inside quoted fields, which may hold line breaks; files
    of any size are still read in byte ranges by many tasks (``csv_ranges``).
    Columns of a directory of part files are taken from its first header.
    A line with too many or too few fields is kept in ``_bad_line`` for the
    validation to report.
    """
    names = columns or csv_header(spark, path)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*names, BAD_LINE]])
    options = {"quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD_LINE,
               "maxCharsPerColumn": "-1", "multiLine": "true"}
    importable(spark)
    parsed = records(spark, path, range_bytes=range_bytes).select(F.from_csv("record", schema.simpleString(), options).alias("r"))
    return parsed.select("r.*")


def csv_header(spark: SparkSession, path: str) -> list[str]:
    """Field names of a CSV file's first line."""
    first = spark.read.option("header", False).option("quote", '"').option("escape", '"').option("inferSchema", False).csv(path)
    row = first.first()
    return [x if x is not None else f"_c{i}" for i, x in enumerate(row)] if row is not None else []


def normalise(raw: DataFrame, binary_as_int: bool = True) -> DataFrame:
    """NA tokens -> NULL, strict numbers, declared types for known columns.

    Unknown columns are kept: strings stay strings (NA tokens nulled).
    Binary columns are cast to INT only when ``binary_as_int``; validate the
    raw frame first so a 1.5 is reported rather than truncated.
    """
    out = []
    for f in raw.schema.fields:
        if f.name == BAD_LINE:
            continue
        c = F.col(f.name)
        if not isinstance(f.dataType, T.StringType):
            out.append(c)
            continue
        if f.name in S.STRING_COLUMNS or (f.name not in S.MODEL_SCHEMA_COLUMNS):
            out.append(F.when(is_na_token(c), F.lit(None).cast("string")).otherwise(c).alias(f.name))
            continue
        if f.name in S.BINARY_COLUMNS:
            num = parse_binary(c)
            out.append((num.cast("int") if binary_as_int else num).alias(f.name))
        else:
            out.append(parse_number(c).alias(f.name))
    return raw.select(*out)


def read_students_csv(spark: SparkSession, path: str) -> DataFrame:
    """Raw + typed student frame from CSV (validation should use the raw one)."""
    return normalise(read_csv_raw(spark, path))


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """S3: CSV directory with a header (one part file per task, no coalesce(1)); quotes are doubled as they are read."""
    df.write.mode(mode).option("header", True).option("quote", '"').option("escape", '"').csv(path)


def save_split_ids(positions: DataFrame, path: str) -> None:
    """The saved (position, student_id, split) table, partitioned by split so a lookup reads only its own files."""
    positions.select("position", F.col(S.ID_COLUMN).cast("string").alias(S.ID_COLUMN), "split").write.mode(
        "overwrite").partitionBy("split").parquet(path)


def load_split_ids(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.where(F.col("split") == split) if split else df
