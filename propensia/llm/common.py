"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import importable, shared_scratch, written  # noqa: F401

#: The white space of the word patterns: space and tab to carriage return.
SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = "[\\x20\\x09-\\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(columns: list[str], base: str) -> str:
    """A column name that does not clash (case-insensitively) with ``columns``."""
    taken = {c.lower() for c in columns}
    name = base
    while name.lower() in taken:
        name += "_"
    return name


def q(name: str) -> Column:
    """The column called exactly ``name``, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def give_back() -> None:
    """Return freed memory to the system; texts that were Python objects otherwise stay with the process."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)      # of glibc
    if trim:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most ``rows`` rows: few texts are Python objects at a time.

    Behind the last one freed memory, Arrow's and the C library's, goes back to
    the system, since the worker process stays for the stages to come.
    """
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)
    give_back()


def append_columns(df: DataFrame, new: list[T.StructField], fn: Callable[[pa.RecordBatch], list],
                   rows: int = 1024) -> DataFrame:
    """Pass every column of ``df`` through one Arrow pass and append what ``fn`` returns per part of ``rows`` rows."""
    fields = df.schema.fields + new
    plain = [f"c{i}" for i in range(len(fields))]      # inside the pass: names with dots do not resolve there
    schema = T.StructType([T.StructField(n, f.dataType, True) for n, f in zip(plain, fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, rows):
            yield pa.RecordBatch.from_arrays(list(b.columns) + list(fn(b)), names=plain)

    return df.toDF(*plain[: len(df.columns)]).mapInArrow(run, schema).toDF(*[f.name for f in fields])


def texts_of(column: pa.Array) -> list[str]:
    """Python strings of an Arrow string column; null counts as the empty text."""
    return [t or "" for t in column.to_pylist()]


def bytes_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column; null counts as the empty text."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [t or b"" for t in column.cast(kind).to_pylist()]


def labelled_sample(labels: DataFrame, keep: Column, columns: list[Column], limit: int, seed: int) -> DataFrame:
    """At most ``limit`` labelled rows, picked by a seeded hash of the id (same rows on every run).

    The bound makes the table safe to broadcast; it is the one documented
    bound on labelled rows that model fitting may use.
    """
    return (labels.where(keep & F.col("doc_id").isNotNull())
            .groupBy("doc_id").agg(*columns)
            .orderBy(F.xxhash64(F.lit(seed), F.col("doc_id")), F.col("doc_id"))
            .limit(limit))
