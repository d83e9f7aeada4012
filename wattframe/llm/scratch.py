"""Scratch tables and row-carrying Arrow maps shared by the operators."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from wattframe.session import scratch_path


def reachable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it.

    Workers of a local session or of a cluster with the checkout at the same path need the folder on
    their path; where the package is installed or shipped with ``--py-files`` this changes nothing.
    """
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH", ""), root) if x)


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write a frame once under the shared checkpoint folder and read it back (lineage ends there)."""
    path = scratch_path(df.sparkSession, "llm", name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete scratch tables that nothing reads any more."""
    jvm = spark._jvm
    for p in paths:
        where = jvm.org.apache.hadoop.fs.Path(p)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator needs, under their internal names."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def carry(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[pa.RecordBatch, list]]],
          added: list[tuple[str, str]], text_col: str = "text") -> DataFrame:
    """Map rows in Arrow tasks and keep all their columns.

    ``fn`` yields (slice of input rows, arrays of the added columns).  An input column that has the
    name of an added one gives way to it.
    """
    names = [n for n, _ in added]
    kept = [f for f in df.schema.fields if f.name not in names or f.name == text_col]
    src = df.select(*[F.col(f"`{f.name}`") for f in kept])
    out = T.StructType([f for f in kept if f.name not in names] + [T.StructField(n, T._parse_datatype_string(t)) for n, t in added])
    hold = [i for i, f in enumerate(kept) if f.name not in names]
    schema = to_arrow_schema(out)

    def run(batches):
        for rows, arrays in fn(batches):
            columns = [rows.column(i) for i in hold] + list(arrays)
            yield pa.RecordBatch.from_arrays([c if c.type == f.type else c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)

    return src.mapInArrow(run, out)
