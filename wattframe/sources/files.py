"""File scans and sinks.

* Scans always take a declared ``StructType`` (no inference on the hot path).  With CSV, Spark applies
  a declared schema **by position** and ignores the header names, so a schema can rename on read.
* Sinks are partitioned writes (one file per task); ``single_file=True`` coalesces to one task and is
  only for small hand-over tables.  Parquet is the default intermediate format: columnar, splittable,
  with pushed filters and pruned columns on re-read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattframe.session import cut_lineage


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None, header: bool = True,
             **options) -> DataFrame:
    """CSV scan.  ``schema=None`` infers types (an extra pass over the file — exploration only)."""
    r = spark.read.option("header", header)
    r = r.schema(schema) if schema is not None else r.option("inferSchema", True)
    for k, v in options.items():
        r = r.option(k, v)
    return r.csv(path)


def read_csv_checked(spark: SparkSession, path: str, schema: T.StructType, header_names: list[str] | None = None,
                     **options) -> tuple[DataFrame, DataFrame]:
    """``(good, quarantine)`` of a CSV source, parsed once and landed in the shared folder.

    ``header_names`` are the names that every file's header must show, in order; a file with others raises (names
    are then replaced by the schema's, by position).  Without them the files have no header.  A line with too few or
    too many fields, or with a value that its column can't hold, is no good row: it goes whole to the quarantine
    (``line, reason``), where the reason is the first column that can't hold its value, else ``number of fields``.
    """
    bad = "_corrupt_line"
    if header_names is not None and len(header_names) != len(schema):
        raise ValueError("as many header names as columns are needed")
    names = header_names or schema.names
    typed = T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, schema)]).add(bad, "string")
    r = spark.read.options(**options).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", bad).option("columnPruning", False)
    r = r.option("header", header_names is not None).option("enforceSchema", header_names is None)
    landed = cut_lineage(r.schema(typed).csv(path).toDF(*schema.names, bad))
    plain = T.StructType([T.StructField(n, T.StringType()) for n in schema.names])
    raw = F.from_csv(F.col(bad), plain.simpleString()[len("struct<"):-1].replace(":", " "), {k: str(v) for k, v in options.items()})
    lost = [F.when(raw[n].isNotNull() & F.col(n).isNull(), F.lit(n)) for n in schema.names]
    quarantine = landed.filter(F.col(bad).isNotNull()).select(
        F.col(bad).alias("line"), F.coalesce(*lost, F.lit("number of fields")).alias("reason"))
    return landed.filter(F.col(bad).isNull()).drop(bad), quarantine


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    return read_parquet(spark, f"{sf_dir.rstrip('/')}/{name}.parquet", columns)


def read_json(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def _writer(df: DataFrame, mode: str, single_file: bool, partition_by):
    out = df.coalesce(1) if single_file else df
    w = out.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    return w


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists", header: bool = True,
              single_file: bool = False, partition_by=None) -> str:
    _writer(df, mode, single_file, partition_by).option("header", header).csv(path)
    return path


def write_json(df: DataFrame, path: str, mode: str = "errorifexists", single_file: bool = False) -> str:
    _writer(df, mode, single_file, None).json(path)
    return path


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists", partition_by=None) -> str:
    _writer(df, mode, False, partition_by).parquet(path)
    return path


def register_views(**frames: DataFrame) -> None:
    for name, df in frames.items():
        df.createOrReplaceTempView(name)


def run_sql(spark: SparkSession, query: str, **views: DataFrame) -> DataFrame:
    """Register ``views`` then run ``query`` (parsed, analysed and optimised by Catalyst)."""
    register_views(**views)
    return spark.sql(query)


def save_model(model, path: str) -> str:
    """Persist a fitted Spark ML model / pipeline (to the shared folder)."""
    model.write().overwrite().save(path)
    return path


def load_model(path: str):
    """Load a model saved with ``save_model`` (pipeline or single model)."""
    from pyspark.ml import PipelineModel
    try:
        return PipelineModel.load(path)
    except Exception:  # not a pipeline: read the class from the metadata
        import json
        spark = SparkSession.getActiveSession()
        meta = json.loads(spark.read.text(f"{path}/metadata").first()[0])
        module, _, cls = meta["class"].replace("org.apache.spark.ml", "pyspark.ml").rpartition(".")
        import importlib
        return getattr(importlib.import_module(module), cls).load(path)
