"""The thin ``opN_*`` queries: each applies one operator to its whole table.

``QUERIES`` maps names to ``(spark, sf_dir) -> DataFrame``.  ``ORACLE_SQL`` holds DuckDB SQL where SQL
can express the result; the other queries are held against brute-force versions in ``tests/llm``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattframe.session import configure, scratch_path

from . import bpe, embeddings, langid, licenses, packing, periodic, pii, quality, rans, secrets, simhash, spelling, substring
from .scratch import reachable

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            configure(spark)
            reachable(spark)
            return fn(spark, sf_dir)
        run.__name__ = fn.__name__
        QUERIES[name] = run
        if sql is not None:
            ORACLE_SQL[name] = sql
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Where a public vocabulary file lies (the operators take any path)."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op4_simhash")
def op4_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op1_quality")
def op1_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).drop("text")


@query("op5_substring")
def op5_substring(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring.without_repeats(docs, with_text=False).drop("text")


@query("op3_byte_bpe")
def op3_byte_bpe(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = bpe.encode_decode(docs, vocabulary("byte_bpe_50k.tiktoken"))
    return found.withColumn("spans_xxh64", F.xxhash64("starts", "ends")).drop("text", "ids", "starts", "ends", "decoded")


@query("op6_packing")
def op6_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), with_ids=False)


@query("op8_rans_tokens")
def op8_rans_tokens(spark, sf_dir):
    out = scratch_path(spark, "llm", "tokens")
    rans.write_tokens(table(spark, sf_dir, "documents"), out, vocabulary("byte_bpe_50k.json"))
    return rans.read_tokens(spark, out, with_ids=False)


@query("op10_embeddings")
def op10_embeddings(spark, sf_dir):
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op9_pii")
def op9_pii(spark, sf_dir):
    return pii.report(table(spark, sf_dir, "documents"))


@query("op7_language")
def op7_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = langid.learn(docs)
    found = langid.predict(docs.select("doc_id", "text"), model)
    return found.withColumn("held_out", F.coalesce(langid.fold() == 2, F.lit(False))).drop("text")


@query("op2_licenses", licenses.scan_sql())
def op2_licenses(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


@query("op13_secrets", secrets.report_sql())
def op13_secrets(spark, sf_dir):
    return secrets.report(table(spark, sf_dir, "documents"))


@query("op12_periodic")
def op12_periodic(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    docs = docs.select("doc_id", periodic.echoed(F.col("doc_id"), F.col("text")).alias("text"))
    return periodic.periodic_runs(docs, with_runs=False, with_text=False).drop("text")


@query("op11_spelling")
def op11_spelling(spark, sf_dir):
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))
