"""A training-data pipeline over ``documents``: five operators, each on what the one before kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a frame that is
written as Parquet and read again as the next one's ``docs``.  All but the last return the columns of
``docs``; ``n_chars``, where present, follows the text.

1. ``quality``    rows that the quality rules reject go;
2. ``simhash``    one row of each near-duplicate group stays (the smallest id, null ids last, then the first text);
3. ``substring``  words of passages that also occur elsewhere go (a text may become empty, its row stays);
4. ``pii``        personal data is replaced by its kind in angle brackets;
5. ``packing``    token windows: one row per piece, with its ids.

Null texts fail the quality rules.  Repeated rows are near duplicates of one another, so one stays.  Columns
with the names of an operator's results keep their own values.  Empty tables pass through as such.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattframe.llm import packing as _packing
from wattframe.llm import pii as _pii
from wattframe.llm import quality as _quality
from wattframe.llm import simhash as _simhash
from wattframe.llm import substring as _substring
from wattframe.llm.queries import table, vocabulary
from wattframe.llm.scratch import reachable, written
from wattframe.session import configure

#: SQL can't express the fitted model, fingerprints or tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def _narrow(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text")


def _with_text(docs: DataFrame, text: str) -> DataFrame:
    """The columns of documents with ``text`` from another column, and ``n_chars`` to match."""
    out = docs.withColumn("text", F.col(text))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = _quality.fit(_narrow(docs), table(spark, sf_dir, "labels"))
    hold = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row")  # the row's own columns can't clash
    return _quality.score(docs.select("text", hold), model).filter("kept").select("row.*", "text").select(*docs.columns)


def simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _simhash.representatives(docs, keep_unnamed=False)


def substring(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    hold = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row")
    clean = _substring.without_repeats(docs.select("doc_id", "text", hold))
    return _with_text(clean.select("row.*", "text", "clean_text"), "clean_text").select(*docs.columns)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _with_text(_pii.redact(docs), "text").select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _packing.pack(docs, vocabulary("byte_bpe_50k.json"))


def _ready(stage):
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        configure(spark)
        reachable(spark)
        return stage(spark, docs, sf_dir)
    run.__name__ = stage.__name__
    return run


STAGES = [(f.__name__, _ready(f)) for f in (quality, simhash, substring, pii, packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; the last one's rows."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, _ = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    return run(spark, sf_dir)
