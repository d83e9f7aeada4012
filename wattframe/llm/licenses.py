"""License scans with DataFrame functions only: MinHash over overlapping windows, then exact containment.

Words are runs of letters and digits in lower case, shingles are ``SHINGLE`` words.  A template of t
shingles is looked for in windows of L = 2 * (next power of two of t) shingles that start every L / 2, so
every run of t shingles lies in one of them whole.  A window with the required containment then has a
Jaccard similarity of at least ``least_similarity`` with the template; with bands of one row, ``bands``
gives their number for a collision probability of ``PROBABILITY``.

A band can only collide where the shingle with the template's smallest hash (its anchor) is in the window.  So
the windows to be hashed are those around anchors of their length, found through a table of buckets of anchors; the
other windows have no equal band by definition.  The bands of a hashed window are joined with the templates' bands
on (length, band, value), and retrieved pairs are verified on the shingles themselves.  Neither step walks over
templates, so a scan costs about the same for ten templates and for thousands.  Long texts are cut into segments
that overlap by the longest window.
"""

from __future__ import annotations

import json
from math import ceil, log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .license_texts import NOTICES, common_wordings

SHINGLE, CONTAINMENT, PROBABILITY = 5, 0.8, 0.999
#: Windows that begin in one segment of a text: this many shingles, or 8 of the longest windows.
SEGMENT = 8192
#: Tables of templates up to this estimated size are broadcast; larger ones are joined by Spark's own choice.
BROADCAST_BYTES = 64 << 20
NO_WORD = r"[^\p{L}\p{N}]+"
TEMPLATES = NOTICES + common_wordings()


def window_shingles(t: int) -> int:
    """Shingles of a window for a template of t shingles."""
    return 2 * (1 << (t - 1).bit_length())


def least_similarity(containment: float = CONTAINMENT) -> float:
    """Least Jaccard similarity of a template and a window that contains this share of it (t > L / 4)."""
    return 0.25 * containment / (1 + 0.25 * (1 - containment))


def bands(containment: float = CONTAINMENT, probability: float = PROBABILITY) -> int:
    """Bands of one row so that such a window collides in one with at least this probability."""
    return ceil(log(1 - probability) / log(1 - least_similarity(containment)))


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), NO_WORD), lambda w: w != "")


def _hash_at(words: Column, i: Column) -> Column:
    return F.xxhash64(*[F.get(words, i + k) for k in range(SHINGLE)])


def _text_at(words: Column, i: Column) -> Column:
    return F.concat_ws(" ", F.slice(words, i + 1, F.lit(SHINGLE)))


def _starts(first: Column, last: Column) -> Column:
    """Shingle numbers from first to last; none if last is smaller."""
    return F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))


def _signature(hashes: Column, n: int) -> Column:
    """MinHash: the smallest value of each of n hash functions over the shingle hashes."""
    return F.array(*[F.array_min(F.transform(hashes, _function(j))) for j in range(n)])


def _function(j: int):
    """Hash function number j."""
    return lambda h: F.xxhash64(h, F.lit(j))


def _anchor(hashes: Column, j: int) -> Column:
    """The shingle hash with the smallest value of hash function j."""
    return F.array_min(F.transform(hashes, lambda h: F.struct(F.xxhash64(h, F.lit(j)).alias("v"), h.alias("h"))))["h"]


def _each(df: DataFrame, name: str, values: Column) -> DataFrame:
    """A row per array element.

    The plain ``explode`` would let the optimizer infer a filter on the array's size and push it, with
    copies of the whole array expression, below the columns it is made of, where words would be split
    again for every shingle.
    """
    return df.withColumn(name, F.explode_outer(values)).filter(F.col(name).isNotNull())


def prepared(spark: SparkSession, templates=None, containment: float = CONTAINMENT, probability: float = PROBABILITY) -> list[dict]:
    """Name, license, shingles, window length, signature and band anchors of every template."""
    templates = TEMPLATES if templates is None else templates
    if len({t[0] for t in templates}) < len(templates):
        raise ValueError("template names must differ")
    n = bands(containment, probability)
    df = spark.createDataFrame(templates, "template string, license string, text string").withColumn("w", words_of(F.col("text")))
    every = _starts(F.lit(0), F.size("w") - SHINGLE)
    df = df.withColumn("h", F.array_distinct(F.transform(every, lambda i: _hash_at(F.col("w"), i))))
    anchor = [_anchor(F.col("h"), j) for j in range(n)]
    rows = df.select("template", "license", F.array_distinct(F.transform(every, lambda i: _text_at(F.col("w"), i))).alias("shingles"),
                     _signature(F.col("h"), n).alias("signature"), F.array(*anchor).alias("anchors")).collect()
    short = [r["template"] for r in rows if not r["shingles"]]
    if short:
        raise ValueError(f"templates of fewer than {SHINGLE} words: {short}")
    return [{**r.asDict(), "window": window_shingles(len(r["shingles"]))} for r in rows]


def _buckets(found: list[dict]):
    """A function from a shingle hash to the window lengths of the templates that have it as an anchor.

    The table is one literal: buckets by remainder, about one anchor each, so a look-up doesn't depend on their number.
    """
    pairs = sorted({(a, t["window"]) for t in found for a in t["anchors"]})
    size = max(1, len(pairs))
    buckets: list[list] = [[] for _ in range(size)]
    for a, length in pairs:
        buckets[a % size].append({"h": a, "length": length})
    table = F.from_json(F.lit(json.dumps(buckets)), "array<array<struct<h: bigint, length: int>>>")
    return lambda h: F.transform(F.filter(F.get(table, F.pmod(h, F.lit(size)).cast("int")), lambda x: x["h"] == h), lambda x: x["length"])


def _small(df: DataFrame, size: int) -> DataFrame:
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def scan(docs: DataFrame, templates=None, id_col: str = "doc_id", text_col: str = "text", containment: float = CONTAINMENT,
         probability: float = PROBABILITY) -> DataFrame:
    """``doc_id, template, license, containment, first_word`` for every template found in a document.

    ``containment`` is the largest share of the template's shingles in one window, ``first_word`` the first
    word of the first window with the required share.  Null texts and texts of fewer than five words match
    nothing; rows equal in id and text give one result.  Other columns are ignored; an empty table, or no
    template, gives no rows.  Texts of any length are scanned whole, segment by segment.
    """
    spark = docs.sparkSession
    found = prepared(spark, templates, containment, probability)
    n = bands(containment, probability)
    longest = max((t["window"] for t in found), default=2)
    segment = max(SEGMENT, 8 * longest)
    lengths_at = _buckets(found)
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), words_of(text).alias("w"))
    cut = F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - SHINGLE, F.lit(0)), F.lit(segment)), lambda s: F.struct(
        s.alias("at"), F.slice("w", s + 1, F.lit(segment + longest + SHINGLE - 1)).alias("w")))
    rows = _each(rows, "part", cut).select("doc_id", "mark", F.col("part.at").alias("at"), F.col("part.w").alias("w"))
    # windows (length, number in the segment) around the anchors
    starts = _starts(F.lit(0), F.size("w") - SHINGLE)
    anchors = F.filter(starts, lambda i: F.size(lengths_at(_hash_at(F.col("w"), i))) > 0)
    rows = rows.withColumn("anchors", anchors)
    around = F.flatten(F.transform("anchors", lambda i: F.flatten(F.transform(lengths_at(_hash_at(F.col("w"), i)), lambda x: F.transform(
        F.array(F.lit(0), F.lit(1)), lambda back: F.struct(x.alias("length"), (F.floor(i / (x / 2)).cast("int") - back).alias("k")))))))
    windows = F.filter(F.array_distinct(around), lambda x: (x["k"] >= 0) & (x["k"] * x["length"] / 2 < segment))
    rows = _each(rows, "x", windows).select("doc_id", "mark", "at", "w", "x.length", (F.col("x.k") * F.col("x.length") / 2).cast("int").alias("first"))
    inside = _starts(F.col("first"), F.least(F.col("first") + F.col("length") - 1, F.size("w") - SHINGLE))
    rows = (rows.withColumn("shingles", F.transform(inside, lambda i: _text_at(F.col("w"), i)))
            .withColumn("signature", _signature(F.transform(inside, lambda i: _hash_at(F.col("w"), i)), n)).drop("w"))
    rows = rows.withColumn("first", F.col("at") + F.col("first"))
    # a look-up by (length, band, value)
    keys = [(t["window"], j, v, t["template"]) for t in found for j, v in enumerate(t["signature"])]
    table = spark.createDataFrame(keys, "length int, band int, value long, template string")
    size = sum(16 + len(k[3]) for k in keys) * 4
    hashed = _each(rows, "b", F.transform("signature", lambda v, j: F.struct(j.alias("band"), v.alias("value"))))
    hashed = hashed.select("doc_id", "mark", "first", "length", "shingles", "b.band", "b.value")
    retrieved = hashed.join(_small(table, size), ["length", "band", "value"])
    full = spark.createDataFrame([(t["template"], t["license"], t["shingles"]) for t in found], "template string, license string, wanted array<string>")
    size = sum(len(x) + 16 for t in found for x in t["shingles"]) * 4
    pairs = retrieved.join(_small(full, size), "template")
    share = F.size(F.array_intersect("wanted", "shingles")) / F.size("wanted")
    return (pairs.select("doc_id", "mark", "template", "license", share.alias("share"), "first").filter(F.col("share") >= containment)
            .groupBy("doc_id", "mark", "template", "license").agg(F.max("share").alias("containment"), F.min("first").alias("first_word"))
            .drop("mark"))


def scan_sql(templates=None, containment: float = CONTAINMENT) -> str:
    """DuckDB SQL for :func:`scan` of ``documents``: containment of every template in all of its windows."""
    rows = ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in t) + ")" for t in (TEMPLATES if templates is None else templates))
    words = "list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"
    shingle = f"array_to_string(w[i + 1:i + {SHINGLE}], ' ')"
    return f"""WITH t(template, license, text) AS (VALUES {rows}),
tw AS (SELECT template, license, {words} AS w FROM t),
ti AS (SELECT *, unnest(range(0, len(w) - {SHINGLE - 1})) AS i FROM tw),
ts AS (SELECT DISTINCT template, license, {shingle} AS s FROM ti),
tn AS (SELECT template, license, count(*) AS n, CAST(pow(2, ceil(log2(count(*)))) AS BIGINT) AS half FROM ts GROUP BY 1, 2),
dw AS (SELECT doc_id, {words} AS w FROM documents),
di AS (SELECT *, unnest(range(0, len(w) - {SHINGLE - 1})) AS i FROM dw WHERE len(w) >= {SHINGLE}),
ds AS (SELECT doc_id, i, {shingle} AS s FROM di),
hit AS (SELECT doc_id, template, license, n, half, s, i // half AS k FROM ds JOIN ts USING (s) JOIN tn USING (template, license)),
win AS (SELECT * FROM hit UNION ALL SELECT * REPLACE (k - 1 AS k) FROM hit WHERE k > 0),
got AS (SELECT doc_id, template, license, k * half AS first, count(DISTINCT s) / n AS share FROM win GROUP BY doc_id, template, license, k, half, n)
SELECT doc_id, template, license, max(share) AS containment, CAST(min(first) AS INTEGER) AS first_word
FROM got WHERE share >= {containment} GROUP BY doc_id, template, license"""
