"""SimHash near-duplicates: 64-bit fingerprints, bit-sliced comparison inside banded blocks.

1. Fingerprints: one Arrow pass over the text (XXH64 of every word shingle, bit majorities).
2. Equal fingerprints collapse in one grouped aggregation, so a group of exact copies, whatever its
   size, goes on as one row.
3. A pair within the radius differs in at most ``radius`` of ``radius + 2`` bands, so it agrees on
   some two bands.  Every two bands make a table keyed by their bits; rows of one key are compared.
   A key with more than ``BLOCK`` rows is dealt into sub-blocks and each pair of sub-blocks becomes
   its own group, so no task ever holds more than two sub-blocks at a time.
4. In a group the fingerprints are stored as vertical bit planes (one lane per row).  A query updates
   all distances of a 64-lane block with carry-save counters, plane by plane; a block is
   abandoned once every lane exceeds the radius.
5. Links inside a group are reduced to one spanning star per group before they leave the task, so a
   dense group of m texts emits m edges, not m * m; components join the stars across groups.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrow_text as A
from .components import connected_components
from .scratch import carry, id_text, written

SHINGLE, RADIUS = 3, 2
#: Rows of one sub-block, and comparisons (query, 64 lanes) made at once: bounds of a task's memory.
BLOCK, AT_ONCE = 4096, 1 << 16

U64 = np.uint64


def fingerprints(column: pa.Array, shingle: int = SHINGLE) -> np.ndarray:
    """The 64-bit fingerprint of every text of a column."""
    data, offsets = A.buffers(column)
    data = A.LOWER[data]
    starts, ends, words = A.word_bounds(data, offsets)
    n_words = np.diff(words)
    text, ws, we = A.joined(data, starts, ends)
    # first words of the shingles: all but the last shingle-1 words, or word 0 of a shorter text
    n_sh = np.where(n_words >= shingle, n_words - shingle + 1, np.minimum(n_words, 1))
    at = np.concatenate([[0], np.cumsum(n_sh)])
    first = np.repeat(words[:-1] - at[:-1], n_sh) + np.arange(at[-1])
    last = first + np.repeat(np.minimum(n_words, shingle) - 1, n_sh)
    h = A.xxh64(text, ws[first], we[last] - ws[first], 42)
    out = np.zeros(len(offsets) - 1, U64)
    some = np.flatnonzero(n_sh)
    if len(some):
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, at[some], axis=0, dtype=np.int32)
        out[some] = np.packbits(2 * ones > n_sh[some][:, None], axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def with_fingerprint(docs: DataFrame, text_col: str = "text", shingle: int = SHINGLE, name: str = "fp") -> DataFrame:
    """``docs`` with the fingerprint as a signed long column."""
    def run(batches):
        for batch in batches:
            for part in A.slices(batch, text_col):
                yield part, [pa.array(fingerprints(part.column(part.schema.get_field_index(text_col)), shingle).view(np.int64))]

    return carry(docs, run, [(name, "bigint")], text_col)


# --- candidate groups -----------------------------------------------------------------------

def band_masks(radius: int = RADIUS) -> list[int]:
    """For every two of ``radius + 2`` bands the mask of their bits."""
    n = radius + 2
    cuts = [64 * i // n for i in range(n + 1)]
    bands = [((1 << cuts[i + 1]) - 1) & ~((1 << cuts[i]) - 1) for i in range(n)]
    return [a | b for a, b in combinations(bands, 2)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def candidate_groups(fps: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """Rows ``table, key, one, two, side, fp`` of every group to compare; lone rows are left out.

    ``one`` and ``two`` name the sub-blocks of a group; ``side`` says which of them the row is in.
    """
    keys = F.array(*[F.struct(F.lit(i).alias("table"), F.col("fp").bitwiseAND(F.lit(_signed(m)).cast("long")).alias("key"))
                     for i, m in enumerate(band_masks(radius))])
    rows = fps.select("fp", F.explode(keys).alias("k")).select("k.table", "k.key", "fp")
    sizes = rows.groupBy("table", "key").agg(F.count("*").alias("n")).filter("n > 1")
    parts = F.ceil(F.col("n") / F.lit(block)).cast("int")
    dealt = (rows.join(sizes, ["table", "key"]).select("table", "key", "fp", parts.alias("parts"))
             .withColumn("own", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")))
    return (dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
            .select("table", "key", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"),
                    (F.col("own") > F.col("other")).cast("int").alias("side"), "fp"))


# --- bit-sliced comparison ------------------------------------------------------------------

def planes(fp: np.ndarray) -> np.ndarray:
    """Vertical bit planes: ``out[p, w]`` holds bit p of the rows 64 w to 64 w + 63, one per lane."""
    full = np.zeros(-(-len(fp) // 64) * 64, U64)
    full[:len(fp)] = fp
    bits = np.unpackbits(full.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u8")


def _lanes_from(n: np.ndarray) -> np.ndarray:
    """All lanes from number n (0 to 64) on."""
    n = np.clip(n, 0, 64)
    return np.where(n >= 64, U64(0), ~U64(0) << np.minimum(n, 63).astype(U64))


def close_pairs(fp: np.ndarray, lo: np.ndarray, hi: np.ndarray, radius: int = RADIUS):
    """Yield index arrays (i, j), ``lo[i] <= j < hi[i]``, of the rows within the radius.

    Distances are kept as vertical counters: the carry of one bit plane ripples through the counter
    bits of 64 lanes at once, and a lane that passes the radius stays in ``gone``.
    """
    n_bits = max(1, int(radius).bit_length())
    sliced = planes(fp)
    first, last = lo // 64, np.where(hi > lo, (hi - 1) // 64, lo // 64 - 1)
    count = np.maximum(last - first + 1, 0)
    at = np.concatenate([[0], np.cumsum(count)])
    for begin in range(0, int(at[-1]), AT_ONCE):
        task = np.arange(begin, min(begin + AT_ONCE, int(at[-1])))
        q = np.searchsorted(at, task, side="right") - 1
        w = first[q] + task - at[q]
        gone = ~_lanes_from(lo[q] - 64 * w) | _lanes_from(hi[q] - 64 * w)
        counter = [np.zeros(len(q), U64) for _ in range(n_bits)]
        mine = fp[q]
        for p in range(64):
            carry_bit = sliced[p][w] ^ (U64(0) - ((mine >> U64(p)) & U64(1)))
            for b in range(n_bits):
                counter[b], carry_bit = counter[b] ^ carry_bit, counter[b] & carry_bit
            gone |= carry_bit
            if p % 4 == 3 or p == 63:
                gone |= _beyond(counter, radius)
                open_ = gone != ~U64(0)
                if not open_.all():  # abandon the blocks in which every lane is too far
                    q, w, gone, mine = q[open_], w[open_], gone[open_], mine[open_]
                    counter = [c[open_] for c in counter]
                if not len(q):
                    break
        if len(q):
            hit = np.unpackbits((~gone).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            t, lane = np.nonzero(hit)
            yield q[t], w[t] * 64 + lane


def _beyond(counter: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose counter is larger than the radius (bitwise comparison, highest bit first)."""
    more, same = np.zeros_like(counter[0]), np.full_like(counter[0], ~U64(0))
    for b in reversed(range(len(counter))):
        if radius >> b & 1:
            same &= counter[b]
        else:
            more |= same & counter[b]
            same &= ~counter[b]
    return more


def merge_labels(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Join the classes of i and j; ``label`` points to the smallest index of each class."""
    while len(i):
        a, b = label[i], label[j]
        differ = a != b
        if not differ.any():
            return label
        i, j, a, b = i[differ], j[differ], a[differ], b[differ]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    return label


def _stars(group: np.ndarray, side: np.ndarray, same: np.ndarray, fp: np.ndarray, radius: int):
    """Edges (fingerprint, fingerprint) that span the links of whole groups, rows sorted by group, side."""
    n = len(fp)
    ends = np.append(np.flatnonzero(group[1:] != group[:-1]) + 1, n)
    end = ends[np.searchsorted(ends, np.arange(n), side="right")]
    # of two different sub-blocks, rows of side 0 meet those of side 1; else each row meets the later ones
    begin = np.concatenate([[0], ends[:-1]])[np.searchsorted(ends, np.arange(n), side="right")]
    zeros = np.concatenate([[0], np.cumsum(side == 0)])
    split = begin + zeros[end] - zeros[begin]
    lo = np.where(same, np.arange(n) + 1, split)
    hi = np.where(same | (side == 0), end, lo)
    label = np.arange(n)
    for i, j in close_pairs(fp, lo, hi, radius):
        label = merge_labels(label, i, j)
    tied = np.flatnonzero(label != np.arange(n))
    return fp[tied], fp[label[tied]]


def linked(fps: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """Edges ``a, b`` between distinct fingerprints that span exactly the links within the radius."""
    def run(batches):
        held = None
        for batch in batches:
            cols = {n: batch.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate(batch.schema.names)}
            rows = np.rec.fromarrays([cols[n] for n in ("table", "key", "one", "two", "side", "fp")],
                                     names="table,key,one,two,side,fp")
            held = rows if held is None else np.concatenate([held, rows]).view(np.recarray)
            if not len(held):
                continue
            new = np.flatnonzero(np.any([held[k][1:] != held[k][:-1] for k in ("table", "key", "one", "two")], axis=0))
            if len(new):  # the last group may go on in the next batch
                yield from edges(held[:new[-1] + 1])
                held = held[new[-1] + 1:].copy().view(np.recarray)
        if held is not None and len(held):
            yield from edges(held)

    def edges(rows):
        changed = np.any([rows[k][1:] != rows[k][:-1] for k in ("table", "key", "one", "two")], axis=0)
        group = np.concatenate([[0], np.cumsum(changed)])
        a, b = _stars(group, rows["side"], rows["one"] == rows["two"], np.ascontiguousarray(rows["fp"]).view(U64), radius)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    order = ["table", "key", "one", "two"]
    return (candidate_groups(fps, radius, block).repartition(*order).sortWithinPartitions(*order, "side")
            .mapInArrow(run, "a long, b long"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs``.

    Null and empty texts have fingerprint zero and are linked like any other.  Repeated rows stay, one
    result row each.  A null id is never a component's name; a component without any id has a null
    name.  Other columns are ignored; an empty table gives no rows.
    """
    prints, _ = written(with_fingerprint(id_text(docs, id_col, text_col), "text", shingle).select("doc_id", "fp"), "fingerprints")
    named = _components(prints, radius, block)
    lows = named.groupBy("component").agg(F.min("low").alias("component_id"))
    names = named.join(lows, "component").select("fp", "component_id")
    return prints.join(names, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _components(prints: DataFrame, radius: int, block: int) -> DataFrame:
    """``fp, low, component`` of every distinct fingerprint: its smallest id and its component."""
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("low"))
    nodes = connected_components(linked(distinct.select("fp"), radius, block).distinct(), "a", "b")
    return distinct.join(nodes, distinct["fp"] == nodes["node"], "left").select(
        "fp", "low", F.coalesce("component", "fp").alias("component"))


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    radius: int = RADIUS, block: int = BLOCK, keep_unnamed: bool = True) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: the smallest id (null ids last), then the first text.

    Rows are told apart by id and a hash of the text, so different texts under one id belong to their own
    groups.  With ``keep_unnamed`` rows without an id stay as they are and the others are reduced among
    themselves; without it they are rows like any other, and a group of them alone keeps one.
    """
    mark = F.xxhash64(F.col(text_col).cast("string"))
    src = docs.filter(F.col(id_col).isNotNull()) if keep_unnamed else docs
    texts = id_text(docs, id_col, text_col).withColumn("mark", F.xxhash64("text"))
    prints, _ = written(with_fingerprint(texts, "text", shingle).select("doc_id", "mark", "fp"), "fingerprints")
    named = _components(prints, radius, block)
    lows = named.groupBy("component").agg(F.min("low").alias("low"))
    low = named.select("fp", "component").join(lows, "component").withColumnRenamed("fp", "f")
    best = (prints.join(low, (F.col("fp") == F.col("f")) & F.col("doc_id").eqNullSafe(F.col("low")))
            .select(F.col("doc_id").alias("__d"), F.col("mark").alias("__m"), F.col("component").alias("__component")).distinct())
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    found = src.select(row.alias("__row"), F.col(id_col).cast("long").alias("__id"), mark.alias("__mark")).join(
        best, F.col("__id").eqNullSafe(F.col("__d")) & (F.col("__mark") == F.col("__m")))
    # a grouped minimum: a hot component collapses before the shuffle
    first = found.groupBy("__component").agg(F.min_by("__row", F.struct(F.col("__row").getField(text_col))).alias("__row"))
    stay = first.select("__row.*")
    return stay.unionByName(docs.filter(F.col(id_col).isNull())) if keep_unnamed else stay
