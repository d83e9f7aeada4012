"""Exact substring dedup: prefix-partitioned suffix trees over word windows.

A word goes when it lies in a window of ``window`` words whose word sequence also starts elsewhere.

1. Every window has one anchor: the leftmost smallest of its hashed ``gram``-word prefixes.  Equal
   windows have equal anchors, so windows can only repeat where anchors do.  Anchors are a few
   hundredths of all words; they are counted by hash with partial aggregation.
2. Consecutive windows of one anchor form a run of suffixes that share their text, the context.
   Only contexts of repeated anchors are cut out of the documents.  Equal contexts collapse in a
   grouped count, so a group of copies, whatever its size, goes on as one row.
3. Distinct contexts are partitioned by a prefix of variable length: the anchor while at most
   ``GROUP`` contexts share it, so that a group fits in memory.  A larger group is cut into its
   suffixes, and these into groups by ever longer prefixes (``prefix_steps``) until each fits.  Suffixes
   that are still too many with a prefix of the whole window are one node as deep as the window: all
   of them are equal, by their words and not by a hash, and need no further order.
4. In a group the suffixes are sorted (prefix doubling on exact word codes) and their common
   prefixes computed: runs of neighbours that share ``window`` words or more are the leaves below the
   deep internal nodes of the group's suffix tree, that is the occurrences of maximal repeats.
5. Marked windows go back to their documents, and one pass removes the covered words.

Shuffles carry anchors, contexts of repeated anchors and documents that hold some.  Documents and
anchors that can't be concerned are kept out by bitmaps of fixed size (``WORDS`` rows); the bitmaps
only save shuffling, exact joins follow.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import arrow_text as A
from .scratch import carry, drop, written

WINDOW = 35
#: Distinct contexts that may share a prefix before a longer one splits them; contexts sorted at once.
GROUP, AT_ONCE = 4096, 8192
#: Parts over which a group that is too large is dealt when it is split.
SALTS = 256
#: Rows of a bitmap (64 bits each): its broadcast has this size whatever the input.
WORDS = 1 << 17

U64 = np.uint64


def gram_words(window: int) -> int:
    """Words of an anchor: at most 30 windows share one, so a run's marks fit in a long."""
    return max(window - 29, (window + 5) // 6)


# --- anchors --------------------------------------------------------------------------------

def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, words: np.ndarray, window: int = WINDOW):
    """Runs of windows by anchor: row, anchor hash, first window, offset of the anchor in it, windows.

    Window numbers count words from the start of the document.
    """
    none = tuple(np.zeros(0, np.int64) for _ in range(5))
    k = gram_words(window)
    n, span = len(starts) - window + 1, window - k + 1
    if n <= 0:
        return none
    codes, distinct = A.word_codes(data, starts, ends)
    value = _windowed(A.dictionary_hashes(distinct)[codes], k)
    at = np.arange(len(value))
    size = 1
    while size < span:  # leftmost smallest gram of ever wider spans
        step = min(size, span - size)
        m = len(value) - step
        right = value[step:step + m] < value[:m]
        value, at = np.where(right, value[step:step + m], value[:m]), np.where(right, at[step:step + m], at[:m])
        size += step
    doc = A.segment_ids(words)
    whole = np.flatnonzero(doc[:n] == doc[window - 1:window - 1 + n])
    if not len(whole):
        return none
    first = np.flatnonzero(np.concatenate([[True], (at[whole][1:] != at[whole][:-1]) | (doc[whole][1:] != doc[whole][:-1])]))
    lo = whole[first]
    row = doc[lo]
    return row, value[lo].view(np.int64), lo - words[row], at[lo] - lo, np.diff(np.append(first, len(whole)))


def _windowed(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k consecutive values."""
    size, out = 1, h
    while size < k:
        step = min(size, k - size)
        m = len(out) - step
        out = A.mix(out[:m], out[step:step + m])
        size += step
    return out


def _each(batches, text: str = "text"):
    for batch in batches:
        for part in A.slices(batch, text):
            data, offsets = A.buffers(part.column(part.schema.get_field_index(text)))
            starts, ends, words = A.word_bounds(data, offsets)
            yield part, data, starts, ends, words


def anchor_rows(keyed: DataFrame, window: int = WINDOW) -> DataFrame:
    """``gram, doc_id, mark, run`` of all anchors; ``run`` packs first window, offset and windows."""
    def run(batches):
        for part, data, starts, ends, words in _each(batches):
            row, gram, lo, off, n = anchors(data, starts, ends, words, window)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(gram), part.column(0).take(take), part.column(1).take(take),
                                              pa.array(lo << 10 | off << 5 | n - 1)], names=["gram", "doc_id", "mark", "run"])

    return keyed.select("doc_id", "mark", "text").mapInArrow(run, "gram long, doc_id long, mark long, run long")


def contexts(hit: DataFrame, window: int = WINDOW) -> DataFrame:
    """The context of every run in ``runs`` (gram, run) with two 64-bit hashes of it."""
    names = ["c1", "c2", "doc_id", "mark", "lo", "gram", "n", "context"]

    def run(batches):
        for part, data, starts, ends, words in _each(batches):
            runs = part.column(part.schema.get_field_index("runs"))
            flat = runs.flatten()
            row = np.repeat(np.arange(part.num_rows), runs.value_lengths().to_numpy(zero_copy_only=False))
            packed = flat.field("run").to_numpy(zero_copy_only=False)
            lo, n = packed >> 10, (packed & 31) + 1
            text, ws, we = A.joined(data, starts, ends)
            begin = ws[words[row] + lo]
            size = we[words[row] + lo + n - 1 + window - 1] - begin
            cut, off = A.ragged_take(text, begin, size)
            take = pa.array(row)
            gram = flat.field("gram")
            # the hashes stand for (anchor, windows, text); the offset follows from the text
            c1, c2 = (A.xxh64(cut, off[:-1], size, seed) for seed in (1, 2))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c1.view(np.int64)), pa.array(c2.view(np.int64)), part.column(0).take(take), part.column(1).take(take),
                 pa.array(lo), gram, pa.array(n),
                 pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(off), pa.py_buffer(cut)]).cast(pa.binary())], names=names)

    return hit.select("doc_id", "mark", "text", "runs").mapInArrow(
        run, "c1 long, c2 long, doc_id long, mark long, lo long, gram long, n long, context binary")


# --- suffix trees ---------------------------------------------------------------------------

def deep_leaves(texts: pa.Array, n: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Per context a bit mask of its first n suffixes that share ``window`` words with another suffix.

    The suffixes of all contexts are ranked by prefix doubling; each context ends in a word of its
    own, so no common prefix passes an end.  Neighbours in suffix order with a common prefix of
    ``window`` words or more lie below one deep internal node.
    """
    data, offsets = A.buffers(texts)
    starts, ends, words = A.word_bounds(data, offsets)
    codes, distinct = A.word_codes(data, starts, ends)
    size = np.diff(words) + 1
    at = np.concatenate([[0], np.cumsum(size)])
    flat = np.full(at[-1], -1, np.int64)
    flat[np.arange(len(codes)) + A.segment_ids(words)] = codes
    flat[at[1:] - 1] = len(distinct) + np.arange(len(size))
    levels = [np.unique(flat, return_inverse=True)[1].astype(np.int64)]
    width = 1
    while width < window:  # ranks of the first 1, 2, 4, ... words
        last = levels[-1]
        top = int(last.max()) + 2
        after = np.zeros(len(last), np.int64)
        after[:-width or None] = last[width:] + 1
        levels.append(np.unique(last * top + after, return_inverse=True)[1].astype(np.int64))
        width *= 2
    suffix = np.repeat(at[:-1], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    order = np.argsort(levels[-1][suffix], kind="stable")
    a, b = suffix[order[:-1]], suffix[order[1:]]
    common = np.zeros(len(a), np.int64)
    for level in reversed(range(len(levels))):  # longest common prefix of neighbours, by powers of two
        i, j = a + common, b + common
        inside = (i < len(flat)) & (j < len(flat))
        same = inside & (levels[level][np.where(inside, i, 0)] == levels[level][np.where(inside, j, 0)])
        common += same << level
    deep = np.zeros(len(suffix), bool)
    deep[order[:-1]] |= common >= window
    deep[order[1:]] |= common >= window
    context = np.repeat(np.arange(len(n)), n)
    bit = np.arange(len(suffix)) - np.repeat(np.cumsum(n) - n, n)
    mask = np.zeros(len(n), np.int64)
    np.bitwise_or.at(mask, context[deep], np.int64(1) << bit[deep])
    return mask


def _tree_masks(groups: DataFrame, window: int) -> DataFrame:
    """``c1, c2, mask`` of contexts in groups that share a ``prefix``, whole groups at a time.

    ``first`` is the number of a context's first suffix among those of the context it was cut from.
    """
    def run(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            if held.num_rows >= AT_ONCE:
                prefix = held.column("prefix").to_numpy()
                new = np.flatnonzero(prefix[1:] != prefix[:-1])
                if len(new):  # the last group may go on
                    yield from masks(held.slice(0, new[-1] + 1))
                    held = held.slice(new[-1] + 1)
        if held is not None and held.num_rows:
            yield from masks(held)

    def masks(table):
        prefix = table.column("prefix").to_numpy()
        cuts = np.append(np.flatnonzero(prefix[1:] != prefix[:-1]) + 1, table.num_rows)
        begin = 0
        while begin < table.num_rows:
            end = int(cuts[max(np.searchsorted(cuts, begin + AT_ONCE, side="right") - 1, np.searchsorted(cuts, begin, side="right"))])
            part = table.slice(begin, end - begin).combine_chunks()
            n, copies = part.column("n").to_numpy(), part.column("copies").to_numpy()
            mask = deep_leaves(part.column("context").chunk(0), n, window)
            mask = np.where(copies > 1, (np.int64(1) << n) - 1, mask) << part.column("first").to_numpy()
            got = np.flatnonzero(mask)
            yield pa.RecordBatch.from_arrays([part.column("c1").chunk(0).take(pa.array(got)), part.column("c2").chunk(0).take(pa.array(got)),
                                              pa.array(mask[got])], names=["c1", "c2", "mask"])
            begin = end

    rows = groups.select("prefix", "c1", "c2", "first", "n", "copies", "context")
    return rows.repartition("prefix").sortWithinPartitions("prefix").mapInArrow(run, "c1 long, c2 long, mask long")


def prefix_steps(window: int) -> list[int]:
    """Lengths of ever longer prefixes: each half as long again as the one before, the last one the window."""
    steps = [gram_words(window)]
    while steps[-1] < window:
        steps.append(min(window, steps[-1] + (steps[-1] + 1) // 2))
    return steps[1:]


def _suffixes(crowded: DataFrame, steps: list[int], window: int) -> DataFrame:
    """The suffixes of contexts as rows of their own, cut at the window, with hashes of their prefixes."""
    def run(batches):
        for batch in batches:
            for part in A.slices(batch, "context"):
                data, offsets = A.buffers(part.column(4))
                starts, ends, words = A.word_bounds(data, offsets)
                n = part.column(2).to_numpy()
                row = np.repeat(np.arange(len(n)), n)
                bit = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                at = words[row] + bit
                begin = starts[at]
                keys = [pa.array(A.xxh64(data, begin, ends[at + k - 1] - begin, k).view(np.int64)) for k in steps]
                cut, off = A.ragged_take(data, begin, ends[at + window - 1] - begin)
                text = pa.Array.from_buffers(pa.large_binary(), len(row), [None, pa.py_buffer(off), pa.py_buffer(cut)]).cast(pa.binary())
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(take), part.column(1).take(take), pa.array(bit), pa.array(np.ones(len(row), np.int64)),
                     part.column(3).take(take), text, *keys], names=["c1", "c2", "first", "n", "copies", "context", *(f"p{k}" for k in steps)])

    return crowded.select("c1", "c2", "n", "copies", "context").mapInArrow(
        run, "c1 long, c2 long, first long, n long, copies long, context binary, " + ", ".join(f"p{k} long" for k in steps))


def _split(rows: DataFrame, keys: DataFrame, prefix: str, group: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows in groups of at most ``group`` by a prefix, and the rows in larger groups (None without any).

    ``keys`` has the prefix of each row; groups are counted there with partial aggregation.  Only larger ones are listed, once per salt: at most
    ``SALTS / group`` of the rows, so no task reads a large group whole.
    """
    counted = keys.groupBy(F.col(prefix).alias("prefix")).agg(F.count("*").alias("times")).filter(F.col("times") > group)
    large, path = written(counted.select("prefix", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")), "large")
    small = rows.withColumn("prefix", F.col(prefix))
    if large.isEmpty():
        drop(rows.sparkSession, path)
        return small, None
    small = small.withColumn("salt", F.pmod(F.xxhash64("c1", "first"), F.lit(SALTS)).cast("int"))
    return small.join(large, ["prefix", "salt"], "left_anti").drop("salt"), small.join(large, ["prefix", "salt"], "left_semi").drop("prefix", "salt")


def _masks(cut: DataFrame, window: int, group: int) -> DataFrame:
    """``c1, c2, mask`` of all distinct contexts, split by longer prefixes until every group fits."""
    steps = prefix_steps(window)
    distinct = cut.groupBy("c1", "c2", "gram", "n", "context").agg(F.count("*").alias("copies")).withColumn("first", F.lit(0).cast("long"))
    small, crowded = _split(distinct, cut.select("gram", "c1", "c2").distinct(), "gram", group)
    masks = _tree_masks(small, window)
    if crowded is None:
        return masks
    rows, _ = written(_suffixes(crowded, steps, window), "suffixes")
    parts = []
    for k in steps:
        small, rows = _split(rows, rows, f"p{k}", group)
        parts.append(_tree_masks(small, window))
        if rows is None:
            break
        rows, _ = written(rows, "crowded")
    if rows is not None:  # one node per window: its leaves are equal rows
        nodes = (rows.groupBy("context").agg(F.sum("copies").alias("times")).filter("times > 1")
                 .select("context", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")))
        parts.append(rows.withColumn("salt", F.pmod(F.xxhash64("c1", "first"), F.lit(SALTS)).cast("int")).join(nodes, ["context", "salt"])
                     .select("c1", "c2", F.expr("shiftleft(1L, CAST(first AS INT))").alias("mask")))
    bits = parts[0]
    for part in parts[1:]:
        bits = bits.unionByName(part)
    return masks.unionByName(bits.groupBy("c1", "c2").agg(F.bit_or("mask").alias("mask")))


# --- the whole job --------------------------------------------------------------------------

def _bitmap(keys: DataFrame, key: Column) -> DataFrame:
    """A bitmap of hashed keys: at most ``WORDS`` rows."""
    return (keys.select(key.alias("k")).groupBy(F.pmod("k", F.lit(WORDS)).alias("word"))
            .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), _bit("k"))).alias("bits")))


def _bit(key: str) -> Column:
    return F.pmod(F.shiftright(key, WORDS.bit_length()), F.lit(64)).cast("int")


def _maybe(df: DataFrame, key: Column, bitmap: DataFrame, how: bool = True) -> DataFrame:
    """Rows whose key may be in the bitmap (``how``), or surely is not."""
    joined = df.withColumn("__key", key).withColumn("__word", F.pmod("__key", F.lit(WORDS)))
    joined = joined.join(F.broadcast(bitmap.select(F.col("word").alias("__word"), F.col("bits").alias("__bits"))), "__word", "left")
    found = F.coalesce(F.call_function("shiftrightunsigned", F.col("__bits"), _bit("__key")).bitwiseAND(F.lit(1)) == 1, F.lit(False))
    return joined.filter(found if how else ~found).drop("__key", "__word", "__bits")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows are told apart by id and a hash of the text: rows equal in both have equal results."""
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, group: int = GROUP) -> DataFrame:
    """``doc_id, mark, windows``: for each document with repeated windows their first words.

    ``windows`` is an array of longs, first window times 2^30 plus a bit mask of the windows from there.
    """
    keyed = _keyed(docs, id_col, text_col)
    found = anchor_rows(keyed, window)
    common, _ = written(found.groupBy("gram").agg(F.count("*").alias("times")).filter("times > 1").select("gram"), "anchors")
    again = _maybe(found, F.col("gram"), _bitmap(common, F.col("gram"))).join(common, "gram")
    runs, _ = written(again.groupBy("doc_id", "mark").agg(F.collect_set(F.struct("gram", "run")).alias("runs")), "runs")
    key = F.xxhash64("doc_id", "mark")
    some = _maybe(keyed, key, _bitmap(runs, key))
    hit = some.join(runs.withColumnsRenamed({"doc_id": "d", "mark": "m"}), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("mark") == F.col("m")))
    cut, _ = written(contexts(hit, window), "contexts")
    masks = _masks(cut, window, group)
    packed = F.shiftleft(F.col("lo"), 30).bitwiseOR(F.col("mask"))
    return (cut.select("c1", "c2", "doc_id", "mark", "lo").join(masks, ["c1", "c2"])
            .groupBy("doc_id", "mark").agg(F.collect_set(packed).alias("windows")))


def covered(windows: np.ndarray, n_words: int, window: int = WINDOW) -> np.ndarray:
    """Which words of a document lie in a marked window."""
    lo, mask = windows >> 30, windows & (1 << 30) - 1
    i, b = np.nonzero(mask[:, None] >> np.arange(30) & 1)
    change = np.zeros(n_words + 1, np.int64)
    np.add.at(change, lo[i] + b, 1)
    np.add.at(change, lo[i] + b + window, -1)
    return np.cumsum(change[:-1]) > 0


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, group: int = GROUP,
                    with_text: bool = True) -> DataFrame:
    """Every row of ``docs`` with ``n_words``, ``n_removed``, ``kept_sha256`` and, on request, ``clean_text``.

    Windows are judged on the input.  ``kept_sha256`` is of the kept words joined by one blank;
    ``clean_text`` is the text without the removed words and the blanks after them, and the text itself
    where nothing goes.  Null texts have no words (``clean_text`` null).  Repeated rows are copies of one
    another, so both lose what they share, whatever their id, null included.  Very long texts are read in
    slices of whole documents and cut nowhere; an empty table gives no rows.  Other columns stay; one with a
    result's name gives way.
    """
    found, _ = written(repeated_windows(docs, id_col, text_col, window, group), "windows")
    added = [("n_words", "bigint"), ("n_removed", "bigint"), ("kept_sha256", "string")] + [("clean_text", "string")] * with_text
    src = docs.drop(*[n for n, _ in added if n not in (id_col, text_col)])

    def run(batches):
        for part, data, starts, ends, words in _each(batches, text_col):
            at = part.schema.get_field_index("__windows")
            windows = part.column(at) if at >= 0 else None
            nulls = part.column(part.schema.get_field_index(text_col)).is_null().to_numpy(zero_copy_only=False)
            text, ws, we = A.joined(data, starts, ends)
            text, total = text.tobytes(), np.diff(words)
            removed, sums, clean = np.zeros(len(total), np.int64), [], []
            raw = data.tobytes() if with_text else b""
            bounds = A.buffers(part.column(part.schema.get_field_index(text_col)))[1]
            for d, (a, b) in enumerate(zip(words[:-1].tolist(), words[1:].tolist())):
                gone = None
                if windows is not None and windows[d].is_valid and b > a:
                    gone = covered(np.array(windows[d].as_py(), np.int64), b - a, window)
                    removed[d] = gone.sum()
                if not removed[d]:
                    sums.append(hashlib.sha256(text[ws[a]:we[b - 1]] if b > a else b"").hexdigest())
                    if with_text:
                        clean.append(None if nulls[d] else raw[bounds[d]:bounds[d + 1]])
                    continue
                kept = a + np.flatnonzero(~gone)
                sums.append(hashlib.sha256(b" ".join(text[i:j] for i, j in zip(ws[kept].tolist(), we[kept].tolist()))).hexdigest())
                if not with_text:
                    continue
                # runs of kept words keep their own blanks; a run ends where the next removed word starts
                edge = np.flatnonzero(np.diff(np.concatenate([[True], gone, [True]]).astype(np.int8)))
                stop = np.append(starts[a:b], bounds[d + 1])
                clean.append(b"".join(raw[stop[i]:stop[j]] for i, j in zip(edge[::2].tolist(), edge[1::2].tolist())))
            out = [pa.array(total), pa.array(removed), pa.array(sums, pa.string())]
            yield part, out + [pa.array(clean, pa.binary()).cast(pa.string())] * with_text

    key = F.xxhash64("__id", "__mark")
    marked = src.withColumn("__id", F.col(id_col).cast("long")).withColumn("__mark", F.xxhash64(F.col(text_col).cast("string")))
    bitmap, _ = written(_bitmap(found, F.xxhash64("doc_id", "mark")), "bitmap")
    side = found.select(F.col("doc_id").alias("__d"), F.col("mark").alias("__m"), F.col("windows").alias("__windows"))
    some = (_maybe(marked, key, bitmap).join(side, F.col("__id").eqNullSafe(F.col("__d")) & (F.col("__mark") == F.col("__m")), "left")
            .drop("__d", "__m", "__id", "__mark"))
    rest = _maybe(marked, key, bitmap, False).drop("__id", "__mark")
    return carry(some, run, added, text_col).drop("__windows").unionByName(carry(rest, run, added, text_col))
