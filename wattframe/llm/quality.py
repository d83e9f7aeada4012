"""Quality rules: boosted trees over document statistics.

One Arrow pass computes the statistics of whole texts with numpy.  A boosted-tree classifier is fitted
on a bounded sample of labelled documents (``sample_rows``, chosen by hash over all labels) with
monotonic constraints on chosen features, flattened into node arrays and applied to every row inside
the same pass that computes its statistics.  No text is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrow_text as A
from .scratch import carry

#: Bound on the labelled documents used to fit (everything else covers all rows).
SAMPLE_ROWS = 20_000
MIN_WORDS, MAX_REPEAT_PCT, WINDOW = 10, 20, 5

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["log_words", "word_length", "symbol_share", "dup_line_share", "repeat_share", "upper_share",
            "mark_share", "digit_share", "distinct_share", "line_words", "foreign_share", "short_word_share"]
#: Constraint per feature: with -1 the score never rises with the feature, 0 is free.
MONOTONE = {"symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "mark_share": -1}

SYMBOL = np.isin(np.arange(256), [ord(c) for c in "#*$%&|<>"])
UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)
DIGIT = (np.arange(256) >= 48) & (np.arange(256) <= 57)
MARK = np.isin(np.arange(256), [ord(c) for c in "!?"])
FOLLOWS = (np.arange(256) & 0xC0) == 0x80


def _rank(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1].astype(np.int64)


def repeated_window_words(codes: np.ndarray, words: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Per document the words inside windows that occur twice or more in that document (exact ranks)."""
    n = len(codes)
    if n < window:
        return np.zeros(len(words) - 1, np.int64)
    doc = A.segment_ids(words)
    rank, size = codes.copy(), 1
    while size < window:  # ranks of `size` words -> ranks of min(2 size, window) words
        step = min(size, window - size)
        m = len(rank) - step
        rank = _rank(rank[:m] * (int(rank.max()) + 1) + rank[step:step + m])
        size += step
    inside = doc[:len(rank)] == doc[window - 1:window - 1 + len(rank)]
    at = np.flatnonzero(inside)
    key = _rank(doc[at] * (int(rank.max()) + 1) + rank[at])
    twice = at[np.bincount(key)[key] > 1]
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + window, -1)
    return A.segment_sum((np.cumsum(cover[:-1]) > 0).astype(np.int64), words)


def _lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Repeated lines (with a word, equal to an earlier line) and lines with a word, per document."""
    docs = len(offsets) - 1
    if len(data) == 0:
        return np.zeros(docs, np.int64), np.zeros(docs, np.int64)
    cut = data == 0x0A
    stop = np.unique(np.concatenate([np.flatnonzero(cut), offsets[1:]]))
    # line i ends before stop[i]; it starts after the previous newline or at its document's start
    at = np.concatenate([[0], stop[:-1]])
    at = at + (cut[np.minimum(at, len(data) - 1)] & (at < len(data)) & (np.arange(len(at)) > 0))
    starts, ends = np.minimum(at, stop), stop
    filled = np.concatenate([[0], np.cumsum(~A.IS_SPACE[data])])
    keep = filled[ends] > filled[starts]
    starts, ends = starts[keep], ends[keep]
    doc = np.searchsorted(offsets, starts, side="right") - 1
    flat, off = A.ragged_take(data, starts, ends - starts)
    lines = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(off), pa.py_buffer(flat)])
    code = lines.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.bincount(doc, minlength=docs)
    distinct = np.bincount(np.unique(doc * (len(lines) + 1) + code) // (len(lines) + 1), minlength=docs)
    return total - distinct, total


def statistics(column: pa.Array) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The base counts and the feature matrix of every text of a column (null: empty)."""
    data, offsets = A.buffers(column)
    starts, ends, words = A.word_bounds(data, offsets)
    codes, _ = A.word_codes(data, starts, ends)
    n_words = np.diff(words)
    per = lambda table: A.segment_sum(table, offsets)
    word_chars = per(~A.IS_SPACE[data] & ~FOLLOWS[data])
    dup_lines, n_lines = _lines(data, offsets)
    counts = {"n_words": n_words, "word_chars": word_chars, "n_symbols": per(SYMBOL[data]), "n_dup_lines": dup_lines,
              "n_repeat_words": repeated_window_words(codes, words)}
    vocabulary = int(codes.max()) + 1 if len(codes) else 1
    distinct = np.bincount(np.unique(A.segment_ids(words) * vocabulary + codes) // vocabulary, minlength=len(n_words))
    short = A.segment_sum((ends - starts) <= 3, words)
    w, c = np.maximum(n_words, 1), np.maximum(word_chars, 1)
    x = np.column_stack([
        np.log1p(n_words), word_chars / w, counts["n_symbols"] / w, dup_lines / np.maximum(n_lines, 1),
        counts["n_repeat_words"] / w, per(UPPER[data]) / c, per(MARK[data]) / w, per(DIGIT[data]) / c, distinct / w,
        n_words / np.maximum(n_lines, 1), per(data >= 0xC0) / c, short / w])
    return counts, x


def base_failed(counts: dict[str, np.ndarray]) -> np.ndarray:
    n = counts["n_words"]
    return (n < MIN_WORDS) | (100 * counts["n_repeat_words"] > MAX_REPEAT_PCT * n)


# --- boosted trees --------------------------------------------------------------------------

@dataclass(frozen=True)
class Trees:
    """All trees flattened into node arrays; leaves point to themselves.

    Row i goes left at a node when ``x[i, feature] <= threshold``.
    """

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of good quality for each row; all rows step through a tree level at once."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            total += self.value[node]
        return 1 / (1 + np.exp(-total))


def fit_trees(x: np.ndarray, y: np.ndarray, monotone: np.ndarray, rounds: int = 60, depth: int = 4, rate: float = 0.15,
              bins: int = 64, l2: float = 1.0, min_rows: int = 20) -> Trees:
    """Logistic boosting on binned features with per-feature monotonic constraints.

    A split on a constrained feature is only allowed in the constrained order of its two leaf values,
    and the middle of the two bounds every value further down, so the whole score is monotonic.
    With no rows, or one class only, the result is a constant.
    """
    good = float(y.mean()) if len(y) else 1.0
    good = min(max(good, 1e-6), 1 - 1e-6)
    base = float(np.log(good / (1 - good)))
    node: dict[str, list] = {k: [] for k in ("feature", "threshold", "left", "right", "value")}
    roots: list[int] = []
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0) for f in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)]) if len(x) else x.astype(int)
    margin = np.full(len(y), base)

    def add(value: float) -> int:
        at = len(node["value"])
        for k, v in (("feature", 0), ("threshold", np.inf), ("left", at), ("right", at), ("value", value)):
            node[k].append(v)
        return at

    def grow(rows: np.ndarray, level: int, low: float, high: float) -> int:
        g, h = grad[rows], hess[rows]
        leaf = lambda a, b: np.clip(-a / (b + l2), low, high)
        at = add(rate * float(leaf(g.sum(), h.sum())))
        if level == depth or len(rows) < 2 * min_rows:
            return at
        best = (1e-6, None)
        gain = lambda a, b, w: -(a * w + 0.5 * (b + l2) * w * w)
        whole = gain(g.sum(), h.sum(), leaf(g.sum(), h.sum()))
        for f, c in enumerate(cuts):
            if not len(c):
                continue
            k = binned[rows, f]
            gl = np.cumsum(np.bincount(k, g, len(c) + 1))[:-1]
            hl = np.cumsum(np.bincount(k, h, len(c) + 1))[:-1]
            nl = np.cumsum(np.bincount(k, minlength=len(c) + 1))[:-1]
            wl, wr = leaf(gl, hl), leaf(g.sum() - gl, h.sum() - hl)
            won = gain(gl, hl, wl) + gain(g.sum() - gl, h.sum() - hl, wr) - whole
            fits = (nl >= min_rows) & (len(rows) - nl >= min_rows) & (monotone[f] * (wr - wl) >= 0)
            won = np.where(fits, won, -np.inf)
            i = int(won.argmax())
            if won[i] > best[0]:
                best = (float(won[i]), (f, i, float(wl[i]), float(wr[i])))
        if best[1] is None:
            return at
        f, i, wl, wr = best[1]
        mid = (wl + wr) / 2
        bound = {-1: ((mid, high), (low, mid)), 0: ((low, high), (low, high)), 1: ((low, mid), (mid, high))}[int(monotone[f])]
        goes = binned[rows, f] <= i
        node["feature"][at], node["threshold"][at] = f, float(cuts[f][i])
        node["left"][at] = grow(rows[goes], level + 1, *bound[0])
        node["right"][at] = grow(rows[~goes], level + 1, *bound[1])
        return at

    def model() -> Trees:
        kinds = {"feature": np.int64, "threshold": float, "left": np.int64, "right": np.int64, "value": float}
        return Trees(np.array(roots, np.int64), *(np.array(node[k], t) for k, t in kinds.items()), depth, base)

    if len(y) >= 2 * min_rows and 0 < y.sum() < len(y):
        every = np.arange(len(y))
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-margin))
            grad, hess = p - y, p * (1 - p)
            roots.append(grow(every, 0, -np.inf, np.inf))
            at = np.full(len(y), roots[-1])
            feature, threshold, left, right = (np.array(node[k]) for k in ("feature", "threshold", "left", "right"))
            for _ in range(depth):
                at = np.where(x[every, feature[at]] <= threshold[at], left[at], right[at])
            margin += np.array(node["value"])[at]
    return model()


def labelled_features(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id",
                      text_col: str = "text", label_col: str = "quality", label_id: str = "doc_id") -> tuple[np.ndarray, np.ndarray]:
    """Feature rows and labels of at most ``sample_rows`` labelled documents, chosen by hash of the id.

    Labels without id or value are ignored; several labels of one document count as the lowest.
    """
    chosen = (labels.select(F.col(label_id).cast("long").alias("id"), F.col(label_col).cast("int").alias("y"))
              .na.drop().groupBy("id").agg(F.min("y").alias("y"))
              .orderBy(F.xxhash64("id"), "id").limit(sample_rows))
    rows = (docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
            .join(F.broadcast(chosen), "id"))  # at most sample_rows ids

    def run(batches):
        for batch in batches:
            for part in A.slices(batch):
                x = statistics(part.column(1))[1]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(list(x), pa.list_(pa.float64()))], names=["id", "y", "x"])

    got = (rows.select("id", "text", "y").mapInArrow(run, "id long, y int, x array<double>")
           .orderBy("id", "x").limit(sample_rows).collect())
    return np.array([r["x"] for r in got]).reshape(-1, len(FEATURES)), np.array([min(max(r["y"], 0), 1) for r in got], float)


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, monotone: dict[str, int] = MONOTONE, **cols) -> Trees:
    """Fit the trees on the labelled documents of ``docs``."""
    x, y = labelled_features(docs, labels, sample_rows, **cols)
    return fit_trees(x, y, np.array([monotone.get(f, 0) for f in FEATURES]))


def score(docs: DataFrame, model: Trees, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Every row of ``docs`` with its counts, ``base_failed``, ``quality_score`` and ``kept``.

    Null and empty texts have no words and fail the base rules.  All other columns are kept; one that
    has the name of a result column gives way to it.  Repeated rows get the same verdict each.
    """
    added = [(c, "bigint") for c in COUNTS] + [("base_failed", "boolean"), ("quality_score", "double"), ("kept", "boolean")]

    def run(batches):
        for batch in batches:
            for part in A.slices(batch, text_col):
                counts, x = statistics(part.column(part.schema.get_field_index(text_col)))
                failed, p = base_failed(counts), model.score(x)
                yield part, [*(pa.array(counts[c].astype(np.int64)) for c in COUNTS), pa.array(failed), pa.array(p),
                             pa.array(~failed & (p >= threshold))]

    return carry(docs, run, added, text_col)
