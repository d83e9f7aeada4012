"""Periodic runs of words by seed and extend along diagonals.

A run of period q and length >= max(12, 2q) matches itself, q words on, in a stretch of at least
max(12 - q, q) words.  So every run holds a pair of equal k-grams at distance q, with k = 6 for
periods up to 11 and k = 12, 24, 48, ... for periods in [k, 2k).

1. Per level, k-grams that occur twice in a document are indexed by hash.  A gram of the next level
   is two of this one, so only positions that still repeat go on; plain text is done after one level.
2. Occurrences of a gram at most k/2 apart form a chain (they overlap, so the text there has their
   distance as period).  Seeds are pairs of occurrences at a distance of the level: the chain's own
   period where it is one, and between two chains each distance once.  A chain has few others in
   reach, so seeds grow with the words, not with the square of a gram's occurrences.
3. Per lag, a table of the furthest word covered suppresses extensions of seeds in a stretch that is
   known.  Other seeds are extended both ways on exact word codes.  Of equal stretches the smallest lag
   is the period.

Documents never meet, so nothing is shuffled; a task holds one slice of text, or one longer document.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import arrow_text as A
from .scratch import carry

#: Shortest run, and words of the grams of the first level: the least overlap of a run with itself.
LEAST, FIRST = 12, 6

U64 = np.uint64


def _chains(pos: np.ndarray, gram: np.ndarray, k: int):
    """Chains of occurrences sorted by (gram, position): first, last, step (0: one occurrence), gram."""
    new = np.ones(len(pos), bool)
    new[1:] = (gram[1:] != gram[:-1]) | (pos[1:] - pos[:-1] > k // 2)
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(pos)) - 1
    step = np.where(tail > head, pos[np.minimum(head + 1, len(pos) - 1)] - pos[head], 0)
    return pos[head], pos[tail], step, gram[head]


def _pairs(first, last, step, gram, low: int, high: int):
    """Seeds of one level: positions and lags in [low, high)."""
    own = (step >= low) & (step < high)
    at, lag = [first[own]], [step[own]]
    t = 1
    while t < len(first):
        a, b = np.arange(len(first) - t), np.arange(t, len(first))
        near = (gram[a] == gram[b]) & (first[b] - last[a] < high)
        if not near.any():
            break
        a, b = a[near], b[near]
        p = np.maximum(step[a], step[b])
        one = np.maximum(p, 1)
        back, ahead = (last[a] - first[a]) // one, (last[b] - first[b]) // one
        apart = first[b] - first[a]  # lags: apart + e * p, e from -back to ahead
        e0 = np.maximum(-back, -((apart - low) // one))
        e1 = np.minimum(ahead, (high - 1 - apart) // one)
        count = np.maximum(e1 - e0 + 1, 0)
        row = np.repeat(np.arange(len(a)), count)
        e = e0[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        at.append(first[a][row] + np.maximum(-e, 0) * p[row])
        lag.append(apart[row] + e * p[row])
        t += 1
    return np.concatenate(at), np.concatenate(lag)


def seeds(codes: np.ndarray, words: np.ndarray, least: int = LEAST):
    """Pairs of equal grams: position and lag, over all documents of a slice (``words``: their offsets)."""
    doc = A.segment_ids(words)
    k = FIRST if least == LEAST else max(least // 2, 1)
    none = np.zeros(0, np.int64)
    if len(codes) < k:
        return none, none
    value = A.mix(codes.astype(U64) + U64(1), doc.astype(U64) + U64(1))
    size, hashed = 1, value
    while size < k:
        more = min(size, k - size)
        m = len(hashed) - more
        hashed = A.mix(hashed[:m], hashed[more:more + m])
        size += more
    pos = np.flatnonzero(doc[:len(hashed)] == doc[k - 1:k - 1 + len(hashed)])
    gram = hashed[pos]
    at, lag, low = [none], [none], 1
    while len(pos):
        order = np.argsort(gram, kind="stable")
        pos, gram = pos[order], gram[order]
        twice = np.zeros(len(pos), bool)
        twice[1:] = gram[1:] == gram[:-1]
        twice[:-1] |= twice[1:]
        pos, gram = pos[twice], gram[twice]
        if not len(pos):
            break
        high = max(2 * k, low + 1)
        x, d = _pairs(*_chains(pos, gram, k), low, high)
        at.append(x)
        lag.append(d)
        # two grams side by side make one of the next level
        order = np.argsort(pos)
        pos, gram = pos[order], gram[order]
        to = np.searchsorted(pos, pos + k)
        both = np.flatnonzero((to < len(pos)) & (pos[np.minimum(to, len(pos) - 1)] == pos + k))
        both = both[doc[pos[both]] == doc[np.minimum(pos[both] + 2 * k - 1, len(doc) - 1)]]
        gram = A.mix(gram[both], gram[to[both]])
        pos = pos[both]
        low, k = high, 2 * k
    return np.concatenate(at), np.concatenate(lag)


def _reach(codes: np.ndarray, i: int, lag: int, stop: int) -> int:
    """The first place from i where the words ``lag`` apart differ, or ``stop``."""
    block = 32
    while i < stop:
        to = min(i + block, stop)
        differ = codes[i:to] != codes[i + lag:to + lag]
        if differ.any():
            return i + int(differ.argmax())
        i, block = to, block * 4
    return stop


def _back(codes: np.ndarray, i: int, lag: int, stop: int) -> int:
    """The first place of the stretch of equal words ``lag`` apart that holds i."""
    block = 32
    while i > stop:
        to = max(i - block, stop)
        differ = codes[to:i] != codes[to + lag:i + lag]
        if differ.any():
            return i - int(differ[::-1].argmax())
        i, block = to, block * 4
    return stop


def runs(codes: np.ndarray, words: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All runs of a slice by start, then period: first word (in the slice), length, period."""
    at, lag = seeds(codes, words, least)
    none = np.zeros(0, np.int64)
    if not len(at):
        return none, none, none
    doc = np.searchsorted(words, at, side="right") - 1
    order = np.lexsort((at, lag, doc))
    at, lag, doc = at[order], lag[order], doc[order]
    # neighbours of one document and lag whose grams touch lie in one stretch
    gram = np.where(lag < 2 * FIRST, FIRST, FIRST << np.maximum(np.floor(np.log2(np.maximum(lag, 1) / FIRST)).astype(np.int64), 0))
    fresh = np.ones(len(at), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (lag[1:] != lag[:-1]) | (at[1:] > at[:-1] + (gram[:-1] if least == LEAST else 0))
    out, covered, here = [], {}, -1
    bounds = words.tolist()
    for i, d, w in zip(at[fresh].tolist(), lag[fresh].tolist(), doc[fresh].tolist()):
        if w != here:
            covered, here = {}, w
        if i < covered.get(d, 0):
            continue
        end = _reach(codes, i, d, bounds[w + 1] - d)
        start = _back(codes, i, d, bounds[w])
        covered[d] = max(end, i + 1)
        if end - start + d >= max(least, 2 * d):
            out.append((start, end - start + d, d))
    if not out:
        return none, none, none
    start, length, period = np.array(out, np.int64).T
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    smallest = np.ones(len(start), bool)
    smallest[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, period = start[smallest], length[smallest], period[smallest]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


ADDED = [("n_runs", "bigint"), ("start", "bigint"), ("length", "bigint"), ("period", "bigint"), ("exponent_milli", "bigint"),
         ("runs_sha256", "string"), ("collapsed_sha256", "string")]


def periodic_runs(docs: DataFrame, text_col: str = "text", least: int = LEAST, with_runs: bool = True, with_text: bool = True) -> DataFrame:
    """Every row of ``docs`` with its runs and what is left when each keeps one period.

    Adds ``n_runs``; ``start, length, period, exponent_milli`` of the longest run (ties: smallest start, then
    period; null without a run); ``runs_sha256`` and ``collapsed_sha256``; on request ``runs`` (array of start,
    length, period by start, then period) and ``collapsed_text`` (kept words joined by one blank).  A word goes
    when a run holds it after that run's first period.  Null texts have no words and no runs (``collapsed_text``
    null); empty ones neither; a text of any length is treated whole; repeated rows have equal results; ids are
    not looked at; other columns stay, one with a result's name gives way; an empty table gives no rows.
    """
    added = ADDED + [("runs", "array<struct<start: bigint, length: bigint, period: bigint>>")] * with_runs + [("collapsed_text", "string")] * with_text

    def run(batches):
        for batch in batches:
            for part in A.slices(batch, text_col):
                column = part.column(part.schema.get_field_index(text_col))
                data, offsets = A.buffers(column)
                starts, ends, words = A.word_bounds(data, offsets)
                codes, _ = A.word_codes(data, starts, ends)
                s, n, p = runs(codes, words, least)
                owner = np.searchsorted(words, s, side="right") - 1
                change = np.zeros(len(starts) + 1, np.int64)
                np.add.at(change, s + p, 1)
                np.add.at(change, s + n, -1)
                keep = np.cumsum(change[:-1]) == 0
                text, ws, we = A.joined(data, starts, ends)
                raw, s = text.tobytes(), s - words[owner]
                at = np.searchsorted(owner, np.arange(part.num_rows + 1))
                rows, sums, kept, left = [], [], [], []
                for d, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
                    lo, hi = int(words[d]), int(words[d + 1])
                    if a == b:
                        rows.append((0, None, None, None, None))
                        plain = raw[ws[lo]:we[hi - 1]] if hi > lo else b""
                    else:
                        best = min(range(a, b), key=lambda i: (-n[i], s[i], p[i]))
                        rows.append((b - a, s[best], n[best], p[best], 1000 * n[best] // p[best]))
                        stay = lo + np.flatnonzero(keep[lo:hi])
                        plain = b" ".join([raw[i:j] for i, j in zip(ws[stay].tolist(), we[stay].tolist())])
                    sums.append(hashlib.sha256("".join(f"{x},{y},{z}\n" for x, y, z in zip(s[a:b].tolist(), n[a:b].tolist(), p[a:b].tolist())).encode()).hexdigest())
                    kept.append(hashlib.sha256(plain).hexdigest())
                    if with_text:
                        left.append(plain if column[d].is_valid else None)
                out = [pa.array(c, pa.int64()) for c in zip(*rows)] + [pa.array(sums, pa.string()), pa.array(kept, pa.string())]
                if with_runs:
                    items = pa.StructArray.from_arrays([pa.array(s), pa.array(n), pa.array(p)], names=["start", "length", "period"])
                    out.append(pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), items))
                yield part, out + [pa.array(left, pa.binary()).cast(pa.string())] * with_text

    return carry(docs, run, added, text_col)


def echoed(doc_id: Column, text: Column) -> Column:
    """The text whose end repeats, for a tenth of the ids: with h = crc32(id) a multiple of 10, g = h div 10 and n
    words, word i >= a becomes word a + (i - a) % p, a = g % n, p = 1 + (n - a) div (3 + g % 8).  Null ids and
    texts stay."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)
    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")

    def again(s):
        p = (F.lit(1) + F.floor((s["n"] - s["a"]) / (F.lit(3) + s["g"] % 8))).cast("int")
        return F.transform(s["w"], lambda w, i: F.when(i < s["a"], w).otherwise(F.get(s["w"], (s["a"] + (i - s["a"]) % p).cast("int"))))

    def first(s):
        return F.transform(F.array(F.struct(s["w"].alias("w"), F.size(s["w"]).alias("n"), s["g"].alias("g"), (s["g"] % F.size(s["w"])).cast("int").alias("a"))), again)[0]

    new = F.transform(F.array(F.struct(words.alias("w"), g.alias("g"))), lambda s: F.when(F.size(s["w"]) > 0, F.array_join(first(s), " ")))[0]
    return F.when((h % 10 == 0) & new.isNotNull(), new).otherwise(text)
