"""Packing of documents into token windows, best fit decreasing.

Each Arrow task tokenises its documents, cuts overlong ones into full windows first and packs the
rest of every document among the rests of its own partition: longest first, each into the tightest
open window, found in a segment tree indexed by remaining capacity.  Nothing is shuffled; a task holds
at most ``BUFFER_TOKENS`` of unpacked rests and packs them whenever they are full.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import arrow_text as A
from .bpe import encoder
from .scratch import id_text

WINDOW, END_ID = 1024, 0
#: Tokens of rests that a task packs at a time.
BUFFER_TOKENS = 1 << 23


class OpenWindows:
    """Open windows by remaining capacity; a segment tree tells which capacities have any."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.size)
        self.at: list[list[int]] = [[] for _ in range(capacity + 1)]

    def put(self, remaining: int, window: int) -> None:
        self.at[remaining].append(window)
        self._add(remaining, 1)

    def tightest(self, length: int) -> tuple[int, int] | None:
        """Take out the window with the least remaining capacity of at least ``length``."""
        i, tree = length + self.size, self.tree
        if not tree[i]:
            while i > 1 and (i & 1 or not tree[i + 1]):  # up, until something lies to the right
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if tree[2 * i] else 2 * i + 1
        remaining = i - self.size
        window = self.at[remaining].pop()
        self._add(remaining, -1)
        return remaining, window

    def _add(self, remaining: int, n: int) -> None:
        i = remaining + self.size
        while i:
            self.tree[i] += n
            i >>= 1


def best_fit(lengths: np.ndarray, capacity: int = WINDOW) -> tuple[np.ndarray, np.ndarray, int]:
    """Window and offset of every piece, and the number of windows; equal lengths go in input order."""
    window, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    open_, made = OpenWindows(capacity), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        found = open_.tightest(n)
        if found is None:
            found, made = (capacity, made), made + 1
        remaining, window[i] = found
        offset[i] = capacity - remaining
        if remaining > n:
            open_.put(remaining - n, int(window[i]))
    return window, offset, made


def pack(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text",
         with_ids: bool = True, buffer_tokens: int = BUFFER_TOKENS) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_length, ids``.

    A document is its ids and ``end_id`` (null text: ``end_id`` alone).  ``sequence_length`` is the padded
    length: ``window``, or the filled length where that is a power of two.  Repeated rows are documents of
    their own; other columns are ignored; an empty table gives no rows.
    """
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_length"] + ["ids"] * with_ids

    def rows(task, made, ids, at, doc, start, tokens, seq, offset):
        """Rows of pieces; ``ids[at[i]:at[i+1]]`` are the ids of piece i."""
        raw, length = ids.tobytes(), np.diff(at)
        crc = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
        fill = np.zeros(made, np.int64)
        np.add.at(fill, seq, length)
        padded = np.where(fill & (fill - 1) == 0, fill, window)[seq]
        out = [doc, pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(tokens), pa.array(seq + task), pa.array(offset), pa.array(padded)]
        if with_ids:
            out.append(pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32))))
        return pa.RecordBatch.from_arrays(out, names=names)

    def run(batches):
        from pyspark import TaskContext

        enc, next_seq = encoder(path), TaskContext.get().partitionId() << 33
        rests, held = [], 0
        for batch in batches:
            for part in A.slices(batch):
                ids, at = enc.encode(part.column(1))
                ids, at = np.insert(ids, at[1:], np.uint32(end_id)), at + np.arange(len(at))
                total = np.diff(at)
                full = total // window
                if full.sum():  # overlong documents: full windows first, each a sequence of its own
                    doc = np.repeat(np.arange(len(total)), full)
                    k = np.arange(len(doc)) - np.repeat(np.cumsum(full) - full, full)
                    cut, cut_at = A.ragged_take(ids, at[doc] + k * window, np.full(len(doc), window))
                    yield rows(next_seq, len(doc), cut, cut_at, part.column(0).take(pa.array(doc)), k * window, total[doc],
                               np.arange(len(doc)), np.zeros(len(doc), np.int64))
                    next_seq += len(doc)
                rest = np.flatnonzero(total % window)
                cut, cut_at = A.ragged_take(ids, at[rest] + full[rest] * window, total[rest] % window)
                rests.append((cut, np.diff(cut_at), part.column(0).take(pa.array(rest)), full[rest] * window, total[rest]))
                held += len(cut)
                if held >= buffer_tokens:
                    made, out = packed(rests, next_seq)
                    yield out
                    next_seq, rests, held = next_seq + made, [], 0
        if rests:
            yield packed(rests, next_seq)[1]

    def packed(rests, task):
        length = np.concatenate([r[1] for r in rests])
        seq, offset, made = best_fit(length, window)
        ids = np.concatenate([r[0] for r in rests])
        at = np.concatenate([[0], np.cumsum(length)])
        doc = pa.concat_arrays([r[2] for r in rests])
        return made, rows(task, made, ids, at, doc, np.concatenate([r[3] for r in rests]), np.concatenate([r[4] for r in rests]), seq, offset)

    schema = ", ".join(f"{n} long" for n in names[:8]) + ", ids array<int>" * with_ids
    return id_text(docs, id_col, text_col).mapInArrow(run, schema)
