"""Token files: static range asymmetric numeral coding (rANS) of token ids in document order.

Documents are range-partitioned by id and sorted; each task tokenises its range and writes segments
of whole documents.  A segment holds one frequency table shared by its blocks, a directory of
documents, and blocks of ``BLOCK`` tokens that decode independently: the directory of blocks is the
list of checkpoints (first token, place in the stream, number of tokens, CRC-32).  Inside a block
``LANES`` coders are interleaved; numpy steps all lanes of all blocks of a segment at once.  Segments
are rows of a Parquet table, so that Spark's commit protocol covers lost executors and retries.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import arrow_text as A
from .bpe import encoder
from .scratch import id_text

END_ID = 2
#: Tokens of a segment (closed at the next document end), of a block, and interleaved coders of a block.
SEGMENT, BLOCK, LANES = 1 << 21, 1 << 16, 64
MAGIC, LOW, SCALE = b"RANSTOK1", 31, 18
#: Ids below this are counted in a table instead of sorted.
SMALL = 1 << 22
#: Text tokenised at once and matches kept by a worker: larger ones find more matches merged already.
SLICE, MATCHES = 4 << 20, 500_000

U64 = np.uint64


def frequency_table(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int, np.ndarray]:
    """Distinct ids, their frequencies scaled to a power of two (1 at least), that power, and the place of every id
    among the distinct ones."""
    if len(ids) and ids.max() < SMALL:  # ids of a vocabulary: counted, not sorted
        seen = np.bincount(ids)
        symbols = np.flatnonzero(seen)
        count, place = seen[symbols], np.zeros(len(seen), np.int32)
        place[symbols] = np.arange(len(symbols))
        code = place[ids]
    else:
        symbols, code, count = np.unique(ids, return_inverse=True, return_counts=True)
    scale = max(SCALE, int(len(symbols)).bit_length() + 2)
    if not len(symbols):
        return symbols.astype(np.uint32), count.astype(np.uint32), scale, code
    whole = 1 << scale
    freq = 1 + count * (whole - len(symbols)) // len(ids)
    freq[np.argmax(freq)] += whole - int(freq.sum())
    return symbols.astype(np.uint32), freq.astype(np.uint32), scale, code


def _grid(n: int, block: int, lanes: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Tokens of each block, and for lane number l of all blocks how many tokens it codes."""
    blocks = -(-n // block)
    size = np.full(blocks, block, np.int64)
    if blocks:
        size[-1] = n - (blocks - 1) * block
    per_lane = (size[:, None] - np.arange(lanes) + lanes - 1) // lanes
    return size, per_lane.ravel(), int(per_lane.max()) if blocks else 0


def encode_segment(ids: np.ndarray, doc_ids: np.ndarray, has_id: np.ndarray, lengths: np.ndarray, block: int = BLOCK, lanes: int = LANES) -> bytes:
    """One segment in the file format."""
    ids = np.ascontiguousarray(ids, np.uint32)
    symbols, freq, scale, code = frequency_table(ids)
    start = np.concatenate([[0], np.cumsum(freq.astype(np.int64))])[:-1].astype(U64)
    size, per_lane, steps = _grid(len(ids), block, lanes)
    begin = np.repeat(np.arange(len(size)) * block, lanes) + np.tile(np.arange(lanes), len(size))
    order = np.argsort(-per_lane, kind="stable")  # the lanes still at work at a step come first
    active = np.searchsorted(-per_lane[order], -np.arange(steps))
    code = code[np.minimum(begin[order] + np.arange(steps)[:, None] * lanes, len(ids) - 1)] if steps else code
    state = np.full(len(begin), 1 << LOW, U64)
    words = np.zeros((steps, len(begin)), np.uint32)
    sent = np.zeros((steps, len(begin)), bool)
    f_all, rest = freq.astype(U64), U64(1 << scale) - freq.astype(U64)
    for t in range(steps - 1, -1, -1):  # the last symbol first, so that decoding runs forwards
        k = active[t]
        c, x = code[t, :k], state[:k]
        f = f_all[c]
        out = x >= f << U64(LOW - scale + 32)
        words[t, :k], sent[t, :k] = x, out  # the low half of the state
        x = np.where(out, x >> U64(32), x)
        state[:k] = x // f * rest[c] + x + start[c]
    if (per_lane[1:] > per_lane[:-1]).any():  # back to the order of blocks and lanes
        back = np.argsort(order)
        state, words, sent = state[back], words[:, back], sent[:, back]
    body, marks, at = [], [], 0
    raw = ids.tobytes()
    for b, n in enumerate(size.tolist()):
        mine = slice(b * lanes, (b + 1) * lanes)
        stream = words[:, mine][sent[:, mine]].astype("<u4").tobytes()
        body += [state[mine].astype("<u8").tobytes(), stream]
        marks.append((b * block, at, n, zlib.crc32(raw[4 * b * block:4 * (b * block + n)])))
        at += 8 * lanes + len(stream)
    table = zlib.compress(np.concatenate([np.diff(symbols, prepend=np.uint32(0)), freq]).astype("<u4").tobytes())
    docs = zlib.compress(doc_ids.astype("<i8").tobytes() + lengths.astype("<i8").tobytes() + np.packbits(has_id).tobytes())
    head = MAGIC + struct.pack("<9Q", len(doc_ids), len(ids), scale, lanes, block, len(symbols), len(table), len(docs), len(marks))
    return head + table + docs + b"".join(struct.pack("<4Q", *m) for m in marks) + b"".join(body)


def read_header(payload: bytes) -> dict:
    """Everything of a segment but the coded tokens: documents, table, checkpoints."""
    if payload[:8] != MAGIC:
        raise ValueError("not a token segment")
    n_docs, n, scale, lanes, block, n_sym, n_table, n_dir, n_blocks = struct.unpack_from("<9Q", payload, 8)
    at = 8 + 72
    table = np.frombuffer(zlib.decompress(payload[at:at + n_table]), "<u4")
    at += n_table
    directory = zlib.decompress(payload[at:at + n_dir])
    at += n_dir
    marks = np.frombuffer(payload, "<u8", 4 * n_blocks, at).reshape(-1, 4).astype(np.int64)
    return {"doc_ids": np.frombuffer(directory, "<i8", n_docs), "lengths": np.frombuffer(directory, "<i8", n_docs, 8 * n_docs),
            "has_id": np.unpackbits(np.frombuffer(directory, np.uint8, -1, 16 * n_docs), count=n_docs).astype(bool),
            "n_tokens": n, "scale": scale, "lanes": lanes, "block": block,
            "symbols": np.cumsum(table[:n_sym], dtype=np.uint32), "freq": table[n_sym:], "marks": marks, "body": at + 32 * n_blocks}


def decode_blocks(payload: bytes, head: dict, first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids of the blocks ``first`` to ``last`` (exclusive) of a segment; each block's checksum is compared."""
    marks, lanes = head["marks"][first:last], head["lanes"]
    if not len(marks):
        return np.zeros(0, np.uint32)
    scale, mask = U64(head["scale"]), U64((1 << head["scale"]) - 1)
    freq = head["freq"].astype(U64)
    start = np.concatenate([[0], np.cumsum(head["freq"], dtype=np.int64)])[:-1].astype(U64)
    slot = np.repeat(np.arange(len(freq), dtype=np.int32), head["freq"])
    n_blocks, size = len(marks), marks[:, 2]
    steps = -(-int(size.max()) // lanes)
    place = head["body"] + marks[:, 1]
    state = np.stack([np.frombuffer(payload, "<u8", lanes, p) for p in place.tolist()])
    stop = np.append(marks[1:, 1], (head["marks"][first + n_blocks, 1] if first + n_blocks < len(head["marks"]) else len(payload) - head["body"]))
    counts = (stop - marks[:, 1] - 8 * lanes) // 4
    words = np.concatenate([np.frombuffer(payload, "<u4", int(k), int(p) + 8 * lanes) for k, p in zip(counts, place)] + [np.zeros(1, np.uint32)])
    at = np.cumsum(counts) - counts
    out = np.zeros((steps, n_blocks, lanes), np.int32)
    for t in range(steps):
        m = int((size > t * lanes).sum())  # only the last block is shorter
        s = state[:m]
        low = s & mask
        c = slot[low.view(np.int64)]
        out[t, :m] = c
        x = freq[c] * (s >> scale) + low - start[c]
        left = size[:m] - t * lanes
        below = x < U64(1 << LOW)
        if left.min() < lanes:  # some coders are at their end
            on = np.arange(lanes) < left[:, None]
            x, below = np.where(on, x, s), below & on
        state[:m] = x
        need = np.flatnonzero(below)
        row = need // lanes
        count = np.bincount(row, minlength=m)
        take = words[np.arange(len(need)) + (at[:m] + count - np.cumsum(count))[row]]
        state.reshape(-1)[need] = (x.reshape(-1)[need] << U64(32)) | take
        at[:m] += count
    ids = np.concatenate([head["symbols"][out[:, b, :].ravel()[:n]] for b, n in enumerate(size.tolist())])
    if (state != U64(1 << LOW)).any():  # every coder must be back where the encoder began
        raise ValueError("a block of a token segment is damaged")
    raw, done = ids.tobytes(), 0
    for n, crc in marks[:, 2:].tolist():
        if zlib.crc32(raw[4 * done:4 * (done + n)]) != crc:
            raise ValueError("a block of a token segment is damaged")
        done += n
    return ids


def decode_documents(payload: bytes, first: int, last: int) -> np.ndarray:
    """Ids of the documents ``first`` to ``last`` (exclusive) of a segment, from the checkpoints around them only."""
    head = read_header(payload)
    at = np.concatenate([[0], np.cumsum(head["lengths"])])
    a, b = int(at[first]), int(at[last])
    if a == b:
        return np.zeros(0, np.uint32)
    one, two = a // head["block"], (b - 1) // head["block"] + 1
    return decode_blocks(payload, head, one, two)[a - one * head["block"]:b - one * head["block"]]


# --- Spark jobs -----------------------------------------------------------------------------

def write_tokens(docs: DataFrame, out: str, vocabulary: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text",
                 segment: int = SEGMENT, block: int = BLOCK, lanes: int = LANES) -> None:
    """Write the ids of every document, with ``end_id`` after each, in ascending order of ``id_col``.

    Null texts count as empty; null ids come first; rows with equal ids go in order of a hash of their text, so
    that many of them need not meet in one task.  Other columns are ignored.  An empty table gives an empty file table.
    """
    def run(batches):
        from pyspark import TaskContext

        enc, part_no = encoder(vocabulary, MATCHES), TaskContext.get().partitionId()
        held, tokens, before, number = [], 0, 0, 0

        def closed():
            ids = np.concatenate([h[0] for h in held])
            doc = pa.concat_arrays([h[1] for h in held])
            length = np.concatenate([h[2] for h in held])
            has = doc.is_valid().to_numpy(zero_copy_only=False)
            payload = encode_segment(ids, doc.fill_null(0).to_numpy(zero_copy_only=False), has, length, block, lanes)
            return pa.RecordBatch.from_pydict({"part": [part_no], "segment": [number], "before": [before], "n_docs": [len(doc)], "n_tokens": [len(ids)],
                                               "payload": pa.array([payload], pa.binary())})

        for batch in batches:
            for rows in A.slices(batch, limit=SLICE):
                ids, at = enc.encode(rows.column(1))
                held.append((np.insert(ids, at[1:], np.uint32(end_id)), rows.column(0), np.diff(at) + 1))
                tokens += len(held[-1][0])
                if tokens >= segment:
                    yield closed()
                    before, number, held, tokens = before + tokens, number + 1, [], 0
        if held:
            yield closed()

    order = [F.col("doc_id").asc_nulls_first(), F.col("mark")]  # the hash splits a hot id into ranges of its own
    (id_text(docs, id_col, text_col).withColumn("mark", F.xxhash64("text"))
     .repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
     .mapInArrow(run, "part long, segment long, before long, n_docs long, n_tokens long, payload binary")
     .write.option("compression", "uncompressed").parquet(out))


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` and, on request, ``ids`` of every document in the files."""
    files = spark.read.schema("part long, segment long, before long, n_docs long, n_tokens long, payload binary").parquet(path)
    # one row per part: a bounded number, whatever the number of documents
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    ahead = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("ahead"))

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                payload = batch.column(2)[i].as_py()
                head = read_header(payload)
                ids = decode_blocks(payload, head)
                at = np.concatenate([[0], np.cumsum(head["lengths"])])
                raw = ids.astype("<u4").tobytes()
                crc = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                n = len(head["doc_ids"])
                out = [pa.array(np.full(n, batch.column(0)[i].as_py())), pa.array(head["doc_ids"], mask=~head["has_id"]),
                       pa.array(at[:-1] + batch.column(1)[i].as_py()), pa.array(head["lengths"]), pa.array(crc, pa.int64())]
                if with_ids:
                    out.append(pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(out, names=["part", "doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)

    rows = files.select("part", "before", "payload").mapInArrow(
        run, "part long, doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)
    rows = rows.join(F.broadcast(ahead), "part")  # one row per part
    return rows.select("doc_id", (F.col("start") + F.col("ahead")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)
