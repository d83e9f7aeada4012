"""Byte-level BPE encoding and decoding over Arrow batches.

Texts of ASCII and Latin letters are split into the matches of the pattern with numpy, whole slices at a
time; other texts are cut at blanks that follow a non-blank character, which no match crosses, and split
by the library.  Distinct matches have their bytes mapped to characters and are merged by the tokenizers
library once (a bounded cache keeps those seen before); ids of whole documents are put together with
numpy.  Decoding looks the ids up in a byte table made by reversing the byte-to-character map of the
vocabulary; characters that tokens split come together again because whole documents are joined as bytes
before any of them is read as UTF-8.
"""

from __future__ import annotations

import base64
import hashlib
import os
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import arrow_text as A
from .scratch import carry

#: Matches whose ids a Python worker keeps (twice this many at most); others are merged again, with the same result.
CACHE = 250_000

#: Fixed value: the pattern that splits text before merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


# Kinds of bytes: letters (of two-byte characters C3 to C9 lead and any may follow), digits, other printable
# ASCII, blank and other white space; 0 for all that is left to the tokenizers library.
_LETTER, _DIGIT, _OTHER, _BLANK, _WHITE = 1, 2, 3, 4, 5
_KIND = np.zeros(256, np.uint8)
_KIND[0x21:0x7F] = _OTHER
_KIND[[*range(65, 91), *range(97, 123), *range(0xC3, 0xCA), *range(0x80, 0xC0)]] = _LETTER
_KIND[48:58] = _DIGIT
_KIND[0x20], _KIND[[0x09, 0x0A, 0x0D]] = _BLANK, _WHITE


def byte_chars() -> list[str]:
    """The character that stands for each byte: printable ones for themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


_CHARS = np.array([ord(c) for c in byte_chars()], "<u4")


def tokenizer_from_ranks(path: str, pattern: str = PATTERN):
    """A tokenizers BPE that merges by the ranks of a rank file.

    The merge that makes a token is what the lower ranks leave of its bytes: two parts.
    """
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    chars = byte_chars()
    named = {token: "".join(chars[b] for b in token) for token in ranks}
    merges = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        if len(token) > 1:
            parts = [token[i:i + 1] for i in range(len(token))]
            while len(parts) > 2:
                best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], rank))
                if ranks.get(parts[best] + parts[best + 1], rank) >= rank:
                    break
                parts[best:best + 2] = [parts[best] + parts[best + 1]]
            if len(parts) == 2:
                merges.append((named[parts[0]], named[parts[1]]))
    tok = Tokenizer(models.BPE(vocab={named[t]: r for t, r in ranks.items()}, merges=merges))
    tok.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"),
                                                 pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return tok


class Encoder:
    """Encodes text columns with one vocabulary file (``.json`` of the tokenizers library, or ranks)."""

    def __init__(self, path: str, cache: int | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        if path.endswith(".json"):
            self.tok = Tokenizer.from_file(path)
        else:
            self.tok = tokenizer_from_ranks(path)
        self.tok.encode_special_tokens = True  # their strings in a text are ordinary text
        self.merge = Tokenizer(self.tok.model)  # merges alone: what it gets is split and mapped to characters already
        self.cache = cache or CACHE
        self.seen: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        back = {c: b for b, c in enumerate(byte_chars())}
        vocab = self.tok.get_vocab()
        tokens = [b""] * (max(vocab.values(), default=-1) + 1)
        for name, i in vocab.items():
            tokens[i] = bytes(back[c] for c in name) if all(c in back for c in name) else name.encode()
        self.token_bytes, self.token_at = _table(tokens)
        self.decimal, self.decimal_at = _table([b"%d " % i for i in range(len(tokens))])

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and where each document starts in them (null: empty)."""
        data, offsets = A.buffers(column)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        kinds = _KIND[data]
        odd = kinds == 0
        odd[1:] |= (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))
        settled = A.segment_sum(odd, offsets) == 0
        start = _match_starts(data, kinds, offsets)
        if not settled.all():
            other = np.repeat(~settled, np.diff(offsets))
            start[:-1] = np.where(other, _safe_starts(data, offsets)[:-1], start[:-1])
        cut = np.flatnonzero(start)
        kind, width = (pa.binary(), np.int32) if len(data) < 2**31 - 1 else (pa.large_binary(), np.int64)
        pieces = pa.Array.from_buffers(kind, len(cut) - 1, [None, pa.py_buffer(cut.astype(width)), pa.py_buffer(np.ascontiguousarray(data))])
        coded = pieces.dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        unsplit = np.zeros(len(coded.dictionary), bool)
        if not settled.all():
            unsplit[code[other[cut[:-1]]]] = True
        ids, at = self._distinct(coded.dictionary.to_numpy(zero_copy_only=False).tolist(), unsplit)
        out, ends = A.ragged_take(ids, at[code], at[code + 1] - at[code])
        return out, ends[np.searchsorted(cut, offsets)]

    def _distinct(self, pieces: list[bytes], unsplit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pieces: matches of the pattern, or (``unsplit``) texts the library has yet to split."""
        found = list(map(self.seen.get, pieces))
        new = [i for i, x in enumerate(found) if x is None]
        whole = np.flatnonzero(unsplit).tolist()
        if new:
            if len(self.seen) + len(new) > self.cache:  # forget what was not needed for a while
                self.old, self.seen = self.seen, {}
            seen, old, ask = self.seen, self.old, []
            for i in new:
                found[i] = known = old.get(pieces[i])
                if known is None:
                    ask.append(i)
                else:
                    seen[pieces[i]] = known
            ask = [i for i in ask if not unsplit[i]] if whole else ask
            asked = [pieces[i] for i in ask]
            text = _CHARS[np.frombuffer(b"".join(asked), np.uint8)].tobytes().decode("utf-32-le")  # a character a byte
            ends = np.cumsum(np.fromiter(map(len, asked), np.int64, len(asked))).tolist()
            chars = [text[a:b] for a, b in zip([0, *ends], ends)]
            for i, e in zip(ask, self.merge.encode_batch_fast(chars, add_special_tokens=False)):
                found[i] = seen[pieces[i]] = array("I", e.ids).tobytes()
        for i, e in zip(whole, self.tok.encode_batch_fast([pieces[i].decode() for i in whole], add_special_tokens=False)):
            found[i] = array("I", e.ids).tobytes()
        at = np.zeros(len(found) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) >> 2, out=at[1:])
        return np.frombuffer(b"".join(found), np.uint32), at

    def decode(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all documents and their offsets."""
        size = np.diff(self.token_at)[ids]
        data, ends = A.ragged_take(self.token_bytes, self.token_at[ids], size)
        return data, ends[at]

    def spans(self, ids: np.ndarray, at: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last-exclusive character of every token in its document (a split character counts for each part)."""
        ends = np.cumsum(np.diff(self.token_at)[ids])
        begins = ends - np.diff(self.token_at)[ids]
        first = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # characters begun before a byte
        doc = np.concatenate([[0], ends])[at[:-1]]
        base = np.repeat(first[doc], np.diff(at))
        inside = (data[np.minimum(begins, max(len(data) - 1, 0))] & 0xC0) == 0x80
        return first[begins] - inside - base, first[ends] - base

    def decimal_sha256(self, ids: np.ndarray, at: np.ndarray) -> list[str]:
        """SHA-256 of each document's decimal ids joined by one blank."""
        size = np.diff(self.decimal_at)[ids]
        text, ends = A.ragged_take(self.decimal, self.decimal_at[ids], size)
        text, ends = text.tobytes(), ends[at]
        return [hashlib.sha256(text[a:max(b - 1, a)]).hexdigest() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]


def _table(items: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    at = np.zeros(len(items) + 1, np.int64)
    np.cumsum([len(x) for x in items], out=at[1:])
    return np.frombuffer(b"".join(items), np.uint8), at


def _safe_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Document starts, and blanks after a character that surely is no white space: no match crosses these."""
    n = len(data)
    solid = data > 0x20
    high = np.flatnonzero(data >= 0x80)
    if len(high):  # the last bytes of a white-space character beyond ASCII: C2 85, C2 A0, E1 9A xx, E2 80 xx, E2 81 xx, E3 80 xx
        one, two = data[np.maximum(high - 1, 0)], data[np.maximum(high - 2, 0)]
        blank = (one == 0xC2) | ((two >= 0xE1) & (two <= 0xE3) & np.isin(one, [0x80, 0x81, 0x9A]))
        solid[high[blank]] = False
    mark = np.zeros(n + 1, bool)
    mark[1:n] = (data[1:] == 0x20) & solid[:-1]
    mark[offsets] = True
    mark[n] = True
    return mark


def _match_starts(data: np.ndarray, kinds: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the matches of ``PATTERN`` start, for documents of settled characters; the end counts as a start.

    A match is a run of one kind, with the single blank before it; of a longer run of white space all but
    the last character are a match, and the last one too unless it is a blank that joins what follows.
    An apostrophe that starts a match takes s, t, m, d, re, ve or ll with it.
    """
    n = len(data)
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    first[n] = True
    space = kinds >= _BLANK
    start = first.copy()
    before, now = kinds[:-1], kinds[1:]
    last = np.zeros(n, bool)  # white space right before something else in the same document
    last[:-1] = space[:-1] & ~space[1:] & ~first[1:n]
    start[1:n] |= np.where(space[1:], ~space[:-1] | last[1:], (before != now) & (before != _BLANK))
    quote = np.flatnonzero((data == 0x27) & start[:n])
    if len(quote):
        padded = np.concatenate([data, np.zeros(2, np.uint8)])
        inside = np.concatenate([~first[1:], np.zeros(2, bool)])  # whether byte i + 1 belongs to the document of byte i
        one, two = padded[quote + 1], padded[quote + 2]
        short = inside[quote] & np.isin(one, list(b"stmd"))
        pair = (np.isin(one, list(b"rv")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        long = inside[quote] & inside[quote + 1] & pair
        start[quote[short | long] + 1] = False
        start[quote[short] + 2] = True
        start[quote[long] + 3] = True
    return start


@lru_cache(maxsize=4)
def encoder(path: str, cache: int | None = None) -> Encoder:
    """One encoder for each vocabulary (and size of its cache) in a Python worker."""
    return Encoder(path, cache)


def encode_decode(docs: DataFrame, path: str, text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Every row with its ids, their character spans, the decoded text, and digests of ids and text.

    Adds ``n_tokens, ids_sha256, decoded_sha256`` and, with ``with_ids``, ``ids, starts, ends, decoded``.
    Null texts count as empty: no ids, digests of the empty string.  Other columns stay; one that has the
    name of a result gives way to it.  Repeated rows have equal results.
    """
    added = [("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")]
    added += [("ids", "array<int>"), ("starts", "array<bigint>"), ("ends", "array<bigint>"), ("decoded", "string")] * with_ids
    lists = lambda values, at: pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values))

    def run(batches):
        enc = encoder(path)
        for batch in batches:
            for part in A.slices(batch, text_col):
                ids, at = enc.encode(part.column(part.schema.get_field_index(text_col)))
                data, ends = enc.decode(ids, at)
                raw, cut = data.tobytes(), ends.tolist()
                out = [pa.array(np.diff(at)), pa.array(enc.decimal_sha256(ids, at), pa.string()),
                       pa.array([hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(cut, cut[1:])], pa.string())]
                if with_ids:
                    first, last = enc.spans(ids, at, data)
                    texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(cut, cut[1:])]
                    out += [lists(ids.astype(np.int32), at), lists(first, at), lists(last, at), pa.array(texts, pa.string())]
                yield part, out

    return carry(docs, run, added, text_col)
