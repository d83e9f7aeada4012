"""Language identification: interpolated Kneser-Ney character models, one per language.

1. The alphabet: every letter of the learning rows is told apart, everything else is a word boundary.  A
   letter is one symbol; should there be more letters than symbols, the rarest are two symbols each.  Only
   letters of no learning row share a symbol, which no model has seen.  An n-gram packs into 64 bits.
2. Arrow tasks count packed n-grams of whole texts, Spark sums them by language; all learning rows count.
3. A task per language turns the summed counts into a Kneser-Ney model kept as sorted arrays of n-gram
   hashes with interpolated log probabilities and back-off weights, found by binary search.
4. Rejection is calibrated on a fold of the learning rows with models that have not seen it.
5. Every text gets the language with the lowest cross-entropy per symbol.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrow_text as A
from .scratch import carry, written

#: Bits of a symbol and symbols of an n-gram.
BITS, ORDER = 16, 4
LETTERS = (1 << BITS) - 2
#: First and second halves of letters that are two symbols: code points after the last, and how many of each.
HALF, HALVES = 0x110000, 512
#: N-gram counts a counting task holds before it hands them on.
HELD = 1 << 21
#: Share of a language's calibration rows below its rejection threshold.
ACCEPT = 0.995
COLUMNS = 8

U64 = np.uint64


@lru_cache(maxsize=1)
def _lower_letters() -> np.ndarray:
    """For every code point its lower-case letter, 0 where it is not a letter."""
    out = np.zeros(0x110000, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def letters(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letters (0: no letter) of all texts one after the other, and document offsets."""
    data, offsets = A.buffers(column)
    text = data.tobytes().decode("utf-8", "replace")
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    ends = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    return _lower_letters()[points], ends


def split_letters(ranked: np.ndarray, places: int = LETTERS) -> tuple[np.ndarray, np.ndarray]:
    """The alphabet (sorted) of letters, most frequent first, and its letters that are two symbols (sorted)."""
    if len(ranked) <= places:
        return np.sort(ranked).astype(np.uint32), np.zeros(0, np.uint32)
    single = places - 2 * HALVES
    halves = np.arange(HALF, HALF + 2 * HALVES)
    return np.sort(np.concatenate([ranked[:single], halves])).astype(np.uint32), np.sort(ranked[single:]).astype(np.uint32)


def _halved(low: np.ndarray, ends: np.ndarray, rare: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``low`` and ``ends`` with each letter in ``rare`` replaced by its two halves."""
    at = np.searchsorted(rare, low)
    two = rare[np.minimum(at, len(rare) - 1)] == low
    start = np.concatenate([[0], np.cumsum(two + 1)])
    out = np.repeat(low, two + 1)
    out[start[:-1][two]] = HALF + at[two] // HALVES
    out[start[:-1][two] + 1] = HALF + HALVES + at[two] % HALVES
    return out, start[ends]


def packed(low: np.ndarray, ends: np.ndarray, alphabet: np.ndarray, rare: np.ndarray = np.zeros(0, np.uint32)) -> tuple[np.ndarray, np.ndarray]:
    """Packed n-grams that end at each symbol, and document offsets; a run of non-letters is one boundary.

    Every document starts after boundaries and ends in one, so it has at least one n-gram.
    """
    if len(rare):
        low, ends = _halved(low, ends, rare)
    symbol = np.zeros(len(low), U64)
    some = low > 0
    at = np.searchsorted(alphabet, low[some])
    known = (at < len(alphabet)) & (alphabet[np.minimum(at, max(len(alphabet) - 1, 0))] == low[some]) if len(alphabet) else np.zeros(len(at), bool)
    symbol[some] = np.where(known, at + 1, LETTERS + 1)
    before = np.concatenate([np.zeros(1, U64), symbol[:-1]])
    before[ends[:-1][ends[:-1] < len(symbol)]] = 0
    keep = (symbol > 0) | (before > 0)
    count = np.concatenate([[0], np.cumsum(keep)])[ends]
    symbol = symbol[keep]
    # ORDER - 1 boundaries before each document, one after it where its last symbol is a letter
    docs = len(ends) - 1
    size = np.diff(count)
    last = np.where(size > 0, symbol[np.maximum(count[1:] - 1, 0)] if len(symbol) else 0, 1)
    size_out = size + (last > 0)
    start = np.concatenate([[0], np.cumsum(size_out + ORDER - 1)])
    flat = np.zeros(start[-1], U64)
    flat[np.arange(len(symbol)) + np.repeat(start[:-1] + ORDER - 1 - count[:-1], size)] = symbol
    code = np.zeros(len(flat), U64)
    for k in range(ORDER):
        code[k:] |= flat[:len(flat) - k] << U64(BITS * k)
    own = np.ones(len(flat), bool)
    own[(start[:-1][:, None] + np.arange(ORDER - 1)).ravel()] = False
    return code[own], np.concatenate([[0], np.cumsum(size_out)]) if docs else np.zeros(1, np.int64)


# --- models ---------------------------------------------------------------------------------

#: An odd factor and a shift for each order.
SALT = [(U64(f), U64(a)) for f, a in ((0xD6E8FEB86659FD93, 0x8EBC6AF09C88C6E3), (0xA0761D6478BD642F, 0x589965CC75374CC3),
                                      (0xE7037ED1A0B428DB, 0x1D8E4E27C47D124F), (0xEB44ACCAB455D165, 0x2127599BF4325C37),
                                      (0x9FB21C651E98DF25, 0x880355F21E6D1965))]


def _hash(order: int, key: np.ndarray) -> np.ndarray:
    """A 64-bit hash of packed n-grams, one to one for each order."""
    factor, shift = SALT[order]
    x = (key.astype(U64) + shift) * factor
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


@dataclass(frozen=True)
class Kneser:
    """One language: sorted hashes of n-grams of all orders, their log2 probability, and of contexts their log2 weight."""

    grams: np.ndarray
    log_p: np.ndarray
    contexts: np.ndarray
    log_w: np.ndarray

    def log_prob(self, code: np.ndarray) -> np.ndarray:
        """log2 probability of the last symbol of packed n-grams after the symbols before it."""
        code = code.astype(U64)
        out, weight, open_ = np.zeros(len(code)), np.zeros(len(code)), np.arange(len(code))
        for order in range(ORDER, -1, -1):
            key = code[open_] & U64((1 << BITS * order) - 1)
            found, value = _find(self.grams, self.log_p, _hash(order, key))
            out[open_[found]] = weight[open_[found]] + value[found]
            open_ = open_[~found]
            if order:
                seen, w = _find(self.contexts, self.log_w, _hash(order - 1, key[~found] >> U64(BITS)))
                weight[open_[seen]] += w[seen]
        return out


def _find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return keys[at] == wanted, values[at]


def kneser_ney(code: np.ndarray, count: np.ndarray) -> Kneser:
    """The interpolated model of packed ``ORDER``-grams with their counts.

    Lower orders count the distinct symbols that precede an n-gram; the lowest level is uniform.
    """
    levels = {ORDER: (code.astype(U64), count.astype(float))}
    for order in range(ORDER - 1, 0, -1):
        shorter = levels[order + 1][0] & U64((1 << BITS * order) - 1)
        levels[order] = tuple(np.unique(shorter, return_counts=True))
    grams, log_p = [_hash(0, np.zeros(1, U64))], [np.array([-float(BITS)])]
    contexts, log_w = [], []
    below = None
    for order in range(1, ORDER + 1):
        key, n = levels[order]
        once, twice = (n == 1).sum(), (n == 2).sum()
        discount = min(max(once / (once + 2 * twice), 0.1), 0.9) if once + twice else 0.5
        context, where = np.unique(key >> U64(BITS), return_inverse=True)
        total, kinds = np.bincount(where, n), np.bincount(where)
        weight = discount * kinds / total
        if below is None:
            lower = np.full(len(key), 2.0 ** -BITS)
        else:
            lower = below[1][np.searchsorted(below[0], key & U64((1 << BITS * (order - 1)) - 1))]
        p = np.maximum(n - discount, 0) / total[where] + weight[where] * lower
        below = key, p
        grams.append(_hash(order, key)), log_p.append(np.log2(p))
        contexts.append(_hash(order - 1, context)), log_w.append(np.log2(weight))
    g, c = np.concatenate(grams), np.concatenate(contexts)
    i, j = np.argsort(g), np.argsort(c)
    return Kneser(g[i], np.concatenate(log_p)[i], c[j], np.concatenate(log_w)[j])


@dataclass(frozen=True)
class Model:
    """All languages in name order, their rejection thresholds, and the slope that turns margins into scores."""

    alphabet: np.ndarray
    rare: np.ndarray
    names: list[str]
    models: list[Kneser]
    limits: np.ndarray
    slope: float

    def entropies(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per symbol of every text (rows) in every language, and which texts have a letter."""
        low, ends = letters(column)
        code, at = packed(low, ends, self.alphabet, self.rare)
        docs = len(at) - 1
        has = A.segment_sum(low > 0, ends) > 0
        out = np.zeros((docs, len(self.names)))
        if not docs or not self.names:
            return out, has
        coded = pa.array(code).dictionary_encode()
        distinct, slot = coded.dictionary.to_numpy(), coded.indices.to_numpy()
        for first in range(0, len(self.names), COLUMNS):  # a bounded number of languages at a time
            part = np.column_stack([m.log_prob(distinct) for m in self.models[first:first + COLUMNS]])
            out[:, first:first + COLUMNS] = -np.add.reduceat(part[slot], at[:-1], axis=0) / np.diff(at)[:, None]
        return out, has


# --- Spark jobs -----------------------------------------------------------------------------

def learning_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``text, lang, fold`` of the rows to learn from: text, language and id given, remainder not 2."""
    return (docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), fold(id_col).alias("fold"))
            .filter("text is not null and lang is not null and fold <> 2"))


def fold(id_col: str = "doc_id"):
    """The remainder that separates held-out rows (2): CRC-32 of the id as text, modulo 4."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)).cast("int")


def learn_alphabet(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Alphabet of all letters of the learning rows, and its letters that are two symbols."""
    def run(batches):
        total = np.zeros(0x110000, np.int64)
        for batch in batches:
            for part in A.slices(batch):
                low, _ = letters(part.column(0))
                counts = np.bincount(low)
                total[:len(counts)] += counts
        total[0] = 0
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["letter", "n"])

    counts = rows.select("text").mapInArrow(run, "letter long, n long").groupBy("letter").agg(F.sum("n").alias("n"))
    found = counts.toArrow()  # at most as many rows as Unicode has letters
    letter, n = (found.column(c).to_numpy() for c in ("letter", "n"))
    return split_letters(letter[np.lexsort((letter, -n))])


def gram_counts(rows: DataFrame, alphabet: np.ndarray, rare: np.ndarray) -> DataFrame:
    """``lang, calibration, code, n``: summed n-gram counts of all learning rows."""
    def run(batches):
        held: dict = {}
        size = 0
        for batch in batches:
            for part in A.slices(batch):
                lang = part.column(1).dictionary_encode()
                group = lang.indices.to_numpy().astype(np.int64) * 2 + (part.column(2).to_numpy() == 3)
                order = np.argsort(group, kind="stable")  # the documents of a group one after the other
                code, at = packed(*letters(part.column(0).take(pa.array(order))), alphabet, rare)
                group = group[order]
                for g in np.unique(group).tolist():
                    a, b = at[np.searchsorted(group, [g, g + 1])]
                    own = pc.value_counts(pa.array(code[a:b]))
                    name = lang.dictionary[g >> 1].as_py(), bool(g & 1)
                    held.setdefault(name, []).append((own.field(0).to_numpy(), own.field(1).to_numpy()))
                    size += len(own)
                    if len(held[name]) >= 16:
                        size -= sum(len(c) for c, _ in held[name])
                        held[name] = [_merged(held[name])]
                        size += len(held[name][0][0])
                if size >= HELD:
                    yield from counted(held)
                    held, size = {}, 0
        yield from counted(held)

    def counted(held):
        for (lang, calibration), parts in held.items():
            code, n = _merged(parts)
            for a in range(0, len(code), 1 << 16):
                k = len(code[a:a + (1 << 16)])
                yield pa.RecordBatch.from_arrays([pa.array([lang] * k, pa.string()), pa.array([calibration] * k), pa.array(code[a:a + k].view(np.int64)),
                                                  pa.array(n[a:a + k])], names=["lang", "calibration", "code", "n"])

    return (rows.select("text", "lang", "fold").mapInArrow(run, "lang string, calibration boolean, code long, n long")
            .groupBy("lang", "calibration", "code").agg(F.sum("n").alias("n")))


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    code, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return code, np.bincount(at, np.concatenate([p[1] for p in parts]), len(code)).astype(np.int64)


def fitted(counts: DataFrame) -> DataFrame:
    """``lang, whole, context, key, value``: the model of every language, of all its learning rows and without calibration rows.

    A task builds one language at a time.
    """
    def build(table):
        lang = table.column("lang")[0].as_py()
        code, n, calibration = (table.column(c).to_numpy() for c in ("code", "n", "calibration"))
        code, parts = code.view(U64), []
        for whole in (False, True):
            use = slice(None) if whole else ~calibration
            model = kneser_ney(*_merged([(code[use], n[use])])) if len(code[use]) else kneser_ney(np.zeros(1, U64), np.ones(1))
            for context, keys, values in ((False, model.grams, model.log_p), (True, model.contexts, model.log_w)):
                for a in range(0, len(keys), 1 << 16):
                    k = len(keys[a:a + (1 << 16)])
                    parts.append(pa.RecordBatch.from_arrays(
                        [pa.array([lang] * k, pa.string()), pa.array([whole] * k), pa.array([context] * k),
                         pa.array(keys[a:a + k].view(np.int64)), pa.array(values[a:a + k])], names=["lang", "whole", "context", "key", "value"]))
        return pa.Table.from_batches(parts)

    return counts.groupBy("lang").applyInArrow(build, "lang string, whole boolean, context boolean, key long, value double")


def _models(parts: DataFrame, names: list[str], whole: bool) -> list[Kneser]:
    rows = parts.filter(F.col("whole") == whole).select("lang", "context", "key", "value").toArrow()
    lang = rows.column("lang").combine_chunks().dictionary_encode()
    lang, of = lang.indices.to_numpy(), {v: i for i, v in enumerate(lang.dictionary.to_pylist())}
    context, value = (rows.column(c).to_numpy() for c in ("context", "value"))
    key = rows.column("key").to_numpy().view(U64)
    out = []
    for name in names:
        arrays = []
        for kind in (False, True):
            mine = np.flatnonzero((lang == of[name]) & (context == kind))
            mine = mine[np.argsort(key[mine])]
            arrays += [key[mine], value[mine]]
        out.append(Kneser(*arrays))
    return out


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn alphabet, models and calibration from the learning rows of ``docs``."""
    rows = learning_rows(docs, id_col, text_col, lang_col)
    alphabet, rare = learn_alphabet(rows)
    parts, _ = written(fitted(gram_counts(rows, alphabet, rare)), "language-models")
    names = sorted(r["lang"] for r in parts.select("lang").distinct().collect())
    unseen = Model(alphabet, rare, names, _models(parts, names, False), np.full(len(names), np.inf), 1.0)
    shared = docs.sparkSession.sparkContext.broadcast(unseen)

    def run(batches):
        model = shared.value
        for batch in batches:
            for part in A.slices(batch):
                h, has = model.entropies(part.column(0))
                own = np.searchsorted(names, part.column(1).to_numpy(zero_copy_only=False).astype(str))
                best = h.argmin(axis=1)
                margin = _margin(h, best)
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array(h[np.arange(len(h)), own]), pa.array(np.round(margin, 2)),
                                                  pa.array(best == own), pa.array(has)], names=["lang", "h", "margin", "right", "has"])

    held = rows.filter("fold = 3").select("text", "lang").mapInArrow(run, "lang string, h double, margin double, right boolean, has boolean").filter("has")
    limits = dict(held.groupBy("lang").agg(F.percentile_approx("h", ACCEPT, 10_000)).collect())
    # a bounded number of margins of two decimals
    bins = held.filter("margin < 40").groupBy("margin", "right").count().collect()
    slope = _slope([(r["margin"], r["right"], r["count"]) for r in bins])
    return Model(alphabet, rare, names, _models(parts, names, True), np.array([limits.get(n) or np.inf for n in names]), slope)


def _margin(h: np.ndarray, best: np.ndarray) -> np.ndarray:
    """How much lower the best cross-entropy is than the next (one language: 64)."""
    if h.shape[1] < 2:
        return np.full(len(h), 64.0)
    rest = h.copy()
    rest[np.arange(len(h)), best] = np.inf
    return np.minimum(rest.min(axis=1) - h[np.arange(len(h)), best], 64.0)


def _slope(bins: list[tuple[float, bool, int]]) -> float:
    """The slope of ``1 / (1 + exp(-slope * margin))`` that fits right and wrong calibration rows best."""
    if not bins:
        return 10.0
    m, right, n = (np.array(x, float) for x in zip(*bins))
    grid = np.geomspace(0.5, 200, 120)
    fit = [float((n * np.where(right > 0, np.logaddexp(0, -s * m), np.logaddexp(0, s * m))).sum()) for s in grid]
    return float(grid[int(np.argmin(fit))])


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Every row with ``lang_pred``, ``score`` (0 to 1), ``cross_entropy`` and ``rejected``.

    Null texts and texts without a letter are ``und`` with score 0, and so is everything if no language was
    learned.  ``rejected`` marks texts whose cross-entropy is above the calibrated limit of their language.
    Ties go to the first language in name order.  Other columns stay; one with a result's name gives way.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        names = np.array([*model.names, "und"], object)
        for batch in batches:
            for part in A.slices(batch, text_col):
                h, has = model.entropies(part.column(part.schema.get_field_index(text_col)))
                if not model.names:
                    h, has = np.zeros((len(h), 1)), np.zeros(len(h), bool)
                best = h.argmin(axis=1)
                lowest = h[np.arange(len(h)), best]
                limit = model.limits[best] if model.names else np.full(len(h), np.inf)
                score = np.where(has, 1 / (1 + np.exp(-model.slope * np.minimum(_margin(h, best), 700 / model.slope))), 0.0)
                yield part, [pa.array(names[np.where(has, best, len(model.names))], pa.string()), pa.array(score),
                             pa.array(lowest, mask=~has), pa.array(has & (lowest > limit))]

    return carry(docs, run, [("lang_pred", "string"), ("score", "double"), ("cross_entropy", "double"), ("rejected", "boolean")], text_col)
