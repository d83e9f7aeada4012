"""Spelling variants: words one edit apart, found by permuterm rotations.

1. Words are counted by Spark with partial aggregation.
2. Every word, marked with a terminator, is rotated to every place (``x c y`` gives ``y $ x c``).  A
   rotation without its last character, ``y $ x``, is a prefix that all words share which differ from this
   one in that character; the word without the character has it as a whole rotation.  So replacements,
   insertions and deletions are the rows of one prefix.
3. Prefixes are sorted and scanned group by group.  A prefix names all places but one, so a group has at
   most one row per letter of the alphabet and one whole rotation, whatever the corpus.  Each group gives
   each member its number of neighbours and the best of them; pairs are never listed.
4. Forms are followed by pointer jumping.  A form has at least twice the count, so chains end.

Prefixes of over ``LONG`` code points stand in the sort by a 127-bit hash, made from running hashes of the
word, so a very long word costs as many rows as code points and no copies of itself.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import drop, written

#: Letters of a run, least code points and occurrences of a word, growth of a form's count.
LETTERS, SHORTEST, SEEN, FACTOR = "A-Za-zÀ-ÿ", 5, 3, 2
#: One letter in MODULUS runs (by crc32) is dropped in the counted words of the query.
MODULUS = 97
#: Code points of a prefix beyond which its hash is sorted; modulus and base of that hash.
LONG, PRIME, BASE = 64, (1 << 127) - 1, 0x5DEECE66D1234567890ABCDEF1357
END = "$"


def letter_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, run``: maximal runs of letters of every whole text, A-Z in lower case (one row each)."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    text = F.translate(F.col(text_col).cast("string"), upper, upper.lower())
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.explode(F.split(text, f"[^{LETTERS}]+")).alias("run"))
    return rows.filter("run != ''")


def word_counts(runs: DataFrame, modulus: int | None = MODULUS) -> DataFrame:
    """``word, n`` of runs (``doc_id, run``); runs whose crc32 of ``<doc_id>:<run>`` is a multiple of ``modulus`` lose
    the code point at that value modulo their length.  A run with a null id loses none."""
    word = F.col("run")
    if modulus:
        h = F.crc32(F.concat_ws(":", F.col("doc_id").cast("string"), word).cast("binary"))
        at = (h % F.length("run")).cast("int")
        word = F.when(F.col("doc_id").isNotNull() & (h % modulus == 0),
                      F.concat(F.substring("run", F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))).otherwise(word)
    return runs.select(word.alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def _rotations(word: str):
    """(prefix, whether the whole rotation, whether removing the character there is its first way) of a word."""
    size = len(word)
    if size < LONG:
        for i in range(size + 1):
            yield word[i:] + END + word[:i], True, False
            if i < size:
                yield word[i + 1:] + END + word[:i], False, i == 0 or word[i] != word[i - 1]
        return
    head, power = [0], [1]
    for c in word:
        head.append((head[-1] * BASE + ord(c)) % PRIME)
        power.append(power[-1] * BASE % PRIME)

    def name(i: int, j: int) -> str:  # of word[j:] + END + word[:i]
        if i + size - j + 1 <= LONG:
            return word[j:] + END + word[:i]
        tail = (head[size] - head[j] * power[size - j]) % PRIME
        return f"{END}{i + size - j}:{((tail * BASE + ord(END)) * power[i] + head[i]) % PRIME:x}"

    for i in range(size + 1):
        yield name(i, i), True, False
        if i < size:
            yield name(i, i + 1), False, i == 0 or word[i] != word[i - 1]


def rotations(words: DataFrame) -> DataFrame:
    """``prefix, whole, first, word, n`` for every rotation of every word, with and without its last character."""
    def run(batches):
        for batch in batches:
            out = []
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for prefix, whole, first in _rotations(word):
                    out.append((prefix, whole, first, word, n))
                    if len(out) == 20_000 or len(word) * len(out) > 1 << 22:
                        yield _batch(out)
                        out = []
            if out:
                yield _batch(out)

    return words.select("word", "n").mapInArrow(run, ROTATION)


ROTATION = "prefix string, whole boolean, first boolean, word string, n long"
FOUND = "word string, near long, best_n long, best string"


def _batch(rows: list) -> pa.RecordBatch:
    kinds = [pa.string(), pa.bool_(), pa.bool_(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["prefix", "whole", "first", "word", "n"])


def _scan(group: list, out: list) -> None:
    """The neighbours that one prefix gives each of its members (word, whole, first, n)."""
    shorts = [(w, n) for w, whole, _, n in group if not whole]
    firsts = [(w, n) for w, whole, first, n in group if not whole and first]
    wholes = [(w, n) for w, whole, _, n in group if whole]
    rank = lambda wn: (-wn[1], wn[0])
    for w, whole, first, _ in group:
        # a letter can be removed from a run of equal letters in several ways: only the first counts
        near = firsts if whole else [x for x in shorts if x[0] != w] + (wholes if first else [])
        if near:
            best = min(near, key=rank)
            out.append((w, len(near), best[1], best[0]))


def neighbours(words: DataFrame) -> DataFrame:
    """``word, n_near, best_n, best``: how many words are one edit away, and the most frequent (ties: the smallest)."""
    def run(batches):
        held, key, out = [], None, []
        for batch in batches:
            for prefix, *row in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if prefix != key:
                    if len(held) > 1:
                        _scan(held, out)
                    held, key = [], prefix
                held.append((row[2], row[0], row[1], row[3]))
            if out:
                yield _found(out)
                out = []
        if len(held) > 1:
            _scan(held, out)
        if out:
            yield _found(out)

    ordered = rotations(words).repartition("prefix").sortWithinPartitions("prefix")
    best = F.min(F.struct((-F.col("best_n")).alias("minus"), "best")).alias("top")
    found = ordered.mapInArrow(run, FOUND).groupBy("word").agg(F.sum("near").alias("n_near"), best)
    return found.select("word", "n_near", (-F.col("top.minus")).alias("best_n"), F.col("top.best").alias("best"))


def _found(rows: list) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["word", "near", "best_n", "best"])


def group_variants(counts: DataFrame, factor: int = FACTOR) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of counted words (``word, n``: one row per word).

    ``form`` is the near word of largest n (ties: smallest in code-point order) if that is at least ``factor``
    times the word's n, else null; ``root`` is reached by following forms.  ``factor`` is at least 2, so that
    chains end.  Null words go; an empty table gives no rows; other columns are ignored.
    """
    if factor < 2:
        raise ValueError("factor must be at least 2")
    spark = counts.sparkSession
    counted, _ = written(counts.filter("word is not null").select("word", F.col("n").cast("long").alias("n")), "words")
    near = neighbours(counted).withColumnRenamed("word", "near_word")
    strong = F.col("best_n") >= factor * F.col("n")
    found, _ = written(counted.join(near, F.col("word") == F.col("near_word"), "left").select(
        "word", F.when(strong, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(strong, F.col("best_n")).alias("form_n")), "forms")
    # words on a chain only: the others are their own roots
    links, path = written(found.filter("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:  # each round halves what is left of every chain
        further = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        jumped, following = written(links.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"),
                                                                              F.col("next").isNotNull().alias("moved")), "roots")
        drop(spark, path)
        links, path = jumped, following
        if jumped.filter("moved").limit(1).count() == 0:
            break
        links = jumped.select("word", "root")
    return found.join(links.select("word", "root"), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int | None = MODULUS,
                      shortest: int = SHORTEST, seen: int = SEEN) -> DataFrame:
    """:func:`group_variants` of the words of ``docs`` with at least ``shortest`` code points and ``seen`` occurrences.

    Null and empty texts have no words; repeated rows count as often as they occur; a text or a word may have any
    length; other columns are ignored; an empty table gives no rows.
    """
    counts = word_counts(letter_runs(docs, id_col, text_col), modulus)
    return group_variants(counts.filter((F.length("word") >= shortest) & (F.col("n") >= seen)))


__all__ = ["letter_runs", "word_counts", "rotations", "neighbours", "group_variants", "spelling_variants"]
