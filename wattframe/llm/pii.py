"""Personal data: fixed base patterns and bootstrapped contextual extraction.

1. One Arrow pass finds the base identifiers of whole texts, and every other identifier-like token,
   with the lexical patterns around each (two words before; one before; one before and one after).
2. Pattern-instance edges are aggregated by Spark.  Seeds (base identifiers) score 1 for their kind.
   Each round, patterns get the share of their instances that belongs to a kind, patterns with a high
   share and enough distinct instances are kept, and instances get the noisy-or of their patterns.
   Scores only grow from round to round, so the rounds go on until no pattern is added and no share
   grows any more.
3. Tokens in a kept pattern of a kind they could be (their shape) become spans of that kind; of kinds
   with equal shares the first in ``KINDS``.

Texts never enter a shuffle: only tokens, patterns and spans do.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrow_text as A
from .scratch import carry, drop, written

KINDS = ["email", "ip", "card", "phone"]
#: Least share of a pattern's instances (smoothed), least distinct instances of a pattern.
CONFIDENCE, SUPPORT, SMOOTHING = 0.7, 5, 2.0
#: Growth of a share from one round to the next that still counts as growth.
SETTLED = 1e-6
#: A longer word next to an identifier is named in patterns by its last characters and a hash of all of it.
CONTEXT = 40

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_MARKED = re.compile(r"[0-9@]")
_NUMERIC = re.compile(r"[0-9().+/-]+")
_PIECE = re.compile(r"[^:=]+")
_EDGE = "\"'()[]{}<>,;:.!?=*"
_HOLDS = np.isin(np.arange(256), [*range(48, 58), ord("@")])


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the base identifiers, leftmost and non-overlapping per kind.

    E-mail addresses are found from their ``@``, whose domain follows and whose local part runs back to
    the first character that can't be in one, or to the previous address; this is what a left-to-right
    search finds, in linear time.
    """
    out, low = [], 0
    for m in _DOMAIN.finditer(text) if "@" in text else ():
        i = m.start()
        while i > low and text[i - 1] in _LOCAL:
            i -= 1
        if i < m.start():
            out.append((i, 0, m.end()))
            low = m.end()
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        d = _digits(m[0])
        if 12 <= len(d) <= 19 and _luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 9 <= len(_digits(m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def _shape(token: str) -> int:
    """Bit mask of the kinds a token could be."""
    n = len(_digits(token))
    numeric = bool(re.fullmatch(r"[0-9().+/\x20-]+", token))
    return ((1 if re.fullmatch(r"[^@\s]+@[^@\s]+", token) else 0) | (2 if re.fullmatch(r"[0-9]+(\.[0-9]+){3}", token) else 0)
            | (4 if numeric and 12 <= n <= 19 else 0) | (8 if numeric and 7 <= n <= 15 else 0))


def _named(word: str) -> str:
    return word if len(word) <= CONTEXT else f"{word[-CONTEXT:]}~{xxhash.xxh64_hexdigest(word)}"


def _plain(word: str) -> str:
    return "#" if _MARKED.search(word) else _named(word.lower().strip(_EDGE) or word)


def _marked_tokens(text: str, words: list[tuple[int, int]], taken: np.ndarray) -> list[tuple[int, int]]:
    """Tokens with a digit or ``@`` in words without base spans: what ``:`` and ``=`` leave of a word.

    A number at the end of a word goes on through the numbers after it, one blank apart.
    """
    found, i = [], 0
    while i < len(words):
        here, i = i, i + 1
        if taken[here] or not _MARKED.search(text, *words[here]):
            continue
        for piece in _PIECE.finditer(text, *words[here]):
            a, b = piece.span()
            if not _MARKED.search(text, a, b):
                continue
            if b == words[here][1] and _NUMERIC.fullmatch(text, a, b):
                while i < len(words) and not taken[i] and text[words[i - 1][1]:words[i][0]] == " " and _NUMERIC.fullmatch(text, *words[i]):
                    i += 1
                b = words[i - 1][1]
            while a < b and text[a] in _EDGE and not (text[a] == "(" and i > here + 1):
                a += 1
            while a < b and text[b - 1] in _EDGE:
                b -= 1
            if a < b:
                found.append((a, b))
    return found


def occurrences(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, str, list[str]]]:
    """``(start, end, kind or -1, shape, instance, patterns)`` of base spans and other marked tokens.

    The nearest word on the left is what precedes the token in its own word, from the identifier before
    it there if any; only without such a part it is the word before.
    """
    words = [m.span() for m in _WORD.finditer(text)]
    starts = [a for a, _ in words]
    taken = np.zeros(len(words), bool)
    for a, _, b in base:
        taken[max(bisect_right(starts, a) - 1, 0):bisect_left(starts, b)] = True
    found = [(a, b, kind, 0) for a, kind, b in base]
    found += [(a, b, -1, _shape(text[a:b])) for a, b in _marked_tokens(text, words, taken)]
    ends = sorted(b for _, b, _, _ in found)
    names: dict[int, str] = {}

    def name(k: int) -> str:
        if k not in names:
            names[k] = _plain(text[words[k][0]:words[k][1]])
        return names[k]

    out = []
    for a, b, kind, shape in sorted(found):
        k = bisect_right(starts, a) - 1
        before = bisect_right(ends, a)
        inner = text[max(words[k][0], ends[before - 1] if before else 0):a].strip("\"'([{<")
        left = ([_named(inner.lower())] if inner else []) + [name(w) for w in range(k - 1, max(k - 3, -1), -1)]
        left += ["^"] * (2 - len(left))
        n = bisect_left(starts, b)
        right = name(n) if n < len(words) else "$"
        out.append((a, b, kind, shape, text[a:b].lower(), [f"{left[1]} {left[0]} _", f"{left[0]} _", f"{left[0]} _ {right}"]))
    return out


_SPAN = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])
_TOKEN = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.int32()), ("shape", pa.int32()),
                    ("instance", pa.string()), ("patterns", pa.list_(pa.string()))])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, mark, base, tokens`` for every row; ``mark`` is a hash of the text."""
    def run(batches):
        for batch in batches:
            for part in A.slices(batch):
                data, offsets = A.buffers(part.column(2))
                some = set(np.flatnonzero(A.segment_sum(_HOLDS[data], offsets)).tolist())
                base, tokens = [], []
                for i in range(part.num_rows):
                    spans = rows = []
                    if i in some:
                        text = part.column(2)[i].as_py()
                        spans = base_spans(text)
                        rows = occurrences(text, spans)
                    base.append([dict(zip(("start", "kind", "end"), s)) for s in spans])
                    tokens.append([dict(zip(("start", "end", "kind", "shape", "instance", "patterns"), r)) for r in rows])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(base, pa.list_(_SPAN)), pa.array(tokens, pa.list_(_TOKEN))],
                                                 names=["doc_id", "mark", "base", "tokens"])

    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text")).mapInArrow(
        run, "doc_id long, mark long, base array<struct<start: long, kind: int, end: long>>, "
             "tokens array<struct<start: long, end: long, kind: int, shape: int, instance: string, patterns: array<string>>>")


def kept_patterns(edges: DataFrame, rounds: int | None = None, confidence: float = CONFIDENCE, support: int = SUPPORT) -> DataFrame:
    """``pattern, kind, confidence`` of the patterns kept after the last round.

    ``edges`` has ``pattern, instance, kind`` (kind -1: not a seed), each edge once.  Without ``rounds``
    the rounds go on until a round adds no pattern and no share grows by more than ``SETTLED``: more
    patterns and larger shares raise instances, and these raise shares, so the kept set never shrinks
    and its end does not depend on a number of rounds.  A chain of g generations takes g + 1 rounds.
    """
    spark = edges.sparkSession
    seeds = edges.filter("kind >= 0").select("instance", "kind").distinct().withColumn("score", F.lit(1.0))
    pairs = edges.select("pattern", "instance").distinct()
    sizes = pairs.groupBy("pattern").agg(F.count("*").alias("n")).filter(F.col("n") >= support)
    scores, patterns, path, done = seeds, None, None, 0
    while True:
        share = pairs.join(scores, "instance").groupBy("pattern", "kind").agg(
            F.sum("score").alias("mass"), F.count(F.when(F.col("score") >= 0.5, 1)).alias("support"))
        kept = (share.filter(F.col("support") >= support).join(sizes, "pattern")
                .withColumn("confidence", F.col("mass") / (F.col("n") + F.lit(SMOOTHING)))
                .filter(F.col("confidence") >= confidence).select("pattern", "kind", "confidence"))
        kept, new = written(kept, "patterns")
        done += 1
        if rounds is None:
            old = patterns.withColumnRenamed("confidence", "was") if patterns is not None else None
            grown = kept if old is None else kept.join(old, ["pattern", "kind"], "left").filter(
                F.col("was").isNull() | (F.col("confidence") - F.col("was") > F.lit(SETTLED)))
            last = grown.isEmpty()
        else:
            last = done >= rounds
        if path:
            drop(spark, path)
        patterns, path = kept, new
        if last:
            return patterns
        found = (pairs.join(patterns, "pattern").groupBy("instance", "kind")
                 .agg((1 - F.exp(F.sum(F.log1p(-F.least("confidence", F.lit(0.99)))))).alias("score")))
        scores = seeds.unionByName(found.join(seeds.select("instance").distinct(), "instance", "left_anti"))


def _contextual(found: DataFrame, **how) -> DataFrame:
    """``doc_id, mark, extra``: the spans that kept patterns add to each document."""
    tokens = found.select("doc_id", "mark", F.explode("tokens").alias("t")).select("doc_id", "mark", "t.*")
    edges, _ = written(tokens.select(F.explode("patterns").alias("pattern"), "instance", "kind").distinct(), "edges")
    patterns = kept_patterns(edges, **how)
    open_ = tokens.filter("kind < 0 and shape > 0").select("doc_id", "mark", "start", "end", "shape", F.explode("patterns").alias("pattern"))
    hits = (open_.join(patterns, "pattern").filter(F.expr("shiftright(shape, kind) & 1") == 1)
            .groupBy("doc_id", "mark", "start", "end").agg(F.max(F.struct("confidence", -F.col("kind"))).alias("best")))
    span = F.struct("start", (-F.col("best").getField("col2")).cast("int").alias("kind"), "end")
    return hits.groupBy("doc_id", "mark").agg(F.collect_set(span).alias("extra"))


def identifiers(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``doc_id, mark, base, spans`` for every row: base spans and all spans, ``(start, kind, end)`` in order.

    Kinds are positions in ``KINDS``, places are code points.  Null and empty texts have no spans.  Very long
    texts are scanned whole, in linear time.  Repeated rows have equal spans, rows with a null id too; other
    columns are ignored; an empty table gives no rows.
    """
    found, _ = written(scan(docs, id_col, text_col), "tokens")
    extra = _contextual(found, **how).withColumnsRenamed({"doc_id": "d", "mark": "m"})
    joined = found.join(extra, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("mark") == F.col("m")), "left")
    none = F.array().cast("array<struct<start: long, kind: int, end: long>>")
    return joined.select("doc_id", "mark", F.array_sort("base").alias("base"),
                         F.array_sort(F.concat("base", F.coalesce("extra", none))).alias("spans"))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``doc_id``, number of base spans per kind, ``base_sha256`` and all spans as ``kind:start:end`` text."""
    names = F.array(*map(F.lit, KINDS))
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return identifiers(docs, id_col, text_col, **how).select(
        "doc_id", *[count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)],
        F.sha2(text("base"), 256).alias("base_sha256"), text("spans").alias("spans"))


def _masked(text: str, spans: list[dict]) -> str:
    out, at = [], 0
    for s in spans:
        if s["start"] >= at:  # else it overlaps the one before and is masked with it
            out += [text[at:s["start"]], f"<{KINDS[s['kind']].upper()}>"]
        at = max(at, s["end"])
    return "".join(out) + text[at:]


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets; overlapping spans become one, named by the first."""
    found = identifiers(docs, id_col, text_col, **how).filter(F.size("spans") > 0)
    side = found.dropDuplicates(["doc_id", "mark"]).select(F.col("doc_id").alias("__d"), F.col("mark").alias("__m"), F.col("spans").alias("__spans"))
    joined = docs.withColumn("__mark", F.xxhash64(F.col(text_col).cast("string"))).join(
        side, F.col(id_col).cast("long").eqNullSafe(F.col("__d")) & (F.col("__mark") == F.col("__m")), "left").drop("__mark", "__d", "__m")

    def run(batches):
        for batch in batches:
            for part in A.slices(batch, text_col):
                text, spans = part.column(part.schema.get_field_index(text_col)), part.column(part.schema.get_field_index("__spans"))
                new = text.to_pylist()
                for i in np.flatnonzero(spans.is_valid().to_numpy(zero_copy_only=False)).tolist():
                    new[i] = _masked(new[i], spans[i].as_py())
                yield part, [pa.array(new, pa.string())]

    return carry(joined, run, [(text_col, "string")], text_col).select(*[F.col(f"`{c}`") for c in docs.columns])
