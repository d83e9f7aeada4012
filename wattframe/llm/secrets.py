"""Secret scans: all rules in one combined deterministic automaton, one pass over the bytes.

1. The driver compiles the rules once.  Each regex becomes an NFA over bytes; the union of all rules,
   allowed to begin anywhere, is determinised by subset construction and minimised by partition
   refinement.  The result is one transition array (state x byte class) and a rule mask per state.
   Each rule also gets a small anchored automaton of its own.
2. Tasks read each byte of the text once for all rules.  A slice is cut into lanes that advance in
   lockstep (numpy); a lane starts as if nothing had been matched, and lanes whose predecessor ended in
   another state are advanced again until they meet the states found before.  The states are those of a
   plain pass, whatever the cuts.
3. An accepting state says which rules have just seen the opening of a match.  Since the last start state
   some match has been under way, so its first byte lies after that.  There the anchored automaton of the
   rule finds the leftmost start and its longest match, and goes on from the end.

Nothing is shuffled.  The automaton (its size depends on the rules alone) goes out with the tasks.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrow_text as A
from .scratch import carry


@dataclass(frozen=True)
class Rule:
    """``head`` in the syntax of :func:`parse`, then at least ``opens`` characters of the class ``tail``.

    A match with fewer than ``least`` tail characters is dropped, and the search goes on after it.  The
    combined automaton only knows the opening (head and ``opens`` tail characters): tails and counters of
    several rules going on at once would multiply its states.
    """

    kind: str
    head: str
    tail: str = ""
    least: int = 0
    opens: int = 1
    any_case: bool = False

    @property
    def pattern(self) -> str:
        return self.opening[:-1] + ",}" if self.tail else self.head

    @property
    def opening(self) -> str:
        return self.head + (f"{self.tail}{{{self.opens}}}" if self.tail else "")


# The base rules.  A run of hex digits has no head, so a match that is opened by 8 of them
# is the same as one opened by the first.
BASE = [
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", "[A-Za-z0-9+/_.=-]", 8, any_case=True),
    Rule("access", "AKIA", "[A-Z0-9]", 12),
    Rule("hex", "", "[0-9a-f]", 32, opens=8),
]
# Published formats of credentials, added by the method.
ADDED = [
    Rule("private_key", r"-----BEGIN (RSA |EC |DSA |OPENSSH |ENCRYPTED |PGP )?PRIVATE KEY( BLOCK)?-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ", "[A-Za-z0-9_.-]", 16),
    Rule("code_host", r"(gh[pousr]_|github_pat_|glpat-)", "[A-Za-z0-9_-]", 20),
    Rule("chat", r"xox[abeoprs]-", "[0-9A-Za-z-]", 10),
    Rule("payment", r"[rs]k_(live|test)_", "[0-9A-Za-z]", 16),
    Rule("cloud", r"(ASIA|AIza)", "[0-9A-Za-z_-]", 16),
    Rule("bearer", r"bearer\x20+", "[A-Za-z0-9+/_.~=-]", 20, any_case=True),
    Rule("url_login", r"(https?|ftp|postgres(ql)?|mysql|mongodb|redis|amqp)://[A-Za-z0-9_.~%-]+:[A-Za-z0-9_.~%!$&*+=-]+@"),
]
RULES = BASE + ADDED
#: Lanes that advance together, and the fewest bytes of a lane.
LANES, SHORTEST = 2048, 64


# --- from patterns to an NFA ----------------------------------------------------------------

_ESCAPES = {"d": "0-9", "w": "A-Za-z0-9_", "n": "\n", "t": "\t", "r": "\r"}


def parse(pattern: str, any_case: bool = False):
    """A syntax tree of a byte regex: literals, ``\\xNN``, classes, groups, ``|``, ``? * + {m} {m,} {m,n}``.

    Nodes are ``("set", bytes)``, ``("cat", nodes)``, ``("or", nodes)`` and ``("rep", node, least, most)``
    with ``most`` None where it is open.  Groups only bracket.  Anything else raises ``ValueError``.
    """
    at = 0

    def peek():
        return pattern[at] if at < len(pattern) else ""

    def take():
        nonlocal at
        if at >= len(pattern):
            raise ValueError(f"pattern ends early: {pattern}")
        at += 1
        return pattern[at - 1]

    def byte_set(chars) -> tuple:
        if any(ord(c) > 127 for c in chars):
            raise ValueError("patterns are ASCII")
        found = {ord(c) for c in chars}
        if any_case:
            found |= {ord(chr(b).swapcase()) for b in found if chr(b).isalpha()}
        return ("set", frozenset(found))

    def escaped() -> str:
        c = take()
        if c == "x":
            return chr(int(take() + take(), 16))
        if c in ("d", "w"):
            return "".join(expand(_ESCAPES[c]))
        if c.isalnum() and c not in _ESCAPES:
            raise ValueError(f"unknown escape \\{c}")
        return _ESCAPES.get(c, c)

    def expand(ranges: str):
        i = 0
        while i < len(ranges):
            if ranges[i + 1:i + 2] == "-" and i + 2 < len(ranges):
                yield from map(chr, range(ord(ranges[i]), ord(ranges[i + 2]) + 1))
                i += 3
            else:
                yield ranges[i]
                i += 1

    def char_class():
        chars: set[str] = set()
        if peek() == "^":
            raise ValueError("negated classes are not supported: rules name the bytes they match")
        while (c := take()) != "]":
            got = escaped() if c == "\\" else c
            if len(got) == 1 and peek() == "-" and pattern[at + 1:at + 2] not in ("]", ""):
                take()
                last = take()
                last = escaped() if last == "\\" else last
                if len(last) != 1 or last < got:
                    raise ValueError(f"bad range in {pattern}")
                chars |= set(map(chr, range(ord(got), ord(last) + 1)))
            else:
                chars |= set(got)
        if not chars:
            raise ValueError(f"empty class in {pattern}")
        return byte_set(chars)

    def atom():
        c = take()
        if c == "(":
            inner = choice()
            if not peek() or take() != ")":
                raise ValueError(f"open group in {pattern}")
            return inner
        if c == "[":
            return char_class()
        if c in "*+?{}).^$|":
            raise ValueError(f"unexpected {c} in {pattern}")
        return byte_set(escaped() if c == "\\" else c)

    def repeated():
        node = atom()
        while peek() and peek() in "?*+{":
            c = take()
            if c == "{":
                text = ""
                while (d := take()) != "}":
                    text += d
                low, comma, high = text.partition(",")
                least, most = int(low), (int(high) if high else None) if comma else int(low)
                if most is not None and most < least:
                    raise ValueError(f"bad repeat in {pattern}")
            else:
                least, most = {"?": (0, 1), "*": (0, None), "+": (1, None)}[c]
            node = ("rep", node, least, most)
        return node

    def sequence():
        parts = []
        while peek() and peek() not in "|)":
            parts.append(repeated())
        return ("cat", tuple(parts))

    def choice():
        options = [sequence()]
        while peek() == "|":
            take()
            options.append(sequence())
        return ("or", tuple(options))

    tree = choice()
    if at < len(pattern):
        raise ValueError(f"unexpected {peek()} in {pattern}")
    return tree


class _Nfa:
    """States with byte-set moves and empty moves."""

    def __init__(self):
        self.moves: list[list[tuple[frozenset, int]]] = []
        self.empty: list[list[int]] = []

    def state(self) -> int:
        self.moves.append([])
        self.empty.append([])
        return len(self.moves) - 1

    def add(self, tree, start: int) -> int:
        """Attach a syntax tree to a state; the state reached at its end."""
        kind = tree[0]
        if kind == "set":
            end = self.state()
            self.moves[start].append((tree[1], end))
            return end
        if kind == "cat":
            for part in tree[1]:
                start = self.add(part, start)
            return start
        end = self.state()
        if kind == "or":
            for option in tree[1]:
                self.empty[self.add(option, start)].append(end)
            return end
        _, inner, least, most = tree
        for _ in range(least):
            start = self.add(inner, start)
        if most is None:
            loop = self.state()
            self.empty[start].append(loop)
            self.empty[self.add(inner, loop)].append(loop)
            start = loop
        else:
            for _ in range(most - least):
                self.empty[start].append(end)
                start = self.add(inner, start)
        self.empty[start].append(end)
        return end

    def closure(self, states) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for s in self.empty[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(seen)


# --- subset construction and minimisation ---------------------------------------------------

@dataclass(frozen=True)
class Automaton:
    """``classes`` maps a byte to its class; the class after the last ends a document and leads to state 0.

    ``moves[state * width + class]`` is the next state times ``width``; ``masks`` has the rules accepted
    per state.  State 0 is the start; ``dead`` is the state nothing is accepted from (-1: none).
    """

    classes: np.ndarray
    moves: np.ndarray
    masks: np.ndarray
    width: int
    dead: int


def _byte_classes(nfa: _Nfa) -> tuple[np.ndarray, list[int]]:
    """Bytes that no rule tells apart share a class: the class of each byte and one byte of each class."""
    signature = [[] for _ in range(256)]
    for k, bytes_ in enumerate({s for moves in nfa.moves for s, _ in moves}):
        for b in bytes_:
            signature[b].append(k)
    number: dict[tuple, int] = {}
    classes = np.array([number.setdefault(tuple(s), len(number)) for s in signature], np.int64)
    return classes, [int(np.argmax(classes == c)) for c in range(len(number))]


def compile_rules(rules: list[Rule], anywhere: bool) -> Automaton:
    """The minimal automaton of all rules: their openings, begun anywhere, or whole matches, begun at the first byte."""
    if not 1 <= len(rules) <= 62:
        raise ValueError("1 to 62 rules fit in a mask")
    nfa = _Nfa()
    root = nfa.state()
    accept: dict[int, int] = {}
    for r, rule in enumerate(rules):
        start = nfa.state()
        nfa.empty[root].append(start)
        end = nfa.add(parse(rule.opening if anywhere else rule.pattern, rule.any_case), start)
        accept[end] = accept.get(end, 0) | 1 << r
    classes, sample = _byte_classes(nfa)
    first = nfa.closure([root])
    if any(s in accept for s in first):
        raise ValueError("a rule matches the empty text")
    reach = [[frozenset().union(*[nfa.closure([to]) for bytes_, to in moves if b in bytes_]) for b in sample] for moves in nfa.moves]
    always = first if anywhere else frozenset()
    number, todo, table = {first: 0}, [first], []
    for subset in todo:  # subset construction; new subsets join the list
        row = []
        live = [reach[s] for s in subset if nfa.moves[s]]
        for c in range(len(sample)):
            after = always.union(*[r[c] for r in live])
            if after not in number:
                number[after] = len(number)
                todo.append(after)
            row.append(number[after])
        table.append(row)
    masks = np.zeros(len(number), np.int64)
    for subset, n in number.items():
        for s in subset:
            masks[n] |= accept.get(s, 0)
    table, masks = _minimal(np.array(table, np.int64), masks)
    width = len(sample) + 1
    loops = (table == np.arange(len(table))[:, None]).all(axis=1) & (masks == 0)
    dead = np.flatnonzero(loops & (np.arange(len(table)) > 0))
    moves = np.zeros((len(table), width), np.int32)
    moves[:, :-1] = table * width
    return Automaton(classes.astype(np.uint8), moves.ravel(), masks, width, int(dead[0]) if len(dead) and not anywhere else -1)


def _minimal(table: np.ndarray, masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge states that no text tells apart: blocks are refined by the blocks their moves lead to."""
    block = np.unique(masks, return_inverse=True)[1].ravel()
    while True:
        finer = np.unique(np.column_stack([block, block[table]]), axis=0, return_inverse=True)[1].ravel()
        if finer.max() == block.max():
            break
        block = finer
    first = np.unique(block, return_index=True)[1]
    order = np.argsort(first)  # blocks in order of their first state, so the start stays 0
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    keep = first[order]
    return rank[block][table[keep]], masks[keep]


@lru_cache(maxsize=16)
def compiled(rules: tuple[Rule, ...]) -> tuple[Automaton, tuple[Automaton, ...]]:
    """The combined automaton of all rules and the anchored one of each."""
    return compile_rules(list(rules), True), tuple(compile_rules([r], False) for r in rules)


# --- scanning -------------------------------------------------------------------------------

def states(auto: Automaton, symbols: np.ndarray, lanes: int = LANES) -> np.ndarray:
    """The state (times ``width``) after each symbol of a text, from state 0."""
    n = len(symbols)
    if n == 0:
        return np.zeros(0, np.int32)
    length = max(SHORTEST, -(-n // lanes))
    count = -(-n // length)
    grid = np.full(count * length, auto.width - 1, np.uint8)
    grid[:n] = symbols
    grid = np.ascontiguousarray(grid.reshape(count, length).T)
    out = np.empty((length, count), np.int32)
    state = np.zeros(count, np.int32)
    for j in range(length):
        state = auto.moves.take(state + grid[j])
        out[j] = state
    began = np.zeros(count, np.int32)
    while True:  # lanes that should have begun elsewhere
        should = np.concatenate([[0], out[-1, :-1]]).astype(np.int32)
        lane = np.flatnonzero(should != began)
        if not len(lane):
            return out.T.ravel()[:n]
        began = should
        state = should[lane]
        for j in range(length):
            state = auto.moves.take(state + grid[j, lane])
            differs = state != out[j, lane]
            if not differs.any():
                break
            out[j, lane[differs]] = state[differs]
            lane, state = lane[differs], state[differs]


def _resolve(rule: Rule, auto: Automaton, data: np.ndarray, lo: int, hit: int, stop: int):
    """The matches of a rule that begin from ``lo`` to ``hit``: start, end, whether the tail is long enough."""
    moves, masks, width, dead = auto.moves, auto.masks, auto.width, auto.dead * auto.width
    at, ahead, symbols = lo, 256, b""
    while at <= hit:
        state, end, first, i = 0, -1, -1, at
        while i < stop:
            if i - lo >= len(symbols):  # a tail may go far past the opening
                ahead *= 2
                symbols = auto.classes[data[lo:min(stop, i + ahead)]].tobytes()
            state = int(moves[state + symbols[i - lo]])
            i += 1
            if masks[state // width]:
                end = i
                first = i if first < 0 else first
            elif state == dead:
                break
        if end < 0:
            at += 1
            continue
        yield at, end, end - first + rule.opens >= rule.least
        at = end


def find(data: np.ndarray, offsets: np.ndarray, rules: tuple[Rule, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All matches in the documents of a byte buffer: document, start and end byte in the buffer, rule."""
    combined, single = compiled(rules)
    n = len(data)
    symbols = np.full(n + len(offsets) - 1, combined.width - 1, np.uint8)  # a closing symbol ends each document
    place = np.arange(n) + A.segment_ids(offsets)
    symbols[place] = combined.classes[data]
    run = states(combined, symbols)
    mask = combined.masks[run // combined.width]
    hits = np.flatnonzero(mask)
    empty = tuple(np.zeros(0, np.int64) for _ in range(4))
    if not len(hits):
        return empty
    rest = np.flatnonzero(run == 0)
    place = np.searchsorted(rest, hits)
    low = np.where(place > 0, rest[np.maximum(place, 1) - 1] + 1, 0)
    doc_of = np.searchsorted(offsets[1:] + np.arange(len(offsets) - 1), hits)  # closing symbols shift places by one a document
    rows, done = [], {}
    for d, lo, hit, wanted in zip(doc_of.tolist(), (low - doc_of).tolist(), (hits - doc_of).tolist(), mask[hits].tolist()):
        stop = int(offsets[d + 1])
        for r in range(len(rules)):
            if wanted >> r & 1 and done.get(r, 0) <= hit:
                for x, y, long_enough in _resolve(rules[r], single[r], data, max(lo, done.get(r, 0)), hit, stop):
                    done[r] = y
                    if long_enough:
                        rows.append((d, x, y, r))
    if not rows:
        return empty
    found = np.array(rows, np.int64)
    return found[:, 0], found[:, 1], found[:, 2], found[:, 3]


def spans(docs: DataFrame, rules: list[Rule] | None = None, text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` with ``secrets``: an array of (start, kind, end) by start, then rule order.

    ``kind`` is a position in ``rules``; places are code points, ``end`` is exclusive.  Matches of one rule
    are leftmost, longest and do not overlap; those of different rules may.  A failing match is dropped and
    its bytes are not tried again.  Null and empty texts have no spans; a text of any length is scanned
    whole; repeated rows have equal spans; other columns stay, one named ``secrets`` gives way; an empty
    table gives no rows.
    """
    chosen = tuple(RULES if rules is None else rules)
    compiled(chosen)  # bad rules raise on the driver

    def run(batches):
        for batch in batches:
            for part in A.slices(batch, text_col):
                data, offsets = A.buffers(part.column(part.schema.get_field_index(text_col)))
                doc, start, end, rule = find(data, offsets, chosen)
                order = np.lexsort((rule, start))
                doc, start, end, rule = (x[order] for x in (doc, start, end, rule))
                if len(doc):
                    points = np.zeros(len(data) + 1, np.int64)
                    np.cumsum((data & 0xC0) != 0x80, out=points[1:])
                    base = points[offsets[doc]]
                    start, end = points[start] - base, points[end] - base
                at = np.searchsorted(doc, np.arange(part.num_rows + 1)).astype(np.int32)
                items = pa.StructArray.from_arrays([pa.array(start), pa.array(rule.astype(np.int32)), pa.array(end)], names=["start", "kind", "end"])
                yield part, [pa.ListArray.from_arrays(pa.array(at), items)]

    return carry(docs, run, [("secrets", "array<struct<start: bigint, kind: int, end: bigint>>")], text_col)


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, base spans by kind, ``base_sha256`` and all spans as ``kind:start:end`` text."""
    names = F.array(*[F.lit(r.kind) for r in RULES])
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("secrets", lambda s: s["kind"] == k)).cast("long")
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return spans(src).select(
        "doc_id", *[count(k).alias(f"n_{r.kind}") for k, r in enumerate(BASE)],
        F.sha2(text(F.filter("secrets", lambda s: s["kind"] < len(BASE))), 256).alias("base_sha256"),
        text(F.col("secrets")).alias("spans"))


def masked(docs: DataFrame, rules: list[Rule] | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` with every secret replaced by its kind in angle brackets; overlapping ones become one, named by the first."""
    chosen = tuple(RULES if rules is None else rules)
    compiled(chosen)

    def run(batches):
        for batch in batches:
            for part in A.slices(batch, text_col):
                column = part.column(part.schema.get_field_index(text_col))
                data, offsets = A.buffers(column)
                doc, start, end, rule = find(data, offsets, chosen)
                order = np.lexsort((rule, start))
                new, raw, pieces, done = column.to_pylist(), data.tobytes(), {}, {}
                for d, a, b, r in zip(*(x[order].tolist() for x in (doc, start, end, rule))):
                    from_ = done.get(d, int(offsets[d]))
                    if a >= from_:
                        pieces.setdefault(d, []).extend([raw[from_:a], b"<" + chosen[r].kind.upper().encode() + b">"])
                    done[d] = max(from_, b)
                for d, parts in pieces.items():
                    new[d] = (b"".join(parts) + raw[done[d]:int(offsets[d + 1])]).decode()
                yield part, [pa.array(new, pa.string())]

    return carry(docs, run, [(text_col, "string")], text_col).select(*[F.col(f"`{c}`") for c in docs.columns])


# --- SQL ------------------------------------------------------------------------------------

def report_sql() -> str:
    """DuckDB SQL for :func:`report`: the pieces between matches give the places."""
    def rule_sql(k: int, rule: Rule) -> str:
        flag = "(?i)" if rule.any_case else ""
        quoted = (flag + rule.pattern).replace("'", "''")
        whole = f"{flag}^{rule.head}({rule.tail}+)$".replace("'", "''")
        keep = f" WHERE length(regexp_extract(m, '{whole}', {rule.head.count('(') + 1})) >= {rule.least}" if rule.least else ""
        return f"""SELECT doc_id, row_id, {k} AS k, '{rule.kind}' AS kind, s, s + length(m) AS e FROM (
  SELECT doc_id, row_id, ms[i] AS m,
    CAST(list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s
  FROM (SELECT doc_id, row_id, ms, ps, unnest(range(1, len(ms) + 1)) AS i FROM (
    SELECT doc_id, row_id, regexp_extract_all(t, '{quoted}') AS ms, string_split_regex(t, '{quoted}') AS ps FROM d) WHERE len(ms) > 0)){keep}"""

    parts = "\nUNION ALL\n".join(rule_sql(k, r) for k, r in enumerate(RULES))
    digest = "coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k){}, '')"
    counts = ", ".join(f"count(*) FILTER (WHERE k = {k}) AS n_{r.kind}" for k, r in enumerate(BASE))
    base = digest.format(f" FILTER (WHERE k < {len(BASE)})")
    return f"""WITH d AS (SELECT doc_id, row_number() OVER () AS row_id, coalesce(text, '') AS t FROM documents),
f AS ({parts})
SELECT d.doc_id, {counts}, sha256({base}) AS base_sha256, {digest.format('')} AS spans
FROM d LEFT JOIN f USING (row_id) GROUP BY d.row_id, d.doc_id"""

