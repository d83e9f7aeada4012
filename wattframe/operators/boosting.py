"""Boosted regression trees: many models grown together, one Spark job per tree level.

Features are cut into bins once.  For every level, one pass over the binned rows sums gradients and counts by
(model, node, feature, bin) in each task, one exchange adds these histograms up, and the tasks that hold a whole
histogram name the best split.  So four targets, or all grid points and folds of a search, cost one job a
level together.  What reaches the driver is the best split of every node, bounded by the size of the models.

* Squared error; the leaf is ``-T(G) / (n + reg_lambda)``, the gain of a split the growth of the sum of
  ``T(G)^2 / (n + reg_lambda)``, where T moves G towards zero by ``alpha`` (the L1 penalty of leaf values).
* Rows are drawn for a tree by a hash of their key, columns once for a tree by its seed.  Gradients are whole
  multiples of 2^-30 of the target's range, so sums, and with them all splits, don't depend on the order of rows,
  the partitioning or retries.  (Bin edges are approximate percentiles; up to some 10,000 rows they are exact.)
* Margins are a column, written to the shared folder every ``every`` rounds; a level's pass adds the few trees grown
  since.  With ``state`` a fit that was broken off goes on from the last written round, with the same result.
* Errors on fitted and held-out rows after each round come with the first level of the next.  Models of one
  ``group`` stop together once their mean held-out RMSE hasn't improved for ``early_stop`` rounds; no job runs for them after.
"""

from __future__ import annotations

import json
import sys
import uuid
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattframe.schemas import TREE_COMMON
from wattframe.session import scratch_path

# tasks get this module's functions by value, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MAX_BINS, MAX_DEPTH = 64, 14
#: Steps of a target's range; rows summed at once, so that float sums of whole numbers stay exact.
STEPS, ROWS = 1 << 30, 1 << 16
NODES = "model int, tree int, node int, feature int, bin int, missing_left boolean, value double"
DONE = "settings string, round int, rows string, nodes string, errors string"
SUMS = pa.schema([("model", pa.int32()), ("node", pa.int32()), ("feature", pa.int32()), ("bin", pa.int32()),
                  ("g", pa.int64()), ("n", pa.int64()), ("e", pa.float64())])
SPLITS = pa.schema([("model", pa.int32()), ("node", pa.int32()), ("gain", pa.float64()), ("feature", pa.int32()), ("bin", pa.int32()),
                    ("missing_left", pa.bool_()), ("gl", pa.int64()), ("nl", pa.int64()), ("g", pa.int64()), ("n", pa.int64())])
SUMS_DDL = "model int, node int, feature int, bin int, g long, n long, e double"
SPLITS_DDL = "model int, node int, gain double, feature int, bin int, missing_left boolean, gl long, nl long, g long, n long"


@dataclass(frozen=True)
class Boost:
    """One model.  ``holdout`` names a boolean column: false rows are fitted, true rows only evaluated, null rows
    left out; without it all rows are fitted.  ``skip`` names features that this model must not use."""
    name: str
    target: str
    learning_rate: float = 0.07
    max_depth: int = 5
    n_estimators: int = 500
    min_child_weight: float = TREE_COMMON["min_child_weight"]
    subsample: float = TREE_COMMON["subsample"]
    colsample: float = TREE_COMMON["colsample_bytree"]
    alpha: float = 0.0
    reg_lambda: float = 1.0
    holdout: str | None = None
    group: str | None = None
    skip: tuple[str, ...] = ()
    seed: int = 42


@dataclass
class Boosted:
    """Fitted models: ``trees[m]`` are the kept trees of model m, ``errors`` rows of (model name, round, train RMSE,
    held-out RMSE or None)."""
    models: list
    features: list
    cuts: list
    base: list
    trees: list = field(default_factory=list)
    errors: list = field(default_factory=list)

    def transform(self, df: DataFrame, columns: dict[str, str]) -> DataFrame:
        """``df`` with a column per entry of ``columns`` (model name to column name)."""
        chosen = [[m.name for m in self.models].index(name) for name in columns]
        names, cuts, base, trees = list(columns.values()), self.cuts, [self.base[i] for i in chosen], [self.trees[i] for i in chosen]
        inputs = [f"_x{j}" for j in range(len(self.features))]

        def predict(batches):
            for b in batches:
                bins = _bins([b.column(x) for x in inputs], cuts)
                out = [np.full(b.num_rows, v) for v in base]
                for k, grown in enumerate(trees):
                    for t in grown:
                        out[k] += t["value"][_walk(t, bins)]
                kept = [c for c in b.schema.names if c not in inputs]
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], *map(pa.array, out)], names=[*kept, *names])

        wide = df.select(*df.columns, *[F.col(c).cast("double").alias(x) for c, x in zip(self.features, inputs)])
        schema = df.schema
        for n in names:
            schema = schema.add(n, "double")
        return wide.mapInArrow(predict, schema)

    def nodes(self, spark: SparkSession) -> DataFrame:
        """One row per node: model, tree, node (children of i: 2i + 1 and 2i + 2), feature (null: leaf), threshold (left: up to
        it), missing_left, value."""
        rows = []
        for m, grown in enumerate(self.trees):
            for k, t in enumerate(grown):
                for i in np.flatnonzero(t["used"]).tolist():
                    f, b = int(t["feature"][i]), int(t["bin"][i])
                    edge = None if f < 0 else float(self.cuts[f][b - 1]) if b <= len(self.cuts[f]) else float("inf")
                    rows.append((self.models[m].name, k, i, self.features[f] if f >= 0 else None, edge, bool(t["missing_left"][i]),
                                 float(t["value"][i])))
        return spark.createDataFrame(rows, "model string, tree int, node int, feature string, threshold double, missing_left boolean, value double")


def fit(df: DataFrame, key_cols: list[str], features: list[str], models: list[Boost], max_bins: int = MAX_BINS, every: int = 10,
        early_stop: int | None = None, state: str | None = None, stop_after: int | None = None) -> Boosted:
    """Grow all ``models`` on ``df``.

    ``key_cols`` tell rows apart (rows with equal keys are drawn together).  Null and NaN features go the way that gains
    more; rows with a null or NaN target are left out of models of this target.  A model without rows predicts 0.
    ``state`` is a folder for resumable fits, ``stop_after`` breaks the fit off after that many rounds.
    """
    _check(models, features, max_bins)
    spark = df.sparkSession
    targets, holdouts = sorted({m.target for m in models}), sorted({m.holdout for m in models if m.holdout})
    y = [F.nanvl(F.col(t).cast("double"), F.lit(None)) for t in targets]
    cuts, low, unit, base = _ranges(df, features, models, targets, y, max_bins)
    out = Boosted(models, list(features), cuts, base, [[] for _ in models])
    settings = json.dumps([[asdict(m) for m in models], out.features, [c.tolist() for c in cuts], base], sort_keys=True)
    state = state or scratch_path(spark, "boost")
    units = [unit[targets.index(m.target)] for m in models]
    facts = [{"y": targets.index(m.target), "bit": holdouts.index(m.holdout) if m.holdout else -1, "unit": units[i],
              "subsample": m.subsample, "alpha": m.alpha, "reg_lambda": m.reg_lambda, "min_child_weight": m.min_child_weight,
              "seed": m.seed} for i, m in enumerate(models)]
    start, rows = _resumed(spark, state, settings, out)
    if rows is None:
        rows = _binned(df, key_cols, features, y, holdouts, cuts, base)
        path = f"{state}/rows-0-{_fresh()}"
        rows.write.parquet(path)
        rows = spark.read.parquet(path)
    rows.persist()
    live = _growing(out, early_stop)
    recent: list[list] = [[] for _ in models]
    last = max(m.n_estimators for m in models)
    r = start
    while True:
        growing = [i for i in live if r < models[i].n_estimators]
        watched = [i for i in live if 0 < r <= models[i].n_estimators]  # errors after round r - 1
        if not growing and not watched or stop_after is not None and r >= stop_after:
            break
        trees = {i: _empty_tree(models[i].max_depth) for i in growing}
        columns = {i: _columns(models[i], r, features) for i in growing}
        open_nodes = {i: [0] for i in growing}
        for level in range(max((models[i].max_depth for i in growing), default=1)):
            todo = {i: nodes for i, nodes in open_nodes.items() if nodes and level < models[i].max_depth}
            measured = watched if level == 0 else []
            if not todo and not measured:
                break
            found, errors = _level(rows, len(features), facts, recent, trees, todo, columns, measured, r, max_bins)
            if measured:
                out.errors += [(models[i].name, r - 1, *errors[i]) for i in measured]
                kept = _growing(out, early_stop)
                if len(kept) < len(live):  # stopped models give up the tree just begun
                    live = kept
                    growing = [i for i in growing if i in live]
                    trees = {i: trees[i] for i in growing}
            open_nodes = {i: _grow(trees[i], models[i], units[i], todo.get(i, []), found.get(i, {})) for i in growing}
        if not growing:
            break
        for i in growing:
            out.trees[i].append(trees[i])
            recent[i].append(trees[i])
        r += 1
        if r % every == 0 and r < last:
            rows, recent = _write_state(spark, rows, state, settings, out, recent, r)
    rows.unpersist()
    if early_stop is not None:
        _keep_best(out)
    return out


def error_table(spark: SparkSession, fitted: Boosted) -> DataFrame:
    return spark.createDataFrame([(n, r, a, b) for n, r, a, b in fitted.errors], "model string, round int, train_rmse double, test_rmse double")


# --- rows ---------------------------------------------------------------------------------------


def _check(models, features, max_bins):
    if not models or not features:
        raise ValueError("at least one model and one feature are needed")
    if len({m.name for m in models}) < len(models):
        raise ValueError("model names must differ")
    if any(set(features) <= set(m.skip) for m in models):
        raise ValueError("a model has no feature left")
    if not 2 <= max_bins <= 255:
        raise ValueError("max_bins must be from 2 to 255")
    if any(not 1 <= m.max_depth <= MAX_DEPTH for m in models):
        raise ValueError(f"max_depth must be from 1 to {MAX_DEPTH}")
    if len({m.holdout for m in models if m.holdout}) > 62:
        raise ValueError("at most 62 holdout columns")


def _fitted_by(m: Boost) -> Column:
    return ~F.col(m.holdout) if m.holdout else F.lit(True)


def _ranges(df, features, models, targets, y, max_bins):
    """Bin edges, smallest value and step of every target, starting value of every model: two aggregations."""
    shares = [(i + 1) / max_bins for i in range(max_bins - 1)]
    x = [F.nanvl(F.col(c).cast("double"), F.lit(None)) for c in features]
    got = df.agg(*[F.percentile_approx(c, shares, 10000).alias(f"c{j}") for j, c in enumerate(x)],
                 *[F.min(c).alias(f"a{j}") for j, c in enumerate(y)], *[F.max(c).alias(f"b{j}") for j, c in enumerate(y)]).first()
    cuts = [np.unique(np.array(got[f"c{j}"] or [], dtype=np.float64)) for j in range(len(features))]
    low = [got[f"a{j}"] or 0.0 for j in range(len(y))]
    unit = [((got[f"b{j}"] or 0.0) - low[j]) / STEPS or 1.0 for j in range(len(y))]
    steps = [F.round((c - F.lit(low[j])) / F.lit(unit[j])).cast("long") for j, c in enumerate(y)]
    sums = []
    for i, m in enumerate(models):
        j = targets.index(m.target)
        mine = F.when(_fitted_by(m), steps[j])
        sums += [F.sum(mine).alias(f"s{i}"), F.count(mine).alias(f"n{i}")]
    got = df.agg(*sums).first()
    base = [low[targets.index(m.target)] + unit[targets.index(m.target)] * (got[f"s{i}"] / got[f"n{i}"]) if got[f"n{i}"] else 0.0
            for i, m in enumerate(models)]
    return cuts, low, unit, base


def _binned(df, key_cols, features, y, holdouts, cuts, base):
    """``h, fit, held, y, bins, margin``: key hash, bits of the holdouts a row is fitted / evaluated for, targets, a byte per
    feature, a margin per model."""
    def bits(value):
        each = [F.when(F.col(c) == F.lit(value), F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, c in enumerate(holdouts)]
        total = F.lit(0).cast("long")
        for b in each:
            total = total.bitwiseOR(b)
        return total

    d = len(features)

    def cut(batches):
        for b in batches:
            bins = _bins([b.column(f"x{j}") for j in range(d)], cuts)
            margin = pa.ListArray.from_arrays(np.arange(b.num_rows + 1, dtype=np.int32) * len(base), np.tile(np.array(base), b.num_rows))
            yield pa.RecordBatch.from_arrays(
                [b.column("h"), b.column("fit"), b.column("held"), b.column("y"), _fixed(bins), margin],
                names=["h", "fit", "held", "y", "bins", "margin"])

    flat = df.select(F.xxhash64(*key_cols).alias("h"), bits(False).alias("fit"), bits(True).alias("held"), F.array(*y).alias("y"),
                     *[F.col(c).cast("double").alias(f"x{j}") for j, c in enumerate(features)])
    return flat.mapInArrow(cut, "h long, fit long, held long, y array<double>, bins binary, margin array<double>")


def _bins(columns, cuts):
    """A byte per row and feature: 0 for a missing value, else one more than the edges below the value."""
    out = np.zeros((len(columns[0]), len(columns)), dtype=np.uint8)
    for j, c in enumerate(columns):
        x = c.to_numpy(zero_copy_only=False).astype(np.float64)
        out[:, j] = np.where(np.isnan(x), 0, 1 + np.searchsorted(cuts[j], x, side="left"))
    return out


def _fixed(bins):
    n, d = bins.shape
    offsets = np.arange(n + 1, dtype=np.int32) * d
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(bins).tobytes())])


def _matrix(lists, width):
    """A list column whose rows all have ``width`` values, as a matrix (nulls: NaN)."""
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), width)


def _slices(batches, d, n_models):
    """h, fit, held, y, bins and margin of at most ROWS rows at a time."""
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            s = b.slice(at, ROWS)
            n = s.num_rows
            y = s.column("y")
            bins = np.frombuffer(b"".join(s.column("bins").to_pylist()), dtype=np.uint8).reshape(n, d)
            yield (s, s.column("h").to_numpy().astype(np.uint64), s.column("fit").to_numpy(), s.column("held").to_numpy(),
                   _matrix(y, len(y.flatten()) // n), bins, _matrix(s.column("margin"), n_models).copy())


# --- trees --------------------------------------------------------------------------------------


def _empty_tree(depth):
    n = (2 << depth) - 1
    used = np.zeros(n, dtype=bool)
    used[0] = True
    return {"depth": depth, "feature": np.full(n, -1, dtype=np.int32), "bin": np.zeros(n, dtype=np.int32),
            "missing_left": np.zeros(n, dtype=bool), "value": np.zeros(n), "used": used}


def _walk(tree, bins):
    """The node that each row reaches."""
    at = np.zeros(len(bins), dtype=np.int64)
    every = np.arange(len(bins))
    for _ in range(tree["depth"]):
        f = tree["feature"][at]
        inner = f >= 0
        if not inner.any():
            break
        b = bins[every, np.maximum(f, 0)]
        left = np.where(b == 0, tree["missing_left"][at], b <= tree["bin"][at])
        at = np.where(inner, 2 * at + 2 - left, at)
    return at


def _columns(model, round_no, features):
    """The columns drawn for a tree, ascending."""
    usable = np.array([j for j, f in enumerate(features) if f not in model.skip])
    n = max(1, int(model.colsample * len(usable)))
    return np.sort(np.random.default_rng([model.seed, round_no]).permutation(usable)[:n])


def _drawn(h, share, seed, round_no):
    """Rows drawn for a tree: a mixed hash of key, seed and round below the share."""
    if share >= 1:
        return np.ones(len(h), dtype=bool)
    x = h ^ np.uint64((seed * 0x9E3779B97F4A7C15 + (round_no + 1) * 0xD1B54A32D192ED03) % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x ^ (x >> np.uint64(31))) < np.uint64(int(share * (1 << 64)))


def _towards_zero(g, alpha):
    return np.sign(g) * np.maximum(np.abs(g) - alpha, 0.0)


def _worth(g, n, fact):
    return _towards_zero(g * fact["unit"], fact["alpha"]) ** 2 / (n + fact["reg_lambda"])


def _grow(tree, model, unit, nodes, found):
    """Put the best splits of a level into the tree; the nodes that may be split next."""
    nxt = []

    def leaf(g, n):
        return -float(_towards_zero(g * unit, model.alpha)) / (n + model.reg_lambda) * model.learning_rate if n else 0.0

    for node in nodes:
        if node not in found:
            continue
        s = found[node]
        if node == 0:
            tree["value"][0] = leaf(s["g"], s["n"])
        if s["feature"] < 0 or not s["gain"] > 0:
            continue
        tree["feature"][node], tree["bin"][node], tree["missing_left"][node] = s["feature"], s["bin"], s["missing_left"]
        for child, g, n in ((2 * node + 1, s["gl"], s["nl"]), (2 * node + 2, s["g"] - s["gl"], s["n"] - s["nl"])):
            tree["used"][child] = True
            tree["value"][child] = leaf(g, n)
            if n >= 2 * model.min_child_weight:
                nxt.append(child)
    return nxt


# --- a level --------------------------------------------------------------------------------------


def _level(rows, d, facts, recent, trees, todo, columns, measured, round_no, max_bins):
    """Best splits {model: {node: split}} of the open nodes, and {model: (train RMSE, held-out RMSE)} of measured models."""
    n_models, width = len(facts), max_bins + 1

    def sums(batches):
        hist = {i: np.zeros((2, len(nodes), len(columns[i]), width), dtype=np.int64) for i, nodes in todo.items()}
        err = {i: np.zeros((2, 2)) for i in measured}
        for _, h, fit_bits, held_bits, y, bins, margin in _slices(batches, d, n_models):
            for i in {*todo, *measured}:
                fact = facts[i]
                m = margin[:, i]
                for t in recent[i]:
                    m += t["value"][_walk(t, bins)]
                g = m - y[:, fact["y"]]
                known = ~np.isnan(g)
                bit = fact["bit"]
                mine = known if bit < 0 else known & ((fit_bits >> bit) & 1 == 1)
                if i in err:
                    held = np.zeros(len(g), dtype=bool) if bit < 0 else known & ((held_bits >> bit) & 1 == 1)
                    for k, part in enumerate((mine, held)):
                        err[i][k] += (g[part] ** 2).sum(), part.sum()
                if i not in todo:
                    continue
                place = np.full(len(trees[i]["used"]), -1)
                place[todo[i]] = np.arange(len(todo[i]))
                at = place[_walk(trees[i], bins)]
                take = np.flatnonzero(mine & (at >= 0) & _drawn(h, fact["subsample"], fact["seed"], round_no))
                if not len(take):
                    continue
                whole = np.rint(g[take] / fact["unit"])
                k = len(columns[i])
                cell = ((at[take][:, None] * k + np.arange(k)) * width + bins[take][:, columns[i]]).ravel()
                size = hist[i][0].size
                hist[i][0] += np.bincount(cell, np.repeat(whole, k), size).astype(np.int64).reshape(hist[i][0].shape)
                hist[i][1] += np.bincount(cell, minlength=size).reshape(hist[i][1].shape)
        for i, x in hist.items():
            node, f, b = np.nonzero(x[1])
            n = len(node)
            if n:
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(
                    (np.full(n, i), np.array(todo[i])[node], columns[i][f], b, x[0][node, f, b], x[1][node, f, b], np.zeros(n)), SUMS.types)],
                    schema=SUMS)
        for i, x in err.items():
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(
                ([i, i], [-1, -1], [0, 1], [0, 0], [0, 0], x[:, 1].astype(np.int64), x[:, 0]), SUMS.types)], schema=SUMS)

    def best(batches):
        got = pa.Table.from_batches(list(batches), SUMS)
        if not got.num_rows:
            return
        model, node, feature, b, g, n, e = (c.to_numpy() for c in got.columns)
        for j in np.flatnonzero(node < 0):  # errors pass through
            yield _splits([(model[j], -1, e[j], feature[j], 0, False, 0, 0, 0, n[j])])
        inner = node >= 0
        if not inner.any():
            return
        key, row = np.unique(np.stack([model[inner], node[inner], feature[inner]]), axis=1, return_inverse=True)
        G, N = np.zeros((2, key.shape[1], width), dtype=np.int64)
        G[row.ravel(), b[inner]], N[row.ravel(), b[inner]] = g[inner], n[inner]
        for i in np.unique(key[0]):
            of = key[0] == i
            yield _splits(_best(key[:, of], G[of], N[of], facts[i]))

    table = (rows.mapInArrow(sums, SUMS_DDL).repartition("model", "node", "feature").groupBy("model", "node", "feature", "bin")
             .agg(F.sum("g").alias("g"), F.sum("n").alias("n"), F.sum("e").alias("e")).mapInArrow(best, SPLITS_DDL).toArrow())
    found, errors = {}, {i: [None, None] for i in measured}
    for s in table.to_pylist():
        if s["node"] < 0:
            errors[s["model"]][s["feature"]] = (s["gain"] / s["n"]) ** 0.5 if s["n"] else None
            continue
        mine = found.setdefault(s["model"], {})
        old = mine.get(s["node"])
        if old is None or (s["gain"], -s["feature"]) > (old["gain"], -old["feature"]):
            mine[s["node"]] = s
    return found, errors


def _best(key, G, N, fact):
    """The best split of each node over the features of this task; feature -1 where none is allowed."""
    total_g, total_n = G.sum(axis=1, keepdims=True), N.sum(axis=1, keepdims=True)
    cg, cn = np.cumsum(G[:, 1:], axis=1), np.cumsum(N[:, 1:], axis=1)
    gl = np.stack([cg, cg + G[:, :1]], axis=2)  # missing values right, left
    nl = np.stack([cn, cn + N[:, :1]], axis=2)
    gr, nr = total_g[:, :, None] - gl, total_n[:, :, None] - nl
    gain = _worth(gl, nl, fact) + _worth(gr, nr, fact) - _worth(total_g, total_n, fact)[:, :, None]
    least = max(fact["min_child_weight"], 1)
    gain = np.where((nl >= least) & (nr >= least), gain, -np.inf).reshape(len(G), -1)
    at = gain.argmax(axis=1)
    top = gain[np.arange(len(G)), at]
    order = np.lexsort((key[2], -top, key[1]))
    first = order[np.unique(key[1][order], return_index=True)[1]]
    for j in first:
        b, left = divmod(int(at[j]), 2)
        allowed = np.isfinite(top[j])
        yield (key[0, j], key[1, j], top[j], key[2, j] if allowed else -1, b + 1, bool(left), gl[j, b, left], nl[j, b, left],
               total_g[j, 0], total_n[j, 0])


def _splits(rows):
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), SPLITS.types)], schema=SPLITS)


# --- stopping and state -----------------------------------------------------------------------------


def _groups(models):
    out: dict = {}
    for i, m in enumerate(models):
        out.setdefault(m.group or m.name, []).append(i)
    return out


def _best_round(out, members):
    """(best round, last round) by the mean held-out RMSE of a group; None without held-out rows."""
    names = {out.models[i].name for i in members}
    by_round: dict = {}
    for name, r, _, held in out.errors:
        if name in names and held is not None:
            by_round.setdefault(r, []).append(held)
    if not by_round:
        return None
    mean = {r: sum(v) / len(v) for r, v in by_round.items()}
    return min(mean, key=lambda r: (mean[r], r)), max(mean)


def _growing(out, early_stop):
    """The models that still grow."""
    live = []
    for members in _groups(out.models).values():
        best = _best_round(out, members) if early_stop is not None else None
        if best is None or best[1] - best[0] < early_stop:
            live += members
    return sorted(live)


def _keep_best(out):
    for members in _groups(out.models).values():
        best = _best_round(out, members)
        for i in members if best else []:
            out.trees[i] = out.trees[i][:best[0] + 1]


def _fresh():
    return uuid.uuid4().hex


def _write_state(spark, rows, state, settings, out, recent, round_no):
    """Margins with the trees grown since the last time, then these trees, then the line that makes both count."""
    d, n_models = len(out.features), len(out.models)

    def moved(batches):
        for s, _, _, _, _, bins, margin in _slices(batches, d, n_models):
            for i, grown in enumerate(recent):
                for t in grown:
                    margin[:, i] += t["value"][_walk(t, bins)]
            column = pa.ListArray.from_arrays(np.arange(s.num_rows + 1, dtype=np.int32) * n_models, margin.ravel())
            yield pa.RecordBatch.from_arrays([*[s.column(c) for c in ("h", "fit", "held", "y", "bins")], column],
                                             names=["h", "fit", "held", "y", "bins", "margin"])

    token = _fresh()
    paths = f"{state}/rows-{round_no}-{token}", f"{state}/nodes-{round_no}-{token}"
    rows.mapInArrow(moved, rows.schema).write.parquet(paths[0])
    nodes = [(i, len(out.trees[i]) - len(grown) + k, int(j), int(t["feature"][j]), int(t["bin"][j]), bool(t["missing_left"][j]), float(t["value"][j]))
             for i, grown in enumerate(recent) for k, t in enumerate(grown) for j in np.flatnonzero(t["used"])]
    spark.createDataFrame(nodes, NODES).coalesce(1).write.parquet(paths[1])
    spark.createDataFrame([(settings, round_no, *paths, json.dumps(out.errors))], DONE).coalesce(1).write.mode("append").parquet(f"{state}/done")
    rows.unpersist()
    return spark.read.parquet(paths[0]).persist(), [[] for _ in recent]


def _resumed(spark, state, settings, out):
    """Round and rows of the last written state of the same fit; trees and errors go into ``out``."""
    try:
        done = spark.read.schema(DONE).parquet(f"{state}/done").orderBy("round").collect()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0, None
    if any(r["settings"] != settings for r in done):
        raise ValueError("the state belongs to another fit (models, features or rows differ)")
    last = done[-1]
    grown: dict = {}
    for r in spark.read.schema(NODES).parquet(*[x["nodes"] for x in done]).collect():
        t = grown.setdefault((r["model"], r["tree"]), _empty_tree(out.models[r["model"]].max_depth))
        j = r["node"]
        t["feature"][j], t["bin"][j], t["missing_left"][j], t["value"][j], t["used"][j] = r["feature"], r["bin"], r["missing_left"], r["value"], True
    for (i, _), t in sorted(grown.items(), key=lambda x: x[0]):
        out.trees[i].append(t)
    out.errors += [tuple(x) for x in json.loads(last["errors"])]
    return last["round"], spark.read.parquet(last["rows"])


__all__ = ["Boost", "Boosted", "fit", "error_table", "MAX_BINS"]
