"""Embedding near-duplicates: spherical k-means cells, blocked cosines inside cells.

1. Equal vectors collapse in a grouped aggregation; a group of copies goes on as one row with a weight.
2. Spherical k-means is fitted on a sample.  Every vector gets its home cell and visits the cells whose
   boundary with its home is near.  How near is measured, not assumed: sample vectors are moved to the
   threshold in directions the data itself has (towards other vectors, towards vectors of the same
   cell) and in even noise, and the margin covers ``RECALL`` of each kind of move.
3. The number of cells is the square root of the number of vectors, or a half, a quarter ... of it where
   the sample says that visits would cost more than smaller cells save.
4. Cells are cut into blocks of ``BLOCK`` vectors; a pair of blocks is one group, so memory is bounded
   whatever the size of a cell.  A pair of vectors that meets in two cells counts in one of them; rows
   carry their home for that, and what a vector visits is computed again where it matters.
5. A group returns one row per vector with links (their number and a root), not one per pair.

With n vectors and v visits each the job compares n * sqrt(n) * (1 + v) pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .scratch import written
from .simhash import merge_labels

THRESHOLD = 0.95
#: Rows used to fit the centres (or ``ROWS_A_CELL`` for each cell if that is more), rows of a block, share of
#: measured moves that the margin covers.
SAMPLE_ROWS, ROWS_A_CELL, BLOCK, RECALL = 20_000, 8, 2048, 0.98
#: Sample vectors that are moved to measure the margin and the visits.
MOVED = 4000


def unit(column: pa.Array, dim: int | None = None) -> np.ndarray:
    """Rows of a list column in double precision with length one, over the first ``dim`` components.

    Shorter vectors count as padded with zeros.  Longer ones have length one over all their components,
    whatever ``dim`` is.  A row's result depends on that row alone, to the last bit.
    """
    size = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    dim = int(size.max(initial=0)) if dim is None else dim
    x = np.zeros((len(size), dim))
    if not len(flat):
        return x
    row = np.repeat(np.arange(len(size)), size)
    some, begin = np.flatnonzero(size), np.cumsum(size) - size
    scale = np.ones(len(size))
    scale[some] = np.maximum(np.maximum.reduceat(np.abs(flat), begin[some]), 1e-300)  # no overflow of squares
    flat = flat / scale[row]
    scale[some] = np.sqrt(np.add.reduceat(flat * flat, begin[some]))
    at = np.arange(len(flat)) - begin[row]
    inside = at < dim
    x[row[inside], at[inside]] = flat[inside] / np.maximum(scale[row[inside]], 1e-300)
    return x


def _nearest(x: np.ndarray, centres: np.ndarray, rows: int = 4096) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *((x[i:i + rows] @ centres.T).argmax(axis=1) for i in range(0, len(x), rows))])


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """``k`` unit centres of unit vectors; a centre without vectors stays where it is."""
    k = max(1, min(k, len(x)))
    centres = x[np.random.default_rng(seed).choice(len(x), k, replace=False)].copy() if len(x) else np.zeros((1, x.shape[1]))
    for _ in range(rounds if len(x) else 0):
        home = _nearest(x, centres)
        total = np.zeros_like(centres)
        np.add.at(total, home, x)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        centres = np.where(norm > 1e-12, total / np.maximum(norm, 1e-12), centres)
    return centres


def visits(x: np.ndarray, home: np.ndarray, centres: np.ndarray, cells: np.ndarray, margin: float) -> np.ndarray:
    """Which of ``cells`` each vector visits: those whose boundary with its home is at most ``margin`` away.

    The answer for a vector and a cell is the same in every call, whatever other rows and cells are asked
    for: matrix products may differ in their last bits, so close calls are settled by a plain sum.
    """
    own, there = centres[home], centres[cells]
    apart = np.sqrt(np.maximum(2 - 2 * (own @ there.T), 0))
    slack = margin * apart - ((x * own).sum(axis=1)[:, None] - x @ there.T)
    out = slack >= 0
    i, j = np.nonzero(np.abs(slack) < 1e-6)
    for s in range(0, len(i), BLOCK):
        a, b = own[i[s:s + BLOCK]], there[j[s:s + BLOCK]]
        gap = (x[i[s:s + BLOCK]] * (a - b)).sum(axis=1)
        out[i[s:s + BLOCK], j[s:s + BLOCK]] = gap <= margin * np.sqrt(((a - b) ** 2).sum(axis=1)) + 1e-12
    return out


def measured_margin(x: np.ndarray, centres: np.ndarray, threshold: float, recall: float, seed: int = 11) -> float:
    """The margin at which ``recall`` of the moves of each kind stay within reach of their start.

    A vector and its moved image at the threshold meet if one of them visits the other's home.  A distance
    is that from a vector to the boundary between its home and the other one.
    """
    if len(x) < 2 or len(centres) < 2:
        return 0.0
    rnd = np.random.default_rng(seed)
    start = x[rnd.choice(len(x), min(MOVED, len(x)), replace=False)]
    home, homes = _nearest(start, centres), _nearest(x, centres)
    order = np.argsort(homes, kind="stable")
    first, last = np.searchsorted(homes[order], home), np.searchsorted(homes[order], home, side="right")
    kinds = [rnd.standard_normal(start.shape), x[rnd.integers(len(x), size=len(start))],
             x[order[first + (rnd.random(len(start)) * (last - first)).astype(np.int64)]]]
    margins = [0.0]
    for towards in kinds:
        way = towards - (towards * start).sum(axis=1, keepdims=True) * start
        size = np.linalg.norm(way, axis=1, keepdims=True)
        some = size[:, 0] > 1e-9
        if not some.any():
            continue
        sign = rnd.choice([-1.0, 1.0], size=(int(some.sum()), 1))
        a, at = start[some], home[some]
        b = threshold * a + np.sqrt(max(1 - threshold**2, 0)) * sign * way[some] / size[some]
        to = _nearest(b, centres)
        line = centres[at] - centres[to]
        apart = np.maximum(np.linalg.norm(line, axis=1), 1e-12)
        far = np.where(at == to, 0, np.minimum((a * line).sum(axis=1), -(b * line).sum(axis=1)) / apart)
        margins.append(float(np.quantile(np.maximum(far, 0), recall)))
    return max(margins)


def fitted_cells(x: np.ndarray, n: int, threshold: float = THRESHOLD, recall: float = RECALL, cells: int | None = None) -> tuple[np.ndarray, float]:
    """Centres and margin; without ``cells`` as many as make comparing and shipping ``n`` vectors cheapest.

    Centres are fitted on one half of the sample, margin and visits measured on the other: vectors are
    nearer to centres fitted on them than others are.
    """
    best, (fit, x) = None, (x[::2], x[1::2] if len(x) > 1 else x)
    k = cells or max(1, round(n**0.5))
    while True:
        centres = spherical_kmeans(fit, k)
        margin = measured_margin(x, centres, threshold, recall)
        some = x[np.random.default_rng(13).choice(len(x), min(MOVED, len(x)), replace=False)] if len(x) else x
        seen = [visits(part, _nearest(part, centres), centres, np.arange(len(centres)), margin).sum()
                for part in (some[i:i + BLOCK] for i in range(0, len(some), BLOCK))]
        # a row is compared with its cells' vectors, and its copies are shipped once per block of these
        copies = float(sum(seen)) / max(len(some), 1)
        cost = copies * (n / len(centres) + BLOCK)
        if best is None or cost < best[0]:
            best = cost, centres, margin
        elif cost > 2 * best[0] or k == 1:
            return best[1:]
        if cells or k == 1:
            return best[1:]
        k = max(1, k // 2)


def cell_rows(classes: DataFrame, centres: np.ndarray, margin: float) -> DataFrame:
    """``cell, home, cid, copies, embedding``: a row for each cell a vector is in or visits."""
    def run(batches):
        every = np.arange(len(centres))
        step = max(1, min(BLOCK, (1 << 23) // len(centres)))  # the products of a step take a bounded part of memory
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                x = unit(part.column(2), centres.shape[1])
                home = _nearest(x, centres)
                there = visits(x, home, centres, every, margin)
                there[np.arange(len(home)), home] = True
                row, cell = np.nonzero(there)
                for cut in range(0, len(row), BLOCK):
                    take = pa.array(row[cut:cut + BLOCK])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cell[cut:cut + BLOCK].astype(np.int32)), pa.array(home[row[cut:cut + BLOCK]].astype(np.int32)),
                         part.column(0).take(take), part.column(1).take(take), part.column(2).take(take)],
                        names=["cell", "home", "cid", "copies", "embedding"])

    return classes.select("cid", "copies", "embedding").mapInArrow(run, "cell int, home int, cid long, copies long, embedding array<double>")


def block_pairs(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Rows dealt to groups ``cell, one, two, kind``: pairs of home blocks (0), home and visiting blocks (1).

    ``side`` says which block of the group a row is from.
    """
    visits = F.col("cell") != F.col("home")
    sizes = rows.groupBy("cell").agg(F.ceil(F.count(F.when(~visits, 1)) / F.lit(block)).cast("int").alias("homes"),
                                     F.ceil(F.count(F.when(visits, 1)) / F.lit(block)).cast("int").alias("guests"))
    # one row of three numbers per cell: the square root of the number of vectors
    dealt = rows.join(F.broadcast(sizes), "cell").filter("homes > 0")
    own = F.pmod(F.xxhash64("cid"), F.when(visits, F.col("guests")).otherwise(F.col("homes"))).cast("int")
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    homes = F.transform(upto(F.col("homes")), lambda i: F.struct(
        F.least(i, F.col("own")).alias("one"), F.greatest(i, F.col("own")).alias("two"), F.lit(0).alias("kind"), (F.col("own") > i).cast("int").alias("side")))
    guests = F.transform(upto(F.col("guests")), lambda i: F.struct(F.col("own").alias("one"), i.alias("two"), F.lit(1).alias("kind"), F.lit(0).alias("side")))
    visit = F.transform(upto(F.col("homes")), lambda i: F.struct(i.alias("one"), F.col("own").alias("two"), F.lit(1).alias("kind"), F.lit(1).alias("side")))
    groups = F.when(visits, visit).otherwise(F.concat(homes, guests))
    return (dealt.withColumn("own", own).withColumn("g", F.explode(groups))
            .select("cell", "g.one", "g.two", "g.kind", "g.side", "home", "cid", "copies", "embedding"))


def group_links(a: np.ndarray, b: np.ndarray | None, allowed, threshold: float, copies_a: np.ndarray, copies_b: np.ndarray):
    """Weighted link counts of both sides and a root for every row (index into a, then b)."""
    near = a @ (a if b is None else b).T >= threshold
    if b is None:
        np.fill_diagonal(near, False)
        count = near @ copies_a
        i, j = np.nonzero(np.triu(near))
        return count, merge_labels(np.arange(len(a)), i, j)
    if allowed is not None:
        near &= allowed()
    i, j = np.nonzero(near)
    return (np.concatenate([near @ copies_b, copies_a @ near]), merge_labels(np.arange(len(a) + len(b)), i, j + len(a)))


def links(classes: DataFrame, centres: np.ndarray, margin: float, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """``cid, links, root``: linked copies of each vector by group, and a vector it is linked to there."""
    order = ["cell", "one", "two", "kind"]

    def run(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            cuts = _cuts(held)
            for x, y in zip(cuts, cuts[1:]):  # the last group may go on
                yield from group(held.slice(x, y - x).combine_chunks())
            held = held.slice(cuts[-1])
        if held is not None and held.num_rows:
            yield from group(held.combine_chunks())

    def _cuts(table):
        if not table.num_rows:
            return [0]
        keys = [table.column(k).to_numpy() for k in order]
        return [0, *(np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1).tolist()]

    def group(table):
        col = {n: table.column(n).chunk(0) for n in table.column_names}
        side = col["side"].to_numpy()
        x, copies = unit(col["embedding"]), col["copies"].to_numpy()
        kind, same = col["kind"][0].as_py(), col["one"][0].as_py() == col["two"][0].as_py()
        if kind == 0 and same:
            order_, (count, label) = np.arange(len(x)), group_links(x, None, None, threshold, copies, copies)
        else:
            a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            if not len(a) or not len(b):
                return

            def allowed():
                """A guest counts here unless the pair counts in the guest's own cell, the smaller one."""
                cell, guest = col["cell"][0].as_py(), col["home"].to_numpy()[b]
                there = np.zeros((len(a), len(b)), bool)
                smaller = np.flatnonzero(guest < cell)
                if len(smaller):
                    homes, back = np.unique(guest[smaller], return_inverse=True)
                    own = unit(col["embedding"].take(pa.array(a)), centres.shape[1])
                    there[:, smaller] = visits(own, np.full(len(a), cell), centres, homes, margin)[:, back]
                return ~there

            order_ = np.concatenate([a, b])
            count, label = group_links(x[a], x[b], allowed if kind == 1 else None, threshold, copies[a], copies[b])
        some = np.flatnonzero(count)
        if len(some):
            cid = col["cid"].to_numpy()[order_]
            yield pa.RecordBatch.from_arrays([pa.array(cid[some]), pa.array(count[some].astype(np.int64)), pa.array(cid[label[some]])],
                                             names=["cid", "links", "root"])

    rows = block_pairs(cell_rows(classes, centres, margin), block)
    return rows.repartition(*order).sortWithinPartitions(*order).mapInArrow(run, "cid long, links long, root long")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD,
                    sample_rows: int = SAMPLE_ROWS, recall: float = RECALL, block: int = BLOCK, cells: int | None = None) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row.

    Cosines are of double components, and shorter vectors count as padded with zeros.  No pair below the
    threshold is linked; pairs over it are found with ``recall`` or more, as measured on moved sample
    vectors.  An empty table gives no rows.  Vectors that are null, empty, zero or hold a null or non-finite component link with nothing.  Repeated
    rows are rows of their own, linked with one another.  A null id is never a component's name; a row
    without id is kept only if its whole component has none.  Other columns are ignored.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("embedding"))
    fine = (F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
            & F.exists("embedding", lambda v: v != 0))
    rows = rows.withColumn("ok", F.coalesce(fine, F.lit(False)))
    classes, _ = written(rows.filter("ok").groupBy("embedding").agg(F.min("vec_id").alias("low"), F.count("*").alias("copies"))
                         .withColumn("cid", F.monotonically_increasing_id()), "vectors")
    n = classes.count()
    sample = classes.orderBy(F.xxhash64("embedding"), "cid").limit(max(sample_rows, ROWS_A_CELL * (cells or round(n**0.5)))).select("embedding").toArrow().column(0).combine_chunks()
    sample = sample if isinstance(sample, pa.Array) else pa.concat_arrays(sample.chunks) if sample.num_chunks else pa.array([], pa.list_(pa.float64()))
    # most vectors have one length; cells look no further than that, cosines do
    usual = int(np.bincount(sample.value_lengths().to_numpy(zero_copy_only=False)).argmax()) if len(sample) else 0
    centres, margin = fitted_cells(unit(sample, usual), n, threshold, recall, cells)
    found, _ = written(links(classes, centres, margin, threshold, block), "links")
    total = found.groupBy("cid").agg(F.sum("links").alias("links"))
    nodes = connected_components(found, "cid", "root")
    named = (classes.join(nodes, classes["cid"] == nodes["node"], "left")
             .select("cid", "embedding", "low", "copies", F.coalesce("component", "cid").alias("component")))
    lows = named.groupBy("component").agg(F.min("low").alias("component_id"))
    done = (named.join(lows, "component").join(total, "cid", "left")
            .select("embedding", "component_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))
    linked = rows.filter("ok").select("vec_id", "embedding").join(done, "embedding").select("vec_id", "n_links", "component_id")
    alone = rows.filter(~F.col("ok")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
