"""Exact nearest neighbours of a table of queries in a table of vectors.

Two ways, same answer. The query table's size is checked first:

* It fits the bound: its matrix is broadcast and every task keeps the k best of its own
  vectors per query, so at most k rows per query and task are shuffled. A stored index is searched in
  two passes, some of its buckets first: the k-th distance found there is no less than the final one,
  and only vectors within it leave the tasks of the second pass.
* It does not: both sides are divided into cells around pivot vectors, on two levels. A query searches its
  own cell first; distance bounds then leave it only the upper cells, and of these the cells, that can
  still hold one of its neighbours (after Lu et al., "Efficient processing of k nearest neighbor joins using
  MapReduce", VLDB 2012). Neighbouring cells make up blocks of bounded size on both sides, large cells are split;
  a pair of blocks meets if some of its queries may have a neighbour there, so that a vector is sent once
  for each block of queries, not each query to each cell. A task has one block of queries and streams the vectors of
  several blocks past it, its limits shrinking.

Neighbours are ordered by distance rounded to `DIGITS` digits, then by key.
"""

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow.session import materialize

DIGITS = 6
TOLERANCE = 10.0**-DIGITS

# The broadcast bound: at most this many queries, a matrix of at most this many bytes, and at
# most this many hits (they are broadcast to fetch their metadata).
MAX_BROADCAST_QUERIES = 50_000
MAX_BROADCAST_BYTES = 64 << 20
MAX_BROADCAST_HITS = 1_000_000

# Of a stored index, one bucket in so many is searched first.
FIRST_SHARE = 32

# Cells for each vector's root; bytes of pivots that every task holds; bytes of vectors that one task
# holds of either side (on average, blocks being made by hash): with copies and hits some eight times as much.
CELL_ROOTS = 0.25
PIVOT_BYTES = 64 << 20
BLOCK_BYTES = 32 << 20

# Blocks of vectors at most that a task compares with its block of queries.
GROUP_BLOCKS = 16

# Rows of either side compared at a time.
TILE = 512


def knn(
    queries: DataFrame,
    vectors: DataFrame,
    k: int = 5,
    metric: str = "cosine",
    *,
    dim: int,
    metadata: list[str] | None = None,
    max_distance: float | None = None,
    enabled: bool = True,
    max_broadcast_queries: int = MAX_BROADCAST_QUERIES,
    n_cells: int | None = None,
    first_share: int = FIRST_SHARE,
    fetch: Callable[[DataFrame, list[str]], DataFrame] | None = None,
) -> DataFrame:
    """The k nearest vectors per query: query_id, raw_rank (from 1), key, distance, metadata.

    `queries` has a unique query_id and an embedding, `vectors` a unique key, an embedding
    and the metadata columns, vectors of `dim` components. A query without a usable vector (missing, wrong size, of no
    direction under cosine) has no hits; so has every query when `enabled` is False.
    `max_distance` drops hits farther away. `fetch` gives the metadata of keys (as `open_index` has it);
    without it they are joined from `vectors`.
    """
    if metric not in ("cosine", "euclidean"):
        raise ValueError("metric is cosine or euclidean")
    metadata = [c for c in metadata or [] if c != "key"]
    # A stored index is partitioned by `bucket`; carrying it lets the join back prune.
    locator = ["key"] + (["bucket"] if "bucket" in vectors.columns else [])
    # Unusable vectors are left out inside the tasks: a filter here would make Spark compute
    # an embedding column twice, once for the filter.
    asked = queries.filter(F.lit(enabled)).select("query_id", as_floats("embedding"))
    stored = vectors.filter(F.lit(enabled)).select(*locator, as_floats("embedding"))

    bound = min(max_broadcast_queries, MAX_BROADCAST_HITS // k, MAX_BROADCAST_BYTES // (8 * max(dim, 1)))
    sample = asked.limit(bound + 1).toArrow()
    small = sample.num_rows <= bound
    # Nothing farther is looked for, whichever way.
    farthest = np.inf if max_distance is None else max(float(max_distance), 0.0)
    if small:
        candidates = _broadcast_search(sample, stored, asked.schema["query_id"], k, metric, dim, farthest, first_share)
    else:
        candidates = _cell_search(asked, stored, k, metric, dim, n_cells, farthest)

    hits = _k_best(candidates, k)
    if max_distance is not None:
        hits = hits.filter(F.col("distance") <= max_distance)
    if metadata and fetch is not None:
        # Written once: the keys are asked for, and the hits joined to what is found.
        hits = materialize(hits.drop("bucket"), "knn-hits")
        hits = hits.join(fetch(hits.select("key").distinct(), metadata), "key")
    elif metadata:
        # At most k rows per broadcast query, so a bounded side again.
        near = F.broadcast(hits) if small else hits
        hits = vectors.select(*locator, *metadata).join(near, locator)
    return hits.select("query_id", "raw_rank", "key", "distance", *metadata)


def _k_best(candidates: DataFrame, k: int) -> DataFrame:
    nearest = Window.partitionBy("query_id").orderBy("distance", "key")
    return candidates.withColumn("raw_rank", F.row_number().over(nearest)).filter(F.col("raw_rank") <= k)


def as_floats(name: str) -> Column:
    return F.col(name).cast(T.ArrayType(T.FloatType())).alias(name)


# ---------------------------------------------------------------- inside tasks


def _scaled(column, metric: str, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, float64 matrix) of the usable vectors; of unit length for cosine."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    keep = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(column), dim), False).to_numpy(zero_copy_only=False))
    if len(keep) < len(column):
        column = column.take(pa.array(keep))
    rows = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype("float64")
    usable = np.isfinite(rows).all(axis=1)
    if metric == "cosine":
        norm = np.sqrt(np.einsum("ij,ij->i", rows, rows))
        usable &= norm > 0
        return keep[usable], rows[usable] / norm[usable, None]
    return keep[usable], rows[usable]


def _gaps(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Rounded distances between paired rows."""
    if metric == "cosine":
        d = 1.0 - np.einsum("ij,ij->i", a, b)
    else:
        d = np.sqrt(np.einsum("ij,ij->i", a - b, a - b))
    return np.round(d, DIGITS) + 0.0


def _ranks(groups: np.ndarray) -> np.ndarray:
    """Position of each row inside its run of equal, sorted group numbers."""
    return np.arange(len(groups)) - np.searchsorted(groups, groups, "left")


def _few_copies(v: np.ndarray, k: int) -> np.ndarray:
    """Positions of the rows without those that repeat k earlier rows: copies are equally far
    from any query, so only the first k can be among its nearest."""
    if len(np.unique(v[:, 0])) > 0.9 * len(v):
        return np.arange(len(v))
    rows = np.ascontiguousarray(v).view(np.dtype((np.void, v.itemsize * v.shape[1]))).ravel()
    group = np.unique(rows, return_inverse=True)[1].ravel()
    order = np.argsort(group, kind="stable")
    return np.sort(order[_ranks(group[order]) < k])


def _comparison(q: np.ndarray, v: np.ndarray, metric: str):
    """Matrices a, b and functions such that the entries of a @ b.T order a query's vectors by
    nearness: `bar(limit)` is the least entry of a vector that may be within the limit, and
    `reach(entries)` a distance within which the vectors of these entries certainly are. The last columns are
    0 and 1: with a row's bar, negative, in place of the 0 what passes is not negative.

    Cosine is compared in single precision; the worst error of the product is allowed for, and
    what passes is measured again in double. Bars are cut off below every entry, so that they are finite.
    """
    dim = q.shape[1]
    if metric == "cosine":
        slack = 2 * TOLERANCE + (dim + 4) * 1.2e-7
        return (
            np.column_stack([q, np.zeros(len(q))]).astype("float32"), np.column_stack([v, np.ones(len(v))]).astype("float32"),
            lambda limit, at: np.maximum(1.0 - limit - slack, -1.5).astype("float32"),
            lambda entries, at: 1.0 - entries + slack,
        )
    qq, vv = np.einsum("ij,ij->i", q, q), np.einsum("ij,ij->i", v, v)
    most = qq.max(initial=0.0) + vv.max(initial=0.0)
    error = (dim + 8) * 9e-16 * (most + 1.0)
    return (
        np.column_stack([q, np.ones(len(q)), np.zeros(len(q))]), np.column_stack([v, -vv / 2, np.ones(len(v))]),
        lambda limit, at: np.maximum((qq[at] - (limit + 2 * TOLERANCE) ** 2) / 2 - error, -most - 1.0),
        lambda entries, at: np.sqrt(np.maximum(qq[at] - 2 * (entries - error), 0.0)) + TOLERANCE,
    )


def _nearest(q: np.ndarray, v: np.ndarray, k: int, metric: str, limit: np.ndarray):
    """(query row, vector row, distance) of each query's k best within `limit`.

    Vector rows are in key order, so equal distances keep the smaller key. Works in tiles that
    stay in the processor's cache; a query's limit shrinks as its k-th best is found. Of a tile, where
    hardly any entry passes, only the rows that have one are looked through.
    """
    some = _few_copies(v, k)
    v = v[some]
    a, b, bar, reach = _comparison(q, v, metric)
    space, passes = np.empty((TILE, TILE), a.dtype), np.empty((TILE, TILE), bool)
    found = []
    for at in range(0, len(q), TILE):
        tile = slice(at, min(at + TILE, len(q)))
        own, worst = a[tile], limit[tile].copy()
        best = (np.empty(0, int), np.empty(0, int), np.empty(0))
        waiting, n = [], 0
        for start in range(0, len(v), TILE):
            other = b[start : start + TILE]
            entries = np.matmul(own, other.T, out=space.ravel()[: len(own) * len(other)].reshape(len(own), -1))
            if not start:
                least = bar(worst, tile)
                if np.count_nonzero(entries >= least[:, None]) > k * len(own) and len(other) > k:
                    kth = np.partition(entries, -k, axis=1)[:, -k].astype("float64")
                    worst = np.minimum(worst, reach(kth, tile))
                    least = bar(worst, tile)
                entries -= least[:, None]
                own[:, -1] = -least
            over = np.greater_equal(entries, 0, out=passes.ravel()[: entries.size].reshape(entries.shape))
            rows = np.flatnonzero(over.any(axis=1))
            if len(rows):
                qi, vi = np.nonzero(over[rows])
                waiting.append((rows[qi], vi + start))
                n += len(qi)
            if n > 2 * k * len(own) or waiting and start + TILE >= len(v):
                best = _best(best, waiting, q[tile], v, k, metric)
                last = _ranks(best[0]) == k - 1
                worst[best[0][last]] = np.minimum(worst[best[0][last]], best[2][last])
                own[:, -1], waiting, n = -bar(worst, tile), [], 0
        found.append((best[0] + at, some[best[1]], best[2]))
    if not found:
        return np.empty(0, int), np.empty(0, int), np.empty(0)
    return tuple(np.concatenate(x) for x in zip(*found))


def _best(best, waiting, q: np.ndarray, v: np.ndarray, k: int, metric: str):
    """The k best per query of the best so far and of the waiting pairs, measured exactly."""
    parts = [best]
    for qi, vi in waiting:
        for s in range(0, len(qi), 50_000):
            e = s + 50_000
            parts.append((qi[s:e], vi[s:e], _gaps(q[qi[s:e]], v[vi[s:e]], metric)))
    qi, vi, d = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((vi, d, qi))
    order = order[_ranks(qi[order]) < k]
    return qi[order], vi[order], d[order]


def _by_key(table: pa.Table) -> pa.Table:
    return table.take(pc.sort_indices(table["key"]))


class _Kept:
    """The k best so far of each query, of vectors that come a table at a time; `limit` shrinks with them."""

    def __init__(self, ids, q: np.ndarray, limit: np.ndarray, k: int, metric: str, names: list[str]):
        self.ids, self.q, self.limit, self.k, self.metric, self.names = ids, q, limit.copy(), k, metric, names
        self.table, self.waiting = None, 0

    def see(self, table: pa.Table, rows: np.ndarray, v: np.ndarray, some: np.ndarray | None = None) -> None:
        """Compare `v`, the vectors in these rows of a table in key order, with the queries, or with some of them."""
        if some is None or len(some) == len(self.q):
            qi, vi, d = _nearest(self.q, v, self.k, self.metric, self.limit)
        else:
            qi, vi, d = _nearest(self.q[some], v, self.k, self.metric, self.limit[some])
            qi = some[qi]
        if not len(qi):
            return
        part = table.select(self.names).take(pa.array(rows[vi]))
        part = part.append_column("_q", pa.array(qi)).append_column("distance", pa.array(d))
        self.table = part if self.table is None else pa.concat_tables([self.table, part])
        self.waiting += len(qi)
        if 2 * self.waiting >= self.k * len(self.q):
            self._cut()

    def _cut(self) -> None:
        qi, d = self.table["_q"].to_numpy(), self.table["distance"].to_numpy()
        order = np.lexsort((d, qi))
        same = (np.diff(qi[order]) == 0) & (np.diff(d[order]) == 0)
        tied = np.flatnonzero(np.append(same, False) | np.append(False, same))
        if len(tied):  # by key, which is looked at for these alone
            at = order[tied]
            by_key = pc.sort_indices(self.table["key"].take(pa.array(at))).to_numpy()
            place = np.empty(len(at), int)
            place[by_key] = np.arange(len(at))
            order[tied] = at[np.lexsort((place, d[at], qi[at]))]
        rank = _ranks(qi[order])
        last = order[rank == self.k - 1]
        self.limit[qi[last]] = np.minimum(self.limit[qi[last]], d[last])
        self.table, self.waiting = self.table.take(pa.array(order[rank < self.k])), 0

    def batches(self) -> Iterator[pa.RecordBatch]:
        """query_id, distance and the named columns of what is kept."""
        if self.table is not None:
            self._cut()
            ids = self.ids.take(self.table["_q"].combine_chunks())
            out = [ids, self.table["distance"], *(self.table[n] for n in self.names)]
            yield from pa.table(out, names=["query_id", "distance", *self.names]).to_batches(max_chunksize=50_000)


# ---------------------------------------------------------------- queries broadcast


def _broadcast_search(
    sample: pa.Table, stored: DataFrame, asked_id: T.StructField, k: int, metric: str, dim: int, farthest: float, first_share: int
):
    keep, q = _scaled(sample["embedding"], metric, dim)
    ids = sample["query_id"].combine_chunks().take(pa.array(keep))
    limit = np.full(len(q), farthest)
    if "bucket" not in stored.columns or first_share < 2:
        return _search_within(ids, q, limit, stored, asked_id, k, metric, dim)
    # By the partition column, so that no file is read in both passes.
    is_first = F.coalesce(F.pmod("bucket", F.lit(first_share)) == 0, F.lit(True))
    found = _search_within(ids, q, limit, stored.filter(is_first), asked_id, k, metric, dim)
    first = materialize(_k_best(found, k), "knn-first")
    # At most one number for each of the broadcast queries.
    kth = first.filter(F.col("raw_rank") == k).select("query_id", "distance").toArrow()
    at = pc.index_in(kth["query_id"], value_set=ids).to_numpy()
    limit[at] = np.minimum(limit[at], kth["distance"].to_numpy())
    rest = _search_within(ids, q, limit, stored.filter(~is_first), asked_id, k, metric, dim)
    return first.drop("raw_rank").unionByName(rest)


def _search_within(ids, q: np.ndarray, limits: np.ndarray, stored: DataFrame, asked_id: T.StructField, k: int, metric: str, dim: int):
    """Each task's k best vectors of every query, those beyond the query's limit left out."""
    shared = stored.sparkSession.sparkContext.broadcast((ids, q, limits))
    locator = [f for f in stored.schema if f.name != "embedding"]
    schema = T.StructType(
        [asked_id, T.StructField("distance", T.DoubleType()), *locator]
    )
    names = [f.name for f in locator]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q, limits = shared.value
        kept = _Kept(ids, q, limits, k, metric, names)
        for batch in batches:
            if not len(q) or not batch.num_rows:
                continue
            table = _by_key(pa.Table.from_batches([batch]))
            kept.see(table, *_scaled(table["embedding"], metric, dim))
        yield from kept.batches()

    return stored.mapInArrow(search, schema)


# ---------------------------------------------------------------- both sides large


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :]
    return np.sqrt(np.maximum(square - 2.0 * (a @ b.T), 0.0))


class _Level:
    """Pivots next to each other, and between which distances of its pivot a cell's vectors lie."""

    def __init__(self, pivots: np.ndarray):
        self.pivots, self.between = pivots, _distances(pivots, pivots)

    def bound(self, size: np.ndarray, low: np.ndarray, high: np.ndarray, homes: np.ndarray) -> None:
        self.used, self.low, self.high, self.homes = size > 0, low, high, homes

    def floors(self, gaps: np.ndarray, scale: float, some=slice(None)) -> np.ndarray:
        """The least distance at which each cell's vectors can be, or those of some cells, from distances to the pivots.

        They lie between the cell's radii, and on its side of the plane midway between its pivot and the
        query's nearest one."""
        near, least = gaps.argmin(axis=1), gaps.min(axis=1)[:, None]
        across, gaps = self.between[:, some][near], gaps[:, some]
        plane = (gaps**2 - least**2) / np.where(across > 0, 2 * across, 1.0)
        ring = np.maximum(gaps - self.high[some], self.low[some] - gaps)
        return np.where(self.used[some], np.maximum(ring, np.where(across > 1e-2 * scale, plane, 0.0)), np.inf)


class _Cells:
    """Cells around pivots on two levels. A vector belongs to the nearest upper pivot, and of the pivots
    that this is nearest to, to the nearest: some twice the root of their number are compared with it."""

    def __init__(self, pivots: np.ndarray):
        upper = pivots[:: max(1, math.isqrt(len(pivots)))]
        # Equal up to rounding, an upper pivot may have nothing below it.
        upper = upper[np.unique(_distances(pivots, upper).argmin(axis=1))]
        group = _distances(pivots, upper).argmin(axis=1)
        pivots = pivots[np.argsort(group, kind="stable")]
        self.starts = np.searchsorted(np.sort(group), np.arange(len(upper) + 1))
        self.upper, self.n = _Level(upper), len(pivots)
        self.lower = [_Level(pivots[s:e]) for s, e in zip(self.starts, self.starts[1:])]
        self.scale = max(1.0, float(np.abs(pivots).max()))

    def bound(self, extent: list, k: int) -> None:
        """Take in the extent of each cell: cell, n, least and greatest distance of its pivot (a, b) and of the upper one (c, d)."""
        self.size = np.zeros(self.n, "int64")
        low, high = np.full((2, self.n), np.inf), np.full((2, self.n), -np.inf)
        for row in extent:
            self.size[row.cell] = row.n
            low[:, row.cell], high[:, row.cell] = (row.a, row.c), (row.b, row.d)
        homes = self.size >= min(k, self.size.max(initial=0))
        for level, s, e in zip(self.lower, self.starts, self.starts[1:]):
            level.bound(self.size[s:e], low[0, s:e], high[0, s:e], homes[s:e])
        over = lambda ufunc, x: ufunc.reduceat(x, self.starts[:-1])
        self.upper.bound(over(np.add, self.size), over(np.minimum, low[1]), over(np.maximum, high[1]), over(np.logical_or, homes))
        self.scale = max(self.scale, float(high.max()))

    def nearest(self, rows: np.ndarray, homes: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cell, distance of its pivot, distance of its upper pivot) of each row; homes: of the cells that have k vectors."""
        gaps = _distances(rows, self.upper.pivots)
        top = (np.where(self.upper.homes, gaps, np.inf) if homes else gaps).argmin(axis=1)
        cell, radius = np.zeros(len(rows), "int32"), np.zeros(len(rows))
        for t in np.unique(top):
            at = np.flatnonzero(top == t)
            below = _distances(rows[at], self.lower[t].pivots)
            best = (np.where(self.lower[t].homes, below, np.inf) if homes else below).argmin(axis=1)
            cell[at], radius[at] = self.starts[t] + best, below[np.arange(len(at)), best]
        return cell, radius, gaps[np.arange(len(rows)), top]

    def wide(self, within: np.ndarray) -> np.ndarray:
        """Distances with an allowance for rounded ones and for the arithmetic."""
        return within + 1e-6 * self.scale + TOLERANCE

    def reached(self, rows: np.ndarray, within: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """By upper cell: its number, rows, and for each of them which cells may hold a vector within its distance."""
        within = self.wide(within)
        go = self.upper.floors(_distances(rows, self.upper.pivots), self.scale) <= within[:, None]
        for t in np.flatnonzero(go.any(axis=0)):
            at = np.flatnonzero(go[:, t])
            yield t, at, self.lower[t].floors(_distances(rows[at], self.lower[t].pivots), self.scale) <= within[at, None]

    def visits(self, rows: np.ndarray, within: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of every cell that may hold a vector within a row's distance."""
        found = [(np.empty(0, int), np.empty(0, int))]
        for t, at, go in self.reached(rows, within):
            qi, cell = np.nonzero(go)
            found.append((at[qi], self.starts[t] + cell))
        return tuple(np.concatenate(x) for x in zip(*found))


class _Near:
    """Which queries of a block may have a neighbour in cells that come one after the other, below the same upper cell mostly."""

    def __init__(self, cells: _Cells, q: np.ndarray):
        self.cells, self.q = cells, q
        self.upper, self.t, self.lower = _distances(q, cells.upper.pivots), None, None

    def rows(self, t: int, own: np.ndarray, within: np.ndarray) -> np.ndarray:
        """Queries that may have one within their distance in one of the cells `own` below upper cell t."""
        cells, within = self.cells, self.cells.wide(within)
        if t != self.t:
            self.t, self.lower = t, _distances(self.q, cells.lower[t].pivots)
        at = np.flatnonzero(cells.upper.floors(self.upper, cells.scale, [t])[:, 0] <= within)
        floors = cells.lower[t].floors(self.lower[at], cells.scale, own - cells.starts[t])
        return at[(floors <= within[at, None]).any(axis=1)]


def _pivots(stored: DataFrame, n_cells: int | None, metric: str, dim: int) -> np.ndarray:
    """About `n_cells` vectors, picked by a hash of the key. Any pivots give right results."""
    n = stored.count()
    n_cells = min(n_cells or 1 + int(CELL_ROOTS * n**0.5), 1 + PIVOT_BYTES // (8 * dim))
    one_in = max(1, n // n_cells)
    picked = stored.filter(F.pmod(F.xxhash64("key"), F.lit(one_in)) == 0).select("embedding").toArrow()
    pivots = np.unique(_scaled(picked["embedding"], metric, dim)[1], axis=0) if picked.num_rows else np.empty((0, dim))
    return pivots if len(pivots) else np.zeros((1, dim))


def _cell_search(
    asked: DataFrame, stored: DataFrame, k: int, metric: str, dim: int, n_cells: int | None, farthest: float
):
    """Search each query's home cell first; the k-th distance found there bounds the rest."""
    # Written once: the vectors may be an embedder's, which is run for the pivots and the placement together.
    stored = materialize(stored, "knn-vectors")
    cells = _Cells(_pivots(stored, n_cells, metric, dim))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, v = _scaled(batch["embedding"], metric, dim)
            if len(rows):
                out = pa.Table.from_batches([batch]).take(pa.array(rows))
                for name, values in zip(("cell", "radius", "upper"), cells.nearest(v)):
                    out = out.append_column(name, pa.array(values))
                yield from out.to_batches()

    # Written once: the bounds must describe the very placement that is searched.
    placed_schema = _plus(stored.schema, cell=T.IntegerType(), radius=T.DoubleType(), upper=T.DoubleType())
    placed = materialize(stored.mapInArrow(place, placed_schema), "knn-cells")
    # One row per cell.
    ends = [f(c).alias(n) for n, f, c in (("a", F.min, "radius"), ("b", F.max, "radius"), ("c", F.min, "upper"), ("d", F.max, "upper"))]
    cells.bound(placed.groupBy("cell").agg(F.count("*").alias("n"), *ends).collect(), k)
    placed = placed.drop("radius", "upper")

    def go_home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, q = _scaled(batch["embedding"], metric, dim)
            out = pa.Table.from_batches([batch]).take(pa.array(rows))
            yield from out.append_column("home", pa.array(cells.nearest(q, True)[0])).to_batches()

    asked = materialize(asked.mapInArrow(go_home, _plus(asked.schema, home=T.IntegerType())), "knn-queries")
    at_home = asked.select("query_id", "embedding", F.col("home").alias("cell"), F.lit(float(farthest)).alias("limit"))
    first = _k_best(_visit(at_home, placed, cells.size, k, metric, dim), k)
    # Written once, without vectors or keys.
    reached = materialize(first.filter(F.col("raw_rank") == k).select(F.col("query_id").alias("_id"), F.col("distance").alias("limit")), "knn-home")
    bounded = asked.join(reached, F.col("query_id").eqNullSafe(F.col("_id")), "left").drop("_id")
    bounded = bounded.withColumn("limit", F.coalesce("limit", F.lit(float(farthest))))
    return _meet(bounded, placed, cells, k, metric, dim)


def _blocks(size: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(first block, number of blocks) of each cell: neighbouring cells share a block of up to `rows`, larger cells have several."""
    first, parts = np.zeros(len(size), "int64"), np.maximum(1, -(-size // rows))
    at = held = 0
    for c, n in enumerate(size):
        if held and held + n > rows:
            at, held = at + 1, 0
        first[c], held = at, held + n
        if parts[c] > 1:
            at, held = at + parts[c], 0
    return first, parts


def _in_blocks(df: DataFrame, cell: str, key: str, out: str, blocks: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Adds the block of each row, by its cell and a hash of its key."""
    table = df.sparkSession.createDataFrame([(c, int(a), int(n)) for c, (a, n) in enumerate(zip(*blocks))], f"{cell} int, _first int, _parts int")
    block = (F.col("_first") + F.pmod(F.xxhash64(key), F.col("_parts"))).cast("int")
    return df.join(F.broadcast(table), cell).withColumn(out, block).drop("_first", "_parts")


def _meet(bounded: DataFrame, placed: DataFrame, cells: _Cells, k: int, metric: str, dim: int) -> DataFrame:
    """Each query's k best within its limit, of every pair of blocks that may hold some."""
    # Blocks of a small table are smaller, so that there are some pairs for every core.
    least = math.ceil((4 * bounded.sparkSession.sparkContext.defaultParallelism) ** 0.5)
    rows = lambda size: max(1, min(BLOCK_BYTES // (8 * dim), -(-int(size.sum()) // least)))
    homes = np.zeros(cells.n, "int64")
    for r in bounded.groupBy("home").count().collect():  # one row per cell
        homes[r.home] = r["count"]
    v_blocks = _blocks(cells.size, rows(cells.size))
    queries = _in_blocks(bounded, "home", "query_id", "q_block", _blocks(homes, rows(homes))).drop("home")
    vectors = _in_blocks(placed, "cell", "key", "v_block", v_blocks)

    reach = lambda limit: np.sqrt(2.0 * limit + 4 * TOLERANCE) if metric == "cosine" else limit

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, q = _scaled(batch["embedding"], metric, dim)
            own, limit = batch["q_block"].to_numpy()[rows].astype("int64"), batch["limit"].to_numpy()[rows]
            order = np.argsort(own, kind="stable")
            for s in range(0, len(order), 2000):
                some = order[s : s + 2000]
                found = []
                for t, at, go in cells.reached(q[some], reach(limit[some])):
                    block, begin = np.unique(own[some[at]], return_index=True)
                    i, cell = np.nonzero(np.logical_or.reduceat(go, begin, axis=0))
                    found.append(block[i] * cells.n + cells.starts[t] + cell)
                pair = np.unique(np.concatenate([np.empty(0, "int64"), *found]))
                block, cell = pair // cells.n, pair % cells.n
                n = v_blocks[1][cell]
                to = np.repeat(v_blocks[0][cell], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                pair = np.unique(np.stack([np.repeat(block, n), to]), axis=1).astype("int32")
                yield pa.record_batch([pa.array(pair[0]), pa.array(pair[1])], names=["q_block", "v_block"])

    routes = materialize(queries.mapInArrow(route, "q_block int, v_block int").distinct(), "knn-routes")
    n_groups, q_groups, v_groups = _groups(routes)
    locator = [f for f in placed.schema if f.name not in ("embedding", "cell")]
    names = [f.name for f in locator]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, asked, kept, near = None, [], None, None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            of, cell = table["group"].to_numpy(), table["cell"].to_numpy()
            ends = np.flatnonzero(np.diff(of)) + 1
            for s, e in zip([0, *ends], [*ends, len(of)]):
                if s == e:
                    continue
                if of[s] != group:
                    if kept:
                        yield from kept.batches()
                    group, asked, kept = of[s], [], None
                first = s + int(np.searchsorted(cell[s:e], 0))  # queries have the cell -1
                if first > s:
                    asked.append(table.slice(s, first - s))
                if first == e or not asked:
                    continue
                if kept is None:
                    left = pa.concat_tables(asked)
                    rows, q = _scaled(left["embedding"], metric, dim)
                    ids = left["query_id"].combine_chunks().take(pa.array(rows))
                    kept, near = _Kept(ids, q, left["limit"].to_numpy()[rows], k, metric, names), _Near(cells, q)
                right = _by_key(table.slice(first, e - first))
                rows, v = _scaled(right["embedding"], metric, dim)
                home = right["cell"].to_numpy()[rows]
                upper = np.searchsorted(cells.starts, home, "right") - 1
                for t in np.unique(upper):
                    at = np.flatnonzero(upper == t)
                    some = near.rows(t, np.unique(home[at]), reach(kept.limit))
                    if len(some):
                        kept.see(right, rows[at], v[at], some)
        if kept:
            yield from kept.batches()

    # One side's columns are null in the other's rows; a group's queries come first, then its vectors cell by cell.
    nothing = lambda fields: [F.lit(None).cast(f.dataType).alias(f.name) for f in fields]
    q_only = [bounded.schema["query_id"], bounded.schema["limit"]]
    left = queries.join(F.broadcast(q_groups), "q_block").select("group", F.lit(-1).alias("cell"), "embedding", *[f.name for f in q_only], *nothing(locator))
    right = vectors.join(F.broadcast(v_groups), "v_block").select("group", "cell", "embedding", *nothing(q_only), *names)
    met = left.unionByName(right).repartitionById(n_groups, "group").sortWithinPartitions("group", "cell")
    return met.mapInArrow(search, T.StructType([bounded.schema["query_id"], T.StructField("distance", T.DoubleType()), *locator]))


def _groups(routes: DataFrame) -> tuple[int, DataFrame, DataFrame]:
    """(number, groups of each query block, groups of each vector block): a group is one block of queries and up to
    GROUP_BLOCKS of the blocks of vectors that it meets, one after the other, its limits shrinking; one task has it. So a
    query's hits leave once for each group, not for each block. Groups are fewer blocks where there are not enough of them
    for every core."""
    spark = routes.sparkSession
    pairs = routes.toArrow().sort_by([("q_block", "ascending"), ("v_block", "ascending")])  # two numbers a pair of blocks
    q, v = (pairs[n].to_numpy().astype("int64") for n in ("q_block", "v_block"))
    per = max(1, min(GROUP_BLOCKS, len(q) // (4 * spark.sparkContext.defaultParallelism)))
    begins = (np.diff(q, prepend=-1) != 0) | (_ranks(q) % per == 0)
    group = np.cumsum(begins) - 1
    of = lambda name, block: spark.createDataFrame(
        [(int(b), int(g)) for b, g in np.unique(np.stack([block, group]), axis=1).T], f"{name} int, group int"
    )
    return max(1, int(begins.sum())), of("q_block", q), of("v_block", v)


def _plus(schema: T.StructType, **columns: T.DataType) -> T.StructType:
    return T.StructType([*schema.fields, *[T.StructField(n, t) for n, t in columns.items()]])


def _visit(routed: DataFrame, placed: DataFrame, size: np.ndarray, k: int, metric: str, dim: int) -> DataFrame:
    """Each routed query's k best in the cell it visits, within its limit.

    A cell's vectors and visitors are cut into blocks by hash; every pair of blocks of a cell
    is one group, so neither a crowded cell nor a popular one ends up in a single task.
    """
    rows = max(1, BLOCK_BYTES // (8 * dim))
    visits = routed.groupBy("cell").count().collect()
    blocks = routed.sparkSession.createDataFrame(
        [(r.cell, int(-(-size[r.cell] // rows)), int(-(-r["count"] // rows))) for r in visits],
        "cell int, v_blocks int, q_blocks int",
    )

    def spread(df: DataFrame, own: str, key: str, other: str) -> DataFrame:
        """Own block by hash of the key, one copy for every block of the other side."""
        return (
            df.join(F.broadcast(blocks), "cell")
            .withColumn(own, F.pmod(F.xxhash64(key), F.col(f"{own}s")).cast("int"))
            .withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"{other}s") - 1)))
            .drop("v_blocks", "q_blocks")
        )

    locator = [f for f in placed.schema if f.name not in ("embedding", "cell")]
    names = [f.name for f in locator]

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        right = _by_key(right)
        lrows, q = _scaled(left["embedding"], metric, dim)
        rrows, v = _scaled(right["embedding"], metric, dim)
        limit = left["limit"].to_numpy()[lrows]
        qi, vi, d = _nearest(q, v, k, metric, limit) if len(v) else (np.empty(0, int),) * 2 + (np.empty(0),)
        near = right.select(names).take(pa.array(rrows[vi], pa.int64()))
        ids = left["query_id"].take(pa.array(lrows[qi], pa.int64()))
        return pa.table([ids, pa.array(d), *near.columns], names=["query_id", "distance", *names])

    by = ["cell", "v_block", "q_block"]
    left = spread(routed, "q_block", "query_id", "v_block").groupBy(*by)
    right = spread(placed, "v_block", "key", "q_block").groupBy(*by)
    schema = T.StructType([routed.schema["query_id"], T.StructField("distance", T.DoubleType()), *locator])
    return left.cogroup(right).applyInArrow(search, schema)
