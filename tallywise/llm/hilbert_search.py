"""Nearest vectors by inner product, found along several shifted Hilbert curves.

A vector is divided by the largest length in the table and gets one more component that makes it a
unit vector; a query gets zero there and is made a unit vector itself. Then the largest inner product
is the smallest distance. For each curve the vectors are projected onto a few random directions,
shifted, put on a grid by the quantiles of a sample, and numbered along a Hilbert curve of that grid.
The keys of the sample cut a curve into blocks of about equal size; rows of equal keys are spread over
the blocks that the key spans. A query visits the blocks its window touches, on every curve; every
visit gives its nearest, and the visits are merged.

How wide the windows are is measured, not guessed: the exact neighbours of some rows of the sample are
looked up among all vectors, and the window is as wide as it takes to hold the share of them asked for.
Vectors that lie in few directions need narrow windows. Vectors without any structure have neighbours
that are hardly nearer than the rest, and windows then hold a large part of the table.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

CURVES = 3
DIRECTIONS = 4
BITS = 12  # of a cell's number in each direction
SAMPLE = 16_384  # vectors that the grid and the blocks are fitted to
KNOTS = 257
CALIBRATED = 256  # of them, whose exact neighbours measure the windows
BLOCK_ROWS = 4096
IN_BLOCK = 16  # vectors of the sample in a block at least
AT_ONCE = 65_536  # rows of either side in a task
SIDE = 1024, 4096  # queries and candidates compared at a time
PAIRS = 65_536
MARGIN = 1e-5  # of a product of two unit vectors in single precision
SALTS = 256


# ---------------------------------------------------------------------------
# Vectors
# ---------------------------------------------------------------------------


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, tag, v): vectors with an id and only finite components, not all zero, of the usual length.

    The usual length is the most frequent one, of equally frequent ones the largest. tag is a hash of
    the vector, so that rows of one id stay apart.
    """
    kind = vectors.schema[vector_col].dataType
    kept = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.FloatType, T.DoubleType))
    v = F.col(f"`{vector_col}`").cast(kind if kept else "array<double>")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null")
    finite = F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    rows = rows.where(finite & F.exists("v", lambda x: x != 0))
    sizes = rows.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n"))
    usual = sizes.orderBy(F.desc("n"), F.desc("dim")).limit(1).select("dim").scalar()
    return rows.where(F.size("v") == usual).select("vec_id", F.xxhash64("v").alias("tag"), "v")


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Arrow lists of equal length as rows of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1)


def lengths(x: np.ndarray) -> np.ndarray:
    """Euclidean lengths, without overflow on the way."""
    most = np.abs(x).max(axis=1)
    with np.errstate(over="ignore"):
        return np.minimum(most * np.sqrt(((x / most[:, None]) ** 2).sum(axis=1)), 1e300)


def _facts(rows: DataFrame, is_query: Column) -> tuple[int, int, float]:
    """Number of vectors, number of queries, largest length."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                longest = float(lengths(matrix(batch.column("v"))).max())
                asked = int(batch.column("asked").to_numpy(zero_copy_only=False).sum())
                yield pa.RecordBatch.from_pydict({"n": [batch.num_rows], "q": [asked], "longest": [longest]})

    found = rows.select("v", F.coalesce(is_query, F.lit(False)).alias("asked")).mapInArrow(run, "n long, q long, longest double")
    row = found.agg(F.sum("n"), F.sum("q"), F.max("longest")).first()
    return row[0] or 0, row[1] or 0, row[2] or 1.0


# ---------------------------------------------------------------------------
# Curves
# ---------------------------------------------------------------------------


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places of grid cells (rows of whole numbers below 2^bits) along the Hilbert curve of the grid.

    From the coarsest bit to the finest, every part of a cell is reflected and its directions are
    exchanged as the curve turns there; the Gray code of what results, bit by bit, is the place.
    """
    x = cells.T.astype(np.int64).copy()
    directions = len(x)
    for bit in range(bits - 1, 0, -1):
        finer = (1 << bit) - 1
        for i in range(directions):
            turned = (x[i] >> bit & 1).astype(bool)
            exchanged = np.where(turned, 0, (x[0] ^ x[i]) & finer)
            x[0] ^= np.where(turned, finer, exchanged)
            x[i] ^= exchanged
    for i in range(1, directions):
        x[i] ^= x[i - 1]
    flipped = np.zeros_like(x[0])
    for bit in range(bits - 1, 0, -1):
        flipped ^= np.where(x[-1] >> bit & 1, (1 << bit) - 1, 0)
    x ^= flipped
    place = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(directions):
            place = place << 1 | (x[i] >> bit & 1)
    return place


@dataclass
class Curves:
    """What a bounded sample has taught: grids and sorted keys of each curve, and the half-width of the windows."""

    longest: float
    axes: list[np.ndarray]
    shifts: list[np.ndarray]
    knots: list[np.ndarray]
    keys: list[np.ndarray]
    half: float = 0.5

    def unit(self, x: np.ndarray, asked: bool) -> np.ndarray:
        """Unit vectors with one more component: what is missing to the largest length, zero for a query."""
        if asked:
            return np.hstack((x / lengths(x)[:, None], np.zeros((len(x), 1))))
        scaled = x / self.longest
        missing = np.sqrt(np.maximum(0.0, 1.0 - (scaled**2).sum(axis=1)))
        return np.hstack((scaled, missing[:, None]))

    def key(self, curve: int, unit: np.ndarray) -> np.ndarray:
        seen = unit @ self.axes[curve]
        at = np.linspace(0, 1, KNOTS)
        grid = np.stack([np.interp(seen[:, i], self.knots[curve][i], at) for i in range(seen.shape[1])], axis=1)
        cells = ((grid + self.shifts[curve]) / 1.5 * (1 << BITS)).astype(np.int64)
        return hilbert(np.clip(cells, 0, (1 << BITS) - 1), BITS)

    def span(self, curve: int, x: np.ndarray, asked: bool) -> tuple[np.ndarray, np.ndarray]:
        """Where the key of each vector begins and ends among the keys of the sample, from 0 to 1."""
        own, keys = self.key(curve, self.unit(x, asked)), self.keys[curve]
        return np.searchsorted(keys, own, "left") / len(keys), np.searchsorted(keys, own, "right") / len(keys)

    def places(self, curve: int, x: np.ndarray, tags: np.ndarray) -> np.ndarray:
        """A place for each vector; those of equal keys are spread over what the key spans."""
        first, last = self.span(curve, x, False)
        return np.minimum(first + (tags.view(np.uint64) / 2.0**64) * (last - first), np.nextafter(1.0, 0.0))


def fit(rows: DataFrame, longest: float, curves: int, directions: int, sample: int, seed: int) -> tuple[Curves, np.ndarray, np.ndarray]:
    """Curves from the `sample` vectors with the smallest hashes of their ids; also these vectors and their (id, tag)."""
    chosen = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "tag").limit(sample).toArrow()
    x = matrix(chosen.column("v"))
    names = np.stack([chosen.column(c).to_numpy() for c in ("vec_id", "tag")], axis=1)
    chance, fitted = np.random.default_rng(seed), Curves(longest, [], [], [], [])
    unit = fitted.unit(x, False)
    for curve in range(curves):
        drawn = chance.normal(size=(unit.shape[1], min(directions, unit.shape[1])))
        fitted.axes.append(np.linalg.qr(drawn)[0])
        fitted.shifts.append(chance.uniform(0, 0.5, fitted.axes[-1].shape[1]))
        fitted.knots.append(np.quantile(unit @ fitted.axes[-1], np.linspace(0, 1, KNOTS), axis=0).T)
        fitted.keys.append(np.sort(fitted.key(curve, unit)))
    return fitted, x, names


# ---------------------------------------------------------------------------
# Comparing
# ---------------------------------------------------------------------------


class Nearest:
    """The k nearest of some queries among the candidates they have met: by product, then id."""

    def __init__(self, queries: np.ndarray, names: np.ndarray, k: int):
        self.queries, self.names, self.k = queries, names, k
        self.unit = (queries / lengths(queries)[:, None]).astype(np.float32)
        self.row = np.empty(0, np.int64)  # sorted; each with score, id and tag of a candidate
        self.score, self.found = np.empty(0), np.empty((0, 2), np.int64)
        self.floor = np.full(len(queries), -np.inf)  # score of the k-th

    def meet(self, x: np.ndarray, names: np.ndarray) -> None:
        for at in range(0, len(x), SIDE[1]):
            own, first = np.unique(names[at : at + SIDE[1]], axis=0, return_index=True)  # repeated rows once
            part = x[at : at + SIDE[1]][first]
            longest = float(lengths(part).max())
            scaled = (part / longest).astype(np.float32).T
            for q in range(0, len(self.queries), SIDE[0]):
                self._compare(slice(q, q + SIDE[0]), scaled, longest, part, own)

    def _compare(self, rows: slice, scaled: np.ndarray, longest: float, x: np.ndarray, names: np.ndarray) -> None:
        near = self.unit[rows] @ scaled
        least = (self.floor[rows] / lengths(self.queries[rows]) / longest).astype(np.float32)
        if near.shape[1] > self.k:
            # one more than asked for: a query may meet itself
            own = np.partition(near, near.shape[1] - self.k - 1, axis=1)[:, near.shape[1] - self.k - 1]
            least = np.maximum(least, own)
        q, c = np.nonzero(near >= (least - MARGIN)[:, None])
        q = q + rows.start
        other = (self.names[q] != names[c]).any(axis=1)
        q, c = q[other], c[other]
        for at in range(0, len(q), PAIRS):
            a, b = q[at : at + PAIRS], c[at : at + PAIRS]
            self._keep(a, np.einsum("ij,ij->i", self.queries[a], x[b]), names[b])

    def _keep(self, row: np.ndarray, score: np.ndarray, names: np.ndarray) -> None:
        row, score = np.concatenate((self.row, row)), np.concatenate((self.score, score))
        names = np.concatenate((self.found, names))
        order = np.lexsort((names[:, 1], names[:, 0], -score, row))
        row, score, names = row[order], score[order], names[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (names[1:] != names[:-1]).any(axis=1)
        row, score, names = row[new], score[new], names[new]
        first = np.searchsorted(row, row)
        top = np.arange(len(row)) - first < self.k
        self.row, self.score, self.found = row[top], score[top], names[top]
        last = np.flatnonzero(np.arange(len(self.row)) - np.searchsorted(self.row, self.row) == self.k - 1)
        self.floor[self.row[last]] = self.score[last]


def exact_nearest(rows: DataFrame, queries: np.ndarray, names: np.ndarray, k: int, curves: Curves) -> DataFrame:
    """(q, neg, vec_id, tag, places) of the k nearest among all rows, for a bounded number of queries.

    Every task compares what it holds with all of them; the tasks' results are merged in two steps.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nearest, seen = Nearest(queries, names, k), {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column("v"))
            own = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "tag")], axis=1)
            nearest.meet(x, own)
            wanted = set(map(tuple, nearest.found.tolist()))
            seen = {n: v for n, v in seen.items() if n in wanted}
            new = [i for i, n in enumerate(map(tuple, own.tolist())) if n in wanted and n not in seen]
            if new:
                places = np.stack([curves.places(c, x[new], own[new, 1]) for c in range(len(curves.axes))], axis=1)
                seen.update(zip(map(tuple, own[new].tolist()), places.tolist()))
        found = nearest.found
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(nearest.row, pa.int64()),
                pa.array(-nearest.score),
                pa.array(found[:, 0]),
                pa.array(found[:, 1]),
                pa.array([seen[tuple(n)] for n in found.tolist()], pa.list_(pa.float64())),
            ],
            ["q", "neg", "vec_id", "tag", "places"],
        )

    met = rows.mapInArrow(run, "q long, neg double, vec_id long, tag long, places array<double>")
    met = met.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    order = ["neg", "vec_id", "tag"]
    some = Window.partitionBy("q", "salt").orderBy(*order)
    met = met.withColumn("place", F.row_number().over(some)).where(F.col("place") <= k)
    met = met.dropDuplicates(["q", "vec_id", "tag"])
    every = Window.partitionBy("q").orderBy(*order)
    return met.withColumn("place", F.row_number().over(every)).where(F.col("place") <= k).drop("salt", "place")


def calibrated(rows: DataFrame, curves: Curves, x: np.ndarray, names: np.ndarray, k: int, recall: float, queries: int) -> float:
    """Half the width of a window that holds the share `recall` of the exact neighbours of some vectors of the sample."""
    x, names = x[:queries], names[:queries]
    spans = [curves.span(c, x, True) for c in range(len(curves.axes))]
    exact = exact_nearest(rows, x, names, k, curves).select("q", "places").toArrow()
    if not exact.num_rows:
        return 0.5
    q = exact.column("q").to_numpy()
    places = matrix(exact.column("places"))
    gaps = [np.maximum(0, np.maximum(first[q] - places[:, c], places[:, c] - last[q])) for c, (first, last) in enumerate(spans)]
    needed = float(np.quantile(np.min(gaps, axis=0), recall))
    return min(0.5, needed + 1 / len(curves.keys[0]))


def _visits(rows: DataFrame, curves: Curves, blocks: int, asked: bool) -> DataFrame:
    """(curve, block, vec_id, tag, v): the block of each vector on each curve, all blocks that a query's window touches."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, tags = matrix(batch.column("v")), batch.column("tag").to_numpy(zero_copy_only=False)
            for c in range(len(curves.axes)):
                if asked:
                    first, last = curves.span(c, x, True)
                    low = np.clip(np.floor((first - curves.half) * blocks), 0, blocks - 1).astype(np.int64)
                    high = np.clip(np.floor((last + curves.half) * blocks), 0, blocks - 1).astype(np.int64)
                    taken = np.repeat(np.arange(len(x)), high - low + 1)
                    block = np.arange(len(taken)) - np.repeat(np.cumsum(high - low + 1) - (high - low + 1), high - low + 1) + low[taken]
                else:
                    taken = np.arange(len(x))
                    block = (curves.places(c, x, tags) * blocks).astype(np.int64)
                for at in range(0, len(taken), 10_000):
                    part = batch.take(pa.array(taken[at : at + 10_000]))
                    own = [pa.array(np.full(part.num_rows, c, np.int32)), pa.array(block[at : at + 10_000].astype(np.int32))]
                    yield pa.RecordBatch.from_arrays([*own, *part.columns], ["curve", "block", "vec_id", "tag", "v"])

    kind = rows.schema["v"].dataType.simpleString()
    return rows.mapInArrow(run, f"curve int, block int, vec_id long, tag long, v {kind}")


FOUND = "q_id long, q_tag long, found array<struct<neg:double,vec_id:long,tag:long>>"


def _compared(queries: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """The k nearest of every query in every block it visits."""

    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        kind = pa.list_(pa.struct([("neg", pa.float64()), ("vec_id", pa.int64()), ("tag", pa.int64())]))
        schema = pa.schema([("q_id", pa.int64()), ("q_tag", pa.int64()), ("found", kind)])
        if not asked.num_rows or not held.num_rows:
            return schema.empty_table()
        names, others = (
            np.stack([t.column(c).to_numpy() for c in ("vec_id", "tag")], axis=1) for t in (asked, held)
        )
        nearest = Nearest(matrix(asked.column("v")), names, k)
        for at in range(0, held.num_rows, SIDE[1]):
            nearest.meet(matrix(held.column("v").slice(at, SIDE[1])), others[at : at + SIDE[1]])
        offsets = np.searchsorted(nearest.row, np.arange(len(names) + 1)).astype(np.int32)
        values = [pa.array(-nearest.score), pa.array(nearest.found[:, 0]), pa.array(nearest.found[:, 1])]
        found = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(values, ["neg", "vec_id", "tag"]))
        return pa.Table.from_arrays([pa.array(names[:, 0]), pa.array(names[:, 1]), found.cast(kind)], schema=schema)

    place = ["curve", "block", "queries", "rows"]
    return queries.groupBy(*place).cogroup(candidates.groupBy(*place)).applyInArrow(run, FOUND)


def nearest_neighbours(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    recall: float = 0.95,
    curves: int = CURVES,
    directions: int = DIRECTIONS,
    sample: int = SAMPLE,
    seed: int = 1,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every row that is a query, nearest first.

    `is_query` is a condition on vec_id. score is the inner product in double precision; ties go to the
    smaller vec_id. All other rows are candidates. Vectors that are null, empty, zero or hold a null or
    non-finite component, rows without an id, and vectors of another than the usual length take no part.
    Rows that repeat id and vector count once; rows of one id with different vectors are told apart.
    With k or fewer candidates all are found. An empty table gives an empty result; further columns are
    ignored. `recall` is the share of true neighbours that the windows are fitted to; the rows of the
    sample it is measured on are those with the smallest hashes of their ids.
    """
    rows = usable(vectors, id_col, vector_col)
    n, asked, longest = _facts(rows, is_query)
    spark = vectors.sparkSession
    if not n or not asked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    blocks = max(1, min(-(-n // BLOCK_ROWS), sample // IN_BLOCK))
    # one block holds everything: one curve is enough
    fitted, x, names = fit(rows, longest, curves if blocks > 1 else 1, directions, sample, seed)
    if blocks > 1:
        fitted.half = calibrated(rows, fitted, x, names, k, recall, CALIBRATED)
    parts = -(-n // (blocks * AT_ONCE))
    groups = max(1, int(np.ceil(asked * min(1.0, 2 * fitted.half + 2 / blocks) / AT_ONCE)))
    numbers = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    candidates = _visits(rows, fitted, blocks, False)
    candidates = candidates.select("*", F.pmod(F.xxhash64("vec_id", "tag"), F.lit(parts)).cast("int").alias("rows"))
    candidates = candidates.select("*", numbers(groups).alias("queries"))
    queries = _visits(rows.where(is_query), fitted, blocks, True)
    queries = queries.select("*", F.pmod(F.xxhash64("tag", "vec_id"), F.lit(groups)).cast("int").alias("queries"))
    queries = queries.select("*", numbers(parts).alias("rows"))
    met = _compared(queries, candidates, k)
    every = F.array_sort(F.array_distinct(F.flatten(F.collect_list("found"))))
    merged = met.groupBy("q_id", "q_tag").agg(F.slice(every, 1, k).alias("found"))
    shown = merged.select(F.col("q_id").alias("query_id"), F.posexplode("found").alias("place", "x"))
    return shown.select(
        "query_id", (F.col("place") + 1).cast("int").alias("rank"), "x.vec_id", (-F.col("x.neg")).alias("score")
    )
