"""Exact top-k search by inner product: pivot distances bound the candidates, which are tried in bound order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Pivots, and rows that they are chosen from.
PIVOTS, SAMPLE = 128, 2048
#: Bytes of quantized queries that are sent to the executors at a time.
BLOCK_BYTES = 1 << 24
#: Queries and candidates whose bounds are worked out together; candidates tried at once.
GROUP, CHUNK, TRY = 64, 4096, 256


def quantized(vector: Column) -> Column:
    """floor(256 * x) of each component; null where the vector is null or a component null or not finite."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(sound, F.transform(vector, lambda x: F.floor(x.cast("double") * 256).cast("long")))


def choose_pivots(sample: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """The rows of ``sample`` that lie farthest from those chosen before."""
    chosen, away = [0], np.full(len(sample), np.inf)
    while len(chosen) < min(n, len(sample)):
        away = np.minimum(away, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
        chosen.append(int(away.argmax()))
    return sample[chosen]


def _distances(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """(pivot, row) distances, one line a pivot."""
    squares = (pivots**2).sum(axis=1)[:, None] + (rows**2).sum(axis=1) - 2 * pivots @ rows.T
    return np.sqrt(np.maximum(squares, 0)).astype(np.float32)


class Search:
    """The best ``k`` so far of each query of one block, over the candidates seen.

    The table holds each query's distances to all pivots. For a candidate the largest difference of the two distances
    to one pivot is a lower bound of theirs, so an upper bound of their product. Candidates are tried in the order
    of bounds until none left has a bound that reaches a k-th score. ``seen`` counts pairs, ``tried`` products.
    """

    def __init__(self, ids: np.ndarray, queries: np.ndarray, pivots: np.ndarray, k: int):
        self.ids, self.k = ids, k
        self.queries, self.pivots = queries.astype(np.int64), pivots.astype(np.float64)
        wide = self.queries.astype(np.float64)
        self.table, self.squares = _distances(wide, self.pivots), (wide**2).sum(axis=1)
        self.most = float(np.abs(wide).max(initial=0))
        self.held = np.zeros(len(ids), np.int64)
        self.scores, self.who = np.zeros((len(ids), k), np.int64), np.zeros((len(ids), k), np.int64)
        self.void = np.zeros((len(ids), k), bool)
        self.tried = self.seen = 0

    @property
    def best(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        return [(self.scores[i, :n], self.who[i, :n], self.void[i, :n]) for i, n in enumerate(self.held)]

    def add(self, ids: np.ndarray, no_id: np.ndarray, rows: np.ndarray) -> None:
        for start in range(0, len(ids), CHUNK):
            self._chunk(*(x[start : start + CHUNK] for x in (ids, no_id, rows)))

    def _chunk(self, ids: np.ndarray, no_id: np.ndarray, rows: np.ndarray) -> None:
        wide = rows.astype(np.float64)
        largest = self.most * float(np.abs(wide).max(initial=0)) * wide.shape[1]
        if largest >= 2.0**62:
            raise OverflowError("inner products beyond 64 bits")
        exact = largest < 2.0**52  # whole numbers that doubles hold
        table, squares = _distances(wide, self.pivots), (wide**2).sum(axis=1)
        for start in range(0, len(self.ids), GROUP):
            at = slice(start, start + GROUP)
            mine = (self.queries[at].astype(np.float64), wide) if exact else (self.queries[at], rows)
            least = np.zeros((len(self.ids[at]), len(ids)), np.float32)
            for here, there in zip(self.table[:, at], table, strict=True):
                gap = there - here[:, None]
                np.maximum(least, np.abs(gap, out=gap), out=least)
            sums = self.squares[at, None] + squares
            bound = (sums - least.astype(np.float64) ** 2) / 2 + (1 + 1e-6 * sums)  # rounding never hides a candidate
            bound[(ids == self.ids[at, None]) & ~no_id] = -np.inf
            self.seen += bound.size
            order = np.argsort(-bound.max(axis=0), kind="stable")
            for some in np.split(order, range(min(TRY, len(order)), len(order), TRY)):
                floor = np.where(self.held[at] == self.k, self.scores[at, -1], -(2.0**63))
                some = some[(bound[:, some] >= floor[:, None]).any(axis=0)]
                if not len(some):
                    if not (bound[:, order] >= floor[:, None]).any():
                        break  # no bound of any query reaches its k-th score
                    continue
                self.tried += len(some) * len(floor)
                found = (mine[0] @ mine[1][some].T).astype(np.int64)
                q, c = np.nonzero((found >= floor[:, None]) & (bound[:, some] > -np.inf))
                if len(q):
                    self._keep(start + q, found[q, c], ids[some[c]], no_id[some[c]])

    def _keep(self, q: np.ndarray, score: np.ndarray, who: np.ndarray, void: np.ndarray) -> None:
        """Takes candidates in; of all that a query has, the best k stay."""
        asked = np.unique(q)
        old = np.repeat(asked, self.held[asked])
        nth = np.arange(len(old)) - np.repeat(np.cumsum(self.held[asked]) - self.held[asked], self.held[asked])
        q, score, who, void = np.r_[old, q], np.r_[self.scores[old, nth], score], np.r_[self.who[old, nth], who], np.r_[self.void[old, nth], void]
        order = np.lexsort((who, void, -score, q))
        q, score, who, void = q[order], score[order], who[order], void[order]
        starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
        nth = np.arange(len(q)) - np.repeat(starts, np.diff(np.r_[starts, len(q)]))
        on = nth < self.k
        self.scores[q[on], nth[on]], self.who[q[on], nth[on]], self.void[q[on], nth[on]] = score[on], who[on], void[on]
        self.held[asked] = np.minimum(np.diff(np.r_[starts, len(q)]), self.k)


def _block_search(shared, k: int):
    def searched(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, marks, queries, pivots = shared.value
        search = Search(ids, queries, pivots, k)
        for part in parts:
            if len(part):
                rows = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(part), queries.shape[1])
                search.add(part.column(0).fill_null(0).to_numpy(zero_copy_only=False), part.column(0).is_null().to_numpy(zero_copy_only=False), rows)
        there = np.arange(k) < search.held[:, None]
        columns = [np.repeat(ids, search.held), np.repeat(marks, search.held), search.who[there], search.scores[there]]
        arrays = [pa.array(x, pa.int64(), mask=search.void[there] if i == 2 else None) for i, x in enumerate(columns)]
        yield pa.RecordBatch.from_arrays(arrays, ["query_id", "mark", "vec_id", "score"])

    return searched


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, key: str = "vec_id", vector: str = "embedding", pivots: int = PIVOTS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id ``every`` divides, the ``k`` best of the other rows.

    Scores are inner products of the quantized vectors, exact; products that 64 bits may not hold are an error. Ties
    go to the smaller id, null ids last. Queries go to the executors in blocks of about ``block_bytes``, one block
    after the other: each is answered, written to the shared folder and let go, so neither driver nor executor
    holds more than one. Each task keeps the k best of every query of a block and leaves out candidates by their
    pivot bounds; the pivots come from ``SAMPLE`` rows. Vectors that are null or hold null or non-finite components
    take no part; vectors of another length than the query's are no candidates. Rows that repeat an id are rows of
    their own as candidates, but never candidates of a query of that id; a query that repeats an id with another
    vector is a query of its own, with an equal vector it is asked once. Fewer rows give fewer results; an empty table
    gives an empty table. Other columns of ``vectors`` are not looked at.
    """
    spark = vectors.sparkSession
    rows = cut(vectors.select(F.col(key).cast("long").alias("vec_id"), quantized(F.col(vector)).alias("q")).filter("q is not null"))
    asked = rows.filter(F.col("vec_id") % every == 0).distinct()
    sizes = {r["width"]: r["n"] for r in asked.groupBy(F.size("q").alias("width")).agg(F.count(F.lit(1)).alias("n")).collect()}
    out = spark.createDataFrame([], "query_id long, mark long, vec_id long, score long")
    for width, n in sorted(sizes.items()):
        same = rows.filter(F.size("q") == width)
        sample = same.orderBy(F.xxhash64("q")).limit(SAMPLE).select("q").collect()
        far = choose_pivots(np.array([r["q"] for r in sample], np.float64).reshape(len(sample), width), pivots)
        blocks = -(-n * 8 * max(width, 1) // block_bytes)
        for i in range(blocks):
            some = asked.filter((F.size("q") == width) & (F.pmod(F.xxhash64("vec_id", "q"), F.lit(blocks)) == i)).select("vec_id", F.xxhash64("q").alias("mark"), "q").collect()
            if some:
                queries = np.array([r["q"] for r in some], np.int64).reshape(len(some), width)
                ids, marks = (np.array([r[x] for r in some], np.int64) for x in ("vec_id", "mark"))
                shared = spark.sparkContext.broadcast((ids, marks, queries, far))
                out = out.union(cut(same.mapInArrow(_block_search(shared, k), "query_id long, mark long, vec_id long, score long")))
                shared.destroy()
    best = Window.partitionBy("query_id", "mark").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    return out.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
