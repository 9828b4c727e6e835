"""Nearest neighbours by inner product: blocks of queries against all rows."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kbflow.functions.vectors import dot

#: Queries that are sent to all tasks at a time.
BLOCK = 4096
#: Queries, and documents, whose products are made at a time.
TILE = 1024


def pairs(queries: DataFrame, kb: DataFrame, budget: int) -> DataFrame:
    """Each query with each document of a knowledge base of at most ``budget`` documents: adds sim. qv and dv are the vectors.

    The budget is what makes a knowledge base: it bounds the broadcast, and the limit proves it.
    """
    return queries.crossJoin(F.broadcast(kb.limit(budget))).withColumn("sim", dot("qv", "dv")).drop("qv", "dv")


def top(found: DataFrame, k: int, by: str = "q", score: str = "sim", tie: str = "d") -> DataFrame:
    """The k best rows of each query, with their rank; the limit reaches below the shuffle."""
    order = Window.partitionBy(by).orderBy(F.col(score).desc(), F.col(tie))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def smallest(rows: DataFrame, k: int, by: str, key: str) -> DataFrame:
    """The rows of the k smallest keys of each group; the limit reaches below the shuffle."""
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(by).orderBy(key))).where(F.col("n") <= k).drop("n")


def nearest(queries: DataFrame, docs: DataFrame, k: int, block: int = BLOCK, digits: int | None = None) -> DataFrame:
    """(q, d, sim, rank) of the k documents (d, dv) with the largest inner products for each query (q, qv); ties, of ``digits`` digits if given, to the smaller d.

    A block of queries is a matrix in every task; each task keeps k rows a query while it reads its documents, so that
    only these are shuffled. Null ids, null vectors and vectors with a null or non-finite component take no part; only
    vectors of one length are compared. Repeated rows count each. Without queries or documents there are no rows.
    """
    own = queries.where(F.col("q").isNotNull() & _fine("qv")).select("q", F.col("qv").cast("array<double>").alias("qv"))
    docs = docs.where(F.col("d").isNotNull() & _fine("dv")).select("d", F.col("dv").cast("array<double>").alias("dv"))
    return _search(own, docs, k, block, digits)


def probe(queries: DataFrame, centroids: DataFrame, docs: DataFrame, n: int, k: int, block: int = BLOCK) -> DataFrame:
    """Two stages: the n best centroids (c, cv) of each query, then the k best documents (d, dv, c) of those clusters.

    The second is a search like the first, in which each query meets the documents of its clusters only.
    """
    chosen = nearest(queries, centroids.select(F.col("c").alias("d"), F.col("cv").alias("dv")), n, block).groupBy("q").agg(F.collect_list("d").alias("cs"))
    own = queries.where(_fine("qv")).select("q", F.col("qv").cast("array<double>").alias("qv")).join(chosen, "q")
    docs = docs.where(F.col("d").isNotNull() & F.col("c").isNotNull() & _fine("dv")).select("d", F.col("dv").cast("array<double>").alias("dv"), "c")
    return _search(own, docs, k, block, None)


def _fine(v: str):
    return F.forall(F.col(v).cast("array<double>"), lambda x: F.coalesce((F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False)))


def _search(queries: DataFrame, docs: DataFrame, k: int, block: int, digits: int | None) -> DataFrame:
    """Queries are read once, and held on the driver a block at a time; their plan is not run again for each block."""
    spark = queries.sparkSession
    held: dict[int, list] = {}
    parts = []

    def send(rows: list) -> None:
        size = len(rows[0].qv)
        ids, matrix = np.array([r.q for r in rows], np.int64), np.array([r.qv for r in rows], np.float64).reshape(len(rows), size)
        lists: dict[int | None, list] = {}
        for i, r in enumerate(rows):
            for c in r.cs if "cs" in r else [None]:
                lists.setdefault(c, []).append(i)
        lists = {c: np.array(own, np.int64) for c, own in lists.items()}
        parts.append(docs.where(F.size("dv") == size).mapInArrow(_best(spark.sparkContext.broadcast((ids, matrix, lists)), k, digits), "q long, d long, sim double"))

    for row in queries.toLocalIterator():
        own = held.setdefault(len(row.qv), [])
        own.append(row)
        if len(own) == block:
            send(held.pop(len(row.qv)))
    for own in held.values():
        send(own)
    if not parts:
        return spark.createDataFrame([], "q long, d long, sim double, rank int")
    return top(functools.reduce(DataFrame.unionByName, parts), k)


def _best(sent, k: int, digits: int | None):
    class Best:
        """The k best documents of each row of ``matrix`` among those that were added; ties to the smaller id.

        Products are made by matrix, a tile of TILE queries and TILE documents at a time, and only tell which pairs can be
        among the best: those within the error of both ways of summing. Their products are summed again in the order of the
        components, so that equal vectors have equal products wherever they stand. Memory is that of a tile and the k best.
        """

        def __init__(self, matrix: np.ndarray, k: int, digits: int | None) -> None:
            self.matrix, self.across, self.k, self.digits = matrix, np.ascontiguousarray(matrix.T), k, digits
            self.n = np.zeros(len(matrix), np.int64)
            self.d, self.s = np.zeros((len(matrix), k), np.int64), np.full((len(matrix), k), -np.inf)
            self.error = 4 * (matrix.shape[1] + 2) * np.finfo(float).eps * np.sqrt((matrix * matrix).sum(axis=1))

        def add(self, d: np.ndarray, x: np.ndarray, among: np.ndarray) -> None:
            """Documents ``d`` with vectors ``x`` for the queries that ``among`` numbers, one that stands there twice counts twice."""
            for at in range(0, len(d), TILE):
                ids, own = d[at : at + TILE], x[at : at + TILE]
                across, largest = np.ascontiguousarray(own.T), np.sqrt((own * own).sum(axis=1)).max()
                for q in range(0, len(among), TILE):
                    self._tile(ids, own, across, largest, among[q : q + TILE])

        def _tile(self, ids: np.ndarray, x: np.ndarray, across: np.ndarray, largest: float, rows: np.ndarray) -> None:
            sims = self.matrix[rows] @ x.T
            slack = self.error[rows] * largest + (0 if self.digits is None else 2 * 10.0**-self.digits)
            least = np.where(self.n[rows] == self.k, self.s[rows, -1], -np.inf) - slack
            may = ~(sims < least[:, None])  # what is not a number is not left out
            if len(ids) > self.k and may.sum() > 4 * self.k * len(rows):
                kth = np.partition(sims, len(ids) - self.k, axis=1)[:, len(ids) - self.k]
                may &= ~(sims < (kth - 2 * slack)[:, None])
            r, c = np.divmod(np.flatnonzero(may), len(ids))
            for at in range(0, len(r), TILE * 64):
                self._exact(ids, across, rows[r[at : at + TILE * 64]], c[at : at + TILE * 64])

        def _exact(self, ids: np.ndarray, across: np.ndarray, r: np.ndarray, c: np.ndarray) -> None:
            s = np.zeros(len(r))
            for a, b in zip(self.across, across, strict=True):
                s += a[r] * b[c]
            if self.digits is not None:
                s = np.round(s, self.digits)
            in_ = ~((self.n[r] == self.k) & (s < self.s[r, -1]))
            r, d, s = r[in_], ids[c[in_]], s[in_]
            if not len(r):
                return
            old = np.unique(r)
            at, place = np.nonzero(np.arange(self.k) < self.n[old, None])
            r, d, s = np.concatenate([r, old[at]]), np.concatenate([d, self.d[old[at], place]]), np.concatenate([s, self.s[old[at], place]])
            order = np.lexsort((d, -s, r))
            r, d, s = r[order], d[order], s[order]
            first = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
            place = np.arange(len(r)) - np.repeat(first, np.diff(np.r_[first, len(r)]))
            kept = place < self.k
            self.d[r[kept], place[kept]], self.s[r[kept], place[kept]] = d[kept], s[kept]
            self.n[old] = np.minimum(np.diff(np.r_[first, len(r)]), self.k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix, lists = sent.value
        best = Best(matrix, k, digits)
        for batch in batches:
            if not batch.num_rows:
                continue
            d = batch.column(0).to_numpy()
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, matrix.shape[1])
            if batch.num_columns == 2:
                best.add(d, x, lists[None])
                continue
            c = batch.column(2).to_numpy()
            for own in np.unique(c).tolist():
                if own in lists:
                    best.add(d[c == own], x[c == own], lists[own])
        held = np.arange(k) < best.n[:, None]
        yield pa.record_batch([pa.array(np.repeat(ids, best.n)), pa.array(best.d[held]), pa.array(best.s[held])], names=["q", "d", "sim"])

    return run
