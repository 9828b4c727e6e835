"""Exact top-k by integer inner product: best-first search in paged M-trees."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kbflow.llm.shared import Table

K, EVERY = 5, 50
#: Vectors of a tree and bytes of its entries at most (about: rows are dealt to trees by a hash), and entries of a page.
TREE, TREE_BYTES, PAGE = 4096, 16 << 20, 64
#: Queries that are searched together: only so many are held by the driver and sent out at a time.
BLOCK, BLOCK_BYTES = 8192, 64 << 20
SCALE = 256
_MOST, _LIMIT = 1 << 53, 1 << 63

SQL = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS x FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
           AND list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false)))),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % {EVERY} = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}
"""


def whole(raw: bytes, dim: int) -> np.ndarray:
    """floor(SCALE * x) of rows of doubles: whole numbers as doubles."""
    return np.floor(np.frombuffer(raw, "<f8").reshape(-1, dim) * SCALE)


class Exact:
    """Inner products of whole numbers without rounding: by doubles where no sum can reach 2**53, else by Python's integers."""

    def __init__(self, x: np.ndarray) -> None:
        self.x, self.most = x, float(np.abs(x).max()) if x.size else 0.0
        self.long: np.ndarray | None = None

    def scores(self, at: np.ndarray, q: np.ndarray) -> list[int]:
        if self.most * float(np.abs(q).max(initial=0)) * max(1, len(q)) < _MOST:
            return (self.x[at] @ q).astype(np.int64).tolist()
        own = [int(v) for v in q]
        return [sum(int(a) * b for a, b in zip(row, own, strict=True)) for row in self.x[at]]


class Tree:
    """An M-tree in three levels of pages. A page has a pivot, a covering radius and its distance to the parent's pivot; entries of leaves have their distance to the page's.

    Vectors x are lifted to (x, sqrt(M**2 - |x|**2)), M the largest norm, and a query q to (q, 0): then
    |q - x|**2 = |q|**2 + M**2 - 2 q.x is a metric in which the nearest have the largest inner product.
    """

    def __init__(self, ids: np.ndarray, x: np.ndarray, page: int = PAGE) -> None:
        self.ids, self.exact = ids, Exact(x)
        self.unit = max(1.0, float(np.sqrt((x * x).sum(axis=1)).max(initial=0)))  # keeps squares of large numbers finite
        y = x / self.unit
        norm = (y * y).sum(axis=1)
        self.top = float(norm.max(initial=0))
        self.y = np.hstack([y, np.sqrt(np.maximum(0, self.top - norm))[:, None]])
        rng = np.random.default_rng(7)
        leaves = [part for group in _assign(self.y, np.sort(rng.permutation(len(y))[: max(1, len(y) // page)])) for part in np.array_split(group, -(-len(group) // page))]
        self.entries, self.pivot, self.radius, self.far = [], [], [], []
        for own in leaves:
            pivot = self.y[own[0]]
            far = _distance(self.y[own], pivot)
            order = np.argsort(far, kind="stable")
            self.entries.append(own[order])
            self.far.append(far[order])
            self.pivot.append(pivot)
            self.radius.append(far.max())
        self.pivot, self.radius = np.array(self.pivot), np.array(self.radius)
        self.inner, self.inner_pivot, self.inner_radius, self.parent = [], [], [], []
        for own in _assign(self.pivot, np.sort(rng.permutation(len(leaves))[: max(1, round(len(leaves) ** 0.5))])):
            pivot = self.pivot[own[0]]
            far = _distance(self.pivot[own], pivot)
            self.inner.append(own)
            self.inner_pivot.append(pivot)
            self.inner_radius.append((far + self.radius[own]).max())
            self.parent.append(far)
        self.inner_pivot, self.inner_radius = np.array(self.inner_pivot), np.array(self.inner_radius)

    def search(self, query_id: int, q: np.ndarray, k: int, best: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """The k best (score, -vec_id) of ``best``, a heap, and this tree. Pages and entries that cannot reach the k-th best are not compared; equal scores count."""
        y = np.append(q / self.unit, 0.0)
        square = float(y @ y)
        slack = 1e-6 * (1 + square + self.top) ** 0.5

        def reach() -> float:
            if len(best) < k:
                return np.inf
            return max(0.0, square + self.top - 2 * best[0][0] / self.unit / self.unit) ** 0.5 + slack

        d = _distance(self.inner_pivot, y)
        heap = [(float(low), 0, i, float(at)) for i, (low, at) in enumerate(zip(np.maximum(0, d - self.inner_radius), d, strict=True))]
        heapq.heapify(heap)
        while heap:
            low, leaf, i, at = heapq.heappop(heap)
            limit = reach()
            if low > limit:
                break
            if not leaf:
                own = self.inner[i]
                own = own[np.abs(at - self.parent[i]) - self.radius[own] <= limit]  # by the parent's distance alone
                far = _distance(self.pivot[own], y)
                for p, f in zip(own.tolist(), far.tolist(), strict=True):
                    if (least := max(0.0, f - self.radius[p])) <= limit:
                        heapq.heappush(heap, (least, 1, p, f))
                continue
            own = self.entries[i]
            a, b = np.searchsorted(self.far[i], [at - limit, at + limit], side="left")
            own = own[a : b + 1]
            for vec_id, score in zip(self.ids[own].tolist(), self.exact.scores(own, q), strict=True):
                if vec_id != query_id:
                    if len(best) < k:
                        heapq.heappush(best, (score, -vec_id))
                    elif (score, -vec_id) > best[0]:
                        heapq.heapreplace(best, (score, -vec_id))
        return best


def _distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    off = x - y
    return np.sqrt(np.einsum("ij,ij->i", off, off))


def _assign(y: np.ndarray, seeds: np.ndarray) -> list[np.ndarray]:
    """Rows by their nearest seed, each group in its rows' order with the seed first."""
    if not len(y):
        return []
    pivots = y[seeds]
    near = np.concatenate([np.argmin(((pivots * pivots).sum(axis=1) - 2 * (part @ pivots.T)), axis=1) for part in np.array_split(y, -(-len(y) // 4096))])
    near[seeds] = np.minimum(near[seeds], np.arange(len(seeds)))
    order = np.argsort(near, kind="stable")
    return [g for g in np.split(order, np.flatnonzero(np.diff(near[order])) + 1) if len(g)]


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw = [np.asarray(v.values.to_numpy(zero_copy_only=False), "<f8").tobytes() for v in batch.column(1)]
        yield pa.record_batch([batch.column(0), pa.array(raw, pa.binary()), batch.column(2)], names=["vec_id", "x", "dim"])


def vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, x binary of doubles, dim): rows with an id whose vector is not null and all finite, each id and vector once."""
    x = F.col(vector_col).cast("array<double>")
    fine = F.forall(x, lambda v: F.coalesce((F.abs(v) < float("inf")) & ~F.isnan(v), F.lit(False)))
    own = table.where(F.col(id_col).isNotNull() & x.isNotNull() & fine).select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x"), F.size(x).alias("dim"))
    return own.mapInArrow(_pack, "vec_id long, x binary, dim int").distinct()


def _trees(key: tuple, rows: pa.Table) -> pa.Table:
    order = np.argsort(rows["vec_id"].to_numpy(), kind="stable")
    ids, raw = rows["vec_id"].to_numpy()[order], rows["x"].take(pa.array(order)).to_pylist()
    return pa.table({"dim": pa.array([key[0].as_py()], pa.int32()), "ids": pa.array([ids.astype("<i8").tobytes()]), "x": pa.array([b"".join(raw)])})


def top_k(table: DataFrame, k: int = K, every: int = EVERY, id_col: str = "vec_id", vector_col: str = "embedding", tree: int = TREE, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by ``every`` the k best other rows.

    Score: the integer inner product of floor(256 * x), without rounding; ranks are those of the whole score, which is
    held at the limits of a long only where it is returned. Ties go to the smaller id. Null ids, null vectors and vectors with a null or non-finite component take no part; only vectors of
    the same length are compared, empty ones too. Repeated rows count once; rows of an own id with other vectors are
    other queries of that id and no candidates of it. An empty table gives no rows. Other columns are not read.

    Trees are built from rows dealt by a hash, so that none grows with the table or with a group of copies. Queries go
    in blocks of a bounded size to all trees; a task keeps k results a query over all its trees, which prunes the more
    the further it comes.
    """
    spark = table.sparkSession
    own = Table(vectors(table, id_col, vector_col), "vectors").df
    sizes = own.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("vec_id") % every == 0).cast("long")).alias("queries")).collect()
    result = "query_id long, of string, vec_id long, high long, low long"
    found: DataFrame | None = None
    for dim, n, queries in ((r["dim"], r["n"], r["queries"]) for r in sorted(sizes, key=lambda r: r["dim"])):
        if not queries:
            continue
        width = 8 * max(1, dim)
        trees = -(-n // max(PAGE, min(tree, TREE_BYTES // width)))
        blocks = -(-queries // max(1, min(block, BLOCK_BYTES // width)))
        alike = own.where(F.col("dim") == dim)
        dealt = alike.withColumn("tree", F.pmod(F.xxhash64("vec_id", "x"), F.lit(trees)))
        built = Table(dealt.groupBy("dim", "tree").applyInArrow(_trees, "dim int, ids binary, x binary"), "trees").df
        asked = alike.where(F.col("vec_id") % every == 0).withColumn("block", F.pmod(F.xxhash64("x", "vec_id"), F.lit(blocks)))
        for b in range(blocks):
            held = [(r["vec_id"], bytes(r["x"])) for r in asked.where(F.col("block") == b).select("vec_id", "x").collect()]
            part = built.repartition(max(1, min(trees, 4 * spark.sparkContext.defaultParallelism))).mapInArrow(_search(spark.sparkContext.broadcast(held), k), result)
            found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    order = Window.partitionBy("query_id", "of").orderBy(F.col("high").desc(), F.col("low").desc(), "vec_id")
    score = F.when(F.col("high") > 1, F.lit(_LIMIT - 1)).when(F.col("high") < -2, F.lit(-_LIMIT)).otherwise(F.shiftleft("high", 62).bitwiseOR(F.col("low")))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", score.alias("score"))


def _search(sent, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[int, int]]] = [[] for _ in sent.value]
        asked: list[np.ndarray] | None = None
        for batch in batches:
            for dim, ids, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                ids = np.frombuffer(ids, "<i8")
                own = Tree(ids, whole(raw, dim) if dim else np.zeros((len(ids), 0)))
                asked = asked if asked is not None else [np.floor(np.frombuffer(x, "<f8") * SCALE) for _, x in sent.value]
                for i, (vec_id, _) in enumerate(sent.value):
                    best[i] = own.search(vec_id, asked[i], k, best[i])
        rows = [(q, hash_of(x), -v, max(-_LIMIT, min(_LIMIT - 1, s >> 62)), s & (1 << 62) - 1) for (q, x), own in zip(sent.value, best, strict=True) for s, v in own]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["query_id", "of", "vec_id", "high", "low"])

    return run


def hash_of(x: bytes) -> str:
    """Tells queries of one id apart."""
    import xxhash

    return xxhash.xxh64_hexdigest(x)


def op10_metric_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
