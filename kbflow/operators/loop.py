"""The loop over windows: each window's queries are answered by the knowledge base as it stands, then a policy changes it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kbflow.operators import fold, knn
from kbflow.operators.stream import order_key

#: What a policy's name stands for; a name that is not here is an error.
POLICIES = ("static", "fetch_on_demand", "miss_lru", "miss_tiny_lfu", "arrivals", "demand", "routed", "adaptive")


class Base:
    """A knowledge base of a fixed size on the driver: ids and vectors, at most the budget of them."""

    def __init__(self, docs: dict[int, np.ndarray]) -> None:
        self.docs = dict(docs)

    def top(self, x: np.ndarray, k: int) -> list[list[tuple[int, float]]]:
        """The k nearest residents of each row of ``x``: by similarity, ties to the smaller id."""
        ids = np.array(sorted(self.docs))
        sims = x @ np.array([self.docs[d] for d in ids.tolist()]).T
        order = np.lexsort((np.broadcast_to(ids, sims.shape), -sims), axis=1)[:, :k]
        return [[(int(ids[j]), float(s[j])) for j in o] for o, s in zip(order, sims, strict=True)]

    def near(self, d: int, v: np.ndarray) -> float:
        """The similarity of the resident that is most like ``v``, without ``d`` itself."""
        own = [x for i, x in self.docs.items() if i != d]
        return float((np.array(own) @ v).max()) if own else -1.0


def windows(queries: DataFrame, pool: DataFrame, gold: DataFrame, k: int) -> Iterator[list]:
    """The rows (q, qv, near, gold) of each window in order; near: the k nearest pool documents (d, sim, dv, label).

    What the pool has for a query does not depend on the knowledge base, so it is searched once for all queries, by all
    executors. The driver reads one window after the other.
    """
    found = knn.nearest(queries, pool, k).join(pool.select("d", "dv", "label"), "d")
    near = found.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("rank", "d", "sim", "dv", "label"))).alias("near"))
    held = queries.join(near, "q", "left").join(gold.groupBy("q").agg(F.sort_array(F.collect_set("d")).alias("gold")), "q", "left")
    own, at = [], None
    for row in held.orderBy("window_idx", "q").select("window_idx", "q", "qv", "near", "gold").toLocalIterator():
        if at is not None and row.window_idx != at:
            yield own
            own = []
        at = row.window_idx
        own.append(row)
    if own:
        yield own


def arrivals(windows: DataFrame, pool: DataFrame, n: int, share: float) -> DataFrame:
    """(window_idx, come): for each of ``windows`` (window_idx, a row each) the n pool documents (d, dv) of the smallest keys, in their order.

    All keys are made, and only the smallest of them, ``share`` of all as they are hashes, are sorted: those hold a
    window's n first if they are n at least. A window that has fewer has all documents with such keys here, or no row.
    """
    keyed = windows.repartition(windows.sparkSession.sparkContext.defaultParallelism, "window_idx").crossJoin(pool.select("d")).withColumn("key", order_key("arrive", "window_idx", "d"))
    few = keyed.where(F.col("key") < f"{int(share * 16**8):08x}") if share < 1 else keyed
    few = few.withColumn("n", F.row_number().over(Window.partitionBy("window_idx").orderBy("key", "d"))).where(F.col("n") <= n)
    own = few.select("window_idx", "n", "d").join(pool.select("d", "dv"), "d").groupBy("window_idx")
    return own.agg(F.sort_array(F.collect_list(F.struct("n", "d", "dv"))).alias("come"))


def _coming(queries: DataFrame, pool: DataFrame, n: int, frozen: int) -> Callable[[int], list]:
    """The arrivals of a window, for windows in rising order: found for all windows at once, and by a job of its own for one that has too few there."""
    size = pool.count()
    later = queries.where(F.col("window_idx") >= frozen).select("window_idx").distinct()
    rows = arrivals(later, pool, n, 8 * n / max(1, size)).orderBy("window_idx").toLocalIterator()
    now = next(rows, None)

    def of(window: int) -> list:
        nonlocal now
        while now is not None and now.window_idx < window:
            now = next(rows, None)
        if now is not None and now.window_idx == window and len(now.come) >= min(n, size):
            return now.come
        return pool.orderBy(order_key(f"arrive|{window}", "d"), "d").select("d", "dv").limit(n).collect()

    return of


def run(policy: str, queries: DataFrame, pool: DataFrame, kb: DataFrame, gold: DataFrame, hit: float, budget: int, k: int = 5, arriving: int = 80, cap: int = 200, frozen: int = 0) -> list[tuple]:
    """(policy, window_idx, n_queries, recall, coverage, hit_recall, writes, gap) of each window; recall@k by the base as it stood at the window's start.

    queries (q, qv, window_idx), pool (d, dv, label), kb (d, dv) of ``budget`` documents at most, gold (q, d). Queries
    without gold count in no recall; a window without any has nulls. Nothing changes in the first ``frozen`` windows.
    fetch_on_demand adds, for one window, what missed queries find in the pool. The state on the driver is the knowledge base, counts
    for it and, for demand, a ledger whose entries decay and go.
    """
    if policy not in POLICIES:
        raise ValueError(f"unknown policy {policy!r}; there are {', '.join(POLICIES)}")
    base = Base({r.d: np.asarray(r.dv, float) for r in kb.select("d", "dv").limit(budget).collect()})
    last, freq, fetched, seen = dict.fromkeys(base.docs, -1), dict.fromkeys(base.docs, 0), {}, {}
    ledger = fold.Ledger(list(base.docs))
    steps: list[tuple[bool, float]] = []
    out = []
    coming = _coming(queries, pool, arriving, frozen) if policy == "arrivals" else None
    for own in windows(queries, pool, gold, k):
        window = own[0].window_idx
        x = np.array([r.qv for r in own], float)
        found = base.top(x, k) if base.docs else [[] for _ in own]
        best = [f[0] if f else (-1, -1.0) for f in found]
        near = [r.near or [] for r in own]
        held = set(base.docs)
        if policy == "fetch_on_demand":
            extra = Base(base.docs | {n.d: np.asarray(n.dv, float) for (_, s), own_near in zip(best, near, strict=True) if s < hit for n in own_near})
            found, held = (extra.top(x, k) if extra.docs else found), set(extra.docs)
        golds = [(set(r.gold), {d for d, _ in f}) for r, f in zip(own, found, strict=True) if r.gold]
        rate = lambda of: round(float(np.mean(of)), 6) if golds else None  # noqa: B023, E731
        wanted = set().union(*(g for g, _ in golds)) if golds else set()
        gap = 1 - float(np.mean([s for _, s in best]))
        asked = [(d, s, n) for (d, s), n in zip(best, near, strict=True)]
        writes = 0
        if window >= frozen:
            vectors = {n.d: np.asarray(n.dv, float) for own_near in near for n in own_near}
            first = [(d, s, n[0].d) for d, s, n in asked if n]
            if policy == "miss_lru":
                writes, kept = fold.miss_lru(last, first, hit, window), last
            elif policy == "miss_tiny_lfu":
                writes, kept = fold.miss_tiny_lfu(freq, fetched, first, hit), freq
            elif policy == "arrivals":
                writes = fold.arrivals(base.docs, seen, [(r.d, np.asarray(r.dv, float)) for r in coming(window)], window)
                kept = base.docs
            elif policy in ("demand", "routed", "adaptive"):
                writes = _demand(policy, base, ledger, asked, hit, gap, steps, budget, cap, vectors)
                kept = ledger.kb
            else:
                kept = base.docs
            base.docs = {d: base.docs[d] if d in base.docs else vectors[d] for d in kept}
        out.append((policy, window, len(own), rate([len(g & f) / len(g) for g, f in golds]), round(len(wanted & held) / len(wanted), 6) if wanted else None, rate([bool(g & f) for g, f in golds]), writes, round(gap, 6)))
    return out


def _demand(policy: str, base: Base, ledger: fold.Ledger, asked: list, hit: float, gap: float, steps: list, budget: int, cap: int, vectors: dict) -> int:
    """Demand and serve; ``routed`` adds what shares a label with a missed query's first documents, ``adaptive`` writes only as much as the gap asks for."""
    extra: dict[int, float] = {}
    if policy != "demand":
        missed = [near for _, s, near in asked if s < hit]
        for near in missed:
            labels = [n.label for n in near[:3]]
            for n in {m.d: m for other in missed for m in other}.values():
                if n.label in labels and n.d not in {m.d for m in near[:3]}:
                    extra[n.d] = extra.get(n.d, 0.0) + 0.6 / labels.count(n.label)
        extra = dict(sorted(extra.items(), key=lambda e: (-e[1], e[0]))[:20])
    most = cap
    if policy == "adaptive":
        steps.append((False, gap))
        most = {"none": 0, "mild": max(1, budget // 20), "aggressive": max(1, budget * 15 // 100)}[fold.decide_simple(steps)[-1]] if len(steps) > 1 else cap
    known = {d: v for d, v in vectors.items() if d not in base.docs}
    # a document whose vector was only seen in an earlier window comes in when it is asked for again
    blocked = {d for d in ledger.demand if d not in vectors} | {d for d, v in known.items() if base.near(d, v) > 0.95}
    redundancy = {d: base.near(d, v) for d, v in base.docs.items()}
    return ledger.step([(d, s, [(n.d, n.sim) for n in near]) for d, s, near in asked], hit, redundancy, blocked, budget=most, extra=extra)
