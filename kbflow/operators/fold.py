"""Operators that go through a key's rows in order: a step depends on the state that the last one left."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def store(rows: list[tuple[int, np.ndarray, float]], join: float, same: float) -> list[tuple[int, str, int]]:
    """(seq, action, cluster) of records (seq, unit vector, score) in order.

    The nearest record at ``same`` or more: ``replaced`` if the new score is higher, else ``skipped``. Otherwise the
    nearest centroid at ``join`` or more takes the record (``added``), else it begins a cluster (``new_cluster``).
    """
    records: list[list] = []  # vector, score, cluster
    sums: list[np.ndarray] = []
    out = []
    for seq, v, score in rows:
        if records:
            sims = np.array([r[0] for r in records]) @ v
            at = int(np.argmax(sims))
            if sims[at] >= same:
                old = records[at]
                if score > old[1]:
                    sums[old[2]] = sums[old[2]] - old[0] + v
                    records[at] = [v, score, old[2]]
                    out.append((seq, "replaced", old[2]))
                else:
                    out.append((seq, "skipped", old[2]))
                continue
            centroids = np.array([s / max(float(np.linalg.norm(s)), 1e-10) for s in sums])
            c = int(np.argmax(near := centroids @ v))
            if near[c] >= join:
                sums[c] = sums[c] + v
                records.append([v, score, c])
                out.append((seq, "added", c))
                continue
        sums.append(v.copy())
        records.append([v, score, len(sums) - 1])
        out.append((seq, "new_cluster", len(sums) - 1))
    return out


def cluster_store(df: DataFrame, join: float, same: float) -> DataFrame:
    """(topic, seq, action, cluster) of rows (topic, seq, v, score): a fold within each topic, whose store is held in one task."""

    def run(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("seq")
        rows = [(s, np.asarray(v, np.float64), float(p)) for s, v, p in zip(own["seq"], own["v"], own["score"], strict=True)]
        found = pd.DataFrame(store(rows, join, same), columns=["seq", "action", "cluster"])
        found.insert(0, "topic", own["topic"].iloc[0])
        return found

    return df.groupBy("topic").applyInPandas(run, "topic int, seq long, action string, cluster int")


def miss_lru(last: dict[int, int], asked: list[tuple[int, float, int]], hit: float, window: int) -> int:
    """One window of queries (nearest resident at its start, its similarity, nearest pool document); the evictions. ``last`` is changed.

    ``last``: when each resident was last used. All hits of the window refresh their residents first; then each miss
    takes the pool's document in for the one unused longest (ties to the smaller id), or refreshes it if it is held.
    """
    for resident, sim, _ in asked:
        if sim >= hit:
            last[resident] = window
    gone = 0
    for _, sim, fetched in asked:
        if sim >= hit or not last:
            continue
        if fetched not in last:
            del last[min(last, key=lambda d: (last[d], d))]
            gone += 1
        last[fetched] = window
    return gone


def miss_tiny_lfu(freq: dict[int, int], fetched_freq: dict[int, int], asked: list[tuple[int, float, int]], hit: float) -> int:
    """As miss_lru(), by counts: ``freq`` of residents' uses and ``fetched_freq`` of all misses, both changed.

    A document comes in if it was fetched at least as often as the least used resident was used, and starts at 0.
    """
    for resident, sim, _ in asked:
        if sim >= hit:
            freq[resident] += 1
    gone = 0
    for _, sim, fetched in asked:
        if sim >= hit or not freq:
            continue
        fetched_freq[fetched] = fetched_freq.get(fetched, 0) + 1
        if fetched in freq:
            freq[fetched] += 1
            continue
        victim = min(freq, key=lambda d: (freq[d], d))
        if fetched_freq[fetched] >= freq[victim]:
            del freq[victim]
            freq[fetched] = 0
            gone += 1
    return gone


def arrivals(held: dict[int, np.ndarray], seen: dict[int, int], new: list[tuple[int, np.ndarray]], window: int, like: float = 0.7, unlike: float = 0.3) -> int:
    """Documents (d, unit vector) that arrive: one like a resident replaces it, one unlike all replaces the stalest; the changes.

    ``held`` and ``seen`` (when a resident came) are changed as documents come, so that later ones meet earlier ones.
    Ties go to the smaller id; an arrival that is held is only seen anew.
    """
    n = 0
    for d, v in new:
        if d in held:
            seen[d] = window
            continue
        if not held:
            break
        own = sorted(held)
        sims = np.array([held[x] for x in own]) @ v
        best = float(sims.max())
        if like >= best >= unlike:
            continue
        old = own[int(sims.argmax())] if best > like else min(own, key=lambda x: (seen.get(x, -1), x))
        del held[old]
        seen.pop(old, None)
        held[d], seen[d] = v, window
        n += 1
    return n


def edits(kb: set[int], targets: list[tuple[int, list[tuple[int, float]]]], low: float, high: float) -> int:
    """Residents that are swapped for the most like document outside ``kb`` with a similarity between the bounds; the swaps.

    targets: (resident, documents by falling similarity), in order; a swap changes what later ones find.
    """
    n = 0
    for d, near in targets:
        if d in kb and (best := next((x for x, s in near if low < s < high and x not in kb), None)) is not None:
            kb.discard(d)
            kb.add(best)
            n += 1
    return n


class Ledger:
    """What is asked for and what serves, over windows: demand and serve decay by a factor and go below ``least``."""

    def __init__(self, kb: list[int], decay: float = 0.92, least: float = 0.01, prior: float = 1.0) -> None:
        self.decay, self.least = decay, least
        self.kb, self.demand, self.serve = set(kb), {}, dict.fromkeys(kb, prior)

    def step(self, asked: list[tuple[int, float, list[tuple[int, float]]]], hit: float, redundancy: dict[int, float], dup: set[int], gain: float = 0.4, red: float = 0.85, weight: float = 1.5, budget: int | None = None, extra: dict[int, float] | None = None) -> int:
        """One window of queries (nearest resident, its similarity, pool documents by falling similarity); the writes.

        A hit serves its resident. A miss asks for its first document, and shares ``gain`` among all by similarity.
        Documents in demand, best first and ties to the larger id, replace residents of the least value, ties to the
        smaller id, as long as they are worth more: a resident's value is what it serves and is asked for, less
        ``weight`` for what its ``redundancy`` (similarity to its nearest neighbour) is over ``red``. Documents in
        ``dup`` are too like a resident and are passed over. ``extra`` is demand that comes by other ways.
        """
        for own in (self.demand, self.serve):
            kept = {d: v * self.decay for d, v in own.items() if v * self.decay >= self.least}
            own.clear()
            own.update(kept)
        missed = [near for _, sim, near in asked if sim < hit]
        for resident, sim, _ in asked:
            if sim >= hit:
                self.serve[resident] = self.serve.get(resident, 0.0) + 1.0
        if not missed or not self.kb:
            return 0
        for near in missed:
            total = sum(max(0.0, s) for _, s in near)
            for i, (d, s) in enumerate(near):
                self.demand[d] = self.demand.get(d, 0.0) + (i == 0) + (gain * max(0.0, s) / total if total > 0 else 0.0)
        for d, v in (extra or {}).items():
            self.demand[d] = self.demand.get(d, 0.0) + v
        value = {d: self.serve.get(d, 0.0) + self.demand.get(d, 0.0) - weight * max(0.0, redundancy.get(d, 0.0) - red) for d in self.kb}
        out = iter(sorted(value, key=lambda d: (round(value[d], 9), d)))
        n, victim = 0, next(out)
        for d in sorted((d for d in self.demand if d not in value), key=lambda d: (-round(self.demand[d], 9), -d)):
            if victim is None or budget is not None and n >= budget or round(self.demand[d], 9) <= round(value[victim], 9):
                break
            if d in dup:
                continue
            self.kb.discard(victim)
            self.kb.add(d)
            self.serve.pop(victim, None)
            n, victim = n + 1, next(out, None)
        return n


def greedy_cover(sims: np.ndarray, weights: np.ndarray, budget: int) -> list[int]:
    """Documents chosen one by one by their gain of sum_c weight_c * max_d sim[c, d]; stops when none gains. Ties to the first."""
    best, chosen = np.zeros(len(weights)), []
    while len(chosen) < min(budget, sims.shape[1]):
        gain = weights @ np.maximum(0.0, sims - best[:, None])
        gain[chosen] = -1.0
        at = int(np.argmax(gain))
        if gain[at] <= 0:
            break
        chosen.append(at)
        best = np.maximum(best, sims[:, at])
    return chosen


def frechet(a_mean: np.ndarray, a_cov: np.ndarray, b_mean: np.ndarray, b_cov: np.ndarray, eps: float = 1e-5) -> float:
    """Distance of two normal distributions, regularised: |m|^2 + tr(A + B - 2 (A B)^(1/2)), never below 0."""
    a, b = a_cov + eps * np.eye(len(a_cov)), b_cov + eps * np.eye(len(b_cov))
    roots = np.sqrt(np.clip(np.linalg.eigvals(a @ b).real, 0, None)).sum()
    return max(0.0, float(((a_mean - b_mean) ** 2).sum() + np.trace(a) + np.trace(b) - 2 * roots))


def decide(steps: list[tuple[bool, float]], warmup: int = 3, beta: float = 0.85, k: float = 1.5, cooldown: int = 2, limit: int = 3) -> list[str]:
    """An action for each window (drifted, gap): aggressive while it warms up (the last of these recalibrates), then none
    in a cool-down, recalibrate after ``limit`` drifts in a row, aggressive after a drift, mild at a high gap, or none.

    Every update after the warm-up begins a cool-down. The running mean takes a window's gap in before it is judged, and
    the deviation is taken from the new mean.
    """
    mean = spread = 0.0
    rest = row = 0
    out = []
    for i, (drifted, gap) in enumerate(steps):
        mean = gap if i == 0 else beta * mean + (1 - beta) * gap
        spread = 0.0 if i == 0 else beta * spread + (1 - beta) * abs(gap - mean)
        row = row + 1 if drifted else 0
        if i < warmup:
            action = "warmup" if i < warmup - 1 else "warmup_recalibrate"
        elif rest:
            action, rest = "cooldown", rest - 1
        elif row >= limit:
            action, row, rest = "recalibrate", 0, cooldown
        elif drifted:
            action, rest = "aggressive", cooldown
        elif gap > mean + k * max(spread, 0.01):
            action, rest = "mild", cooldown
        else:
            action = "none"
        out.append(action)
    return out


def decide_simple(steps: list[tuple[bool, float]], beta: float = 0.85, k: float = 1.5) -> list[str]:
    """The same without warm-up and cool-down; a gap is judged by the mean and deviation of the windows before it."""
    mean = spread = None
    out = []
    for drifted, gap in steps:
        high = mean is not None and gap > mean + k * max(spread, 0.01)
        out.append("aggressive" if drifted else "mild" if high else "none")
        spread = 0.0 if mean is None else beta * spread + (1 - beta) * abs(gap - mean)
        mean = gap if mean is None else beta * mean + (1 - beta) * gap
    return out


def farthest(x: np.ndarray, n: int) -> list[int]:
    """n rows of unit vectors, each the farthest by cosine from those before it, from the first row on; ties to the first."""
    if not len(x):
        return []
    chosen, near = [0], x @ x[0]
    while len(chosen) < min(n, len(x)):
        near[chosen] = np.inf
        at = int(np.argmin(near))
        chosen.append(at)
        near = np.maximum(near, x @ x[at])
    return chosen


def means(x: np.ndarray, k: int, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """(label of each row, centroids) by k-means of unit vectors under cosine; starts from farthest rows, ties to the first."""
    centres = x[farthest(x, k)]
    label = np.full(len(x), -1)
    for _ in range(rounds):
        now = np.argmax(x @ centres.T, axis=1)
        if (now == label).all():
            break
        label = now
        for c in range(len(centres)):
            if (label == c).any():
                own = x[label == c].mean(axis=0)
                centres[c] = own / max(float(np.linalg.norm(own)), 1e-10)
    return label, centres


def silhouette(x: np.ndarray, label: np.ndarray) -> float:
    """Mean silhouette of unit vectors under cosine distance; 0 for a row alone in its cluster, and for fewer than two clusters."""
    kinds = np.unique(label)
    if len(kinds) < 2:
        return 0.0
    far = 1 - x @ x.T
    total = np.array([far[:, label == c].sum(axis=1) for c in kinds])
    size = np.array([(label == c).sum() for c in kinds])
    at = np.searchsorted(kinds, label)
    rows = np.arange(len(x))
    own = total[at, rows] / np.maximum(1, size[at] - 1)
    mean = total / size[:, None]
    mean[at, rows] = np.inf
    other = mean.min(axis=0)
    score = np.where(size[at] > 1, (other - own) / np.maximum(np.maximum(own, other), 1e-12), 0.0)
    return float(score.mean())


def best_k(x: np.ndarray, low: int = 2, high: int = 10) -> tuple[int, np.ndarray, np.ndarray]:
    """(k, centroids, weights) of the k with the best silhouette, the least of equals; one or two rows are their own centroids."""
    if len(x) <= 2:
        return len(x), x, np.full(len(x), 1 / max(1, len(x)))
    found = [(-silhouette(x, (own := means(x, k))[0]), k, *own) for k in range(low, min(high, len(x) - 1) + 1)]
    _, k, label, centres = min(found, key=lambda f: (round(f[0], 12), f[1]))
    return k, centres, np.bincount(label, minlength=len(centres)) / len(x)


def recurate(current: list[int], ideal: list[int], gain: dict[int, float], interest: dict[int, float], share: float) -> tuple[list[int], list[int]]:
    """(added, removed): the step from ``current`` towards ``ideal`` with at most ``share`` of the current documents changed.

    Missing documents of the largest gain come, surplus ones of the least interest go, as many of one as of the other;
    ties to the smaller id.
    """
    most = max(1, int(share * len(current))) if current else len(ideal)
    add = sorted(set(ideal) - set(current), key=lambda d: (-gain.get(d, 0.0), d))
    gone = sorted(set(current) - set(ideal), key=lambda d: (interest.get(d, 0.0), d))
    n = min(most, len(add), len(gone)) if current else min(most, len(add))
    return add[:n], gone[:n]


def walk(near: dict[int, list[int]], n: int) -> list[int]:
    """A walk over n nodes at most: to the first neighbour that was not seen, else to the least node that was not."""
    if not near:
        return []
    rest = sorted(near)
    at, seen, out = rest[0], set(), []
    while len(out) < min(n, len(near)):
        out.append(at)
        seen.add(at)
        nxt = next((x for x in sorted(near[at]) if x not in seen and x in near), None)
        at = nxt if nxt is not None else next((x for x in rest if x not in seen), at)
    return out


def topic_add(rows: list[np.ndarray], like: float, most: int) -> list[int]:
    """The cluster of each unit vector in order: the nearest centroid at ``like`` or more, else a new one, beyond ``most`` the nearest."""
    sums: list[np.ndarray] = []
    out = []
    for v in rows:
        sims = [float(s @ v) / max(float(np.linalg.norm(s)), 1e-10) for s in sums]
        at = int(np.argmax(sims)) if sims else -1
        if at < 0 or sims[at] < like and len(sums) < most:
            sums.append(v.copy())
            at = len(sums) - 1
        else:
            sums[at] = sums[at] + v
        out.append(at)
    return out
