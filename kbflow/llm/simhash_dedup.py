"""Near-duplicate documents by SimHash fingerprints and tiled exact comparison."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbflow.llm.shared import Table, components

SHINGLE = 3
RADIUS = 2
#: Shingles, 64-bit words of a fingerprint, radius and least ratio of lengths for near copies of similarity 0.8: at that
#: similarity two fingerprints differ in 39 of 256 bits, give or take 6; 46 finds nine of ten such pairs.
NEAR = {"n": 5, "width": 4, "radius": 46, "ratio": 0.8}
#: Fingerprints of a tile: what a task holds of two tiles does not grow with the table.
TILE = 32_768
#: Rows of a block inside a tile pair; its columns are what sizes and population counts leave.
BLOCK = 256
#: Most differing bits of the first words of wide near copies: as many as of whole ones, so none is left out by them.
FIRST = NEAR["radius"]
#: Words of wide fingerprints that are compared for all pairs; those within the radius there are compared in full.
LEADING = 2
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_GOLDEN, _MIX = 0x9E3779B97F4A7C15, (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def hashes(text: str | None, n: int = SHINGLE) -> np.ndarray:
    """XXH64 (seed 42) of the n-word shingles, A-Z lower-cased, words between blanks and U+0009 to U+000D; fewer words are one shingle."""
    own = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not own:
        return np.zeros(0, np.uint64)
    joined = b" ".join(own)
    if len(own) <= n:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    lengths = np.fromiter(map(len, own), np.int64, len(own))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[s:e], 42) for s, e in zip(starts[: 1 - n].tolist(), ends[n - 1 :].tolist(), strict=True)], np.uint64)


def majority(found: np.ndarray) -> int:
    """64 bits: each is 1 if it is set in over half of ``found``; none: 0."""
    count = np.zeros(64, np.int64)
    for at in range(0, len(found), 255):
        count += np.unpackbits(found[at : at + 255].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return int(np.packbits(2 * count > len(found), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, n: int = SHINGLE, width: int = 1) -> tuple[int, ...]:
    """``width`` words of 64 bits; those after the first are of the hashes, mixed again for each. Null and wordless texts: 0."""
    return of_hashes(hashes(text, n), width)


def of_hashes(found: np.ndarray, width: int) -> tuple[int, ...]:
    out = [majority(found)]
    for k in range(1, width):
        x = found + np.uint64(_GOLDEN * k % (1 << 64))
        x = (x ^ (x >> np.uint64(30))) * _MIX[0]
        x = (x ^ (x >> np.uint64(27))) * _MIX[1]
        out.append(majority(x ^ (x >> np.uint64(31))))
    return tuple(out)


def _fingerprints(n: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[str | None, tuple] = {}
            out = []
            for text in batch.column(1):
                text = text.as_py()
                if (own := seen.get(text)) is None:
                    found = hashes(text, n)
                    fp = np.array(of_hashes(found, width), "<u8")
                    node = int(fp[0]) if width == 1 else xxhash.xxh64_intdigest(fp.tobytes())
                    own = seen[text] = (fp.tobytes(), node - (1 << 64) if node >> 63 else node, int(np.bitwise_count(fp).sum()), len(found))
                out.append(own)
            columns = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.record_batch([batch.column(0), pa.array(columns[0], pa.binary()), *(pa.array(c, pa.int64()) for c in columns[1:])], names=["doc_id", "fp", "node", "pc", "n"])

    return run


def quarter_counts(fps: np.ndarray) -> np.ndarray:
    """Population counts of the four 16-bit quarters, (n, 4)."""
    return np.bitwise_count(np.ascontiguousarray(fps).view(np.uint16)).reshape(-1, 4).astype(np.int16)


def forest(n: int, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The smallest node connected with each of n nodes by the links (p, q)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[p], label[q])
        before = label.copy()
        np.minimum.at(label, label[p], low)
        np.minimum.at(label, label[q], low)
        np.minimum.at(label, p, low)
        np.minimum.at(label, q, low)
        label = label[label]
        if (label == before).all():
            return label


class Side:
    """A tile: fingerprints (rows, width), in blocks of like sizes and population counts."""

    def __init__(self, fps: np.ndarray, sizes: np.ndarray, by_size: bool) -> None:
        fps = fps.reshape(len(sizes), -1)
        counts = quarter_counts(fps[:, 0])
        keys = (fps[:, 0], *counts.T[::-1], counts.sum(axis=1))
        self.order = np.lexsort((*keys, sizes) if by_size else keys)
        self.fps, self.sizes = np.ascontiguousarray(fps[self.order]), sizes[self.order]
        at = np.arange(0, len(sizes), BLOCK)
        counts = counts[self.order]
        self.low, self.high = np.minimum.reduceat(counts, at, axis=0), np.maximum.reduceat(counts, at, axis=0)
        self.small, self.large = np.minimum.reduceat(self.sizes, at), np.maximum.reduceat(self.sizes, at)


def tile_links(a: Side, b: Side | None, radius: int, ratio: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between the tiles ``a`` and ``b`` (b None: within a), as positions in a followed by b.

    Fingerprints link if they differ in at most ``radius`` bits and the smaller size is at least ``ratio`` of the larger.
    Blocks are compared by exclusive-or and bit count of the LEADING first words, and pairs within the radius there in
    full; a pair of blocks is skipped if the population counts of its quarters, and so of whole fingerprints, differ by more than the
    radius, or no sizes fit. Links of a large group are thinned to a forest as they arise, so that at most one link a
    fingerprint remains.
    """
    own = b is None
    b = a if own else b
    width = a.fps.shape[1]
    shift = 0 if own else len(a.fps)
    n = len(a.fps) + (0 if own else len(b.fps))
    first, *more = [(a.fps[:, k], np.ascontiguousarray(b.fps[:, k])) for k in range(min(width, LEADING))]
    differing = lambda u, v: np.bitwise_count(u[i * BLOCK : (i + 1) * BLOCK, None] ^ v[columns][None, :])
    p, q, held = [], [], 0

    def thin() -> None:
        nonlocal p, q, held
        label = forest(n, np.concatenate(p), np.concatenate(q))
        moved = np.flatnonzero(label != np.arange(n))
        p, q, held = [moved], [label[moved]], 0

    for i in range(len(a.low)):
        gap = (np.maximum(0, b.low - a.high[i]) + np.maximum(0, a.low[i] - b.high)).sum(axis=1)
        near = np.flatnonzero((gap <= radius) & (b.large >= ratio * a.small[i]) & (a.large[i] >= ratio * b.small))
        near = near[near >= i] if own else near
        for part in np.array_split(near, max(1, len(near) // 64)):
            if not len(part):
                continue
            columns = (part[:, None] * BLOCK + np.arange(BLOCK)).ravel()
            columns = columns[columns < len(b.fps)]
            bits = differing(*first)
            for words in more:
                bits += differing(*words)
            x, y = np.nonzero(bits <= radius)
            x, y = x + i * BLOCK, columns[y]
            keep = x != y + shift
            if width > LEADING:
                keep &= np.bitwise_count(a.fps[x] ^ b.fps[y]).sum(axis=1, dtype=np.int64) <= radius
            if ratio:
                keep &= np.minimum(a.sizes[x], b.sizes[y]) >= ratio * np.maximum(a.sizes[x], b.sizes[y])
            p.append(x[keep])
            q.append(y[keep] + shift)
            held += len(p[-1])
            if held > 2_000_000:
                thin()
    if not p:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    thin()
    back = a.order if own else np.concatenate([a.order, b.order + len(a.order)])
    return back[p[0]], back[q[0]]


def _compare(radius: int, ratio: float):
    def run(rows: pa.Table) -> pa.Table:
        held: list[Side | None] = [None, None]
        nodes = [np.zeros(0, np.int64)] * 2
        for side in (0, 1):
            own = rows.filter(pa.compute.equal(rows["side"], side))
            if own.num_rows:
                of = lambda c, kind: np.concatenate([np.frombuffer(x, kind) for x in own[c].to_pylist()])  # noqa: B023, E731
                nodes[side], sizes = of("nodes", "<i8"), of("sizes", "<i8")
                held[side] = Side(of("fps", "<u8"), sizes, ratio > 0)
        p, q = tile_links(held[0], held[1], radius, ratio) if held[0] is not None else (np.zeros(0, np.int64),) * 2
        both = np.concatenate(nodes)
        return pa.table({"a": pa.array(both[p], pa.int64()), "b": pa.array(both[q], pa.int64())})

    return run


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            nodes, sizes, keys = (batch.column(c).to_numpy() for c in (1, 2, 3))
            fps = b"".join(batch.column(0).to_pylist())
            yield pa.record_batch([pa.array([int(batch.column(4)[0].as_py())]), pa.array([fps]), pa.array([nodes.astype("<i8").tobytes()]), pa.array([sizes.astype("<i8").tobytes()]), pa.array([int(keys.min())]), pa.array([int(keys.max())])], names=["part", "fps", "nodes", "sizes", "lo", "hi"])


def links(reps: DataFrame, radius: int = RADIUS, ratio: float = 0.0, tile: int = TILE) -> DataFrame:
    """Links (a, b) of nodes whose components are those of all linked pairs of ``reps`` (fp, node, pc, n; fp distinct).

    Fingerprints are dealt to tiles of about ``tile`` in order of their size, or without a ratio of their population
    count; so the tiles that a tile can have links with follow each other. The driver sees two counts a tile and finds
    the first and the last of those; pairs are made by the executors. A task compares one pair of tiles.
    """
    spark = reps.sparkSession
    n = reps.count()
    if not n:
        return spark.createDataFrame([], "a long, b long")
    tiles = -(-n // tile)
    key = F.col("n" if ratio else "pc")
    dealt = reps.select("fp", "node", "n", key.alias("key")).repartitionByRange(4 * tiles, "key", "node").withColumn("part", F.spark_partition_id().cast("long"))
    packed = Table(dealt.mapInArrow(_pack, "part long, fps binary, nodes binary, sizes binary, lo long, hi long"), "tiles").df
    ends = packed.agg(F.max("part")).first()[0]
    held = packed.withColumn("tile", F.expr(f"part * {tiles} div {ends + 1}"))
    ranges = sorted((r["tile"], r["lo"], r["hi"]) for r in held.groupBy("tile").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect())
    names, low, high = (np.array(c, np.int64) for c in zip(*ranges, strict=True))
    last = np.searchsorted(low, np.maximum.accumulate(high) / ratio if ratio else np.maximum.accumulate(high) + radius, side="right") - 1
    since = np.searchsorted(last, np.arange(len(last)), side="left")
    rows = [(int(t), i, int(since[i]), int(last[i])) for i, t in enumerate(names)]
    roles = F.broadcast(spark.createDataFrame(rows, "tile long, at int, since int, last int"))  # a row a tile
    pairs = F.explode(F.expr("transform(sequence(since, last), x -> struct(least(at, x) AS i, greatest(at, x) AS j, int(x < at) AS side))"))
    sent = held.join(roles, "tile").select("fps", "nodes", "sizes", pairs.alias("p")).select("p.*", "fps", "nodes", "sizes")
    return sent.groupBy("i", "j").applyInArrow(_compare(radius, ratio), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = SHINGLE, radius: int = RADIUS, width: int = 1, ratio: float = 0.0) -> DataFrame:
    """Each row's fingerprint and group: (doc_id, fingerprint, component_id).

    Texts: A-Z lower-cased, words between blanks, n-word shingles with repeats; fewer words: the whole sequence.
    Two documents link at ``radius`` or fewer differing bits of ``width`` times 64, if the smaller one's number of
    shingles is at least ``ratio`` of the larger one's; component_id is the smallest doc_id reachable.
    Null and empty texts have fingerprint zero and link like any other. Repeated rows each come out. A null doc_id
    keeps its row and its links; it never names a group, unless the group has no other id (then null). An empty table
    gives an empty result. Other columns are not read.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    marked = Table(source.mapInArrow(_fingerprints(n, width), "doc_id long, fp binary, node long, pc long, n long"), "fingerprints").df
    reps = Table(marked.groupBy("fp", "node", "pc").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n")), "distinct").df
    joined = Table(links(reps, radius, ratio), "links").df
    classes = components(joined, "a", "b")
    named = Table(reps.select("node", "rep").join(classes, "node", "left").select("node", "rep", F.coalesce("component", "node").alias("component")), "classes").df
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    names = named.join(least, "component").select("node", "component_id")
    shown = F.lower(F.lpad(F.hex("node"), 16, "0") if width == 1 else F.hex("fp"))
    return marked.join(names, "node", "left").select("doc_id", shown.alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **rule) -> DataFrame:
    """``docs`` with the document of the smallest id of each near-duplicate group; of repeated rows one stays. Rows without an id pass unjudged.

    ``rule`` is that of near_duplicates(), near copies of five-word shingles if it is left out.
    """
    judged = docs.where(F.col(id_col).isNotNull())
    own = Table(near_duplicates(judged, id_col, text_col, **(rule or NEAR)), "own").df
    kept = own.where("doc_id = component_id").groupBy(F.col("doc_id").alias("kept")).agg(F.count(F.lit(1)).alias("rows"))
    rows = judged.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("kept"))
    found = rows.join(kept.where("rows = 1"), "kept", "left_semi")
    again = rows.join(kept.where("rows > 1"), "kept", "left_semi").dropDuplicates(["kept"])
    return found.unionByName(again).select("row.*").unionByName(docs.where(F.col(id_col).isNull()))


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
