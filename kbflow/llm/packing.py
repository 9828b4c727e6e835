"""Order-preserving packing: where to cut a stream of documents into sequences, by dynamic programming."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbflow.llm.chunks import SENTENCES, Encoded, gather, once

VOCABULARY = "byte_bpe_50k.json"
SIZE, END = 1024, 0
#: What a cut costs, in tokens of padding: at the end of a document, of a sentence or line, and elsewhere.
AT_DOCUMENT, AT_SENTENCE, ELSEWHERE = 0, 2, 24
#: Ids between two places that may be cut at most.
STRIDE = 64
#: Ids after which settled sequences are written, and bytes of text of a task, about.
HORIZON, TASK_BYTES = 1 << 18, 16 << 20
#: Bytes of texts that are encoded together: a smaller run than elsewhere, as unsettled ids are held beside it.
RUN_BYTES = 3 << 20


def fill(places: np.ndarray, costs: np.ndarray, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray]:
    """Adds places between those that are over ``stride`` apart; places begin with 0 and ascend."""
    gaps = np.diff(places)
    more = (gaps - 1) // stride
    if not more.any():
        return places, costs
    at = np.repeat(places[:-1], more) + stride * (np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more) + 1)
    all_places, all_costs = np.concatenate([places, at]), np.concatenate([costs, np.full(len(at), ELSEWHERE, costs.dtype)])
    order = np.argsort(all_places, kind="stable")
    return all_places[order], all_costs[order]


class Plan:
    """The cuts that minimise padding plus costs, found as places come.

    A sequence of n ids is padded to ``size``, unless n is a power of two. best[j] = costs[j] + the least of
    best[i] + size - (places[j] - places[i]) over windows of at most ``size`` (a monotone queue of best[i] + places[i])
    and of best[i] over windows of a power of two. Neighbouring places are at most ``size`` apart. Ties go to the longer
    window. Cuts are settled as far as all plans agree that a later place may still end in, so they are those that one
    plan over the whole stream has.
    """

    def __init__(self, size: int = SIZE) -> None:
        self.size = size
        self.powers = [1 << k for k in range(size.bit_length()) if 1 << k < size]
        self.places, self.best, self.came = [0], [0], [0]
        self.queue, self.keys = [0], [0]

    def extend(self, places: np.ndarray, costs: np.ndarray) -> None:
        """Places after the last one, ascending."""
        if not len(places):
            return
        lo, own = len(self.places), self.places
        # only what a window can reach
        known = np.concatenate([np.asarray(own[max(0, lo - self.size) :], np.int64), places])
        shift = lo - (len(known) - len(places))
        later, sooner = [], []
        for n in self.powers:
            at = np.searchsorted(known, places - n)
            met = np.flatnonzero(known[at] == places - n)
            later.append(met + lo)
            sooner.append(at[met] + shift)
        later, sooner = np.concatenate([*later, [lo + len(places)]]), np.concatenate([*sooner, [0]])
        order = np.argsort(later, kind="stable")
        later, sooner = later[order].tolist(), sooner[order].tolist()
        own.extend(places.tolist())
        best, came, queue, keys, size = self.best, self.came, self.queue, self.keys, self.size
        head = hit = 0
        for j, cost in enumerate(costs.tolist(), lo):
            at = own[j]
            while own[queue[head]] < at - size:
                head += 1
            source = queue[head]
            least = keys[head] + size - at
            while later[hit] == j:
                k = sooner[hit]
                hit += 1
                if best[k] < least or best[k] == least and k < source:
                    least, source = best[k], k
            least += cost
            best.append(least)
            came.append(source)
            key = least + at
            while len(keys) > head and keys[-1] > key:
                keys.pop()
                queue.pop()
            queue.append(j)
            keys.append(key)
        del queue[:head], keys[:head]

    def settle(self, final: bool) -> list[int]:
        """Places of the cuts that no later place changes; what is left counts from the last of them."""
        last = len(self.places) - 1
        if not final:
            open_ = np.zeros(last + 1, bool)
            first = int(np.searchsorted(self.places, self.places[last] - self.size))
            open_[first:] = True
            n, at = last + 1 - first, last
            while n > 1:
                if open_[at]:
                    if open_[self.came[at]]:
                        n -= 1
                    open_[at], open_[self.came[at]] = False, True
                at -= 1
            last = int(np.flatnonzero(open_)[0])
        cuts, j = [], last
        while j:
            cuts.append(self.places[j])
            j = self.came[j]
        base, paid = self.places[last], self.best[last]
        self.places = [p - base for p in self.places[last:]]
        self.best = [b - paid for b in self.best[last:]]
        self.came = [max(0, c - last) for c in self.came[last:]]
        self.queue = [q - last for q in self.queue]
        self.keys = [k - base - paid for k in self.keys]
        return cuts[::-1]


class _Stream:
    """Documents in order; only those whose sequences are not settled yet are held."""

    def __init__(self, size: int, horizon: int) -> None:
        self.plan, self.size, self.horizon = Plan(size), size, horizon
        self.ids, self.doc_ids = [np.zeros(0, np.uint32)], []
        self.begin, self.end = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.waiting, self.sequence, self.due = 0, 0, horizon

    def add(self, doc_ids: list, found: Encoded, last: int) -> None:
        n = found.end - found.begin
        ids, ends = gather(found.ids, found.begin, n, np.arange(len(n)))
        whole = np.arange(1, len(n) + 1) + ends  # with the end id
        order = np.argsort(found.begin, kind="stable")
        at = np.searchsorted(found.end[order], found.marks)
        own = order[at]
        inner = found.marks < found.end[own]
        marks = (found.marks - found.begin[own] + (whole - n - 1)[own])[inner]
        places = np.concatenate([marks, whole])
        costs = np.concatenate([np.full(len(marks), AT_SENTENCE, np.int64), np.full(len(whole), AT_DOCUMENT, np.int64)])
        order = np.argsort(places, kind="stable")
        fine, fine_costs = fill(np.concatenate([[0], places[order]]), np.concatenate([[0], costs[order]]), min(STRIDE, self.size))
        self.plan.extend(fine[1:] + self.waiting, fine_costs[1:])
        self.ids.append(np.insert(ids, ends, last).astype("<u4"))
        self.doc_ids += doc_ids
        self.begin = np.concatenate([self.begin, whole - n - 1 + self.waiting])
        self.end = np.concatenate([self.end, whole + self.waiting])
        self.waiting += len(self.ids[-1])

    def full(self) -> bool:
        return self.waiting >= self.due

    def take(self, final: bool, with_ids: bool) -> list[pa.Array]:
        """Pieces of the settled sequences: doc_id, start, length, ids_crc32, doc_tokens, sequence, offset[, ids]."""
        cuts = np.array(self.plan.settle(final), np.int64)
        limit = int(cuts[-1]) if len(cuts) else 0
        ids = np.concatenate(self.ids)
        marks = np.union1d(cuts, self.end[self.end <= limit])
        starts = np.concatenate([[0], marks[:-1]]) if len(marks) else marks
        of_doc = np.searchsorted(self.end, starts, side="right")
        of_cut = np.searchsorted(cuts, starts, side="right")
        raw = memoryview(np.ascontiguousarray(ids)).cast("B")
        pieces = list(zip((4 * starts).tolist(), (4 * marks).tolist(), strict=True))
        columns = [
            pa.array([self.doc_ids[d] for d in of_doc.tolist()], pa.int64()), pa.array(starts - self.begin[of_doc]), pa.array(marks - starts), pa.array([zlib.crc32(raw[s:e]) for s, e in pieces], pa.int64()),
            pa.array((self.end - self.begin)[of_doc]), pa.array(self.sequence + of_cut), pa.array(starts - np.concatenate([[0], cuts])[of_cut]),
        ]
        if with_ids:
            columns.append(pa.array([bytes(raw[s:e]) for s, e in pieces], pa.binary()))
        self.sequence += len(cuts)
        done = int(np.searchsorted(self.end, limit, side="right"))
        self.ids, self.doc_ids = [ids[limit:]], self.doc_ids[done:]
        self.begin, self.end = self.begin[done:] - limit, self.end[done:] - limit
        self.waiting -= limit
        self.due = max(self.horizon, 2 * self.waiting)
        return columns


def pack(docs: DataFrame, path: str, size: int = SIZE, end: int = END, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, horizon: int = HORIZON, task_bytes: int = TASK_BYTES) -> DataFrame:
    """Pieces of documents in sequences of at most ``size`` ids: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]).

    A document is its whole text's ids and ``end``; null texts are empty. Documents follow each other by doc_id (null
    ids first, rows of one id by their text, each a document of its own). Ranges of them, of ``task_bytes`` of text or
    one document, are packed apart, each by the cuts of least cost over the whole range; a task holds what is not
    settled yet, about ``horizon`` ids, and a run of texts. sequence_id is unique and ascends with doc_id, with gaps
    between ranges. Other columns are not read; an empty table has no pieces.
    """
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence", "offset", "ids"][: 8 if with_ids else 7]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, stream = once(SENTENCES, path), _Stream(size, horizon)
        for batch in batches:
            for at, found in own.many(batch.column(1), RUN_BYTES):
                stream.add(batch.column(0).slice(at, len(found.begin)).to_pylist(), found, end)
                if stream.full():
                    yield pa.record_batch(stream.take(False, with_ids), names=names)
        yield pa.record_batch(stream.take(True, with_ids), names=names)

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    held = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    keys = ["doc_id", "h", "row"]
    keyed = source.withColumn("h", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    ordered = keyed.repartitionByRange(max(1, -(-held // task_bytes)), *keys).sortWithinPartitions(*keys).select("doc_id", "text")
    kind = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence long, offset long" + ", ids binary" * with_ids
    return ordered.mapInArrow(run, kind).withColumn("sequence_id", F.shiftleft(F.spark_partition_id().cast("long"), 40) + F.col("sequence")).select(*[n if n != "sequence" else "sequence_id" for n in names])


def sequences(pieces: DataFrame, size: int = SIZE, pad: int = END) -> DataFrame:
    """(sequence_id, ids array, n_pieces) of packed pieces with ids: at most ``size`` ids each, padded unless a power of two."""

    @F.pandas_udf("array<int>")
    def whole(parts):
        def of(own):
            ids = np.concatenate([np.frombuffer(p["ids"], "<u4") for p in own]).astype(np.int32)
            n = len(ids)
            return ids if n & (n - 1) == 0 else np.pad(ids, (0, size - n), constant_values=pad)

        return parts.map(of)

    held = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("own"))
    return held.select("sequence_id", whole(F.transform("own", lambda p: F.struct(p["ids"].alias("ids")))).alias("ids"), F.size("own").alias("n_pieces"))


def padding(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """One row: n_sequences, n_ids, and padded, the ids that padding adds."""
    own = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    pad = F.when(F.bit_count("n") == 1, 0).otherwise(size - F.col("n"))
    return own.agg(F.count(F.lit(1)).alias("n_sequences"), F.sum("n").alias("n_ids"), F.sum(pad).alias("padded"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path(VOCABULARY))
