"""Token ids as files of blocks coded by a static range asymmetric numeral system.

One table of frequencies serves all blocks. A block holds whole documents and decodes alone; inside, LANES coders
with a state each take every LANES-th id and share one stream of 32-bit words. Checkpoints in a block hold the states
and the place in the stream every CHECKPOINT steps, so that parts of a block decode apart from each other, and each
part between checkpoints has a checksum of its ids. Blocks are rows of Parquet files in the shared folder: that is
what every store can hold, a task that is run again leaves no half-written file, and readers choose blocks by columns.

A folder of files has ``blocks``, those rows, and ``table``, one row: the scale, and ids and frequencies as little-endian
32-bit integers. Both together are all that a reader needs.

Block: magic ``RANS``, then little-endian 32-bit: version, scale bits, lanes, ids, documents, checkpoints, words,
crc32 of all that follows; then the lengths of the documents (32-bit each), the checkpoints (lane states 64-bit each,
place in the words, crc32 of the part's ids), and the words.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kbflow.llm.chunks import WORDS, binary, gather, once
from kbflow.llm.shared import Table, work_path

VOCABULARY = "word_bpe_49k.json"
END = 1
LANES, CHECKPOINT = 1024, 128
#: Ids at which a block is closed; a longer document has a block of its own. Ids of a task, about.
BLOCK_IDS, TASK_IDS = 1 << 18, 1 << 21
LOW = np.uint64(1 << 31)
_32 = np.uint64(32)
_HEAD = struct.Struct("<4s8I")


class Frequencies:
    """Counts scaled to a power of two, at least 1 for each id that occurs."""

    def __init__(self, ids: np.ndarray, freq: np.ndarray, bits: int) -> None:
        """ids: those that occur, ascending; freq: their shares of 2**bits."""
        self.ids, self.bits = np.asarray(ids, np.uint32), bits
        self.freq = np.asarray(freq, np.uint64)
        self.start = np.cumsum(self.freq) - self.freq
        self.limit = (LOW >> np.uint64(bits) << _32) * self.freq
        self._slots: np.ndarray | None = None

    @classmethod
    def of(cls, ids: np.ndarray, counts: np.ndarray) -> Frequencies:
        """From how often each id occurs over all documents."""
        bits = min(24, max(12, int(max(1, len(ids)) - 1).bit_length() + 3))
        total = 1 << bits
        freq = np.maximum(1, np.floor(np.asarray(counts, float) * (total / max(1, np.sum(counts))))).astype(np.int64)
        order = np.argsort(-freq, kind="stable")
        while len(freq) and (rest := total - int(freq.sum())):  # the most frequent ids give or take what rounding left
            if rest > 0:
                freq[order[0]] += rest
            else:
                for k in order:
                    rest += (take := min(int(freq[k]) - 1, -rest))
                    freq[k] -= take
                    if not rest:
                        break
        return cls(ids, freq, bits)

    def positions(self, ids: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.ids, ids) if not len(ids) or ids.max() >= 1 << 22 else self._places()[ids]
        if len(ids) and (at.max() >= len(self.ids) or (self.ids[at] != ids).any()):
            raise ValueError("an id that the table of frequencies has not")
        return at

    def _places(self) -> np.ndarray:
        if not hasattr(self, "_by_id"):
            self._by_id = np.full(1 << 22, len(self.ids), np.int32)
            small = self.ids[self.ids < 1 << 22]
            self._by_id[small] = np.arange(len(small))
        return self._by_id

    @property
    def slots(self) -> np.ndarray:
        if self._slots is None:
            self._slots = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))
        return self._slots


def encode_block(documents: list[np.ndarray], table: Frequencies, lanes: int = LANES, every: int = CHECKPOINT) -> bytes:
    ids = np.concatenate(documents) if documents else np.zeros(0, np.uint32)
    lengths = np.fromiter(map(len, documents), np.uint32, len(documents))
    n, bits = len(ids), np.uint64(table.bits)
    at = table.positions(ids)
    steps = -(-n // lanes)
    state = np.full(lanes, LOW, np.uint64)
    words: list[np.ndarray] = []
    marks: list[tuple[np.ndarray, int]] = []
    written = 0
    for step in range(steps - 1, -1, -1):
        own = at[step * lanes : (step + 1) * lanes]
        x, freq = state[: len(own)], table.freq[own]
        over = x >= table.limit[own]
        if over.any():
            words.append(x[over].astype(np.uint32))
            written += len(words[-1])
            x[over] >>= _32
        share = x // freq
        state[: len(own)] = (share << bits) + (x - share * freq) + table.start[own]
        if step % every == 0:
            marks.append((state.copy(), written))
    marks.reverse()
    body = [lengths.tobytes()]
    for k, (states, done) in enumerate(marks):
        part = ids[k * every * lanes : (k + 1) * every * lanes]
        body.append(states.tobytes() + struct.pack("<II", written - done, zlib.crc32(part.tobytes())))
    body += [w.tobytes() for w in reversed(words)]
    rest = b"".join(body)
    return _HEAD.pack(b"RANS", 1, table.bits, lanes, n, len(lengths), len(marks), written, zlib.crc32(rest)) + rest + struct.pack("<I", every)


def decode_block(block: bytes, table: Frequencies, parts: range | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(ids, lengths of documents) of a block; ``parts``: only the ids between these checkpoints. Damage raises ValueError."""
    magic, version, bits, lanes, n, documents, marks, words, crc = _HEAD.unpack_from(block)
    if magic != b"RANS" or version != 1 or bits != table.bits or zlib.crc32(block[_HEAD.size : -4]) != crc:
        raise ValueError("damaged block, or not of this table")
    every = struct.unpack("<I", block[-4:])[0]
    place = _HEAD.size
    lengths = np.frombuffer(block, "<u4", documents, place)
    place += 4 * documents
    size = 8 * lanes + 8
    stream = np.frombuffer(block, "<u4", words, place + marks * size)
    mask, shift, out = np.uint64((1 << bits) - 1), np.uint64(bits), []
    for k in range(marks) if parts is None else parts:
        state = np.frombuffer(block, "<u8", lanes, place + k * size).astype(np.uint64)
        at, crc = struct.unpack_from("<II", block, place + k * size + 8 * lanes)
        found = []
        for step in range(k * every, min((k + 1) * every, -(-n // lanes))):
            x = state[: min(lanes, n - step * lanes)]
            slot = x & mask
            own = table.slots[slot]
            found.append(own)
            x = table.freq[own] * (x >> shift) + slot - table.start[own]
            if (under := x < LOW).any():
                more = int(under.sum())
                x[under] = (x[under] << _32) | stream[at : at + more]
                at += more
            state[: len(x)] = x
        ids = table.ids[np.concatenate(found)]
        if zlib.crc32(ids.tobytes()) != crc:
            raise ValueError(f"part {k} does not have its checksum")
        out.append(ids)
    return np.concatenate(out) if out else np.zeros(0, np.uint32), lengths


def _encode_texts(path: str, end: int, width: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = once(WORDS, path)
        for batch in batches:
            for at, found in own.many(batch.column(1)):
                n = found.end - found.begin
                ids, ends = gather(found.ids, found.begin, n, np.arange(len(n)))
                whole = np.insert(ids, ends, end).astype(width)
                ends = (ends + np.arange(1, len(ends) + 1)) * whole.itemsize
                yield pa.record_batch([batch.column(0).slice(at, len(n)), binary(whole.view(np.uint8), ends)], names=["doc_id", "ids"])

    return run


def _count(width: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            if batch.num_rows:
                own = np.bincount(np.concatenate([np.frombuffer(x.as_buffer(), width) for x in batch.column(0)]))
                total = np.pad(total, (0, max(0, len(own) - len(total))))
                total[: len(own)] += own
        ids = np.flatnonzero(total)
        yield pa.record_batch([pa.array(ids.astype(np.int64)), pa.array(total[ids])], names=["id", "n"])

    return run


def _blocks(table: Frequencies, limit: int, width: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, docs, size, number = [], [], 0, 0

        def closed() -> pa.RecordBatch:
            block = encode_block(docs, table)
            return pa.record_batch([pa.array([number]), pa.array([ids_of], pa.list_(pa.int64())), pa.array([size]), pa.array([block])], names=["block", "doc_ids", "n_ids", "data"])

        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = np.frombuffer(ids.as_buffer(), width).astype(np.uint32)
                if docs and size + len(own) > limit:
                    yield closed()
                    ids_of, docs, size, number = [], [], 0, number + 1
                ids_of.append(doc_id)
                docs.append(own)
                size += len(own)
        if docs:
            yield closed()

    return run


class TokenFiles:
    """A folder of token files; the table of frequencies has a row for each id of the vocabulary at most, a bound that no input changes."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        """Open what write() left at ``path``."""
        self.path = path
        self.blocks = spark.read.schema("block long, doc_ids array<long>, n_ids long, data binary, part int").parquet(f"{path}/blocks")
        held = spark.read.parquet(f"{path}/table").first()
        self.table = Frequencies(np.frombuffer(held["ids"], "<u4"), np.frombuffer(held["freq"], "<u4"), held["bits"])

    def read(self) -> DataFrame:
        """(doc_id, start, n_tokens, ids binary) of each document: start is the count of ids before it, ids are little-endian 32-bit."""
        return self._read("doc_id long, start long, n_tokens long, ids binary", lambda ids: ids.tobytes(), pa.binary())

    def digests(self) -> DataFrame:
        """As read(), with the crc32 of the ids in place of the ids."""
        return self._read("doc_id long, start long, n_tokens long, ids_crc32 long", lambda ids: zlib.crc32(ids.tobytes()), pa.int64())

    def _read(self, kind: str, of, arrow) -> DataFrame:
        table, names = self.table, [f.split(" ")[0] for f in kind.split(", ")]
        sizes = self.blocks.select("part", "block", "n_ids")
        parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
        # a row a task of the writer
        before = parts.select("part", (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).alias("base"))
        own = F.sum("n_ids").over(Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
        starts = Table(sizes.select("part", "block", own.alias("own")).join(before, "part").select("part", "block", F.expr("coalesce(base, 0) + coalesce(own, 0)").alias("start")), "starts").df

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for data, doc_ids, start in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                    ids, lengths = decode_block(data.as_py(), table)
                    ends = np.cumsum(lengths, dtype=np.int64)
                    found = [of(ids[e - n : e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                    yield pa.record_batch([doc_ids.values, pa.array(start.as_py() + ends - lengths), pa.array(lengths.astype(np.int64)), pa.array(found, arrow)], names=names)

        return self.blocks.join(starts, ["part", "block"]).select("data", "doc_ids", "start").mapInArrow(run, kind)


def write(docs: DataFrame, path: str, out: str | None = None, end: int = END, id_col: str = "doc_id", text_col: str = "text", block_ids: int = BLOCK_IDS, task_ids: int = TASK_IDS) -> TokenFiles:
    """Encode whole texts by the tokenizer file ``path``, each followed by ``end``, and write them to the folder ``out`` in ascending order of their ids.

    ``out`` is a folder that executors share; without it the files are a work table, deleted at exit. Null texts are
    empty: only ``end``. Null ids come first; rows of one id follow each other in an order that their ids of tokens
    give, each with its own place, and however many they are, several tasks share them. An empty table gives files without blocks.
    Other columns are not read. Three passes: texts to ids (kept as a work table), counts of all ids, and blocks.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    out = out if out is not None else work_path(spark, "files")
    width = "<u2" if max(end, Tokenizer.from_file(path).get_vocab_size() - 1) < 1 << 16 else "<u4"
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    encoded = Table(source.mapInArrow(_encode_texts(path, end, width), "doc_id long, ids binary").withColumn("h", F.xxhash64("ids")), "ids")
    counts = encoded.df.select("ids").mapInArrow(_count(width), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).orderBy("id").toPandas()
    table = Frequencies.of(counts["id"].to_numpy(np.uint32), counts["n"].to_numpy(np.int64))
    held = [(table.bits, bytearray(table.ids.astype("<u4").tobytes()), bytearray(table.freq.astype("<u4").tobytes()))]
    spark.createDataFrame(held, "bits int, ids binary, freq binary").coalesce(1).write.parquet(f"{out}/table")
    parts = max(1, -(-int(counts["n"].sum()) // task_ids))
    keys = ["doc_id", "h", "row"]
    ordered = encoded.df.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    blocks = ordered.select("doc_id", "ids").mapInArrow(_blocks(table, block_ids, width), "block long, doc_ids array<long>, n_ids long, data binary").withColumn("part", F.spark_partition_id())
    blocks.write.parquet(f"{out}/blocks")
    encoded.drop()
    return TokenFiles(spark, out)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return write(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path(VOCABULARY)).digests()
