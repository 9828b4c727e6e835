"""Byte-level BPE by rank files: encoding with offsets, and decoding."""

from __future__ import annotations

import base64
import hashlib
import heapq
import os
import re
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbflow.llm.chunks import BLANKS, Words, byte_characters, gather, grouped, once, single

MULTI = "byte_bpe_multi_50k.tiktoken"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def merge_by_rank(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Merges the adjacent pair of lowest rank, the leftmost of equals, until none is left."""
    if piece in ranks:
        return [ranks[piece]]
    parts: list[bytes | None] = [piece[i : i + 1] for i in range(len(piece))]
    before, after = list(range(-1, len(parts) - 1)), list(range(1, len(parts) + 1))
    heap = [(r, i, parts[i] + parts[i + 1]) for i in range(len(parts) - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, whole = heapq.heappop(heap)
        j = after[i]
        if parts[i] is None or j >= len(parts) or parts[i] + parts[j] != whole:
            continue
        parts[i], parts[j] = whole, None
        after[i] = after[j]
        if after[i] < len(parts):
            before[after[i]] = i
        for k in (before[i], i):
            if k >= 0 and after[k] < len(parts) and (r := ranks.get(pair := parts[k] + parts[after[k]])) is not None:
                heapq.heappush(heap, (r, k, pair))
    return [ranks[p] for p in parts if p is not None]


class Ranks:
    """A rank file as a model of the tokenizers library.

    The library merges by a list of pairs, the file's own rule by the rank of the merged token. All pairs that make a
    token are listed, in the order of its rank; the library then differs only where two overlapping pairs make the
    same token by different splits. Words that hold such a text are merged by the rule itself.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        self.ranks = read_ranks(path)
        chars = byte_characters()
        text = lambda x: "".join(map(chars.__getitem__, x))
        merges, overlaps = [], set()
        for token in sorted(self.ranks, key=self.ranks.__getitem__):
            splits = [(token[:i], token[i:]) for i in range(1, len(token)) if token[:i] in self.ranks and token[i:] in self.ranks]
            merges += [(text(a), text(b)) for a, b in sorted(splits, key=lambda s: (self.ranks[s[0]], self.ranks[s[1]]))]
            if len(splits) > 1:
                overlaps |= {a + b + d for a, b in splits for c, d in splits if c == b and (a, b) != (c, d)}
        self.own = Tokenizer(models.BPE(vocab={text(t): r for t, r in self.ranks.items()}, merges=merges, ignore_merges=True))
        self.own.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(public_tokenizers.PATTERN), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.model = self.own.model
        self.pieces = regex.compile(public_tokenizers.PATTERN.replace(r"\s", r"\p{White_Space}")).findall
        self.overlap = b"|".join(map(re.escape, sorted(overlaps)))
        order = sorted(self.ranks.values())
        size = np.zeros(order[-1] + 1 if order else 0, np.int64)
        for token, r in self.ranks.items():
            size[r] = len(token)
        self.size, self.start = size, np.cumsum(size) - size
        self.bytes = np.frombuffer(b"".join(sorted(self.ranks, key=self.ranks.__getitem__)), np.uint8)

    def _exact(self, text: str) -> list[int]:
        out: list[int] = []
        for piece in self.pieces(text):
            out += merge_by_rank(piece.encode(), self.ranks)
        return out

    def encode(self, words: Sequence[str], plain: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, one after another, and how many each has."""
        ids, sizes = single(self.model, words) if plain else grouped(self.own, words)
        hits = pc.match_substring_regex(pa.array(words, pa.string()).cast(pa.binary()), self.overlap).to_numpy(zero_copy_only=False).astype(bool) if self.overlap and len(words) else np.zeros(len(words), bool)
        if not hits.any():
            return ids, sizes
        exact = [self._exact(words[i]) for i in np.flatnonzero(hits)]
        left = ids[np.repeat(~hits, sizes)]
        sizes = sizes.copy()
        sizes[hits] = [len(e) for e in exact]
        out = np.empty(int(sizes.sum()), np.uint32)
        of = np.repeat(hits, sizes)
        out[~of], out[of] = left, list(chain.from_iterable(exact))
        return out, sizes

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of ids and where each id's end; an id without a token raises KeyError."""
        ids = ids.astype(np.int64)
        if len(ids) and (ids.max() >= len(self.size) or not self.size[ids].all()):
            raise KeyError("an id that the vocabulary has not")
        return gather(self.bytes, self.start, self.size, ids)


_ranks: dict[str, Ranks] = {}


def ranks_of(path: str) -> Ranks:
    if path not in _ranks:
        _ranks[path] = Ranks(path)
    return _ranks[path]


def _library(path: str):
    return ranks_of(path).encode


def words_of(path: str) -> Words:
    return once(BLANKS, path, _library)


def encode_texts(texts: Sequence[str | None], path: str) -> list[bytes]:
    """The ids of whole texts, little-endian unsigned 32-bit; lone surrogates count as U+FFFD."""
    own = pa.array([None if t is None else t.encode("utf-16", "surrogatepass").decode("utf-16", "replace") for t in texts], pa.string())
    return [found.of(i).astype("<u4").tobytes() for _, found in words_of(path).many(own) for i in range(len(found.begin))]


def encode_text(text: str | None, path: str) -> bytes:
    return encode_texts([text], path)[0]


def decode_ids(ids: bytes, path: str) -> bytes:
    """The bytes of a text; an id without a token raises KeyError."""
    return ranks_of(path).decode(np.frombuffer(ids, "<u4"))[0].tobytes()


def decode_parts(parts: Sequence[bytes], path: str) -> list[str]:
    """Texts of consecutive slices of ids: a character whose bytes two slices share comes whole with the slice that ends it; what remains incomplete at the end becomes U+FFFD."""
    import codecs

    reader = codecs.getincrementaldecoder("utf-8")("replace")
    return [reader.decode(decode_ids(p, path), final=i == len(parts) - 1) for i, p in enumerate(parts)]


def offsets(text: str, ids: bytes, path: str) -> list[tuple[int, int]]:
    """The characters (start, end) that each id's bytes touch; ids that share a character both have it."""
    at = np.repeat(np.arange(len(text)), [len(c.encode()) for c in text]) if text else np.zeros(0, np.int64)
    ends = ranks_of(path).decode(np.frombuffer(ids, "<u4"))[1]
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends
    return [(int(at[s]), int(at[e - 1]) + 1) for s, e in zip(starts, ends, strict=True)]


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_offsets: bool = False) -> DataFrame:
    """(doc_id, ids binary, n_tokens[, offsets]) of each row; ids are little-endian unsigned 32-bit integers.

    Null texts are empty and have no ids; null and repeated ids, extra columns and empty tables do no harm: one row
    comes out for each that goes in. Texts are whole, of any length.
    """
    kind = "doc_id long, ids binary, n_tokens long" + ", offsets array<struct<start:int,end:int>>" * with_offsets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, found in words_of(path).many(batch.column(1)):
                ids = [found.of(i).astype("<u4").tobytes() for i in range(len(found.begin))]
                columns = [batch.column(0).slice(at, len(ids)), pa.array(ids, pa.binary()), pa.array(found.end - found.begin, pa.int64())]
                if with_offsets:
                    texts = batch.column(1).slice(at, len(ids)).to_pylist()
                    spans = [[{"start": s, "end": e} for s, e in offsets(t or "", i, path)] for t, i in zip(texts, ids, strict=True)]
                    columns.append(pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))))
                yield pa.record_batch(columns, names=["doc_id", "ids", "n_tokens", "offsets"][: len(columns)])

    return _source(docs, id_col, text_col).mapInArrow(run, kind)


def decode(encoded: DataFrame, path: str, ids_col: str = "ids", bytes_col: str = "bytes", text_col: str = "text") -> DataFrame:
    """A table with a column of ids, and their bytes and text (invalid UTF-8 as U+FFFD); null ids give nulls.

    Columns of the table that are named as the two new ones are replaced.
    """

    @F.pandas_udf("b binary, t string")
    def run(ids):
        import pandas as pd

        raw = [None if i is None else decode_ids(i, path) for i in ids]
        return pd.DataFrame({"b": raw, "t": [None if r is None else r.decode("utf-8", "replace") for r in raw]})

    names = [c for c in encoded.columns if c not in (bytes_col, text_col)]
    own = encoded.select(*(F.col(f"`{c}`") for c in names), run(F.col(ids_col)).alias("__decoded"))
    return own.select(*(F.col(f"`{c}`") for c in names), F.col("__decoded.b").alias(bytes_col), F.col("__decoded.t").alias(text_col))


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of the ids and of the bytes that they decode to: (doc_id, n_tokens, ids_sha256, decoded_sha256)."""
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, found in words_of(path).many(batch.column(1)):
                raw, ends = ranks_of(path).decode(found.ids)
                places = np.concatenate([[0], ends])
                ids, text = memoryview(np.ascontiguousarray(found.ids, "<u4")).cast("B"), memoryview(raw)
                own = list(zip(found.begin.tolist(), found.end.tolist(), places[found.begin].tolist(), places[found.end].tolist(), strict=True))
                a = [hashlib.sha256(ids[4 * s : 4 * e]).hexdigest() for s, e, _, _ in own]
                b = [hashlib.sha256(text[s:e]).hexdigest() for _, _, s, e in own]
                yield pa.record_batch([batch.column(0).slice(at, len(own)), pa.array(found.end - found.begin, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=names)

    return _source(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path(MULTI))
