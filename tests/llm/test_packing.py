import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from kbflow.llm import packing as K
from kbflow.llm.chunks import SENTENCES, once

PATH = P.path(K.VOCABULARY)


def pad(n, size):
    return 0 if n & (n - 1) == 0 else size - n


def slow(places, costs, size):
    best = [0.0] + [float("inf")] * (len(places) - 1)
    for j in range(1, len(places)):
        for i in range(j):
            if (n := places[j] - places[i]) <= size:
                best[j] = min(best[j], best[i] + pad(n, size) + costs[j])
    return best[-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 12), st.sampled_from([0, 2, 24])), min_size=1, max_size=60), st.sampled_from([12, 16, 20]), st.sampled_from([1, 3, 7, 60]))
def test_plan_is_optimal(steps, size, run):
    places = np.cumsum([0] + [s for s, _ in steps]).tolist()
    costs = [0] + [c for _, c in steps]
    own, cuts, base = K.Plan(size), [], 0
    for k in range(1, len(places), run):  # as places come, settled in between
        own.extend(np.array(places[k : k + run]) - base, np.array(costs[k : k + run]))
        cuts += [base + c for c in own.settle(k + run >= len(places))]
        base = cuts[-1] if cuts else 0
    at = [0, *cuts]
    of = dict(zip(places, costs, strict=True))
    assert at[-1] == places[-1] and all(0 < b - a <= size for a, b in zip(at, at[1:]))
    assert sum(pad(b - a, size) for a, b in zip(at, at[1:])) + sum(of[c] for c in cuts) == slow(places, costs, size)


def test_fill():
    places, costs = K.fill(np.array([0, 10, 200, 264]), np.array([0, 2, 0, 0]), 64)
    assert places.tolist() == [0, 10, 74, 138, 200, 264] and costs.tolist() == [0, 2, 24, 24, 0, 0]


def test_marks():
    own = Tokenizer.from_file(PATH)
    own.encode_special_tokens = True
    texts = ["", "A b. C d\nE f! g", "a  b.\n\nc", " x.", "x\x00 y. z", "", "word " * 300, "日本。語\nx", "Mr. X, y? z"]
    [(_, found)] = once(SENTENCES, PATH).many(pa.array(texts))
    ends = [[own.decode(found.of(i)[: m - found.begin[i]].tolist()) for m in found.marks.tolist() if found.begin[i] < m < found.end[i]] for i in range(len(texts))]
    assert ends[1] == ["A b.", "A b. C d\n", "A b. C d\nE f!"] and ends[8] == ["Mr.", "Mr. X, y?"] and ends[0] == ends[5] == ends[6] == []
    assert all(e.endswith((".", "!", "?", "…", "。", "！", "？", "\n")) for own in ends for e in own)


def test_settled_as_one_plan():
    """Padding and costs of a stream that is settled early are those of a plan over all of it."""
    rng = np.random.default_rng(4)
    places = np.unique(np.cumsum(rng.integers(1, 64, 4000)))
    costs = rng.choice([0, 2, 24], len(places))
    whole = K.Plan(1024)
    whole.extend(places, costs)
    want = whole.settle(True)
    parts, cuts, base = K.Plan(1024), [], 0
    for k in range(0, len(places), 500):
        parts.extend(places[k : k + 500] - base, costs[k : k + 500])
        cuts += [base + c for c in parts.settle(False)]
        base = cuts[-1] if cuts else 0
    assert len(cuts) > 50
    cuts += [base + c for c in parts.settle(True)]
    assert cuts == want


def verify(rows, docs, size=1024):
    own = Tokenizer.from_file(PATH)
    own.encode_special_tokens = True
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == set(docs)
    for i, text in docs.items():
        ids = np.asarray([*own.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for own_rows in by_seq.values():
        at = 0
        for r in sorted(own_rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size
    order = [(r.sequence_id, r.offset) for r in sorted(rows, key=lambda r: (r.doc_id, r.start))]
    assert order == sorted(order)


def test_documents(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    docs |= {-1: None, 10**9: "", 10**9 + 1: "x" * 9000, 10**9 + 2: "long line without an end " * 4000}
    frame = spark.createDataFrame([(i, t, 0) for i, t in docs.items()], "doc_id long, text string, offset int")
    pieces = K.pack(frame, PATH, horizon=20_000, task_bytes=200_000)
    verify(pieces.collect(), docs)
    found = K.padding(pieces).first()
    assert found.padded < 0.02 * found.n_ids
    held = K.sequences(K.pack(frame, PATH, with_ids=True)).collect()
    assert all(len(r.ids) == 1024 or len(r.ids) & (len(r.ids) - 1) == 0 for r in held)


def test_rows(spark):
    frame = spark.createDataFrame([(None, "a b"), (5, "x"), (5, "x")], "doc_id long, text string")
    assert [(r.doc_id, r.start, r.doc_tokens) for r in K.pack(frame, PATH).orderBy("sequence_id", "offset").collect()][0] == (None, 0, 3)
    assert K.pack(frame, PATH).count() >= 3
    assert K.pack(frame.limit(0), PATH).count() == 0
