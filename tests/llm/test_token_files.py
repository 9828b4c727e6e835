import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from kbflow.llm import token_files as T

PATH = P.path(T.VOCABULARY)


def table_of(ids):
    return T.Frequencies.of(*np.unique(ids, return_counts=True)) if len(ids) else T.Frequencies.of(np.zeros(0), np.zeros(0))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 5), st.integers(0, 2**32 - 1)), max_size=300), max_size=8), st.integers(1, 40), st.integers(1, 9))
def test_round_trip(documents, lanes, every):
    documents = [np.asarray(d, np.uint32) for d in documents]
    ids = np.concatenate(documents) if documents else np.zeros(0, np.uint32)
    table = table_of(ids)
    block = T.encode_block(documents, table, lanes, every)
    got, lengths = T.decode_block(block, table)
    assert got.tolist() == ids.tolist() and lengths.tolist() == [len(d) for d in documents]


def test_parts_damage_and_size():
    rng = np.random.default_rng(0)
    ids = (rng.zipf(1.3, 400_000) % 49_000).astype(np.uint32)
    table = table_of(ids)
    block = T.encode_block([ids], table)
    assert T.decode_block(block, table, range(1, 3))[0].tolist() == ids[128 * 1024 : 3 * 128 * 1024].tolist()
    p = np.unique(ids, return_counts=True)[1] / len(ids)
    assert len(block) < 1.1 * len(ids) * -(p * np.log2(p)).sum() / 8
    broken = bytearray(block)
    broken[len(block) // 2] ^= 4
    with pytest.raises(ValueError):
        T.decode_block(bytes(broken), table)
    with pytest.raises(ValueError):
        T.encode_block([np.asarray([123_456], np.uint32)], table)


def test_documents(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + [(-3, None), (10**9, ""), (10**9 + 1, "Ünï  CÖde\x1c 日本 " * 50)]
    frame = spark.createDataFrame([(i, t, i) for i, t in rows], "doc_id long, text string, start long")
    own = Tokenizer.from_file(PATH)
    own.encode_special_tokens = True
    at, want = 0, []
    for i, text in sorted(rows):
        ids = np.asarray([*own.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    files = T.write(frame, PATH, block_ids=5000)
    assert sorted(map(tuple, files.digests().collect())) == want
    assert sorted((r.doc_id, r.n_tokens, zlib.crc32(bytes(r.ids))) for r in files.read().collect()) == [(a, c, d) for a, _, c, d in want]


def test_another_session_opens_the_files(spark, tmp_path):
    frame = spark.createDataFrame([(2, "b c"), (1, "a")], "doc_id long, text string")
    want = sorted(map(tuple, T.write(frame, PATH, out=str(tmp_path / "files")).digests().collect()))
    assert [r[:2] for r in want] == [(1, 0), (2, want[0][2])]
    assert sorted(map(tuple, T.TokenFiles(spark.newSession(), str(tmp_path / "files")).digests().collect())) == want


def test_one_id_in_many_tasks(spark):
    frame = spark.range(300).selectExpr("7L AS doc_id", "concat('word ', id % 3) AS text")
    got = sorted(map(tuple, T.write(frame, PATH, task_ids=100).digests().collect()), key=lambda r: r[1])
    assert len(got) == 300 and [r[1] for r in got] == np.cumsum([0] + [r[2] for r in got[:-1]]).tolist()


def test_null_and_repeated_ids_and_empty(spark):
    frame = spark.createDataFrame([(None, "a b"), (5, "x"), (5, "x"), (5, "y z")], "doc_id long, text string")
    got = sorted(map(tuple, T.write(frame, PATH).digests().collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [None, 5, 5, 5] and [r[1] for r in got] == np.cumsum([0] + [r[2] for r in got[:-1]]).tolist()
    assert T.write(frame.limit(0), PATH).digests().count() == 0
