import base64
import hashlib
import random

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from kbflow.llm import byte_bpe as B
from kbflow.llm.chunks import BLANKS, SENTENCES, WORDS, once

PATH = P.path(B.MULTI)
ODD = ["", " ", "  ", "a", " a", "a ", "a  b", "a \n b", "\n\n  x\t y", "erere ererere aaaaaaaaaaa =======", "don't we'll 'S", "x\x1cy \x1dz", " a  b　c", "日本語 テキスト", "é éa ́b", "👩‍👩‍👧 🇩🇪", "١٢٣ ²½ 12345", "a" * 3000, " " * 500 + "x", "Σίσυφος İstanbul ǅ", "\r\n\r\n", "<|endoftext|> x", "\x85 ᠎ ​ x"]


@pytest.fixture(scope="module")
def exact():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def noise(n, seed):
    rng = random.Random(seed)
    letters = ["ere", "er", "e", "re", "aha", "...", "ana", " ", " ", "\n", "  ", "\t", "!", "'s", "9", "é", "ß", "日", "́", "о", "го", " ", "=", "\x1c"]
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(n)]


def test_as_tiktoken(exact):
    for text in ODD + noise(3000, 1):
        ids = np.frombuffer(B.encode_text(text, PATH), "<u4").tolist()
        assert ids == exact.encode_ordinary(text), repr(text)
        assert B.decode_ids(B.encode_text(text, PATH), PATH) == text.encode()


def test_other_files_as_the_library():
    for name, rule in (("byte_bpe_50k.json", BLANKS), ("byte_bpe_50k.json", SENTENCES), ("word_bpe_49k.json", WORDS)):
        own = Tokenizer.from_file(P.path(name))
        own.encode_special_tokens = True
        texts = ODD + noise(3000, 2)
        got = [found.of(i).tolist() for _, found in once(rule, P.path(name)).many(pa.array([None, *texts])) for i in range(len(found.begin))]
        assert got == [[], *(own.encode(text, add_special_tokens=False).ids for text in texts)]


def test_forgotten_words(monkeypatch):
    from kbflow.llm import chunks

    texts = noise(400, 3)
    want = [B.encode_text(t, PATH) for t in texts]
    monkeypatch.setattr(chunks, "CACHED", 20)
    monkeypatch.setattr(chunks, "TOGETHER", 200)
    assert B.encode_texts(texts, PATH) == want


def test_documents_and_round_trip(spark, sf, exact):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = B.round_trip(docs, PATH).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = exact.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_rows(spark):
    frame = spark.createDataFrame([(None, None, 1), (7, "né", 2), (7, "né", 2)], "doc_id long, text string, ids int")
    rows = B.decode(B.encode(frame, PATH, with_offsets=True), PATH).collect()
    assert sorted((str(r.doc_id), r.text) for r in rows) == [("7", "né"), ("7", "né"), ("None", "")]
    assert all(r.offsets[-1].end == 2 for r in rows if r.text)
    assert B.encode(frame.limit(0), PATH).count() == 0


def test_clashing_columns(spark):
    frame = B.encode(spark.createDataFrame([(1, "né")], "doc_id long, text string"), PATH)
    row = B.decode(frame.selectExpr("*", "'x' AS text", "1 AS bytes"), PATH).first()
    assert (row.text, bytes(row.bytes)) == ("né", "né".encode())
    with pytest.raises(KeyError):
        B.decode_ids(np.asarray([10**6], "<u4").tobytes(), PATH)


def test_split_characters():
    ids = B.encode_text("日本👩 x", PATH)
    parts = [ids[i : i + 4] for i in range(0, len(ids), 4)]
    assert "".join(B.decode_parts(parts, PATH)) == "日本👩 x"
    assert B.decode_parts([B.encode_text("👩", PATH)[:4]], PATH) == ["\ufffd"]
    spans = B.offsets("日本", B.encode_text("日本", PATH), PATH)
    assert spans[0][0] == 0 and spans[-1][1] == 2
