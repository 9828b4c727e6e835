import random
from collections import Counter

from kbflow.llm import host_quality as Q


def slow(text):
    for c in "\t\n\x0b\x0c\r":
        if c != "\n":
            text = (text or "").replace(c, " ")
    own = [w for w in text.replace("\n", " ").split(" ") if w]
    wins = [tuple(own[i : i + 3]) for i in range(len(own) - 2)]
    many = Counter(wins)
    covered = {i + k for i, w in enumerate(wins) if many[w] > 1 for k in range(3)}
    return len(own), sum(map(len, own)), sum(text.count(c) for c in "#*$%&|<>"), len(covered)


def dup_lines(text):
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\x0b\x0c\r")]
    return len(lines) - len(set(lines))


def test_measures(spark):
    rng = random.Random(4)
    texts = [None, "", " \n\t", "a", "a b", "a b c a b c", "x\x0by\x0cz\r\n" * 40, "é | # <é> % a\u00a0b\u2003c", "w " * 20_000]
    texts += [" ".join(rng.choice("abcd") for _ in range(rng.randrange(60))).replace("d a", "d\na") for _ in range(200)]
    frame = spark.createDataFrame([(i, t, "h", 1) for i, t in enumerate(texts)], "doc_id long, text string, source string, words int")
    got = {r.doc_id: r for r in Q.measures(frame).collect()}
    for i, t in enumerate(texts):
        n, chars, symbols, repeats = slow(t)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup_lines(t), repeats), t
        assert r.base_failed == (n < 50 or 100 * repeats > 50 * n)


def test_hosts(spark):
    good, bad = " ".join(f"w{i}" for i in range(60)), "too short"
    rows = [(i, good, "good") for i in range(50)] + [(100 + i, bad if i < 48 else good, "bad") for i in range(50)] + [(200, bad, "small"), (201, good, None), (None, good, "good"), (201, good, None), (203, None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for limit in (100, 0):
        got = Q.judge(frame, broadcast_hosts=limit).collect()
        assert len(got) == len(rows)
        kept = Counter((r.host, r.kept) for r in got)
        assert kept == {("good", True): 51, ("bad", False): 50, ("small", False): 1, (None, True): 2, (None, False): 1}
    assert Q.judge(frame.limit(0)).count() == 0
    alone = Q.judge(frame.where("source = 'small'")).collect()
    assert [r.kept for r in alone] == [False]


def test_as_sql(same):
    same(Q.op3_host_quality, Q.SQL, "/root/testdata/sf0.01", ["documents"])
