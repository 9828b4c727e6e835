import hashlib
import random
import re
from collections import Counter

from kbflow.llm import secrets as S

RNG = random.Random(3)
B64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


def rand(alphabet, n):
    return "".join(RNG.choice(alphabet) for _ in range(n))


def slow_base(text):
    out = []
    low = "".join(c.lower() if c.isascii() else c for c in text)
    at = 0
    while m := re.compile(r"""(password|passwd|secret|token|api_?key)["']? *[:=] *["']?""").search(low, at):
        end = m.end()
        while end < len(text) and text[end] in B64 + "_.=-":
            end += 1
        if end == m.end():
            at = m.start() + 1
            continue
        if end - m.end() >= 6:
            out.append((m.start(), 0, end))
        at = end
    for kind, head, body, least in ((1, "AKIA", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 20), (2, "", "0123456789abcdef", 24)):
        i = 0
        while i < len(text):
            j = i + len(head)
            if text.startswith(head, i):
                while j < len(text) and text[j] in body:
                    j += 1
                if j > i + len(head):
                    out += [(i, kind, j)] * (j - i >= least)
                    i = j
                    continue
            i += 1
    return sorted(out)


def test_base_against_slow_search():
    bits = ["password", "PassWD", " = ", ":", '"', "tokens ", "api_key=", "APIKEY: 'abcdef", "abc", "AKIA", "AKIA" + "A1" * 8, "0123456789abcdef" * 2, "ß", "ſecret=abcdefg", "\n", "-", " ", "secret", "=="]
    for _ in range(3000):
        text = "".join(RNG.choice(bits) for _ in range(RNG.randrange(12)))
        assert S.base_spans(text) == slow_base(text), text


WRITTEN = """keitlichenlichkeitbe internationalization getElementByIdentifier some_long_identifier_name thinkingaboutnothing
Donaudampfschifffahrtsgesellschaft anticonstitutionnellement ACKNOWLEDGEMENTSECTION the-quick-brown-fox-jumps-over
src/main/java/org/example/Service max_connections_per_host_v2 CamelCaseClassNameFactoryBean aaaaaaaaaaaaaaaaaaaaaaaa""".split()


def test_battery_tells_random_from_written():
    for w in WRITTEN:
        p, uniform = S.battery(w)
        assert p > 1e-3 or uniform < 1e-3, (w, p)
    for alphabet, n in (("0123456789abcdef", 40), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 80), (B64, 20), (B64, 44)):
        assert sum(S.battery(rand(alphabet, n))[0] < 1e-3 and S.battery(rand(alphabet, n))[1] > 1e-3 for _ in range(200)) > 180, (alphabet, n)
    assert S.battery("a" * 40)[1] < 1e-6


def test_recall_and_false_finds(spark, sf):
    """Fifty random tokens of one alphabet among the texts of a table and written tokens: recall by alphabet and length."""
    texts = [r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + [f"see {w} there" for w in WRITTEN * 40]
    real = [c for t in texts for c in S.candidates(t)]
    for name, n, least in ((B64[:-2], 20, 0.9), (B64, 24, 0.95), (B64, 32, 0.95), ("0123456789ABCDEF", 24, 0.9), (B64[26:-2], 40, 0.9), (B64[:26] + "234567", 64, 0.9)):
        planted = [S.candidates(rand(name, n))[0] for _ in range(50)]
        counts = Counter((c[2], c[3]) for c in real + planted)
        own = S.limits_of(counts)
        found = lambda cs: sum(c[4] and c[3] >= own[c[2]] for c in cs)  # noqa: B023, E731
        assert found(planted) >= least * 50, (name, n, found(planted))
        written = [c for w in WRITTEN * 40 for c in S.candidates(w)]
        assert found(written) == 0


def test_control():
    own = S.limits_of({(0, 0): 1000, (0, 200): 3, (1, 20): 5})
    assert own[0] <= 200 and own[1:] == [S.BINS] * 4
    assert S.limits_of({}) == [S.BINS] * 5


def test_documents(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    secret = rand(B64[:-2], 44)
    texts |= {-1: None, -2: "", -3: f"see {secret} there", -4: "password=hunter2x and " + "plain words " * 9000}
    frame = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc_id long, text string, spans string")
    rows = {r.doc_id: r for r in S.scan(frame).collect()}
    assert len(rows) == len(texts)
    for i, r in rows.items():
        base = slow_base(texts[i] or "")
        joined = ",".join(f"{S.KINDS[k]}:{s}:{e}" for s, k, e in base)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == n for _, k, _ in base) for n in range(3))
        assert [x for x in r.spans.split(",") if not x.startswith("random")] == (joined.split(",") if joined else [""] if not r.n_random else [])
    assert rows[-3].spans == f"random:4:{4 + len(secret)}"
    assert sum(r.n_random for r in rows.values()) < 3
    clean = {r.doc_id: r.text for r in S.redact(frame).collect()}
    assert clean[-1] is None and clean[-3] == "see [SECRET] there" and clean[-4].startswith("[SECRET] and plain")


def test_touching_spans():
    text = "AKIA" + "A1B2C3D4E5F6G7H8" + "0a" * 12 + " x"
    assert S.redact_text(text, [S.BINS] * 5) == "[SECRET] x"
    assert S.redact_text("x " + text, [S.BINS] * 5) == "x [SECRET] x"


def test_odd_rows(spark):
    frame = spark.createDataFrame([(None, "token=abcdefgh"), (3, "x"), (3, "x")], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.n_assign) for r in S.scan(frame).collect()) == [("3", 0), ("3", 0), ("None", 1)]
    assert S.scan(frame.limit(0)).count() == 0 and S.redact(frame.limit(0)).count() == 0
