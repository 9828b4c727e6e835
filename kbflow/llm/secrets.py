"""Secrets in whole texts: fixed patterns, and a battery of randomness tests with control of false discoveries."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "random")
MARK = "[SECRET]"
#: Characters of the shortest candidate of the battery, and the lengths at which classes of length begin.
SHORTEST, CLASSES = 20, (20, 24, 32, 48, 96)
#: Share of false discoveries in each class of length, and the least joint p-value of the tests for uniformity.
RATE, UNIFORM = 1e-2, 1e-3
#: In written text, of neighbouring characters so many at most are of different classes (small letters, capitals, digits,
#: others), and of neighbouring letters so many at least are a vowel and a consonant.
CHANGES, TURNS = 0.15, 0.5
#: Bins of -log10 p: counts of candidates by class and bin are all that control needs, a table of fixed size.
BINS, PER_UNIT = 2001, 20

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile("AKIA[A-Z0-9]+")
_HEX = re.compile("[0-9a-f]{24,}")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % SHORTEST)
_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Encodings from the narrowest alphabet to the widest.
ENCODINGS = (
    ("decimal", _DIGITS), ("hex", _DIGITS + "abcdef"), ("HEX", _DIGITS + "ABCDEF"), ("lower", _LOWER), ("upper", _UPPER), ("base32", _UPPER + "234567"), ("lower36", _DIGITS + _LOWER), ("upper36", _DIGITS + _UPPER),
    ("letters", _UPPER + _LOWER), ("base62", _DIGITS + _UPPER + _LOWER), ("base64", _UPPER + _LOWER + _DIGITS + "+/"), ("base64url", _UPPER + _LOWER + _DIGITS + "-_"), ("other", _UPPER + _LOWER + _DIGITS + "+/-_="),
)
#: Weights of what people write: letters as in European prose, capitals and digits seldom.
_LETTERS = dict(zip(_LOWER, (8.2, 1.6, 3.4, 4.2, 13.4, 2.0, 2.1, 3.3, 7.2, 0.3, 0.7, 4.2, 2.5, 7.4, 6.8, 2.4, 0.5, 6.4, 6.6, 7.6, 3.3, 1.1, 1.3, 0.4, 1.2, 0.4), strict=True))
_WRITTEN = {**{c: w for c, w in _LETTERS.items()}, **{c.upper(): 0.15 * w for c, w in _LETTERS.items()}, **dict.fromkeys(_DIGITS, 0.4), **dict.fromkeys("+/-_=", 2.0)}


class _Encoding:
    def __init__(self, alphabet: str) -> None:
        self.k = k = len(alphabet)
        self.value = np.full(128, -1, np.int64)
        self.value[[ord(c) for c in alphabet]] = np.arange(k)
        small = any(c.islower() for c in alphabet)
        share = np.array([_WRITTEN[c if small else c.lower()] for c in alphabet])  # capitals alone are written like small letters
        share = share / share.sum()
        self.mean_0, self.bend = k * (share * (1 - share)).sum(), k * ((share - 1 / k) ** 2).sum()


_CLASS = bytes(0 if chr(c) in _LOWER else 1 if chr(c) in _UPPER else 2 if chr(c) in _DIGITS else 3 for c in range(256))
_VOWEL = bytes(1 if chr(c) in "aeiouyAEIOUY" else 0 if chr(c) in _LOWER + _UPPER else 2 for c in range(256))
_TABLES = [(set(a), _Encoding(a)) for _, a in ENCODINGS]


def _normal(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def _chi_tail(x: float, df: float) -> float:
    """Upper tail of chi-squared, by the cube-root approximation."""
    c = 2 / (9 * df)
    return _normal(-(((max(x, 0) / df) ** (1 / 3)) - (1 - c)) / math.sqrt(c))


@lru_cache(maxsize=100_000)
def _at_least(k: int, n: int, p: float) -> float:
    """How often at least k of n come up, each with probability p; large n by the normal distribution."""
    if k <= 0:
        return 1.0
    if n > 400:
        return _normal((n * p - k + 0.5) / math.sqrt(n * p * (1 - p)))
    return min(1.0, math.fsum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k, n + 1)))


def _joint(own: list[float]) -> float:
    """Fisher's joint p-value of independent ones."""
    half, term, total = -sum(math.log(max(p, 1e-300)) for p in own), 1.0, 1.0
    for i in range(1, len(own)):
        term *= half / i
        total += term
    return math.exp(-half) * total


def battery(text: str) -> tuple[float, float]:
    """(p_written, p_uniform) of a candidate in the narrowest encoding that has all its characters; '=' at the end is padding.

    Three statistics: chi-squared of the alphabet, runs of classes of characters, and how letters follow each other.
    p_written is Fisher's joint p-value that written text would look as random: its letters are as uniform (a shifted
    normal under written frequencies), its classes change as often, and vowels and consonants alternate as seldom.
    p_uniform is the joint p-value of a uniform random string: chi-squared, runs above and below the middle of the
    alphabet, and correlation with the next character.
    """
    own = text.rstrip("=") or text
    raw = own.encode("ascii")
    chars = set(own)
    table = next(t for a, t in _TABLES if chars <= a)
    n, k = len(own), table.k
    x = table.value[np.frombuffer(raw, np.uint8)]
    count = np.bincount(x, minlength=k)
    chi = float(k * (count * count).sum() / n - n)
    shift = n * table.bend
    written = [_normal((chi - table.mean_0 - shift) / math.sqrt(2 * (k - 1) + 4 * shift))]
    kind = np.frombuffer(raw.translate(_CLASS), np.uint8)
    if changes := int(np.count_nonzero(kind[1:] != kind[:-1])):
        written.append(_at_least(changes, n - 1, CHANGES))
    vowel = np.frombuffer(raw.translate(_VOWEL), np.uint8)
    pairs = vowel[1:] + vowel[:-1]
    letters = int(np.count_nonzero((vowel[1:] < 2) & (vowel[:-1] < 2)))
    if letters:
        written.append(_at_least(letters - int(np.count_nonzero(pairs == 1)), letters, 1 - TURNS))
    above = x >= k / 2
    ups = int(above.sum())
    downs = n - ups
    runs = 1 + int((above[1:] != above[:-1]).sum())
    if ups and downs:
        mean = 1 + 2 * ups * downs / n
        var = max(1e-9, (mean - 1) * (mean - 2) / max(1, n - 1))
        p_runs = 2 * _normal(-abs(runs - mean) / math.sqrt(var)) if var > 1e-6 else 1.0
    else:
        p_runs = 0.5 ** (n - 1)
    off = x - x.mean()
    scale = float((off * off).sum())
    p_serial = 2 * _normal(-abs(float((off[1:] * off[:-1]).sum()) / scale + 1 / n) * math.sqrt(n)) if scale else 0.0
    return _joint(written), _joint([_chi_tail(chi, k - 1), min(1, p_runs), min(1, p_serial)])


def candidates(text: str) -> list[tuple[int, int, int, int, bool]]:
    """(start, end, class of length, bin of p_written, whether uniform) of each candidate."""
    out = []
    for m in _CANDIDATE.finditer(text):
        p, uniform = battery(m[0])
        size = sum(len(m[0]) >= c for c in CLASSES) - 1
        out.append((m.start(), m.end(), size, min(BINS - 1, int(-math.log10(max(p, 1e-300)) * PER_UNIT)), uniform >= UNIFORM))
    return out


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, kind's place, end) of what the patterns find, in code points; matches that are too short are dropped after the search."""
    out = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= 20] if "AKIA" in text else []
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def all_spans(text: str, limits: list[int]) -> tuple[list, list]:
    """(base spans, all spans): the battery adds candidates that no base span touches, at or over their class's limit."""
    base = base_spans(text)
    more = [(s, 3, e) for s, e, size, at, uniform in candidates(text) if uniform and at >= limits[size] and all(e <= b or s >= d for b, _, d in base)]
    return base, sorted(base + more)


def limits_of(counts: dict[tuple[int, int], int], rate: float = RATE) -> list[int]:
    """The least bin of each class of length at which Benjamini and Hochberg's rule admits; BINS if none."""
    out = []
    for size in range(len(CLASSES)):
        own = np.array([counts.get((size, b), 0) for b in range(BINS)])
        found, total = np.cumsum(own[::-1])[::-1], own.sum()
        p = 10.0 ** (-np.arange(BINS) / PER_UNIT)  # the largest p of each bin
        good = np.flatnonzero((found > 0) & (p * total <= rate * found))
        out.append(int(good[0]) if len(good) else BINS)
    return out


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(len(CLASSES) * BINS, np.int64)
    for batch in batches:
        for text in batch.column(0):
            for _, _, size, at, _ in candidates(text.as_py() or ""):
                total[size * BINS + at] += 1
    at = np.flatnonzero(total)
    yield pa.record_batch([pa.array(at // BINS), pa.array(at % BINS), pa.array(total[at])], names=["size", "bin", "n"])


def limits(docs: DataFrame, text_col: str = "text", rate: float = RATE) -> list[int]:
    """Limits from the candidates of all texts; at most len(CLASSES) * BINS counts reach the driver."""
    held = docs.select(F.col(text_col).cast("string")).mapInArrow(_tally, "size long, bin long, n long").groupBy("size", "bin").agg(F.sum("n").alias("n")).collect()
    return limits_of({(r["size"], r["bin"]): r["n"] for r in held}, rate)


def _joined(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = RATE) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random) of each row.

    Spans are kind:start:end in code points, by start and then kind. Null texts are empty; null and repeated ids give
    a row each; other columns are not read; an empty table gives none.
    """
    own = limits(docs, text_col, rate)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1):
                base, found = all_spans(text.as_py() or "", own)
                kinds = [k for _, k, _ in found]
                rows.append((*(kinds.count(k) for k in range(3)), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(found), kinds.count(3)))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            yield pa.record_batch([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long")


def redact_text(text: str, own: list[int]) -> str:
    """Spans that touch or overlap become one mark."""
    out, at = [], 0
    for s, _, e in all_spans(text, own)[1]:
        if s > at or not out:
            out += [text[at:s], MARK]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text_col: str = "text", rate: float = RATE) -> DataFrame:
    """``docs`` with every span replaced by a mark; null texts stay null and no row goes."""
    own = limits(docs, text_col, rate)

    @F.pandas_udf("string")
    def of(texts):
        return texts.map(lambda t: None if t is None else redact_text(t, own))

    return docs.withColumn(text_col, of(F.col(text_col).cast("string")))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
