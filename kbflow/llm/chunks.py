"""Ids of texts by the tokenizers library: texts are cut into words in Arrow, and each distinct word is encoded once."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: All white space of Unicode and U+001C to U+001F, for RE2 and for Python.
_WHITE = r"\t-\r\x1c-\x20\x{85}\pZ"
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Letters of ASCII and Latin-1: no normal form composes them, and their lower case is a letter of the same kind.
_LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
#: A mark or line end after a letter or digit, which every vocabulary here takes as pieces of their own.
_TAIL = rf"([{_LATIN}0-9])(?:[,.;:!?]\n?|\n)\z"
#: Words that are remembered, and their ids: only bounds memory.
CACHED, CACHED_IDS = 1_000_000, 16_000_000
#: Bytes of the texts whose words are looked up together, and words that the library is given together.
TOGETHER, GROUP = 8 << 20, 1000
#: encode(words, plain) -> their ids one after another and how many each has; plain words are letters of _LATIN after a blank at most.
Encode = Callable[[Sequence[str], bool], tuple[np.ndarray, np.ndarray]]


@dataclass(frozen=True)
class Rule:
    """Where texts may be cut: ``marks`` are replaced in turn, then the text is split by ``by``.

    Texts that ``odd`` finds are cut at blanks between two characters that are not white space, and nowhere else.
    ``ends`` marks words at whose end a sentence or line ends; ``lower``: the vocabulary knows lower case only.
    """

    by: str
    marks: tuple[tuple[str, str], ...]
    odd: str | None = None
    ends: str | None = None
    lower: bool = False


#: For vocabularies whose pre-tokenizer drops white space.
WORDS = Rule(" ", (("\n", " "),), lower=True)
#: For byte-level vocabularies without a normalizer: a piece begins at a blank between two other characters.
BLANKS = Rule("\x00", ((" ", "\x00 "),), rf"[{_WHITE}] | [{_WHITE}]|\A | \z|\x00")
#: The same; pieces also begin after a line end between two other characters.
SENTENCES = Rule("\x00", (("\n", "\n\x00"), (" ", "\x00 ")), rf"[{_WHITE}][ \n]|[ \n][{_WHITE}]|\A[ \n]|[ \n]\z|\x00", r"[.!?…。！？\n]\z")


@dataclass
class Encoded:
    """ids of texts; those of text i are ids[begin[i] : end[i]]; marks: ascending places in ids at which marked words end."""

    ids: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    marks: np.ndarray

    def of(self, i: int) -> np.ndarray:
        return self.ids[self.begin[i] : self.end[i]]


def gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slices ``at`` (start, size) of ``flat``, one after another, and the ends of each."""
    n = size[at]
    ends = np.cumsum(n)
    if not len(at):
        return flat[:0], ends
    return flat[np.arange(ends[-1]) + np.repeat(start[at] - (ends - n), n)], ends


def binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary values that lie one after another in ``data``, a byte array; ends of each."""
    offsets = np.concatenate([[0], ends])
    if offsets[-1] < 1 << 31:
        return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary())


def together(texts: pa.Array, limit: int = TOGETHER) -> Iterator[tuple[int, pa.Array]]:
    """Runs of texts, nulls as empty, of ``limit`` bytes or one text: (position of the first, texts)."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)) if len(texts) else np.zeros(0, np.int64)
    at = 0
    while at < len(texts):
        before = ends[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield at, texts.slice(at, end - at)
        at = end


class Words:
    """The ids of each distinct word once, for the words that came last."""

    def __init__(self, encode: Encode, rule: Rule) -> None:
        self.encode, self.rule = encode, rule
        self._clear()

    def _clear(self) -> None:
        self.known = pa.array([""])
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.start, self.size = np.zeros(1, np.int64), np.zeros(1, np.int64)

    def _add(self, words: pa.Array, plain: bool) -> None:
        """Words that are not known yet."""
        ids, sizes = self.encode(words.to_pylist(), plain) if len(words) else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.zeros(max(len(ids), len(self.flat) // 2), np.uint32)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.known = pa.concat_arrays([self.known, words])
        self.start = np.concatenate([self.start, self.used + np.cumsum(sizes) - sizes])
        self.size = np.concatenate([self.size, sizes])
        self.used += len(ids)

    def _slots(self, words: pa.Array) -> np.ndarray:
        """Slots of distinct words; new ones are encoded."""
        if len(self.known) + len(words) > CACHED or self.used > CACHED_IDS:
            self._clear()
        found = pc.fill_null(pc.index_in(words, value_set=self.known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = np.flatnonzero(found < 0)
        if len(new):
            missing = words.take(pa.array(new))
            plain = pc.match_substring_regex(missing, rf"\A ?[{_LATIN}]+\z").to_numpy(zero_copy_only=False).astype(bool)
            for kind in (True, False):
                at = np.flatnonzero(plain == kind)
                found[new[at]] = np.arange(len(self.known), len(self.known) + len(at))
                self._add(missing.take(pa.array(at)), kind)
        return found

    def _table(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(flat, start, size) of the ids of distinct words: those of what is before a mark at their end, and of the mark."""
        core = pc.replace_substring_regex(words, _TAIL, r"\1")
        if self.rule.lower:
            core = pc.if_else(pc.match_substring_regex(core, rf"\A[{_LATIN}]+\z"), pc.utf8_lower(core), core)
        cut = (pc.binary_length(words).to_numpy(zero_copy_only=False) - pc.binary_length(core).to_numpy(zero_copy_only=False)).astype(np.int64)
        last = np.frombuffer(words.buffers()[1], np.int32)[words.offset + 1 : words.offset + 1 + len(words)].astype(np.int64)
        data = np.frombuffer(words.buffers()[2], np.uint8) if words.buffers()[2] is not None and words.buffers()[2].size else np.zeros(1, np.uint8)
        tail = np.where(cut > 0, data[np.maximum(0, last - 1)].astype(np.int64), 0) + np.where(cut > 1, data[np.maximum(0, last - 2)].astype(np.int64) << 8, 0)
        kinds, of = np.unique(tail, return_inverse=True)
        marks = ["" if not k else chr(k) if k < 256 else chr(k >> 8) + chr(k & 255) for k in kinds.tolist()]
        # one look-up for both, as a look-up may forget what came before it
        both = pa.concat_arrays([pa.array(marks, pa.string()), core]).dictionary_encode()
        slots = self._slots(both.dictionary)[both.indices.to_numpy(zero_copy_only=False)]
        pairs = np.column_stack([slots[len(marks) :], slots[: len(marks)][of]]).ravel()
        flat, ends = gather(self.flat, self.start, self.size, pairs)
        ends = ends[1::2]
        size = np.diff(ends, prepend=0)
        return flat, ends - size, size

    def _pieces(self, texts: pa.Array) -> tuple[pa.ListArray, np.ndarray]:
        """Words of texts, and which text each list belongs to."""
        rule = self.rule
        odd = pc.match_substring_regex(texts, rule.odd).to_numpy(zero_copy_only=False).astype(bool) if rule.odd else np.zeros(len(texts), bool)
        fine, rest = np.flatnonzero(~odd), np.flatnonzero(odd)
        own = texts.take(pa.array(fine)) if len(rest) else texts
        for old, new in rule.marks:
            own = pc.replace_substring(own, old, new)
        own = pc.split_pattern(own, rule.by)
        if not len(rest):
            return own, fine
        cut = [[p if not i else " " + p for i, p in enumerate(_CUT.split(texts[int(t)].as_py()))] for t in rest]
        return pa.concat_arrays([own, pa.array(cut, pa.list_(pa.string()))]), np.concatenate([fine, rest])

    def run(self, texts: pa.Array) -> Encoded:
        """One run of texts without nulls."""
        pieces, order = self._pieces(texts)
        offsets = pieces.offsets.to_numpy()
        words = pieces.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
        at = words.indices.to_numpy(zero_copy_only=False)
        flat, start, size = self._table(words.dictionary)
        ids, ends = gather(flat, start, size, at)
        bounds = np.concatenate([[0], ends])[offsets - offsets[0]]
        begin, end = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
        begin[order], end[order] = bounds[:-1], bounds[1:]
        marks = np.zeros(0, np.int64)
        if self.rule.ends:
            marked = pc.match_substring_regex(words.dictionary, self.rule.ends).to_numpy(zero_copy_only=False).astype(bool)
            marks = ends[marked[at]]
        return Encoded(ids, begin, end, marks)

    def many(self, texts: pa.Array, limit: int | None = None) -> Iterator[tuple[int, Encoded]]:
        """Texts in runs of a bounded size: (position of a run's first text, its ids). Nulls are empty."""
        for at, own in together(texts, limit or TOGETHER):
            yield at, self.run(own)
            pa.default_memory_pool().release_unused()


def grouped(tokenizer, words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of words that are encoded apart from each other, and how many each has."""
    groups = [list(words[i : i + GROUP]) for i in range(0, len(words), GROUP)]
    ids, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
    for own, found in zip(groups, tokenizer.encode_batch(groups, is_pretokenized=True, add_special_tokens=False), strict=True):
        ids.append(np.asarray(found.ids, np.uint32))
        sizes.append(np.bincount(np.asarray(found.word_ids, np.int64), minlength=len(own)))
    return np.concatenate(ids), np.concatenate(sizes)


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in the library's byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, more = [""] * 256, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b], more = chr(more), more + 1
    return out


#: What plain words become: each byte of theirs as its character.
_MAPPED = {c: "".join(byte_characters()[b] for b in chr(c).encode()) for c in range(256)}


def single(model, words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of plain words: each is one piece, which the model of a byte-level vocabulary merges."""
    found = [[t.id for t in model.tokenize(w.translate(_MAPPED))] for w in words]
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    return np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum())), sizes


def library(path: str) -> Encode:
    """encode() of a tokenizer file; special tokens' strings in a text are ordinary text.

    Plain words pass the normalizer unchanged and are one piece for the pre-tokenizer, so both are left out for them.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    own.encode_special_tokens = True
    model = own.model
    return lambda words, plain: single(model, words) if plain else grouped(own, words)


_ready: dict[tuple, Words] = {}


def once(rule: Rule, path: str, load: Callable[[str], Encode] = library) -> Words:
    """One encoder for each Python worker, vocabulary and rule."""
    if (key := (rule, path, load.__name__)) not in _ready:
        _ready[key] = Words(load(path), rule)
    return _ready[key]
