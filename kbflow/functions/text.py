"""Text functions: normal forms, ids by content, classification by rules, parsers of model output."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ordered rules: the first pattern that matches names the topic.
TOPIC_RULES = tuple((name, rf"(^|[^\p{{L}}\p{{N}}])({words})($|[^\p{{L}}\p{{N}}])") for name, words in (("spanish", "el|la|los|las"), ("german", "der|die|das|und"), ("french", "le|les|des|une?"), ("english", "the|and|of|to")))
OTHER = "other"


def embedding_text(title: Column, text: Column, prefix: str = "", most: int = 256) -> Column:
    """``prefix`` and ``title: text``, the text cut at ``most`` characters."""
    return F.concat(F.lit(prefix), title, F.lit(": "), F.substring(text, 1, most))


def content_id(prefix: str, text: Column, digits: int) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.md5(text), 1, digits))


def normal_answer(text: Column) -> Column:
    """Lower case, punctuation as blanks, without a, an and the, single blanks."""
    words = F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\s]", " "), r"\s+")
    return F.array_join(F.filter(words, lambda w: ~w.isin("", "a", "an", "the")), " ")


def normal_title(text: Column) -> Column:
    """Underscores as blanks, escaped brackets as themselves, lower case."""
    out = F.replace(F.replace(text, F.lit("_"), F.lit(" ")), F.lit("-LRB-"), F.lit("("))
    return F.lower(F.trim(F.replace(out, F.lit("-RRB-"), F.lit(")"))))


def normal_entity(text: Column) -> Column:
    """Single blanks, lower case, no leading ``the``; null unless 2 to 79 characters remain."""
    own = F.regexp_replace(F.lower(F.trim(F.regexp_replace(text, r"\s+", " "))), "^the ", "")
    return F.when((F.length(own) > 1) & (F.length(own) < 80), own)


def tokens(text: Column) -> Column:
    """Words of the lower-cased text between white space."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")


def first_rule(text: Column, rules=TOPIC_RULES, other: str = OTHER) -> Column:
    out = F.lit(other)
    for name, pattern in reversed(rules):
        out = F.when(F.lower(text).rlike(pattern), F.lit(name)).otherwise(out)
    return out


def keyword_topic(text: Column, topics: dict[str, tuple[str, ...]], other: str = OTHER) -> Column:
    """The first topic of which the text has a keyword as a token."""
    own, out = tokens(text), F.lit(other)
    for name in reversed(list(topics)):
        out = F.when(F.arrays_overlap(own, F.array(*map(F.lit, topics[name]))), F.lit(name)).otherwise(out)
    return out


def after_thinking(text: Column, mark: str = "</think>") -> Column:
    """What follows the last mark, trimmed; the whole text without one."""
    return F.trim(F.element_at(F.split(text, mark), -1))


def first_grade(text: Column, fallback: int = 3) -> Column:
    """The first digit from 1 to 5."""
    return F.coalesce(F.regexp_extract(text, "[1-5]", 0).try_cast("int"), F.lit(fallback))


def numbered_items(text: Column) -> Column:
    """Items of lines such as ``1. item`` or ``- item``, without their marks."""
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_extract(x, r"^\s*(?:[0-9]+[.)]|[-*])\s*(.*)$", 1))), lambda x: x != "")


def verdict(text: Column) -> Column:
    """Reinforce, make false or no change, by what a model's answer names first of these."""
    low = F.lower(text)
    return F.when(low.contains("reinforce"), "reinforce").when(low.contains("make false") | low.contains("make_false"), "make_false").otherwise("no_change")


def error_kind(text: Column) -> Column:
    low = F.lower(text)
    return F.when(low.rlike("time ?out"), "timeout").when(low.rlike("rate|quota|429"), "rate_limit").when(low.rlike("connect|network"), "network").otherwise("unknown")


def context(items: Column, most: int = 300, empty: str = "No context.") -> Column:
    """``[n] text`` of each item, on one line and cut, parted by a blank line."""
    own = F.transform(items, lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), F.substring(F.regexp_replace(x, r"[\n\t]", " "), 1, most)))
    return F.when(F.size(items) > 0, F.array_join(own, "\n\n")).otherwise(F.lit(empty))


def chunks(text: Column, size: int = 1024, overlap: int = 128) -> Column:
    """Windows of ``size`` characters that begin every ``size - overlap``; the last ends with the text."""
    step = size - overlap
    n = F.greatest(F.lit(1), F.ceil((F.length(text) - overlap) / F.lit(step)))
    return F.transform(F.sequence(F.lit(0), n.cast("int") - 1), lambda i: F.substring(text, i * step + 1, F.lit(size)))
