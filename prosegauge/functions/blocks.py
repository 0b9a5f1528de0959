"""Markdown-aware text blocks as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dialect import BREAK, CHARS, WS, occurrences, strip

FENCE = "```"
LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\\x{85}\\x{2028}\\x{2029}]"
LIST_ITEM = "^([-*+] |[0-9]+\\. )"
SENTENCE = "[^。！？!?；;\n]+[。！？!?；;]?"
STAT_BREAK = "[。！？!?\n]+"
MIN_CHARS, MIN_SENTENCES = 40, 2


def frontmatter_end(text: Column) -> Column:
    """Length of the front matter with both delimiters; 0 without one."""
    at = F.locate("\n---\n", text)
    return F.when(F.startswith(text, F.lit("---\n")) & (at > 0), at + 4).otherwise(F.lit(0))


def front(text: Column) -> Column:
    return F.substr(text, F.lit(1), frontmatter_end(text))


def body(text: Column) -> Column:
    return F.substr(text, frontmatter_end(text) + 1)


def kept(parts: Column) -> Column:
    """Stripped parts that aren't blank."""
    return F.filter(F.transform(parts, strip), lambda x: x != "")


def paragraphs(text: Column) -> Column:
    return kept(F.split(body(text), BREAK))


def sentences(text: Column) -> Column:
    """Sentences with their ends; code, headings and tables stay whole."""
    t = strip(text)
    found = kept(F.regexp_extract_all(t, F.lit(SENTENCE), F.lit(0)))
    whole = F.startswith(t, F.lit(FENCE)) | F.startswith(t, F.lit("#")) | F.startswith(t, F.lit("|"))
    return F.when(t == "", F.array().cast("array<string>")).when(whole | (F.size(found) == 0), F.array(t)).otherwise(found)


def stat_sentences(text: Column) -> Column:
    """Sentences for statistics, without their ends."""
    return kept(F.split(text, STAT_BREAK))


def lines(text: Column) -> Column:
    return kept(F.split(text, LINE_BREAK))


def is_heading(text: Column) -> Column:
    return text.rlike(f"^{WS}*#")


def is_code(text: Column) -> Column:
    return F.startswith(strip(text), F.lit(FENCE)) | F.endswith(strip(text), F.lit(FENCE))


def is_table(text: Column) -> Column:
    """All lines begin with a bar; lines are looked at only if the text does."""
    return F.startswith(strip(text), F.lit("|")) & (F.size(lines(text)) > 0) & F.forall(lines(text), lambda x: F.startswith(x, F.lit("|")))


def is_list(text: Column) -> Column:
    """All lines are items; lines are looked at only if the text begins like one."""
    return strip(text).rlike(LIST_ITEM) & (F.size(lines(text)) > 0) & F.forall(lines(text), lambda x: x.rlike(LIST_ITEM))


def block_type(text: Column) -> Column:
    return F.when(is_heading(text), "heading").when(is_code(text), "code").when(is_table(text), "table").when(is_list(text), "list").otherwise("prose")


def plain_length(text: Column) -> Column:
    """Characters that aren't white space."""
    return F.length(F.translate(text, CHARS, ""))


def fences(text: Column) -> Column:
    return occurrences(text, FENCE)


def eligible(text: Column, min_chars: int = MIN_CHARS, min_sentences: int = MIN_SENTENCES) -> Column:
    """Whether statistics of the paragraph mean anything: prose, long enough, of several sentences."""
    return (F.length(text) >= min_chars) & (plain_length(text) >= min_chars) & (F.size(stat_sentences(text)) >= min_sentences) & (block_type(text) == "prose")


def span_index(spans: Column, pos: Column) -> Column:
    """Place of the span that holds a position: 0 before the first, the last from its start on, null in a gap."""
    inside = F.filter(F.transform(spans, lambda s, i: F.when((s["start"] <= pos) & (pos < s["stop"]), i)), lambda i: i.isNotNull())
    return F.when(F.size(spans) == 0, F.lit(None)).when(pos < spans[0]["start"], 0).when(F.size(inside) > 0, F.get(inside, F.lit(0))).when(pos >= F.element_at(spans, -1)["start"], F.size(spans) - 1).cast("int")
