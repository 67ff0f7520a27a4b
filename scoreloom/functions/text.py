"""Text cleaning and tokenising as built-in column expressions.

Patterns keep to the syntax that Java and RE2 share, so the same pattern can be
run by another SQL engine as a check.
"""

from __future__ import annotations

import string
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

PUNCTUATION = string.punctuation
PUNCTUATION_RUN = r"[!-/:-@\[-`{-~]+"

# One white-space character in the Unicode sense, spelled out for both regex dialects.
SPACE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
SPACES = SPACE + "+"
EDGES = rf"\A{SPACES}|{SPACES}\z"

# The words a Treebank tokeniser splits in two, and typographic quotes.
JOINED_WORDS = ["cannot", "gonna", "wanna", "gotta", "gimme", "lemme"]
SPLIT_WORDS = r"\b(?:(can)(not)|(gon|wan)(na)|(got)(ta)|(gim|lem)(me))\b"
QUOTES = "«“‘„»”’"

# Rules for raw text, applied in this order: (pattern, replacement with $n groups).
END_PERIOD = (rf"(\.+)([\])}}>\"'»”’]*)({SPACE}|\z)", " $1 $2$3")
SYMBOLS = (rf"([;@#$%&?!*\[\](){{}}<>\"{QUOTES}]|\.{{2,}}|--|''|`+)", " $1 ")
COLON_COMMA = (r"([:,])([^\d]|\z)", " $1 $2")
APOSTROPHES = [
    (r"(?i)'([a-ce-lo-ru-z0-9_])\b", "' $1"),
    (r"([^'])' ", "$1 ' "),
    (r"([^' ])('[sS]|'[mM]|'[dD]|') ", "$1 $2 "),
    (r"([^' ])('ll|'LL|'re|'RE|'ve|'VE|n't|N'T) ", "$1 $2 "),
    (r"(?i)\b(d|more)('ye|'n)\b", "$1 $2"),
    (r"(?i) ('t)(is|was)\b", " $1 $2"),
]
CONTRACTIONS = (rf"(?i){SPLIT_WORDS}", "$1$3$5$7 $2$4$6$8")
CONTRACTIONS_AND_QUOTES = (rf"{SPLIT_WORDS}|([{QUOTES}])", "$1$3$5$7 $9 $2$4$6$8")

ANSWER_AFTER_LABEL = rf"(?is)(?:Answer|Response|Solution):{SPACE}*(.+)"
ANSWER_AFTER_PHRASE = rf"(?is)(?:The answer is|The result is){SPACE}*(.+)"
FIRST_LINE = r"\A([^\n]+)"
MARKDOWN = [(r"\*\*([^\n]*?)\*\*", "$1"), (r"\*([^\n]*?)\*", "$1"), (r"`([^\n]*?)`", "$1")]


def _replace(text: Column, rule: tuple[str, str]) -> Column:
    return F.regexp_replace(text, rule[0], rule[1])


def _words(text: Column) -> Column:
    """Split on single spaces, without empty entries."""
    return F.array_remove(F.split(text, " "), "")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, EDGES, "")


def normalize_text(text: Column, lowered: Column | None = None) -> Column:
    """Lower case, ASCII punctuation deleted, white space collapsed and trimmed; `lowered` is the text's lower case, if known."""
    bare = F.regexp_replace(F.lower(text) if lowered is None else lowered, PUNCTUATION_RUN, "")
    return F.trim(F.regexp_replace(bare, SPACES, " "))


def _has_any(text: Column, parts: Iterable[str]) -> Column:
    """A byte search: far cheaper than a pattern that rarely matches."""
    listed = F.split(F.lit(" ".join(parts)), " ")
    return F.exists(listed, lambda part: F.contains(text, part))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body mentions it."""
    return F.get(F.transform(F.array(value), body), 0)


def normalized_tokens(normalized: Column) -> Column:
    """Word tokens of text that went through :func:`normalize_text`."""
    spaced = bound(
        normalized,
        lambda line: F.when(
            _has_any(line, [*JOINED_WORDS, *QUOTES]), _replace(line, CONTRACTIONS_AND_QUOTES)
        ).otherwise(line),
    )
    return _words(spaced)


def word_tokens(text: Column, lowered: Column | None = None) -> Column:
    """Word tokens of raw text: punctuation and contractions become tokens.

    Every period before white space counts as a sentence end; no abbreviation list is used. `lowered` is
    the text's lower case, if known: a joined word stands in it wherever it stands in the spaced text.
    """
    spaced = F.concat(F.lit(" "), text, F.lit(" "))
    for rule in (END_PERIOD, SYMBOLS, COLON_COMMA):
        spaced = _replace(spaced, rule)

    def split_quoted(line: Column) -> Column:
        quoted = line
        for rule in APOSTROPHES:
            quoted = _replace(quoted, rule)
        return F.when(F.contains(line, F.lit("'")), quoted).otherwise(line)

    def split_joined(line: Column) -> Column:
        if lowered is not None:
            joined = _has_any(lowered, JOINED_WORDS)
        else:
            joined = bound(F.lower(line), lambda low: _has_any(low, JOINED_WORDS))
        return F.when(joined, _replace(line, CONTRACTIONS)).otherwise(line)

    spaced = bound(bound(spaced, split_quoted), split_joined)
    return F.array_remove(F.split(spaced, SPACES), "")


def word_count(text: Column) -> Column:
    """Number of white-space separated words; 0 for blank text."""
    return F.array_size(F.array_remove(F.split(text, SPACES), ""))


def rouge_text(text: Column, lowered: Column | None = None) -> Column:
    """Lower-case ASCII letters and digits, everything else a single space."""
    return F.trim(F.regexp_replace(F.lower(text) if lowered is None else lowered, "[^a-z0-9]+", " "))


def rouge_tokens(text: Column) -> Column:
    return _words(rouge_text(text))


def clean_crm_answer(text: Column) -> Column:
    """The answer part of a service reply, lower case, without trailing periods."""
    whole = strip(text)
    answer = F.coalesce(
        *(
            F.nullif(strip(F.regexp_extract(whole, pattern, 1)), F.lit(""))
            for pattern in (ANSWER_AFTER_LABEL, ANSWER_AFTER_PHRASE, FIRST_LINE)
        ),
        whole,
    )
    return F.lower(F.regexp_replace(F.regexp_replace(answer, SPACES, " "), r"\.+\z", ""))


def clean_markdown(text: Column) -> Column:
    """Bold, italic and code marks unwrapped, white space collapsed."""
    plain = strip(text)
    for rule in MARKDOWN:
        plain = _replace(plain, rule)
    return F.regexp_replace(plain, SPACES, " ")
