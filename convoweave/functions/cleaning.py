"""Message and title cleaning as column expressions; only NFC needs a Python worker, and only for non-ASCII text."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Roles and the patterns of what exports leave in messages.
HUMAN_ROLES = ("human", "user", "you", "me")
ASSISTANT_ROLES = ("assistant", "claude", "ai", "bot", "system")
ARTIFACT = r"(?s)(?iu)<(?:artifact|antArtifact)[^>]*>.*?</(?:artifact|antArtifact)>"
THINKING = r"(?s)(?iu)<thinking>.*?</thinking>"
FENCE = r"(?sU)```(?:[\w+-]*\n)?\s*(.*?)\s*```"
MARKER = r"(?iu)\[(?:INST|/INST|SYS|/SYS|CLAUDE|HUMAN)\]"
WRAPPER = r"(?iu)</?(?:response|reply|answer|output|result)[^>]*>"
CONTROL = r"[\p{Cc}&&[^\n\t\r]]"
UNTITLED = "Untitled Conversation"


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``, however often it is used there, lambdas included."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def normalize_role(role: Column) -> Column:
    low = F.lower(role)
    return F.when(low.isin(*HUMAN_ROLES), "human").when(low.isin(*ASSISTANT_ROLES), "assistant").otherwise(low)


def strip_artifacts(text: Column) -> Column:
    return F.regexp_replace(text, ARTIFACT, "")


def strip_thinking(text: Column) -> Column:
    return F.regexp_replace(text, THINKING, "")


def normalize_fences(text: Column) -> Column:
    """Fenced blocks lose their language tag and outer white space."""
    return F.regexp_replace(text, FENCE, "```\n$1\n```")


def strip_markers(text: Column) -> Column:
    return F.regexp_replace(text, MARKER, "")


def strip_wrappers(text: Column) -> Column:
    return F.regexp_replace(text, WRAPPER, "")


def normalize_whitespace(text: Column) -> Column:
    """Runs of blanks and of newlines shrink and lines are trimmed, outside fenced blocks.

    The text is cut at its fenced blocks; no character stands in for them, so any character may be in the text. A line
    that goes on after a block is trimmed at its outer ends only.
    """
    fence = r"(?s)```.*?```"

    def shrink(part: Column, i: Column) -> Column:
        x, block = part["outside"], part["block"]
        x = F.regexp_replace(F.regexp_replace(x, r"[ \t]{2,}", " "), r"\n{3,}", "\n\n")
        x = F.regexp_replace(F.regexp_replace(x, r"(?d)\n[ \t]+", "\n"), r"(?d)[ \t]+\n", "\n")
        x = F.when(i == 0, F.regexp_replace(x, r"\A[ \t]+", "")).otherwise(x)
        return F.when(block.isNull(), F.regexp_replace(x, r"[ \t]+\z", "")).otherwise(F.concat(x, block))

    def cut(t: Column) -> Column:  # the last piece has no block behind it
        return F.arrays_zip(F.split(t, fence, -1).alias("outside"), F.regexp_extract_all(t, F.lit(fence), F.lit(0)).alias("block"))

    return F.regexp_replace(F.array_join(F.transform(bound(text, cut), shrink), ""), r"(?U)\A\s+|\s+\z", "")


def not_blank(text: Column) -> Column:
    """Whether a message has anything but white space; null has not."""
    return F.coalesce(F.regexp_replace(text, r"(?U)\s+", ""), F.lit("")) != ""


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


NON_ASCII = r"[^\x00-\x7F]"


@F.pandas_udf(T.StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def compose(text: Column) -> Column:
    """The text in NFC. Only texts beyond ASCII are sent to Python; the others go as nulls and stay as they are."""
    return F.coalesce(_nfc(F.when(text.rlike(NON_ASCII), text)), text)


def normalize_unicode(text: Column, nfc: bool = True) -> Column:
    composed = compose(text) if nfc else text
    return F.regexp_replace(F.regexp_replace(composed, CONTROL, ""), r"\r\n?", "\n")


def clean_message(text: Column, nfc: bool = True) -> Column:
    for step in (strip_artifacts, strip_thinking, normalize_fences, strip_markers, strip_wrappers, normalize_whitespace):
        text = step(text)
    return normalize_unicode(text, nfc)


def clean_title(title: Column, nfc: bool = True) -> Column:
    composed = compose(title) if nfc else title
    flat = F.trim(F.regexp_replace(F.regexp_replace(composed, r"[\p{Cc}&&[^\n\t]]", ""), r"(?U)\s+", " "))
    return F.when(F.coalesce(flat, F.lit("")) == "", UNTITLED).otherwise(flat)


def word_set(text: Column) -> Column:
    return F.array_distinct(F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\s+"), ""))


def parse_time(text: Column) -> Column:
    """ISO text, epoch seconds, or epoch milliseconds beyond 1e12; null if it is none of them."""
    number = text.try_cast("double")
    micros = F.round(F.when(number > 1e12, number * 1e3).otherwise(number * 1e6)).try_cast("bigint")
    return F.coalesce(F.timestamp_micros(micros), F.try_to_timestamp(text))
