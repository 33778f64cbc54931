"""Cleaning and string functions as column expressions; all but the cleaning of English texts stay in the JVM."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from .stopwords import ENGLISH, TURKISH

TURKISH_SUFFIXES = ("gb", "tl", "saniye", "sn", "yıldız")


def words(text: Column) -> Column:
    """The words of a text split at white space, without empty ones."""
    return F.filter(F.split(text, "\\s+"), lambda w: w != "")


def has_emoji(text: Column) -> Column:
    """Whether a character beyond the basic plane occurs."""
    return text.rlike("[\\x{10000}-\\x{10FFFF}]")


def encode_emoji(text: Column) -> Column:
    """Each emoji as a word of its own, emoji and its bytes in hexadecimal, which cleaning with digits keeps."""
    chars = F.transform(F.regexp_extract_all(text, F.lit("(?s)."), 0), lambda c: F.when(has_emoji(c), F.concat(F.lit(" emoji"), F.lower(F.hex(c)), F.lit(" "))).otherwise(c))
    return F.when(has_emoji(text), F.array_join(chars, "")).otherwise(text)


def decode_emoji(word: Column) -> Column:
    """The emoji of a word that encode_emoji made; other words as they are."""
    return F.when(word.rlike("^emojif0[0-9a-f]{6}$"), F.decode(F.unhex(F.substring(word, 6, 8)), "UTF-8")).otherwise(word)


_ASCII = {False: re.compile("[a-z]+"), True: re.compile("[a-z0-9]+")}
_ANY = {False: regex.compile(r"\p{Ll}+"), True: regex.compile(r"[\p{Ll}\p{Nd}]+")}
_FAR = re.compile("[\U00010000-\U0010FFFF]")


def english_words(text: str, keep_numbers: bool, stopwords: frozenset[str]) -> list[str]:
    """See clean_english."""
    if text.isascii():
        found = _ASCII[keep_numbers].findall(text.lower())
    else:
        found = _ANY[keep_numbers].findall(unicodedata.normalize("NFKD", _FAR.sub(" emoji ", text).lower()))
    return [w for w in found if w not in stopwords and (w[0] != "x" or len(w) == 1 or w.strip("x"))]


#: Bytes of text that are Python objects at a time. A batch of 10 000 long texts has millions of words, each some 60 bytes as an object.
SLICE_BYTES = 1 << 20


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about `most` bytes each, all rows in order; a longer text has a range of its own."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64))
    lo, before = 0, 0
    while lo < len(ends):
        hi = max(lo + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield lo, hi
        lo, before = hi, int(ends[hi - 1])


def clean_english(text: Column, keep_numbers: bool = False, stopwords: tuple[str, ...] = ENGLISH) -> Column:
    """Words of an English text: lower case, decomposed, letters only (digits too with keep_numbers), without runs of x and stop words.

    Emoji become the word emoji. NULL gives NULL and an empty text no words. One pass over each Arrow batch: compatibility decomposition
    has no built-in, and the several regular expressions and lambdas that say it with built-ins take ten times as long.
    """
    stop = frozenset(stopwords)

    def run(texts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.string())
        parts = [pa.array([None if t is None else english_words(t, keep_numbers, stop) for t in texts.slice(lo, hi - lo).to_pylist()], kind) for lo, hi in slices(texts)]
        return pa.concat_arrays(parts) if parts else pa.array([], kind)

    return F.arrow_udf(run, "array<string>")(text)


def turkish_lower(text: Column) -> Column:
    """Lower case where the six Turkish capitals are mapped first; I becomes i."""
    return F.lower(F.translate(text, "İĞŞÜÖÇ", "iğşüöç"))


def turkish_upper(text: Column) -> Column:
    """Upper case where the six Turkish letters are mapped first."""
    return F.upper(F.translate(text, "iğşüöç", "İĞŞÜÖÇ"))


def join_suffix(text: Column, left: str = "\\d+", suffix: str = "gb") -> Column:
    """Remove the space between a number (or `left`) and a suffix."""
    return F.regexp_replace(text, f"({left})\\s+({suffix})\\b", "$1$2")


def clean_turkish(text: Column, stopwords: tuple[str, ...] = TURKISH, suffixes: tuple[str, ...] = TURKISH_SUFFIXES) -> Column:
    """Cleaned Turkish text: letters and digits, runs of 3 and more equal characters cut to 2, no stop words, units joined to numbers."""
    t = F.regexp_replace(turkish_lower(text), "[^\\p{Ll}\\p{Nd}]", " ")
    t = F.regexp_replace(t, "(.)\\1{2,}", "$1$1")
    t = F.array_join(F.filter(words(t), lambda w: ~w.isin(*stopwords)), " ")
    for s in suffixes:
        t = join_suffix(t, suffix=s)
    return t


def is_pure_number(token: Column) -> Column:
    """Whether no part of the token between underscores holds anything but digits, and there is a digit."""
    return token.rlike("^[0-9]+(_[0-9]+)*$")


def sanitize(text: Column) -> Column:
    """Text without line feeds and double quotes, as documents are shown."""
    return F.translate(text, '\n"', "")


def topic_label(topic_id: Column) -> Column:
    """Topic 01, Topic 02, ..."""
    return F.format_string("Topic %02d", topic_id)


def split_scored(text: Column, most: int = 200) -> tuple[Column, Column]:
    """Text and score of 'text:score', cut at the last colon; long texts end in ... ."""
    score = F.substring_index(text, ":", -1).cast("double")
    body = F.regexp_replace(text, ":[^:]*$", "")
    return F.when(F.length(body) > most, F.concat(F.substring(body, 1, most), F.lit("..."))).otherwise(body), score
