"""The word functions of :mod:`lexiloom.functions.text` once more, for Arrow batches of whole texts.

A text is cut by one pattern and each distinct token is looked up: a worker works a token's forms out once, not once
a page. What letters and numbers are is asked of the JVM, so that both sides have the same version of Unicode; a test
compares the forms over all assigned code points (U+A7CB and U+A7DC alone are words there and none here: the JVM's
patterns don't know them as letters, and Spark's lower case does).
"""

from __future__ import annotations

import re
from functools import cache
from operator import itemgetter

from pyspark.sql import SparkSession

from lexiloom.functions import text as T

_BLANK = re.escape(T._BLANKS)
_RUNS, _TOKENS = re.compile(r"\w+"), re.compile(r"\w+|\s+|[^\w\s]+")
_LAST = frozenset(suffix[-1] for suffix, _ in T.SUFFIXES)
_canon = itemgetter(1)
_PLAIN = re.compile(r"[a-z0-9_]+")
_ACCENTS = {ord(c): (T._TARGET[i] if i < len(T._TARGET) else None) for i, c in reversed(list(enumerate(T._SOURCE)))}
#: Forms that a worker remembers.
REMEMBERED = 400_000
_LETTERS: list[tuple[str, str]] = []


def letters(spark: SparkSession) -> tuple[str, str]:
    """The JVM's letters and numbers as ranges of a character class, and the characters that are among them but not Python's, or the other way round. Of the running JVM, so it is asked once."""
    if not _LETTERS:
        every = "".join(chr(i) for i in range(0x110000) if not 0xD800 <= i <= 0xDFFF)
        others = set(spark._jvm.java.util.regex.Pattern.compile(r"[\p{L}\p{N}]+").matcher(every).replaceAll(""))
        ranges: list[list[int]] = []
        for point in (ord(c) for c in every if c not in others):
            if ranges and ranges[-1][1] == point - 1:
                ranges[-1][1] = point
            else:
                ranges.append([point, point])
        odd = "".join(c for c in every if c.isalnum() == (c in others))
        _LETTERS.append(("".join(rf"\U{a:08x}-\U{b:08x}" for a, b in ranges), odd))
    return _LETTERS[0]


def canonical(word: str) -> str:
    """The first suffix rule that fits a normal form."""
    if len(word) <= 3 or word[-1] not in _LAST or word == "pays" or word.endswith("is"):
        return word
    for suffix, end in T.SUFFIXES:
        if word.endswith(suffix) and len(word) - len(suffix) >= 3:
            return word[: -len(suffix)] + end
    return word


class Forms(dict):
    """token -> (normal form, canonical form), both empty if it is no word; bounded. letters: what letters() gives.

    Python's own classes of characters are much faster than ranges, so a text is cut by them
    unless it has a character in which Python and the JVM differ.
    """

    def __init__(self, letters: tuple[str, str]) -> None:
        letters, odd = letters
        self._odd = frozenset(odd)
        self._runs, self._letter = re.compile(f"[{letters}_]+"), re.compile(f"[{letters}]")
        self._tokens = re.compile(f"[{letters}_]+|[{_BLANK}]+|[^{letters}_{_BLANK}]+")
        self._edges = re.compile(f"^[^{letters}_]+|[^{letters}_]+$")

    def _plain(self, text: str) -> bool:
        return text.isascii() or self._odd.isdisjoint(text)

    def __missing__(self, token: str) -> tuple[str, str]:
        if token.isascii() and (token[0].isalnum() or token[0] == "_"):  # a run of word characters is plain then
            norm = token.lower()
            word = norm.strip("_")
        else:
            norm = self.normal(token)
            word = self._letter.search(norm)
        found = (norm, canonical(norm)) if word else ("", "")
        if len(self) >= REMEMBERED:
            self.clear()
        self[token] = found
        return found

    def normal(self, token: str) -> str:
        low = token.lower()
        return low if _PLAIN.fullmatch(low) else self._edges.sub("", low.translate(_ACCENTS))

    def runs(self, text: str | None) -> list[str]:
        """The runs of word characters, in order. No other token is a word."""
        return (_RUNS if self._plain(text or "") else self._runs).findall(text or "")

    def tokens(self, text: str | None) -> list[str]:
        """All tokens, in order."""
        return (_TOKENS if self._plain(text or "") else self._tokens).findall(text or "")

    def contents(self, text: str | None, least: int = 3) -> list[str]:
        """Distinct canonical forms of `least` letters or more, in the order of their first use."""
        return [w for w in dict.fromkeys(map(_canon, map(self.__getitem__, dict.fromkeys(self.runs(text))))) if len(w) >= least]


@cache
def forms_of(letters: tuple[str, str]) -> Forms:
    """A worker's own, kept from task to task."""
    return Forms(letters)
