"""Secrets: three fixed patterns, and values in credential contexts that take too many guesses.

The fixed kinds (assign, access, hex) give the base spans.  Values that stand where
credentials do (after `password:`, `pwd=`, `bearer`, in the user part of an address
and the like) are priced: the cheapest way to put a value together from dictionary
words, dates, repeats, keyboard walks and brute-force spans, in bits, by dynamic
programming over its end positions.  Values of MIN_BITS or more, in which kinds of
signs mix, are spans of kind `guess`.

A word costs what it takes to guess all words that are as frequent as it or more:
words of all documents are counted by Spark and put into classes of about equal
frequency; the most frequent classes that have at most WORDS words together are
the dictionary, so no tie is cut and its size doesn't follow the corpus.

Null texts count as empty; whole texts are searched, however long; values over
MAX_VALUE signs are priced in pieces of that length, one after another (a bound of
time, not of what is found); repeated rows get equal spans; rows without doc_id are
searched like others; an empty table gives an empty result; other columns are not
read, and their names don't matter.  Spans are code points, end exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from math import log2

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import record_batch, staged, table

KINDS = ("assign", "access", "hex", "guess")
#: Least bits of a value's cheapest segmentation; most words of the dictionary; frequency classes per doubling; signs priced at once.
MIN_BITS, WORDS, CLASSES, MAX_VALUE = 40.0, 20_000, 4, 256
#: Letters of a dictionary word.
WORD_LENGTH = 24

# The contract's patterns.
_ASSIGN = re.compile(r"""(?ai:(?:password|passwd|secret|token|api_?key))["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
#: Where else credentials stand: a name of one before a sign of assignment, an authorization scheme, an address's user part.
_CONTEXT = re.compile(r"""(?ai:(?:pass(?:word|wd|phrase|code|key)?|pwd|pw|secret|token|api[_ -]?key|credentials?|private[_ -]?key)s?)["'`]? *(?:=>|:=|[:=]) *(?:"([^"\s]+)"|'([^'\s]+)'|`([^`\s]+)`|([^\s"'`]+))|(?ai:\b(?:bearer|basic)) +([A-Za-z0-9+/_.~=-]+)|://[^\s:/@]+:([^\s/@]+)@""")
#: One linear pass by which most texts are left out.
_ANY = r"(?i)pass|pwd|pw[^a-z0-9]|secret|token|api|cred|private|bearer|basic|://|akia|[0-9a-f]{16}"

#: Rows of the usual keyboards, and the least of what is called a walk.
_KEYS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./", "azertyuiop", "qsdfghjklm", "wxcvbn", "qwertzuiop", "yxcvbnm")
_WALK, _REPEAT = 3, 3
_PLACE = {k: (y, x) for y, row in enumerate(_KEYS[:4]) for x, k in enumerate(row)}
_NEXT_ON_ROW = {(a, b) for row in _KEYS for a, b in zip(row, row[1:])} | {(b, a) for row in _KEYS for a, b in zip(row, row[1:])}
_SHIFTED = str.maketrans('~!@#$%^&*()_+{}|:"<>?', "`1234567890-=[]\\;',./")
_DATE = re.compile(r"(?:(?:19|20)[0-9]{2}([-/._]?)(?:0?[1-9]|1[0-2])\1(?:[12][0-9]|3[01]|0?[1-9]))|(?:(?:[12][0-9]|3[01]|0?[1-9])([-/._]?)(?:0?[1-9]|1[0-2])\2(?:19|20)[0-9]{2})|(?:19|20)[0-9]{2}")
#: Bits for a year, a day of a year, the form of a date; a step of a walk and its start; the choice of each further segment.
_YEAR_BITS, _DAY_BITS, _FORM_BITS, _STEP_BITS, _START_BITS, _SEGMENT_BITS = log2(130), log2(366), 2.0, 1.5, log2(94), 1.0


def _adjacent(a: str, b: str) -> bool:
    if (a, b) in _NEXT_ON_ROW:
        return True
    if a == b or a not in _PLACE or b not in _PLACE:
        return False
    (y, x), (v, u) = _PLACE[a], _PLACE[b]
    return (v - y, u - x) in ((1, 0), (1, -1), (-1, 0), (-1, 1))


_ADJACENT = {(a, b) for a in "".join(_KEYS) for b in "".join(_KEYS) if _adjacent(a, b)}


@lru_cache(maxsize=4096)
def _sign_bits(c: str) -> float:
    """Brute force: the bits of one sign by its kind."""
    if c.isdigit():
        return log2(10)
    if c.isalpha():
        return log2(26) if c.isascii() else log2(200)
    return log2(33) if c.isascii() else log2(1000)


def _piece_bits(value: str, words: dict[str, float]) -> float:
    n, low = len(value), value.lower()
    if len(low) != n:  # a letter whose lower case is longer
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
    keys = low.translate(_SHIFTED)
    best = [0.0] + [float("inf")] * n
    for i in range(n):
        base = best[i] + (_SEGMENT_BITS if i else 0.0)

        def reach(j: int, bits: float) -> None:
            if base + bits < best[j]:
                best[j] = base + bits

        # Brute force goes on where it is: only its first sign opens a segment.
        brute = 0.0
        for j in range(i + 1, min(n, i + 16) + 1):
            brute += _sign_bits(value[j - 1]) + (1.0 if value[j - 1].isupper() and j > i + 1 else 0.0)
            reach(j, brute)
        # Words; capitals in them cost by where they stand.
        if low[i].isalpha():
            for j in range(i + 3, min(n, i + WORD_LENGTH) + 1):
                bits = words.get(low[i:j])
                if bits is not None:
                    form = value[i:j]
                    reach(j, bits + (0.0 if form.islower() else 1.0 if form[1:].islower() or form.isupper() else sum(c.isupper() for c in form) + 1.0))
        # Dates and years.
        if value[i].isdigit():
            found = _DATE.match(value, i)
            if found:
                reach(found.end(), _YEAR_BITS + (_DAY_BITS + _FORM_BITS if found.end() > i + 4 else 0.0))
        # Keyboard walks: from their start to every place that they reach.
        j = i + 1
        while j < n and (keys[j - 1], keys[j]) in _ADJACENT:
            j += 1
            if j - i >= _WALK:
                reach(j, _START_BITS + _STEP_BITS * (j - i - 1) + (1.0 if value[i:j] != low[i:j] else 0.0))
        # Repeats: what the first period costs by brute force, and how often it comes.
        brute = 0.0
        for p in range(1, min(8, (n - i) // 2) + 1):
            brute += _sign_bits(value[i + p - 1])
            j = i + p
            while j < n and value[j] == value[j - p]:
                j += 1
            if j - i >= max(_REPEAT, 2 * p):
                reach(j, brute + log2((j - i) / p) + 1.0)
    return best[n]


def guess_bits(value: str, words: dict[str, float]) -> float:
    """Bits of the cheapest segmentation of a value; words: word -> bits."""
    return sum(_piece_bits(value[i : i + MAX_VALUE], words) for i in range(0, len(value), MAX_VALUE))


def mixed(value: str) -> bool:
    """Whether kinds of signs mix as in no plain word: letters with digits or signs inside, or capitals inside."""
    kinds = {"d" if c.isdigit() else "u" if c.isupper() else "l" if c.isalpha() else "s" for c in value}
    return len(kinds) > 1 and not (kinds == {"u", "l"} and value[1:].islower())


_EDGES = ".,;:!?)]}>"


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """By start, then kind as listed."""
    out = [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m.group(1)) >= 12]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def guessed_spans(text: str, base: list[tuple[str, int, int]], words: dict[str, float]) -> list[tuple[str, int, int, float]]:
    """Values in credential contexts that no base span touches and that take MIN_BITS or more."""
    out, i = [], 0
    for m in _CONTEXT.finditer(text):
        start, end = m.span(m.lastindex)
        while end > start and text[end - 1] in _EDGES:
            end -= 1
        while i < len(base) and base[i][2] <= start:
            i += 1
        if any(s < end and e > start for _, s, e in base[i : i + 3]) or end - start < 6 or "://" in text[start:end] or not mixed(text[start:end]):
            continue
        bits = guess_bits(text[start:end], words)
        if bits >= MIN_BITS:
            out.append(("guess", start, end, bits))
    return out


def dictionary(docs: DataFrame, words: int = WORDS, classes: int = CLASSES) -> dict[str, float]:
    """word -> bits, for the most frequent classes of words (3 to WORD_LENGTH letters a-z, folded) with at most so many words."""
    letters = F.explode(F.split(F.lower(F.coalesce(F.col("text").cast("string"), F.lit(""))), "[^a-z]+")).alias("word")
    counts = docs.select(letters).where(F.length("word").between(3, WORD_LENGTH)).groupBy("word").agg(F.count("*").alias("n"))
    classed = staged(counts.select("word", F.floor(F.log2("n") * classes).cast("int").alias("c")), "word-classes")
    # One row per class: classes grow with the logarithm of the corpus.
    sizes = sorted(((r["c"], r["k"]) for r in classed.groupBy("c").agg(F.count("*").alias("k")).collect()), reverse=True)
    bits, total, least = {}, 0, None
    for c, k in sizes:
        total += k
        if total > words:
            break
        bits[c], least = log2(total), c
    if least is None:
        return {}
    return {r["word"]: bits[r["c"]] for r in classed.where(F.col("c") >= least).collect()}


_FOUND = pa.schema([("doc_id", pa.int64()), ("base", pa.list_(pa.string())), ("added", pa.list_(pa.string())), ("bits", pa.list_(pa.float64()))])


def secrets(docs: DataFrame, words: dict[str, float] | None = None) -> DataFrame:
    """doc_id, base, added (kind:start:end, by start, then kind), bits (of each added span)."""
    known = docs.sparkSession.sparkContext.broadcast(dictionary(docs) if words is None else words)
    inner = docs.select(F.col("doc_id").cast("long").alias("k"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            likely = pc.match_substring_regex(batch.column(1), _ANY).to_pylist()
            for i, (key, some) in enumerate(zip(batch.column(0).to_pylist(), likely, strict=True)):
                base, added = [], []
                if some:
                    text = batch.column(1)[i].as_py()
                    base = base_spans(text)
                    added = guessed_spans(text, sorted(base, key=lambda s: s[1:]), known.value)
                rows.append((key, [f"{k}:{s}:{e}" for k, s, e in base], [f"{k}:{s}:{e}" for k, s, e, _ in added], [b for *_, b in added]))
            yield record_batch(_FOUND, rows)

    return inner.mapInArrow(run, "doc_id long, base array<string>, added array<string>, bits array<double>")


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets(table(spark, sf_dir, "documents"))
    rank = F.array(*[F.lit(k) for k in KINDS])

    def in_order(spans):
        keyed = F.transform(spans, lambda s: F.struct(F.split(s, ":")[1].cast("long").alias("a"), F.array_position(rank, F.split(s, ":")[0]).alias("k"), s.alias("s")))
        return F.transform(F.array_sort(keyed), lambda x: x["s"])

    def number(kind: str):
        return F.size(F.filter("base", lambda s: s.startswith(f"{kind}:"))).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *[number(k) for k in KINDS[:3]], F.sha2(F.array_join("base", ","), 256).alias("base_sha256"), F.array_join(in_order(F.concat("base", "added")), ",").alias("spans"), F.size("added").cast("long").alias("n_guess"))
