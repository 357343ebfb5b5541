"""Substring deduplication of words by super-k-mer partitioning.

A window is 13 words in a row.  Windows in a row that share a minimiser (the
least-hashed 5 words in them) travel as one packed string, a super-k-mer, to the
minimiser's bucket, where sorting the windows counts them exactly.  See
:mod:`.repeats` for the steps and for how skew is kept from any one task.

A word goes if a window over it also starts in a document with a smaller doc_id.
Null texts have no words; null doc_ids come last; rows that repeat a doc_id count
as documents in the order of their texts' SHA-256 (equal rows as one); very long
texts are taken whole; an empty table gives an empty result; other columns are not
read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from .common import record_batch, table
from .repeats import Unit, from_places, merged, with_stretches

WINDOW, MINIMISER = 13, 5
CACHE_WORDS = 150_000
_HASHES: dict[bytes, int] = {}


def cut(text: bytes) -> list[bytes]:
    return text.split()


def word_hashes(texts: list[list[bytes]]) -> np.ndarray:
    words = [w for t in texts for w in t]
    fresh = set(words) - _HASHES.keys()
    if len(_HASHES) + len(fresh) > CACHE_WORDS:
        _HASHES.clear()
        fresh = set(words)
    _HASHES.update((w, xxhash.xxh64_intdigest(w)) for w in fresh)
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def join(words: list[bytes], start: int, stop: int) -> bytes:
    return b" ".join(words[start:stop])


def solve(strings: list[bytes], u: np.ndarray, start: np.ndarray, count: np.ndarray) -> list[np.ndarray]:
    """Per super-k-mer: which of its windows also start in a document before its own. Sorted windows stand beside their equals, the earliest document first."""
    flags = [np.zeros(c, bool) for c in count.tolist()]
    if len(strings) == 1:
        return flags
    rows: list[tuple[bytes, int, int, int]] = []
    for i, (x, doc, n) in enumerate(zip(strings, u.tolist(), count.tolist(), strict=True)):
        words = x.split(b" ")
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1).tolist()
        starts = [0, *ends]
        rows += [(x[starts[j] : ends[j + WINDOW - 1] - 1], doc, i, j) for j in range(n)]
    rows.sort()
    last, least = None, 0
    for x, doc, i, j in rows:
        if x != last:
            last, least = x, doc
        elif doc > least:
            flags[i][j] = True
    return flags


WORDS = Unit(WINDOW, MINIMISER, cut, len, word_hashes, join, solve, same_document=False)
KEPT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("kept", pa.binary()), ("n_removed", pa.int64())])


def remove_repeated_words(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, kept (the words left, joined by one space, as UTF-8), n_removed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, t, blobs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = t.split()
                gone = 0
                if blobs:
                    start, stop = merged(*from_places(blobs, 2))
                    gone = int((stop - start).sum())
                    edges = [0, *(x for pair in zip(start.tolist(), stop.tolist(), strict=True) for x in pair), len(words)]
                    kept = [w for a, b in zip(edges[::2], edges[1::2], strict=True) for w in words[a:b]]
                else:
                    kept = words
                rows.append((k, len(words), b" ".join(kept), gone))
            yield record_batch(KEPT, rows)

    return with_stretches(docs, WORDS).mapInArrow(run, "doc_id long, n_words long, kept binary, n_removed long")


DIGEST = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeated_words(table(spark, sf_dir, "documents"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, n, kept, gone = batch.columns
            yield pa.record_batch([k, n, gone, pa.array([hashlib.sha256(x.as_py()).hexdigest() for x in kept])], schema=DIGEST)

    return found.mapInArrow(digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")
