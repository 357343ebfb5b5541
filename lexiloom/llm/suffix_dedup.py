"""Substring deduplication of bytes by difference-cover suffix arrays.

Every byte goes that lies in a 100-byte string which also starts earlier (in a
document with a smaller doc_id, or further to the front of the same one).  A
suffix array of all bytes would be sorted several times over by every task of
the cluster; but equal 100-byte strings have equal anchors, so the suffixes are
first dealt to buckets by anchor (see :mod:`.repeats`), and those whose anchor
occurs once anywhere are left out, which loses nothing.  In a bucket the
difference-cover algorithm sorts the suffixes: triples at the positions 1 and 2
modulo 3 are sorted and named, the names are sorted by recursion (until a name
stands for 100 bytes or more), the remaining suffixes follow from their first
byte and the next one's rank, and both are merged.  Neighbours of the array
whose first 100 bytes agree are equal windows.

Null texts count as empty; null doc_ids come last; rows that repeat a doc_id
count as documents in the order of their texts' SHA-256 (equal rows as one); very
long texts are taken whole, their windows dealt like others'; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import record_batch, table
from .repeats import Unit, from_places, merged, with_stretches

WINDOW, GRAM = 100, 32
_TABLE = np.random.default_rng(2).integers(0, 1 << 63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def cut(text: bytes) -> bytes:
    return text


def byte_hashes(texts: list[bytes]) -> np.ndarray:
    return _TABLE[np.frombuffer(b"".join(texts), np.uint8)]


def join(text: bytes, start: int, stop: int) -> bytes:
    return text[start:stop]


# --- the difference-cover suffix array ---------------------------------------------------------------------
def _key(*columns: np.ndarray) -> np.ndarray:
    """One number per tuple, in the tuples' order."""
    out = columns[0]
    for c in columns[1:]:
        top = int(c.max()) + 1
        if int(out.max()) >= (1 << 62) // top:
            out = _names(out)
        out = out * top + c
    return out


def _names(key: np.ndarray) -> np.ndarray:
    """Dense ranks of numbers, from 0; by marking where the numbers are small, else by sorting."""
    top = int(key.max()) + 1
    if top <= max(1 << 16, 4 * len(key)):
        there = np.zeros(top, bool)
        there[key] = True
        return (np.cumsum(there) - 1)[key]
    return np.unique(key, return_inverse=True)[1].astype(np.int64)


def _smaller(of: np.ndarray, than: np.ndarray) -> np.ndarray:
    """How many of `of` are smaller than each of `than`; sorted needles keep the search in cache."""
    order = np.argsort(than)
    out = np.empty(len(than), np.int64)
    out[order] = np.searchsorted(np.sort(of), than[order])
    return out


def suffix_ranks(s: np.ndarray, depth: int, covers: int = 1) -> np.ndarray:
    """Ranks (from 1, ordered like the suffixes of s) for symbols of 1 or more that stand for `covers` bytes each; suffixes that agree in `depth` bytes may share a rank."""
    n = len(s)
    if n == 1:
        return np.ones(1, np.int64)
    s = _names(s) + 1
    if covers >= depth:
        return s
    t = np.zeros(n + 3, np.int64)
    t[:n] = s
    one, two, zero = np.arange(1, n, 3), np.arange(2, n, 3), np.arange(0, n, 3)
    sample = np.concatenate([one, two])
    names = _names(_key(t[sample], t[sample + 1], t[sample + 2])) + 1
    if names.max() < len(names):
        # The names of positions 1, 4, 7, ... and then those of 2, 5, 8, ...; a gap parts the two.
        text = np.concatenate([names[: len(one)], [0], names[len(one) :]])
        names = _names(np.delete(suffix_ranks(text + 1, depth, 3 * covers), len(one))) + 1
    rank = np.zeros(n + 3, np.int64)
    rank[sample] = names
    # Merge on comparable keys: a suffix at 0 modulo 3 against one at 1 by (symbol, rank of the next), against one at 2 by (two symbols, rank after them).
    by_one = _key(np.concatenate([t[zero], t[one]]), np.concatenate([rank[zero + 1], rank[one + 1]]))
    by_two = _key(*(np.concatenate([x[zero + i], x[two + i]]) for x, i in ((t, 0), (t, 1), (rank, 2))))
    zero_one, zero_two, one_zero, two_zero = by_one[: len(zero)], by_two[: len(zero)], by_one[len(zero) :], by_two[len(zero) :]
    # A suffix's rank is one more than the number of smaller ones, sampled and not.
    times = np.bincount(names)
    out = np.empty(n, np.int64)
    out[zero] = 1 + _smaller(zero_one, zero_one) + _smaller(one_zero, zero_one) + _smaller(two_zero, zero_two)
    out[one] = _smaller(zero_one, one_zero)
    out[two] = _smaller(zero_two, two_zero)
    out[sample] += 1 + (np.cumsum(times) - times)[names]
    return out


def solve(strings: list[bytes], u: np.ndarray, start: np.ndarray, count: np.ndarray) -> list[np.ndarray]:
    """Per string: which of its windows also start earlier, in another string or in this one."""
    sizes = np.fromiter(map(len, strings), np.int64, len(strings)) + 1
    s = np.frombuffer(b"".join(x + b"\0" for x in strings), np.uint8).astype(np.int64) + 2
    begin = np.cumsum(sizes) - sizes
    s[begin + sizes - 1] = 1  # parts the strings; windows never reach it
    place = np.repeat(begin - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
    order = place[np.argsort(suffix_ranks(s, WINDOW)[place])]
    owner = np.repeat(np.arange(len(strings)), sizes)
    # Adjacent prefixes, eight bytes at a time.
    eight = np.zeros(len(s) + WINDOW, np.uint64)
    padded = np.zeros(len(s) + WINDOW + 8, np.uint64)
    padded[: len(s)] = s.astype(np.uint64) - np.uint64(2)
    for i in range(8):
        eight |= padded[i : i + len(eight)] << np.uint64(8 * i)
    same = np.arange(1, len(order))
    for at in [*range(0, WINDOW - 8, 8), WINDOW - 8]:
        same = same[eight[order[same] + at] == eight[order[same - 1] + at]]
    flags = [np.zeros(c, bool) for c in count.tolist()]
    if not len(same):
        return flags
    tied = np.zeros(len(order), bool)
    tied[same] = True
    group = np.cumsum(~tied)
    member = tied.copy()
    member[same - 1] = True
    at = np.flatnonzero(member)
    p, g = order[at], group[at]
    w = owner[p]
    doc, position = u[w], start[w] + p - begin[w]
    ranked = np.lexsort((position, doc, g))
    first = np.concatenate([[True], g[ranked][1:] != g[ranked][:-1]])
    lead = ranked[np.maximum.accumulate(np.where(first, np.arange(len(ranked)), 0))]
    gone = ranked[(doc[ranked] != doc[lead]) | (position[ranked] != position[lead])]
    for i, j in zip(w[gone].tolist(), (p[gone] - begin[w[gone]]).tolist(), strict=True):
        flags[i][j] = True
    return flags


BYTES = Unit(WINDOW, GRAM, cut, len, byte_hashes, join, solve, same_document=True)
KEPT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("kept", pa.binary()), ("n_removed", pa.int64()), ("n_spans", pa.int64())])


def remove_repeated_bytes(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, kept (the bytes left), n_removed, n_spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, t, blobs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                start, stop = merged(*from_places(blobs or [], 2))
                edges = [0, *(x for pair in zip(start.tolist(), stop.tolist(), strict=True) for x in pair), len(t)]
                kept = b"".join(t[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                rows.append((k, len(t), kept, len(t) - len(kept), len(start)))
            yield record_batch(KEPT, rows)

    return with_stretches(docs, BYTES).mapInArrow(run, "doc_id long, n_bytes long, kept binary, n_removed long, n_spans long")


DIGEST = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeated_bytes(table(spark, sf_dir, "documents"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, n, kept, gone, spans = batch.columns
            yield pa.record_batch([k, n, gone, spans, pa.array([hashlib.sha256(x.as_py()).hexdigest() for x in kept])], schema=DIGEST)

    return found.mapInArrow(digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
