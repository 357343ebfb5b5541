"""What exact-substring deduplication of bytes and of words have in common.

Both ask of every window (W units in a row) whether its content occurs earlier.
1. Every window has an *anchor*, the least-hashed m-gram of its units; windows
   with equal content have equal anchors.  Consecutive windows of one anchor form
   a *run*.  Only anchors that occur twice anywhere can hold repeated windows:
   their hashes are counted in buckets, as packed columns, not row by row.
2. Runs of repeated anchors travel as one string each to the anchor's bucket; of
   equal strings of a task only the earliest does, the later ones are removed at
   once (all their windows occur earlier).
3. In its bucket a solver, exact on the strings, finds the earliest occurrence of
   each window.  An anchor that holds too much of its bucket is split by window:
   each window then goes to a bucket of its own content.
4. The removed stretches go back to their documents.

Intermediate tables are written to the shared folder.  A document is known by
`u`, its doc_id; null doc_ids come last.  Where doc_ids repeat, `u` is the place
of (doc_id, hash of the text) in ascending order instead, so that such rows are
documents of their own, ordered by that hash, and rows that agree in both are one
document (they get equal results).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_bytes, record_batch, shuffle_partitions, staged

LAST = (1 << 63) - 1
#: Anchor occurrences, and bytes of run strings, that a task gathers before it passes them on.
HOLD_ANCHORS, HOLD_BYTES = 400_000, 12_000_000
#: Bytes of texts that are hashed together.
GROUP_BYTES = 400_000
#: Bytes of run strings that a solver is given at once (or one anchor's).
PIECE_BYTES = 300_000
#: Bytes of run strings in a bucket beyond which its anchors are looked at one by one, and the share of these that makes an anchor hot.
BUCKET_BYTES, HOT_BYTES = 64_000_000, 8_000_000
#: Text that a partition stands for.
PART_BYTES = 16_000_000
#: Most cells into which a task deals what it holds. Beyond so many buckets it deals to groups of them, and another exchange to the buckets of each group.
MOST_CELLS = 8192


@dataclass(frozen=True)
class Unit:
    """How a text is cut, hashed and put together again. Only module-level functions, so that it travels by name."""

    window: int
    gram: int
    cut: Callable[[bytes], Any]  # text -> units
    size: Callable[[Any], int]
    hashes: Callable[[list[Any]], np.ndarray]  # unit hashes of several cut texts, one after another
    join: Callable[[Any, int, int], bytes]  # units[start:stop] as a string
    solve: Callable[[list[bytes], np.ndarray, np.ndarray, np.ndarray], list[np.ndarray]]
    #: May an equal run of the same document, further on, be removed for the earlier one?
    same_document: bool


# --- packed columns ----------------------------------------------------------------------------------
def pack(columns: list[np.ndarray]) -> bytes:
    """Columns of 64-bit integers, byte planes apart (high bytes compress to nothing)."""
    flat = b"".join(np.ascontiguousarray(c.astype(np.int64).view(np.uint8).reshape(-1, 8).T).tobytes() for c in columns)
    return zstandard.ZstdCompressor(level=1).compress(flat)


def unpack(blob: bytes, n_columns: int) -> list[np.ndarray]:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    n = len(flat) // (8 * n_columns)
    return [np.ascontiguousarray(flat[8 * n * i : 8 * n * (i + 1)].reshape(8, n).T).view(np.int64).reshape(-1) for i in range(n_columns)]


def pack_strings(strings: list[bytes]) -> bytes:
    sizes = pack([np.fromiter(map(len, strings), np.int64, len(strings))])
    return len(sizes).to_bytes(4, "little") + sizes + zstandard.ZstdCompressor(level=1).compress(b"".join(strings))


def unpack_strings(blob: bytes) -> list[bytes]:
    n = int.from_bytes(blob[:4], "little")
    flat = zstandard.ZstdDecompressor().decompress(blob[4 + n :])
    ends = np.cumsum(unpack(blob[4 : 4 + n], 1)[0]).tolist()
    return [flat[s:e] for s, e in zip([0, *ends], ends)]


# --- anchors -------------------------------------------------------------------------------------------
_STEP = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(h: np.ndarray, m: int) -> np.ndarray:
    """A hash of every m units in a row, by doubling."""
    power, width, out, out_width = h, 1, None, 0
    while True:
        if m & width:
            if out is None:
                out, out_width = power, width
            else:
                n = len(h) - out_width - width + 1
                out = out[:n] * (_STEP + np.uint64(2 * out_width)) + (power[out_width : out_width + n] ^ (power[out_width : out_width + n] >> np.uint64(29)))
                out_width += width
        if out_width == m:
            break
        n = len(power) - width
        power = power[:n] * (_STEP + np.uint64(2 * width + 1)) + (power[width:] ^ (power[width:] >> np.uint64(31)))
        width *= 2
    out = (out ^ (out >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(32))


def window_minimum(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w values in a row."""
    done = 1
    while 2 * done <= w:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    return np.minimum(x[: len(x) - (w - done)], x[w - done :]) if w > done else x


def runs(h: np.ndarray, sizes: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Unit hashes of several documents in a row. Per run: document, first window's start in it, number of windows, anchor (48 bits)."""
    none = np.zeros(0, np.int64)
    if len(h) < window:
        return none, none, none, none
    g = gram_hashes(h, gram)
    bits = max(1, int(len(g)).bit_length())
    keyed = (g >> np.uint64(bits) << np.uint64(bits)) | (np.uint64(len(g)) - np.arange(len(g), dtype=np.uint64) - np.uint64(1))  # ties: the rightmost
    where = np.int64(len(g) - 1) - (window_minimum(keyed, window - gram + 1) & np.uint64((1 << bits) - 1)).astype(np.int64)
    starts = np.cumsum(sizes) - sizes
    doc = np.repeat(np.arange(len(sizes)), sizes)[: len(where)]
    valid = np.arange(len(where)) + window <= (starts + sizes)[doc]
    new = np.ones(len(where), bool)
    new[1:] = (where[1:] != where[:-1]) | (valid[1:] != valid[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(where)))
    good = valid[first]
    first, count = first[good], count[good]
    return doc[first], first - starts[doc[first]], count, (g[where[first]] >> np.uint64(16)).astype(np.int64)


def _groups(items: list, size: Callable[[Any], int], most: int) -> Iterator[slice]:
    start = total = 0
    for i, x in enumerate(items):
        if i > start and total + size(x) > most:
            yield slice(start, i)
            start, total = i, 0
        total += size(x)
    if start < len(items):
        yield slice(start, len(items))


# --- documents -------------------------------------------------------------------------------------------
def keyed_documents(docs: DataFrame) -> DataFrame:
    """u, k (the doc_id), t (bytes). See the module's text."""
    plain = doc_bytes(docs).select(F.coalesce("k", F.lit(LAST)).alias("u"), "k", "t")
    repeated = plain.groupBy("u").count().where("count > 1")
    if repeated.limit(1).count() == 0:
        return plain
    marked = plain.withColumn("h", F.sha2("t", 256))
    pairs = marked.select("u", "h").distinct().repartitionByRange(shuffle_partitions(docs.sparkSession), "u", "h").sortWithinPartitions("u", "h")
    placed = staged(pairs.withColumn("v", F.monotonically_increasing_id()), "document-keys")  # ascending over the ranges
    return staged(marked.join(placed, ["u", "h"]).select(F.col("v").alias("u"), "k", "t"), "keyed-documents")


# --- steps ---------------------------------------------------------------------------------------------------
CELLS = pa.schema([("b", pa.int32()), ("n", pa.int64()), ("blob", pa.binary()), ("strings", pa.binary())])
CELLS_DDL = "b int, n long, blob binary, strings binary"
PLACES = pa.schema([("u", pa.int64()), ("blob", pa.binary())])


def _dealt(b: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Every number that occurs, with the places where it does. Time follows the places, not the numbers that there could be."""
    order = np.argsort(b, kind="stable")
    values, first = np.unique(b[order], return_index=True)
    for value, part in zip(values.tolist(), np.split(order, first[1:]), strict=True):
        yield value, part


def _bucket_of(a: np.ndarray, u: np.ndarray, weight: np.ndarray, buckets: int) -> np.ndarray:
    return np.where(weight < 0, (u * 31 + 7) % buckets, a % buckets)


def _count_cells(a: np.ndarray, u: np.ndarray, p: np.ndarray, weight: np.ndarray, buckets: int, wide: int) -> Iterator[pa.RecordBatch]:
    """Occurrences in cells of `wide` buckets."""
    rows = []
    for i, part in _dealt(_bucket_of(a, u, weight, buckets) // wide):
        rows.append((i, len(part), pack([a[part], u[part], p[part], weight[part]]), b""))
        if len(rows) >= 1024:
            yield record_batch(CELLS, rows)
            rows = []
    if rows:
        yield record_batch(CELLS, rows)


def _narrow_counts(buckets: int):
    """Cells of several buckets become cells of one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        n = 0
        for batch in batches:
            for blob in batch.column(2).to_pylist():
                held.append(unpack(blob, 4))
                n += len(held[-1][0])
                if n >= HOLD_ANCHORS:
                    yield from _count_cells(*(np.concatenate(c) for c in zip(*held, strict=True)), buckets, 1)
                    held, n = [], 0
        if held:
            yield from _count_cells(*(np.concatenate(c) for c in zip(*held, strict=True)), buckets, 1)

    return run


def _narrow_runs(buckets: int):
    """The same of runs; removed stretches (b = -1) pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        strings: list[bytes] = []
        n = 0
        for batch in batches:
            for b, size, blob, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if b < 0:
                    yield record_batch(CELLS, [(b, size, blob, packed)])
                    continue
                held.append(unpack(blob, 4))
                strings += unpack_strings(packed)
                n += size
                if n >= HOLD_BYTES:
                    yield from _cells(*(np.concatenate(c) for c in zip(*held, strict=True)), strings, buckets, 1)
                    held, strings, n = [], [], 0
        if held:
            yield from _cells(*(np.concatenate(c) for c in zip(*held, strict=True)), strings, buckets, 1)

    return run


def _count_anchors(unit: Unit, buckets: int, wide: int):
    """Occurrences (anchor, u, place, weight) to the anchor's bucket; of those of an anchor in one task the first stands for all, the others are known to be repeated and go to a bucket of their document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        n = 0

        def flush() -> Iterator[pa.RecordBatch]:
            a, u, p = (np.concatenate(c) for c in zip(*held, strict=True))
            order = np.argsort(a, kind="stable")
            a, u, p = a[order], u[order], p[order]
            first = np.ones(len(a), bool)
            first[1:] = a[1:] != a[:-1]
            weight = np.where(first, 0, -1)  # -1: known to be repeated
            at = np.flatnonzero(first)
            weight[at] = np.diff(np.append(at, len(a)))
            yield from _count_cells(a, u, p, weight, buckets, wide)

        for batch in batches:
            keys, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
            for part in _groups(texts, len, GROUP_BYTES):
                cut = [unit.cut(t) for t in texts[part]]
                sizes = np.fromiter(map(unit.size, cut), np.int64, len(cut))
                doc, start, count, anchor = runs(unit.hashes(cut), sizes, unit.window, unit.gram)
                held.append((anchor, keys[part][doc], start << 8 | count))
                n += len(doc)
                if n >= HOLD_ANCHORS:
                    yield from flush()
                    held, n = [], 0
        if n:
            yield from flush()

    return run


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> dict[int, list[tuple[bytes, bytes]]]:
    found: dict[int, list[tuple[bytes, bytes]]] = {}
    for batch in batches:
        for b, blob, strings in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            found.setdefault(b, []).append((blob, strings))
    return found


def _places(u: np.ndarray, columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """One row for each document: u, packed columns."""
    order = np.argsort(u, kind="stable")
    u, columns = u[order], [c[order] for c in columns]
    first = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]])) if len(u) else np.zeros(0, np.int64)
    ends = np.append(first[1:], len(u))
    for at in range(0, len(first), 20_000):
        here = range(at, min(len(first), at + 20_000))
        yield record_batch(PLACES, [(int(u[first[i]]), b"".join(c[first[i] : ends[i]].astype("<i8").tobytes() for c in columns)) for i in here])


def from_places(blobs: list[bytes], n_columns: int) -> list[np.ndarray]:
    parts = [np.frombuffer(b, "<i8").reshape(n_columns, -1) for b in blobs]
    return list(np.concatenate(parts, axis=1)) if parts else [np.zeros(0, np.int64)] * n_columns


def _repeated_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per bucket the occurrences of anchors that occur twice or more: (u, place, anchor)."""
    for cells in _by_bucket(batches).values():
        a, u, p, weight = (np.concatenate(c) for c in zip(*(unpack(blob, 4) for blob, _ in cells), strict=True))
        known = weight < 0
        order = np.argsort(a[~known], kind="stable")
        b, w = a[~known][order], weight[~known][order]
        first = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]])) if len(b) else np.zeros(0, np.int64)
        times = np.diff(np.append(first, len(b)))
        total = np.add.reduceat(w, first) if len(first) else first
        again = np.repeat(total > 1, times)
        pick = np.concatenate([np.flatnonzero(known), np.flatnonzero(~known)[order[again]]])
        yield from _places(u[pick], [p[pick], a[pick]])


def _cells(anchor: np.ndarray, u: np.ndarray, start: np.ndarray, count: np.ndarray, strings: list[bytes], buckets: int, wide: int) -> Iterator[pa.RecordBatch]:
    for i, part in _dealt(anchor % buckets // wide):
        held = [strings[j] for j in part.tolist()]
        yield record_batch(CELLS, [(i, sum(map(len, held)), pack([anchor[part], u[part], start[part], count[part]]), pack_strings(held))])


def _send_runs(unit: Unit, buckets: int, wide: int):
    """Documents with their repeated anchors: run strings to the anchors' buckets (b >= 0); later copies within the task as removed stretches (b = -1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[int, bytes], list[tuple[int, int, int]]] = {}
        gone: list[tuple[int, int, int]] = []
        size = 0

        def later(u: int, start: int, count: int) -> None:
            gone.append((u, start, start + count + unit.window - 1))

        def flush() -> Iterator[pa.RecordBatch]:
            rows = [(a, u, s, c, x) for (a, x), places in best.items() for u, s, c in places]
            if rows:
                a, u, s, c, strings = zip(*rows, strict=True)
                yield from _cells(*(np.array(x, np.int64) for x in (a, u, s, c)), list(strings), buckets, wide)
            for at in range(0, len(gone), 500_000):
                part = gone[at : at + 500_000]
                yield record_batch(CELLS, [(-1, 0, pack([np.array(x, np.int64) for x in zip(*part, strict=True)]), b"")])

        for batch in batches:
            for u, t, blobs in zip(*(batch.column(i) for i in range(3)), strict=True):
                u, cut = u.as_py(), unit.cut(t.as_py())
                place, anchors = from_places(blobs.as_py(), 2)
                place, at = np.unique(place, return_index=True)
                for p, a in zip(place.tolist(), anchors[at].tolist(), strict=True):
                    start, count = p >> 8, p & 255
                    x = unit.join(cut, start, start + count + unit.window - 1)
                    found = best.get((a, x))
                    if found is None:
                        best[a, x] = [(u, start, count)]
                        size += len(x) + 200
                        continue
                    u0, s0, _ = found[0]
                    if u0 == u and not unit.same_document:
                        found.append((u, start, count))
                    elif (u, start) < (u0, s0):
                        for o in found:
                            later(*o)
                        best[a, x] = [(u, start, count)]
                    elif (u, start) > (u0, s0):
                        later(u, start, count)
                if size >= HOLD_BYTES:
                    yield from flush()
                    best.clear()
                    gone.clear()
                    size = 0
        yield from flush()

    return run


def _split_hot(unit: Unit, hot: np.ndarray, buckets: int):
    """Runs of hot anchors become runs of one window, whose anchor is a hash of the window's own string (56 bits, apart from the 48 of others)."""
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, n, blob, strings in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                anchor, u, start, count = unpack(blob, 4)
                is_hot = np.isin(anchor, hot)
                if not is_hot.any():
                    yield record_batch(CELLS, [(b, n, blob, strings)])
                    continue
                held = unpack_strings(strings)
                rows = []
                for i in range(len(held)):
                    if not is_hot[i]:
                        rows.append((anchor[i], u[i], start[i], count[i], held[i]))
                        continue
                    cut = unit.cut(held[i])
                    for j in range(int(count[i])):
                        x = unit.join(cut, j, j + unit.window)
                        rows.append((xxhash.xxh64_intdigest(x) >> 8 | 1 << 56, u[i], start[i] + j, 1, x))
                a, u, s, c, x = zip(*rows, strict=True)
                yield from _cells(*(np.array(y, np.int64) for y in (a, u, s, c)), list(x), buckets, 1)

    return run


def _solve_buckets(unit: Unit):
    """Removed stretches per document: u, packed (start, stop). Buckets are solved in pieces of whole anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, cells in _by_bucket(batches).items():
            if b < 0:
                for blob, _ in cells:
                    u, start, stop = unpack(blob, 3)
                    yield from _places(u, [start, stop])
                continue
            anchor, u, start, count = (np.concatenate(c) for c in zip(*(unpack(blob, 4) for blob, _ in cells), strict=True))
            strings = [x for _, s in cells for x in unpack_strings(s)]
            cells.clear()
            kept, out = _distinct(unit, anchor.tolist(), u.tolist(), start.tolist(), count.tolist(), strings)
            anchor, u, start, count = anchor[kept], u[kept], start[kept], count[kept]
            order = np.lexsort((start, u, anchor))
            anchor, u, start, count = anchor[order], u[order], start[order], count[order]
            strings = [strings[i] for i in kept[order]]
            edges = np.append(np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]])), len(anchor)) if len(anchor) else np.zeros(1, np.int64)
            sizes = np.add.reduceat(np.fromiter(map(len, strings), np.int64, len(strings)), edges[:-1]) if len(anchor) else edges[:-1]
            for part in _groups(list(range(len(sizes))), lambda i: int(sizes[i]), PIECE_BYTES):
                lo, hi = edges[part.start], edges[part.stop]
                removed = unit.solve(strings[lo:hi], u[lo:hi], start[lo:hi], count[lo:hi])
                for i, flags in enumerate(removed, lo):
                    if not flags.any():
                        continue
                    change = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
                    for s, e in zip(change[::2].tolist(), change[1::2].tolist(), strict=True):
                        out.append((u[i], start[i] + s, start[i] + e - 1 + unit.window))
            if out:
                where, first, last = (np.array(x, np.int64) for x in zip(*out, strict=True))
                yield from _places(where, [first, last])

    return run


def _distinct(unit: Unit, anchor: list[int], u: list[int], start: list[int], count: list[int], strings: list[bytes]) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Of equal runs only the earliest is left to solve; later ones are removed whole. A run that is then its anchor's only one has nothing to be compared with: its windows all differ, for they hold its anchor at different places."""
    best: dict[tuple[int, bytes], list[int]] = {}
    gone: list[tuple[int, int, int]] = []
    for i, key in enumerate(zip(anchor, strings, strict=True)):
        found = best.get(key)
        if found is None:
            best[key] = [i]
            continue
        j = found[0]
        if u[i] == u[j] and not unit.same_document:
            found.append(i)
            continue
        if (u[i], start[i]) == (u[j], start[j]):
            continue
        later = [i]
        if (u[i], start[i]) < (u[j], start[j]):
            later, best[key] = found, [i]
        gone += [(u[k], start[k], start[k] + count[k] - 1 + unit.window) for k in later]
    times: dict[int, int] = {}
    for a, _ in best:
        times[a] = times.get(a, 0) + 1
    return np.array([i for (a, _), found in best.items() if times[a] > 1 for i in found], np.int64), gone


def removed_stretches(docs: DataFrame, unit: Unit) -> DataFrame:
    """docs: u, k, t. Returns u, blobs: per document with removed windows the packed (start, stop) of stretches of units; they may overlap."""
    size = docs.agg(F.sum(F.length("t").cast("long"))).first()[0] or 0
    parts = max(shuffle_partitions(docs.sparkSession), size // PART_BYTES)  # a task's work stays the same however large the corpus
    buckets = 4 * parts
    wide = -(-buckets // MOST_CELLS)  # buckets of a cell
    texts = docs.select("u", "t")
    cells = texts.mapInArrow(_count_anchors(unit, buckets, wide), CELLS_DDL)
    if wide > 1:
        cells = cells.repartition(MOST_CELLS, "b").mapInArrow(_narrow_counts(buckets), CELLS_DDL)
    counted = cells.repartition(parts, "b").mapInArrow(_repeated_anchors, "u long, blob binary")
    listed = counted.groupBy("u").agg(F.collect_list("blob").alias("blobs"))  # a document's own anchors
    sent = texts.join(listed, "u").mapInArrow(_send_runs(unit, buckets, wide), CELLS_DDL)
    if wide > 1:
        sent = sent.repartition(MOST_CELLS, "b", F.when(F.col("b") < 0, F.xxhash64("blob"))).mapInArrow(_narrow_runs(buckets), CELLS_DDL)
    sent = staged(sent, "runs")
    # Buckets that hold too much, as a table: broadcast only where its measured size is under Spark's limit.
    full = staged(sent.where("b >= 0").groupBy("b").agg(F.sum("n").alias("n")).where(F.col("n") > BUCKET_BYTES).select("b"), "full-buckets")
    if not full.isEmpty():
        large = staged(sent.join(full, "b", "left_semi"), "full-cells")
        hot = _hot_anchors(large)
        if len(hot):
            sent = sent.join(full, "b", "left_anti").union(large.mapInArrow(_split_hot(unit, hot, buckets), CELLS_DDL))
    solved = sent.repartition(parts, "b", F.when(F.col("b") < 0, F.xxhash64("blob"))).mapInArrow(_solve_buckets(unit), "u long, blob binary")
    return solved.groupBy("u").agg(F.collect_list("blob").alias("blobs"))


def _hot_anchors(cells: DataFrame, most: int = 1_000_000) -> np.ndarray:
    """Anchors with over HOT_BYTES of run strings, or over a millionth of all of them if that is more (100 MB of 100 TB): never more than a million numbers, sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob, strings in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                anchor = unpack(blob, 4)[0]
                values, back = np.unique(anchor, return_inverse=True)
                sizes = np.bincount(back, np.fromiter(map(len, unpack_strings(strings)), np.float64, len(anchor))).astype(np.int64)
                yield pa.record_batch([pa.array(values), pa.array(sizes)], names=["a", "n"])

    total = cells.agg(F.sum("n")).first()[0]
    least = max(HOT_BYTES, total // most)
    sums = cells.mapInArrow(run, "a long, n long").groupBy("a").agg(F.sum("n").alias("n")).where(F.col("n") > least)
    return np.sort(np.array([r["a"] for r in sums.select("a").collect()], np.int64))


def merged(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of stretches (touching ones join)."""
    if not len(start):
        return start, stop
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(stop[order])
    new = np.concatenate([[True], start[1:] > reach[:-1]])
    first = np.flatnonzero(new)
    return start[first], reach[np.append(first[1:] - 1, len(start) - 1)]


def with_stretches(docs: DataFrame, unit: Unit) -> DataFrame:
    """k, t, blobs of every document."""
    keyed = keyed_documents(docs)
    return keyed.join(removed_stretches(keyed, unit), "u", "left").select("k", "t", "blobs")
