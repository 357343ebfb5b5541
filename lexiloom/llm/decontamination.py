"""Benchmark decontamination with suffix arrays of the training texts.

A shard is a run of documents that one task holds (at most SHARD_CHARS of text).
Its words become integers; words that no benchmark item has become 0, which
matches nothing, and runs too short for any window are left out before sorting,
which loses no match.  Prefix doubling sorts the suffixes that are left.  Every
suffix of every benchmark item is then binary-searched in the array, one word
after another and all suffixes at once: the interval after `window` words holds
all places of that window, and the last interval that isn't empty gives the
longest verbatim match.  Shards need nothing of each other, so no row is shuffled.

A benchmark up to BLOCK_BYTES is broadcast; a larger one is cut into blocks of
that size in the shared folder, and each shard is searched block after block.

Null texts have no words and are never hit; a null item_id is listed as the empty
string; equal item_ids count once; very long texts are searched whole, a few at a time; an
empty table on either side gives no hits; other columns are not read.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import doc_bytes, record_batch, scratch_path, table

WINDOW = 10
BLOCK_BYTES = 8_000_000
SHARD_BYTES = 6_000_000

#: A-Z to a-z; every other ASCII character that isn't a letter or digit to a blank; bytes of other characters stay.
_FOLD = bytes(i + 32 if 0x41 <= i <= 0x5A else i if 0x30 <= i <= 0x39 or 0x61 <= i <= 0x7A or i >= 0x80 else 0x20 for i in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


@dataclass
class Block:
    """Benchmark items as one integer sequence (0 between items) and their distinct windows."""

    vocabulary: dict[bytes, int]
    sequence: np.ndarray  # padded with zeros
    starts: np.ndarray  # every suffix of every item
    item_of: np.ndarray  # its item
    window_at: np.ndarray  # suffixes that begin a distinct window
    window_size: np.ndarray
    window_items: list[np.ndarray]  # items that have this window
    item_ids: list[str]
    shortest: int
    longest: int


def make_block(items: list[tuple[str, bytes]], window: int = WINDOW) -> Block:
    vocabulary: dict[bytes, int] = {}
    sequence, starts, item_of, ids, longest = [], [], [], [], 1
    windows: dict[tuple[int, ...], tuple[int, list[int]]] = {}
    for name, text in items:
        found = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words(text)]
        if not found:
            continue
        longest = max(longest, len(found))
        size = min(window, len(found))
        for i in range(len(found)):
            if i + size <= len(found):
                at, having = windows.setdefault(tuple(found[i : i + size]), (len(starts), []))
                if not having or having[-1] != len(ids):
                    having.append(len(ids))
            starts.append(len(sequence) + i)
            item_of.append(len(ids))
        sequence += [*found, 0]
        ids.append(name)
    flat = np.zeros(len(sequence) + longest + 1, np.int32)
    flat[: len(sequence)] = sequence
    at = np.array([w[0] for w in windows.values()], np.int64)
    size = np.array([len(w) for w in windows], np.int64)
    return Block(vocabulary, flat, np.array(starts, np.int64), np.array(item_of, np.int64), at, size, [np.array(w[1]) for w in windows.values()], ids, int(size.min()) if len(size) else 0, longest)


def suffix_array(b: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """starts in the order of the sequences that begin there (up to `depth` words, or to the next 0), by prefix doubling."""
    rank, n, k = b.astype(np.int64), len(b), 1
    while k < depth:
        later = np.zeros(n, np.int64)
        later[: n - k] = rank[k:]
        later[rank == 0] = 0
        values, rank_new = np.unique(rank * (rank.max() + 1) + later, return_inverse=True)
        rank_new = rank_new + (0 if values[0] == 0 else 1)
        if len(values) == n or np.array_equal(rank_new, rank):
            rank = rank_new
            break
        rank, k = rank_new, 2 * k
    return starts[np.argsort(rank[starts], kind="stable")]


def _narrow(b: np.ndarray, order: np.ndarray, low: np.ndarray, high: np.ndarray, depth: int, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Within [low, high), whose suffixes agree so far, the part whose word at `depth` is `want`, by two binary searches."""

    def bound(after: int) -> np.ndarray:
        lo, hi = low.copy(), high.copy()
        while True:
            busy = np.flatnonzero(lo < hi)
            if not len(busy):
                return lo
            mid = (lo[busy] + hi[busy]) // 2
            less = b[order[mid] + depth] < want[busy] + after
            lo[busy[less]] = mid[less] + 1
            hi[busy[~less]] = mid[~less]

    return bound(0), bound(1)


@dataclass
class Matches:
    """Of one shard and block; positions are word positions of the shard."""

    hit: np.ndarray  # per word
    documents: np.ndarray  # pairs: document of the shard ...
    items: np.ndarray  # ... and item of the block
    longest: np.ndarray  # per benchmark suffix: words of its longest match of at least a window, else 0
    location: np.ndarray  # and where one such match begins


def search(block: Block, text_words: list[list[bytes]]) -> Matches:
    n = sum(map(len, text_words)) + len(text_words)
    a, doc = np.zeros(n + 1, np.int32), np.zeros(n + 1, np.int64)
    at, get = 0, block.vocabulary.get
    for i, found in enumerate(text_words):
        a[at : at + len(found)] = np.fromiter(map(get, found, repeat(0)), np.int32, len(found))
        doc[at : at + len(found) + 1] = i
        at += len(found) + 1  # a zero parts the documents
    none = np.zeros(len(block.starts), np.int64)
    empty = Matches(np.zeros(n + 1, bool), none[:0], none[:0], none, none.copy())
    if not len(block.starts):
        return empty
    # Runs of benchmark words: only those as long as the shortest window can hold a match.
    edge = np.flatnonzero(np.diff(np.concatenate([[0], (a > 0).astype(np.int8), [0]])))
    first, last = edge[::2], edge[1::2]
    long = last - first >= block.shortest
    first, size = first[long], (last - first)[long]
    if not len(first):
        return empty
    inside = np.repeat(first - np.concatenate([[0], np.cumsum(size + 1)[:-1]]), size + 1) + np.arange((size + 1).sum())
    end = np.cumsum(size + 1) - 1
    b = np.concatenate([a[inside], np.zeros(block.longest + 1, np.int32)])
    b[end] = 0
    remaining = np.repeat(end, size + 1) - np.arange(len(inside))
    order = suffix_array(b, np.flatnonzero(remaining >= block.shortest), block.longest)
    q, low, high = np.arange(len(block.starts)), np.zeros(len(block.starts), np.int64), np.full(len(block.starts), len(order))
    longest, location = none.copy(), none.copy()
    window_of = np.full(len(block.starts), -1)
    window_of[block.window_at] = np.arange(len(block.window_at))
    change = np.zeros(len(b) + 1, np.int64)
    documents, items = [none[:0]], [none[:0]]
    for depth in range(block.longest):
        want = block.sequence[block.starts[q] + depth]
        q, low, high, want = (x[want > 0] for x in (q, low, high, want))
        if not len(q):
            break
        low, high = _narrow(b, order, low, high, depth, want)
        alive = low < high
        q, low, high = q[alive], low[alive], high[alive]
        if depth + 1 >= block.shortest:
            longest[q], location[q] = depth + 1, inside[order[low]]
        full = np.flatnonzero((window_of[q] >= 0) & (block.window_size[window_of[q]] == depth + 1))
        for i in full:  # one turn for each window that occurs in the shard
            places = order[low[i] : high[i]]
            np.add.at(change, places, 1)
            np.add.at(change, places + depth + 1, -1)
            having, where = block.window_items[window_of[q[i]]], np.unique(doc[inside[places]])
            documents.append(np.repeat(where, len(having)))
            items.append(np.tile(having, len(where)))
    hit = np.zeros(n + 1, bool)
    hit[inside[np.flatnonzero(np.cumsum(change[: len(inside)]) > 0)]] = True
    return Matches(hit, np.concatenate(documents), np.concatenate(items), longest, location)


class Benchmark:
    """The prepared items: broadcast as one block, or block files of the shared folder."""

    def __init__(self, benchmark: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES):
        spark = benchmark.sparkSession
        rows = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("i"), F.coalesce(F.col(text).cast("string").cast("binary"), F.lit(b"")).alias("t"))
        self.window, self.files, held, size = window, [], [], 0
        folder = None
        for r in rows.toLocalIterator():
            if held and size + len(r.t) > block_bytes:
                folder = folder or scratch_path(spark, "benchmark")
                self.files.append(self._put(folder, held))
                held, size = [], 0
            held.append((r.i, bytes(r.t)))
            size += len(r.t)
        if self.files and held:
            self.files.append(self._put(folder, held))
            held = []
        self.one = None if self.files else spark.sparkContext.broadcast(held)  # at most block_bytes of text

    def _put(self, folder: str, items: list[tuple[str, bytes]]) -> str:
        uri = f"{folder}/block-{len(self.files):06d}"
        fs, path = pafs.FileSystem.from_uri(uri)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        with fs.open_output_stream(path) as out:
            out.write(pickle.dumps(items))
        return uri

    def __getstate__(self) -> dict:
        return {"window": self.window, "files": self.files, "one": self.one}

    def blocks(self) -> Iterator[Block]:
        if self.one is not None:
            if not hasattr(self, "_made"):
                self._made = make_block(self.one.value, self.window)
            yield self._made
        for uri in self.files:
            fs, path = pafs.FileSystem.from_uri(uri)
            with fs.open_input_stream(path) as f:
                yield make_block(pickle.loads(f.read()), self.window)


def _shards(texts: list[bytes | None]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and size + len(t or b"") > SHARD_BYTES:
            yield start, i
            start, size = i, 0
        size += len(t or b"")
    if start < len(texts):
        yield start, len(texts)


def _scan(benchmark: Benchmark, texts: list[bytes | None]) -> Iterator[tuple[int, int, list[str]]]:
    """Per document: words, hit words, sorted item_ids."""
    for start, stop in _shards(texts):
        split = [words(t or b"") for t in texts[start:stop]]
        found: list[set[str]] = [set() for _ in split]
        hit = None
        for block in benchmark.blocks():
            got = search(block, split)
            hit = got.hit if hit is None else hit | got.hit
            for d, i in zip(got.documents.tolist(), got.items.tolist(), strict=True):
                found[d].add(block.item_ids[i])
        at = 0
        for w, items in zip(split, found, strict=True):
            yield len(w), int(hit[at : at + len(w)].sum()) if hit is not None else 0, sorted(items)
            at += len(w) + 1


HITS = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("item_ids", pa.list_(pa.string()))])


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit (words inside any benchmark window), item_ids (of the items with such windows)."""
    prepared = Benchmark(benchmark, window=window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column(0).to_pylist(), _scan(prepared, batch.column(1).to_pylist()), strict=True)
            yield record_batch(HITS, [(k, *r) for k, r in rows])

    return doc_bytes(docs).mapInArrow(run, "doc_id long, n_words long, n_hit long, item_ids array<string>")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text") -> DataFrame:
    """docs without the documents that hold any benchmark window; all columns stay."""
    prepared = Benchmark(benchmark, window=window)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if t is None else t.encode() for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array([n_hit == 0 for _, n_hit, _ in _scan(prepared, texts)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


LONGEST = pa.schema([("item_id", pa.string()), ("item_start", pa.int64()), ("doc_id", pa.int64()), ("doc_start", pa.int64()), ("length", pa.int64())])


def longest_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per benchmark suffix that occurs: item_id, item_start, and the longest verbatim match over all shards as doc_id, doc_start (words), length."""
    prepared = Benchmark(benchmark, window=window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for start, stop in _shards(texts):
                split = [words(t or b"") for t in texts[start:stop]]
                begin = np.cumsum([0, *(len(w) + 1 for w in split)])
                for block in prepared.blocks():
                    got = search(block, split)
                    item_first = np.searchsorted(block.item_of, np.arange(len(block.item_ids)))
                    rows = []
                    for s in np.flatnonzero(got.longest):
                        d = int(np.searchsorted(begin, got.location[s], side="right")) - 1
                        item = block.item_of[s]
                        rows.append((block.item_ids[item], int(s - item_first[item]), keys[start + d], int(got.location[s] - begin[d]), int(got.longest[s])))
                    yield record_batch(LONGEST, rows)

    per_shard = doc_bytes(docs).mapInArrow(run, "item_id string, item_start long, doc_id long, doc_start long, length long")
    best = F.max(F.struct("length", (-F.col("doc_id")).alias("d"), (-F.col("doc_start")).alias("s"))).alias("m")
    return per_shard.groupBy("item_id", "item_start").agg(best).select("item_id", "item_start", (-F.col("m.d")).alias("doc_id"), (-F.col("m.s")).alias("doc_start"), "m.length")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
