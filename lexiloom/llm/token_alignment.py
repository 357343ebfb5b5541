"""Alignment of two tokenizers' tokens over the bytes of each text.

Every text is encoded by a byte-level vocabulary (A, with a space before the text)
and by a piece vocabulary (B, which puts the space there itself).  The spans of B's
tokens are a static index (their starts and their ends, both sorted); two
bisections per A token find the first and the last span that it stabs, which are
its links.  A gap between two A tokens that no B token spans ends a group.  Both
are done for many texts at once, laid end to end, in numpy.

What an id pair counts for is known only after the last text, so there are two
passes.  The first writes, for chunks of some megabytes of text, the distinct
pairs with their counts and the links as places in that list.  Spark sums the
counts of pairs, finds each B id's highest, and sends the sums of a chunk's pairs
back to it; a frequent pair travels once a chunk, so no key is hot.

A null or empty text, and one whose A or B bytes differ from it with a space
before it (a text with U+2581, for one), has no tokens: zeros and ''.  A very long
text is a chunk of its own.  Repeated rows count each; rows without doc_id are
aligned like others; an empty table gives an empty result; other columns are not
read, and their names don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged, table
from .tokens import _SIGNS, CACHE_LENGTH, ChunkedTokenizer, text_groups, tokenizer_path

BYTE_VOCABULARY, PIECE_VOCABULARY = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of text that are tokenized and aligned at a time, and those that share one list of distinct pairs.
GROUP_BYTES, CHUNK_BYTES = 2_000_000, 8_000_000
#: Pairs in a row of the lists.
ROW_PAIRS = 65_536

_LOADED: dict[tuple[str, str], "Aligner"] = {}


class SpacedTokenizer(ChunkedTokenizer):
    """A: takes texts that begin with the added space, so that their first chunk is one after a space like others."""

    def _chunks(self, texts: pa.Array) -> pa.Array:
        return pc.split_pattern(pc.replace_substring(pc.utf8_slice_codeunits(texts, 1), "\n", " \n"), " ")


class PieceTokenizer(ChunkedTokenizer):
    """B: no piece goes on after a space (checked), so the ids of a text are those of its parts between single spaces; a text with other spaces is encoded whole."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model, self.mode = SentencePieceProcessor(model_file=path), "space"
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any("▁" in p.lstrip("▁") or (p.startswith("▁▁") and p.strip("▁")) for p in pieces):
            raise ValueError("a piece of this vocabulary goes on after a space")
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else b"" if self.model.is_control(i) or self.model.is_unknown(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]

    def _chunks(self, texts: pa.Array) -> pa.Array:
        return pc.split_pattern(texts, " ")

    def _raw(self, text: str) -> bytes:
        return np.array(self.model.encode(text, num_threads=1), "<u4").tobytes()

    def _find(self, keys: list[str]) -> list[bytes | None]:
        found = [self.young.get(k) or self.old.get(k) for k in keys]
        new = [i for i, f in enumerate(found) if f is None and keys[i]]
        for i, ids in zip(new, self.model.encode([keys[i] for i in new], num_threads=1) if new else [], strict=True):
            found[i] = np.array(ids, "<u4").tobytes()
        for k, ids in zip(keys, found, strict=True):
            if ids is not None and len(k) <= CACHE_LENGTH:
                self.young[k] = ids
        return found


class Aligner:
    """Both tokenizers with their tokens' bytes, one pair per worker process."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = SpacedTokenizer(a_path, "prefix"), PieceTokenizer(b_path)
        back = {sign: byte for byte, sign in enumerate(_SIGNS)}
        entries = self.a.tokenizer.get_vocab(with_added_tokens=True)
        a_bytes = [b""] * (max(entries.values()) + 1)
        for entry, i in entries.items():
            a_bytes[i] = bytes(back[c] for c in entry) if all(c in back for c in entry) else entry.encode()
        self.a_bytes, self.b_bytes = (pa.array(x, pa.large_binary()) for x in (a_bytes, self.b.bytes))
        self.a_size, self.b_size = (np.array([len(x) for x in xs]) for xs in (a_bytes, self.b.bytes))
        n_a, n_b = len(a_bytes), len(self.b.bytes)
        # How an id is written where the next is of the same side, of the other side, or of another group.
        self.written = pa.array([f"{i}," for i in range(n_a)] + [f"{i}|" for i in range(n_a)] + [f"{i}," for i in range(n_b)] + [f"{i};" for i in range(n_b)], pa.large_string())
        self.n_a, self.n_b = n_a, n_b

    def same(self, texts: list[bytes], ids: list[np.ndarray], spelt: pa.Array) -> list[bool]:
        """Whether the tokens' bytes are the text's."""
        joined = spelt.take(pa.array(np.concatenate(ids).astype(np.int64))) if ids else spelt[:0]
        edges = np.frombuffer(joined.buffers()[1], np.int64)[: len(joined) + 1] if len(joined) else np.zeros(1, np.int64)
        body = memoryview(joined.buffers()[2]).cast("B") if len(joined) else memoryview(b"")
        at = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
        return [body[edges[s] : edges[e]] == t for t, s, e in zip(texts, at[:-1].tolist(), at[1:].tolist(), strict=True)]

    def align(self, texts: list[str]) -> tuple[list[tuple[int, int, int, int, memoryview]], np.ndarray]:
        """Per text (n_a, n_b, n_groups, n_links, groups as written), and the pairs (a * n_b + b) of all links, text by text."""
        spaced = [" " + t for t in texts]
        a, b, raw = list(self.a.encode(spaced)), list(self.b.encode(texts)), [t.encode() for t in spaced]
        good = [bool(t) and x and y for t, x, y in zip(texts, self.same(raw, a, self.a_bytes), self.same(raw, b, self.b_bytes), strict=True)]
        none = np.zeros(0, np.uint32)
        a, b = ([x if g else none for x, g in zip(xs, good, strict=True)] for xs in (a, b))
        of_a, of_b = (np.concatenate([[0], np.cumsum([len(x) for x in xs])]) for xs in (a, b))
        a, b = np.concatenate(a).astype(np.int64), np.concatenate(b).astype(np.int64)
        a_end, b_end = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        # The index: B spans by start and by end. An A token stabs those that end after its start and start before its end.
        first = np.searchsorted(b_end, a_end - self.a_size[a], "right")
        last = np.searchsorted(b_end - self.b_size[b], a_end, "left")
        n = last - first
        before = np.concatenate([[0], np.cumsum(n)])
        stabbed = np.repeat(first - before[:-1], n) + np.arange(before[-1])
        pairs = np.repeat(a * self.n_b, n) + b[stabbed]
        # A gap behind an A token that the last B token stabbed doesn't reach over ends a group.
        open_gap = (b_end[last - 1] == a_end) if len(a) else np.zeros(0, bool)
        cuts = np.flatnonzero(open_gap)
        n_before = np.concatenate([[0], np.cumsum(open_gap)])
        of_group_a, of_group_b = n_before[:-1], np.searchsorted(a_end[cuts], b_end, "left")
        b_upto = last[cuts]  # B tokens up to the end of each group
        codes = np.empty(len(a) + len(b), np.int64)
        codes[np.arange(len(a)) + np.concatenate([[0], b_upto])[of_group_a]] = a + np.where(open_gap, self.n_a, 0)
        ends_group = np.zeros(len(b), bool)
        ends_group[b_upto - 1] = True
        codes[np.arange(len(b)) + (cuts + 1)[of_group_b]] = 2 * self.n_a + b + np.where(ends_group, self.n_b, 0)
        written = self.written.take(pa.array(codes))
        edges = np.frombuffer(written.buffers()[1], np.int64)[: len(codes) + 1] if len(codes) else np.zeros(1, np.int64)
        body = memoryview(written.buffers()[2]).cast("B") if len(codes) else memoryview(b"")
        out = []
        for i in range(len(texts)):
            s, e, p, q = int(of_a[i]), int(of_a[i + 1]), int(of_b[i]), int(of_b[i + 1])
            groups = body[edges[s + p] : edges[e + q] - 1] if e > s else body[:0]
            out.append((e - s, q - p, int(n_before[e] - n_before[s]), int(before[e] - before[s]), groups))
        return out, pairs


def load(a_path: str, b_path: str) -> Aligner:
    if (a_path, b_path) not in _LOADED:
        _LOADED[a_path, b_path] = Aligner(a_path, b_path)
    return _LOADED[a_path, b_path]


_ALIGNED = pa.schema(
    [("chunk", pa.string()), ("doc_id", pa.int64())]
    + [(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")]
    + [("groups", pa.string()), ("links", pa.binary()), ("base", pa.int64()), ("pairs", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))]
)
_ALIGNED_DDL = "chunk string, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, links binary, base long, pairs array<long>, counts array<long>"


def _chunk_batches(name: str, rows: list[tuple], pairs: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """A chunk's documents, and the list of its distinct pairs in rows of bounded length."""
    coded = pa.array(np.concatenate(pairs) if pairs else np.zeros(0, np.int64)).dictionary_encode()
    places, listed = coded.indices.to_numpy(), coded.dictionary.to_numpy()
    places = places.astype(np.uint16 if len(listed) <= 65_536 else np.uint32)
    edges = np.concatenate([[0], np.cumsum([r[4] for r in rows])])
    n = len(rows)
    columns = [pa.array([r[i] for r in rows], pa.int64()) for i in range(5)]
    links = pa.array([places[s:e].tobytes() for s, e in zip(edges[:-1], edges[1:], strict=True)], pa.binary())
    yield pa.record_batch([pa.array([name] * n, pa.string()), *columns, pa.array([r[5] for r in rows], pa.string()), links, *(pa.nulls(n, f.type) for f in list(_ALIGNED)[8:])], schema=_ALIGNED)
    counts = np.bincount(places, minlength=len(listed))
    for at in range(0, len(listed), ROW_PAIRS):
        part = slice(at, at + ROW_PAIRS)
        filled = [pa.array([at], pa.int64()), pa.array([listed[part]], pa.list_(pa.int64())), pa.array([counts[part]], pa.list_(pa.int64()))]
        yield pa.record_batch([pa.array([name]), *(pa.nulls(1, f.type) for f in list(_ALIGNED)[1:8]), *filled], schema=_ALIGNED)


def _aligned_chunks(docs: DataFrame, paths: tuple[str, str], digest: bool) -> DataFrame:
    """Rows of documents (without `pairs`) and of their chunks' lists of pairs (without `doc_id`)."""
    inner = docs.select(F.col("doc_id").cast("long").alias("k"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, task = load(*paths), TaskContext.get()
        rows, pairs, held, n = [], [], 0, 0
        for batch in batches:
            sizes = pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False)
            for part in text_groups(sizes, GROUP_BYTES):
                size = int(sizes[part].sum())
                if rows and held + size > CHUNK_BYTES:
                    yield from _chunk_batches(f"{task.partitionId()}-{n}", rows, pairs)
                    rows, pairs, held, n = [], [], 0, n + 1
                found, links = aligner.align(batch.column(1)[part].to_pylist())
                for key, (*numbers, groups) in zip(batch.column(0)[part].to_pylist(), found, strict=True):
                    text = ("" if not len(groups) else hashlib.sha256(groups).hexdigest()) if digest else str(groups, "ascii")
                    rows.append((key, *numbers, text))
                pairs.append(links)
                held += size
        if rows:
            yield from _chunk_batches(f"{task.partitionId()}-{n}", rows, pairs)

    return inner.mapInArrow(run, _ALIGNED_DDL)


def pair_totals(lists: DataFrame, n_b: int) -> DataFrame:
    """lists(pair, n) -> pair, total over the corpus, and whether it is the highest of its B id. There are at most as many B ids as the vocabulary has."""
    totals = staged(lists.groupBy("pair").agg(F.sum("n").alias("total")), "pair-totals")
    of_b = (F.col("pair") % n_b).alias("b")
    highest = totals.groupBy(of_b).agg(F.max("total").alias("highest"))
    return totals.select("pair", "total", of_b).join(F.broadcast(highest), "b").select("pair", "total", (F.col("total") == F.col("highest")).alias("best"))


_SCORED_DDL = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"


def _scored(left: pa.Table, right: pa.Table) -> pa.Table:
    """A chunk's documents with what its pairs count for."""
    right = right.sort_by("place")
    total, best = right.column("total").to_numpy(), right.column("best").to_numpy(zero_copy_only=False).astype(np.int64)
    n_best, count_sum = [], []
    for n, links in zip(left.column("n_links").to_pylist(), left.column("links").to_pylist(), strict=True):
        places = np.frombuffer(links, np.uint16 if len(links) == 2 * n else np.uint32)
        n_best.append(int(best[places].sum()))
        count_sum.append(int(total[places].sum()))
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
    return pa.table([*(left.column(c) for c in names), pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64()), left.column("groups")], names=[*names, "n_best", "count_sum", "groups"])


def aligned_tokens(docs: DataFrame, byte_path: str | None = None, piece_path: str | None = None, digest: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups (`a1,a2|b1;a3|b2,b3`, or with `digest` its SHA-256 in hexadecimal)."""
    paths = byte_path or tokenizer_path(BYTE_VOCABULARY), piece_path or tokenizer_path(PIECE_VOCABULARY)
    n_b = PieceTokenizer(paths[1]).model.get_piece_size()
    chunks = staged(_aligned_chunks(docs, paths, digest), "token-alignment")
    lists = chunks.where("pairs is not null").select("chunk", "base", F.posexplode(F.arrays_zip("pairs", "counts")).alias("at", "x"))
    lists = lists.select(F.col("chunk").alias("of_chunk"), (F.col("base") + F.col("at")).alias("place"), F.col("x.pairs").alias("pair"), F.col("x.counts").alias("n"))
    known = lists.select("of_chunk", "place", "pair").join(pair_totals(lists.select("pair", "n"), n_b).hint("merge"), "pair").select("of_chunk", "place", "total", "best")
    rows = chunks.where("pairs is null").select("chunk", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "links")
    return rows.groupBy("chunk").cogroup(known.groupBy("of_chunk")).applyInArrow(_scored, _SCORED_DDL)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned_tokens(table(spark, sf_dir, "documents"), digest=True).withColumnRenamed("groups", "groups_sha256")
