"""SimHash near-duplicates, compared bit plane by bit plane.

Fingerprints (64 bits, majority of the XXH64 of the 4-word shingles) are made
distinct, then dealt to buckets: the 64 bits are cut into `blocks` pieces and two
fingerprints that differ in at most `radius` bits agree in `blocks - radius` of
them, so every choice of that many pieces is a bucket key and no link is lost.
In a bucket the bits stand vertically: plane p is a bit vector over the rows.
The distances of all rows to the row d places further on are had by XOR of each
plane with itself shifted by d, summed in carry-save bit counters; 64 row pairs
move in one word, and words whose 64 distances all exceed the radius are dropped
before the remaining planes are touched.  A bucket gives a spanning forest, not
its pairs.  Buckets over BUCKET_ROWS are cut into chunks, and each pair of chunks
is a task's bucket of its own, so that no task holds a hot key.

Null texts count as empty (fingerprint zero, linked like any other); null doc_ids
never name a component unless it has no other id; repeated rows share a component;
very long texts are hashed whole; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import doc_bytes, shuffle_partitions, staged, table, unused
from .graph import components

SHINGLE, SEED, RADIUS = 4, 42, 4
BUCKET_ROWS = 4096
#: Parts of a large component; documents of a fingerprint beyond which it is spread, and how many such fingerprints there can be.
SALTS, HOT_ROWS, MOST_HOT = 16, 10_000, 1_000
PRINTS = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64()), ("text_hash", pa.int64())])
LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


# --- fingerprints -----------------------------------------------------------------------------------
def fingerprint(text: bytes, size: int = SHINGLE, seed: int = SEED) -> int:
    """Signed 64 bits. bytes.lower folds A-Z alone and bytes.split cuts at the six ASCII blanks alone."""
    found = text.lower().split()
    if not found:
        return 0
    if len(found) <= size:
        value = xxhash.xxh64_intdigest(b" ".join(found), seed)
        return value - (1 << 64) if value >> 63 else value
    joined, digest = b" ".join(found), xxhash.xxh64_digest
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1).tolist()
    starts = [0, *ends]
    counts, n = np.zeros(64, np.int64), len(found) - size + 1
    for at in range(0, n, 65536):
        hashes = b"".join([digest(joined[s : e - 1], seed) for s, e in zip(starts[at : min(n, at + 65536)], ends[at + size - 1 :])])
        counts += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n).view(">i8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (signed 64 bits), text_hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.fromiter((fingerprint(t.as_py()) for t in batch.column(1)), np.int64, batch.num_rows)
            yield pa.record_batch([batch.column(0), pa.array(prints), batch.column(2)], schema=PRINTS)

    hashed = doc_bytes(docs).withColumn("h", F.xxhash64("t"))
    return hashed.mapInArrow(run, "doc_id long, fp long, text_hash long")


# --- buckets ------------------------------------------------------------------------------------------
def layout(n: int, radius: int = RADIUS) -> list[tuple[int, ...]]:
    """Bit masks of the bucket keys. The more fingerprints, the more pieces (and keys), so that buckets stay small; any layout finds all links."""
    extra = 2 if n < 1 << 27 else 3 if n < 1 << 33 else 4
    blocks = radius + extra
    edges = [64 * i // blocks for i in range(blocks + 1)]
    pieces = [(edges[i], edges[i + 1] - edges[i]) for i in range(blocks)]
    return [tuple(p) for p in combinations(pieces, extra)]


def bucket_key(fp: Column, number: int, pieces: tuple[tuple[int, int], ...]) -> Column:
    key = F.lit(number).cast("long")
    for at, width in pieces:
        key = F.shiftleft(key, width).bitwiseOR(F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << width) - 1).cast("long")))
    return key


# --- bit-sliced comparison ------------------------------------------------------------------------------
def bit_planes(fp: np.ndarray) -> np.ndarray:
    """planes[p]: bit p of every row, 64 rows in a word (row 0 lowest)."""
    n = -(-len(fp) // 64) * 64
    rows = np.zeros((n, 8), np.uint8)
    rows[: len(fp)] = fp.astype("<u8").view(np.uint8).reshape(-1, 8)
    bits = np.unpackbits(rows, axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")


def within(planes: np.ndarray, d: int, wanted: np.ndarray, radius: int = RADIUS, step: int = 8) -> np.ndarray:
    """Rows i with `wanted` bit i whose distance to row i + d is at most radius.

    wanted: bit vector. Counters are bit-sliced: `digits` holds bit j of the 64
    distances of a word, and a carry out of the top digit sets `over` for good.
    """
    digits_n = max(1, int(radius).bit_length())
    live = np.flatnonzero(wanted)
    skip, s = divmod(d, 64)
    n_words = planes.shape[1]
    alive = wanted[live]
    digits = [np.zeros(len(live), np.uint64) for _ in range(digits_n)]
    over = np.zeros(len(live), np.uint64)
    for at in range(0, 64, step):
        for p in range(at, at + step):
            plane = planes[p]
            near = live + skip
            other = np.where(near < n_words, plane[np.minimum(near, n_words - 1)], np.uint64(0)) >> np.uint64(s)
            if s:
                other = other | (np.where(near + 1 < n_words, plane[np.minimum(near + 1, n_words - 1)], np.uint64(0)) << np.uint64(64 - s))
            carry = plane[live] ^ other
            for j in range(digits_n):
                digits[j], carry = digits[j] ^ carry, digits[j] & carry
            over |= carry
        alive = wanted[live] & ~(over | _exceeds(digits, radius))
        keep = alive != 0  # a word whose pairs are all beyond the radius is abandoned here
        if not keep.all():
            live, over = live[keep], over[keep]
            digits = [x[keep] for x in digits]
            if not len(live):
                return np.zeros(0, np.int64)
    alive = wanted[live] & ~(over | _exceeds(digits, radius))
    bits = np.unpackbits(alive.astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64)
    word, bit = np.nonzero(bits)
    return live[word] * 64 + bit


def _exceeds(digits: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose counter is greater than radius, digit by digit from the top."""
    more = np.zeros_like(digits[0])
    equal = ~more
    for j in reversed(range(len(digits))):
        if radius >> j & 1:
            equal &= digits[j]
        else:
            more |= equal & digits[j]
            equal &= ~digits[j]
    return more


def forest(bucket: np.ndarray, fp: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Rows sorted by bucket. Links (a, b) that join all rows of a bucket that reach each other within the radius."""
    n = len(fp)
    change = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    size = np.diff(np.append(change, n))
    rows = np.flatnonzero(np.repeat(size > 1, size))
    left = np.repeat(change + size, size) - np.arange(n) - 1  # rows of the bucket after this one
    left, values = left[rows], fp[rows]
    root = np.arange(len(rows))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return int(x)

    a, b, d = [], [], 1
    planes = bit_planes(values.view(np.uint64)) if len(rows) else None
    where = np.arange(len(rows))  # rows of buckets that still have pairs at distance d in the order
    while len(where) and (left >= d).any():
        mask = np.zeros(planes.shape[1] * 64, np.uint8)
        mask[: len(left)] = left >= d
        hits = within(planes, d, np.packbits(mask, bitorder="little").view("<u8"), radius)
        for i, j in zip(where[hits].tolist(), where[hits + d].tolist(), strict=True):
            x, y = find(i), find(j)
            if x != y:
                root[max(x, y)] = min(x, y)
                a.append(i)
                b.append(j)
        d += 1
        if d & (d - 1) == 0:  # from time to time only large buckets are carried on
            begin = np.flatnonzero(np.concatenate([[True], left[1:] != left[:-1] - 1]))  # a bucket's first row has the most rows after it
            span = np.diff(np.append(begin, len(left)))
            keep = np.repeat(left[begin] >= d, span)
            if not keep.all():
                where, left, values = where[keep], left[keep], values[keep]
                planes = bit_planes(values.view(np.uint64)) if len(where) else None
    at = rows[np.array(a, np.int64)], rows[np.array(b, np.int64)]
    return fp[at[0]], fp[at[1]]


def _bucket_links(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by bucket; a bucket is never cut, and some ten thousand rows are compared together."""
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, n
            bucket, fp = (np.concatenate(x) for x in zip(*held, strict=True))
            cut = len(bucket) if last else int(np.searchsorted(bucket == bucket[-1], True))
            if cut:
                yield pa.record_batch([pa.array(x) for x in forest(bucket[:cut], fp[:cut], radius)], schema=LINKS)
            held, n = [(bucket[cut:], fp[cut:])], len(bucket) - cut

        for batch in batches:
            held.append(tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)))
            n += batch.num_rows
            if n >= 60_000:
                yield from flush(last=False)
        if n:
            yield from flush(last=True)

    return run


def fingerprint_links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """prints(fp): distinct fingerprints, a stable table. Links (a, b) whose components are those of all pairs within the radius."""
    tables = layout(prints.count(), radius)
    keys = F.explode(F.array(*[bucket_key(F.col("fp"), i, p) for i, p in enumerate(tables)])).alias("bucket")
    dealt = prints.select(keys, "fp")
    hot = dealt.groupBy("bucket").count().where(F.col("count") > BUCKET_ROWS).select("bucket", F.ceil(F.col("count") / BUCKET_ROWS).cast("int").alias("chunks"))
    hot = staged(hot, "hot-buckets")
    parts = shuffle_partitions(prints.sparkSession)
    if not hot.isEmpty():
        # Chunk pairs (i, j) of a hot bucket; a row goes to the pairs that hold its own chunk.
        marked = dealt.join(hot, "bucket", "left")
        own = F.pmod(F.xxhash64("fp"), F.col("chunks"))
        pairs = F.when(F.col("chunks").isNull(), F.array(F.col("bucket"))).otherwise(
            F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda j: F.xxhash64(F.col("bucket"), F.least(own, j.cast("long")), F.greatest(own, j.cast("long"))))
        )
        dealt = marked.select(F.explode(pairs).alias("bucket"), "fp")
    return dealt.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_bucket_links(radius), "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp, text_hash, component_id (the smallest doc_id that links reach)."""
    prints = staged(fingerprints(docs), "fingerprints")
    distinct = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "distinct-fingerprints")
    linked = components(fingerprint_links(distinct.select("fp"), radius), "simhash")
    tied = distinct.join(linked.withColumnRenamed("node", "fp"), "fp", "left").withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)))
    # Of components of several fingerprints only; a large one is spread over salts.
    several = tied.where("root is not null")
    named = several.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<long>")))
    classes = several.join(named.hint("merge"), ["root", "salt"]).select("fp", "n", "component_id").union(tied.where("root is null").select("fp", "n", F.col("least").alias("component_id")))
    # A fingerprint of very many documents is spread as well; there are never more than MOST_HOT of them.
    least = max(HOT_ROWS, (prints.count() or 0) // MOST_HOT)
    copies = F.when(F.col("n") > least, F.ceil(F.col("n") / least)).otherwise(1).cast("long")
    hot = distinct.where(F.col("n") > least).select("fp", copies.alias("copies"))
    dealt = classes.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), copies - 1))).drop("n")
    rows = prints.join(F.broadcast(hot), "fp", "left").withColumn("salt", F.pmod(F.xxhash64("doc_id", "text_hash"), F.coalesce("copies", F.lit(1))))
    return rows.join(dealt, ["fp", "salt"]).select("doc_id", "fp", "text_hash", "component_id")


def keep_one_of_each(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """docs with one document of each group: the one with the smallest doc_id. Rows that repeat a doc_id count as one; rows without doc_id count by their text."""
    id_name, hash_name, same_name = unused(docs.columns, "_kept", "_hash", "_same")
    found = staged(near_duplicates(docs, radius), "near-duplicates")
    kept = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("doc_id", "text_hash").agg(F.count("*").alias("n"))
    kept = staged(kept.withColumnsRenamed({"doc_id": id_name, "text_hash": hash_name}).withColumnRenamed("n", "rows"), "kept")
    mine = F.xxhash64(F.coalesce(F.col("text").cast("string").cast("binary"), F.lit(b"")))
    # Sort-merge at every size: a broadcast of the small inputs' ids would be another plan than that of large ones.
    whole = docs.join(kept.select(id_name, hash_name).hint("merge"), F.col("doc_id").eqNullSafe(F.col(id_name)) & (mine == F.col(hash_name)), "left_semi")
    if kept.agg(F.sum("rows") == F.countDistinct(id_name)).first()[0]:  # no doc_id comes twice, none is null
        return whole
    same = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.sha2(F.coalesce("text", F.lit("")), 256)))
    return whole.withColumn(same_name, same).dropDuplicates([same_name]).select(*docs.columns)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
