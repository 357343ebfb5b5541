"""Best-fit packing by a configuration linear program.

Documents become token pieces of at most `capacity` ids.  Only the histogram of
piece lengths (one number per length, whatever the corpus) reaches the driver.
There a fractional covering program over configurations (ways to fill one
sequence) is solved by multiplicative weights: the pricing problem, the most
valuable configuration under the current weights, is an integer knapsack solved
by dynamic programming.  The solution is rounded down so that nothing is packed
twice, pricing goes on over what is left as long as it fills whole sequences, and
the last pieces go by best fit, longest first, on counts.
The plan is a bounded table (ranks of each length -> sequence and offset) that
tasks apply to pieces ranked by a window over (length, bucket).

Null texts count as empty (a single end id); very long texts become many pieces,
the first the shorter one; ties of length go by bucket and key; repeated rows are
separate pieces; an empty table packs to no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import doc_bytes, record_batch, shuffle_partitions, staged, table
from .tokens import load, tokenizer_path

CAPACITY = 1024
#: Step of the weights, configurations taken from one pricing, and the power of its length that a piece weighs to begin with
#: (over 1: a few long pieces are worth more than many short ones, which fill the last gaps).
STEP, COLUMNS, POWER = 1.0, 4, 1.2
PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
PIECES_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long"


# --- the plan, on the histogram ------------------------------------------------------------------
def price(value: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Knapsack by dynamic programming over capacity: the greatest value that fits each room, and the last length put in (0: none)."""
    lengths = np.flatnonzero(value > 0)
    best, last = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    if not len(lengths):
        return best, last
    worth = value[lengths]
    for room in range(int(lengths[0]), capacity + 1):
        n = np.searchsorted(lengths, room, side="right")
        got = worth[:n] + best[room - lengths[:n]]
        i = int(np.argmax(got))
        if got[i] > best[room - 1]:
            best[room], last[room] = got[i], lengths[i]
        else:
            best[room] = best[room - 1]
    return best, last


def configuration(first: int, last: np.ndarray, limit: np.ndarray, capacity: int) -> dict[int, int]:
    """{length: copies}: the most valuable filling of a sequence that holds `first`, as far as `limit` allows."""
    out, room = {first: 1}, capacity - first
    while room > 0 and last[room]:
        size = int(last[room])
        if out.get(size, 0) < limit[size]:
            out[size] = out.get(size, 0) + 1
            room -= size
        else:  # no copy is left: fill the room without this one more
            room -= 1
    return out


def price_out(need: np.ndarray, capacity: int, whole: bool, step: float = STEP, columns: int = COLUMNS) -> tuple[list[tuple[dict[int, int], float]], np.ndarray, float]:
    """Configurations with their amounts, what they leave uncovered, and a lower bound on all sequences, by multiplicative weights.

    A length weighs a power of itself, times a factor that falls with its covered
    share.  One pricing table gives a most valuable configuration for each
    length that it must hold; a round takes those of the `columns` longest lengths
    that are open and covers what is left of a length of theirs, then weighs
    again.  It ends when pricing finds no configuration that fills a sequence.
    Weights over the best configuration's worth are a dual solution: the
    bound, as are the lengths themselves.
    """
    left, used, bound = need.astype(np.int64 if whole else np.float64), [], float(need @ np.arange(len(need))) / capacity
    sizes = np.flatnonzero(need)
    weight = np.zeros(len(need))
    while len(sizes):
        share = 1 - left[sizes] / need[sizes]
        weight[sizes] = sizes**POWER * np.exp(-step * (share - share.mean()))
        bound = max(bound, float(weight @ need) / price(weight, capacity)[0][capacity]) if not used else bound
        open_weight = np.where(left > 0, weight, 0.0)
        _, last = price(open_weight, capacity)
        taken = 0
        for size in np.flatnonzero(left > 0)[::-1].tolist():
            if left[size] <= 0:
                continue
            config = configuration(size, last, np.ceil(left), capacity)
            if sum(s * k for s, k in config.items()) < capacity:
                continue
            amount = min(left[s] // k if whole else left[s] / k for s, k in config.items())
            used.append((config, amount))
            for s, k in config.items():
                left[s] = max(left[s] - amount * k, 0)
            taken += 1
            if taken == columns:
                break
        if not taken:
            break
    return used, left, bound


def round_down(used: list[tuple[dict[int, int], float]], need: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Whole multiplicities within the demand: the whole part of every amount, then pricing over what that leaves."""
    left, out = need.copy(), []
    for config, amount in used:
        times = int(amount + 1e-9)
        if times:
            out.append((config, times))
            for size, k in config.items():
                left[size] -= times * k
    return out + [(config, int(times)) for config, times in price_out(left, capacity, whole=True)[0]]


def best_fit_counts(left: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best fit, longest first, on counts: groups of equal bins are handled together, so the work follows the number of lengths, not of pieces."""
    by_room: list[list[tuple[dict[int, int], int]]] = [[] for _ in range(capacity + 1)]
    for size in range(capacity, 0, -1):
        n = int(left[size])
        while n:
            room = next((r for r in range(size, capacity) if by_room[r]), None)
            if room is None:
                each = capacity // size
                full, rest = divmod(n, each)
                for k, times in ((each, full), (rest, 1 if rest else 0)):
                    if times:
                        by_room[capacity - size * k].append(({size: k}, times))
                n = 0
                continue
            config, times = by_room[room].pop()
            each = min(room // size, n)  # as many copies as fit
            use = min(times, n // each)
            if use < times:
                by_room[room].append((config, times - use))
            filled = dict(config)
            filled[size] = filled.get(size, 0) + each
            by_room[room - size * each].append((filled, use))
            n -= use * each
    return [group for groups in by_room for group in groups]


@dataclass
class Plan:
    """For each length: ascending first ranks, and for each of these the first sequence, copies in a sequence and offset of the first copy."""

    n_sequences: int
    n_priced: int  # sequences that are configurations of the program
    bound: float  # no packing needs fewer sequences
    by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    def place(self, length: int, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first, sequence, copies, offset = self.by_length[length]
        i = np.searchsorted(first, rank, side="right") - 1
        within = rank - first[i]
        return sequence[i] + within // copies[i], offset[i] + within % copies[i] * length


def make_plan(need: np.ndarray, capacity: int = CAPACITY) -> Plan:
    """need[length]: number of pieces."""
    need = need.astype(np.int64)
    groups: list[tuple[dict[int, int], int]] = [({capacity: 1}, int(need[capacity]))] if need[capacity] else []
    open_need = need.copy()
    open_need[capacity] = 0
    used, _, bound = price_out(open_need, capacity, whole=False)
    whole, left = round_down(used, open_need, capacity), open_need.copy()
    for config, times in whole:
        for size, k in config.items():
            left[size] -= times * k
    groups += whole + best_fit_counts(left, capacity)
    spans, taken, sequence = defaultdict(list), defaultdict(int), 0
    for config, times in groups:
        offset = 0
        for size, k in sorted(config.items(), reverse=True):
            spans[size].append((taken[size], sequence, k, offset))
            taken[size] += times * k
            offset += size * k
        sequence += times
    return Plan(sequence, sum(times for _, times in whole), int(need[capacity]) + bound, {size: tuple(np.array(c, np.int64) for c in zip(*rows, strict=True)) for size, rows in spans.items()})


# --- pieces ---------------------------------------------------------------------------------------
def token_pieces(docs: DataFrame, vocabulary: str, mode: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32. A document longer than capacity is cut into full pieces; its first one takes the remainder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, end = load(vocabulary, mode), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows = []
            for k, ids in zip(batch.column(0).to_pylist(), tokenizer.encode(batch.column(1).cast(pa.string())), strict=True):
                ids = ids.tobytes() + end
                n = len(ids) // 4
                at, piece = 0, 0
                while at < n:
                    size = (n % capacity or capacity) if at == 0 else capacity
                    rows.append((k, piece, at, size, zlib.crc32(ids[4 * at : 4 * (at + size)])))
                    at, piece = at + size, piece + 1
                if len(rows) >= 4096:
                    yield record_batch(PIECES, rows)
                    rows = []
            if rows:
                yield record_batch(PIECES, rows)

    return doc_bytes(docs).mapInArrow(run, PIECES_DDL)


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset. pieces: a stable table (it is read three times)."""
    counts = pieces.groupBy("length").count().collect()  # at most `capacity` rows
    need = np.zeros(capacity + 1, np.int64)
    for r in counts:
        need[r["length"]] = r["count"]
    plan = make_plan(need, capacity)
    parts = max(shuffle_partitions(pieces.sparkSession), int(need.sum() // 100_000) + 1)
    # A length that most pieces have is ranked in as many buckets as there are partitions.
    marked = pieces.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts)))
    bases = marked.groupBy("length", "_bucket").count()
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = bases.select("length", "_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = marked.withColumn("_in", F.row_number().over(inside) - 1).join(bases, ["length", "_bucket"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_base") + F.col("_in")).cast("long").alias("_rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for size in np.unique(length):
                at = np.flatnonzero(length == size)
                sequence[at], offset[at] = plan.place(int(size), rank[at])
            yield pa.record_batch([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=[*PIECES.names, "sequence_id", "offset"])

    return ranked.mapInArrow(run, f"{PIECES_DDL}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    pieces = token_pieces(docs, tokenizer_path("byte_bpe_50k.json"), "prefix", 2, capacity)
    return pack_pieces(staged(pieces, "pieces"), capacity)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
