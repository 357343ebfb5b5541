"""Conversations put together again from turns that arrive late, twice and out of order.

A stateful stream (`applyInPandasWithState`) has one group per *bucket*, a hash of
the conversation's id, and each bucket's state is one value: the zstd-compressed
columns of its many conversations.  Every batch brings each bucket one tick row, so
that a bucket without arrivals notices that time has passed.  A batch is merged in
numpy, all conversations of a bucket at once: arrivals are sorted behind what is
kept and the first of each turn stays, the run of kept turns without a gap is
released, conversations that were silent for IDLE batches are closed.  What is
released leaves the state but for its number and last role; a closed conversation
leaves its id, by which later arrivals are rejected.

Texts don't travel: an arrival is its turn, its role and its payload's SHA-256.
The number of buckets follows the number of rows, so a bucket's state and its
arrivals stay at about ROWS_PER_BUCKET turns however large the input is.  A
conversation is released in order and closed with one hash over its turns, so it
lies in one bucket: some 50 bytes for each turn that waits, none for released ones.

Null turns are dropped, null roles and texts count as empty, rows without conv_id
are a conversation of their own (in a bucket of its own), repeated rows arrive
once; very long texts are only hashed; an empty table gives an empty result; other
columns are not read, and their names don't matter.
"""

from __future__ import annotations

import hashlib
import json
import struct
import warnings
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .common import scratch_path, staged, table

#: Batches of the given arrival order, silent batches that close a conversation, and turns that a bucket is meant to hold.
BATCHES, IDLE, ROWS_PER_BUCKET = 12, 2, 20_000
#: Fewest buckets, so that small inputs are spread too.
LEAST_BUCKETS = 24

#: Rows of the stream: arrivals, and one tick (with `last` in the last batch) per bucket. No column has nulls, so that long numbers stay whole in pandas.
ARRIVAL_DDL = "bucket int, conv_id long, turn long, first long, role string, digest string, batch long, tick boolean, last boolean"
EVENT_DDL = "event string, conv_id long, turn long, batch long, sha256 string, n_missing long, n_breaks long"
_EVENT_COLUMNS = [c.split(" ")[0] for c in EVENT_DDL.split(", ")]

#: Columns of a bucket's open conversations (sorted by id) and of the turns that they keep (by conversation, then turn).
_OPEN = np.dtype([("id", "<i8"), ("first", "<i8"), ("next", "<i8"), ("breaks", "<i8"), ("role", "<i4"), ("seen", "<i8")])
_KEPT = np.dtype([("conv", "<i4"), ("turn", "<i8"), ("role", "<i4"), ("digest", "V32")])


def _packed(closed: np.ndarray, opened: dict[str, np.ndarray], kept: dict[str, np.ndarray], roles: list[str]) -> bytes:
    """One column after another, compressed."""
    names = json.dumps(roles).encode()
    head = struct.pack("<4q", len(closed), len(opened["id"]), len(kept["turn"]), len(names))
    parts = [np.diff(closed, prepend=0).astype("<i8"), *(opened[c].astype(_OPEN[c]) for c in _OPEN.names), *(kept[c].astype(_KEPT[c]) for c in _KEPT.names)]
    return zstandard.ZstdCompressor(level=3).compress(head + names + b"".join(p.tobytes() for p in parts))


def _unpacked(blob: bytes | None) -> tuple[np.ndarray, dict[str, np.ndarray], dict[str, np.ndarray], list[str]]:
    if not blob:
        return np.zeros(0, np.int64), {c: np.zeros(0, _OPEN[c]) for c in _OPEN.names}, {c: np.zeros(0, _KEPT[c]) for c in _KEPT.names}, []
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n_closed, n_open, n_kept, n_names = struct.unpack_from("<4q", raw)
    at = 32 + n_names
    roles = json.loads(raw[32:at])

    def column(kind: np.dtype, n: int) -> np.ndarray:
        nonlocal at
        found = np.frombuffer(raw, kind, n, at)
        at += kind.itemsize * n
        return found

    closed = np.cumsum(column(np.dtype("<i8"), n_closed))
    return closed, {c: column(_OPEN[c], n_open) for c in _OPEN.names}, {c: column(_KEPT[c], n_kept) for c in _KEPT.names}, roles


def _places(ids: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where sorted ids hold each wanted one, and whether they do."""
    at = np.searchsorted(ids, wanted)
    inside = np.minimum(at, max(len(ids) - 1, 0))
    return at, (ids[inside] == wanted) if len(ids) else np.zeros(len(wanted), bool)


def merged(blob: bytes | None, arrivals: dict[str, np.ndarray], batch: int, last: bool, idle: int = IDLE) -> tuple[bytes, list[tuple[str, np.ndarray, np.ndarray, list[str], np.ndarray | None, np.ndarray | None]]]:
    """A bucket's state after one batch, and its events: (event, conversations, turns, hashes, missing, breaks).

    arrivals: conv_id, turn, first, role (strings), digest (32 bytes each), at most one row per turn of a conversation.
    """
    closed, opened, kept, roles = _unpacked(blob)
    events = []
    # Arrivals of closed conversations.
    late = _places(closed, arrivals["conv_id"])[1]
    if late.any():
        order = np.flatnonzero(late)
        events.append(("reject", arrivals["conv_id"][order], arrivals["turn"][order], [d.hex() for d in arrivals["digest"][order].tolist()], None, None))
        arrivals = {c: v[~late] for c, v in arrivals.items()}
    # Conversations that arrivals open.
    ids, at = np.unique(arrivals["conv_id"], return_index=True)
    new = ~_places(opened["id"], ids)[1]
    n_new = int(new.sum())
    firsts = arrivals["first"][at][new]
    fresh = {"id": ids[new], "first": firsts, "next": firsts, "breaks": np.zeros(n_new, np.int64), "role": np.full(n_new, -1, np.int32), "seen": np.full(n_new, batch)}
    every = {c: np.concatenate([opened[c], fresh[c]]) for c in _OPEN.names}
    order = np.argsort(every["id"], kind="stable")
    moved = np.empty(len(order), np.int64)
    moved[order] = np.arange(len(order))
    convs = {c: v[order] for c, v in every.items()}
    convs["seen"][_places(convs["id"], ids)[0]] = batch
    # Roles by number.
    number = {r: i for i, r in enumerate(roles)}
    codes = np.array([number.setdefault(r, len(number)) for r in arrivals["role"]], np.int32)
    roles = list(number)
    # First wins: what is kept stands before what arrives; turns before `next` have been released.
    conv = np.concatenate([moved[kept["conv"]], _places(convs["id"], arrivals["conv_id"])[0]])
    turn = np.concatenate([kept["turn"], arrivals["turn"]])
    role = np.concatenate([kept["role"], codes])
    digest = np.concatenate([kept["digest"], arrivals["digest"]])
    order = np.lexsort((np.arange(len(turn)), turn, conv))
    conv, turn, role, digest = conv[order], turn[order], role[order], digest[order]
    stays = turn >= convs["next"][conv]
    if len(turn):
        stays[1:] &= (conv[1:] != conv[:-1]) | (turn[1:] != turn[:-1])
    conv, turn, role, digest = conv[stays], turn[stays], role[stays], digest[stays]
    # The run from `next` on: turns are distinct and sorted, so those in it stand as far behind `next` as they do in their conversation.
    starts = np.searchsorted(conv, np.arange(len(convs["id"])))
    rank = np.arange(len(conv)) - starts[conv]
    free = turn - convs["next"][conv] == rank
    n_free = np.bincount(conv[free], minlength=len(starts))
    if free.any():
        events.append(("release", convs["id"][conv[free]], turn[free], [d.hex() for d in digest[free].tolist()], None, None))
    # Breaks: a kept turn with the role of the kept turn before it; the one before a run's first turn is the last released.
    same = np.zeros(len(conv), bool)
    if len(conv):
        same[1:] = (conv[1:] == conv[:-1]) & (turn[1:] == turn[:-1] + 1) & (role[1:] == role[:-1])
        lead = free & (rank == 0)
        same[lead] = role[lead] == convs["role"][conv[lead]]
    convs["breaks"] = convs["breaks"] + np.bincount(conv[free & same], minlength=len(starts))
    moves = n_free > 0
    if moves.any():
        convs["role"] = convs["role"].copy()
        convs["role"][moves] = role[(starts + n_free - 1)[moves]]
    convs["next"] = convs["next"] + n_free
    same &= ~free
    inner_breaks = np.bincount(conv[same], minlength=len(starts))
    conv, turn, role, digest = conv[~free], turn[~free], role[~free], digest[~free]
    # Silent conversations close.
    ends = (batch - convs["seen"] >= idle) | last
    if ends.any():
        from_, to = np.searchsorted(conv, np.arange(len(starts))), np.searchsorted(conv, np.arange(len(starts)), "right")
        n_left = to - from_
        largest = convs["next"] - 1
        largest[n_left > 0] = turn[to[n_left > 0] - 1]
        missing = largest - convs["next"] + 1 - n_left
        hashes = [hashlib.sha256(",".join(map(str, turn[s:e].tolist())).encode()).hexdigest() for s, e in zip(from_[ends].tolist(), to[ends].tolist(), strict=True)]
        events.append(("close", convs["id"][ends], np.full(int(ends.sum()), -1), hashes, missing[ends], (convs["breaks"] + inner_breaks)[ends]))
        closed = np.sort(np.concatenate([closed, convs["id"][ends]]))
        goes_on = ~ends[conv]
        left = np.cumsum(~ends) - 1
        conv, turn, role, digest = left[conv[goes_on]], turn[goes_on], role[goes_on], digest[goes_on]
        convs = {c: v[~ends] for c, v in convs.items()}
    # Only the roles still in use stay in the state.
    used = np.unique(np.concatenate([role, convs["role"][convs["role"] >= 0]]))
    convs["role"] = np.where(convs["role"] >= 0, np.searchsorted(used, convs["role"]), -1)
    kept = {"conv": conv, "turn": turn, "role": np.searchsorted(used, role), "digest": digest}
    return _packed(closed, convs, kept, [roles[i] for i in used.tolist()]), events


def bucket_step(idle: int = IDLE) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    """The function of `applyInPandasWithState`: a bucket's rows of one batch, its tick among them."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        warnings.filterwarnings("ignore", "The behavior of DataFrame concatenation", FutureWarning)
        rows = pd.concat(list(frames))
        batch, last = int(rows["batch"].iloc[0]), bool(rows["last"].any())
        rows = rows[~rows["tick"].to_numpy(bool)]
        digest = np.frombuffer(bytes.fromhex("".join(rows["digest"].tolist())), "V32")
        arrivals = {c: rows[c].to_numpy(np.int64) for c in ("conv_id", "turn", "first")} | {"role": rows["role"].to_numpy(), "digest": digest}
        blob, events = merged(state.get[0] if state.exists else None, arrivals, batch, last, idle)
        state.update((blob,))
        n, whole = sum(len(e[1]) for e in events), {"conv_id": [], "turn": [], "n_missing": [], "n_breaks": []}
        names, hashes = [], []
        for event, conv, turn, found, missing, breaks in events:
            names += [event] * len(conv)
            hashes += found
            none = pd.array([None] * len(conv), "Int64")
            parts = (pd.array(conv, "Int64") if key[0] >= 0 else none, pd.array(turn, "Int64"), none if missing is None else pd.array(missing, "Int64"), none if breaks is None else pd.array(breaks, "Int64"))
            for column, part in zip(whole.values(), parts, strict=True):
                column.append(part)
        if n:
            longs = {c: pd.concat([pd.Series(p) for p in parts], ignore_index=True) for c, parts in whole.items()}
            yield pd.DataFrame({"event": names, "batch": np.full(n, batch), "sha256": hashes, **longs})[_EVENT_COLUMNS]

    return step


def reassembled(arrivals: DataFrame, idle: int = IDLE) -> DataFrame:
    """A stream of arrivals and ticks (ARRIVAL_DDL; per bucket and batch one tick) -> events (EVENT_DDL)."""
    return arrivals.groupBy("bucket").applyInPandasWithState(bucket_step(idle), EVENT_DDL, "state binary", "append", GroupStateTimeout.NoTimeout)


def bucket_of(conv: F.Column, buckets: int) -> F.Column:
    """Rows without an id have a bucket of their own."""
    return F.when(conv.isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64(conv), F.lit(buckets)).cast("int"))


def arrivals_of(conversations: DataFrame, buckets: int, batches: int = BATCHES) -> DataFrame:
    """bucket, conv_id, turn, first, role, digest, batch: when and as what every turn arrives, of a batch's payloads of a turn the smallest."""
    number, text = F.col("turn").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = conversations.where(number.isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), number.alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), text.alias("text"))
    h = F.conv(F.substring(F.sha2(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.lit(":"), F.col("turn").cast("string")), 256), 1, 8), 16, 10).cast("long")
    once = F.struct((h % batches).alias("batch"), "role")
    again = F.struct(((h + 5) % batches).alias("batch"), F.lit("user").alias("role"))
    dealt = rows.select("conv_id", "turn", "text", F.explode(F.when(h % 7 < 2, F.array(once, again)).otherwise(F.array(once))).alias("a")).select("conv_id", "turn", "a.batch", "a.role", F.concat("a.role", F.lit("|"), "text").alias("payload"))
    # Payloads of a turn are compared as UTF-8 bytes; the role is what stands before the text of the smallest.
    least = dealt.groupBy("conv_id", "turn", "batch").agg(F.min(F.struct("payload", "role")).alias("m")).select("conv_id", "turn", "batch", "m.role", F.sha2("m.payload", 256).alias("digest"))
    firsts = rows.groupBy("conv_id").agg(F.min("turn").alias("first")).withColumnRenamed("conv_id", "_conv")
    joined = least.join(firsts.hint("merge"), F.col("conv_id").eqNullSafe(F.col("_conv")))
    return joined.select(bucket_of(F.col("conv_id"), buckets).alias("bucket"), F.coalesce("conv_id", F.lit(0).cast("long")).alias("conv_id"), "turn", "first", "role", "digest", "batch")


def bucket_count(rows: int) -> int:
    return max(LEAST_BUCKETS, -(-rows // ROWS_PER_BUCKET))


def fed(spark: SparkSession, arrivals: DataFrame, buckets: int, batches: int = BATCHES) -> DataFrame:
    """The events of all batches: each is laid into the stream's folder, and the query is started anew on one checkpoint to take it."""
    top = scratch_path(spark, "turn-reassembly")
    ids = spark.range(-1, buckets).select(F.col("id").cast("int").alias("bucket"))
    for batch in range(batches + 1):
        none = F.lit(0).cast("long")
        tick = ids.select("bucket", none.alias("conv_id"), none.alias("turn"), none.alias("first"), F.lit("").alias("role"), F.lit("").alias("digest"), F.lit(batch).cast("long").alias("batch"), F.lit(True).alias("tick"), F.lit(batch == batches).alias("last"))
        rows = arrivals.where(F.col("batch") == batch).select("*", F.lit(False).alias("tick"), F.lit(False).alias("last"))
        rows.unionByName(tick).write.mode("append").parquet(f"{top}/in")
        stream = reassembled(spark.readStream.schema(ARRIVAL_DDL).parquet(f"{top}/in"))
        query = stream.writeStream.format("parquet").option("path", f"{top}/out").option("checkpointLocation", f"{top}/checkpoint").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.schema(EVENT_DDL).parquet(f"{top}/out")


def reassemble(conversations: DataFrame, batches: int = BATCHES) -> DataFrame:
    """Events (EVENT_DDL) of the conversations' turns as `arrivals_of` lets them arrive."""
    spark = conversations.sparkSession
    buckets = bucket_count(conversations.count())
    arrivals = staged(arrivals_of(conversations, buckets, batches), "turn-arrivals")
    return fed(spark, arrivals, buckets, batches)


def op13_turn_reassembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reassemble(table(spark, sf_dir, "conversations"))
