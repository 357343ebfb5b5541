"""Substring deduplication gives the same rows however its buckets are dealt, and documents of equal ids are ordered without RDDs."""

import random
import time

import numpy as np
import pytest

from lexiloom.llm import repeats, suffix_dedup, word_windows


def rows(seed=3):
    rand = random.Random(seed)
    passages = [" ".join(rand.choice("abcdefgh") * rand.randrange(1, 6) for _ in range(40)) for _ in range(6)]
    out = []
    for i in range(60):
        parts = [" ".join(rand.choice("klmnop") * rand.randrange(1, 6) for _ in range(rand.randrange(5, 40)))]
        parts += [rand.choice(passages) for _ in range(rand.randrange(3))]
        rand.shuffle(parts)
        out.append((i, " ".join(parts)))
    return [*out, (7, out[8][1]), (7, out[9][1]), (None, out[3][1]), (None, "x y"), (60, "ab " * 900)]


def found(spark, table):
    df = spark.createDataFrame(table, "doc_id long, text string").repartition(5)
    a = sorted(((r.doc_id is None, r.doc_id, bytes(r.kept), r.n_removed) for r in suffix_dedup.remove_repeated_bytes(df).collect()), key=str)
    b = sorted(((r.doc_id is None, r.doc_id, bytes(r.kept), r.n_removed) for r in word_windows.remove_repeated_words(df).collect()), key=str)
    return a, b


@pytest.mark.parametrize("settings", [{"MOST_CELLS": 3}, {"MOST_CELLS": 5, "BUCKET_BYTES": 400, "HOT_BYTES": 200}, {"HOLD_ANCHORS": 50, "HOLD_BYTES": 900, "MOST_CELLS": 2}])
def test_same_rows_however_buckets_are_dealt(spark, monkeypatch, settings):
    want = found(spark, rows())
    for name, value in settings.items():
        monkeypatch.setattr(repeats, name, value)
    assert found(spark, rows()) == want and sum(r[3] for r in want[0]) > 0 and sum(r[3] for r in want[1]) > 0


def test_dealing_follows_the_items_not_the_buckets():
    rand = np.random.default_rng(1)
    n = 20_000
    a, u, s, c, x = rand.integers(0, 1 << 48, n), rand.integers(0, 1000, n), rand.integers(0, 9999, n), np.ones(n, np.int64), [b"x" * 120] * n

    def dealt(buckets):
        start = time.process_time()
        cells = sum(b.num_rows for b in repeats._cells(a, u, s, c, x, buckets, -(-buckets // repeats.MOST_CELLS)))
        return cells, time.process_time() - start

    few, many = dealt(7_500), dealt(25_000_000)
    assert many[0] <= repeats.MOST_CELLS and many[1] < 3 * few[1] + 0.5
