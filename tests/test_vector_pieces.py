"""Vector searches in pieces: the same results, and no row per query and cell."""

import numpy as np

from lexiloom.operators import nearest, vectors


def test_queries_travel_with_a_list_of_cells(spark):
    rand = np.random.default_rng(3)
    rows = spark.createDataFrame([(f"w{i}", rand.normal(size=4).tolist()) for i in range(60)], "word string, vec array<double>")
    cells = nearest.Cells(rows, pivots=10)
    assert cells.wanted(rows, 20).count() == 60


def test_max_similarity_in_pieces(spark, monkeypatch):
    rand = np.random.default_rng(4)
    vec = {f"w{i}": rand.normal(size=4) for i in range(40)}
    v = spark.createDataFrame([(w, x.tolist()) for w, x in vec.items()], "word string, vec array<double>")
    page = {p: [f"w{i}" for i in range(40) if i % 3 == p] for p in (0, 1)}
    has = spark.createDataFrame([(p, w) for p, ws in page.items() for w in ws], "page_id int, word string")
    pairs = spark.createDataFrame([(p, w) for p in (0, 1, 2) for w in [*vec, "none"]], "page_id int, word string")
    monkeypatch.setattr(nearest, "BLOCK_ROWS", 5)
    got = {(r.page_id, r.word): round(r.sim, 6) for r in vectors.max_similarity(v, has, pairs).collect()}
    want = {}
    for p in (0, 1, 2):
        for w in [*vec, "none"]:
            ws = page.get(p, [])
            want[p, w] = 1.0 if w in ws else round(max((float(vec[w] @ vec[x]) for x in ws), default=0.0), 6) if w in vec else 0.0
    assert got == want
