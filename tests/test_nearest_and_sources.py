"""Pruned nearest vectors and similarity sources against brute force."""

import random

import numpy as np
import pytest

from lexiloom.operators import game, nearest, similarity, vectors


def frame(spark, rows):
    return spark.createDataFrame([(w, [float(x) for x in v]) for w, v in rows], "word string, vec array<double>")


def brute(rows, queries, k):
    out = {}
    for q, v in queries:
        sims = sorted(((-round(float(np.dot(v, x)), 9), w) for w, x in rows))[:k]
        out[q] = [(w, round(-s, 6)) for s, w in sims]
    return out


@pytest.mark.parametrize("pieces", [(4096, 2048), (7, 5)])
def test_nearest_equals_brute_force_and_skips(spark, monkeypatch, pieces):
    monkeypatch.setattr(nearest, "CELL_ROWS", pieces[0])
    monkeypatch.setattr(nearest, "QUERY_ROWS", pieces[1])
    rand = np.random.default_rng(5)
    centres = rand.normal(size=(12, 8)) * 4
    points = np.concatenate([c + rand.normal(size=(30, 8)) * 0.05 for c in centres])
    rows = [(f"w{i:03}", p) for i, p in enumerate(points)] + [("tie1", points[0]), ("tie0", points[0]), ("zero", np.zeros(8))]
    queries = [(f"q{i}", points[i * 9] + 0.01) for i in range(40)] + [("q_zero", np.zeros(8)), ("w000", points[0])]
    cells = nearest.Cells(frame(spark, rows), pivots=20)
    found, searched = nearest.nearest(cells, frame(spark, queries), 5)
    got = {}
    for r in sorted(found.collect(), key=lambda r: (r.query, r["rank"])):
        got.setdefault(r.query, []).append((r.word, round(r.sim, 6)))
    want = brute(rows, queries, 5)
    assert {q: [w for w, _ in v] for q, v in got.items()} == {q: [w for w, _ in v] for q, v in want.items()}
    pairs = searched.collect()
    assert len(set(pairs)) == len(pairs)  # a cell is searched once a query
    assert len(pairs) < 0.5 * len(queries) * 20  # and most are skipped


def test_fewer_vectors_than_asked_and_none(spark):
    rows = [("a", [1.0, 0.0]), ("b", [0.0, 1.0])]
    found, _ = nearest.nearest(nearest.Cells(frame(spark, rows)), frame(spark, [("q", [1.0, 0.5])]), 10)
    assert [(r.word, r["rank"]) for r in found.orderBy("rank").collect()] == [("a", 1), ("b", 2)]
    found, searched = nearest.nearest(nearest.Cells(frame(spark, [])), frame(spark, [("q", [1.0])]), 3)
    assert found.count() == 0 and searched.count() == 0


def test_best_by_owner(spark, monkeypatch):
    monkeypatch.setattr(nearest, "QUERY_ROWS", 3)
    rand = random.Random(1)
    rows = [(f"w{i}", [rand.gauss(0, 1) for _ in range(4)]) for i in range(30)]
    pages = [(p, f"w{rand.randrange(30)}") for p in (1, 1, 1, 1, 1, 1, 2, 3)]
    got = {(r.page_id, r.word): round(r.sim, 6) for r in vectors.best_of_pages(frame(spark, rows), spark.createDataFrame(pages, "page_id long, word string")).collect()}
    vec = dict(rows)
    assert got == {(p, w): round(max(float(np.dot(vec[x], v)) for q, x in pages if q == p), 6) for p in (1, 2, 3) for w, v in rows}


# --- sources -----------------------------------------------------------------------------------------
def answers(source, spark, pairs):
    return {(r.l, r.r): round(r.sim, 6) for r in source.similarity(spark.createDataFrame(pairs, "l string, r string")).collect()}


PAIRS = [("a", "a"), ("a", "b"), ("b", "a"), ("a", "zz"), ("zz", "zz")]


def test_every_source_answers_every_pair(spark, tmp_path):
    near = spark.createDataFrame([("a", "b", 0.7)], "word string, other string, score double")
    idf = spark.createDataFrame([("a", 2.0)], "word string, idf double")
    table = similarity.TableSource(spark.createDataFrame([("a", "b", 0.7)], "l string, r string, sim double"))
    lexical = similarity.LexicalSource(near, idf, idf.select("word"))
    dense = similarity.chosen(lexical, frame(spark, [("a", [1.0, 0.0]), ("b", [0.6, 0.8])]))
    contrast = similarity.BackgroundSource(dense, spark.createDataFrame([("a", 0.2)], "word string, background double"))
    assert answers(table, spark, PAIRS) == answers(lexical, spark, PAIRS) == {("a", "a"): 1.0, ("a", "b"): 0.7, ("b", "a"): 0.7, ("a", "zz"): 0.0, ("zz", "zz"): 1.0}
    assert answers(dense, spark, PAIRS) == {("a", "a"): 1.0, ("a", "b"): 0.6, ("b", "a"): 0.6, ("a", "zz"): 0.0, ("zz", "zz"): 1.0}
    assert answers(contrast, spark, PAIRS) == {("a", "a"): 1.0, ("a", "b"): 0.4, ("b", "a"): 0.6, ("a", "zz"): 0.0, ("zz", "zz"): 1.0}
    assert isinstance(dense, similarity.DenseSource) and dense.idf is idf and similarity.chosen(lexical, None) is lexical
    for name, df in (("idf", idf), ("neighbours", near), ("starters", idf.select("word"))):
        df.write.parquet(f"{tmp_path}/{name}")
    assert isinstance(similarity.loaded(spark, str(tmp_path)), similarity.LexicalSource)
    dense.vectors.write.parquet(f"{tmp_path}/vectors")
    assert answers(similarity.loaded(spark, str(tmp_path)), spark, PAIRS) == answers(dense, spark, PAIRS)


def test_games_run_on_a_source_as_on_its_table(spark):
    pages = spark.createDataFrame([(1, "Paris", "ville capitale rivière ville"), (2, "Rome", "capitale")], "page_id long, title string, intro string")
    guesses = spark.createDataFrame([(1, 1, "capitale"), (1, 2, "ville"), (2, 1, "rivière")], "game_id long, turn int, guess string")
    rows = [("capital", "vill", 0.8), ("vill", "rivier", 0.5), ("ville", "riviere", 0.5), ("capitale", "ville", 0.8), ("ville", "paris", 0.4), ("riviere", "rome", 0.9)]
    both = spark.createDataFrame([*rows, *[(r, l, s) for l, r, s in rows]], "l string, r string, sim double")
    source, idf = similarity.TableSource(both), spark.createDataFrame([("ville", 3.0)], "word string, idf double")
    tokens = game.page_tokens(pages)
    revealed = game.revealed_pages(pages, guesses)
    for run in (lambda s: game.semantic_hits(revealed, guesses, s), lambda s: game.display_score(tokens, guesses, s), lambda s: game.guess_rewards(tokens, guesses, idf, s)):
        assert sorted(map(str, run(source).collect())) == sorted(map(str, run(both).collect()))
