"""Oracles over tables against games scored one by one, and leads by hand."""

import random

import pytest

from lexiloom.operators import game, oracles

WORDS = "ville villes capitale France français guerre histoire Paris rivière rivières sport ballon élan musique art arts siècle".split()


@pytest.fixture(scope="module")
def world(spark):
    rand = random.Random(3)
    texts = [(i, " ".join(rand.sample(WORDS, 2)), ", ".join(rand.choice(WORDS) for _ in range(20)) + ".") for i in range(4)] + [(4, "Paris", ""), (5, "", "rien")]
    pages = spark.createDataFrame(texts, "page_id long, title string, intro string")
    forms = sorted({r.c for r in spark.createDataFrame([(w,) for w in WORDS], "w string").select(game.T.canonical_word(game.F.col("w")).alias("c")).collect()})
    idf = spark.createDataFrame([(c, 0.5 + i * 0.7) for i, c in enumerate(forms)], "word string, idf double")
    near = {(a, b): round(rand.random(), 4) for a in forms for b in rand.sample(forms, 4) if a < b}
    sim = spark.createDataFrame([(*p, s) for (a, b), s in near.items() for p in ((a, b), (b, a))], "l string, r string, sim double")
    history = spark.createDataFrame([(p, t, w) for p in range(4) for t, w in enumerate(rand.sample(WORDS, 2), 1)], "game_id long, turn int, guess string")
    return pages, idf, sim, history


def test_candidates_are_scored_as_if_each_were_guessed_in_its_own_game(spark, world):
    pages, idf, sim, history = world
    candidates = spark.createDataFrame([(p, w) for p in range(6) for w in ("ville", "sport", "Élan", "paris", "think")], "game_id long, guess string")
    got = {(r.game_id, r.guess): r.reward for r in oracles.candidate_rewards(game.page_profile(game.page_tokens(pages)), history, candidates, idf, sim).collect()}
    assert len(got) == 30
    for word in ("ville", "elan", "think"):  # one candidate at a time, by the whole games
        after = history.union(spark.createDataFrame([(p, 3 if p < 4 else 1, word) for p in range(6)], "game_id long, turn int, guess string"))
        whole = {(r.game_id, r.turn): r.reward for r in game.guess_rewards(game.page_tokens(pages), after, idf, sim).collect()}
        for p in range(6):
            assert got[p, word] == pytest.approx(whole[p, 3 if p < 4 else 1], abs=2e-4)


def test_oracle_rounds(spark, world):
    pages, idf, sim, history = world
    tokens = game.page_tokens(pages)
    titles = {r.game_id: set() for r in pages.selectExpr("page_id as game_id").collect()}
    for r in tokens.where("in_title and is_word").collect():
        titles[r.game_id].add(r.norm)
    strong = oracles.oracle_rounds(tokens, idf, sim, ["sport", "art"], 3, True, history=history).collect()
    games = {}
    for r in sorted(strong, key=lambda r: (r.game_id, r.turn)):
        games.setdefault(r.game_id, []).append(r.guess)
    assert all(len(set(g)) == len(g) for g in games.values()) and games[4] == ["paris"]  # solved, then silent
    for p in range(4):
        assert titles[p] & set(games[p]) or not titles[p] - {r.guess for r in history.where(f"game_id = {p}").collect()}
    soft = oracles.oracle_rounds(tokens, idf, sim, ["sport", "art"], 2, False, k=4, temperature=1.0, history=history).collect()
    again = oracles.oracle_rounds(tokens.repartition(3), idf, sim, ["sport", "art"], 2, False, k=4, temperature=1.0, history=history).collect()
    assert sorted(map(tuple, soft)) == sorted(map(tuple, again)) and all(r.guess not in titles[r.game_id] for r in soft)
    assert oracles.oracle_rounds(tokens.where("false"), idf, sim, ["art"], 1, True).count() == 0


def test_lead_words(spark):
    pages = spark.createDataFrame([(1, "Paris", "Une grande rivière traverse la ville"), (2, "Paris", "petit petite"), (3, "Paris", "a b"), (4, "Paris Lyon", "paris Rivière grande"), (5, None, None)], "page_id long, title string, intro string")
    guesses = spark.createDataFrame([(4, "Rivière"), (2, "petit")], "game_id long, guess string")
    sim = spark.createDataFrame([("rivière", "paris", 0.9), ("grande", "paris", 0.1)], "l string, r string, sim double")
    assert {r.game_id: r.guess for r in oracles.lead_words(pages, guesses, sim).collect()} == {1: "rivière", 2: "petite", 4: "grande"}
