"""Guesses travel to their page's words; words, and the pairs of words, are not dealt out again."""

from lexiloom.operators import game, similarity


def test_words_are_dealt_out_once(spark):
    pages = spark.createDataFrame([(1, "Le chat", "Le chat noir dort"), (2, "Chien", "Un chien court")], "page_id int, title string, intro string")
    guesses = spark.createDataFrame([(1, 1, "noir"), (1, 2, "chien"), (2, 1, "chat")], "game_id int, turn int, guess string")
    words = game.page_tokens(pages).where("is_word").selectExpr("game_id", "canon as r").distinct()
    met = game.asked_words(words, guesses)
    assert sorted(met.where("game_id = 2").collect()) == sorted((2, r, 1, "chat") for r in ("un", "chien", "court"))
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2  # the pages and the guesses, by game


def test_scored_keeps_rows_and_columns(spark):
    rows = spark.createDataFrame([(1, "a", "b"), (2, "a", "b"), (3, "b", "b"), (4, "", "b"), (5, None, "b")], "id int, l string, r string")
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.6, 0.8])], "word string, vec array<double>")
    near = spark.createDataFrame([("a", "b", 0.5)], "l string, r string, sim double")
    for source, sim in ((similarity.DenseSource(vectors), 0.6), (near, 0.5), (similarity.TableSource(near), 0.5)):
        assert sorted((r.id, r.sim) for r in similarity.scored(source, rows).select("id", "sim").fillna(0.0).collect()) == [(1, sim), (2, sim), (3, 0.0), (4, 0.0), (5, 0.0)]
