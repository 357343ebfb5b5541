"""Pages given whole give what their tokens give; only words that a guess can touch leave the texts."""

import pytest
from pyspark.sql import functions as F

from lexiloom.functions import text as T
from lexiloom.operators import game, lexical, oracles, similarity

PAGES = [
    (1, "Les Chats", "Les chats noirs dorment, les chiens_2 courent; l'été chante. Chat chat CHATS d'ailleurs"),
    (2, "Été", "Un été 1693 à Paris — « Paris » et la mer; les étés d'avant"),
    (3, "—", "… !"), (4, "", "seul chat"), (5, None, "chat"), (6, "Chien", None), (1, "Chien", "un autre chat du jeu"),
]
GUESSES = [(1, 1, "Chat"), (1, 2, "chiens"), (1, 3, "les"), (1, 4, "chat"), (1, 5, "été"), (2, 1, "paris"), (2, 2, "Eté"), (2, 3, ""), (3, 1, "chat"), (4, 1, "seul"), (9, 1, "chat")]


@pytest.fixture()
def given(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, title string, intro string").repartition(3)
    guesses = spark.createDataFrame(GUESSES, "game_id long, turn int, guess string")
    alike = spark.createDataFrame([(l, r, s) for a, b, s in (("chat", "noir", 0.6), ("ete", "mer", 0.4), ("pari", "mer", 0.5), ("chien", "chat", 0.3)) for l, r in ((a, b), (b, a))], "l string, r string, sim double")
    idf = spark.createDataFrame([("chat", 1.5), ("noir", 2.0), ("mer", 3.0), ("ete", 1.0)], "word string, idf double")
    return pages, guesses, alike, idf


def rows(df):
    return sorted(map(repr, df.collect()))


def test_words_are_those_of_the_tokens(spark, given):
    pages, guesses, alike, _ = given
    columns = ["game_id", "norm", "canon", "n_title", "n_body"]
    every = game.page_profile(game.page_tokens(pages)).select(columns)
    assert rows(game.words_of(pages).select(columns)) == rows(every)
    again = game.words_of(pages).where(F.col("again") != T.canonical_word(F.col("canon")))
    assert again.count() == 0
    few = game.words_of(pages, guesses, alike).select(columns)
    assert few.exceptAll(every).count() == 0
    left = {(r.game_id, r.norm) for r in every.exceptAll(few).collect()}
    assert (1, "dorment") in left and (2, "mer") not in left and not any(r.n_title for r in every.exceptAll(few).collect())


def test_pages_earn_what_their_tokens_earn(spark, given):
    pages, guesses, alike, idf = given
    tokens, table = game.page_tokens(pages), similarity.TableSource(alike)
    lexicon = similarity.LexicalSource(alike.select(F.col("l").alias("word"), F.col("r").alias("other"), F.col("sim").alias("score")))
    vectors = similarity.DenseSource(spark.createDataFrame([("chat", [1.0, 0.0]), ("noir", [0.6, 0.8]), ("mer", [0.0, 1.0])], "word string, vec array<double>"))
    less = similarity.BackgroundSource(table, spark.createDataFrame([("chat", 0.1)], "word string, background double"))
    for source in (alike, table, lexicon, vectors, less):
        assert rows(game.guess_rewards(pages, guesses, idf, source)) == rows(game.guess_rewards(tokens, guesses, idf, source))
        assert rows(game.display_score(pages, guesses, source)) == rows(game.display_score(tokens, guesses, source))
        assert rows(game.semantic_hits(pages, guesses, source, 0.2)) == rows(game.semantic_hits(game.reveals(tokens, guesses), guesses, source, 0.2))
    assert rows(game.shaped_rewards(pages, guesses, idf, alike, 50.0)) == rows(game.shaped_rewards(tokens, guesses, idf, alike, 50.0))
    said = spark.createDataFrame([(1, "MOT: noir"), (2, "mer"), (3, "chat")], "game_id long, completion string")
    assert rows(game.completion_rewards(pages, guesses, said, idf, alike)) == rows(game.completion_rewards(tokens, guesses, said, idf, alike))


def test_oracles_play_pages(spark, given):
    pages, guesses, alike, idf = given
    for with_title, rounds in ((True, 3), (False, 1)):
        play = lambda of: rows(oracles.oracle_rounds(of, idf, alike, ["sport", "mer"], rounds, with_title, history=guesses.where("turn < 3")))  # noqa: B023, E731
        assert play(pages) == play(game.page_tokens(pages))


def test_candidates_meet_only_their_words(spark, given):
    pages, guesses, alike, idf = given
    pool = spark.createDataFrame([(1, "chat"), (1, "noirs"), (2, "mer")], "game_id long, guess string")
    met = {(r.game_id, r.guess, r.norm, r.s) for r in oracles.met_words(game.words_of(pages), pool, idf, alike).collect()}
    chats = {(1, guess, norm, s) for guess, s in (("chat", 1.0), ("noirs", 0.6)) for norm in ("chat", "chats")}
    assert met == chats | {(1, "chat", "noirs", 0.6), (1, "noirs", "noirs", 1.0), (1, "chat", "chien", 0.3), (2, "mer", "mer", 1.0), (2, "mer", "ete", 0.4), (2, "mer", "etes", 0.4)}


def test_words_are_counted_where_texts_lie(spark, given, monkeypatch):
    texts = given[0].select("intro")
    words = lexical.page_words(given[0].where("intro is not null").withColumn("page_id", F.monotonically_increasing_id()), "page_id", "intro")
    for held in (500_000, 2):
        monkeypatch.setattr(lexical, "HELD_WORDS", held)
        assert lexical.counted_vocabulary(texts, 7).collect() == lexical.smoothed_idf(lexical.vocabulary(words, 7), 6).collect()
    assert lexical.counted_vocabulary(texts.limit(0)).count() == 0


def test_first_words_cut_the_head_only(spark):
    texts = ["", "  ", "a", " a b", "a　b c", "a  b\n", "a b c d", None, "x" * 50_000 + " y z"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for n in (1, 2, 3):
        assert [r.w for r in df.select(T.first_words(F.col("t"), n).alias("w")).collect()] == [t if t is None else t.split()[:n] for t in texts]
    assert "split(t," not in df.select(T.first_words(F.col("t"), 2))._jdf.queryExecution().optimizedPlan().toString()
