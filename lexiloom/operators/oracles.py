"""Who would guess what: candidates of a game scored all at once, oracles in rounds of tables, words that lead back.

Every candidate at a state meets its page's word profile, so a state's candidates are
scored by the same sums as any guesses; the best (or one drawn by a softmax) goes on.
A round of all games is one such scoring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions import text as T
from lexiloom.operators import datasets as D
from lexiloom.operators import game as G
from lexiloom.operators.policy import gumbel_choice
from lexiloom.operators.similarity import SimilaritySource, known_pairs, scored
from lexiloom.operators.stage import staged

#: Longest list of an intro's words that a lead is looked for in, and the letters that such a word has at least.
LEAD_WORDS, LEAD_LETTERS = 200, 5


def met_words(profile: DataFrame, candidates: DataFrame, idf: DataFrame, similarity: DataFrame | SimilaritySource) -> DataFrame:
    """game_id, guess, norm, n_title, n_body, info, s, same: the words of a game's page that its candidates(game_id, guess; normal forms) are (same) or are like (s > 0). No other word earns a candidate anything. profile: page_profile, with `info` or without.

    A game's candidates travel to its words as a list, so the words of a page aren't
    copied for its candidates.
    """
    listed = G.prepared_guesses(candidates).groupBy("game_id").agg(F.collect_list(F.struct("guess", F.col("norm_guess").alias("norm"), F.col("canon_guess").alias("l"))).alias("_asked"))
    words, pairs = profile.join(listed.hint("shuffle_hash"), "game_id"), known_pairs(similarity)
    if pairs is None:
        near = words.withColumn("_a", F.explode("_asked"))
    else:  # of a word's likes and itself those that are asked; equal normal forms have equal canonical ones
        likes = pairs.groupBy(F.col("r").alias("canon")).agg(F.collect_set("l").alias("_likes"))
        own = F.concat(F.coalesce("_likes", F.array().cast("array<string>")), F.array("canon"))
        told = words.join(likes, "canon", "left").withColumn("_l", F.explode(F.array_intersect(own, F.col("_asked.l"))))
        near = told.withColumn("_a", F.explode(F.filter("_asked", lambda a: a["l"] == F.col("_l"))))
    met = near.withColumn("same", F.col("norm") == F.col("_a.norm"))
    rows = scored(similarity, met.select(*profile.columns, "same", F.col("_a.guess").alias("guess"), F.col("_a.l").alias("l"), F.col("canon").alias("r")))
    rows = rows.withColumn("s", F.when(F.col("l") == F.col("r"), F.greatest(F.lit(1.0), F.col("sim"))).otherwise(F.col("sim"))).where("s > 0 or same")
    return (rows if "info" in profile.columns else G.informed(rows, idf)).select("game_id", "guess", "norm", "n_title", "n_body", "info", "s", "same")


def candidate_rewards(profile: DataFrame, history: DataFrame, candidates: DataFrame, idf: DataFrame, similarity: DataFrame | SimilaritySource, met: DataFrame | None = None) -> DataFrame:
    """game_id, guess, reward of each of candidates(game_id, guess) as the guess after its game's history(game_id, turn, guess). profile: page_profile of the games' words; met: met_words() of these candidates and any more, where there is one already."""
    asked = candidates.select("game_id", T.normalize_word(F.col("guess")).alias("guess")).where("guess <> ''").distinct()
    if met is None:
        met = met_words(profile, asked, idf, similarity)
    said = G.prepared_guesses(history).groupBy("game_id").agg(F.max("turn").alias("_n"), F.collect_set(F.when(F.col("norm_guess") != "", F.col("norm_guess"))).alias("_said"))
    spoken = F.coalesce(F.array_contains("_said", F.col("norm")), F.lit(False))
    rows = met.join(said.hint("shuffle_hash"), "game_id", "left").withColumn("shown", spoken).where("not shown").withColumn("bg", F.lit(0.0))
    sums = rows.groupBy("game_id", "guess").agg(*G.reward_sums(F.col("same"), ~F.col("same"), F.lit(False), F.lit(False)))
    titles = profile.where("n_title > 0").join(said.hint("shuffle_hash"), "game_id", "left").groupBy("game_id").agg(F.count("*").alias("_words"), F.count(F.when(spoken, 1)).alias("_shown"))
    every = asked.join(said, "game_id", "left").withColumn("norm", T.normalize_word(F.col("guess"))).withColumn("turn", (F.coalesce("_n", F.lit(0)) + 1).cast("int")).withColumn("repeated", spoken).drop("_said", "_n")
    row = every.join(sums, ["game_id", "guess"], "left").join(titles, "game_id", "left").fillna(0, [*G.SUMS, "_words", "_shown"])
    solved = (F.col("title") > 0) & (F.col("_words") == F.col("_shown") + 1)  # it was the last word that the title hid
    reward = F.when(~T.is_valid_guess(F.col("norm")), F.lit(G.INVALID)).when(F.col("repeated"), F.lit(G.REPEATED)).otherwise(G.earned(solved, 1.0))
    return row.select("game_id", "guess", reward.alias("reward"))


def best_guesses(rewards: DataFrame, k: int = 1, temperature: float = 0.0, seed: int = 42) -> DataFrame:
    """game_id, guess, reward: the candidate with the greatest reward (ties by word), or one of the k best drawn by a softmax over their normalised rewards."""
    return gumbel_choice(rewards, ["game_id"], "reward", "guess", k, temperature, seed)


def solved_games(profile: DataFrame, history: DataFrame) -> DataFrame:
    """game_id of the games whose title words have all been guessed."""
    titles = profile.where("n_title > 0").select("game_id", "norm").distinct()
    said = history.select("game_id", T.normalize_word(F.col("guess")).alias("norm")).distinct().withColumn("_said", F.lit(1))
    found = titles.join(said, ["game_id", "norm"], "left").groupBy("game_id").agg(F.count("*").alias("n"), F.count("_said").alias("k"))
    return found.where("n = k").select("game_id")


def oracle_rounds(given: DataFrame, idf: DataFrame, similarity: DataFrame | SimilaritySource, extras: list[str], rounds: int, with_title: bool, k: int = 1, temperature: float = 0.0, history: DataFrame | None = None, seed: int = 42) -> DataFrame:
    """game_id, turn, guess, reward: what the oracle says in each of the next rounds of every game, each with what was said before.

    given: tokens, or pages (page_id, title, intro).  The strong oracle (with_title)
    knows the title's words; the soft one never says one.  A game that is solved says
    no more.  What the pool's words meet is worked out once for all rounds.
    """
    words = staged(G.informed(G.words_of(given), idf), "words")
    if "idx" in given.columns:
        games = given.select("game_id")
    else:
        games = given.where("title is not null and intro is not null").select(F.col("page_id").alias("game_id"))
    kind = dict(words.dtypes)["game_id"]
    past = staged(history.select("game_id", F.col("turn").cast("int").alias("turn"), "guess"), "history") if history is not None else given.sparkSession.createDataFrame([], f"game_id {kind}, turn int, guess string")
    pool = staged(D.profile_pool(words, games, past.select("game_id", "guess"), extras, with_title).select("game_id", F.col("word").alias("guess")).distinct(), "pool")
    titles = words.where("n_title > 0")
    profile = staged(titles, "titles") if rounds > 1 else titles
    met = met_words(words, pool, idf, similarity)
    met = staged(met, "met") if rounds > 1 else met
    said = None
    for round_ in range(rounds):
        spoken = past.select("game_id", T.normalize_word(F.col("guess")).alias("guess")).distinct()
        free = pool.join(spoken, ["game_id", "guess"], "left_anti").join(solved_games(profile, past), "game_id", "left_anti")
        best = best_guesses(candidate_rewards(profile, past, free, idf, similarity, met), k, temperature, seed + round_)
        turns = past.groupBy("game_id").agg(F.max("turn").alias("_n"))
        new = staged(best.join(turns, "game_id", "left").select("game_id", (F.coalesce("_n", F.lit(0)) + 1).cast("int").alias("turn"), "guess", "reward"), "round")
        said = new if said is None else said.union(new)
        past = past.union(new.select("game_id", "turn", "guess"))
    return said


def lead_words(pages: DataFrame, guesses: DataFrame, similarity: DataFrame | SimilaritySource) -> DataFrame:
    """game_id, guess: for games that go astray the word of the intro that is nearest to a title word.

    pages(page_id, title, intro); guesses(game_id, guess).  Looked at are the first
    LEAD_WORDS different words of LEAD_LETTERS letters or more that are neither stop
    words nor guessed nor in the title; the earliest of equals counts.
    """
    letters = "a-zA-ZÀ-ÿ"
    runs = lambda c, least: F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(rf"(?<![\p{{L}}\p{{N}}_])[{letters}]{{{least},}}(?![\p{{L}}\p{{N}}_])" if least > 1 else f"[{letters}]+"), F.lit(0))
    titles = pages.select(F.col("page_id").alias("game_id"), F.explode(runs(F.col("title"), 1)).alias("r")).distinct()
    words = pages.select(F.col("page_id").alias("game_id"), F.posexplode(runs(F.col("intro"), LEAD_LETTERS)).alias("pos", "word")).where(~F.col("word").isin(*T.STOPWORDS))
    first = words.groupBy("game_id", "word").agg(F.min("pos").alias("pos"))
    never = titles.select("game_id", F.col("r").alias("word")).union(guesses.select("game_id", F.lower("guess").alias("word"))).distinct()
    order = Window.partitionBy("game_id").orderBy("pos")
    open_ = staged(first.join(never, ["game_id", "word"], "left_anti").withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= LEAD_WORDS), "leads")
    pairs = open_.select("game_id", F.col("word").alias("l")).join(titles, "game_id")
    table = similarity if isinstance(similarity, DataFrame) else similarity.similarity(pairs.select("l", "r").distinct())
    near = pairs.join(table, ["l", "r"]).groupBy("game_id", F.col("l").alias("word")).agg(F.max("sim").alias("sim"))
    scored = open_.join(near, ["game_id", "word"], "left").groupBy("game_id").agg(F.min(F.struct((-F.coalesce("sim", F.lit(0.0))).alias("s"), "pos", "word")).alias("m"))
    return scored.select("game_id", F.col("m.word").alias("guess"))
