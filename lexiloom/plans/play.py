"""Queries on oracles, teachers, prompts and training rows. Documents are pages; a user's events are a game's steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiloom.functions import prompts
from lexiloom.functions import text as T
from lexiloom.operators import game as G
from lexiloom.operators import lexical as L
from lexiloom.operators import oracles as O
from lexiloom.operators import rows as R
from lexiloom.operators.corpus import global_rank
from lexiloom.operators.policy import evaluation_report as evaluation_of
from lexiloom.operators.stage import staged
from lexiloom.plans.games import _alike, _guesses, _idf, _pages
from lexiloom.plans.play_sql import END, GAME, ORACLES, STEPS  # noqa: F401
from lexiloom.plans.policies import _batch_results, _steps
from lexiloom.plans.texts import _model


def _lexicon(spark, sf):
    """idf, neighbours of the documents' 1,000 most frequent words."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("text is not null")
    words = staged(L.word_lists(docs, "doc_id", "text"), "words")
    vocab = staged(L.smoothed_idf(L.vocabulary(words.select(F.explode("words").alias("word")), 1000), words.count()), "vocabulary")
    return vocab, L.neighbours(L.pair_counts(words, vocab), vocab)


def document_neighbors(spark, sf):
    return _lexicon(spark, sf)[1]


def full_text(spark, sf):
    pages = _pages(spark, sf)
    return G.full_text(G.shown_pages(pages, _guesses(pages))).select("game_id", F.md5("text").alias("text_md5"))


def stub_hints(spark, sf):
    """Every document behind a few compound words of which the first part is shown."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("text is not null")
    n = F.length("text").cast("string")
    shown = F.concat(F.lit("États-_(4) "), F.col("text"), F.lit(" Saint-(_("), n, F.lit(") Nord-_("), n, F.lit(")"))
    return docs.select("doc_id", F.array_join(prompts.stub_hints(shown), "|").alias("hints"))


def guess_reward_checked(spark, sf):
    """With a dictionary (words of an even number of letters) and a background."""
    pages, idf = _pages(spark, sf), _idf(spark, sf)
    real = idf.where("length(word) % 2 = 0").select("word")
    background = idf.select("word", (F.length("word") % 3 * 0.1).alias("bg"))
    return G.guess_rewards(pages, _guesses(pages), idf.select("word", "idf"), _alike(idf), real, background)


def feedback_steps(spark, sf):
    pages, idf = _pages(spark, sf), _idf(spark, sf)
    return G.feedback_steps(pages, _guesses(pages), idf.select("word", "idf"), _alike(idf))


def completion_rewards(spark, sf):
    pages, idf = _pages(spark, sf), _idf(spark, sf)
    guesses = _guesses(pages)
    said = guesses.where("turn = 6").select("game_id", F.concat(F.lit("<think>bien</think> MOT: "), "guess").alias("completion"))
    return G.completion_rewards(pages, guesses.where("turn < 6"), said, idf.select("word", "idf"), _alike(idf))


def shaped_reward(spark, sf):
    pages, idf = _pages(spark, sf), _idf(spark, sf)
    found = G.shaped_rewards(pages, _guesses(pages), idf.select("word", "idf"), _alike(idf), 50.0)
    return found.select("game_id", "turn", F.round("shaped", 4).alias("shaped"))


EXTRAS = ["sport", "histoire", "ville", "that"]


def _picks(spark, sf, with_title, temperature=0.0, k=1, rounds=1):
    """After the first two guesses of every game."""
    pages, idf = _pages(spark, sf), _idf(spark, sf).select("word", "idf")
    return O.oracle_rounds(pages, idf, _alike(idf), EXTRAS, rounds, with_title, k, temperature, _guesses(pages).where("turn <= 2"))


def strong_oracle_picks(spark, sf):
    return _picks(spark, sf, True)


def soft_oracle_picks(spark, sf):
    return _picks(spark, sf, False)


def soft_oracle_draws(spark, sf):
    return _picks(spark, sf, False, temperature=1.0, k=8)


def oracle_trajectories(spark, sf):
    """Three rounds of the strong oracle."""
    return _picks(spark, sf, True, rounds=3)


def rescue_words(spark, sf):
    pages = _pages(spark, sf)
    return O.lead_words(pages, _guesses(pages).where("turn <= 3"), _alike(_idf(spark, sf)))


def step_prompts(spark, sf):
    """The prompt at every step of every game."""
    before = F.collect_list(F.struct("guess", "score", "exact")).over(G.Window.partitionBy("game_id").orderBy("turn").rowsBetween(G.Window.unboundedPreceding, -1))
    steps = _steps(spark, sf).withColumn("h", before)
    return steps.select("game_id", "turn", F.md5(prompts.chat_prompt(prompts.prompt(F.col("h"), None, 100, GAME), "answer")).alias("prompt_md5"))


def thought_completions(spark, sf):
    c = spark.read.parquet(f"{sf}/conversations.parquet").where("text is not null")
    raw = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("<think> "), "text", F.lit(" </think>MOT: x"))).when(F.col("turn") % 3 == 1, F.concat(F.lit("thinking\n"), "text", F.lit("</think>"))).otherwise(F.col("text"))
    return c.select("conv_id", "turn", F.md5(prompts.thought_completion(raw, F.col("role"), END)).alias("completion_md5"))


def transcript_rows(spark, sf):
    steps = _steps(spark, sf).withColumn("raw", F.concat(F.lit("<think>"), "guess", F.lit("</think>")))
    known = spark.createDataFrame([("click",), ("view",), ("purchase",), ("signup",)], "word string")
    done = steps.where("game_id % 7 = 0").select("game_id")
    return R.transcript_rows(steps, known, done, 100, GAME, END, thought=True).select("game_id", "turn", F.md5("prompt").alias("prompt_md5"), "completion")


def oracle_row_conversion(spark, sf):
    steps = _steps(spark, sf)
    rows = steps.select(F.concat(F.lit("t"), "game_id").alias("title"), F.concat(F.lit(" "), "guess", F.lit("\n")).alias("completion"), F.to_json(F.array(F.struct("guess", "exact", "semantic"))).alias("history"))
    return R.oracle_training_rows(rows, 100, GAME, END).select(F.md5("prompt").alias("prompt_md5"), "completion", "page_title")


def _real_words(spark, sf):
    """The documents' vocabulary, the parts' names and the theme words."""
    names = spark.read.parquet(f"{sf}/part.parquet").select(F.explode(F.regexp_extract_all("p_name", F.lit(T.NONBLANK), F.lit(0))).alias("word"))
    return R.real_words(_idf(spark, sf).select("word"), names)


def real_word_union(spark, sf):
    return _real_words(spark, sf)


def batch_result_real_guesses(spark, sf):
    return _batch_results(spark, sf, _real_words(spark, sf))


def _choices(spark, sf):
    c = spark.read.parquet(f"{sf}/conversations.parquet").where("text is not null")
    said = c.select(F.col("conv_id").alias("game_id"), F.col("turn").alias("pos"), F.concat(F.lit("MOT: "), "text").alias("completion"))
    had = said.where("pos % 2 = 0").select("game_id", T.extract_guess(F.col("completion")).alias("guess"))
    return R.chosen_completions(said, had, [*T.THEME_SEEDS, *R.FALLBACKS])


def completion_choice(spark, sf):
    return _choices(spark, sf)


def evaluation_report(spark, sf):
    found = evaluation_of(_steps(spark, sf), _choices(spark, sf))
    return found.select("games", F.round("solve_rate", 6).alias("solve_rate"), F.round("mean_steps", 6).alias("mean_steps"), *[F.col(c).cast("long").alias(c) for c in ("repeated", "invalid", "rejected_repeated", "rejected_invalid", "fallbacks")])


def curriculum_pages(spark, sf):
    vocab = L.vocabulary(L.page_words(spark.read.parquet(f"{sf}/documents.parquet").where("text is not null"), "doc_id", "text"))
    return R.curriculum_pages(_pages(spark, sf), vocab, 2).select("page_id", "title")


def training_row_reasons(spark, sf):
    docs = _pages(spark, sf)
    rows = docs.select(F.col("page_id").alias("row_id"), F.get(T.first_words(F.col("title"), 1), F.lit(0)).alias("completion")).fillna("", ["completion"])
    return R.training_row_reasons(rows, _idf(spark, sf), 2.0, 300).select("row_id", "reason")


def well_scored(spark, sf):
    rows = _steps(spark, sf).withColumn("score", F.when(F.col("score") % 10 != 0, F.col("score")))
    return R.well_scored(rows, "score", 60).select("game_id", "turn", "score")


def popular_long_pages(spark, sf):
    pages = _pages(spark, sf)
    ranking = global_rank(pages.groupBy("title").agg(F.sum(F.length("intro")).alias("views")), [F.desc("views"), F.asc("title")], "rank")
    return R.popular_long_pages(pages, ranking, 200, 300).select("page_id", "rank")


def shuffled_head(spark, sf):
    return R.shuffled_head(_pages(spark, sf), "page_id", 100, 7, strict=True).select("page_id")


def completion_vocabulary(spark, sf):
    c = spark.read.parquet(f"{sf}/conversations.parquet").where("text is not null")
    rows = c.select(F.concat(F.lit("MOT: "), "text").alias("completion"), F.col("role").alias("title"))
    _, near = _model(spark, sf)
    return R.completion_vocabulary(rows, near, 50, 5)


def agent_summary(spark, sf):
    games = _steps(spark, sf).groupBy("game_id").agg(F.max("solved").alias("solved"), F.count("*").alias("steps"))
    return R.agent_summary(games, 200).select("solved", F.round("solve_rate", 6).alias("solve_rate"), F.round("mean_steps", 6).alias("mean_steps"))


def mix_shares(spark, sf):
    return R.mix_shares(spark.read.parquet(f"{sf}/documents.parquet"), "source")


def sharded_evaluation(spark, sf):
    games = _steps(spark, sf).groupBy("game_id").agg(F.max(F.col("solved").cast("int")).alias("solved"))
    return R.sharded(games, [F.asc("game_id")], 7).groupBy("shard").agg(F.count("*").alias("games"), F.sum("solved").cast("long").alias("solved"))


def _masked(spark, sf):
    vocabulary, near = _model(spark, sf)
    actions = global_rank(vocabulary.select("word"), [F.asc("word")], "pos")
    parts = spark.read.parquet(f"{sf}/part.parquet")
    words = parts.select(F.col("p_partkey").alias("row_id"), F.explode(T.content_words(F.col("p_name"))).alias("word"))
    return actions, near, words


def guessed_actions(spark, sf):
    actions, _, words = _masked(spark, sf)
    rows = words.select("row_id", (F.col("row_id") % 50).alias("game_id")).distinct()
    return R.guessed_actions(rows, actions, words.select(F.col("row_id").alias("game_id"), F.col("word").alias("guess")))


def expanded_actions(spark, sf):
    actions, near, words = _masked(spark, sf)
    return R.expanded_actions(words, actions, near, 4, 1)


def far_title_actions(spark, sf):
    actions, near, words = _masked(spark, sf)
    return R.far_title_actions(words, actions, near, 0.8)


QUERIES = {
    f.__name__: f
    for f in (
        document_neighbors, full_text, stub_hints, guess_reward_checked, feedback_steps, completion_rewards, shaped_reward, strong_oracle_picks, soft_oracle_picks, soft_oracle_draws,
        oracle_trajectories, rescue_words, step_prompts, thought_completions, transcript_rows, oracle_row_conversion, completion_choice, evaluation_report, real_word_union, batch_result_real_guesses, curriculum_pages,
        training_row_reasons, well_scored, popular_long_pages, shuffled_head, completion_vocabulary, agent_summary, mix_shares, sharded_evaluation, guessed_actions, expanded_actions, far_title_actions,
    )
}
