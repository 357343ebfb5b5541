"""Training rows and what they are made from: filters, vocabularies, summaries, shards, conversions, chosen completions, action masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions import prompts
from lexiloom.functions import text as T
from lexiloom.operators.corpus import global_rank

HISTORY = "array<struct<guess:string,score:int,exact:int,semantic:int,title:int,reward:double,solved:boolean,invalid:boolean,repeated:boolean>>"
#: Guesses in their order when a model has none left.
FALLBACKS = ["geographie", "biologie", "economie", "litterature", "acteur", "football", "grec", "romain", "religion", "industrie", "mathematique", "strategie"]


# --- filters -----------------------------------------------------------------------------------------------
def curriculum_pages(pages: DataFrame, vocabulary: DataFrame, most_title_words: int) -> DataFrame:
    """Pages with one to `most_title_words` title words, all of them in vocabulary(word). If there is none, all pages."""
    words = pages.select("page_id", T.word_set(F.col("title")).alias("_w")).where((F.size("_w") > 0) & (F.size("_w") <= most_title_words))
    each = words.select("page_id", F.size("_w").alias("_n"), F.explode("_w").alias("word"))
    known = each.join(vocabulary.select("word").distinct(), "word", "left_semi").groupBy("page_id").agg(F.max("_n").alias("_n"), F.count("*").alias("_k"))
    fit = known.where("_n = _k").select("page_id")
    none = fit.limit(1).agg(F.count("*").alias("_any"))
    marked = pages.join(fit.withColumn("_fit", F.lit(True)), "page_id", "left").crossJoin(F.broadcast(none))  # one row
    return marked.where("_fit or _any = 0").drop("_fit", "_any")


def training_row_reasons(rows: DataFrame, idf: DataFrame, least_idf: float, most: int | None = None) -> DataFrame:
    """rows(row_id, completion) with `word` and `reason`: empty, stopword, idf, beyond (the first `most` good rows by row_id stay) or kept."""
    word = T.strip(F.col("completion"))
    known = rows.withColumn("word", word).withColumn("_c", T.canonical_word(word)).join(idf.select(F.col("word").alias("_c"), "idf"), "_c", "left")
    reason = F.when(F.col("word") == "", "empty").when(F.col("word").isin(*T.STOPWORDS), "stopword").when(F.coalesce("idf", F.lit(0.0)) < least_idf, "idf").otherwise("kept")
    known = known.withColumn("reason", reason).drop("_c", "idf")
    if most is None:
        return known
    good = global_rank(known.where("reason = 'kept'").select("row_id"), [F.asc("row_id")], "_r")
    return known.join(good, "row_id", "left").withColumn("reason", F.when(F.col("_r") > most, "beyond").otherwise(F.col("reason"))).drop("_r")


def well_scored(rows: DataFrame, column: str, least: float) -> DataFrame:
    """Rows that score `least` or more, and rows without a score."""
    return rows.where(F.col(column).isNull() | (F.col(column) >= least))


def popular_long_pages(pages: DataFrame, ranking: DataFrame, n: int, least_words: int) -> DataFrame:
    """The n best ranked pages, and of these the ones with enough words: in this order, so fewer than n may stay."""
    top = pages.join(ranking.select("title", "rank"), "title").orderBy("rank", "page_id").limit(n)
    return top.where(T.words_by_blanks(F.col("intro")) >= least_words)


def real_words(*sources: DataFrame) -> DataFrame:
    """word: what any of the lists has (dictionary, model vocabulary, openers, theme words), by normal form."""
    every = sources[0].select(T.normalize_word(F.col("word")).alias("word"))
    for more in sources[1:]:
        every = every.union(more.select(T.normalize_word(F.col("word")).alias("word")))
    seeds = every.sparkSession.createDataFrame([(w,) for w in T.THEME_SEEDS], "word string")
    return every.union(seeds.select(T.normalize_word(F.col("word")).alias("word"))).where("word <> ''").distinct()


def shuffled_head(df: DataFrame, key: str, n: int, seed: int, strict: bool = False) -> DataFrame:
    """n rows in an order that the seed shuffles. strict: fewer rows than that are an error."""
    head = df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)
    if strict and (found := head.count()) < n:
        raise ValueError(f"{found} rows, not {n}")
    return head


# --- vocabularies, summaries, shards ------------------------------------------------------------------------
def completion_vocabulary(rows: DataFrame, neighbours: DataFrame, most: int, expand: int = 0) -> DataFrame:
    """pos, word, source of rows(completion, title): the `most` frequent guesses, title words that aren't among them, then the `expand` nearest neighbours of title words; each within its part in order, and all words that a completion can say."""
    guess = T.extract_guess(F.col("completion"))
    said = rows.select(guess.alias("word")).where(T.is_valid_guess(F.col("word")))
    top = said.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(most)
    titles = rows.select(F.explode(F.regexp_extract_all("title", F.lit(T.NONBLANK), F.lit(0))).alias("w")).select(T.normalize_word(F.col("w")).alias("word")).distinct()
    titles = titles.where(T.is_valid_guess(F.col("word")))
    only = titles.join(top, "word", "left_anti")
    near = neighbours.where(F.col("rank") <= expand).join(titles, "word", "left_semi").select(F.col("other").alias("word")).distinct()
    near = near.join(top, "word", "left_anti").join(only, "word", "left_anti")
    parts = top.select(F.lit(0).alias("part"), (-F.col("n")).alias("by"), "word").union(only.select(F.lit(1), F.lit(0), "word")).union(near.select(F.lit(2), F.lit(0), "word"))
    speakable = parts.where(T.extract_guess(F.concat(F.lit("MOT: "), "word")) == F.col("word"))
    ranked = global_rank(speakable, [F.asc("part"), F.asc("by"), F.asc("word")], "pos")
    return ranked.select("pos", "word", F.element_at(F.array(F.lit("guessed"), F.lit("title"), F.lit("near")), F.col("part") + 1).alias("source"))


def agent_summary(games: DataFrame, requested: int) -> DataFrame:
    """One row over games(solved, steps): solved, solve_rate and mean_steps, both by the number of games that were asked for."""
    n = max(1, requested)
    return games.agg(F.sum(F.col("solved").cast("long")).alias("solved"), (F.sum(F.col("solved").cast("long")) / n).alias("solve_rate"), (F.sum("steps") / n).alias("mean_steps"))


def mix_shares(parts: DataFrame, source: str) -> DataFrame:
    """source, rows, share (4 digits) of a mix."""
    total = F.greatest(F.sum("rows").over(Window.partitionBy()), F.lit(1))  # a row per source
    return parts.groupBy(source).agg(F.count("*").alias("rows")).withColumn("share", F.round(F.col("rows") / total, 4))


def sharded(df: DataFrame, order: list[Column], shards: int) -> DataFrame:
    """df with `shard` from 0: equal runs of ceil(n / shards) rows in this order, the last ones shorter."""
    ranked = global_rank(df, order, "_r")
    size = F.ceil(F.lit(df.count()) / shards)
    return ranked.withColumn("shard", F.floor((F.col("_r") - 1) / size).cast("int")).drop("_r")


# --- conversions ----------------------------------------------------------------------------------------------
def oracle_training_rows(rows: DataFrame, most_steps: int, game: str, end: str) -> DataFrame:
    """prompt, completion, page_title of recorded oracle rows(title, completion, history as JSON): the hits by similarity stand where the score was."""
    old = F.from_json("history", "array<struct<guess:string,exact:int,semantic:int,score:int>>")
    steps = F.transform(F.coalesce(old, F.array().cast("array<struct<guess:string,exact:int,semantic:int,score:int>>")), lambda s: F.struct(
        s["guess"].alias("guess"), F.coalesce(s["semantic"], s["score"], F.lit(0)).alias("score"), F.coalesce(s["exact"], F.lit(0)).alias("exact")))
    rows = rows.withColumn("_h", steps)
    asked = prompts.chat_prompt(prompts.prompt(F.col("_h"), None, most_steps, game), "answer")
    return rows.select(asked.alias("prompt"), F.concat(F.lit(" "), T.strip(F.col("completion")), F.lit(end)).alias("completion"), F.coalesce("title", F.lit("")).alias("page_title"))


def state_rows(states: DataFrame, most_steps: int, game: str, form: str = "none", end: str = "") -> DataFrame:
    """game_id, turn, prompt, completion, text, history (JSON) of states(game_id, turn, guess, view, history)."""
    asked = prompts.chat_prompt(prompts.prompt(F.col("history"), F.col("view"), most_steps, game), form)
    answer = F.concat(F.lit(" " if form == "answer" else "MOT: "), "guess", F.lit(end))
    rows = states.select("game_id", "turn", asked.alias("prompt"), answer.alias("completion"), F.to_json("history").alias("history"))
    return rows.withColumn("text", F.concat("prompt", "completion"))


def transcript_rows(steps: DataFrame, known: DataFrame, done: DataFrame, most_steps: int, game: str, end: str, thought: bool = False) -> DataFrame:
    """Training rows of an agent's transcripts: steps(game_id, turn, guess, score, exact, raw).

    Left out: repeated guesses of a game, words that known(word) doesn't have,
    answers without a thought (where `thought` asks for one), and the games of
    done(game_id), which an earlier run has written.
    """
    fresh = steps.join(done.select("game_id").distinct(), "game_id", "left_anti")
    before = Window.partitionBy("game_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    told = fresh.withColumn("history", F.collect_list(F.struct("guess", "score", "exact")).over(before))
    first = F.row_number().over(Window.partitionBy("game_id", "guess").orderBy("turn"))
    kept = told.withColumn("_first", first).where("_first = 1").join(known.select(F.col("word").alias("guess")).distinct(), "guess", "left_semi")
    if thought:
        kept = kept.where(F.col("raw").rlike(r"(?s)(<think>|thinking).*?\S.*?</think>"))
    asked = prompts.training_prompt(prompts.prompt(F.col("history"), None, most_steps, game), "think" if thought else "none")
    answer = prompts.thought_completion(F.col("raw"), F.col("guess"), end) if thought else F.concat(F.lit("MOT: "), "guess", F.lit(end))
    return kept.select("game_id", "turn", asked.alias("prompt"), answer.alias("completion"))


def chosen_completions(completions: DataFrame, guessed: DataFrame, fallbacks: list[str]) -> DataFrame:
    """game_id, guess, fallback, rejected_invalid, rejected_repeated: of completions(game_id, pos, completion) the first valid guess that the game hasn't had; else the first such fallback."""
    said = completions.select("game_id", "pos", T.extract_guess(F.col("completion")).alias("guess"))
    had = guessed.select("game_id", "guess").distinct().withColumn("_had", F.lit(True))
    judged = said.withColumn("_ok", T.is_valid_guess(F.col("guess"))).join(had, ["game_id", "guess"], "left").withColumn("_had", F.coalesce("_had", F.lit(False)))
    per = judged.groupBy("game_id").agg(
        F.min(F.when(F.col("_ok") & ~F.col("_had"), F.struct("pos", "guess")))["guess"].alias("picked"),
        F.sum((~F.col("_ok")).cast("long")).alias("rejected_invalid"), F.sum((F.col("_ok") & F.col("_had")).cast("long")).alias("rejected_repeated"))
    mine = had.groupBy("game_id").agg(F.collect_set("guess").alias("_all"))
    spare = F.array(*[F.lit(w) for w in fallbacks])
    free = F.filter(spare, lambda w: T.is_valid_guess(w) & ~F.array_contains(F.coalesce("_all", F.array().cast("array<string>")), w))
    joined = per.join(mine, "game_id", "left")
    return joined.select("game_id", F.coalesce("picked", F.get(free, F.lit(0)), F.lit(fallbacks[-1])).alias("guess"), F.col("picked").isNull().alias("fallback"), "rejected_invalid", "rejected_repeated")


# --- action masks: what is barred, not rows times vocabulary -------------------------------------------------
def guessed_actions(rows: DataFrame, vocabulary: DataFrame, guessed: DataFrame) -> DataFrame:
    """row_id, pos: actions barred as the row's game has guessed them. rows(row_id, game_id), vocabulary(pos, word)."""
    return rows.join(guessed.select("game_id", F.col("guess").alias("word")).distinct(), "game_id").join(vocabulary, "word").select("row_id", "pos").distinct()


def expanded_actions(titles: DataFrame, vocabulary: DataFrame, neighbours: DataFrame, base: int, expand: int) -> DataFrame:
    """row_id, pos: actions beyond the first `base` that a row may take as well: its title's words(row_id, word) and their `expand` nearest."""
    near = titles.join(neighbours.where(F.col("rank") <= expand), "word").select("row_id", F.col("other").alias("word"))
    return titles.select("row_id", "word").union(near).distinct().join(vocabulary.where(F.col("pos") > base), "word").select("row_id", "pos")


def far_title_actions(shown: DataFrame, title_actions: DataFrame, neighbours: DataFrame, threshold: float) -> DataFrame:
    """row_id, pos: title words that stay allowed for rows that have shown(row_id, word) words: those similar enough to one of them. All other title actions of these rows are barred."""
    # Few words have neighbours, and at most MAX_NEIGHBOURS each: a word's allowed actions travel to the rows as a list, so a frequent word isn't one task's.
    good = neighbours.where(F.col("score") >= threshold).select("word", F.col("other").alias("_other")).distinct()
    allowed = good.join(title_actions.select(F.col("word").alias("_other"), "pos"), "_other").groupBy("word").agg(F.collect_list("pos").alias("_allowed"))
    lists = shown.select("row_id", "word").join(F.broadcast(allowed), "word")
    return lists.select("row_id", F.explode("_allowed").alias("pos")).distinct()
