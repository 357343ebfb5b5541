"""Training-data builders: oracle pools and their best guesses, trajectories, curriculum rows, batch requests and results, closed-set games."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions import prompts
from lexiloom.functions import text as T
from lexiloom.operators import game as G
from lexiloom.operators.stage import staged

HISTORY = "array<struct<guess:string,score:int,exact:int,semantic:int,title:int,reward:double,solved:boolean>>"


def title_words(tokens: DataFrame) -> DataFrame:
    """game_id, word, pos: the distinct normal forms of a title in order."""
    return tokens.where("in_title and is_word").groupBy("game_id", F.col("norm").alias("word")).agg(F.min("idx").alias("pos"))


def probe_words(tokens: DataFrame, idf: DataFrame, n: int = 20) -> DataFrame:
    """game_id, word, info, rank: words of the text, not of the title, that tell most."""
    body = tokens.where("is_word and not in_title").where(T.is_valid_guess(F.col("norm"))).select("game_id", F.col("norm").alias("word"), "canon").distinct()
    known = G.informed(body, idf).select("game_id", "word", "info")
    best = known.groupBy("game_id", "word").agg(F.max("info").alias("info")).join(title_words(tokens).select("game_id", "word"), ["game_id", "word"], "left_anti")
    order = Window.partitionBy("game_id").orderBy(F.desc("info"), "word")
    return best.where("info > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def profile_probes(profile: DataFrame, n: int = 20) -> DataFrame:
    """probe_words() from a page_profile with `info`."""
    own = profile.where("n_title = 0 and info > 0").where(T.is_valid_guess(F.col("norm"))).groupBy("game_id", F.col("norm").alias("word")).agg(F.max("info").alias("info"))
    order = Window.partitionBy("game_id").orderBy(F.desc("info"), "word")
    return own.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def profile_pool(profile: DataFrame, games: DataFrame, guessed: DataFrame, extras: list[str], with_title: bool) -> DataFrame:
    """oracle_pool() from a page_profile with `info`, for games(game_id)."""
    pool = profile_probes(profile).select("game_id", "word")
    openers = games.sparkSession.createDataFrame([(w,) for w in extras], "word string")
    pool = pool.union(games.select("game_id").distinct().crossJoin(F.broadcast(openers)))  # a stated list
    titles = profile.where("n_title > 0").select("game_id", F.col("norm").alias("word")).distinct()
    pool = pool.union(titles) if with_title else pool.join(titles, ["game_id", "word"], "left_anti")
    return pool.distinct().join(guessed.select("game_id", F.col("guess").alias("word")).distinct(), ["game_id", "word"], "left_anti")


def oracle_pool(tokens: DataFrame, idf: DataFrame, guessed: DataFrame, extras: list[str], with_title: bool) -> DataFrame:
    """game_id, word: probes, common openers and (for the strong oracle) title words, without what was guessed; without any title word for the soft oracle."""
    pool = probe_words(tokens, idf).select("game_id", "word")
    openers = tokens.sparkSession.createDataFrame([(w,) for w in extras], "word string")
    pool = pool.union(tokens.select("game_id").distinct().crossJoin(F.broadcast(openers)))  # a stated list
    titles = title_words(tokens).select("game_id", "word")
    pool = pool.union(titles) if with_title else pool.join(titles, ["game_id", "word"], "left_anti")
    return pool.distinct().join(guessed.select("game_id", F.col("guess").alias("word")).distinct(), ["game_id", "word"], "left_anti")


def best_rewarded(tokens: DataFrame, pool: DataFrame, idf: DataFrame, similarity: DataFrame) -> DataFrame:
    """game_id, guess, reward: the pool's word with the greatest reward as a first guess (ties by word). Each candidate is a game of one turn."""
    cand = pool.select("game_id", F.concat_ws("\x1f", F.col("game_id").cast("string"), "word").alias("play"), F.col("word").alias("guess"))
    plays = tokens.join(cand.select("game_id", "play"), "game_id").withColumn("game_id", F.col("play")).drop("play")
    scored = G.guess_rewards(plays, cand.select(F.col("play").alias("game_id"), F.lit(1).alias("turn"), "guess"), idf, similarity)
    found = scored.select(F.split("game_id", "\x1f")[0].alias("game_id"), "guess", "reward")
    order = Window.partitionBy("game_id").orderBy(F.desc("reward"), "guess")
    return found.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def curriculum_rows(steps: DataFrame, most_steps: int, name: str) -> DataFrame:
    """game_id, turn, prompt, completion, history (JSON): one row per step, its state being all earlier steps. steps: game_id, turn, guess, score, exact, semantic, title, reward, solved. name: the game's."""
    one = F.struct(*[F.col(c).cast(t).alias(c) for c, t in (("guess", "string"), ("score", "int"), ("exact", "int"), ("semantic", "int"), ("title", "int"), ("reward", "double"), ("solved", "boolean"))])
    w = Window.partitionBy("game_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    rows = steps.withColumn("h", F.collect_list(one).over(w))
    asked = prompts.prompt(F.col("h"), None, most_steps, name)
    return rows.select("game_id", "turn", asked.alias("prompt"), F.concat(F.lit("MOT: "), "guess").alias("completion"), F.to_json("h").alias("history"))


def with_end_mark(df: DataFrame, mark: str) -> DataFrame:
    """The completion ends with the mark, once."""
    return df.withColumn("completion", F.when(F.col("completion").endswith(mark), F.col("completion")).otherwise(F.concat("completion", F.lit(mark))))


def warm_stops(steps: DataFrame, stops: tuple[int, ...] = (0, 3, 6, 10, 15, 20)) -> DataFrame:
    """States with so many earlier guesses; the empty state is always one."""
    return steps.where((F.col("turn") - 1).isin(0, *stops))


def oversampled(df: DataFrame, condition, times: int = 3) -> DataFrame:
    copies = F.when(condition, F.array_repeat(F.lit(1), times)).otherwise(F.array(F.lit(1)))
    return df.withColumn("_c", F.explode(copies)).drop("_c")


def batch_requests(states: DataFrame, model: str, system: str, max_tokens: int = 64) -> DataFrame:
    """custom_id, request (JSON). states: custom_id, prompt."""
    message = F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")), F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content")))
    body = F.struct(F.lit(model).alias("model"), message.alias("messages"), F.lit(max_tokens).alias("max_tokens"), F.lit(0.7).alias("temperature"))
    whole = F.struct("custom_id", F.lit("POST").alias("method"), F.lit("/v1/chat/completions").alias("url"), body.alias("body"))
    return states.select("custom_id", F.to_json(whole).alias("request"))


def batch_results(states: DataFrame, results: DataFrame, real_words: DataFrame | None = None) -> DataFrame:
    """custom_id, game_id, guess: the answers' guesses, valid ones (and such that real_words(word) has, if it is given), the first of equal guesses of a game. results: value (JSON lines)."""
    text = F.get_json_object("value", "$.response.body.choices[0].message.content")
    got = results.select(F.get_json_object("value", "$.custom_id").alias("custom_id"), T.extract_guess(text).alias("guess")).where(T.is_valid_guess(F.col("guess")))
    if real_words is not None:
        got = got.join(real_words.select(F.col("word").alias("guess")).distinct(), "guess", "left_semi")
    found = states.join(got, "custom_id")
    order = Window.partitionBy("game_id", "guess").orderBy("custom_id")
    return found.withColumn("_r", F.row_number().over(order)).where("_r = 1").select("custom_id", "game_id", "guess")


#: Candidates whose words the solver weighs, and how few it takes to try their titles.
POOL, FEW = 250, 3


def _page_kinds(page_words: DataFrame, title_words_: DataFrame, idf: DataFrame, games: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (page_id, kind: a hash of its words and title words) of the closed set, and a row per kind: kind, first (its smallest page), pages, firsts (its POOL smallest pages), words, score, need, player."""
    marked = [df.where("page_id is not null").select("page_id", "word", F.lit(i == 0).alias("inside"), F.lit(i == 1).alias("titled")) for i, df in enumerate((page_words, title_words_))]
    once = marked[0].union(marked[1]).groupBy("page_id", "word").agg(F.max("inside").alias("inside"), F.max("titled").alias("titled"))
    pages = once.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("word", "inside", "titled"))).alias("words"), F.count_if("inside").alias("n"), F.count_if("titled").alias("need"))
    pages = pages.where("n > 0").withColumn("kind", F.unhex(F.sha2(F.to_json(F.struct("words")), 256)))
    pages = pages.join(games.select("page_id", F.lit(True).alias("asked")).distinct(), "page_id", "left").withColumn("asked", F.col("asked").isNotNull())
    pages = staged(pages, "pages")
    kinds = pages.groupBy("kind").agg(F.min("page_id").alias("first"), F.count("*").alias("pages"), F.first("words").alias("words"), F.first("n").alias("n"), F.first("need").alias("need"), F.max("asked").alias("player"))
    place = F.row_number().over(Window.partitionBy("kind").orderBy("page_id"))
    firsts = pages.select("kind", "page_id", place.alias("place")).where(F.col("place") <= POOL).groupBy("kind").agg(F.sort_array(F.collect_list("page_id")).alias("firsts"))
    kinds = staged(kinds.join(firsts, "kind").withColumn("score", -0.01 * F.col("n")).drop("n"), "kinds")
    weights = idf.groupBy("word").agg(F.max("idf").cast("double").alias("weight"))
    weighed = kinds.select("kind", F.inline("words")).where("word is not null").join(weights, "word", "left")
    weighed = weighed.groupBy("kind").agg(F.collect_list(F.struct("word", F.coalesce("weight", F.lit(1.0)).alias("weight"), "inside", "titled")).alias("words"))
    kinds = kinds.drop("words").join(weighed, "kind", "left").withColumn("words", F.coalesce("words", F.array().cast(weighed.schema["words"].dataType)))
    return pages.select("page_id", "kind"), staged(kinds, "weighed")


def solve_closed_set(
    games: DataFrame, page_words: DataFrame, title_words_: DataFrame, idf: DataFrame, starters: list[str], most_steps: int = 20, vocabulary: tuple[str, ...] = ()
) -> DataFrame:
    """Plays every game (game_id, page_id) against the closed set of pages: game_id, turn, guess, candidates, solved.

    The starters come first. Then, with at most FEW candidates left, the title words of the best ranked one, the rarest
    first; else the word that tells most about the POOL best ranked; else the vocabulary in its order. Unknown words have
    an IDF of 1. Candidates rank by what game.candidate_ranking says, ties by page.

    All games play a turn together. Pages with equal words and title words are one kind: they answer alike and rank alike
    but for ties, so a kind is played once, with the number of its pages, and keeps its POOL smallest for the ties. Kinds
    that gave equal answers so far are at the same node of a guess tree: they have the same candidates and make the same
    guess. A node's name is its answers. A kind's row has its words that weren't guessed yet, so answers need no join with
    the words, and a turn writes three tables: guesses, kinds, nodes. The driver holds none of them.
    """
    pages, kinds = _page_kinds(page_words, title_words_, idf, games)
    outside = not games.join(pages, "page_id", "left_anti").isEmpty()
    fate = "struct<guessed:array<string>,counts:array<int>,solved:boolean>"
    state = kinds.select("first", "pages", "firsts", "words", F.lit("").alias("node"), "score", "score", "need", "player", F.lit(False).alias("solved"), F.lit(None).cast(fate).alias("fate"))
    state = state.toDF(*"first pages firsts words node score was need player solved fate".split())
    if outside:  # pages outside of the set never hit; they are one player without words
        blank = games.sparkSession.range(1).select(*(F.lit({"pages": 0, "node": "", "score": 0.0, "was": 0.0, "need": 0, "player": True, "solved": False}.get(f.name)).cast(f.dataType).alias(f.name) for f in state.schema))
        state = state.union(blank.withColumn("words", F.array().cast(state.schema["words"].dataType)))
    nodes = state.groupBy("node").agg(F.sum("pages").alias("n"), F.max("player").alias("alive")).where("alive")
    nodes = staged(nodes.select("node", "n", "alive", F.array().cast("array<string>").alias("guessed"), F.array().cast("array<int>").alias("counts"), F.lit(False).alias("ruled_out")), "nodes")
    listed, spare = (F.array(*map(F.lit, some)).cast("array<string>") for some in (starters, vocabulary))
    fates: list[DataFrame] = []
    for _ in range(most_steps):
        opener = F.get(F.array_except(listed, "guessed"), F.lit(0))
        open_nodes = nodes.where(F.col("alive") & opener.isNull()).select("node", "n")
        # the POOL best pages are of the POOL best kinds, since each kind before a page's own has a page before it
        best = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("score"), "first"))
        pool = state.where("pages > 0").select("node", "first", "score", "firsts").join(open_nodes, "node").withColumn("place", best).where(F.col("place") <= POOL)
        place = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("score"), "page_id"))
        pool = pool.select("node", "n", "first", "score", F.explode("firsts").alias("page_id")).withColumn("place", place).where(F.col("place") <= POOL)
        pool = pool.groupBy("node", "n", "first").agg(F.count("*").alias("m"), F.min("place").alias("place"))
        told = pool.join(state.where("pages > 0").select("node", "first", "words"), ["node", "first"]).select("node", "n", "m", "place", F.inline("words"))
        told = told.groupBy("node", "n", "word").agg(
            F.sum(F.when(F.col("inside"), F.col("m"))).alias("c"), F.sum(F.when(F.col("titled"), F.col("m"))).alias("t"), F.min(F.when(F.col("titled"), F.col("place"))).alias("place"), F.first("weight").alias("weight")
        )
        size = F.least("n", F.lit(POOL))
        share = F.col("c") / size
        score = share * (1 - share) + 0.18 * share * F.col("weight") + 0.8 * F.coalesce("t", F.lit(0)) / size
        good = F.col("c").isNotNull() & (F.length("word") >= 3) & ~F.col("word").rlike(r"^\p{Nd}+$")
        late = F.col("place").isNotNull() & (F.col("n") <= FEW)
        told = told.groupBy("node").agg(
            F.min(F.when(late, F.struct("place", (-F.col("weight")).alias("at"), "word")))["word"].alias("titled"), F.min(F.when(good, F.struct((-F.round(score, 9)).alias("at"), "word")))["word"].alias("split")
        )
        guess = F.when(F.col("alive"), F.coalesce(opener, "titled", "split", F.get(F.array_except(spare, "guessed"), F.lit(0))))
        asked = staged(nodes.join(told, "node", "left").select("node", "n", "guessed", "counts", guess.alias("guess")), "asked")

        at = F.get("words", F.array_position(F.col("words.word"), F.col("guess")).cast("int") - 1)  # the guess among the kind's words, or null
        met = state.join(asked, "node").withColumn("at", at).withColumn("hit", F.coalesce("at.inside", F.lit(False))).withColumn("named", F.col("hit") & F.coalesce("at.titled", F.lit(False)))
        ends = F.col("player") & (F.col("solved") | F.col("guess").isNull())
        gain = F.when(F.col("hit"), F.col("at.weight") * F.when(F.col("named"), 3.5).otherwise(1.0)).otherwise(0.0)
        left = F.col("need") - F.col("named").cast("int")
        met = met.where(F.col("guess").isNotNull() | ends).select(
            "first", "pages", "firsts", F.when(F.col("at").isNull(), F.col("words")).otherwise(F.array_remove("words", F.col("at"))).alias("words"),
            F.when(F.col("guess").isNotNull(), F.concat("node", F.col("hit").cast("int").cast("string"))).alias("node"),
            (F.col("score") + gain).alias("score"), F.col("score").alias("was"), left.alias("need"), (F.col("player") & ~ends).alias("player"), ((left == 0) & F.col("named")).alias("solved"),
            F.when(ends, F.struct("guessed", "counts", "solved")).alias("fate"),
        )
        met = staged(met, "kinds")
        fates.append(met.where("fate is not null").select("first", "fate.*"))
        state = met.where("node is not null")
        sizes = state.groupBy("node").agg(F.sum("pages").alias("own"), F.max("player").alias("held"), F.max(F.col("player") & ~F.col("solved")).alias("alive")).where("held")
        sizes = sizes.withColumnRenamed("node", "_next").join(asked, F.expr("left(_next, length(_next) - 1)") == F.col("node"))
        n = F.when(F.col("own") > 0, F.col("own")).otherwise(F.col("n"))
        sizes = sizes.select(F.col("_next").alias("node"), n.alias("n"), "alive", F.array_append("guessed", F.col("guess")).alias("guessed"), F.array_append("counts", n.cast("int")).alias("counts"), (F.col("own") == 0).alias("ruled_out"))
        nodes = staged(sizes, "nodes")
        if outside:  # a page outside of the set can rule out every candidate; then all stay
            gone = nodes.where("ruled_out").select(F.concat(F.expr("left(node, length(node) - 1)"), F.lit("1")).alias("node"), F.col("node").alias("_to"))
            stay = state.where("pages > 0").join(gone, "node").withColumn("node", F.col("_to")).withColumn("score", F.col("was")).withColumn("player", F.lit(False)).withColumn("solved", F.lit(False))
            state = state.union(stay.select(*state.columns))
        if nodes.where("alive").isEmpty():
            break
    ended = state.where("player").join(nodes, "node").select("first", "guessed", "counts", "solved")
    for some in fates:
        ended = ended.union(some)
    log = F.arrays_zip(F.col("guessed").alias("guess"), F.col("counts").alias("candidates"))
    ended = staged(ended.select("first", log.alias("log"), "solved"), "ended")
    played = games.join(pages, "page_id").join(ended.join(kinds.select("first", "kind"), "first").select("kind", "log", "solved"), "kind").select("game_id", "log", "solved")
    if outside:
        played = played.union(games.join(pages, "page_id", "left_anti").crossJoin(F.broadcast(ended.where("first is null"))).select("game_id", "log", "solved"))  # one row
    rows = played.select("game_id", F.size("log").alias("_n"), "solved", F.posexplode("log").alias("_i", "_at"))
    return rows.select("game_id", (F.col("_i") + 1).alias("turn"), "_at.guess", "_at.candidates", (F.col("solved") & (F.col("_i") + 1 == F.col("_n"))).alias("solved"))
