"""Queries on rewards, histories, curricula and batch files, with their SQL.

A user's events, in the order of time and id, are a game: guess = event_type,
reward = value - 100, score = value (mod 100).
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexiloom.operators import corpus as C
from lexiloom.operators import datasets as D
from lexiloom.operators import game as G
from lexiloom.operators import lexical as L
from lexiloom.operators import policy as P
from lexiloom.operators.stage import staged

from lexiloom.plans import sql as S


def _steps(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").where("value is not null and user_id is not null")
    turn = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    v = F.col("value")
    return e.select(
        F.col("user_id").alias("game_id"), turn.alias("turn"), F.col("event_type").alias("guess"), F.round(v - 100, 4).alias("reward"), (F.floor(v) % 100).cast("int").alias("score"),
        (F.col("event_id") % 4 == 0).cast("int").alias("exact"), (F.col("event_id") % 30).cast("int").alias("semantic"), (F.col("event_id") % 3).cast("int").alias("title"),
        (F.col("event_id") % 50 == 0).alias("solved"), (F.col("event_id") % 11 == 0).alias("invalid"),
    )


def group_advantage(spark, sf):
    return P.group_advantages(_steps(spark, sf), ["game_id"], "reward").select("game_id", "turn", F.round("advantage", 6).alias("advantage"))


def reward_ema(spark, sf):
    return P.reward_ema(_steps(spark, sf), "game_id", ["turn"], "reward").select("game_id", F.round("ema", 6).alias("ema"))


def state_keys(spark, sf):
    return P.state_keys(_steps(spark, sf)).select("game_id", "turn", "state")


def prefix_histories(spark, sf):
    h = P.prefix_histories(_steps(spark, sf))
    return h.select("game_id", "turn", F.size("history").alias("n"), F.md5(F.array_join("history", ",")).alias("history_md5"))


def spiral_steps(spark, sf):
    return P.spirals(_steps(spark, sf), 4)


def training_log(spark, sf):
    updates = _steps(spark, sf).groupBy(F.col("game_id").alias("update")).agg(F.avg("reward").alias("reward"), F.max("solved").alias("solved"), F.count("*").alias("steps"))
    return P.training_log(updates, 25).select("block", *[F.round(c, 6).alias(c) for c in ("mean_reward", "solve_rate", "mean_steps")])


def evaluation_rollup(spark, sf):
    return P.evaluation(_steps(spark, sf)).select("games", F.round("solve_rate", 6).alias("solve_rate"), F.round("mean_steps", 6).alias("mean_steps"), F.col("repeated").cast("long").alias("repeated"), F.col("invalid").cast("long").alias("invalid"))


def opening_words(spark, sf):
    return P.opening_words(_steps(spark, sf))


def trend_hints(spark, sf):
    return P.trend_hint(_steps(spark, sf))


def step_rewards(spark, sf):
    r = P.step_reward(F.col("solved"), F.col("exact"), F.col("title"), F.col("semantic"))
    return _steps(spark, sf).select("game_id", "turn", F.round(r, 4).alias("r"))


def warm_stop_states(spark, sf):
    return D.warm_stops(_steps(spark, sf)).select("game_id", "turn")


def curriculum_rows(spark, sf):
    rows = D.curriculum_rows(_steps(spark, sf), 100, "Mots")
    return rows.select("game_id", "turn", F.md5("prompt").alias("prompt_md5"), "completion", F.json_array_length("history").alias("n_history"))


def title_oversampling(spark, sf):
    rows = D.oversampled(_steps(spark, sf), F.col("title") == 2)
    return rows.groupBy("title").agg(F.count("*").alias("n"))


def end_marked_completions(spark, sf):
    c = spark.read.parquet(f"{sf}/conversations.parquet").where("text is not null")
    once = D.with_end_mark(c.select("conv_id", "turn", F.col("text").alias("completion")), "<eos>")
    return D.with_end_mark(once, "<eos>").select("conv_id", "turn", F.md5("completion").alias("completion_md5"))


def _batch_results(spark, sf, real=None):
    c = spark.read.parquet(f"{sf}/conversations.parquet").where("text is not null")
    states = c.where("turn % 2 = 0").select(F.concat_ws("-", "conv_id", "turn").alias("custom_id"), F.col("conv_id").alias("game_id"))
    message = F.struct(F.concat(F.lit("MOT: "), "text").alias("content"))
    response = F.struct(F.struct(F.array(F.struct(message.alias("message"))).alias("choices")).alias("body"))
    results = c.select(F.to_json(F.struct(F.concat_ws("-", "conv_id", "turn").alias("custom_id"), response.alias("response"))).alias("value"))
    return D.batch_results(states, results, real)


def batch_result_guesses(spark, sf):
    return _batch_results(spark, sf)


def best_actions(spark, sf):
    """A game's next action by its mean reward, then by a prior, among those that its first two guesses weren't."""
    steps = _steps(spark, sf)
    q = P.stepped_means(steps.select("game_id", F.col("guess").alias("action"), "reward"), ["game_id", "action"], "reward", 50, "value")
    words = steps.select(F.col("guess").alias("word")).distinct()
    vocabulary = C.global_rank(words, [F.asc("word")], "pos").select("pos", "word")
    priors = words.where("length(word) > 4").select("word", (F.length("word") % 3).cast("double").alias("prior"))
    return P.best_action(q, priors, vocabulary, steps.where("turn <= 2"))


def softmax_choice(spark, sf):
    return P.gumbel_choice(_steps(spark, sf), ["game_id"], "reward", "turn", 5, 0.0, 1).select("game_id", "turn", "guess")


def softmax_draws(spark, sf):
    """Among a game's five best steps, at temperature 0.7, by uniform numbers of the rows' own."""
    u = ((F.col("turn") * 7919 + F.col("game_id") * 104_729) % 100_003 + 0.5) / 100_003
    return P.gumbel_choice(_steps(spark, sf), ["game_id"], "reward", "turn", 5, 0.7, 1, u).select("game_id", "turn", "guess")


def weighted_draws(spark, sf):
    """Every event draws a part, likelier the greater its size."""
    items = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", F.col("p_size").cast("long").alias("size"))
    draws = spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_id").alias("draw"), (F.col("event_id") * 7919 % 100_003 / 100_003).alias("u"))
    return P.weighted_draws(items, draws, "p_partkey", "size")


def weighted_curriculum_sample(spark, sf):
    ema = P.reward_ema(_steps(spark, sf), "game_id", ["turn"], "reward").withColumn("w", P.curriculum_weight(F.col("ema")))
    return P.weighted_sample(ema, "w", "game_id", 50, 3)


def page_sample(spark, sf):
    return C.sample_pages(C.pages_of_documents(spark.read.parquet(f"{sf}/documents.parquet")), 100, 7, 40).select("page_id", "title")


def _games(spark, sf):
    pages = C.pages_of_documents(spark.read.parquet(f"{sf}/documents.parquet"))
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("text is not null")
    idf = L.smoothed_idf(L.vocabulary(L.page_words(docs, "doc_id", "text")), docs.count()).select("word", "idf")
    return G.page_tokens(pages), staged(idf, "idf")


def probe_words(spark, sf):
    tokens, idf = _games(spark, sf)
    return D.probe_words(tokens, idf, 5).select("game_id", "word", "rank")


def closed_set_solver(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").alias("page_id"), F.col("p_brand").alias("title"), F.col("p_name").alias("intro"))
    tokens = G.page_tokens(p).where("is_word").groupBy(F.col("game_id").alias("page_id"), F.col("canon").alias("word")).agg(F.max("in_title").alias("in_title"))
    tokens = staged(tokens, "tokens")
    body, head = tokens.select("page_id", "word"), tokens.where("in_title").select("page_id", "word")
    idf = L.smoothed_idf(L.document_frequency(body), p.count())
    return D.solve_closed_set(p.select(F.col("page_id").alias("game_id"), "page_id"), body, head, idf, ["steel", "small"], 20)


QUERIES = {
    f.__name__: f
    for f in (
        group_advantage, reward_ema, state_keys, prefix_histories, spiral_steps, training_log, evaluation_rollup, opening_words, trend_hints, step_rewards, warm_stop_states, curriculum_rows,
        title_oversampling, end_marked_completions, batch_result_guesses, best_actions, softmax_choice, softmax_draws, weighted_draws, weighted_curriculum_sample, page_sample, probe_words, closed_set_solver,
    )
}

_S = """s AS (SELECT user_id AS game_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INT AS turn, event_type AS guess, round(value - 100, 4) AS reward, (floor(value)::BIGINT % 100)::INT AS score, (event_id % 4 = 0)::INT AS exact, (event_id % 30)::INT AS semantic, (event_id % 3)::INT AS title, event_id % 50 = 0 AS solved, event_id % 11 = 0 AS invalid FROM events WHERE value IS NOT NULL AND user_id IS NOT NULL)"""


def _bin(x: str, cuts: list[int]) -> str:
    return "CASE " + " ".join(f"WHEN {x} <= {c} THEN '{i}'" for i, c in enumerate(cuts)) + f" ELSE '{len(cuts)}' END"


_KEY = f"guess || ':' || {_bin('exact', [0, 1, 2, 5])} || ':' || {_bin('semantic', [0, 3, 10, 25])} || ':' || {_bin('title', [0, 1, 2])}"
ORACLES = {
    "group_advantage": f"WITH {_S}, a AS (SELECT *, avg(reward) OVER w AS m, coalesce(nullif(stddev_samp(reward) OVER w, 0), 1) AS d FROM s WINDOW w AS (PARTITION BY game_id)) SELECT game_id, turn, round(greatest(-3, least(3, (reward - m) / d)), 6) AS advantage FROM a",
    "reward_ema": f"WITH {_S}, p AS (SELECT *, count(*) OVER (PARTITION BY game_id) AS n FROM s) SELECT game_id, round(sum(reward * pow(0.8, n - turn) * CASE WHEN turn = 1 THEN 1 ELSE 0.2 END), 6) AS ema FROM p GROUP BY game_id",
    "state_keys": f"WITH {_S}, k AS (SELECT game_id, turn, {_KEY} AS key FROM s) SELECT game_id, turn, coalesce(nullif(string_agg(key, '|') OVER (PARTITION BY game_id ORDER BY turn ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING), ''), 'START') AS state FROM k",
    "prefix_histories": f"WITH {_S} SELECT game_id, turn, turn - 1 AS n, md5(coalesce(string_agg(guess, ',') OVER (PARTITION BY game_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '')) AS history_md5 FROM s",
    "spiral_steps": f"WITH {_S}, b AS (SELECT game_id, turn, max(reward) OVER w < 0 AND count(*) OVER w = 4 AS bad FROM s WINDOW w AS (PARTITION BY game_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)) SELECT game_id, turn FROM b WHERE bad",
    "training_log": f"WITH {_S}, u AS (SELECT game_id AS up, avg(reward) AS reward, max(solved::INT) AS solved, count(*) AS steps FROM s GROUP BY game_id) SELECT ceil(up / 25)::BIGINT AS block, round(avg(reward), 6) AS mean_reward, round(avg(solved), 6) AS solve_rate, round(avg(steps), 6) AS mean_steps FROM u GROUP BY 1",
    "evaluation_rollup": f"WITH {_S}, m AS (SELECT *, row_number() OVER (PARTITION BY game_id, guess ORDER BY turn) > 1 AS rep FROM s), g AS (SELECT max(turn) AS n, max(solved::INT) AS s, sum(rep::INT) AS r, sum(invalid::INT) AS i FROM m GROUP BY game_id) SELECT count(*) AS games, round(avg(s), 6) AS solve_rate, round(avg(n), 6) AS mean_steps, sum(r)::BIGINT AS repeated, sum(i)::BIGINT AS invalid FROM g",
    "opening_words": f"WITH {_S} SELECT guess, count(*) AS n FROM s WHERE turn <= 10 GROUP BY guess ORDER BY n DESC, guess LIMIT 25",
    "trend_hints": f"WITH {_S}, m AS (SELECT *, CASE WHEN exact = 0 THEN score END AS miss FROM s), h AS (SELECT game_id, turn, avg(miss) OVER (PARTITION BY game_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS a, max(miss) OVER (PARTITION BY game_id ORDER BY turn) AS b FROM m) SELECT game_id, turn, CASE WHEN turn < 3 OR a IS NULL THEN 'none' WHEN a < 45 AND b < 55 THEN 'pivot' WHEN b >= 60 AND a < b - 20 THEN 'lost' WHEN a >= 55 THEN 'warm' ELSE 'none' END AS hint FROM h",
    "step_rewards": f"WITH {_S} SELECT game_id, turn, round(CASE WHEN solved THEN 120 ELSE least(8, exact) * 1.2 + least(4, title) * 10 + least(25, semantic) * 0.04 - 1 END::DOUBLE, 4) AS r FROM s",
    "warm_stop_states": f"WITH {_S} SELECT game_id, turn FROM s WHERE turn - 1 IN (0, 3, 6, 10, 15, 20)",
    "title_oversampling": f"WITH {_S} SELECT title, sum(CASE WHEN title = 2 THEN 3 ELSE 1 END)::BIGINT AS n FROM s GROUP BY title",
    "end_marked_completions": "SELECT conv_id, turn, md5(CASE WHEN ends_with(text, '<eos>') THEN text ELSE text || '<eos>' END) AS completion_md5 FROM conversations WHERE text IS NOT NULL",
    "best_actions": f"WITH {_S}, q AS (SELECT game_id, guess AS action, floor(avg(reward) / 50) AS value FROM s GROUP BY ALL), v AS (SELECT guess AS action, row_number() OVER (ORDER BY guess) AS pos, CASE WHEN length(guess) > 4 THEN length(guess) % 3 ELSE 0 END AS prior FROM (SELECT DISTINCT guess FROM s)) SELECT game_id, action FROM q JOIN v USING (action) WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.game_id = q.game_id AND s.guess = q.action AND turn <= 2) QUALIFY row_number() OVER (PARTITION BY game_id ORDER BY value DESC, prior DESC, pos) = 1",
    "softmax_draws": f"WITH {_S}, r AS (SELECT *, row_number() OVER (PARTITION BY game_id ORDER BY reward DESC, turn) AS k FROM s), n AS (SELECT *, max(reward) OVER w AS hi, min(reward) OVER w AS lo FROM r WHERE k <= 5 WINDOW w AS (PARTITION BY game_id)) SELECT game_id, turn, guess FROM n QUALIFY row_number() OVER (PARTITION BY game_id ORDER BY CASE WHEN hi > lo THEN (reward - lo) / (hi - lo) ELSE 0 END / 0.7 - ln(-ln(((turn * 7919 + game_id * 104729) % 100003 + 0.5) / 100003)) DESC, turn) = 1",
    "weighted_draws": "WITH l AS (SELECT p_partkey, sum(p_size) OVER (ORDER BY p_partkey) - p_size AS f, sum(p_size) OVER () AS w FROM part WHERE p_size > 0), d AS (SELECT event_id AS draw, (event_id * 7919 % 100003) / 100003 * (SELECT max(w) FROM l) AS spot FROM events WHERE event_id IS NOT NULL) SELECT draw, p_partkey FROM d ASOF JOIN l ON d.spot >= l.f",
    "softmax_choice": f"WITH {_S}, r AS (SELECT game_id, turn, guess, row_number() OVER (PARTITION BY game_id ORDER BY reward DESC, turn) AS k FROM s) SELECT game_id, turn, guess FROM r WHERE k = 1",
}
ORACLES = {name: S.spelt(q) for name, q in ORACLES.items()}
