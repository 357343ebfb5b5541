"""Rewards, advantages, curricula, state keys, action masks and tabular policies as windows and aggregates.

steps: game_id, turn, ... in long form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiloom.operators.corpus import running_total
from lexiloom.operators.stage import staged

def step_reward(solved: Column, exact: Column, title: Column, semantic: Column) -> Column:
    hits = F.least(F.lit(8), exact) * 1.2 + F.least(F.lit(4), title) * 10.0 + F.least(F.lit(25), semantic) * 0.04
    return F.when(solved, F.lit(120.0)).otherwise(hits - 1.0)


def group_advantages(df: DataFrame, group: list[str], reward: str, clip: float | None = 3.0, floor: float | None = None) -> DataFrame:
    """(reward - mean) / sample deviation of its group. A deviation of zero (or of a single row) counts as 1, or with `floor` as that."""
    w = Window.partitionBy(*group)
    deviation = F.coalesce(F.stddev_samp(reward).over(w), F.lit(0.0))
    deviation = F.when(deviation == 0, F.lit(1.0)).otherwise(deviation) if floor is None else F.greatest(deviation, F.lit(floor))
    a = (F.col(reward) - F.avg(reward).over(w)) / deviation
    return df.withColumn("advantage", F.greatest(F.lit(-clip), F.least(F.lit(clip), a)) if clip else a)


def reward_ema(df: DataFrame, key: str, order: list[str], reward: str, alpha: float = 0.2) -> DataFrame:
    """key, ema: the first reward starts, then alpha of each new one is mixed in.

    An EMA is a weighted sum: the i-th last of n rewards weighs alpha (1 - alpha)^i,
    the first (1 - alpha)^(n-1). As a sum it combines before the shuffle of its
    aggregate and needs no list per key.
    """
    up = Window.partitionBy(key).orderBy(*order)
    total = Window.partitionBy(key)
    placed = df.withColumn("_i", F.row_number().over(up)).withColumn("_n", F.count("*").over(total))
    weight = F.pow(F.lit(1 - alpha), F.col("_n") - F.col("_i")) * F.when(F.col("_i") == 1, F.lit(1.0)).otherwise(F.lit(alpha))
    return placed.groupBy(key).agg(F.sum(F.col(reward) * weight).alias("ema"))


def curriculum_weight(ema: Column, low: float = -80.0, high: float = 20.0, weight: float = 4.0) -> Column:
    """Games in the window of reachable rewards are drawn `weight` times as often as others and unknown ones."""
    return F.when(ema.between(low, high), F.lit(weight)).otherwise(F.lit(1.0))


def weighted_sample(df: DataFrame, weight: str, key: str, n: int, seed: int) -> DataFrame:
    """n rows without replacement, likelier the greater their weight: the least -ln(u) / weight, u from the seeded hash of the key."""
    u = (F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return df.withColumn("_k", -F.log(u) / F.col(weight)).orderBy("_k", key).limit(n).drop("_k")


def seeded_draws(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """draw, u: n numbers in [0, 1) from a seeded hash, the same however they are partitioned."""
    return spark.range(n).select(F.col("id").alias("draw"), (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 52)) / float(1 << 52)).alias("u"))


def weighted_draws(items: DataFrame, draws: DataFrame, key: str, weight: str, cells: int = 65_536) -> DataFrame:
    """draw, key: with replacement, every draw(draw, u) one of items(key, weight), likelier the greater its weight.

    Items lie end to end on a line, in the order of their keys, each as long as its
    weight; a draw takes the item at u times the whole length.  The line's sums come
    from range partitions; draws meet items by cells of the line, so that neither the
    items nor the draws are in one task: an item lies in the cells that it covers, a
    draw in one.  Items without a weight over 0, or without a key, are never drawn; keys are unique.
    """
    good = items.where((F.col(weight) > 0) & F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(weight).alias("_w"))
    line = staged(running_total(good, ["key"], "_w", "_to").withColumn("_from", F.col("_to") - F.col("_w")), "line")
    length = line.agg(F.max("_to").cast("double").alias("m")).first()["m"] or 0.0
    of_cell = lambda c: F.least(F.floor(c / length * cells), F.lit(cells - 1)).cast("int")
    laid = line.withColumn("_cell", F.explode(F.sequence(of_cell(F.col("_from")), of_cell(F.col("_to")))))
    asked = draws.select("draw", (F.col("u") * length).alias("_at")).withColumn("_cell", of_cell(F.col("_at")))
    return asked.join(laid, "_cell").where((F.col("_at") >= F.col("_from")) & (F.col("_at") < F.col("_to"))).select("draw", F.col("key").alias(key))


def binned(value: Column, cuts: list[int]) -> Column:
    """Index of the first cut that is not less."""
    out = F.when(value <= cuts[0], "0")
    for i, cut in enumerate(cuts[1:], 1):
        out = out.when(value <= cut, str(i))
    return out.otherwise(str(len(cuts)))


def state_keys(steps: DataFrame, most: int = 8) -> DataFrame:
    """steps with `state`: the last `most` earlier steps as guess:exact:semantic:title bins, or START."""
    one = F.concat_ws(":", "guess", binned(F.col("exact"), [0, 1, 2, 5]), binned(F.col("semantic"), [0, 3, 10, 25]), binned(F.col("title"), [0, 1, 2]))
    w = Window.partitionBy("game_id").orderBy("turn").rowsBetween(-most, -1)
    state = F.array_join(F.collect_list("_s").over(w), "|")
    return steps.withColumn("_s", one).withColumn("state", state).withColumn("state", F.when(F.col("state") == "", "START").otherwise(F.col("state"))).drop("_s")


def prefix_histories(steps: DataFrame) -> DataFrame:
    """game_id, turn, history: the guesses before each step."""
    w = Window.partitionBy("game_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return steps.select("game_id", "turn", F.collect_list("guess").over(w).alias("history"))


def spirals(steps: DataFrame, threshold: int) -> DataFrame:
    """game_id, turn of the steps at which the last `threshold` rewards are all negative."""
    w = Window.partitionBy("game_id").orderBy("turn").rowsBetween(-(threshold - 1), 0)
    bad = (F.max("reward").over(w) < 0) & (F.count("*").over(w) == threshold)
    return steps.withColumn("_b", bad).where("_b").select("game_id", "turn")


def training_log(updates: DataFrame, every: int) -> DataFrame:
    """Means over each `every` updates: block, mean_reward, solve_rate, mean_steps."""
    return updates.groupBy(F.ceil(F.col("update") / every).alias("block")).agg(F.avg("reward").alias("mean_reward"), F.avg(F.col("solved").cast("int")).alias("solve_rate"), F.avg("steps").alias("mean_steps"))


def evaluation(steps: DataFrame) -> DataFrame:
    """One row: games, solve_rate, mean_steps, repeated, invalid. steps: game_id, turn, guess, solved, invalid."""
    seen = Window.partitionBy("game_id", "guess").orderBy("turn")
    marked = steps.withColumn("_rep", F.row_number().over(seen) > 1)
    games = marked.groupBy("game_id").agg(F.max("turn").alias("n"), F.max(F.col("solved").cast("int")).alias("s"), F.sum(F.col("_rep").cast("int")).alias("r"), F.sum(F.col("invalid").cast("int")).alias("i"))
    return games.agg(F.count("*").alias("games"), F.avg("s").alias("solve_rate"), F.avg("n").alias("mean_steps"), F.sum("r").alias("repeated"), F.sum("i").alias("invalid"))


def evaluation_report(steps: DataFrame, choices: DataFrame) -> DataFrame:
    """evaluation() with what the choice of guesses refused: rejected_repeated, rejected_invalid, and how often it fell back on a word of its own. choices: game_id, fallback, rejected_invalid, rejected_repeated."""
    refused = choices.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("rejected_repeated", "rejected_invalid")], F.coalesce(F.sum(F.col("fallback").cast("long")), F.lit(0)).alias("fallbacks"))
    return evaluation(steps).join(F.broadcast(refused), F.lit(True))  # one row and one


def opening_words(steps: DataFrame, first: int = 10, n: int = 25) -> DataFrame:
    return steps.where(F.col("turn") <= first).groupBy("guess").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "guess").limit(n)


def trend_hint(steps: DataFrame) -> DataFrame:
    """game_id, turn, hint after each step: pivot, lost, warm or none, from the last four scores that weren't exact against the best."""
    upto = Window.partitionBy("game_id").orderBy("turn")
    last = upto.rowsBetween(-3, 0)
    miss = F.when(F.col("exact") == 0, F.col("score"))
    s = steps.withColumn("_n", F.row_number().over(upto)).withColumn("_avg", F.avg(miss).over(last)).withColumn("_best", F.max(miss).over(upto))
    hint = (
        F.when((F.col("_n") < 3) | F.col("_avg").isNull(), F.lit("none"))
        .when((F.col("_avg") < 45) & (F.col("_best") < 55), F.lit("pivot"))
        .when((F.col("_best") >= 60) & (F.col("_avg") < F.col("_best") - 20), F.lit("lost"))
        .when(F.col("_avg") >= 55, F.lit("warm"))
        .otherwise(F.lit("none"))
    )
    return s.select("game_id", "turn", hint.alias("hint"))


def gumbel_choice(candidates: DataFrame, group: list[str], reward: str, key: str, k: int, temperature: float, seed: int, uniform: Column | None = None) -> DataFrame:
    """One candidate per group, drawn by a softmax over the k best min-max normalised rewards (Gumbel-max on a seeded hash, or on `uniform` numbers in (0, 1) of the rows' own). Temperature 0: the best, ties by key."""
    order = Window.partitionBy(*group).orderBy(F.desc(reward), key)
    top = candidates.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k)
    w = Window.partitionBy(*group)
    span = F.max(reward).over(w) - F.min(reward).over(w)
    norm = F.when(span > 0, (F.col(reward) - F.min(reward).over(w)) / span).otherwise(F.lit(0.0))
    u = (F.pmod(F.xxhash64(*group, key, F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52) if uniform is None else uniform
    score = norm / temperature - F.log(-F.log(u)) if temperature > 0 else -F.col("_r").cast("double")
    pick = Window.partitionBy(*group).orderBy(F.desc("_s"), key)
    return top.withColumn("_s", score).withColumn("_p", F.row_number().over(pick)).where("_p = 1").drop("_r", "_s", "_p")


def stepped_means(df: DataFrame, key: list[str], amount: str, step: int, name: str, digits: int = 4) -> DataFrame:
    """key, name: the mean of amounts of at most `digits` digits in whole steps, rounded down. Sums are of whole numbers: a mean that lies on a step doesn't depend on the order in which rows come."""
    unit = F.round(F.col(amount) * 10**digits).try_cast("long")
    sums = df.groupBy(*key).agg(F.try_sum(unit).alias("_s"), F.count(unit).alias("_k"), F.count(amount).alias("_n"), F.avg(amount).alias("_m"))
    width = F.col("_n") * (step * 10**digits)
    exact = (F.col("_s") - F.pmod("_s", width)) / width
    return sums.select(*key, F.when((F.col("_k") == F.col("_n")) & F.col("_s").isNotNull(), F.floor(exact)).otherwise(F.floor(F.col("_m") / step)).alias(name))  # else: no numbers, or no whole ones


def best_action(q: DataFrame, priors: DataFrame, vocabulary: DataFrame, guessed: DataFrame) -> DataFrame:
    """game_id, action: by value, then prior, then vocabulary order, among actions that the game has not guessed. q(game_id, action, value); vocabulary(pos, word)."""
    actions = vocabulary.join(priors, "word", "left").select(F.col("word").alias("action"), "pos", F.coalesce("prior", F.lit(0.0)).alias("prior"))
    own = q.join(actions, "action").select("game_id", "action", "value", "prior", "pos")
    free = own.join(guessed.select("game_id", F.col("guess").alias("action")).distinct(), ["game_id", "action"], "left_anti")
    order = Window.partitionBy("game_id").orderBy(F.desc("value"), F.desc("prior"), "pos")
    return free.withColumn("_r", F.row_number().over(order)).where("_r = 1").select("game_id", "action")


def q_update(q: DataFrame, transitions: DataFrame, rate: float = 0.1, discount: float = 0.9, keep: int = 40) -> DataFrame:
    """One synchronous round of Q-learning: transitions(state, action, reward, next_state); the `keep` best actions of a state stay. q(state, action, value)."""
    future = q.groupBy(F.col("state").alias("next_state")).agg(F.greatest(F.lit(0.0), F.max("value")).alias("f"))
    target = transitions.join(future, "next_state", "left").groupBy("state", "action").agg(F.avg(F.col("reward") + discount * F.coalesce("f", F.lit(0.0))).alias("t"))
    merged = q.join(target, ["state", "action"], "full").select("state", "action", F.when(F.col("t").isNull(), F.col("value")).otherwise(F.coalesce("value", F.lit(0.0)) + rate * (F.col("t") - F.coalesce("value", F.lit(0.0)))).alias("value"))
    order = Window.partitionBy("state").orderBy(F.desc("value"), "action")
    return merged.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= keep).drop("_r")


def policy_update(logits: DataFrame, rollouts: DataFrame, rate: float = 0.1, clip: float = 8.0) -> DataFrame:
    """One round of the group-relative policy update: rollouts(group, state, action, reward), logits(state, action, logit) within +-clip."""
    step = group_advantages(rollouts, ["group"], "reward").groupBy("state", "action").agg(F.sum("advantage").alias("d"))
    moved = F.coalesce("logit", F.lit(0.0)) + rate * F.coalesce("d", F.lit(0.0))
    return logits.join(step, ["state", "action"], "full").select("state", "action", F.greatest(F.lit(-clip), F.least(F.lit(clip), moved)).alias("logit"))


def allowed_actions(rows: DataFrame, vocabulary: DataFrame, guessed: DataFrame) -> DataFrame:
    """row_id, word: the vocabulary without the row's guesses, as an anti join against the vocabulary of bounded size. rows(row_id, game_id)."""
    every = rows.crossJoin(F.broadcast(vocabulary.select("word")))
    return every.join(guessed.select("game_id", F.col("guess").alias("word")).distinct(), ["game_id", "word"], "left_anti").select("row_id", "word")
