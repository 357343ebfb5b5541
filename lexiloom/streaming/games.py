"""Streams: incremental page ingestion, rewards by title, and live games as keyed state."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


from lexiloom.functions import text as T


def new_page_stream(pages: DataFrame, least_chars: int = 220) -> DataFrame:
    """Pages long enough, each title (by lower case) once; what has been seen is the query's checkpoint, so a restart goes on where it stopped."""
    keyed = pages.where(F.length("intro") >= least_chars).withColumn("key", F.lower("title"))
    return keyed.dropDuplicates(["key"]).drop("key")


class _Ema(StatefulProcessor):
    """The moving reward of a title; rows of a batch are taken in the order of `turn`."""

    def __init__(self, alpha: float):
        self.alpha = alpha

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("ema", "ema double")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        value = self.state.get()[0] if self.state.exists() else None
        for r in pd.concat(list(rows)).sort_values("turn")["reward"]:
            value = float(r) if value is None else self.alpha * float(r) + (1 - self.alpha) * value
        self.state.update((value,))
        yield pd.DataFrame({"title": [key[0]], "ema": [value]})

    def close(self) -> None:
        pass


def reward_ema_stream(steps: DataFrame, alpha: float = 0.2) -> DataFrame:
    """steps(title, turn, reward) -> title, ema after each batch."""
    return steps.groupBy("title").transformWithStateInPandas(_Ema(alpha), "title string, ema double", "Update", "None")


class _LiveGame(StatefulProcessor):
    """One game: its title words still hidden and the guesses so far. A finished game leaves its trajectory and its state."""

    def __init__(self, most_steps: int):
        self.most_steps = most_steps

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.game = handle.getValueState("game", "hidden array<string>, guesses array<string>")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        out = []
        held = self.game.get() if self.game.exists() else None
        hidden, guesses = (list(held[0]), list(held[1])) if held else (None, [])
        for _, row in pd.concat(list(rows)).sort_values("turn").iterrows():
            if hidden is None:
                hidden = [w for w in row["title_forms"].split(" ") if w]
            if row["guess_form"] in guesses:
                continue
            guesses.append(row["guess_form"])
            hidden = [w for w in hidden if w != row["guess_form"]]
            if not hidden or len(guesses) >= self.most_steps:
                out.append((key[0], not hidden, len(guesses), " ".join(guesses)))
                hidden, guesses = None, []
        if hidden is None:
            self.game.clear()
        else:
            self.game.update((hidden, guesses))
        yield pd.DataFrame(out, columns=["game_id", "solved", "steps", "guesses"])

    def close(self) -> None:
        pass


def live_games(guesses: DataFrame, most_steps: int = 30) -> DataFrame:
    """guesses(game_id, title, turn, guess), arriving in any batches -> game_id, solved, steps, guesses of every finished game. After a game's end the next guess of its id begins it anew."""
    title = F.array_join(F.array_distinct(T.canonical_words(F.col("title"))), " ")
    formed = guesses.select("game_id", "turn", title.alias("title_forms"), T.canonical_word(F.col("guess")).alias("guess_form"))
    return formed.groupBy("game_id").transformWithStateInPandas(_LiveGame(most_steps), "game_id long, solved boolean, steps int, guesses string", "Append", "None")


