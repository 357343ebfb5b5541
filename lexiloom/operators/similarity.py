"""Sources of word similarity behind one interface, and the choice among them.

A source is asked for pairs and answers them; nothing needs a whole similarity
matrix.  What a game needs is worked out first (the forms of its guesses against the
forms of its page) and asked for in the game's own rows: they are read past a
vocabulary that goes to every task, so neither the pairs nor the vocabulary's
neighbours of every guess are dealt out again.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.operators import lexical as L
from lexiloom.operators import vectors as V


class SimilaritySource(Protocol):
    def similarity(self, pairs: DataFrame) -> DataFrame:
        """pairs(l, r, and any other columns) -> these with sim (0 to 1; 1 for equal words, 0 for what the source doesn't know)."""
        ...

    def known(self) -> DataFrame | None:
        """l, r of all pairs of different words whose sim may not be 0; None where any pair's may be."""
        ...


@dataclass(frozen=True)
class TableSource:
    """Similarities given as a table (l, r, sim); both directions count."""

    table: DataFrame

    def similarity(self, pairs: DataFrame) -> DataFrame:
        both = self.table.select("l", "r", "sim").union(self.table.select(F.col("r").alias("l"), F.col("l").alias("r"), "sim")).groupBy("l", "r").agg(F.max("sim").alias("sim"))
        same = F.when(F.col("l") == F.col("r"), F.lit(1.0))
        return pairs.join(both, ["l", "r"], "left").select(*pairs.columns, F.coalesce(same, F.col("sim").cast("double"), F.lit(0.0)).alias("sim"))

    def known(self) -> DataFrame:
        return _both(self.table)


@dataclass(frozen=True)
class LexicalSource:
    """Co-occurrence: a word's neighbours (word, other, score), else those that have it as theirs. idf and starters come with it."""

    neighbours: DataFrame
    idf: DataFrame | None = None
    starters: DataFrame | None = None

    def similarity(self, pairs: DataFrame) -> DataFrame:
        return L.local_similarity(pairs, self.neighbours)

    def known(self) -> DataFrame:
        return _both(self.neighbours.select(F.col("word").alias("l"), F.col("other").alias("r")))


@dataclass(frozen=True)
class DenseSource:
    """Cosine of word vectors (word, vec of unit length), clipped to 0..1. idf and starters are borrowed from a lexical model."""

    vectors: DataFrame
    idf: DataFrame | None = None
    starters: DataFrame | None = None

    def similarity(self, pairs: DataFrame) -> DataFrame:
        return V.pair_similarity(pairs, self.vectors)

    def known(self) -> None:
        return None


@dataclass(frozen=True)
class BackgroundSource:
    """Another source's similarity less how near the left word is to every word (word, background), at least 0. Equal words stay 1."""

    inner: SimilaritySource
    background: DataFrame

    def similarity(self, pairs: DataFrame) -> DataFrame:
        b = self.background.select(F.col("word").alias("l"), F.col("background").alias("_b"))
        left = self.inner.similarity(pairs).join(b, "l", "left")
        contrast = F.greatest(F.lit(0.0), F.col("sim") - F.coalesce("_b", F.lit(0.0)))
        return left.select(*pairs.columns, F.when(F.col("l") == F.col("r"), F.lit(1.0)).otherwise(contrast).alias("sim"))

    def known(self) -> DataFrame | None:
        pairs = known_pairs(self.inner)
        less = pairs is None or self.background.where("background < 0").limit(1).count()  # these come nearer than the inner source says
        return None if less else pairs


def _both(pairs: DataFrame) -> DataFrame:
    return pairs.select("l", "r").union(pairs.select(F.col("r").alias("l"), F.col("l").alias("r")))


def chosen(lexical: LexicalSource, vectors: DataFrame | None) -> SimilaritySource:
    """Dense where there are vectors, with the lexical model's idf and starters; else the lexical model."""
    return lexical if vectors is None else DenseSource(vectors, lexical.idf, lexical.starters)


def loaded(spark: SparkSession, path: str) -> SimilaritySource:
    """The source that a model folder gives: its vectors if it has any (`vectors`), else its neighbours."""
    idf, near, starters = (spark.read.parquet(f"{path}/{name}") for name in ("idf", "neighbours", "starters"))
    try:
        vectors = spark.read.parquet(f"{path}/vectors")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        vectors = None
    return chosen(LexicalSource(near, idf, starters), vectors)


def scored(source: SimilaritySource | DataFrame, rows: DataFrame) -> DataFrame:
    """rows(l, r, ...) with `sim`, 0 where nothing is known. A table of similarities (l, r, sim) is read as it is; a source knows nothing of empty words."""
    if isinstance(source, DataFrame):
        table = source.groupBy("l", "r").agg(F.max("sim").cast("double").alias("sim"))
        return rows.join(table, ["l", "r"], "left").select(*rows.columns, F.coalesce("sim", F.lit(0.0)).alias("sim"))
    found = source.similarity(rows)
    asked = (F.col("l") != F.col("r")) & (F.col("l") != "") & (F.col("r") != "")
    return found.withColumn("sim", F.when(asked, F.col("sim")).otherwise(F.lit(0.0)))


def known_pairs(source: SimilaritySource | DataFrame) -> DataFrame | None:
    """l, r of the pairs of different words that `scored` may find alike; None where that may be any."""
    if isinstance(source, DataFrame):
        return source.select("l", "r")
    known = getattr(source, "known", None)  # a source need not know
    return known() if known else None
