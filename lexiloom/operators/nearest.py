"""Exact nearest vectors by cells around pivots.

Vectors are dealt to the nearest of some pivots (a hashed choice among themselves);
a cell knows its radius r.  For a query q and a cell around p no vector of the cell
has a dot product over q.p + |q| r.  A query first searches the cells nearest to it
that hold k vectors together, which gives it a k-th best; then it searches only the
cells whose bound reaches that.  Both searches meet in cogroups of a piece of a cell
and a piece of its queries, each of bounded size, so neither a large cell nor one
that all queries want is a hot group, and no vectors pass through the driver but the
pivots.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, isqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.operators.stage import staged

#: Most pivots (they go to every task), and rows of a piece of a cell and of a piece of its queries.
MOST_PIVOTS, CELL_ROWS, QUERY_ROWS = 1024, 4096, 2048
#: Where nothing can be skipped: rows of a piece on either side.
BLOCK_ROWS = 16_384
#: Similarities are compared by so many digits, ties by word.
DIGITS = 9


def _matrix(vecs: pd.Series, dims: int) -> np.ndarray:
    return np.array(vecs.tolist(), np.float64).reshape(len(vecs), dims)


def _bounds(x: np.ndarray, pivots: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """Per row and cell what no dot product exceeds; a little is added for rounding."""
    return x @ pivots.T + np.sqrt((x * x).sum(1))[:, None] * radius + 10.0**-DIGITS


class Cells:
    """Vectors dealt to cells; made once for any number of searches."""

    def __init__(self, vectors: DataFrame, pivots: int | None = None):
        self.spark = vectors.sparkSession
        rows = vectors.select("word", F.col("vec").cast("array<double>").alias("vec")).where("vec is not null")
        # A query travels once a cell that it can't skip, so large tables have cells of CELL_ROWS rows, not of the root of their rows.
        n = rows.count()
        n = pivots or max(1, min(MOST_PIVOTS, isqrt(n), max(32, ceil(n / CELL_ROWS))))
        chosen = rows.orderBy(F.xxhash64("word"), "word").limit(n).collect()  # at most MOST_PIVOTS rows
        self.dims = len(chosen[0]["vec"]) if chosen else 0
        self.pivots = np.array([r["vec"] for r in chosen], np.float64).reshape(len(chosen), self.dims)
        centres, dims = self.pivots, self.dims

        def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                x = _matrix(batch["vec"], dims)
                square = (x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)
                cell = square.argmin(1)
                yield batch.assign(cell=cell, away=np.sqrt(((x - centres[cell]) ** 2).sum(1)))

        self.dealt = staged(rows.mapInPandas(deal, "word string, vec array<double>, cell int, away double"), "cells") if chosen else rows.selectExpr("word", "vec", "0 as cell", "0D as away")
        sizes = {r["cell"]: r for r in self.dealt.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("r")).collect()}  # a row per pivot
        self.n = np.array([sizes[c]["n"] if c in sizes else 0 for c in range(len(chosen))], np.int64)
        self.radius = np.array([sizes[c]["r"] if c in sizes else 0.0 for c in range(len(chosen))])

    def wanted(self, queries: DataFrame, k: int) -> DataFrame:
        """queries(word, vec) -> word, vec, cells: the nearest cells that hold k vectors together."""
        pivots, n, dims = self.pivots, self.n, self.dims

        def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                near = np.argsort(-(_matrix(batch["vec"], dims) @ pivots.T), axis=1, kind="stable")
                enough = np.cumsum(n[near], axis=1) - n[near] < k
                yield batch[["word", "vec"]].assign(cells=[row[some] for row, some in zip(near, enough & (n[near] > 0), strict=True)])

        return queries.mapInPandas(choose, "word string, vec array<double>, cells array<int>")

    def reachable(self, queries: DataFrame) -> DataFrame:
        """queries(word, vec, least, had: cells already searched) -> word, vec, least, cells: the cells in which a similarity of `least` or more (null: any) can be."""
        pivots, radius, n, dims = self.pivots, self.radius, self.n, self.dims

        def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                least = batch["least"].fillna(-np.inf).to_numpy(np.float64)
                open_ = (_bounds(_matrix(batch["vec"], dims), pivots, radius) >= least[:, None]) & (n > 0)
                for i, had in enumerate(batch["had"]):
                    open_[i, list(had)] = False
                yield batch[["word", "vec", "least"]].assign(cells=[np.flatnonzero(row) for row in open_])

        return queries.mapInPandas(choose, "word string, vec array<double>, least double, cells array<int>")

    def pieces(self, wanted: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
        """wanted(..., cell) and the vectors, both by (cell, part, qpart): every wanting row meets every vector of its cell once, in groups of bounded size."""
        asked = {r["cell"]: r["n"] for r in wanted.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # a row per pivot
        rows = [(c, max(1, ceil(int(self.n[c]) / CELL_ROWS)), max(1, ceil(n / QUERY_ROWS))) for c, n in asked.items()]
        plan = F.broadcast(self.spark.createDataFrame(rows, "cell int, parts int, qparts int"))
        left = wanted.join(plan, "cell").withColumn("qpart", F.pmod(F.xxhash64(*key), "qparts").cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts", "qparts")
        right = self.dealt.drop("away").join(plan, "cell").withColumn("part", F.pmod(F.xxhash64("word"), "parts").cast("int")).withColumn("qpart", F.explode(F.sequence(F.lit(0), F.col("qparts") - 1))).drop("parts", "qparts")
        return left, right

    def search(self, wanted: DataFrame, k: int) -> DataFrame:
        """wanted(word, vec, least, cell) -> query, word, sim: of each piece of a cell the k best that reach `least`, with all ties of the k-th by digits cut by word."""
        left, right = self.pieces(wanted, ["word"])
        dims = self.dims

        def best(queries: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
            if not len(queries) or not len(vectors):
                return pd.DataFrame({"query": np.zeros(0, object), "word": np.zeros(0, object), "sim": np.zeros(0)})
            names = vectors["word"].to_numpy().astype(str)
            own = _matrix(vectors["vec"], dims)
            keep, out = min(k, len(names)), []
            asked, least = _matrix(queries["vec"], dims), queries["least"].fillna(-np.inf).to_numpy(np.float64)
            for at in range(0, len(queries), 64):
                sims = asked[at : at + 64] @ own.T
                digits = np.round(sims, DIGITS)
                for i in np.flatnonzero(digits.max(axis=1) >= least[at : at + 64]):
                    row = digits[i]
                    bar = max(np.partition(row, len(row) - keep)[len(row) - keep], least[at + i])
                    near = np.flatnonzero(row >= bar)
                    near = near[np.lexsort((names[near], -row[near]))[:keep]]
                    out.append((at + i, near, sims[i, near]))
            if not out:
                return pd.DataFrame({"query": np.zeros(0, object), "word": np.zeros(0, object), "sim": np.zeros(0)})
            n = [len(near) for _, near, _ in out]
            words = queries["word"].to_numpy()
            return pd.DataFrame({"query": np.repeat(words[[i for i, *_ in out]], n), "word": names[np.concatenate([near for _, near, _ in out])], "sim": np.concatenate([s for *_, s in out])})

        groups = ["cell", "part", "qpart"]
        return left.groupBy(*groups).cogroup(right.groupBy(*groups)).applyInPandas(best, "query string, word string, sim double")


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc(F.round("sim", DIGITS)), "word")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(cells: Cells, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """queries(word, vec), each word once -> (query, word, sim, rank: the k vectors most similar to each, ties by word) and (word, cell: what was searched, the other cells were skipped)."""
    queries = staged(queries.select("word", F.col("vec").cast("array<double>").alias("vec")), "queries")
    if not len(cells.n):
        return queries.selectExpr("word as query", "word", "0D as sim", "0 as rank").where("false"), queries.selectExpr("word", "0 as cell").where("false")
    first = staged(cells.wanted(queries, k), "first-cells")
    each = lambda df: df.withColumn("cell", F.explode("cells")).drop("cells")
    hits = staged(_ranked(cells.search(each(first).withColumn("least", F.lit(None).cast("double")), k), k), "first-hits")
    bar = hits.where(F.col("rank") == k).select(F.col("query").alias("word"), F.round("sim", DIGITS).alias("least"))
    more = staged(cells.reachable(first.withColumnRenamed("cells", "had").join(bar, "word", "left").select("word", "vec", "least", "had")), "more-cells")
    every = hits.drop("rank").union(cells.search(each(more), k))
    return _ranked(every, k), each(first).select("word", "cell").union(each(more).select("word", "cell"))


def best_in_groups(asked: DataFrame, own: DataFrame) -> DataFrame:
    """asked(owner, word, vec), own(owner, word, vec) -> owner, word, sim: the greatest similarity of each asked vector to any that its owner has; no row where it has none.

    Both sides of an owner are cut in pieces of BLOCK_ROWS; every piece of one meets every piece of the other in a task of its own.
    """
    cut = lambda n: F.ceil(F.col(n) / BLOCK_ROWS).cast("int")
    sizes = asked.groupBy("owner").agg(F.count("*").alias("_a")).join(own.groupBy("owner").agg(F.count("*").alias("_o")), "owner")
    plan = staged(sizes.select("owner", cut("_a").alias("qparts"), cut("_o").alias("parts")), "pieces")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    fresh = lambda *names: [F.col(c).alias(c) for c in names]  # noqa: E731  # both sides may be of one table
    left = asked.join(plan, "owner").withColumn("qpart", F.pmod(F.xxhash64("word"), "qparts").cast("int")).withColumn("part", every("parts")).select(*fresh("owner", "part", "qpart", "word", "vec"))
    right = own.join(plan, "owner").withColumn("part", F.pmod(F.xxhash64("word"), "parts").cast("int")).withColumn("qpart", every("qparts")).select(*fresh("owner", "part", "qpart", "vec"))

    def best(queries: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(vectors):
            return queries[["owner", "word"]][:0].assign(sim=0.0)
        has = np.array(vectors["vec"].tolist(), np.float64).T
        x = np.array(queries["vec"].tolist(), np.float64)
        sims = [(x[at : at + 256] @ has).max(axis=1) for at in range(0, len(x), 256)]
        return pd.DataFrame({"owner": queries["owner"], "word": queries["word"], "sim": np.concatenate(sims)})

    groups = ["owner", "part", "qpart"]
    found = left.groupBy(*groups).cogroup(right.groupBy(*groups)).applyInPandas(best, f"owner {dict(asked.dtypes)['owner']}, word string, sim double")
    return found.groupBy("owner", "word").agg(F.max("sim").alias("sim"))


def best_by_owner(cells: Cells, owned: DataFrame) -> DataFrame:
    """owned(owner, word, vec) -> owner, word, sim: every vector's greatest similarity to any of an owner's words. Every owner and vector gives a row, so nothing can be skipped; a piece sends one row per owner and vector."""
    dims = cells.dims
    wanted = staged(owned.select("owner", F.col("word").alias("_w"), F.col("vec").cast("array<double>").alias("vec")), "owned")
    parts, qparts = (max(1, ceil(n / BLOCK_ROWS)) for n in (int(cells.n.sum()), wanted.count()))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = wanted.withColumn("qpart", F.pmod(F.xxhash64("owner", "_w"), F.lit(qparts)).cast("int")).withColumn("part", every(parts))
    right = cells.dealt.select("word", "vec").withColumn("part", F.pmod(F.xxhash64("word"), F.lit(parts)).cast("int")).withColumn("qpart", every(qparts))

    def best(rows: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(vectors):
            return pd.DataFrame({"owner": [], "word": [], "sim": []})
        own, words, parts = _matrix(vectors["vec"], dims), vectors["word"].to_numpy(), []
        for owner, group in rows.groupby("owner", sort=False):
            parts.append((owner, (_matrix(group["vec"], dims) @ own.T).max(axis=0)))
        return pd.DataFrame({"owner": np.repeat([o for o, _ in parts], len(words)), "word": np.tile(words, len(parts)), "sim": np.concatenate([s for _, s in parts])})

    groups = ["part", "qpart"]
    found = left.groupBy(*groups).cogroup(right.groupBy(*groups)).applyInPandas(best, f"owner {dict(wanted.dtypes)['owner']}, word string, sim double")
    return found.groupBy("owner", "word").agg(F.max("sim").alias("sim"))
