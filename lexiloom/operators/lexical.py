"""The lexical model: document frequencies, smoothed IDF, co-occurrence neighbours, starter words, action space."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions import text as T
from lexiloom.functions import words as W
from lexiloom.operators.stage import spread, staged

MAX_VOCABULARY, MAX_NEIGHBOURS = 5000, 25
#: Up to so many words a task counts all their pairs in one table (32 MB), by the product of some pages' table of words (16 MB) with itself; pairs held before they are counted (32 MB).
DENSE_WORDS, DENSE_PAGES, HELD_PAIRS = 2048, 2048, 4_000_000
#: Texts that are read as strings at once; words that a task counts before it gives their counts away.
TEXTS, HELD_WORDS = 256, 500_000


def page_words(pages: DataFrame, page_id: str, text: str) -> DataFrame:
    """page_id, pos, word: the content words of a page, once each."""
    return spread(pages.select(page_id, text)).select(F.col(page_id).alias("page_id"), F.posexplode_outer(T.content_words(F.col(text))).alias("pos", "word")).where("word is not null")  # outer: else a filter works the words out a second time


def canonical_counts(parts: DataFrame) -> DataFrame:
    """canon, n of all tokens (part). Equal tokens are counted first, so a form is worked out once, not at every place."""
    counts = parts.groupBy("part").agg(F.count("*").alias("n")).withColumn("norm", T.normalize_word(F.col("part")))
    forms = counts.where(T.is_word(F.col("norm"))).select(T.canonical_of_normal(F.col("norm")).alias("canon"), "n")
    return forms.where("canon <> ''").groupBy("canon").agg(F.sum("n").alias("n"))


def document_frequency(words: DataFrame) -> DataFrame:
    return words.groupBy("word").agg(F.count("*").alias("df"))


def smoothed_idf(df: DataFrame, n_pages: int) -> DataFrame:
    n = max(1, n_pages)
    return df.withColumn("idf", F.log((F.lit(1.0) + n) / (F.lit(1.0) + F.col("df"))) + 1)


def vocabulary(words: DataFrame, most: int = MAX_VOCABULARY) -> DataFrame:
    """The most frequent words (ties by word), at most `most` rows: small enough to send to every task."""
    return document_frequency(words).orderBy(F.desc("df"), "word").limit(most)


def counted_vocabulary(texts: DataFrame, most: int = MAX_VOCABULARY) -> DataFrame:
    """word, df, idf: smoothed_idf of the vocabulary of a table's only column. Words are counted where the texts lie, so no text's words travel; null texts don't count."""
    letters = W.letters(texts.sparkSession)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forms, total = W.forms_of(letters), Counter()
        given = lambda: pa.record_batch([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
        for batch in batches:
            for at in range(0, len(batch), TEXTS):
                for text in batch.column(0).slice(at, TEXTS).to_pylist():
                    if text is not None:
                        total.update(forms.contents(text))
                        total[""] += 1  # the texts
                if len(total) >= HELD_WORDS:
                    yield given()
                    total.clear()
        yield given()

    df = staged(spread(texts).mapInArrow(counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("df")), "counts")
    pages = df.where("word = ''").first()
    return smoothed_idf(df.where("word <> ''").orderBy(F.desc("df"), "word").limit(most), pages["df"] if pages else 0)


def word_lists(pages: DataFrame, page_id: str, text: str) -> DataFrame:
    """page_id, words: a row per page with its content words as a list; none for null."""
    letters = W.letters(pages.sparkSession)

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forms = W.forms_of(letters)
        for batch in batches:
            for at in range(0, len(batch), TEXTS):
                rows = batch.slice(at, TEXTS)
                yield pa.record_batch([rows.column(0), pa.array([forms.contents(t) for t in rows.column(1).to_pylist()], pa.list_(pa.string()))], ["page_id", "words"])

    rows = spread(pages.select(F.col(page_id).alias("page_id"), F.col(text).alias("text")))
    return rows.mapInArrow(lists, f"page_id {dict(rows.dtypes)['page_id']}, words array<string>")


def pair_counts(words: DataFrame, vocab: DataFrame, per_page: int | None = None) -> DataFrame:
    """l < r and the number of pages with both. words: page_id, word; or a row per page with its words as a list (`words`).

    A page takes part with all its vocabulary words, or the `per_page` alphabetically first. Words are numbers of the
    vocabulary (which is bounded, and goes to every task) and pairs are counted where the page lies: no pair travels
    by itself, and a task holds the counts of a small vocabulary's pairs, else of some millions of pairs.
    """
    spark = words.sparkSession
    known = [r["word"] for r in vocab.select("word").distinct().orderBy("word").collect()]
    size = len(known)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size), np.int64) if size <= DENSE_WORDS else None
        held, n_held = [], 0

        def rows(codes: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            for at in range(0, len(codes), 1 << 20):
                c = codes[at : at + (1 << 20)]
                yield pa.record_batch([pa.array(c // size, pa.int32()), pa.array(c % size, pa.int32()), pa.array(n[at : at + (1 << 20)], pa.int64())], ["l", "r", "n"])

        def emptied() -> Iterator[pa.RecordBatch]:
            nonlocal n_held
            if held:
                yield from rows(*np.unique(np.concatenate(held), return_counts=True))
            held.clear()
            n_held = 0

        for batch in batches:
            lists = batch.column(0)
            flat = pc.list_flatten(lists)
            at = pc.fill_null(pc.index_in(flat, pa.array(known, flat.type)), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            page = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
            own = np.unique((page * size + at)[at >= 0])  # by page, then alphabet
            pages, ids = own // max(1, size), own % max(1, size)
            starts = np.flatnonzero(np.diff(pages, prepend=-1))
            if per_page is not None:
                few = np.arange(len(own)) - np.repeat(starts, np.diff(np.append(starts, len(own)))) < per_page
                pages, ids = pages[few], ids[few]
                starts = np.flatnonzero(np.diff(pages, prepend=-1))
            if total is not None:
                _, nth = np.unique(pages, return_inverse=True)
                for a in range(0, len(starts), DENSE_PAGES):
                    n = min(DENSE_PAGES, len(starts) - a)
                    own = slice(starts[a], np.append(starts, len(ids))[a + n])
                    has = np.zeros((n, size), np.float32)  # whole numbers stay exact
                    has[nth[own] - a, ids[own]] = 1
                    total += (has.T @ has).astype(np.int64)
                continue
            for a, b in zip(starts, np.append(starts, len(ids))[1:], strict=True):  # no start: no page has a word
                for i in range(a, b - 1):  # a word with those behind it
                    held.append(ids[i] * size + ids[i + 1 : b])
                    n_held += b - i + 15  # and what an array takes
                    if n_held >= HELD_PAIRS:
                        yield from emptied()
        yield from emptied()
        if total is not None:
            total = np.triu(total, 1).ravel()
            codes = np.flatnonzero(total)
            yield from rows(codes, total[codes])

    if "words" not in words.columns:
        words = words.join(F.broadcast(vocab.select("word")), "word", "left_semi").groupBy("page_id").agg(F.collect_set("word").alias("words"))
    pairs = words.select("words").mapInArrow(counts, "l int, r int, n long").groupBy("l", "r").agg(F.sum("n").alias("n"))
    names = spark.createDataFrame(list(enumerate(known)), "i int, w string")
    left, right = (F.broadcast(names.select(F.col("i").alias(c), F.col("w").alias(f"_{c}"))) for c in ("l", "r"))
    return staged(pairs.join(left, "l").join(right, "r").select(F.col("_l").alias("l"), F.col("_r").alias("r"), "n"), "pairs")


def neighbours(pairs: DataFrame, idf: DataFrame, most: int = MAX_NEIGHBOURS) -> DataFrame:
    """word, other, rank, score: co-occurrence weighted by both IDFs, over the word's greatest, 4 digits."""
    i = F.broadcast(idf.select("word", "idf"))  # of the bounded vocabulary
    left = pairs.join(i.withColumnsRenamed({"word": "l", "idf": "il"}), "l").join(i.withColumnsRenamed({"word": "r", "idf": "ir"}), "r")
    weight = left.select("l", "r", (F.col("n") * F.col("il") * F.col("ir")).alias("w"))
    both = weight.select(F.col("l").alias("word"), F.col("r").alias("other"), "w").union(weight.select(F.col("r").alias("word"), F.col("l").alias("other"), "w"))
    ranked = Window.partitionBy("word").orderBy(F.desc(F.round("w", 9)), "other")
    top = both.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= most)
    greatest = F.max("w").over(Window.partitionBy("word"))
    return top.select("word", "other", "rank", F.round(F.col("w") / greatest, 4).alias("score"))


def local_similarity(pairs: DataFrame, model: DataFrame) -> DataFrame:
    """pairs(l, r, and any other columns) with sim: 1 for equal words, else the neighbour score forwards, else backwards, else 0."""
    f = model.select(F.col("word").alias("l"), F.col("other").alias("r"), F.col("score").alias("f"))
    b = model.select(F.col("word").alias("r"), F.col("other").alias("l"), F.col("score").alias("b"))
    found = pairs.join(f, ["l", "r"], "left").join(b, ["l", "r"], "left")
    return found.select(*pairs.columns, F.when(F.col("l") == F.col("r"), F.lit(1.0)).otherwise(F.coalesce("f", "b", F.lit(0.0))).alias("sim"))


def starter_words(vocab_idf: DataFrame, most: int = 200) -> DataFrame:
    good = (F.length("word") >= 3) & ~F.col("word").isin(*T.STOPWORDS) & ~F.col("word").rlike("^[0-9]+$")
    return vocab_idf.where(good).orderBy(F.desc("df"), "word").limit(most)


def action_priors(pages: DataFrame) -> DataFrame:
    """word, prior: 4 p(1-p) + 1.2 share of titles + 1 for theme words; theme words that no page has get 0.5. pages: page_id, title, intro."""
    n = F.broadcast(pages.agg(F.greatest(F.count("*"), F.lit(1)).alias("n_pages")))
    full = spread(pages.select("page_id", "title", "intro")).select("page_id", F.explode_outer(T.content_words(F.concat("title", F.lit("\n\n"), "intro"))).alias("word")).where("word is not null")
    titles = pages.select("page_id", F.explode(T.word_set(F.col("title"))).alias("word")).groupBy("word").agg(F.count("*").alias("tf"))
    good = (F.length("word") >= 3) & ~F.col("word").rlike(r"^\p{Nd}+$") & ~F.col("word").isin(*T.STOPWORDS)
    found = document_frequency(full).where(good).join(titles, "word", "left").crossJoin(n)  # one row
    p = F.col("df") / F.col("n_pages")
    priors = found.select("word", (4 * p * (1 - p) + 1.2 * F.coalesce("tf", F.lit(0)) / F.col("n_pages") + F.col("word").isin(*T.THEME_SEEDS).cast("int")).alias("prior"))
    priors = staged(priors, "priors")  # of distinct words: the pages are read once, however often priors are
    seeds = pages.sparkSession.createDataFrame([(w, 0.5) for w in T.THEME_SEEDS], "word string, prior double")
    return priors.union(seeds.join(priors.where(F.col("word").isin(*T.THEME_SEEDS)), "word", "left_anti"))


def action_vocabulary(pages: DataFrame, most: int) -> DataFrame:
    """pos, word: theme words, then frequent title words (a third of `most`, fifty at least), then words by prior; each once, `most` in all."""
    priors = staged(action_priors(pages), "priors")
    titles = pages.select("page_id", F.explode(T.word_set(F.col("title"))).alias("word")).groupBy("word").agg(F.count("*").alias("tf"))
    by_title = titles.join(priors, "word").where((F.length("word") >= 3) & ~F.col("word").isin(*T.STOPWORDS)).orderBy(F.desc("tf"), "word").limit(max(50, most // 3))
    by_prior = priors.orderBy(F.desc(F.round("prior", 9)), "word").limit(most)
    seeds = pages.sparkSession.createDataFrame([(0, i, w) for i, w in enumerate(T.THEME_SEEDS)], "source int, at long, word string")

    def placed(df: DataFrame, source: int, order: list) -> DataFrame:  # at most `most` rows
        return df.select(F.lit(source).alias("source"), (F.row_number().over(Window.orderBy(*order)) - 1).cast("long").alias("at"), "word")

    every = seeds.union(placed(by_title, 1, [F.desc("tf"), "word"])).union(placed(by_prior, 2, [F.desc(F.round("prior", 9)), "word"]))
    first = every.groupBy("word").agg(F.min(F.struct("source", "at")).alias("m"))
    ranked = first.withColumn("pos", F.row_number().over(Window.orderBy("m.source", "m.at")))
    return ranked.where(F.col("pos") <= most).select("pos", "word")
