"""Word vectors: similarities, centroid, merging, similarity joins, rank tables, inverted indexes, unknown words, soft labels.

vectors: word, vec (array of float, unit length).  Two paths give the same
numbers: native array functions, and for nearest words the cells of `nearest`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions import text as T
from lexiloom.operators.nearest import Cells, best_by_owner, best_in_groups, nearest


def dot(a: Column, b: Column) -> Column:
    """In double precision."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def unit(v: Column) -> Column:
    """v over its length; null if it has almost none."""
    length = F.sqrt(dot(v, v))
    return F.when(length >= 1e-9, F.transform(v, lambda x: x.cast("double") / length))


def clipped(similarity: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), similarity))


def mean_vectors(df: DataFrame, key: list[str], vec: str = "vec") -> DataFrame:
    """Mean vector per key, by coordinate: sums combine before the shuffle, and no list of vectors is gathered."""
    by_place = df.select(*key, F.posexplode(vec).alias("i", "x")).groupBy(*key, "i").agg(F.avg(F.col("x").cast("double")).alias("m"), F.count("*").alias("n"))
    return by_place.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("vec"), F.first("n").alias("n"))


def centroid(vectors: DataFrame) -> DataFrame:
    """One row: the unit-length mean."""
    return mean_vectors(vectors.withColumn("_one", F.lit(1)), ["_one"]).select(unit(F.col("vec")).alias("centroid"))


def background(vectors: DataFrame) -> DataFrame:
    """word, background: similarity to the centroid, clipped to 0..1."""
    return vectors.crossJoin(F.broadcast(centroid(vectors))).select("word", clipped(dot(F.col("vec"), F.col("centroid"))).alias("background"))


def pair_similarity(pairs: DataFrame, vectors: DataFrame, clip: bool = True) -> DataFrame:
    """pairs(l, r, and any other columns) with sim: 1 for equal words, 0 where a vector is missing, else the cosine."""
    a = vectors.select(F.col("word").alias("l"), F.col("vec").alias("_a"))
    b = vectors.select(F.col("word").alias("r"), F.col("vec").alias("_b"))
    s = dot(F.col("_a"), F.col("_b"))
    sim = F.when(F.col("l") == F.col("r"), F.lit(1.0)).when(F.col("_a").isNull() | F.col("_b").isNull(), F.lit(0.0)).otherwise(clipped(s) if clip else s)
    return pairs.join(a, "l", "left").join(b, "r", "left").select(*pairs.columns, sim.alias("sim"))


def nearest_of_page_words(vectors: DataFrame, page_words: DataFrame, k: int) -> DataFrame:
    """page_id, page_word, word, sim: the k vocabulary words most similar to each word of each page that has a vector (ties by word, 9 digits). A word is searched once however many pages have it."""
    asked = page_words.select("word").distinct().join(vectors.select("word", "vec"), "word")
    found, _ = nearest(Cells(vectors), asked, k)
    return page_words.select("page_id", F.col("word").alias("page_word")).join(found.select(F.col("query").alias("page_word"), "word", "sim"), "page_word").select("page_id", "page_word", "word", "sim")


def best_of_pages(vectors: DataFrame, page_words: DataFrame) -> DataFrame:
    """page_id, word, sim: a vocabulary word's greatest similarity to any word of the page, for every page and word."""
    owned = page_words.join(vectors.select("word", "vec"), "word").select(F.col("page_id").alias("owner"), "word", "vec")
    return best_by_owner(Cells(vectors), owned).withColumnRenamed("owner", "page_id")


def rank_table(vectors: DataFrame, page_words: DataFrame, n: int = 1000) -> DataFrame:
    """page_id, word, rank: vocabulary words by their best similarity to the page's words. A word among a page's n best is among the n best of the page word nearest to it, so only these are compared."""
    best = nearest_of_page_words(vectors, page_words, n).groupBy("page_id", "word").agg(F.max("sim").alias("sim"))
    order = Window.partitionBy("page_id").orderBy(F.desc(F.round("sim", 9)), "word")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select("page_id", "word", "rank")


def inverted_index(vectors: DataFrame, page_words: DataFrame, k: int = 500, least: float = 0.1) -> DataFrame:
    """page_id, word, page_word, sim (3 digits): per page word its k nearest vocabulary words that reach `least`."""
    top = nearest_of_page_words(vectors, page_words, k).where(F.col("sim") >= least)
    return top.groupBy("page_id", "word", "page_word").agg(F.round(F.max("sim"), 3).alias("sim"))


def max_similarity(vectors: DataFrame, page_words: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs(page_id, word) with `sim`: 1 if the page has the word, 0 if the word or all of the page's words have no vector, else the greatest cosine (not clipped)."""
    own = page_words.select("page_id", "word").distinct().withColumn("_own", F.lit(1.0))
    held = page_words.select(F.col("page_id").alias("owner"), "word").distinct().join(vectors.select("word", "vec"), "word").select("owner", "word", "vec")
    asked = pairs.select(F.col("page_id").alias("owner"), "word").distinct().join(vectors.select("word", "vec"), "word").select("owner", "word", "vec")
    near = best_in_groups(asked, held).select(F.col("owner").alias("page_id"), "word", F.col("sim").alias("_s"))
    joined = pairs.join(own, ["page_id", "word"], "left").join(near, ["page_id", "word"], "left")
    return joined.withColumn("sim", F.coalesce("_own", "_s", F.lit(0.0))).drop("_own", "_s")


def vector_model(vectors: DataFrame, pages: DataFrame) -> DataFrame:
    """word, vec (unit length) of the words that the pages' titles and intros use: content words, and the canonical form of the whole title. Vectors of no length are left out."""
    words = pages.select(F.explode(T.content_words(F.concat_ws(" ", "title", "intro"))).alias("word"))
    whole = pages.select(T.canonical_word(F.col("title")).alias("word")).where("word <> ''")
    used = vectors.join(words.union(whole).distinct(), "word", "left_semi")
    return used.select("word", unit(F.col("vec")).alias("vec")).where("vec is not null")


def augmented_model(vectors: DataFrame, article_words: DataFrame, least_articles: int = 3) -> DataFrame:
    """word, vec: the model and the vectors made for words that it doesn't have."""
    made = unknown_word_vectors(vectors, article_words, least_articles)
    return vectors.select("word", "vec").union(made.select("word", "vec"))


def merged_by_form(vectors: DataFrame, form: Column) -> DataFrame:
    """word, vec, n: words of the same form share the unit-length mean of their vectors."""
    merged = mean_vectors(vectors.select(form.alias("word"), "vec"), ["word"])
    return merged.select("word", unit(F.col("vec")).alias("vec"), "n").where("vec is not null")


def unknown_word_vectors(vectors: DataFrame, article_words: DataFrame, least_articles: int = 3) -> DataFrame:
    """word, vec, n: words without a vector that occur in enough articles get the unit-length mean of these articles' means (known words with their multiplicity). article_words(page_id, word), a row per occurrence."""
    means = mean_vectors(article_words.join(vectors, "word"), ["page_id"]).select("page_id", "vec")
    unknown = article_words.join(vectors.select("word"), "word", "left_anti").distinct()
    found = mean_vectors(unknown.join(means, "page_id"), ["word"])
    return found.where(F.col("n") >= least_articles).select("word", unit(F.col("vec")).alias("vec"), "n")


def nearest_words(vectors: DataFrame, targets: DataFrame, k: int, least: float) -> DataFrame:
    """l, r, sim, rank: per target(word) its k most similar other words with `least` or more."""
    near = nearest_of_page_words(vectors, targets.select(F.lit(0).alias("page_id"), "word").distinct(), k + 1).select(F.col("page_word").alias("l"), F.col("word").alias("r"), "sim")
    order = Window.partitionBy("l").orderBy(F.desc(F.round("sim", 9)), "r")
    return near.where((F.col("l") != F.col("r")) & (F.col("sim") >= least)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def soft_labels(nearest: DataFrame, first_token: DataFrame, alpha: float = 0.8) -> DataFrame:
    """Per target word l: token -> (1 - alpha) * one-hot + alpha * share, where a token weighs as the most similar word that begins with it (the target itself 1). first_token(word, token)."""
    own = nearest.select("l").distinct().select("l", F.col("l").alias("r"), F.lit(1.0).alias("sim"))
    every = own.union(nearest.select("l", "r", "sim")).join(first_token.withColumnRenamed("word", "r"), "r")
    weight = every.groupBy("l", "token").agg(F.max("sim").alias("w"), F.max((F.col("l") == F.col("r")).cast("int")).alias("own"))
    share = F.col("w") / F.sum("w").over(Window.partitionBy("l"))
    return weight.select("l", "token", ((1 - alpha) * F.col("own") + alpha * share).alias("p"))
