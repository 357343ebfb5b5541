"""Queries on word vectors, with their SQL. Vectors are the rows of `embeddings` (word 'w' || vec_id, page `label`)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiloom.operators import vectors as V

from lexiloom.plans import sql as S


def _vectors(spark, sf):
    return spark.read.parquet(f"{sf}/embeddings.parquet").where("embedding is not null").select(F.concat(F.lit("w"), "vec_id").alias("word"), F.col("embedding").alias("vec"), "label")


def _page_words(spark, sf):
    """Every vector's word belongs to the page of its label."""
    return _vectors(spark, sf).select(F.col("label").alias("page_id"), "word")


def vector_centroid(spark, sf):
    return V.centroid(_vectors(spark, sf)).select(F.posexplode("centroid").alias("i", "x")).select("i", F.round("x", 6).alias("x"))


def background_similarity(spark, sf):
    return V.background(_vectors(spark, sf)).select("word", F.round("background", 6).alias("background"))


def _pairs(spark, sf):
    w = _vectors(spark, sf).select(F.col("word").alias("l"), F.substring("word", 2, 9).cast("long").alias("i"))
    return w.select("l", F.explode(F.array(*[F.concat(F.lit("w"), F.col("i") + d) for d in (0, 1, 7, 1000)])).alias("r"))


def word_pair_cosine(spark, sf):
    return V.pair_similarity(_pairs(spark, sf), _vectors(spark, sf), clip=False).select("l", "r", F.round("sim", 6).alias("sim"))


def word_pair_cosine_clipped(spark, sf):
    return V.pair_similarity(_pairs(spark, sf), _vectors(spark, sf)).select("l", "r", F.round("sim", 6).alias("sim"))


def contrastive_similarity(spark, sf):
    v = _vectors(spark, sf)
    best = V.best_of_pages(v.select("word", "vec"), _page_words(spark, sf))
    return best.join(V.background(v), "word").select("page_id", "word", F.round(F.greatest(F.lit(0.0), F.col("sim") - F.col("background")), 6).alias("contrast"))


def max_similarity(spark, sf):
    v = _vectors(spark, sf)
    asked = v.select(F.explode(F.array(F.col("label"), (F.col("label") + 1) % 10, F.lit(99))).alias("page_id"), "word").union(v.select(F.col("label").alias("page_id"), F.lit("none").alias("word")).distinct())
    return V.max_similarity(v.select("word", "vec"), _page_words(spark, sf), asked).select("page_id", "word", F.round("sim", 6).alias("sim"))


def page_rank_table(spark, sf):
    return V.rank_table(_vectors(spark, sf).select("word", "vec"), _page_words(spark, sf), 100)


def similarity_inverted_index(spark, sf):
    return V.inverted_index(_vectors(spark, sf).select("word", "vec"), _page_words(spark, sf), 20, 0.1)


def normalized_vector_merge(spark, sf):
    form = F.concat(F.lit("g"), F.substring("word", 2, 9).cast("long") % 50)
    merged = V.merged_by_form(_vectors(spark, sf), form)
    return merged.select("word", "n", F.posexplode("vec").alias("i", "x")).select("word", "n", "i", F.round("x", 6).alias("x"))


def oov_vectors(spark, sf):
    v = _vectors(spark, sf)
    known = v.select(F.col("label").alias("page_id"), "word")
    unknown = v.select(F.col("label").alias("page_id"), F.concat(F.lit("u"), (F.substring("word", 2, 9).cast("long") * 7 % 23)).alias("word"))
    made = V.unknown_word_vectors(v.select("word", "vec"), known.union(unknown))
    return made.select("word", "n", F.posexplode("vec").alias("i", "x")).select("word", "n", "i", F.round("x", 6).alias("x"))


def _nearest(spark, sf):
    v = _vectors(spark, sf).select("word", "vec")
    return V.nearest_words(v, v, 5, 0.3)


def nearest_vector_words(spark, sf):
    return _nearest(spark, sf).select("l", "r", "rank", F.round("sim", 6).alias("sim"))


def soft_label_distribution(spark, sf):
    token = _vectors(spark, sf).select("word", (F.substring("word", 2, 9).cast("long") % 31).alias("token"))
    return V.soft_labels(_nearest(spark, sf), token).select("l", "token", F.round("p", 6).alias("p"))


def augmented_vectors(spark, sf):
    v = _vectors(spark, sf)
    known = v.select(F.col("label").alias("page_id"), "word")
    unknown = v.select(F.col("label").alias("page_id"), F.concat(F.lit("u"), (F.substring("word", 2, 9).cast("long") * 7 % 23)).alias("word"))
    model = V.augmented_model(v.select("word", "vec"), known.union(unknown))
    return model.select("word", F.round(F.element_at("vec", 1).cast("double"), 6).alias("first"), F.size("vec").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        vector_centroid, background_similarity, word_pair_cosine, word_pair_cosine_clipped, contrastive_similarity, page_rank_table, similarity_inverted_index,
        max_similarity, normalized_vector_merge, oov_vectors, augmented_vectors, nearest_vector_words, soft_label_distribution,
    )
}

_BASE = """v AS (SELECT 'w' || vec_id AS word, vec_id AS id, embedding::DOUBLE[] AS vec, label FROM embeddings WHERE embedding IS NOT NULL),
u AS (SELECT word, id, label, unnest(vec) AS x, generate_subscripts(vec, 1) - 1 AS i FROM v),
m AS (SELECT i, avg(x) AS x FROM u GROUP BY i), nm AS (SELECT sqrt(sum(x * x)) AS n FROM m),
c AS (SELECT list(x / n ORDER BY i) AS centroid FROM m, nm),
bg AS (SELECT word, greatest(0, least(1, list_dot_product(vec, centroid))) AS background FROM v, c),
pw AS (SELECT label AS page_id, word AS page_word, vec AS pv FROM v),
sims AS (SELECT page_id, word, page_word, list_dot_product(vec, pv) AS sim FROM v, pw)"""
_NEAR = """nr AS (SELECT page_word AS l, word AS r, sim, row_number() OVER (PARTITION BY page_word ORDER BY round(sim, 9) DESC, word) AS rank FROM sims WHERE page_word <> word AND sim >= 0.3), near AS (SELECT * FROM nr WHERE rank <= 5)"""
_COS = "q AS (SELECT word AS l, 'w' || (id + d) AS r FROM v, (SELECT unnest([0, 1, 7, 1000]) AS d)), s AS (SELECT q.l, q.r, a.vec AS a, b.vec AS b FROM q JOIN v a ON a.word = q.l LEFT JOIN v b ON b.word = q.r)"

ORACLES = {
    "vector_centroid": f"WITH {_BASE} SELECT i::INT AS i, round(x / n, 6) AS x FROM m, nm",
    "background_similarity": f"WITH {_BASE} SELECT word, round(background, 6) AS background FROM bg",
    "word_pair_cosine": f"WITH {_BASE}, {_COS} SELECT l, r, CASE WHEN l = r THEN 1.0::DOUBLE WHEN b IS NULL THEN 0.0 ELSE round(list_dot_product(a, b), 6) END AS sim FROM s",
    "word_pair_cosine_clipped": f"WITH {_BASE}, {_COS} SELECT l, r, CASE WHEN l = r THEN 1.0::DOUBLE WHEN b IS NULL THEN 0.0 ELSE round(greatest(0, least(1, list_dot_product(a, b))), 6) END AS sim FROM s",
    "contrastive_similarity": f"WITH {_BASE} SELECT page_id, word, round(greatest(0.0, max(sim) - any_value(background)), 6) AS contrast FROM sims JOIN bg USING (word) GROUP BY ALL",
    "max_similarity": f"WITH {_BASE}, a AS (SELECT word, unnest([label, (label + 1) % 10, 99]) AS page_id FROM v UNION ALL SELECT DISTINCT 'none', label FROM v), b AS (SELECT page_id, word, max(sim) AS s FROM sims GROUP BY ALL) SELECT a.page_id, a.word, round(CASE WHEN l.word IS NOT NULL THEN 1.0::DOUBLE ELSE coalesce(s, 0.0) END, 6) AS sim FROM a LEFT JOIN b ON b.page_id = a.page_id AND b.word = a.word LEFT JOIN v l ON l.word = a.word AND l.label = a.page_id",
    "page_rank_table": f"WITH {_BASE}, b AS (SELECT page_id, word, max(sim) AS s FROM sims GROUP BY ALL), r AS (SELECT page_id, word, row_number() OVER (PARTITION BY page_id ORDER BY round(s, 9) DESC, word)::INT AS rank FROM b) SELECT * FROM r WHERE rank <= 100",
    "similarity_inverted_index": f"WITH {_BASE}, r AS (SELECT *, row_number() OVER (PARTITION BY page_id, page_word ORDER BY round(sim, 9) DESC, word) AS k FROM sims) SELECT page_id, word, page_word, round(max(sim), 3) AS sim FROM r WHERE k <= 20 AND sim >= 0.1 GROUP BY ALL",
    "normalized_vector_merge": f"WITH {_BASE}, g AS (SELECT 'g' || (id % 50) AS word, i, avg(x) AS x, count(*) AS n FROM u GROUP BY ALL), l AS (SELECT word, sqrt(sum(x * x)) AS len FROM g GROUP BY word) SELECT word, n, i::INT AS i, round(x / len, 6) AS x FROM g JOIN l USING (word)",
    "oov_vectors": f"WITH {_BASE}, pm AS (SELECT label, i, avg(x) AS x FROM u GROUP BY ALL), uk AS (SELECT DISTINCT label, 'u' || (id * 7 % 23) AS word FROM v), g AS (SELECT word, i, avg(x) AS x, count(*) AS n FROM uk JOIN pm USING (label) GROUP BY ALL), l AS (SELECT word, sqrt(sum(x * x)) AS len FROM g GROUP BY word) SELECT word, n, i::INT AS i, round(x / len, 6) AS x FROM g JOIN l USING (word) WHERE n >= 3",
    "augmented_vectors": f"WITH {_BASE}, pm AS (SELECT label, i, avg(x) AS x FROM u GROUP BY ALL), uk AS (SELECT DISTINCT label, 'u' || (id * 7 % 23) AS word FROM v), g AS (SELECT word, i, avg(x) AS x, count(*) AS n FROM uk JOIN pm USING (label) GROUP BY ALL), l AS (SELECT word, sqrt(sum(x * x)) AS len, count(*)::INT AS d FROM g WHERE n >= 3 GROUP BY word) SELECT word, round(vec[1], 6) AS first, len(vec)::INT AS n FROM v UNION ALL SELECT word, round(x / len, 6), d FROM g JOIN l USING (word) WHERE i = 0 AND n >= 3",
    "nearest_vector_words": f"WITH {_BASE}, {_NEAR} SELECT l, r, rank::INT AS rank, round(sim, 6) AS sim FROM near",
    "soft_label_distribution": f"WITH {_BASE}, {_NEAR}, e AS (SELECT DISTINCT l, l AS r, 1.0::DOUBLE AS sim FROM near UNION ALL SELECT l, r, sim FROM near), t AS (SELECT l, substr(r, 2)::BIGINT % 31 AS token, max(sim) AS w, max((l = r)::INT) AS own FROM e GROUP BY ALL) SELECT l, token, round((1 - 0.8) * own + 0.8 * w / sum(w) OVER (PARTITION BY l), 6) AS p FROM t",
}
ORACLES = {name: S.spelt(q) for name, q in ORACLES.items()}
