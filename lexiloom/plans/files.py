"""Queries through files: tables written as the files that sources read, and read back by them, with SQL over the tables themselves."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiloom.functions import text as T
from lexiloom.operators.stage import scratch, staged
from lexiloom.plans import sql as S
from lexiloom.sources import lines, packed, readers


def _copy(rows, order, form="json", **options):
    path = scratch(rows.sparkSession, "files")
    lines.write_in_order(rows, path, order, form, **options)
    return path


def _page_lines(spark, sf):
    """Documents as lines of pages, by doc_id: every fifth has an id of its own, some have their text under another name or not at all."""
    d = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id is not null")
    k, text = F.col("doc_id"), F.col("text")
    title = F.array_join(T.first_words(text, 2), " ")
    return d.select(
        "doc_id", F.when(k % 5 == 0, k + 1_000_000_000).alias("id"), F.when(k % 11 != 3, title).alias("title"), F.when(k % 3 == 0, text).alias("intro"), F.when(k % 3 == 1, text).alias("summary"),
        F.when((k % 3 == 2) & (k % 7 != 5), text).alias("text"),
    )


def pages_in_file_order(spark, sf):
    pages = readers.read_pages_tolerant(spark, _copy(_page_lines(spark, sf), ["doc_id"]))
    return pages.select("page_id", "title", F.md5("intro").alias("intro_md5"))


def page_line_faults(spark, sf):
    rows = _page_lines(spark, sf).select("doc_id", "title", "intro")
    path = _copy(rows, ["doc_id"])
    checked = readers.page_faults(spark, path).join(lines.numbered_lines(spark, path), ["file", "line_no"])
    return checked.select("position", "fault")


def qids_by_line(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet").select(F.concat(F.lit("Q"), "c_custkey").alias("qid"), F.coalesce("c_acctbal", F.lit(0.0)).alias("score"), (-F.coalesce("c_acctbal", F.lit(0.0))).alias("down"), "c_custkey")
    path = _copy(c, ["down", "c_custkey"], "csv", header="true", compression="gzip")
    return readers.read_qids(spark, path, 1000)


def first_vectors_by_line(spark, sf):
    """Vectors under 300 shared names: the first line of a name counts."""
    e = spark.read.parquet(f"{sf}/embeddings.parquet").where("embedding is not null")
    word = F.concat(F.lit("mot"), F.col("vec_id") * 7919 % 300)
    size = e.select(F.size("embedding")).first()[0]
    rows = e.select("vec_id", F.concat_ws(" ", word, F.concat_ws(" ", F.transform("embedding", lambda x: x.cast("string")))).alias("value"))
    vocabulary = e.select(word.alias("word")).where(F.col("vec_id") % 2 == 0)
    found = readers.read_vectors(spark, _copy(rows, ["vec_id"], "text"), vocabulary, size)
    return found.select("word", F.posexplode("vec").alias("i", "x")).select("word", "i", F.round("x", 5).alias("x"))


def packed_page_objects(spark, sf):
    """Documents packed as objects, and read back."""
    d = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id is not null").select("doc_id", "text", "lang")
    path = scratch(spark, "objects")
    packed.write_packed_objects(d, path, "doc_id")
    body = F.from_json("object", "text string, lang string")
    return packed.packed_objects(spark, path).select("page_id", F.md5(body["text"]).alias("text_md5"), body["lang"].alias("lang"))


def restored_words(spark, sf):
    """The documents' words are a dictionary, written and read as one; their accentless forms get accents back."""
    d = spark.read.parquet(f"{sf}/documents.parquet").where("text is not null")
    words = d.select(F.explode(T.token_texts(F.col("text"))).alias("w")).where(F.col("w").rlike(r"^\p{L}{2,}$")).select(F.lower("w").alias("w")).distinct()
    entries = words.select("w", F.concat("w", F.lit("/S")).alias("value"))
    dictionary = staged(readers.read_dictionary(spark, _copy(entries, ["w"], "text")), "dictionary")
    plain = dictionary.select(T.strip_accents(F.col("word")).alias("word")).distinct()
    none = spark.createDataFrame([("zz", "zzé")], "plain string, word string")
    return readers.restored(plain, readers.accent_restorer(dictionary), none)


QUERIES = {f.__name__: f for f in (pages_in_file_order, page_line_faults, qids_by_line, first_vectors_by_line, packed_page_objects, restored_words)}

_LINES = """l AS (SELECT doc_id AS k, row_number() OVER (ORDER BY doc_id) AS position, text, CASE WHEN doc_id % 11 <> 3 THEN array_to_string(list_slice(regexp_extract_all(text, '[^\\s]+'), 1, 2), ' ') END AS title FROM documents WHERE doc_id IS NOT NULL)"""
ORACLES = {
    "pages_in_file_order": f"WITH {_LINES}, g AS (SELECT *, row_number() OVER (ORDER BY k) AS n FROM l WHERE title <> '' AND text <> '' AND NOT (k % 3 = 2 AND k % 7 = 5)) SELECT CASE WHEN k % 5 = 0 THEN k + 1000000000 ELSE n END AS page_id, title, md5(text) AS intro_md5 FROM g",
    "page_line_faults": f"WITH {_LINES} SELECT position, 'missing required key ' || CASE WHEN title IS NULL THEN '''title''' ELSE '''intro''' END AS fault FROM l WHERE title IS NULL OR text IS NULL OR k % 3 <> 0",
    "packed_page_objects": "SELECT doc_id AS page_id, md5(text) AS text_md5, lang FROM documents WHERE doc_id IS NOT NULL",
    "restored_words": r"""WITH p AS (SELECT regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+|\s+') AS p FROM documents WHERE text IS NOT NULL), w AS (SELECT DISTINCT lower(x) AS word FROM (SELECT unnest(p) AS x FROM p) WHERE regexp_matches(x, '^\p{L}{2,}$')),
d AS (SELECT word FROM w UNION SELECT strip_accents(word) FROM w), r AS (SELECT strip_accents(word) AS plain, min(word) AS word FROM d WHERE strip_accents(word) <> word GROUP BY 1) SELECT q.word, CASE WHEN q.word = 'zz' THEN 'zzé' WHEN length(q.word) >= 4 THEN coalesce(r.word, q.word) ELSE q.word END AS restored FROM (SELECT DISTINCT strip_accents(word) AS word FROM d) q LEFT JOIN r ON r.plain = q.word""",
    "qids_by_line": "SELECT 'Q' || c_custkey AS qid, row_number() OVER (ORDER BY coalesce(c_acctbal, 0) DESC, c_custkey) AS rank FROM customer QUALIFY rank <= 1000",
    "first_vectors_by_line": """WITH v AS (SELECT 'mot' || (vec_id * 7919 % 300) AS word, vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL), f AS (SELECT word, arg_min(e, vec_id) AS e FROM v GROUP BY word HAVING bool_or(vec_id % 2 = 0)),
u AS (SELECT word, unnest(e) AS x, generate_subscripts(e, 1) - 1 AS i, sqrt(list_dot_product(e, e)) AS n FROM f) SELECT word, i::INT AS i, round(x / n, 5) AS x FROM u""",
}
ORACLES = {name: S.spelt(q) for name, q in ORACLES.items()}
