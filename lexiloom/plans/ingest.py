"""Queries on the resumed ingest of landed responses, with their SQL: documents are pages, twenty to a response, by doc_id."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiloom.functions import text as T
from lexiloom.operators.stage import scratch
from lexiloom.plans import sql as S
from lexiloom.sources.lines import write_in_order
from lexiloom.streaming import ingest as I


def _landed(spark, sf, limit=None):
    """Half of the responses lands and is taken; then the rest lands and the query is started anew on its checkpoint."""
    d = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id is not null")
    top = scratch(spark, "ingest")
    title = F.coalesce(F.array_join(T.first_words(F.col("text"), 2), " "), F.lit("none"))
    page = F.struct(title.alias("title"), F.col("text").alias("extract"), F.concat(F.lit("u/"), "doc_id").alias("fullurl"), F.when(F.col("doc_id") % 13 == 7, F.lit("")).alias("missing"))
    pages = F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", page.alias("p")))), lambda x: F.struct(x["doc_id"].cast("string"), x["p"])))
    responses = d.groupBy(F.floor(F.col("doc_id") / 20).alias("response")).agg(pages.alias("pages")).select("response", F.to_json(F.struct(F.struct("pages").alias("query"))).alias("value"))
    for part in ("a", "b"):
        write_in_order(responses.where(F.pmod(F.col("response") / 8, F.lit(2)) < 1 if part == "a" else F.pmod(F.col("response") / 8, F.lit(2)) >= 1), f"{top}/landed/{part}", ["response"], "text")
        I.ingest(I.landed_responses(spark, f"{top}/landed/*"), f"{top}/out", f"{top}/checkpoint", limit).awaitTermination()
    return I.ingested(spark, f"{top}/out").select("title", "url", F.length("intro").cast("long").alias("chars"))


def resumed_batches(spark, sf):
    return _landed(spark, sf)


def ingest_with_limit(spark, sf):
    return _landed(spark, sf, limit=spark.read.parquet(f"{sf}/documents.parquet").count() // 2)


QUERIES = {f.__name__: f for f in (resumed_batches, ingest_with_limit)}

_TAKEN = r"""p AS (SELECT doc_id, (doc_id // 20 // 8) % 2 AS part, array_to_string(list_slice(regexp_extract_all(text, '[^\s]+'), 1, 2), ' ') AS title, trim(text, BLANKS) AS intro FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL AND doc_id % 13 <> 7),
g AS (SELECT * FROM p WHERE title <> '' AND length(intro) >= 180 AND NOT starts_with(lower(title), 'liste de') AND NOT starts_with(lower(title), 'chronologie de') AND NOT regexp_matches(lower(intro), 'peut désigner|peuvent désigner|page d[''’]homonymie')),
f AS (SELECT *, row_number() OVER (ORDER BY part, doc_id) AS n FROM (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY lower(title) ORDER BY part, doc_id) = 1))""".replace("BLANKS", "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)")
ORACLES = {
    "resumed_batches": f"WITH {_TAKEN} SELECT title, 'u/' || doc_id AS url, length(intro)::BIGINT AS chars FROM f",
    "ingest_with_limit": f"WITH {_TAKEN} SELECT title, 'u/' || doc_id AS url, length(intro)::BIGINT AS chars FROM f WHERE n <= (SELECT count(*) // 2 FROM documents)",
}
ORACLES = {name: S.spelt(q) for name, q in ORACLES.items()}
