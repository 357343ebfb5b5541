"""Queries on redirect chains and patches, with their SQL.

An event redirects to the event of its user before it (by time and id), so a user's
chain ends at the first event; every tenth user's first event redirects to the last,
which makes a circle.  Documents are pages, some of them named like an event.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexiloom.operators import redirects as R
from lexiloom.plans import sql as S


def _links(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").where("user_id is not null and event_id is not null")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    last = F.when(F.col("user_id") % 10 == 0, F.last("event_id").over(whole))
    before = F.coalesce(F.lag("event_id").over(order), last)
    return e.select(F.concat(F.lit("e"), "event_id").alias("source"), F.concat(F.lit("e"), before).alias("target"))


def redirect_ends(spark, sf):
    return R.resolved(_links(spark, sf))


def _patches(spark, sf):
    """Document k is page e<k>; texts stand at the first events, under ids of documents."""
    d = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id is not null")
    pages = d.select(F.col("doc_id").alias("page_id"), F.concat(F.lit("e"), "doc_id").alias("title"), F.col("text").alias("intro"))
    links = _links(spark, sf)
    ends = links.where("target is null").select("source")
    texts = pages.select(F.col("title").alias("source"), F.concat(F.lit("[12]"), F.substring("intro", 1, 300), F.lit("\n\n\n\n\nit's "), "page_id").alias("extract"))
    return R.redirect_patches(pages, ends.join(texts, "source").select(F.col("source").alias("title"), "extract"), links)


def redirect_patches(spark, sf):
    return _patches(spark, sf).select("page_id", F.md5("intro").alias("intro_md5"), "char_count", "word_count")


def redirect_updates(spark, sf):
    return R.update_statements(_patches(spark, sf)).select("page_id", F.md5("statement").alias("statement_md5"))


QUERIES = {f.__name__: f for f in (redirect_ends, redirect_patches, redirect_updates)}

_ENDS = """RECURSIVE w AS (SELECT user_id, event_id, lag(event_id) OVER o AS before, last_value(event_id) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last FROM events WHERE user_id IS NOT NULL AND event_id IS NOT NULL WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id)),
l AS (SELECT 'e' || event_id AS source, 'e' || coalesce(before, CASE WHEN user_id % 10 = 0 THEN last END) AS target FROM w),
t AS (SELECT source AS page, source AS top, 0::BIGINT AS steps FROM l WHERE target IS NULL UNION ALL SELECT l.source, t.top, t.steps + 1 FROM t JOIN l ON l.target = t.page),
ends AS (SELECT source, top AS target, steps FROM l LEFT JOIN t ON t.page = l.source WHERE l.target IS NOT NULL)"""
_PATCHES = rf"""{_ENDS}, x AS (SELECT doc_id, 'e' || doc_id AS title, text, substr(text, 1, 300) || '{chr(10) * 5}it''s ' || doc_id AS extract FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
f AS (SELECT title, regexp_replace(regexp_replace(trim(regexp_replace(extract, '\[\d+\]', '', 'g'), ' {chr(10)}{chr(9)}{chr(13)}'), '\n{{3,}}', '{chr(10) * 2}', 'g'), '^$', '') AS new FROM x JOIN l ON l.source = x.title WHERE l.target IS NULL),
g AS (SELECT doc_id AS page_id, coalesce(a.new, b.new) AS new FROM (SELECT doc_id, 'e' || doc_id AS title, text FROM documents WHERE doc_id IS NOT NULL) p LEFT JOIN f a ON a.title = p.title LEFT JOIN ends ON ends.source = p.title LEFT JOIN f b ON b.title = ends.target WHERE coalesce(a.new, b.new) IS DISTINCT FROM p.text AND coalesce(a.new, b.new) IS NOT NULL),
pt AS (SELECT page_id, new, length(new)::INT AS char_count, len(regexp_extract_all(new, '[^\s]+'))::INT AS word_count FROM g WHERE length(new) >= 100)"""
ORACLES = {
    "redirect_ends": f"WITH {_ENDS} SELECT source, target, steps FROM ends",
    "redirect_patches": f"WITH {_PATCHES} SELECT page_id, md5(new) AS intro_md5, char_count, word_count FROM pt",
    "redirect_updates": f"WITH {_PATCHES} SELECT page_id, md5('UPDATE pages SET intro=''' || replace(new, '''', '''''') || ''', char_count=' || char_count || ', word_count=' || word_count || ' WHERE id=' || page_id || ';') AS statement_md5 FROM pt",
}
ORACLES = {name: S.spelt(q) for name, q in ORACLES.items()}
