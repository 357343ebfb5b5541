"""Redirects followed to their ends, and the patches that fetched texts make of pages.

Chains are followed by pointer doubling: in every round each page takes over the
pointer of the page that it points to, so a chain of n redirects takes log2(n)
joins whatever its length.  Pages whose pointer has reached an end leave the rounds and are written once,
so an end that many pages share is no hot key.  A round in which no page arrives
is the last: chains of every length up to the longest have pages that arrive in each
round before, so what still points on runs into a circle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.functions import text as T
from lexiloom.operators.stage import staged


def resolved(links: DataFrame) -> DataFrame:
    """links(source, target) -> source, target, steps: the end of each chain and how many redirects lead to it; both null where there is none (a circle, or a chain into one).

    Of several targets of a source the smallest counts; rows without source or target are left out.
    """
    edges = links.where("source is not null and target is not null").groupBy("source").agg(F.min("target").alias("target"))
    active = staged(edges.select("source", "target", F.lit(1).cast("long").alias("steps")), "redirects")
    arrived, left = active.where(F.lit(False)), active.count()
    while left:
        pointers = [df.select(F.col("source").alias("target"), F.col("target").alias("_next"), F.col("steps").alias("_more"), F.lit(there).alias("_arrived")) for df, there in ((active, False), (arrived, True))]
        jumped = active.join(pointers[0].union(pointers[1]), "target", "left").select(
            "source", F.coalesce("_next", "target").alias("target"), (F.col("steps") + F.coalesce("_more", F.lit(0))).alias("steps"), (F.col("_next").isNull() | F.col("_arrived")).alias("arrived"))
        jumped = staged(jumped, "redirects")
        arrived, active, before = arrived.union(jumped.where("arrived").drop("arrived")), jumped.where("not arrived").drop("arrived"), left
        left = active.count()
        if left == before:
            break
    none = active.select("source", F.lit(None).cast(edges.schema["target"].dataType).alias("target"), F.lit(None).cast("long").alias("steps"))
    return arrived.union(none)


def cleaned(extract: Column) -> Column:
    """A fetched text without reference marks and spare empty lines."""
    return T.strip(F.regexp_replace(F.regexp_replace(T.strip(extract), r"\[\d+\]", ""), r"\n{3,}", "\n\n"))


def redirect_patches(pages: DataFrame, fetched: DataFrame, links: DataFrame, least_chars: int = 100) -> DataFrame:
    """page_id, intro, char_count, word_count of the pages whose text changes.

    pages(page_id, title, intro); fetched(title, extract) by the titles at which the texts stand; links(source, target).
    A page takes the text of its own title, else that of the title to which it is redirected, if it is long enough.
    Underscores in titles are spaces; of several texts of a title the longest counts (of these the first by order).
    """
    plain = F.replace("title", F.lit("_"), F.lit(" "))
    text = cleaned(F.col("extract"))
    found = fetched.where("extract is not null").select(plain.alias("_at"), text.alias("_text")).where(F.length("_text") >= least_chars)
    best = found.groupBy("_at").agg(F.min(F.struct((-F.length("_text")).alias("n"), F.col("_text").alias("t"))).alias("m")).select("_at", F.col("m.t").alias("_text"))
    ends = resolved(links.select(F.replace("source", F.lit("_"), F.lit(" ")).alias("source"), F.replace("target", F.lit("_"), F.lit(" ")).alias("target"))).where("target is not null")
    asked = pages.select("page_id", "intro", plain.alias("_title"))
    own = best.select(F.col("_at").alias("_title"), F.col("_text").alias("_own"))
    led = ends.join(best, ends.target == best._at).select(F.col("source").alias("_title"), F.col("_text").alias("_led"))
    joined = asked.join(own, "_title", "left").join(led, "_title", "left").withColumn("new", F.coalesce("_own", "_led"))
    changed = joined.where(F.col("new").isNotNull() & ~F.col("new").eqNullSafe(F.col("intro")))
    return changed.select("page_id", F.col("new").alias("intro"), F.length("new").alias("char_count"), T.words_by_blanks(F.col("new")).alias("word_count"))


def update_statements(patches: DataFrame, table: str = "pages") -> DataFrame:
    """page_id, statement: a patch as an SQL UPDATE; quotes in texts are doubled."""
    quoted = F.concat(F.lit("'"), F.replace("intro", F.lit("'"), F.lit("''")), F.lit("'"))
    return patches.select("page_id", F.concat(F.lit(f"UPDATE {table} SET intro="), quoted, F.lit(", char_count="), "char_count", F.lit(", word_count="), "word_count", F.lit(" WHERE id="), "page_id", F.lit(";")).alias("statement"))
