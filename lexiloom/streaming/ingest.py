"""Pages taken in batch by batch, each title once, up to a limit, stopped and resumed at any batch.

Landed responses (JSON lines of a summaries service, any number of titles each) are
a file stream, whose checkpoint knows the files that were taken; every batch writes
its new pages to a folder of its own number.  A batch that is run again after a
crash overwrites its folder and looks only at the folders before it, so its rows are
the same.  What has been seen is the output itself (its titles are read, nothing
else), so no state grows beside it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexiloom.functions import text as T
from lexiloom.operators.corpus import global_rank
from lexiloom.operators.stage import staged
from lexiloom.sources.lines import sourced

PAGE_DDL = "title string, intro string, url string"
_RESPONSE = "query struct<pages: map<string, struct<title: string, extract: string, fullurl: string, missing: string>>>"
#: Order of rows: the file, its split, the place in the split's task, the place in a response.
_PLACE = ["_file", "_block", "_at", "_nth"]


def landed_responses(spark: SparkSession, path: str, files_at_once: int | None = None) -> DataFrame:
    """A stream of the lines of landed files, oldest first, with where they were read."""
    reader = spark.readStream.format("text")
    return sourced((reader.option("maxFilesPerTrigger", files_at_once) if files_at_once else reader).load(path))


def pages_of_responses(lines: DataFrame) -> DataFrame:
    """title, intro, url and the places of a batch's lines. Pages said to be missing, those without title or text, and lines that aren't JSON give no row."""
    rows = lines.withColumn("_at", F.monotonically_increasing_id())
    entries = F.map_entries(F.from_json("value", _RESPONSE)["query"]["pages"])
    pages = rows.select("_file", "_block", "_at", F.posexplode(entries).alias("_nth", "_e")).select("_file", "_block", "_at", "_nth", "_e.value.*").where("missing is null")
    found = pages.select("title", T.strip(F.col("extract")).alias("intro"), F.coalesce("fullurl", F.lit("")).alias("url"), *_PLACE)
    return found.where("title <> '' and intro <> ''")


def append_new(batch: DataFrame, batch_id: int, out: str, limit: int | None, least_chars: int) -> None:
    """Writes a batch's new pages to `out`/batch=<id>: the first page of each title (by lower case) that no earlier batch has, as many as the limit leaves."""
    spark = batch.sparkSession
    earlier = spark.read.schema(f"{PAGE_DDL}, batch long").parquet(out).where((F.col("batch") < batch_id) & (F.col("batch") >= 0))
    room = None if limit is None else max(0, limit - earlier.count())
    good = batch.where((F.length("intro") >= least_chars) & ~T.is_excluded_page(F.col("title"), F.col("intro")))
    first = good.groupBy(F.lower("title").alias("_key")).agg(F.min(F.struct(*_PLACE, "title", "intro", "url")).alias("_m")).select("_key", "_m.*")
    fresh = first.join(earlier.select(F.lower("title").alias("_key")), "_key", "left_anti")
    if room is not None:
        fresh = staged(fresh, "ingest")
        if fresh.count() > room:
            fresh = global_rank(fresh, [F.col(c) for c in _PLACE], "_rank").where(F.col("_rank") <= room)
    fresh.select("title", "intro", "url").write.mode("overwrite").parquet(f"{out}/batch={batch_id}")


def ingest(lines: DataFrame, out: str, checkpoint: str, limit: int | None = None, least_chars: int = 180) -> StreamingQuery:
    """Takes what the stream has now and ends. Started again on the same checkpoint it goes on behind the last whole batch."""
    spark = lines.sparkSession
    spark.createDataFrame([], PAGE_DDL).write.mode("overwrite").parquet(f"{out}/batch=-1")  # so that the folder is there
    return lines.writeStream.foreachBatch(lambda df, i: append_new(pages_of_responses(df), i, out, limit, least_chars)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingested(spark: SparkSession, out: str) -> DataFrame:
    """title, intro, url, batch of all whole batches."""
    return spark.read.schema(f"{PAGE_DDL}, batch long").parquet(out)
