"""Rows of files in the order in which they stand there.

Spark reads a file in splits, and a table has no row order.  Here every row gets its
number in the file and its position over all files (by path): a split is known by
its file and the byte that it begins at, rows of a split by their order in its task.
A first pass counts the rows of every split; running sums of the counts are each
split's offset; the second pass adds them.  Both passes read in parallel, bz2 too
(Spark splits it), and no row is moved: only counts, one per split, are joined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiloom.operators.stage import staged

#: Up to so many splits (some 100 bytes each) their offsets are broadcast; beyond it they are joined by merging.
BROADCAST_SPLITS = 100_000


def sourced(rows: DataFrame) -> DataFrame:
    """Rows just read from files, with `_file` and `_block`: where Spark read them."""
    return rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))


def placed(rows: DataFrame, line: str = "line_no", position: str = "position") -> DataFrame:
    """sourced rows, perhaps filtered or projected, with their number in the file and over all files, both from 1. Only the rows that are left count."""
    rows = rows.withColumn("_at", F.monotonically_increasing_id())
    splits = staged(rows.groupBy("_file", "_block").agg(F.min("_at").alias("_first"), F.count("*").alias("_n")), "splits")
    files = splits.groupBy("_file").agg(F.sum("_n").alias("_lines"))
    before_file = files.select(F.col("_file").alias("_f"), (F.sum("_lines").over(Window.orderBy("_file")) - F.col("_lines")).alias("_files_before"))  # a row per file
    before = F.sum("_n").over(Window.partitionBy("_file").orderBy("_block")) - F.col("_n")  # a row per split
    offsets = splits.select(F.col("_file").alias("_f"), F.col("_block").alias("_b"), "_first", before.alias("_before")).join(before_file, "_f")
    offsets = F.broadcast(offsets) if rows.rdd.getNumPartitions() <= BROADCAST_SPLITS else offsets.hint("merge")
    number = F.col("_before") + F.col("_at") - F.col("_first") + 1
    joined = rows.join(offsets, (F.col("_file") == F.col("_f")) & (F.col("_block") == F.col("_b")))
    return joined.select(*[c for c in rows.columns if c not in ("_at", "_block")], number.alias(line), (F.col("_files_before") + number).alias(position))


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, line_no (from 1 in its file), position (from 1 over the files in the order of their paths), value. Empty lines count and stay; a line feed at a file's end begins no line."""
    return placed(sourced(spark.read.text(path))).select(F.col("_file").alias("file"), "line_no", "position", "value")


def write_in_order(rows: DataFrame, path: str, order: list[str], form: str = "json", **options: str) -> None:
    """Files whose paths and lines are in the order of the columns (which aren't written with form='text')."""
    files = max(2, rows.sparkSession.sparkContext.defaultParallelism)
    ranged = rows.repartitionByRange(files, *order).sortWithinPartitions(*order)
    (ranged.select("value") if form == "text" else ranged).write.format(form).options(**options).save(path)
