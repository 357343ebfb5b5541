"""Many page objects in few files, any of them read alone, and model tables that join without a shuffle.

Objects are rows of Parquet files, ranged and sorted by page, in small row groups
with a Bloom filter on the page: their footers are the index, so the scan of one
page opens the file whose range has it and reads the group that holds it.  Model
tables are bucketed and sorted by word, all alike, so that joins of them by word
need no exchange.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of objects in a row group, and buckets of a model's tables.
GROUP_BYTES, BUCKETS = 1_000_000, 32


def write_packed_objects(rows: DataFrame, path: str, key: str = "page_id") -> None:
    """One object per row: its columns but for the key, as JSON. Keys are unique."""
    body = F.to_json(F.struct(*[c for c in rows.columns if c != key])).alias("object")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packed = rows.select(F.col(key).alias("page_id"), body).repartitionByRange(parts, "page_id").sortWithinPartitions("page_id")
    packed.write.mode("overwrite").option("parquet.block.size", GROUP_BYTES).option("parquet.bloom.filter.enabled#page_id", "true").parquet(path)


def packed_objects(spark: SparkSession, path: str, pages: list | None = None) -> DataFrame:
    """page_id, object of all pages, or of some: these are pushed down to the row groups."""
    rows = spark.read.parquet(path)
    return rows if pages is None else rows.where(F.col("page_id").isin(pages))


def packed_object(spark: SparkSession, path: str, page: int | str) -> str | None:
    """One page's object."""
    found = packed_objects(spark, path).where(F.col("page_id") == page).select("object").take(1)
    return found[0]["object"] if found else None


def write_model_tables(tables: dict[str, DataFrame], database: str, path: str, buckets: int = BUCKETS, key: str = "word") -> None:
    """Each table (idf, neighbours, starters, vectors, a policy's values ...; all have the key) as `database`.`name` under the path, bucketed and sorted by the key."""
    spark = next(iter(tables.values())).sparkSession
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name, df in tables.items():
        df.repartition(buckets, key).write.mode("overwrite").option("path", f"{path}/{name}").bucketBy(buckets, key).sortBy(key).format("parquet").saveAsTable(f"{database}.{name}")


def model_table(spark: SparkSession, database: str, name: str) -> DataFrame:
    return spark.table(f"{database}.{name}")
