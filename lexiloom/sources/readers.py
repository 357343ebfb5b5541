"""Readers and writers: pages as JSON lines, wiki dumps, rankings, dictionaries, vectors, model tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiloom.functions import text as X
from lexiloom.sources.lines import numbered_lines, placed, sourced

PAGE = T.StructType([T.StructField("title", T.StringType()), T.StructField("intro", T.StringType()), T.StructField("url", T.StringType())])
DUMP = T.StructType(
    [
        T.StructField("title", T.StringType()),
        T.StructField("ns", T.LongType()),
        T.StructField("redirect", T.StructType([T.StructField("_title", T.StringType())])),
        T.StructField("revision", T.StructType([T.StructField("text", T.StringType())])),
    ]
)


def _filled(c: str):
    return F.when(F.col(c) != "", F.col(c))


def page_faults(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no, fault of every filled line of JSON-lines files that isn't a JSON object or lacks a title or intro."""
    return _checked(spark, path).where("fault is not null").select("file", "line_no", "fault")


def _checked(spark: SparkSession, path: str) -> DataFrame:
    lines = numbered_lines(spark, path).where(F.trim("value") != "")
    schema = "title string, intro string, url string, _broken string"
    rows = lines.withColumn("_p", F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}))
    fault = (
        F.when(F.col("_p._broken").isNotNull() | ~F.trim("value").startswith("{"), "not a JSON object")
        .when(F.col("_p.title").isNull(), "missing required key 'title'")
        .when(F.col("_p.intro").isNull(), "missing required key 'intro'")
    )
    return rows.select("file", "line_no", fault.alias("fault"), "_p.title", "_p.intro", "_p.url")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Strict: a line without title or intro, or one that isn't JSON, fails the query with its file and line number. Empty lines are skipped."""
    rows = _checked(spark, path)
    stop = F.raise_error(F.concat("file", F.lit(":"), "line_no", F.lit(" page without title or intro: "), "fault"))
    return rows.select(F.when(F.col("fault").isNotNull(), stop).otherwise(F.col("title")).alias("title"), "intro", F.coalesce("url", F.lit("")).alias("url"))


def read_pages_tolerant(spark: SparkSession, path: str) -> DataFrame:
    """Rows that aren't JSON or have no title or text are skipped; the text is the first filled of intro, summary, text; page_id the first of id, page_id that is filled and not 0, else the row's number among the rows that are left, in the order of files and lines."""
    schema = "id long, page_id long, title string, intro string, summary string, text string, url string"
    rows = sourced(spark.read.text(path)).withColumn("_p", F.from_json("value", schema)).select("_p.*", "_file", "_block")
    given = [F.when(F.col(c) != 0, F.col(c)).alias(c) for c in ("id", "page_id")]
    rows = rows.select(*given, _filled("title").alias("title"), F.coalesce(_filled("intro"), _filled("summary"), _filled("text")).alias("intro"), F.coalesce("url", F.lit("")).alias("url"), "_file", "_block")
    kept = placed(rows.where("title is not null and intro is not null"))
    return kept.select(F.coalesce("id", "page_id", "position").alias("page_id"), "title", "intro", "url")


def write_pages(pages: DataFrame, path: str) -> None:
    pages.select("title", "intro", "url").write.mode("overwrite").json(path)


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    """title, intro of the articles (no redirects, no other name spaces) of a MediaWiki XML dump; bz2 is read as it is."""
    rows = spark.read.format("xml").option("rowTag", "page").schema(DUMP).load(path)
    kept = rows.where((F.col("ns") == 0) & F.col("redirect").isNull() & X.is_article_title(F.col("title")))
    return kept.select("title", X.extract_intro(F.coalesce("revision.text", F.lit(""))).alias("intro"))


def read_pageviews(spark: SparkSession, path: str, month: str, prefix: str = "fr.wikipedia ") -> DataFrame:
    """title, month, n of a dump's lines with the prefix; lines without a number of views are dropped."""
    parts = F.split("value", " ")
    rows = spark.read.text(path).where(F.col("value").startswith(prefix))
    rows = rows.select(F.replace(F.get(parts, F.lit(1)), F.lit("_"), F.lit(" ")).alias("title"), F.lit(month).alias("month"), F.expr("try_cast(get(split(value, ' '), 3) as long)").alias("n"))
    return rows.where(F.col("n").isNotNull() & X.is_article_title(F.col("title")))


def write_ranking(ranking: DataFrame, path: str) -> None:
    ranking.select("rank", "title", "views").orderBy("rank").write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def read_ranking(spark: SparkSession, path: str) -> DataFrame:
    """title, rank, views; a title's greatest rank counts."""
    rows = spark.read.schema("rank int, title string, views long").option("sep", "\t").option("header", True).csv(path)
    return rows.groupBy("title").agg(F.max(F.struct("rank", "views")).alias("m")).select("title", "m.rank", "m.views")


def read_qids(spark: SparkSession, path: str, n: int) -> DataFrame:
    """qid, rank of the first n rows of a (gz) CSV of qid, score with a header: the file is sorted by score, so a row's place is its rank."""
    rows = spark.read.option("header", True).csv(path)
    rows = sourced(rows).select(F.col(f"`{rows.columns[0]}`").alias("qid"), "_file", "_block")
    return placed(rows).where(F.col("position") <= n).select("qid", F.col("position").alias("rank"))


def read_dictionary(spark: SparkSession, path: str, lower_first: bool = True) -> DataFrame:
    """word: entries of a Hunspell dictionary (count line and flags left out), lower-cased, alphabetic, two letters or more, with their accentless twins. lower_first False: capitalised entries are dropped instead."""
    entry = F.split("value", "/")[0]
    rows = spark.read.text(path).select(F.trim(entry).alias("w")).where(~F.col("w").rlike(r"^[0-9]*$"))
    rows = rows.withColumn("w", F.lower("w")) if lower_first else rows.where(F.col("w") == F.lower("w"))
    good = rows.where(F.col("w").rlike(r"^\p{L}{2,}$"))
    return good.select(F.col("w").alias("word")).union(good.select(X.strip_accents(F.col("w")).alias("word"))).distinct()


def accent_restorer(dictionary: DataFrame) -> DataFrame:
    """plain, word: the alphabetically first accented entry of every accentless form."""
    both = dictionary.select(X.strip_accents(F.col("word")).alias("plain"), "word").where("plain <> word")
    return both.groupBy("plain").agg(F.min("word").alias("word"))


def restored(words: DataFrame, restorer: DataFrame, supplement: DataFrame, least: int = 4) -> DataFrame:
    """words(word) with `restored`: the supplement's form, else (from `least` letters on) the dictionary's, else the word."""
    a, b = supplement.select(F.col("plain").alias("word"), F.col("word").alias("_s")), restorer.select(F.col("plain").alias("word"), F.col("word").alias("_d"))
    found = words.join(a, "word", "left").join(b, "word", "left")
    return found.select("word", F.coalesce("_s", F.when(F.length("word") >= least, F.col("_d")), "word").alias("restored"))


def lemmas(forms: DataFrame, table: DataFrame, blocked: list[str]) -> DataFrame:
    """forms(form) with their lemma where the table (form, lemma) has another word that isn't blocked."""
    good = table.where((F.col("form") != F.col("lemma")) & ~F.col("lemma").isin(blocked))
    return forms.join(good, "form", "left").select("form", F.coalesce("lemma", "form").alias("lemma"))


def read_vectors(spark: SparkSession, path: str, vocabulary: DataFrame, size: int) -> DataFrame:
    """word, vec (unit length) of a text file of `word v1 v2 ...`: lines whose word's canonical form, or the word itself, is in the vocabulary(word); the first such line in the file's order counts. Vectors of another size or of no length don't."""
    parts = F.split(F.rtrim("value"), " ")
    rows = placed(sourced(spark.read.text(path))).select("position", F.get(parts, F.lit(0)).alias("raw"), F.transform(F.slice(parts, 2, size), lambda x: x.try_cast("float")).alias("vec"), F.size(parts).alias("n"))
    from lexiloom.operators.vectors import unit

    rows = rows.where((F.col("n") == size + 1) & F.forall("vec", lambda x: x.isNotNull())).withColumn("canon", X.canonical_word(F.col("raw"))).withColumn("vec", unit(F.col("vec"))).where("vec is not null")
    words = vocabulary.select("word").distinct()
    by_canon = rows.join(words, rows.canon == words.word, "left_semi").select(F.col("canon").alias("word"), "position", "vec")
    by_raw = rows.join(words, rows.canon == words.word, "left_anti").join(words, rows.raw == words.word, "left_semi").select(F.col("raw").alias("word"), "position", "vec")
    return by_canon.union(by_raw).groupBy("word").agg(F.min_by("vec", "position").alias("vec"))


def write_model(idf: DataFrame, neighbours: DataFrame, starters: DataFrame, path: str) -> None:
    for name, df in (("idf", idf), ("neighbours", neighbours), ("starters", starters)):
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def read_model(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(spark.read.parquet(f"{path}/{name}") for name in ("idf", "neighbours", "starters"))


def write_page_objects(df: DataFrame, path: str, key: str = "page_id") -> None:
    """One folder of JSON per page, as an object store serves them."""
    df.repartition(key).write.mode("overwrite").partitionBy(key).json(path)
