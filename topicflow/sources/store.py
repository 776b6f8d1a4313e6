"""Article store: parquet tables of articles and rejected urls, source lists, stage files.

Articles lie in folders by the date of their parse time, so a run that asks for fresh ones lists and
reads the folders of their days.  Times that are no times lie in the folder of the null date, which
every read takes in: they are for the reader to refuse.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.ml.util import MLReadable, MLWritable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Times stay strings in the store and are parsed on use.
ARTICLES = T.StructType(
    [T.StructField(name, T.StringType()) for name in ("url", "title", "content", "published_at", "parse_datetime")]
)
PARSE_DATE = T.StructField("parse_date", T.DateType())
REJECTED = T.StructType([T.StructField("url", T.StringType())])
WORD_VECTORS = T.StructType(
    [T.StructField("word", T.StringType()), T.StructField("vector", T.ArrayType(T.DoubleType()))]
)


def read_sources(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=REJECTED)


def _read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path).select(schema.fieldNames())


def read_articles(spark: SparkSession, path: str, since: str | None = None) -> DataFrame:
    """The stored articles; with ``since``, those of the days that may hold articles parsed since then.

    A day more is read than asked for, as sessions of other time zones may have written.  Which rows of
    these days are fresh is for ``fresh_since`` to say.
    """
    stored = spark.read.schema(T.StructType([*ARTICLES.fields, PARSE_DATE])).parquet(path)
    if since is not None:
        first = F.date_sub(F.lit(since).cast("timestamp").cast("date"), 1)
        stored = stored.where((F.col("parse_date") >= first) | F.col("parse_date").isNull())
    return stored.select(ARTICLES.fieldNames())


def read_rejected(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, REJECTED)


def _conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    return df.select(*(F.col(f.name).cast(f.dataType) for f in schema))


def append_articles(df: DataFrame, path: str) -> None:
    date = F.try_to_timestamp("parse_datetime").cast("date").alias(PARSE_DATE.name)
    _conform(df, ARTICLES).select("*", date).write.mode("append").partitionBy(PARSE_DATE.name).parquet(path)


def append_rejected(df: DataFrame, path: str) -> None:
    _conform(df, REJECTED).write.mode("append").parquet(path)


def _empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def _create(spark: SparkSession, path: str, schema: T.StructType, mode: str) -> None:
    if schema == ARTICLES:  # partitioned: a folder without a file
        _empty(spark, T.StructType([*schema.fields, PARSE_DATE])).write.mode(mode).partitionBy(PARSE_DATE.name).parquet(path)
    else:
        _empty(spark, schema).write.mode(mode).parquet(path)


def ensure_table(spark: SparkSession, path: str, schema: T.StructType) -> None:
    """Create an empty table unless one is there."""
    try:
        spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        _create(spark, path, schema, "ignore")


def ensure_tables(spark: SparkSession, articles: str, rejected: str) -> None:
    ensure_table(spark, articles, ARTICLES)
    ensure_table(spark, rejected, REJECTED)


def reset_table(spark: SparkSession, path: str, schema: T.StructType) -> None:
    _create(spark, path, schema, "overwrite")


def urls_to_ignore(articles: DataFrame, rejected: DataFrame) -> DataFrame:
    """Stored and rejected urls, repeats kept."""
    return articles.select("url").unionByName(rejected.select("url"))


def write_topic_names(names: DataFrame, path: str) -> None:
    """One JSON folder per level."""
    names.write.mode("overwrite").partitionBy("level").json(path)


def export_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def save_stage(stage: DataFrame | MLWritable, path: str) -> None:
    """Persist a table or a fitted model between jobs."""
    if isinstance(stage, DataFrame):
        stage.write.mode("overwrite").parquet(path)
    else:
        stage.write().overwrite().save(path)


def load_stage(spark: SparkSession, path: str, model: type[MLReadable] | None = None):
    return spark.read.parquet(path) if model is None else model.load(path)


def load_word_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(WORD_VECTORS).parquet(path)
