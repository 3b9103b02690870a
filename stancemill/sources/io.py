"""Readers and writers: tables, questions, id lists, pages, and caches that let a job resume."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from stancemill.functions.text import strip
from stancemill.operators.relational import dense_ids, drop_ids

QUESTIONS = "search_query string, category string"
#: Characters of page texts that read_pages hands on at once.
PAGE_BATCH = 8 << 20


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_table(df: DataFrame, path: str) -> None:
    """A new table: Spark can't overwrite what it reads, so stages write to paths of their own."""
    df.write.parquet(path)


def read_questions(spark: SparkSession, path: str, index: bool = False) -> DataFrame:
    """(search_query, category); index: the files have a first column of row numbers, which is left out."""
    schema = f"_row long, {QUESTIONS}" if index else QUESTIONS
    return spark.read.csv(path, header=True, schema=schema, multiLine=True, escape='"').select("search_query", "category")


def write_questions(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """CSV files; with an order, their first column, which has no name, numbers the rows from 0 in it."""
    if order:
        df = dense_ids(df, order, "_row").select(F.col("_row").alias(" "), *df.columns)
    df.write.csv(path, header=True, escape='"', ignoreLeadingWhiteSpace=bool(order))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line): stripped lines that are not blank."""
    return spark.read.text(path).select(strip(F.col("value")).alias("line")).filter("line <> ''")


def read_json_strings(spark: SparkSession, path: str, name: str = "search_query") -> DataFrame:
    """The distinct strings of files that each hold a JSON array."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<string>")).alias(name)).distinct()


def id_list(ids: DataFrame, column: str = "answer_id") -> DataFrame:
    """(line): the lines of one JSON array of the ids, ascending and nulls last; repeated ids stay, [ and ] have lines of their own."""
    i = ids.groupBy(F.col(column).alias("id")).agg(F.count("*").alias("n")).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n"))))
    first = F.col("id").eqNullSafe(ids.agg(F.min(column)).scalar()) & (F.col("k") == 1)
    rows = i.select(F.lit(1).alias("part"), "id", "k", F.concat(F.when(first, "").otherwise(","), F.coalesce(F.col("id").cast("string"), F.lit("null"))).alias("line"))
    ends = ids.sparkSession.createDataFrame([(0, "["), (2, "]")], "part int, line string")
    ends = ends.select("part", F.lit(None).cast(i.schema["id"].dataType).alias("id"), F.lit(0).cast("long").alias("k"), "line")
    # A list is one file, so one task sorts the ids, spilling where they are many.
    return rows.unionByName(ends).repartition(1).sortWithinPartitions("part", F.col("id").asc_nulls_last(), "k").select("line")


def write_id_list(ids: DataFrame, path: str, column: str = "answer_id") -> None:
    """A folder with one file, which is a JSON array."""
    id_list(ids, column).write.text(path)


def read_id_list(spark: SparkSession, path: str, column: str = "answer_id") -> DataFrame:
    """The integers of JSON arrays, of one line or of several; nulls are left out."""
    return spark.read.text(path).select(F.explode(F.regexp_extract_all("value", F.lit(r"-?\d+"), F.lit(0)).cast("array<bigint>")).alias(column))


def read_pages(spark: SparkSession, paths: DataFrame, folder: str) -> DataFrame:
    """paths (source_path, ...) with source, the file's text; a null or missing path has a null one.

    Only the files named are opened, each by the task that has its row; a path without a leading slash or scheme lies in the folder.
    """

    def read(path: str | None) -> str | None:
        if path is None:
            return None
        whole = path if path.startswith("/") or "://" in path else f"{folder.rstrip('/')}/{path}"
        store, inside = pyarrow.fs.FileSystem.from_uri(whole)
        try:
            with store.open_input_stream(inside, compression=None) as f:
                return f.read().decode("utf-8", "replace")
        except FileNotFoundError:
            return None

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, held, begin = [], 0, 0
            for k, path in enumerate(b.column("source_path").to_pylist(), 1):
                found.append(read(path))
                held += len(found[-1] or "")
                if held >= PAGE_BATCH or k == b.num_rows:
                    rows = b.slice(begin, k - begin)
                    yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(found, pa.string())], names=[*rows.schema.names, "source"])
                    found, held, begin = [], 0, k

    rest = paths.drop("source")
    return rest.mapInArrow(work, StructType([*rest.schema.fields, StructField("source", StringType())]))


def write_pages(pages: DataFrame, folder: str) -> None:
    """(doc_id, html) as a table in place of one small file for each page, in ranges of ids and sorted, so that a look-up by id reads few row groups."""
    pages.repartitionByRange("doc_id").sortWithinPartitions("doc_id").write.parquet(folder)


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def cached(spark: SparkSession, path: str, build) -> DataFrame:
    """The table at path; if it isn't there, what build() gives, written there first."""
    if not exists(spark, path):
        write_table(build(), path)
    return spark.read.parquet(path)


def resumed(inputs: DataFrame, cache: DataFrame | None, column: str, fetch) -> DataFrame:
    """The cache with fetch(inputs it lacks) appended. What the cache holds is looked up once, so inputs repeated in one run are fetched as often."""
    return fetch(inputs) if cache is None else cache.unionByName(fetch(drop_ids(inputs, cache, column, column)))


def resumed_at(spark: SparkSession, path: str, inputs: DataFrame, column: str, fetch) -> DataFrame:
    """The table at path after fetch(inputs it lacks) was appended to it; what an earlier run wrote is not fetched again."""
    lacking = drop_ids(inputs, spark.read.parquet(path), column, column) if exists(spark, path) else inputs
    fetch(lacking).write.mode("append").parquet(path)
    return spark.read.parquet(path)
