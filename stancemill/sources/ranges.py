"""Work that survives failures: keys are cut into ranges that are written down, and each range has a commit of its own.

A task writes the rows of a range to a file and then a line in the manifest that names it. Only files that the
manifest names are read, so half a range is never seen; a range that is done twice, by a retried or a doubled
task, has one line, of the last. A later run plans only the keys that no committed range has.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from stancemill.sources import io

STATUS = "range long, rows long, error string"


def located(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """File system and path of a path or URI."""
    if "://" in path or path.startswith("file:/"):
        return pyarrow.fs.FileSystem.from_uri(path if "://" in path else "file://" + path[len("file:") :])
    return pyarrow.fs.LocalFileSystem(), path


@dataclass(frozen=True)
class Run:
    """One run's commits under a path."""

    path: str
    name: str

    def line(self, number: int) -> str:
        return f"manifest/{self.name}-{number}.json"

    def done(self, number: int) -> bool:
        store, top = located(self.path)
        return store.get_file_info(f"{top}/{self.line(number)}").type == pyarrow.fs.FileType.File

    def commit(self, number: int, rows: pa.Table) -> None:
        """Writes the rows, then the line that names their file. Files get their names when they are whole."""
        store, top = located(self.path)
        for folder in ("data", "manifest"):
            store.create_dir(f"{top}/{folder}", recursive=True)
        name = f"{self.name}-{number}-{uuid.uuid4().hex}.parquet"
        pq.write_table(rows, f"{top}/data/_{name}", filesystem=store)
        store.move(f"{top}/data/_{name}", f"{top}/data/{name}")
        line = json.dumps({"run": self.name, "range": number, "file": name, "rows": rows.num_rows}).encode()
        with store.open_output_stream(f"{top}/manifest/_{name}") as out:
            out.write(line)
        store.move(f"{top}/manifest/_{name}", f"{top}/{self.line(number)}")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(run, range, file, rows) of the committed ranges."""
    schema = "run string, range long, file string, rows long"
    return spark.read.schema(schema).json(f"{path}/manifest") if io.exists(spark, f"{path}/manifest") else spark.createDataFrame([], schema)


def committed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all committed ranges. Files that no line names, of tries that failed or were repeated, are left out."""
    if not io.exists(spark, f"{path}/data"):
        return spark.createDataFrame([], schema)
    files = manifest(spark, path).select(F.col("file").alias("_file"))
    rows = spark.read.schema(schema).parquet(f"{path}/data").withColumn("_name", F.col("_metadata.file_name"))
    return rows.join(files, F.col("_name") == F.col("_file"), "left_semi").drop("_name")


def settled_keys(spark: SparkSession, path: str, key: str, kind: str) -> DataFrame:
    """The keys of all committed ranges, those without rows too."""
    if not io.exists(spark, f"{path}/plan"):
        return spark.createDataFrame([], f"{key} {kind}")
    plan = spark.read.schema(f"{key} {kind}, range long, run string").parquet(f"{path}/plan")
    return plan.join(manifest(spark, path).select("run", "range"), ["run", "range"], "left_semi").select(key)


def numbered(keys: DataFrame, rows: int) -> DataFrame:
    """keys with range: dealt in turn to ranges of about so many rows."""
    n = max(1, -(-keys.count() // rows))
    return keys.repartition(n).withColumn("range", F.spark_partition_id().cast("long"))


def run_ranges(keys: DataFrame, path: str, work: Callable[[pa.Table], pa.Table], strict: bool = True) -> DataFrame:
    """Does work(rows of a range) for each range of keys (range, ...), commits what it gives, and returns (range, rows, error).

    The plan is written first, so that every try of a task sees the same ranges; a retried task leaves out those that
    are committed. An error in a range leaves the other ranges as they are; with strict it is raised once those are done.
    """
    spark = keys.sparkSession
    run = Run(path, uuid.uuid4().hex)
    keys.withColumn("run", F.lit(run.name)).write.mode("append").partitionBy("run").parquet(f"{path}/plan")
    plan = spark.read.schema(StructType([*keys.schema.fields, StructField("run", StringType())])).parquet(f"{path}/plan").filter(F.col("run") == run.name).drop("run")
    names = [c for c in plan.columns if c != "range"]

    def one(number: int, rows: pa.Table) -> tuple[int, int | None, str | None]:
        if run.done(number):
            return number, None, None
        try:
            made = work(rows)
            run.commit(number, made)
            return number, made.num_rows, None
        except Exception as error:  # noqa: BLE001 - one range's failure leaves the others
            return number, None, f"{type(error).__name__}: {error}"

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, number = [], None
        status = lambda r: pa.RecordBatch.from_pylist([dict(zip(("range", "rows", "error"), r))], pa.schema([("range", pa.int64()), ("rows", pa.int64()), ("error", pa.string())]))
        for b in batches:
            ranges = b.column("range").to_pylist()
            start = 0
            for k in range(1, len(ranges) + 1):
                if k == len(ranges) or ranges[k] != ranges[start]:
                    if held and ranges[start] != number:
                        yield status(one(number, pa.Table.from_batches(held)))
                        held = []
                    number = ranges[start]
                    held.append(b.slice(start, k - start).select(names))
                    start = k
        if held:
            yield status(one(number, pa.Table.from_batches(held)))

    statuses = f"{path}/status/{run.name}"
    plan.repartition("range").sortWithinPartitions("range").mapInArrow(task, STATUS).write.parquet(statuses)
    out = spark.read.schema(STATUS).parquet(statuses)
    if strict and (bad := out.filter("error is not null").agg(F.count("*").alias("n"), F.min("error").alias("error")).first())["n"]:
        raise RuntimeError(f"{bad['n']} ranges failed, of which a later run does the keys again; one of the errors: {bad['error']}")
    return out
