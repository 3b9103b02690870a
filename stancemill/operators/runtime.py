"""How models run in tasks: loaded once in each Python worker, fed batches of like lengths, queries encoded once, on the task's device."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.resource import ExecutorResourceRequests, ResourceProfile, ResourceProfileBuilder, TaskResourceRequests
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stancemill.operators.relational import shared_folder

#: Models of this Python worker, by the Loaded that made them.
HELD: dict[str, object] = {}


class Loaded:
    """A model that make() loads where it is first used, once in each Python worker, however many tasks and batches that serves.

    Only make is sent to the tasks, never the model.
    """

    def __init__(self, make: Callable[[], object]):
        self.make, self.key = make, uuid.uuid4().hex

    def get(self):
        if self.key not in HELD:
            HELD[self.key] = self.make()
        return HELD[self.key]


def model_of(given):
    """The model itself, loaded if it is not yet."""
    return given.get() if isinstance(given, Loaded) else given


def like_lengths(lengths: Sequence[int], budget: int, most: int = 256) -> list[list[int]]:
    """Numbers of rows in batches: shortest rows first, each batch with at most budget after padding to its longest, and most rows. A longer row is a batch of its own."""
    out: list[list[int]] = []
    for k in sorted(range(len(lengths)), key=lambda k: (lengths[k], k)):
        if out and len(out[-1]) < most and lengths[k] * (len(out[-1]) + 1) <= budget:
            out[-1].append(k)
        else:
            out.append([k])
    return out


def encoded(model, texts: list[str], budget: int = 1 << 14, size: Callable[[str], int] = len) -> list[np.ndarray]:
    """The encodings of texts in their order, made in batches of like lengths; size measures a text, by default its characters."""
    out: list[np.ndarray] = [None] * len(texts)
    for some in like_lengths([size(t) for t in texts], budget):
        for k, v in zip(some, np.asarray(model.encode([texts[k] for k in some]), float)):
            out[k] = v
    return out


def encode(text: Column, encoder, budget: int = 1 << 14) -> Column:
    """The encoding of a column of texts as an array of doubles; null for a null."""

    @F.arrow_udf("array<double>")
    def work(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = model_of(encoder)
        for b in batches:
            texts = b.to_pylist()
            some = [k for k, t in enumerate(texts) if t is not None]
            made = dict(zip(some, encoded(model, [texts[k] for k in some], budget)))
            yield pa.array([made[k].tolist() if k in made else None for k in range(len(texts))], pa.list_(pa.float64()))

    return work(text)


def encoded_queries(pages: DataFrame, encoder, column: str = "search_query", budget: int = 1 << 14) -> DataFrame:
    """(query, query_vector) of each different query of pages, encoded once in all and written to the shared folder. Null queries have none."""
    spark = pages.sparkSession
    path = f"{shared_folder(spark)}/queries-{uuid.uuid4().hex}"
    asked = pages.select(F.col(column).cast("string").alias("query")).filter("query is not null").distinct()
    asked.withColumn("query_vector", encode(F.col("query"), encoder, budget)).write.parquet(path)
    return spark.read.schema("query string, query_vector array<double>").parquet(path)


def with_query_vectors(pages: DataFrame, encoder, column: str = "search_query", budget: int = 1 << 14) -> DataFrame:
    """pages with query_vector, null for a null query. The written table has a known size, so Spark can broadcast it or split a hot query's pages."""
    return pages.join(encoded_queries(pages, encoder, column, budget), F.col(column) == F.col("query"), "left").drop("query")


def device_profile(resource: str = "gpu", script: str | None = None, cores: int = 1, spark: SparkSession | None = None) -> ResourceProfile:
    """A profile by which each task has a device of its own; script finds an executor's devices, where the cluster's own settings don't."""
    executor = ExecutorResourceRequests().resource(resource, 1, script or "", "").cores(cores)
    return ResourceProfileBuilder().require(executor).require(TaskResourceRequests().cpus(cores).resource(resource, 1)).build


def device(resource: str = "gpu") -> str | None:
    """The address of the device that Spark gave this task; None without one, as on a local master."""
    task = TaskContext.get()
    found = task.resources().get(resource) if task is not None else None
    return found.addresses[0] if found is not None and found.addresses else None


def on_devices(df: DataFrame, work: Callable[[str | None, Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, resource: str = "gpu", profile: ResourceProfile | None = None) -> DataFrame:
    """work(device, batches) over df, one task to a device at a time; as many partitions run at once as there are devices. Without a profile tasks run as any others do."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(device(resource), batches)

    return df.mapInArrow(task, schema, profile=profile) if profile is not None else df.mapInArrow(task, schema)
