"""Pages as a stream: text, length filter and features as they arrive, repeated urls dropped within a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stancemill.functions import text as T
from stancemill.operators import boilerplate, features

PAGES = "page_id long, url string, html string, fetched timestamp"


def page_stream(spark: SparkSession, folder: str, least: int = 200, watermark: str = "1 hour") -> DataFrame:
    """A streaming DataFrame over Parquet files of pages that appear in a folder."""
    pages = spark.readStream.schema(PAGES).parquet(folder)
    pages = pages.withWatermark("fetched", watermark).dropDuplicatesWithinWatermark(["url"])
    text = pages.withColumn("text", boilerplate.main_text(F.col("html"))).drop("html").filter(T.long_enough(F.col("text"), least))
    return features.add_features(text, ["_num_tokens", "_num_unique_tokens", "_href_count", "_email_count", "_tld", "_domain"])
